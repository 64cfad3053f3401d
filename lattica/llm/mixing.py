"""Mixing sources to target weights by the cube method.

Every document of a source is wanted ``target / source size`` times (0 to 2). The whole part of that is taken of every document,
the rest is an inclusion probability. A flight moves the probabilities of three undecided documents at a time along the
null space of two constraints, documents and words of the source, until one of them is 0 or 1; both totals stay
as they are. Flights run in blocks of one source; each leaves at most two documents undecided, and holds back ``RESERVE`` more, spread over the
sizes from the smallest to the largest. The next round gathers them into fewer blocks, until one block a source is left. Its last documents, the
reserve among them, are landed on the combination that comes nearest to the source's words: of some 2^18 sums one is near even where
a single document holds a good part of its source.

Defined results: a null text has size 0; a null source is a source of its own, the last in order; a source of size 0 has target
0 and takes nothing; repeated rows are documents of their own; a null ``doc_id`` is a row like any other; columns of any names pass through
``take``; long texts count by their words alone; an empty table gives an empty result. Blocks,
orders and directions follow from hashes, so reruns agree. Sources are taken to be few enough to be ordered in one
task (one row each; ids in the millions are fine).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 2048
#: Documents of a block that are left to the landing.
RESERVE = 16
EPS = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, rank, docs, source_size, target) from rows of (source, size).

    Targets share ``share`` of all sizes by weight and stop at ``most`` times the source's size. Reshared excess is a common
    level: target = least(cap, level * weight), where the sources with the least cap per weight are the capped ones.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("rank", turn)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.col("total") - capped) / open_weight
    # The first source, in this order, that its level does not fill sets the level of all after it.
    by = by.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    found = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"]
    target = F.when(found.isNull(), F.col("cap")).otherwise(F.least("cap", found * F.col("weight")))
    return by.select("source", "rank", "docs", "source_size", target.alias("target"))


def flight(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide all but at most two of the probabilities, keeping the sums of ``p`` and of ``p * size``."""
    p = p.astype(float).copy()
    work: list[int] = []
    for i in np.flatnonzero((p > EPS) & (p < 1 - EPS)):
        work.append(int(i))
        if len(work) < 3:
            continue
        a, b, c = work
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        # The sign that moves the first document up is alternated by its place, so that no source's head is favoured.
        sign = 1.0 if a % 2 else -1.0
        step = min((((1 - p[k]) if sign * w > 0 else p[k]) / abs(w)) for k, w in zip(work, u, strict=True) if w)
        for k, w in zip(work, u, strict=True):
            p[k] += sign * step * w
            if p[k] < EPS or p[k] > 1 - EPS:
                p[k] = round(p[k])
        work = [k for k in work if 0 < p[k] < 1]
    return p


def _sums(values: np.ndarray) -> np.ndarray:
    """The sums of all subsets, by the bits of their numbers."""
    out = np.zeros(1)
    for v in values:
        out = np.concatenate([out, out + v])
    return out


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the last few: the combination nearest to the expected words, then to the expected number of documents, then the first.

    Sums of one half are looked up among the sorted sums of the other, so twenty documents take some thousand steps.
    """
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    want, count = float(p[left] @ size[left]), float(p[left].sum())
    half = len(left) // 2
    a, b = _sums(size[left[:half]]), _sums(size[left[half:]])
    na, nb = _sums(np.ones(half)), _sums(np.ones(len(left) - half))
    order = np.lexsort((nb, b))
    at = np.searchsorted(b[order], want - a)
    tries = [(i, order[j]) for step in (-1, 0) for i, j in enumerate(np.clip(at + step, 0, len(b) - 1))]
    i, j = min(tries, key=lambda t: (abs(a[t[0]] + b[t[1]] - want), abs(na[t[0]] + nb[t[1]] - count), t[0], t[1]))
    p = p.copy()
    p[left] = [i >> k & 1 for k in range(half)] + [int(j) >> k & 1 for k in range(len(left) - half)]
    return p


def held_back(p: np.ndarray) -> np.ndarray:
    """Whether a document, of all in order of size, waits for the landing: ``RESERVE`` of the undecided ones, spread evenly."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    out = np.zeros(len(p), dtype=bool)
    if len(open_):
        out[open_[np.unique(np.linspace(0, len(open_) - 1, min(RESERVE, len(open_))).astype(int))]] = True
    return out


def _flown(pdf: pd.DataFrame) -> np.ndarray:
    """The probabilities after a flight of all documents, in order of size, but for those held back."""
    p, size = pdf["p"].to_numpy(dtype=float).copy(), pdf["size"].to_numpy(dtype=float)
    flies = ~held_back(p)
    p[flies] = flight(p[flies], size[flies])
    return p


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "turn", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last").reset_index(drop=True)
    pdf["p"] = _flown(pdf)
    pdf["place"] = np.arange(len(pdf), dtype=np.int64)
    return pdf


def _fly_again(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "block", "place"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    pdf["p"] = _flown(pdf)
    if pdf["last"].iloc[0]:
        pdf["p"] = land(pdf["p"].to_numpy(), pdf["size"].to_numpy(dtype=float))
    return pdf


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (how often the mix takes the document, 0 to ``most``)."""
    return plan_mix(docs.withColumn("size", F.size(words_of(text_of("text"))).cast("long")), weights, share, most, block, seed)


def plan_mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target and copies of rows with doc_id, source and size."""
    scratch = Scratch(sized.sparkSession, "mixing")
    sized = scratch.save(sized.select("doc_id", "source", "size"), "sizes")
    targets = scratch.save(source_targets(sized, weights, share, most), "targets").withColumnRenamed("source", "of")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("of")))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.ceil(F.col("docs") / block).cast("int")
    rows = rows.withColumn("whole", F.floor(times + EPS).cast("int")).withColumn("p", F.greatest(F.lit(0.0), times - F.col("whole")))
    rows = rows.withColumn("turn", F.xxhash64("doc_id", "size", F.lit(seed))).withColumn("block", F.pmod(F.xxhash64("turn"), blocks).cast("int"))
    keep = ["doc_id", "size", "source_size", "target", "rank", "whole", "block"]
    rows = rows.select(*keep, "turn", "p")
    kinds = dict(rows.dtypes)
    # A block holds some ``block`` documents, however many its source has.
    flown = rows.groupBy("rank", "block").applyInPandas(_fly, ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", place bigint").drop("turn")
    flown = scratch.save(flown, "flight")
    open_ = flown.where("p > 0 and p < 1").select("rank", "block", "place", "size", "p")
    most_blocks = int(targets.agg(F.coalesce(F.max(F.ceil(F.col("docs") / block)), F.lit(0))).first()[0])
    rounds, left = [], most_blocks
    group, width = 1, max(2, block // (RESERVE + 2))  # a block leaves so many documents at most
    while True:
        group *= width
        left = -(-left // width)
        more = open_.withColumn("g", F.floor(F.col("block") / group).cast("int")).withColumn("last", F.lit(left <= 1))
        schema = "rank int, block int, place bigint, size bigint, p double, g int, last boolean"
        done = scratch.save(more.groupBy("rank", "g").applyInPandas(_fly_again, schema).select("rank", "block", "place", "size", "p"), "flight")
        rounds.append(done.where("p = 0 or p = 1"))
        open_ = done.where("p > 0 and p < 1")
        if left <= 1:
            break
    landed = rounds[0]
    for x in rounds[1:]:
        landed = landed.unionByName(x)
    landed = landed.select("rank", "block", "place", F.col("p").alias("landed"))
    out = flown.join(landed, ["rank", "block", "place"], "left")
    copies = F.col("whole") + F.coalesce("landed", F.col("p")).cast("int")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken. Rows are matched by a hash of all that decides: id, text and source."""
    text = text_of("text")
    key = F.xxhash64("doc_id", "text", F.coalesce("source", F.lit("")), F.col("source").isNull())
    sized = docs.select(key.alias("doc_id"), "source", F.size(words_of(text)).cast("long").alias("size"))
    plan = plan_mix(sized, **options).groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).withColumnRenamed("doc_id", "plan_key")
    # The columns go along as one, so that none clashes with a name used here.
    df = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).join(plan.hint("merge"), F.col("key") == F.col("plan_key"))
    return deal(df).select("row.*")


def deal(df: DataFrame) -> DataFrame:
    """Rows that repeat share their copies evenly; what is left over goes to the first of them by a running number."""
    once = df.where("rows = 1").withColumn("n", F.col("copies").cast("int"))
    many = df.where("rows > 1").withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("plan_key")))
    share = F.floor(F.col("copies") / F.col("rows")) + (F.col("i") <= F.col("copies") % F.col("rows")).cast("int")
    both = once.unionByName(many.withColumn("n", share.cast("int")).drop("i"))
    return both.where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))))


def mix_digest(plan: DataFrame) -> DataFrame:
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))

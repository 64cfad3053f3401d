"""Importance resampling towards a target distribution, over hashed word n-grams.

Texts become features in Arrow batches: ``ascii_lower``, ``split_pattern_regex`` and ``list_flatten`` give the words of a whole batch,
``dictionary_encode`` numbers them; runs of n words are pairs of the number of a shorter run and the number of the word that follows, made
by shifting the number arrays, and only distinct pairs are spelled out and hashed (CRC). Each document's buckets are written once. One pass counts
them (a task sends one row for each bucket it met), which gives every bucket a gain: the scaled log ratio of its smoothed share in the target and
in the documents. The next pass takes the gains by bucket and reduces them by document. A document's score is its mean gain plus Gumbel noise from
a hash of its id, so that the highest scores are a draw without replacement in proportion to importance.

The draw needs no global sort: scores are whole numbers within a bound that follows from 64-bit counts (some 200,000 values), so
their histogram gives the score of the last rank, and only documents at or above it are ordered, in ranges.

Defined results: a null text has no words; without features the weight is 0; documents of fewer than ``least_words`` words have a score and
no rank; ties go to the smaller id, null ids (hashed as the empty text) last, then to fewer features; repeated rows are documents of their own; an empty target
has shares of the smoothing alone; a very long text is a row like another; extra columns are ignored by ``importance`` and kept by ``resample``; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, number_rows, small_batches, text_of
from .mixing import deal

#: What stands between words, after A-Z are lower-cased: all of ASCII but digits and letters.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000


def ngram_buckets(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parents, bucket of each feature, words of each text): parents are places in ``texts``; features go by length, then place."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), APART)
    words, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    worded = pc.greater(pc.binary_length(words), 0)
    words, parents = words.filter(worded), parents.filter(worded).to_numpy(zero_copy_only=False)
    encoded = words.dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    numbers = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = [w.encode() for w in encoded.dictionary.to_pylist()]
    n_words = np.bincount(parents, minlength=len(texts))
    crc = lambda runs: np.fromiter((zlib.crc32(r) % buckets for r in runs), dtype=np.int32, count=len(runs))
    all_parents, found = [parents], [crc(spelled)[numbers] if len(spelled) else np.empty(0, dtype=np.int32)]
    runs, codes = spelled, numbers
    for n in range(2, longest + 1):
        # A run of n words starts where its text goes on for n - 1 more.
        inside = parents[: max(0, len(parents) - n + 1)] == parents[n - 1 :]
        codes, parts = codes[: len(inside)], numbers[n - 1 :]
        pairs = codes * len(spelled) + parts
        distinct, inverse = np.unique(pairs[inside], return_inverse=True)
        shorter = runs
        runs = [shorter[p // len(spelled)] + b" " + spelled[p % len(spelled)] for p in distinct.tolist()]
        codes = np.zeros(len(inside), dtype=np.int64)
        codes[inside] = inverse
        all_parents.append(parents[: len(inside)][inside])
        found.append(crc(runs)[inverse] if len(runs) else np.empty(0, dtype=np.int32))
    return np.concatenate(all_parents), np.concatenate(found), n_words


def _lists(parents: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    order = np.argsort(parents, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(parents, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order], pa.int32()))


def _features(longest: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parents, found, words = ngram_buckets(batch.column("text"), longest, buckets)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(words, pa.int64()), pa.array(np.bincount(parents, minlength=batch.num_rows), pa.int64()), _lists(parents, found, batch.num_rows)],
                names=[*(c for c in batch.schema.names if c != "text"), "n_words", "n_features", "buckets"],
            )

    return run


def featurize(df: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``df`` without its text, with n_words, n_features and buckets (array of int)."""
    df = df.withColumn("text", text_of(text))
    left = [f for f in df.schema.fields if f.name != "text"]
    return df.mapInArrow(_features(longest, buckets), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in left] + ["n_words bigint, n_features bigint, buckets array<int>"]))


def _count(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column("buckets").flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How often each bucket occurs: as many numbers as buckets, summed by Spark."""
    out = [0] * buckets
    for r in features.select("buckets").mapInArrow(_count(buckets), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: list[int], target: list[int], scale: float = 1000.0) -> list[int]:
    s_all, t_all, b = float(sum(source)), float(sum(target)), len(source)
    return [math.floor(scale * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(source, target, strict=True)]


def _weigh(gains: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            taken = gains[lists.flatten().to_numpy(zero_copy_only=False)]
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.zeros(len(n), dtype=np.int64)
            some = n > 0
            if some.any():  # texts without features have no segment
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                sums[some] = np.add.reduceat(taken, starts[some])
            names = [c for c in batch.schema.names if c != "buckets"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sums // np.maximum(n, 1), pa.int64())], names=[*names, "weight"])

    return run


def gumbel(id_: Column, seed: str) -> Column:
    """floor(1000 * g), g of the standard Gumbel distribution, from the first 8 hex digits of sha256(seed:id)."""
    hexes = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(hexes, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u)))


def importance(docs: DataFrame, target: DataFrame, id_: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: str = "2024", least_words: int = 20, percent: int = 10, carry: tuple[Column, ...] = ()) -> DataFrame:
    """``carry``, doc_id, n_words, n_features, weight, score and rank (null where not drawn) of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    with small_batches(spark):
        features = scratch.save(featurize(docs.select(*carry, F.col(id_).alias("doc_id"), F.col(text).alias("text")), longest=longest, buckets=buckets), "features")
        wanted = bucket_counts(featurize(target.select(F.col(target_text).alias("text")), longest=longest, buckets=buckets), buckets)
        gains = np.array(bucket_gains(bucket_counts(features, buckets), wanted), dtype=np.int64)
        kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in features.schema.fields if f.name != "buckets")
        weighed = features.mapInArrow(_weigh(gains), f"{kept}, weight bigint")
        weighed = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("__tie", F.monotonically_increasing_id())
        scored = scratch.save(weighed, "scored")
    scratch.drop(features)
    return _ranked(scored, scratch, least_words, percent)


def _ranked(scored: DataFrame, scratch: Scratch, least_words: int, percent: int) -> DataFrame:
    fit = F.col("n_words") >= least_words
    # Gains lie within 1000 * ln of a ratio of 64-bit counts, noise within 1000 * ln(23) below and 22,900 above: some 200,000 scores at most.
    histogram = sorted(((r["score"], r["n"]) for r in scored.where(fit).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = sum(n for _, n in histogram) * percent // 100
    last, met = None, 0
    for score, n in histogram:
        if met >= drawn:
            break
        last, met = score, met + n
    none = F.lit(None).cast("bigint")
    if last is None:
        return scored.drop("__tie").withColumn("rank", none)
    near = fit & (F.col("score") >= last)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("__tie").asc())
    placed = number_rows(scored.where(near), scratch, *order)
    placed = placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    return placed.unionByName(scored.where(~near).withColumn("rank", none)).drop("__tie")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Rows are matched by a hash of id and text; equal ones share their draws."""
    key = F.xxhash64("doc_id", "text")
    plan = importance(docs, target, carry=(key.alias("plan_key"),), **options)
    plan = plan.groupBy("plan_key").agg(F.count("rank").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    # The columns go along as one, so that none clashes with a name used here.
    df = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).join(plan, F.col("key") == F.col("plan_key"))
    return deal(df).select("row.*")

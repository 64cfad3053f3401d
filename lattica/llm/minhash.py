"""Near-duplicates by MinHash: universal hash minima, banding, confirmation on full shingle sets, connected components.

1. Each text becomes the set of its distinct word shingles (64-bit hashes), ``bands * rows`` minima and a key of the whole set.
   Texts with equal sets are one class, represented by its least doc_id; only representatives go on.
2. Representatives that share a band meet in a bucket. Every member is compared with the bucket's least and greatest id on full
   sets; confirmed links are joined into components.
3. In a bucket, two members that are neither of the two and lie in different components have not been compared. Members outside the
   bucket's main component are compared with all others, in cells of bounded size, but only pairs whose minima agree often
   enough (six standard deviations below the threshold) and whose first shared band this is. Confirmed links join components.

So every pair that shares a band is either confirmed, refuted, or already connected. With b bands of r rows a link of likeness t
is missed with probability (1 - t^r)^b at most, under 1e-8 by default; ``bands_for`` gives b. Nothing is capped.

Defined results: a null text counts as empty; an empty text, or one without words, has no shingles and is linked with nothing; with
fewer words than a shingle the whole sequence is one shingle; a null ``doc_id`` is its own component (null, kept);
one id is one node: rows that share a doc_id with different texts join the components of all of them, and each reports the size of its own text's set; extra columns are ignored; an empty table gives an empty result; a very long
text is one set, whose size bounds the memory of its comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, text_of
from .components import components

ROWS = 5


def bands_for(percent: int, rows: int = ROWS, missed: float = 1e-8) -> int:
    return ceil(log(missed) / log(1 - (percent / 100) ** rows))


class WordHashes(dict):
    """64-bit hashes of words, kept until there are too many."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        self[word] = value = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes], most: int = 500_000) -> np.ndarray:
        if len(self) > most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. Bytes are lower-cased and split as ASCII, which is what the words ask for."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hashes.of(words)
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def hash_family(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits of each universal hash's minimum over a non-empty set."""
    x = ((values >> np.uint64(32)) ^ values).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512, None] * a + b).min(axis=0), out=least)
    return (least ^ (least >> np.uint32(16))).astype("<u2")


def features(docs: DataFrame, width: int, count: int) -> DataFrame:
    """doc_id, n_shingles, set_key and signature of each row."""
    a, b = hash_family(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        hashes = WordHashes()
        for batch in batches:
            sizes, keys, signs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width, hashes)
                sizes.append(len(s))
                keys.append(xxh3_128_digest(s.tobytes()) if len(s) else None)
                signs.append(minima(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select(F.col("doc_id").cast("long"), text_of("text")).mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, signature binary")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and its whole set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, width, hashes).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), text_of("text")).mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    sizes = (F.size("set_a"), F.size("set_b"))
    near = both.where(100 * F.least(*sizes) >= percent * F.greatest(*sizes))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return near.where(100 * shared >= percent * (sizes[0] + sizes[1] - shared)).select("a", "b")


def compare_cell(percent: int, bands: int, rows: int):
    """Confirms links between different components within one cell (see the module's step 3)."""
    t, count = percent / 100, bands * rows
    least_agreeing = int(count * t - 6 * sqrt(count * t * (1 - t)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        signs = np.frombuffer(b"".join(pdf["signature"]), dtype="<u2").reshape(len(pdf), count)
        comp, ids, sets = pdf["comp"].to_numpy(), pdf["id"].to_numpy(), [np.asarray(s) for s in pdf["shingles"]]
        sizes = np.array([len(s) for s in sets])
        main, band = pdf["main"].iloc[0], pdf["band"].iloc[0]
        asks, others = np.flatnonzero(pdf["asks"].to_numpy()), np.flatnonzero(~pdf["asks"].to_numpy())
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        found = []
        theirs = signs[others]
        for i in asks:
            equal = theirs == signs[i]
            small, big = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            # Two members outside the main component ask each other; one of the two questions is enough.
            once = (comp[others] == main) | (ids[others] > ids[i])
            maybe = np.flatnonzero(once & (comp[others] != comp[i]) & (100 * small >= percent * big) & (equal.sum(axis=1) >= least_agreeing))
            maybe = maybe[equal[maybe].reshape(len(maybe), bands, rows).all(axis=2).argmax(axis=1) == band]
            for j in others[maybe]:
                x, y = find(comp[i]), find(comp[j])
                if x == y:
                    continue
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared >= percent * (sizes[i] + sizes[j] - shared):
                    parent[max(x, y)] = min(x, y)
                    found.append((comp[i], comp[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, bands: int | None = None, cell_rows: int = 1024, cell_shingles: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (which needs doc_id and text)."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, width, percent, rows, bands or bands_for(percent, rows), cell_rows, cell_shingles)


def _near_duplicates(docs: DataFrame, width: int, percent: int, rows: int, bands: int, cell_rows: int, cell_shingles: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "minhash")
    feats = scratch.save(features(docs, width, bands * rows), "features")
    classes = feats.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = scratch.save(classes, "classes")

    step = 2 * rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * step + 1, F.lit(step))))
    banded = classes.select("id", "n", F.posexplode(keys).alias("band", "key"))
    hubs = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").withColumnRenamed("key", "of")
    members = scratch.save(banded.join(hubs, F.col("key") == F.col("of")).drop("of"), "members")

    needed = members.select(F.col("id").alias("needed")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed.hint("shuffle_hash"), F.col("doc_id") == F.col("needed"), "left_semi")
    sets = scratch.save(full_sets(texts, width), "sets")
    pairs = members.where("id != low").select(F.col("low").alias("a"), F.col("id").alias("b")).unionByName(members.where("id != high").select(F.col("id").alias("a"), F.col("high").alias("b"))).distinct()
    first = scratch.save(components(confirmed(pairs, sets, percent), scratch), "components")

    roots = first.select(F.col("id").alias("linked"), "root")
    rest = members.where("id != low and id != high").join(roots, F.col("id") == F.col("linked"), "left").select("key", "band", "id", "n", F.coalesce("root", "id").alias("comp"))
    rest = scratch.save(rest, "rest")
    shares = rest.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    mixed = shares.groupBy("key").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max(F.struct("c", "comp", "w"))["w"].alias("main_w"), F.max("c").alias("main_c"), F.count("*").alias("kinds"))
    cells = lambda c, w: F.greatest(F.lit(1), F.ceil(c / cell_rows), F.ceil(w / cell_shingles)).cast("int")
    mixed = mixed.where("kinds > 1").select(F.col("key").alias("of"), "main", cells(F.col("c"), F.col("w")).alias("wide"), cells(F.col("c") - F.col("main_c"), F.col("w") - F.col("main_w")).alias("tall"))
    open_ = rest.join(mixed, F.col("key") == F.col("of")).drop("of", "n")
    asks = open_.where("comp != main").withColumn("i", F.pmod(F.xxhash64("id"), F.col("tall")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("wide") - 1))).withColumn("asks", F.lit(True))
    others = open_.withColumn("j", F.pmod(F.xxhash64("id", "key"), F.col("wide")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tall") - 1))).withColumn("asks", F.lit(False))
    both = asks.unionByName(others).drop("wide", "tall")
    signs = classes.select(F.col("id").alias("sign_id"), "signature")
    both = both.join(signs, F.col("id") == F.col("sign_id")).join(sets, F.col("id") == F.col("doc_id")).select("key", "i", "j", "band", "id", "comp", "main", "asks", "signature", "shingles")
    more = both.groupBy("key", "i", "j").applyInPandas(compare_cell(percent, bands, rows), "a bigint, b bigint")
    second = components(more, scratch).select(F.col("id").alias("old"), F.col("root").alias("new"))
    final = first.join(second, F.col("root") == F.col("old"), "left").select("id", F.coalesce("new", "root").alias("root"))
    # A class that step 2 left alone is its own component, which step 3 may have joined to another.
    final = scratch.save(final.unionByName(second.join(first, F.col("old") == F.col("id"), "left_anti").select(F.col("old").alias("id"), F.col("new").alias("root"))), "final")

    named = classes.select("set_key", "id").join(final.withColumnRenamed("id", "final_id"), F.col("id") == F.col("final_id"), "left").select(F.col("set_key").alias("class_key"), F.coalesce("root", "id").alias("component"))
    named = scratch.save(named, "named")
    scratch.drop(members, sets, rest)
    out = feats.join(named, F.col("set_key") == F.col("class_key"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

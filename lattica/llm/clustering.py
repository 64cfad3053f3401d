"""Centroid clustering with heap-ordered bounds: exact rounds of assignment and update that rescan few vectors.

Vectors are packed once into blocks of some ``BLOCK``, in a table bucketed by block. In a block each cluster keeps a heap of its
members, ordered by the gap between the distance to the second nearest centroid and to their own. A round moves every centroid j by some
drift, which shrinks the gaps of its members by no more than drift j plus the largest drift of another centroid; the sum of those
is the cluster's offset. A gap is stored with the offset at its entry added, so a whole heap ages without being touched: entries not above
the present offset are popped, rescanned against all centroids in exact integers, and pushed again. Every other vector is certain to stay.
Centroid sums change by the vectors that move alone. A round reads the blocks beside the last round's heaps (both bucketed alike, so
nothing is shuffled) and writes heaps only; what comes to the driver are the sums of each centroid, as many as clusters times
components.

Components are integers: floor(``scale`` * x). Defined results: vectors with another number of components, a null one or one that
is not finite, and null vectors, are left out; an integer beyond 2^27 in size counts as 2^27 of its sign, so that squared distances fit a
long; a sum of distances that doesn't fit is null; ties go to the smaller centroid; repeated rows are vectors of their own; a null id is the last
to be a first centroid and passes through; with fewer vectors than centroids there are as many centroids as vectors; equal first centroids
leave the later one empty, and it stays where it is; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

BLOCK = 2048
#: Components beyond this count as this.
LARGEST = 2**27
#: Up to this size all terms of a squared distance are whole numbers below 2^53, whatever order they are added in.
SMALL = 2**21


def integer_vectors(df: DataFrame, id_: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, ints) of the vectors with ``dims`` finite components."""
    x = F.col(vector)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    whole = lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    good = x.isNotNull() & (F.size(x) == dims) & F.forall(x, finite)
    return df.where(good).select(F.col(id_).cast("long").alias("vec_id"), F.transform(x, whole).alias("ints"))


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one row a vector and one column a centroid."""
    largest = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if largest <= SMALL and x.shape[1] <= 256:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        out[:, j] = np.square(x.astype(np.int64) - c).sum(1)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (the smaller of equals) and a gap that is never above the true one."""
    d = squared_distances(x, centroids)
    own = d.argmin(1)
    rows = np.arange(len(x))
    first = np.sqrt(d[rows, own].astype(np.float64))
    if len(centroids) == 1:
        return own, np.full(len(x), np.inf)
    d[rows, own] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(1).astype(np.float64))
    return own, second - first - 1e-9 * (second + first + 1)


@dataclass
class Heaps:
    """The heaps of one block: members of cluster j are ``ends[j-1]:ends[j]``, ascending by key (a sorted array is a heap)."""

    ends: np.ndarray
    keys: np.ndarray
    places: np.ndarray

    def pop(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Places and clusters of the expired members, and what is left of each heap."""
        popped, clusters, left, start = [], [], [], 0
        for j, end in enumerate(self.ends):
            cut = start + int(np.searchsorted(self.keys[start:end], offsets[j], side="right"))
            popped.append(self.places[start:cut])
            clusters.append(np.full(cut - start, j))
            left.append((self.keys[cut:end], self.places[cut:end]))
            start = end
        return np.concatenate(popped), np.concatenate(clusters), left

    @classmethod
    def push(cls, left: list[tuple[np.ndarray, np.ndarray]], own: np.ndarray, keys: np.ndarray, places: np.ndarray) -> Heaps:
        order = np.lexsort((places, keys, own))
        own, keys, places = own[order], keys[order], places[order]
        bounds = np.searchsorted(own, np.arange(len(left) + 1))
        out_keys, out_places = [], []
        for j, (k, p) in enumerate(left):
            a, b = bounds[j], bounds[j + 1]
            if a < b:
                at = np.searchsorted(k, keys[a:b])
                k, p = np.insert(k, at, keys[a:b]), np.insert(p, at, places[a:b])
            out_keys.append(k)
            out_places.append(p)
        ends = np.cumsum([len(k) for k in out_keys])
        return cls(ends.astype(np.int32), np.concatenate(out_keys), np.concatenate(out_places).astype(np.int32))

    def clusters(self) -> np.ndarray:
        """The cluster of each place."""
        out = np.empty(len(self.places), dtype=np.int32)
        out[self.places] = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))
        return out


HEAPS = "block int, ends binary, keys binary, places binary"
MOVES = "popped int, moves array<struct<cluster:int,n:bigint,sums:array<bigint>>>"


def _pack(dims: int) -> Callable[[pa.Table], pa.Table]:
    def pack(rows: pa.Table) -> pa.Table:
        x = rows["ints"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        width = 2 if np.abs(x).max(initial=0) < 2**15 else 4
        ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), rows["vec_id"].combine_chunks())
        return pa.table({"block": pa.array([rows["block"][0].as_py()], pa.int32()), "ids": ids, "width": pa.array([width], pa.int32()), "data": pa.array([x.astype(f"<i{width}").tobytes()], pa.binary())})

    return pack


def _vectors(row: dict, dims: int) -> np.ndarray:
    return np.frombuffer(row["data"], dtype=f"<i{row['width']}").reshape(-1, dims).astype(np.int64)


def _assign(row: dict, x: np.ndarray, centroids: np.ndarray, offsets: np.ndarray) -> tuple[Heaps, np.ndarray, np.ndarray, np.ndarray]:
    """The block's heaps after a round, with the places that were rescanned and their clusters before (-1 for none) and after."""
    if row.get("keys") is None:
        places, before = np.arange(len(x)), np.full(len(x), -1)
        left = [(np.empty(0), np.empty(0, dtype=np.int32))] * len(centroids)
    else:
        read = lambda c, t: np.frombuffer(row[c], dtype=t)
        places, before, left = Heaps(read("ends", "<i4"), read("keys", "<f8"), read("places", "<i4")).pop(offsets)
    own, gap = nearest(x[places], centroids)
    return Heaps.push(left, own, gap + offsets[own], places), places, before, own


def _round(centroids: np.ndarray, offsets: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _vectors(row, dims)
                heaps, places, before, own = _assign(row, x, centroids, offsets)
                moved = before != own
                sums, n = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
                np.add.at(sums, own[moved], x[places[moved]])
                np.add.at(n, own[moved], 1)
                left = moved & (before >= 0)
                np.subtract.at(sums, before[left], x[places[left]])
                np.subtract.at(n, before[left], 1)
                touched = np.union1d(own[moved], before[left])
                moves = [{"cluster": int(j), "n": int(n[j]), "sums": sums[j].tolist()} for j in touched]
                yield pa.RecordBatch.from_pylist(
                    [{"block": row["block"], "ends": heaps.ends.astype("<i4").tobytes(), "keys": heaps.keys.astype("<f8").tobytes(), "places": heaps.places.astype("<i4").tobytes(), "popped": len(places), "moves": moves}],
                    schema=_ROUND,
                )

    return run


_MOVE = pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_ROUND = pa.schema([("block", pa.int32()), ("ends", pa.binary()), ("keys", pa.binary()), ("places", pa.binary()), ("popped", pa.int32()), ("moves", pa.list_(_MOVE))])


def _finish(centroids: np.ndarray, offsets: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _vectors(row, dims)
                own = _assign(row, x, centroids, offsets)[0].clusters()
                distance = np.square(x - centroids[own]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(own, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


@dataclass
class Clustering:
    #: (vec_id, cluster, distance), a written table.
    assigned: DataFrame
    centroids: list[list[int]]
    #: How many vectors each pass held against all centroids.
    rescanned: list[int]


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", id_: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256, block: int = BLOCK) -> Clustering:
    """``rounds`` rounds of assignment and update from the ``k`` vectors of least sha256 of ``seed:id``, then a last assignment."""
    spark = df.sparkSession
    scratch = Scratch(spark, "clustering")
    ints = integer_vectors(df, id_, vector, dims, scale)
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [list(r["ints"]) for r in ints.orderBy(turn.asc_nulls_last(), "ints").limit(k).collect()]
    if not centroids:
        return Clustering(spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), [], [])
    blocks = -(-ints.count() // block)
    buckets = min(blocks, max(2 * spark.sparkContext.defaultParallelism, -(-blocks // 64)), 100_000)
    # Rows are dealt by a running number: equal vectors and ids spread like others.
    dealt = ints.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).repartition(buckets, "block")
    packed = dealt.groupBy("block").applyInArrow(_pack(dims), "block int, ids array<bigint>, width int, data binary")
    packed = scratch.save_buckets(packed, "block", buckets, "blocks")
    sums, counts = [[0] * dims for _ in centroids], [0] * len(centroids)
    offsets, heaps, rescanned = np.zeros(len(centroids)), None, []
    with small_batches(spark, 8):
        for _ in range(rounds):
            rows = packed.drop("ids") if heaps is None else packed.drop("ids").join(heaps.select("block", "ends", "keys", "places"), "block")
            new = scratch.save_buckets(rows.mapInArrow(_round(np.array(centroids, dtype=np.int64), offsets), f"{HEAPS}, {MOVES}"), "block", buckets, "heaps")
            if heaps is not None:
                scratch.drop(heaps)
            heaps = new
            rescanned.append(_moved(heaps, sums, counts))
            before = np.array(centroids, dtype=np.float64)
            centroids = [[s // n for s in row] if n else c for c, row, n in zip(centroids, sums, counts, strict=True)]
            offsets = offsets + _aging(before, np.array(centroids, dtype=np.float64))
        last = packed if heaps is None else packed.join(heaps.select("block", "ends", "keys", "places"), "block")
        assigned = scratch.save(last.mapInArrow(_finish(np.array(centroids, dtype=np.int64), offsets), "vec_id bigint, cluster int, distance bigint"), "assigned")
    scratch.drop(packed, *([heaps] if heaps is not None else []))
    return Clustering(assigned, centroids, rescanned)


def _moved(heaps: DataFrame, sums: list[list[int]], counts: list[int]) -> int:
    """Add a round's moves, summed by Spark for each cluster, to the running sums; how many vectors were rescanned."""
    dims = len(sums[0])
    one = F.col("m.sums")
    by = heaps.select(F.explode("moves").alias("m")).groupBy(F.col("m.cluster").alias("cluster"))
    for r in by.agg(F.sum("m.n").alias("n"), F.array(*(F.sum(F.get(one, F.lit(i)).cast("decimal(20,0)")) for i in range(dims))).alias("sums")).collect():
        counts[r["cluster"]] += r["n"]
        sums[r["cluster"]] = [a + int(b) for a, b in zip(sums[r["cluster"]], r["sums"], strict=True)]
    return heaps.agg(F.sum("popped")).first()[0]


def _aging(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """By how much each cluster's gaps may have shrunk: its own drift and the largest of the others', rounded up."""
    drift = np.sqrt(np.square(after - before).sum(1)) * (1 + 1e-12)
    others = np.array([np.delete(drift, j).max(initial=0.0) for j in range(len(drift))])
    return (drift + others) * (1 + 1e-9)


def _by_cluster(values: list, kind: str) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)


def cluster_digest(found: Clustering) -> DataFrame:
    """``assigned`` with the sums of distances and the digest of each cluster's centroid."""
    inertia: list[int | None] = [0] * len(found.centroids)
    for r in found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect():
        inertia[r["cluster"]] = int(r["s"])
    fits = lambda v: v if v < 2**63 else None
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    return found.assigned.select(
        "vec_id", "cluster", "distance",
        _by_cluster([fits(v) for v in inertia] or [None], "bigint").alias("cluster_inertia"),
        F.lit(fits(sum(inertia))).cast("bigint").alias("inertia"), _by_cluster(shas or [None], "string").alias("centroid_sha256"),
    )

"""Connected components of a graph of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 50) -> DataFrame:
    """(id, root): the least id reachable from each id that has a link. ``links`` has columns a and b; null ends are dropped.

    A round joins each vertex's neighbours with its least neighbour, first the larger ones, then the smaller ones; it ends with
    stars around the least ids. Vertices with many neighbours are grouped by partial sums and joined, never gathered.
    """
    pairs = links.where("a is not null and b is not null and a != b")
    edges = scratch.save(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(edges)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large")
        below = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of")
        small = large.join(below, F.col("u") == F.col("of"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(below.select(F.col("of").alias("u"), F.col("m").alias("v")))
        fresh = scratch.save(small.distinct(), "edges")
        scratch.drop(edges, large)
        edges, before, state = fresh, state, _state(fresh)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40)))).first()
    return tuple(row)

"""Stored hubs that are brought up to date in part (section 2.8, M14).

A hub's rows follow from its releases with their titles, and from these releases' artists and labels with their numbers of releases, genres and styles. A fingerprint sums
that up without an order: counts and xor of hashes, from the rows that hubs are made of, which are written once for both. Hubs whose fingerprint is the stored one keep their
partition and its files; others are built anew, and only their partitions are written; those of genres that are gone are removed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import Catalog, query, shared_dir
from .discover import _HUBS, HubRows, hub_rows, hubs
from .temporal import ensure_checkpoints

STORED = "type string, id string, witness string, fingerprint string, hub string"


def fingerprints(near: HubRows) -> DataFrame:
    """(hub, fingerprint) of each genre."""
    of_release = F.xxhash64("release_id", "title_hash", *(F.sort_array(k) for k in ("genres", "styles", "artist_ids", "label_ids")))
    parts = [near.releases.select(F.explode("genres").alias("hub"), of_release.alias("x")), near.pairs.select("hub", F.xxhash64("type", "id", "pop").alias("x"))]
    sums = [df.groupBy("hub").agg(F.concat_ws(":", F.count("*").cast("string"), F.bit_xor("x").cast("string")).alias(name)) for df, name in zip(parts, ("x", "y"), strict=True)]
    return sums[0].join(sums[1], "hub", "left").select("hub", F.concat_ws(":", "x", "y").alias("fingerprint"))


@dataclass(frozen=True)
class Refresh:
    rebuilt: list[str]
    removed: list[str]
    kept: int


def read_hubs(c: Catalog, path: str) -> DataFrame:
    return c.spark.read.schema(STORED).parquet(path)


def refresh_hubs(c: Catalog, path: str, limit: int = 100) -> Refresh:
    """Bring the store at ``path`` up to date. What comes to the driver are names of genres that change, of which a catalog has a few hundred."""
    ensure_checkpoints(c)
    place = c.spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(c.spark._jsc.hadoopConfiguration())
    near = hub_rows(c)
    now = fingerprints(near).checkpoint()
    stored = read_hubs(c, path).select("hub", F.col("fingerprint").alias("was")).distinct() if files.exists(place) else c.spark.createDataFrame([], "hub string, was string")
    both = now.join(stored, "hub", "full_outer").checkpoint()
    changed = both.where("fingerprint is not null and (was is null or was <> fingerprint)").select("hub", "fingerprint")
    rebuilt = sorted(r["hub"] for r in changed.select("hub").collect())
    removed = sorted(r["hub"] for r in both.where("fingerprint is null").select("hub").collect())
    if rebuilt:
        fresh = hubs(c, limit, changed, near).join(changed, "hub").select("type", "id", "witness", "fingerprint", "hub")
        fresh.repartition("hub").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hub").parquet(path)
    # Spark names a partition's folder, so a file of it is asked for.
    gone = read_hubs(c, path).where(F.col("hub").isin(removed)).select(F.regexp_replace(F.input_file_name(), "/[^/]*$", "").alias("folder")).distinct().collect() if removed else []
    for r in gone:
        files.delete(c.spark._jvm.org.apache.hadoop.fs.Path(c.spark._jvm.java.net.URI(r["folder"])), True)
    return Refresh(rebuilt, removed, both.where("was = fingerprint").count())


class Earlier(Catalog):
    """The catalog before its last years of releases."""

    def __init__(self, c: Catalog, before: int):
        super().__init__(c.spark, c.sf_dir)
        old = c.releases.where(F.col("year") < before).select("release_id")
        for name in ("by", "on", "genres", "styles", "masters"):
            self.__dict__[name] = getattr(c, name).join(old, "release_id", "left_semi")


@query("m14_refreshed_hubs", f"{_HUBS} SELECT hub, type, id, witness FROM hubs")
def refreshed_hubs(c: Catalog) -> DataFrame:
    """A store that was made before the last years of releases, brought up to date."""
    path = f"{shared_dir(c.spark)}/hubs-{uuid.uuid4().hex}"
    refresh_hubs(Earlier(c, 1996), path)
    refresh_hubs(c, path)
    return read_hubs(c, path).select("hub", "type", "id", "witness")

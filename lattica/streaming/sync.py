"""Paged sync of collections as a stream (section 2.13, X9 to X11): upsert page by page, sweep after the last, acted on once.

A page is a set of rows (user_id, sync_id, page, last, release_id, rating): its number from 1, whether it ends the sync, and its items (an empty page has one row without
a release). The table holds each user's items with the sync and page that brought them last, and a row for each page met of a sync that is not complete. A batch
is merged into its buckets of users only: the newest version of an item stays; where all pages of a sync are there, what no newer sync brought is swept.

That merge gives the same table whatever the order of pages, their repeats, or the cuts between batches, so a batch that ran half may run again. A sync that
becomes complete is written to ``done`` under its batch before the table changes; a batch that finds its own record keeps it, so each completion is acted on once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import Catalog, query
from . import folder, source

PAGES = "user_id bigint, sync_id bigint, page int, last boolean, release_id bigint, rating double"
STORED = "user_id bigint, sync_id bigint, page int, last boolean, release_id bigint, rating double, swept bigint, bucket int"
BUCKETS = 64


def merged(stored: DataFrame, pages: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of the table after ``pages``: items (release_id not null) and pages of open syncs; ``swept`` is the user's last complete sync.

    A user's rows are brought together by a window; the number of a user's items bounds it.
    """
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")
    names = ("user_id", "sync_id", "page", "last", "release_id", "rating", "swept")
    marks = pages.select("user_id", "sync_id", "page", "last", F.lit(None).cast("bigint").alias("release_id"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("bigint").alias("swept")).distinct()
    items = pages.where("release_id is not null").select("user_id", "sync_id", "page", F.lit(None).cast("boolean").alias("last"), "release_id", "rating", F.lit(None).cast("bigint").alias("swept"))
    rows = stored.select(*names).unionByName(marks).unionByName(items)
    # The newest version of an item, and each page once.
    newest = F.row_number().over(Window.partitionBy("user_id", "release_id", F.when(F.col("release_id").isNull(), F.struct("sync_id", "page"))).orderBy(F.desc("sync_id"), F.desc("page"), F.desc_nulls_last("rating"), F.desc_nulls_last("swept")))
    rows = rows.withColumn("n", newest).where("n = 1").drop("n")
    of_sync = Window.partitionBy("user_id", "sync_id")
    is_page = F.col("release_id").isNull() & (F.col("page") > 0)
    whole = F.max(F.when(is_page & F.col("last"), F.col("page"))).over(of_sync) == F.count_if(is_page).over(of_sync)
    of_user = Window.partitionBy("user_id")
    done = F.max(F.when(F.col("whole"), F.col("sync_id"))).over(of_user)
    rows = rows.withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("done", F.greatest(done, F.max("swept").over(of_user)))
    # Of complete syncs the newest alone is remembered, by a row of page 0.
    kept = rows.where(F.col("done").isNull() | (F.col("sync_id") > F.col("done")) | ((F.col("sync_id") == F.col("done")) & F.col("release_id").isNotNull()))
    note = rows.where("done is not null").select("user_id", F.col("done").alias("sync_id"), F.lit(0).alias("page"), F.lit(None).cast("boolean").alias("last"), F.lit(None).cast("bigint").alias("release_id"), F.lit(None).cast("double").alias("rating"), F.col("done").alias("swept")).distinct()
    return kept.where("page > 0").select(*names).unionByName(note).withColumn("bucket", bucket)


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)


def batch_writer(target: str, done: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = _read(spark, target, STORED)
        bucket = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        mine = stored.where(F.col("bucket").isin(touched))
        after = merged(mine, batch, buckets).checkpoint()  # the files that it is read from are overwritten
        record = f"{done}/batch={batch_id}"
        if not _there(spark, f"{record}/_SUCCESS"):
            before = mine.where("swept is not null").select("user_id", F.col("swept").alias("was"))
            new = after.where("swept is not null").join(before, "user_id", "left").where("was is null or swept > was").select("user_id", F.col("swept").alias("sync_id"))
            new.write.mode("overwrite").parquet(record)
        after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    return write


def sync_pages(pages: DataFrame, target: str, done: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge a stream of pages into ``target``; runs over what is there and ends."""
    return pages.writeStream.foreachBatch(batch_writer(target, done, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collections(spark: SparkSession, target: str) -> DataFrame:
    """(user_id, release_id, rating, sync_id): what users hold."""
    return _read(spark, target, STORED).where("release_id is not null").select("user_id", "release_id", "rating", "sync_id")


def completed(spark: SparkSession, done: str) -> DataFrame:
    return _read(spark, done, "user_id bigint, sync_id bigint, batch int").select("user_id", "sync_id")


def week_pages(c: Catalog, size: int = 3) -> DataFrame:
    """Each user's purchases of a week as a sync, in ``size`` pages by release; the last page ends it, with or without items."""
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("long")
    bought = c.events.where("event_type = 'purchase' and k is not null and user_id is not null").select(F.col("user_id").cast("long").alias("user_id"), week.alias("sync_id"), (F.pmod("k", F.lit(size)) + 1).cast("int").alias("page"), F.col("k").alias("release_id"), "value")
    items = bought.groupBy("user_id", "sync_id", "page", "release_id").agg(F.max("value").alias("rating"))
    every = bought.select("user_id", "sync_id").distinct().select("user_id", "sync_id", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("page"))
    return every.join(items, ["user_id", "sync_id", "page"], "left").select("user_id", "sync_id", "page", (F.col("page") == size).alias("last"), "release_id", "rating")


_WEEKS = "WITH w AS (SELECT user_id, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7) AS BIGINT) AS sync_id, k AS release_id, max(value) AS rating FROM ev WHERE event_type = 'purchase' AND k IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2, 3)"


def _synced(c: Catalog) -> tuple[str, str]:
    from ..operators.temporal import ensure_checkpoints

    ensure_checkpoints(c)
    files, target, done = folder(c, "pages"), folder(c, "synced"), folder(c, "done")
    # Pages reach the stream in files that mix users, syncs and pages.
    week_pages(c).repartition(3, F.xxhash64("user_id", "sync_id", "page")).write.parquet(files)
    sync_pages(source(c.spark, files, PAGES), target, done, folder(c, "offsets"), 8).awaitTermination()
    return target, done


@query("x11_synced_collections", f"{_WEEKS} SELECT user_id, release_id, rating, sync_id FROM w WHERE (user_id, sync_id) IN (SELECT (user_id, max(sync_id)) FROM w GROUP BY user_id)")
def synced_collections(c: Catalog) -> DataFrame:
    """What every user holds after the pages of all weeks, in batches of files: the items of the last complete sync."""
    return collections(c.spark, _synced(c)[0])


@query("x9_completed_syncs", f"{_WEEKS} SELECT user_id, max(sync_id) AS newest FROM w GROUP BY 1")
def completed_syncs(c: Catalog) -> DataFrame:
    """The newest sync of each user that was acted on."""
    return completed(c.spark, _synced(c)[1]).groupBy("user_id").agg(F.max("sync_id").alias("newest"))

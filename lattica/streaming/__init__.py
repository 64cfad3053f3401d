"""Activity ingest as Structured Streaming (section 2.13): validation, idempotent append, months, windows and outcomes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import Catalog, query, shared_dir

REQUIRED = {"purchase": ("k", "value"), "click": ("k",), "view": ("k",), "signup": ("user_id",), "error": ("k",)}


def folder(c: Catalog, name: str) -> str:
    """A fresh place below the folder that executors share."""
    return f"{shared_dir(c.spark)}/{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is given, not inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def validated(events: DataFrame) -> DataFrame:
    """Add ``valid``: the fields that an event's type requires are there, and the type is known."""
    ok = F.lit(False)
    for kind, fields in REQUIRED.items():
        there = F.lit(True)
        for f in fields:
            there = there & F.col(f).isNotNull()
        ok = F.when(F.col("event_type") == kind, there).otherwise(ok)
    return events.withColumn("valid", F.coalesce(ok, F.lit(False)))


def append_once(batch: DataFrame, target: str, keys: list[str]) -> None:
    """Append the rows whose key is not stored yet: idempotent however late a retry comes, which a watermark is not.

    An event may come back under another month, so the keys of all months are read (of each file the key columns alone), less those outside
    the batch's range of keys, which the files' statistics rule out where keys grow with time.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys)
    try:
        stored = spark.read.parquet(target)
    except Exception as e:  # the first batch has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        low, high = fresh.agg(F.min(keys[0]), F.max(keys[0])).first()
        if low is not None:
            stored = stored.where(F.col(keys[0]).between(F.lit(low), F.lit(high)))
        fresh = fresh.join(stored.select(*keys), keys, "left_anti")
    fresh.write.mode("append").partitionBy("month").parquet(target)


def ingest(events: DataFrame, target: str, quarantine: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Validated events into months, others into ``quarantine``; runs over what is there and ends."""

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        append_once(batch.where("valid").withColumn("month", F.date_format("ts", "yyyy-MM")), target, keys)
        batch.where("not valid").write.mode("append").parquet(quarantine)
        batch.unpersist()

    return validated(events).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _events(c: Catalog) -> DataFrame:
    """The events table as a stream; the table is one file or a folder of files."""
    schema = c.table("events").schema
    rows = source(c.spark, f"{c.sf_dir}/event[s].parquet", schema)  # a pattern, so that the table may be one file
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("long")).drop("props")


@query("x4_idempotent_ingest", "SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n, count(DISTINCT event_id) AS ids FROM ev GROUP BY 1, 2")
def idempotent_ingest(c: Catalog) -> DataFrame:
    """The stream is ingested twice, the second time as retries: each event is stored once."""
    target, bad = folder(c, "events"), folder(c, "quarantine")
    for turn in range(2):
        ingest(_events(c), target, bad, folder(c, f"offsets{turn}"), ["event_id"]).awaitTermination()
    return c.spark.read.parquet(target).groupBy("event_type", F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


def windowed(events: DataFrame, size: str, slide: str | None, late: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"))


def _run(c: Catalog, df: DataFrame, mode: str) -> DataFrame:
    """Run over what is there; the rows land in the shared folder."""
    target = folder(c, "windows")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(target)

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", folder(c, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return c.spark.read.parquet(target)


@query("extra_tumbling_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS at, event_type, count(*) AS n FROM ev GROUP BY 1, 2")
def tumbling_counts(c: Catalog) -> DataFrame:
    """Extension: hourly counts with a watermark, complete at the end of the stream."""
    out = _run(c, windowed(_events(c), "1 hour", None, "1 day"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("at"), "event_type", "n")


@query("extra_outcome_views", "SELECT o.event_id, count(i.event_id) AS views FROM ev o LEFT JOIN ev i ON i.event_type = 'view' AND i.k = o.k AND i.ts <= o.ts AND i.ts > o.ts - INTERVAL 1 DAY WHERE o.event_type = 'purchase' GROUP BY 1")
def outcomes(c: Catalog) -> DataFrame:
    """Extension: views of the item in the day before each purchase. Days are join keys, so no purchase meets all views."""
    day = F.date_trunc("day", "ts").cast("date")
    views = c.events.where("event_type = 'view'").select("k", F.col("ts").alias("seen"), day.alias("d"))
    buys = c.events.where("event_type = 'purchase'").select("event_id", "k", "ts")
    near = buys.withColumn("d", F.explode(F.array(day, F.date_sub(day, 1)))).join(views, ["k", "d"]).where((F.col("seen") <= F.col("ts")) & (F.col("seen") > F.col("ts") - F.expr("INTERVAL 1 DAY")))
    return buys.select("event_id").join(near.groupBy("event_id").agg(F.count("*").alias("views")), "event_id", "left").fillna(0, ["views"])


@query("x3_impressions", "SELECT user_id, k, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS BIGINT) AS position FROM ev WHERE event_type = 'click' AND k IS NOT NULL")
def impressions(c: Catalog) -> DataFrame:
    """Ranked lists stamped with positions; items without a key are skipped."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return c.events.where("event_type = 'click' and k is not null").select("user_id", "k", F.row_number().over(order).cast("long").alias("position"))


@query("x10_watermark", "SELECT event_type, max(event_id) AS high, strftime(max(ts), '%Y-%m-%d') AS last_day FROM ev GROUP BY 1")
def high_watermark(c: Catalog) -> DataFrame:
    return c.events.groupBy("event_type").agg(F.max("event_id").alias("high"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))

"""The catalog graph as lazy DataFrames over the star tables, its DuckDB twin, and the registry of named queries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); only a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, for what has several readers."""
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Lines of one partition of an edge.
LINES_EACH = 500_000


class Catalog:
    """Nodes and edges over the star tables; each is a plan, nothing but row counts is read before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _parts_of_lines(self) -> int:
        """How many partitions of ``LINES_EACH`` lines there are; a count reads footers alone."""
        return -(-self.lines.count() // LINES_EACH)

    def spread(self, df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
        """``df`` by ``keys`` in as many partitions as its lines need (each of them making ``times`` rows), where the session's number is less: so a task's memory does not grow with the tables."""
        parts = self._parts_of_lines * times
        return df.repartition(parts, *keys) if int(self.spark.conf.get("spark.sql.shuffle.partitions")) < parts else df

    @cached_property
    def releases(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("release_id"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_custkey").alias("label_id"), F.col("o_orderpriority").alias("priority"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def by_raw(self) -> DataFrame:
        """Release to artist, one row for each line: duplicate edges stay."""
        return self.lines.select(F.col("l_orderkey").alias("release_id"), F.col("l_suppkey").alias("artist_id"))

    @cached_property
    def by(self) -> DataFrame:
        return self.spread(self.by_raw, "release_id").distinct()

    @cached_property
    def on(self) -> DataFrame:
        return self.releases.select("release_id", "label_id")

    @cached_property
    def _parts(self) -> DataFrame:
        return self.lines.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def genres(self) -> DataFrame:
        return self.spread(self._parts.select(F.col("l_orderkey").alias("release_id"), F.col("p_type").alias("genre")), "release_id").distinct()

    @cached_property
    def styles(self) -> DataFrame:
        return self.spread(self._parts.select(F.col("l_orderkey").alias("release_id"), F.col("p_brand").alias("style")), "release_id").distinct()

    @cached_property
    def masters(self) -> DataFrame:
        """Release to its master."""
        return self.lines.groupBy(F.col("l_orderkey").alias("release_id")).agg(F.min("l_partkey").alias("master_id"))

    @cached_property
    def media(self) -> DataFrame:
        medium = F.concat("l_returnflag", F.lit("_"), "l_linestatus")
        return self.lines.select(F.col("l_orderkey").alias("release_id"), medium.alias("medium"), F.col("l_returnflag").alias("family")).distinct()

    @cached_property
    def credits(self) -> DataFrame:
        """Release to person with role and category; duplicates stay."""
        return self.lines.select(F.col("l_orderkey").alias("release_id"), F.col("l_suppkey").alias("person_id"), F.col("l_linestatus").alias("role"), F.col("l_returnflag").alias("category"))

    @cached_property
    def artists(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"))

    @cached_property
    def labels(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("label_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"))

    @cached_property
    def aliases(self) -> DataFrame:
        """Artist to the next artist of its nation."""
        following = F.lead("artist_id").over(Window.partitionBy("nation").orderBy("artist_id"))
        return self.artists.select("artist_id", following.alias("other_id")).where("other_id is not null")

    @cached_property
    def groups(self) -> DataFrame:
        """Artist (member) to the least artist of its nation (group)."""
        least = self.artists.groupBy("nation").agg(F.min("artist_id").alias("other_id"))
        return self.artists.join(least, "nation").where("artist_id != other_id").select("artist_id", "other_id")

    @cached_property
    def events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long")
        return self.table("events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))

    def _held(self, kind: str) -> DataFrame:
        return self.events.where(F.col("event_type") == kind).select("user_id", F.col("k").alias("release_id"), F.col("ts").alias("date_added"), "value")

    @cached_property
    def collected(self) -> DataFrame:
        return self._held("purchase")

    @cached_property
    def wanted(self) -> DataFrame:
        return self._held("click")


class Within(Catalog):
    """The catalog's releases and lines of some releases (release_id): what is asked of a few releases makes no edges of the others."""

    def __init__(self, c: Catalog, releases: DataFrame):
        super().__init__(c.spark, c.sf_dir)
        lines = c.lines.join(releases.select(F.col("release_id").alias("l_orderkey")), "l_orderkey", "left_semi")
        self.__dict__.update(_parts_of_lines=c._parts_of_lines, lines=lines, releases=c.releases.join(releases, "release_id", "left_semi"))


class OfUsers(Within):
    """The catalog's collections and wishes and the releases in them, written once: a query that joins them many times reads the tables once."""

    def __init__(self, c: Catalog):
        marks = written(c.spark, c.events.where(F.col("event_type").isin("purchase", "click")))
        super().__init__(c, marks.select(F.col("k").alias("release_id")).distinct())
        self.__dict__["events"] = marks
        self.__dict__["lines"] = written(c.spark, self.lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"))
        self.__dict__["releases"] = written(c.spark, self.releases)
        self.__dict__.pop("_parts_of_lines")


#: The same nodes and edges for DuckDB, in the order they build on each other.
VIEWS = {
    "releases": "SELECT o_orderkey AS release_id, CAST(year(o_orderdate) AS BIGINT) AS year, o_custkey AS label_id, o_orderpriority AS priority FROM orders",
    "by_raw": "SELECT l_orderkey AS release_id, l_suppkey AS artist_id FROM lineitem",
    "by_": "SELECT DISTINCT l_orderkey AS release_id, l_suppkey AS artist_id FROM lineitem",
    "on_": "SELECT o_orderkey AS release_id, o_custkey AS label_id FROM orders",
    "genres": "SELECT DISTINCT l_orderkey AS release_id, p_type AS genre FROM lineitem JOIN part ON l_partkey = p_partkey",
    "styles": "SELECT DISTINCT l_orderkey AS release_id, p_brand AS style FROM lineitem JOIN part ON l_partkey = p_partkey",
    "masters": "SELECT l_orderkey AS release_id, min(l_partkey) AS master_id FROM lineitem GROUP BY 1",
    "media": "SELECT DISTINCT l_orderkey AS release_id, l_returnflag || '_' || l_linestatus AS medium, l_returnflag AS family FROM lineitem",
    "credits": "SELECT l_orderkey AS release_id, l_suppkey AS person_id, l_linestatus AS role, l_returnflag AS category FROM lineitem",
    "artists": "SELECT s_suppkey AS artist_id, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation FROM supplier",
    "label_nodes": "SELECT c_custkey AS label_id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation FROM customer",
    "aliases": "SELECT * FROM (SELECT artist_id, lead(artist_id) OVER (PARTITION BY nation ORDER BY artist_id) AS other_id FROM artists) WHERE other_id IS NOT NULL",
    "groups_": "SELECT a.artist_id, m.other_id FROM artists a JOIN (SELECT nation, min(artist_id) AS other_id FROM artists GROUP BY 1) m USING (nation) WHERE a.artist_id <> m.other_id",
    "ev": "SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "collected": "SELECT user_id, k AS release_id, ts AS date_added, value FROM ev WHERE event_type = 'purchase'",
    "wanted": "SELECT user_id, k AS release_id, ts AS date_added, value FROM ev WHERE event_type = 'click'",
}


def sql(text: str) -> str:
    """DuckDB SQL over the views above."""
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in VIEWS.items()) + (",\n" + text.strip()[5:] if text.strip().upper().startswith("WITH ") else "\n" + text.strip())


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``f(catalog) -> DataFrame`` under ``name``, with the DuckDB SQL that must give the same rows."""

    def add(f: Callable[[Catalog], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = lambda spark, sf_dir: f(Catalog(spark, sf_dir))
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return add

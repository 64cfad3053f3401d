"""Sources and sinks (section 2.1): JSON lines, sidecar files, COPY text, keyed upserts, snapshots and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..plans import Catalog, query

# The files that mark an analysed folder, and the columns of an evaluation set.
ANALYSIS_FILES = ("report.txt", "skipped.jsonl", "violations.jsonl")
GOLDEN = {
    "labels": "id:string, name:string, release_count:int",
    "artists": "id:string, name:string, primary_genre:string, styles:array<string>",
    "masters": "id:string, title:string, year:int",
    "releases": "id:string, title:string, artist_ids:array<string>, label_id:string, master_id:string, year:int, genres:array<string>, styles:array<string>, medium:string, have_count:int, want_count:int",
}
COLLECTORS = "id:string, name:string, taste_genres:array<string>, collected:array<struct<release_id:string, date_added:date>>, wants:array<string>"


def read_flagged(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """JSON lines below ``root/<version>/<entity>/``; version and entity from the path, corrupt lines dropped."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(root)
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, r"/([^/]+)/[^/]+/[^/]+\.jsonl$", 1).alias("version"), F.regexp_extract(path, r"/([^/]+)/[^/]+\.jsonl$", 1).alias("entity_type"))


def read_sidecars(spark: SparkSession, root: str, most_bytes: int = 512 * 1024) -> DataFrame:
    """(record_id, content, truncated) of whole files; contents beyond the limit are cut and flagged."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    record = F.regexp_extract("path", r"/([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(record.alias("record_id"), F.substring("content", 1, most_bytes).cast("string").alias("content"), (F.col("length") > most_bytes).alias("truncated"))


def scan_versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, entity_types) of ``root/<version>/<entity>/`` folders that hold an analysis file, be it empty; from Spark's listing, as scans leave out empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{%s}" % ",".join(ANALYSIS_FILES)).load(root)
    found = spark.createDataFrame([(path,) for path in files.inputFiles()], "path string")
    parts = found.select(F.regexp_extract("path", r"/([^/]+)/[^/]+/[^/]+$", 1).alias("version"), F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("entity"))
    return parts.groupBy("version").agg(F.sort_array(F.collect_set("entity")).alias("entity_types"))


def phase_status(spark: SparkSession, root: str) -> DataFrame:
    """(version, phase, status) from markers ``extraction_status_<version>.json``; a phase without a status is unknown, a corrupt marker has none.

    Spark lists no hidden files, so markers whose names begin with a dot must be renamed first.
    """
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*extraction_status_*.json")
    marker = F.from_json("value", "map<string,string>")
    version = F.regexp_extract("_metadata.file_path", r"extraction_status_([^/]+)\.json$", 1)
    phases = F.map_filter(marker, lambda k, v: F.endswith(k, F.lit("_phase")) & F.startswith(v, F.lit("{")))
    rows = files.select(version.alias("version"), F.explode(phases).alias("phase", "state"))
    return rows.select("version", "phase", F.coalesce(F.get_json_object("state", "$.status"), F.lit("unknown")).alias("status"))


def read_golden_set(spark: SparkSession, catalog: str, collectors: str) -> dict[str, DataFrame]:
    """The typed tables of two JSON documents: labels, artists, masters, releases; collectors, collected, wants. A document that does not parse is an error."""
    read = lambda path, schema: spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)
    graph = read(catalog, ", ".join(f"{name} array<struct<{fields}>>" for name, fields in GOLDEN.items()))
    people = read(collectors, f"collectors array<struct<{COLLECTORS}>>").select(F.explode("collectors").alias("x")).select("x.*")
    tables = {name: graph.select(F.explode(name).alias("x")).select("x.*") for name in GOLDEN}
    tables["collectors"] = people.select("id", "name", "taste_genres")
    tables["collected"] = people.select(F.col("id").alias("collector_id"), F.explode("collected").alias("x")).select("collector_id", "x.*")
    tables["wants"] = people.select(F.col("id").alias("collector_id"), F.explode("wants").alias("release_id"))
    return tables


def write_report(report: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file, over what was there."""
    report.coalesce(1).write.mode("overwrite").json(path)


def moved_metrics(before: DataFrame, after: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, metric, before, after) of numbers that differ by more than ``tolerance``, or that one side lacks; other columns are left out."""
    numbers = [f.name for f in after.schema.fields if f.name not in keys and isinstance(f.dataType, NumericType)]
    long = lambda df, side: df.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(side)) for n in numbers))).alias("x")).select(*keys, "x.*")
    both = long(before, "before").join(long(after, "after"), [*keys, "metric"], "full_outer")
    same = F.col("before").eqNullSafe(F.col("after")) | (F.abs(F.col("before") - F.col("after")) <= tolerance)
    return both.where(~F.coalesce(same, F.lit(False)))


def read_copy_text(spark: SparkSession, path: str, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """A table in COPY text form: tabs, ``\\N`` for null, no quotes."""
    schema = ", ".join(f"{k} {v}" for k, v in columns.items())
    return spark.read.schema(schema).csv(path, sep="\t", nullValue="\\N", quote="", escape="\\").select(*keep)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str]) -> DataFrame:
    """``new`` over ``old`` by key; columns in ``keep_old`` keep the old value where the new one is null."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *(F.col(c).alias(f"__old_{c}") for c in rest), F.lit(True).alias("__in_old"))
    b = new.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in rest), F.lit(True).alias("__in_new"))
    pick = lambda c: F.coalesce(f"__new_{c}", f"__old_{c}") if c in keep_old else F.when(F.col("__in_new"), F.col(f"__new_{c}")).otherwise(F.col(f"__old_{c}"))
    return a.join(b, keys, "full_outer").select(*keys, *(pick(c).alias(c) for c in rest))


def changed_fields(before: DataFrame, after: DataFrame, keys: list[str], tracked: list[str]) -> DataFrame:
    """Added and updated rows of ``after`` with the tracked fields that differ; unchanged rows emit nothing."""
    a = before.select(*keys, *(F.col(c).alias(f"__b_{c}") for c in tracked), F.lit(True).alias("__there"))
    df = after.join(a, keys, "left")
    names = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__b_{c}")), F.lit(c)) for c in tracked)))
    kind = F.when(F.col("__there").isNull(), "added").when(F.size(names) > 0, "updated")
    out = df.select(*keys, kind.alias("kind"), F.when(F.col("__there").isNotNull(), F.array_join(names, ",")).otherwise("").alias("fields"))
    return out.where("kind is not null")


def snapshot_hash(rows: DataFrame, group: str, item: str) -> DataFrame:
    """SHA-256 over the sorted ids of each group, joined by newlines."""
    ids = F.sort_array(F.collect_list(F.col(item).cast("string")))
    return rows.groupBy(group).agg(F.count("*").alias("items"), F.sha2(F.array_join(ids, "\n"), 256).alias("sha256"))


def export_sections(sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """(section, place, line): each row as JSON, sections in the given order."""
    parts = [df.select(F.lit(name).alias("section"), F.lit(n).cast("long").alias("place"), F.to_json(F.struct(*df.columns)).alias("line")) for n, (name, df) in enumerate(sections)]
    return reduce(DataFrame.unionByName, parts)


def erase_user(tables: dict[str, DataFrame], user_id: int) -> dict[str, DataFrame]:
    """Every table without the user's rows."""
    return {name: df.where(~F.col("user_id").eqNullSafe(F.lit(user_id))) for name, df in tables.items()}


def _halves(c: Catalog) -> tuple[DataFrame, DataFrame]:
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    rows = c.collected.select("user_id", "release_id", "date_added", F.round(F.col("value") * 100).cast("long").alias("cents"))
    last = lambda df: df.groupBy("user_id", "release_id").agg(F.max_by("cents", F.struct("date_added", "cents")).alias("cents"), F.date_format(F.max("date_added"), "yyyy-MM-dd").alias("day"))
    return last(rows.where(F.col("date_added") < cut)), last(rows.where(F.col("date_added") >= cut))


_HALVES = """WITH src AS (SELECT user_id, release_id, date_added, CAST(round(value * 100) AS BIGINT) AS cents FROM collected),
    a AS (SELECT user_id, release_id, max_by(cents, (date_added, cents)) AS cents, strftime(max(date_added), '%Y-%m-%d') AS day FROM src WHERE date_added < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1, 2),
    b AS (SELECT user_id, release_id, max_by(cents, (date_added, cents)) AS cents, strftime(max(date_added), '%Y-%m-%d') AS day FROM src WHERE date_added >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1, 2)"""


@query("s12_upsert_collection", f"{_HALVES} SELECT user_id, release_id, coalesce(b.cents, a.cents) AS cents, coalesce(b.day, a.day) AS day FROM a FULL OUTER JOIN b USING (user_id, release_id)")
def upsert_collection(c: Catalog) -> DataFrame:
    old, new = _halves(c)
    return upsert(old, new, ["user_id", "release_id"], ["day"])


@query("s15_page_events", f"{_HALVES} SELECT user_id, release_id, CASE WHEN a.cents IS NULL THEN 'added' ELSE 'updated' END AS kind, CASE WHEN a.cents IS NULL THEN '' WHEN a.cents IS DISTINCT FROM b.cents AND a.day IS DISTINCT FROM b.day THEN 'cents,day' WHEN a.cents IS DISTINCT FROM b.cents THEN 'cents' ELSE 'day' END AS fields FROM b LEFT JOIN a USING (user_id, release_id) WHERE a.cents IS DISTINCT FROM b.cents OR a.day IS DISTINCT FROM b.day")
def page_events(c: Catalog) -> DataFrame:
    old, new = _halves(c)
    return changed_fields(old, new, ["user_id", "release_id"], ["cents", "day"])


@query("s14_stale_rows", f"{_HALVES} SELECT user_id, release_id, a.cents FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.release_id = a.release_id)")
def stale_rows(c: Catalog) -> DataFrame:
    """What a sync did not touch."""
    old, new = _halves(c)
    return old.join(new.select("user_id", "release_id"), ["user_id", "release_id"], "left_anti").select("user_id", "release_id", "cents")


@query("s16_collection_snapshots", "SELECT user_id, count(*) AS items, sha256(string_agg(CAST(release_id AS VARCHAR), chr(10) ORDER BY CAST(release_id AS VARCHAR))) AS sha256 FROM (SELECT DISTINCT user_id, release_id FROM collected) GROUP BY 1")
def collection_snapshots(c: Catalog) -> DataFrame:
    return snapshot_hash(c.collected.select("user_id", "release_id").distinct(), "user_id", "release_id")


@query("extra_export_counts", "SELECT section, count(*) AS lines FROM (SELECT 'collection' AS section FROM collected UNION ALL SELECT 'wants' FROM wanted UNION ALL SELECT 'events' FROM ev) GROUP BY 1")
def user_export(c: Catalog) -> DataFrame:
    lines = export_sections([("collection", c.collected), ("wants", c.wanted), ("events", c.events)])
    return lines.groupBy("section").agg(F.count("line").alias("lines"))

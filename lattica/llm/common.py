"""What the operators share: scratch tables, word arrays and match spans.

A "word" is a maximal run of characters other than space and U+0009..U+000D.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, as a Java regular expression class.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, only a local session may fall back to a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: The Scratch objects made inside ``scratch_tables``.
_made: ContextVar[list | None] = ContextVar("made", default=None)


@contextmanager
def scratch_tables():
    """The Scratch objects that operators make inside, as a list: their caller may remove them once the results are written."""
    found: list = []
    token = _made.set(found)
    try:
        yield found
    finally:
        _made.reset(token)


class Scratch:
    """Written tables that cut lineage; they live in the shared folder and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.names: dict[str, str] = {}
        if (made := _made.get()) is not None:
            made.append(self)

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write ``df`` and read it back: later plans start from the files."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{label}"
        df.write.parquet(path, compression="zstd")
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_buckets(self, df: DataFrame, column: str, buckets: int, label: str = "t") -> DataFrame:
        """Like ``save``, bucketed by ``column``: tables of equal buckets join on it without a shuffle."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{label}"
        name = f"scratch_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, column).sortBy(column).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        self.names[path] = name
        out = self.spark.table(name)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later plan reads."""
        for table in tables:
            self._forget(table._scratch_path)
            self._delete(table._scratch_path)

    def remove(self) -> None:
        """Delete all its tables."""
        for path in list(self.names):
            self._forget(path)
        self._delete(self.root)

    def _forget(self, path: str) -> None:
        if name := self.names.pop(path, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _delete(self, place: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def number_rows(df: DataFrame, scratch: Scratch, *order: Column) -> DataFrame:
    """``df``, a written table, with ``place``: 0, 1, ... by ``order``.

    Rows are sorted in ranges and numbered within each; a range begins where the counts of those before it end. So no task sees more than its
    range, and what is summed in one task is a count for each range. Equal rows are split by ``order``'s last part, which should be unique.
    """
    high = F.shiftright("__at", 33)
    ranged = scratch.save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranged")
    ranges = ranged.groupBy(high.alias("__range")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select("__range", F.coalesce(before, F.lit(0)).alias("__start"))
    # One row a range, of which there are as many as shuffle partitions.
    out = ranged.join(F.broadcast(starts), high == F.col("__range"))
    return out.withColumn("place", F.col("__start") + F.col("__at").bitwiseAND(2**33 - 1)).drop("__at", "__range", "__start")


def text_of(col: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WS_CLASS + "+"), "")


def string_array(values) -> Column:
    values = list(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


SUMS = 128


def add_running_sums(df: DataFrame, lengths: str, out: str) -> DataFrame:
    """Add array ``out``: for each place of ``lengths``, the sum of the elements before it.

    Sums are taken of blocks of ``SUMS`` elements first, so that arrays of 100,000 elements take no quadratic time.
    """
    blocks, ends, n = f"__{out}_b", f"__{out}_e", F.size(lengths)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
    parts = F.sequence(F.lit(0), F.floor((n - 1) / SUMS).cast("int"))
    df = df.withColumn(blocks, F.when(n > 0, F.transform(parts, lambda i: total(F.slice(F.col(lengths), i * SUMS + 1, F.lit(SUMS))))))
    df = df.withColumn(ends, F.when(F.size(blocks) > 0, F.transform(blocks, lambda _, i: total(F.slice(F.col(blocks), F.lit(1), i)))))

    def before(_: Column, i: Column) -> Column:
        first = i - i % SUMS
        return F.get(F.col(ends), F.floor(i / SUMS).cast("int")) + total(F.slice(F.col(lengths), first + 1, i - first))

    # Two uses of a column keep the optimizer from computing it again for each element.
    return df.withColumn(out, F.when(F.size(ends) > 0, F.transform(F.col(lengths), before))).drop(blocks, ends)


def add_spans(df: DataFrame, text: str, out: str, regex: str, keep=None, gaps: str | None = None) -> DataFrame:
    """Add array ``out`` of ``struct<m, s, e>``: the leftmost non-overlapping matches with code-point places, end exclusive.

    Spark returns matches without their places, so those are summed from the pieces between matches, which ``split``
    returns in the same order. ``keep`` filters after places are known, so a dropped match still takes its characters.
    ``gaps`` names a column for the piece of text before each match, null where there is none.
    """
    m, p, n, a = (f"__{out}_{x}" for x in "mpna")
    df = df.withColumn(m, F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0)))
    df = df.withColumn(p, F.when(F.size(m) > 0, F.split(F.col(text), regex)))
    df = df.withColumn(n, F.when(F.size(p) > 0, F.zip_with(F.col(m), F.slice(F.col(p), F.lit(1), F.size(m)), lambda x, y: F.length(x) + F.length(y))))
    df = add_running_sums(df, n, a)

    def place(x: Column, i: Column) -> Column:
        start = F.get(F.col(a), i) + F.length(F.get(F.col(p), i))
        return F.struct(x.alias("m"), start.alias("s"), (start + F.length(x)).alias("e"))

    none = F.array().cast("array<struct<m:string,s:int,e:int>>")
    df = df.withColumn(out, F.when(F.size(a) > 0, F.transform(F.col(m), place)).otherwise(none))
    df = df.withColumnRenamed(p, gaps).drop(m, n, a) if gaps else df.drop(m, p, n, a)
    return df.withColumn(out, F.filter(F.col(out), keep)) if keep is not None else df


def tagged(spans: str, kind: str, rank: int, kind_first: bool = False) -> Column:
    """Spans as structs that sort by start, then kind in listed order; ``kind_first`` sorts by kind, then start."""

    def one(x: Column) -> Column:
        parts = [x["s"].alias("s"), F.lit(rank).alias("r")]
        return F.struct(*(reversed(parts) if kind_first else parts), F.lit(kind).alias("k"), x["e"].alias("e"))

    return F.transform(F.col(spans), one)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Bound the Arrow batches of texts that Python workers hold at once, for the jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)

"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard of each key gets a number u in (0, 1) from a hash of both, and the shard with the greatest ``-weight / ln(u)`` wins. So a shard takes keys in
proportion to its weight, a further shard takes keys only into itself (its share, from all others alike), and a shard that goes
gives its keys to the others without moving theirs. The hash is md5 of the key as text, so the choice depends on no engine, run or partition:
a record finds its shard alone, in one projection. Rows are then numbered in each shard by their key: sorted in
ranges over all shards at once, however few shards there are and however large one is.

Defined results: a null key is the empty text, and so all null keys are in one shard; repeated rows, and rows of one key, share a shard and
have slots of their own, in no stated order among equals; ties between shards go to the greater number; a null text has no bytes and counts 1; a very
long text is a row like another; a shard may be empty; weights must be positive; columns of any names pass through ``assign_shards`` and
``write_shards``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, number_rows, text_of

SHARDS = 16
#: Hex digits of the hash that are used: 52 bits, exact in doubles.
DIGITS = 13


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) of a key given as text."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")

    def bid(shard: int, weight: float) -> Column:
        digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, DIGITS)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("bid"), F.lit(shard).alias("shard"))

    if len(weights) == 1:
        return F.lit(0)
    return F.greatest(*(bid(i, w) for i, w in enumerate(weights)))["shard"]


def key_text(*columns: Column | str) -> Column:
    """A record key as text: one column, or several joined by U+001F."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return parts[0] if len(parts) == 1 else F.concat_ws("\x1f", *parts)


def assign_shards(docs: DataFrame, key: str | Sequence[str] = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, column: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row's key, in place of a column of that name."""
    keys = [key] if isinstance(key, str) else list(key)
    return docs.withColumn(column, rendezvous(key_text(*keys), weights))


def write_shards(docs: DataFrame, path: str, key: str | Sequence[str] = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, file_rows: int = 1_000_000) -> None:
    """Write ``docs`` as Parquet, a folder ``shard=N`` each, without a shuffle of the texts; files hold at most ``file_rows`` rows."""
    assign_shards(docs, key, weights).write.partitionBy("shard").option("maxRecordsPerFile", file_rows).parquet(path)


def moved(docs: DataFrame, key: str, before: Sequence[float], after: Sequence[float]) -> DataFrame:
    """(from_shard, to_shard, rows) of the rows whose shard changes when the weights do."""
    text = key_text(key)
    both = docs.select(rendezvous(text, before).alias("from_shard"), rendezvous(text, after).alias("to_shard"))
    return both.where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count("*").alias("rows"))


def shard_slots(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (of one shard more) of every row, with equal weights."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text, key = text_of("text"), key_text("doc_id")
    size = F.octet_length(text).cast("long") + 1
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("__key"))
    shard = rendezvous(F.col("__key"), [1.0] * shards)
    # A further shard wins only if it outbids all others, so both choices agree but for its own rows.
    rows = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), rendezvous(F.col("__key"), [1.0] * (shards + 1)).alias("grown_shard"))
    digest = scratch.save(rows.withColumn("__tie", F.monotonically_increasing_id()), "digest")
    placed = number_rows(digest, scratch, F.col("shard").asc(), F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc(), F.col("__tie").asc())
    counts = {r["shard"]: r["n"] for r in digest.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    starts = [sum(counts.get(i, 0) for i in range(s)) for s in range(shards)]
    slot = F.col("place") - F.element_at(F.array(*(F.lit(v).cast("long") for v in starts)), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")

"""Removal of repeated passages by content-defined chunks of lines (DataFrame functions only).

Lines are hashed. A rolling hash over ``WINDOW`` line hashes ends a chunk where it is divisible by ``SPACING``: boundaries depend on the lines around
them alone, so a passage is cut alike wherever it stands and whatever was inserted before it. Chunks of three and more lines that occur again anywhere go,
but for their first occurrence (least doc_id, then place). What such chunks leave is cut again at the finest grain: every line ends a chunk, and a chunk reaches
over one boundary, so it is a pair of neighbours; pairs inside a chunk that goes are not looked up again. A line of ``long_line`` or more words is a chunk
alone. All that is to go is then compared with its first occurrence byte by byte. Both grains together remove every run of two or more
lines that occurred before, from its first line to its last, and nothing else: a run that a coarse chunk covers in part is finished by pairs over the chunk's ends.

Defined results: a line without words is no part of a chunk (its neighbours are); it goes where it lies inside a removed chunk or, at a
text's edge, beside one; an occurrence that overlaps the first one in its own document stays; a null text stays null and an empty text
stays empty; a null ``doc_id`` sorts before the others; repeated rows (same id and text) are one document and are changed alike; two
occurrences in one document count as a repeat; other columns, whatever their names, pass through ``dedup_lines`` unchanged; an empty
table gives an empty result. Time grows with a text's lines and its repeated chunks, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of, words_of

#: A character of a word.
WORDED = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    """Array of struct<i, x>: the lines with words, numbered from 1 among all lines."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct((i + 1).alias("i"), x.alias("x")))
    return F.filter(numbered, lambda s: s["x"].rlike(WORDED))


#: Lines that the rolling hash sees, and how many lines a chunk has on average.
WINDOW, SPACING = 3, 8


def _chunk_ends(h: Column) -> Column:
    """Numbers of the lines that end a chunk, from the line hashes."""
    rolling = lambda i: F.xxhash64(*(F.get(h, i - 1 - back) for back in range(WINDOW)))
    return F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == F.size(h)) | (F.pmod(rolling(i), F.lit(SPACING)) == 0))


def _starts(goes: int) -> Column:
    """Array of struct<k, goes>: the first line of each chunk."""
    return F.transform("ends", lambda e, j: F.struct((F.coalesce(F.get(F.col("ends"), j - 1), F.lit(0)) + 1).alias("k"), F.lit(goes).alias("goes")))


def _inside() -> Column:
    """For each line the number of the chunk it goes with, or null; null for a text of which nothing goes.

    ``marks`` holds all chunks' first lines and, once more, those of the chunks that go, in order: a chunk goes if its own follows it.
    """
    marked = F.transform("marks", lambda m, i: F.struct(m["k"].alias("k"), m["goes"].alias("goes"), (F.get(F.col("marks"), i + 1)["k"] == m["k"]).alias("twice")))
    chunks = F.filter(marked, lambda m: m["goes"] == 0)
    size = lambda m, j: F.element_at("ends", j + 1) - m["k"] + 1
    return F.flatten(F.transform(chunks, lambda m, j: F.array_repeat(F.when(m["twice"], m["k"]), size(m, j))))


def _run(h: Column, k: Column, n: Column | int) -> Column:
    return F.struct(k.cast("int").alias("k"), (n if isinstance(n, Column) else F.lit(n)).cast("int").alias("n"), F.xxhash64(F.slice(h, k, n)).alias("hash"))


def _coarse() -> Column:
    """Array of struct<k, n, hash>: the chunks of three and more lines, from line k on; ``ends`` are their last lines."""
    first = lambda j: F.coalesce(F.get(F.col("ends"), j - 1), F.lit(0)) + 1
    bounds = F.transform("ends", lambda e, j: F.struct(first(j).alias("k"), (e - first(j) + 1).alias("n")))
    return F.transform(F.filter(bounds, lambda c: c["n"] >= 3), lambda c: _run(F.col("h"), c["k"], c["n"]))


def _fine() -> Column:
    """The pairs of neighbours (n = 2) that lie in no chunk of ``inside``, and the long lines (n = 1) outside of them.

    ``inside`` holds a number for each line: that of the chunk it goes with, or null.
    """
    h, at = F.col("h"), lambda k: F.element_at("inside", k)
    open_pair = lambda k: F.col("inside").isNull() | ~F.coalesce(at(k) == at(k + 1), F.lit(False))
    pairs = F.when(F.size(h) > 1, F.filter(F.sequence(F.lit(1), F.size(h) - 1), open_pair)).otherwise(F.array().cast("array<int>"))
    long = F.filter("long", lambda k: F.col("inside").isNull() | at(k).isNull())
    return F.concat(F.transform(pairs, lambda k: _run(h, k, 2)), F.transform(long, lambda k: _run(h, k, 1)))


def _read(r: Column) -> Column:
    """A run's hash, bytes and range of lines a..b, at a text's edge with the lines without words there."""
    end = r["k"] + r["n"] - 1
    a = F.when(r["k"] == 1, 1).otherwise(F.element_at("lines", r["k"])["i"])
    b = F.when(end == F.size("lines"), F.col("all")).otherwise(F.element_at("lines", end)["i"])
    text = F.array_join(F.transform(F.slice("lines", r["k"], r["n"]), lambda s: s["x"]), "\n")
    return F.struct(a.alias("a"), b.alias("b"), r["hash"].alias("hash"), r["is_first"].alias("is_first"), text.alias("bytes"))


SALTS = 8


def _later(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, k, n, hash, is_first) of the runs (doc_id, key, k, n, hash) that occur more than once, without those that overlap the first in its document.

    The most frequent run may be in a third of all texts, so its rows are dealt out by a salt and the few rows they meet are copied for each.
    """
    # A hash of the place tells occurrences apart in 8 bytes. Repeated rows have equal places, so two places are two occurrences.
    spot = F.xxhash64("key", "k")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("to")
    again = runs.groupBy("hash").agg(F.min(spot).alias("one"), F.max(spot).alias("other")).where("one != other").select(F.col("hash").alias("of"), salts)
    salted = runs.withColumn("salt", F.pmod(F.col("key"), F.lit(SALTS)).cast("int"))
    repeated = scratch.save(salted.join(again, (F.col("hash") == F.col("of")) & (F.col("salt") == F.col("to")), "left_semi"), "repeated")
    place = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), "key", "k")
    firsts = repeated.groupBy("hash").agg(F.min(place).alias("first")).select(F.col("hash").alias("of"), "first", salts)
    is_first = place == F.col("first")
    apart = (F.col("key") != F.col("first.key")) | (F.col("k") >= F.col("first.k") + F.col("n"))
    both = repeated.join(firsts, (F.col("hash") == F.col("of")) & (F.col("salt") == F.col("to"))).where(is_first | apart)
    out = scratch.save(both.select("key", "k", "n", "hash", is_first.alias("is_first")).distinct(), "later")
    scratch.drop(repeated)
    return out


def repeated_runs(docs: DataFrame, scratch: Scratch, long_line: int = 50) -> DataFrame:
    """(key, a, b): line ranges to remove; ranges may overlap."""
    df = docs.select("doc_id", text_of("text").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    df = df.select("doc_id", "key", _lines(F.col("text")).alias("lines"))
    long = F.transform("lines", lambda s, k: F.when(F.size(words_of(s["x"])) >= long_line, k + 1))
    # Texts are read once for their line hashes; both grains are cut from those.
    hashed = df.select("doc_id", "key", F.transform("lines", lambda s: F.xxhash64(s["x"])).alias("h"), F.filter(long, lambda k: k.isNotNull()).alias("long"))
    hashed = scratch.save(hashed.withColumn("ends", _chunk_ends(F.col("h"))), "hashes")
    chunks = _later(hashed.select("doc_id", "key", F.explode(_coarse()).alias("r")).select("doc_id", "key", "r.*"), scratch)
    going = chunks.where("not is_first").groupBy("key").agg(F.collect_list("k").alias("going")).withColumnRenamed("key", "going_key")
    rest = hashed.join(going.hint("merge"), F.col("key") == F.col("going_key"), "left").withColumn("marks", F.array_sort(F.concat(_starts(0), F.transform("going", lambda k: F.struct(k.alias("k"), F.lit(1).alias("goes"))))))
    rest = rest.withColumn("inside", _inside())
    runs = scratch.save(rest.select("doc_id", "key", F.explode(_fine()).alias("r")).select("doc_id", "key", "r.*"), "runs")
    scratch.drop(hashed)
    pairs = _later(runs, scratch)
    scratch.drop(runs)
    # Only texts with a repeated run are read again, for the comparison of bytes. Texts meet what grows with them by sort-merge joins, which can spill.
    marked = chunks.unionByName(pairs)
    asked = marked.groupBy("key").agg(F.collect_list(F.struct("k", "n", "hash", "is_first")).alias("asked")).withColumnRenamed("key", "asked_key")
    texts = docs.select(F.xxhash64("doc_id", text_of("text")).alias("key"), text_of("text").alias("text")).join(asked.hint("merge"), F.col("key") == F.col("asked_key"))
    texts = texts.select("key", "asked", F.size(F.split("text", "\n")).alias("all"), _lines(F.col("text")).alias("lines"))
    texts = texts.select("key", F.explode(F.transform("asked", _read)).alias("r")).select("key", "r.*")
    texts = scratch.save(texts, "texts")
    scratch.drop(chunks, pairs)
    # A chunk's hash may be that of a run of other length only by chance; its bytes then differ.
    firsts = texts.where("is_first").select(F.col("hash").alias("of"), F.col("bytes").alias("first_bytes")).dropDuplicates(["of"])
    same = texts.where("not is_first").join(firsts, F.col("hash") == F.col("of")).where(F.col("bytes") == F.col("first_bytes"))
    gone = scratch.save(same.select("key", "a", "b").distinct(), "gone")
    scratch.drop(texts)
    return gone


def dedup_lines(docs: DataFrame, long_line: int = 50) -> DataFrame:
    """``docs`` with ``text`` without repeated runs, and ``removed_lines`` (int), ``all_lines`` (int) beside (in place of such columns)."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    gone = repeated_runs(docs, scratch, long_line).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("a", "b")))).alias("gone"))
    # The other columns go along as one, so that none clashes with a name used here.
    text = F.col("text")
    df = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), F.xxhash64("doc_id", text_of("text")).alias("row_key"))
    df = df.join(gone.hint("merge"), F.col("row_key") == F.col("key"), "left").withColumn("lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(1), F.size("lines")), F.col("gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i - 1)), "\n")
    found = F.col("gone").isNotNull()
    df = df.select(
        F.col("row"), F.when(found, left).otherwise(text).alias("text"),
        F.when(found, F.size("gone")).otherwise(0).alias("removed_lines"),
        F.when(text == "", 0).otherwise(F.coalesce(F.when(text.isNotNull(), F.size("lines")), F.lit(0))).alias("all_lines"),
    )
    own = ("removed_lines", "all_lines")
    return df.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in own), *own)

"""Document fingerprints by I-Match (DataFrame functions only).

The lexicon is the terms (lower-cased words) whose document frequency lies in a band of shares of all documents. A
text's lexicon terms, distinct and sorted, are hashed over randomised lexicon subsets: at each level the lexicon is
split at random into parts (16, 64, 256, 1024, 4096) and the first 16 parts are the subsets. Dense subsets tell short texts apart
and sparse ones survive edits of long texts; for any text some level leaves it one to four terms a subset. A fingerprint lists
the 80 hashes; a subset without terms of the text is blank.

The band's lower end bounds the lexicon, whatever the corpus: with at most D distinct terms in a text on average, at
most D / ``low`` terms can reach the share ``low``. It is counted, and broadcast (8 bytes a term) only if it has at most
``most_broadcast`` terms; a larger one is joined by shuffles.

Defined results: a null text counts as empty; the fingerprint of a text without lexicon terms is a hash of the whole text, so it is
like equal texts alone; a row with null ``doc_id`` has no next document, so its last quarter is cut and ``near_next`` is null; rows
that share an id share the next document, and where the next id is repeated, its least text stands for it; repeated rows get
the same results each; extra columns are ignored; an empty table gives an empty result. Time grows in proportion to a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of, words_of

PARTS = (16, 64, 256, 1024, 4096)
SUBSETS = 16


def terms_of(text: Column) -> Column:
    """Distinct hashed terms: 64 bits stand for a lower-cased word."""
    return F.array_distinct(F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = 0.0005, high: float = 0.25) -> DataFrame:
    """(term): those in at least two documents and in a share of ``low`` to ``high`` of all."""
    total = docs.agg(F.count("*").alias("total"))
    terms = docs.select(F.explode(terms_of(text_of("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    held = (F.col("df") >= 2) & (F.col("df") >= low * F.col("total")) & (F.col("df") <= F.greatest(F.lit(2.0), high * F.col("total")))
    return terms.join(F.broadcast(total)).where(held).select("term")


def add_fingerprint(df: DataFrame, terms: str, whole: str, out: str) -> DataFrame:
    """From a column of distinct lexicon terms in sorted order; without any, from a hash of the whole text."""
    for n, parts in enumerate(PARTS):
        placed = F.transform(F.col(terms), lambda t: F.struct(F.pmod(F.xxhash64(t, F.lit(n)), F.lit(parts)).cast("int").alias("p"), t.alias("t")))  # noqa: B023
        df = df.withColumn(f"__level{n}", F.filter(placed, lambda x: x["p"] < SUBSETS))

    def level(n: int) -> Column:
        own = F.col(f"__level{n}")

        def one(j: Column) -> Column:
            mine = F.transform(F.filter(own, lambda x: x["p"] == j), lambda x: x["t"])
            return F.when(F.exists(own, lambda x: x["p"] == j), F.substring(F.lpad(F.lower(F.hex(F.xxhash64(mine))), 16, "0"), 9, 8)).otherwise("")

        return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), one)

    names = [f"__level{n}" for n in range(len(PARTS))]
    prints = F.array_join(F.concat(*map(level, range(len(PARTS)))), ",")
    return df.withColumn(out, F.when(F.size(terms) > 0, prints).otherwise(F.lower(F.hex(whole)))).drop(*names)


def likeness(a: str, b: str) -> Column:
    """0 to 1: the best level's share of agreeing subsets among those that either text has; equal fingerprints give 1."""
    x, y = F.split(a, ","), F.split(b, ",")
    shares = []
    for n in range(len(PARTS)):
        pairs = F.arrays_zip(F.slice(x, n * SUBSETS + 1, SUBSETS).alias("a"), F.slice(y, n * SUBSETS + 1, SUBSETS).alias("b"))
        same = F.size(F.filter(pairs, lambda p: (p["a"] != "") & (p["a"] == p["b"])))
        either = F.size(F.filter(pairs, lambda p: (p["a"] != "") | (p["b"] != "")))
        # Where few subsets have terms, one that agrees by chance must not count for much.
        shares.append(same / F.greatest(either, F.lit(1 if n == 0 else 4)))
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(*shares))


def next_ids(ids: DataFrame, per_range: int = 50_000, most_ranges: int = 256) -> DataFrame:
    """(doc_id, next_id): the next id in ascending order, after the last the first.

    Ids are cut into ranges by their quantiles, so that no task sorts them all; only the ranges' first ids meet in one place.
    """
    n = ids.count()
    ranges = max(1, min(most_ranges, n // per_range))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10_000).alias("cuts")).first()["cuts"] if ranges > 1 else []
    bounds = sorted(set(cuts or []))
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    ids = ids.withColumn("range", at)
    firsts = ids.groupBy("range").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("range")  # at most ``most_ranges`` rows
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("after"))
    inside = ids.withColumn("lead", F.lead("doc_id").over(Window.partitionBy("range").orderBy("doc_id")))
    return inside.join(F.broadcast(firsts), "range").select("doc_id", F.coalesce("lead", "after").alias("next_id"))


def _prints(both: DataFrame, lex: DataFrame, small: bool) -> DataFrame:
    """Fingerprints of rows with doc_id, text and head, which lends its first characters to the edited text."""
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("head", F.lit(1), cut))
    both = both.select("doc_id", F.xxhash64("text").alias("row"), F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    info = F.array(F.struct(F.lit(None).cast("long").alias("term"), F.lit(0).alias("version"), F.sha2("edited", 256).alias("sha"), F.col("n_chars").alias("n"), F.xxhash64("edited").alias("whole")))
    none = lambda v: lambda t: F.struct(t.alias("term"), F.lit(v).alias("version"), F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("whole"))
    # One row carries what belongs to the document, the others a term each; ids keep their place, so grouping needs no exchange.
    parts = both.select("doc_id", "row", F.explode(F.concat(info, F.transform(terms_of(F.col("text")), none(0)), F.transform(terms_of(F.col("edited")), none(1)))).alias("x")).select("doc_id", "row", "x.*")
    held = lex.withColumnRenamed("term", "held")
    parts = parts.join(F.broadcast(held) if small else held, F.col("term") == F.col("held"), "left").where("term is null or held is not null")
    grouped = parts.groupBy("doc_id", "row").agg(
        F.max("n").alias("n_chars"), F.max("sha").alias("edited_sha256"), F.max("whole").alias("whole"),
        F.sort_array(F.collect_set(F.when(F.col("version") == 0, F.col("term")))).alias("own"),
        F.sort_array(F.collect_set(F.when(F.col("version") == 1, F.col("term")))).alias("new"),
        F.count("sha").alias("copies"),
    )
    printed = add_fingerprint(add_fingerprint(grouped, "own", "row", "fingerprint"), "new", "whole", "edited_fingerprint")
    return printed.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "copies")


def fingerprint_with_edits(docs: DataFrame, low: float = 0.0005, high: float = 0.25, most_broadcast: int = 4_000_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text's last quarter (rounded down) is replaced by as many first characters of the next document.
    """
    scratch = Scratch(docs.sparkSession, "imatch")
    lex = scratch.save(lexicon(docs, low, high), "lexicon")
    small = lex.count() <= most_broadcast
    rows = docs.select("doc_id", text_of("text").alias("text"))
    known = rows.where("doc_id is not null")
    sizes = scratch.save(known.groupBy("doc_id").agg(F.floor(F.max(F.length("text")) / 4).cast("int").alias("cut")), "sizes")
    following = scratch.save(next_ids(sizes.select("doc_id")), "next")
    asks = following.join(sizes, "doc_id").select(F.col("doc_id").alias("for_id"), F.col("next_id"), "cut")
    heads = known.join(asks, F.col("doc_id") == F.col("next_id")).select("for_id", F.substring("text", F.lit(1), F.col("cut")).alias("head"))
    heads = heads.groupBy("for_id").agg(F.min("head").alias("head"))
    # Both joins read ``known`` by doc_id, so its texts are shuffled once.
    both = known.join(heads, F.col("doc_id") == F.col("for_id"), "left").select("doc_id", "text", text_of("head").alias("head"))
    alone = rows.where("doc_id is null").withColumn("head", F.lit(""))
    prints = scratch.save(_prints(both, lex, small).unionByName(_prints(alone, lex, small)), "prints")
    firsts = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fingerprint").alias("next_print")).withColumnRenamed("doc_id", "next_id")
    nearby = following.join(firsts, "next_id").select(F.col("doc_id").alias("for_id"), "next_print")
    out = prints.join(nearby, F.col("doc_id") == F.col("for_id"), "left")
    out = out.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), F.when(F.col("next_print").isNotNull(), likeness("fingerprint", "next_print")).alias("near_next"))

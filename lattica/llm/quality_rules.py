"""Quality rules by distribution divergence (DataFrame functions only).

Base rules count words, symbols, repeated lines and repeated 8-word windows. The method then compares each text's
character-class histogram and common-word histogram with its language's reference by the Jensen-Shannon distance
(square root of the divergence in bits, 0 to 1). A language's common words are its most frequent ones in the corpus, counted over
all texts; its references are summed over all its texts that pass the base rules. Texts whose language is null or has under
``least_share`` of all texts form one group with words and references of its own, so there are at most 1 / ``least_share`` groups more:
that is why words and references may be broadcast.

Defined results: a null text counts as empty; an empty or white-space text has zero counts and fails the base rules; a
text of under ``min_words`` words gets no verdict from the distances (they are null) and keeps its base verdict; so does
a text whose group has no text that passes the base rules. A null ``doc_id`` is a row like any other, repeated rows are judged alike, extra
columns are ignored, ties among common words go to the least word, an empty table gives an empty result. Long texts take
time in proportion to their words, and to the logarithm of the words where windows repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of, words_of

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]+"
COMMON = 16
#: Classes of characters; lower-case letters, white space, symbols and what is left are counted beside.
CHAR_CLASSES = {"upper": "[A-Z]+", "digit": "[0-9]+", "mark": r"[!-/:-@\[-`{-~]+"}


def _cut(text: str, regex: str) -> Column:
    """How many characters of a column the expression matches."""
    return F.length(text) - F.length(F.regexp_replace(text, regex, ""))


def _windows(df: DataFrame) -> DataFrame:
    """``w`` to ``win``: a hash of the eight words from each word on, built by doubling (1, 2, 4, 8); the last seven are of fewer words."""
    df = df.withColumn("win", F.transform("w", lambda x: F.xxhash64(x)))
    width = 1
    while width < WINDOW:
        later = F.slice("win", width + 1, F.greatest(F.size("win") - width, F.lit(0)))
        df = df.withColumn("win", F.zip_with("win", later, lambda a, b: F.xxhash64(a, b)))
        width *= 2
    return df


def _repeat_words(df: DataFrame) -> DataFrame:
    """``win`` to ``n_repeat_words``. Only texts with two equal windows are looked at more closely."""
    places = F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("placed", F.when(F.size(F.array_distinct("win")) < F.size("win"), places).otherwise(none)).drop("win")
    same = lambda x, k, d: F.coalesce(F.get(F.col("placed"), k + d)["h"] == x["h"], F.lit(False))
    again = F.filter("placed", lambda x, k: ((k > 0) & same(x, k, F.lit(-1))) | same(x, k, F.lit(1)))
    df = df.withColumn("at", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("placed")
    covered = F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), k + 1) - x, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, b: a + b).cast("long")).drop("at")


def grouped_by_language(docs: DataFrame, least_share: float) -> DataFrame:
    """doc_id, text (never null) and ``grp``: the language, or null for those of too few texts."""
    rows = docs.select("doc_id", text_of("text").alias("text"), "lang")
    langs = rows.groupBy("lang").agg(F.count("*").alias("n"))
    total = langs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # At most 1 / least_share languages.
    own = sorted(r["lang"] for r in langs.where(F.col("lang").isNotNull() & (F.col("n") >= least_share * total)).select("lang").collect())
    return rows.withColumn("grp", F.when(F.col("lang").isin(own), F.col("lang")) if own else F.lit(None).cast("string"))


def common_words(rows: DataFrame, most: int = COMMON) -> DataFrame:
    """(grp, vocabulary): the ``most`` most frequent lower-cased words of each group, over all its texts."""
    forms = rows.select("grp", F.explode(words_of(F.col("text"))).alias("x")).groupBy("grp", "x").agg(F.count("*").alias("n"))
    counts = forms.groupBy("grp", F.lower("x").alias("x")).agg(F.sum("n").alias("n"))
    first = Window.partitionBy("grp").orderBy(F.desc("n"), "x")
    best = counts.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most)
    return best.groupBy("grp").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "x"))), lambda s: s["x"]).alias("vocabulary"))


def base_counts(rows: DataFrame, vocabularies: DataFrame) -> DataFrame:
    """Per row of (doc_id, text, grp): the base counts and the histograms ``chars`` and ``common``."""
    spark = rows.sparkSession
    known = [(r["grp"], r["vocabulary"]) for r in vocabularies.collect()]  # ``COMMON`` words a group
    listed = sorted({f for _, words in known for w in words for f in (w, w.capitalize(), w.upper())})
    table = F.broadcast(spark.createDataFrame(known, "of string, vocabulary array<string>"))
    df = rows.join(table, F.col("grp").eqNullSafe(F.col("of")), "left").drop("of").withColumn("w", words_of(F.col("text")))
    some = F.filter("w", lambda x: x.isin(listed)) if listed else F.slice("w", 1, 0)
    df = df.withColumn("some", F.split(F.lower(F.array_join(some, " ")), " "))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("lines", lines).withColumn("n_words", F.size("w").cast("long")).withColumn("len", F.length("text"))
    df = df.withColumn("word_chars", F.length(F.array_join("w", "")))
    # Without lower-case letters and spaces little is left, which the other classes are counted in.
    df = df.withColumn("rest", F.regexp_replace("text", r"[a-z\x20]+", "")).drop("text")
    df = _repeat_words(_windows(df).drop("w"))
    white = F.col("len") - F.col("word_chars")
    cuts = {"symbol": _cut("rest", SYMBOLS), "white": _cut("rest", r"[\x09-\x0D]+")} | {k: _cut("rest", r) for k, r in CHAR_CLASSES.items()}
    df = df.select("*", *(v.alias(f"c_{k}") for k, v in cuts.items()), F.length("rest").alias("c_rest"), white.alias("c_space"))
    lower = F.col("len") - F.col("c_rest") - (F.col("c_space") - F.col("c_white"))
    classes = [lower, F.col("c_upper"), F.col("c_digit"), F.col("c_mark") - F.col("c_symbol"), F.col("c_symbol"), F.col("c_space")]
    other = F.greatest(F.lit(0), F.col("len") - sum(classes[1:], classes[0]))
    found = F.transform("vocabulary", lambda v: F.size("some") - F.size(F.array_remove(F.col("some"), v)))
    found = F.coalesce(found, F.array().cast("array<int>"))
    df = df.select(
        "doc_id", "grp", "n_words", F.col("word_chars").cast("long").alias("word_chars"), F.col("c_symbol").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.transform(F.array(*classes, other), lambda x: x.cast("long")).alias("chars"), found.alias("common"),
    )
    rest = F.greatest(F.lit(0), F.col("n_words") - F.aggregate("common", F.lit(0), lambda a, b: a + b)).cast("long")
    df = df.withColumn("common", F.concat(F.transform("common", lambda x: x.cast("long")), F.array(rest)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda x, y: x + y)


def with_shares(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Histograms as shares of their sums: arrays of double, null where the sum is 0."""
    df = df.withColumns({f"__{c}": _total(F.col(c)) for c in columns})
    # Using a sum twice keeps the optimizer from computing it again for each element.
    share = lambda c: F.when(F.col(f"__{c}") > 0, F.transform(c, lambda x: x / F.col(f"__{c}")))
    shares = {out: share(c) for c, out in columns.items()}
    return df.withColumns(shares).drop(*(f"__{c}" for c in columns))


def references(sample: DataFrame) -> DataFrame:
    """(of, ref_chars, ref_common): the shares of each group's summed histograms, over texts that pass the base rules."""
    n = {"chars": len(CHAR_CLASSES) + 4, "common": COMMON + 1}
    parts = [F.sum(F.get(F.col(k), F.lit(i))).alias(f"{k}_{i}") for k, size in n.items() for i in range(size)]
    out = sample.where(~F.col("base_failed")).groupBy("grp").agg(*parts)
    # A group of fewer words has shorter histograms.
    out = out.select(F.col("grp").alias("of"), *[F.array_compact(F.array(*(F.col(f"{k}_{i}") for i in range(size)))).alias(k) for k, size in n.items()])
    return with_shares(out, {"chars": "ref_chars", "common": "ref_common"}).select("of", "ref_chars", "ref_common")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares; null where either is null."""
    term = lambda a, b: F.when(a > 0, 0.5 * a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return F.sqrt(F.greatest(F.lit(0.0), _total(F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a)))))


def _against(stats: DataFrame, sample: DataFrame) -> DataFrame:
    """``stats`` with its distances from the references summed over ``sample``."""
    df = stats.join(F.broadcast(references(sample)), F.col("grp").eqNullSafe(F.col("of")), "left")
    far = lambda k: distance(F.col(f"p_{k}"), F.col(f"ref_{k}"))
    return df.withColumn("char_distance", far("chars")).withColumn("word_distance", far("common")).select(*stats.columns, "char_distance", "word_distance")


def quality_rules(docs: DataFrame, min_words: int = 50, max_chars: float = 0.2, max_words: float = 0.2, slack: float = 0.9, least_share: float = 0.001) -> DataFrame:
    """doc_id, the base counts, base_failed, char_distance, word_distance and kept.

    References are summed twice: over all texts that pass the base rules, then over those of them within the limits of
    the first references, so that junk does not shape them. ``slack`` over the root of the word count widens the
    limit on common words: a short text's histogram strays by chance.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    rows = grouped_by_language(docs, least_share)
    stats = scratch.save(with_shares(base_counts(rows, common_words(rows)), {"chars": "p_chars", "common": "p_common"}), "stats")
    long_enough = F.col("n_words") >= min_words
    close = (F.coalesce("char_distance", F.lit(0.0)) <= max_chars) & (F.coalesce("word_distance", F.lit(0.0)) <= max_words + slack / F.sqrt(F.greatest(F.lit(1.0), F.col("n_words").cast("double"))))
    first = _against(stats, stats)
    df = _against(stats, first.where(close).select(*stats.columns))
    for k in ("char_distance", "word_distance"):
        df = df.withColumn(k, F.when(long_enough, F.col(k)))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", (~F.col("base_failed") & close).alias("kept"))

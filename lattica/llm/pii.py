"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Base entities (email, ip, card, phone) are found by expression and validated. They seed the method: tokens with a digit
or an at sign are instances, the one or two words before a token are its lexical patterns, and the pattern-instance
graph is scored in rounds. A pattern's score is the smoothed share of its distinct instances' scores; an instance that is no
seed takes its best pattern's score. Tokens that no base entity covers, look like identifiers and follow a pattern of high
score and enough support (the summed scores of its instances, seeds or not) become ``context`` spans.

Defined results: a null text counts as empty and has no spans; rows are keyed by a hash of id and text, so a null
``doc_id`` is a row like any other and repeated rows get the same spans each; extra columns are ignored; an empty table gives
an empty result. A text of n tokens takes time in proportion to n times the root of n at most, so very long ones hold no task up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, add_spans, span_text, tagged, text_of, words_of

# The base kinds in their listed order. Possessive repeats and the look-behinds, which skip starts within a
# run that failed from its first character, keep long runs from taking quadratic time; the matches are the same.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "context")
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*[0-9@])[^\x20\x09-\x0D]+"
_OCTET = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    backwards = F.reverse(_digits(m))
    doubled = F.transform(F.sequence(F.lit(1), F.length(backwards)), lambda i: F.substring(backwards, i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str):
    """What a match of a base kind must satisfy beyond its expression."""
    if kind == "ip":
        return lambda x: F.forall(F.split(x["m"], r"\."), lambda part: F.rlike(part, F.lit(_OCTET)))
    if kind == "card":
        return lambda x: F.length(_digits(x["m"])).between(16, 19) & _luhn(x["m"])
    if kind == "phone":
        return lambda x: F.length(_digits(x["m"])).between(8, 15)
    return None


def find_entities(docs: DataFrame) -> DataFrame:
    """doc_id, key, ``spans_<kind>`` of the base kinds and ``tokens`` (place, normal form, patterns, whether a base span covers it)."""
    df = docs.select("doc_id", text_of("text").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    mark = {"email": "@", "phone": "+", "ip": "."}
    for kind, regex in BASE.items():
        asked = F.contains(F.col("text"), F.lit(mark[kind])) if kind in mark else F.rlike(F.col("text"), F.lit("[0-9]"))
        df = df.withColumn("__t", F.when(asked, F.col("text")).otherwise(""))
        df = add_spans(df, "__t", f"spans_{kind}", regex, _valid(kind)).drop("__t")
    df = add_spans(df, "text", "raw", TOKEN, gaps="gaps")
    df = df.withColumn("base", F.concat(*(f"spans_{k}" for k in BASE)))
    # Base spans by stretches of the text, as many as the root of their number: a token meets those of its own stretches only.
    df = df.withColumn("wide", F.floor(F.length("text") / F.ceil(F.sqrt(F.greatest(F.size("base"), F.lit(1))))).cast("int") + 1).drop("text")
    stretches = F.sequence(F.lit(0), F.ceil(F.sqrt(F.greatest(F.size("base"), F.lit(1)))).cast("int"))
    touching = lambda k: F.filter(F.col("base"), lambda b: (b["s"] < (k + 1) * F.col("wide")) & (b["e"] > k * F.col("wide")))
    df = df.withColumn("near", F.when((F.size("base") > 0) & (F.size("raw") > 0), F.transform(stretches, touching))).drop("base")

    def token(x: Column, i: Column) -> Column:
        # The two words before a token lie in the piece before it, or are the tokens before that.
        back = lambda k: F.concat(F.coalesce(F.get(F.col("raw"), i - k)["m"], F.lit("")), F.coalesce(F.get(F.col("gaps"), i - k + 1), F.lit("")))
        left = F.slice(F.concat(F.array(F.lit(""), F.lit("")), words_of(F.lower(F.concat(back(2), back(1))))), -2, 2)
        plain = F.transform(F.array_remove(left, ""), lambda w: F.regexp_replace(F.regexp_replace(w, "[0-9]+", "0"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}:=#]+$", ""))
        value = F.regexp_replace(F.lower(x["m"]), r"^[^\p{L}\p{N}+]+|[^\p{L}\p{N}]+$", "")
        first, last = (F.floor(at / F.col("wide")).cast("int") for at in (x["s"], x["e"] - 1))
        seed = F.exists(F.slice(F.col("near"), first + 1, last - first + 1), lambda some: F.exists(some, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), value.alias("value"), F.array(F.try_element_at(plain, F.lit(-1)), F.concat_ws(" ", plain)).alias("patterns"), F.coalesce(seed, F.lit(False)).alias("seed"))

    some = F.when((F.size("raw") > 0) & ((F.size("near") > 0) | F.col("near").isNull()), F.transform("raw", token))
    return df.select("doc_id", "key", *(f"spans_{k}" for k in BASE), some.alias("tokens"))


def score_patterns(edges: DataFrame, scratch: Scratch, rounds: int = 3, smoothing: float = 4.0) -> DataFrame:
    """(pattern, score, support) from (pattern, value, seed), distinct pairs of the graph; support is the sum of its instances' scores."""
    edges = scratch.save(edges.withColumn("score", F.col("seed").cast("double")), "edges")
    for r in range(rounds):
        scored = edges.groupBy("pattern").agg((F.sum("score") / (F.count("*") + smoothing)).alias("p"), F.sum("score").alias("support"))
        if r == rounds - 1:
            return scored.select("pattern", F.col("p").alias("score"), "support")
        best = edges.join(scored, "pattern").groupBy("value").agg(F.max("p").alias("best"))
        fresh = edges.drop("score").join(best, "value").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.col("best")))
        edges = scratch.save(fresh.select("pattern", "value", "seed", "score"), "edges")
    raise ValueError("rounds must be at least 1")


def find_pii(docs: DataFrame, rounds: int = 3, least_score: float = 0.6, least_support: float = 8.0, least_digits: int = 5) -> DataFrame:
    """doc_id and ``spans_<kind>`` for the base kinds and ``context``: array of struct<m, s, e>, in code points, end exclusive."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.save(find_entities(docs), "entities")
    tokens = rows.where(F.size("tokens") > 0).select("key", F.explode("tokens").alias("x")).select("key", "x.*")
    edges = tokens.select(F.explode(F.array_distinct("patterns")).alias("pattern"), "value", "seed").where("pattern is not null and pattern != '' and value != ''")
    edges = edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    trusted = score_patterns(edges, scratch, rounds).where((F.col("score") >= least_score) & (F.col("support") >= least_support)).select("pattern")
    unseen = tokens.where(~F.col("seed") & (F.length(_digits(F.col("value"))) >= least_digits))
    unseen = unseen.select("key", F.explode(F.array_distinct("patterns")).alias("pattern"), F.struct(F.col("value").alias("m"), "s", "e").alias("span"))
    found = unseen.join(trusted, "pattern", "left_semi").groupBy("key").agg(F.collect_set("span").alias("found")).withColumnRenamed("key", "found_key")
    df = rows.join(found, F.col("key") == F.col("found_key"), "left")
    return df.select("doc_id", *(f"spans_{k}" for k in BASE), F.coalesce("found", F.array().cast("array<struct<m:string,s:int,e:int>>")).alias("spans_context"))


def pii_digest(df: DataFrame) -> DataFrame:
    join = lambda kinds: F.sort_array(reduce(lambda a, b: F.concat(a, b), [tagged(f"spans_{k}", k, KINDS.index(k), kind_first=True) for k in kinds]))
    counts = [F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(span_text(join(BASE)), 256).alias("base_sha256"), span_text(join(KINDS)).alias("spans"))

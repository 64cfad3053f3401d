"""Full-text search, facets and autocomplete (section 2.11).

Rule: a text's tokens are its lower-cased runs of letters, digits and underscores; a search matches when every one of its tokens
occurs; rank is the sum of 1 + ln(tf) over 1 + ln(length in tokens), in millionths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import top_n
from ..plans import Catalog, query

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def search(docs: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """``docs`` that match all terms, with ``rank``. Substring tests run first: they are cheap and reject most texts."""
    low = F.lower("text")
    hit = docs.where(reduce(lambda a, b: a & b, (F.contains(low, F.lit(t)) for t in terms)))
    hit = hit.withColumn("__w", tokens(F.col("text")))
    counts = [F.size(F.filter("__w", _is(term))) for term in terms]
    hit = hit.withColumn("__c", F.array(*counts)).withColumn("__n", F.size("__w")).where(F.array_min("__c") > 0)
    weight = F.aggregate("__c", F.lit(0.0), lambda a, n: a + 1 + F.log(n.cast("double")))
    rank = F.floor(F.round(weight / (1 + F.log(F.col("__n").cast("double"))), 9) * 10**6 + 0.5).cast("long")
    return hit.withColumn("rank", rank).drop("__w", "__c", "__n")


def _is(term: str):
    return lambda x: x == term


TERMS = ["the", "of", "and"]
_MATCH = """WITH tok AS (SELECT doc_id, lang, source, n_chars, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
    hits AS (SELECT *, len(list_filter(w, lambda x: x = 'the')) AS c1, len(list_filter(w, lambda x: x = 'of')) AS c2, len(list_filter(w, lambda x: x = 'and')) AS c3 FROM tok),
    ranked AS (SELECT doc_id, lang, source, n_chars, CAST(floor(round((3 + ln(c1) + ln(c2) + ln(c3)) / (1 + ln(len(w))), 9) * 1e6 + 0.5) AS BIGINT) AS rank FROM hits WHERE c1 > 0 AND c2 > 0 AND c3 > 0)"""


@query("f2_search_results", f"{_MATCH} SELECT doc_id, lang, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rank DESC, doc_id) AS rn FROM ranked) WHERE rn <= 20")
def search_results(c: Catalog, terms: list[str] = TERMS, n: int = 20) -> DataFrame:
    """The best of each kind (language); ranks are computed before wide columns are needed."""
    found = search(c.table("documents").select("doc_id", "lang", "text"), terms)
    return top_n(found.select("doc_id", "lang", "rank"), ["lang"], [F.desc("rank"), "doc_id"], n)


@query("f3_search_totals", f"{_MATCH} SELECT lang, count(*) AS total FROM ranked WHERE n_chars >= 500 GROUP BY 1")
def search_totals(c: Catalog, terms: list[str] = TERMS) -> DataFrame:
    return search(c.table("documents").where("n_chars >= 500").select("doc_id", "lang", "text"), terms).groupBy("lang").agg(F.count("*").alias("total"))


@query("f5_search_facets", f"{_MATCH} SELECT 'source' AS facet, source AS name, count(*) AS n FROM ranked GROUP BY 2 UNION ALL SELECT 'size', CAST(n_chars // 1000 AS VARCHAR), count(*) FROM ranked GROUP BY 2")
def search_facets(c: Catalog, terms: list[str] = TERMS) -> DataFrame:
    """All facets from one pass over the matches."""
    found = search(c.table("documents").select("doc_id", "source", "n_chars", "text"), terms)
    size = F.floor(F.col("n_chars") / 1000).cast("string")
    pairs = F.array(F.struct(F.lit("source").alias("facet"), F.col("source").alias("name")), F.struct(F.lit("size").alias("facet"), size.alias("name")))
    return found.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.name").agg(F.count("*").alias("n"))


@query("f9_filtered_search", f"{_MATCH} SELECT doc_id, rank FROM ranked WHERE (source IS NULL OR source IN ('src0', 'src1')) AND (n_chars IS NULL OR n_chars BETWEEN 500 AND 5000)")
def filtered_search(c: Catalog, terms: list[str] = TERMS) -> DataFrame:
    """Filters let rows pass that lack the attribute; they stand below the match, so scans prune by them."""
    docs = c.table("documents").where((F.col("source").isNull() | F.col("source").isin("src0", "src1")) & (F.col("n_chars").isNull() | F.col("n_chars").between(500, 5000)))
    return search(docs.select("doc_id", "text"), terms).select("doc_id", "rank")


@query("f14_autocomplete", """SELECT p_partkey, p_name, CAST(CASE WHEN list_contains(string_split(lower(p_name), ' '), 're') THEN 2 ELSE 1 END AS BIGINT) AS score FROM part WHERE len(list_filter(string_split(lower(p_name), ' '), lambda x: starts_with(x, 're'))) > 0""")
def autocomplete(c: Catalog, prefix: str = "re") -> DataFrame:
    """A token must start with the prefix; a whole token scores 2."""
    words = F.split(F.lower("p_name"), " ")
    rows = c.table("part").select("p_partkey", "p_name").where(F.exists(words, lambda x: F.startswith(x, F.lit(prefix))))
    return rows.withColumn("score", F.when(F.array_contains(words, prefix), 2).otherwise(1).cast("long"))


@query("f16_autocomplete_labels", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE starts_with(lower(c_name), 'customer#00000001') ORDER BY length(c_name), c_custkey LIMIT 25")
def autocomplete_labels(c: Catalog, prefix: str = "customer#00000001") -> DataFrame:
    rows = c.labels.where(F.startswith(F.lower("name"), F.lit(prefix)))
    return rows.orderBy(F.length("name"), "label_id").limit(25).select(F.col("label_id").alias("id"), "name")

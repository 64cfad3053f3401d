"""Search over artists, labels, masters and releases: results, counts, facets, filters and suggestions (section 2.11).

Rule: a name's tokens are its lower-cased runs of letters, digits and underscores; an entity matches when every search term is one of
them; relevance is the share of its tokens that are terms, to four places. A release is named after its master and has the country of
its label. Filters let rows pass that lack the attribute.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scaled, top_n
from ..plans import Catalog, query
from .search import tokens

TERMS = ["red"]
#: Counts stop here: a user is told "10,000 or more".
MOST = 10_000
TYPES = ("artist", "label", "master", "release")


def entities(c: Catalog, only: DataFrame | None = None) -> dict[str, DataFrame]:
    """Each type's rows (type, id, name, year, country), or those whose names are in ``only`` (name, and what goes along): it meets masters before these meet their releases."""
    named = lambda df: df if only is None else df.join(only, "name")
    more = [] if only is None else [k for k in only.columns if k != "name"]
    parts = named(c.table("part").select(F.col("p_partkey").alias("master_id"), F.col("p_name").alias("name")))
    of_parts = c.masters if only is None else c.masters.join(parts.select("master_id"), "master_id", "left_semi")
    first = of_parts.join(c.releases.where("year > 0").select("release_id", "year"), "release_id").groupBy("master_id").agg(F.min("year").alias("year"))
    nation = c.labels.select("label_id", F.col("nation").alias("country"))
    none = F.lit(None).cast("long")
    return {
        "artist": named(c.artists).select(F.col("artist_id").alias("id"), "name", none.alias("year"), F.col("nation").alias("country"), *more),
        "label": named(c.labels).select(F.col("label_id").alias("id"), "name", none.alias("year"), F.col("nation").alias("country"), *more),
        "master": parts.join(first, "master_id", "left").select(F.col("master_id").alias("id"), "name", "year", none.alias("country"), *more),
        "release": c.masters.join(parts, "master_id").join(c.releases, "release_id").join(nation, "label_id", "left").select(F.col("release_id").alias("id"), "name", "year", "country", *more),
    }


def holds(name: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.array_contains(tokens(name), t) for t in terms))


def matches(c: Catalog, terms: list[str] = TERMS, types=TYPES) -> DataFrame:
    """(type, id, name, year, country, relevance): the test on names reaches each branch's own table."""
    found = [df.where(holds(F.col("name"), terms)).withColumn("type", F.lit(kind)) for kind, df in entities(c).items() if kind in types]
    both = reduce(DataFrame.unionByName, found).withColumn("words", tokens(F.col("name")))
    share = F.size(F.filter("words", lambda x: x.isin(terms))) / F.size("words")
    return both.withColumn("relevance", scaled(share, 4)).drop("words")


_HITS = """WITH named AS (SELECT m.release_id, m.master_id, p.p_name AS name FROM masters m JOIN part p ON p.p_partkey = m.master_id), first_ AS (SELECT master_id, min(year) AS year FROM masters JOIN releases USING (release_id) WHERE year > 0 GROUP BY 1),
    ent AS (SELECT 'artist' AS type, artist_id AS id, name, NULL::BIGINT AS year, nation AS country FROM artists UNION ALL SELECT 'label', label_id, name, NULL, nation FROM label_nodes
        UNION ALL SELECT 'master', p_partkey, p_name, year, NULL FROM part LEFT JOIN first_ ON master_id = p_partkey UNION ALL SELECT 'release', n.release_id, n.name, r.year, l.nation FROM named n JOIN releases r USING (release_id) LEFT JOIN label_nodes l USING (label_id)),
    tok AS (SELECT *, regexp_extract_all(lower(name), '[\\p{L}\\p{N}_]+') AS w FROM ent),
    hits AS (SELECT type, id, name, year, country, CAST(floor(len(list_filter(w, lambda x: x = 'red')) / len(w) * 1e4 + 0.5) AS BIGINT) AS relevance FROM tok WHERE list_contains(w, 'red'))"""


@query("f1_entity_results", f"{_HITS} SELECT type, id, name, relevance FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY relevance DESC, id) AS rn FROM hits) WHERE rn <= 20")
def entity_results(c: Catalog, terms: list[str] = TERMS, n: int = 20) -> DataFrame:
    """The best of each type."""
    return top_n(matches(c, terms).select("type", "id", "name", "relevance"), ["type"], [F.desc("relevance"), "id"], n)


@query("f4_type_counts", f"{_HITS} SELECT t.type, CAST(least(10000, count(h.id)) AS BIGINT) AS total FROM (VALUES ('artist'), ('label'), ('master'), ('release')) t(type) LEFT JOIN hits h ON h.type = t.type GROUP BY 1")
def type_counts(c: Catalog, terms: list[str] = TERMS) -> DataFrame:
    """Matches of each type, types without any included."""
    kinds = c.spark.createDataFrame([(t,) for t in TYPES], "type string")
    n = matches(c, terms).groupBy("type").agg(F.count("*").alias("n"))
    return F.broadcast(kinds).join(n, "type", "left").select("type", F.least(F.lit(MOST), F.coalesce("n", F.lit(0))).cast("long").alias("total"))


@query("f5_genre_facets", f"{_HITS} SELECT genre, count(*) AS n FROM hits h JOIN genres g ON g.release_id = h.id WHERE h.type = 'release' GROUP BY 1")
def genre_facets(c: Catalog, terms: list[str] = TERMS) -> DataFrame:
    found = matches(c, terms, ("release",)).select(F.col("id").alias("release_id"))
    return found.join(c.genres, "release_id").groupBy("genre").agg(F.count("*").alias("n"))


@query("f6_decade_facets", f"{_HITS} SELECT type, CAST(year - year % 10 AS VARCHAR) || 's' AS decade, CASE WHEN type = 'master' THEN least(10000, count(*)) ELSE count(*) END AS n FROM hits WHERE year BETWEEN 1000 AND 9999 GROUP BY 1, 2")
def decade_facets(c: Catalog, terms: list[str] = TERMS) -> DataFrame:
    """Four-digit years only; counts of masters stop at ``MOST``."""
    rows = matches(c, terms, ("master", "release")).where("year between 1000 and 9999")
    label = F.concat((F.col("year") - F.col("year") % 10).cast("string"), F.lit("s"))
    n = F.count("*")
    return rows.groupBy("type", label.alias("decade")).agg(n.alias("n")).withColumn("n", F.when(F.col("type") == "master", F.least(F.lit(MOST), "n")).otherwise(F.col("n")).cast("long"))


@query("f7_media_facets", f"{_HITS} SELECT family, count(DISTINCT h.id) AS n FROM hits h JOIN media m ON m.release_id = h.id WHERE h.type = 'release' GROUP BY 1")
def media_facets(c: Catalog, terms: list[str] = TERMS) -> DataFrame:
    found = matches(c, terms, ("release",)).select(F.col("id").alias("release_id"))
    return found.join(c.media.select("release_id", "family").distinct(), "release_id").groupBy("family").agg(F.count("*").alias("n"))


def media_filter(c: Catalog, found: DataFrame, families: list[str], mediums: list[str]) -> DataFrame:
    """Releases with one of the families or mediums, and those without any media."""
    some = c.media.groupBy("release_id").agg(F.bool_or(F.col("family").isin(families) | F.col("medium").isin(mediums)).alias("fits"))
    return found.join(some.withColumnRenamed("release_id", "id"), "id", "left").where(F.coalesce("fits", F.lit(True))).drop("fits")


@query("f10_media_filter", f"{_HITS}, fits AS (SELECT release_id, bool_or(family IN ('R') OR medium IN ('N_O')) AS ok FROM media GROUP BY 1) SELECT id, relevance FROM hits LEFT JOIN fits ON release_id = id WHERE type = 'release' AND coalesce(ok, true)")
def media_filtered(c: Catalog, terms: list[str] = TERMS, media: tuple[str, ...] = ("R", "N_O")) -> DataFrame:
    """Media ids without an underscore are families, the others mediums."""
    families, mediums = [m for m in media if "_" not in m], [m for m in media if "_" in m]
    return media_filter(c, matches(c, terms, ("release",)), families, mediums).select("id", "relevance")


@query("f11_country_filter", f"{_HITS} SELECT type, id FROM hits WHERE country IS NULL OR country IN (1, 2, 3)")
def country_filtered(c: Catalog, terms: list[str] = TERMS, countries: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    return matches(c, terms).where(F.col("country").isNull() | F.col("country").isin(list(countries))).select("type", "id")


@query("f12_formatted_results", f"""{_HITS} SELECT type, CAST(id AS VARCHAR) AS id, name, printf('%.4f', relevance / 1e4) AS relevance, coalesce(CAST(year AS VARCHAR), '') AS year, md5('{{"q":"red","type":"' || type || '"}}') AS cache_key FROM hits WHERE type IN ('master', 'release')""")
def formatted_results(c: Catalog, terms: list[str] = TERMS) -> DataFrame:
    """Rows as a response shows them, with a hash of the canonical request."""
    rows = matches(c, terms, ("master", "release"))
    key = F.md5(F.to_json(F.struct(F.lit(" ".join(terms)).alias("q"), F.col("type"))))
    return rows.select("type", F.col("id").cast("string"), "name", F.format_string("%.4f", F.col("relevance") / 10**4).alias("relevance"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"), key.alias("cache_key"))


def suggestions(names: DataFrame, prefix: str, n: int, pool: int | None = None) -> DataFrame:
    """(id, name, releases, score): names with a token that starts with the prefix; a whole token scores 2, else 1. Best first: score, the name
    itself, releases, short names, ids. With ``pool``, only so many by score and length are ranked by releases."""
    words = tokens(F.col("name"))
    rows = names.where(F.exists(words, lambda x: F.startswith(x, F.lit(prefix))))
    rows = rows.withColumn("score", F.when(F.array_contains(words, prefix), 2).otherwise(1).cast("long"))
    if pool:
        rows = rows.orderBy(F.desc("score"), F.length("name"), "id").limit(pool)
    return rows.orderBy(F.desc("score"), F.desc(F.lower("name") == prefix), F.desc("releases"), F.length("name"), "id").limit(n)


_POOL = """SELECT id, name, score, releases FROM (SELECT *, row_number() OVER (ORDER BY score DESC, length(name), id) AS rn FROM (SELECT *, CASE WHEN list_contains(regexp_extract_all(lower(name), '[\\p{L}\\p{N}_]+'), 'supplier') THEN 2::BIGINT ELSE 1 END AS score FROM n
    WHERE len(list_filter(regexp_extract_all(lower(name), '[\\p{L}\\p{N}_]+'), lambda x: starts_with(x, 'supplier'))) > 0)) WHERE rn <= 50"""
_SUGGEST = "SELECT id, name, score, releases FROM p ORDER BY score DESC, (lower(name) = 'supplier') DESC, releases DESC, length(name), id LIMIT 10"


@query("f15_suggest_artists", f"WITH n AS (SELECT artist_id AS id, name, coalesce(k, 0) AS releases FROM artists LEFT JOIN (SELECT artist_id, count(*) AS k FROM by_ GROUP BY 1) USING (artist_id)), p AS ({_POOL}) {_SUGGEST}")
def suggest_artists(c: Catalog, prefix: str = "supplier", n: int = 10, pool: int = 50) -> DataFrame:
    counts = c.by.groupBy("artist_id").agg(F.count("*").alias("releases"))
    names = c.artists.join(counts, "artist_id", "left").select(F.col("artist_id").alias("id"), "name", F.coalesce("releases", F.lit(0)).alias("releases"))
    return suggestions(names, prefix, n, pool).select("id", "name", "score", "releases")


@query("f17_suggest_persons", f"WITH n AS (SELECT artist_id AS id, name, k AS releases FROM artists JOIN (SELECT person_id, count(DISTINCT release_id) AS k FROM credits GROUP BY 1) ON person_id = artist_id), p AS ({_POOL.replace('WHERE rn <= 50', '')}) {_SUGGEST}")
def suggest_persons(c: Catalog, prefix: str = "supplier", n: int = 10) -> DataFrame:
    """People are artists with credits."""
    counts = c.credits.groupBy(F.col("person_id").alias("artist_id")).agg(F.count_distinct("release_id").alias("releases"))
    names = c.artists.join(counts, "artist_id").select(F.col("artist_id").alias("id"), "name", "releases")
    return suggestions(names, prefix, n).select("id", "name", "score", "releases")

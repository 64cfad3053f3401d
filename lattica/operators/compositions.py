"""Dispatch by type and category, coverage and storage reports, and small compositions (sections 2.3, 2.6, 2.7, 2.15 and 2.21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scaled, top_n
from ..plans import QUERIES, Catalog, query
from .discover import _HEUR
from .profiles import resolved_media
from .rarity import _SCORED, rarity_scores
from .similarity import _UNHELD, similar_artists, user_recommendations

TYPES = ("artist", "genre", "label", "style")


def dispatch(kind: str, category: str):
    """The registered query (spark, sf_dir) -> DataFrame for a type and a category: explore, details, trends, or what to expand or count.

    ``category`` is "explore", "details", "trends", "expand <what>" or "count <what>"; an unknown pair is an error that lists what there is.
    """
    verb, _, what = category.partition(" ")
    stem = {"explore": f"explore_{kind}", "details": f"{kind}_details", "trends": f"trends_{kind}"}.get(verb, f"{verb}_{kind}_{what}")
    found = [name for name in QUERIES if name.partition("_")[2] == stem]
    if kind not in TYPES or not found:
        there = sorted(name.partition("_")[2] for name in QUERIES if name[0] in "gt" and f"_{kind}" in name)
        raise ValueError(f"no {category!r} for {kind!r}; there is: {', '.join(there)}")
    return QUERIES[found[0]]


@query("r5_signal_coverage", f"{_SCORED} SELECT (SELECT count(*) FROM releases) AS releases, count(*) AS scored, count(*) FILTER (WHERE pressing IS NULL) AS without_family, (SELECT count(*) FROM releases) - count(*) AS missing FROM rated")
def signal_coverage(c: Catalog) -> DataFrame:
    """How many releases the scores cover, and how many no family extends."""
    total = c.releases.agg(F.count("*").alias("releases"))
    rows = rarity_scores(c).agg(F.count("*").alias("scored"), F.count_if(F.col("pressing").isNull()).alias("without_family"))
    return rows.join(F.broadcast(total)).select("releases", "scored", "without_family", (F.col("releases") - F.col("scored")).alias("missing"))


_TABLES = {"artists": "supplier", "labels": "customer", "releases": "orders", "masters": "part", "credits": "lineitem", "events": "events"}


@query("a11_storage", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {t}" for n, t in _TABLES.items()))
def storage(c: Catalog) -> DataFrame:
    """Rows of each stored table; a count reads footers alone."""
    out = None
    for name, table in _TABLES.items():
        one = c.table(table).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def classified(xml: Column, json: Column, field: str) -> Column:
    """Whose fault a violation of ``field`` is: the parser's where source and record differ, the source's where they agree, open where the source lacks it."""
    there, kept = F.xpath_string(xml, F.lit(f"//{field}")), F.get_json_object(json, f"$.{field}")
    return F.when(F.coalesce(there, F.lit("")) == "", "indeterminate").when(there.eqNullSafe(kept), "source_issue").otherwise("parsing_error")


@query("a15_classified_violations", """SELECT event_type, kind, count(*) AS n FROM (SELECT event_type, CASE WHEN value < 2 THEN 'indeterminate' WHEN value >= 20 THEN 'parsing_error' ELSE 'source_issue' END AS kind FROM events) GROUP BY 1, 2""")
def classified_violations(c: Catalog) -> DataFrame:
    """Records against the XML they came from (built from the events: without the field below a value of 2, altered from 20 on)."""
    k = F.get_json_object("props", "$.k")
    seen = F.when(F.col("value") < 2, "").otherwise(F.concat(F.lit("<k>"), k, F.when(F.col("value") >= 20, "0").otherwise(""), F.lit("</k>")))
    rows = c.table("events").withColumn("xml", F.concat(F.lit("<record><inner>"), seen, F.lit("</inner></record>")))
    return rows.groupBy("event_type", classified(F.col("xml"), F.col("props"), "k").alias("kind")).agg(F.count("*").alias("n"))


@query("z2_artist_strategy", f"""WITH {_UNHELD}, rec AS (SELECT user_id, release_id, score FROM (SELECT user_id, release_id, CAST(sum(n) AS BIGINT) AS score, row_number() OVER (PARTITION BY user_id ORDER BY sum(n) DESC, release_id) AS rn FROM ua JOIN by_ b USING (artist_id)
    WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.user_id = ua.user_id AND h.release_id = b.release_id) AND NOT EXISTS (SELECT 1 FROM want w WHERE w.user_id = ua.user_id AND w.release_id = b.release_id) GROUP BY 1, 2) WHERE rn <= 20)
    SELECT user_id, release_id, CAST(floor(score / max(score) OVER (PARTITION BY user_id) * 1e4 + 0.5) AS BIGINT) AS score FROM rec""")
def artist_strategy(c: Catalog) -> DataFrame:
    """Recommendations by artists, as shares of the user's best."""
    share = F.col("score") / F.max("score").over(Window.partitionBy("user_id"))
    return user_recommendations(c).select("user_id", "release_id", scaled(share, 4).alias("score"))


@query("z11_media_filters", """WITH e AS (SELECT release_id, string_agg(DISTINCT medium, '|' ORDER BY medium) AS v FROM media WHERE medium LIKE '%_F' GROUP BY 1), f AS (SELECT release_id, string_agg(DISTINCT family, '|' ORDER BY family) AS v FROM media WHERE family <> 'N' GROUP BY 1),
    r AS (SELECT unnest(string_split(coalesce(e.v, f.v, r.priority), '|')) AS id FROM releases r LEFT JOIN e USING (release_id) LEFT JOIN f USING (release_id))
    SELECT id, CASE WHEN id IN (SELECT medium FROM media) THEN 'medium' WHEN id IN (SELECT family FROM media) THEN 'family' ELSE 'legacy' END AS kind, count(*) AS n FROM r GROUP BY 1, 2""")
def media_filters(c: Catalog) -> DataFrame:
    """The ids that releases resolve to, split into mediums, families and legacy names by the taxonomy."""
    known = c.media.select(F.explode(F.array(F.struct(F.col("medium").alias("id"), F.lit("medium").alias("kind")), F.struct(F.col("family").alias("id"), F.lit("family").alias("kind")))).alias("x")).select("x.*").distinct()
    ids = resolved_media(c).select(F.explode(F.split("media", r"\|")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ids.join(known, "id", "left").select("id", F.coalesce("kind", F.lit("legacy")).alias("kind"), "n")


@query("z12_strata_labels", "SELECT m.master_id, min(nullif(r.year, 0)) AS first_year, min_by(l.name, (nullif(r.year, 0), r.release_id)) FILTER (WHERE r.year > 0) AS label FROM masters m JOIN releases r USING (release_id) JOIN label_nodes l USING (label_id) GROUP BY 1")
def strata_labels(c: Catalog) -> DataFrame:
    """Each master's earliest year and the label of that release; names are joined to what is left, not to all releases."""
    dated = c.masters.join(c.releases.where("year > 0"), "release_id").groupBy("master_id").agg(F.min(F.struct("year", "release_id", "label_id")).alias("x"))
    named = dated.select("master_id", F.col("x.year").alias("first_year"), F.col("x.label_id").alias("label_id")).join(c.labels.select("label_id", F.col("name").alias("label")), "label_id").drop("label_id")
    return c.masters.select("master_id").distinct().join(named, "master_id", "left")


@query("z28_collection_ids", "SELECT u.user_id, count(DISTINCT c.release_id) AS held, CAST(coalesce(sum(DISTINCT c.release_id), 0) AS BIGINT) AS id_sum FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN collected c USING (user_id) GROUP BY 1")
def collection_ids(c: Catalog) -> DataFrame:
    """What each user holds; a user without a collection has an empty one."""
    held = c.collected.select("user_id", "release_id").distinct().groupBy("user_id").agg(F.count("release_id").alias("held"), F.sum("release_id").alias("id_sum"))
    return c.events.select("user_id").distinct().join(held, "user_id", "left").fillna(0, ["held", "id_sum"])


@query("v6_similar_artist_metrics", f"""{_HEUR.replace(" AND a % 100 = 0", "")}, pg AS (SELECT artist_id, style FROM (SELECT artist_id, style, row_number() OVER (PARTITION BY artist_id ORDER BY count(*) DESC, style) AS rn FROM by_ JOIN styles USING (release_id) GROUP BY 1, 2) WHERE rn = 1)
    SELECT h.id AS artist_id, count(*) AS listed, count(*) FILTER (WHERE x.style = y.style) AS same_style, CAST(floor(count(*) FILTER (WHERE x.style = y.style) / count(*) * 1e6 + 0.5) AS BIGINT) AS precision_ppm FROM hr h LEFT JOIN pg x ON x.artist_id = h.id LEFT JOIN pg y ON y.artist_id = h.other_id GROUP BY 1""")
def similar_artist_metrics(c: Catalog) -> DataFrame:
    """How many of each artist's similar artists share its first style."""
    counts = c.by.join(c.styles, "release_id").groupBy("artist_id", "style").agg(F.count("*").alias("n"))
    first = top_n(counts, ["artist_id"], [F.desc("n"), "style"], 1)
    own, theirs = (first.select(F.col("artist_id").alias(k), F.col("style").alias(f"style_{k}")) for k in "ab")
    rows = similar_artists(c).join(own, "a", "left").join(theirs, "b", "left").groupBy(F.col("a").alias("artist_id"))
    return rows.agg(F.count("*").alias("listed"), F.count_if(F.col("style_a") == F.col("style_b")).alias("same_style")).withColumn("precision_ppm", scaled(F.col("same_style") / F.col("listed")))

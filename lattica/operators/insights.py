"""Catalog-wide insights, gaps and data quality (sections 2.5 and 2.6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, scaled, top_n
from ..plans import Catalog, query
from .explore import LONGEVITY, expand, label_longevity
from .similarity import first_releases, in_common

PLACEHOLDER = r"^(?is)(not on label.*|.*000000[0-9])$"


@query("a1_artist_centrality", """SELECT artist_id, degree FROM (SELECT artist_id, count(*) AS degree FROM (SELECT artist_id FROM by_raw UNION ALL SELECT artist_id FROM aliases UNION ALL SELECT other_id FROM aliases
    UNION ALL SELECT artist_id FROM groups_ UNION ALL SELECT other_id FROM groups_) GROUP BY 1 ORDER BY degree DESC, artist_id LIMIT 50)""")
def artist_centrality(c: Catalog, limit: int = 50) -> DataFrame:
    ends = [c.by_raw.select("artist_id")]
    for edges in (c.aliases, c.groups):
        ends += [edges.select("artist_id"), edges.select(F.col("other_id").alias("artist_id"))]
    degree = reduce(DataFrame.unionByName, ends).groupBy("artist_id").agg(F.count("*").alias("degree"))
    return degree.orderBy(F.desc("degree"), "artist_id").limit(limit)


@query("a2_label_longevity", f"""{LONGEVITY} SELECT label_id, name, active_years, dated, peak_decade, rank() OVER (ORDER BY active_years DESC, dated DESC, label_id) AS place
    FROM longevity JOIN label_nodes USING (label_id) WHERE NOT regexp_matches(name, '^(?is)(not on label.*|.*000000[0-9])$') ORDER BY place LIMIT 50""")
def longevity_ranking(c: Catalog, limit: int = 50) -> DataFrame:
    """Placeholder labels take no place (rule a3): a full, case-insensitive match of the name."""
    real = c.labels.where(~F.rlike("name", F.lit(PLACEHOLDER))).select("label_id", "name")
    best = label_longevity(c).join(real, "label_id").orderBy(F.desc("active_years"), F.desc("dated"), "label_id").limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("active_years"), F.desc("dated"), "label_id")).cast("long")
    return best.select("label_id", "name", "active_years", "dated", "peak_decade", place.alias("place"))


@query("a3_placeholder_labels", "SELECT label_id, name FROM label_nodes WHERE regexp_matches(name, '^(?is)(not on label.*|.*000000[0-9])$')")
def placeholder_labels(c: Catalog) -> DataFrame:
    return c.labels.where(F.rlike("name", F.lit(PLACEHOLDER))).select("label_id", "name")


@query("a4_style_landmarks", """SELECT style, master_id, releases FROM (SELECT style, master_id, count(DISTINCT s.release_id) AS releases, row_number() OVER (PARTITION BY style ORDER BY count(DISTINCT s.release_id) DESC, CAST(master_id AS VARCHAR)) AS rn
    FROM styles s JOIN masters m ON s.release_id = m.release_id GROUP BY 1, 2) WHERE rn <= 25""")
def style_landmarks(c: Catalog, n: int = 25) -> DataFrame:
    """The masters with most releases of each style; ties by master id as text."""
    counts = c.styles.join(c.masters, "release_id").groupBy("style", "master_id").agg(F.count("*").alias("releases"))
    return top_n(counts, ["style"], [F.desc("releases"), F.col("master_id").cast("string")], n)


@query("a5_style_cotags", """SELECT style, other, n FROM (SELECT a.style, b.style AS other, count(*) AS n, row_number() OVER (PARTITION BY a.style ORDER BY count(*) DESC, b.style) AS rn FROM styles a JOIN styles b ON a.release_id = b.release_id AND a.style <> b.style GROUP BY 1, 2) WHERE rn <= 25""")
def style_cotags(c: Catalog, n: int = 25) -> DataFrame:
    pairs = c.styles.join(c.styles.withColumnRenamed("style", "other"), "release_id").where("style != other").groupBy("style", "other").agg(F.count("*").alias("n"))
    return top_n(pairs, ["style"], [F.desc("n"), "other"], n)


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """Total and non-empty counts of each field from one scan, and their mean share (hundredths of a percent)."""
    filled = {f: F.count_if(F.col(f).isNotNull() & ~F.col(f).cast("string").isin("", "[]")) for f in fields}
    out = df.agg(F.count("*").alias("total"), *(x.alias(f"n_{f}") for f, x in filled.items()))
    mean = reduce(lambda a, b: a + b, (F.col(f"n_{f}") for f in fields)) / (F.col("total") * len(fields))
    return out.withColumn("mean_pct", F.when(F.col("total") > 0, scaled(mean, 4)))


@query("a6_data_completeness", """SELECT count(*) AS total, count(*) FILTER (WHERE url IS NOT NULL AND url NOT IN ('', '[]')) AS n_url, count(*) FILTER (WHERE html IS NOT NULL AND html NOT IN ('', '[]')) AS n_html, count(*) FILTER (WHERE title IS NOT NULL AND title <> '') AS n_title,
    CAST(floor((count(*) FILTER (WHERE url IS NOT NULL AND url <> '') + count(*) FILTER (WHERE html IS NOT NULL AND html <> '') + count(*) FILTER (WHERE title IS NOT NULL AND title <> '')) / (count(*) * 3) * 10000 + 0.5) AS BIGINT) AS mean_pct FROM (SELECT url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)""")
def data_completeness(c: Catalog) -> DataFrame:
    pages = c.table("pages").select("url", "html", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return completeness(pages, ["url", "html", "title"])


@query("a7_unmapped_media", """SELECT medium, n, CAST(floor(n / t * 1e6 + 0.5) AS BIGINT) AS share_ppm FROM (SELECT medium, count(DISTINCT release_id) AS n FROM media WHERE family NOT IN ('A', 'R') GROUP BY 1), (SELECT count(DISTINCT release_id) AS t FROM media)""")
def unmapped_media(c: Catalog, mapped: tuple[str, ...] = ("A", "R")) -> DataFrame:
    """Names outside the mapped families by tagged releases, and their share of all tagged releases."""
    total = c.media.agg(F.count_distinct("release_id").alias("t"))
    n = c.media.where(~F.col("family").isin(*mapped)).groupBy("medium").agg(F.count_distinct("release_id").alias("n"))
    return n.join(F.broadcast(total)).select("medium", "n", scaled(F.col("n") / F.col("t")).alias("share_ppm"))


@query("a8_collection_media", """SELECT user_id, 'family' AS kind, family AS name, count(DISTINCT c.release_id) AS n FROM collected c JOIN media m ON c.release_id = m.release_id GROUP BY 1, 3
    UNION ALL SELECT user_id, 'medium', medium, count(DISTINCT c.release_id) FROM collected c JOIN media m ON c.release_id = m.release_id GROUP BY 1, 3""")
def collection_media(c: Catalog) -> DataFrame:
    held = c.collected.select("user_id", "release_id").distinct().join(c.media, "release_id")
    one = lambda col: held.groupBy("user_id", F.col(col).alias("name")).agg(F.count_distinct("release_id").alias("n")).withColumn("kind", F.lit(col))
    return one("family").unionByName(one("medium")).select("user_id", "kind", "name", "n")


@query("a9_enrichment_status", "SELECT event_type, count(*) AS total, count(k) AS with_key, count(*) FILTER (WHERE value > 50) AS enriched FROM ev GROUP BY 1")
def enrichment_status(c: Catalog) -> DataFrame:
    return c.events.groupBy("event_type").agg(F.count("*").alias("total"), F.count("k").alias("with_key"), F.count_if(F.col("value") > 50).alias("enriched"))


@query("a10_audit_page", "SELECT event_id, user_id, event_type FROM ev WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_page(c: Catalog) -> DataFrame:
    return c.events.where((F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")) & (F.col("event_type") == "error")).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "event_type")


@query("a12_collection_formats", "SELECT DISTINCT user_id, medium FROM collected c JOIN media m ON c.release_id = m.release_id WHERE medium <> ''")
def collection_formats(c: Catalog) -> DataFrame:
    return c.collected.select("user_id", "release_id").join(c.media, "release_id").where("medium != ''").select("user_id", "medium").distinct()


@query("a13_violation_summary", """SELECT event_type, k % 10 AS rule, count(*) AS n, count(*) FILTER (WHERE value >= 100) AS errors, count(*) FILTER (WHERE value < 100) AS warnings FROM ev GROUP BY GROUPING SETS ((event_type, k % 10), (event_type), ())""")
def violation_summary(c: Catalog) -> DataFrame:
    """Counts by (entity, rule), by entity and overall from one scan."""
    rows = c.events.withColumn("rule", F.col("k") % 10)
    return rows.groupingSets([["event_type", "rule"], ["event_type"], []], "event_type", "rule").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 100).alias("errors"), F.count_if(F.col("value") < 100).alias("warnings"))


@query("a16_count_changes", """WITH a AS (SELECT k, count(*) AS n FROM ev WHERE ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1), b AS (SELECT k, count(*) AS n FROM ev WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, CASE WHEN coalesce(b.n, 0) > coalesce(a.n, 0) THEN 'worsened' WHEN coalesce(b.n, 0) < coalesce(a.n, 0) THEN 'improved' ELSE 'same' END AS direction FROM a FULL OUTER JOIN b ON a.k = b.k""")
def count_changes(c: Catalog) -> DataFrame:
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    a = c.events.where(F.col("ts") < cut).groupBy("k").agg(F.count("*").alias("before"))
    b = c.events.where(F.col("ts") >= cut).groupBy("k").agg(F.count("*").alias("after"))
    out = a.join(b, "k", "full_outer").fillna(0, ["before", "after"])
    return out.withColumn("direction", F.when(F.col("after") > F.col("before"), "worsened").when(F.col("after") < F.col("before"), "improved").otherwise("same"))


@query("a14_violation_page", "SELECT event_id, k, value FROM ev WHERE event_type = 'error' AND k % 10 = 3 ORDER BY event_id LIMIT 50")
def violation_page(c: Catalog) -> DataFrame:
    return c.events.where((F.col("event_type") == "error") & (F.col("k") % 10 == 3)).orderBy("event_id").limit(50).select("event_id", "k", "value")


@query("a17_prompt_contexts", """SELECT rule, total, string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY event_id) AS examples FROM (SELECT k % 10 AS rule, event_id, count(*) OVER (PARTITION BY k % 10) AS total, row_number() OVER (PARTITION BY k % 10 ORDER BY event_id) AS rn FROM ev WHERE event_type = 'error') WHERE rn <= 5 GROUP BY 1, 2""")
def prompt_contexts(c: Catalog) -> DataFrame:
    """Total and the first five records of each rule."""
    rows = c.events.where("event_type = 'error'").select((F.col("k") % 10).alias("rule"), "event_id")
    totals = rows.groupBy("rule").agg(F.count("*").alias("total"))
    first = top_n(rows, ["rule"], ["event_id"], 5).groupBy("rule").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), "|").alias("examples"))
    return totals.join(first, "rule")


# gaps and join shapes


def gaps(c: Catalog, edges: DataFrame, parent: str, n: int = 20) -> DataFrame:
    """Releases of each user's parents that the user neither holds nor wants; a page for each (user, parent).

    A page lies within the parent's first n + h releases, where h counts those that the user holds or wants.
    """
    keys = ["user_id", "release_id"]
    known = c.collected.select(*keys).union(c.wanted.select(*keys)).distinct()
    mine = c.collected.select(*keys).distinct().join(edges, "release_id").select("user_id", parent).distinct()
    missing = first_releases(edges, parent, mine, known, n).join(known, keys, "left_anti")
    return top_n(missing.select("user_id", parent, "release_id"), ["user_id", parent], ["release_id"], n)


def _register_gaps(parent: str, attribute: str, view: str, col: str) -> None:
    mine = f"WITH held AS (SELECT DISTINCT user_id, release_id FROM collected), mine AS (SELECT DISTINCT user_id, {col} FROM held JOIN {view} USING (release_id))"

    @query(f"j3_{parent}_gaps", f"""{mine} SELECT user_id, {col}, release_id FROM (SELECT m.user_id, m.{col}, e.release_id, row_number() OVER (PARTITION BY m.user_id, m.{col} ORDER BY e.release_id) AS rn FROM mine m JOIN {view} e ON m.{col} = e.{col}
        WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.user_id = m.user_id AND h.release_id = e.release_id) AND NOT EXISTS (SELECT 1 FROM wanted w WHERE w.user_id = m.user_id AND w.release_id = e.release_id)) WHERE rn <= 20""")
    def _(c: Catalog) -> DataFrame:
        return gaps(c, getattr(c, attribute), col)

    @query(f"j4_{parent}_gap_summary", f"""{mine} SELECT m.user_id, m.{col}, count(*) AS total, count(h.release_id) AS owned, count(*) - count(h.release_id) AS missing FROM mine m JOIN {view} e ON m.{col} = e.{col} LEFT JOIN held h ON h.user_id = m.user_id AND h.release_id = e.release_id GROUP BY 1, 2""")
    def _(c: Catalog) -> DataFrame:
        edges, held = getattr(c, attribute), c.collected.select("user_id", "release_id").distinct()
        totals = edges.groupBy(col).agg(F.count("*").alias("total"))
        owned = held.join(edges, "release_id").groupBy("user_id", col).agg(F.count("*").alias("owned"))
        return owned.join(totals, col).select("user_id", col, "total", "owned", (F.col("total") - F.col("owned")).alias("missing"))


_register_gaps("label", "on", "on_", "label_id")
_register_gaps("master", "masters", "masters", "master_id")


@query("j2_count_collaborators", "SELECT a.artist_id, count(DISTINCT b.artist_id) AS n FROM by_ a JOIN by_ b ON a.release_id = b.release_id AND a.artist_id <> b.artist_id GROUP BY 1")
def count_collaborators(c: Catalog) -> DataFrame:
    return c.by.join(c.by.withColumnRenamed("artist_id", "other_id"), "release_id").where("artist_id != other_id").groupBy("artist_id").agg(F.count_distinct("other_id").alias("n"))


@query("j1_cotag_self_join", "SELECT a.genre, b.style, count(*) AS n FROM genres a JOIN styles b USING (release_id) GROUP BY 1, 2")
def cotag_self_join(c: Catalog) -> DataFrame:
    return expand(c.genres, c.styles, "genre", "style", edges=True).withColumnRenamed("release_count", "n")


@query("j6_label_membership", """WITH r AS (SELECT release_id, list_sort(list(DISTINCT artist_id)) AS artist_ids FROM by_ GROUP BY 1) SELECT release_id, len(artist_ids) AS artists FROM r WHERE list_contains(artist_ids, 7)""")
def label_membership(c: Catalog, artist_id: int = 7) -> DataFrame:
    """Membership by an array column instead of an id list."""
    # The filter reaches the scan; only its releases are gathered.
    asked = c.by.where(F.col("artist_id") == artist_id).select("release_id")
    rows = c.by.join(asked, "release_id", "left_semi").groupBy("release_id").agg(F.collect_set("artist_id").alias("artist_ids"))
    return rows.select("release_id", F.size("artist_ids").cast("long").alias("artists"))


@query("j9_ambiguous_aliases", "SELECT k, string_agg(CAST(user_id AS VARCHAR), '|' ORDER BY user_id) AS candidates FROM (SELECT k, user_id, row_number() OVER (PARTITION BY k ORDER BY user_id) AS rn FROM (SELECT DISTINCT k, user_id FROM ev WHERE event_type = 'signup')) WHERE rn <= 2 GROUP BY 1")
def ambiguous_aliases(c: Catalog) -> DataFrame:
    """At most two distinct candidates of each key: enough to prove ambiguity."""
    pairs = c.events.where("event_type = 'signup'").select("k", "user_id").distinct()
    return top_n(pairs, ["k"], ["user_id"], 2).groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list("user_id")), lambda x: x.cast("string")), "|").alias("candidates"))


@query("j12_shared_credits", """SELECT a.person_id AS a, b.person_id AS b, count(DISTINCT a.release_id) AS releases FROM credits a JOIN credits b ON a.release_id = b.release_id AND a.category = b.category AND a.person_id < b.person_id GROUP BY 1, 2""")
def shared_credits(c: Catalog) -> DataFrame:
    one = c.credits.select("release_id", "category", "person_id").distinct()
    pairs = one.withColumnRenamed("person_id", "a").join(one.withColumnRenamed("person_id", "b"), ["release_id", "category"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count_distinct("release_id").alias("releases"))


def shared_personnel(c: Catalog, asked: str | None = None, least: int = 3, block: int = 1000, rows_each: int = 1_000_000) -> DataFrame:
    """Masters a < b that share at least ``least`` (person, category) pairs; ``asked`` is a condition on the ``master_id`` of a.

    Masters are dealt into blocks of about ``rows_each`` rows; long lists of a (person, category) are cut into pieces of ``block`` masters.
    """
    key = ["person_id", "category"]
    blocks = max(1, -(-c.lines.count() // rows_each))
    rows = c.credits.join(c.masters, "release_id").select(F.col("master_id").alias("id"), *key).repartition(*key).distinct()
    found = in_common(rows, key, c.masters.select(F.col("master_id").alias("id")), blocks, least, asked and asked.replace("master_id", "id"), block=block)
    return found.withColumnRenamed("n", "shared")


@query("j7_shared_personnel", """WITH r AS (SELECT DISTINCT master_id, person_id, category FROM credits JOIN masters USING (release_id))
    SELECT a.master_id AS a, b.master_id AS b, count(*) AS shared FROM r a JOIN r b ON a.person_id = b.person_id AND a.category = b.category AND a.master_id < b.master_id GROUP BY 1, 2 HAVING count(*) >= 3""")
def all_shared_personnel(c: Catalog) -> DataFrame:
    return shared_personnel(c)


@query("o2_distinct_union", "SELECT user_id, release_id FROM collected UNION SELECT user_id, release_id FROM wanted")
def distinct_union(c: Catalog) -> DataFrame:
    return c.collected.select("user_id", "release_id").unionByName(c.wanted.select("user_id", "release_id")).distinct()


@query("o4_difference", "SELECT DISTINCT user_id, release_id FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM collected c WHERE c.user_id = w.user_id AND c.release_id = w.release_id)")
def difference(c: Catalog) -> DataFrame:
    return c.wanted.select("user_id", "release_id").distinct().join(c.collected.select("user_id", "release_id"), ["user_id", "release_id"], "left_anti")


@query("o5_intersection", "SELECT user_id, release_id FROM wanted INTERSECT SELECT user_id, release_id FROM collected")
def intersection(c: Catalog) -> DataFrame:
    return c.wanted.select("user_id", "release_id").intersect(c.collected.select("user_id", "release_id"))


@query("l16_label_names", "SELECT nation, string_agg(CAST(artist_id AS VARCHAR), '|' ORDER BY CAST(artist_id AS VARCHAR)) AS ids, count(*) > 1 AS ambiguous FROM artists GROUP BY 1")
def resolve_names(c: Catalog) -> DataFrame:
    """A name with more than one id is ambiguous; its candidates are listed."""
    return c.artists.groupBy("nation").agg(names("artist_id").alias("ids"), (F.count("*") > 1).alias("ambiguous"))

"""Lookups, normalised keys, ownership, marks and small compositions (sections 2.2, 2.5, 2.13, 2.14 and 2.21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scaled
from ..plans import Catalog, query
from .similarity import top_held


@query("l3_two_catalogs", "SELECT 'artist' AS source, CAST(artist_id AS VARCHAR) AS id, name FROM artists UNION ALL SELECT 'label', CAST(label_id AS VARCHAR), name FROM label_nodes")
def two_catalogs(c: Catalog) -> DataFrame:
    one = lambda df, kind, key: df.select(F.lit(kind).alias("source"), F.col(key).cast("string").alias("id"), "name")
    return one(c.artists, "artist", "artist_id").unionByName(one(c.labels, "label", "label_id"))


def text_year(text: Column) -> Column:
    """The leading four digits as a positive number, else null."""
    year = F.regexp_extract(F.trim(text), r"^([0-9]{4})", 1)
    return F.when(year != "", F.nullif(year.cast("long"), F.lit(0).cast("long")))


@query("l4_text_years", "SELECT o_orderkey, year(o_orderdate) AS year FROM orders")
def text_years(c: Catalog) -> DataFrame:
    return c.table("orders").select("o_orderkey", text_year(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("year"))


def barcode_forms(digits: Column) -> Column:
    """The equivalent 12-, 13- and 14-digit forms of a barcode, without spaces and dashes."""
    bare = F.regexp_replace(F.regexp_replace(digits, "[^0-9]", ""), "^0+", "")
    return F.array_distinct(F.array(*(F.lpad(bare, n, "0") for n in (12, 13, 14))))


@query("l5_barcode_forms", "SELECT p_partkey, lpad(CAST(p_partkey * 1000 + 7 AS VARCHAR), n, '0') AS form FROM part, (VALUES (12), (13), (14)) t(n)")
def part_barcodes(c: Catalog) -> DataFrame:
    code = (F.col("p_partkey") * 1000 + 7).cast("string")
    return c.table("part").select("p_partkey", F.explode(barcode_forms(code)).alias("form"))


@query("l6_batch_triples", "SELECT o.o_orderkey, e.user_id FROM orders o LEFT JOIN (SELECT k, max(user_id) AS user_id FROM ev WHERE event_type = 'signup' GROUP BY 1) e ON o.o_orderkey = e.k")
def batch_triples(c: Catalog) -> DataFrame:
    held = c.events.where("event_type = 'signup'").groupBy("k").agg(F.max("user_id").alias("user_id"))
    return c.table("orders").select("o_orderkey").join(held, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", "user_id")


@query("j10_ownership", """SELECT u.user_id, m.master_id, CASE WHEN count(*) FILTER (WHERE u.event_type = 'purchase') > 0 THEN 'owned' WHEN count(*) FILTER (WHERE u.event_type = 'error') > 0 THEN 'unknown' ELSE 'missing' END AS state FROM ev u JOIN masters m ON u.k = m.release_id GROUP BY 1, 2""")
def ownership(c: Catalog) -> DataFrame:
    """Three-valued: owned, unknown where the source failed, missing."""
    rows = c.events.join(c.masters, F.col("k") == F.col("release_id")).groupBy("user_id", "master_id")
    has = lambda kind: F.bool_or(F.col("event_type") == kind)
    return rows.agg(F.when(has("purchase"), "owned").when(has("error"), "unknown").otherwise("missing").alias("state"))


@query("j13_fused_scores", """WITH a AS (SELECT user_id, release_id, count(*) AS s FROM collected GROUP BY 1, 2), b AS (SELECT user_id, release_id, count(*) AS s FROM wanted GROUP BY 1, 2) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.release_id, b.release_id) AS release_id, 3 * coalesce(a.s, 0) + coalesce(b.s, 0) AS fused FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.release_id = b.release_id""")
def fused_scores(c: Catalog) -> DataFrame:
    """A full outer join of two score lists, absent scores as 0."""
    keys = ["user_id", "release_id"]
    a = c.collected.groupBy(*keys).agg(F.count("*").alias("sa"))
    b = c.wanted.groupBy(*keys).agg(F.count("*").alias("sb"))
    return a.join(b, keys, "full_outer").select(*keys, (3 * F.coalesce("sa", F.lit(0)) + F.coalesce("sb", F.lit(0))).alias("fused"))


@query("x2_stored_or_duplicate", "SELECT event_id, row_number() OVER (PARTITION BY user_id, k, event_type ORDER BY ts, event_id) = 1 AS stored FROM ev")
def stored_or_duplicate(c: Catalog) -> DataFrame:
    """For each row of a batch whether its (subject, key) is new."""
    order = Window.partitionBy("user_id", "k", "event_type").orderBy("ts", "event_id")
    return c.events.select("event_id", (F.row_number().over(order) == 1).alias("stored"))


@query("x6_active_purposes", "SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS purposes FROM ev WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def active_purposes(c: Catalog) -> DataFrame:
    rows = c.events.where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"))
    return rows.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), "|").alias("purposes"))


@query("b2_marks", """SELECT user_id, release_id, bool_or(o) AS owned, bool_or(NOT o) AS wanted, strftime(min(date_added), '%Y-%m-%d') AS first_at FROM (SELECT user_id, release_id, date_added, true AS o FROM collected UNION ALL SELECT user_id, release_id, date_added, false FROM wanted) GROUP BY 1, 2""")
def marks(c: Catalog) -> DataFrame:
    one = lambda df, o: df.select("user_id", "release_id", "date_added", F.lit(o).alias("o"))
    rows = one(c.collected, True).unionByName(one(c.wanted, False)).groupBy("user_id", "release_id")
    return rows.agg(F.bool_or("o").alias("owned"), F.bool_or(~F.col("o")).alias("wanted"), F.date_format(F.min("date_added"), "yyyy-MM-dd").alias("first_at"))


@query("b3_master_credits", "SELECT m.master_id, min(r.year) AS year, count(*) AS releases, count(*) FILTER (WHERE r.year > 0) AS dated FROM masters m JOIN releases r USING (release_id) GROUP BY 1")
def master_credits(c: Catalog) -> DataFrame:
    rows = c.masters.join(c.releases.select("release_id", "year"), "release_id").groupBy("master_id")
    return rows.agg(F.min("year").alias("year"), F.count("*").alias("releases"), F.count_if(F.col("year") > 0).alias("dated"))


@query("b14_field_contrast", """WITH f AS (SELECT p_brand, 'type' AS field, p_type AS v FROM part UNION ALL SELECT p_brand, 'size', CAST(p_size AS VARCHAR) FROM part), d AS (SELECT p_brand, field, count(*) AS n, count(DISTINCT v) AS kinds FROM f GROUP BY 1, 2),
    s AS (SELECT p_brand, field, CAST(sum(c * (c - 1)) AS BIGINT) AS same FROM (SELECT p_brand, field, v, count(*) AS c FROM f GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT p_brand, field, kinds, n * (n - 1) - same AS differing FROM d JOIN s USING (p_brand, field)""")
def field_contrast(c: Catalog) -> DataFrame:
    """Ordered candidate pairs of a group that differ in a field: from value counts, n(n-1) less the equal pairs, no pair is made."""
    fields = F.array(F.struct(F.lit("type").alias("field"), F.col("p_type").alias("v")), F.struct(F.lit("size").alias("field"), F.col("p_size").cast("string").alias("v")))
    values = c.table("part").select("p_brand", F.explode(fields).alias("x")).groupBy("p_brand", "x.field", "x.v").agg(F.count("*").alias("n"))
    out = values.groupBy("p_brand", "field").agg(F.count("*").alias("kinds"), F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    return out.select("p_brand", "field", "kinds", (F.col("all") * (F.col("all") - 1) - F.col("same")).alias("differing"))


@query("z1_taste_fingerprints", """WITH h AS (SELECT DISTINCT user_id, release_id FROM collected), g AS (SELECT user_id, genre, count(*) AS n FROM h JOIN genres USING (release_id) GROUP BY 1, 2),
    t AS (SELECT user_id, genre FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) AS rn FROM g) WHERE rn = 1), s AS (SELECT user_id, count(*) AS items FROM h GROUP BY 1)
    SELECT s.user_id, items, items >= 10 AS enough, t.genre AS top_genre FROM s LEFT JOIN t ON s.user_id = t.user_id""")
def taste_fingerprints(c: Catalog, least: int = 10) -> DataFrame:
    items = c.collected.select("user_id", "release_id").distinct().groupBy("user_id").agg(F.count("*").alias("items"))
    best = top_held(c, c.genres, "genre", 1).select("user_id", F.col("genre").alias("top_genre"))
    return items.withColumn("enough", F.col("items") >= least).join(best, "user_id", "left")


@query("extra_priority_years", "SELECT priority, count(*) AS n, CAST(floor(avg(year) * 100 + 0.5) AS BIGINT) AS mean_year FROM releases GROUP BY 1")
def priority_histogram(c: Catalog) -> DataFrame:
    return c.releases.groupBy("priority").agg(F.count("*").alias("n"), scaled(F.avg("year"), 2).alias("mean_year"))


@query("v12_jaccard_policy", """WITH h AS (SELECT user_id, list(DISTINCT style) AS s FROM collected c JOIN styles t ON c.release_id = t.release_id GROUP BY 1), w AS (SELECT DISTINCT user_id, release_id FROM wanted), r AS (SELECT release_id, list(DISTINCT style) AS s FROM styles GROUP BY 1)
    SELECT w.user_id, w.release_id, CAST(floor(len(list_intersect(h.s, r.s)) / len(list_distinct(list_concat(h.s, r.s))) * 1e6 + 0.5) AS BIGINT) AS jaccard_ppm FROM w JOIN h ON w.user_id = h.user_id JOIN r ON w.release_id = r.release_id""")
def jaccard_policy(c: Catalog) -> DataFrame:
    """Likeness of a wanted release's styles to all styles that the user holds."""
    held = c.collected.select("user_id", "release_id").join(c.styles, "release_id").groupBy("user_id").agg(F.collect_set("style").alias("h"))
    of = c.styles.groupBy("release_id").agg(F.collect_set("style").alias("r"))
    rows = c.wanted.select("user_id", "release_id").distinct().join(held, "user_id").join(of, "release_id")
    return rows.select("user_id", "release_id", scaled(F.size(F.array_intersect("h", "r")) / F.size(F.array_union("h", "r"))).alias("jaccard_ppm"))


def titles(c: Catalog) -> DataFrame:
    """(release_id, title): a release is named after its master."""
    return c.masters.join(c.table("part").select(F.col("p_partkey").alias("master_id"), F.col("p_name").alias("title")), "master_id").select("release_id", "title")

"""Time series (section 2.4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decade, scaled, top_n
from ..plans import Catalog, query
from .explore import EDGES, expand


def per_year(edges: DataFrame, releases: DataFrame, parent: str, distinct: bool = True) -> DataFrame:
    """(parent, year, n) over dated releases."""
    dated = edges.join(releases.where("year > 0").select("release_id", "year"), "release_id")
    return dated.groupBy(parent, "year").agg((F.count_distinct("release_id") if distinct else F.count("*")).alias("n"))


def _register(key: str, parent: str, attribute: str, view: str, distinct: bool) -> None:
    col = EDGES[parent][2]
    count = "count(DISTINCT e.release_id)" if distinct else "count(*)"

    @query(f"{key}_trends_{parent}", f"SELECT e.{col}, r.year, {count} AS n FROM {view} e JOIN releases r ON e.release_id = r.release_id WHERE r.year > 0 GROUP BY 1, 2")
    def _(c: Catalog) -> DataFrame:
        return per_year(getattr(c, attribute), c.releases, col, distinct)


_register("t1", "artist", "by_raw", "by_raw", True)
_register("t2", "genre", "genres", "genres", False)
_register("t3", "label", "on", "on_", True)
_register("t4", "style", "styles", "styles", False)


@query("t5_genre_decades", "SELECT genre, year - year % 10 AS decade, count(DISTINCT release_id) AS n FROM genres JOIN releases USING (release_id) WHERE year > 0 GROUP BY 1, 2")
def genre_decades(c: Catalog) -> DataFrame:
    return c.genres.join(c.releases.where("year > 0"), "release_id").groupBy("genre", decade(F.col("year")).alias("decade")).agg(F.count_distinct("release_id").alias("n"))


@query("t6_style_years", "SELECT style, year, count(DISTINCT s.release_id) AS releases, count(DISTINCT m.master_id) AS masters FROM styles s JOIN releases r ON s.release_id = r.release_id LEFT JOIN masters m ON s.release_id = m.release_id WHERE year > 0 GROUP BY 1, 2")
def style_years(c: Catalog) -> DataFrame:
    df = c.styles.join(c.releases.where("year > 0").select("release_id", "year"), "release_id").join(c.masters, "release_id", "left")
    return df.groupBy("style", "year").agg(F.count_distinct("release_id").alias("releases"), F.count_distinct("master_id").alias("masters"))


@query("t6_style_genre_share", """SELECT style, genre, n, CAST(floor(n / t * 1e6 + 0.5) AS BIGINT) AS share_ppm FROM
    (SELECT style, genre, count(DISTINCT release_id) AS n FROM styles JOIN genres USING (release_id) GROUP BY 1, 2) JOIN (SELECT style, count(DISTINCT release_id) AS t FROM styles GROUP BY 1) USING (style)""")
def style_genre_share(c: Catalog) -> DataFrame:
    pairs = expand(c.styles, c.genres, "style", "genre").withColumnRenamed("release_count", "n")
    totals = c.styles.groupBy("style").agg(F.count("*").alias("t"))
    return pairs.join(totals, "style").select("style", "genre", "n", scaled(F.col("n") / F.col("t")).alias("share_ppm"))


@query("t7_collection_timeline", """WITH held AS (SELECT DISTINCT user_id, c.release_id, r.year FROM collected c JOIN releases r ON c.release_id = r.release_id WHERE r.year > 0),
    g AS (SELECT user_id, year, genre, count(DISTINCT h.release_id) AS n FROM held h JOIN genres g ON h.release_id = g.release_id GROUP BY 1, 2, 3),
    t AS (SELECT user_id, year, sum(n) AS t FROM g GROUP BY 1, 2)
    SELECT h.user_id, h.year, h.releases, coalesce(d.genre, '') AS top_genre FROM (SELECT user_id, year, count(*) AS releases FROM held GROUP BY 1, 2) h
    LEFT JOIN (SELECT user_id, year, genre FROM (SELECT *, row_number() OVER (PARTITION BY user_id, year ORDER BY n DESC, genre) AS rn FROM g) WHERE rn = 1) d ON h.user_id = d.user_id AND h.year = d.year""")
def collection_timeline(c: Catalog) -> DataFrame:
    held = c.collected.select("user_id", "release_id").distinct().join(c.releases.where("year > 0").select("release_id", "year"), "release_id")
    counts = held.groupBy("user_id", "year").agg(F.count("*").alias("releases"))
    genres = held.join(c.genres, "release_id").groupBy("user_id", "year", "genre").agg(F.count("*").alias("n"))
    best = top_n(genres, ["user_id", "year"], [F.desc("n"), "genre"], 1).select("user_id", "year", F.col("genre").alias("top_genre"))
    return counts.join(best, ["user_id", "year"], "left").fillna("", ["top_genre"])


def entropy(df: DataFrame, group: list[str], count: str) -> DataFrame:
    """Shannon entropy of each group's counts over log2 of the number of kinds; 0 for one kind (parts per hundred)."""
    share = F.col(count) / F.sum(count).over(Window.partitionBy(*group))
    out = df.withColumn("__p", share).groupBy(*group).agg(F.sum(-F.col("__p") * F.log2("__p")).alias("h"), F.count("*").alias("kinds"))
    return out.withColumn("entropy", F.when(F.col("kinds") > 1, scaled(F.col("h") / F.log2("kinds"), 2)).otherwise(0)).drop("h")


@query("t7_collection_entropy", """WITH g AS (SELECT user_id, genre, count(DISTINCT c.release_id) AS n FROM collected c JOIN genres g ON c.release_id = g.release_id GROUP BY 1, 2),
    p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM g)
    SELECT user_id, count(*) AS kinds, CASE WHEN count(*) > 1 THEN CAST(floor(sum(-p * log2(p)) / log2(count(*)) * 100 + 0.5) AS BIGINT) ELSE 0 END AS entropy FROM p GROUP BY 1""")
def collection_entropy(c: Catalog) -> DataFrame:
    counts = c.collected.select("user_id", "release_id").distinct().join(c.genres, "release_id").groupBy("user_id", "genre").agg(F.count("*").alias("n"))
    return entropy(counts, ["user_id"], "n")


@query("t7_style_drift", """WITH b AS (SELECT user_id, year, list_sort(list(DISTINCT style)) AS s FROM collected c JOIN releases r ON c.release_id = r.release_id JOIN styles t ON c.release_id = t.release_id WHERE year > 0 GROUP BY 1, 2),
    l AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY year) AS prev FROM b)
    SELECT user_id, year, CAST(floor((1 - len(list_intersect(s, prev)) / len(list_distinct(list_concat(s, prev)))) * 1e6 + 0.5) AS BIGINT) AS drift_ppm FROM l WHERE prev IS NOT NULL""")
def style_drift(c: Catalog) -> DataFrame:
    sets = c.collected.select("user_id", "release_id").join(c.releases.where("year > 0").select("release_id", "year"), "release_id").join(c.styles, "release_id").groupBy("user_id", "year").agg(F.collect_set("style").alias("s"))
    before = sets.withColumn("prev", F.lag("s").over(Window.partitionBy("user_id").orderBy("year"))).where("prev is not null")
    return before.select("user_id", "year", scaled(1 - F.size(F.array_intersect("s", "prev")) / F.size(F.array_union("s", "prev"))).alias("drift_ppm"))


@query("t8_collection_evolution", """SELECT user_id, year, 'genre' AS kind, genre AS name, count(*) AS n FROM collected c JOIN releases r ON c.release_id = r.release_id JOIN genres g ON c.release_id = g.release_id WHERE year > 0 GROUP BY 1, 2, 4
    UNION ALL SELECT user_id, year, 'style', style, count(*) FROM collected c JOIN releases r ON c.release_id = r.release_id JOIN styles g ON c.release_id = g.release_id WHERE year > 0 GROUP BY 1, 2, 4""")
def collection_evolution(c: Catalog) -> DataFrame:
    held = c.collected.select("user_id", "release_id").join(c.releases.where("year > 0").select("release_id", "year"), "release_id")
    one = lambda df, col: held.join(df, "release_id").groupBy("user_id", "year", F.col(col).alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(col))
    return one(c.genres, "genre").unionByName(one(c.styles, "style")).select("user_id", "year", "kind", "name", "n")


@query("t9_taste_drift", """SELECT user_id, day, genre, n FROM (SELECT user_id, strftime(date_added, '%Y-%m-%d') AS day, genre, count(*) AS n, row_number() OVER (PARTITION BY user_id, strftime(date_added, '%Y-%m-%d') ORDER BY count(*) DESC, genre) AS rn
    FROM collected c JOIN genres g ON c.release_id = g.release_id GROUP BY 1, 2, 3) WHERE rn = 1""")
def taste_drift(c: Catalog) -> DataFrame:
    """Top genre of each period of ``date_added``; the test events span one month, so the period is the day."""
    n = c.collected.join(c.genres, "release_id").groupBy("user_id", F.date_format("date_added", "yyyy-MM-dd").alias("day"), "genre").agg(F.count("*").alias("n"))
    return top_n(n, ["user_id", "day"], [F.desc("n"), "genre"], 1)


@query("t10_person_timeline", "SELECT person_id, year, category, count(*) AS n FROM credits JOIN releases USING (release_id) WHERE year > 0 GROUP BY 1, 2, 3")
def person_timeline(c: Catalog) -> DataFrame:
    return c.credits.join(c.releases.where("year > 0"), "release_id").groupBy("person_id", "year", "category").agg(F.count("*").alias("n"))


@query("t11_label_decades", "SELECT label_id, year - year % 10 AS decade, count(*) AS n, count(DISTINCT year) AS active_years FROM releases WHERE year > 0 GROUP BY 1, 2")
def label_decades(c: Catalog) -> DataFrame:
    years = c.releases.where("year > 0").groupBy("label_id", "year").agg(F.count("*").alias("n"))
    return years.groupBy("label_id", decade(F.col("year")).alias("decade")).agg(F.sum("n").alias("n"), F.count("*").alias("active_years"))


@query("t12_collaborators", """WITH p AS (SELECT a.artist_id, b.artist_id AS other_id, year, count(*) AS n FROM by_ a JOIN by_ b ON a.release_id = b.release_id AND a.artist_id <> b.artist_id JOIN releases r ON a.release_id = r.release_id WHERE year > 0 GROUP BY 1, 2, 3)
    SELECT artist_id, other_id, CAST(sum(n) AS BIGINT) AS releases, min(year) AS first_year, max(year) AS last_year, string_agg(CAST(year AS VARCHAR) || ':' || CAST(n AS VARCHAR), '|' ORDER BY year) AS years FROM p GROUP BY 1, 2""")
def collaborators(c: Catalog) -> DataFrame:
    pairs = c.by.join(c.by.withColumnRenamed("artist_id", "other_id"), "release_id").where("artist_id != other_id").join(c.releases.where("year > 0").select("release_id", "year"), "release_id")
    years = c.spread(pairs.select("artist_id", "other_id", "year"), "artist_id").groupBy("artist_id", "other_id", "year").agg(F.count("*").alias("n"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("year", "n"))), lambda x: F.concat_ws(":", x["year"].cast("string"), x["n"].cast("string")))
    return years.groupBy("artist_id", "other_id").agg(F.sum("n").alias("releases"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.array_join(listed, "|").alias("years"))


@query("t13_anniversaries", "SELECT master_id, y AS year, 2005 - y AS milestone FROM (SELECT master_id, min(year) AS y FROM masters JOIN releases USING (release_id) WHERE year > 0 GROUP BY 1) WHERE 2005 - y IN (5, 10, 20, 25, 50)")
def anniversaries(c: Catalog, year: int = 2005, milestones: tuple[int, ...] = (5, 10, 20, 25, 50)) -> DataFrame:
    years = c.masters.join(c.releases.where("year > 0"), "release_id").groupBy("master_id").agg(F.min("year").alias("year"))
    return years.withColumn("milestone", F.lit(year).cast("long") - F.col("year")).where(F.col("milestone").isin(*milestones))


@query("t14_user_activity_windows", """SELECT 'day' AS period, date_trunc('day', ts) AS at, count(*) AS events, count(DISTINCT user_id) AS users FROM ev GROUP BY 2
    UNION ALL SELECT 'week', date_trunc('week', ts), count(*), count(DISTINCT user_id) FROM ev GROUP BY 2 UNION ALL SELECT 'month', date_trunc('month', ts), count(*), count(DISTINCT user_id) FROM ev GROUP BY 2""".replace("date_trunc('day', ts)", "strftime(date_trunc('day', ts), '%Y-%m-%d')").replace("date_trunc('week', ts)", "strftime(date_trunc('week', ts), '%Y-%m-%d')").replace("date_trunc('month', ts)", "strftime(date_trunc('month', ts), '%Y-%m-%d')"))
def user_activity_windows(c: Catalog) -> DataFrame:
    one = lambda p: c.events.groupBy(F.date_format(F.date_trunc(p, "ts"), "yyyy-MM-dd").alias("at")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users")).select(F.lit(p).alias("period"), "at", "events", "users")
    return one("day").unionByName(one("week")).unionByName(one("month"))


@query("t15_sync_activity", """SELECT d AS days, count(*) AS syncs, count(*) FILTER (WHERE event_type = 'error') AS failures, CAST(floor(count(*) FILTER (WHERE event_type = 'error') / count(*) * 1e6 + 0.5) AS BIGINT) AS failure_ppm
    FROM ev, (VALUES (7), (30)) t(d) WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(d AS INTEGER)) GROUP BY 1""".replace("SELECT d AS days", "SELECT CAST(d AS BIGINT) AS days"))
def sync_activity(c: Catalog, now: str = "2024-01-31 00:00:00", spans: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Rolling windows up to a given instant, all spans from one scan."""
    inside = F.array_compact(F.array(*(F.when(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {d} DAYS"), F.lit(d).cast("long")) for d in spans)))
    rows = c.events.select("event_type", F.explode(inside).alias("days"))
    failed = F.count_if(F.col("event_type") == "error")
    return rows.groupBy("days").agg(F.count("*").alias("syncs"), failed.alias("failures"), scaled(failed / F.count("*")).alias("failure_ppm"))


@query("t16_ledger_density", "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM ev GROUP BY 1, 2")
def ledger_density(c: Catalog) -> DataFrame:
    return c.events.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count("*").alias("n"))

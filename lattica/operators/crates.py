"""Crates: a few additions to a collection, chosen by coverage, fit or popularity (section 2.14, B12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import top_n
from ..plans import ORACLES, Catalog, OfUsers, query, written
from .fit import fit

# Fixed value: the picks that a comparison makes.
PICKS = 5


def candidates(c: Catalog) -> DataFrame:
    """(user_id, master_id, release_id, units): wanted masters of which the user has no release, each by its first wanted release, with the artists it would add."""
    held = c.collected.select("user_id", "release_id").distinct()
    known = held.join(c.by, "release_id").select("user_id", "artist_id").distinct()
    want = c.wanted.select("user_id", "release_id").distinct().join(c.masters, "release_id").join(held.join(c.masters, "release_id"), ["user_id", "master_id"], "left_anti")
    pool = want.groupBy("user_id", "master_id").agg(F.min("release_id").alias("release_id"))
    fresh = pool.join(c.by, "release_id").join(known, ["user_id", "artist_id"], "left_anti").groupBy("user_id", "master_id").agg(F.sort_array(F.collect_set("artist_id")).alias("units"))
    return pool.join(fresh, ["user_id", "master_id"], "left").withColumn("units", F.coalesce("units", F.array().cast("array<bigint>")))


def greedy(pool: DataFrame, picks: int = PICKS) -> DataFrame:
    """(user_id, picks, gained): again and again the candidate that adds most artists, the least master among equals, until none adds any.

    A row is an artist of a candidate, and windows of a user find each pick, so no list of candidates is held however many there are.
    """
    rows = pool.select("user_id", "master_id", F.explode_outer("units").alias("unit")).repartition("user_id").withColumn("open", F.col("unit").isNotNull())
    of = lambda *keys: Window.partitionBy("user_id", *keys)
    for k in range(1, picks + 1):
        rows = rows.withColumn("gain", F.count_if("open").over(of("master_id")))
        rows = rows.withColumn("best", F.max(F.struct("gain", (-F.col("master_id")).alias("key"))).over(of()))
        rows = rows.withColumn(f"pick{k}", F.when(F.col("best.gain") > 0, -F.col("best.key")))
        taken = (F.col("best.gain") > 0) & F.col("master_id").eqNullSafe(F.col(f"pick{k}"))
        rows = rows.withColumn("open", F.col("open") & ~F.bool_or(taken).over(of("unit"))).drop("gain", "best")
    names = [f"pick{k}" for k in range(1, picks + 1)]
    picked = F.concat_ws("|", *(F.max(k).cast("string") for k in names))
    gained = F.count_distinct(F.when(~F.col("open"), F.col("unit")))
    return rows.groupBy("user_id").agg(picked.alias("picks"), gained.alias("gained"))


def ranked(pool: DataFrame, by: str, picks: int = PICKS) -> DataFrame:
    """(user_id, picks, gained) of the candidates with the greatest ``by``."""
    first = top_n(pool, ["user_id"], [F.desc(by), "master_id"], picks, rank="r").groupBy("user_id")
    out = first.agg(F.sort_array(F.collect_list(F.struct("r", "master_id"))).alias("x"), F.array_distinct(F.flatten(F.collect_list("units"))).alias("covered"))
    return out.select("user_id", F.array_join(F.transform("x", lambda m: m["master_id"].cast("string")), "|").alias("picks"), F.size("covered").cast("long").alias("gained"))


def _crates_sql() -> str:
    """Greedy picks, unrolled."""
    out = [f"""WITH held AS (SELECT DISTINCT user_id, release_id FROM collected), hm AS (SELECT DISTINCT user_id, master_id FROM held JOIN masters USING (release_id)), mine AS (SELECT DISTINCT user_id, artist_id FROM held JOIN by_ USING (release_id)),
    w AS (SELECT user_id, master_id, min(release_id) AS release_id FROM wanted JOIN masters m USING (release_id) WHERE NOT EXISTS (SELECT 1 FROM hm WHERE hm.user_id = wanted.user_id AND hm.master_id = m.master_id) GROUP BY 1, 2),
    pool AS (SELECT user_id, master_id, release_id FROM w),
    u AS MATERIALIZED (SELECT p.user_id, p.master_id, p.release_id, coalesce(list(b.artist_id) FILTER (WHERE m.artist_id IS NULL), []) AS units FROM pool p JOIN by_ b USING (release_id) LEFT JOIN mine m ON m.user_id = p.user_id AND m.artist_id = b.artist_id GROUP BY 1, 2, 3),
    s0 AS (SELECT DISTINCT user_id, CAST([] AS BIGINT[]) AS picked, CAST([] AS BIGINT[]) AS covered FROM u)"""]
    for d in range(1, PICKS + 1):
        out.append(f"g{d} AS (SELECT s.user_id, picked, covered, u.master_id, u.units, len(u.units) - len(list_intersect(u.units, covered)) AS gain FROM s{d - 1} s JOIN u USING (user_id))")
        out.append(f"""s{d} AS MATERIALIZED (SELECT user_id, CASE WHEN gain > 0 THEN list_append(picked, master_id) ELSE picked END AS picked, CASE WHEN gain > 0 THEN list_distinct(list_concat(covered, units)) ELSE covered END AS covered
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gain DESC, master_id) AS rn FROM g{d}) WHERE rn = 1)""")
    out.append("pop AS (SELECT release_id, count(DISTINCT user_id) AS n FROM (SELECT user_id, release_id FROM collected UNION ALL SELECT user_id, release_id FROM wanted) GROUP BY 1)")
    out.append(f"ft AS ({ORACLES['c14_fit']})")
    out.append("v AS (SELECT u.*, 'popularity' AS policy, coalesce(pop.n, 0) AS v FROM u LEFT JOIN pop USING (release_id) UNION ALL SELECT u.*, 'individual_fit', coalesce(ft.fit, 0) FROM u LEFT JOIN ft ON ft.user_id = u.user_id AND ft.release_id = u.release_id)")
    out.append(f"r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY policy, user_id ORDER BY v DESC, master_id) AS rn FROM v) WHERE rn <= {PICKS})")
    return ", ".join(out) + f""" SELECT user_id, 'greedy_coverage' AS policy, array_to_string(picked, '|') AS picks, CAST(len(covered) AS BIGINT) AS gained FROM s{PICKS}
    UNION ALL SELECT user_id, policy, string_agg(CAST(master_id AS VARCHAR), '|' ORDER BY rn), CAST(len(list_distinct(flatten(list(units)))) AS BIGINT) FROM r GROUP BY 1, 2"""


@query("b12_crates", _crates_sql())
def crates(c: Catalog) -> DataFrame:
    """What five additions gain each user in new artists when chosen greedily, by individual fit, or by popularity, all against the collection as it is."""
    # All that follows is asked of releases that users have or want, so no other line is made an edge.
    c = OfUsers(c)
    pool = written(c.spark, candidates(c))
    both = c.collected.select("user_id", "release_id").union(c.wanted.select("user_id", "release_id"))
    popular = both.groupBy("release_id").agg(F.count_distinct("user_id").alias("popularity"))
    valued = pool.join(popular, "release_id", "left").join(fit(c).select("user_id", "release_id", F.col("fit").alias("individual_fit")), ["user_id", "release_id"], "left").fillna(0, ["popularity", "individual_fit"])
    valued = written(c.spark, valued)
    parts = [greedy(pool).withColumn("policy", F.lit("greedy_coverage")), *(ranked(valued, by).withColumn("policy", F.lit(by)) for by in ("individual_fit", "popularity"))]
    return reduce(DataFrame.unionByName, parts)

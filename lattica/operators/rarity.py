"""Rarity: the batch score of every release, and reads of its table (section 2.7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import top_n
from ..plans import Catalog, query

# Weights, tiers and score ladders.
WEIGHTS = {"label_catalog": 0.10, "medium_rarity": 0.10, "temporal": 0.20, "isolation": 0.15, "prevalence": 0.20, "pressing": 0.25}
TIERS = ((80, "ultra-rare"), (60, "rare"), (40, "scarce"), (20, "uncommon"), (0, "common"))
LADDERS = {
    "label_catalog": ((9, 100), (50, 75), (200, 50), (1000, 25), (None, 10)),
    "isolation": ((2, 90), (4, 70), (7, 50), (12, 30), (None, 10)),
    "prevalence": ((0, 95), (10, 85), (100, 70), (1000, 50), (10000, 25), (None, 10)),
    "pressing": ((1, 100), (2, 85), (5, 60), (10, 35), (None, 10)),
}
MEDIA = {"A": 40, "N": 30, "R": 70}
GROOVED = "R"
THIS_YEAR = 2005


def ladder(x: Column, name: str) -> Column:
    steps = LADDERS[name]
    return reduce(lambda out, step: F.when(x <= step[0], step[1]).otherwise(out), reversed(steps[:-1]), F.lit(steps[-1][1]))


def signals(c: Catalog) -> DataFrame:
    """Per release: the raw signals and scores from 0 to 100; ``pressing`` is null where it does not apply."""
    size = c.on.groupBy("label_id").agg(F.count("*").alias("label_size"))
    sibling = c.masters.join(c.releases.where("year > 0").select("release_id", "year"), "release_id")
    # The latest release of each master, and the latest year of its others: so each release finds the latest of its siblings.
    latest = sibling.groupBy("master_id").agg(F.max(F.struct("year", "release_id")).alias("last"), F.count("*").alias("pressings"))
    others = sibling.join(latest, "master_id").where("release_id != last.release_id").groupBy("master_id").agg(F.max("year").alias("second"))
    latest = latest.join(others, "master_id", "left").select("master_id", "pressings", F.col("last.year").alias("first_year"), F.col("last.release_id").alias("first_id"), "second")
    degree = [c.by.select("release_id"), c.genres.select("release_id"), c.styles.select("release_id"), c.on.select("release_id")]
    degree = reduce(DataFrame.unionByName, degree).groupBy("release_id").agg(F.count("*").alias("degree"))
    media = c.media.withColumn("m", reduce(lambda out, kv: F.when(F.col("family") == kv[0], kv[1]).otherwise(out), MEDIA.items(), F.lit(50)))
    media = media.groupBy("release_id").agg(F.max("m").alias("medium_rarity"), F.bool_or(F.col("family") == GROOVED).alias("grooved"))
    have = c.collected.groupBy("release_id").agg(F.count_distinct("user_id").alias("have"))
    want = c.wanted.groupBy("release_id").agg(F.count_distinct("user_id").alias("want"))
    df = c.releases.select("release_id", "year", "label_id").join(size, "label_id").join(degree, "release_id", "left").join(media, "release_id", "left")
    df = df.join(c.masters, "release_id", "left").join(latest, "master_id", "left").join(have, "release_id", "left").join(want, "release_id", "left")
    age = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 1.5 * (THIS_YEAR - F.col("year"))))
    newest = F.when(F.col("release_id") == F.col("first_id"), F.col("second")).otherwise(F.col("first_year"))
    recent = F.coalesce(newest >= THIS_YEAR - 10, F.lit(False))
    bonus = F.when(F.coalesce("want", F.lit(0)) > F.coalesce("have", F.lit(0)), 5).otherwise(0)
    prevalence = F.when(F.col("have").isNull() & F.col("want").isNull(), 50).otherwise(F.least(F.lit(100), ladder(F.coalesce("have", F.lit(0)), "prevalence") + bonus))
    grooved = F.coalesce("grooved", F.lit(False))
    pressing = F.when(grooved, F.when(F.col("master_id").isNull(), 90).otherwise(ladder(F.coalesce("pressings", F.lit(1)), "pressing")))
    return df.select(
        "release_id",
        F.coalesce("medium_rarity", F.lit(50)).cast("long").alias("medium_rarity"),
        ladder(F.col("label_size"), "label_catalog").cast("long").alias("label_catalog"),
        prevalence.cast("long").alias("prevalence"),
        F.when(F.col("year") > 0, F.greatest(F.lit(0.0), age - F.when(recent, 40).otherwise(0))).otherwise(50.0).cast("decimal(6,2)").alias("temporal"),
        ladder(F.coalesce("degree", F.lit(0)), "isolation").cast("long").alias("isolation"),
        pressing.cast("long").alias("pressing"),
    )


def composed(df: DataFrame) -> DataFrame:
    """Weighted sum over the signals present, weights renormalised, in hundredths; and its tier."""
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(k).cast("double") * w, F.lit(0.0)) for k, w in WEIGHTS.items()))
    weight = reduce(lambda a, b: a + b, (F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in WEIGHTS.items()))
    out = df.withColumn("score", F.floor(total / weight * 100 + 0.5 + 1e-7).cast("long"))
    tier = reduce(lambda out, t: F.when(F.col("score") >= t[0] * 100, t[1]).otherwise(out), reversed(TIERS[:-1]), F.lit(TIERS[-1][1]))
    return out.withColumn("tier", tier)


_SIGNALS = """WITH size AS (SELECT label_id, count(*) AS label_size FROM on_ GROUP BY 1),
    latest AS (SELECT master_id, count(*) AS pressings FROM masters JOIN releases USING (release_id) WHERE year > 0 GROUP BY 1),
    sib AS (SELECT release_id, max(year) OVER (PARTITION BY master_id ORDER BY release_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS newest FROM masters JOIN releases USING (release_id) WHERE year > 0),
    deg AS (SELECT release_id, count(*) AS degree FROM (SELECT release_id FROM by_ UNION ALL SELECT release_id FROM genres UNION ALL SELECT release_id FROM styles UNION ALL SELECT release_id FROM on_) GROUP BY 1),
    med AS (SELECT release_id, max(CASE family WHEN 'A' THEN 40 WHEN 'N' THEN 30 WHEN 'R' THEN 70 ELSE 50 END) AS medium_rarity, bool_or(family = 'R') AS grooved FROM media GROUP BY 1),
    hv AS (SELECT release_id, count(DISTINCT user_id) AS have FROM collected GROUP BY 1), wt AS (SELECT release_id, count(DISTINCT user_id) AS want FROM wanted GROUP BY 1),
    signals AS (SELECT r.release_id, CAST(coalesce(medium_rarity, 50) AS BIGINT) AS medium_rarity, CAST(CASE WHEN label_size < 10 THEN 100 WHEN label_size <= 50 THEN 75 WHEN label_size <= 200 THEN 50 WHEN label_size <= 1000 THEN 25 ELSE 10 END AS BIGINT) AS label_catalog,
        CAST(CASE WHEN have IS NULL AND want IS NULL THEN 50 ELSE least(100, CASE WHEN coalesce(have, 0) <= 0 THEN 95 WHEN have <= 10 THEN 85 WHEN have <= 100 THEN 70 WHEN have <= 1000 THEN 50 WHEN have <= 10000 THEN 25 ELSE 10 END + CASE WHEN coalesce(want, 0) > coalesce(have, 0) THEN 5 ELSE 0 END) END AS BIGINT) AS prevalence,
        CAST(CASE WHEN year > 0 THEN greatest(0.0, least(100.0, greatest(0.0, 1.5 * (2005 - year))) - CASE WHEN newest >= 1995 THEN 40 ELSE 0 END) ELSE 50.0 END AS DECIMAL(6,2)) AS temporal,
        CAST(CASE WHEN coalesce(degree, 0) <= 2 THEN 90 WHEN degree <= 4 THEN 70 WHEN degree <= 7 THEN 50 WHEN degree <= 12 THEN 30 ELSE 10 END AS BIGINT) AS isolation,
        CAST(CASE WHEN coalesce(grooved, false) THEN CASE WHEN m.master_id IS NULL THEN 90 ELSE CASE WHEN coalesce(pressings, 1) <= 1 THEN 100 WHEN pressings <= 2 THEN 85 WHEN pressings <= 5 THEN 60 WHEN pressings <= 10 THEN 35 ELSE 10 END END END AS BIGINT) AS pressing
        FROM releases r JOIN size ON r.label_id = size.label_id LEFT JOIN deg ON r.release_id = deg.release_id LEFT JOIN med ON r.release_id = med.release_id LEFT JOIN masters m ON r.release_id = m.release_id
        LEFT JOIN latest ON m.master_id = latest.master_id LEFT JOIN sib ON sib.release_id = r.release_id LEFT JOIN hv ON r.release_id = hv.release_id LEFT JOIN wt ON r.release_id = wt.release_id)"""
_SCORED = f"""{_SIGNALS},
    sums AS (SELECT *, 0.1::DOUBLE * label_catalog + 0.1::DOUBLE * medium_rarity + 0.2::DOUBLE * CAST(temporal AS DOUBLE) + 0.15::DOUBLE * isolation + 0.2::DOUBLE * prevalence + 0.25::DOUBLE * coalesce(pressing, 0) AS total, CASE WHEN pressing IS NULL THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM signals),
    scored AS (SELECT * EXCLUDE (total, weight), CAST(floor(total / weight * 100 + 0.5 + 1e-7) AS BIGINT) AS score FROM sums),
    rated AS (SELECT *, CASE WHEN score >= 8000 THEN 'ultra-rare' WHEN score >= 6000 THEN 'rare' WHEN score >= 4000 THEN 'scarce' WHEN score >= 2000 THEN 'uncommon' ELSE 'common' END AS tier FROM scored)"""


@query("r2_rarity_signals", f"{_SIGNALS} SELECT * FROM signals")
def rarity_signals(c: Catalog) -> DataFrame:
    return signals(c)


@query("r4_rarity_scores", f"{_SCORED} SELECT * FROM rated")
def rarity_scores(c: Catalog) -> DataFrame:
    return composed(signals(c))


@query("r17_rarity_tiers", f"{_SCORED} SELECT tier, count(*) AS n, min(score) AS least, max(score) AS most FROM rated GROUP BY 1")
def rarity_tiers(c: Catalog) -> DataFrame:
    return rarity_scores(c).groupBy("tier").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query("r18_leaderboard", f"{_SCORED} SELECT release_id, score, tier FROM rated ORDER BY score DESC, release_id LIMIT 100")
def leaderboard(c: Catalog, limit: int = 100) -> DataFrame:
    return rarity_scores(c).select("release_id", "score", "tier").orderBy(F.desc("score"), "release_id").limit(limit)


@query("r19_tier_keyset_page", f"{_SCORED} SELECT release_id, score FROM rated WHERE tier = 'scarce' AND (score < 4500 OR (score = 4500 AND release_id > 100)) ORDER BY score DESC, release_id LIMIT 50")
def tier_page(c: Catalog, tier: str = "scarce", after: tuple[int, int] = (4500, 100), limit: int = 50) -> DataFrame:
    """The page after a (score, release_id) key."""
    score, last = after
    rows = rarity_scores(c).where((F.col("tier") == tier) & ((F.col("score") < score) | ((F.col("score") == score) & (F.col("release_id") > last))))
    return rows.select("release_id", "score").orderBy(F.desc("score"), "release_id").limit(limit)


@query("r3_quality_percentiles", """WITH d AS (SELECT artist_id, count(*) AS degree FROM by_ GROUP BY 1) SELECT artist_id, degree, CAST(floor((rank() OVER (ORDER BY degree) - 1) / count(*) OVER () * 1e6 + 0.5) AS BIGINT) AS below_ppm FROM d""")
def quality_percentiles(c: Catalog) -> DataFrame:
    """Share of artists of strictly smaller degree. Ranked over the distinct degrees, which are few, not over the artists."""
    degrees = c.by.groupBy("artist_id").agg(F.count("*").alias("degree"))
    return percentiles(degrees, "degree").select("artist_id", "degree", F.floor(F.col("below") * 10**6 + 0.5).cast("long").alias("below_ppm"))


def percentiles(df: DataFrame, value: str) -> DataFrame:
    """Add ``below``: the share of positive values strictly below; ranks are summed over the histogram of values."""
    from pyspark.sql import Window

    counts = df.where(F.col(value) > 0).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    lower = F.coalesce(F.sum("__n").over(Window.orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = counts.select("__v", (lower / F.sum("__n").over(Window.partitionBy())).alias("below"))
    return df.join(shares, F.col(value) == F.col("__v"), "left").drop("__v").fillna(0.0, ["below"])


@query("r20_hidden_gems", f"""{_SCORED}, ad AS (SELECT artist_id, count(*) AS d FROM by_ GROUP BY 1), ap AS (SELECT artist_id, (rank() OVER (ORDER BY d) - 1) / count(*) OVER () AS p FROM ad),
    ld AS (SELECT label_id, count(*) AS d FROM on_ GROUP BY 1), lp AS (SELECT label_id, (rank() OVER (ORDER BY d) - 1) / count(*) OVER () AS p FROM ld),
    gd AS (SELECT genre, count(*) AS d FROM genres GROUP BY 1), gp AS (SELECT genre, (rank() OVER (ORDER BY d) - 1) / count(*) OVER () AS p FROM gd),
    q AS (SELECT r.release_id, r.score, coalesce(a.p, 0) AS pa, coalesce(l.p, 0) AS pl, coalesce(g.p, 0) AS pg FROM rated r LEFT JOIN (SELECT release_id, max(p) AS p FROM by_ JOIN ap USING (artist_id) GROUP BY 1) a ON r.release_id = a.release_id
        LEFT JOIN (SELECT release_id, max(p) AS p FROM on_ JOIN lp USING (label_id) GROUP BY 1) l ON r.release_id = l.release_id LEFT JOIN (SELECT release_id, max(p) AS p FROM genres JOIN gp USING (genre) GROUP BY 1) g ON r.release_id = g.release_id)
    SELECT release_id, score, CAST(floor(score * (0.4::DOUBLE * pa + 0.3::DOUBLE * pl + 0.3::DOUBLE * pg) + 0.5 + 1e-7) AS BIGINT) AS gem FROM q WHERE score >= 4100 ORDER BY gem DESC, release_id LIMIT 100""")
def hidden_gems(c: Catalog, limit: int = 100) -> DataFrame:
    """score * (0.4 artist + 0.3 label + 0.3 genre percentile of the best-connected neighbour), in hundredths, from a score of 41 on."""
    best = []
    for edges, key, name in ((c.by, "artist_id", "pa"), (c.on, "label_id", "pl"), (c.genres, "genre", "pg")):
        share = percentiles(edges.groupBy(key).agg(F.count("*").alias("d")), "d").select(key, "below")
        best.append(edges.join(share, key).groupBy("release_id").agg(F.max("below").alias(name)))
    rows = reduce(lambda a, b: a.join(b, "release_id", "left"), best, rarity_scores(c).where("score >= 4100").select("release_id", "score")).fillna(0.0, ["pa", "pl", "pg"])
    gem = F.floor(F.col("score") * (0.4 * F.col("pa") + 0.3 * F.col("pl") + 0.3 * F.col("pg")) + 0.5 + 1e-7).cast("long")
    return rows.select("release_id", "score", gem.alias("gem")).orderBy(F.desc("gem"), "release_id").limit(limit)


def _by_member(attribute: str, view: str, col: str) -> None:
    @query(f"r21_rarity_by_{attribute}", f"{_SCORED} SELECT {col}, release_id, score FROM (SELECT e.{col}, e.release_id, score, row_number() OVER (PARTITION BY e.{col} ORDER BY score DESC, e.release_id) AS rn FROM {view} e JOIN rated r ON e.release_id = r.release_id) WHERE rn <= 10")
    def _(c: Catalog) -> DataFrame:
        return top_n(getattr(c, attribute).join(rarity_scores(c).select("release_id", "score"), "release_id").select(col, "release_id", "score"), [col], [F.desc("score"), "release_id"], 10)


_by_member("by", "by_", "artist_id")
_by_member("on", "on_", "label_id")


@query("r23_stale_counts", "SELECT release_id FROM (SELECT release_id FROM collected UNION SELECT release_id FROM wanted) WHERE release_id NOT IN (SELECT k FROM ev WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-30 00:00:00' AND k IS NOT NULL)")
def stale_counts(c: Catalog) -> DataFrame:
    held = c.collected.select("release_id").unionByName(c.wanted.select("release_id")).distinct()
    fresh = c.events.where((F.col("event_type") == "view") & (F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz"))).select(F.col("k").alias("release_id"))
    return held.join(fresh, "release_id", "left_anti")

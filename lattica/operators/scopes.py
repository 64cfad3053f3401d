"""Candidate scopes of similar artists, replays of what is served, and guarded compositions (V11, V14, Z3, Z9, Z13 and Z18)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scaled, top_n
from ..plans import ORACLES, Catalog, query
from .discover import scored_discoveries
from .folds import master_folds
from .similarity import _CANDIDATES, candidates, similar_artists

# The most releases of a root whose strata are drawn, and the least versions of stored longevity and ranks that are trusted.
MOST_RELEASES = 134_051
LONGEVITY_VERSION, RANK_VERSION = 3, 4


def signals(c: Catalog, *kinds: str) -> DataFrame:
    """(release_id, signal): the genres, styles, label and the release itself (or those of ``kinds``), each by a text of its own."""
    parts = (("genre", c.genres, "genre"), ("style", c.styles, "style"), ("label", c.on, "label_id"), ("release", c.releases, "release_id"))
    return reduce(DataFrame.unionByName, (df.select("release_id", F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("signal")) for kind, df, key in parts if not kinds or kind in kinds))


def all_signal_candidates(c: Catalog, asked: str | None = None, least: int = 3) -> DataFrame:
    """(a, b, releases): artists b with ``least`` releases or more that share a genre, style, label or release with those of a; ``asked`` is a condition on the ``artist_id`` of a.

    No genre is cut short. Artists of the same genres and styles reach the same releases by them, so those are counted once for each such set, under its least artist;
    an artist of its own are only the releases that its labels and itself add to that.
    """
    own = (c.by.where(asked) if asked else c.by).withColumnRenamed("artist_id", "a")
    topics = signals(c, "genre", "style")
    sets = own.join(topics, "release_id").groupBy("a").agg(F.sort_array(F.collect_set("signal")).alias("set"))
    reps = sets.withColumn("rep", F.min("a").over(Window.partitionBy("set")))
    reached = reps.where("a = rep").select("rep", F.explode("set").alias("signal")).join(topics, "signal").select("rep", "release_id").distinct()
    others = c.by.withColumnRenamed("artist_id", "b")
    alike = reached.join(others, "release_id").groupBy("rep", "b").agg(F.count("*").alias("n"))
    by_label = own.join(c.on, "release_id").select("a", "label_id").distinct().join(c.on, "label_id").select("a", "release_id")
    more = by_label.unionByName(own.join(c.releases.select("release_id"), "release_id").select("a", "release_id")).distinct()
    more = more.join(reps.select("a", "rep"), "a", "left").join(reached, ["rep", "release_id"], "left_anti").join(others, "release_id").groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = reps.select("a", "rep").join(alike, "rep").select("a", "b", "n").unionByName(more).where("a != b")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("releases")).where(F.col("releases") >= least)


_ALL = """sg AS (SELECT release_id, 'genre:' || genre AS signal FROM genres UNION ALL SELECT release_id, 'style:' || style FROM styles UNION ALL SELECT release_id, 'label:' || label_id FROM on_ UNION ALL SELECT release_id, 'release:' || release_id FROM releases),
    wt AS (SELECT DISTINCT artist_id AS a, signal FROM by_ JOIN sg USING (release_id) WHERE artist_id % 100 = 0), rc AS (SELECT DISTINCT a, release_id FROM wt JOIN sg USING (signal)),
    al AS (SELECT a, artist_id AS b, count(*) AS releases FROM rc JOIN by_ USING (release_id) WHERE a <> artist_id GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query("v11_all_signal_candidates", f"WITH {_ALL} SELECT a, b, releases FROM al")
def asked_candidates(c: Catalog) -> DataFrame:
    """The query set: artists whose ids are divisible by 100, against all artists."""
    return all_signal_candidates(c, "artist_id % 100 = 0")


@query("z18_candidate_scopes", f"""WITH {_ALL}, {_CANDIDATES}, pg AS (SELECT artist_id, style FROM (SELECT artist_id, style, row_number() OVER (PARTITION BY artist_id ORDER BY count(*) DESC, style) AS rn FROM by_ JOIN styles USING (release_id) GROUP BY 1, 2) WHERE rn = 1),
    ls AS (SELECT 'all_signals' AS scope, a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY releases DESC, b) AS rn FROM al) WHERE rn <= 50 UNION ALL SELECT 'top_genres', a, b FROM cand WHERE a % 100 = 0)
    SELECT scope, count(DISTINCT a) AS artists, count(*) AS listed, count(*) FILTER (WHERE x.style = y.style) AS same_style, CAST(floor(count(*) FILTER (WHERE x.style = y.style) / count(*) * 1e6 + 0.5) AS BIGINT) AS precision_ppm
    FROM ls LEFT JOIN pg x ON x.artist_id = a LEFT JOIN pg y ON y.artist_id = b GROUP BY 1""")
def candidate_scopes(c: Catalog, most: int = 50) -> DataFrame:
    """The first candidates of each scope for the asked artists, and how many have the artist's first style."""
    first = top_n(c.by.join(c.styles, "release_id").groupBy("artist_id", "style").agg(F.count("*").alias("n")), ["artist_id"], [F.desc("n"), "style"], 1)
    wide = top_n(asked_candidates(c), ["a"], [F.desc("releases"), "b"], most).select("a", "b", F.lit("all_signals").alias("scope"))
    lists = wide.unionByName(candidates(c, most=most, asked="a % 100 = 0").select("a", "b", F.lit("top_genres").alias("scope")))
    own, theirs = (first.select(F.col("artist_id").alias(k), F.col("style").alias(f"style_{k}")) for k in "ab")
    rows = lists.join(own, "a", "left").join(theirs, "b", "left").groupBy("scope")
    rows = rows.agg(F.count_distinct("a").alias("artists"), F.count("*").alias("listed"), F.count_if(F.col("style_a") == F.col("style_b")).alias("same_style"))
    return rows.withColumn("precision_ppm", scaled(F.col("same_style") / F.col("listed")))


# replays and compositions


@query("v14_served_lists", f"""WITH hb AS (SELECT DISTINCT user_id, release_id FROM collected WHERE date_added < TIMESTAMP '2024-01-20 00:00:00'),
    sd AS (SELECT user_id, artist_id FROM (SELECT user_id, artist_id, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, artist_id) AS rn FROM hb JOIN by_ USING (release_id) GROUP BY 1, 2) WHERE rn = 1),
    ls AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM ({ORACLES["m5_similar_artists"]})) WHERE rn <= 5),
    nw AS (SELECT DISTINCT user_id, artist_id FROM collected JOIN by_ USING (release_id) WHERE date_added >= TIMESTAMP '2024-01-20 00:00:00')
    SELECT sd.user_id, sd.artist_id AS seed, count(ls.b) AS served, count(nw.artist_id) AS hits FROM sd LEFT JOIN ls ON ls.a = sd.artist_id LEFT JOIN nw ON nw.user_id = sd.user_id AND nw.artist_id = ls.b GROUP BY 1, 2""")
def served_lists(c: Catalog, cut: str = "2024-01-20", n: int = 5) -> DataFrame:
    """What each user's first artist before the cut is served, and how many of those artists the user came to hold after it."""
    at = F.lit(cut).cast("timestamp_ntz")
    held = c.collected.where(F.col("date_added") < at).select("user_id", "release_id").distinct().join(c.by, "release_id")
    seeds = top_n(held.groupBy("user_id", "artist_id").agg(F.count("*").alias("n")), ["user_id"], [F.desc("n"), "artist_id"], 1).select("user_id", F.col("artist_id").alias("seed"))
    lists = similar_artists(c, n).select(F.col("a").alias("seed"), F.col("b").alias("artist_id"))
    fresh = c.collected.where(F.col("date_added") >= at).select("user_id", "release_id").distinct().join(c.by, "release_id").select("user_id", "artist_id").distinct().withColumn("hit", F.lit(True))
    rows = seeds.join(lists, "seed", "left").join(fresh, ["user_id", "artist_id"], "left")
    return rows.groupBy("user_id", "seed").agg(F.count("artist_id").alias("served"), F.count("hit").alias("hits"))


_FIRST = "SELECT user_id, genre AS hub FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) AS rn FROM ug) WHERE rn = 1"
_WANTED = "SELECT user_id, genre AS hub FROM (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, genre) AS rn FROM (SELECT DISTINCT user_id, release_id FROM wanted) JOIN genres USING (release_id) GROUP BY 1, 2) WHERE rn = 1"


@query("z3_explore_from_here", f"""SELECT * FROM ({ORACLES["m11_scored_discoveries"].replace(_FIRST, _WANTED).removesuffix("10")}50)""")
def explore_from_here(c: Catalog, limit: int = 50) -> DataFrame:
    """From the genre that a user wants most, what lies near it, by what the user holds."""
    counts = c.wanted.select("user_id", "release_id").distinct().join(c.genres, "release_id").groupBy("user_id", "genre").agg(F.count("*").alias("n"))
    return scored_discoveries(c, limit, top_n(counts, ["user_id"], [F.desc("n"), "genre"], 1).select("user_id", F.col("genre").alias("hub")))


@query("z9_strata", f"""SELECT n.label_id, n.releases, CASE WHEN n.releases > {MOST_RELEASES} THEN 'refused' ELSE 'served' END AS status, CASE WHEN n.releases <= {MOST_RELEASES} THEN coalesce(f.kept + f.buckets, 0) END AS entries
    FROM (SELECT label_id, count(*) AS releases FROM on_ GROUP BY 1) n LEFT JOIN ({ORACLES["b4_master_folds"]}) f ON f.label_id = n.label_id""")
def strata(c: Catalog, most: int = MOST_RELEASES, budget: int = 8) -> DataFrame:
    """The entries of each label's view; a label of more than ``most`` releases is refused, and its releases are not folded."""
    sizes = c.on.groupBy("label_id").agg(F.count("*").alias("releases"))
    folds = master_folds(c, budget).select("label_id", (F.col("kept") + F.col("buckets")).alias("entries"))
    served = F.col("releases") <= most
    rows = sizes.join(folds, "label_id", "left")
    return rows.select("label_id", "releases", F.when(served, "served").otherwise("refused").alias("status"), F.when(served, F.coalesce("entries", F.lit(0))).alias("entries"))


@query("z13_trusted_longevity", f"""WITH live AS (SELECT label_id, min(year) AS first_year, max(year) AS last_year, count(*) AS n FROM releases GROUP BY 1), st AS (SELECT label_id, min(year) AS first_year, max(year) AS last_year, count(*) AS n FROM releases WHERE year < 1998 GROUP BY 1),
    rk AS (SELECT label_id, rank() OVER (ORDER BY n DESC) AS place FROM st), v AS (SELECT label_id, nation > 2 AS maintained, nation % 6 AS version FROM label_nodes),
    j AS (SELECT live.label_id, v.maintained AND v.version >= {LONGEVITY_VERSION} AND st.n IS NOT NULL AS trusted, live.first_year AS lf, live.last_year AS ll, live.n AS ln, st.first_year AS sf, st.last_year AS sl, st.n AS sn, CASE WHEN v.maintained AND v.version >= {RANK_VERSION} THEN rk.place END AS place FROM live LEFT JOIN st USING (label_id) LEFT JOIN rk USING (label_id) LEFT JOIN v USING (label_id))
    SELECT label_id, coalesce(trusted, false) AS stored, CASE WHEN trusted THEN sf ELSE lf END AS first_year, CASE WHEN trusted THEN sl ELSE ll END AS last_year, CASE WHEN trusted THEN sn ELSE ln END AS releases, place FROM j""")
def trusted_longevity(c: Catalog, before: int = 1998) -> DataFrame:
    """A label's span of years: what an older sweep stored where its version is trusted, else the live one; a stored rank only, never a live one.

    The sweep saw the years before ``before``; a label's version and whether it is maintained follow from its nation.
    """
    span = lambda df, tag: df.groupBy("label_id").agg(*(f("year").alias(f"{tag}_{k}") for k, f in (("first_year", F.min), ("last_year", F.max))), F.count("*").alias(f"{tag}_releases"))
    live, stored = span(c.releases, "live"), span(c.releases.where(F.col("year") < before), "stored")
    # Ranks follow from the histogram of counts, so no window holds all labels.
    sizes = stored.groupBy("stored_releases").agg(F.count("*").alias("labels"))
    above = F.sum("labels").over(Window.orderBy(F.desc("stored_releases")).rowsBetween(Window.unboundedPreceding, -1))
    ranks = sizes.select("stored_releases", (F.coalesce(above, F.lit(0)) + 1).alias("place"))
    kept = c.labels.select("label_id", (F.col("nation") > 2).alias("maintained"), (F.col("nation") % 6).alias("version"))
    rows = live.join(stored.join(ranks, "stored_releases"), "label_id", "left").join(kept, "label_id", "left")
    since = lambda version: F.coalesce(F.col("maintained") & (F.col("version") >= version), F.lit(False))
    trusted = since(LONGEVITY_VERSION) & F.col("stored_releases").isNotNull()
    either = [F.when(trusted, F.col(f"stored_{k}")).otherwise(F.col(f"live_{k}")).alias(k) for k in ("first_year", "last_year", "releases")]
    return rows.select("label_id", trusted.alias("stored"), *either, F.when(since(RANK_VERSION), F.col("place")).alias("place"))

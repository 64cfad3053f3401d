"""Fit of a wanted release to its user's collection (section 2.10, C7 to C14), for all users at once.

Facets of a release are its artists, label, genres and styles. Affinity is the weighted share of facets that the user holds, novelty
the share not held, depth how far the best-held artist or label goes, bridge whether it joins regions of the collection that share nothing, and
redundancy whether the same release, master, or artist and title is held. All are in ten-thousandths; the fit clips their sum to the same scale.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scaled
from ..plans import Catalog, query
from .lookup import titles

# Weights of the facets in affinity, and releases that count as full depth.
FACETS = {"artist": 0.35, "label": 0.25, "genre": 0.25, "style": 0.15}
FULL_DEPTH = 5
# Redundancy of a held release, of its master in a like form, of its master in another form, and of its artist and title.
HELD, SAME_FORM, OTHER_FORM, SAME_TITLE = 10000, 10000, 6000, 3000
ONE = 10000


def facets(c: Catalog) -> DataFrame:
    """(release_id, dim, name) of every release."""
    parts = [(c.by, "artist", "artist_id"), (c.on, "label", "label_id"), (c.genres, "genre", "genre"), (c.styles, "style", "style")]
    return reduce(DataFrame.unionByName, (df.select("release_id", F.lit(d).alias("dim"), F.col(col).cast("string").alias("name")) for df, d, col in parts))


_FACETS = """WITH fc AS (SELECT release_id, 'artist' AS dim, CAST(artist_id AS VARCHAR) AS name FROM by_ UNION ALL SELECT release_id, 'label', CAST(label_id AS VARCHAR) FROM on_ UNION ALL SELECT release_id, 'genre', genre FROM genres UNION ALL SELECT release_id, 'style', style FROM styles),
    held AS (SELECT DISTINCT user_id, release_id FROM collected), cand AS (SELECT DISTINCT user_id, release_id FROM wanted),
    hf AS (SELECT user_id, dim, name, count(*) AS n FROM held JOIN fc USING (release_id) GROUP BY 1, 2, 3),
    m AS (SELECT c.user_id, c.release_id, f.dim, f.name, coalesce(h.n, 0) AS n FROM cand c JOIN fc f ON c.release_id = f.release_id LEFT JOIN hf h ON h.user_id = c.user_id AND h.dim = f.dim AND h.name = f.name)"""


@query("c7_held_facets", f"{_FACETS} SELECT user_id, dim, name, n FROM hf")
def held_facets(c: Catalog) -> DataFrame:
    held = c.collected.select("user_id", "release_id").distinct()
    return held.join(facets(c), "release_id").groupBy("user_id", "dim", "name").agg(F.count("*").alias("n"))


def matched(c: Catalog) -> DataFrame:
    """(user_id, release_id, dim, name, n): the facets of what users want, with how many releases they hold of each."""
    want = c.wanted.select("user_id", "release_id").distinct().join(facets(c), "release_id")
    return want.join(held_facets(c), ["user_id", "dim", "name"], "left").fillna(0, ["n"])


_FIT = f"""{_FACETS}, per AS (SELECT user_id, release_id, dim, count(*) FILTER (WHERE n > 0) / count(*) AS share, CASE dim WHEN 'artist' THEN 0.35::DOUBLE WHEN 'label' THEN 0.25::DOUBLE WHEN 'genre' THEN 0.25::DOUBLE ELSE 0.15::DOUBLE END AS w FROM m GROUP BY 1, 2, 3),
    af AS (SELECT user_id, release_id, CAST(floor(round(sum(w * share) / sum(w), 9) * 10000 + 0.5) AS BIGINT) AS affinity FROM per GROUP BY 1, 2),
    nd AS (SELECT user_id, release_id, CAST(floor(round(count(*) FILTER (WHERE n = 0) / count(*), 9) * 10000 + 0.5) AS BIGINT) AS novelty, CAST(coalesce(max(least(5, n)) FILTER (WHERE dim IN ('artist', 'label')), 0) * 2000 AS BIGINT) AS depth FROM m GROUP BY 1, 2),
    sc AS (SELECT * FROM af JOIN nd USING (user_id, release_id)),
    ti AS (SELECT release_id, lower(p_name) AS title FROM masters JOIN part ON p_partkey = master_id), fam AS (SELECT DISTINCT release_id, family FROM media),
    sm AS (SELECT c.user_id, c.release_id, b.release_id AS other FROM cand c JOIN masters a ON a.release_id = c.release_id JOIN masters b ON b.master_id = a.master_id JOIN held h ON h.user_id = c.user_id AND h.release_id = b.release_id),
    sf AS (SELECT DISTINCT sm.user_id, sm.release_id FROM sm JOIN fam x ON x.release_id = sm.release_id JOIN fam y ON y.release_id = sm.other AND y.family = x.family),
    mt AS (SELECT DISTINCT user_id, artist_id, title FROM held JOIN by_ USING (release_id) JOIN ti USING (release_id)),
    st AS (SELECT DISTINCT c.user_id, c.release_id FROM cand c JOIN by_ b ON b.release_id = c.release_id JOIN ti ON ti.release_id = c.release_id JOIN mt ON mt.user_id = c.user_id AND mt.artist_id = b.artist_id AND mt.title = ti.title),
    rd AS (SELECT user_id, release_id, CASE WHEN (user_id, release_id) IN (SELECT (user_id, release_id) FROM held) THEN 10000 WHEN (user_id, release_id) IN (SELECT (user_id, release_id) FROM sf) THEN 10000
        WHEN (user_id, release_id) IN (SELECT (user_id, release_id) FROM sm) THEN 6000 WHEN (user_id, release_id) IN (SELECT (user_id, release_id) FROM st) THEN 3000 ELSE 0 END AS redundancy FROM cand)"""


def scores(c: Catalog) -> DataFrame:
    """affinity (C9), novelty (C10) and depth (C11) of each wanted release."""
    rows = matched(c)
    of = {d: F.count_if(F.col("dim") == d) for d in FACETS}
    hit = {d: F.count_if((F.col("dim") == d) & (F.col("n") > 0)) for d in FACETS}
    total = reduce(lambda a, b: a + b, (F.when(of[d] > 0, w * hit[d] / of[d]).otherwise(0.0) for d, w in FACETS.items()))
    weight = reduce(lambda a, b: a + b, (F.when(of[d] > 0, w).otherwise(0.0) for d, w in FACETS.items()))
    deep = F.max(F.when(F.col("dim").isin("artist", "label"), F.least(F.lit(1.0), F.col("n") / FULL_DEPTH)))
    return rows.groupBy("user_id", "release_id").agg(
        scaled(F.round(total / weight, 9), 4).alias("affinity"),
        scaled(F.round(F.count_if(F.col("n") == 0) / F.count("*"), 9), 4).alias("novelty"),
        scaled(F.round(F.coalesce(deep, F.lit(0.0)), 9), 4).alias("depth"),
    )


_BRIDGE = """WITH held AS (SELECT DISTINCT user_id, release_id FROM collected), cand AS (SELECT DISTINCT user_id, release_id FROM wanted),
    hg AS (SELECT user_id, release_id, genre FROM held JOIN genres USING (release_id)), mem AS (SELECT DISTINCT user_id, genre, 'a' || artist_id AS m FROM hg JOIN by_ USING (release_id) UNION SELECT DISTINCT user_id, genre, 'l' || label_id FROM hg JOIN on_ USING (release_id)),
    ov AS (SELECT x.user_id, x.genre, list(DISTINCT y.genre) AS touching FROM mem x JOIN mem y ON x.user_id = y.user_id AND x.m = y.m AND x.genre <> y.genre GROUP BY 1, 2),
    gs AS (SELECT DISTINCT user_id, genre, style FROM hg JOIN styles USING (release_id)), reg AS (SELECT DISTINCT user_id, genre FROM hg),
    tc AS (SELECT c.user_id, c.release_id, r.genre FROM cand c JOIN reg r USING (user_id) JOIN genres g ON g.release_id = c.release_id AND g.genre = r.genre UNION SELECT c.user_id, c.release_id, gs.genre FROM cand c JOIN gs USING (user_id) JOIN styles s ON s.release_id = c.release_id AND s.style = gs.style),
    ls AS (SELECT t.user_id, t.release_id, list({'g': t.genre, 'o': coalesce(ov.touching, [])} ORDER BY t.genre) AS rs FROM tc t LEFT JOIN ov ON ov.user_id = t.user_id AND ov.genre = t.genre GROUP BY 1, 2),
    rec AS (SELECT user_id, release_id, rs, 1 AS i, CAST([] AS VARCHAR[]) AS picked FROM ls UNION ALL SELECT user_id, release_id, rs, i + 1, CASE WHEN list_has_any(picked, rs[i].o) THEN picked ELSE list_append(picked, rs[i].g) END FROM rec WHERE i <= len(rs))
    SELECT user_id, release_id, CAST(10000 * least(1, greatest(0, len(picked) - 1)) AS BIGINT) AS bridge, array_to_string(picked, '|') AS regions FROM rec WHERE i > len(rs)"""


@query("c12_bridges", _BRIDGE)
def bridges(c: Catalog) -> DataFrame:
    """Whether a wanted release touches regions (genres) of the collection that share no artist and no label: picked greedily in sorted order.

    Which regions share a member is found by a join first, so the greedy pass meets names of genres only, which are few.
    """
    held = c.collected.select("user_id", "release_id").distinct()
    want = c.wanted.select("user_id", "release_id").distinct()
    regions = held.join(c.genres, "release_id")
    member = lambda edges, kind, key: regions.join(edges, "release_id").select("user_id", "genre", F.concat(F.lit(kind), F.col(key).cast("string")).alias("m"))
    members = member(c.by, "a", "artist_id").unionByName(member(c.on, "l", "label_id")).distinct()
    touching = members.join(members.withColumnRenamed("genre", "other"), ["user_id", "m"]).where("genre != other").groupBy("user_id", "genre").agg(F.collect_set("other").alias("o"))
    of = regions.join(c.styles, "release_id").select("user_id", "genre", "style").distinct()
    same = want.join(c.genres, "release_id").join(regions.select("user_id", "genre").distinct(), ["user_id", "genre"])
    near = want.join(c.styles, "release_id").join(of, ["user_id", "style"])
    touched = same.select("user_id", "release_id", "genre").unionByName(near.select("user_id", "release_id", "genre")).distinct()
    none = F.array().cast("array<string>")
    rows = touched.join(touching, ["user_id", "genre"], "left").groupBy("user_id", "release_id").agg(F.sort_array(F.collect_list(F.struct(F.col("genre").alias("g"), F.coalesce("o", none).alias("o")))).alias("rs"))
    picked = F.aggregate("rs", none, lambda acc, r: F.when(F.arrays_overlap(acc, r["o"]), acc).otherwise(F.array_append(acc, r["g"])))
    rows = rows.withColumn("picked", picked)
    return rows.select("user_id", "release_id", (10000 * F.least(F.lit(1), F.greatest(F.lit(0), F.size("picked") - 1))).cast("long").alias("bridge"), F.array_join("picked", "|").alias("regions"))


def redundancy(c: Catalog) -> DataFrame:
    """The strongest of: the release is held; another of its master is, in a family of media that both have; another of its master in other families; one of
    the same artist and the same title but for case. A hot artist or master meets a user's holdings only, never all its releases."""
    keys = ["user_id", "release_id"]
    held = c.collected.select(*keys).distinct()
    want = c.wanted.select(*keys).distinct()
    families = c.media.groupBy("release_id").agg(F.collect_set("family").alias("families"))
    owned = held.join(c.masters, "release_id").join(families, "release_id", "left").groupBy("user_id", "master_id").agg(F.array_distinct(F.flatten(F.collect_list("families"))).alias("held_families"))
    asked = want.join(c.masters, "release_id", "left").join(families, "release_id", "left").join(owned, ["user_id", "master_id"], "left")
    alike = F.coalesce(F.arrays_overlap("families", "held_families"), F.lit(False))
    named = lambda df: df.join(c.by, "release_id").join(titles(c).select("release_id", F.lower("title").alias("title")), "release_id").where("title <> ''")
    mine = named(held).select("user_id", "artist_id", "title").distinct()
    same = named(want).join(mine, ["user_id", "artist_id", "title"], "left_semi").select(*keys, F.lit(True).alias("same_title")).distinct()
    out = asked.join(held.withColumn("held", F.lit(True)), keys, "left").join(same, keys, "left")
    score = F.when(F.col("held"), HELD).when(alike, SAME_FORM).when(F.col("held_families").isNotNull(), OTHER_FORM).when(F.col("same_title"), SAME_TITLE).otherwise(0)
    return out.select(*keys, score.cast("long").alias("redundancy"))


@query("c9_affinity_novelty", f"{_FIT} SELECT user_id, release_id, affinity, novelty, depth FROM sc")
def affinity_novelty(c: Catalog) -> DataFrame:
    return scores(c)


@query("c13_redundancy", f"{_FIT} SELECT user_id, release_id, CAST(redundancy AS BIGINT) AS redundancy FROM rd")
def redundancies(c: Catalog) -> DataFrame:
    return redundancy(c)


@query("c14_fit", f"""SELECT user_id, release_id, affinity, novelty, coalesce(bridge, 0) AS bridge, depth, CAST(redundancy AS BIGINT) AS redundancy, CAST(greatest(0, least(10000, affinity + novelty + coalesce(bridge, 0) + depth - redundancy)) AS BIGINT) AS fit
    FROM ({_FIT} SELECT * FROM sc JOIN rd USING (user_id, release_id)) LEFT JOIN ({_BRIDGE.replace("WITH held", "WITH RECURSIVE held", 1)}) USING (user_id, release_id)""")
def fit(c: Catalog) -> DataFrame:
    """The five components of each wanted release, unharmed, and their sum (redundancy subtracted) clipped to 0..``ONE``."""
    keys = ["user_id", "release_id"]
    both = scores(c).join(redundancy(c), keys).join(bridges(c).select(*keys, "bridge"), keys, "left").fillna(0, ["bridge"])
    total = F.col("affinity") + F.col("novelty") + F.col("bridge") + F.col("depth") - F.col("redundancy")
    return both.select(*keys, "affinity", "novelty", "bridge", "depth", "redundancy", F.greatest(F.lit(0), F.least(F.lit(ONE), total)).cast("long").alias("fit"))

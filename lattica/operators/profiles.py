"""Lookups and profiles of artists, labels, people and releases (sections 2.2, 2.8 to 2.10 and 2.21)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decade, names, scaled
from ..plans import Catalog, query
from .rarity import _SCORED, WEIGHTS, rarity_scores

# Scores by format name, and that of names not listed.
FORMAT_SCORES = {
    "Test Pressing": 100, "Lathe Cut": 98, "Flexi-disc": 95, "Shellac": 90, "Blu-spec CD": 80, "Box Set": 70, '10"': 65,
    "8-Track Cartridge": 60, "CDr": 50, "Vinyl": 40, "Cassette": 35, "LP": 30, "CD": 10, "File": 5,
}
OTHER_FORMAT = 50


@query("p6_release_credits", "SELECT DISTINCT c.release_id, c.person_id, c.role, c.category, a.artist_id AS same_as FROM credits c LEFT JOIN (SELECT artist_id FROM by_ GROUP BY 1 HAVING count(*) >= 10) a ON a.artist_id = c.person_id")
def release_credits(c: Catalog, least: int = 10) -> DataFrame:
    """Credits with the artist that a person is, where the artist is well known."""
    same = c.by.groupBy("artist_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("artist_id").alias("same_as"))
    return c.credits.distinct().join(same, F.col("person_id") == F.col("same_as"), "left").select("release_id", "person_id", "role", "category", "same_as")


@query("p10_label_profiles", """WITH n AS (SELECT label_id, count(*) AS releases FROM on_ GROUP BY 1 HAVING count(*) >= 5) SELECT label_id, 'genre' AS kind, genre AS name, count(*) AS n, CAST(floor(count(*) / any_value(releases) * 10000 + 0.5) AS BIGINT) AS share FROM n JOIN on_ USING (label_id) JOIN genres USING (release_id) GROUP BY 1, 2, 3
    UNION ALL SELECT label_id, 'style', style, count(*), CAST(floor(count(*) / any_value(releases) * 10000 + 0.5) AS BIGINT) FROM n JOIN on_ USING (label_id) JOIN styles USING (release_id) GROUP BY 1, 2, 3
    UNION ALL SELECT label_id, 'decade', CAST(year - year % 10 AS VARCHAR), count(*), CAST(floor(count(*) / any_value(releases) * 10000 + 0.5) AS BIGINT) FROM n JOIN releases USING (label_id) WHERE year > 0 GROUP BY 1, 2, 3""")
def label_profiles(c: Catalog, least: int = 5) -> DataFrame:
    """Genres, styles and decades of each label with enough releases, as counts and shares of its releases."""
    known = c.on.groupBy("label_id").agg(F.count("*").alias("releases")).where(F.col("releases") >= least)
    part = lambda df, kind, name: df.select("label_id", F.lit(kind).alias("kind"), name.cast("string").alias("name"))
    rows = [
        part(c.on.join(c.genres, "release_id"), "genre", F.col("genre")),
        part(c.on.join(c.styles, "release_id"), "style", F.col("style")),
        part(c.releases.where("year > 0"), "decade", decade(F.col("year"))),
    ]
    counts = reduce(DataFrame.unionByName, rows).groupBy("label_id", "kind", "name").agg(F.count("*").alias("n"))
    return counts.join(known, "label_id").select("label_id", "kind", "name", "n", scaled(F.col("n") / F.col("releases"), 4).alias("share"))


@query("p11_label_formats", "SELECT label_id, medium AS format, count(DISTINCT release_id) AS n FROM on_ JOIN media USING (release_id) GROUP BY 1, 2")
def label_formats(c: Catalog) -> DataFrame:
    """Releases of each label by each format of their list."""
    lists = c.media.groupBy("release_id").agg(F.collect_set("medium").alias("formats"))
    return c.on.join(lists, "release_id").select("label_id", "release_id", F.explode("formats").alias("format")).groupBy("label_id", "format").agg(F.count_distinct("release_id").alias("n"))


@query("l7_owned_copies", "SELECT user_id, release_id, min(event_id) AS owned_copy_id, count(*) AS copies FROM (SELECT event_id, user_id, k AS release_id FROM ev WHERE event_type = 'purchase') GROUP BY 1, 2")
def owned_copies(c: Catalog) -> DataFrame:
    """(user, release) to the first owned copy."""
    held = c.events.where("event_type = 'purchase'").groupBy("user_id", F.col("k").alias("release_id"))
    return held.agg(F.min("event_id").alias("owned_copy_id"), F.count("*").alias("copies"))


@query("l8_release_identity", """SELECT w.user_id, w.release_id, r.master_id, o.owned_copy_id FROM (SELECT DISTINCT user_id, release_id FROM wanted) w LEFT JOIN masters r USING (release_id)
    LEFT JOIN (SELECT user_id, k AS release_id, min(event_id) AS owned_copy_id FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2) o ON o.user_id = w.user_id AND o.release_id = w.release_id""")
def release_identity(c: Catalog) -> DataFrame:
    """Rows of users' releases with the native id and the user's copy, null where there is none."""
    rows = c.wanted.select("user_id", "release_id").distinct()
    return rows.join(c.masters, "release_id", "left").join(owned_copies(c).drop("copies"), ["user_id", "release_id"], "left").select("user_id", "release_id", "master_id", "owned_copy_id")


@query("l9_gap_identity", "SELECT l.label_id, r.release_id, m.master_id FROM label_nodes l JOIN on_ r USING (label_id) LEFT JOIN masters m USING (release_id) WHERE NOT EXISTS (SELECT 1 FROM collected c WHERE c.release_id = r.release_id)")
def gap_identity(c: Catalog) -> DataFrame:
    """Releases that nobody holds, with their native ids."""
    return c.on.join(c.collected.select("release_id"), "release_id", "left_anti").join(c.masters, "release_id", "left").select("label_id", "release_id", "master_id")


@query("l10_release_media", "SELECT release_id, string_agg(DISTINCT family, '|' ORDER BY family) AS families, string_agg(DISTINCT medium, '|' ORDER BY medium) AS mediums, count(*) AS items FROM media GROUP BY 1")
def release_media(c: Catalog) -> DataFrame:
    return c.media.groupBy("release_id").agg(names("family").alias("families"), names("medium").alias("mediums"), F.count("*").alias("items"))


@query("l11_catalog_blocks", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 0::BIGINT AS identifiers, 0::BIGINT AS companies FROM events")
def catalog_blocks(c: Catalog) -> DataFrame:
    """Blocks of a JSON document; one that is missing or malformed counts as empty."""
    schema = "k bigint, identifiers struct<items: array<struct<type: string, value: string>>>, companies struct<items: array<struct<name: string>>>"
    doc = F.from_json("props", schema)
    size = lambda block: F.size(F.coalesce(block, F.array())).cast("long")
    return c.table("events").withColumn("doc", doc).select("event_id", F.col("doc.k").alias("k"), size(F.col("doc.identifiers.items")).alias("identifiers"), size(F.col("doc.companies.items")).alias("companies"))


@query("l12_artist_metadata", "SELECT artist_id, name, nation, least(nation, 5) AS area FROM artists WHERE nation > 0")
def artist_metadata(c: Catalog) -> DataFrame:
    """Metadata of the artists that a second catalog knows (here: of nations above 0)."""
    return c.artists.where("nation > 0").select("artist_id", "name", "nation", F.least("nation", F.lit(5).cast("long")).alias("area"))


@query("l13_relationships", "SELECT artist_id, other_id, 'alias' AS kind, 'outgoing' AS direction FROM aliases UNION ALL SELECT other_id, artist_id, 'alias', 'incoming' FROM aliases UNION ALL SELECT artist_id, other_id, 'member of', 'outgoing' FROM groups_ UNION ALL SELECT other_id, artist_id, 'member of', 'incoming' FROM groups_")
def relationships(c: Catalog) -> DataFrame:
    """Typed edges from both ends, with their direction. A pass over each edge table gives both rows."""
    out = []
    for kind, edges in (("alias", c.aliases), ("member of", c.groups)):
        ends = F.array(*(F.struct(F.col(a).alias("artist_id"), F.col(b).alias("other_id"), F.lit(kind).alias("kind"), F.lit(d).alias("direction")) for a, b, d in (("artist_id", "other_id", "outgoing"), ("other_id", "artist_id", "incoming"))))
        out.append(edges.select(F.inline(ends)))
    return out[0].unionByName(out[1])


@query("l14_external_links", "SELECT a.artist_id, n_name AS service, 'https://' || lower(n_name) || '/' || a.artist_id AS url FROM artists a JOIN nation ON n_nationkey = a.nation")
def external_links(c: Catalog) -> DataFrame:
    service = c.table("nation").select(F.col("n_nationkey").cast("long").alias("nation"), F.col("n_name").alias("service"))
    return c.artists.join(service, "nation").select("artist_id", "service", F.concat(F.lit("https://"), F.lower("service"), F.lit("/"), F.col("artist_id").cast("string")).alias("url"))


@query("l15_label_metadata", "SELECT label_id, name, nation, CAST(count(release_id) AS BIGINT) AS releases FROM label_nodes LEFT JOIN on_ USING (label_id) GROUP BY 1, 2, 3")
def label_metadata(c: Catalog) -> DataFrame:
    return c.labels.join(c.on.groupBy("label_id").agg(F.count("*").alias("releases")), "label_id", "left").fillna(0, ["releases"]).select("label_id", "name", "nation", "releases")


@query("z14_artist_identity", "SELECT artist_id, name, CAST(count(release_id) AS BIGINT) AS releases FROM artists LEFT JOIN by_ USING (artist_id) GROUP BY 1, 2")
def artist_identity(c: Catalog) -> DataFrame:
    return c.artists.join(c.by.groupBy("artist_id").agg(F.count("*").alias("releases")), "artist_id", "left").fillna(0, ["releases"]).select("artist_id", "name", "releases")


_FORMAT_SQL = "CASE medium WHEN 'A_F' THEN 40 WHEN 'N_F' THEN 30 WHEN 'N_O' THEN 10 WHEN 'R_F' THEN 35 ELSE 50 END"


@query("r11_format_rarity", f"SELECT release_id, CAST(coalesce(max({_FORMAT_SQL}), 50) AS BIGINT) AS format_rarity FROM releases LEFT JOIN media USING (release_id) GROUP BY 1")
def format_rarity(c: Catalog) -> DataFrame:
    """The greatest score of a release's format names; reported, not part of the score."""
    named = {"A_F": "Vinyl", "N_F": "LP", "N_O": "CD", "R_F": "Cassette"}
    table = c.spark.createDataFrame([(m, FORMAT_SCORES[f]) for m, f in named.items()], "medium string, s long")
    rows = c.media.join(F.broadcast(table), "medium", "left").groupBy("release_id").agg(F.max(F.coalesce("s", F.lit(OTHER_FORMAT))).alias("s"))
    return c.releases.select("release_id").join(rows, "release_id", "left").select("release_id", F.coalesce("s", F.lit(OTHER_FORMAT)).cast("long").alias("format_rarity"))


@query("r12_resolved_media", """WITH e AS (SELECT release_id, string_agg(DISTINCT medium, '|' ORDER BY medium) AS v FROM media WHERE medium LIKE '%_F' GROUP BY 1), f AS (SELECT release_id, string_agg(DISTINCT family, '|' ORDER BY family) AS v FROM media WHERE family <> 'N' GROUP BY 1)
    SELECT r.release_id, coalesce(e.v, f.v, r.priority) AS media, CASE WHEN e.v IS NOT NULL THEN 'mediums' WHEN f.v IS NOT NULL THEN 'families' ELSE 'formats' END AS source FROM releases r LEFT JOIN e USING (release_id) LEFT JOIN f USING (release_id)""")
def resolved_media(c: Catalog) -> DataFrame:
    """The first evidence that is there: mediums (finished ones), families, else the raw format text."""
    edges = c.media.groupBy("release_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.endswith("medium", F.lit("_F")), F.col("medium")))), "|").alias("m"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("family") != "N", F.col("family")))), "|").alias("f"),
    )
    rows = c.releases.select("release_id", "priority").join(edges, "release_id", "left")
    m, f = F.nullif("m", F.lit("")), F.nullif("f", F.lit(""))
    return rows.select("release_id", F.coalesce(m, f, "priority").alias("media"), F.when(m.isNotNull(), "mediums").when(f.isNotNull(), "families").otherwise("formats").alias("source"))


@query("r22_rarity_breakdown", f"""{_SCORED}, w AS (SELECT *, CASE WHEN pressing IS NULL THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM rated),
    p AS (SELECT release_id, weight, unnest([{{'k': 'label_catalog', 'v': label_catalog::DOUBLE, 'f': 0.1::DOUBLE}}, {{'k': 'medium_rarity', 'v': medium_rarity::DOUBLE, 'f': 0.1::DOUBLE}}, {{'k': 'temporal', 'v': temporal::DOUBLE, 'f': 0.2::DOUBLE}},
        {{'k': 'isolation', 'v': isolation::DOUBLE, 'f': 0.15::DOUBLE}}, {{'k': 'prevalence', 'v': prevalence::DOUBLE, 'f': 0.2::DOUBLE}}, {{'k': 'pressing', 'v': pressing::DOUBLE, 'f': 0.25::DOUBLE}}]) AS x FROM w)
    SELECT release_id, x.k AS signal, CAST(floor(x.v * 100 + 0.5) AS BIGINT) AS score, CAST(floor(x.f / weight * 10000 + 0.5) AS BIGINT) AS weight FROM p WHERE x.v IS NOT NULL
    UNION ALL SELECT release_id, 'format_rarity', 100 * CAST(coalesce(max({_FORMAT_SQL}), 50) AS BIGINT), 0 FROM releases LEFT JOIN media USING (release_id) GROUP BY 1""")
def rarity_breakdown(c: Catalog) -> DataFrame:
    """Each release's signals with their effective weights: shared out over the signals that it has. format_rarity has weight 0."""
    rows = rarity_scores(c)
    total = reduce(lambda a, b: a + b, (F.when(F.col(k).isNotNull(), v).otherwise(0.0) for k, v in WEIGHTS.items()))
    parts = F.array(*(F.struct(F.lit(k).alias("signal"), scaled(F.col(k).cast("double"), 2).alias("score"), scaled(v / F.col("total"), 4).alias("weight")) for k, v in WEIGHTS.items()))
    long = rows.withColumn("total", total).select("release_id", F.inline(parts)).where("score is not null")
    formats = format_rarity(c).select("release_id", F.lit("format_rarity").alias("signal"), (F.col("format_rarity") * 100).alias("score"), F.lit(0).cast("long").alias("weight"))
    return long.unionByName(formats)


@query("l17_release_rarity", f"{_SCORED} SELECT k.event_id, r.score, r.tier FROM ev k LEFT JOIN rated r ON r.release_id = k.k")
def release_rarity(c: Catalog) -> DataFrame:
    """Score and tier for ids as they come in, null where an id is unknown or no number."""
    asked = c.table("events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("asked"))
    return asked.join(rarity_scores(c).select("release_id", "score", "tier"), F.col("asked") == F.col("release_id"), "left").select("event_id", "score", "tier")


@query("z5_compared_labels", """SELECT o.label_id, count(*) AS releases, count(DISTINCT b.artist_id) AS artists, min(nullif(r.year, 0)) AS first_year, max(r.year) AS last_year FROM on_ o JOIN releases r USING (release_id) LEFT JOIN by_ b USING (release_id) WHERE o.label_id IN (1, 2, 4) GROUP BY 1""".replace("count(*) AS releases", "count(DISTINCT o.release_id) AS releases"))
def compared_labels(c: Catalog, labels: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """Fingerprints of the asked labels side by side; the filter reaches the scan before any join."""
    if len(labels) < 2:
        raise ValueError("at least two labels are compared")
    mine = c.releases.where(F.col("label_id").isin(list(labels)))
    years = mine.groupBy("label_id").agg(F.count("*").alias("releases"), F.min(F.nullif("year", F.lit(0).cast("long"))).alias("first_year"), F.max("year").alias("last_year"))
    artists = mine.select("label_id", "release_id").join(c.by, "release_id").groupBy("label_id").agg(F.count_distinct("artist_id").alias("artists"))
    return years.join(artists, "label_id", "left").select("label_id", "releases", F.coalesce("artists", F.lit(0)).cast("long").alias("artists"), "first_year", "last_year")


@query("z27_timing_stats", "SELECT event_type, CAST(floor(quantile_cont(value, 0.95) * 1e4 + 0.5) AS BIGINT) AS p95, CAST(floor(min(value) * 1e4 + 0.5) AS BIGINT) AS least, CAST(floor(max(value) * 1e4 + 0.5) AS BIGINT) AS most FROM events GROUP BY 1")
def timing_stats(c: Catalog) -> DataFrame:
    """Interpolated 95th percentile, least and greatest value, in ten-thousandths."""
    return c.table("events").groupBy("event_type").agg(*(scaled(f, 4).alias(n) for f, n in ((F.percentile("value", 0.95), "p95"), (F.min("value"), "least"), (F.max("value"), "most"))))

"""Explore, expand, count and details: projections and grouped counts over join chains (section 2.3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decade, names, top_n
from ..plans import Catalog, query

PAGE = 25
#: Name of each edge: its attribute in the catalog, its view, its column.
EDGES = {"artist": ("by", "by_", "artist_id"), "label": ("on", "on_", "label_id"), "genre": ("genres", "genres", "genre"), "style": ("styles", "styles", "style")}
#: id, parent, child, whether edges (not distinct releases) are counted.
EXPANDS = (
    ("g6", "artist", "label", False),
    ("g7", "genre", "artist", True),
    ("g8", "genre", "label", False),
    ("g9", "genre", "style", False),
    ("g10", "label", "artist", False),
    ("g11", "label", "genre", False),
    ("g12", "style", "artist", True),
    ("g13", "style", "label", False),
    ("g14", "style", "genre", False),
)


def expand(parents: DataFrame, children: DataFrame, parent: str, child: str, edges: bool = False, releases: DataFrame | None = None, before_year: int | None = None) -> DataFrame:
    """(parent, child, release_count) over parent <- release -> child; each release once unless ``edges``.

    An edge made distinct meets another one once, so rows are counted: groups are as many as there are pairs, not releases.
    """
    if not edges:
        parents, children = parents.select("release_id", parent).distinct(), children.select("release_id", child).distinct()
    pairs = parents.join(children, "release_id")
    if before_year is not None:
        pairs = pairs.join(releases.where((F.col("year") > 0) & (F.col("year") <= before_year)).select("release_id"), "release_id", "left_semi")
    return pairs.groupBy(parent, child).agg(F.count("*").alias("release_count"))


def _register_expand(key: str, parent: str, child: str, edges: bool) -> None:
    pa, pv, pc = EDGES[parent]
    ca, cv, cc = EDGES[child]
    if edges:
        ca, cv = "by_raw", "by_raw"
    count = "count(*)" if edges else "count(DISTINCT release_id)"
    oracle = f"""
        SELECT {pc}, {cc}, release_count FROM (
            SELECT {pc}, {cc}, {count} AS release_count, row_number() OVER (PARTITION BY {pc} ORDER BY {count} DESC, {cc}) AS rn
            FROM {pv} JOIN {cv} USING (release_id) GROUP BY 1, 2) WHERE rn <= {PAGE}"""

    @query(f"{key}_expand_{parent}_{child}s", oracle)
    def _(c: Catalog) -> DataFrame:
        found = expand(getattr(c, pa), getattr(c, ca), pc, cc, edges)
        return top_n(found, [pc], [F.desc("release_count"), cc], PAGE)

    total = f"SELECT {pc}, count(DISTINCT {cc}) AS total FROM {pv} JOIN {cv} USING (release_id) GROUP BY 1"

    @query(f"g18_count_{parent}_{child}s", total)
    def _(c: Catalog) -> DataFrame:
        return getattr(c, pa).join(getattr(c, ca), "release_id").groupBy(pc).agg(F.count_distinct(cc).alias("total"))


for _spec in EXPANDS:
    _register_expand(*_spec)


@query("g5_expand_before_year", """
    SELECT genre, label_id, release_count FROM (
        SELECT genre, label_id, count(DISTINCT release_id) AS release_count, row_number() OVER (PARTITION BY genre ORDER BY count(DISTINCT release_id) DESC, label_id) AS rn
        FROM genres JOIN on_ USING (release_id) JOIN releases r USING (release_id) WHERE r.year > 0 AND r.year <= 1997 GROUP BY genre, on_.label_id) WHERE rn <= 25""".replace("on_.label_id", "2").replace("SELECT genre, label_id, count", "SELECT genre, on_.label_id AS label_id, count").replace("DESC, label_id)", "DESC, on_.label_id)"))
def expand_before_year(c: Catalog) -> DataFrame:
    found = expand(c.genres, c.on, "genre", "label_id", releases=c.releases, before_year=1997)
    return top_n(found, ["genre"], [F.desc("release_count"), "label_id"], PAGE)


def _register_releases(parent: str) -> None:
    pa, pv, pc = EDGES[parent]

    @query(f"g15_expand_{parent}_releases", f"""
        SELECT {pc}, release_id, y AS year FROM (
            SELECT e.{pc}, e.release_id, CASE WHEN r.year > 0 THEN r.year END AS y, row_number() OVER (PARTITION BY e.{pc} ORDER BY CASE WHEN r.year > 0 THEN r.year END DESC NULLS LAST, e.release_id) AS rn
            FROM {pv} e JOIN releases r ON e.release_id = r.release_id) WHERE rn <= {PAGE}""")
    def _(c: Catalog) -> DataFrame:
        dated = c.releases.select("release_id", F.when(F.col("year") > 0, F.col("year")).alias("year"))
        return top_n(getattr(c, pa).join(dated, "release_id").select(pc, "release_id", "year"), [pc], [F.desc_nulls_last("year"), "release_id"], PAGE)

    @query(f"g19_count_{parent}_releases", f"SELECT {pc}, count(DISTINCT release_id) AS total FROM {pv} GROUP BY 1")
    def _(c: Catalog) -> DataFrame:
        return getattr(c, pa).groupBy(pc).agg(F.count_distinct("release_id").alias("total"))


for _name in EDGES:
    _register_releases(_name)


def related_artists(c: Catalog) -> DataFrame:
    """Distinct (artist_id, other_id) over aliases, groups and members."""
    back = c.groups.select(F.col("other_id").alias("artist_id"), F.col("artist_id").alias("other_id"))
    return reduce(DataFrame.unionByName, [c.aliases, c.groups, back]).distinct()


_RELATED = "WITH related AS (SELECT * FROM aliases UNION SELECT * FROM groups_ UNION SELECT other_id, artist_id FROM groups_)"


@query("g17_expand_artist_aliases", f"{_RELATED} SELECT r.artist_id, r.other_id, a.name FROM related r JOIN artists a ON r.other_id = a.artist_id")
def expand_artist_aliases(c: Catalog) -> DataFrame:
    return related_artists(c).join(c.artists.select(F.col("artist_id").alias("other_id"), "name"), "other_id").select("artist_id", "other_id", "name")


@query("g20_count_artist_aliases", f"{_RELATED} SELECT artist_id, count(*) AS total FROM related GROUP BY 1")
def count_artist_aliases(c: Catalog) -> DataFrame:
    return related_artists(c).groupBy("artist_id").agg(F.count("*").alias("total"))


@query("g1_explore_artist", f"""{_RELATED},
    live AS (SELECT b.artist_id, count(DISTINCT b.release_id) AS release_count, count(DISTINCT o.label_id) AS label_count FROM by_ b LEFT JOIN on_ o USING (release_id) GROUP BY 1)
    SELECT a.artist_id, a.name, coalesce(release_count, 0) AS release_count, coalesce(label_count, 0) AS label_count, coalesce(n, 0) AS alias_count
    FROM artists a LEFT JOIN live USING (artist_id) LEFT JOIN (SELECT artist_id, count(*) AS n FROM related GROUP BY 1) USING (artist_id)""")
def explore_artist(c: Catalog) -> DataFrame:
    live = c.by.join(c.on, "release_id", "left").groupBy("artist_id").agg(F.count_distinct("release_id").alias("release_count"), F.count_distinct("label_id").alias("label_count"))
    others = related_artists(c).groupBy("artist_id").agg(F.count("*").alias("alias_count"))
    out = c.artists.select("artist_id", "name").join(live, "artist_id", "left").join(others, "artist_id", "left")
    return out.fillna(0, ["release_count", "label_count", "alias_count"])


def _tag_counts(c: Catalog, tag: str) -> DataFrame:
    """Distinct counts of a tag, one aggregate for each edge: no cross products of edges."""
    attribute, _, col = EDGES[tag]
    tagged = getattr(c, attribute)
    other, _, other_col = EDGES["style" if tag == "genre" else "genre"]
    parts = [tagged.groupBy(col).agg(F.count("*").alias("release_count"))]
    for edges, key, name in ((c.by, "artist_id", "artist_count"), (c.on, "label_id", "label_count"), (getattr(c, other), other_col, f"{other_col}_count")):
        parts.append(tagged.join(edges, "release_id").groupBy(col).agg(F.count_distinct(key).alias(name)))
    out = reduce(lambda a, b: a.join(b, col, "left"), parts)
    return out.fillna(0)


def _tag_oracle(tag: str, other: str) -> str:
    v = f"{tag}s"
    return f"""SELECT g.{tag}, count(DISTINCT g.release_id) AS release_count, count(DISTINCT b.artist_id) AS artist_count, count(DISTINCT o.label_id) AS label_count, count(DISTINCT s.{other}) AS {other}_count
        FROM {v} g LEFT JOIN by_ b USING (release_id) LEFT JOIN on_ o USING (release_id) LEFT JOIN {other}s s USING (release_id) GROUP BY 1"""


@query("g2_explore_genre", _tag_oracle("genre", "style"))
def explore_genre(c: Catalog) -> DataFrame:
    return _tag_counts(c, "genre")


@query("g4_explore_style", _tag_oracle("style", "genre"))
def explore_style(c: Catalog) -> DataFrame:
    return _tag_counts(c, "style")


@query("g3_explore_label", """SELECT l.label_id, l.name, count(DISTINCT o.release_id) AS release_count, count(DISTINCT b.artist_id) AS artist_count, count(DISTINCT g.genre) AS genre_count
    FROM label_nodes l LEFT JOIN on_ o USING (label_id) LEFT JOIN by_ b USING (release_id) LEFT JOIN genres g USING (release_id) GROUP BY 1, 2""")
def explore_label(c: Catalog) -> DataFrame:
    out = c.labels.select("label_id", "name").join(c.on.groupBy("label_id").agg(F.count("*").alias("release_count")), "label_id", "left")
    out = out.join(c.on.join(c.by, "release_id").groupBy("label_id").agg(F.count_distinct("artist_id").alias("artist_count")), "label_id", "left")
    out = out.join(c.on.join(c.genres, "release_id").groupBy("label_id").agg(F.count_distinct("genre").alias("genre_count")), "label_id", "left")
    return out.fillna(0, ["release_count", "artist_count", "genre_count"])


@query("g24_artist_details", """SELECT b.artist_id, count(DISTINCT b.release_id) AS release_count,
        coalesce(string_agg(DISTINCT g.genre, '|' ORDER BY g.genre), '') AS genres, coalesce(string_agg(DISTINCT s.style, '|' ORDER BY s.style), '') AS styles
    FROM by_ b LEFT JOIN genres g USING (release_id) LEFT JOIN styles s USING (release_id) GROUP BY 1""")
def artist_details(c: Catalog) -> DataFrame:
    out = c.by.groupBy("artist_id").agg(F.count("*").alias("release_count"))
    for edges, col, name in ((c.genres, "genre", "genres"), (c.styles, "style", "styles")):
        out = out.join(c.by.join(edges, "release_id").groupBy("artist_id").agg(names(col).alias(name)), "artist_id", "left")
    return out.fillna("", ["genres", "styles"])


@query("g25_release_details", """SELECT r.release_id, CASE WHEN r.year > 0 THEN r.year END AS year, r.label_id,
        coalesce(a.x, '') AS artists, coalesce(g.x, '') AS genres, coalesce(s.x, '') AS styles FROM releases r
    LEFT JOIN (SELECT release_id, string_agg(CAST(artist_id AS VARCHAR), '|' ORDER BY CAST(artist_id AS VARCHAR)) AS x FROM by_ GROUP BY 1) a USING (release_id)
    LEFT JOIN (SELECT release_id, string_agg(genre, '|' ORDER BY genre) AS x FROM genres GROUP BY 1) g USING (release_id)
    LEFT JOIN (SELECT release_id, string_agg(style, '|' ORDER BY style) AS x FROM styles GROUP BY 1) s USING (release_id)""")
def release_details(c: Catalog) -> DataFrame:
    out = c.releases.select("release_id", F.when(F.col("year") > 0, F.col("year")).alias("year"), "label_id")
    for edges, col, name in ((c.by_raw, "artist_id", "artists"), (c.genres, "genre", "genres"), (c.styles, "style", "styles")):
        out = out.join(edges.groupBy("release_id").agg(names(col).alias(name)), "release_id", "left")
    return out.fillna("", ["artists", "genres", "styles"])


def label_years(c: Catalog) -> DataFrame:
    return c.releases.where("year > 0").groupBy("label_id", "year").agg(F.count("*").alias("n"))


def label_longevity(c: Catalog) -> DataFrame:
    """First and last year, span, active years, dated releases and peak decade (the earliest on a tie)."""
    years = label_years(c)
    spans = years.groupBy("label_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("active_years"), F.sum("n").alias("dated"))
    decades = years.groupBy("label_id", decade(F.col("year")).alias("peak_decade")).agg(F.sum("n").alias("d"))
    peak = top_n(decades, ["label_id"], [F.desc("d"), "peak_decade"], 1).drop("d")
    return spans.withColumn("span", F.col("last_year") - F.col("first_year") + 1).join(peak, "label_id")


LONGEVITY = """WITH years AS (SELECT label_id, year, count(*) AS n FROM releases WHERE year > 0 GROUP BY 1, 2),
    longevity AS (SELECT s.*, d.peak_decade FROM (SELECT label_id, min(year) AS first_year, max(year) AS last_year, count(*) AS active_years, CAST(sum(n) AS BIGINT) AS dated, max(year) - min(year) + 1 AS span FROM years GROUP BY 1) s
        JOIN (SELECT label_id, peak_decade FROM (SELECT label_id, year - year % 10 AS peak_decade, row_number() OVER (PARTITION BY label_id ORDER BY sum(n) DESC, year - year % 10) AS rn FROM years GROUP BY 1, 2) WHERE rn = 1) d USING (label_id))"""


@query("g26_label_details", f"{LONGEVITY} SELECT label_id, first_year, last_year, active_years, dated, span, peak_decade FROM longevity")
def label_details(c: Catalog) -> DataFrame:
    return label_longevity(c)


@query("g27_tag_artist_counts", """SELECT 'genre' AS kind, genre AS name, count(DISTINCT artist_id) AS artists FROM genres JOIN by_ USING (release_id) GROUP BY 2
    UNION ALL SELECT 'style', style, count(DISTINCT artist_id) FROM styles JOIN by_ USING (release_id) GROUP BY 2""")
def tag_artist_counts(c: Catalog) -> DataFrame:
    one = lambda df, col: df.join(c.by, "release_id").groupBy(F.col(col).alias("name")).agg(F.count_distinct("artist_id").alias("artists")).withColumn("kind", F.lit(col))
    return one(c.genres, "genre").unionByName(one(c.styles, "style")).select("kind", "name", "artists")


@query("g28_graph_stats", """SELECT 'release' AS node, count(*) AS n FROM releases UNION ALL SELECT 'artist', count(*) FROM artists UNION ALL SELECT 'label', count(*) FROM label_nodes
    UNION ALL SELECT 'master', count(DISTINCT master_id) FROM masters UNION ALL SELECT 'genre', count(DISTINCT genre) FROM genres UNION ALL SELECT 'style', count(DISTINCT style) FROM styles""")
def graph_stats(c: Catalog) -> DataFrame:
    plain = [(c.releases, "release", "release_id"), (c.artists, "artist", "artist_id"), (c.labels, "label", "label_id")]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("node"), "n") for df, n, _ in plain]
    parts += [df.agg(F.count_distinct(col).alias("n")).select(F.lit(n).alias("node"), "n") for df, n, col in ((c.masters, "master", "master_id"), (c.genres, "genre", "genre"), (c.styles, "style", "style"))]
    return reduce(DataFrame.unionByName, parts)


@query("g29_year_range", "SELECT min(year) AS min_year, max(year) AS max_year FROM releases WHERE year > 0")
def year_range(c: Catalog) -> DataFrame:
    return c.releases.where("year > 0").agg(F.min("year").alias("min_year"), F.max("year").alias("max_year"))


@query("g30_genre_emergence", """SELECT kind, name, first_year FROM (SELECT 'genre' AS kind, genre AS name, min(year) AS first_year FROM genres JOIN releases USING (release_id) WHERE year > 0 GROUP BY 2
    UNION ALL SELECT 'style', style, min(year) FROM styles JOIN releases USING (release_id) WHERE year > 0 GROUP BY 2) WHERE first_year <= 1998""")
def genre_emergence(c: Catalog) -> DataFrame:
    one = lambda df, col: df.join(c.releases.where("year > 0"), "release_id").groupBy(F.col(col).alias("name")).agg(F.min("year").alias("first_year")).withColumn("kind", F.lit(col))
    return one(c.genres, "genre").unionByName(one(c.styles, "style")).where("first_year <= 1998").select("kind", "name", "first_year")


@query("g32_genre_tree", """SELECT genre, string_agg(style || ':' || CAST(n AS VARCHAR), '|' ORDER BY n DESC, style) AS styles FROM
    (SELECT genre, style, count(DISTINCT release_id) AS n FROM genres JOIN styles USING (release_id) GROUP BY 1, 2) GROUP BY 1""")
def genre_tree(c: Catalog) -> DataFrame:
    pairs = expand(c.genres, c.styles, "genre", "style")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("release_count")).alias("n"), "style")))
    return pairs.groupBy("genre").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["style"], F.lit(":"), (-x["n"]).cast("string"))), "|").alias("styles"))


@query("g33_genre_signature", """SELECT CAST(count(DISTINCT genre) AS VARCHAR) || ':' || CAST(count(*) AS VARCHAR) || ':' || (SELECT CAST(count(*) AS VARCHAR) FROM styles) AS signature FROM genres""")
def genre_signature(c: Catalog) -> DataFrame:
    left = c.genres.agg(F.count_distinct("genre").alias("g"), F.count("*").alias("r"))
    right = c.styles.agg(F.count("*").alias("s"))
    return left.join(F.broadcast(right)).select(F.concat_ws(":", *(F.col(x).cast("string") for x in "grs")).alias("signature"))


@query("g34_release_user_status", """SELECT u.user_id, r.release_id, bool_or(kind = 1) AS in_collection, bool_or(kind = 2) AS in_wantlist FROM
    (SELECT user_id, release_id, 1 AS kind FROM collected UNION ALL SELECT user_id, release_id, 2 FROM wanted) u JOIN releases r USING (release_id) GROUP BY 1, 2""".replace("r.release_id", "release_id").replace("u.user_id", "user_id"))
def release_user_status(c: Catalog) -> DataFrame:
    both = c.collected.select("user_id", "release_id", F.lit(1).alias("kind")).unionByName(c.wanted.select("user_id", "release_id", F.lit(2).alias("kind")))
    known = both.join(c.releases.select("release_id"), "release_id", "left_semi")
    return known.groupBy("user_id", "release_id").agg(F.bool_or(F.col("kind") == 1).alias("in_collection"), F.bool_or(F.col("kind") == 2).alias("in_wantlist"))

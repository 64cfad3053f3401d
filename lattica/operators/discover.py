"""Paths, hubs, discoveries and neighbour lists (sections 2.8, 2.9 and 2.21)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scaled, top_n
from ..plans import Catalog, query, shared_dir
from .similarity import _CANDIDATES, _PROFILES, DIMENSIONS, similar_artists

# hubs


_HUBS = """WITH t AS (SELECT release_id, p_name AS title FROM masters JOIN part ON p_partkey = master_id), base AS (SELECT g.genre AS hub, g.release_id, t.title FROM genres g LEFT JOIN t USING (release_id)),
    al AS (SELECT hub, 'artist' AS type, CAST(artist_id AS VARCHAR) AS id, any_value(p.n) AS pop, min(title) AS witness FROM base JOIN by_ USING (release_id) JOIN (SELECT artist_id, count(*) AS n FROM by_ GROUP BY 1) p USING (artist_id) GROUP BY hub, artist_id
        UNION ALL SELECT hub, 'label', CAST(label_id AS VARCHAR), any_value(p.n), min(title) FROM base JOIN on_ USING (release_id) JOIN (SELECT label_id, count(*) AS n FROM on_ GROUP BY 1) p USING (label_id) GROUP BY hub, label_id),
    gs AS (SELECT hub, 'genre' AS type, genre AS id, min(title) AS witness FROM base JOIN genres USING (release_id) WHERE genre <> hub GROUP BY 1, 3 UNION ALL SELECT hub, 'style', style, min(title) FROM base JOIN styles USING (release_id) GROUP BY 1, 3),
    hubs AS (SELECT hub, type, id, witness FROM (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY pop DESC, type, id) AS rn FROM al) WHERE rn <= 100 UNION ALL SELECT * FROM gs)"""


@dataclass(frozen=True)
class HubRows:
    """What hubs are made of, written once: every reader of it reads numbers and no join of edges is done again."""

    #: (release_id, genres, styles, artist_ids, label_ids, title_no, title_hash): one row for each release with a genre
    releases: DataFrame
    #: (hub, type, id, pop, title_no): artists and labels of each genre's releases
    pairs: DataFrame
    #: (title_no, title): numbers in the order of titles
    names: DataFrame


def hub_rows(c: Catalog) -> HubRows:
    place = f"{shared_dir(c.spark)}/hubrows-{uuid.uuid4().hex}"

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{place}/{name}")
        return c.spark.read.schema(df.schema).parquet(f"{place}/{name}")

    part = c.table("part").select(F.col("p_partkey").alias("master_id"), F.col("p_name").alias("title"))
    # Sorted parts are numbered one after the other, so a lesser title has the lesser number: the least is found by numbers.
    names = save(part.where("title is not null").select("title").distinct().orderBy("title").select("title", F.monotonically_increasing_id().alias("title_no")), "names")
    numbered = c.masters.join(part.join(names, "title", "left"), "master_id")
    named = numbered.select("release_id", "title_no", F.xxhash64("title").alias("title_hash"))
    # All edges of a release meet in one aggregation.
    edges = {"genres": (c.genres, "genre"), "styles": (c.styles, "style"), "artist_ids": (c.by, "artist_id"), "label_ids": (c.on, "label_id")}
    union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [named, *(df.select("release_id", F.col(key).alias(name)) for name, (df, key) in edges.items())])
    rows = union.groupBy("release_id").agg(F.min("title_no").alias("title_no"), F.bit_xor("title_hash").alias("title_hash"), *(F.collect_list(name).alias(name) for name in edges))
    rows = save(rows.where("size(genres) > 0"), "releases")
    pairs = []
    for kind, edges, key in (("artist", c.by, "artist_id"), ("label", c.on, "label_id")):
        pop = edges.groupBy(key).agg(F.count("*").alias("pop"))
        both = rows.select(F.explode("genres").alias("hub"), f"{key}s", "title_no").select("hub", F.explode(f"{key}s").alias(key), "title_no")
        near = both.groupBy("hub", key).agg(F.min("title_no").alias("title_no")).join(pop, key)
        pairs.append(near.select("hub", F.lit(kind).alias("type"), F.col(key).cast("string").alias("id"), "pop", "title_no"))
    return HubRows(rows, save(pairs[0].unionByName(pairs[1]), "pairs"), names)


@query("m13_hubs", f"{_HUBS} SELECT hub, type, id, witness FROM hubs")
def hubs(c: Catalog, limit: int = 100, only: DataFrame | None = None, near: HubRows | None = None) -> DataFrame:
    """What lies two hops from each genre (or from those of ``only`` (hub)): other genres and styles, and the most established artists and labels, each with its least linking title."""
    near = near or hub_rows(c)
    asked = lambda df: df if only is None else df.join(only.select("hub"), "hub", "left_semi")
    best = top_n(asked(near.pairs), ["hub"], [F.desc("pop"), "type", "id"], limit).drop("pop")
    of = lambda kind: near.releases.select(F.explode("genres").alias("hub"), f"{kind}s", "title_no").select("hub", F.lit(kind).alias("type"), F.explode(f"{kind}s").alias("id"), "title_no")
    kinds = [asked(of(kind).groupBy("hub", "type", "id").agg(F.min("title_no").alias("title_no"))) for kind in ("genre", "style")]
    rows = reduce(DataFrame.unionByName, kinds).where("NOT (type = 'genre' AND id = hub)").unionByName(best)
    return rows.join(near.names, "title_no", "left").select("hub", "type", "id", F.col("title").alias("witness"))


@query("m11_scored_discoveries", f"""{_HUBS}, held AS (SELECT DISTINCT user_id, release_id FROM collected), ug AS (SELECT user_id, genre, count(*) AS n FROM held JOIN genres USING (release_id) GROUP BY 1, 2), us AS (SELECT DISTINCT user_id, style FROM held JOIN styles USING (release_id)),
    top AS (SELECT user_id, genre AS hub FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) AS rn FROM ug) WHERE rn = 1), sh AS (SELECT user_id, genre, n / sum(n) OVER (PARTITION BY user_id) AS share FROM ug),
    sc AS (SELECT t.user_id, h.type, h.id, h.witness, CASE WHEN h.type = 'genre' THEN coalesce(sh.share, 1.5) WHEN h.type = 'style' THEN CASE WHEN us.style IS NULL THEN 1.5 ELSE 0.0 END ELSE 0.5 END AS s,
        CASE WHEN (h.type = 'genre' AND sh.share IS NULL) OR (h.type = 'style' AND us.style IS NULL) THEN 'blind_spot_boost' ELSE 'graph_proximity' END AS reason FROM top t JOIN hubs h USING (hub) LEFT JOIN sh ON sh.user_id = t.user_id AND sh.genre = h.id AND h.type = 'genre' LEFT JOIN us ON us.user_id = t.user_id AND us.style = h.id AND h.type = 'style')
    SELECT user_id, type, id, score, reason, path FROM (SELECT user_id, type, id, CAST(floor(round(s, 9) * 10000 + 0.5) AS BIGINT) AS score, reason, coalesce(witness, '') || '>' || id AS path, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(round(s, 9) * 10000 + 0.5) AS BIGINT) DESC, type, id) AS rn FROM sc) WHERE rn <= 10""")
def scored_discoveries(c: Catalog, limit: int = 10, start: DataFrame | None = None) -> DataFrame:
    """What lies near each user's first genre, or near its hub of ``start`` (user_id, hub), scored: blind spots 1 x 1.5, known genres by their share, artists and labels 1 / distance."""
    held = c.collected.select("user_id", "release_id").distinct()
    counts = held.join(c.genres, "release_id").groupBy("user_id", "genre").agg(F.count("*").alias("n"))
    first = start if start is not None else top_n(counts, ["user_id"], [F.desc("n"), "genre"], 1).select("user_id", F.col("genre").alias("hub"))
    shares = counts.select("user_id", F.lit("genre").alias("type"), F.col("genre").alias("id"), (F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("share"))
    styles = held.join(c.styles, "release_id").select("user_id", F.lit("style").alias("type"), F.col("style").alias("id"), F.lit(0.0).alias("share")).distinct()
    rows = first.join(hubs(c), "hub").join(shares.unionByName(styles), ["user_id", "type", "id"], "left")
    topic = F.col("type").isin("genre", "style")
    score = scaled(F.round(F.when(topic, F.coalesce("share", F.lit(1.5))).otherwise(0.5), 9), 4)
    reason = F.when(topic & F.col("share").isNull(), "blind_spot_boost").otherwise("graph_proximity")
    rows = rows.select("user_id", "type", "id", score.alias("score"), reason.alias("reason"), F.concat_ws(">", F.coalesce("witness", F.lit("")), "id").alias("path"))
    return top_n(rows, ["user_id"], [F.desc("score"), "type", "id"], limit)


# neighbour lists


def nearest(vectors: DataFrame, asked: DataFrame, k: int = 10, block: int = 512, part: int = 8192, parts: int | None = None) -> DataFrame:
    """(id, other_id, cos): the exact k nearest of ``asked`` among ``vectors`` (both id, e), by cosine to nine places, then id.

    Asked vectors are dealt into blocks of some ``block``, all vectors into parts of some ``part`` (or as many as ``parts``), so a cell's size does not depend on their number; each pair of a block and a part is one matrix product that keeps k of each row.
    """
    n = max(1, -(-asked.count() // block))
    parts = parts or max(1, -(-vectors.count() // part))
    left = asked.select("id", "e", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("asks", F.lit(True))
    right = vectors.select("id", "e", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("j")).withColumn("asks", F.lit(False))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["e"].tolist(), dtype=float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        ids, q = pdf["id"].to_numpy(), pdf["asks"].to_numpy()
        cos = np.round(m[q] @ m[~q].T, 9)
        out = []
        for row, one in zip(cos, ids[q], strict=True):
            row = np.where(ids[~q] == one, -np.inf, row)
            best = np.lexsort((ids[~q], -row))[:k]
            out.append(pd.DataFrame({"id": one, "other_id": ids[~q][best], "cos": row[best]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other_id": [], "cos": []})

    found = left.unionByName(right.select(*left.columns)).groupBy("i", "j").applyInPandas(cell, "id bigint, other_id bigint, cos double").where("cos > double('-infinity')")
    return top_n(found, ["id"], [F.desc("cos"), "other_id"], k)


_NEAREST = """nn AS (SELECT id, other_id, cos FROM (SELECT a.vec_id AS id, b.vec_id AS other_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cos, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS rn
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rn <= 10)"""


def neighbours(c: Catalog, k: int = 10) -> DataFrame:
    """Neighbour lists of the vectors whose id is divisible by 100, against all vectors."""
    v = c.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    return nearest(v, v.where("id % 100 = 0"), k)


@query("m17_neighbour_lists", f"WITH {_NEAREST} SELECT id, other_id, CAST(floor(cos * 1e6 + 0.5) AS BIGINT) AS cos_ppm FROM nn")
def neighbour_lists(c: Catalog) -> DataFrame:
    return neighbours(c).select("id", "other_id", scaled(F.col("cos")).alias("cos_ppm"))


_HEUR = f"""{_PROFILES}, {_CANDIDATES}, nrm AS (SELECT artist_id, dim, sqrt(sum(CAST(n AS DOUBLE) * n)) AS norm FROM prof GROUP BY 1, 2),
    cs AS (SELECT a, b, x.dim, sum(x.n * y.n) / (max(na.norm) * max(nb.norm)) AS cos FROM cand JOIN prof x ON x.artist_id = a JOIN prof y ON y.artist_id = b AND x.dim = y.dim AND x.name = y.name JOIN nrm na ON na.artist_id = a AND na.dim = x.dim JOIN nrm nb ON nb.artist_id = b AND nb.dim = x.dim GROUP BY 1, 2, 3),
    sc AS (SELECT a, b, CAST(floor(round({" + ".join(f"coalesce(sum(CASE WHEN dim = '{d}' THEN {w}::DOUBLE * cos END), 0)" for d, w in DIMENSIONS.items())}, 9) * 10000 + 0.5) AS BIGINT) AS score FROM cs GROUP BY 1, 2),
    hr AS (SELECT a AS id, b AS other_id, score / 1e4 AS heur FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM sc WHERE score > 0) WHERE rn <= 20 AND a % 100 = 0), {_NEAREST}"""


@query("m16_fused_lists", f"""{_HEUR} SELECT coalesce(n.id, h.id) AS id, coalesce(n.other_id, h.other_id) AS other_id, CAST(floor(round(0.8::DOUBLE * coalesce(n.cos, 0) + 0.2::DOUBLE * coalesce(h.heur, 0), 9) * 10000 + 0.5) AS BIGINT) AS fused FROM nn n FULL OUTER JOIN hr h ON n.id = h.id AND n.other_id = h.other_id""")
def fused_lists(c: Catalog, alpha: float = 0.8) -> DataFrame:
    """alpha x cosine + (1 - alpha) x heuristic score, over what either list has; an artist's vector is the one of its id."""
    heur = similar_artists(c, asked="a % 100 = 0").select(F.col("a").alias("id"), F.col("b").alias("other_id"), (F.col("score") / 10**4).alias("heur"))
    both = neighbours(c).join(heur, ["id", "other_id"], "full_outer")
    fused = alpha * F.coalesce("cos", F.lit(0.0)) + (1 - alpha) * F.coalesce("heur", F.lit(0.0))
    return both.select("id", "other_id", scaled(F.round(fused, 9), 4).alias("fused"))


@query("m18_ranked_lists", f"""{_HEUR}, f AS (SELECT coalesce(n.id, h.id) AS id, coalesce(n.other_id, h.other_id) AS other_id, CAST(floor(round(0.8::DOUBLE * coalesce(n.cos, 0) + 0.2::DOUBLE * coalesce(h.heur, 0), 9) * 10000 + 0.5) AS BIGINT) AS fused FROM nn n FULL OUTER JOIN hr h ON n.id = h.id AND n.other_id = h.other_id)
    SELECT id, other_id, rank FROM (SELECT id, other_id, row_number() OVER (PARTITION BY id ORDER BY fused DESC, other_id) AS rank FROM f) WHERE rank <= 5""")
def ranked_lists(c: Catalog, n: int = 5) -> DataFrame:
    return top_n(fused_lists(c), ["id"], [F.desc("fused"), "other_id"], n, rank="rank").select("id", "other_id", F.col("rank").cast("long"))



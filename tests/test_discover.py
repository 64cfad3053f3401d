"""Hand-computed cases of paths, bridges, neighbour lists, recommendations and dispatch."""

import datetime

import pytest

from lattica.operators.compositions import classified, dispatch
from lattica.operators.discover import nearest
from lattica.operators.fit import bridges, fit, redundancy
from lattica.operators.paths import typed_paths
from lattica.operators.similarity import first_releases, user_recommendations


class Small:
    """Releases 1 to 4 of artists 10, 20 and 30 on labels 5 and 6, in genres x and y; user 1 holds 1 and 2 and wants 3."""

    def __init__(self, spark):
        df, at = spark.createDataFrame, datetime.datetime(2024, 1, 1)
        self.spark = spark
        self.by = df([(1, 10), (2, 20), (3, 10), (3, 20), (4, 30)], "release_id bigint, artist_id bigint")
        self.on = df([(1, 5), (2, 6), (3, 5), (4, 6)], "release_id bigint, label_id bigint")
        self.genres = df([(1, "x"), (2, "y"), (3, "x"), (3, "y"), (4, "y")], "release_id bigint, genre string")
        self.styles = df([(1, "s"), (2, "t"), (4, "t")], "release_id bigint, style string")
        self.aliases = df([(30, 40)], "artist_id bigint, other_id bigint")
        self.groups = df([], "artist_id bigint, other_id bigint")
        self.masters = df([], "release_id bigint, master_id bigint")
        held = "user_id bigint, release_id bigint, date_added timestamp_ntz, value double"
        self.collected = df([(1, 1, at, 1.0), (1, 2, at, 1.0)], held)
        self.wanted = df([(1, 3, at, 1.0)], held)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("discover")))
    return Small(spark)


def test_typed_paths(spark, small):
    nodes = lambda *ids: spark.createDataFrame([(i,) for i in ids], "node string")
    got = {(r.source, r.target): (r.hops, r.path) for r in typed_paths(small, nodes("artist:10"), nodes("artist:40", "label:6", "artist:99")).collect()}
    # Release 3 links 10 to genre y and artist 20; release 4 of genre y links on to 30, whose alias is 40.
    assert got[("artist:10", "label:6")] == (4, "artist:10>release:3>artist:20>release:2>label:6")
    assert got[("artist:10", "artist:40")] == (5, "artist:10>release:3>genre:y>release:4>artist:30>artist:40")
    assert len(got) == 2
    assert typed_paths(small, nodes("artist:10"), nodes("artist:40"), depth=4).count() == 0
    assert typed_paths(small, nodes("artist:10"), nodes("genre:y"), hub=1).count() == 0, "two hubs"
    with pytest.raises(ValueError):
        typed_paths(small, nodes("artist:10"), nodes("artist:40"), depth=11)


def test_bridges(spark, small):
    assert [tuple(r) for r in bridges(small).collect()] == [(1, 3, 10000, "x|y")]
    joined = Small(spark)
    joined.on = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 6)], "release_id bigint, label_id bigint")
    assert [tuple(r) for r in bridges(joined).collect()] == [(1, 3, 0, "x")], "the regions share a label"


def test_redundancy_ladder_and_fit(spark):
    """User 1 holds release 1 (master 100, vinyl, artist 10, "Blue") and 2 (master 200, tape, artist 20, "Old Red")."""
    df, at = spark.createDataFrame, datetime.datetime(2024, 1, 1)
    c = Small(spark)
    c.masters = df([(1, 100), (2, 200), (3, 100), (4, 100), (5, 300), (6, 400), (7, 500)], "release_id bigint, master_id bigint")
    c.media = df([(1, "v", "vinyl"), (2, "t", "tape"), (3, "v", "vinyl"), (3, "c", "disc"), (4, "c", "disc"), (5, "t", "tape"), (6, "c", "disc"), (7, "c", "disc")], "release_id bigint, medium string, family string")
    c.by = df([(1, 10), (2, 20), (3, 10), (4, 10), (5, 20), (6, 30), (7, 20)], "release_id bigint, artist_id bigint")
    c.on = df([(1, 5), (2, 6), (3, 5), (4, 7), (5, 6), (6, 8), (7, 8)], "release_id bigint, label_id bigint")
    c.genres = df([(1, "x"), (2, "y"), (3, "x"), (4, "x"), (5, "y"), (6, "z"), (7, "x"), (7, "y")], "release_id bigint, genre string")
    c.styles = df([(1, "s"), (7, "s"), (7, "q")], "release_id bigint, style string")
    parts = df([(100, "Blue"), (200, "Old Red"), (300, "OLD red"), (400, "old red"), (500, "New")], "p_partkey bigint, p_name string")
    c.table = lambda name: parts
    held = "user_id bigint, release_id bigint, date_added timestamp_ntz, value double"
    c.wanted = df([(1, r, at, 1.0) for r in (1, 3, 4, 5, 6, 7)], held)
    # The very release; same master in a family of both; same master in another; same artist and title but for case; title alone; nothing.
    assert {r.release_id: r.redundancy for r in redundancy(c).collect()} == {1: 10000, 3: 10000, 4: 6000, 5: 3000, 6: 0, 7: 0}
    got = {r.release_id: r for r in fit(c).collect()}
    # Release 7: artist held (0.35), label not (of 0.25), genres held (0.25), one of two styles (0.15 / 2): 0.675. New: label 8 and style q of six facets.
    assert (got[7].affinity, got[7].novelty, got[7].depth, got[7].bridge, got[7].fit) == (6750, 3333, 2000, 10000, 10000)
    # Release 4: no styles, so over 0.85: artist and genre held, label not: 0.6 / 0.85; one of three facets is new; one held release by the artist.
    assert (got[4].affinity, got[4].novelty, got[4].depth, got[4].bridge, got[4].fit) == (7059, 3333, 2000, 0, 6392)
    assert (got[6].affinity, got[6].novelty, got[6].fit) == (0, 10000, 10000)


def test_blind_spots_are_genres_with_samples(spark):
    from lattica.operators.similarity import blind_spot_candidates, blind_spot_genres

    df, at = spark.createDataFrame, datetime.datetime(2024, 1, 1)
    c = Small(spark)
    c.by = df([(1, 10), (2, 20)] + [(r, 10) for r in range(30, 38)] + [(40, 20), (41, 20)], "release_id bigint, artist_id bigint")
    c.genres = df([(1, "x"), (2, "x")] + [(r, "far") for r in range(30, 38)] + [(40, "far"), (41, "near"), (41, "x")], "release_id bigint, genre string")
    assert sorted(tuple(r) for r in blind_spot_genres(c).collect()) == [(1, "far", 2, 30), (1, "near", 1, 41)]
    got = sorted((r.genre, r.release_id, r.score) for r in blind_spot_candidates(c).collect())
    assert got == [("far", r, 2) for r in range(30, 35)] + [("near", 41, 1)]


def test_recommendations_are_exact_after_pruning(spark, small):
    from collections import Counter
    from random import Random

    rng = Random(4)
    c = Small(spark)
    by = sorted({(r, rng.randrange(12)) for r in range(400) for _ in range(rng.randrange(1, 4))})
    c.by = spark.createDataFrame(by, "release_id bigint, artist_id bigint")
    at = datetime.datetime(2024, 1, 1)
    held = sorted({(u, rng.randrange(400)) for u in range(4) for _ in range(30)})
    c.collected = spark.createDataFrame([(u, r, at, 1.0) for u, r in held], "user_id bigint, release_id bigint, date_added timestamp_ntz, value double")
    want = []
    for u in range(4):
        mine = {r for v, r in held if v == u} | ({3} if u == 1 else set())
        weights = Counter(a for r, a in by if (u, r) in set(held))
        tops = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:10])
        scores = Counter()
        for r, a in by:
            scores[r] += tops.get(a, 0)
        best = sorted((-s, r) for r, s in scores.items() if s and r not in mine)[:7]
        want += [(u, r, -s) for s, r in best]
    assert sorted((r.user_id, r.release_id, r.score) for r in user_recommendations(c, 7).collect()) == sorted(want)
    one = first_releases(c.by, "artist_id", spark.createDataFrame([(0, 3, 9)], "user_id bigint, artist_id bigint, n bigint"), spark.createDataFrame(held, "user_id bigint, release_id bigint"), 2)
    ids = [r for r, a in by if a == 3]
    known = sum((0, r) in set(held) for r in ids)
    assert sorted(r.release_id for r in one.collect()) == ids[: 2 + known]


def test_nearest(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [2.0, 0.0]), (5, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "id bigint, e array<double>")
    got = sorted((r.id, r.other_id, round(r.cos, 3)) for r in nearest(v, v.where("id in (1, 3)"), k=2, block=1, parts=3).collect())
    assert got == [(1, 2, 0.994), (1, 4, 1.0), (3, 1, 0.0), (3, 2, 0.11)]


def test_dispatch():
    from lattica import plans

    assert dispatch("genre", "expand artists") is plans.QUERIES["g7_expand_genre_artists"]
    assert dispatch("label", "explore") is plans.QUERIES["g3_explore_label"]
    assert dispatch("style", "trends") is plans.QUERIES["t4_trends_style"]
    assert dispatch("artist", "count releases") is plans.QUERIES["g19_count_artist_releases"]
    for kind, category in (("genre", "expand nothing"), ("person", "explore")):
        with pytest.raises(ValueError):
            dispatch(kind, category)


def test_classified(spark):
    from pyspark.sql import functions as F

    rows = [("<r><a><k>7</k></a></r>", '{"k": 7}'), ("<r><a><k>8</k></a></r>", '{"k": 7}'), ("<r><a/></r>", '{"k": 7}'), (None, None)]
    got = spark.createDataFrame(rows, "x string, j string").select(classified(F.col("x"), F.col("j"), "k").alias("kind")).collect()
    assert [r.kind for r in got] == ["source_issue", "parsing_error", "indeterminate", "indeterminate"]

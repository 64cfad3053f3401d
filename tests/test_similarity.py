"""Candidates by sets of names, and candidates by all signals, against plain countings."""

import collections
import random

import pytest

from lattica.operators.scopes import all_signal_candidates
from lattica.operators.similarity import candidates, most_shared
from lattica.plans import Catalog


@pytest.mark.parametrize("block,part", [(4096, 131_072), (2, 7)])
def test_best_of_a_set_of_names(spark, block, part):
    rng = random.Random(3)
    counts = [(b, f"g{k}", rng.randrange(1, 5)) for b in range(40) for k in range(6) if rng.random() < 0.7]
    tops = [(a, f"g{k}") for a in range(30) for k in rng.sample(range(6), 3)]
    sets, best = most_shared(spark.createDataFrame(tops, "a long, name string"), spark.createDataFrame(counts, "b long, name string, n long"), 3, 5, 30, 40, block, part)
    of = collections.defaultdict(set)
    for a, name in tops:
        of[a].add(name)
    assert {r.a: tuple(r.set) for r in sets.collect()} == {a: tuple(sorted(s)) for a, s in of.items()}
    want = set()
    for one in {tuple(sorted(s)) for s in of.values()}:
        sums = collections.Counter()
        for b, name, n in counts:
            sums[b] += n * (name in one)
        ranked = sorted((-n, b) for b, n in sums.items() if n >= 3)[:6]
        want |= {(one, b, -n, place) for place, (n, b) in enumerate(ranked, 1)}
    assert {(tuple(r.set), r.b, r.shared, r.place) for r in best.collect()} == want


def test_artists_are_not_paired_by_genre(spark):
    """Sets meet parts of artists in cells; a join on the genre would make a row of every two artists."""
    plan = candidates(Catalog(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert not [line for line in plan.splitlines() if "Join [genre#" in line]


def test_topics_are_reached_once_for_artists_of_the_same(spark):
    """Two artists of one set of topics reach its releases by one row each; a label adds what its set has not."""
    c = Catalog(spark, "/root/testdata/sf0.001")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    c.__dict__.update(
        by=frame([(1, 100), (2, 200), (3, 100), (3, 300), (4, 300), (5, 300)], "release_id long, artist_id long"), genres=frame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "release_id long, genre string"), styles=frame([], "release_id long, style string"),
        on=frame([(1, 7), (5, 7), (2, 8), (3, 8), (4, 9)], "release_id long, label_id long"), releases=frame([(k,) for k in range(1, 6)], "release_id long"),
    )
    got = {(r.a, r.b): r.releases for r in all_signal_candidates(c, least=1).collect()}
    # 100 reaches 1, 2, 3 by x and 5 by label 7; 200 reaches 1, 2, 3 by x; 300 reaches all.
    assert got == {(100, 200): 1, (100, 300): 2, (200, 100): 2, (200, 300): 1, (300, 100): 2, (300, 200): 1}
    plan = all_signal_candidates(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "rep" in plan


@pytest.mark.parametrize("roots", [None, "a % 10 = 0"])
def test_bridges_are_counted_in_blocks(spark, roots):
    from lattica.operators.similarity import collaborator_distances

    c = Catalog(spark, "/root/testdata/sf0.001")
    near = collections.defaultdict(set)
    by = collections.defaultdict(set)
    for r in c.by.collect():
        by[r.release_id].add(r.artist_id)
    for group in by.values():
        for a in group:
            near[a] |= group - {a}
    n = collections.Counter((a, b) for bridge in near for a in near[bridge] for b in near[bridge] if a != b and b not in near[a])
    want = {(a, b, k) for (a, b), k in n.items() if roots is None or a % 10 == 0}
    for each in (1_000_000, 2000):
        got = collaborator_distances(c, roots, each)
        assert {(r.a, r.b, r.n) for r in got.where("distance = 2").collect()} == want
    assert "FlatMapGroupsInPandas" in got._jdf.queryExecution().executedPlan().toString()


def test_edges_are_spread_by_their_lines(spark):
    """Where the session has fewer partitions than the lines need, an edge has as many as they need; groups of a pair hold counts, not releases."""
    from unittest import mock

    from lattica.operators.explore import genre_tree

    with mock.patch("lattica.plans.LINES_EACH", 500):
        c = Catalog(spark, "/root/testdata/sf0.001")
        parts = -(-c.lines.count() // 500)
        assert parts > 4 and c.by.rdd.getNumPartitions() == c.genres.rdd.getNumPartitions() == parts
    c = Catalog(spark, "/root/testdata/sf0.001")
    plan = genre_tree(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct release_id" not in plan and "count(distinct" not in plan


def test_pairs_at_distance_two_are_counted_once_and_told_apart_in_place(spark):
    """Pairs in common are left out where they are counted, in any number of blocks, and no pair at distance two is shuffled."""
    from lattica.operators.similarity import collaborator_distances, in_common

    rng = random.Random(3)
    by = sorted({(r, rng.randrange(60)) for r in range(70) for _ in range(3)})
    near = collections.defaultdict(collections.Counter)
    for r, a in by:
        for s, b in by:
            if r == s and a != b:
                near[a][b] += 1
    want = {(a, b, 1, n) for a in near for b, n in near[a].items()}
    want |= {(a, b, 2, len(set(near[a]) & set(near[b]))) for a in near for b in near if a != b and b not in near[a] and set(near[a]) & set(near[b])}

    class Chosen:
        def __init__(self):
            self.spark, self.by = spark, spark.createDataFrame(by, "release_id bigint, artist_id bigint")

    for rows_each in (1_000_000, 40):
        got = collaborator_distances(Chosen(), rows_each=rows_each)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        asked = collaborator_distances(Chosen(), "a % 10 = 0", rows_each=rows_each)
        assert sorted(map(tuple, asked.collect())) == sorted(x for x in want if x[0] % 10 == 0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InPandas") == 1 and "LeftAnti" not in plan
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id bigint, key bigint")
    kept = in_common(rows, ["key"], rows.select("id"), 2, but=spark.createDataFrame([(1, 3), (7, 8)], "a bigint, b bigint"))
    assert sorted(map(tuple, kept.collect())) == [(1, 2, 1), (2, 3, 1)]


def test_edges_are_gathered_once_for_similar_artists(spark, tmp_path):
    """What stays unknown is counted as such, a line without its part has no genre, and no edge is read again once it is gathered."""
    from lattica.operators.similarity import profiles, similar_artists

    d = str(tmp_path)
    spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 2, 12), (2, 1, 99), (2, None, 10), (None, 1, 10)], "l_orderkey bigint, l_suppkey bigint, l_partkey bigint").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(10, "g", "s"), (11, "g", None), (12, "h", "s")], "p_partkey bigint, p_type string, p_brand string").write.parquet(f"{d}/part.parquet")
    spark.sql("SELECT * FROM VALUES (1L, 7L), (1L, 7L), (2L, null), (3L, 8L) AS t(o_orderkey, o_custkey)").selectExpr("*", "timestamp'2000-01-01' AS o_orderdate", "'1' AS o_orderpriority").write.parquet(f"{d}/orders.parquet")
    got = {(r.artist_id, r.dim, r.name): r.n for r in profiles(Catalog(spark, d)).collect()}
    genres = {(1, "g"): 2, (1, "h"): 1, (2, "g"): 1, (2, "h"): 1, (None, "g"): 1}
    styles = {(1, "s"): 2, (1, None): 1, (2, "s"): 1, (2, None): 1, (None, "s"): 1}
    labels = {(1, "7"): 2, (2, "7"): 2, (1, None): 1, (None, None): 1}
    want = {(a, dim, x): n for dim, rows in (("genre", genres), ("style", styles), ("label", labels), ("collaborator", {(1, "2"): 1, (2, "1"): 1})) for (a, x), n in rows.items()}
    assert got == want
    plan = similar_artists(Catalog(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan

"""Null, tie and edge rules on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from lattica.functions import page, scaled, top_n
from lattica.operators.insights import shared_personnel
from lattica.operators.rarity import composed, percentiles
from lattica.operators.similarity import collaborator_distances, similar_labels
from lattica.operators.temporal import alias_distances, merge_items, reattach, shortest_paths, validity
from lattica.operators.trends import entropy
from lattica.plans import Catalog
from lattica.sources import changed_fields, read_copy_text, read_flagged, read_sidecars, upsert
from lattica.streaming import ingest, source, validated


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(autouse=True, scope="module")
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_top_n_breaks_ties_by_the_last_key(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 9, None)], "g string, k int, n int")
    assert rows(top_n(df, ["g"], [F.desc("n"), "k"], 2)) == [("a", 1, 5), ("a", 2, 5), ("b", 9, None)]
    assert [r.k for r in page(df, [F.desc_nulls_first("n"), "k"], 2, 1).collect()] == [1, 2]


def test_scaled_rounds_half_up(spark):
    got = spark.createDataFrame([(0.5,), (0.25,), (None,)], "x double").select(scaled(F.col("x"), 1).alias("y"))
    assert [r.y for r in got.collect()] == [5, 3, None]


def test_running_sums(spark):
    from itertools import accumulate

    from lattica.functions import running_sums

    arrays = [[], [5], list(range(127)), list(range(128)), list(range(129)), [3] * 1000]
    got = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>").select("i", running_sums(F.col("a")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: [0, *accumulate(a)][: len(a)] for i, a in enumerate(arrays)}


def test_share_below_counts_positive_values_only(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 10), (4, 0), (5, None)], "k int, v int")
    want = {1: 0.0, 2: 0.0, 3: 2 / 3, 4: 0.0, 5: 0.0}
    assert {r.k: r.below for r in percentiles(df, "v").collect()} == want


def test_entropy_of_one_kind_is_zero(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (2, "b", 1)], "u int, g string, n int")
    assert rows(entropy(df, ["u"], "n").select("u", "kinds", "entropy")) == [(1, 1, 0), (2, 2, 100)]


def test_rarity_renormalises_over_present_signals(spark):
    df = spark.createDataFrame([(1, 40, 40, 40, 40.0, 40, None), (2, 40, 40, 40, 40.0, 40, 100)], "release_id int, medium_rarity int, label_catalog int, prevalence int, temporal double, isolation int, pressing int")
    got = {r.release_id: (r.score, r.tier) for r in composed(df).collect()}
    assert got == {1: (4000, "scarce"), 2: (5500, "scarce")}


def test_each_rarity_signal_has_its_own_weight(spark):
    """Unlike scores: 10 x 0.1 + 20 x 0.1 + 30 x 0.2 + 40 x 0.15 + 50 x 0.2 = 25, over 0.75 without pressings, and plus 60 x 0.25 with."""
    schema = "release_id int, label_catalog int, medium_rarity int, temporal double, isolation int, prevalence int, pressing int"
    df = spark.createDataFrame([(1, 10, 20, 30.0, 40, 50, None), (2, 10, 20, 30.0, 40, 50, 60)], schema)
    assert {r.release_id: (r.score, r.tier) for r in composed(df).collect()} == {1: (3333, "uncommon"), 2: (4000, "scarce")}


def test_temporal_scarcity_looks_at_other_releases_of_the_master(spark):
    from lattica.operators.rarity import signals

    df, at = spark.createDataFrame, __import__("datetime").datetime(2024, 1, 1)

    class C:
        # Master 7: releases of 1960, 2000; 8: two of 2001; 9: 2003 alone; release 6 without a master.
        releases = df([(1, 1960, 5, "p"), (2, 2000, 5, "p"), (3, 2001, 5, "p"), (4, 2001, 5, "p"), (5, 2003, 5, "p"), (6, 1940, 5, "p")], "release_id bigint, year bigint, label_id bigint, priority string")
        masters = df([(1, 7), (2, 7), (3, 8), (4, 8), (5, 9)], "release_id bigint, master_id bigint")
        on = df([(i, 5) for i in range(1, 7)], "release_id bigint, label_id bigint")
        by = df([(1, 1)], "release_id bigint, artist_id bigint")
        genres = df([(1, "g")], "release_id bigint, genre string")
        styles = df([(1, "s")], "release_id bigint, style string")
        media = df([(1, "R_F", "R"), (6, "A_F", "A")], "release_id bigint, medium string, family string")
        collected = df([(9, 1, at, 1.0)], "user_id bigint, release_id bigint, date_added timestamp_ntz, value double")
        wanted = df([(9, 1, at, 1.0), (8, 1, at, 1.0)], "user_id bigint, release_id bigint, date_added timestamp_ntz, value double")

    got = {r.release_id: r for r in signals(C).collect()}
    # Base 1.5 a year before 2005; 40 less where another release is of 1995 or later: not where the release itself is the only such one.
    assert {k: float(r.temporal) for k, r in got.items()} == {1: 27.5, 2: 7.5, 3: 0.0, 4: 0.0, 5: 3.0, 6: 97.5}
    assert (got[1].medium_rarity, got[1].label_catalog, got[1].prevalence, got[1].isolation, got[1].pressing) == (70, 100, 90, 70, 85)
    assert got[6].pressing is None and got[2].isolation == 90


def test_validity_has_one_open_row_and_no_overlap(spark):
    df = spark.createDataFrame([("k", 1, 1, "a"), ("k", 5, 2, "b"), ("k", 5, 3, "c"), ("m", 2, 4, "d")], "key string, at int, id int, v string")
    got = validity(df, ["key"], "at", "id").orderBy("key", "valid_from", "id").collect()
    assert [(r.v, r.valid_from, r.valid_to) for r in got] == [("a", 1, 5), ("b", 5, 5), ("c", 5, None), ("d", 2, None)]


def test_supersession_chains_compress(spark):
    df = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)], "superseded int, survivor int")
    assert rows(merge_items(df)) == [(2, 1), (3, 1), (4, 1), (5, 1), (9, 8)]
    with pytest.raises(ValueError):
        merge_items(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "superseded int, survivor int"), rounds=6)


def test_reattach_keeps_collisions_closed(spark):
    schema = "provider string, external_id string, native_id string, valid_from timestamp_ntz, valid_to timestamp_ntz"
    t0 = __import__("datetime").datetime(2024, 1, 1)
    aliases = spark.createDataFrame([("p", "1", "old", t0, None), ("p", "2", "old", t0, None), ("p", "2", "new", t0, None), ("p", "3", "other", t0, None)], schema)
    sup = spark.createDataFrame([("old", "new")], "superseded string, survivor string")
    out = reattach(aliases, sup, "2024-02-01")
    open_ = rows(out.where("valid_to is null").select("external_id", "native_id"))
    assert open_ == [("1", "new"), ("2", "new"), ("3", "other")]
    assert out.where("native_id = 'old' and valid_to is null").count() == 0


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (7, 8)], "a int, b int")
    got = rows(shortest_paths(edges, spark.createDataFrame([(1,)], "source int"), 5))
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 1)]


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", None)], "id int, v string, note string")
    new = spark.createDataFrame([(2, "B", None), (3, None, "z"), (4, "d", "w")], "id int, v string, note string")
    assert rows(upsert(old, new, ["id"], ["note"])) == [(1, "a", "x"), (2, "B", "y"), (3, None, "z"), (4, "d", "w")]
    assert rows(changed_fields(old, new, ["id"], ["v", "note"])) == [(2, "updated", "v,note"), (3, "updated", "v,note"), (4, "added", "")]
    assert rows(changed_fields(old, old, ["id"], ["v", "note"])) == []


def test_file_sources(spark, tmp_path):
    folder = tmp_path / "flagged" / "v1" / "releases"
    folder.mkdir(parents=True)
    (folder / "x.jsonl").write_text(json.dumps({"record_id": "1", "rule": "r"}) + "\n{broken\n" + json.dumps({"record_id": "2", "rule": "s"}) + "\n")
    got = read_flagged(spark, str(tmp_path / "flagged"), "record_id string, rule string")
    assert rows(got.select("record_id", "version", "entity_type")) == [("1", "v1", "releases"), ("2", "v1", "releases")]
    side = tmp_path / "side"
    side.mkdir()
    (side / "7.xml").write_text("<a>" + "x" * 50 + "</a>")
    assert rows(read_sidecars(spark, str(side), 10)) == [("7", "<a>xxxxxxx", True)]
    (tmp_path / "t.txt").write_text("1\t\\N\t\"q\"\n2\tb\tc\n")
    assert rows(read_copy_text(spark, str(tmp_path / "t.txt"), {"id": "int", "v": "string", "w": "string"}, ["id", "v", "w"])) == [(1, None, '"q"'), (2, "b", "c")]


def test_ingest_is_idempotent_however_late(spark, tmp_path):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, k bigint"
    day = __import__("datetime").datetime
    first = [(1, day(2024, 1, 1), 1, "purchase", 2.0, 3), (2, day(2024, 1, 2), 1, "view", None, None), (3, day(2024, 1, 3), None, "odd", None, None)]
    late = [(1, day(2024, 1, 1), 1, "purchase", 2.0, 3), (4, day(2025, 6, 1), 1, "click", None, 9), (4, day(2025, 6, 1), 1, "click", None, 9)]
    target, bad = str(tmp_path / "t"), str(tmp_path / "q")
    for n, part in enumerate((first, late)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        ingest(source(spark, str(tmp_path / f"in{n}"), schema), target, bad, str(tmp_path / f"c{n}"), ["event_id"]).awaitTermination()
    assert rows(spark.read.parquet(target).select("event_id", F.col("month").cast("string"))) == [(1, "2024-01"), (4, "2025-06")]
    assert sorted(r.event_id for r in spark.read.parquet(bad).collect()) == [2, 3]
    assert rows(validated(spark.createDataFrame(first, schema)).select("event_id", "valid")) == [(1, True), (2, False), (3, False)]


SF = "/root/testdata/sf0.001"


def test_shared_personnel_answers_for_all_masters(spark):
    from collections import Counter, defaultdict

    c = Catalog(spark, SF)
    by = defaultdict(set)
    for r in c.credits.join(c.masters, "release_id").select("master_id", "person_id", "category").collect():
        by[r.person_id, r.category].add(r.master_id)
    n = Counter((a, b) for group in by.values() for a in group for b in group if a < b)
    want = sorted(((a, b, k) for (a, b), k in n.items() if k >= 3), key=repr)
    assert len({a for a, _, _ in want if a % 100}) > 10
    assert rows(shared_personnel(c)) == want
    assert rows(shared_personnel(c, block=7)) == want


def test_similar_labels_answers_for_all_labels(spark):
    c = Catalog(spark, SF)
    got = rows(similar_labels(c))
    assert len({a for a, _, _ in got}) > 10 and any(a % 100 for a, _, _ in got)
    assert [r for r in got if r[0] % 100 == 0] == rows(similar_labels(c, asked="label_id % 100 = 0"))


class Chain:
    """Artists 1 to 12, each an alias of the next and on a release with the next; 20 alone."""

    def __init__(self, spark):
        self.spark = spark
        links = [(i, i + 1) for i in range(1, 12)]
        self.artists = spark.createDataFrame([(i,) for i in [*range(1, 13), 20]], "artist_id bigint")
        self.aliases = spark.createDataFrame(links, "artist_id bigint, other_id bigint")
        self.by = spark.createDataFrame([(r, i) for r, pair in enumerate(links) for i in pair] + [(50, 1), (50, 2), (60, 20)], "release_id bigint, artist_id bigint")


def test_distances_answer_for_all_artists(spark):
    c, near = Chain(spark), range(1, 13)
    pairs = [(a, b, abs(a - b), 2 if {a, b} == {1, 2} else 1) for a in near for b in near if 1 <= abs(a - b) <= 2]
    assert rows(collaborator_distances(c)) == sorted(pairs, key=repr)
    for depth, got in ((6, alias_distances(c)), (9, alias_distances(c, depth=9))):
        assert rows(got) == sorted([(a, b, abs(a - b)) for a in near for b in near if abs(a - b) <= depth] + [(20, 20, 0)], key=repr)


def test_suffix_minimum_takes_a_growing_frame(spark):
    """A frame from the row to the end is summed up anew for every row of a key; one from the start is not."""
    from lattica.operators.temporal import suffix_minimum
    from lattica.plans import Catalog

    plan = suffix_minimum(Catalog(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and "unboundedpreceding" in plan


def test_shared_personnel_does_not_spread_lists_over_all_parts(spark):
    """Blocks of masters that have nobody in common do not meet, whatever their number; the counts stay."""
    c = Catalog(spark, SF)
    want = rows(shared_personnel(c))
    assert rows(shared_personnel(c, rows_each=700)) == want
    assert rows(shared_personnel(c, "master_id % 10 = 0", rows_each=900, block=3)) == [r for r in want if r[0] % 10 == 0]
    plan = shared_personnel(c, rows_each=700)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan

"""Hubs brought up to date in part: partitions that don't change keep their files, and all equal a full build."""

import os

import pytest
from pyspark.sql import functions as F

from lattica.operators.discover import hubs
from lattica.operators.hubstore import Earlier, read_hubs, refresh_hubs
from lattica.plans import Catalog


@pytest.fixture(autouse=True, scope="module")
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("hubs")))


class Small(Catalog):
    """Genres a, b and "c/d e"; the last one shares no artist or label with the others."""

    def __init__(self, spark, title="red", extra=(), without=()):
        super().__init__(spark, "")
        df = spark.createDataFrame
        rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c/d e"), (5, "c/d e"), *extra]
        rows = [r for r in rows if r[1] not in without]
        kept = {r for r, _ in rows}
        on = lambda pairs, schema: df([p for p in pairs if p[0] in kept], schema)
        self.__dict__ |= {
            "genres": df(rows, "release_id bigint, genre string"), "by": on([(1, 10), (2, 10), (3, 11), (4, 12), (5, 12), (6, 11)], "release_id bigint, artist_id bigint"), "on": on([(1, 20), (2, 21), (3, 21), (4, 22), (5, 22), (6, 23)], "release_id bigint, label_id bigint"),
            "styles": on([(1, "s"), (4, "t")], "release_id bigint, style string"), "masters": on([(r, r) for r in range(1, 7)], "release_id bigint, master_id bigint"),
        }
        self.parts = df([(r, f"title {r}" if r != 2 else title) for r in range(1, 7)], "p_partkey bigint, p_name string")

    def table(self, name):
        return self.parts


def rows(df):
    return sorted(tuple(r) for r in df.select("hub", "type", "id", "witness").collect())


def files(path):
    return {f"{d.rsplit('/', 1)[1]}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_what_changed_is_rebuilt(spark, tmp_path):
    path = str(tmp_path / "store")
    first = refresh_hubs(Small(spark), path)
    assert (first.rebuilt, first.removed, first.kept) == (["a", "b", "c/d e"], [], 0)
    assert rows(read_hubs(Small(spark), path)) == rows(hubs(Small(spark)))
    before = files(path)
    same = refresh_hubs(Small(spark), path)
    assert (same.rebuilt, same.removed, same.kept) == ([], [], 3) and files(path) == before
    # Another title of a release in a and b; a new release of b's artist.
    for c, rebuilt in ((Small(spark, title="blue"), ["a", "b"]), (Small(spark, title="blue", extra=[(6, "b")]), ["b"])):
        before = files(path)
        got = refresh_hubs(c, path)
        assert (got.rebuilt, got.removed) == (rebuilt, [])
        assert rows(read_hubs(c, path)) == rows(hubs(c))
        after = files(path)
        untouched = {f for f in before if f.split("/")[0][4:] not in rebuilt}
        assert untouched and all(after[f] == before[f] for f in untouched)
    c = Small(spark, title="blue", extra=[(6, "b")], without=["c/d e"])
    got = refresh_hubs(c, path)
    assert (got.rebuilt, got.removed, got.kept) == ([], ["c/d e"], 2)
    assert rows(read_hubs(c, path)) == rows(hubs(c))


def test_earlier_catalog(spark):
    c = Catalog(spark, "/root/testdata/sf0.001")
    old = Earlier(c, 1996)
    assert 0 < old.by.count() < c.by.count()
    assert old.genres.join(c.releases.where(F.col("year") >= 1996), "release_id", "left_semi").count() == 0

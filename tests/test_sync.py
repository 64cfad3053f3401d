"""A paged sync cut after any page and resumed ends in the same table, and each completion is acted on once."""

import collections
import random

import pytest

from lattica.streaming import source
from lattica.streaming import sync as s


@pytest.fixture(autouse=True, scope="module")
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("sync")))


# user, sync, page, last, items
PAGES = [
    (1, 10, 1, False, {5: 1.0, 6: 2.0}), (1, 10, 2, True, {7: 3.0}),
    (1, 20, 1, False, {5: 9.0}), (1, 20, 2, False, {8: 1.0}), (1, 20, 3, True, {}),
    (2, 10, 1, True, {5: 4.0}), (2, 30, 1, False, {6: 1.0}),  # the second sync never ends
    (3, 40, 1, True, {}),
]


def rows(pages):
    return [(u, y, p, last, r, v) for u, y, p, last, items in pages for r, v in (items or {None: None}).items()]


def plain(pages):
    """{(user, release): (rating, sync)} and the completed syncs, from the set of pages alone."""
    held, done = {}, set()
    for u, y, p, _, items in sorted(pages, key=lambda x: (x[1], x[2])):
        for r, v in items.items():
            held[u, r] = (v, y)
    for u, y in {(x[0], x[1]) for x in pages}:
        mine = [x for x in pages if x[:2] == (u, y)]
        if any(x[3] and x[2] == len({m[2] for m in mine}) for x in mine):
            done.add((u, y))
    newest = collections.defaultdict(int)
    for u, y in done:
        newest[u] = max(newest[u], y)
    return {k: v for k, v in held.items() if v[1] >= newest[k[0]]}, dict(newest)


def table(spark, target):
    return {(r.user_id, r.release_id): (r.rating, r.sync_id) for r in s.collections(spark, target).collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_any_order_of_pages_and_cuts(spark, tmp_path, seed):
    """Batches of pages in random order, some met twice, some run again after they were written: the end is the same, and so is what was acted on."""
    rng = random.Random(seed)
    order = PAGES + rng.sample(PAGES, 2)
    rng.shuffle(order)
    target, done = str(tmp_path / "t"), str(tmp_path / "d")
    write = s.batch_writer(target, done, 4)
    met, batch = [], 0
    while order:
        part, order = order[:3], order[3:]
        met += part
        df = spark.createDataFrame(rows(part), s.PAGES)
        write(df, batch)
        if rng.random() < 0.5:
            write(df, batch)  # the run was cut before it was noted
        batch += 1
    held, newest = plain(met)
    assert table(spark, target) == held
    acted = [(r.user_id, r.sync_id) for r in s.completed(spark, done).collect()]
    assert len(acted) == len(set(acted)) and {u: max(y for v, y in acted if v == u) for u, _ in acted} == newest


def test_a_stream_that_is_cut_and_resumed(spark, tmp_path):
    files = tmp_path / "files"
    target, done, offsets = (str(tmp_path / x) for x in ("t", "d", "o"))
    for cut in ((0, 3), (3, 4), (4, len(PAGES))):
        for n, p in enumerate(PAGES[slice(*cut)]):
            spark.createDataFrame(rows([p]), s.PAGES).coalesce(1).write.mode("append").parquet(str(files))
        s.sync_pages(source(spark, str(files), s.PAGES, files_per_trigger=2), target, done, offsets, 2).awaitTermination()
        held, _ = plain(PAGES[: cut[1]])
        assert table(spark, target) == held
    assert sorted((r.user_id, r.sync_id) for r in s.completed(spark, done).collect()) == [(1, 10), (1, 20), (2, 10), (3, 40)]
    assert (1, 5) in table(spark, target) and (1, 6) not in table(spark, target), "swept by the second sync"


def test_nothing_is_swept_before_the_last_page(spark, tmp_path):
    write = s.batch_writer(str(tmp_path / "t"), str(tmp_path / "d"), 2)
    write(spark.createDataFrame(rows(PAGES[:4]), s.PAGES), 0)
    assert set(table(spark, str(tmp_path / "t"))) == {(1, 5), (1, 6), (1, 7), (1, 8)}
    write(spark.createDataFrame(rows(PAGES[4:5]), s.PAGES), 1)
    assert set(table(spark, str(tmp_path / "t"))) == {(1, 5), (1, 8)}

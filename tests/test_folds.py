"""Folds against a plain greedy pass, and hand-computed cases of reverts, pressings and owned copies."""

import datetime
from collections import Counter
from random import Random

import pytest

from lattica.operators.folds import focus_pages, known_candidates, master_folds, owned_copies, release_folds, reverted

HELD = "user_id bigint, release_id bigint, date_added timestamp_ntz, value double"


def day(n):
    return datetime.datetime(2024, 1, n)


class Frames:
    def __init__(self, **frames):
        self.__dict__.update(frames)


def catalog(spark, rows, held=(), wanted=()):
    """From (release, label, master, year)."""
    return Frames(
        releases=spark.createDataFrame([(r, y, lb, "p") for r, lb, m, y in rows], "release_id bigint, year bigint, label_id bigint, priority string"),
        masters=spark.createDataFrame([(r, m) for r, lb, m, y in rows], "release_id bigint, master_id bigint"),
        on=spark.createDataFrame([(r, lb) for r, lb, m, y in rows], "release_id bigint, label_id bigint"),
        media=spark.createDataFrame([(r, "A_F" if r % 2 else "A_O", "A") for r, *_ in rows], "release_id bigint, medium string, family string"),
        collected=spark.createDataFrame(list(held), HELD),
        wanted=spark.createDataFrame(list(wanted), HELD),
    )


def greedy(rows, budget):
    """Let masters go from the last on, each into its decade, until the view fits; else one bucket."""
    by = {}
    for r, lb, m, y in rows:
        by.setdefault(lb, {}).setdefault(m, []).append(y)
    out = set()
    for lb, masters in by.items():
        order = sorted(masters, key=lambda m: (-len(masters[m]), m))
        decades = {m: (lambda d: str(min(d) // 10 * 10) if d else "undated")([y for y in masters[m] if y]) for m in order}
        total = len(set(decades.values()))
        for mode in ("decade", "all"):
            keep, buckets = len(order), Counter()
            while keep and keep + len(buckets) > budget:
                keep -= 1
                buckets[decades[order[keep]] if mode == "decade" else "all"] += 1
            if keep + len(buckets) <= budget:
                out.add((lb, len(order), total, keep, len(buckets), mode))
                break
    return out


@pytest.mark.parametrize("budget", [2, 5, 9])
def test_master_folds(spark, budget):
    rng = Random(budget)
    rows = [(r, rng.randrange(12), rng.randrange(60), rng.choice([0, 1955, 1964, 1978, 1983, 1999, 2004])) for r in range(300)]
    rows += [(1000 + i, 99, 1000 + i, 1990) for i in range(3)]
    got = {tuple(r) for r in master_folds(catalog(spark, rows), budget).collect()}
    assert got == greedy(rows, budget)


def test_release_folds(spark):
    # Master 1 has releases 1 to 6, master 2 has 7; 4 is held. Originals are 1 and 7.
    c = catalog(spark, [(r, 5, 1, 1990) for r in range(1, 7)] + [(7, 5, 2, 1990)], held=[(1, 4, day(1), 1.0)])
    draw = lambda room: [tuple(r) for r in release_folds(c, room).collect()]
    assert draw(7) == [(5, 7, "everything", 7)]
    assert draw(4) == [(5, 7, "originals", 4)], "1, 4, 7 and the rest of master 1"
    assert draw(3) == [(5, 7, "stateful", 3)], "4 and two folds"
    assert draw(2) == [(5, 7, "folded", 2)]


def test_focus_pages_wrap(spark):
    c = catalog(spark, [(r, 5, r, 1990) for r in range(1, 8)])
    assert [tuple(r) for r in focus_pages(c, cursor=4, size=3).collect()] == [(5, 1, 3, 4, "4|5|6")], "page 4 of 3 is page 1"
    assert [tuple(r) for r in focus_pages(c, cursor=2, size=3).collect()] == [(5, 2, 1, 6, "7")]


def test_known_candidates(spark):
    # Releases of one master: 1 and 3 have a known medium, 2 has none, 5 is of another year.
    c = catalog(spark, [(1, 5, 1, 1990), (2, 5, 1, 1990), (3, 5, 1, 1990), (5, 5, 1, 1991)], wanted=[(1, r, day(1), 1.0) for r in (1, 2, 5)])
    got = {r.release_id: (r.candidates, r.compatible, r.contradicting) for r in known_candidates(c).collect()}
    assert got == {1: (4, 3, 1), 2: (4, 3, 1), 5: (4, 1, 3)}


def test_reverted(spark):
    rows = [(1, day(1), 7, "signup", 1.0, 10), (2, day(2), 8, "signup", 1.0, 10), (3, day(2), 9, "signup", 1.0, 11), (4, day(3), 9, "error", 1.0, 11), (5, day(3), 6, "signup", 1.0, None)]
    c = Frames(events=spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, k bigint"))
    assert sorted(tuple(r) for r in reverted(c).collect()) == [(10, 2, 1, "reverted"), (11, 3, None, "refused")]


def test_owned_copies(spark):
    rows = [(1, 1, day(1), 5.0), (1, 2, day(1), 5.0), (1, 2, day(25), 5.0), (1, 3, day(25), 5.0), (1, 4, day(1), 1.0), (1, None, day(1), 5.0)]
    got = {r.release_id: (r.state, r.acquired) for r in owned_copies(catalog(spark, [(1, 1, 1, 1990)], held=rows)).collect()}
    assert got == {1: ("unchanged", "2024-01-01"), 2: ("updated", "2024-01-25"), 3: ("inserted", "2024-01-25"), 4: ("unchanged", "2024-01-01")}


def test_greedy_crates(spark):
    from lattica.operators.crates import greedy, ranked

    pool = spark.createDataFrame([(1, 10, [1, 2, 3], 9), (1, 11, [3, 4], 5), (1, 12, [4, 5], 5), (1, 13, [1, 2], 1), (2, 10, [], 1)], "user_id bigint, master_id bigint, units array<bigint>, n bigint")
    # 10 adds three; then 12 adds two and 11 one; after that nothing adds any.
    assert sorted(tuple(r) for r in greedy(pool, 5).collect()) == [(1, "10|12", 5), (2, "", 0)]
    assert sorted(tuple(r) for r in ranked(pool, "n", 2).collect()) == [(1, "10|11", 4), (2, "10", 0)]


def test_fits_read_lines_of_users_releases(spark):
    """Beside the lines that rarity reads, only those of releases that users have or want."""
    from lattica.operators.folds import release_fits
    from lattica.operators.rarity import rarity_scores
    from lattica.plans import Catalog

    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate")
    c = Catalog(spark, "/root/testdata/sf0.001")
    assert scans(release_fits(c)) == scans(rarity_scores(c)) > 0

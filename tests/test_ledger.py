"""Merges and reverts in random order against plain code, and the state before a merge after its revert."""

import random

import pytest

from lattica.operators.ledger import Ledger, merge, revert


@pytest.fixture(autouse=True, scope="module")
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ledger")))


def start(spark, items, dependents):
    return Ledger.start(spark, spark.createDataFrame(items, "item_id bigint, kind string"), spark.createDataFrame(dependents, "kind string, row_id bigint, owner bigint, item_id bigint"))


def pair(spark, *rows):
    return spark.createDataFrame([(a, b, "catalog_reattachment", "d") for a, b in rows], "superseded bigint, survivor bigint, cause string, decision string")


def state(ledger):
    open_ = sorted((r.superseded, r.survivor, r.via_id is not None) for r in ledger.current().collect())
    return open_, sorted((r.kind, r.row_id, r.item_id) for r in ledger.dependents.collect())


class Plain:
    """The same rules on dictionaries, one pair at a time."""

    def __init__(self, dependents):
        self.at, self.rows, self.moves = {d[:2]: d[3] for d in dependents}, {}, []

    def open(self):
        return {k: r for k, r in self.rows.items() if r["to"] is None}

    def merge(self, a, b, t):
        current = {r["a"]: (k, r) for k, r in self.open().items()}
        if a == b or b in current or (a in current and current[a][1]["b"] != b):
            return False
        key = current[a][0] if a in current else f"{a}>{b}@{t}"
        if a not in current:
            for k, r in list(self.open().items()):
                if r["b"] == a:
                    r["to"] = t
                    self.rows[f"{k}|{key}"] = {"a": r["a"], "b": b, "via": key, "from": t, "to": None}
            self.rows[key] = {"a": a, "b": b, "via": None, "from": t, "to": None}
        for d, item in self.at.items():
            if item == a:
                self.at[d] = b
                self.moves.append((key, d, a, b))
        return True

    def revert(self, key, t):
        row = self.rows.get(key)
        if row is None or row["to"] is not None or row["via"]:
            return False
        row["to"] = t
        for r in list(self.rows.values()):
            if r["via"] == key and r["to"] is None:
                r["to"] = t
                for p in self.rows.values():
                    if (p["a"], p["b"], p["to"]) == (r["a"], row["a"], r["from"]):
                        p["to"] = None
        for k, d, a, b in self.moves:
            if k == key and self.at[d] == b:
                self.at[d] = a
        return True

    def state(self):
        return sorted((r["a"], r["b"], r["via"] is not None) for r in self.open().values()), sorted((*d, i) for d, i in self.at.items())


def test_random_sequences(spark):
    rng = random.Random(14)
    items = [(i, "release") for i in range(8)]
    dependents = [(rng.choice(["artifacts", "owned_copies"]), i, i % 3, rng.randrange(8)) for i in range(25)]
    ledger, plain = start(spark, items, dependents), Plain(dependents)
    refused = 0
    for t in range(1, 10):
        if rng.random() < 0.6 or not plain.rows:
            a, b = rng.randrange(8), rng.randrange(8)
            ledger, no = merge(ledger, pair(spark, (a, b)), t)
            done = plain.merge(a, b, t)
        else:
            key = rng.choice(sorted(plain.rows))
            ledger, no = revert(ledger, spark.createDataFrame([(key,)], "id string"), t)
            done = plain.revert(key, t)
        assert (no.count() == 0) == done
        refused += not done
        assert state(ledger) == plain.state()
    assert 0 < refused < 8
    assert ledger.moves.count() == len(plain.moves)


def test_merge_merge_revert_revert_is_the_state_before(spark):
    """A into X, X into D: A leads to D at once. Its compressed row can't be reverted; the merge that compressed it can, then the first."""
    ledger = start(spark, [(i, "work") for i in (1, 2, 3)], [("artifacts", 10, 1, 1), ("artifacts", 11, 1, 2), ("owned_copies", 12, 1, 3)])
    zero = state(ledger)
    ledger, _ = merge(ledger, pair(spark, (1, 2)), 1)
    one = state(ledger)
    ledger, _ = merge(ledger, pair(spark, (2, 3)), 2)
    assert state(ledger) == ([(1, 3, True), (2, 3, False)], [("artifacts", 10, 3), ("artifacts", 11, 3), ("owned_copies", 12, 3)])
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    same, no = revert(ledger, ids("1>2@1|2>3@2", "nothing", "1>2@1"), 3)
    assert {r.id: r.refused.split(";")[0] for r in no.collect()} == {"1>2@1|2>3@2": "was compressed by 2>3@2", "nothing": "does not exist", "1>2@1": "is not current"}
    assert state(same) == state(ledger)
    ledger, _ = revert(ledger, ids("2>3@2"), 4)
    assert state(ledger) == one
    ledger, _ = revert(ledger, ids("1>2@1"), 5)
    assert state(ledger) == zero
    assert ledger.moves.count() == 3, "the ledger stays"


def test_refusals(spark):
    ledger = start(spark, [(1, "work"), (2, "work"), (3, "release"), (4, "work"), (5, "work")], [("artifacts", 10, 1, 1)])
    ledger, no = merge(ledger, pair(spark, (1, 1), (1, 9), (2, 3)), 1)
    assert sorted(r.refused for r in no.collect()) == ["an item cannot supersede itself", "an item does not exist", "kinds differ"]
    ledger, no = merge(ledger, pair(spark, (1, 2), (2, 4)), 1)
    assert {r.refused for r in no.collect()} == {"pairs of one batch meet in an item"}
    ledger, no = merge(ledger, pair(spark, (1, 2)), 2)
    assert no.count() == 0
    ledger, no = merge(ledger, pair(spark, (1, 4)), 3)
    assert [r.refused for r in no.collect()] == ["already superseded by another item"]
    ledger, no = merge(ledger, pair(spark, (5, 1)), 3)
    assert [r.refused for r in no.collect()] == ["the survivor is itself superseded"]
    again, no = merge(ledger, pair(spark, (1, 2)), 4)
    assert no.count() == 0 and state(again) == state(ledger)

"""Clustering, importance resampling and sharding against plain Python versions, on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

DIMS = 6


# centroid clustering


def brute_clusters(rows, k, rounds, seed="2", dims=DIMS, scale=256):
    largest = 2**27
    kept = [(i, [max(-largest, min(largest, math.floor(x * scale))) if abs(x) < 1e15 else math.copysign(largest, x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [int(x) for x in v]) for i, v in kept]
    order = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=order)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    by = collections.Counter()
    for d, c in found:
        by[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda x: x if x < 2**63 else None
    return collections.Counter((i, c, d, fits(by[c]), fits(sum(by.values())), sha[c]) for (i, _), (d, c) in zip(kept, found, strict=True))


def vectors(n=400, seed=3, dims=DIMS):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(9)]
    rows = [(i, [m + rng.gauss(0, 0.2) for m in rng.choice(middles)]) for i in range(n)]
    rows += [(n + i, [0.5] * dims) for i in range(60)]  # one vector many times
    rows += [(3, rows[3][1]), (3, rows[3][1]), (5, [0.25] * dims), (None, [0.1] * dims), (None, [0.1] * dims)]
    return rows + [(900, None), (901, []), (902, [0.0] * (dims - 1)), (903, [0.0] * (dims + 1)), (904, [None] + [0.0] * (dims - 1)), (905, [math.nan] + [0.0] * (dims - 1)), (906, [math.inf] + [0.0] * (dims - 1))]


def clusters(spark, rows, kind="double", **options):
    from lattica.llm.clustering import cluster, cluster_digest

    df = spark.createDataFrame([(i, v, i, "x") for i, v in rows], f"vec_id bigint, embedding array<{kind}>, label bigint, cluster string")
    found = cluster(df, dims=DIMS, **options)
    return collections.Counter(map(tuple, cluster_digest(found).collect())), found


@pytest.mark.parametrize(("k", "rounds", "block"), [(7, 5, 37), (1, 2, 1000), (40, 3, 64), (7, 0, 50)])
def test_clusters(spark, k, rounds, block):
    rows = vectors()
    got, found = clusters(spark, rows, k=k, rounds=rounds, block=block)
    assert got == brute_clusters(rows, k, rounds)
    assert len(found.rescanned) == rounds


def test_clusters_rescan_few_once_they_settle(spark):
    rows = vectors(3000)
    got, found = clusters(spark, rows, k=9, rounds=12, block=300)
    assert got == brute_clusters(rows, 9, 12)
    assert found.rescanned[0] == 3065
    assert sum(found.rescanned[6:]) < 3065


def test_clusters_of_large_components(spark):
    """Beyond 2^53 squared distances are still exact; beyond 2^27 a component counts as 2^27."""
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-4e5, 4e5) for _ in range(DIMS)]) for i in range(80)] + [(100, [1e300] * DIMS), (101, [-1e12] * DIMS), (102, [1e6] * DIMS)]
    assert clusters(spark, rows, k=5, rounds=4, block=16)[0] == brute_clusters(rows, 5, 4)


def test_clusters_ties_few_and_none(spark):
    rows = [(i, [float(i % 2)] * DIMS) for i in range(20)]  # equal first centroids: the later ones are empty
    assert clusters(spark, rows, k=4, rounds=3)[0] == brute_clusters(rows, 4, 3)
    rows = rows[:3]
    assert clusters(spark, rows, k=9, rounds=3)[0] == brute_clusters(rows, 9, 3)
    got, found = clusters(spark, [(1, None)], k=9, rounds=3)
    assert not got and not found.centroids
    assert clusters(spark, vectors(), kind="float", k=5, rounds=1)[0].total() == 465


def test_rounds_shuffle_no_vectors(spark):
    """Blocks and heaps are bucketed alike: their join has no exchange."""
    from lattica.llm.common import Scratch

    scratch = Scratch(spark, "plan")
    a, b = (scratch.save_buckets(spark.range(100).select(F.col("id").cast("int").alias("block"), F.lit(x).alias(x)), "block", 4) for x in ("a", "b"))
    plan = a.hint("merge").join(b, "block")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    scratch.remove()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("scratch_")]


# importance resampling

TEXTS = ["The cat sat", "dogs & cats, DOGS; dogs", "", None, "  \n\t", "É é ÉÉ straße x1 2y", "a" * 50, "nul\x00between", "one two three four five six seven " * 12, "the of and to " * 4000, "\U0001f600 smile\U0001f600x"]
SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = SPLIT.findall(lower)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_importance(rows, target, longest, buckets, least, percent):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(map(crc, features(x, longest)[1]))
    for x in target:
        t.update(map(crc, features(x, longest)[1]))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    out = []
    for i, x in rows:
        words, runs = features(x, longest)
        weight = sum(gain[crc(f)] for f in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    ranked = fit[: len(fit) * percent // 100]
    rest = collections.Counter(out) - collections.Counter(ranked)
    return collections.Counter([(*r, k + 1) for k, r in enumerate(ranked)] + [(*r, None) for r in rest.elements()])


def corpus(n=150, seed=8):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Über", "THE", "the", "x-y"]
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    return rows + [rows[-1], rows[-1], (None, rows[-2][1]), (None, rows[-2][1]), (None, None)]


@pytest.mark.parametrize(("longest", "buckets", "least", "percent"), [(1, 10_000, 20, 10), (3, 97, 5, 35), (2, 1000, 0, 100)])
def test_importance(spark, longest, buckets, least, percent):
    from lattica.llm.resampling import importance

    rows = corpus()
    target = ["w1 w2 w3 the W4", None, "Über w1 w1"]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id bigint, text string, score string, rank int").repartition(5)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, buckets int")
    got = importance(df, wanted, longest=longest, buckets=buckets, least_words=least, percent=percent)
    got = collections.Counter(map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()))
    assert got == brute_importance(rows, target, longest, buckets, least, percent)


def test_importance_without_rows_or_target(spark):
    from lattica.llm.resampling import importance, resample

    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    assert importance(none, none).collect() == [] and resample(none, some).collect() == []
    got = collections.Counter(map(tuple, importance(some, none).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()))
    assert got == brute_importance(corpus(), [], 1, 10_000, 20, 10)


def test_resample_returns_the_drawn_rows(spark):
    from lattica.llm.resampling import importance, resample

    rows = corpus()
    df = spark.createDataFrame([(i, t, "r", k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, row string, key int")
    target = spark.createDataFrame([("w1 w2 w3",)], "text string")
    drawn = resample(df, target, percent=40)
    assert drawn.columns == df.columns
    want = importance(df, target, percent=40).where("rank is not null").select("doc_id").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in drawn.collect()) == sorted((r["doc_id"] is None, r["doc_id"]) for r in want)
    assert {(r["doc_id"], r["text"]) for r in drawn.collect()} <= set(rows)


def test_draws_follow_importance(spark):
    """Documents of the target's words are drawn far more often than their share."""
    from lattica.llm.resampling import importance

    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"] if i % 10 == 0 else ["delta", "eps", "zeta"]) for _ in range(30))) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = importance(df, spark.createDataFrame([("alpha beta gamma " * 9,)], "text string"), buckets=500).where("rank is not null").collect()
    assert len(got) == 100 and sum(r["doc_id"] % 10 == 0 for r in got) > 75


# sharding


def brute_shard(key, weights):
    bids = []
    for j, w in enumerate(weights):
        u = (int(hashlib.md5(f"{key}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        bids.append((-w / math.log(u), j))
    return max(bids)[1]


def records():
    rng = random.Random(6)
    rows = [(i * 7 - 50, " ".join(rng.choice("abcé") for _ in range(rng.randrange(30)))) for i in range(500)]
    return rows + [rows[4], rows[4], (9, None), (9, ""), (10, "x" * 200_000)] + [(None, t) for t in ("a", "a", None, "b")]


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_slots(spark, shards):
    from lattica.llm.sharding import shard_slots

    rows = records()
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id bigint, text string, shard int, size string").repartition(6)
    got = shard_slots(df, shards).collect()
    want = collections.Counter()
    for i, t in rows:
        b, key = (t or "").encode(), "" if i is None else i
        want[i, len(b) + 1, zlib.crc32(b), "key", brute_shard(key, [1] * shards), brute_shard(key, [1] * (shards + 1))] += 1
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], shards)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_weights_shares_and_moves(spark):
    from lattica.llm.sharding import assign_shards, moved

    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    weights = [1.0, 2.0, 1.0]
    n = {r["shard"]: r["count"] for r in assign_shards(df, weights=weights).groupBy("shard").count().collect()}
    assert all(abs(n[i] / 20_000 - w / 4) < 0.015 for i, w in enumerate(weights))
    grown = moved(df, "doc_id", weights, [*weights, 1.0]).collect()
    assert {r["to_shard"] for r in grown} == {3} and abs(sum(r["rows"] for r in grown) / 20_000 - 0.2) < 0.015
    heavier = moved(df, "doc_id", weights, [2.0, 2.0, 1.0]).collect()
    assert {r["to_shard"] for r in heavier} == {0}
    with pytest.raises(ValueError, match="weight"):
        assign_shards(df, weights=[1.0, 0.0])


def test_written_shards(spark, tmp_path):
    from lattica.llm.sharding import assign_shards, write_shards

    df = spark.createDataFrame([(i, t, "v", "w") for i, t in records()], "doc_id bigint, text string, lang string, bid string")
    write_shards(df, str(tmp_path / "out"), key=["doc_id", "lang"], weights=[1.0, 3.0], file_rows=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    want = assign_shards(df, key=["doc_id", "lang"], weights=[1.0, 3.0])
    rows = lambda d: collections.Counter(map(tuple, d.select("doc_id", "text", "lang", "bid", "shard").collect()))
    assert rows(back) == rows(want)
    for f in (tmp_path / "out").rglob("*.parquet"):
        assert spark.read.parquet(str(f)).count() <= 100


def test_sharding_nothing(spark):
    from lattica.llm.sharding import shard_slots

    assert shard_slots(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


# compiled rules of the classifier


def test_compiled_rules_score_like_plain_ones(spark):
    """The column expression of a rule model against its conditions evaluated one by one."""
    from lattica.llm.classifier import FEATURES, RuleModel

    rng = random.Random(17)
    rules = []
    for _ in range(25):
        conditions = {f: rng.choice([(round(rng.random(), 2), None), (None, round(rng.random(), 2)), (round(rng.random() / 2, 2), round(0.5 + rng.random() / 2, 2))]) for f in rng.sample(FEATURES, rng.randrange(1, 4))}
        rules.append((conditions, rng.uniform(-2, 2)))
    model = RuleModel(0.3, rules)
    rows = [tuple(round(rng.random(), 2) for _ in FEATURES) for _ in range(200)] + [tuple(0.0 for _ in FEATURES)]

    def plain(row):
        total = model.intercept
        for conditions, weight in rules:
            x = {f: row[FEATURES.index(f)] for f in conditions}
            if all((low is None or x[f] > low) and (high is None or x[f] <= high) for f, (low, high) in conditions.items()):
                total += weight
        return 1 / (1 + math.exp(-total))

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{f} double" for f in FEATURES))
    got = {r["i"]: r["s"] for r in df.select("i", model.score().alias("s")).collect()}
    assert all(abs(got[i] - plain(r)) < 1e-12 for i, r in enumerate(rows))

"""Signatures in inscriptions on hand-made rules, and refusals of large roots."""

from pyspark.sql import functions as F

from lattica.operators.inscriptions import accepted, exact, interpret, measured
from lattica.operators.scopes import strata
from lattica.plans import Catalog

RULES = [
    ("NORTH  PLANT", "plant", "north"), ("A1 77-X NORTH PLANT", "plant", "north"), ("EAST PLANT", "plant", "east"), ("EAST PLANT", "plant", "far east"),
    ("PLANT CUT", "plant", "other"), ("CUT", "engineer", "c"), ("(a.b)", "mark", "dots"), (r"q\\Ez", "mark", "quoted"), ("NOWHERE", "plant", "none"), ("  ", "plant", "blank"), (None, "plant", "null"),
]
TEXTS = [
    (1, "A1 77-X  NORTH\tPLANT"), (2, "B2 EAST PLANT"), (3, "NORTH PLANT CUT"), (4, "NORTH PLANTS"), (5, "x(a.b)"), (6, "(a.b) (a.b)"), (7, "(axb)"),
    (8, r"see q\\Ez."), (9, ""), (10, None), (11, "north plant"), (12, "CUT-CUT RECUT"), (13, "EAST PLANT"), (14, "NORTH PLANT"),
]


def test_signatures_match_whole_tokens_and_clashes_are_ambiguous(spark):
    texts, rules = spark.createDataFrame(TEXTS, "id int, text string"), spark.createDataFrame(RULES, "signature string, role string, candidate string")
    read = interpret(texts, rules)
    got = {r.id: [(s.start, s.end, s.signature, s.ambiguous) for s in r.spans] for r in read.collect()}
    assert got == {
        1: [(0, 20, "A1 77-X NORTH PLANT", False), (9, 20, "NORTH PLANT", False)], 2: [(3, 13, "EAST PLANT", True)],
        3: [(0, 11, "NORTH PLANT", True), (6, 15, "PLANT CUT", True), (12, 15, "CUT", False)], 4: [], 5: [], 6: [(0, 5, "(a.b)", False), (6, 11, "(a.b)", False)], 7: [],
        8: [(4, 9, r"q\\Ez", False)], 9: [], 10: [], 11: [], 12: [(0, 3, "CUT", False), (4, 7, "CUT", False)], 13: [(0, 10, "EAST PLANT", True)], 14: [(0, 11, "NORTH PLANT", False)],
    }
    said = {(r.id, r.role, r.candidate) for r in accepted(read).collect()}
    assert said == {(1, "plant", "north"), (3, "engineer", "c"), (6, "mark", "dots"), (8, "mark", "quoted"), (12, "engineer", "c"), (14, "plant", "north")}
    assert {(r.id, r.candidate) for r in exact(texts, rules).collect()} == {(1, "north"), (14, "north")}


def test_measures_are_null_where_undefined(spark):
    schema = "id int, role string, candidate string"
    expected, none, cases = (spark.createDataFrame(r, schema) for r in ([(1, "a", "x"), (2, "a", "y")], [], [(1, "", ""), (2, "", ""), (3, "", "")]))
    found = spark.createDataFrame([(1, "a", "x"), (1, "a", "z")], schema)
    assert tuple(measured(found, expected, cases).first()) == (2, 1, 1, 3, 500000, 333333)
    assert tuple(measured(none, expected, none).first()) == (0, 0, 0, 0, None, None)


def test_large_roots_are_refused(spark):
    got = strata(Catalog(spark, "/root/testdata/sf0.001"), most=10)
    counts = {r.status: (r.least, r.most, r.drawn) for r in got.groupBy("status").agg(F.min("releases").alias("least"), F.max("releases").alias("most"), F.count("entries").alias("drawn")).collect()}
    assert counts["served"][1] <= 10 < counts["refused"][0] and counts["refused"][2] == 0 < counts["served"][2]


def test_typed_spans_are_the_text_and_unknown_ones_what_is_left(spark):
    import random

    from pyspark.sql import functions as F

    from lattica.operators.inscriptions import lexical_spans, unknown_spans

    def kind(ch):
        return "whitespace" if ch.isspace() else "letters" if ch.isalpha() else "numbers" if ch.isdecimal() else "alphanumeric" if ch.isalnum() else "marks"

    def lex(text):
        out, run = [], {"letters", "numbers", "alphanumeric"}
        for i, ch in enumerate(text):
            k = kind(ch)
            if out and (kind(text[out[-1][0]]) == k or {k, kind(text[out[-1][0]])} <= run):
                out[-1][1] = i + 1
            else:
                out.append([i, i + 1])
        named = []
        for a, b in out:
            piece, k = text[a:b], kind(text[a])
            if k in run and any(map(str.isalpha, piece)) and any(map(str.isdecimal, piece)):
                k = "alphanumeric"
            named.append((piece, a, b, k))
        return named

    rng = random.Random(8)
    texts = ["", "A-1  B2²", "²3", "\t\n", "é~~1"] + ["".join(rng.choice("aB1 2-~é²\t") for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = []
    for i, t in enumerate(texts):
        spans = sorted((a, min(len(t), a + rng.randrange(1, 9))) for a in rng.sample(range(len(t)), min(len(t), rng.randrange(4))))
        rows.append((i, t, spans))
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<start:int,end:int>>")
    got = df.select("i", lexical_spans(F.col("t")).alias("l"), unknown_spans(F.col("t"), F.col("s")).alias("u")).collect()
    for r in got:
        _, text, spans = rows[r.i]
        assert [tuple(x) for x in r.l] == lex(text) and "".join(x.text for x in r.l) == text
        left, at = [], 0
        for a, b in [*spans, (len(text), len(text))]:
            left += [(p, at + x, at + y, k) for p, x, y, k in lex(text[at:a])]
            at = max(at, b)
        assert [tuple(x) for x in r.u] == left


def test_equal_texts_are_read_once(spark):
    """Many inscriptions of one text cost one reading: signatures are matched on distinct texts, and nothing of the inscriptions' number is sent to the driver."""
    texts = spark.range(1000).selectExpr("id", "concat('made by ACME ', id % 4) AS text")
    rules = spark.createDataFrame([("ACME", "maker", "acme")], "signature string, role string, candidate string")
    read = interpret(texts, rules)
    got = read.collect()
    assert len(got) == 1000 and all([(s.start, s.end) for s in r.spans] == [(8, 12)] for r in got)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join LeftOuter" in line and "text#" in line and "merge" in line for line in plan.splitlines())


def test_metrics_join_by_merge(spark):
    from lattica.operators.inscriptions import measured

    rows = spark.createDataFrame([(1, "maker", "acme")], "id long, role string, candidate string")
    df = measured(rows, rows, rows.select("id"))
    assert df.first().correct == 1
    assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_typed_spans_are_spread(spark):
    """One file of texts is one or few tasks else."""
    from lattica.operators.inscriptions import typed_spans

    assert typed_spans(Catalog(spark, "/root/testdata/sf0.001")).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism

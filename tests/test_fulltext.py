"""The inverted index, its ranks and its headlines against a plain scan."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lattica.operators import fulltext as ft

# Pairs of the stemmer's published vocabulary.
STEMS = dict(p.split(":") for p in """consign:consign consigned:consign consigning:consign consignment:consign consistency:consist consistently:consist consolation:consol consolatory:consolatori
consolidate:consolid consoling:consol knackeries:knackeri knaves:knave knavish:knavish kneaded:knead kneeled:kneel knightly:knight knitted:knit knives:knive generate:generat
generously:generous hopping:hop hoping:hope cries:cri ties:tie dying:die happy:happi say:say by:by skies:sky rational:ration relational:relat conditional:condit vietnamization:vietnam
feed:feed agreed:agre plastered:plaster electricity:electr hopefulness:hope adoption:adopt replacement:replac rate:rate cease:ceas inning:inning innings:inning communication:communic
controlled:control sensational:sensat formative:format gas:gas this:this kiwis:kiwi youth:youth toys:toy""".split())


@pytest.fixture(autouse=True, scope="module")
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("search")))


def test_stems(spark):
    got = ft.stemmed(spark.createDataFrame([(w,) for w in STEMS], "w string")).collect()
    assert {r.w: r.stem for r in got} == STEMS


def test_lexemes(spark):
    assert ft.lexemes(spark, "The RINGS of the ring, running; and_so") == ["ring", "run", "and_so"]
    assert ft.lexemes(spark, "the of and") == ft.lexemes(spark, "  ") == []


WORD = re.compile(r"\w+")


def scan(texts, stems, terms):
    """{id: (rank, hits)} by looking at every text."""
    out = {}
    for i, t in texts:
        at = {}
        for p, w in enumerate(WORD.findall((t or "").lower()), 1):
            if w not in ft.STOP_WORDS:
                at.setdefault(stems[w], []).append(p)
        if not all(x in at for x in terms):
            continue
        if len(terms) == 1:
            rank = sum(0.1 / (j * j) for j in range(1, len(at[terms[0]]) + 1)) / 1.64493406685
        else:
            rest = 1.0
            for a in range(len(terms)):
                for b in range(a):
                    for p in at[terms[a]]:
                        for q in at[terms[b]]:
                            d = abs(p - q)
                            rest *= 1 - (0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))) if d <= 100 else 0.1e-15)
            rank = 1 - rest
        out[i] = (math.floor(round(rank, 9) * 1e6 + 0.5), sorted(p for x in terms for p in at[x]))
    return out


def shown(text, hits, words):
    found = list(WORD.finditer(text))
    if len(found) <= words:
        first, last = 1, len(found)
    else:
        first = min(max(hits, key=lambda p: (sum(p <= x < p + words for x in hits), -p)), len(found) - words + 1)
        last = first + words - 1
    out, at = [], 0 if len(found) <= words else found[first - 1].start()
    for k in range(first, last + 1):
        m = found[k - 1]
        out.append(text[at : m.start()] + (f"<b>{m.group()}</b>" if k in hits else m.group()))
        at = m.end()
    return "".join(out) + (text[at:] if len(found) <= words else "")


def texts():
    rng = random.Random(3)
    words = ["ring", "rings", "ringing", "small", "smaller", "blue", "the", "of", "gear", "Gear", "é", "x_1"]
    out = [(i, " ".join(rng.choice(words) + rng.choice(["", "", ",", ".\n"]) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    far = "small " + "filler " * 150 + "ring"
    return [*out, (100, far), (101, "  Small-ring!  "), (102, ""), (103, None), (104, "ring " * 400 + "small " * 3), (105, "the the"), (106, "small ring small ring")]


@pytest.mark.parametrize("q", ["small rings", "ring", "gear blue the small", "absent", "the"])
def test_matches_equal_a_scan(spark, q, tmp_path):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "id bigint, text string, term int")
    every = sorted({w for _, t in rows for w in WORD.findall((t or "").lower())})
    stems = {r.w: r.stem for r in ft.stemmed(spark.createDataFrame([(w,) for w in every], "w string")).collect()}
    terms = ft.lexemes(spark, q)
    index = ft.write_index(ft.postings(docs, ["id"], "text"), str(tmp_path / "index"))
    got = {r.id: (r["rank"], r.hits) for r in ft.matched(index, ["id"], terms).collect()}
    assert got == (scan(rows, stems, terms) if terms else {})
    head = ft.matched(index, ["id"], terms).join(docs, "id").select("id", ft.headline(F.col("text"), F.col("hits"), 10).alias("h")).collect()
    assert {r.id: r.h for r in head} == {i: shown(dict(rows)[i], hits, 10) for i, (_, hits) in got.items()}


def test_index_reads_the_terms_that_are_asked_for(spark, tmp_path):
    docs = spark.createDataFrame(texts(), "id bigint, text string")
    index = ft.write_index(ft.postings(docs, ["id"], "text"), str(tmp_path / "index"))
    plan = index.where(F.col("term").isin(["ring"]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "ring" in plan.split("PushedFilters")[1]


def test_composed_pages_add_up(spark):
    from lattica.plans import Catalog

    c = Catalog(spark, "/root/testdata/sf0.001")
    index = ft.name_index(c)
    part = lambda **kw: ft.composed(c, index, "small rings", **kw).collect()
    whole, first, second = part(limit=1000), part(limit=7), part(limit=7, offset=7)
    ids = lambda rows: [(r.place, r.key, r.id) for r in sorted(rows, key=lambda r: r.place or 0) if r.section == "result"]
    assert ids(first) + ids(second) == ids(whole)[:14]
    value = lambda rows, key: next(r.value for r in rows if r.section == "pagination" and r.key == key)
    assert value(whole, "total") == len(ids(whole)) == sum(r.value for r in whole if r.section == "type")
    assert value(first, "has_more") == 1 and value(whole, "has_more") == 0
    assert all("<b>small</b> <b>ring</b>" == r.highlight for r in first if r.section == "result")
    with pytest.raises(ValueError, match="types"):
        ft.composed(c, index, "x", types=())


def test_tokens_are_stemmed_once_each(spark, tmp_path, monkeypatch):
    """The stemmer sees the distinct tokens, not those of each text."""
    seen, plain = [], ft.stemmed
    monkeypatch.setattr(ft, "stemmed", lambda df: seen.append(df) or plain(df))
    docs = spark.createDataFrame([(i, "rings ringing rings small" if i % 2 else "ring the smaller") for i in range(50)], "id bigint, text string")
    found = {(r.id, r.term): r.positions for r in ft.postings(docs, ["id"], "text").collect()}
    assert seen[0].count() == 5
    assert found[1, "ring"] == [1, 2, 3] and found[1, "small"] == [4] and found[0, "ring"] == [1] and found[0, "smaller"] == [3]


def test_names_are_indexed_once(spark):
    """The index of names grows with the names, not with the releases that share them."""
    from lattica.plans import Catalog

    c = Catalog(spark, "/root/testdata/sf0.001")
    names = c.artists.select("name").union(c.labels.select("name")).union(c.table("part").select("p_name")).distinct()
    assert ft.name_index(c).select("name").distinct().count() == names.count() < c.masters.count() + names.count()

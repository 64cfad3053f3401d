"""Inscriptions: where known signatures stand in a text, and how far that can be trusted (section 2.14, B15 and B17)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import running_sums, scaled
from ..plans import Catalog, query

_TOKEN = r"(?U)[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
_ALNUM = r"[\p{L}\p{N}]"


def signature_of(text: Column) -> Column:
    """The text with each run of white space as one space, trimmed; case and marks stay."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)))


def _spans(text: str, regex: str) -> Column:
    """array<struct<start, end>> of the matches, in characters; ``text`` and ``regex`` name columns."""
    found, pieces = F.regexp_extract_all(F.col(text), F.col(regex), F.lit(0)), F.split(F.col(text), F.col(regex), -1)
    sums = running_sums(F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda x, y: F.length(x) + F.length(y)))
    start = lambda at, i: at + F.length(F.get(pieces, i))
    return F.transform(sums, lambda at, i: F.struct(start(at, i).alias("start"), (start(at, i) + F.length(F.get(found, i))).alias("end")))


def _clash(x: Column, y: Column) -> Column:
    """Whether two overlapping spans name different candidates for a role that both have."""
    of = lambda s, role: F.filter(s["candidates"], lambda p: p["role"] == role)
    differ = F.exists(x["candidates"], lambda p: (F.size(of(y, p["role"])) > 0) & (of(x, p["role"]) != of(y, p["role"])))
    return (x["start"] < y["end"]) & (y["start"] < x["end"]) & differ


def interpret(inscriptions: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, spans) from (id, text) and (signature, role, candidate): spans is an array of struct<start, end, signature, candidates, ambiguous>.

    A signature matches literally, with any white space where it has some, and never inside a longer alphanumeric token. A span is
    ambiguous if its signature has several candidates, or if it overlaps a span with other candidates for a role of both. Texts meet
    rules by the rule's rarest token, so no rule is held against all texts. A null text or signature matches nothing.
    """
    rules = rules.select(signature_of(F.col("signature")).alias("signature"), "role", "candidate").where("signature != ''")
    known = rules.groupBy("signature").agg(F.sort_array(F.collect_set(F.struct("role", "candidate"))).alias("candidates"))
    # Inscriptions of one text read alike, so texts are read once each; a text's bytes say little of the work it makes, so texts are spread by number.
    spread = 4 * inscriptions.sparkSession.sparkContext.defaultParallelism
    texts = inscriptions.where("text is not null").select("text").distinct()
    tokens = texts.repartition(spread, "text").select("text", F.explode(_tokens(F.col("text"))).alias("token"))
    asked = known.select("signature", F.explode(_tokens(F.col("signature"))).alias("token"))
    counts = tokens.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    # A signature with a token that no text has can't match: its least count is none.
    rarest = asked.join(counts, "token", "left").groupBy("signature").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("x"))
    rarest = rarest.where("x.n > 0").select("signature", F.col("x.token").alias("token"))
    pairs = tokens.join(rarest, "token").select("text", "signature").repartition(spread, "text").join(known, "signature")
    words = F.transform(F.split("signature", " "), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pairs = pairs.withColumn("regex", F.concat(F.lit("(?U)"), F.array_join(words, r"\s+"))).withColumn("at", F.explode(_spans("text", "regex")))
    alone = lambda place: ~F.rlike(F.substr("text", place, F.lit(1)), F.lit(_ALNUM))
    pairs = pairs.where(((F.col("at.start") == 0) | alone(F.col("at.start"))) & alone(F.col("at.end") + 1))
    span = F.struct("at.start", "at.end", "signature", "candidates")
    matched = pairs.groupBy("text").agg(F.sort_array(F.collect_list(span)).alias("all"))
    unsure = lambda x: (F.size(x["candidates"]) > 1) | F.exists("all", lambda y: _clash(x, y))
    rated = F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["signature"].alias("signature"), x["candidates"].alias("candidates"), unsure(x).alias("ambiguous")))
    none = F.array().cast("array<struct<start:int,end:int,signature:string,candidates:array<struct<role:string,candidate:string>>,ambiguous:boolean>>")
    # Files of texts are small beside their rows, so sizes by files must not make this a broadcast.
    return inscriptions.select("id", "text").join(matched.select("text", rated.alias("spans")).hint("merge"), "text", "left").select("id", F.coalesce("spans", none).alias("spans"))


_PIECE = r"(?U)[\p{L}\p{N}]+|\s+|[^\s\p{L}\p{N}]+"


def _kind(piece: Column) -> Column:
    """The kinds of spans. A run of letters and digits is alphanumeric if it has both, else what its first character is."""
    first = F.substring(piece, 1, 1)
    has = lambda x, regex: F.rlike(x, F.lit(regex))
    run = F.when(has(piece, r"\p{L}") & has(piece, r"\p{Nd}"), "alphanumeric").when(has(first, r"\p{L}"), "letters").when(has(first, r"\p{Nd}"), "numbers").otherwise("alphanumeric")
    return F.when(has(first, r"(?U)\s"), "whitespace").when(has(first, r"[\p{L}\p{N}]"), run).otherwise("marks")


def lexical_spans(text: Column) -> Column:
    """array<struct<text, start, end, kind>>: the text in runs of letters and digits, of white space, and of other marks; together they are the text."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    starts = running_sums(F.transform(pieces, F.length))
    return F.zip_with(pieces, starts, lambda p, at: F.struct(p.alias("text"), at.alias("start"), (at + F.length(p)).alias("end"), _kind(p).alias("kind")))


def unknown_spans(text: Column, spans: Column) -> Column:
    """The typed spans of what ``spans`` (struct<start, end, ..>, ascending) leave of the text, with their places in it."""
    gap = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    none = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc: Column, x: Column) -> Column:
        out = F.when(x["start"] > acc["at"], F.array_append(acc["gaps"], gap(acc["at"], x["start"]))).otherwise(acc["gaps"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("gaps"))

    rest = lambda acc: F.when(acc["at"] < F.length(text), F.array_append(acc["gaps"], gap(acc["at"], F.length(text)))).otherwise(acc["gaps"])
    gaps = F.aggregate(spans, F.struct(F.lit(0).alias("at"), none.alias("gaps")), step, rest)
    moved = lambda g: F.transform(lexical_spans(F.substr(text, g["a"] + 1, g["b"] - g["a"])), lambda x: F.struct(x["text"].alias("text"), (x["start"] + g["a"]).alias("start"), (x["end"] + g["a"]).alias("end"), x["kind"].alias("kind")))
    return F.flatten(F.transform(gaps, moved))


def accepted(read: DataFrame) -> DataFrame:
    """(id, role, candidate), distinct: what the spans that are not ambiguous say."""
    sure = F.flatten(F.transform(F.filter("spans", lambda x: ~x["ambiguous"]), lambda x: x["candidates"]))
    return read.select("id", F.explode(sure).alias("x")).select("id", "x.*").distinct()


def exact(inscriptions: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, role, candidate) where a rule's signature is the whole text and has one candidate only."""
    one = rules.select(signature_of(F.col("signature")).alias("signature"), "role", "candidate").distinct().groupBy("signature")
    one = one.agg(F.count("*").alias("n"), F.first("role").alias("role"), F.first("candidate").alias("candidate")).where("n = 1 and signature != ''")
    return inscriptions.select("id", signature_of(F.col("text")).alias("signature")).join(one, "signature").select("id", "role", "candidate")


def measured(found: DataFrame, expected: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: accepted, correct, covered, cases and the two shares in millionths (null where undefined)."""
    right = expected.select("id", "role", "candidate").distinct().withColumn("right", F.lit(True))
    rows = found.join(right.hint("merge"), ["id", "role", "candidate"], "left").agg(F.count("*").alias("accepted"), F.count("right").alias("correct"), F.count_distinct("id").alias("covered"))
    rows = rows.join(F.broadcast(cases.agg(F.count("*").alias("cases"))))
    share = lambda a, b: F.when(F.col(b) > 0, scaled(F.col(a) / F.col(b)))
    return rows.select("*", share("correct", "accepted").alias("precision_ppm"), share("covered", "cases").alias("coverage_ppm"))


def part_inscriptions(c: Catalog) -> DataFrame:
    return c.table("part").select(F.col("p_partkey").alias("id"), F.concat(F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit("  "), "p_type", F.lit("-"), "p_brand").alias("text"), "p_brand")


def part_rules(c: Catalog) -> DataFrame:
    """Signatures of names, kinds of names, types, brands and some whole inscriptions."""
    part = c.table("part")
    rule = lambda df, signature, role, candidate: df.select(signature.alias("signature"), F.lit(role).alias("role"), candidate.alias("candidate"))
    name, brand = F.col("p_name"), F.col("p_brand")
    kinds = part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("kind")).agg(F.min("p_brand").alias("p_brand"))
    rows = [
        rule(part.where("p_size = 1"), name, "maker", brand),
        rule(part, F.col("p_type"), "plant", F.col("p_type")),
        rule(part, brand, "brand", brand),
        rule(kinds, F.col("kind"), "maker", brand),
        rule(part.where("p_size = 2"), F.concat("p_name", F.lit(" "), "p_type", F.lit("-"), "p_brand"), "maker", brand),
    ]
    return reduce(DataFrame.unionByName, rows).distinct()


_READ = """WITH ins AS (SELECT p_partkey AS id, replace(p_name, ' ', '  ') || '  ' || p_type || '-' || p_brand AS t, p_brand FROM part),
    ru AS (SELECT p_name AS sig, 'maker' AS role, p_brand AS cand FROM part WHERE p_size = 1 UNION SELECT p_type, 'plant', p_type FROM part UNION SELECT p_brand, 'brand', p_brand FROM part
        UNION SELECT split_part(p_name, ' ', 2), 'maker', min(p_brand) FROM part GROUP BY 1 UNION SELECT p_name || ' ' || p_type || '-' || p_brand, 'maker', p_brand FROM part WHERE p_size = 2),
    sg AS (SELECT sig, replace(sig, ' ', '  ') AS w, count(*) AS n FROM ru GROUP BY 1),
    m0 AS (SELECT id, t, sig, n, strpos(t, w) - 1 AS s, strpos(t, w) - 1 + length(w) AS e FROM ins JOIN sg ON contains(t, w)),
    m AS (SELECT * FROM m0 WHERE (s = 0 OR NOT regexp_matches(substr(t, s, 1), '[A-Za-z0-9]')) AND NOT regexp_matches(substr(t, e + 1, 1), '[A-Za-z0-9]')),
    mr AS (SELECT id, sig, s, e, role, list_sort(list(cand)) AS v FROM m JOIN ru USING (sig) GROUP BY ALL),
    cf AS (SELECT DISTINCT a.id, a.sig FROM mr a JOIN mr b ON a.id = b.id AND a.sig <> b.sig AND a.role = b.role AND a.s < b.e AND b.s < a.e WHERE a.v <> b.v),
    st AS (SELECT m.id, m.sig, s, e, n > 1 OR cf.sig IS NOT NULL AS amb FROM m LEFT JOIN cf ON cf.id = m.id AND cf.sig = m.sig),
    acc AS (SELECT DISTINCT id, role, cand FROM st JOIN ru USING (sig) WHERE NOT amb)"""


@query("b15_interpretations", f"""{_READ}, sp AS (SELECT id, bool_or(amb) AS amb, string_agg(s || '-' || e || CASE WHEN amb THEN '?' ELSE '' END, '|' ORDER BY s, e, sig) AS spans FROM st GROUP BY 1),
    ac AS (SELECT id, string_agg(role || ':' || cand, '|' ORDER BY role, cand) AS accepted FROM acc GROUP BY 1)
    SELECT ins.id AS p_partkey, CASE WHEN sp.id IS NULL THEN 'unknown' WHEN sp.amb THEN 'ambiguous' ELSE 'supported' END AS status, coalesce(spans, '') AS spans, coalesce(accepted, '') AS accepted FROM ins LEFT JOIN sp ON sp.id = ins.id LEFT JOIN ac ON ac.id = ins.id""")
def interpretations(c: Catalog) -> DataFrame:
    """Each part's inscription: its status, the places of signatures (with ? where ambiguous) and what is accepted."""
    read = interpret(part_inscriptions(c), part_rules(c))
    sure = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("spans", lambda x: ~x["ambiguous"]), lambda x: x["candidates"]))))
    status = F.when(F.size("spans") == 0, "unknown").when(F.exists("spans", lambda x: x["ambiguous"]), "ambiguous").otherwise("supported")
    place = lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.when(x["ambiguous"], "?").otherwise(""))
    said = F.array_join(F.transform(sure, lambda p: F.concat_ws(":", p["role"], p["candidate"])), "|")
    return read.select(F.col("id").alias("p_partkey"), status.alias("status"), F.array_join(F.transform("spans", place), "|").alias("spans"), said.alias("accepted"))


@query("b16_typed_spans", """WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+|\\s+|[^\\s\\p{L}\\p{N}]+')) AS p, generate_subscripts(regexp_extract_all(text, '[\\p{L}\\p{N}]+|\\s+|[^\\s\\p{L}\\p{N}]+'), 1) AS i FROM documents WHERE text IS NOT NULL),
    k AS (SELECT doc_id, i, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e, length(p) AS n, CASE WHEN regexp_matches(p, '^\\s') THEN 'whitespace' WHEN NOT regexp_matches(p, '^[\\p{L}\\p{N}]') THEN 'marks' WHEN regexp_matches(p, '\\p{L}') AND regexp_matches(p, '\\p{Nd}') THEN 'alphanumeric' WHEN regexp_matches(p, '^\\p{L}') THEN 'letters' WHEN regexp_matches(p, '^\\p{Nd}') THEN 'numbers' ELSE 'alphanumeric' END AS kind FROM p)
    SELECT doc_id, count(*) AS spans, count(*) FILTER (WHERE kind = 'letters') AS letters, count(*) FILTER (WHERE kind = 'numbers') AS numbers, count(*) FILTER (WHERE kind = 'alphanumeric') AS alphanumeric, count(*) FILTER (WHERE kind = 'marks') AS marks, md5(string_agg(CAST(e - n AS BIGINT) || ':' || CAST(e AS BIGINT) || ':' || kind, ',' ORDER BY i)) AS digest FROM k GROUP BY 1""")
def typed_spans(c: Catalog) -> DataFrame:
    """The typed spans of every text: how many of each kind, and a digest of their places."""
    # A file of texts is read in few pieces, each much work, so texts are spread by number.
    texts = c.table("documents").where("text <> ''").select("doc_id", "text").repartition(4 * c.spark.sparkContext.defaultParallelism, "doc_id")
    rows = texts.select("doc_id", lexical_spans(F.col("text")).alias("s"))
    of = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(kind)
    line = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["kind"])), ",")
    return rows.select("doc_id", F.size("s").cast("long").alias("spans"), of("letters"), of("numbers"), of("alphanumeric"), of("marks"), F.md5(line).alias("digest"))


@query("b16_unknown_spans", f"""{_READ}, ch AS (SELECT id, t, unnest(generate_series(1, length(t))) AS i FROM ins), cl AS (SELECT id, i, t[i] AS c, CASE WHEN regexp_matches(t[i], '^\\s') THEN 0 WHEN regexp_matches(t[i], '^[\\p{{L}}\\p{{N}}]') THEN 1 ELSE 2 END AS k, EXISTS (SELECT 1 FROM st WHERE st.id = ch.id AND st.s < i AND i <= st.e) AS known FROM ch),
    ed AS (SELECT *, CASE WHEN lag(k) OVER w IS DISTINCT FROM k OR lag(known) OVER w THEN 1 ELSE 0 END AS fresh FROM cl WINDOW w AS (PARTITION BY id ORDER BY i)), gr AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY i) AS g FROM ed WHERE NOT known)
    SELECT id AS p_partkey, string_agg(a || '-' || e || ' ' || x, '|' ORDER BY a) AS unknown FROM (SELECT id, min(i) - 1 AS a, max(i) AS e, string_agg(c, '' ORDER BY i) AS x FROM gr GROUP BY id, g) GROUP BY 1""")
def part_unknown_spans(c: Catalog) -> DataFrame:
    """What the signatures leave of each part's inscription; inscriptions that are known from end to end are left out."""
    texts = part_inscriptions(c)
    rows = interpret(texts, part_rules(c)).join(texts.select("id", "text").hint("merge"), "id").select("id", unknown_spans(F.col("text"), F.col("spans")).alias("u")).where(F.size("u") > 0)
    said = lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit(" "), x["text"])
    return rows.select(F.col("id").alias("p_partkey"), F.array_join(F.transform("u", said), "|").alias("unknown"))


def _measured_sql(method: str, found: str) -> str:
    return f"""SELECT '{method}' AS method, *, CASE WHEN accepted > 0 THEN CAST(floor(correct / accepted * 1e6 + 0.5) AS BIGINT) END AS precision_ppm, CASE WHEN cases > 0 THEN CAST(floor(covered / cases * 1e6 + 0.5) AS BIGINT) END AS coverage_ppm
    FROM (SELECT count(*) AS accepted, count(x.id) AS correct, count(DISTINCT f.id) AS covered, (SELECT count(*) FROM ins) AS cases FROM {found} f LEFT JOIN ex x ON x.id = f.id AND x.role = f.role AND x.cand = f.cand)"""


@query("b17_interpretation_metrics", f"""{_READ}, ex AS (SELECT id, unnest(['maker', 'brand']) AS role, p_brand AS cand FROM ins),
    one AS (SELECT sig, min(role) AS role, min(cand) AS cand FROM ru GROUP BY 1 HAVING count(*) = 1), bs AS (SELECT id, role, cand FROM ins JOIN one ON replace(t, '  ', ' ') = sig)
    {_measured_sql("interpreter", "acc")} UNION ALL {_measured_sql("exact", "bs")}""")
def interpretation_metrics(c: Catalog) -> DataFrame:
    """Precision and coverage of reading signatures anywhere, against looking the whole inscription up."""
    texts, rules = part_inscriptions(c), part_rules(c)
    expected = texts.select("id", F.explode(F.array(F.lit("maker"), F.lit("brand"))).alias("role"), F.col("p_brand").alias("candidate"))
    found = {"interpreter": accepted(interpret(texts, rules)), "exact": exact(texts, rules)}
    return reduce(DataFrame.unionByName, (measured(df, expected, texts).withColumn("method", F.lit(name)) for name, df in found.items()))

"""Secret scan through a trigram inverted index (DataFrame functions only).

Each rule is a regular expression. From its parse tree follow Boolean trigram queries: all clauses must hold, a clause
holds if one of its alternatives does, an alternative is a set of trigrams that the text must contain. Postings
(trigram, text) are built for the trigrams that some rule asks for, each rule's postings are intersected, and only
the candidates are verified by the expression itself. A rule without mandatory trigrams scans every text.

Defined results: a null text counts as empty and has no spans; a null ``doc_id`` is a row like any other (rows are keyed by
a hash of id and text); repeated rows get the same spans each; extra columns are ignored; an empty table gives an empty result.
Places are summed in blocks, so a text of 100,000 matches takes seconds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_spans, span_text, string_array, tagged, text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    keep: str = ""  # "value": group 2 of 8 characters or more
    base: bool = False


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# The base rules in their listed order, then well-known public credential formats.
RULES = (
    Rule("assign", _ASSIGN, keep="value", base=True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

_MOST = 64


def _exact(op, arg) -> set[str] | None:
    """The lower-cased strings that a parsed node matches, if they are few; else None."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        return {chr(v).lower() for _, v in arg} if all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8 else None
    if name == "SUBPATTERN":
        return _exact_all(arg[-1])
    if name == "BRANCH":
        parts = [_exact_all(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if name == "MAX_REPEAT" and arg[1] == 1:
        inner = _exact_all(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        inner = _exact(op, arg)
        if inner is None or len(out) * len(inner) > _MOST:
            return None
        out = {a + b for a in out for b in inner}
    return out


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """AND of ORs of trigram sets that every match of ``regex`` satisfies; empty if none is mandatory."""
    clauses: list[list[frozenset[str]]] = []

    def flush(strings: set[str]) -> None:
        if strings and min(map(len, strings)) >= 3:
            sets = {trigrams(s) for s in strings}
            clauses.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))

    def walk(nodes) -> None:
        run = {""}
        for op, arg in nodes:
            inner = _exact(op, arg)
            if inner is not None and len(run) * len(inner) <= _MOST:
                run = {a + b for a in run for b in inner}
                continue
            flush(run)
            run = inner or {""}
            if inner is None and str(op) == "SUBPATTERN":
                walk(arg[-1])
        flush(run)

    walk(regex_parser.parse(regex))
    return clauses


def candidates(rows: DataFrame, rules=RULES) -> DataFrame:
    """(key, rules): the rules whose trigram query a text satisfies. ``rows`` has key and text; rules without a query are not listed."""
    asked = [(r.kind, c, a, sorted(grams)) for r in rules for c, clause in enumerate(trigram_query(r.regex)) for a, grams in enumerate(clause)]
    needed = sorted({g for *_, grams in asked for g in grams})
    low = rows.select("key", F.lower("text").alias("low"))
    # A literal for each trigram: the lower-cased text is used many times, so it is computed once.
    present = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in needed)))
    postings = low.select("key", F.explode(present).alias("gram"))
    spark = rows.sparkSession
    terms = spark.createDataFrame([(k, c, a, len(grams), g) for k, c, a, grams in asked for g in grams], "kind string, clause int, alt int, size int, gram string")
    sizes = {r.kind: len(trigram_query(r.regex)) for r in rules}
    wanted = spark.createDataFrame(sorted(sizes.items()), "kind string, clauses int")
    # Both tables follow from the rules alone, so their size does not depend on the texts.
    hit = postings.join(F.broadcast(terms), "gram").groupBy("key", "kind", "clause", "alt").agg(F.count_distinct("gram").alias("n"), F.first("size").alias("size"))
    held = hit.where("n = size").groupBy("key", "kind").agg(F.count_distinct("clause").alias("held"))
    found = held.join(F.broadcast(wanted), "kind").where("held = clauses")
    return found.groupBy("key").agg(F.collect_set("kind").alias("rules"))


def _keep(rule: Rule):
    if rule.keep != "value":
        return None
    value = lambda x: F.regexp_extract(x["m"], rule.regex, 2)
    return lambda x: F.length(value(x)) >= 8


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and, for each rule, ``spans_<kind>``: array of struct<m, s, e> (the match, its start and end in code points)."""
    rows = docs.select("doc_id", text_of("text").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    full = [r.kind for r in rules if not trigram_query(r.regex)]
    found = candidates(rows, rules).withColumnRenamed("key", "found_key")
    df = rows.join(found.hint("shuffle_hash"), F.col("key") == F.col("found_key"), "left")
    for rule in rules:
        asked = F.lit(True) if rule.kind in full else F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))
        df = df.withColumn("__t", F.when(asked, F.col("text")).otherwise(""))
        df = add_spans(df, "__t", f"spans_{rule.kind}", rule.regex, _keep(rule)).drop("__t")
    return df.select("doc_id", *(f"spans_{r.kind}" for r in rules))


def secret_digest(df: DataFrame, rules=RULES) -> DataFrame:
    """The counts of the base rules, their hash and all spans as text."""
    join = lambda some: reduce(lambda a, b: F.concat(a, b), [tagged(f"spans_{r.kind}", r.kind, i) for i, r in enumerate(rules) if some(r)])
    ordered: Column = F.sort_array(join(lambda r: True))
    base: Column = F.sort_array(join(lambda r: r.base))
    counts = [F.size(f"spans_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return df.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(ordered).alias("spans"))

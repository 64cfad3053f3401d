"""URL filter by a path-template tree (DataFrame functions only).

Base rules (host, path) decide where one fits; the longest wins. Their decisions are the labels of the method, which judges the
rest. Two trees are grown over the paths, one for all hosts together and one for each host: level by level, segments that
vary become wildcards. Block rates go down the trees, first the common one, then the host's own: siblings whose labelled rates do not
differ (two-proportion z test, in order of rate) merge into one branch; a branch that does not differ from what came down to it
keeps that, and one that differs takes its own rate, smoothed towards it. A template whose rate reaches ``reject`` is blocked.

Trees have at most ``depth`` levels: what follows is one segment of the last. A parent has at most 1 / ``share`` literal
children and a wildcard, so siblings are ordered in small windows.

Defined results: a null url or one without ``://`` has empty host and path and is judged with the others of that
empty host; urls whose templates have no labels on any host take the overall rate of blocks (and are allowed where there are no labels);
repeated rows are judged alike; a null ``page_id`` is a row like any other; very long paths fold beyond the last level; extra columns,
also ones named host or path, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of

# Fixed values: (verdict, rule); a rule is its host and the path that follows.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda x: len(x[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{rest}"))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _templates(paths: DataFrame, scratch: Scratch, scope: list[str], name: str, depth: int, support: int, share: float) -> tuple[DataFrame, int]:
    """Add ``<name>0``, ``<name>1``..: the template prefixes of each distinct (host, path); and how many levels there are.

    A segment stays literal if enough urls below its parent have it; the others vary and share a wildcard.
    """
    deepest = min(depth, paths.agg(F.coalesce(F.max(F.size("segments")), F.lit(0))).first()[0])
    paths = paths.withColumn(f"{name}0", F.lit(""))
    for d in range(1, deepest + 1):
        rest = F.array_join(F.slice("segments", d, F.greatest(F.size("segments") - d + 1, F.lit(0))), "/")
        segment = rest if d == depth else F.coalesce(F.get("segments", F.lit(d - 1)), F.lit(""))
        paths = paths.withColumn("parent", F.col(f"{name}{d - 1}")).withColumn("seg", segment)
        kids = paths.groupBy(*scope, "parent", "seg").agg(F.sum("n").alias("c"))
        total = kids.groupBy(*scope, "parent").agg(F.sum("c").alias("all"))
        held = (F.col("c") >= support) & (F.col("c") >= share * F.col("all"))
        literal = kids.join(total, [*scope, "parent"]).where(held).select(*scope, "parent", "seg", F.lit(True).alias("literal"))
        paths = paths.join(literal, [*scope, "parent", "seg"], "left")
        step = F.when(F.col("seg") == "", "").otherwise(F.concat(F.lit("/"), F.when(F.col("literal"), F.col("seg")).otherwise("*")))
        paths = scratch.save(paths.withColumn(f"{name}{d}", F.concat("parent", step)).drop("parent", "seg", "literal"), f"{name}{d}")
    return paths, deepest


def _level(leaves: DataFrame, parent: list[str], child: list[str], weight: float, z: float) -> DataFrame:
    """``leaves`` with ``rate`` moved by the branches ``child`` below ``parent``, or, without ``child``, by the hosts as wholes.

    A branch's rate replaces the one that a leaf has so far where the two differ; a whole host's moves its leaves where its labels
    differ from what their leaves expect, as labels in one branch say little of another.
    """
    differ = lambda expected, found, over: F.abs(expected - found) >= z * F.sqrt(F.greatest(expected * (1 - expected), F.lit(0.01)) * over)
    keys = [*parent, *child]
    branch = leaves.groupBy(*keys).agg(F.sum("b").alias("own_b"), F.sum("l").alias("own_l"), F.sum(F.col("l") * F.col("rate")).alias("own_e")).where("own_l > 0").withColumn("r", F.col("own_b") / F.col("own_l"))
    if child:
        order = Window.partitionBy(*parent).orderBy("r", *child)
        b, n = F.lag("own_b").over(order), F.lag("own_l").over(order)
        pooled = (F.col("own_b") + b) / (F.col("own_l") + n)
        apart = F.abs(F.col("r") - b / n) >= z * F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(0.01)) * (1 / F.col("own_l") + 1 / n))
        branch = branch.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("cluster", F.sum("apart").over(order))
        merged = Window.partitionBy(*parent, "cluster")
        branch = branch.select(*keys, *(F.sum(x).over(merged).alias(x) for x in ("own_b", "own_l", "own_e")))
    expected = F.col("rate") if child else F.col("own_e") / F.col("own_l")
    moves = F.coalesce(differ(expected, F.col("own_b") / F.col("own_l"), 1 / F.col("own_l")), F.lit(False))
    smoothed = (F.col("own_b") + weight * F.col("rate")) / (F.col("own_l") + weight)
    return leaves.join(branch.drop("r"), keys, "left").withColumn("rate", F.when(moves, smoothed).otherwise(F.col("rate"))).drop("own_b", "own_l", "own_e")


def template_rates(paths: DataFrame, scratch: Scratch, depth: int = 8, support: int = 5, share: float = 0.02, weight: float = 4.0, z: float = 1.96) -> DataFrame:
    """(host, path, template, block_rate) of distinct rows (host, path, n, labelled, blocks)."""
    paths = paths.withColumn("segments", F.array_remove(F.split("path", "/"), ""))
    paths, common = _templates(scratch.save(paths, "paths"), scratch, [], "g", depth, support, share)
    paths, own = _templates(paths, scratch, ["host"], "t", depth, support, share)
    names = [*(f"g{d}" for d in range(common + 1)), *(f"t{d}" for d in range(own + 1))]
    leaves = paths.groupBy("host", *names).agg(F.sum("blocks").alias("b"), F.sum("labelled").alias("l"))
    leaves = scratch.save(leaves, "leaves")
    every = leaves.agg(F.coalesce(F.sum("b") / F.nullif(F.sum("l"), F.lit(0)), F.lit(0.0)).alias("rate"))
    leaves = leaves.join(F.broadcast(every))
    for d in range(1, common + 1):
        leaves = scratch.save(_level(leaves, [f"g{d - 1}"], [f"g{d}"], weight, z), f"common{d}")
    leaves = scratch.save(_level(leaves, ["host"], [], weight, z), "host")
    for d in range(1, own + 1):
        leaves = scratch.save(_level(leaves, ["host", f"t{d - 1}"], [f"t{d}"], weight, z), f"own{d}")
    # The last prefixes contain the ones before them.
    ends = ["host", f"g{common}", f"t{own}"]
    judged = paths.select(*ends, "path").join(leaves.select(*ends, F.col("rate").alias("block_rate")), ends)
    return judged.select("host", "path", F.col(f"t{own}").alias("template"), "block_rate")


def filter_urls(pages: DataFrame, rules=RULES, reject: float = 0.5, **tree) -> DataFrame:
    """page_id, host, path, rule, verdict, template and block_rate. ``tree`` goes to ``template_rates``."""
    scratch = Scratch(pages.sparkSession, "url-filter")
    host, path = host_and_path(text_of("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, decided = rule_columns(F.col("host"), F.col("path"), rules)
    df = df.withColumn("rule", rule).withColumn("decided", decided)
    paths = df.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("decided").alias("labelled"), F.count_if(F.col("decided") == "block").alias("blocks"))
    out = df.join(template_rates(paths, scratch, **tree), ["host", "path"])
    verdict = F.coalesce("decided", F.when(F.col("block_rate") >= reject, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "block_rate")

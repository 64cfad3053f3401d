"""Quality classifier: a sparse rule ensemble over text statistics.

A random forest's tree paths become conjunctive rules, an L1-penalised logistic regression weighs them and drops most,
and what is left is compiled into one Spark column expression, so that scoring is a plain projection.

Only the text is an input of a score. Labels are learnt from rows with crc32(doc_id as text) mod 3 other than 1; at most
``most_labels`` of them, chosen by a hash of the id.

Defined results: a null or empty text has statistics of 0 and is scored like any other; a null ``doc_id`` is not held out and
has no label; contradictory labels of one id both count; repeated rows score alike; with no labels, or one class only, the
score is the smoothed share of label 1 (0.5 for none) for all; extra columns are ignored by ``classify`` and kept by ``keep_good``, whatever
their names; an empty table gives an empty result; time grows in proportion to a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of, words_of

FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "bang", "bar", "mark", "foreign", "distinct_words", "same_lines", "line_words", "space")
#: A conjunction: {feature: (more than, at most)}; None is no bound.
Conditions = dict[str, tuple[float | None, float | None]]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[Conditions, float]] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of label 1, over columns named as in ``FEATURES``."""
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(holds(conditions), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def with_statistics(df: DataFrame) -> DataFrame:
    """``__row`` and the ``FEATURES`` of ``__text``, for rows of (__row, __text)."""
    df = df.withColumn("w", words_of(F.col("__text"))).withColumn("lines", F.split("__text", "\n")).withColumn("n", F.length("__text"))
    # Without lower-case letters and spaces little is left, which the other classes are counted in.
    df = df.withColumn("rest", F.regexp_replace("__text", r"[a-z\x20]+", "")).drop("__text")
    cut = lambda regex: (F.length("rest") - F.length(F.regexp_replace("rest", regex, ""))) / F.greatest(F.col("n"), F.lit(1))
    words = F.greatest(F.size("w"), F.lit(1))
    in_words = F.length(F.array_join("w", ""))
    values = {
        "log_words": F.log1p(F.size("w").cast("double")),
        "word_length": in_words / words,
        "upper": cut(r"\p{Lu}+"),
        "digit": cut("[0-9]+"),
        "symbol": cut("[#$%&*<>@=+~^]+"),
        "bang": cut("!+"),
        "bar": cut(r"\|+"),
        "mark": cut(r"""[.,;:?'"()-]+"""),
        "foreign": cut(r"[^\x00-\x7F]+"),
        "distinct_words": F.size(F.array_distinct("w")) / words,
        "same_lines": 1 - F.size(F.array_distinct("lines")) / F.size("lines"),
        "line_words": F.log1p(F.size("w") / F.size("lines")),
        "space": (F.col("n") - in_words) / F.greatest(F.col("n"), F.lit(1)),
    }
    return df.select("__row", *(values[k].cast("double").alias(k) for k in FEATURES))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs``' doc_id and the ``FEATURES`` of its text."""
    return with_statistics(docs.select(F.col("doc_id").alias("__row"), text_of("text").alias("__text"))).withColumnRenamed("__row", "doc_id")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def holds(conditions: Conditions) -> Column:
    out = F.lit(True)
    for name, (low, high) in sorted(conditions.items()):
        out = out & (F.col(name) > low if low is not None else F.lit(True)) & (F.col(name) <= high if high is not None else F.lit(True))
    return out


def _paths(node, so_far: Conditions) -> list[Conditions]:
    """The conjunctions that lead to each node below ``node`` of a fitted tree."""
    if node.getClass().getSimpleName() != "InternalNode":
        return []
    split = node.split()
    name, at = FEATURES[split.featureIndex()], float(split.threshold())
    low, high = so_far.get(name, (None, None))
    left = so_far | {name: (low, at if high is None else min(at, high))}
    right = so_far | {name: (at if low is None else max(at, low), high)}
    return [left, right, *_paths(node.leftChild(), left), *_paths(node.rightChild(), right)]


def fit_rules(stats: DataFrame, labels: DataFrame, trees: int = 24, depth: int = 3, penalty: float = 0.0005, most_labels: int = 200_000, seed: int = 7) -> RuleModel:
    """Fit on the labelled rows of ``stats`` (doc_id and ``FEATURES``) that are not held out."""
    scratch = Scratch(stats.sparkSession, "classifier")
    wanted = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("double").alias("label"))
    known = stats.where(~held_out()).join(wanted, "doc_id").select("doc_id", "label", array_to_vector(F.array(*FEATURES)).alias("features"), *FEATURES)
    known = scratch.save(known.drop("features"), "known").withColumn("features", array_to_vector(F.array(*FEATURES)))
    total, ones = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if total > most_labels:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * most_labels / total))
    if ones in (0, total):
        share = (ones + 0.5) / (total + 1)
        return RuleModel(float(_logit(share)))
    known = known.persist()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="sqrt", minInstancesPerNode=5, seed=seed).fit(known)
    rules: dict[str, Conditions] = {}
    for tree in forest.trees:
        for conditions in _paths(tree._java_obj.rootNode(), {}):
            rules[repr(sorted(conditions.items()))] = conditions
    chosen = [rules[k] for k in sorted(rules)]
    if not chosen:
        known.unpersist()
        return RuleModel(float(_logit(ones / total)))
    fired = known.select("label", *FEATURES).mapInArrow(_firing(chosen), "label double, fired array<double>")
    fired = fired.select("label", array_to_vector("fired").alias("features")).persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, tol=1e-5).fit(fired)
    fired.unpersist()
    known.unpersist()
    return RuleModel(float(lasso.intercept), [(c, float(w)) for c, w in zip(chosen, lasso.coefficients.toArray(), strict=True) if w])


def _firing(rules: list[Conditions]):
    """Batches of label and ``FEATURES`` to label and the rules that hold, as 0 or 1."""

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in FEATURES}
            out = np.ones((batch.num_rows, len(rules)))
            for j, conditions in enumerate(rules):
                for name, (low, high) in conditions.items():
                    if low is not None:
                        out[:, j] *= values[name] > low
                    if high is not None:
                        out[:, j] *= values[name] <= high
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(rules)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(ends, out.ravel())], names=["label", "fired"])

    return fire


def _logit(p: float) -> float:
    return log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "classifier")
    stats = scratch.save(statistics(docs), "stats")
    model = fit_rules(stats, labels, **options)
    scored = stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay, whatever their names.

    Rows are written once with their statistics, so that texts are not measured again to be scored.
    """
    scratch = Scratch(docs.sparkSession, "classifier")
    rows = scratch.save(with_statistics(docs.select(F.struct(*docs.columns).alias("__row"), text_of("text").alias("__text"))), "rows")
    model = fit_rules(rows.select(F.col("__row.doc_id").alias("doc_id"), *FEATURES), labels, **options)
    return rows.where(model.score() >= 0.5).select("__row.*")

"""The corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents; the
last returns the packing. Stage by stage: the classifier's rejects go; repeated passages are cut out of texts (a text that
consists of repeated passages alone goes, so an exact copy goes here or is left whole for the next stage); of each group of
near-duplicates the document with the least id stays; the mix takes documents zero, one or two times; what is left is tokenized and
packed. SQL can't express the stages, so there is no oracle; tests hold line dedup, near-duplicates and packing against plain versions, and
the classifier and the mix against what they promise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.classifier import keep_good
from lattica.llm.common import Scratch, read_table, scratch_tables
from lattica.llm.line_dedup import WORDED, dedup_lines
from lattica.llm.minhash import near_duplicates
from lattica.llm.mixing import take
from lattica.llm.packing import pack, tokenize_pieces


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs)
    changed = F.col("removed_lines") > 0
    out = out.where(~changed | F.col("text").rlike(WORDED))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, likeness 0.8 or more. A document without words, or without an id, is no one's copy and stays."""
    gone = near_duplicates(docs, width=5, percent=80).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    # The columns go along as one, so that none clashes with a name used here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"))
    return rows.join(gone.hint("merge"), F.col("id") == F.col("gone"), "left_anti").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(tokenize_pieces(docs))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_copies),
    ("source_mixing", mixing),
    ("best_fit_packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again by the next.

    What a stage wrote for itself goes when its rows are written, and its rows go when the next stage's are.
    """
    scratch = Scratch(spark, "pipeline")
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch_tables() as used:
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        for tables in used:
            tables.remove()
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

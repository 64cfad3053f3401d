"""The queries of the operators and of the pipeline, by their registered names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import read_table


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import fingerprint_with_edits

    return fingerprint_with_edits(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("all_lines").cast("long"), F.col("removed_lines").cast("long"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(read_table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets, secret_digest

    return secret_digest(scan_secrets(read_table(spark, sf_dir, "documents")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, tokenize_pieces

    return pack(tokenize_pieces(read_table(spark, sf_dir, "documents")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii, pii_digest

    return pii_digest(find_pii(read_table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, mix_digest

    return mix_digest(mix(read_table(spark, sf_dir, "documents")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import cluster, cluster_digest

    return cluster_digest(cluster(read_table(spark, sf_dir, "embeddings")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import importance

    out = importance(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_slots

    return shard_slots(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_imatch": op2_imatch,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_secret_scan": op5_secret_scan,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_pii": op7_pii,
    "op8_quality_rules": op8_quality_rules,
    "op9_mixing": op9_mixing,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_sharding": op13_sharding,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op11_centroid_clustering": oracles.centroid_sql(),
    "op12_importance_resampling": oracles.importance_sql(),
    "op13_sharding": oracles.shards_sql(),
}

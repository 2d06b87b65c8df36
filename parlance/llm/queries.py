"""The registered queries of the training-data operators: op1 to op13."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parlance.llm import centroids, divergence, html_extract, jaccard_join, line_dedup, packing, pii, piece_codec, quality_classifier, quality_rules, sharding, topk, url_filter
from parlance.llm.common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # where a block was found follows from the alignment, which has no SQL form; tests hold it against the texts
    return line_dedup.report(table(spark, sf_dir, "documents")).drop("found")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which rule rejects first follows from measured costs, the verdict doesn't
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_url_filter, op3_sentencepiece, op4_line_dedup, op5_packing, op6_ngram_jaccard_join, op7_quality_rules, op8_quality_classifier, op9_pii, op10_exact_topk, op11_source_divergence, op12_sharding, op13_centroid_clustering)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.ORACLE, "op4_line_dedup": line_dedup.ORACLE, "op6_ngram_jaccard_join": jaccard_join.ORACLE, "op7_quality_rules": quality_rules.ORACLE, "op9_pii": pii.ORACLE, "op10_exact_topk": topk.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_sharding": sharding.ORACLE, "op13_centroid_clustering": centroids.ORACLE}

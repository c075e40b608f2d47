"""The queries of this subpackage, by name; each runs its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.llm import decontamination

    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.llm import suffix_dedup

    return suffix_dedup.digest(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.llm import sharding

    return sharding.assign(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.llm import warc

    index = warc.archive_and_index(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.llm import ngram_join

    return ngram_join.link(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.llm import toxicity

    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.llm import quality_rules

    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.llm import quality

    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.llm import langid

    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.llm import sentencepiece_fst

    return sentencepiece_fst.encode(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.llm import filter_audit

    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.llm import topk_search

    return topk_search.search(_table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from placeframe.llm import ranked_search

    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontamination, op2_suffix_dedup, op3_sharding, op4_warc, op5_ngram_join, op6_toxicity, op7_quality_rules, op8_quality_classifier, op9_language_id, op10_sentencepiece, op11_filter_audit, op12_topk_search, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    from placeframe.llm import oracles

    return {"op2_suffix_dedup": oracles.SUFFIX_DEDUP, "op4_warc": oracles.WARC, "op5_ngram_join": oracles.NGRAM_JOIN, "op7_quality_rules": oracles.QUALITY_RULES, "op11_filter_audit": oracles.FILTER_AUDIT, "op12_topk_search": oracles.TOPK_SEARCH, "op13_ranked_search": oracles.RANKED_SEARCH}

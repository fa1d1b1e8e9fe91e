"""The ``opN_`` queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, idfiles, langid, licenses, neardup, packing, pii, quality_rules, quality_score, secret_scan
from plumbline.llm.sampling import held_out
from plumbline.llm.tokens import default_vocabulary


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(pii.scan(_read(spark, sf_dir, "documents")), "doc_id", pii.BASE)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_report(secret_scan.scan(_read(spark, sf_dir, "documents")), "doc_id", secret_scan.BASE)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), default_vocabulary("byte_bpe_50k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, _read(spark, sf_dir, "labels")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_score.predict(docs, quality_score.fit(docs, _read(spark, sf_dir, "labels")))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.round_trip(_read(spark, sf_dir, "documents"), default_vocabulary("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_minhash_near_dedup, op3_personal_data, op4_secrets, op5_best_fit_packing, op6_quality_rules, op7_quality_classifier, op8_benchmark_decontamination, op9_language_id, op10_token_id_files)}


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can say.  The others fit models, run a vocabulary or take samples by
    hash; tests hold them against brute force, exact round trips or held-out rows."""
    return {
        "op1_license_scan": licenses.oracle_sql(),
        "op8_benchmark_decontamination": decontaminate.oracle_sql(),
    }

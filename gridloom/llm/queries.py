"""Queries of the corpus operators and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, decontaminate, media, mixing, pii, quality, secret_scan, simhash, suffix_dedup, toxicity, urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.report(_read(spark, sf_dir, "documents"), common.shared_dir(spark))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(_read(spark, sf_dir, "pages"), common.shared_dir(spark))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_read(spark, sf_dir, "documents"), common.shared_dir(spark))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_read(spark, sf_dir, "documents"), common.shared_dir(spark))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = spark.conf.get(secret_scan.LEDGER, None) or f"{common.shared_dir(spark)}/secret_ledger"
    return secret_scan.report(secret_scan.scan(_read(spark, sf_dir, "documents"), ledger))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), common.shared_dir(spark))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), common.shared_dir(spark))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), common.shared_dir(spark))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_media": op2_media,
    "op3_url_filter": op3_url_filter,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_url_filter": urls.ORACLE,
    "op4_mixing": mixing.oracle(),
    "op6_secret_scan": secret_scan.oracle(),
    "op10_suffix_dedup": suffix_dedup.ORACLE,
}

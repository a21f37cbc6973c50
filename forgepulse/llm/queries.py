"""Queries of the numbered operators: thin, over the whole documents table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import documents
from .filter_audit import filter_audit
from .fingerprints import fingerprint_documents
from .license_scan import license_scan
from .mixing import mixing_plan
from .packing import pack
from .periodic_runs import periodic_runs
from .pii import pii_spans
from .quality_rules import quality_rules
from .secret_scan import secret_scan
from .simhash import simhash_near_dedup
from .substring_dedup import substring_dedup
from .suffix_array_dedup import suffix_array_dedup
from .url_filters import url_filters

#: Environment variable that names a tokenizer file in place of the public one.
TOKENIZER = "TOKENIZER_FILE"


def tokenizer() -> str:
    if TOKENIZER in os.environ:
        return os.environ[TOKENIZER]
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).drop("kept")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).drop("spans")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir)).drop("redacted")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("cleaned")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(documents(spark, sf_dir)).drop("spans")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer(), with_ids=False)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(documents(spark, sf_dir))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", (F.round("position", 6) + 0.0).alias("position"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(documents(spark, sf_dir), arrange=True).drop("n_words", "collapsed")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("source")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_license_scan, op3_secret_scan, op4_quality_rules, op5_document_fingerprints, op6_suffix_array_dedup, op7_packing, op8_pii, op9_simhash_near_dedup, op10_mixing, op11_periodic_runs, op12_filter_audit, op13_url_filters)}


def oracle_sql() -> dict[str, str]:
    """The other operators are held against plain versions in the tests."""
    return {"op1_substring_dedup": oracles.SUBSTRING_DEDUP, "op4_quality_rules": oracles.QUALITY_RULES, "op10_mixing": oracles.MIXING, "op12_filter_audit": oracles.FILTER_AUDIT, "op13_url_filters": oracles.URL_FILTERS}

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, filter_audit, graph_ann, importance, lm_scoring, preference, quality_gam, secret_scan, simhash, sql, suffix_dedup, toxicity, url_filter
from ._common import read_documents


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.report(read_documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.report(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read_documents(spark, sf_dir))


def op4_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ann.report(read_documents(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_documents(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flag(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))


def op7_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(*preference.pair_neighbours(read_documents(spark, sf_dir, "conversations")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(read_documents(spark, sf_dir), bpe.load_spec(bpe_path()), digest=True)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(read_documents(spark, sf_dir))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read_documents(spark, sf_dir))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_lm_scoring, op2_quality, op3_simhash, op4_graph_ann, op5_url_filter, op6_decontaminate, op7_preference,
        op8_bpe, op9_toxicity, op10_secrets, op11_suffix_dedup, op12_filter_audit, op13_importance,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filter": url_filter.oracle(), "op6_decontaminate": sql.DECONTAMINATE, "op7_preference": preference.ORACLE,
        "op10_secrets": sql.SECRETS, "op11_suffix_dedup": suffix_dedup.ORACLE, "op12_filter_audit": filter_audit.ORACLE, "op13_importance": importance.oracle(),
    }

"""A corpus pipeline: quality, near copies, benchmark passages, secrets, tokens.

All stages but the last return the columns of documents, whatever other columns there are and however they are named.
Each reads null texts as empty ones, takes texts of any length whole, treats repeated rows as rows of their own (near
copies: as copies), and gives an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, decontaminate, quality_gam, queries, secret_scan, simhash
from tessella.llm._common import read_documents, write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Without labels all scores are 0.5, and all stay."""
    return quality_gam.keep_good(docs, read_documents(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest doc_id, a null one last (five-word
    shingles, similarity 0.8). Documents without words are one group, and of rows that are repeated one stays."""
    return simhash.near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; without a benchmark all stay."""
    return decontaminate.clean(docs, read_documents(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark, and n_chars follows; all documents stay. A null text stays null."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the texts' token ids, which are decoded again and must give the text; a null or an empty text has none."""
    return bpe.encode(docs, bpe.load_spec(queries.bpe_path()), decoded=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_copies", near_copies), ("benchmark", benchmark), ("secrets", secrets), ("tokens", tokens),
]

#: Classifiers, components and token automata are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs

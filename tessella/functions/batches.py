"""Sizes of the Arrow batches that workers take up."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of text that a worker takes up at once, and of a batch that Spark sends it.
PIECE, BATCH = 2 << 20, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Spark send batches of a few MB, not of ten thousand rows of any size. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(key, "64m")) > BATCH:
        spark.conf.set(key, str(BATCH))


def _bytes(setting: str) -> int:
    at = setting.strip().lower().removesuffix("b")
    return int(at[:-1]) << {"k": 10, "m": 20, "g": 30}[at[-1]] if at[-1:] in "kmg" else int(at)

"""A bounded sample of labelled documents for classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fold

#: Most labelled documents that a classifier is fitted on. Where there are more, those of the least hashed ids are taken.
MOST_LABELLED = 20_000


def held_out(parts: int, remainder: int, key: str = "doc_id") -> Column:
    """Whether the row is in the fold that labels are never learned from; a null id is not."""
    return F.coalesce(fold(key, parts) == remainder, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, parts: int, remainder: int, most: int = MOST_LABELLED) -> DataFrame:
    """text and y (0 or 1) of at most `most` labelled documents outside the held-out fold, the same ones however rows lie
    in partitions.

    A document is an id: of several rows with one id the least text counts (null reads as empty), and an id with both
    labels has none. The number of rows of an id does not matter, as they meet in a partial minimum.
    """
    own = F.col("doc_id").cast("string").alias("doc_id")  # as both tables can say it
    usable = labels.select(own, F.col(label).alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(parts, remainder))
    usable = usable.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("__most")).filter("y = __most").drop("__most")
    place = F.xxhash64("doc_id", F.lit("sample"))
    # a bound on the hash leaves not much more than is taken, so that no task has to order all labels
    share = min(1.0, 1.2 * (most + 100) / max(1, usable.count()))
    near = usable.filter(F.pmod(place, F.lit(1 << 20)) <= int(share * (1 << 20)))
    taken = near.orderBy(F.pmod(place, F.lit(1 << 20)), place, "doc_id").limit(most)
    rows = docs.select(own, F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(taken), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").cast("int").alias("y")).select("text", "y")

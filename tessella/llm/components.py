"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import remove_table, write_table


def _stars(pairs: DataFrame, larger: bool) -> tuple[DataFrame, DataFrame]:
    """Hook neighbours of each u to the least among u and them: the larger ones, or the smaller ones and u itself. Also
    a table that this reads: each u's least, by itself, so that the join can split a u of very many neighbours."""
    least = write_table(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = pairs.join(least, "u")
    if larger:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), least
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v"), least


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link, from links (u, v) in either order; component is the least node.

    Each round is written to the shared folder, so a lost executor costs at most a round, and the tables of the round
    before are removed. Only two numbers of each round come to the driver. Nulls and self-links are left out; repeated
    links count once; without links there are no rows.
    """
    edges = links.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = write_table(edges, "links")
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, first = _stars(both, True)
        large = write_table(large.distinct(), "links")
        small, second = _stars(large, False)
        before, edges = edges, write_table(small.distinct(), "links")
        remove_table(before, first, large, second)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

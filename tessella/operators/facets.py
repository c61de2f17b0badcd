"""Facets, statistics and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def field_facet(df: DataFrame, column: str, least: int = 1, limit: int | None = None) -> DataFrame:
    """(value, n) of a field, or of an array's distinct elements, most frequent first, then by value; nulls are no value."""
    value = F.explode(F.array_distinct(column)) if isinstance(df.schema[column].dataType, ArrayType) else F.col(column)
    counted = df.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    counted = counted.orderBy(F.desc("n"), "value")
    return counted.limit(limit) if limit else counted


def query_facet(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """(facet, n) for each named predicate, in one pass; those of no rows are left out."""
    counts = df.agg(*[F.count_if(p).alias(f"c{i}") for i, p in enumerate(predicates.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("facet"), F.col(f"c{i}").alias("n")) for i, name in enumerate(predicates)])
    return counts.select(F.explode(rows).alias("x")).select("x.*").filter("n > 0")


def range_facet(df: DataFrame, column: str, start: float, end: float, gap: float) -> DataFrame:
    """(bucket, upper, n): rows from start to below end by steps of gap, labelled by the lower bound; 'before' and
    'after' the range have no bounds but the one they share with it."""
    c = F.col(column).cast("double")
    lower = start + F.floor((c - start) / gap) * gap
    bucket = F.when(c < start, "before").when(c >= end, "after").otherwise("in")
    rows = df.filter(c.isNotNull()).select(bucket.alias("part"), F.when(bucket == "in", lower).alias("bucket"))
    return rows.groupBy("part", "bucket").agg(F.count("*").alias("n")).withColumn("upper", F.col("bucket") + gap)


def year_facet(df: DataFrame, column: str, now: Column, years: int = 10) -> DataFrame:
    """(year, n) by calendar year from `years` before now's to now's."""
    ts = F.col(column)
    first = F.date_trunc("YEAR", now) - F.make_interval(years=F.lit(years))
    return df.filter((ts >= first) & (ts < now)).groupBy(F.year(ts).alias("year")).agg(F.count("*").alias("n"))


def pivot_facet(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, level, n): counts of a (level 1) and of a with b (level 2)."""
    rolled = df.rollup(a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return rolled.filter("g < 3").select(a, b, F.when(F.col("g") == 1, 1).otherwise(2).alias("level"), "n")


def stats(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(
        F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"), F.count(c).alias("count"), F.count_if(c.isNull()).alias("missing"),
        F.sum(c * c).alias("sum_of_squares"), F.avg(c).alias("mean"), F.stddev(c).alias("stddev"),
    )


def top_clusters(df: DataFrame, column: str = "clusterid", limit: int = 10) -> DataFrame:
    """(clusterid, n) of the largest clusters."""
    return field_facet(df, column, limit=limit).withColumnRenamed("value", column)


def group_by_cluster(df: DataFrame, column: str, score: str = "score", groups: int = 10) -> DataFrame:
    """The first documents of the `groups` most relevant clusters (by score, then id), with rank and similar, the ids of
    the cluster's other documents in that order.

    Roots are partial minima, so a cluster of any size costs a row for each task; only members of the clusters that are
    shown are gathered.
    """
    place = F.struct((-F.col(score).cast("double")).alias("less"), F.col("id"))
    roots = df.groupBy(column).agg(F.min(place).alias("root")).orderBy("root", column).limit(groups)
    roots = roots.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy("root", column)))  # `groups` rows
    shown = F.broadcast(roots.select(column, F.col("root.id").alias("__root"), "rank"))
    members = df.join(shown, column)
    lists = members.filter(F.col("id") != F.col("__root")).groupBy(F.col("rank").alias("__rank")).agg(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["id"]).alias("similar"))
    out = members.filter(F.col("id") == F.col("__root")).drop("__root").dropDuplicates(["rank"]).join(lists, F.col("rank") == F.col("__rank"), "left").drop("__rank")
    return out.withColumn("similar", F.coalesce("similar", F.array().cast("array<string>")))


def by_size(grouped: DataFrame) -> DataFrame:
    """Largest group first; of equal size the one that came later in relevance first."""
    return grouped.orderBy(F.size("similar").desc(), F.col("rank").desc())


def field_stats(df: DataFrame, exact: bool = False) -> DataFrame:
    """(field, type, docs, distinct): for each field how many rows have it and how many values it has; of a list field,
    how many rows have elements and how many elements there are. In one pass, with distinct values estimated; or
    exactly, at the cost of a shuffle of each field's values."""
    rows, counts = [], []
    for i, f in enumerate(df.schema.fields):
        listed = isinstance(f.dataType, ArrayType)
        c = F.col(f"`{f.name}`")
        rows.append(F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n{i}").alias("docs"), F.col(f"d{i}").alias("distinct")))
        counts.append(F.count_if(F.size(c) > 0).alias(f"n{i}") if listed else F.count(c).alias(f"n{i}"))
        if not listed and not exact:
            counts.append(F.approx_count_distinct(c).alias(f"d{i}"))
    out = df.agg(*counts)
    for i, f in enumerate(df.schema.fields):
        listed = isinstance(f.dataType, ArrayType)
        if listed or exact:  # a row each, beside the one row of counts
            values = df.select((F.explode(F.col(f"`{f.name}`")) if listed else F.col(f"`{f.name}`")).alias("x")).filter("x is not null")
            own = values.groupBy("x").count().agg(F.count("*").alias(f"d{i}")) if exact else values.agg(F.approx_count_distinct("x").alias(f"d{i}"))
            out = out.crossJoin(F.broadcast(own))
    return out.select(F.explode(F.array(*rows)).alias("x")).select("x.*")

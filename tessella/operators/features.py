"""Sparse feature vectors in long form, document frequencies, IDF weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from .store import remove_table, write_table

DEFAULT_DF = 2
#: Features whose frequencies are sent to all tasks, at most.
MOST_SENT = 400_000


def idf(total: Column, df: Column) -> Column:
    """ln(1 + total div df): the division drops the remainder. A feature without a frequency counts as in two."""
    return F.log(F.lit(1) + F.floor(total / F.coalesce(df, F.lit(DEFAULT_DF))))


def spread(docs: DataFrame) -> DataFrame:
    """The rows over all cores, if they come in fewer parts than there are cores, as a small table in one file does; a larger
    table as it is. For work that costs far more than moving the texts."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(2 * cores) if docs.rdd.getNumPartitions() < cores else docs


def exploded(docs: DataFrame, kind: str, column: str, distinct: bool = False) -> DataFrame:
    """(id, kind, feature) of each distinct feature of a document; distinct says that the column's arrays hold none twice."""
    return docs.select("id", F.lit(kind).alias("kind"), F.explode(F.col(column) if distinct else F.array_distinct(F.coalesce(column, F.array().cast("array<string>")))).alias("feature"))


def doc_frequency(features: DataFrame) -> DataFrame:
    """(kind, feature, df): documents that have the feature, of rows (id, kind, feature) that are distinct, as exploded() of
    distinct ids gives them."""
    return features.groupBy("kind", "feature").agg(F.count("*").alias("df"))


def with_frequency(rows: DataFrame, df: DataFrame, feature: str = "feature") -> DataFrame:
    """rows, a written table with a row for each document of a feature, with the features' frequencies of df (feature, df).

    A feature of at least n rows is one of at most (all rows / n), so with n chosen by MOST_SENT the frequent ones, whose
    rows are most rows, go to all tasks, and only rows of rarer ones meet theirs in a shuffle.
    """
    least = rows.count() // MOST_SENT + 1
    met = rows.join(F.broadcast(df.filter(F.col("df") >= least)), feature, "left" if least > 1 else "inner")
    if least == 1:
        return met
    rare = met.filter(F.col("df").isNull()).drop("df").join(df.filter(F.col("df") < least), feature)
    return met.filter(F.col("df").isNotNull()).unionByName(rare)


def vectors(features: DataFrame, df: DataFrame, total: int | Column) -> DataFrame:
    """(id, feature, weight): IDF, no term frequency; a feature that is both n-gram and entity counts as n-gram."""
    total = F.lit(total) if isinstance(total, int) else total
    # 'ngram' is the greater kind, so the maximum is the one that wins
    one = features.groupBy("id", "feature").agg(F.max("kind").alias("kind"))
    return one.join(df, ["kind", "feature"], "left").select("id", "feature", idf(total, F.col("df")).alias("weight"))


def tallied(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Rows, numbers of features, and how often each is there, of the features of each list, and the features by number."""
    row, all_of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy()), lists.flatten()
    if all_of.null_count:
        row, all_of = row[all_of.is_valid().to_numpy(zero_copy_only=False)], all_of.drop_null()
    coded = all_of.dictionary_encode()
    key, n = np.unique(row * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
    row, code = np.divmod(key, max(1, len(coded.dictionary)))
    return row, code, n, coded.dictionary


def list_frequency(docs: DataFrame, column: str) -> DataFrame:
    """(feature, df): rows whose array has the feature. Each batch of rows brings a row for each of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, code, _, names = tallied(batch.column(0))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(code, minlength=len(names)))], ["feature", "df"])

    small_batches(docs.sparkSession)
    return docs.select(column).mapInArrow(run, "feature string, df long").groupBy("feature").agg(F.sum("df").alias("df"))


def _lists(row: np.ndarray, rows: int, **columns: pa.Array) -> pa.ListArray:
    """A list of structs for each of so many rows; row says whose each is, in order."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def export_vectors(docs: DataFrame, column: str = "ngram", most_df: float = 0.5, most_empty: float = 0.05) -> DataFrame:
    """(id, feature, weight): TF-IDF without features in more than most_df of the documents, of length 1.

    More than most_empty documents without any feature are an error. A document is a row up to the end. Frequencies of
    frequent features, of at most MOST_SENT, go to all tasks; only rows of rarer features are shuffled, to meet theirs and to
    go back to their documents. Rows of an id that is there more than once are put together first.
    """
    spark = docs.sparkSession
    total, copies = docs.groupBy("id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
    if copies and copies > 1:
        docs = docs.groupBy("id").agg(F.flatten(F.collect_list(column)).alias(column))
    df = write_table(list_frequency(docs, column), "frequencies")
    # no more than MOST_SENT features can have so many of all rows
    least = (df.agg(F.sum("df")).first()[0] or 0) // MOST_SENT + 1
    sent = spark.sparkContext.broadcast(df.filter(F.col("df") >= least).toArrow().combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.concat_arrays([*sent.value.column("feature").chunks, pa.array([], sent.value.schema.field("feature").type)])
        known_df = np.append(sent.value.column("df").to_numpy(), 0)
        for batch in batches:
            row, code, n, names = tallied(batch.column(1))
            df = known_df[pc.index_in(names.cast(known.type), value_set=known).fill_null(-1).to_numpy()][code]
            kept, rare = (df > 0) & (df <= most_df * total), df == 0
            w = np.sqrt(n[kept]) * (np.log(total / (df[kept] + 1)) + 1)
            found = _lists(row[kept], len(batch), feature=names.take(pa.array(code[kept])), w=pa.array(w))
            left = _lists(row[rare], len(batch), feature=names.take(pa.array(code[rare])), tf=pa.array(n[rare]))
            yield pa.RecordBatch.from_arrays([batch.column(0), found, left, pa.array(np.bincount(row[kept], w * w, len(batch)).astype(np.float64))], ["id", "found", "left", "squares"])

    kind = docs.schema["id"].dataType.simpleString()
    met = docs.select("id", column).mapInArrow(run, f"id {kind}, found array<struct<feature:string,w:double>>, left array<struct<feature:string,tf:bigint>>, squares double")
    met = write_table(met, "met")
    weight = F.sqrt("tf") * (F.log(F.lit(total) / (F.col("df") + 1)) + 1)
    rare = met.select("id", F.inline("left")).join(df.filter((F.col("df") < least) & (F.col("df") <= most_df * total)), "feature").select("id", "feature", weight.alias("w"))
    rare = rare.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("feature", "w")).alias("more"), F.sum(F.col("w") * F.col("w")).alias("rest"))
    both = met.drop("left").join(write_table(rare, "rare"), F.col("id").eqNullSafe(F.col("of")), "left")
    left = both.filter((F.col("squares") > 0) | F.col("rest").isNotNull()).count()
    remove_table(df)
    if total and (total - left) / total > most_empty:
        raise ValueError(f"{total - left} of {total} documents have no features left")
    length = F.sqrt(F.col("squares") + F.coalesce("rest", F.lit(0.0)))
    rows = both.select("id", length.alias("length"), F.inline(F.concat("found", F.coalesce("more", F.array().cast("array<struct<feature:string,w:double>>")))))
    return rows.select("id", "feature", (F.col("w") / F.col("length")).alias("weight"))


def term_vectors(docs: DataFrame, tokens: str) -> DataFrame:
    """(id, term, tf, df)."""
    tf = write_table(docs.select("id", F.explode(tokens).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf")), "counted")
    df = write_table(tf.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    return with_frequency(tf, df, "term").select("id", "term", "tf", "df")


def term_histogram(docs: DataFrame, tokens: str, height: int = 160) -> DataFrame:
    """(bucket, n, bar): terms by the power of two at or above their document frequency, and a bar of the largest's height."""
    df = docs.select("id", F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = df.groupBy(F.pow(F.lit(2), F.ceil(F.log2("df"))).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    # a bucket for each power of two: a few dozen rows at any size
    return n.withColumn("bar", F.floor(F.col("n") * height / F.max("n").over(Window.partitionBy())))

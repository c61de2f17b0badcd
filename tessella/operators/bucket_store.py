"""A store of documents in buckets of ids, of which an upsert rewrites only those that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import remove_table, write_table

_BUCKET = "__bucket"


class BucketStore:
    """Rows with distinct ids under a path that all machines share, in `buckets` folders by the hash of the id.

    An upsert keeps, of a stored row and the changed ones with its id, the one of the greatest version, and of several with
    that the greatest by its columns from left to right. So an upsert that is run again, after a failure or with a batch that a
    stream repeats, changes nothing, and an older version never takes the place of a newer one. Only touched buckets are read
    (the rest are pruned) and overwritten; merged rows are written aside first, so a failure before the overwrite leaves
    the store as it was, and one within it is mended by the same upsert again. A row without id is refused.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, version: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.version, self.buckets = spark, path, schema, version, buckets
        self._all = T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            self._write(spark.createDataFrame([], self._all))

    def _write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.path)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self._all).parquet(self.path)

    def rows(self) -> DataFrame:
        return self._read().drop(_BUCKET)

    def lookup(self, ids: list) -> DataFrame:
        """The rows of some ids, from their buckets alone."""
        own = self.spark.createDataFrame([(i,) for i in ids], T.StructType([self.schema["id"]])).select(self._bucket().alias("b")).distinct()
        return self._read().filter(F.col(_BUCKET).isin([r.b for r in own.collect()]) & F.col("id").isin(ids)).drop(_BUCKET)

    def _bucket(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def touched(self, changed: DataFrame) -> list[int]:
        """The buckets of changed rows: at most as many numbers as there are buckets."""
        return sorted(r.b for r in changed.select(self._bucket().alias("b")).distinct().collect())

    def upsert(self, changed: DataFrame) -> list[int]:
        """Merge changed rows (the store's columns) and return the buckets that were rewritten."""
        names = [f.name for f in self.schema.fields]
        new = write_table(changed.select(*names), "changed")
        if not new.filter("id is null").isEmpty():
            remove_table(new)
            raise ValueError("a changed row has no id")
        touched = self.touched(new)
        if touched:
            old = self._read().filter(F.col(_BUCKET).isin(touched)).select(*names)
            rest = [n for n in names if n not in ("id", self.version)]
            best = old.unionByName(new).groupBy("id").agg(F.max(F.struct(self.version, *rest)).alias("x")).select("id", "x.*").select(*names)
            merged = write_table(best.withColumn(_BUCKET, self._bucket()).repartition(len(touched), _BUCKET), "merged")
            self._write(merged)
            remove_table(merged)
        remove_table(new)
        return touched

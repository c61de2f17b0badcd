"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where it is unset and all runs on this machine, an own one; elsewhere
    executors would not see that, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, at, True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a row group, of which every task that writes holds one.
ROW_GROUP = 32 << 20


def drop_shuffles(spark: SparkSession) -> None:
    """Let what a query has shuffled be removed when the query has ended, not when the driver happens to collect garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def write_table(df: DataFrame, name: str, folders: str | None = None) -> DataFrame:
    """df, read back from a Parquet table: its lineage is cut, and several uses compute it once. With folders, the last column's
    values are folders, and those that a filter leaves out are not read."""
    spark = df.sparkSession
    path = f"{new_path(spark, name)}.parquet"
    drop_shuffles(spark)
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path, partitionBy=folders)
    table = spark.read.schema(df.schema).parquet(path)
    table.table_path = path
    return table


def remove_table(*tables: DataFrame) -> None:
    """Remove tables of write_table() that nothing will read any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.table_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

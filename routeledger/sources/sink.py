"""A sink for streams that may be replayed: batches are merged by key into a partitioned table, with a ledger of what has been merged."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def merged(rows: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """One row for each key: the least `first`, the greatest `last`, and all else from the row with the greatest (last, first, values).

    The result doesn't depend on the order of the rows, nor on how often each is there. Columns must be comparable.
    """
    others = [c for c in rows.columns if c not in (*keys, first, last)]
    newest: Column = F.max(F.struct(last, first, *others)).alias("_newest")
    found = rows.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last), newest)
    return found.select(*(F.col(f"_newest.{c}").alias(c) if c in others else F.col(c) for c in rows.columns))


def merging(path: str, keys: list[str], partition: str, first: str = "first_seen", last: str = "last_seen", stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that merges a batch into the table at path/rows.

    `partition` is one of the keys, so that a key never leaves its partition: only partitions that the batch touches are read and
    written over. The merged rows are written beside the table first, then put in its place; a run that fails between the two
    is mended by the next try, since merging twice gives the same. path/ledger has the batches that were merged, which are skipped.
    """
    if partition not in keys:
        raise ValueError("the partition has to be one of the keys")

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ledger, table = f"{path}/ledger", f"{path}/rows"
        if exists(spark, ledger) and spark.read.schema("stream string, batch long").parquet(ledger).where((F.col("stream") == stream) & (F.col("batch") == batch_id)).limit(1).count():
            return
        new = merged(batch, keys, first, last)
        if exists(spark, table):
            touched = new.select(partition).distinct()
            old = spark.read.schema(batch.schema).parquet(table)
            new = merged(new.unionByName(old.join(touched, partition, "left_semi")), keys, first, last)
        staged = f"{path}/staged/{uuid.uuid4().hex}"
        new.write.parquet(staged)
        spark.read.schema(batch.schema).parquet(staged).repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(table)
        spark.createDataFrame([(stream, batch_id)], "stream string, batch long").coalesce(1).write.mode("append").parquet(ledger)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    return merge


def read_merged(spark: SparkSession, path: str, schema) -> DataFrame:
    """The merged table, with the columns in the order of the batches; empty before the first batch."""
    return spark.read.schema(schema).parquet(f"{path}/rows") if exists(spark, f"{path}/rows") else spark.createDataFrame([], schema)

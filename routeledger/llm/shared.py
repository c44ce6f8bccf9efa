"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, as in tests, a temporary one in local mode only."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir")
    if known:
        return known.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="routeledger-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table with checkpoint(); Spark removes its files once nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether Spark removes the shuffle files of a query as soon as it ends, rather than when the driver's memory is next collected.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidied(spark: SparkSession, tidy: bool = True) -> Iterator[None]:
    """Queries that end meanwhile have their shuffle files removed, if `tidy`."""
    before = spark.conf.get(TIDY)
    spark.conf.set(TIDY, str(tidy or before == "true").lower())
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


def total(df: DataFrame, *sums: Column | str) -> list[int]:
    """The sum of each column over a table; 0 if it has no rows."""
    with tidied(df.sparkSession):
        return [x or 0 for x in df.agg(*(F.sum(c) for c in sums)).first()]


def written(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write a table as Parquet in the shared folder and read it back: compressed, pruned by column, and with
    a shuffle of its own in later joins, so that Spark can split skewed partitions. If `tidy`, its shuffles are removed once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with tidied(spark, tidy):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = [path]
    return table


def in_parts(make: Callable[[DataFrame], DataFrame], df: DataFrame, n: int, *keys: str) -> DataFrame:
    """What `make` gives for each of n parts of df, dealt by `keys`, as `written`: only one part's shuffles are on disk at a time.
    `make` may bring together rows of equal keys only."""
    part = F.pmod(F.xxhash64(*keys), F.lit(n))
    tables = [written(make(df.where(part == i) if n > 1 else df), tidy=True) for i in range(n)]
    paths = [path for t in tables for path in t.scratch]
    table = df.sparkSession.read.schema(tables[0].schema).parquet(*paths)
    table.scratch = paths
    return table


def discard(df: DataFrame) -> None:
    """Remove a table that `written` or `in_parts` gave, once nothing that is still to run reads it."""
    for path in df.scratch:
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    if getattr(spark.sparkContext, "_jsc", None) is not None:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def needs(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; others, whatever their names, are left out."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(df[n] for n in names))

"""Joins over stored results: keyset pages, evidence within a time of an event, upserts and reconciliation of three lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(rows: DataFrame, key: str, after: Column | None, limit: int, descending: bool = True) -> DataFrame:
    """The next `limit` rows beyond a key, with `more`: whether there are others. The condition on the key reaches the scan."""
    beyond = rows if after is None else rows.where(F.col(key) < after if descending else F.col(key) > after)
    order = F.col(key).desc() if descending else F.col(key).asc()
    page = beyond.orderBy(order).limit(limit + 1)  # what the windows look at
    placed = page.withColumn("_place", F.row_number().over(Window.orderBy(order))).withColumn("more", F.count("*").over(Window.partitionBy()) > limit)
    return placed.where(F.col("_place") <= limit).drop("_place")


def within(events: DataFrame, logs: DataFrame, key: str, at: str, seconds: int = 3600) -> DataFrame:
    """Pairs of an event and a log of one key at most so many seconds apart (`at`: whole seconds; `log_at` of the logs).

    Both are dealt into buckets of that length: a log goes to its own and both neighbouring ones, so that an equi-join of key and
    bucket finds every pair once, and no key meets in one task as a whole.
    """
    own = events.withColumn("_bucket", F.expr(f"floor({at} / {seconds})"))
    near = logs.withColumnRenamed(at, "log_at").withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.expr(f"floor(log_at / {seconds})") + d)))
    met = own.join(near, [key, "_bucket"])
    return met.where(F.abs(F.col(at) - F.col("log_at")) <= seconds).drop("_bucket")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], keep_first: bool = False) -> DataFrame:
    """Stored rows with new ones put in by key: over those that are there, or, with keep_first, only where there are none."""
    if keep_first:
        return stored.unionByName(new.join(stored.select(*keys), keys, "left_anti"))
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new)


def reconciled(desired: DataFrame, registered: DataFrame, remote: DataFrame) -> DataFrame:
    """name and operation for lists of artifacts: desired (name, hash), registered (name, hash, status, resource) and remote (name).

    create: not registered with a resource; recreate: gone from the remote side; unchanged: synced with the same hash; update otherwise;
    `conflict` where the remote side has a name that is not registered; stale: registered, but no longer desired.
    """
    known = registered.select("name", F.col("hash").alias("stored"), "status", "resource")
    there = remote.select("name").distinct().withColumn("there", F.lit(True))
    met = desired.join(known, "name", "left").join(there, "name", "left")
    operation = (
        F.when(F.col("resource").isNull(), F.when(F.col("there").isNotNull(), "conflict").otherwise("create"))
        .when(F.col("there").isNull(), "recreate").when((F.col("stored") == F.col("hash")) & (F.col("status") == "synced"), "unchanged").otherwise("update")
    )
    stale = registered.where("status <> 'deleted'").join(desired.select("name"), "name", "left_anti").select("name", F.lit("stale").alias("operation"))
    return met.select("name", operation.alias("operation")).unionByName(stale)

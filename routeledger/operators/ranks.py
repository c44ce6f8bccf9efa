"""Exact percentiles by distributed rank selection: no task holds the values of one key.

Different values are counted, dealt into ranges of (key, value), and the ranges' sums give the range that holds each wanted rank; the
value is found there. A hot key spans ranges, and a hot value is one count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeledger.functions.exact import decimal6
from routeledger.operators.graph import cut


def percentiles(rows: DataFrame, keys: list[str], value: str, percents: list[int], prefix: str = "p") -> DataFrame:
    """keys and the nearest-rank percentiles p50, p95, ... of a column of whole numbers; nulls are left out, keys without a value too.

    Null keys are keys. The value of percent p is the one of rank ceil(n * p / 100), and of rank 1 at least.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("k"), F.col(value).cast("bigint").alias("v")).agg(F.count("*").alias("n"))
    dealt = cut(counted.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # of a row for each range of a key
    sizes = dealt.groupBy("k", "part").agg(F.sum("n").alias("m"))
    placed = sizes.select("k", "part", "m", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("k")).alias("total"))
    rank = F.greatest(F.lit(1), F.expr("(total * percent + 99) div 100"))
    wanted = placed.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("rank", rank).where("rank > before AND rank <= before + m")
    ranges = wanted.groupBy("k", "part").agg(F.collect_list(F.struct("percent", (F.col("rank") - F.col("before")).alias("rank"))).alias("wanted"))
    so_far = Window.partitionBy("k", "part").orderBy("v")
    met = dealt.join(ranges, ["k", "part"]).withColumn("upto", F.sum("n").over(so_far))
    hits = met.select("k", "v", F.explode(F.filter("wanted", lambda w: (w["rank"] <= F.col("upto")) & (w["rank"] > F.col("upto") - F.col("n")))).alias("w"))
    found = hits.groupBy("k").agg(*(F.max(F.when(F.col("w.percent") == p, F.col("v"))).alias(f"{prefix}{p}") for p in percents))
    return found.select("k.*", *(f"{prefix}{p}" for p in percents))


def distribution(rows: DataFrame, keys: list[str], value: str, prefix: str = "", percents: tuple[int, ...] = (50, 75, 90, 95, 99)) -> DataFrame:
    """keys with count, least, most, sum, mean (text of six decimals) and percentiles of a column of whole numbers; nulls are left out."""
    n, total = F.count(value), F.sum(value)
    plain = rows.groupBy(*keys).agg(n.alias(f"{prefix}count"), F.min(value).alias(f"{prefix}min"), F.max(value).alias(f"{prefix}max"), total.alias(f"{prefix}sum"), decimal6(total, n).alias(f"{prefix}mean"))
    ranked = percentiles(rows, keys, value, list(percents), f"{prefix}p")
    mine = ranked.select(F.struct(*keys).alias("_k"), *(c for c in ranked.columns if c not in keys))
    return plain.withColumn("_k", F.struct(*keys)).join(mine, "_k", "left").drop("_k")

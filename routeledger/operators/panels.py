"""The panels of a dashboard over evaluated runs, as one table, and the latest violating traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeledger.operators.ranks import percentiles
from routeledger.operators.release import ABOVE_CODES, UNKNOWN_CODES


def series(runs: DataFrame, violations: DataFrame) -> DataFrame:
    """panel, day, key and value of every panel.

    runs: trace_id, release, day, status, duration_ms, tokens and retries; violations: trace_id, rule_type, severity and code.
    - decisions: runs by status; retries and tokens: their sums by release; latency: the p95 of durations by release.
    - violations: by release; rules: violations by kind of rule and severity; unknown_routes and duplicates: runs by release that have such a violation.
    Nulls add nothing; a series without a value on a day has no row. Every panel but latency is a sum, so rows are summed where they are.
    """
    row = lambda panel, key, value: F.struct(F.lit(panel).alias("panel"), key.alias("key"), value.cast("bigint").alias("value"))
    release = F.col("release")
    marks: dict[str, Column] = {"unknown_routes": F.col("code").isin(*UNKNOWN_CODES), "duplicates": F.col("code").isin(*ABOVE_CODES)}
    per_run = violations.groupBy("trace_id").agg(F.count("*").alias("violations"), *(F.max(c.cast("int")).alias(n) for n, c in marks.items()))
    met = runs.join(per_run, "trace_id", "left")
    sums = [row("decisions", F.col("status"), F.lit(1)), *(row(n, release, F.col(n)) for n in ("tokens", "retries", "violations", *marks))]
    by_rule = violations.select("trace_id", F.concat_ws("/", "rule_type", "severity").alias("key")).join(runs.select("trace_id", "day"), "trace_id").select("day", row("rules", F.col("key"), F.lit(1)).alias("x"))
    added = met.select("day", F.explode(F.array(*sums)).alias("x")).unionByName(by_rule).select("day", "x.*").where("value IS NOT NULL")
    added = added.groupBy("panel", "day", "key").agg(F.sum("value").alias("value")).where("value <> 0")
    latency = percentiles(runs, ["release", "day"], "duration_ms", [95]).select(F.lit("latency").alias("panel"), "day", F.col("release").alias("key"), F.col("p95").alias("value"))
    return added.select("panel", "day", "key", "value").unionByName(latency)


def latest_violating(runs: DataFrame, violations: DataFrame, most: int = 20) -> DataFrame:
    """release, place, trace_id, start_ns and violations of the latest runs of each release that have a violation, ties to the smaller trace_id."""
    counted = violations.groupBy("trace_id").agg(F.count("*").alias("violations"))
    order = [F.desc("start_ns"), "trace_id"]
    met = runs.join(counted, "trace_id").withColumn("part", F.pmod(F.xxhash64("trace_id"), F.lit(64)))
    first = met.withColumn("place", F.row_number().over(Window.partitionBy("release", "part").orderBy(*order))).where(F.col("place") <= most)
    last = first.withColumn("place", F.row_number().over(Window.partitionBy("release").orderBy(*order))).where(F.col("place") <= most)
    return last.select("release", F.col("place").cast("bigint").alias("place"), "trace_id", "start_ns", "violations")

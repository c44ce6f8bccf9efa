"""Rolling windows over runs for alerts, and runs that are closed by a watermark for continuous evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeledger.operators.ranks import percentiles


def rolling(rows: DataFrame, ts: str, span: str, every: str, key: str | None = None) -> DataFrame:
    """Counts of rows in windows of `span` that start every `every`: window_start, [key], n. Batch or streaming."""
    keys = [F.window(ts, span, every).alias("w"), *([F.col(key)] if key else [])]
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *([key] if key else []), "n")


def alert(counts: DataFrame, threshold: int, direction: str = "above", recovery: int | None = None) -> DataFrame:
    """`state` of every window: firing beyond the threshold, recovering between it and the recovery target, else ok."""
    beyond = F.col("n") > threshold if direction == "above" else F.col("n") < threshold
    near = F.lit(False) if recovery is None else (F.col("n") > recovery if direction == "above" else F.col("n") < recovery)
    return counts.withColumn("state", F.when(beyond, "firing").when(near, "recovering").otherwise("ok"))


def absent(rows: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Starts of the windows of some minutes, between the first and the last, that have no rows."""
    micros = minutes * 60_000_000
    have = rows.select((F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / micros)).alias("w")).distinct()
    ends = have.agg(F.min("w").alias("lo"), F.max("w").alias("hi")).where("lo IS NOT NULL")
    every = ends.select(F.explode(F.sequence("lo", "hi")).alias("w"))
    return every.join(have, "w", "left_anti").select(F.timestamp_micros(F.col("w") * micros).alias("window_start"))


def closed_runs(spans: DataFrame, ts: str = "ts", gap: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """trace_id, first, last and spans of runs that have had no span for `gap`; spans later than `late` are left out."""
    return (
        spans.withWatermark(ts, late).groupBy("trace_id", F.session_window(ts, gap).alias("s"))
        .agg(F.count("*").alias("spans")).select("trace_id", F.col("s.start").alias("first"), F.col("s.end").alias("last"), "spans")
    )


def evaluate_closed(runs: DataFrame, evaluate: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Start a stream that hands every batch of closed runs to `evaluate`."""
    return runs.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(evaluate).start()


def counter_increase(points: DataFrame, ts: str = "ts") -> DataFrame:
    """The increase of a counter from point to point of each series, a fall being a reset: series, ts, increase."""
    before = F.lag("value").over(Window.partitionBy("series").orderBy(ts))
    return points.select("series", ts, F.when(before.isNull(), F.lit(None)).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value")).alias("increase"))


def bucket_quantiles(points: DataFrame, percents: list[int], width: str, ts: str = "ts") -> DataFrame:
    """window_start, observed and p50, p95, ... of histograms, whose buckets are counters.

    points: series (text), le (upper end of a bucket, infinity for the last one), ts and value (observations up to le so far). Each
    bucket's increases are added up by window and over all series, so that a series that restarts counts from 0 again. A percentile lies in the
    first bucket that reaches its rank, by linear interpolation from the bucket below, or from 0 below the first one; beyond the last finite
    end it is that end. Buckets are made to rise with le. Windows without observations have null percentiles.
    """
    by_bucket = points.select(F.struct("series", "le").alias("series"), ts, "value")
    grown = counter_increase(by_bucket, ts).where("increase IS NOT NULL").groupBy(F.window(ts, width).start.alias("window_start"), F.col("series.le").alias("le")).agg(F.sum("increase").alias("n"))
    # One row for each bucket of a window: as many as the histogram has.
    buckets = grown.groupBy("window_start").agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("raw"))
    highest = F.transform("raw", lambda b, i: F.struct(b["le"].alias("le"), F.array_max(F.transform(F.slice("raw", 1, i + 1), lambda x: x["n"])).cast("double").alias("n")))
    ready = buckets.withColumn("b", highest).withColumn("total", F.element_at("b", -1)["n"])

    def at(percent: int) -> Column:
        rank = F.col("total") * percent / 100
        i = F.array_position(F.transform("b", lambda x: x["n"] >= rank), F.lit(True)).cast("int")  # from 1
        here, below = F.element_at("b", i), F.when(i > 1, F.element_at("b", F.greatest(i - 1, F.lit(1))))
        low, before = F.coalesce(below["le"], F.when(here["le"] > 0, F.lit(0.0)).otherwise(here["le"])), F.coalesce(below["n"], F.lit(0.0))
        inside = low + (here["le"] - low) * (rank - before) / F.when(here["n"] > before, here["n"] - before)
        return F.when(F.col("total") > 0, F.when(here["le"] == float("inf"), below["le"]).otherwise(F.coalesce(inside, here["le"])))

    return ready.select("window_start", F.col("total").cast("bigint").alias("observed"), *(at(p).alias(f"p{p}") for p in percents))


def panels(runs: DataFrame) -> DataFrame:
    """release and day with runs, p95 of duration_ms, tokens and the most retries; runs have start_ns and these columns."""
    dated = runs.withColumn("day", F.date_trunc("day", F.timestamp_micros(F.expr("start_ns div 1000"))).cast("timestamp_ntz"))
    ranked = percentiles(dated, ["release", "day"], "duration_ms", [95]).select(F.struct("release", "day").alias("_k"), F.col("p95").alias("p95_ms"))
    plain = dated.groupBy("release", "day").agg(F.count("*").alias("runs"), F.sum("tokens").alias("tokens"), F.max("retries").alias("most_retry"))
    return plain.withColumn("_k", F.struct("release", "day")).join(ranked, "_k", "left").select("release", "day", "runs", "p95_ms", "tokens", "most_retry")

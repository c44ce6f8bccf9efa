"""Percentiles of hot keys, histograms, running alerts, and a sink that may be replayed."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from routeledger.operators import ranks
from routeledger.sources import sink
from routeledger.streaming import alerts, windows


def test_percentiles_of_hot_keys(spark):
    rng = random.Random(21)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([rng.randrange(30), rng.randrange(10**6), -5, None])) for _ in range(4000)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v long").withColumn("n", F.lit(1)).repartition(6)
    got = {r["k"]: tuple(r)[1:] for r in ranks.percentiles(df, ["k"], "v", [1, 50, 95, 99, 100]).collect()}
    values = {}
    for k, v in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    assert got == {k: tuple(sorted(v)[max(1, -(-len(v) * p // 100)) - 1] for p in (1, 50, 95, 99, 100)) for k, v in values.items()}
    whole = {r["k"]: r for r in ranks.distribution(df, ["k"], "v", "d_").collect()}
    assert set(whole) == {*values, "none"} and whole["none"]["d_count"] == 0 and whole["none"]["d_p50"] is None and whole["hot"]["d_sum"] == sum(values["hot"])
    assert ranks.percentiles(df.limit(0), ["k"], "v", [50]).count() == 0


def test_bucket_quantiles(spark):
    start, inf = datetime(2024, 1, 1), math.inf
    series = {"a": [(0, 0, 0), (10, 40, 50), (10, 40, 50), (2, 4, 8)], "b": [(0, 0, 0), (0, 10, 10), (0, 10, 30), (0, 10, 30)]}  # a restarts
    rows = [(s, le, start + timedelta(minutes=i), v) for s, points in series.items() for i, p in enumerate(points) for le, v in zip((10.0, 20.0, inf), p, strict=True)]
    df = spark.createDataFrame(rows, "series string, le double, ts timestamp, value long")
    got = {r["window_start"]: (r["observed"], r["p50"], r["p95"]) for r in windows.bucket_quantiles(df, [50, 95], "1 minute").collect()}
    at = lambda i: start + timedelta(minutes=i)
    assert set(got) == {at(1), at(2), at(3)}
    assert got[at(1)] == (60, 10 + 10 * (30 - 10) / 40, 20.0)  # 10, 50, 60 observations up to each end
    assert got[at(2)] == (20, 20.0, 20.0)  # all beyond the last finite end
    assert got[at(3)] == (8, 20.0, 20.0)
    (still,) = windows.bucket_quantiles(df.where("series = 'b' AND minute(ts) > 1"), [50], "1 hour").collect()
    assert (still["observed"], still["p50"]) == (0, None)


RULES = [
    alerts.Rule(3, "at_least_once", recovery=1, window_minutes=2, absent_minutes=4),
    alerts.Rule(1, "all_the_times", window_minutes=3, recovery=0),
    alerts.Rule(2, "on_average", "below", window_minutes=2, absent_minutes=3),
    alerts.Rule(6, "in_total", recovery=3, window_minutes=4),
]


def slow_states(rows, rule):
    out, by = [], {}
    for s, t in rows:
        by.setdefault(s, []).append(int((t - datetime(1970, 1, 1)).total_seconds()) // 60)
    for s, minutes in by.items():
        state, seen = "ok", None
        for m in range(min(minutes), max(minutes) + 1):
            points = [minutes.count(x) for x in range(m - rule.window_minutes + 1, m + 1) if x in minutes]
            seen = m if m in minutes else seen
            state = alerts.step(rule, state, points, m - seen)
            out.append((s, m, state))
    return sorted(out)


def alert_rows():
    rng = random.Random(22)
    start, rows = datetime(2024, 1, 1), []
    for s in ("a", "b"):
        minute = 0
        for _ in range(40):
            minute += rng.choice([0, 0, 1, 1, 2, 7])
            rows += [(s, start + timedelta(minutes=minute, seconds=rng.randrange(60))) for _ in range(rng.choice([1, 2, 5]))]
    return rows


def test_alerts_of_a_batch(spark):
    rows = alert_rows()
    df = spark.createDataFrame(rows, "series string, ts timestamp")
    for rule in RULES:
        got = sorted(map(tuple, alerts.batch_states(df, rule).collect()))
        assert got == slow_states(rows, rule) and len({s for _, _, s in got}) > 1
    with pytest.raises(ValueError):
        alerts.batch_states(df, alerts.Rule(1, "sometimes"))


def test_running_alerts_equal_the_batch(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows, rule = alert_rows(), RULES[0]
        end = max(t for _, t in rows)
        order = sorted(rows, key=lambda r: r[1])
        order[0], order[3] = order[3], order[0]
        parts = [order[i : i + 40] for i in range(0, len(order), 40)]
        parts[2] = [*parts[2], ("a", min(order, key=lambda r: r[1])[1])]  # too late: its minute has been told
        parts.append([("z", end + timedelta(minutes=30))])  # brings the time forward: a and b fall silent
        for i, part in enumerate(parts):
            spark.createDataFrame(part, "series string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i:02}"))
        stream = spark.readStream.schema("series string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        told = []
        query = alerts.running_states(stream, rule).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).foreachBatch(lambda df, _: told.extend(map(tuple, df.collect()))).start().awaitTermination(150)
        want = slow_states(rows, rule)
        last = {s: max(m for x, m, _ in want if x == s) for s in ("a", "b")}
        assert sorted(t for t in told if t[0] in last and t[1] <= last[t[0]]) == want
        assert {s for s, m, state in told if state == "absent" and m > last.get(s, 0)} == {"a", "b"}
    finally:
        spark.conf.unset(provider)


def test_replayed_and_reordered_batches_give_one_table(spark, tmp_path):
    rng = random.Random(23)
    schema = "day string, id long, first_seen long, last_seen long, note string"
    rows = [(f"d{i % 3}", rng.randrange(20), t := rng.randrange(100), t + rng.randrange(9), rng.choice(["x", "y", None])) for i in range(120)]
    batches = [rows[i : i + 30] for i in range(0, 120, 30)]
    want = None
    for name, order in (("plain", [0, 1, 2, 3]), ("again", [0, 1, 1, 0, 2, 3, 3]), ("mixed", [3, 1, 0, 2])):
        path = str(tmp_path / name)
        merge = sink.merging(path, ["day", "id"], "day")
        assert sink.read_merged(spark, path, schema).count() == 0
        for b in order:
            merge(spark.createDataFrame(batches[b], schema), b)
        if name == "mixed":  # a batch that was merged, but is not in the ledger
            sink.merging(path, ["day", "id"], "day", stream="other")(spark.createDataFrame(batches[2], schema), 2)
        got = sorted(map(str, sink.read_merged(spark, path, schema).collect()))
        want = want or got
        assert got == want and len(got) == len({r[:2] for r in rows})
    least = {}
    for d, i, f, _, _ in rows:
        least[d, i] = min(f, least.get((d, i), f))
    assert {(r["day"], r["id"]): r["first_seen"] for r in sink.read_merged(spark, path, schema).collect()} == least

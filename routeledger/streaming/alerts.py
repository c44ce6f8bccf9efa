"""Running alerts over counts by minute: states with hysteresis and absent data, as a stream and, by the same rules, as a batch.

A rule looks, at the end of every minute, at the points of its window: the counts of the minutes that have rows.
- `at_least_once`: some point is beyond the threshold; `all_the_times`: there are points, and all are; `on_average`, `in_total`: their mean or sum is.
- firing: beyond the threshold. recovering: not beyond, but still beyond the recovery target by the same match, after firing. ok: else.
- absent: without any row for `absent_minutes`, if the rule says so; no other state is looked at then, and the alert begins afresh afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MATCHES = ("at_least_once", "all_the_times", "on_average", "in_total")
STATES = "series string, minute long, state string"


class Rule(NamedTuple):
    threshold: int
    match: str = "at_least_once"
    direction: str = "above"
    recovery: int | None = None
    window_minutes: int = 5
    absent_minutes: int | None = None


def checked(rule: Rule) -> Rule:
    if rule.match not in MATCHES or rule.direction not in ("above", "below") or rule.window_minutes < 1 or (rule.absent_minutes or 1) < 1:
        raise ValueError(f"no alert rule: {rule}")
    return rule


def matched(rule: Rule, target: int, points: list[int]) -> bool:
    """Whether the points of a window are beyond a target."""
    sign = 1 if rule.direction == "above" else -1
    if not points:
        return False
    if rule.match == "in_total":
        return sign * sum(points) > sign * target
    if rule.match == "on_average":
        return sign * sum(points) > sign * target * len(points)
    return (any if rule.match == "at_least_once" else all)(sign * p > sign * target for p in points)


def step(rule: Rule, before: str, points: list[int], silent: int) -> str:
    """The next state, from the one before, the points of the window and the minutes since the last row."""
    if rule.absent_minutes is not None and silent >= rule.absent_minutes:
        return "absent"
    if matched(rule, rule.threshold, points):
        return "firing"
    if before in ("firing", "recovering") and rule.recovery is not None and matched(rule, rule.recovery, points):
        return "recovering"
    return "ok"


def counted(rows: DataFrame, ts: str, series: str) -> DataFrame:
    """series, minute (since the epoch) and ts of rows, to be counted by minute."""
    return rows.select(F.col(series).cast("string").alias("series"), F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 60_000_000).cast("bigint").alias("minute"), F.col(ts).cast("timestamp").alias("ts"))


def batch_states(rows: DataFrame, rule: Rule, ts: str = "ts", series: str = "series") -> DataFrame:
    """series, minute and state at the end of every minute from a series' first row to its last; rows without a time or a series are left out."""
    rule = checked(rule)
    points = counted(rows, ts, series).where("series IS NOT NULL AND minute IS NOT NULL").groupBy("series", "minute").agg(F.count("*").alias("n"))
    spans = points.withColumn("_next", F.lead("minute").over(Window.partitionBy("series").orderBy("minute")))
    grid = spans.select("series", F.col("minute").alias("seen"), "n", F.explode(F.sequence("minute", F.coalesce(F.col("_next") - 1, F.col("minute")))).alias("minute"))
    grid = grid.withColumn("point", F.when(F.col("minute") == F.col("seen"), F.col("n")))
    lately = Window.partitionBy("series").orderBy("minute").rowsBetween(1 - rule.window_minutes, 0)
    sign = 1 if rule.direction == "above" else -1

    def beyond(target: int) -> Column:
        n, total = F.count("point").over(lately), F.sum("point").over(lately)
        if rule.match in ("in_total", "on_average"):
            return (n > 0) & (sign * total > sign * target * (n if rule.match == "on_average" else 1))
        over = F.count(F.when(sign * F.col("point") > sign * target, 1)).over(lately)
        return over > 0 if rule.match == "at_least_once" else (n > 0) & (over == n)

    absent = F.lit(False) if rule.absent_minutes is None else F.col("minute") - F.col("seen") >= rule.absent_minutes
    near = F.lit(False) if rule.recovery is None else beyond(rule.recovery)
    told = grid.select("series", "minute", F.when(absent, "absent").when(beyond(rule.threshold), "firing").when(near, "near").otherwise("ok").alias("told"))
    # While it is near the threshold, an alert keeps what it was before: recovering after firing, else ok.
    last = F.last(F.when(F.col("told") != "near", F.col("told")), ignorenulls=True).over(Window.partitionBy("series").orderBy("minute"))
    return told.select("series", "minute", F.when(F.col("told") != "near", F.col("told")).when(last == "firing", "recovering").otherwise("ok").alias("state"))


class Alerting(StatefulProcessor):
    """Counts by minute of a series in a map, and a timer at the end of the next minute, which tells the state and sets the next timer."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "minute long", "n long")
        self.now = handle.getValueState("now", "minute long, state string, seen long")  # the next minute to tell, the last state, the last row's minute

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told, first = timerValues.getCurrentWatermarkInMs() // 60_000, None  # minutes before it have been told
        for some in rows:
            for minute, n in some["minute"].value_counts().items():
                if minute >= told:
                    at = (int(minute),)
                    self.counts.updateValue(at, ((self.counts.getValue(at)[0] if self.counts.containsKey(at) else 0) + int(n),))
                    first = int(minute) if first is None else min(first, int(minute))
        if first is not None and not self.now.exists():
            self.handle.registerTimer((first + 1) * 60_000)
            self.now.update((first, "ok", first))
        elif first is not None and first < self.now.get()[0]:  # before the series' first minute so far, none of which has been told
            self.now.update((first, "ok", first))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        minute, state, seen = self.now.get()
        upto, told = timerValues.getCurrentWatermarkInMs() // 60_000, []
        while minute < upto:
            points = {m: self.counts.getValue((m,))[0] for m in range(minute - self.rule.window_minutes + 1, minute + 1) if self.counts.containsKey((m,))}
            seen = minute if minute in points else seen
            state = step(self.rule, state, list(points.values()), minute - seen)
            told.append((key[0], minute, state))
            gone = (minute - self.rule.window_minutes + 1,)
            if self.counts.containsKey(gone):
                self.counts.removeKey(gone)
            minute += 1
        self.now.update((minute, state, seen))
        self.handle.registerTimer((minute + 1) * 60_000)
        yield pd.DataFrame(told, columns=["series", "minute", "state"])

    def close(self) -> None:
        pass


def running_states(rows: DataFrame, rule: Rule, ts: str = "ts", series: str = "series", late: str = "1 minute") -> DataFrame:
    """As batch_states, for a stream: a minute is told once the watermark has passed it, and goes on being told while other series bring the time
    forward, so that silence is seen. Rows later than `late` are left out. Spark's RocksDB state store has to be set."""
    rule = checked(rule)
    keyed = counted(rows, ts, series).where("series IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return keyed.groupBy("series").transformWithStateInPandas(Alerting(rule), outputStructType=STATES, outputMode="Append", timeMode="EventTime")

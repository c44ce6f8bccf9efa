"""Queries over the given tables for patterns, percentiles, histograms, alerts, merged sightings, drift and instruments, with DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeledger.operators import artifacts, instruments, panels, ranks, release, rules, selectors
from routeledger.plans import registry
from routeledger.plans.registry import table
from routeledger.sources import sink
from routeledger.streaming import alerts, windows

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    """Register a query by its function's name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__], ORACLES[fn.__name__] = fn, oracle
        return fn

    return add


#: Patterns on which engines that backtrack take quadratic to exponential time.
PATTERNS = {"words": "[a-z]+[a-z]+[a-z]+[a-z]+[a-z]+x", "ends": "(a|e|i)*e*s?$", "nested": "(([a-z]+-)*[a-z]+)+/$", "digits": r"^https?://[^/]+(/\w+)*/\d+$"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS pattern, page_id, length(url) <= 8192 AND regexp_matches(url, '{p}') AS found FROM pages WHERE url IS NOT NULL" for name, p in PATTERNS.items()))
def matching_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every page's url holds each pattern."""
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("pattern"), selectors.matches(F.col("url"), p).alias("found")) for n, p in PATTERNS.items())))
    return pages.select("page_id", each.alias("x")).select("x.pattern", "page_id", "x.found")


@query(
    "SELECT event_type, user_id % 10 = 0 AS tenth, count(us)::BIGINT AS n_count, quantile_disc(us, 0.5)::BIGINT AS n_p50, quantile_disc(us, 0.9)::BIGINT AS n_p90, quantile_disc(us, 0.99)::BIGINT AS n_p99, sum(us)::BIGINT AS n_sum"
    " FROM (SELECT event_type, user_id, floor(value * 1000)::BIGINT AS us FROM events) GROUP BY ALL"
)
def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of events' values, no task holding those of one type."""
    events = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10 == 0).alias("tenth"), F.floor(F.col("value") * 1000).cast("bigint").alias("us"))
    return ranks.distribution(events, ["event_type", "tenth"], "us", "n_", (50, 90, 99)).select("event_type", "tenth", "n_count", "n_p50", "n_p90", "n_p99", "n_sum")


ENDS = [5.0, 20.0, 50.0, 100.0, 200.0, 500.0, math.inf]


@query(f"""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS ts, b.le, count(*) FILTER (WHERE value <= b.le) AS n FROM events, (SELECT unnest([{", ".join("'inf'::DOUBLE" if e == math.inf else f"{e}::DOUBLE" for e in ENDS)}]) AS le) b GROUP BY ALL),
points AS (SELECT event_type, le, ts, (sum(n) OVER (PARTITION BY event_type, le, ts::DATE ORDER BY ts))::BIGINT AS v FROM h),
lagged AS (SELECT *, lag(v) OVER (PARTITION BY event_type, le ORDER BY ts) AS before FROM points),
raw AS (SELECT ts::DATE AS d, le, sum(CASE WHEN v >= before THEN v - before ELSE v END) AS n FROM lagged WHERE before IS NOT NULL GROUP BY ALL),
buckets AS (SELECT d, le, max(n) OVER w AS n, row_number() OVER w AS i, max(n) OVER (PARTITION BY d) AS total FROM raw WINDOW w AS (PARTITION BY d ORDER BY le)),
edges AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below FROM buckets WINDOW w AS (PARTITION BY d ORDER BY le)),
hit AS (SELECT p, d, total, min_by(struct_pack(le, n, low, below), i) AS b FROM edges, (SELECT unnest([50, 95]) AS p) WHERE n >= total::DOUBLE * p / 100 GROUP BY ALL),
said AS (SELECT d, p, total, CASE WHEN total > 0 THEN CASE WHEN b.le = 'inf'::DOUBLE THEN b.low WHEN b.n > b.below THEN b.low + (b.le - b.low) * (total::DOUBLE * p / 100 - b.below) / (b.n - b.below) ELSE b.le END END AS v FROM hit)
SELECT strftime(d, '%Y-%m-%d') AS day, total::BIGINT AS observed, round(max(CASE WHEN p = 50 THEN v END) * 1000)::BIGINT AS p50, round(max(CASE WHEN p = 95 THEN v END) * 1000)::BIGINT AS p95 FROM said GROUP BY d, total""")
def daily_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median and p95 of events' values by day (in thousandths), from hourly bucket counters that restart at midnight."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    hourly = events.groupBy("event_type", "ts").agg(*(F.count(F.when(F.col("value") <= e, 1)).alias(f"b{i}") for i, e in enumerate(ENDS)))
    each = hourly.select("event_type", "ts", F.explode(F.array(*(F.struct(F.lit(e).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(ENDS)))).alias("b")).select("event_type", "ts", "b.*")
    day = windows.Window.partitionBy("event_type", "le", F.to_date("ts")).orderBy("ts")
    points = each.select(F.col("event_type").alias("series"), "le", "ts", F.sum("n").over(day).alias("value"))
    found = windows.bucket_quantiles(points, [50, 95], "1 day")
    thousandths = lambda c: F.round(F.col(c) * 1000).cast("bigint").alias(c)
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "observed", thousandths("p50"), thousandths("p95"))


ALERT = alerts.Rule(1, "in_total", recovery=0, window_minutes=90, absent_minutes=180)


@query(f"""
WITH p AS (SELECT event_type AS series, epoch_us(ts) // 60000000 AS m, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT series, min(m) AS lo, max(m) AS hi FROM p GROUP BY series),
g AS (SELECT series, unnest(range(lo, hi + 1)) AS m FROM r), q AS (SELECT g.series, g.m, n, max(CASE WHEN n IS NOT NULL THEN g.m END) OVER (PARTITION BY g.series ORDER BY g.m) AS seen,
  sum(n) OVER (PARTITION BY g.series ORDER BY g.m ROWS BETWEEN {ALERT.window_minutes - 1} PRECEDING AND CURRENT ROW) AS total FROM g LEFT JOIN p ON p.series = g.series AND p.m = g.m),
t AS (SELECT series, m, CASE WHEN m - seen >= {ALERT.absent_minutes} THEN 'absent' WHEN total > {ALERT.threshold} THEN 'firing' WHEN total > {ALERT.recovery} THEN NULL ELSE 'ok' END AS told FROM q),
s AS (SELECT series, told, last_value(told IGNORE NULLS) OVER (PARTITION BY series ORDER BY m) AS last FROM t)
SELECT series, state, count(*)::BIGINT AS minutes FROM (SELECT series, CASE WHEN told IS NOT NULL THEN told WHEN last = 'firing' THEN 'recovering' ELSE 'ok' END AS state FROM s) GROUP BY ALL""")
def alert_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes that an alert on each type of events is firing, recovering, absent or ok."""
    return alerts.batch_states(table(spark, sf_dir, "events"), ALERT, "ts", "event_type").groupBy("series", "state").agg(F.count("*").alias("minutes"))


@query("SELECT event_type, user_id::VARCHAR AS who, min(epoch_us(ts))::BIGINT AS first_seen, max(epoch_us(ts))::BIGINT AS last_seen, arg_max(event_id, (epoch_us(ts), event_id))::BIGINT AS event_id FROM events GROUP BY event_type, user_id")
def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with each type of event: when first and last, and the last event."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("who"), at.alias("first_seen"), at.alias("last_seen"), F.col("event_id").cast("bigint").alias("event_id"))
    return sink.merged(events, ["event_type", "who"], "first_seen", "last_seen")


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as documents, and the same as read back with planted differences."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    name, meta = F.concat(F.lit("order-"), F.col("k").cast("string")), lambda v: F.struct(v.alias("version"), F.array(F.lit(1), F.lit(2)).alias("steps"))
    desired = orders.select(name.alias("name"), F.to_json(F.struct("status", "priority", meta(F.lit(1)).alias("meta"))).alias("document"))
    changed = F.struct(F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("status")).alias("status"), F.when(F.col("k") % 5 != 0, F.col("priority")).alias("priority"), meta(F.lit(2)).alias("meta"), F.when(F.col("k") % 11 == 0, F.lit(True)).alias("extra"))
    found = orders.where("k % 13 <> 0").select(name.alias("name"), F.when(F.col("k") % 17 == 0, "<html>").otherwise(F.to_json(changed)).alias("document"))
    return desired, found


@query("""WITH o AS (SELECT 'order-' || o_orderkey AS name, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders), r AS (SELECT * FROM o WHERE k % 13 <> 0 AND k % 17 <> 0)
SELECT name, NULL AS path, 'absent' AS kind, NULL AS wanted, NULL AS found FROM o WHERE k % 13 = 0 UNION ALL SELECT name, NULL, 'invalid', NULL, NULL FROM o WHERE k % 13 <> 0 AND k % 17 = 0
UNION ALL SELECT name, 'status', 'changed', '"' || s || '"', '"X"' FROM r WHERE k % 7 = 0 AND s <> 'X' UNION ALL SELECT name, 'priority', 'lacking', '"' || p || '"', NULL FROM r WHERE k % 5 = 0
UNION ALL SELECT name, 'extra', 'surplus', NULL, 'true' FROM r WHERE k % 11 = 0""")
def document_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between orders' documents and what is read back, versions set by the server aside."""
    return artifacts.drift(*_documents(spark, sf_dir), ["meta.version"])


DIMENSIONS = {"events": ["type", "user", "fifth"], "values": ["type"]}


def _measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    labels = F.create_map(*(x for k, v in (("type", F.col("event_type")), ("user", F.col("user_id").cast("string")), ("fifth", (F.col("user_id") % 5).cast("string"))) for x in (F.lit(k), v)))
    thousandths = F.floor(F.col("value") * 1000).cast("bigint")
    return events.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), labels.alias("labels"), v.alias("value")) for m, v in (("events", F.lit(1).cast("bigint")), ("values", thousandths), ("stray", thousandths))))).alias("x")).select("x.*")


@query("""SELECT 'events' AS metric, 'type=' || event_type || ',user=' || CASE WHEN (SELECT count(DISTINCT user_id) FROM events) > 30 THEN '__other__' ELSE user_id::VARCHAR END || ',fifth=' || (user_id % 5) AS labels, count(*)::BIGINT AS n, count(*)::BIGINT AS total FROM events GROUP BY ALL
UNION ALL SELECT 'values', 'type=' || event_type, count(*), sum(floor(value * 1000)::BIGINT)::BIGINT FROM events GROUP BY ALL""")
def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of events' metrics by their declared dimensions; users are too many."""
    found = instruments.series(_measurements(spark, sf_dir), DIMENSIONS, 30)
    return found.select("metric", F.array_join(F.transform("labels", lambda x: F.concat(x["dimension"], F.lit("="), x["value"])), ",").alias("labels"), "n", "total")


@query("SELECT 'values' AS metric, unnest(['user', 'fifth']) AS label, (SELECT count(*) FROM events)::BIGINT AS rows UNION ALL SELECT 'stray', NULL, count(*)::BIGINT FROM events")
def refused_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of events' metrics that are not declared."""
    return instruments.refused(_measurements(spark, sf_dir), DIMENSIONS)


@query(registry.SPANS + registry.JSON_NODES + registry.FEATURES + registry.TOP_ROUTES + """, fam AS (SELECT fingerprint, min(trace_id) AS trace_id FROM routes JOIN runs USING (trace_id) WHERE release = 'v1' AND fingerprint IN (SELECT fingerprint FROM top) GROUP BY 1),
mt AS (SELECT trace_id, sum(weight) AS t FROM f GROUP BY 1), sim AS (SELECT f.trace_id, g.trace_id AS other, sum(f.weight) AS shared FROM fam g JOIN f ff ON ff.trace_id = g.trace_id JOIN f ON f.feature = ff.feature GROUP BY ALL),
near AS (SELECT s.trace_id, bool_or(shared * 10 >= 8 * (a.t + b.t - shared)) AS close FROM sim s JOIN mt a ON a.trace_id = s.trace_id JOIN mt b ON b.trace_id = s.other GROUP BY 1)
SELECT trace_id, CASE WHEN fingerprint IN (SELECT fingerprint FROM top) THEN 'pass' ELSE 'violation' END AS outcome,
  CASE WHEN fingerprint IN (SELECT fingerprint FROM top) THEN NULL WHEN close THEN 'ROUTE_DRIFTED' ELSE 'ROUTE_NOT_APPROVED' END AS code FROM routes LEFT JOIN near USING (trace_id)""")
def drifted_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that take an approved route, one much like it, or another one."""
    g, placed, routes = registry.routed(spark, sf_dir)
    approved = registry.approved_of_v1(g, routes)
    own, families = registry.own_and_families(g, placed, routes)
    rule = {"id": "known-routes", "type": "approved_routes", "fingerprints": approved, "minSimilarity": 0.8, "severity": "high"}
    found = rules.evaluate_rules(g, g.nodes, [rule], routes, own, families.where(F.col("fingerprint").isin(*approved)))
    return found.select("trace_id", "outcome", "code")


@query(registry.SPANS + "SELECT release, 'few-purchases' AS rule_id, count(*)::BIGINT AS reporting, sum(n)::BIGINT AS value, CASE WHEN sum(n) > 900 OR sum(n) < 1 THEN 'violation' ELSE 'pass' END AS outcome FROM (SELECT release, trace_id, count(*) FILTER (WHERE label = 'purchase') AS n FROM spans GROUP BY ALL) GROUP BY release")
def release_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cardinality of release scope: purchases of all runs of a release."""
    g = registry.event_graph(spark, sf_dir)
    rule = {"id": "few-purchases", "type": "cardinality", "selector": {"name": "purchase"}, "min": 1, "max": 900, "scope": "release", "severity": "medium"}
    return release.release_budgets(rules.evaluate_rules(g, g.nodes, [rule]), g.traces, [rule]).select("release", "rule_id", "reporting", "value", "outcome")


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evaluated runs with day, start, tokens and retries, and their violations."""
    e = registry.evaluate(registry.event_spans(spark, sf_dir), registry.CONTRACT, unicode=False)
    starts = e.nodes.where("`order` = 0").select("trace_id", "start_ns", F.to_date(F.timestamp_micros(F.expr("start_ns div 1000"))).cast("string").alias("day"))
    runs = e.runs.join(starts, "trace_id").select("trace_id", "release", "day", "start_ns", "status", "duration_ms", F.col("output_tokens").alias("tokens"), "retries")
    return runs, e.violations


OF_RULES = ", ".join(f"('{r['id']}', '{r['type']}/{r['severity']}')" for r in registry.RULES)
DAYS = """, d AS (SELECT r.trace_id, r.release, status, violations, duration_ms, start_ns, make_timestamp(start_ns // 1000)::DATE::VARCHAR AS day, tokens, retried FROM st JOIN runs r USING (trace_id)
  JOIN (SELECT trace_id, min(start_ns) AS start_ns, sum(tokens) AS tokens, sum(CASE WHEN retry > 0 THEN retry ELSE 0 END) AS retried FROM spans GROUP BY 1) s USING (trace_id)) """


@query(registry.SPANS + registry.STATUS + DAYS + f""", dup AS (SELECT DISTINCT trace_id FROM res WHERE code IN ('CARDINALITY_ABOVE_MAX', 'REQUIRED_SPAN_TOO_MANY', 'RETRY_BUDGET_SIDE_EFFECT_EXCEEDED')),
every AS (SELECT 'decisions' AS panel, day, status AS key, 1 AS value FROM d UNION ALL SELECT 'tokens', day, release, tokens FROM d UNION ALL SELECT 'retries', day, release, retried FROM d UNION ALL SELECT 'violations', day, release, violations FROM d
  UNION ALL SELECT 'duplicates', day, release, 1 FROM d JOIN dup USING (trace_id) UNION ALL SELECT 'rules', day, kind, n FROM res JOIN d USING (trace_id) JOIN (VALUES {OF_RULES}) v(rule_id, kind) USING (rule_id) WHERE outcome = 'violation')
SELECT panel, day, key, sum(value)::BIGINT AS value FROM every GROUP BY ALL HAVING sum(value) <> 0 UNION ALL SELECT 'latency', day, release, quantile_disc(duration_ms, 0.95)::BIGINT FROM d GROUP BY ALL""")
def dashboard_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions, violations, duplicates, latency, tokens and retries by day."""
    return panels.series(*_evaluated(spark, sf_dir))


@query(registry.SPANS + registry.STATUS + DAYS + "SELECT release, row_number() OVER (PARTITION BY release ORDER BY start_ns DESC, trace_id) AS place, trace_id, start_ns, violations FROM d WHERE violations > 0 QUALIFY place <= 20")
def latest_violating_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest violating traces of every release."""
    return panels.latest_violating(*_evaluated(spark, sf_dir))

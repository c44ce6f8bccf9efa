"""Every query with SQL gives what DuckDB gives, on the smallest tables, where they are present."""

import glob
import os

import duckdb
import pytest

from routeledger.operators import features
from routeledger.plans import operations, registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["span_source", "trace_quality", "route_fingerprints", "rule_retry_budget", "gate_findings", "label_statistics", "nearest_family", "span_dedup", "error_alert", "faulty_quality", "faulty_buy_after_view", "release_changes", "evidence_within_an_hour", "reconciled_artifacts", "keys_and_cursors", "evidence_bundle", "matching_urls", "daily_histograms", "alert_minutes", "document_drift", "metric_series", "dashboard_panels", "route_families"])
def test_query(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    queries, oracles = registry.QUERIES | operations.QUERIES, registry.ORACLES | operations.ORACLES
    df = queries[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    want = sorted(tuple(map(str, r)) for r in db.execute(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({oracles[name]})").fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["faulty_clicks_retried", "faulty_clicks_each"])
def test_clicks_by_run_and_by_span(spark, name):
    test_query(spark, name)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_nearest_of_all_families(spark):
    from fractions import Fraction


    g, placed, routes = registry.routed(spark, DATA)
    sets, sides = {}, registry.own_and_families(g, placed, routes)
    for r in features.features(g, placed).collect():
        sets.setdefault(r["trace_id"], {})[r["feature"]] = r["weight"]
    v1 = {r["trace_id"] for r in g.traces.where("release = 'v1'").collect()}
    families = {}
    for r in routes.collect():
        if r["trace_id"] in v1:
            families[r["fingerprint"]] = min(families.get(r["fingerprint"], r["trace_id"]), r["trace_id"])
    kinds = {}
    for f, t in sorted(families.items()):
        kinds.setdefault(frozenset(sets[t].items()), f)

    def best(a):
        found = []
        for b, f in kinds.items():
            shared = sum(w for _, w in a & b)
            found.append((-Fraction(shared, sum(w for _, w in a | b)), f))
        return min(found)[1]

    known = {a: best(a) for a in {frozenset(s.items()) for s in sets.values()}}
    got = {r["trace_id"]: r["nearest"] for r in features.nearest(*sides).collect()}
    _, runs, groups = features.distinct_sets(*sides)
    assert features.candidates(runs, groups).count() < 0.35 * runs.count() * groups.count()  # of all pairs
    assert len(families) > 5 and got == {t: known[frozenset(s.items())] for t, s in sets.items()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_violations_have_ids_of_their_own(spark):
    e = registry.evaluate(registry.event_spans(spark, DATA), registry.CONTRACT, unicode=False)
    rows = e.violations.select("trace_id", "violation_id", "place", "orders", "labels", "span_ids").collect()
    assert len(rows) == len({(r["trace_id"], r["violation_id"]) for r in rows}) == len({(r["trace_id"], r["place"]) for r in rows}) > 100
    assert all(len(r["orders"]) == len(r["span_ids"] or []) for r in rows)


def test_streaming_closes_runs(spark, tmp_path):
    from routeledger.streaming.windows import closed_runs, evaluate_closed

    rows = [("t1", "2024-01-01 00:00:00"), ("t1", "2024-01-01 00:01:00"), ("t2", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "trace_id string, ts string").selectExpr("trace_id", "cast(ts as timestamp) ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("trace_id string, ts timestamp").parquet(str(tmp_path / "in"))
    evaluate_closed(closed_runs(stream), lambda df, _: seen.extend(df.collect()), str(tmp_path / "state")).awaitTermination(60)
    assert [(r["trace_id"], r["spans"]) for r in seen] == [("t1", 2)]

"""Drift of nested documents, read-backs, and instruments."""

import json

from pyspark.sql import functions as F

from routeledger.operators import artifacts, instruments


def docs(spark, items):
    return spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in items], "name string, document string")


def test_drift(spark):
    desired = docs(spark, [("a", {"x": 1, "deep": {"l": [1, {"y": "é"}], "e": {}}, "a.b": 2, "server": {"id": 1}}), ("b", {"x": 1}), ("c", {"x": 1}), ("d", {"x": [1, 2]}), ("e", {"x": 1}), ("f", {"x": None})])
    found = docs(spark, [("a", {"server": {"id": 9, "at": 1}, "deep": {"e": [], "l": [1, {"y": "z"}, 3]}, "x": 1.0, "a.b": 3}), ("c", "<!doctype html>"), ("d", {"x": [1, 2]}), ("e", None), ("f", {}), ("g", {"x": 1})])
    got = {tuple(r) for r in artifacts.drift(desired, found, ["server", "*.none"]).collect()}
    assert got == {
        ("a", "deep.l.1.y", "changed", '"é"', '"z"'), ("a", "deep.l.2", "surplus", None, "3"), ("a", "deep.e", "changed", "{}", "[]"), ("a", r"a\.b", "changed", "2", "3"),
        ("b", None, "absent", None, None), ("c", None, "invalid", None, None), ("e", None, "invalid", None, None), ("f", None, "invalid", None, None),
    } | ({("a", "x", "changed", "1", "1.0")} if artifacts.canonical_json(1.0) != "1" else set())
    hashes = {r["name"]: r["hash"] for r in artifacts.flattened(docs(spark, [("p", '{"a": 1, "b": [2]}'), ("q", '{"b":[2],"a":1}'), ("r", '{"b":[2],"a":2}'), ("s", "[]")])).collect()}
    assert hashes["p"] == hashes["q"] != hashes["r"] and hashes["s"] is None
    assert artifacts.drift(desired.limit(0), found).count() == 0


def test_read_backs(spark):
    fields = spark.createDataFrame([("a", "x.0.y", "1"), ("a", "x.length", "2"), ("a", "whole", '{"q": 1, "p": 2}'), ("b", "x", "1"), ("b", "constructor", "1"), ("c", "x", "1"), ("d", "x", "1")], "name string, field string, expected string")
    found = docs(spark, [("a", {"x": [{"y": 1}, 2], "whole": {"p": 2, "q": 1}}), ("b", {"x": "1"}), ("c", "<html>")])
    got = {r["name"]: (r["status"], r["mismatched"]) for r in artifacts.verified(fields, found).collect()}
    assert got == {"a": ("verified", []), "b": ("mismatched", ["constructor", "x"]), "c": ("invalid_response", []), "d": ("absent", [])}


def test_instruments(spark):
    rows = [("m", {"a": str(i % 3), "b": str(i), "c": "x"}, i) for i in range(50)] + [("m", {"a": "0"}, None), ("m", {}, 5), ("other", {"a": "1"}, 1), (None, {"a": "1"}, 1)]
    df = spark.createDataFrame(rows, "metric string, labels map<string,string>, value long")
    found = instruments.series(df, {"m": ["a", "b"], "unused": []}, 10)
    got = {tuple(x["value"] for x in r["labels"]): (r["n"], r["total"]) for r in found.collect()}
    assert got == {(str(k), instruments.OTHER): (len(v), sum(v)) for k, v in ((k, [i for i in range(50) if i % 3 == k]) for k in (1, 2))} | {("0", instruments.OTHER): (18, sum(i for i in range(50) if i % 3 == 0)), ("", instruments.OTHER): (1, 5)}
    assert {tuple(r) for r in instruments.refused(df, {"m": ["a", "b"]}).collect()} == {("m", "c", 50), ("other", None, 1)}
    assert found.agg(F.sum("total")).first()[0] == sum(range(50)) + 5

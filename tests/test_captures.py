"""Captures with open, mixed and nested attributes, and odd rows."""

import json

from routeledger.sources import captures


def span(i, **more):
    return {"data": {"trace_id": "t", "span_id": f"s{i}", "name": "step", "agent.retry.number": i, **more}, "timestamp": f"2024-01-01T00:00:0{i}.500Z"}


ROWS = [
    span(0, **{"x": 1, "list": ["b", 2, True, None], "deep": {"z": [1, {"y": 2}], "a": "é"}, "none": None}),
    span(1, **{"x": "1", "agent.retry.number": "1", "has_error": "true", "gen_ai.usage.input_tokens": 10}),
    span(2, **{"x": 1.5, "agent.retry.number": 1.5, "has_error": True}),
    span(3, **{"x": True, "big": 12345678901234567890123, "e": 1e30, "agent.idempotency.present": False}),
    {"data": [1]}, {"other": 1}, span(4, span_id=""), span(5, span_id=None), 7,
]


def test_documents_and_lines_read_alike(spark, tmp_path):
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc/a.json").write_text(json.dumps({"rows": ROWS}, indent=1))
    (tmp_path / "doc/b.json").write_text("{not json")
    (tmp_path / "doc/c.json").write_text('{"rows": 5}')
    (tmp_path / "doc/d.json").write_text('{"rows": []}')
    (tmp_path / "lines.json").write_text("\n".join([*map(json.dumps, ROWS), "", "{cut off"]))
    docs, lines = captures.read_rows(spark, str(tmp_path / "doc")), captures.read_rows(spark, str(tmp_path / "lines.json"), lines=True)
    for rows, odd in ((docs, {"invalid_json": 1, "no_rows": 1}), (lines, {"invalid_json": 1})):
        got = {r["span_id"]: r for r in captures.spans_of(rows).collect()}
        assert sorted(got) == ["s0", "s1", "s2", "s3"]
        assert [got[f"s{i}"]["retry_number"] for i in range(4)] == [0, None, None, 3]
        assert [got[f"s{i}"]["has_error"] for i in range(4)] == [None, None, True, None] and got["s3"]["idempotent"] is False and got["s1"]["input_tokens"] == 10
        assert got["s0"]["start_ns"] == 1704067200500000000
        assert [got[f"s{i}"]["extra"]["x"] for i in range(4)] == ["number:1", "string:1", "number:1.5", "boolean:true"]
        assert got["s0"]["extra"] == {"x": "number:1", "list": 'array:["boolean:true","null:","number:2","string:b"]', "deep": 'object:{"a":"é","z":[1,{"y":2}]}'}
        assert got["s1"]["extra"] == {"x": "string:1", "agent.retry.number": "string:1", "has_error": "string:true"} and got["s2"]["extra"]["agent.retry.number"] == "number:1.5"
        assert got["s3"]["extra"]["big"] == "number:12345678901234567890123"
        counts = {}
        for r in captures.refused(rows).collect():
            counts[r["reason"]] = counts.get(r["reason"], 0) + 1
        assert counts == {"data_is_no_object": 3, "missing_span_id": 2, **odd}
    kinds = {(r["key"], r["kind"]): (r["rows"], r["state"]) for r in captures.field_kinds(docs).collect()}
    assert kinds["x", "number"] == (2, "mixed") and kinds["name", "string"] == (6, "verified") and kinds["deep", "object"] == (1, "open") and kinds["agent.idempotency.present", "boolean"][1] == "verified"

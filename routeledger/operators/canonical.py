"""Canonical order, route fingerprints and ancestors, from the places that `graph.build` gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeledger.functions.names import DEFAULT, Config
from routeledger.operators.graph import Graph, entries_json, json_text, per_trace


def ordered(graph: Graph) -> DataFrame:
    """Nodes reached from their root, with depth, `digest` of their subtree and `order`."""
    return graph.nodes.where("`order` IS NOT NULL")


def fingerprints(nodes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """trace_id and `fingerprint`: SHA-256 of the canonical graph as JSON. A trace has a bounded number of spans."""
    fields = [("order", "order"), ("depth", "depth"), ("label", "label"), ("service", "service"), ("kind", "kind"), ("sideEffect", "side_effect"), ("tool", "tool"), ("dataDomain", "data_domain"), ("retryNumber", "retry_number")]
    node = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), json_text(F.col(c))) for k, c in fields), F.concat(F.lit('"attributes":'), entries_json("{", "}", ":"))), F.lit("}"))
    mine = F.struct("order", F.col("span_id").alias("id"), "up", node.alias("text"))
    packed = nodes.groupBy("trace_id").agg(F.array_sort(F.collect_list(mine)).alias("n"))
    place = F.map_from_arrays(F.col("n")["id"], F.col("n")["order"])
    packed = packed.withColumn("place", place)
    ends = F.transform(F.filter("n", lambda x: x["up"].isNotNull()), lambda x: F.struct(F.element_at("place", x["up"]).alias("from"), x["order"].alias("to")))
    ends = F.array_sort(F.filter(ends, lambda e: e["from"].isNotNull()))
    edges = F.transform(ends, lambda e: F.concat(F.lit('{"from":'), e["from"].cast("string"), F.lit(',"to":'), e["to"].cast("string"), F.lit(',"type":"parent"}')))
    head = f'{{"normaliserVersion":"{config.version}","normaliserConfigHash":"{config.hash()}","nodes":['
    whole = F.concat(F.lit(head), F.array_join(F.col("n")["text"], ","), F.lit('],"edges":['), F.array_join(edges, ","), F.lit("]}"))
    return packed.select("trace_id", F.sha2(whole, 256).alias("fingerprint"))


def ancestors(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """trace_id, span_id, ancestor and dist for the targets (trace_id, span_id) only: themselves at 0, then up to the top.
    A span that comes round a cycle ends there. Nodes have span_id and up; their traces are bounded."""
    wanted = targets.select("trace_id", "span_id", F.lit(True).alias("wanted"))
    marked = nodes.select("trace_id", "span_id", "up").join(wanted, ["trace_id", "span_id"], "left").withColumn("pre", F.lit(0))

    def walk(ids: list, ups: list, marks: list):
        up = dict(zip(ids, ups, strict=True))
        for start, mark in zip(ids, marks, strict=True):
            at, dist, seen = start, 0, set()
            while mark and at in up and at not in seen:
                yield start, at, dist
                seen.add(at)
                at, dist = up[at], dist + 1

    return per_trace(marked, {"span_id": F.col("span_id"), "up": F.col("up"), "wanted": F.col("wanted")}, walk, "struct<span_id: string, ancestor: string, dist: int>")


def nearest_above(nodes: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """Nodes with a column for each mark: how far above them the nearest node with that mark is, or null. Nodes are those of a graph."""
    names = list(marks)

    def walk(ids: list, ups: list, *marked: list):
        far: dict[str, tuple] = {}
        has = {i: k for k, i in enumerate(ids)}
        for i, up in zip(ids, ups, strict=True):  # parents come before their children
            above = far.get(up, (None,) * len(names))
            far[i] = tuple(None if up is None else 1 if m[has[up]] else None if d is None else d + 1 for m, d in zip(marked, above, strict=True))
            yield (i, *far[i])

    found = per_trace(nodes, {"span_id": F.col("span_id"), "up": F.col("up")} | {f"m{k}": marks[n] for k, n in enumerate(names)}, walk, f"struct<span_id: string, {', '.join(f'd{k}: int' for k in range(len(names)))}>")
    return nodes.join(found.toDF("trace_id", "span_id", *names), ["trace_id", "span_id"])

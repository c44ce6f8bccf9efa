"""What changed between routes: labels, edges, tools, services, domains, side effects, retries and attribute facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Severities of the kinds of changes.
SEVERITY = {
    "node_added": "structural", "node_removed": "structural", "edge_added": "structural", "edge_removed": "structural", "cardinality_changed": "behavioural",
    "tool_added": "behavioural", "service_added": "behavioural", "data_domain_added": "behavioural", "retry_increased": "behavioural",
    "side_effect_duplicated": "structural", "attribute_changed": "informational", "route_unknown": "structural",
}


def changes(before: DataFrame, after: DataFrame, before_edges: DataFrame, after_edges: DataFrame, approved: list[str] | None = None, fingerprint: str | None = None) -> DataFrame:
    """kind, subject, before and after of every change from one route's nodes and edges to another's.

    Nodes have label, service, tool, data_domain, side_effect, retry_number and entries; edges have a and b (labels) and type.
    """
    counts = lambda df, n: df.groupBy("label").agg(F.count("*").alias(n))
    labels = counts(before, "x").join(counts(after, "y"), "label", "full_outer").select("label", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    kind = F.when(F.col("x") == 0, "node_added").when(F.col("y") == 0, "node_removed").otherwise("cardinality_changed")
    out = labels.where("x <> y").select(kind.alias("kind"), F.col("label").alias("subject"), F.col("x").cast("bigint").alias("before"), F.col("y").cast("bigint").alias("after"))
    row = lambda df, k, subject, x=None, y=None: df.select(F.lit(k).alias("kind"), subject.alias("subject"), (F.lit(None) if x is None else x).cast("bigint").alias("before"), (F.lit(None) if y is None else y).cast("bigint").alias("after"))
    edge = lambda df: df.select(F.concat("a", F.lit("->"), "b", F.lit("|"), "type").alias("e")).distinct()
    out = out.union(row(edge(after_edges).subtract(edge(before_edges)), "edge_added", F.col("e"))).union(row(edge(before_edges).subtract(edge(after_edges)), "edge_removed", F.col("e")))
    for column, name in (("tool", "tool_added"), ("service", "service_added"), ("data_domain", "data_domain_added")):
        new = after.where(F.col(column).isNotNull()).select(column).distinct().join(before.select(column).distinct(), column, "left_anti")
        out = out.union(row(new, name, F.col(column)))
    effects = lambda df, n: df.where("side_effect IN ('write', 'external')").groupBy("label", "side_effect").agg(F.count("*").alias(n))
    more = effects(after, "y").join(effects(before, "x"), ["label", "side_effect"], "left").where("y > coalesce(x, 0)")
    out = out.union(row(more, "side_effect_duplicated", F.concat_ws("|", "label", "side_effect"), F.coalesce("x", F.lit(0)), F.col("y")))
    retries = lambda df, n: df.groupBy("label").agg(F.max("retry_number").alias(n))
    rose = retries(after, "y").join(retries(before, "x"), "label", "left").where("y > coalesce(x, 0)")
    out = out.union(row(rose, "retry_increased", F.col("label"), F.coalesce("x", F.lit(0)), F.col("y")))
    facts = lambda df: df.select("label", F.explode("entries").alias("f")).select("label", F.concat_ws("=", "f.k", "f.v").alias("fact")).distinct()
    added = facts(after).join(facts(before), ["label", "fact"], "left_anti").join(before.select("label").distinct(), "label", "left_semi")
    out = out.union(row(added.select("label").distinct(), "attribute_changed", F.col("label")))
    if approved is not None and fingerprint not in approved:
        out = out.union(before.sparkSession.range(1).select(F.lit("route_unknown"), F.lit(fingerprint), F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))
    severities = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return out.withColumn("severity", F.element_at(severities, F.col("kind")))


def labeled_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """trace_id, a, b and type: edges by their ends' labels."""
    at = nodes.select("trace_id", "span_id", "label")
    return edges.join(at.toDF("trace_id", "from", "a"), ["trace_id", "from"]).join(at.toDF("trace_id", "to", "b"), ["trace_id", "to"]).select("trace_id", "a", "b", "type")


def representative(runs: DataFrame) -> DataFrame:
    """The run of each release that stands for it in a comparison: a failing one before others, then by trace id."""
    order = Window.partitionBy("release").orderBy((F.col("status") == "fail").desc(), "trace_id")
    return runs.withColumn("place", F.row_number().over(order)).where("place = 1").select("release", "trace_id", "status")

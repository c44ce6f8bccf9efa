"""Run evaluations: rule results joined to a status for every run, violations with stable ids, and counts."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeledger.operators import features
from routeledger.operators.canonical import fingerprints, ordered
from routeledger.operators.graph import Graph, build, cut
from routeledger.operators.rules import evaluate_rules

#: Severities, the gravest first, and outcomes by rank.
SEVERITIES = ["critical", "high", "medium", "low"]
#: Kinds of rules in the order in which results are listed.
RULE_TYPES = ["required_span", "cardinality", "forbidden_span", "required_edge", "required_ancestry", "forbidden_path", "allowed_values", "attribute_constraint", "retry_budget", "numeric_budget", "approved_routes"]


class Evaluation(NamedTuple):
    graph: Graph
    nodes: DataFrame
    routes: DataFrame
    results: DataFrame
    violations: DataFrame
    runs: DataFrame


def critical_labels(contract: dict) -> list[str]:
    """Labels that critical rules name."""
    found = set()
    for rule in contract["spec"]["rules"]:
        if rule["severity"] == "critical":
            found |= {rule[k]["name"] for k in ("selector", "from", "to", "ancestor", "descendant") if "name" in rule.get(k, {})}
    return sorted(found)


def quoted(text) -> Column:
    """A text as JSON."""
    said = F.to_json(F.array(text))
    return F.substring(said, 2, F.length(said) - 2)


def violations_of(results: DataFrame) -> DataFrame:
    """Violations with `violation_id` and `place`, their order in a run.

    The id hashes rule, code, canonical orders and labels of the evidence, and what tells violations of one rule apart. It does not
    depend on span ids or values, so that the same finding has one id in all runs of a route. The gravest come first, then by kind of rule, rule and id.
    """
    said = F.concat(F.lit("["), quoted(F.col("rule_id")), F.lit(","), quoted(F.col("code")), F.lit(","), F.to_json("orders"), F.lit(","), F.to_json("labels"), F.lit(","), F.coalesce(F.when(F.col("detail").isNotNull(), quoted(F.col("detail"))), F.lit("null")), F.lit("]"))
    ident = F.concat_ws(":", "rule_id", "code", F.substring(F.sha2(said, 256), 1, 16))
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    kind = F.array_position(F.array(*map(F.lit, RULE_TYPES)), F.col("rule_type"))
    order = Window.partitionBy("trace_id").orderBy("severity_rank", kind, "rule_id", "violation_id")
    found = results.where("outcome = 'violation'").select("trace_id", ident.alias("violation_id"), "rule_id", "rule_type", "severity", rank.alias("severity_rank"), "rule_order", "code", "detail", "value", "span_ids", "orders", "labels")
    return found.withColumn("place", F.row_number().over(order))


def evaluation_hashes(results: DataFrame) -> DataFrame:
    """trace_id and `hash`: SHA-256 of a run's outcomes by rule, without span ids, so that equal runs have one hash."""
    counted = results.groupBy("trace_id", "rule_id", "outcome", "code").agg(F.count("*").alias("n"))
    said = F.concat_ws("|", "rule_id", "outcome", F.coalesce("code", F.lit("")), F.col("n").cast("string"))
    return counted.groupBy("trace_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(said)), ";"), 256).alias("hash"))


def run_status(traces: DataFrame, results: DataFrame, zero_tolerance: list[str] = ()) -> DataFrame:
    """One row for each run with its status: fail, insufficient_data, pass, or error for runs without a tree; and counts of its results."""
    n = lambda c: F.count(F.when(c, 1))
    is_ = lambda o: F.col("outcome") == o
    counts = results.groupBy("trace_id").agg(
        F.countDistinct("rule_id").alias("rules"), n(is_("violation")).alias("violations"), n(is_("violation") & (F.col("severity") == "critical")).alias("critical_violations"),
        n(is_("violation") & F.col("rule_id").isin(*zero_tolerance)).alias("zero_tolerance_violations"), n(is_("insufficient_evidence")).alias("insufficient"), n(is_("deferred")).alias("deferred"), n(is_("pass")).alias("passed"),
    )
    status = (
        F.when(F.col("quality").isin("empty", "too_large"), "error").when(F.col("quality") == "inconsistent", "insufficient_data")
        .when(F.col("violations") > 0, "fail").when(F.col("insufficient") > 0, "insufficient_data").otherwise("pass")
    )
    return traces.join(counts, "trace_id", "left").fillna(0, ["rules", "violations", "critical_violations", "zero_tolerance_violations", "insufficient", "deferred", "passed"]).select(
        "trace_id", "release", "environment", "quality", "spans", status.alias("status"), "rules", "violations", "critical_violations", "zero_tolerance_violations", "insufficient", "deferred", "passed"
    )


def evaluate(spans: DataFrame, contract: dict, families: DataFrame | None = None, unicode: bool = True) -> Evaluation:
    """Evaluate all runs in `spans` against a contract. families: features of the approved routes (fingerprint, feature, weight)."""
    spec = contract["spec"]
    rules = spec["rules"]
    graph = build(spans, (spec.get("selectors") or {}).get("rootSpan"), unicode=unicode)
    nodes = graph.nodes
    placed = ordered(graph)
    routes = fingerprints(placed)
    own = features.features(graph, placed, critical_labels(contract)) if families is not None else None
    results = cut(evaluate_rules(graph, nodes, rules, routes, own, families))
    positive = F.sum(F.when(F.col("retry_number") > 0, F.col("retry_number")).otherwise(0))
    totals = nodes.groupBy("trace_id").agg(
        positive.alias("retries"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.max(F.when(F.col("order") == 0, F.expr("duration_ns div 1000000"))).alias("duration_ms"),
    )
    runs = run_status(graph.traces, results, (spec.get("gate") or {}).get("zeroToleranceRuleIds") or []).join(routes, "trace_id", "left").join(totals, "trace_id", "left").withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0)))
    return Evaluation(graph, nodes, routes, results, violations_of(results), cut(runs))

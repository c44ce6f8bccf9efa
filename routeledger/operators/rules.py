"""The eleven rules of a contract over all runs: each gives rows of outcome pass, violation, insufficient_evidence or deferred.

Rules that count or look at a run's own spans are aggregated together, in one pass over the nodes; rules about ancestry share one
walk down every tree, which notes how far above each span the nearest one of interest is; every rule starts from the runs, so
that runs without a match have rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeledger.functions.exact import at_least
from routeledger.operators import canonical, features
from routeledger.operators.graph import Graph, cut
from routeledger.operators.selectors import SIDE_EFFECTING, condition, field, operand_of, selector

#: `detail` tells apart the violations of one rule in a run; span_ids, orders and labels are the evidence.
RESULT = "struct<outcome: string, code: string, detail: string, value: bigint, span_ids: array<string>, orders: array<bigint>, labels: array<string>>"
PLACES = "array<struct<order: bigint, span_id: string, label: string>>"
NO_PLACE = 1 << 60


def result(outcome: str | Column, code: str | Column | None = None, value: Column | None = None, found: Column | None = None, detail: Column | None = None, absent: list[str] = ()) -> Column:
    """A rule's result. found: the spans that are its evidence, as `place` gives them; absent: labels that were expected."""
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    spans = None if found is None else F.array_sort(found)
    orders = F.array() if spans is None else F.transform(F.filter(spans, lambda x: x["order"] < NO_PLACE), lambda x: x["order"])
    labels = F.array(*map(F.lit, sorted(set(absent)))) if spans is None else F.array_sort(F.array_distinct(F.transform(F.filter(spans, lambda x: x["label"].isNotNull()), lambda x: x["label"])))
    return F.struct(
        text(outcome).alias("outcome"), text(code).alias("code"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"), (F.lit(None) if value is None else value).cast("bigint").alias("value"),
        (F.lit(None) if spans is None else F.transform(spans, lambda x: x["span_id"])).cast("array<string>").alias("span_ids"), orders.cast("array<bigint>").alias("orders"), labels.cast("array<string>").alias("labels"),
    )


def one(choice: Column) -> Column:
    return F.array(choice)


def place() -> Column:
    """A span in canonical order, those without one last."""
    return F.struct(F.coalesce("order", F.lit(NO_PLACE)).alias("order"), F.col("span_id"), F.col("label"))


def placed(x: Column) -> Column:
    """What tells a span apart: its canonical order, or its id where it has none."""
    return F.when(x["order"] < NO_PLACE, x["order"].cast("string")).otherwise(x["span_id"])


COMPLETE = "quality = 'complete'"


def window_of(rule: dict) -> tuple[int, int | None]:
    own = rule.get("cardinality") if rule["type"] == "required_span" else rule
    own = own or {}
    return own.get("min", 1 if rule["type"] == "required_span" else 0), own.get("max")


def counted(rule: dict, found: Column) -> Column:
    """required_span and cardinality: too many can be told of any run, too few of complete ones only."""
    low, high = window_of(rule)
    n, spans = F.size(found), found
    absent = [rule["selector"]["name"]] if "name" in rule["selector"] else []
    if rule["type"] == "cardinality" and rule["scope"] == "release":
        return one(result("deferred", None, n, spans))
    over = F.lit(False) if high is None else n > high
    above = "REQUIRED_SPAN_TOO_MANY" if rule["type"] == "required_span" else "CARDINALITY_ABOVE_MAX"
    below = "REQUIRED_SPAN_MISSING" if rule["type"] == "required_span" else "CARDINALITY_BELOW_MIN"
    return one(
        F.when(over, result("violation", above, n, spans))
        .when((n < low) & ~F.expr(COMPLETE), result("insufficient_evidence", "trace_incomplete", n, spans))
        .when((n < low) & (n == 0), result("violation", below, n, absent=absent))
        .when(n < low, result("violation", below, n, spans))
        .otherwise(result("pass", None, n, spans))
    )


def forbidden(found: Column) -> Column:
    return one(
        F.when(F.size(found) > 0, result("violation", "FORBIDDEN_SPAN_PRESENT", F.size(found), found))
        .when(~F.expr(COMPLETE), result("insufficient_evidence", "trace_incomplete"))
        .otherwise(result("pass"))
    )


def plain_value(rule_field: str) -> Column:
    return {"service.name": F.concat(F.lit("string:"), "service")}.get(rule_field, field(rule_field))


def single_pass(traces: DataFrame, nodes: DataFrame, rules: list[dict]) -> DataFrame | None:
    """trace_id, rule and its results for the rules that one aggregation by run decides."""
    aggs, parts = [], []
    for i, rule in enumerate(rules):
        kind, c = rule["type"], f"r{i}"
        if kind in ("required_span", "cardinality", "forbidden_span"):
            aggs.append(F.collect_list(F.when(selector(rule["selector"]), place())).alias(c))
            found = F.coalesce(c, F.array().cast(PLACES))
            parts.append((rule, forbidden(found) if kind == "forbidden_span" else counted(rule, found)))
        elif kind == "allowed_values":
            value = plain_value(rule["field"])
            value = F.when(selector(rule["selector"]), value) if rule.get("selector") else value
            bad = value.isNotNull() & ~condition(value, "in", rule["values"])
            aggs += [F.count(value).alias(c), F.collect_list(F.when(bad, F.struct(value.alias("value"), place().alias("span")))).alias(f"{c}_bad")]
            values = F.array_sort(F.array_distinct(F.transform(f"{c}_bad", lambda x: x["value"])))
            all_bad = F.col(f"{c}_bad")
            wrong = F.transform(values, lambda v: result("violation", "DISALLOWED_VALUE", None, F.transform(F.filter(all_bad, lambda x: x["value"] == v), lambda x: x["span"]), v))  # noqa: B023
            none = F.coalesce(c, F.lit(0)) == 0
            parts.append((rule, F.when(none, one(result("insufficient_evidence", "attribute_not_emitted"))).when(F.size(f"{c}_bad") > 0, wrong).otherwise(one(result("pass")))))
        elif kind == "attribute_constraint":
            mine, value, op = selector(rule["selector"]), field(rule["field"]), rule["operator"]
            holds = condition(value, op, operand_of(rule))
            unsure = value.isNull() if op in ("equals", "in", "matches") else F.lit(False)
            aggs += [F.collect_list(F.when(mine & ~holds & ~unsure, place())).alias(c), F.count(F.when(mine & unsure, 1)).alias(f"{c}_unsure")]
            found = F.coalesce(c, F.array().cast(PLACES))
            wrong = F.transform(F.array_sort(found), lambda x: result("violation", "ATTRIBUTE_CONSTRAINT_FAILED", None, F.array(x), placed(x)))
            parts.append((rule, F.when(F.size(found) > 0, wrong).when(F.col(f"{c}_unsure") > 0, one(result("insufficient_evidence", "attribute_not_emitted"))).otherwise(one(result("pass")))))
        elif kind == "numeric_budget":
            amount = {"run.duration_ms": F.when((F.col("span_id") == F.col("run_root")), F.expr("duration_ns div 1000000"))}.get(
                rule["metric"], F.col("input_tokens") if rule["metric"].endswith("input_tokens") else F.col("output_tokens")
            )
            aggs += [(F.sum if rule["aggregation"] == "sum" or rule["metric"] != "run.duration_ms" else F.max)(amount).cast("bigint").alias(c), F.collect_list(F.when(amount.isNotNull(), place())).alias(f"{c}_of")]
            if rule["scope"] == "release":
                parts.append((rule, one(result("deferred", None, F.col(c)))))
            else:
                parts.append((rule, one(
                    F.when(F.col(c).isNull(), result("insufficient_evidence", "metric_not_emitted"))
                    .when(F.col(c) > rule["max"], result("violation", "NUMERIC_BUDGET_EXCEEDED", F.col(c), F.col(f"{c}_of"))).otherwise(result("pass", None, F.col(c)))
                )))
    if not parts:
        return None
    found = nodes.join(traces.select("trace_id", F.col("root").alias("run_root")), "trace_id").groupBy("trace_id").agg(*aggs)
    met = traces.select("trace_id", "quality").join(found, "trace_id", "left")
    each = F.array(*(F.struct(F.lit(r["id"]).alias("rule_id"), x.cast(f"array<{RESULT}>").alias("results")) for r, x in parts))
    return met.select("trace_id", F.explode(each).alias("x")).select("trace_id", "x.rule_id", F.explode("x.results").alias("r")).select("trace_id", "rule_id", "r.*")


def per_run(traces: DataFrame, found: DataFrame, rule: dict, choice: Column) -> DataFrame:
    """A row of results for each run, of what `found` has for it."""
    met = traces.select("trace_id", "quality").join(found, "trace_id", "left")
    return met.select("trace_id", F.lit(rule["id"]).alias("rule_id"), choice.cast(RESULT).alias("r")).select("trace_id", "rule_id", "r.*")


def per_offender(traces: DataFrame, spans: DataFrame, rule: dict, code: str, doubtful: Column, otherwise: Column, more: Column | None = None) -> DataFrame:
    """One violation for each span that `spans` marks `bad`; runs without one are insufficient if `doubtful`, else `otherwise`.

    more: the spans that are evidence of a bad one besides it.
    """
    own = F.struct(place().alias("span"), (F.array().cast(PLACES) if more is None else more).alias("more"))
    found = spans.groupBy("trace_id").agg(F.collect_list(F.when(F.col("state") == "bad", own)).alias("bad"), F.count(F.when(F.col("state") == "unsure", 1)).alias("unsure"))
    met = traces.select("trace_id", "quality").join(found, "trace_id", "left")
    bad = F.transform(F.array_sort("bad"), lambda x: result("violation", code, None, F.array_union(F.array(x["span"]), x["more"]), placed(x["span"])))
    results = F.when(F.size("bad") > 0, bad.cast(f"array<{RESULT}>")).when(doubtful, one(result("insufficient_evidence", otherwise)).cast(f"array<{RESULT}>")).otherwise(one(result("pass")).cast(f"array<{RESULT}>"))
    return met.select("trace_id", F.lit(rule["id"]).alias("rule_id"), F.explode(results).alias("r")).select("trace_id", "rule_id", "r.*")


def required_edge(traces: DataFrame, nodes: DataFrame, rule: dict) -> DataFrame:
    """Each `from` span has a `to` span as a child, or anywhere below it: nodes below one are those from pre + 1 to last."""
    if rule["relationship"] == "direct":
        above = nodes.where(selector(rule["to"]) & F.col("up").isNotNull()).select("trace_id", F.col("up").alias("span_id")).distinct()
        left = nodes.where(selector(rule["from"])).join(above, ["trace_id", "span_id"], "left_anti")
    else:
        later = Window.partitionBy("trace_id").orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
        following = nodes.withColumn("_next", F.min(F.when(selector(rule["to"]), F.col("pre"))).over(later))
        left = following.where(selector(rule["from"]) & F.coalesce(F.col("_next") > F.col("last"), F.lit(True)))
    left = left.withColumn("state", F.when(F.col("unserved"), "unsure").otherwise("bad"))
    return per_offender(traces, left, rule, "REQUIRED_EDGE_MISSING", F.col("unsure") > 0, F.lit("unobservable_subtree"))


def ancestry_marks(rules: list[dict]) -> dict[str, Column]:
    """What the rules about ancestry look for above a span, by the rule's id."""
    marks = {}
    for rule in rules:
        if rule["type"] == "required_ancestry":
            marks[f"ancestor {rule['id']}"] = selector(rule["ancestor"])
        elif rule["type"] == "forbidden_path":
            unless = (rule.get("unless") or {}).get("contains")
            marks[f"from {rule['id']}"] = selector(rule["from"])
            marks[f"unless {rule['id']}"] = selector(unless) if unless else F.lit(False)
    return marks


def required_ancestry(traces: DataFrame, nodes: DataFrame, rule: dict) -> DataFrame:
    """Each `descendant` has an `ancestor` as its parent, or anywhere above it; nodes have the distances of ancestry_marks."""
    far = F.col(f"`ancestor {rule['id']}`")
    has = far == 1 if rule["relationship"] == "direct" else far.isNotNull()
    above = Window.partitionBy("trace_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    # The top of a span's tree is the last top before it in the walk.
    topped = nodes.withColumn("_lost", F.last(F.when(F.col("up").isNull(), F.col("orphan")), ignorenulls=True).over(above))
    missing = topped.where(selector(rule["descendant"]) & ~F.coalesce(has, F.lit(False))).withColumn("state", F.when(F.col("_lost"), "unsure").otherwise("bad"))
    return per_offender(traces, missing, rule, "REQUIRED_ANCESTRY_MISSING", F.col("unsure") > 0, F.lit("trace_incomplete"))


def forbidden_path(traces: DataFrame, nodes: DataFrame, rule: dict) -> DataFrame:
    """No `to` span below a `from` span, unless a span from the nearest such one down to it is exempt; nodes have the distances of
    ancestry_marks."""
    nearest, exempt = F.col(f"`from {rule['id']}`"), F.col(f"`unless {rule['id']}`")
    unless = (rule.get("unless") or {}).get("contains")
    own = selector(unless) if unless else F.lit(False)
    bad = nodes.where(selector(rule["to"]) & nearest.isNotNull() & ~own & F.coalesce(exempt > nearest, F.lit(True))).withColumn("state", F.lit("bad"))
    # The path from the nearest `from` span down to it is the evidence.
    above = canonical.ancestors(nodes, bad.select("trace_id", "span_id"))
    steps = above.join(nodes.select("trace_id", F.col("span_id").alias("ancestor"), place().alias("step")), ["trace_id", "ancestor"])
    path = steps.groupBy("trace_id", "span_id").agg(F.collect_list(F.struct("dist", "step")).alias("steps"))
    bad = bad.join(path, ["trace_id", "span_id"], "left").withColumn("path", F.transform(F.filter(F.coalesce("steps", F.array().cast(f"array<struct<dist: int, step: {PLACES[6:-1]}>>")), lambda x: x["dist"] <= nearest), lambda x: x["step"]))
    return per_offender(traces, bad, rule, "FORBIDDEN_PATH_PRESENT", F.col("quality") != "complete", F.lit("trace_incomplete"), F.col("path"))


def retry_budget(traces: DataFrame, nodes: DataFrame, rule: dict) -> DataFrame:
    """A violation for each tool (or label) whose greatest retry number is too high, for the sum of these over the run, and for each
    tool with side effects, in this order; without any retry number there is no evidence."""
    mine = nodes.where(selector(rule["selector"]) & F.col("retry_number").isNotNull())
    retry, effects = F.col("retry_number"), F.col("side_effect").isin(*SIDE_EFFECTING)
    unknown = (F.col("side_effect") == "unknown") & (retry > rule["sideEffectMax"])
    spans = lambda when: F.collect_list(F.when(when, place()))
    groups = mine.groupBy("trace_id", F.coalesce("tool", "label").alias("tool")).agg(
        F.max(retry).alias("most"), F.max(F.when(effects, retry)).alias("effect"), spans(F.lit(True)).alias("all"), spans(effects).alias("mutating"), spans(unknown).alias("unknown"),
    )
    found = groups.groupBy("trace_id").agg(
        F.array_sort(F.collect_list(F.struct("tool", "most", "effect", "all", "mutating"))).alias("groups"), F.sum("most").alias("total"), F.flatten(F.collect_list("unknown")).alias("unknown")
    )
    over = lambda value, most: F.filter("groups", lambda g: g[value] > most)
    tools = F.transform(over("most", rule["maxPerTool"]), lambda g: result("violation", "RETRY_BUDGET_PER_TOOL_EXCEEDED", g["most"], g["all"], g["tool"]))
    total = F.when(F.col("total") > rule["maxRunTotal"], one(result("violation", "RETRY_BUDGET_RUN_TOTAL_EXCEEDED", F.col("total"), F.flatten(F.transform("groups", lambda g: g["all"]))))).otherwise(F.array().cast(f"array<{RESULT}>"))
    mutating = F.transform(over("effect", rule["sideEffectMax"]), lambda g: result("violation", "RETRY_BUDGET_SIDE_EFFECT_EXCEEDED", g["effect"], g["mutating"], F.concat(F.lit("side-effect:"), g["tool"])))
    every = F.concat(tools.cast(f"array<{RESULT}>"), total.cast(f"array<{RESULT}>"), mutating.cast(f"array<{RESULT}>"))
    results = (
        F.when(F.col("groups").isNull(), one(result("insufficient_evidence", "attribute_not_emitted")).cast(f"array<{RESULT}>"))
        .when(F.size(every) > 0, every)
        .when(F.size("unknown") > 0, one(result("insufficient_evidence", "side_effect_unclassified", None, F.col("unknown"))).cast(f"array<{RESULT}>"))
        .otherwise(one(result("pass", None, F.col("total"))).cast(f"array<{RESULT}>"))
    )
    met = traces.select("trace_id").join(found, "trace_id", "left")
    return met.select("trace_id", F.lit(rule["id"]).alias("rule_id"), F.explode(results).alias("r")).select("trace_id", "rule_id", "r.*")


def approved_routes(traces: DataFrame, routes: DataFrame, rule: dict, own: DataFrame | None = None, approved: DataFrame | None = None) -> DataFrame:
    """A run's fingerprint is approved; if not, it drifted if it is similar enough to an approved family, else it is unknown.

    routes: trace_id, fingerprint. own and approved: features of the runs (trace_id) and of the families (fingerprint).
    """
    known = [f.removeprefix("sha256:") for f in rule["fingerprints"]]
    found = routes.select("trace_id", F.col("fingerprint").isin(*known).alias("known"))
    drifted = F.lit(False)
    if own is not None and approved is not None and rule.get("minSimilarity") is not None:
        near = features.nearest(own, approved)
        found = found.join(near, "trace_id", "left")
        drifted = F.coalesce(at_least(F.col("shared"), F.col("either"), rule["minSimilarity"]), F.lit(False))
    choice = F.when(F.col("known"), result("pass")).when(drifted, result("violation", "ROUTE_DRIFTED")).otherwise(result("violation", "ROUTE_NOT_APPROVED"))
    return per_run(traces, found, rule, choice)


def evaluate_rules(graph: Graph, nodes: DataFrame, rules: list[dict], routes: DataFrame | None = None, own: DataFrame | None = None, approved: DataFrame | None = None) -> DataFrame:
    """trace_id, rule_id, rule_type, severity, outcome, code, detail, value, span_ids, orders and labels of all rules over the runs that can be evaluated.

    nodes: graph.nodes.
    """
    traces = graph.traces.where("quality IN ('complete', 'incomplete')")
    nodes = nodes.join(traces.select("trace_id"), "trace_id", "left_semi")
    marks = ancestry_marks(rules)
    seen = canonical.nearest_above(nodes, marks) if marks else nodes
    seen = cut(seen) if len(marks) > 2 else seen  # read by several rules
    structural = {"required_edge": required_edge, "required_ancestry": required_ancestry, "forbidden_path": forbidden_path, "retry_budget": retry_budget}
    parts = [p for p in [single_pass(traces, nodes, rules)] if p is not None]
    parts += [structural[r["type"]](traces, seen, r) for r in rules if r["type"] in structural]
    parts += [approved_routes(traces, routes, r, own, approved) for r in rules if r["type"] == "approved_routes"]
    every = reduce(DataFrame.unionByName, parts)
    about = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r["id"]), F.struct(F.lit(r["type"]).alias("rule_type"), F.lit(r["severity"]).alias("severity"), F.lit(i).alias("rule_order")))))
    return every.withColumn("about", F.element_at(about, F.col("rule_id"))).select("trace_id", "rule_id", "about.rule_type", "about.severity", "about.rule_order", "outcome", "code", "detail", "value", "span_ids", "orders", "labels")

"""Mining of baselines: eligible runs, route families and their statistics, and a contract proposed from them."""

from __future__ import annotations

import hashlib
import json
import re
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeledger.functions.exact import at_least, distribution, fraction
from routeledger.functions.names import margin_up, rule_id, safe_text
from routeledger.operators import ranks
from routeledger.operators.canonical import fingerprints, ordered
from routeledger.operators.diff import labeled_edges
from routeledger.operators.graph import build, cut

#: Bounds of a selection: letters of a key and of a text, traces.
MOST_KEY, MOST_TEXT, MOST_TRACES = 128, 256, 100_000
#: Reasons for which a run is left out, those of eligibility in the order in which they are looked for.
REASONS = [
    "UNTRUSTED_TYPED_ATTRIBUTE", "TRACE_FETCH_FAILED", "TRACE_MALFORMED", "TRACE_TOO_LARGE", "TRACE_INCONSISTENT", "TRACE_INCOMPLETE", "ROOT_SPAN_MISSING", "NORMALISER_VERSION_MISMATCH",
    "RELEASE_ID_MISSING", "RELEASE_MISMATCH", "ENVIRONMENT_MISMATCH", "RUN_ID_MISSING", "RUN_NOT_SUCCESSFUL", "DUPLICATE_TRACE", "DUPLICATE_RUN",
]


def facts(spans: DataFrame, traces: DataFrame, untrusted: DataFrame | None = None) -> DataFrame:
    """trace_id, quality, warnings and the different releases, environments and run ids of each trace, whether a span has an error, and
    `typed_ok`: not one of the traces of `untrusted`, whose values have other types than declared."""
    own = spans.where("trace_id IS NOT NULL").groupBy("trace_id").agg(
        *(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))).alias(f"{c}s") for c in ("release", "environment", "run_id")),
        F.coalesce(F.max(F.col("has_error") | (F.lower("status_code") == "error")), F.lit(False)).alias("has_error"),
    )
    met = traces.select("trace_id", "quality", "warnings").join(own, "trace_id", "left")
    if untrusted is None:
        return met.withColumn("typed_ok", F.lit(True))
    bad = untrusted.select("trace_id").distinct().withColumn("typed_ok", F.lit(False))
    return met.join(bad, "trace_id", "left").withColumn("typed_ok", F.coalesce("typed_ok", F.lit(True)))


def reason(release: str, environment: str | None = None, successful_only: bool = False, needs_root: bool = False) -> Column:
    """The first reason for which a run is no good example, or null. Rows: those of `facts`."""
    c = F.when(~F.col("typed_ok"), "UNTRUSTED_TYPED_ATTRIBUTE").when(F.col("quality").isNull(), "TRACE_FETCH_FAILED")
    c = c.when(F.col("quality") == "empty", "TRACE_MALFORMED").when(F.col("quality") == "too_large", "TRACE_TOO_LARGE")
    c = c.when(F.col("quality") == "inconsistent", "TRACE_INCONSISTENT").when(F.col("quality") != "complete", "TRACE_INCOMPLETE")
    if needs_root:
        c = c.when(F.exists("warnings", lambda w: w["kind"] == "missing_root_selector_match"), "ROOT_SPAN_MISSING")
    c = c.when(F.size("releases") == 0, "RELEASE_ID_MISSING").when(F.col("releases") != F.array(F.lit(release)), "RELEASE_MISMATCH")
    if environment is not None:
        c = c.when(F.col("environments") != F.array(F.lit(environment)), "ENVIRONMENT_MISMATCH")
    c = c.when(F.size("run_ids") != 1, "RUN_ID_MISSING")
    return c.when(F.col("has_error"), "RUN_NOT_SUCCESSFUL") if successful_only else c


def dataset(runs: DataFrame, why: Column) -> tuple[DataFrame, DataFrame]:
    """Eligible runs, one for each run id (the smallest trace id), and the number of those left out by reason."""
    judged = runs.withColumn("reason", why)
    once = Window.partitionBy(F.get("run_ids", F.lit(0))).orderBy("trace_id")
    good = judged.where("reason IS NULL").withColumn("place", F.row_number().over(once))
    tally = judged.where("reason IS NOT NULL").select("reason").union(good.where("place > 1").select(F.lit("DUPLICATE_RUN"))).groupBy("reason").agg(F.count("*").alias("runs"))
    return good.where("place = 1").drop("place", "reason"), tally


def families(runs: DataFrame, rare: str = "0.05") -> DataFrame:
    """Route families: runs of one fingerprint with their statistics, and whether they are rare: less than this share of all runs."""
    plain = runs.groupBy("fingerprint").agg(F.count("*").alias("runs"), F.max("retries").alias("most_retries"))
    spread = ranks.distribution(runs, ["fingerprint"], "duration_ms", "d_")  # a family may hold most runs
    found = plain.join(spread, "fingerprint").withColumn("p95_ms", F.col("d_p95"))
    total = runs.agg(F.count("*").alias("total"))
    return found.crossJoin(total).withColumn("rare", ~at_least(F.col("runs"), F.col("total"), rare))  # total is one row


def representatives(runs: DataFrame, k: int = 3) -> DataFrame:
    """The k runs of each family that are closest to its median duration, ties to the smaller trace id."""
    middle = ranks.percentiles(runs, ["fingerprint"], "duration_ms", [50]).select("fingerprint", F.col("p50").alias("middle"))
    order = [F.abs(F.col("duration_ms") - F.col("middle")), "trace_id"]
    near = runs.join(middle, "fingerprint").withColumn("part", F.pmod(F.xxhash64("trace_id"), F.lit(64)))
    some = near.withColumn("place", F.row_number().over(Window.partitionBy("fingerprint", "part").orderBy(*order))).where(F.col("place") <= k)
    return some.withColumn("place", F.row_number().over(Window.partitionBy("fingerprint").orderBy(*order))).where(F.col("place") <= k).select("fingerprint", "place", "trace_id")


def family_topology(nodes: DataFrame, families_: DataFrame) -> DataFrame:
    """fingerprint, label, occurrences, greatest retry and the kinds of one run of each family: families_ has fingerprint and trace_id."""
    own = nodes.join(families_.select("fingerprint", "trace_id"), "trace_id")
    sets = {"side_effects": "side_effect", "services": "service", "kinds": "kind", "tools": "tool", "data_domains": "data_domain", "operations": "operation"}
    return own.groupBy("fingerprint", "label").agg(F.count("*").alias("occurrences"), F.max("retry_number").alias("most_retry"), *(F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()))


def hidden_labels(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """trace_id and label of what a run may have hidden: labels that somewhere are children of one whose client span has no server span
    in this run, and that the run doesn't show. labels: trace_id, label and unserved; pairs: labels a and b of edges."""
    flagged = labels.where("unserved").select("trace_id", F.col("label").alias("a"))
    return flagged.join(pairs.select("a", F.col("b").alias("label")), "a").select("trace_id", "label").distinct().join(labels.select("trace_id", "label"), ["trace_id", "label"], "left_anti")


def presence_class(present: Column, observable: Column, required: float = 1, rare: float = 0.05) -> Column:
    """Always, required (at least that share of the runs that could show it), optional, rare (less than that share), unobservable."""
    least = at_least(present, observable, required)
    return (
        F.when(observable == 0, "unobservable").when(present == observable, "always").when(least, "required")
        .when(~at_least(present, observable, rare), "rare").otherwise("optional")
    )


def label_statistics(nodes: DataFrame, runs: DataFrame, edges: DataFrame, required: float = 1, rare: float = 0.05) -> DataFrame:
    """For every label: runs with it, those that could show it, all runs, least, most and p95 of its count in these (0 without it), its
    presence, kinds, parents and whether it is a remote handler; edges are by labels (trace_id, a, b)."""
    sets = {"side_effects": "side_effect", "services": "service", "kinds": "kind", "tools": "tool", "data_domains": "data_domain", "operations": "operation"}
    # Nodes are read once, for a row for each run and label; edges once, for the pairs of labels. The rest is made of these.
    mine = nodes.join(runs.select("trace_id"), "trace_id", "left_semi")
    per_run = cut(mine.groupBy("trace_id", "label").agg(F.count("*").alias("n"), F.max("retry_number").alias("retry"), F.max("unserved").alias("unserved"), *(F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items())))
    pairs = cut(edges.join(runs.select("trace_id"), "trace_id", "left_semi").select("a", "b").distinct())
    total = runs.agg(F.count("*").alias("total"))
    every = lambda n: F.array_sort(F.array_distinct(F.flatten(F.collect_set(n)))).alias(n)  # noqa: E731  # of the different sets of a label's runs
    seen = per_run.groupBy("label").agg(F.count("*").alias("present"), F.min("n").alias("lo"), F.max("n").alias("most"), F.max("retry").alias("most_retry"), *map(every, sets))
    parents = pairs.groupBy(F.col("b").alias("label")).agg(F.array_sort(F.collect_set("a")).alias("parent_labels"))
    hidden = hidden_labels(per_run, pairs).groupBy("label").agg(F.count("*").alias("unobservable"))
    clients = seen.where(F.array_contains("kinds", "Client")).select(F.col("label").alias("a"))
    # A label whose parents all are client spans somewhere.
    foreign = pairs.select("a", F.col("b").alias("label")).join(clients, "a", "left_anti").select("label").distinct().withColumn("foreign", F.lit(True))
    seen = seen.join(parents, "label", "left").join(hidden, "label", "left").join(foreign, "label", "left").crossJoin(total)  # total is one row
    seen = seen.withColumn("unobservable", F.coalesce("unobservable", F.lit(0))).withColumn("observable", F.col("total") - F.col("unobservable"))
    # Of runs without the label only the number matters: the p95 is a rank among the others.
    order = Window.partitionBy("label").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    histogram = per_run.groupBy("label", "n").agg(F.count("*").alias("runs"))
    rank = F.ceil(F.lit(95) * F.col("observable") / 100)
    ranked = histogram.join(seen.select("label", "present", "observable"), "label").withColumn("upto", F.col("observable") - F.col("present") + F.sum("runs").over(order))
    p95 = ranked.where(F.col("upto") >= rank).groupBy("label").agg(F.min("n").alias("above"))
    met = seen.join(p95, "label", "left")
    zero = F.col("observable") - F.col("present") >= rank
    handler = (F.col("kinds") == F.array(F.lit("Server"))) & F.col("parent_labels").isNotNull() & F.col("foreign").isNull()
    return met.select(
        "label", "present", "observable", "unobservable", "total", F.when(F.col("present") < F.col("observable"), F.lit(0)).otherwise(F.col("lo")).cast("bigint").alias("least"), "most",
        F.when(zero, F.lit(0)).otherwise(F.col("above")).cast("bigint").alias("p95"), presence_class(F.col("present"), F.col("observable"), required, rare).alias("presence"),
        *sets, F.coalesce("parent_labels", F.array().cast("array<string>")).alias("parent_labels"), F.coalesce(handler, F.lit(False)).alias("remote_handler"), "most_retry",
    )


def edge_statistics(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """a, b, type, runs that have the edge, all runs, and how often it occurs; edges by labels."""
    mine = edges.join(runs.select("trace_id"), "trace_id", "left_semi")
    each = mine.groupBy("trace_id", "a", "b", "type").agg(F.count("*").alias("n")).groupBy("a", "b", "type").agg(F.count("*").alias("runs"), F.sum("n").alias("total"), F.max("n").alias("most"))
    return each.crossJoin(runs.agg(F.count("*").alias("all_runs")))  # one row


def retry_statistics(nodes: DataFrame, runs: DataFrame) -> DataFrame:
    """group (tool, else label), runs with a retry number of it, the distribution of its greatest one in these runs, and side effects."""
    mine = nodes.join(runs.select("trace_id"), "trace_id", "left_semi").where("retry_number IS NOT NULL").withColumn("group", F.coalesce("tool", "label"))
    per_run = mine.groupBy("trace_id", "group").agg(F.max("retry_number").alias("retry"))
    effects = mine.groupBy("group").agg(F.array_sort(F.collect_set("side_effect")).alias("side_effects"), F.array_sort(F.collect_set("operation")).alias("operations"))
    return per_run.groupBy("group").agg(*distribution("retry", "")).join(effects, "group")


def run_retries(nodes: DataFrame) -> DataFrame:
    """trace_id, total (the sum over groups of the greatest retry number) and side_effect_max; runs without a retry number have no row."""
    mine = nodes.where("retry_number IS NOT NULL").groupBy("trace_id", F.coalesce("tool", "label").alias("group")).agg(
        F.max("retry_number").alias("retry"), F.max(F.when(F.col("side_effect").isin("write", "external"), F.col("retry_number"))).alias("effect")
    )
    return mine.groupBy("trace_id").agg(F.sum("retry").alias("total"), F.coalesce(F.max("effect"), F.lit(0)).alias("side_effect_max"))


def attribute_support(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """label, key, value, spans that carry it and all spans of the label, for allow-listed attributes."""
    pairs = nodes.select("label", F.explode(F.map_filter("attributes", lambda k, v: k.isin(*keys))).alias("key", "value"))
    every = nodes.groupBy("label").agg(F.count("*").alias("all_spans"))
    return pairs.groupBy("label", "key", "value").agg(F.count("*").alias("spans")).join(every, "label")


def availability(runs: DataFrame, column: str, least: int = 1) -> DataFrame:
    """One row: whether a metric is available over the runs, and why not; observed and all runs."""
    found = runs.agg(F.count(column).alias("observed"), F.count("*").alias("runs"))
    why = F.when(F.col("observed") == 0, "ATTRIBUTE_NOT_EMITTED").when(F.col("observed") < least, "INSUFFICIENT_OBSERVATIONS")
    return found.select(F.lit(column).alias("metric"), why.isNull().alias("available"), why.alias("reason"), "observed", "runs")


def status(n_eligible: int, truncated: bool, least: int = 20) -> str:
    return "dataset_truncated" if truncated else "insufficient_runs" if n_eligible < least else "pending_review"


def decided(found: DataFrame, decisions: dict[str, str]) -> DataFrame:
    """Families with the status that a review gives them: approved, rejected, optional or excluded_fixture_error; else pending."""
    known = {r[0] for r in found.where(F.col("fingerprint").isin(*decisions)).select("fingerprint").collect()} if decisions else set()  # as many as decisions
    if missing := sorted(set(decisions) - known):
        raise ValueError(f"no such families: {', '.join(missing)}")
    if bad := sorted(set(decisions.values()) - {"approved", "rejected", "optional", "excluded_fixture_error"}):
        raise ValueError(f"unknown decisions: {', '.join(bad)}")
    states = F.create_map(*(F.lit(x) for kv in decisions.items() for x in kv)) if decisions else F.create_map().cast("map<string,string>")
    return found.withColumn("status", F.coalesce(F.element_at(states, F.col("fingerprint")), F.lit("pending")))


def cardinality_bounds(labels: DataFrame, margin: int = 0) -> DataFrame:
    """Recommended bounds: p95 with the outliers flagged where the most exceeds it, else the most and a margin."""
    outliers = F.col("most") > F.col("p95")
    top = F.when(outliers, F.col("p95")).otherwise(F.col("most") + margin)
    return labels.select("label", F.col("least").alias("min"), top.cast("bigint").alias("max"), outliers.alias("outliers"))


#: Attributes on which all spans of a side effect must agree to give a rule.
AGREEING = ["agent.idempotency.present"]


def proposal_rows(nodes: DataFrame, runs: DataFrame, edges: DataFrame, most: int) -> dict:
    """What a proposal is made of, all of it bounded: labels with their bounds and agreeing attributes, lists of values, retries, metrics."""
    labels = label_statistics(nodes, runs, edges)
    mine = nodes.join(runs.select("trace_id"), "trace_id", "left_semi")
    agree = attribute_support(mine, AGREEING).where("spans = all_spans").groupBy("label").agg(F.collect_list(F.struct("key", "value")).alias("agreed"))
    rows = labels.join(cardinality_bounds(labels), "label").join(agree, "label", "left").orderBy("label").limit(most + 1).collect()
    per_run = run_retries(mine).agg(F.max("total").alias("total"), F.max("side_effect_max").alias("side_effect_max")).first()
    groups = mine.where("retry_number IS NOT NULL").agg(F.max("retry_number").alias("most"), F.array_sort(F.collect_set("operation")).alias("operations")).first()
    columns = ("duration_ms", "input_tokens", "output_tokens")
    each = runs.select(F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).cast("bigint").alias("value")) for c in columns))).alias("x")).select("x.*")
    ranked = {r["of"]: r["p95"] for r in ranks.percentiles(each, ["of"], "value", [95]).collect()}
    metrics = {"most": runs.agg(F.max("duration_ms").alias("most")).first()["most"]} | {c: ranked.get(c) for c in columns}
    return {"labels": rows, "retries": per_run, "groups": groups, "metrics": metrics}


def propose(nodes: DataFrame, edges: DataFrame, found: DataFrame, runs: DataFrame, name: str, root: str | None = None, minimum_runs: int = 20, most_rules: int = 400, most_values: int = 256) -> dict:
    """A draft contract from approved families: presence, handler edges, side effects, allowed values, retries, routes and budgets.

    nodes and edges (by labels: trace_id, a, b, type) are those of a graph; runs (trace_id, fingerprint, duration_ms, input_tokens,
    output_tokens) are cut to the families of `found` that are approved. What can't be said is disclosed as code and subject.
    """
    good = found.where("status = 'approved'").select("fingerprint")
    approved = sorted(r[0] for r in good.limit(most_values + 1).collect())
    runs = runs.join(good, "fingerprint", "left_semi")
    seen = proposal_rows(nodes, runs, edges, most_rules)
    rules, disclosures = [], []
    add = lambda rule, severity: rules.append(rule | {"severity": severity})
    tell = lambda code, subject: disclosures.append(f"{code}:{subject}")
    clean: dict[str, list] = {}
    for r in seen["labels"][:most_rules]:
        clean.setdefault(safe_text(r["label"]), []).append(r)
    named = {own[0]["label"]: label for label, own in clean.items() if label and len(own) == 1}
    for r in (r for label, own in sorted(clean.items()) if not label or len(own) > 1 for r in own):
        tell("LABEL_NOT_EXPRESSIBLE", r["label"])
    for r in seen["labels"][:most_rules]:
        label = named.get(r["label"])
        if label is None or r["label"] == root:
            continue
        if r["presence"] == "unobservable":
            tell("LABEL_UNOBSERVABLE", label)
            continue
        if r["remote_handler"]:
            for parent in r["parent_labels"]:
                if parent in named:
                    add({"id": rule_id("answered", f"{named[parent]}->{label}"), "type": "required_edge", "from": {"name": named[parent]}, "to": {"name": label}, "relationship": "direct"}, "high")
        else:
            if r["outliers"]:
                tell("CARDINALITY_OUTLIER", label)
            if r["least"] >= 1:
                add({"id": rule_id("require", label), "type": "required_span", "selector": {"name": label}, "cardinality": {"min": r["least"], "max": r["max"]}}, "critical" if r["side_effects"] == ["read"] else "high")
            else:
                tell("LABEL_OPTIONAL", label)
                add({"id": rule_id("bound", label), "type": "cardinality", "selector": {"name": label}, "min": 0, "max": r["max"], "scope": "run"}, "medium")
        if len(r["side_effects"]) == 1 and r["side_effects"][0] in ("write", "external"):
            effect = r["side_effects"][0]
            add({"id": rule_id("single", f"{label}|{effect}"), "type": "cardinality", "selector": {"name": label, "attributes": {"agent.side_effect": effect}}, "min": 0, "max": r["max"], "scope": "run"}, "critical")
            if root in named and r["present"] == r["observable"]:
                add({"id": rule_id("within", f"{named[root]}->{label}"), "type": "required_ancestry", "ancestor": {"name": named[root]}, "descendant": {"name": label}, "relationship": "any_depth"}, "high")
            for fact in r["agreed"] or []:
                kind, _, text = fact["value"].partition(":")
                value = {"boolean": text == "true", "number": int(text) if kind == "number" and text.lstrip("-").isdigit() else text}.get(kind, text)
                add({"id": rule_id("attribute", f"{label}|{fact['key']}"), "type": "attribute_constraint", "selector": {"name": label}, "field": fact["key"], "operator": "equals", "value": value}, "critical")
    for field, column, prefix in (("gen_ai.tool.name", "tools", "tools"), ("service.name", "services", "services"), ("agent.data_domain", "data_domains", "domains")):
        values = sorted({safe_text(v) for r in seen["labels"] for v in r[column]})
        if len(values) > most_values:
            tell("BUDGET_NOT_PROPOSED", field)
        elif values:
            add({"id": rule_id("approved", prefix), "type": "allowed_values", "field": field, "values": values}, "high")
    operations, retries = seen["groups"]["operations"] or [], seen["retries"]
    if seen["groups"]["most"] is None or not operations:
        tell("BUDGET_NOT_PROPOSED", "retries")
    else:
        where = {"operation": safe_text(operations[0])} if len(operations) == 1 else {"attributes": {"gen_ai.operation.name": {"operator": "in", "values": [safe_text(o) for o in operations[:most_values]]}}}
        add({"id": rule_id("retries", "bounded"), "type": "retry_budget", "selector": where, "maxPerTool": seen["groups"]["most"], "maxRunTotal": max(retries["total"], seen["groups"]["most"]), "sideEffectMax": retries["side_effect_max"]}, "high")
    if approved and len(approved) <= most_values:
        add({"id": rule_id("route", "approved-family"), "type": "approved_routes", "fingerprints": [f"sha256:{f}" for f in approved], "minSimilarity": 0.92}, "high")
    metrics = seen["metrics"]
    if metrics["most"] is not None:
        add({"id": rule_id("budget", "run.duration_ms"), "type": "numeric_budget", "metric": "run.duration_ms", "aggregation": "max", "max": margin_up(metrics["most"], 50), "scope": "run"}, "medium")
        add({"id": rule_id("budget", "release.duration_ms"), "type": "numeric_budget", "metric": "run.duration_ms", "aggregation": "p95", "max": margin_up(metrics["duration_ms"], 20), "scope": "release"}, "medium")
    else:
        tell("BUDGET_NOT_PROPOSED", "run.duration_ms")
    for column in ("input_tokens", "output_tokens"):
        metric = f"gen_ai.usage.{column}"
        if metrics[column] is None:
            tell("BUDGET_NOT_PROPOSED", metric)
        else:
            add({"id": rule_id("budget", metric), "type": "numeric_budget", "metric": metric, "aggregation": "p95", "max": margin_up(metrics[column], 25), "scope": "release"}, "medium")
    if len(rules) > most_rules or len(seen["labels"]) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    gate = {
        "minCompletedRuns": minimum_runs, "evaluationTimeoutSeconds": 600, "maxViolationPercent": 0.5, "maxUnknownRoutePercent": 1, "maxLatencyRegressionPercent": 20,
        "maxTokenRegressionPercent": 25, "zeroToleranceRuleIds": sorted(r["id"] for r in rules if r["severity"] == "critical"),
    }
    routes = [f"sha256:{f}" for f in approved]
    return {"apiVersion": "v1", "kind": "TrajectoryContract", "metadata": {"id": name, "name": name, "version": "0.1.0"}, "spec": {"selectors": {"rootSpan": root} if root else {}, "approvedRoutes": routes, "rules": rules, "gate": gate}, "disclosures": sorted(set(disclosures))}


class Selection(NamedTuple):
    """What is mined: a release's runs in a window of time. Bounds are checked by `selected`."""

    project: str
    agent: str
    release: str
    root: str
    start_ms: int
    end_ms: int
    environment: str | None = None
    minimum_runs: int = 20
    successful_only: bool = True
    needs_root: bool = True
    rare: str = "0.05"
    most_traces: int = 1000
    most_spans: int = 10_000
    representatives: int = 3


def selected(s: Selection) -> Selection:
    """The selection, if it keeps its bounds."""
    for what, key in (("project", s.project), ("agent", s.agent)):
        if not re.fullmatch(r"[a-z0-9][a-z0-9._-]*", key) or len(key) > MOST_KEY:
            raise ValueError(f"no {what} key: {key!r}")
    for what, text in (("release", s.release), ("root", s.root)):
        if not 0 < len(text) <= MOST_TEXT:
            raise ValueError(f"the {what} has to have 1 to {MOST_TEXT} letters")
    if s.end_ms <= s.start_ms:
        raise ValueError("the window has to end after it starts")
    for what, n, most in (("minimum_runs", s.minimum_runs, MOST_TRACES), ("most_traces", s.most_traces, MOST_TRACES), ("most_spans", s.most_spans, 100_000), ("representatives", s.representatives, 50)):
        if not 0 < n <= most:
            raise ValueError(f"{what} has to be from 1 to {most}")
    n, d = fraction(s.rare)
    if not 0 <= n <= d:
        raise ValueError("the threshold of rare routes is a share")
    return s


def baseline_id(s: Selection) -> str:
    """The identity of a baseline: all of its selection. The threshold counts as a fraction in lowest terms."""
    rare = Fraction(*fraction(s.rare))
    said = [s.project, s.agent, s.release, s.environment, s.start_ms, s.end_ms, s.minimum_runs, s.root, s.successful_only, s.needs_root, [rare.numerator, rare.denominator], s.most_traces, s.most_spans, s.representatives]
    return f"bl-{hashlib.sha256(json.dumps(said, separators=(',', ':'), ensure_ascii=False).encode()).hexdigest()[:32]}"


def family_ids(found: DataFrame, baseline: str) -> DataFrame:
    """Families with `family_id`, which depends on baseline and fingerprint only."""
    return found.withColumn("family_id", F.concat(F.lit("rf-"), F.substring(F.sha2(F.concat(F.lit(f"{baseline}|"), F.col("fingerprint")), 256), 1, 32)))


def discovered(spans: DataFrame, s: Selection) -> tuple[DataFrame, bool]:
    """Spans of the first `most_traces` traces, by time, whose root is of the release and in the window, and whether there are more."""
    roots = spans.where((F.col("name") == s.root) & (F.col("release") == s.release) & (F.col("start_ns") >= s.start_ms * 1_000_000) & (F.col("start_ns") < s.end_ms * 1_000_000))
    roots = roots if s.environment is None else roots.where(F.col("environment") == s.environment)
    first = roots.groupBy("trace_id").agg(F.min("start_ns").alias("at")).orderBy("at", "trace_id").limit(s.most_traces + 1)
    ranked = cut(first.withColumn("place", F.row_number().over(Window.orderBy("at", "trace_id"))))  # most_traces + 1 rows at most
    return spans.join(ranked.where(F.col("place") <= s.most_traces).select("trace_id"), "trace_id", "left_semi"), ranked.where(F.col("place") > s.most_traces).count() > 0


def baseline_disclosures(state: str, found: DataFrame, tally: DataFrame, eligible: int, unverified: list[str] = ()) -> list[tuple[str, int]]:
    """Code and count of what a reviewer has to know about a baseline. unverified: fields whose type nothing tells."""
    out = sum(r["runs"] for r in tally.collect())  # a row for each reason
    rare = found.where("rare").count()
    told = [
        ("DATASET_TRUNCATED", out + eligible if state == "dataset_truncated" else 0), ("INSUFFICIENT_RUNS", eligible if state == "insufficient_runs" else None), ("TRACES_EXCLUDED", out),
        ("RARE_FAMILY_PRESENT", rare), ("FIELD_TYPE_UNVERIFIED", len(unverified)),
    ]
    return sorted((code, n) for code, n in told if n or (code == "INSUFFICIENT_RUNS" and n == 0))


def proposal_disclosures(families: DataFrame) -> list[tuple[str, int]]:
    """Code and count of what a reviewer has to know about the families that a proposal rests on; families have `status`."""
    counts = {r["approved"]: r["n"] for r in families.groupBy((F.col("status") == "approved").alias("approved")).agg(F.count("*").alias("n")).collect()}
    told = [("MULTIPLE_FAMILIES_APPROVED", counts.get(True, 0) if counts.get(True, 0) > 1 else 0), ("UNAPPROVED_FAMILY_PRESENT", counts.get(False, 0))]
    return [(code, n) for code, n in told if n]


def mine(spans: DataFrame, selection: Selection, name: str, decisions: dict[str, str] | None = None, unicode: bool = True, unverified: list[str] = ()) -> dict:
    """The whole way from spans to a draft: the selection's traces, eligible runs, families, the baseline's status and disclosures and, once families
    are approved, a contract."""
    s = selected(selection)
    own, truncated = discovered(spans, s)
    g = build(own, s.root, unicode=unicode)
    good, tally = dataset(facts(own, g.traces), reason(s.release, s.environment, needs_root=s.needs_root))
    totals = g.nodes.groupBy("trace_id").agg(F.max(F.when(F.col("order") == 0, F.expr("duration_ns div 1000000"))).alias("duration_ms"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.greatest("retry_number", F.lit(0))).alias("retries"))
    runs = cut(good.select("trace_id").join(fingerprints(ordered(g)), "trace_id").join(totals, "trace_id"))
    found, eligible, baseline = cut(family_ids(families(runs, s.rare), baseline_id(s))), runs.count(), baseline_id(s)
    state = status(eligible, truncated, s.minimum_runs)
    told, draft = baseline_disclosures(state, found, tally, eligible, unverified), None
    if decisions:
        approved = decided(found, decisions)
        draft = propose(g.nodes, labeled_edges(g.nodes, g.edges), approved, runs, name, s.root, s.minimum_runs)
        draft["disclosures"] = sorted({*draft["disclosures"], *(f"{code}:" for code, _ in [*told, *proposal_disclosures(approved)])})
    return {"families": found, "runs": runs, "tally": tally, "status": state, "disclosures": told, "draft": draft, "baseline": baseline}

"""The release gate: runs are counted for each release, budgets summed over it, and findings decide by the gravest."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeledger.functions.exact import fraction, ratio
from routeledger.operators.ranks import percentiles

#: Decisions by rank and exit codes.
DECISIONS = ["pass", "insufficient_data", "fail", "error"]
EXIT_CODES = {"pass": 0, "fail": 2, "insufficient_data": 3, "error": 4, "configuration": 5}
MISSING_CODES = ("REQUIRED_SPAN_MISSING", "REQUIRED_ANCESTRY_MISSING", "REQUIRED_EDGE_MISSING", "CARDINALITY_BELOW_MIN")
ABOVE_CODES = ("CARDINALITY_ABOVE_MAX", "REQUIRED_SPAN_TOO_MANY", "RETRY_BUDGET_SIDE_EFFECT_EXCEEDED")
UNKNOWN_CODES = ("ROUTE_NOT_APPROVED", "ROUTE_DRIFTED")
#: Codes of findings, in the order in which they are listed, and of disclosures.
FINDINGS = [
    "CONTRACT_NOT_ACTIVE", "CONTRACT_MISMATCH", "RUN_EVALUATION_ERRORED", "RETRIEVAL_TRUNCATED", "EVALUATION_TIMED_OUT", "EVALUATION_INCOMPLETE", "AGGREGATION_STALE",
    "MIN_RUNS_NOT_MET", "RUN_EVIDENCE_INSUFFICIENT", "RELEASE_RULE_EVIDENCE_INSUFFICIENT", "ZERO_TOLERANCE_VIOLATION", "VIOLATION_RATE_EXCEEDED", "UNKNOWN_ROUTE_RATE_EXCEEDED",
    "LATENCY_REGRESSION_EXCEEDED", "TOKEN_REGRESSION_EXCEEDED", "RELEASE_BUDGET_EXCEEDED", "RELEASE_CARDINALITY_EXCEEDED",
]
DISCLOSURES = [
    "BASELINE_UNAVAILABLE", "LATENCY_REGRESSION_NOT_MEASURED", "TOKEN_REGRESSION_NOT_MEASURED", "RETRY_CHANGE_NOT_MEASURED",
    "RELEASE_BUDGET_NOT_MEASURED", "RUN_DURATION_NOT_RECORDED", "RUN_RETRIES_NOT_RECORDED",
]


class State(NamedTuple):
    """What is known of the evaluation beside its runs; times are in milliseconds."""

    contract_state: str = "active"
    same_contract: bool = True
    truncated: bool = False
    started_ms: int | None = None
    completed_ms: int | None = 0
    now_ms: int = 0
    window_end_ms: int = 0
    max_age_seconds: int = 3600


class Reference(NamedTuple):
    """What a release is compared with: figures of its baseline."""

    latency_p95_ms: int | None = None
    tokens_p95: int | None = None
    retries_per_run: int | None = None


def counts(runs: DataFrame, violations: DataFrame) -> DataFrame:
    """One row for each release: runs by status, violations by severity, unknown routes, duplicates and missing prerequisites."""
    n = lambda c: F.count(F.when(c, 1))
    by_run = violations.groupBy("trace_id").agg(
        *(n(F.col("severity") == s).alias(f"v_{s}") for s in ("critical", "high", "medium", "low")),
        F.max(F.col("code").isin(*UNKNOWN_CODES).cast("int")).alias("unknown_route"), F.max(F.col("code").isin(*ABOVE_CODES).cast("int")).alias("duplicate"),
        F.max(F.col("code").isin(*MISSING_CODES).cast("int")).alias("missing"),
    )
    v_columns = [c for c in by_run.columns if c != "trace_id"]
    met = runs.join(by_run, "trace_id", "left").fillna(0, v_columns)
    tokens = F.when(F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull(), F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)))
    met = met.withColumn("tokens", tokens)
    is_ = lambda s: F.col("status") == s
    plain = met.groupBy("release").agg(
        F.count("*").alias("runs"), n(is_("pass")).alias("passed"), n(is_("fail")).alias("failed"), n(is_("insufficient_data")).alias("insufficient"), n(is_("error")).alias("errors"),
        *(F.sum(f"v_{s}").alias(f"v_{s}") for s in ("critical", "high", "medium", "low")),
        F.sum("unknown_route").cast("bigint").alias("unknown_routes"), F.sum("duplicate").cast("bigint").alias("duplicate_rule_runs"), F.sum("missing").cast("bigint").alias("missing_prerequisites"),
        n(F.col("quality") != "complete").alias("degraded"), F.countDistinct("fingerprint").alias("routes"),
        F.sum("retries").alias("retries"), F.sum("output_tokens").alias("output_tokens"),
        F.count("duration_ms").alias("timed"), F.count("retries").alias("with_retries"), F.expr("sum(retries) div count(retries)").alias("retries_per_run"),
    )
    measured = met.select("release", F.explode(F.array(F.struct(F.lit("ms").alias("of"), F.col("duration_ms").cast("bigint").alias("value")), F.struct(F.lit("tokens").alias("of"), F.col("tokens").cast("bigint").alias("value")))).alias("x")).select("release", "x.*")
    ranked = percentiles(measured, ["release", "of"], "value", [95, 99])
    pick = lambda of, p: F.max(F.when(F.col("of") == of, F.col(f"p{p}")))
    ranked = ranked.groupBy(F.struct("release").alias("_k")).agg(pick("ms", 95).alias("p95_ms"), pick("ms", 99).alias("p99_ms"), pick("tokens", 95).alias("p95_tokens"))
    return plain.withColumn("_k", F.struct("release")).join(ranked, "_k", "left").drop("_k")


def rates(counted: DataFrame) -> DataFrame:
    """Counts with the exact shares of runs that fail, follow unknown routes, repeat side effects or miss a prerequisite."""
    shares = {"violation_rate": "failed", "unknown_rate": "unknown_routes", "duplicate_rate": "duplicate_rule_runs", "missing_rate": "missing_prerequisites"}
    return counted.withColumns({name: ratio(F.col(c), F.col("runs")) for name, c in shares.items()})


def release_budgets(results: DataFrame, runs: DataFrame, rules: list[dict]) -> DataFrame:
    """release, rule_id, reporting, value and outcome of budgets and cardinalities of release scope, from deferred results."""
    deferred = results.where("outcome = 'deferred'").join(runs.select("trace_id", "release"), "trace_id")
    found = deferred.groupBy("release", "rule_id").agg(
        F.count("value").alias("reporting"), F.count("*").alias("runs"), F.sum("value").alias("sum"), F.max("value").alias("max"),
        F.floor(F.sum("value") / F.count("value")).alias("avg"),
    )
    ranked = percentiles(deferred, ["release", "rule_id"], "value", [95, 99]).select(F.struct("release", "rule_id").alias("_k"), "p95", "p99")
    found = found.withColumn("_k", F.struct("release", "rule_id")).join(ranked, "_k", "left")
    value, bad, is_budget = F.lit(None).cast("bigint"), F.lit(False), F.lit(False)
    for rule in rules:
        if rule.get("scope") != "release":
            continue
        mine = F.col("rule_id") == rule["id"]
        budget = rule["type"] == "numeric_budget"
        own = F.col(rule["aggregation"] if budget else "sum")
        value = F.when(mine, own).otherwise(value)
        wrong = F.lit(False)
        if rule.get("max") is not None:
            wrong = own > rule["max"]
        if not budget and rule.get("min") is not None:
            wrong = wrong | (own < rule["min"])
        bad, is_budget = F.when(mine, wrong).otherwise(bad), F.when(mine, F.lit(budget)).otherwise(is_budget)
    # A budget that no run reports is disclosed; one that some runs don't report can't be decided.
    outcome = F.when((F.col("reporting") == 0) & is_budget, "not_measured").when(F.col("reporting") < F.col("runs"), "insufficient_evidence").when(bad, "violation").otherwise("pass")
    decided = outcome.isin("violation", "pass")
    return found.select("release", "rule_id", "reporting", "runs", F.when(decided, value).alias("value"), outcome.alias("outcome"), is_budget.alias("is_budget"))


def change(now: Column, base: Column) -> Column:
    """Signed change in percent, cut toward 0; null where the base is null or 0."""
    percent = (now - base) * 100 / F.when(base != 0, base)
    return F.when(percent < 0, F.ceil(percent)).otherwise(F.floor(percent)).cast("bigint")


def regressed(now: Column, base: Column, percent) -> Column:
    """now exceeds base by more than a percentage, by cross-multiplication; never without a base."""
    n, d = fraction(percent)
    wide = lambda c: c.cast("decimal(19,0)")
    return F.coalesce((base > 0) & (wide(now) * F.lit(100 * d).cast("decimal(12,0)") > wide(base) * F.lit(100 * d + n).cast("decimal(12,0)")), F.lit(False))


def weighted_reference(families: DataFrame) -> DataFrame:
    """The reference of an approved baseline: the whole part of its families' p95 weighted by their runs."""
    return families.where("status = 'approved'").agg(F.floor(F.sum(F.col("p95_ms") * F.col("runs")) / F.sum("runs")).alias("p95_ms"))


def changes_from(counted: DataFrame, reference: Reference | None) -> DataFrame:
    """release, metric, before, after and change (percent, cut toward 0; null: not measured) of latency, tokens and retries."""
    ref = reference or Reference()
    rows = [("run.duration_ms", ref.latency_p95_ms, "p95_ms"), ("gen_ai.usage.total_tokens", ref.tokens_p95, "p95_tokens"), ("agent.retry.count", ref.retries_per_run, "retries_per_run")]
    each = F.array(*(F.struct(F.lit(metric).alias("metric"), F.lit(base).cast("bigint").alias("before"), F.col(now).cast("bigint").alias("after")) for metric, base, now in rows))
    return counted.select("release", F.explode(each).alias("x")).select("release", "x.*").withColumn("change", change(F.col("after"), F.col("before")))


def findings(counted: DataFrame, violations: DataFrame, runs: DataFrame, budgets: DataFrame, gate: dict, reference: Reference | None = None, state: State = State()) -> DataFrame:
    """release, finding, decision, rule_id and detail for everything that keeps a release from passing, in order by `place`."""
    rows = []

    def add(df: DataFrame, name: str, decision: str, when: Column, detail: Column, rule: Column | None = None) -> None:
        rule = F.lit(None) if rule is None else rule
        rows.append(df.where(when).select("release", F.lit(name).alias("finding"), F.lit(decision).alias("decision"), rule.cast("string").alias("rule_id"), detail.cast("string").alias("detail")))

    always = lambda name, decision, detail: add(counted, name, decision, F.lit(True), F.lit(detail))
    if state.contract_state != "active":
        always("CONTRACT_NOT_ACTIVE", "error", state.contract_state)
    if not state.same_contract:
        always("CONTRACT_MISMATCH", "error", "other content hash")
    add(counted, "RUN_EVALUATION_ERRORED", "error", F.col("errors") > 0, F.col("errors"))
    if state.truncated:
        always("RETRIEVAL_TRUNCATED", "insufficient_data", "truncated")
    if state.completed_ms is None:
        always("EVALUATION_INCOMPLETE", "insufficient_data", "not completed")
    elif state.started_ms is not None and state.completed_ms - state.started_ms > 1000 * gate.get("evaluationTimeoutSeconds", 600):
        always("EVALUATION_TIMED_OUT", "insufficient_data", str(state.completed_ms - state.started_ms))
    if state.now_ms - state.window_end_ms > 1000 * state.max_age_seconds:
        always("AGGREGATION_STALE", "insufficient_data", str(state.now_ms - state.window_end_ms))
    add(counted, "MIN_RUNS_NOT_MET", "insufficient_data", F.col("runs") < gate.get("minCompletedRuns", 1), F.col("runs"))
    add(counted, "RUN_EVIDENCE_INSUFFICIENT", "insufficient_data", F.col("insufficient") > 0, F.col("insufficient"))
    zero = gate.get("zeroToleranceRuleIds") or []
    if zero:
        hit = violations.where(F.col("rule_id").isin(*zero)).join(runs.select("trace_id", "release"), "trace_id").groupBy("release").agg(F.count("*").alias("n"))
        add(hit, "ZERO_TOLERANCE_VIOLATION", "fail", F.lit(True), F.col("n"))
    for key, name, column in (("maxViolationPercent", "VIOLATION_RATE_EXCEEDED", "failed"), ("maxUnknownRoutePercent", "UNKNOWN_ROUTE_RATE_EXCEEDED", "unknown_routes")):
        if key in gate:
            n, d = fraction(gate[key])
            add(counted, name, "fail", F.col(column) * 100 * d > F.col("runs") * n, F.col(column))
    for key, name, column, base in (
        ("maxLatencyRegressionPercent", "LATENCY_REGRESSION_EXCEEDED", "p95_ms", reference and reference.latency_p95_ms),
        ("maxTokenRegressionPercent", "TOKEN_REGRESSION_EXCEEDED", "p95_tokens", reference and reference.tokens_p95),
    ):
        if key in gate and base is not None:
            add(counted, name, "fail", regressed(F.col(column), F.lit(base), gate[key]), F.col(column))
    add(budgets, "RELEASE_BUDGET_EXCEEDED", "fail", (F.col("outcome") == "violation") & F.col("is_budget"), F.col("value"), F.col("rule_id"))
    add(budgets, "RELEASE_CARDINALITY_EXCEEDED", "fail", (F.col("outcome") == "violation") & ~F.col("is_budget"), F.col("value"), F.col("rule_id"))
    add(budgets, "RELEASE_RULE_EVIDENCE_INSUFFICIENT", "insufficient_data", F.col("outcome") == "insufficient_evidence", F.col("reporting"), F.col("rule_id"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    # The gravest decision first, then the order of codes, then rules.
    place = F.struct(-F.array_position(F.array(*map(F.lit, DECISIONS)), F.col("decision")), F.array_position(F.array(*map(F.lit, FINDINGS)), F.col("finding")), F.coalesce("rule_id", F.lit("")))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("release").orderBy(place)))


def disclosures(counted: DataFrame, budgets: DataFrame, reference: Reference | None = None) -> DataFrame:
    """release, disclosure and subject of what could not be measured, which neither passes nor fails."""
    said = lambda df, name, when, subject=None: df.where(when).select("release", F.lit(name).alias("disclosure"), (F.lit(None) if subject is None else subject).cast("string").alias("subject"))
    out = said(budgets, "RELEASE_BUDGET_NOT_MEASURED", F.col("outcome") == "not_measured", F.col("rule_id"))
    if reference is None:
        out = out.union(said(counted, "BASELINE_UNAVAILABLE", F.lit(True)))
    out = out.union(said(counted, "RUN_DURATION_NOT_RECORDED", F.col("timed") < F.col("runs"))).union(said(counted, "RUN_RETRIES_NOT_RECORDED", F.col("with_retries") < F.col("runs")))
    names = {"run.duration_ms": "LATENCY_REGRESSION_NOT_MEASURED", "gen_ai.usage.total_tokens": "TOKEN_REGRESSION_NOT_MEASURED", "agent.retry.count": "RETRY_CHANGE_NOT_MEASURED"}
    open_ = changes_from(counted, reference).where("change IS NULL")
    return out.union(open_.select("release", F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("metric")), F.lit(None).cast("string")))


def decisions(counted: DataFrame, found: DataFrame) -> DataFrame:
    """release, decision (the gravest finding's, else pass), exit_code and n_findings."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, DECISIONS)), c)
    worst = found.groupBy("release").agg(F.max(rank(F.col("decision"))).alias("rank"), F.count("*").alias("n_findings"))
    met = counted.select("release").join(worst, "release", "left")
    decision = F.element_at(F.array(*map(F.lit, DECISIONS)), F.coalesce("rank", F.lit(1)).cast("int"))
    codes = F.create_map(*(F.lit(x) for kv in EXIT_CODES.items() for x in kv))
    return met.select("release", decision.alias("decision"), F.element_at(codes, decision).alias("exit_code"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def evidence(runs: DataFrame, violations: DataFrame, zero_tolerance: list[str] = (), most: int = 5) -> DataFrame:
    """What a release's decision rests on: release, failing and passing (up to `most` traces each, by id; every run that does not pass is
    failing), violated_rules, those of them without tolerance, and the fingerprints observed."""
    salt = F.pmod(F.xxhash64("trace_id"), F.lit(64))  # the first of each part, then of those: a release is never sorted as a whole
    side = runs.select("release", "trace_id", F.when(F.col("status") == "pass", "passing").otherwise("failing").alias("side"), salt.alias("salt"))
    first = side.withColumn("_n", F.row_number().over(Window.partitionBy("release", "side", "salt").orderBy("trace_id"))).where(F.col("_n") <= most)
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("release", "side").orderBy("trace_id"))).where(F.col("_n") <= most)
    listed = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("trace_id")))).alias(s)
    traces = first.groupBy("release").agg(listed("failing"), listed("passing"))
    rules = violations.select("trace_id", "rule_id").join(runs.select("trace_id", "release"), "trace_id").groupBy("release").agg(F.array_sort(F.collect_set("rule_id")).alias("violated_rules"))
    routes = runs.select("release", "fingerprint").distinct().groupBy("release").agg(F.array_sort(F.collect_list("fingerprint")).alias("fingerprints"))
    met = traces.join(routes, "release", "left").join(rules, "release", "left").withColumn("violated_rules", F.coalesce("violated_rules", F.array().cast("array<string>")))
    intolerable = F.array_intersect("violated_rules", F.array(*map(F.lit, sorted(zero_tolerance))).cast("array<string>"))
    return met.select("release", "failing", "passing", "violated_rules", intolerable.alias("zero_tolerance_rules"), F.coalesce("fingerprints", F.array().cast("array<string>")).alias("fingerprints"))


def decision_hash(counted: DataFrame, found: DataFrame, disclosed: DataFrame | None = None, budgets: DataFrame | None = None, rests_on: DataFrame | None = None) -> DataFrame:
    """release, document and `hash`: SHA-256 of a release's decision as JSON: all counts, findings, and where they are given disclosures, release rules and
    evidence. Lists are in order and keys too, so that an unchanged release has one hash however often, and in what order, it is counted."""
    listed = lambda df, name: df.groupBy("release").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*sorted(c for c in df.columns if c != "release")), {"ignoreNullFields": "false"}))).alias(name))
    met = counted.select("release", F.struct(*sorted(c for c in counted.columns if c != "release")).alias("counts"))
    parts = {"budgets": budgets, "disclosures": disclosed, "findings": found}
    for name, df in parts.items():
        if df is not None:
            met = met.join(listed(df, name), "release", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    if rests_on is not None:
        met = met.join(rests_on.select("release", F.struct(*sorted(c for c in rests_on.columns if c != "release")).alias("evidence")), "release", "left")
    document = F.to_json(F.struct(*sorted(met.columns)), {"ignoreNullFields": "false"})
    return met.select("release", document.alias("document"), F.sha2(document, 256).alias("hash"))

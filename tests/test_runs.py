"""Trees, routes, rules and releases over small runs."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from routeledger.functions import exact, names, redact
from routeledger.operators import canonical, diff, features, graph, mine, release, rules, selectors
from routeledger.operators.evaluate import evaluate
from routeledger.plans import contract
from routeledger.sources import spans as source

STEPS = [("a", None, "start", "Server"), ("b", "a", "look.up", "Client"), ("c", "b", "look.handler", "Server"), ("d", "a", "pay.out", "Client")]
EFFECTS = {"pay.out": "write", "look.up": "read"}


def rows(trace="t", steps=STEPS, **more):
    return [{"trace_id": trace, "span_id": s, "parent_span_id": p, "name": n, "kind": k, "start_ns": i, "duration_ns": 5_000_000, "service": "svc", "side_effect": EFFECTS.get(n, "none"), **more} for i, (s, p, n, k) in enumerate(steps)]


def spans(spark, *runs):
    return source.as_spans(spark.createDataFrame([r for run in runs for r in run], source.SCHEMA))


def quality(spark, run, root="start"):
    t = graph.build(spans(spark, run), root).traces.first()
    return t["quality"], sorted(w["kind"] for w in t["warnings"] or [])


def test_config_hash():
    assert names.DEFAULT.hash() == "57dee0d05549eebd8ec0e851e567de12eb5fd86a759b53f2a67d287da3cc313f"


@pytest.mark.parametrize("raw, want", [
    ("  order/123/x ", "order/{id}/x"), ("run_ab", "run_{id}"), ("run_", "run_"), ("a-1-b", "a-1-b"), ("550e8400-e29b-41d4-a716-446655440000", "{id}"),
    ("01ARZ3NDEKTSV4RRFFQ69G5FAV", "{id}"), ("x:0123456789abcdef", "x:{id}"), ("é", "é"),
])
def test_names(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(names.normalised_name(F.col("x"))).first()[0] == want


def test_quality(spark):
    assert quality(spark, rows()) == ("complete", ["client_span_without_server_span"])
    assert quality(spark, rows(steps=[*STEPS, ("e", "gone", "lost", None)]))[0] == "incomplete"
    assert quality(spark, rows(steps=[*STEPS, ("e", "f", "x", None), ("f", "e", "y", None)])) == ("inconsistent", ["client_span_without_server_span", "cycle_detected"])
    assert quality(spark, [*rows(), {**rows()[0], "name": "other"}])[0] == "inconsistent"
    assert quality(spark, [*rows(), rows()[1]])[0] == "complete"
    assert quality(spark, [{**rows()[0], "span_id": None}])[0] == "empty"


def fingerprint(spark, run):
    g = graph.build(spans(spark, run), "start")
    return canonical.fingerprints(canonical.ordered(g)).first()["fingerprint"]


def test_fingerprint_ignores_ids_and_order(spark):
    base = fingerprint(spark, rows())
    shuffled = rows()
    random.Random(3).shuffle(shuffled)
    renamed = [{**r, "span_id": "z" + r["span_id"], "parent_span_id": r["parent_span_id"] and "z" + r["parent_span_id"]} for r in shuffled]
    assert fingerprint(spark, renamed) == base
    assert fingerprint(spark, rows(steps=[*STEPS, ("e", "a", "more", None)])) != base


def test_deep_chain(spark):
    n = 10_000
    chain = [(f"s{i:05}", f"s{i - 1:05}" if i else None, f"n{i % 7}", None) for i in range(n)]
    random.Random(2).shuffle(chain)
    g = graph.build(spans(spark, rows(steps=chain)), "n0")
    places = canonical.ordered(g).select("span_id", "depth", "order").collect()
    assert len(places) == n and all(r["depth"] == r["order"] == int(r["span_id"][1:]) for r in places)
    assert canonical.ancestors(g.nodes, g.nodes.where("span_id = 's09999'")).count() == n
    far = canonical.nearest_above(g.nodes, {"six": F.col("label") == "n6"}).where("span_id = 's09999'").first()
    assert far["six"] == 4  # 9995 is the nearest above
    assert canonical.fingerprints(canonical.ordered(g)).count() == 1


def brute_force_places(run):
    """order by span of a tree, by recursion over the same texts."""
    below = {}
    for r in run:
        below.setdefault(r["up"], []).append(r)

    def digest(r):
        parts = sorted(digest(c)[0] for c in below.get(r["span_id"], []))
        text = r["text"] + "".join(f"|{p}" for p in parts)
        return hashlib.sha256(text.encode()).hexdigest(), r["span_id"]

    out, waiting = [], [r for r in run if r["up"] is None and r["order"] == 0]
    while waiting:
        r = waiting.pop()
        out.append(r["span_id"])
        waiting += sorted(below.get(r["span_id"], []), key=digest, reverse=True)
    return out


def test_random_trees_against_brute_force(spark):
    rng = random.Random(9)
    runs = []
    for t in range(25):
        n = rng.randint(1, 25)
        steps = [(f"s{i}", None if i == 0 else f"s{rng.randrange(i)}", rng.choice(["a", "b", "c.d"]), rng.choice(["Client", "Server", None])) for i in range(n)]
        steps += [("lost", "gone", "a", None)] if t % 5 == 0 else []
        rng.shuffle(steps)
        runs.append(rows(f"t{t}", steps))
    g = graph.build(spans(spark, *runs), None)
    texts = g.nodes.withColumn("label_text", graph.node_label()).withColumn("text", F.concat(F.length("label_text").cast("string"), F.lit(":"), "label_text"))
    for t in range(25):
        own = [r.asDict() for r in texts.where(F.col("trace_id") == f"t{t}").collect()]
        got = [r["span_id"] for r in sorted((r for r in own if r["order"] is not None), key=lambda r: r["order"])]
        assert got == brute_force_places(own)
        for r in own:
            inside = [x for x in own if r["pre"] < x["pre"] <= r["last"]]
            up = {x["span_id"]: x["up"] for x in own}

            def above(x, up=up):
                while (x := up[x]) is not None:
                    yield x

            assert {x["span_id"] for x in inside} == {x["span_id"] for x in own if r["span_id"] in set(above(x["span_id"]))}


RULES = [
    {"id": "need", "type": "required_span", "selector": {"name": "look.up"}, "cardinality": {"min": 1, "max": 1}, "severity": "critical"},
    {"id": "one", "type": "cardinality", "selector": {"name": "pay.out", "attributes": {"agent.side_effect": "write"}}, "min": 0, "max": 1, "scope": "run", "severity": "critical"},
    {"id": "edge", "type": "required_edge", "from": {"name": "look.up"}, "to": {"name": "look.handler"}, "relationship": "direct", "severity": "high"},
    {"id": "under", "type": "required_ancestry", "ancestor": {"name": "start"}, "descendant": {"name": "pay.out"}, "relationship": "any_depth", "severity": "high"},
    {"id": "path", "type": "forbidden_path", "from": {"name": "look.up"}, "to": {"name": "pay.out"}, "severity": "high"},
    {"id": "token", "type": "numeric_budget", "metric": "gen_ai.usage.output_tokens", "aggregation": "sum", "max": 5, "scope": "run", "severity": "low"},
]
DOC = {"apiVersion": "v1", "kind": "TrajectoryContract", "metadata": {"id": "x"}, "spec": {"selectors": {"rootSpan": "start"}, "rules": RULES, "gate": {"minCompletedRuns": 1, "maxViolationPercent": 10, "zeroToleranceRuleIds": ["need"]}}}


def outcomes(e, trace):
    return {r["rule_id"]: (r["outcome"], r["code"]) for r in e.results.where(F.col("trace_id") == trace).collect()}


def test_rules_and_release(spark):
    bad = rows("bad", [("a", None, "start", "Server"), ("d", "a", "pay.out", None), ("e", "a", "pay.out", None)], release="r2")
    lost = rows("lost", [("a", None, "start", "Server"), ("b", "gone", "pay.out", None)], release="r1")
    e = evaluate(spans(spark, rows("good", release="r1", output_tokens=1), bad, lost), DOC)
    good = outcomes(e, "good")
    assert {k: v[0] for k, v in good.items()} == {"need": "pass", "one": "pass", "edge": "pass", "under": "pass", "path": "pass", "token": "pass"}
    assert outcomes(e, "bad")["need"] == ("violation", "REQUIRED_SPAN_MISSING") and outcomes(e, "bad")["one"] == ("violation", "CARDINALITY_ABOVE_MAX")
    assert outcomes(e, "bad")["token"] == ("insufficient_evidence", "metric_not_emitted")
    assert outcomes(e, "lost")["need"] == ("insufficient_evidence", "trace_incomplete") and outcomes(e, "lost")["under"] == ("insufficient_evidence", "trace_incomplete")
    counted = release.counts(e.runs, e.violations)
    found = release.findings(counted, e.violations, e.runs, release.release_budgets(e.results, e.runs, RULES), DOC["spec"]["gate"])
    assert {r["release"]: (r["decision"], r["exit_code"]) for r in release.decisions(counted, found).collect()} == {"r1": ("insufficient_data", 3), "r2": ("fail", 2)}


def test_similarity_and_diff(spark):
    g = graph.build(spans(spark, rows("x"), rows("y", STEPS[:3])), "start")
    placed = canonical.ordered(g)
    own = features.features(g, placed)
    near = features.nearest(own, own.where("trace_id = 'x'").select(F.lit("f").alias("fingerprint"), "feature", "weight"))
    found = {r["trace_id"]: (r["shared"], r["either"]) for r in near.collect()}
    assert found["x"][0] == found["x"][1] and 0 < found["y"][0] < found["y"][1] == found["x"][1]
    side = lambda t: placed.where(F.col("trace_id") == t)
    kinds = [r["kind"] for r in diff.changes(side("x"), side("y"), diff.labeled_edges(side("x"), g.edges), diff.labeled_edges(side("y"), g.edges)).collect()]
    assert sorted(kinds) == ["edge_removed", "node_removed"]


def test_exact_numbers(spark):
    df = spark.createDataFrame([(1, 3), (0, 5), (2, 1), (7, 0)], "n bigint, d bigint")
    assert [r[0] for r in df.select(exact.decimal6(F.col("n"), F.col("d"))).collect()] == ["0.333333", "0.000000", "2.000000", None]
    assert exact.fraction("0.5") == (5, 10) and exact.fraction(1) == (1, 1)
    with pytest.raises(ValueError):
        exact.fraction("0.1234567")
    values = spark.createDataFrame([(i,) for i in range(1, 21)], "v bigint").agg(exact.percentile("v", 95)).first()[0]
    assert values == 19 and names.margin_up(101, 50) == 152


def test_absent_values(spark):
    df = spark.createDataFrame([({"k": "number:1"},), ({},)], "attributes map<string,string>")
    got = lambda op, x=None: [r[0] for r in df.select(selectors.condition(selectors.field("k"), op, x)).collect()]
    assert got("equals", 1) == [True, False] and got("equals", "1") == [False, False] and got("not_equals", 1) == [False, True]
    assert got("in", [1, 2]) == [True, False] and got("not_in", [1]) == [False, True] and got("exists") == [True, False]


def test_patterns(spark):
    df = spark.createDataFrame([("ab\n",), ("ab",), ("a&&b",)], "x string")
    got = lambda p: [r[0] for r in df.select(selectors.matches(F.col("x"), p)).collect()]
    assert got("ab$") == [False, True, False] and got("[a&&b]+$") == [False, True, True]
    assert selectors.check_pattern("(?=a)") and selectors.check_pattern("a*?") and not selectors.check_pattern("a+(b|c)")


def test_contract_documents():
    text = contract.yaml.safe_dump(DOC)
    assert contract.content_hash(contract.load(text)) == contract.content_hash(DOC)
    assert contract.content_hash(contract.load(contract.dump(DOC))) == contract.content_hash(DOC)
    assert contract.edited(DOC, maxViolationPercent=2)["spec"]["gate"]["maxViolationPercent"] == 2
    assert contract.moved("draft", "approved") == "approved"
    with pytest.raises(contract.ContractError):
        contract.moved("draft", "active")


@pytest.mark.parametrize("text, code", [
    ("a: &x 1", "YAML_ANCHOR_FORBIDDEN"), ("a: !!str x", "YAML_TAG_FORBIDDEN"), ("[" * 40 + "]" * 40, "YAML_TOO_DEEP"), ("", "SOURCE_EMPTY"), ("a: " + "x" * 300_000, "SOURCE_TOO_LARGE"),
    ("\n" * 9000 + "a: 1", "SOURCE_TOO_MANY_LINES"), ("a: 1\na: 2", "YAML_DUPLICATE_KEY"), ("a: 1\n---\nb: 2", "YAML_MULTIPLE_DOCUMENTS"), ("a: [", "YAML_MALFORMED"), ("a: *x", "YAML_ALIAS_FORBIDDEN"), ("7", "INVALID_TYPE"),
])
def test_sources_of_contracts_that_are_refused(text, code):
    with pytest.raises(contract.ContractError) as e:
        contract.load(text)
    assert e.value.codes == [code]


@pytest.mark.parametrize("change, code", [
    (lambda d: d.update(kind="x"), "UNKNOWN_KIND"), (lambda d: d.update(apiVersion="?"), "UNKNOWN_API_VERSION"), (lambda d: d.update(more=1), "UNKNOWN_FIELD"),
    (lambda d: d["spec"]["rules"].append({"type": "odd"}), "UNKNOWN_RULE_TYPE"), (lambda d: d["spec"]["rules"][0].pop("selector"), "REQUIRED"), (lambda d: d["spec"]["rules"][0].update(selector=3), "INVALID_TYPE"),
    (lambda d: d["spec"]["rules"][0].update(severity="odd"), "INVALID_ENUM"), (lambda d: d["metadata"].update(version="1"), "INVALID_FORMAT"), (lambda d: d["spec"]["rules"][0].update(id="No Id"), "INVALID_IDENTIFIER"),
    (lambda d: d["spec"]["rules"][1].update(min=4), "INVALID_RANGE"), (lambda d: d["spec"]["rules"][1].update(max=1.5), "INVALID_NUMBER"), (lambda d: d["spec"]["rules"][0].update(description="x" * 2000), "STRING_TOO_LONG"),
    (lambda d: d["spec"]["rules"].append({"id": "v", "type": "allowed_values", "field": "service.name", "values": [], "severity": "low"}), "LIST_EMPTY"),
    (lambda d: d["spec"]["rules"].append({"id": "v", "type": "allowed_values", "field": "service.name", "values": list(range(300)), "severity": "low"}), "LIST_TOO_LONG"),
    (lambda d: d["spec"]["rules"].append({"id": "v", "type": "allowed_values", "field": "service.name", "values": ["a", "a"], "severity": "low"}), "DUPLICATE_VALUE"),
    (lambda d: d["spec"].update(rules=[d["spec"]["rules"][0]] * 600), "TOO_MANY_RULES"), (lambda d: d["spec"]["rules"].append(d["spec"]["rules"][0]), "DUPLICATE_RULE_ID"),
    (lambda d: d["spec"]["rules"][0].update(selector={}), "EMPTY_SELECTOR"), (lambda d: d["spec"]["rules"][0].update(selector={"namePattern": "(?=a)"}), "INVALID_PATTERN"),
    (lambda d: d["spec"]["rules"].append({"id": "no", "type": "forbidden_span", "selector": {"name": "look.up"}, "severity": "high"}), "CONTRADICTORY_RULES"),
    (lambda d: d["spec"]["rules"].append({"id": "two", "type": "cardinality", "selector": {"name": "look.up"}, "min": 2, "scope": "run", "severity": "high"}), "CONTRADICTORY_RULES"),
    (lambda d: d["spec"]["gate"].update(zeroToleranceRuleIds=["none"]), "UNKNOWN_RULE_REFERENCE"), (lambda d: d["spec"]["gate"].update(maxViolationPercent=0.1234567), "INVALID_NUMBER"),
    (lambda d: d["spec"].update(approvedRoutes=["a" * 64], rules=[*d["spec"]["rules"], {"id": "r", "type": "approved_routes", "fingerprints": ["b" * 64], "severity": "high"}]), "UNKNOWN_ROUTE_REFERENCE"),
])
def test_faults_of_contracts(change, code):
    doc = json.loads(json.dumps(DOC))
    assert contract.validate(doc) == []
    change(doc)
    assert code in {fault.split(": ")[1] for fault in contract.validate(doc)}


def test_mining(spark):
    many = [[r | {"run_id": f"run{i}", "operation": "op", "retry_number": 0, "output_tokens": 5} for r in rows(f"t{i}", release="r1")] for i in range(4)]
    other = rows("u", release="r2", run_id="x")
    all_spans = spans(spark, *many, other, [r | {"run_id": "run0"} for r in rows("t9", release="r1")], rows("v", release="r1"))
    chosen = mine.Selection("p", "a", "r1", "start", 0, 10**12, minimum_runs=2)
    first = mine.mine(all_spans, chosen, "x")
    assert first["status"] == "pending_review" and {r["reason"]: r["runs"] for r in first["tally"].collect()} == {"RUN_ID_MISSING": 1, "DUPLICATE_RUN": 1}
    assert first["disclosures"] == [("TRACES_EXCLUDED", 2)]
    few = mine.mine(all_spans, chosen._replace(most_traces=3, minimum_runs=50), "x", unverified=["x.y"])
    assert few["status"] == "dataset_truncated" and few["disclosures"] == [("DATASET_TRUNCATED", 3), ("FIELD_TYPE_UNVERIFIED", 1)] and few["baseline"] != first["baseline"]
    said = '["p","a","r1",null,0,1000000000000,2,"start",true,true,[1,20],1000,10000,3]'
    assert first["baseline"] == "bl-" + hashlib.sha256(said.encode()).hexdigest()[:32]
    route = first["families"].first()["fingerprint"]
    assert first["families"].first()["family_id"] == "rf-" + hashlib.sha256(f"{first['baseline']}|{route}".encode()).hexdigest()[:32]
    found = mine.mine(all_spans, chosen, "x", decisions={route: "approved"})
    draft = found["draft"]
    disclosed = draft.pop("disclosures")
    kinds = {r["type"] for r in draft["spec"]["rules"]}
    assert contract.validate(draft) == [] and mine.representatives(first["runs"]).count() == 3
    assert kinds == {"required_span", "required_edge", "cardinality", "required_ancestry", "allowed_values", "retry_budget", "approved_routes", "numeric_budget"}
    assert "BUDGET_NOT_PROPOSED:gen_ai.usage.input_tokens" in disclosed and first["baseline"] == found["baseline"]
    assert draft["spec"]["gate"]["zeroToleranceRuleIds"] == sorted(r["id"] for r in draft["spec"]["rules"] if r["severity"] == "critical")
    assert evaluate(spans(spark, *many), draft).runs.where("status = 'pass'").count() == 4
    with pytest.raises(ValueError):
        mine.decided(first["families"], {"none": "approved"})
    for wrong in ({"project": "P"}, {"end_ms": 0}, {"minimum_runs": 0}, {"rare": "1.5"}, {"root": ""}, {"representatives": 51}):
        with pytest.raises(ValueError):
            mine.selected(chosen._replace(**wrong))
    two = found["families"].select("fingerprint").withColumn("status", F.lit("approved")).union(spark.createDataFrame([("a", "approved"), ("b", "pending")], "fingerprint string, status string"))
    assert mine.proposal_disclosures(two) == [("MULTIPLE_FAMILIES_APPROVED", 2), ("UNAPPROVED_FAMILY_PRESENT", 1)]
    assert mine.baseline_disclosures("insufficient_runs", two.withColumn("rare", F.lit(True)), first["tally"].limit(0), 0) == [("INSUFFICIENT_RUNS", 0), ("RARE_FAMILY_PRESENT", 3)]


def test_labels_that_a_run_may_hide(spark):
    # In the second run the server span of look.up is missing, so look.handler may have been there.
    e = graph.build(spans(spark, rows("x"), rows("y", [STEPS[0], STEPS[1], STEPS[3]])), "start")
    got = {r["label"]: r for r in mine.label_statistics(e.nodes, e.traces, diff.labeled_edges(e.nodes, e.edges)).collect()}
    assert (got["look.handler"]["present"], got["look.handler"]["observable"], got["look.handler"]["presence"], got["look.handler"]["remote_handler"]) == (1, 1, "always", True)
    assert got["look.up"]["unobservable"] == 0 and not got["pay.out"]["remote_handler"]


def test_retry_budget_has_a_violation_for_each_way(spark):
    steps = [("a", None, "start", None), ("b", "a", "one", None), ("c", "a", "two", None), ("d", "a", "pay.out", None), ("e", "a", "odd", None)]
    run = rows("t", steps)
    for r, retry, effect in zip(run, (None, 3, 4, 2, 1), ("none", "read", "read", "write", None), strict=True):
        r["retry_number"], r["side_effect"] = retry, effect
    rule = {"id": "r", "type": "retry_budget", "selector": {"service": "svc"}, "maxPerTool": 2, "maxRunTotal": 9, "sideEffectMax": 0, "severity": "high"}

    def said(run, **more):
        g = graph.build(spans(spark, run), "start")
        return [(r["outcome"], r["code"], r["detail"], r["value"]) for r in rules.evaluate_rules(g, g.nodes, [rule | more]).collect()]

    assert sorted(said(run)) == sorted([
        ("violation", "RETRY_BUDGET_PER_TOOL_EXCEEDED", "one", 3), ("violation", "RETRY_BUDGET_PER_TOOL_EXCEEDED", "two", 4), ("violation", "RETRY_BUDGET_RUN_TOTAL_EXCEEDED", None, 10),
        ("violation", "RETRY_BUDGET_SIDE_EFFECT_EXCEEDED", "side-effect:pay.out", 2),
    ])
    assert said([r | {"retry_number": None} for r in run]) == [("insufficient_evidence", "attribute_not_emitted", None, None)]
    assert said(run, maxPerTool=9, maxRunTotal=99, sideEffectMax=3) == [("pass", None, None, 10)]
    unknown = [r | {"side_effect": None} for r in run]
    assert [x[:2] for x in said(unknown, maxPerTool=9, maxRunTotal=99, sideEffectMax=3)] == [("insufficient_evidence", "side_effect_unclassified")]


def test_side_effects_that_are_new_are_changes(spark):
    g = graph.build(spans(spark, rows("x", STEPS[:3]), rows("y")), "start")
    side = lambda t: g.nodes.where(F.col("trace_id") == t)
    found = diff.changes(side("x"), side("y"), diff.labeled_edges(side("x"), g.edges), diff.labeled_edges(side("y"), g.edges), ["f"], "g").collect()
    assert ("side_effect_duplicated", "pay.out|write", 0, 1, "structural") in [tuple(r) for r in found] and ("route_unknown", "g", None, None, "structural") in [tuple(r) for r in found]


def test_similarity_without_overlap(spark):
    own = spark.createDataFrame([("t", "a", 2), ("u", "c", 1)], "trace_id string, feature string, weight int")
    families = spark.createDataFrame([("f2", "c", 1), ("f1", "d", 4)], "fingerprint string, feature string, weight int")
    assert {tuple(r) for r in features.nearest(own, families).collect()} == {("t", "f1", 0, 6), ("u", "f2", 1, 1)}


def test_nearest_against_brute_force(spark):
    from fractions import Fraction

    rng = random.Random(12)
    weights = {f"f{i}": rng.choice([1, 2, 3, 5]) for i in range(60)}
    draw = lambda: {"f0", "f1", *rng.sample(sorted(weights), rng.randint(1, 12))} if rng.random() < 0.95 else {f"only{rng.randrange(9)}"}
    runs = {f"t{i:03}": draw() for i in range(150)}
    families = {f"g{i:03}": rng.choice([draw, lambda: set(rng.choice(list(runs.values())))])() for i in range(120)}
    weight = lambda s: sum(weights.get(f, 1) for f in s)
    table = lambda sets, key: spark.createDataFrame([(k, f, weights.get(f, 1)) for k, s in sets.items() for f in sorted(s)], f"{key} string, feature string, weight int")
    own, theirs = table(runs, "trace_id"), table(families, "fingerprint")
    got = {r["trace_id"]: tuple(r)[1:] for r in features.nearest(own, theirs).collect()}
    for t, s in runs.items():
        _, f = min((-Fraction(weight(s & g), weight(s | g)), f) for f, g in families.items())
        assert got[t] == (f, weight(s & families[f]), weight(s | families[f]))
    _, sets, groups = features.distinct_sets(own, theirs)
    pairs = features.candidates(sets, groups).count()
    assert pairs < 0.35 * sets.count() * groups.count()
    assert features.nearest(own, theirs.limit(0)).count() == 0
    both = features.similarity(own.where("trace_id = 't001'"), theirs).collect()
    assert all(abs(r["jaccard"] - r["shared"] / r["either"]) < 1e-12 for r in both)


def test_features_by_kind(spark):
    g = graph.build(spans(spark, rows("x")), "start")
    got = {tuple(r)[1:] for r in features.features(g, canonical.ordered(g), ["search"]).collect()}
    kinds = {f.split(":")[0]: w for f, w in got}
    assert all(features.WEIGHTS[k] == w for k, w in kinds.items()) and any(f.startswith("sideEffectNode:") and f.endswith(("|write", "|external")) for f, _ in got)


def test_state_of_a_release(spark):
    e = evaluate(spans(spark, rows("good", release="r1", output_tokens=1)), DOC)
    counted, budgets = release.counts(e.runs, e.violations), release.release_budgets(e.results, e.runs, RULES)
    codes = lambda **state: [r["finding"] for r in release.findings(counted, e.violations, e.runs, budgets, DOC["spec"]["gate"], None, release.State(**state)).orderBy("place").collect()]
    assert codes() == []
    assert codes(contract_state="draft", same_contract=False, truncated=True, completed_ms=None, now_ms=10_000_000) == ["CONTRACT_NOT_ACTIVE", "CONTRACT_MISMATCH", "RETRIEVAL_TRUNCATED", "EVALUATION_INCOMPLETE", "AGGREGATION_STALE"]
    assert codes(started_ms=0, completed_ms=601_000) == ["EVALUATION_TIMED_OUT"]
    found = release.findings(counted, e.violations, e.runs, budgets, DOC["spec"]["gate"] | {"maxLatencyRegressionPercent": 20, "maxTokenRegressionPercent": 20}, release.Reference(latency_p95_ms=4, tokens_p95=1))
    assert {r["finding"] for r in found.collect()} == {"LATENCY_REGRESSION_EXCEEDED", "TOKEN_REGRESSION_EXCEEDED"}
    assert release.decision_hash(counted, found).first()["hash"] != release.decision_hash(counted, found.limit(1)).first()["hash"]
    assert {r["disclosure"] for r in release.disclosures(counted, budgets, release.Reference(4, 4, 0)).collect()} == {"RETRY_CHANGE_NOT_MEASURED"}


def test_selectors_of_side_effects():
    pins = selectors.pins_side_effect
    assert pins({"attributes": {"agent.side_effect": "write"}}) and not pins({"attributes": {"agent.side_effect": "read"}}) and not pins({"name": "x"})
    assert pins({"attributes": [{"key": "agent.side_effect", "operator": "in", "value": ["write", "external"]}]})
    assert not pins({"attributes": {"agent.side_effect": {"operator": "in", "values": ["write", "none"]}}})


def test_lists_and_redaction(spark):
    df = spark.createDataFrame([(["string:a"],), (["string:a", "string:b"],)], "x array<string>")
    got = lambda op, x: [r[0] for r in df.select(selectors.condition(selectors.list_value(F.col("x")), op, x)).collect()]
    assert got("equals", "a") == [True, False] and got("in", ["b"]) == [False, True] and got("not_in", ["b"]) == [True, False] and got("matches", "a") == [False, False]
    doc = {"apiKey": "x", "tokens": 3, "deep": [{"Password": 1, "note": "a long-secret b"}]}
    assert redact.redacted(doc, ["long-secret", "b"]) == {"apiKey": "[redacted]", "tokens": 3, "deep": [{"Password": "[redacted]", "note": "a [redacted] b"}]}
    nodes = graph.build(spans(spark, rows(extra={"x.secret": "string:s"})), "start").nodes
    document = json.loads(redact.exported(nodes).first()["document"])
    assert [(e["from"] < e["to"], e["type"]) for e in document["edges"]] == [(True, "parent")] * 3
    assert [n["order"] for n in document["nodes"]] == [0, 1, 2, 3] and document["nodes"][0]["attributes"]["x.secret"] == "[redacted]"


def test_sources(spark, tmp_path):
    capture = {"rows": [{"data": {"trace_id": "t", "span_id": "a", "name": "start", "duration_nano": 5, "agent.retry.number": 1, "flag": True}, "timestamp": "2026-01-01T00:00:00.001Z"}]}
    (tmp_path / "c.json").write_text(json.dumps(capture))
    row = source.read_capture(spark, str(tmp_path / "c.json")).first()
    assert row["start_ns"] == 1767225600001000000 and row["retry_number"] == 1 and row["extra"] == {"flag": "boolean:true"}
    df = spans(spark, rows(), rows("u"))
    assert source.verify_types(df.withColumn("kind", F.lit(1)).drop("tool"))["mismatched"] == ["kind"]
    page = source.search(df, F.col("name") == "start", ["trace_id"], 0, 10, 1, 1)
    assert [r["trace_id"] for r in page.collect()] == ["u"] and source.discover(df.withColumn("release", F.lit("r")), "start", "r", 1)[1]
    extra = spark.createDataFrame([("t", {"k": "string:1"}), ("u", {"k": "number:1"})], "trace_id string, extra map<string,string>")
    assert source.untrusted_fields(extra, {"k": "number"}).collect()[0]["trace_id"] == "t"
    logs = spark.createDataFrame([("t", "x" * 3000), ("z", "y")], "trace_id string, body string")
    assert [len(r["body"]) for r in source.logs_of(logs, df).collect()] == [2000]
    series = spark.createDataFrame([([([([("a", "b")], [(1, 2.0), (2, 3.0)])],)],)], "results array<struct<series: array<struct<labels: array<struct<key: string, value: string>>, values: array<struct<ts: bigint, value: double>>>>>>")
    assert [(r["labels"], r["ts"], r["value"]) for r in source.metric_points(series).collect()] == [({"a": "b"}, 1, 2.0), ({"a": "b"}, 2, 3.0)]
    assert sorted(r["trace_id"] for r in source.read_spans(spark, _saved(df, tmp_path)).collect()) == ["t"] * 4 + ["u"] * 4


def _saved(df, tmp_path):
    df.drop("extra").withColumnRenamed("service", "service.name").write.parquet(str(tmp_path / "spans"))
    return str(tmp_path / "spans")

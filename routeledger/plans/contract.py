"""Contracts: loading from YAML with limits, validation, content hash and lifecycle. All of it is small and on the driver."""

from __future__ import annotations

import copy
import hashlib
import re

import yaml

from routeledger.functions.exact import fraction
from routeledger.functions.names import canonical_json
from routeledger.operators.selectors import MAX_PATTERN, OPERATORS, check_pattern

#: Limits of a document.
MAX_BYTES, MAX_LINES, MAX_DEPTH, MAX_RULES = 256 << 10, 8000, 32, 500
MAX_ID, MAX_TEXT, MAX_VALUES, MAX_ATTRIBUTES, MAX_ROUTES, MAX_INTEGER = 128, 1024, 256, 32, 1000, 2**53 - 1
SEVERITIES = ("critical", "high", "medium", "low")
METRICS = ("run.duration_ms", "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens")
AGGREGATIONS = ("sum", "max", "avg", "p95", "p99")
#: Forms of ids, versions, attribute keys and fingerprints.
IDENTIFIER, VERSION = r"[a-z0-9][a-z0-9._-]*", r"(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(-[0-9A-Za-z.-]+)?"
ATTRIBUTE, FINGERPRINT = r"[A-Za-z][A-Za-z0-9._-]*", r"(sha256:)?[0-9a-f]{64}"
#: Kinds of the fields of a rule of each type; those with a question mark may be left out.
RULE_FIELDS = {
    "required_span": "selector:selector cardinality:window?", "cardinality": "selector:selector scope:scope min:count? max:count?", "forbidden_span": "selector:selector",
    "required_edge": "from:selector to:selector relationship:relationship", "required_ancestry": "ancestor:selector descendant:selector relationship:relationship",
    "forbidden_path": "from:selector to:selector unless:contains?", "allowed_values": "field:attribute values:values selector:selector?",
    "attribute_constraint": "selector:selector field:attribute operator:operator value:operand? values:values? pattern:pattern?",
    "retry_budget": "selector:selector maxPerTool:count maxRunTotal:count sideEffectMax:count", "approved_routes": "fingerprints:routes minSimilarity:share?",
    "numeric_budget": "metric:metric aggregation:aggregation max:count scope:scope",
}
GATE = ("minCompletedRuns", "evaluationTimeoutSeconds", "maxViolationPercent", "maxUnknownRoutePercent", "maxLatencyRegressionPercent", "maxTokenRegressionPercent", "zeroToleranceRuleIds")
#: Lifecycle of a contract.
MOVES = {"draft": ("approved", "invalid"), "approved": ("active", "invalid"), "active": ("superseded", "invalid"), "superseded": (), "invalid": ()}


class ContractError(ValueError):
    """All faults of a document, sorted, each as path, code and text."""

    def __init__(self, faults: list[str]):
        super().__init__("; ".join(sorted(faults)))
        self.faults = sorted(faults)

    @property
    def codes(self) -> list[str]:
        return [fault.split(": ", 2)[1] for fault in self.faults]


def load(text: str) -> dict:
    """A valid contract document from YAML without tags, anchors and aliases."""
    refuse = lambda code, why: ContractError([f"source: {code}: {why}"])
    if not text.strip():
        raise refuse("SOURCE_EMPTY", "no document")
    if len(text.encode()) > MAX_BYTES:
        raise refuse("SOURCE_TOO_LARGE", "document too large")
    if text.count("\n") >= MAX_LINES:
        raise refuse("SOURCE_TOO_MANY_LINES", "document too long")
    depth, documents, mappings = 0, 0, []
    try:
        for event in yaml.parse(text, Loader=yaml.SafeLoader):
            if isinstance(event, yaml.AliasEvent):
                raise refuse("YAML_ALIAS_FORBIDDEN", "aliases are not allowed")
            if getattr(event, "anchor", None):
                raise refuse("YAML_ANCHOR_FORBIDDEN", "anchors are not allowed")
            if getattr(event, "tag", None):
                raise refuse("YAML_TAG_FORBIDDEN", "tags are not allowed")
            documents += isinstance(event, yaml.DocumentStartEvent)
            if documents > 1:
                raise refuse("YAML_MULTIPLE_DOCUMENTS", "one document only")
            depth += isinstance(event, yaml.CollectionStartEvent) - isinstance(event, yaml.CollectionEndEvent)
            if depth > MAX_DEPTH:
                raise refuse("YAML_TOO_DEEP", "nested too deep")
        mappings.append(yaml.compose(text, Loader=yaml.SafeLoader))
        while mappings:
            node = mappings.pop()
            if isinstance(node, yaml.MappingNode):
                keys = [k.value for k, _ in node.value]
                if len(keys) != len(set(map(str, keys))):
                    raise refuse("YAML_DUPLICATE_KEY", "a key is given twice")
                mappings += [v for _, v in node.value]
            elif isinstance(node, yaml.SequenceNode):
                mappings += node.value
        doc = yaml.load(text, Loader=yaml.SafeLoader)
    except yaml.YAMLError as e:
        raise refuse("YAML_MALFORMED", f"no YAML: {e}") from e
    if faults := validate(doc):
        raise ContractError(faults)
    return doc


def dump(doc: dict) -> str:
    """YAML of a contract, proven by loading it again."""
    text = yaml.safe_dump(doc, sort_keys=False, allow_unicode=True)
    if content_hash(load(text)) != content_hash(doc):
        raise ContractError(["source: UNSUPPORTED_VALUE_TYPE: the document changes when it is written"])
    return text


class Checks:
    """Faults of a document, found field by field: a method for each kind of field, by its name."""

    def __init__(self) -> None:
        self.faults: list[str] = []

    def say(self, at: str, code: str, text: str) -> None:
        self.faults.append(f"{at}: {code}: {text}")

    def fields(self, value: dict, kinds: dict[str, str], at: str) -> None:
        """Known, needed and rightly typed fields; a kind that ends with a question mark is not needed."""
        for k in sorted(set(value) - set(kinds), key=str):
            self.say(f"{at}.{k}", "UNKNOWN_FIELD", "unknown")
        for name, kind in kinds.items():
            if name in value:
                getattr(self, kind.rstrip("?"))(value[name], f"{at}.{name}")
            elif not kind.endswith("?"):
                self.say(f"{at}.{name}", "REQUIRED", "missing")

    def of_type(self, value, kind: type | tuple, at: str) -> bool:
        good = isinstance(value, kind) and not (isinstance(value, bool) and kind is not bool)
        if not good:
            self.say(at, "INVALID_TYPE", f"no {kind.__name__ if isinstance(kind, type) else 'value of a known type'}")
        return good

    def text(self, value, at: str, most: int = MAX_TEXT) -> bool:
        if not self.of_type(value, str, at):
            return False
        if not value:
            self.say(at, "INVALID_FORMAT", "empty")
        elif len(value) > most:
            self.say(at, "STRING_TOO_LONG", f"more than {most} characters")
        return 0 < len(value) <= most

    def formed(self, value, at: str, form: str, code: str = "INVALID_IDENTIFIER", most: int = MAX_ID) -> None:
        if self.text(value, at, most) and not re.fullmatch(form, value):
            self.say(at, code, "not of the known form")

    def identifier(self, value, at: str) -> None:
        self.formed(value, at, IDENTIFIER)

    def attribute(self, value, at: str) -> None:
        self.formed(value, at, ATTRIBUTE)

    def version(self, value, at: str) -> None:
        self.formed(value, at, VERSION, "INVALID_FORMAT")

    def anything(self, value, at: str) -> None:
        pass

    def chosen(self, value, at: str, known: tuple) -> None:
        if self.of_type(value, str, at) and value not in known:
            self.say(at, "INVALID_ENUM", f"none of {', '.join(known)}")

    def severity(self, value, at: str) -> None:
        self.chosen(value, at, SEVERITIES)

    def scope(self, value, at: str) -> None:
        self.chosen(value, at, ("run", "release"))

    def relationship(self, value, at: str) -> None:
        self.chosen(value, at, ("direct", "any_depth"))

    def operator(self, value, at: str) -> None:
        self.chosen(value, at, OPERATORS)

    def metric(self, value, at: str) -> None:
        self.chosen(value, at, METRICS)

    def aggregation(self, value, at: str) -> None:
        self.chosen(value, at, AGGREGATIONS)

    def count(self, value, at: str, least: int = 0) -> None:
        if isinstance(value, float) and not value.is_integer() or isinstance(value, int) and abs(value) > MAX_INTEGER:
            self.say(at, "INVALID_NUMBER", "no exact whole number")
        elif self.of_type(value, (int, float), at) and value < least:
            self.say(at, "INVALID_RANGE", f"less than {least}")

    def share(self, value, at: str, most: float = 1) -> None:
        if not self.of_type(value, (int, float, str), at):
            return
        try:
            fraction(value)
        except (ValueError, ArithmeticError):
            self.say(at, "INVALID_NUMBER", "no decimal of at most six places")
            return
        if not 0 <= float(value) <= most:
            self.say(at, "INVALID_RANGE", f"not from 0 to {most}")

    def percent(self, value, at: str) -> None:
        self.share(value, at, 1000 if "Regression" in at else 100)

    def listed(self, value, at: str, most: int) -> bool:
        if not self.of_type(value, list, at):
            return False
        if not value:
            self.say(at, "LIST_EMPTY", "empty")
        elif len(value) > most:
            self.say(at, "LIST_TOO_LONG", f"more than {most} entries")
        elif len({canonical_json(_plain(v)) for v in value}) < len(value):
            self.say(at, "DUPLICATE_VALUE", "an entry is given twice")
        return bool(value)

    def scalar(self, value, at: str) -> None:
        if not isinstance(value, (str, bool, int, float)):
            self.say(at, "INVALID_TYPE", "no scalar")

    def values(self, value, at: str) -> None:
        if self.listed(value, at, MAX_VALUES):
            for i, v in enumerate(value):
                self.scalar(v, f"{at}[{i}]")

    def routes(self, value, at: str) -> None:
        if self.listed(value, at, MAX_ROUTES):
            for i, v in enumerate(value):
                self.formed(v, f"{at}[{i}]", FINGERPRINT, "INVALID_FORMAT")

    def some_routes(self, value, at: str) -> None:
        if value:
            self.routes(value, at)

    def some_ids(self, value, at: str) -> None:
        if value and self.listed(value, at, MAX_RULES):
            for i, v in enumerate(value):
                self.identifier(v, f"{at}[{i}]")

    def window(self, value, at: str) -> None:
        if self.of_type(value, dict, at):
            self.fields(value, {"min": "count?", "max": "count?"}, at)
            self.in_order(value, at)

    def in_order(self, value: dict, at: str) -> None:
        low, high = value.get("min", 0), value.get("max")
        if isinstance(low, int) and isinstance(high, int) and low > high:
            self.say(f"{at}.max", "INVALID_RANGE", "less than min")

    def pattern(self, value, at: str) -> None:
        if self.text(value, at, MAX_PATTERN):
            for x in check_pattern(value):
                self.say(at, "INVALID_PATTERN", x)

    def contains(self, value, at: str) -> None:
        if self.of_type(value, dict, at):
            self.fields(value, {"contains": "selector"}, at)

    def selector(self, value, at: str) -> None:
        if not self.of_type(value, dict, at):
            return
        if not value:
            self.say(at, "EMPTY_SELECTOR", "would match every span")
        self.fields(value, {"name": "text?", "namePattern": "pattern?", "service": "text?", "operation": "text?", "attributes": "conditions?"}, at)

    def conditions(self, value, at: str) -> None:
        """Conditions by key, or a list of them."""
        if not self.of_type(value, (dict, list), at):
            return
        if len(value) > MAX_ATTRIBUTES:
            self.say(at, "LIST_TOO_LONG", f"more than {MAX_ATTRIBUTES} conditions")
        each = [(c.get("key") if isinstance(c, dict) else None, c) for c in value] if isinstance(value, list) else value.items()
        for key, wanted in each:
            self.attribute(key, f"{at}.{key}")
            if isinstance(wanted, dict):
                self.condition(wanted, f"{at}.{key}", {"key": "attribute?", "operator": "operator", "value": "operand?", "values": "values?", "pattern": "pattern?"})
            else:
                self.scalar(wanted, f"{at}.{key}")

    def operand(self, value, at: str) -> None:
        self.values(value, at) if isinstance(value, list) else self.scalar(value, at)

    def condition(self, value: dict, at: str, kinds: dict[str, str] | None) -> None:
        """What an operator needs is there: a value, a list of values or a pattern."""
        if kinds:
            self.fields(value, kinds, at)
        operator = value.get("operator")
        given = next((value[k] for k in ("values", "pattern", "value") if k in value), None)
        if operator != "exists" and given is None:
            self.say(f"{at}.value", "REQUIRED", "missing")
        elif operator in ("in", "not_in") and not isinstance(given, list) or operator in ("equals", "not_equals") and isinstance(given, list):
            self.say(f"{at}.value", "INVALID_TYPE", "not what the operator takes")
        elif operator == "matches" and "pattern" not in value:
            self.pattern(given, f"{at}.value")


def validate(doc) -> list[str]:
    """Faults of a document, as path, code and text, sorted; none if it is valid."""
    c = Checks()
    if not c.of_type(doc, dict, "document"):
        return c.faults
    # Short documents for evaluation alone may leave out what says where they belong.
    c.fields(doc, {"apiVersion": "text?", "kind": "anything?", "metadata": "anything?", "spec": "anything"}, "document")
    if doc.get("kind", "TrajectoryContract") != "TrajectoryContract":
        c.say("document.kind", "UNKNOWN_KIND", "no contract")
    if "apiVersion" in doc and not re.fullmatch(r"([a-z0-9.-]+/)?v[0-9]+((alpha|beta)[0-9]+)?", str(doc["apiVersion"])):
        c.say("document.apiVersion", "UNKNOWN_API_VERSION", "unknown")
    meta = doc.get("metadata")
    if meta is not None and c.of_type(meta, dict, "metadata"):
        c.fields(meta, {"id": "identifier", "name": "text?", "version": "version?", "project": "identifier?", "agent": "identifier?", "environment": "identifier?", "createdAt": "anything?", "baselineRelease": "text?"}, "metadata")
    spec = doc.get("spec")
    if spec is None or not c.of_type(spec, dict, "spec"):
        return sorted(c.faults)
    c.fields(spec, {"selectors": "anything?", "approvedRoutes": "some_routes?", "rules": "anything?", "gate": "anything?"}, "spec")
    rules = spec.get("rules") or []
    if not c.of_type(rules, list, "spec.rules"):
        return sorted(c.faults)
    if len(rules) > MAX_RULES:
        c.say("spec.rules", "TOO_MANY_RULES", f"more than {MAX_RULES}")
        return sorted(c.faults)
    seen: set[str] = set()
    for i, rule in enumerate(rules):
        at = f"spec.rules[{i}]"
        if not c.of_type(rule, dict, at):
            continue
        if rule.get("type") not in RULE_FIELDS:
            c.say(f"{at}.type", "UNKNOWN_RULE_TYPE", "unknown")
            continue
        kinds = dict(f.split(":") for f in RULE_FIELDS[rule["type"]].split())
        c.fields(rule, {"id": "identifier", "type": "anything", "severity": "severity", "description": "text?"} | kinds, at)
        if rule["type"] == "cardinality":
            c.in_order(rule, at)
        if rule["type"] == "attribute_constraint":
            c.condition(rule, at, None)
        if rule["type"] == "numeric_budget" and rule.get("scope") == "run" and rule.get("aggregation") not in ("sum", "max"):
            c.say(f"{at}.aggregation", "INVALID_ENUM", "a run has only sum and max")
        if str(rule.get("id")) in seen:
            c.say(f"{at}.id", "DUPLICATE_RULE_ID", "repeated")
        seen.add(str(rule.get("id")))
    if not c.faults:
        _between_rules(c, rules, spec.get("approvedRoutes"))
    gate = spec.get("gate") or {}
    if c.of_type(gate, dict, "spec.gate"):
        c.fields(gate, dict.fromkeys(GATE[:2], "count?") | dict.fromkeys(GATE[2:6], "percent?") | {GATE[6]: "some_ids?"}, "spec.gate")
        for r in gate.get("zeroToleranceRuleIds") or []:
            if r not in seen:
                c.say("spec.gate.zeroToleranceRuleIds", "UNKNOWN_RULE_REFERENCE", f"no rule {r}")
    return sorted(c.faults)


def _between_rules(c: Checks, rules: list[dict], approved: list[str] | None) -> None:
    """Rules that can't both hold, and routes that are not approved."""
    at = {r["id"]: f"spec.rules[{i}]" for i, r in enumerate(rules)}
    of = lambda *kinds: [r for r in rules if r["type"] in kinds]
    key = lambda r: canonical_json(_plain(r["selector"]))
    if approved is not None:
        for r in of("approved_routes"):
            for f in set(r["fingerprints"]) - set(approved):
                c.say(f"{at[r['id']]}.fingerprints", "UNKNOWN_ROUTE_REFERENCE", f"{f} is not approved")
    window = lambda r: (r.get("cardinality") or {"min": 1}) if r["type"] == "required_span" else r
    forbidden = {key(r): r["id"] for r in of("forbidden_span")}
    for r in of("required_span"):
        if window(r).get("min", 1) > 0 and key(r) in forbidden:
            c.say(f"{at[r['id']]}.selector", "CONTRADICTORY_RULES", f"{r['id']} and {forbidden[key(r)]}: required and forbidden")
    windows: dict[str, list[dict]] = {}
    for r in of("required_span", "cardinality"):
        windows.setdefault(key(r), []).append(r)
    for same in windows.values():
        for i, x in enumerate(same):
            for y in same[i + 1 :]:
                a, b = window(x), window(y)
                if max(a.get("min", 0), b.get("min", 0)) > min(a.get("max", MAX_INTEGER), b.get("max", MAX_INTEGER)):
                    c.say(at[y["id"]], "CONTRADICTORY_RULES", f"{x['id']} and {y['id']}: disjoint windows")
    allowed = {r["field"]: r for r in of("allowed_values") if "selector" not in r}
    for r in of("attribute_constraint"):
        if r["operator"] == "equals" and r["field"] in allowed and canonical_json(r.get("value")) not in map(canonical_json, allowed[r["field"]]["values"]):
            c.say(f"{at[r['id']]}.value", "CONTRADICTORY_RULES", f"{allowed[r['field']]['id']} does not allow it")


def content_hash(doc: dict) -> str:
    """SHA-256 of what a contract says: without its name, date and descriptions; lists whose order says nothing are sorted."""
    said = copy.deepcopy(doc)
    for k in ("name", "createdAt"):
        said.get("metadata", {}).pop(k, None)
    spec = said["spec"]
    for rule in spec.get("rules", []):
        rule.pop("description", None)
        for k in ("values", "fingerprints"):
            if isinstance(rule.get(k), list):
                rule[k] = sorted(rule[k], key=lambda v: canonical_json(v))
    spec["rules"] = sorted(spec.get("rules", []), key=lambda r: r["id"])
    spec["approvedRoutes"] = sorted(spec.get("approvedRoutes") or [])
    if said.get("metadata", {}).get("createdAt") is not None:
        said["metadata"].pop("createdAt")
    return hashlib.sha256(canonical_json(_plain(said)).encode()).hexdigest()


def _plain(value):
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def moved(state: str, to: str, active_elsewhere: bool = False) -> str:
    """The next state of a contract; one is active for each environment."""
    if to not in MOVES.get(state, ()) or to == "active" and active_elsewhere:
        raise ContractError([f"state: INVALID_ENUM: no move from {state} to {to}"])
    return to


def edited(doc: dict, **controls) -> dict:
    """A copy with some controls changed: gate thresholds by their names, `approve` (a fingerprint), `drop_rule` and `add_rule`."""
    out = copy.deepcopy(doc)
    spec = out["spec"]
    for k, v in controls.items():
        if k in GATE:
            spec.setdefault("gate", {})[k] = v
        elif k == "approve":
            spec["approvedRoutes"] = sorted({*(spec.get("approvedRoutes") or []), v})
            for r in spec["rules"]:
                if r["type"] == "approved_routes":
                    r["fingerprints"] = sorted({*r["fingerprints"], v})
        elif k == "drop_rule":
            spec["rules"] = [r for r in spec["rules"] if r["id"] != v]
        elif k == "add_rule":
            spec["rules"] = [*(r for r in spec["rules"] if r["id"] != v["id"]), v]
        else:
            raise ContractError([f"controls.{k}: UNKNOWN_FIELD: unknown control"])
    if faults := validate(out):
        raise ContractError(faults)
    return out

"""Selectors and attribute conditions as boolean columns over nodes. Absent values never make a condition null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from routeledger.functions import patterns
from routeledger.functions.patterns import MAX_INPUT, MAX_PATTERN, MAX_REPEAT

OPERATORS = ("equals", "not_equals", "in", "not_in", "exists", "matches")
#: Fields that are columns of a node besides its attributes.
SIDE_EFFECTING = ("write", "external")


def tagged(value) -> str:
    """A literal with its type before it, as nodes hold attribute values."""
    if isinstance(value, bool):
        return f"boolean:{str(value).lower()}"
    if isinstance(value, (int, float)):
        return f"number:{value:g}" if isinstance(value, float) else f"number:{value}"
    return f"string:{value}"


def field(name: str) -> Column:
    return F.element_at("attributes", F.lit(name))


def check_pattern(pattern: str) -> list[str]:
    """Faults of a pattern: one that is empty, too long or too large, or has look-around, back-references, flags, lazy repeats, repeats
    of repeats or other escapes. Every other one is matched in linear time."""
    out = []
    if not pattern:
        out.append("an empty pattern")
    if len(pattern) > MAX_PATTERN:
        out.append("pattern too long")
    if re.search(r"\(\?(?!:)", pattern) or re.search(r"\\[1-9kpPbBAZzGQE]", pattern):
        out.append("look-around, back-references and other escapes are not allowed")
    if re.search(r"(?<!\\)[*+?}][*+?]", pattern):
        out.append("a repeat of a repeat is not allowed")
    if any(int(n) > MAX_REPEAT for bounds in re.findall(r"\{(\d+)(?:,(\d*))?\}", pattern) for n in bounds if n):
        out.append(f"a repeat of more than {MAX_REPEAT} times is not allowed")
    if not out:
        try:
            patterns.Automaton(pattern)
        except (re.error, patterns.PatternTooLarge, KeyError) as e:
            out.append(f"no pattern: {e}")
    return out


def rendered(pattern: str) -> str:
    """The pattern in Java's syntax with the subset's meaning: `$` is the very end, `.` stops at line feeds only, `&&` and
    `[` in a class are letters."""
    out, i, inside = [], 0, False
    special = {"v": r"\x0B", "0": r"\x00"}
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(special.get(pattern[i + 1], pattern[i : i + 2]))
            i += 2
            continue
        if inside:
            out.append("\\" + c if c in "[&" else c)
            inside = c != "]"
        elif c == "[":
            inside = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        else:
            out.append({"$": r"\z", ".": r"[^\n]"}.get(c, c))
        i += 1
    return "".join(out)


def matches(text: Column, pattern: str) -> Column:
    """Whether a text of at most MAX_INPUT letters holds a match. A pattern without repeats is a plain expression, any other one runs
    on an automaton: no engine that backtracks meets a repeat."""
    if faults := check_pattern(pattern):
        raise ValueError("; ".join(faults))
    if patterns.has_repeat(patterns.parsed(pattern)):
        return patterns.search(text, pattern)
    return F.coalesce((F.length(text) <= MAX_INPUT) & text.rlike(rendered(pattern)), F.lit(False))


def list_value(members: Column) -> Column:
    """The value of an attribute that is a list, from its members as tagged values, whose order says nothing."""
    return F.concat(F.lit("array:"), F.to_json(F.array_sort(members)))


def condition(value: Column, operator: str, operand=None) -> Column:
    """Whether a tagged value fulfils a condition; an absent one equals nothing, and differs from everything. A list equals the value
    that is its only member, and is in a set if one of its members is."""
    absent = value.isNull()
    members = F.when(value.startswith("array:"), F.from_json(F.substring(value, 7, 1 << 30), "array<string>"))
    equals = lambda x: F.coalesce((value == x) | (F.coalesce(members == F.array(F.lit(x)), F.lit(False))), F.lit(False))
    within = lambda xs: F.coalesce(value.isin(*xs) | F.coalesce(F.arrays_overlap(members, F.array(*map(F.lit, xs))), F.lit(False)), F.lit(False)) if xs else F.lit(False)
    if operator == "exists":
        return ~absent
    if operator == "equals":
        return equals(tagged(operand))
    if operator == "not_equals":
        return absent | ~equals(tagged(operand))
    if operator == "in":
        return within([tagged(x) for x in operand])
    if operator == "not_in":
        return absent | ~within([tagged(x) for x in operand])
    if operator == "matches":
        text = F.when(value.startswith("string:"), F.substring(value, 8, 1 << 30))
        return matches(text, operand)
    raise ValueError(f"unknown operator {operator}")


def operand_of(spec: dict):
    return next((spec[k] for k in ("values", "pattern", "value") if k in spec), None)


def selector(spec: dict) -> Column:
    """All parts of a selector: name (or namePattern), service, operation and attributes."""
    out = F.lit(True)
    for key, column in (("name", "label"), ("service", "service"), ("operation", "operation")):
        if key in spec:
            out = out & F.coalesce(F.col(column) == spec[key], F.lit(False))
    if "namePattern" in spec:
        out = out & matches(F.col("label"), spec["namePattern"])
    for name, operator, operand in conditions(spec):
        out = out & condition(field(name), operator, operand)
    return out


def conditions(spec: dict) -> list[tuple]:
    """Key, operator and operand of a selector's conditions: a list of them, or an object of values or of conditions by key."""
    own = spec.get("attributes") or {}
    each = [(c["key"], c) for c in own] if isinstance(own, list) else own.items()
    return [(key, c["operator"], operand_of(c)) if isinstance(c, dict) else (key, "equals", c) for key, c in each]


def pins_side_effect(spec: dict) -> bool:
    """Whether a selector takes only spans that write or reach outside."""
    for key, operator, operand in conditions(spec):
        values = [operand] if operator == "equals" else operand if operator == "in" else []
        if key == "agent.side_effect" and values and all(v in SIDE_EFFECTING for v in values):
            return True
    return False

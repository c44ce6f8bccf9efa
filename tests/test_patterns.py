"""The matcher against Python's engine on random patterns, and in linear time where engines that backtrack don't end."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from routeledger.functions import patterns
from routeledger.operators import selectors


def drawn(rng, depth=0):
    atoms = ["a", "b", "c", ".", r"\d", r"\W", r"\s", "[a-c]", "[^ab]", r"[\d\-x]", "é", r"\.", "[]a]", "\U0001f600"]
    kind = rng.random()
    if depth > 1 or kind < 0.4:
        return rng.choice(atoms)
    if kind < 0.6:
        return "".join(drawn(rng, depth + 1) for _ in range(rng.randint(1, 4)))
    inner = f"({drawn(rng, depth + 1)}{rng.choice(['', '|' + drawn(rng, depth + 1), '|'])})"
    return inner + rng.choice(["", "*", "+", "?", "{2}", "{1,3}", "{0,2}", "{2,}"])


def test_against_another_engine(monkeypatch):
    rng = random.Random(9)
    texts = ["", "a", "ab\n", "\n", "aXb", "\U0001f600a", "éé", "a.b-x", "0 1\t2"] + ["".join(rng.choice("abc1 .\né-") for _ in range(rng.randint(0, 7))) for _ in range(60)]
    for states in (1024, 2):
        monkeypatch.setattr(patterns, "MOST_STATES", states)
        for _ in range(150):
            pattern = rng.choice(["", "^", "(^|a)"]) + drawn(rng) + rng.choice(["", "$", "($|b)"])
            want = [re.search(pattern.replace("$", r"\Z"), t, re.ASCII) is not None for t in texts]
            assert patterns.Automaton(pattern).search(texts).tolist() == want, pattern


@pytest.mark.parametrize("pattern", ["a*a*a*a*b", "[a-z]+[a-z]+[a-z]+[a-z]+[a-z]+x", "(a|a)*b", "(a+)+b", "(a|ab)*c", "((ab)*a)+c", "(a?){100}a{100}b", "(.*)(.*)(.*)(.*)=1"])
def test_linear_time(pattern):
    assert not selectors.check_pattern(pattern)
    own = patterns.Automaton(pattern)
    own.search(["a"])
    took = []
    for n in (2048, 8192):
        began = time.perf_counter()
        assert own.search(["a" * n] * 50).tolist() == [False] * 50
        took.append(time.perf_counter() - began)
    assert took[1] < 1.5 and took[1] < 12 * took[0] + 0.2


def test_faults():
    for bad in ("", "(?=a)", "(?i)a", "a*?", "a++", r"\bword", r"(a)\1", r"\p{L}", "a{129}", "((a{100}){100}){2}", "(a", "a)", "[a", "*a", "a" * 257):
        assert selectors.check_pattern(bad), bad
    for good in ("(a+)+b", "a{2,3}b", "^(?:one|two)$", "a{", "x{,3}", r"\d+\.\d*", "[^]]"):
        assert not selectors.check_pattern(good), good


def test_in_selectors(spark):
    rows = [("tool.search", 1), ("tool.", 2), (None, 3), ("x" * 8193 + "a1", 4), ("a1", 5)]
    df = spark.createDataFrame(rows, "label string, n int").withColumn("service", F.lit("web")).withColumn("attributes", F.create_map(F.lit("q"), F.concat(F.lit("string:"), "label")))
    assert [r["n"] for r in df.where(selectors.selector({"namePattern": r"^tool\.\w+$"})).collect()] == [1]
    assert [r["n"] for r in df.where(selectors.selector({"attributes": {"q": {"operator": "matches", "pattern": "[a-z]+[0-9]+$"}}})).collect()] == [5]
    counted = df.groupBy("service").agg(F.count(F.when(selectors.selector({"namePattern": "o+l|a1"}), 1)).alias("c")).collect()
    assert counted[0]["c"] == 3

"""Pattern matching in linear time over Arrow batches.

A pattern becomes an automaton of positions, and sets of positions become the states of a table, made as texts need them and never
more than MOST_STATES at a time. All texts of a batch advance by one letter together, each by one look into the table, so a text costs
steps in proportion to its length whatever the pattern; nothing backtracks. A match is searched anywhere; `^` and `$` are the very
ends of a text, `.` is all but the line feed, and \\d, \\w and \\s are ASCII.
"""

from __future__ import annotations

import re
import warnings
from functools import lru_cache
from re import _parser as parser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_INPUT, MAX_PATTERN, MAX_REPEAT, MAX_PROGRAM = 8192, 256, 128, 4096
MOST_STATES = 1024
LAST = 0x10FFFF
CATEGORIES = {
    parser.CATEGORY_DIGIT: [(0x30, 0x39)],
    parser.CATEGORY_WORD: [(0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A)],
    parser.CATEGORY_SPACE: [(0x09, 0x0D), (0x20, 0x20)],
}
NEGATED = {parser.CATEGORY_NOT_DIGIT: parser.CATEGORY_DIGIT, parser.CATEGORY_NOT_WORD: parser.CATEGORY_WORD, parser.CATEGORY_NOT_SPACE: parser.CATEGORY_SPACE}


class PatternTooLarge(ValueError):
    pass


def parsed(pattern: str):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return parser.parse(pattern, re.ASCII)


def complement(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, at = [], 0
    for lo, hi in sorted(ranges):
        if lo > at:
            out.append((at, lo - 1))
        at = max(at, hi + 1)
    return [*out, (at, LAST)] if at <= LAST else out


def members(items) -> list[tuple[int, int]]:
    """Ranges of letters of a class."""
    out, negate = [], False
    for op, value in items:
        if op is parser.NEGATE:
            negate = True
        elif op is parser.LITERAL:
            out.append((value, value))
        elif op is parser.RANGE:
            out.append(value)
        else:
            out += CATEGORIES[value] if value in CATEGORIES else complement(CATEGORIES[NEGATED[value]])
    return complement(out) if negate else out


class Automaton:
    def __init__(self, pattern: str):
        #: Positions: ("letter", ranges, next), ("any of", nexts), ("begin", next), ("end", next) or ("match",).
        self.positions: list[tuple] = [("match",)]
        self.start = self._sequence(parsed(pattern), 0)
        bounds = sorted({b for p in self.positions if p[0] == "letter" for lo, hi in p[1] for b in (lo, hi + 1)})
        self.bounds = np.array(bounds, np.int64)
        self.samples = [0, *bounds] if not bounds or bounds[0] else bounds  # a letter of each class that no range splits
        self.offset = 0 if len(self.samples) > len(bounds) else 1
        self._clear()

    def _add(self, *position) -> int:
        if len(self.positions) >= MAX_PROGRAM:
            raise PatternTooLarge("the pattern's repeats make it too large")
        self.positions.append(position)
        return len(self.positions) - 1

    def _sequence(self, items, to: int) -> int:
        for op, value in reversed(list(items)):
            to = self._one(op, value, to)
        return to

    def _one(self, op, value, to: int) -> int:
        if op is parser.LITERAL:
            return self._add("letter", [(value, value)], to)
        if op is parser.NOT_LITERAL:
            return self._add("letter", complement([(value, value)]), to)
        if op is parser.ANY:
            return self._add("letter", complement([(10, 10)]), to)
        if op is parser.IN:
            return self._add("letter", members(value), to)
        if op is parser.BRANCH:
            return self._add("any of", [self._sequence(x, to) for x in value[1]])
        if op is parser.SUBPATTERN:
            return self._sequence(value[-1], to)
        if op is parser.AT:
            return self._add("begin" if value is parser.AT_BEGINNING else "end", to)
        low, high, inner = value  # a repeat
        if high is parser.MAXREPEAT:
            loop = self._add("any of", [])
            self.positions[loop][1].extend([self._sequence(inner, loop), to])
            to = loop
        else:
            beyond = to
            for _ in range(high - low):
                to = self._add("any of", [self._sequence(inner, to), beyond])
        for _ in range(low):
            to = self._sequence(inner, to)
        return to

    def _closure(self, of, begin: bool = False, end: bool = False) -> frozenset:
        """Positions that wait for a letter or the end, or are a match, from some on without a letter."""
        found, seen, todo = set(), set(), list(of)
        while todo:
            p = todo.pop()
            if p in seen:
                continue
            seen.add(p)
            kind = self.positions[p][0]
            if kind == "any of":
                todo += self.positions[p][1]
            elif kind == "begin":
                todo += [self.positions[p][1]] if begin else []
            elif kind == "end" and end:
                todo.append(self.positions[p][1])
            else:
                found.add(p)
        return frozenset(found)

    def _clear(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.table = np.full((64, len(self.samples)), -1, np.int32)
        self.accepts, self.settled = np.zeros(64, bool), np.zeros(64, bool)
        self.first = self._number(self._closure([self.start], begin=True))

    def _number(self, positions: frozenset) -> int:
        at = self.numbers.get(positions)
        if at is None:
            at = self.numbers[positions] = len(self.sets)
            self.sets.append(positions)
            if at >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
                self.accepts, self.settled = (np.concatenate([x, np.zeros_like(x)]) for x in (self.accepts, self.settled))
            self.settled[at] = 0 in positions
            self.accepts[at] = 0 in positions or 0 in self._closure(positions, begin=at == 0, end=True)
        return at

    def _follow(self, state: int, letter: int) -> int:
        own = self.sets[state]
        if 0 in own:
            return state
        sample = self.samples[letter]
        to = [p[2] for p in map(self.positions.__getitem__, own) if p[0] == "letter" and any(lo <= sample <= hi for lo, hi in p[1])]
        return self._number(self._closure([*to, self.start]))  # a match can begin at every letter

    def search(self, texts: list[str]) -> np.ndarray:
        """Whether each text holds a match."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        letters = np.searchsorted(self.bounds, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), "right") - self.offset
        starts = (np.cumsum(lengths) - lengths)[order]
        falling = -lengths[order]
        state = np.full(len(texts), self.first, np.int32)
        for t in range(int(lengths.max(initial=0))):
            if len(self.sets) > MOST_STATES:
                state = self._afresh(state)
            active = int(np.searchsorted(falling, -t, "left"))
            now, letter = state[:active], letters[starts[:active] + t]
            following = self.table[now, letter]
            if (missing := following < 0).any():
                for s, k in set(zip(now[missing].tolist(), letter[missing].tolist(), strict=True)):
                    to = self._follow(s, k)
                    self.table[s, k] = to
                following = self.table[now, letter]
            state[:active] = following
            if t % 64 == 63 and self.settled[following].all():
                break
        out = np.zeros(len(texts), bool)
        out[order] = self.accepts[state]
        return out

    def _afresh(self, state: np.ndarray) -> np.ndarray:
        """Forget all states but those in use."""
        used, place = np.unique(state, return_inverse=True)
        kept = [self.sets[s] for s in used]
        begun = [s == 0 for s in used]
        self._clear()
        return np.array([self.first if b else self._number(k) for k, b in zip(kept, begun, strict=True)], np.int32)[place]


@lru_cache(maxsize=256)
def automaton(pattern: str) -> Automaton:
    return Automaton(pattern)


def has_repeat(items) -> bool:
    """Whether a parsed pattern repeats something a varying number of times."""
    for op, value in items:
        if op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            if value[0] != value[1] or has_repeat(value[2]):
                return True
        elif (op is parser.SUBPATTERN and has_repeat(value[-1])) or (op is parser.BRANCH and any(map(has_repeat, value[1]))):
            return True
    return False


def search(text: Column, pattern: str) -> Column:
    """Whether a text of at most MAX_INPUT letters holds a match; false where it is null or longer."""

    @F.pandas_udf(T.BooleanType())
    def found(texts: pd.Series) -> pd.Series:
        own = [t if t is not None and len(t) <= MAX_INPUT else None for t in texts]
        out = np.zeros(len(own), bool)
        some = [i for i, t in enumerate(own) if t is not None]
        out[some] = automaton(pattern).search([own[i] for i in some])
        return pd.Series(out)

    return F.coalesce(found(text), F.lit(False))

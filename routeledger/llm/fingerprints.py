"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over the last eight bytes of a text's UTF-8. Where its lowest `level` bits are zero a piece ends, so pieces of about
2^level bytes depend on their own bytes alone and survive changes elsewhere. A piece's signature is twelve bits of the sum of the
hashes in it, written as two letters. The level is the least from which a text has at most MOST_PIECES pieces, tried from one
well below what its length suggests. A fingerprint is `level:signatures:signatures:signatures`, at this level and the next two, each
twice as coarse; pieces of a coarser level are unions of finer ones.

Two fingerprints are compared at the finest level that both have, by the edit distance of insertions and deletions:
likeness = 1 - distance / (number of signatures of both). Without a common level it is 0; equal fingerprints have 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from routeledger.llm.shared import needs, written
from routeledger.llm.words import mix

WINDOW, MOST_PIECES, LEVELS = 8, 64, 3
#: Bytes that are hashed at a time; a text of any length takes a few times as much memory besides its own.
BLOCK = 1 << 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
_PAIRS = np.array([a + b for a in LETTERS for b in LETTERS])
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW bytes that end at each place; the first WINDOW - 1 of `data` only lead in."""
    h, step, width = _BYTES[data], _STEP, 1
    while width < WINDOW:  # windows of twice the width from two of the last width
        h = h[width:] + step * h[:-width]
        step, width = step * step, width * 2
    return mix(h)


def fingerprint(text: str | None) -> str:
    """The fingerprint of a whole text; a null text is an empty one, which has no pieces."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    level = max(0, (n // MOST_PIECES).bit_length() - 2)
    ends, sums, marks = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for at in range(0, n, BLOCK):
            lead = np.zeros(max(0, WINDOW - 1 - at), np.uint8)
            h = rolling(np.concatenate([lead, data[max(0, at - WINDOW + 1) : at + BLOCK]]))
            sum_to = np.cumsum(h * _STEP ^ (h >> np.uint64(29)), dtype=np.uint64) + total
            total = sum_to[-1]
            here = np.flatnonzero((h & np.uint64((1 << level) - 1)) == 0)
            ends, sums, marks = np.concatenate([ends, here + at]), np.concatenate([sums, sum_to[here]]), np.concatenate([marks, h[here]])
            while len(ends) >= MOST_PIECES and level < 63:
                level += 1
                left = (marks & np.uint64((1 << level) - 1)) == 0
                ends, sums, marks = ends[left], sums[left], marks[left]
        parts = []
        for finer in range(level, level + LEVELS):
            left = (marks & np.uint64((1 << min(finer, 63)) - 1)) == 0
            to = np.append(sums[left], total) if n and not (left.any() and ends[left][-1] == n - 1) else sums[left]
            pieces = np.diff(to, prepend=np.uint64(0))
            parts.append("".join(_PAIRS[(mix(pieces) >> np.uint64(52)).astype(np.int64)]))
    return f"{level}:{':'.join(parts)}"


def shared_length(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, a word of bits at a time."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    if a == b:
        return 1.0
    (level_a, *of_a), (level_b, *of_b) = a.split(":"), b.split(":")
    low = max(int(level_a), int(level_b))
    i, j = low - int(level_a), low - int(level_b)
    if i >= len(of_a) or j >= len(of_b):
        return 0.0
    x, y = ([s[k : k + 2] for k in range(0, len(s), 2)] for s in (of_a[i], of_b[j]))
    return 2.0 * shared_length(x, y) / (len(x) + len(y)) if x and y else 0.0


@F.pandas_udf(T.StringType())
def fingerprint_of(text: pd.Series) -> pd.Series:
    return text.map(fingerprint)


@F.pandas_udf(T.DoubleType())
def likeness_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """likeness of two columns of fingerprints; null where either is."""
    return pd.Series([None if x is None or y is None else likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `fingerprint`; a column of that name gives way."""
    return docs.select(*(docs[c] for c in docs.columns if c != "fingerprint"), fingerprint_of(F.coalesce(F.col(text), F.lit(""))).alias("fingerprint"))


Row = tuple[int | None, str]


def with_next(docs: DataFrame, of: Callable[[Row, Row], dict], schema: str) -> DataFrame:
    """of(row, next row) for every (doc_id, text) in ascending order of doc_id; after the last comes the first.

    Null doc_ids come first. Rows of one doc_id follow each other by their texts' hashes, then as the table has them. Rows are dealt
    into ranges of this order and sorted there, so that a hot doc_id is spread; a task holds two rows at a time. The last row of a
    range meets the first one of the next range in a join of one row for each range.
    """
    rows = needs(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", "h", "place"]
    dealt = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place")).repartitionByRange(*order).sortWithinPartitions(*order)

    made_type = T.StructType.fromDDL(schema)
    names, types = made_type.names, to_arrow_schema(made_type)
    shape = T.StructType.fromDDL("part int, kind string, id long, body string").add("made", made_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            done, edges = [], []
            for row in zip(batch["doc_id"].to_pylist(), (x.as_py() for x in batch["text"])):
                if held is None:
                    edges.append(("first", *row))
                else:
                    done.append(of(held, row))
                held = row
            yield _rows(part, done, edges, names, types)
        if held is not None:
            yield _rows(part, [], [("last", *held)], names, types)

    found = written(dealt.select("doc_id", "text").mapInArrow(run, shape))
    made = found.where("kind is null").select("made.*")
    edges = found.where("kind is not null").select("part", "kind", "id", "body")
    parts = edges.where("kind = 'first'").select("part")
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))  # a number for each range
    links = parts.select("part", after.alias("after"))
    last = edges.where("kind = 'last'").select("part", "id", "body").join(links, "part")
    first = edges.where("kind = 'first'").select(F.col("part").alias("after"), F.col("id").alias("next_id"), F.col("body").alias("next_body"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [of((r["id"], r["body"]), (r["next_id"], r["next_body"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(done, types)

    met = last.join(first, "after").select("id", "body", "next_id", "next_body").mapInArrow(meet, made_type)
    return made.union(met.select(*names))


def _rows(part: int, done: list[dict], edges: list[tuple], names: list[str], types: pa.Schema) -> pa.RecordBatch:
    n, m = len(done), len(edges)
    made = pa.StructArray.from_arrays([pa.array([d[x] for d in done] + [None] * m, types.field(x).type) for x in names], names)
    columns = [pa.array([part] * (n + m), pa.int32()), *(pa.array([None] * n + [e[i] for e in edges], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))), made]
    return pa.RecordBatch.from_arrays(columns, ["part", "kind", "id", "body", "made"])


def edited(text: str, following: str) -> str:
    """A text whose last half gives way to as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint, that of its edited text, and how alike they and the next document's are.

    Null texts are empty ones. Every row of docs gives one; columns but doc_id and text are left out. A single row is its own next one.
    """

    class Memo:
        last: tuple[str, str] = ("", fingerprint(""))  # the text fingerprinted last, which the next pair begins with

    def of(row: Row, following: Row) -> dict:
        own = Memo.last[1] if Memo.last[0] is row[1] else fingerprint(row[1])
        theirs = fingerprint(following[1])
        Memo.last = (following[1], theirs)
        new = edited(row[1], following[1])
        other = fingerprint(new)
        return {
            "doc_id": row[0], "n_chars": len(row[1]), "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": own,
            "edited_fingerprint": other, "near_edited": likeness(own, other), "near_next": likeness(own, theirs),
        }

    return with_next(docs, of, COMPARED)

"""Best-fit packing of tokenised documents into sequences of a fixed length.

The tokens of each text are counted in Arrow batches; a text longer than a sequence is cut into full pieces and a rest.
Only the histogram of piece lengths, at most `capacity` numbers whatever the size of the corpus, reaches the driver.
There a configuration linear program (least number of sequences, each filled by one pattern of lengths) is solved by
multiplicative weights: every length has a weight, a bounded knapsack dynamic program prices the heaviest patterns, and weights
fall as lengths are covered. Its solution is rounded to whole patterns and solved again for what is left; best fit places the small
residue. Weights bound the number of sequences from below, so the gap is known. The plan says, for each
length, which ranks go to which sequences. Pieces get ranks within their length from counts by (length, bucket), so
that no length, however frequent, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeledger.llm.shared import needs, written
from routeledger.llm.words import Memo

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Parts of texts whose ids a worker keeps.
KEPT_PARTS = 400_000


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it is printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of a tokenizers file without special tokens, as little-endian unsigned 32-bit integers.

    With `by_word` a text is split at ASCII white space, over which no token of a word tokenizer reaches, and the ids of
    each part are kept. A part of Latin letters, or such with one full stop or comma, goes to the vocabulary's own model at
    once; any other part is encoded in full. `by_word` fits lower-casing word vocabularies; without it whole texts are encoded.
    """

    def __init__(self, path: str, by_word: bool = True):
        self.path, self.by_word, self._kept = path, by_word, None

    def __getstate__(self):
        return {"path": self.path, "by_word": self.by_word, "_kept": None}

    def _load(self) -> None:
        from tokenizers import Tokenizer

        encoder, letter = Tokenizer.from_file(self.path), byte_letters()
        model, plain = encoder.model, {s: None for s in ".,"}

        def word(w: str) -> list[int]:
            return [t.id for t in model.tokenize(w if w.isascii() else "".join(letter[b] for b in w.encode()))]

        def ids(part: str) -> bytes:
            if self.by_word:
                head = part[:-1] if part[-1:] in plain else part
                if head.isalpha() and head.islower() and max(head) < "\u0100":
                    return np.array(word(head) + (word(part[-1]) if head is not part else []), "<u4").tobytes()
            return np.array(encoder.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

        self._kept = Memo(ids, KEPT_PARTS)

    def __call__(self, text: str) -> bytes:
        if self._kept is None:
            self._load()
        if not self.by_word:
            return self._kept.of(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            text = text.lower()  # as the vocabulary's own lower-casing does; beyond Latin-1 that may differ
        return b"".join(map(self._kept.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def pieces(docs: DataFrame, encoder: Encoder, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of every document: its ids and then `end_id`, cut only where they are more than `capacity`.

    A null text counts as empty and gives one piece with the end id alone; repeated rows each give their own pieces.
    """

    end = int(end_id).to_bytes(4, "little")

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return needs(docs, "doc_id", "text").mapInPandas(cut_up, PIECES)


#: Weights favour long pieces by this much: short ones fill up what others leave and are kept for the end.
TILT = 0.02
#: A weight falls by exp(-FALL) while its length's demand is covered; patterns whose weight is within NEAR of the best are used.
FALL, NEAR = 1.0, 0.02


class Fills:
    """The heaviest choice of lengths for every room up to the capacity: a bounded knapsack by dynamic programming."""

    def __init__(self, weights: np.ndarray, limits: np.ndarray, capacity: int):
        of, copies = [], []
        for n in np.nonzero(limits)[0].tolist():
            left, k = min(int(limits[n]), capacity // n), 1
            while left > 0:  # 1, 2, 4, ... copies, together as many as the limit
                k = min(k, left)
                of.append(n)
                copies.append(k)
                left -= k
                k *= 2
        self.of, self.copies = np.array(of, np.int64), np.array(copies, np.int64)
        self.best = np.zeros(capacity + 1)
        self.took = np.zeros((len(of), capacity + 1), bool)
        for i, (n, k) in enumerate(zip(of, copies, strict=True)):
            more = self.best[: capacity + 1 - n * k] + k * weights[n]
            self.took[i, n * k :] = more > self.best[n * k :]
            np.maximum(self.best[n * k :], more, out=self.best[n * k :])

    def chosen(self, rooms: np.ndarray) -> list[dict[int, int]]:
        """Lengths and copies of the best choice for each of the rooms."""
        left, picked = rooms.copy(), np.zeros((len(self.of), len(rooms)), bool)
        for i in range(len(self.of) - 1, -1, -1):
            picked[i] = self.took[i, left]
            left -= picked[i] * (self.of[i] * self.copies[i])
        out: list[dict[int, int]] = []
        for own in picked.T:
            pattern: dict[int, int] = {}
            for i in np.nonzero(own)[0]:
                pattern[int(self.of[i])] = pattern.get(int(self.of[i]), 0) + int(self.copies[i])
            out.append(pattern)
        return out


def lower_bound(counts: np.ndarray, capacity: int) -> float:
    """A number of sequences that no packing gets below, nor the linear program: the best of two families of dual feasible weights.
    The first counts pieces of more than capacity - t whole, those of at least t by their share of a sequence, and no others; the
    second rounds (k + 1) times the share down to whole k-ths."""
    lengths = np.arange(capacity + 1)
    pieces, tokens = np.cumsum(counts), np.cumsum(counts * lengths) / capacity
    t = np.arange(capacity // 2 + 1)
    whole = pieces[-1] - pieces[capacity - t]
    part = tokens[capacity - t] - np.where(t > 0, tokens[np.maximum(t - 1, 0)], 0.0)
    best = float((whole + part).max())
    for k in range(1, 50):
        exact = (k + 1) * lengths % capacity == 0
        best = max(best, float(counts @ np.where(exact, lengths / capacity, (k + 1) * lengths // capacity / k)))
    return best


def solve(counts: np.ndarray, capacity: int, rounds: int = 500) -> tuple[dict[tuple, float], float]:
    """The configuration program for counts[l] pieces of each length l, by multiplicative weights: patterns, as tuples of length and
    copies, with how often each is used, and a lower bound of the program's value.

    A length starts at the weight of its share of a sequence; weights fall exponentially as demand is covered, so that lengths that lag
    behind lead the next patterns. A round prices by one knapsack program the best pattern through every length, and uses those of nearly
    the best weight as far as the scarcest length allows. Weights over the best pattern's weight are feasible for the dual, which gives the
    bound. Nothing is covered twice; rounds end when all is covered, or after `rounds`.
    """
    demand = counts.astype(float)
    need, share = demand.copy(), np.arange(capacity + 1) / capacity
    found: dict[tuple, float] = {}
    bound = lower_bound(counts, capacity)
    for _ in range(rounds):
        live = need > 1e-9 * demand
        if not live.any():
            break
        done = np.divide(demand - need, demand, out=np.zeros(capacity + 1), where=demand > 0)
        weights = np.where(live, share * (1 + TILT * share) * np.exp(-FALL * (done - done[live].min())), 0.0)
        fills = Fills(weights, np.where(live, counts, 0), capacity)
        lengths = np.nonzero(live)[0][::-1]
        value = fills.best[capacity - lengths] + weights[lengths]
        bound = max(bound, float(weights @ demand / value.max()))
        lengths = lengths[value >= (1 - NEAR) * value.max()]
        for n, pattern in zip(lengths.tolist(), fills.chosen(capacity - lengths), strict=True):
            pattern[n] = pattern.get(n, 0) + 1
            uses = min(need[m] / k for m, k in pattern.items())
            if uses > 1e-9:
                for m, k in pattern.items():
                    need[m] = max(need[m] - k * uses, 0.0)
                key = tuple(sorted(pattern.items()))
                found[key] = found.get(key, 0.0) + uses
    return found, bound


class Plan(NamedTuple):
    """Where the pieces of each length go: for length l, from rank first[l][i] on, copy j = (rank - first) // times is
    put at offset + j * l of sequence base + (rank - first) % times. `by_program` sequences are patterns of the linear program, and
    `bound` is a number of sequences that no packing gets below."""

    first: dict[int, np.ndarray]
    base: dict[int, np.ndarray]
    times: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    sequences: int
    by_program: int
    bound: float


def plan(counts: np.ndarray, capacity: int, rounds: int = 500) -> Plan:
    """Round the solution of the configuration program to whole sequences; its size is bounded by the capacity alone.

    Uses are rounded down, and then each pattern is used once more, the fullest first, where its pieces are still there. The program is
    solved again for what is left, as long as that places a fiftieth of the sequences so far; best fit packs the residue.
    """
    left = counts.astype(np.int64).copy()
    chosen: dict[tuple, int] = {}

    def use(pattern: tuple, most: int) -> int:
        times = min(most, *(int(left[n]) // k for n, k in pattern))
        if times > 0:
            for n, k in pattern:
                left[n] -= k * times
            chosen[pattern] = chosen.get(pattern, 0) + times
        return max(times, 0)

    bound, by_program = lower_bound(counts, capacity), 0
    while left.any():
        solved, least = solve(left, capacity, rounds)
        bound = max(bound, least) if not by_program else bound
        placed = sum(use(pattern, int(uses + 1e-9)) for pattern, uses in solved.items())
        placed += sum(use(pattern, 1) for pattern in sorted(solved, key=lambda p: (-sum(n * k for n, k in p), -(solved[p] % 1), p)))
        by_program += placed
        if placed * 50 <= by_program:
            break
    while left.any():
        room, pattern = capacity, {}
        while room > 0:
            lengths = np.nonzero(left[: room + 1] > 0)[0]
            lengths = lengths[[left[n] > pattern.get(int(n), 0) for n in lengths]] if pattern else lengths
            if not len(lengths):
                break
            n = int(lengths[-1])
            k = min(room // n, int(left[n]) - pattern.get(n, 0))
            pattern[n] = pattern.get(n, 0) + k
            room -= n * k
        use(tuple(sorted(pattern.items())), 1 << 62)
    parts: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks = np.zeros(capacity + 1, np.int64)
    sequences = 0
    for pattern, times in chosen.items():
        offset = 0
        for n, k in pattern:
            parts.setdefault(n, []).append((int(ranks[n]), sequences, times, offset))
            ranks[n] += k * times
            offset += n * k
        sequences += times
    columns = [{n: np.array([x[i] for x in rows], np.int64) for n, rows in parts.items()} for i in range(4)]
    return Plan(*columns, sequences, by_program, bound)


def ranked(parts: DataFrame) -> DataFrame:
    """Add `rank`, from 0 without gaps among the pieces of a length, by buckets of each length: of n pieces there are
    about sqrt(n) buckets of sqrt(n) pieces, so that neither numbering them nor adding up their sizes is one long task.
    `row` differs for all pieces, also for equal ones."""
    n_buckets = F.ceil(F.sqrt("n_length"))
    per_length = parts.groupBy("length").agg(F.count("*").alias("n_length"))
    # At most one row for each length, of which there are no more than the capacity.
    dealt = parts.join(F.broadcast(per_length), "length").withColumn("bucket", F.pmod(F.xxhash64("row"), n_buckets)).drop("n_length")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from_rank"))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("row")
    return (
        dealt.withColumn("rn", F.row_number().over(inside) - 1)
        .join(starts, ["length", "bucket"])
        .withColumn("rank", F.col("from_rank") + F.col("rn"))
        .drop("bucket", "rn", "from_rank", "row")
    )


def pack(docs: DataFrame, encoder: Encoder, capacity: int = 2048, end_id: int = 0, rounds: int = 500) -> DataFrame:
    """Pack every document: its pieces with `sequence_id` and `offset`, gapless from 0 in each sequence.

    Empty tables give no rows; null texts are empty ones; extra columns are left out.
    """
    parts = written(pieces(docs, encoder, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))  # fixed once written
    counts = np.zeros(capacity + 1, np.int64)
    for row in parts.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    where = plan(counts, capacity, rounds)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for n in np.unique(lengths):
                at = np.nonzero(lengths == n)[0]
                k = np.searchsorted(where.first[n], ranks[at], side="right") - 1
                past, times = ranks[at] - where.first[n][k], where.times[n][k]
                sequence[at] = where.base[n][k] + past % times
                offset[at] = where.offset[n][k] + past // times * n
            out = batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return ranked(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, f"{PIECES}, sequence_id long, offset long")


def word_tokenizer() -> Encoder:
    """The public word tokenizer named in the contract of op2; its words never span white space."""
    import public_tokenizers

    return Encoder(public_tokenizers.path("word_bpe_49k.json"))

"""Benchmark decontamination by template canonicalisation.

1. Words become templates: numbers, names and units give way to typed placeholders, so that a question with other numbers or names
   keeps its template. An item's windows are hashes of runs of templates; an item of few templates is one window of its exact words.
2. Texts are read once, where they are. A filter of a fixed number of bits, set for the items' windows, lets through the windows that
   may be an item's, whatever the benchmark's size; runs of them leave the task with their slots.
3. These windows are hash-joined with the items' windows, which are broadcast only where Spark finds them small. A window of hardly any
   literal words says little: its words have to be equal, values included.
4. Matches are grouped by text, item and band of neighbouring diagonals, so that a place in the text goes with one in the item, but for a
   few words put in or left out. Slots are checked: wherever the item has the same value the text must have one value too. A text
   whose windows of one band cover enough of an item's template, with consistent slots on some diagonal of it, holds the item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeledger.llm.shared import needs, written
from routeledger.llm.words import MEMO_WORDS, Memo, chunked, hash_word, shingles

#: Templates of a window; items of fewer are one window, and those of fewer than EXACT one of their words as they are.
WINDOW, EXACT = 8, 6
#: Literal words of a window that is told by its template; one of fewer is told by its words and values.
LITERAL = 3
#: Diagonals of a band. Bands overlap by half, so that matches within half as many diagonals share one.
BAND = 16
#: Of an item's templates so many must be covered, and of its slots so many be consistent.
COVER, CONSISTENT = 0.5, 0.8
#: Bits of the filter for windows that may be an item's: 2 MB.
FILTER_BITS = 1 << 24

#: Units of measure and money.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg kilogram kilograms lb lbs oz ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years kb mb gb tb hz khz mhz ghz w kw kwh v j kj kcal cal n pa kpa c f k % percent "
    "usd eur gbp dollar dollars euro euros cent cents pound pounds".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
STRIPPED = ".,;:!?\"'()[]{}|<>*_«»“”‘’#"
#: Kinds of slots.
SLOTS = {"number": 1, "unit": 2, "name": 3}
PLAIN, CAPITAL = 0, 4


def template(word: str) -> tuple[int, int, int, bool]:
    """Of a word: the hash of its template in lower case, the kind of its slot (CAPITAL: a name unless a sentence begins),
    the hash of its value, and whether a sentence ends after it."""
    bare = word.strip(STRIPPED)
    value, ends = hash_word(bare), word.endswith((".", "!", "?"))
    if not bare:
        return 0, PLAIN, 0, ends
    if bare[0] in "+-$€£0123456789" and NUMBER.fullmatch(bare):
        return SLOTS["number"], SLOTS["number"], value, ends
    if bare.lower() in UNITS:
        return value, SLOTS["unit"], value, ends
    if bare[0].isupper():
        return value, CAPITAL, value, ends
    return value, PLAIN, value, ends


class Templates:
    """Templates of some texts, one after another: `t`, `slot`, `value`, and where each text begins in `starts`.

    A unit is a slot only after a number; a word with a capital only within a sentence. Words of signs alone are left out.
    """

    def __init__(self, texts: list[str | None], memo: Memo):
        words: list[str] = []
        n = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if text:
                words += text.split()
            n[i + 1] = len(words)
        entries = np.array(list(map(memo.__getitem__, words)), np.int64) if words else np.empty(0, np.int64)
        table = memo.table()
        t, slot, value, ends = (column[entries] for column in table)
        begins = np.ones(len(words), bool)
        begins[1:] = ends[:-1]
        begins[n[:-1][n[:-1] < len(words)]] = True
        after_number = np.zeros(len(words), bool)
        after_number[1:] = slot[:-1] == SLOTS["number"]
        name = (slot == CAPITAL) & ~begins
        unit = (slot == SLOTS["unit"]) & after_number
        slot = np.where(name, SLOTS["name"], np.where(unit | (slot == SLOTS["number"]), slot, PLAIN))
        t = np.where(slot == PLAIN, t, slot).astype(np.uint64)
        kept = t != 0
        self.t, self.slot, self.value = t[kept], slot[kept], value[kept]
        self.starts = np.concatenate([[0], np.cumsum(kept)])[n]


class WordTable(Memo):
    """A memo of `template` whose values are rows of arrays."""

    def __init__(self):
        super().__init__(self._add, 1 << 62)
        self.rows: list[tuple[int, int, int, bool]] = []  # not in columns yet
        self.columns: list[np.ndarray] | None = None

    def _add(self, word: str) -> int:
        self.rows.append(template(word))
        return len(self.rows) - 1 + (0 if self.columns is None else len(self.columns[0]))

    def table(self) -> tuple[np.ndarray, ...]:
        """Columns of all entries."""
        grown = [np.fromiter((r[i] for r in self.rows), kind, len(self.rows)) for i, kind in enumerate((np.uint64, np.int8, np.uint64, bool))]
        self.rows = []
        self.columns = grown if self.columns is None else [np.concatenate(x) for x in zip(self.columns, grown, strict=True)]
        return tuple(self.columns)


def window_hashes(t: Templates, size: int) -> np.ndarray:
    """A hash for each run of `size` templates, or of words as they are if it is less than EXACT or few of them are literal; runs may reach over
    texts' ends."""
    exact = shingles(t.value, size) ^ np.uint64(size)
    if size < EXACT or not len(exact):
        return exact
    literal = np.concatenate([[0], np.cumsum(t.slot == PLAIN)])
    return np.where(literal[size:] - literal[:-size] >= LITERAL, shingles(t.t, size) ^ np.uint64(size), ~exact)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item (a hash of item_id and text), item_id, n (templates), size, place, hash, slots and values of the windows of the items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, item_id, text in zip(batch["item"], batch["item_id"], batch["text"], strict=True):
                t = Templates([text], WordTable())
                n = len(t.t)
                if size := min(window, n):
                    hashes = window_hashes(t, size).view(np.int64)
                    slot, value = t.slot.astype(np.int32), t.value.view(np.int64)
                    out += [(item, item_id, n, size, k, h, slot[k : k + size], value[k : k + size]) for k, h in enumerate(hashes.tolist())]
            yield pd.DataFrame(out, columns=["item", "item_id", "n", "size", "place", "hash", "slots", "values"])

    listed = needs(benchmark, "item_id", "text").dropna().distinct().withColumn("item", F.xxhash64("item_id", "text"))
    return listed.mapInPandas(run, "item long, item_id long, n int, size int, place int, hash long, slots array<int>, values array<long>")


def places_in_filter(h: np.ndarray, bits: int = FILTER_BITS) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that stand for a hash."""
    return (h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(40)).astype(np.int64) & (bits - 1)


def window_filter(items: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit array in which both bits of each window are set; at most bits / 64 numbers reach the driver."""
    low, high = F.col("hash").bitwiseAND(bits - 1), F.shiftrightunsigned("hash", 40).bitwiseAND(bits - 1)
    bit = items.select(F.explode(F.array(low, high)).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set"))
    out = np.zeros(bits // 64, np.int64)
    for row in words.collect():
        out[row["word"]] = row["set"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


RUNS = "row long, doc_id long, size int, at int, total int, hashes array<long>, slots array<int>, values array<long>"


def runs_of_windows(docs: DataFrame, sizes: list[int], may_be: np.ndarray) -> DataFrame:
    """Runs of neighbouring windows of texts that the filter lets through: row, doc_id, size, at (the first template), total (of the text), hashes of the
    windows, and slots and values of the templates; docs has row, doc_id and text."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(may_be))  # FILTER_BITS at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        may, memo = np.unpackbits(sent.value).astype(bool), WordTable()
        for batch in batches:
            rows, ids, texts, out = batch["row"].tolist(), batch["doc_id"].astype("Int64").tolist(), list(batch["text"]), []
            for x, y in chunked(texts):
                if len(memo) > MEMO_WORDS:  # between chunks, so that no entry goes while it is in use
                    memo = WordTable()
                t = Templates(texts[x:y], memo)
                for size in sizes:
                    if len(t.t) < size:
                        continue
                    h = window_hashes(t, size)
                    low, high = places_in_filter(h, len(may))
                    hit = np.nonzero(may[low] & may[high])[0]
                    own = np.searchsorted(t.starts, hit, side="right") - 1
                    inside = hit + size <= t.starts[own + 1]
                    hit, own = hit[inside], own[inside]
                    for part in np.split(np.arange(len(hit)), np.nonzero((np.diff(hit) > 1) | (np.diff(own) > 0))[0] + 1) if len(hit) else []:
                        first, last, i = int(hit[part[0]]), int(hit[part[-1]]), int(own[part[0]])
                        across = slice(first, last + size)
                        out.append((rows[x + i], ids[x + i], size, first - int(t.starts[i]), int(t.starts[i + 1] - t.starts[i]), h[first : last + 1].view(np.int64), t.slot[across].astype(np.int32), t.value[across].view(np.int64)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RUNS.split(", ")]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(run, RUNS)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, agree: float = CONSISTENT) -> DataFrame:
    """doc_id, item_id, start, end, covered and consistent of texts and the benchmark items that they hold.

    start and end count templates; covered is the share of the item's templates in windows that the text has in one band, consistent the share of the
    slots of these windows that are consistent on the best diagonal of it, 1 where there are no slots. An item that a text holds several times has one row. Null and empty texts and items have none;
    an item of few words is held by a text that has them in a row, or that has no others if it is less than three. Rows without doc_id are
    reported with a null one; repeated rows of docs are reported each, of the benchmark once; other columns are left out.
    """
    items = written(item_windows(benchmark, window))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most `window`
    rows = needs(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    runs = written(runs_of_windows(rows, sizes, window_filter(items)))
    each = runs.select("row", "doc_id", "size", "at", "total", F.posexplode("hashes").alias("k", "hash"), "slots", "values")
    each = each.select("row", "doc_id", (F.col("at") + F.col("k")).alias("at"), "total", "hash", "size", F.slice("slots", F.col("k") + 1, F.col("size")).alias("text_slots"), F.slice("values", F.col("k") + 1, F.col("size")).alias("text_values"))
    met = written(each.join(items, ["hash", "size"]).where("n > 2 OR n = total"))
    diagonal = F.col("at") - F.col("place")
    bands = lambda d: F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.floor((d + i * (BAND // 2)) / BAND).alias("band")) for i in (0, 1)))).alias("b")
    found = met.select("*", bands(diagonal)).groupBy("row", "item", "b").agg(
        F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.first("n").alias("n"), F.first("size").alias("size"),
        F.min("at").alias("start"), F.max(F.col("at") + F.col("size")).alias("end"), F.collect_set("place").alias("places"),
    )
    every = F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1)))
    found = found.withColumn("covered", F.size(F.array_distinct(every)) / F.col("n")).where(F.col("covered") >= cover)
    pair = F.arrays_zip(F.col("slots").alias("a"), F.col("values").alias("b"), F.col("text_slots").alias("c"), F.col("text_values").alias("d"), F.sequence("place", F.col("place") + F.col("size") - 1).alias("e"))
    slots = met.select("row", "item", diagonal.alias("diagonal"), F.explode(pair).alias("x")).where("x.a > 0 AND x.c > 0")
    slots = slots.select("row", "item", "diagonal", F.col("x.e").alias("place"), F.col("x.b").alias("value"), F.col("x.d").alias("text_value")).distinct()
    counted = slots.groupBy("row", "item", "diagonal", "value", "text_value").agg(F.count("*").alias("n"))
    of_value = counted.groupBy("row", "item", "diagonal", "value").agg(F.max("n").alias("same"), F.sum("n").alias("n"))
    on_diagonal = of_value.groupBy("row", "item", "diagonal").agg((F.sum("same") / F.sum("n")).alias("consistent"))
    best = on_diagonal.select("row", "item", "consistent", bands(F.col("diagonal"))).groupBy("row", "item", "b").agg(F.max("consistent").alias("consistent"))
    judged = found.join(best, ["row", "item", "b"], "left").withColumn("consistent", F.coalesce("consistent", F.lit(1.0))).where(F.col("consistent") >= agree)
    # Of the bands in which a text holds an item, the one that covers most, then the first.
    order = F.struct(-F.col("covered"), -F.col("consistent"), "start", "end")
    one = judged.groupBy("row", "item").agg(F.min_by(F.struct("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "covered", "consistent"), order).alias("x"))
    return one.select("x.*")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all columns; rows without doc_id stay."""
    held = contaminated(docs, benchmark).where("doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti")

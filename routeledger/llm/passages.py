"""Substring dedup: fuzzy passages that several documents share, by collinear chaining of k-mer seeds.

1. A document's seeds are its minimisers: of each window of neighbouring k-word runs the one with the least hash; and besides all runs
   with hashes so small that one in RATE has them, which changes nearby cannot unseat. Two texts with window + k - 1 equal words in a row
   have a seed in common.
2. Each seed that several texts hold points from each of them to one leader, the least doc_id that holds it. Texts meet a leader with
   which they share two seeds at places that a passage can have. Only seeds and doc_ids are shuffled for this.
3. Texts of pairs meet, and all k-word runs that the two have in common are matched. Where a run recurs, its n-th occurrence matches the
   n-th of the other text, or the first one if there is none, so that repetitions stay linear too. Matches are chained by a Fenwick
   tree: a match extends the best chain that ends before it in both texts, less a cost for the words skipped in either.
4. A passage whose seeds point to different leaders is found in a second round, in which every two texts meet that share a seed of
   at most MOST_HOLDERS texts. Of a seed that more hold, every two seeds near each other are a seed of their own, held by fewer texts; where
   that is not so the leader holds both. Pairs whose common seeds all lie in passages that are found already are left out of this round.
   Of equal texts only the one of the least doc_id takes part in all this; the others share its whole length.
5. Chains are aligned with both texts: gaps by edit distance, ends as far as words keep agreeing. Aligned passages are
   merged within each document; those long enough are the result.

Steps that shuffle more than a share of the texts' bytes take their rows in parts, one after another, so that the disk that
they need at a time follows the texts, however many rows the texts have in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeledger.llm.shared import discard, in_parts, needs, total, written
from routeledger.llm.words import WEIGHTS, byte_hashes, chunked, runs, shingles

#: Words of a seed, k-word runs of a window, and the share of runs (one in RATE) that are seeds in any case. Every run of
#: LEAST_CHAIN + 2 * WINDOW - 2 = 26 equal words has two seeds, which leaves room for passages of LEAST_WORDS with some words changed.
K, WINDOW, RATE = 4, 8, 8
#: A chain loses this much for each word that it skips in either text; it is aligned if it spans so many words.
GAP_COST, LEAST_CHAIN = 0.2, 12
#: Share of a passage's words that must agree, and the words of the shortest passage of the result.
AGREE, LEAST_WORDS = 0.8, 40
#: Two seeds that texts share are of one passage if they are at most this many words apart in both and AGREE allows the difference.
REACH = 80
#: A seed of more texts does not pair all of them, but goes on with each of the next NEAR seeds of a text, up to NEAR_WORDS away.
MOST_HOLDERS, NEAR, NEAR_WORDS = 8, 4, 40
#: Characters of the texts that a task keeps in words.
KNOWN_CHARS = 4_000_000
#: Pairs whose texts are put into words together.
TOGETHER = 64
#: Matches that are chained as one.
PIECE = 8
#: Rows of a step are taken in parts that shuffle about this share of the texts' bytes at a time, or LEAST_ROOM bytes if that is more.
ROOM, LEAST_ROOM = 0.5, 1 << 26
#: Bytes that a row takes in the shuffles of a step: of seeds that are counted and joined with their counts, of seeds that are linked, and of links.
SEED_BYTES, LINK_BYTES = 40, 30
#: A leader's text goes to the others of its pairs, where it is the shorter one, if it is in at most so many pairs.
MOST_SENT = 64
#: At the ends of a chain, words are compared until disagreements outweigh agreements by this much.
DROP = 6


def minimisers(h: np.ndarray, starts: np.ndarray, k: int = K, window: int = WINDOW, rate: int = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of texts in word_hashes' form: positions in h, and hashes. A text with fewer runs than a window gives its least at any rate."""
    none = np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(h) < k:
        return none
    whole = runs(starts, k)[: len(h) - k + 1]
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    value = np.where(whole, shingles(h, k), most)
    low = value
    have, step = 1, 1
    while have < window:  # minima of ranges of doubling length
        step = min(have, window - have)
        low = np.minimum(low, np.concatenate([low[step:], np.full(min(step, len(low)), most)]))
        have += step
    # A run is a seed if it is the least of a window within its text that holds it.
    n = np.diff(starts)
    last = np.repeat(np.maximum(starts[1:] - k - window + 1, starts[:-1]), n)[: len(value)]
    text = np.repeat(np.arange(len(n)), n)[: len(value)]
    windows = np.nonzero((np.arange(len(value)) <= last) & whole)[0]
    if not len(windows):
        return none
    # No window of a text of at least `window` runs leaves it; that of a shorter one may, whose runs are then looked through.
    short = (n - k + 1 < window)[text[windows]]
    chosen = set()
    for w in windows[short]:
        end = starts[text[w] + 1] - k + 1
        chosen.add(int(w + value[w:end].argmin()))
    wins = windows[~short]
    picked = whole & (value < most // np.uint64(rate))
    picked[list(chosen)] = True
    for shift in range(window):
        at = wins + shift
        picked[at[value[at] == low[wins]]] = True
    places = np.nonzero(picked)[0]
    return places, value[places]


def firsts(own: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which seed of each text is the first of its value there, and whether that value recurs in the text."""
    order = np.lexsort((value, own))
    new = np.ones(len(value) + 1, bool)
    new[1:-1] = (own[order][1:] != own[order][:-1]) | (value[order][1:] != value[order][:-1])
    at = order[new[:-1]]
    again = ~new[1:][new[:-1]]
    by_place = np.argsort(at)
    return at[by_place], again[by_place]


def seeds(texts: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """seed, id and `place` of every different seed of each of the texts (id, text): twice the word where it first begins, and 1 more if it recurs.
    A row without seed has a text's words as its place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, all_texts = batch["id"].to_numpy(), list(batch["text"])
            for x, y in chunked(all_texts):
                h, starts = byte_hashes(all_texts[x:y])
                places, value = minimisers(h, starts, k, window)
                own = np.searchsorted(starts, places, side="right") - 1
                first, again = firsts(own, value)
                own = own[first]
                yield pd.DataFrame({"seed": value[first].view(np.int64), "id": ids[x:y][own], "place": (places[first] - starts[own]) * 2 + again})
                yield pd.DataFrame({"seed": pd.array([None] * (y - x), "Int64"), "id": ids[x:y], "place": np.diff(starts)})

    return texts.mapInPandas(run, "seed long, id long, place int")


def held_seeds(sown: DataFrame) -> DataFrame:
    """The rows (seed, id, place) of seeds of two ids or more, with n, their rows, and the least id that holds them: `head`, at `head_place`."""
    heads = sown.groupBy("seed").agg(F.min("id").alias("head"), F.min_by("place", "id").alias("head_place"), F.max("id").alias("last"), F.count("*").alias("n")).where("head < last").drop("last")
    return sown.join(heads.hint("shuffle_hash"), "seed")


def links(held: DataFrame, most: int) -> DataFrame:
    """id, leader (a smaller id), x and y (their places) and `first` (whether the leader is the least id): of the rows that held_seeds gives every two
    of a seed that at most `most` hold, and each with the least id of a seed that more hold."""
    own = F.struct("id", "place")
    link = lambda a, b, first: F.struct(b["id"].alias("id"), a["id"].alias("leader"), b["place"].alias("x"), a["place"].alias("y"), first.alias("first"))
    few = held.where(F.col("n") <= most).groupBy("seed").agg(F.array_sort(F.collect_list(own)).alias("all"))
    each = few.select(F.explode(F.flatten(F.transform("all", lambda a, i: F.transform(F.slice("all", i + 2, most), lambda b: link(a, b, a["id"] == F.col("all")[0]["id"]))))).alias("link"))
    head = F.struct(F.col("head").alias("id"), F.col("head_place").alias("place"))
    return each.union(held.where(F.col("n") > most).select(link(head, own, F.lit(True)).alias("link"))).select("link.*").where("id > leader")


def near_seeds(held: DataFrame, most: int) -> DataFrame:
    """seed, id and place of every two seeds near each other in a text, one of which more than `most` hold."""
    own = F.struct(F.shiftright("place", 1).alias("at"), "seed", (F.col("n") > most).alias("heavy"))
    by_text = held.groupBy("id").agg(F.array_sort(F.collect_list(own)).alias("all")).where(F.exists("all", lambda a: a["heavy"]))
    two = lambda a, b: F.struct(F.xxhash64(a["seed"], b["seed"]).alias("seed"), a["at"].alias("at"), (a["heavy"] | b["heavy"]).alias("heavy"), (b["at"] - a["at"]).alias("gap"))
    every = by_text.select("id", F.explode(F.flatten(F.transform("all", lambda a, i: F.transform(F.slice("all", i + 2, NEAR), lambda b: two(a, b))))).alias("x"))
    some = every.where(F.col("x.heavy") & (F.col("x.gap") <= NEAR_WORDS))
    return some.groupBy(F.col("x.seed").alias("seed"), "id").agg((F.min("x.at") * 2 + 1).alias("place"))


def alike(linked: DataFrame, slack: float = 1 - AGREE) -> DataFrame:
    """id, leader, places (x, y) and `first` of the linked texts that two seeds may put in one passage; `first` where seeds do so whose leader this is.
    Places of seeds that recur are not all known, so any second seed does with these; one that recurs in both does alone."""
    pairs = linked.groupBy("id", "leader").agg(F.collect_list(F.struct("x", "y", "first")).alias("all"))
    step = lambda a, b, c: F.shiftright(b[c], 1) - F.shiftright(a[c], 1)
    close = lambda a, b: step(a, b, "x").between(1, REACH) & step(a, b, "y").between(1, REACH) & (F.abs(step(a, b, "x") - step(a, b, "y")) <= F.lit(int(REACH * slack)))
    recurs = lambda p, c: p[c].bitwiseAND(1) == 1

    def one_passage(places: str) -> Column:
        several = F.exists(places, lambda p: recurs(p, "x") | recurs(p, "y")) | F.exists(places, lambda a: F.exists(places, lambda b: close(a, b)))
        return F.exists(places, lambda p: recurs(p, "x") & recurs(p, "y")) | ((F.size(places) > 1) & several)

    # Each of the two looks through a column of its own, the second only where the first finds nothing.
    told = pairs.withColumn("of_first", F.filter("all", lambda p: p["first"])).withColumn("first", one_passage("of_first"))
    some = told.where(F.col("first") | one_passage("all"))
    return some.select("id", "leader", "first", F.when(~F.col("first"), F.transform("all", lambda p: F.struct(F.shiftright(p["x"], 1).alias("x"), F.shiftright(p["y"], 1).alias("y")))).alias("places"))


def in_order(h: np.ndarray, k: int = K) -> tuple[np.ndarray, ...]:
    """The k-word runs of a text by value: places, different values, and where each value's places begin and how many they are."""
    value = sum((h[i : len(h) - k + 1 + i] * WEIGHTS[i] for i in range(k)), np.zeros(max(len(h) - k + 1, 0), np.uint64))
    places = np.argsort(value, kind="stable")
    value = value[places]
    new = np.append(True, value[1:] != value[:-1]) if len(value) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return places, value[first], first, np.diff(np.append(first, len(value)))


def matched(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places x and y of the runs that two texts, each as in_order gives them, have in common."""
    (pa, va, sa, na), (pb, vb, sb, nb) = a, b
    _, i, j = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    most = np.maximum(na[i], nb[j])
    i, j = np.repeat(i, most), np.repeat(j, most)
    nth = np.arange(len(i)) - np.repeat(np.cumsum(most) - most, most)
    return pa[sa[i] + np.where(nth < na[i], nth, 0)], pb[sb[j] + np.where(nth < nb[j], nth, 0)]


def pieces(x: np.ndarray, y: np.ndarray, most: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches that follow each other in both texts as one: x, y and how many they are, at most `most`."""
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)
    at = np.arange(len(x))
    new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % most == 0
    first = np.flatnonzero(new)
    return x[first], y[first], np.diff(np.append(first, len(x)))


def chains(x: np.ndarray, y: np.ndarray, n: np.ndarray, k: int = K, gap_cost: float = GAP_COST) -> list[np.ndarray]:
    """Collinear chains of pieces (x[i], y[i]) of n[i] matches of k words: places in the input, in ascending order.

    The best predecessor of a piece is looked up in a Fenwick tree over y that holds prefix maxima of score plus gap_cost
    times the sum of a chain's ends. Each piece belongs to one chain, the best first.
    """
    order = np.lexsort((y, x))
    x, y, n = x[order], y[order], n[order]
    if len(x) == 1 or ((y - x == y[0] - x[0]).all() and ((x[1:] - x[:-1] - n[:-1]) * 2 * gap_cost <= k).all()):
        return [order]  # one diagonal without long gaps
    known = np.unique(np.concatenate([y, y + n - 1]))
    first, last = (np.searchsorted(known, y) + 1).tolist(), (np.searchsorted(known, y + n - 1) + 1).tolist()
    x, y, n = x.tolist(), y.tolist(), n.tolist()
    size = len(known)
    tree, held = [-np.inf] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    waiting: list[tuple[int, int]] = []
    for i in range(len(x)):
        while waiting and waiting[0][0] < x[i]:
            end, j = heappop(waiting)
            value, r = score[j] + gap_cost * (end + y[j] + n[j] - 1), last[j]
            while r <= size:
                if value > tree[r]:
                    tree[r], held[r] = value, j
                r += r & -r
        best, at, r = -np.inf, -1, first[i] - 1
        while r > 0:
            if tree[r] > best:
                best, at = tree[r], held[r]
            r -= r & -r
        score[i] = k + n[i] - 1
        if at >= 0:
            step = min(x[i] - x[at] - n[at] + 1, y[i] - y[at] - n[at] + 1, k)
            gained = best - gap_cost * (x[i] + y[i]) + step + gap_cost * 2 * step  # the words that a match covers are not skipped
            if gained > k:
                score[i], before[i] = gained + n[i] - 1, at
        heappush(waiting, (x[i] + n[i] - 1, i))
    used, out = [False] * len(x), []
    for i in np.argsort(-np.array(score), kind="stable").tolist():
        chain = []
        at = i
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(at)
            at = before[at]
        if chain:
            out.append(order[np.array(chain[::-1])])
    return out


def distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edits that turn a into b; words are replaced, put in or left out."""
    if len(a) == len(b):
        same = int((a != b).sum())
        if same <= 1:
            return same
    row = np.arange(len(b) + 1)
    span = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        step = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(np.concatenate([[i], step]) - span) + span
    return int(row[-1])


def extended(a: np.ndarray, b: np.ndarray, drop: int = DROP) -> tuple[int, int]:
    """How many words of both, from the start, agree on balance; and how many of those disagree."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, -2))
    fell = np.nonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > drop)[0]
    end = int(fell[0]) if len(fell) else n
    if not end or score[:end].max() <= 0:
        return 0, 0
    took = int(score[:end].argmax()) + 1
    return took, int((~same[:took]).sum())


def aligned(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, k: int = K, agree: float = AGREE) -> tuple[int, int, int, int] | None:
    """The passages a[from:to] and b[from:to] of a chain, with its ends extended; None if too few words agree."""
    edits, ax, by = 0, int(x[0]), int(y[0])
    for i, j, m in zip(x.tolist(), y.tolist(), n.tolist(), strict=True):
        if i > ax or j > by:
            gap_a, gap_b = a[ax : max(i, ax)], b[by : max(j, by)]
            edits += distance(gap_a, gap_b) if len(gap_a) and len(gap_b) else len(gap_a) + len(gap_b)
        ax, by = max(ax, i + m + k - 1), max(by, j + m + k - 1)
    left, wrong_left = extended(a[: x[0]][::-1], b[: y[0]][::-1])
    right, wrong_right = extended(a[ax:], b[by:])
    edits += wrong_left + wrong_right
    span = (int(x[0]) - left, ax + right, int(y[0]) - left, by + right)
    return span if edits <= (1 - agree) * max(span[1] - span[0], span[3] - span[2]) else None


def parted(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Aligned passages of a chain; one in which too few words agree is split at its widest gap, so that its parts are not lost."""
    out, waiting = [], [(x, y, n)]
    while waiting:
        x, y, n = waiting.pop()
        if x[-1] + n[-1] + K - 1 - x[0] < LEAST_CHAIN:
            continue
        if (span := aligned(a, b, x, y, n)) is not None:
            out.append(span)
        elif len(x) > 1:
            at = int(np.maximum(np.diff(x), np.diff(y)).argmax()) + 1
            waiting += [(x[:at], y[:at], n[:at]), (x[at:], y[at:], n[at:])]
    return out


def leaders(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """leader, pairs and lead_size: of each leader of the pairs (id, leader) how many it has, and the bytes of its text."""
    return pairs.groupBy("leader").agg(F.count("*").alias("pairs")).join(known.select(F.col("id").alias("leader"), F.col("size").alias("lead_size")), "leader")


def sent(pairs: DataFrame, known: DataFrame, led: DataFrame) -> DataFrame:
    """The pairs (id, leader), whether the text of `id` goes to that of `leader` rather than the other way, and the bytes of the text that goes.
    The shorter one does; a leader of many pairs stays, so that no task sends them all. led: what `leaders` gives."""
    sized = pairs.join(known.select("id", "size"), "id").join(led, "leader")
    own_goes = (F.col("size") <= F.col("lead_size")) | (F.col("pairs") > MOST_SENT)
    return sized.select("id", "leader", own_goes.alias("own_goes"), F.when(own_goes, F.col("size")).otherwise(F.col("lead_size")).alias("bytes"))


def shared_spans(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """id, start, end and other: aligned passages of both texts of each pair (id, leader, own_goes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}

        def keep(texts: dict[tuple[int, int], str]) -> None:
            """Hash the words of those texts that are not known, some of them together."""
            own = [(key, text) for key, text in texts.items() if key not in known]
            if sum(size for _, size in known) + sum(size for (_, size), _ in own) > KNOWN_CHARS:
                known.clear()
                own = list(texts.items())
            for x, y in chunked([text for _, text in own]):
                h, starts = byte_hashes([text for _, text in own[x:y]])
                for (key, _), a, b in zip(own[x:y], starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    known[key] = (some := h[a:b].copy()), in_order(some)

        for batch in batches:
            out, rows = [], list(batch.itertuples(index=False))
            for begin in range(0, len(rows), TOGETHER):
                some = rows[begin : begin + TOGETHER]
                keep({(i, len(text)): text for row in some for i, text in ((row.id, row.own_text), (row.leader, row.lead_text))})
                for row in some:
                    (a, own), (b, other) = known[row.id, len(row.own_text)], known[row.leader, len(row.lead_text)]
                    x, y, n = pieces(*matched(own, other))
                    for chain in chains(x, y, n) if len(x) else []:
                        for span in parted(a, b, x[chain], y[chain], n[chain]):
                            out += [(row.id, span[0], span[1], row.leader), (row.leader, span[2], span[3], row.id)]
            yield pd.DataFrame(out, columns=["id", "start", "end", "other"]).astype("int64")

    # Texts are too large to be broadcast at any size that matters; one plan for all sizes. Both joins read one shuffle of them.
    of = lambda i, text: texts.select(F.col("id").alias(i), F.col("text").alias(text)).hint("merge")
    either = lambda a, b: F.when(F.col("own_goes"), F.col(a)).otherwise(F.col(b))
    dealt = pairs.select("id", "leader", "own_goes", either("id", "leader").alias("goes"), either("leader", "id").alias("stays"))
    met = dealt.join(of("goes", "text_there"), "goes").join(of("stays", "text_here"), "stays")
    own = met.select("id", "leader", either("text_there", "text_here").alias("own_text"), either("text_here", "text_there").alias("lead_text"))
    return own.mapInPandas(run, "id long, start long, end long, other long")


def merged(spans: list, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """Overlapping and touching (start, end, other) as one, with the least `other`; those of `least` words or more."""
    out: list[list[int]] = []
    for start, end, other in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], end), min(out[-1][2], other)
        else:
            out.append([start, end, other])
    return [tuple(s) for s in out if s[1] - s[0] >= least]


def passages_of(found: DataFrame, least: int) -> DataFrame:
    """id and own: the merged passages (start, end, other) of each text, in order."""
    # Of the passages that begin at one word the longest: no more rows for a leader than it has words.
    spans = found.groupBy("id", "start").agg(F.max("end").alias("end"), F.min("other").alias("other"))

    @F.pandas_udf("array<struct<start: long, end: long, other: long>>")
    def merge(each: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "other": o} for s, e, o in merged([(x["start"], x["end"], x["other"]) for x in own], least)] for own in each])

    return spans.groupBy("id").agg(F.collect_list(F.struct("start", "end", "other")).alias("own")).select("id", merge("own").alias("own"))


def uncovered(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """id and leader of the pairs (id, leader, places) that share a seed outside the passages (id, own) of one of the two."""
    of = lambda i, name: known.select(F.col("id").alias(i), F.col("own").alias(name))
    met = pairs.join(of("id", "own_x"), "id", "left").join(of("leader", "own_y"), "leader", "left")
    inside = lambda at, own: F.exists(own, lambda s: (s["start"] <= at) & (at + K <= s["end"]))
    new = F.col("own_x").isNull() | F.col("own_y").isNull() | F.exists("places", lambda p: ~inside(p["x"], F.col("own_x")) | ~inside(p["y"], F.col("own_y")))
    return met.where(new).select("id", "leader")


def described(texts: DataFrame) -> DataFrame:
    """Of each id of texts (id, text): size, the bytes of its text, and digest, null if its rows hold different texts."""
    each = texts.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size"))
    one = each.groupBy("id").agg(F.min("digest").alias("digest"), F.max("digest").alias("last"), F.max("size").alias("size"))
    return one.select("id", F.when(F.col("digest") == F.col("last"), F.col("digest")).alias("digest"), "size")


def heads(known: DataFrame) -> DataFrame:
    """digest and head: of every text that several ids have the least of these."""
    return known.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").drop("last")


def copies(known: DataFrame, first: DataFrame) -> DataFrame:
    """id and head: every id whose text a smaller id has too, and the least of these. first: what `heads` gives."""
    return known.join(first, "digest").where("id > head").select("id", "head")


def repeated_passages(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Passages of at least `least` words that other documents repeat, perhaps with some words changed.

    One row for each: doc_id, passage (from 0), start and end (words, split at white space, end exclusive) and other, the
    least doc_id known to share it. Null and empty texts and rows without doc_id have none; repeated rows of one doc_id are
    one document; letter case is ignored.
    """
    texts = needs(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").toDF("id", "text")
    known = written(described(texts), tidy=True)
    (size,) = total(known, "size")
    one = F.lit(1)
    parts = lambda n: max(1, -(-n // max(LEAST_ROOM, int(size * ROOM))))
    first = written(heads(known), tidy=True)
    copied = written(copies(known, first), tidy=True)
    discard(first)
    sown = written(seeds(texts.join(copied.select("id").hint("shuffle_hash"), "id", "left_anti")), tidy=True)
    held = in_parts(held_seeds, sown.where("seed IS NOT NULL"), parts(total(sown, one)[0] * SEED_BYTES), "seed")
    words = sown.where("seed IS NULL").groupBy("id").agg(F.max("place").cast("long").alias("end"))
    whole = written(copied.groupBy(F.col("head").alias("id")).agg(F.min("id").alias("other")).join(words, "id").select("id", F.lit(0).cast("long").alias("start"), "end", "other"), tidy=True)
    discard(sown)
    rows, heavy = total(held, one, (F.col("n") > MOST_HOLDERS).cast("long"))
    linked = in_parts(lambda some: links(some, MOST_HOLDERS), held, parts(rows * LINK_BYTES), "seed")
    near = in_parts(lambda some: near_seeds(some, MOST_HOLDERS), held, parts((rows + heavy * NEAR) * LINK_BYTES), "id")
    discard(held)
    more = in_parts(lambda some: links(held_seeds(some), MOST_HOLDERS).withColumn("first", F.lit(False)), near, parts(total(near, one)[0] * (SEED_BYTES + LINK_BYTES)), "seed")
    discard(near)
    every = linked.union(more)
    met = in_parts(alike, every, parts(total(every, one)[0] * LINK_BYTES), "id", "leader")
    discard(linked)
    discard(more)

    def spans(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, tidy=True)
        led = written(leaders(pairs, known), tidy=True)
        dealt = written(sent(pairs, known, led), tidy=True)
        discard(pairs)
        discard(led)
        # Each part shuffles all texts besides those that go.
        found = in_parts(lambda some: shared_spans(some, texts), dealt, max(1, -(-total(dealt, "bytes")[0] // max(LEAST_ROOM, size))), "id", "leader")
        discard(dealt)
        return found

    found = spans(met.where("first").select("id", "leader"))
    again = spans(uncovered(met.where("NOT first"), passages_of(found.union(whole), least)))
    own = written(passages_of(found.union(whole).union(again), least).select("id", F.posexplode("own").alias("passage", "x")).select("id", "passage", "x.start", "x.end", "x.other"), tidy=True)
    for table in (known, whole, met, found, again):
        discard(table)
    of_copies = copied.join(own.withColumnRenamed("id", "head"), "head").select("id", "passage", "start", "end", F.least("other", "head").alias("other"))
    return own.union(of_copies).withColumnRenamed("id", "doc_id")


def without_repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """docs without the passages that documents of a smaller doc_id hold too; other columns stay as they are.

    Words that stay are joined by single spaces where a passage went; texts without one are unchanged.
    """
    found = repeated_passages(docs, least).where("other < doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("gone"))

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, gone, strict=True):
            words = (text or "").split()
            for span in sorted(spans, key=lambda s: -s["start"]):
                del words[span["start"] : span["end"]]
            out.append(" ".join(words))
        return pd.Series(out)

    found = found.withColumnRenamed("doc_id", "of")
    met = docs.join(found, docs["doc_id"] == found["of"], "left")
    text = F.when(found["gone"].isNull() | docs["text"].isNull(), docs["text"]).otherwise(cut_out(docs["text"], F.coalesce(found["gone"], F.array()))).alias("text")
    return met.select(*(text if c == "text" else docs[c] for c in docs.columns))

"""Phrase collocations by suffix-sigma.

Every place of a text gives the suffix that begins there, of max_n words at most and within its piece. Suffixes are counted where
they are, dealt out by language and first word and sorted in reverse lexicographic order, and one stack of words counts all their
prefixes: a word that leaves the stack takes its count with it and adds it to the word below. Parts of phrases meet afterwards.

- Suffixes are dealt into ranges of their order, so that a hot first word, or pair, spans ranges. Only prefixes of a range's first and
  last suffix can go on elsewhere; their counts are added up afterwards, those of all others are whole and are dropped if too small.
- A phrase is as frequent as each of its words and pairs at most. Words and pairs are counted beforehand in a fixed number of slots
  by their hashes; a slot below the least count holds none that a candidate can have, so suffixes end before such pairs. Longer phrases
  of what is left are counted in slots likewise, so suffixes end with the longest phrase that may be frequent enough. The filter
  never loses a candidate. On more words than it has room for it spares less, down to nothing; counts remain the same.
- A phrase scores 1000 * n / f at most, where f counts its first or last word. So phrases that begin or end with a hot word, of f above
  a bound, are not scored while enough others score higher than that allows; a language where they don't is counted again with all its
  phrases. Parts of scored phrases, and phrases a word longer, begin or end with a word that is not hot; these are counted whole. Words
  and pairs that only occur where no phrase around them can be scored are not counted by themselves (marks).
- Words are joined by NUL, below all letters, so that suffixes with one prefix are neighbours; a NUL in a text is escaped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeledger.llm.shared import needs, written
from routeledger.llm.words import GOLDEN, Memo, chunked, mix

SLOT_BITS, BLOCK_BITS = 27, 20
#: Different suffixes that a task counts before it sends them on.
HELD_SUFFIXES = 400_000
#: Different words that a task counts before it forgets the rarer half, and hot words of all languages together.
HELD_WORDS, HOT_WORDS = 400_000, 200_000
#: Words are hot above so many times the least count, as far as tasks have met each a 64th of it.
HOT_TIMES, HOT_SHARE = 40, 64
_ALONE, _PAIR = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5A5A5A5A5A5A5A5A)
_SEPARATORS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_BREAK, _NOTHING = np.uint64(1), np.uint64(0)


def _hash(word: bytes) -> int:
    return 0 if not word else 1 if word == b"\n" else max(2, xxhash.xxh64_intdigest(word))


def _escaped(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    if b"\x00" in data or b"\x01" in data:
        data = data.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")
    return data


def _plain(joined: Column) -> Column:
    return F.replace(F.replace(F.replace(joined, F.lit("\x00"), F.lit(" ")), F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))


def _split(texts: list[str]) -> list[bytes]:
    """Words and, as b"\\n", ends of pieces; some are empty."""
    return b"\n".join(map(_escaped, texts)).lower().translate(_SEPARATORS).replace(b"\n", b" \n ").split(b" ")


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    by: dict[str, list[str]] = {}
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
        if text:
            by.setdefault(lang, []).append(text)
    for lang, own in by.items():
        for a, b in chunked(own):
            yield lang, own[a:b]


class Words:
    """Words of some texts of one language: each with its hash and that of the pair that it begins (0 at the end of a piece)."""

    def __init__(self, lang: str, texts: list[str], memo: Memo):
        words = np.array(_split(texts), object)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        some = h != _NOTHING
        words, h = words[some], h[some]
        real = h != _BREAK
        salt = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))
        pair = np.zeros(len(h), np.uint64)
        both = np.flatnonzero(real[:-1] & real[1:])
        pair[both] = mix(h[both] * GOLDEN ^ mix(h[both + 1] ^ salt)) | np.uint64(1)
        self.lang, self.words, self.word, self.pair = lang, words[real], mix(h[real] ^ salt), pair[real]

    def longer(self, m: np.ndarray, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length from 3 to max_n: the places whose suffix of m words is as long, and a hash of the phrase of that length there."""
        at, h = np.flatnonzero(m > 1), None
        for n in range(3, max_n + 1):
            h = self.pair[at] if h is None else h
            more = m[at] >= n
            at, h = at[more], h[more]
            h = mix(h * GOLDEN ^ self.word[at + n - 1])
            yield n, at, h

    @classmethod
    def of(cls, batch: pa.RecordBatch, memo: Memo) -> Iterator[tuple[str, Words]]:
        for lang, own in _chunks(batch):
            yield lang, cls(lang, own, memo)


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _words_and_pairs(w: Words) -> np.ndarray:
    return np.concatenate([w.word, w.pair[w.pair != 0]])


def is_set(bits_of: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    s = slots(h, bits)
    return (bits_of[s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1).astype(bool)


def frequent_slots(texts: DataFrame, least: int, bits: int = SLOT_BITS, hashes: Callable[[Words], np.ndarray] = _words_and_pairs) -> np.ndarray:
    """Bits of the slots to which `least` words or pairs (or other `hashes`), or more, are hashed: 2^bits of them, packed, whatever the input's size."""
    block = min(bits, BLOCK_BITS)
    kind = np.uint8 if least <= 255 else np.uint16  # counts stop at the least one that matters
    most = min(least, np.iinfo(kind).max)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = Memo(_hash), np.zeros(1 << bits, kind)
        for batch in batches:
            for _, w in Words.of(batch, memo):
                at, n = np.unique(slots(hashes(w), bits), return_counts=True)
                seen[at] = np.minimum(seen[at] + n, most)
        for b in range(1 << (bits - block)):
            own = seen[b << block : (b + 1) << block]
            at = np.flatnonzero(own)
            if len(at):
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "at": [at.astype(np.int32).tobytes()], "n": [own[at].tobytes()]}, pa.schema([("block", pa.int32()), ("at", pa.binary()), ("n", pa.binary())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, at, n in zip(*(batch[c].to_pylist() for c in ("block", "at", "n")), strict=True):
                own = sums.setdefault(b, np.zeros(1 << block, np.int64))
                own[np.frombuffer(at, np.int32)] += np.frombuffer(n, kind)
        for b, own in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "bits": pa.array([np.packbits(own >= most).tobytes()], pa.binary())})

    n_blocks = 1 << (bits - block)
    counted = texts.mapInArrow(count, "block int, at binary, n binary").repartition(n_blocks, "block").mapInArrow(add, "block int, bits binary")
    out = np.zeros((n_blocks, max(1, (1 << block) >> 3)), np.uint8)
    for row in counted.collect():  # 2^bits bits in all
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def hot_words(texts: DataFrame, above: int) -> dict[str, set[bytes]]:
    """Words of each language that occur more than `above` times: not all of them, but no others, as counts leave places out and add none."""
    share = max(1, above // HOT_SHARE)
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, own in _chunks(batch):
                held.setdefault(lang, Counter()).update(_split(own))
                if sum(map(len, held.values())) > HELD_WORDS:
                    held = {k: Counter(dict(seen.most_common(len(seen) // 2))) for k, seen in held.items()}
        for lang, seen in held.items():
            some = [(w, n) for w, n in seen.items() if n >= share and w not in (b"", b"\n")]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([w for w, _ in some], pa.binary()), pa.array([n for _, n in some], pa.int64())], schema=schema)

    counted = texts.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") > above)
    found: dict[str, set[bytes]] = {}
    for row in counted.orderBy(F.desc("n")).limit(HOT_WORDS).collect():
        found.setdefault(row["lang"], set()).add(bytes(row["word"]))
    return found


def up_to_cold(m: np.ndarray, cold: np.ndarray) -> np.ndarray:
    """Words of the suffix at each place: of one that begins with a hot word only those up to its last cold word."""
    at = np.arange(len(m))
    last = np.maximum.accumulate(np.where(cold, at, -1))[at + np.maximum(m, 1) - 1]
    return np.where(cold | (m == 0), m, np.maximum(0, last - at + 1))


def cold_words(w: Words, hot: set[bytes]) -> np.ndarray:
    return ~np.fromiter(map(hot.__contains__, w.words), bool, len(w.words))


def marks(w: Words, m: np.ndarray, cold: np.ndarray) -> np.ndarray:
    """Hashes of the words and pairs that may be parts of a scored phrase at their place, for suffixes of m words up to their last cold one."""
    before = lambda x, n: np.concatenate([np.zeros(n, bool), x])[: len(x)]
    both, long = cold & (m > 1) & np.append(cold[1:], False), m > 2
    word = cold & (both | long | before(both, 1) | before(long, 2))
    pair = both | (m > 1) & np.where(cold, long, before(long, 1))
    return np.concatenate([mix(w.word[word] ^ _ALONE), mix(w.pair[pair] ^ _PAIR)])


def lengths(good_word: np.ndarray, good_pair: np.ndarray, max_n: int) -> np.ndarray:
    """Words of the suffix at each place: 0 where the word is rare, else up to the first rare pair."""
    n = len(good_word)
    ends = np.append(np.flatnonzero(~good_pair), n)
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1
    return np.where(good_word, np.minimum(to_end, max_n), 0)


def frequent_phrases(texts: DataFrame, filter_bits: Broadcast, least: int, max_n: int, bits: int = SLOT_BITS, hot: Broadcast | None = None) -> np.ndarray:
    """frequent_slots of the phrases of three words or more whose words and pairs are in frequent slots; in languages with hot words, also of marks."""

    def hashes(w: Words) -> np.ndarray:
        m = lengths(is_set(filter_bits.value, w.word, bits), (w.pair != 0) & is_set(filter_bits.value, w.pair, bits), max_n)
        own = [np.empty(0, np.uint64)]
        if hot is not None and w.lang in hot.value and len(m):
            cold = cold_words(w, hot.value[w.lang])
            m = up_to_cold(m, cold)
            own.append(marks(w, m, cold))
        return np.concatenate([*own, *(h for _, _, h in w.longer(m, max_n))])

    return frequent_slots(texts, least, bits, hashes)


def suffixes(texts: DataFrame, filter_bits: Broadcast, phrase_bits: Broadcast, max_n: int, bits: int = SLOT_BITS, hot: Broadcast | None = None) -> DataFrame:
    """lang, suffix and n: suffixes counted within each task, and the number of all words of a language where suffix is null.

    With `hot` words of each language, what begins and ends with a hot word is not counted whole."""
    schema = pa.schema([("lang", pa.string()), ("suffix", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, totals, filled = Memo(_hash), {}, Counter(), 0
        good = lambda h: is_set(filter_bits.value, h, bits)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in held.items():
                for at in range(0, len(keys := list(own)), 50_000):
                    some = keys[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([own[k] for k in some], pa.int64())], schema=schema)
            held.clear()

        for batch in batches:
            for lang, w in Words.of(batch, memo):
                totals[lang] += len(w.words)
                if not len(w.words):
                    continue
                m = lengths(good(w.word), (w.pair != 0) & good(w.pair), max_n)
                for length, at, h in w.longer(m.copy(), max_n):
                    rare = at[~is_set(phrase_bits.value, h, bits)]
                    m[rare] = np.minimum(m[rare], length - 1)
                if hot is not None and lang in hot.value:
                    cold = cold_words(w, hot.value[lang])
                    m = up_to_cold(m, cold)
                    for n, hashes, salt in ((2, w.pair, _PAIR), (1, w.word, _ALONE)):
                        at = np.flatnonzero(m == n)
                        at = at[~is_set(phrase_bits.value, mix(hashes[at] ^ salt), bits)]
                        m[at] = cold[at] & (n > 1)
                own, words = held.setdefault(lang, Counter()), w.words.tolist()
                before = len(own)
                at = np.flatnonzero(m)
                own.update([b"\x00".join(words[a:b]) for a, b in zip(at.tolist(), (at + m[at]).tolist(), strict=True)])
                filled += len(own) - before
                if filled > HELD_SUFFIXES:
                    yield from flush()
                    filled = 0
        yield from flush()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([None] * len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], schema=schema)

    return texts.mapInArrow(run, "lang string, suffix string, n long")


class Stack:
    """Counts of all prefixes of suffixes that come in order: a stack of words with a count each."""

    def __init__(self, least: int):
        self.least, self.lang, self.words, self.counts = least, None, [], []
        #: Depth of the prefixes in the stack that the first suffix of the range has too.
        self.first = None
        self.found: list[tuple[str, bytes, int]] = []

    def pop(self, depth: int, last: bool = False) -> None:
        words, counts = self.words, self.counts
        while len(words) > depth:
            n = counts.pop()
            if n >= self.least or len(words) <= self.first or last:
                self.found.append((self.lang, b"\x00".join(words), n))
            words.pop()
            if counts:
                counts[-1] += n
        self.first = min(self.first, depth)

    def add(self, lang: str, suffix: bytes, n: int) -> None:
        words, own = suffix.split(b"\x00"), self.words
        if self.first is None:
            self.first = len(words)
        else:
            same, most = 0, min(len(own), len(words)) if lang == self.lang else 0
            while same < most and own[same] == words[same]:
                same += 1
            self.pop(same)
        self.lang = lang
        own += words[len(own) :]
        self.counts += [0] * (len(own) - len(self.counts))
        self.counts[-1] += n


def prefix_counts(counted: DataFrame, least: int) -> DataFrame:
    """lang, phrase and f of every phrase with f >= least, from suffixes (lang, suffix, n)."""
    order = [F.desc("lang"), F.desc("suffix")]
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(least)

        def found() -> pa.RecordBatch:
            langs, phrases, n = zip(*stack.found, strict=True) if stack.found else ((), (), ())
            stack.found.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], schema=schema)

        for batch in batches:
            for lang, suffix, n in zip(batch["lang"].to_pylist(), batch["suffix"].cast(pa.binary()).to_pylist(), batch["n"].to_pylist(), strict=True):
                stack.add(lang, suffix, n)
            yield found()
        if stack.first is not None:
            stack.pop(0, last=True)
            yield found()

    dealt = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    whole = dealt.select("lang", "suffix", "n").mapInArrow(run, "lang string, phrase string, f long")
    return whole.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def big(x: Column) -> Column:
    return x.cast(T.DecimalType(19, 0))


def scored(counted: DataFrame, totals: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """lang, phrase, a, l, r, n and score of every counted (or chosen) phrase of two words or more, by the cut that scores lowest."""
    words = F.split("phrase", "\x00")
    part = lambda at, n: F.array_join(F.slice(words, at, n), "\x00")
    cuts = (counted if chosen is None else chosen).where(F.size(words) > 1).select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("*", part(1, F.col("k")).alias("left_part"), part(F.col("k") + 1, F.size(words)).alias("right_part"))
    of = lambda name, f: counted.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    met = cuts.join(of("left_part", "l"), ["lang", "left_part"]).join(of("right_part", "r"), ["lang", "right_part"]).join(totals, "lang")
    score = F.expr("cast(1000 * cast(a as decimal(19, 0)) * cast(n as decimal(15, 0)) as decimal(38, 0)) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = met.select("lang", "phrase", F.struct(score.alias("score"), "k", "a", "l", "r", "n").alias("cut")).groupBy("lang", "phrase").agg(F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def between_cold(counted: DataFrame, hot: dict[str, set[bytes]]) -> DataFrame:
    """The counted phrases of two words or more that neither begin nor end with a hot word."""
    words = F.split("phrase", "\x00")
    found = counted.where(F.size(words) > 1)
    if hot:
        table = counted.sparkSession.createDataFrame([(lang, word.decode("utf-8", "surrogatepass")) for lang, own in hot.items() for word in own], "lang string, word string")
        for at in (1, -1):
            found = found.withColumn("word", F.element_at(words, at)).join(F.broadcast(table), ["lang", "word"], "left_anti").drop("word")
    return found


def without_contained(chosen: DataFrame, counted: DataFrame, percent: int = 100) -> DataFrame:
    """Chosen phrases whose words do not lie in a longer counted one with at least percent / 100 of their count.

    A phrase one word longer between the two is as frequent as the longest, so those of one word more tell.
    """
    words = F.split("phrase", "\x00")
    n = F.size(words)
    inner = F.explode(F.array(F.array_join(F.slice(words, 1, n - 1), "\x00"), F.array_join(F.slice(words, 2, n - 1), "\x00")))
    longer = counted.where(n > 2).select("lang", inner.alias("phrase"), F.col("f").alias("most")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    hidden = chosen.join(longer, ["lang", "phrase"]).where(big(F.col("most")) * 100 >= big(F.col("f")) * percent).select("lang", "phrase")
    return chosen.join(hidden, ["lang", "phrase"], "left_anti")


def collocations(docs: DataFrame, max_n: int = 5, least: int = 100, top: int = 2000, percent: int = 100, slot_bits: int = SLOT_BITS) -> DataFrame:
    """The first `top` collocations of each language: lang, rank, phrase, a, l, r, n and score.

    docs has lang and text; other columns are left out. A null text is empty, a null lang is `und`. Repeated rows count each. Ties go by
    a, then by the phrase's bytes. A language without candidates, and an empty table, give no rows.
    """
    rows = needs(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    send, above = rows.sparkSession.sparkContext.broadcast, HOT_TIMES * least
    hot = hot_words(rows, above)
    sent = send(hot)
    words_and_pairs = send(frequent_slots(rows, least, slot_bits))
    longer = send(frequent_phrases(rows, words_and_pairs, least, max_n, slot_bits, sent))

    def kept_of(texts: DataFrame, longer: Broadcast, hot: dict[str, set[bytes]], sent: Broadcast | None) -> DataFrame:
        found = written(suffixes(texts, words_and_pairs, longer, max_n, slot_bits, sent))
        totals = found.where("suffix is null").groupBy("lang").agg(F.sum("n").alias("n"))
        counted = written(prefix_counts(found.where("suffix is not null"), least))
        return written(scored(counted, totals, without_contained(between_cold(counted, hot), counted, percent)))

    kept = kept_of(rows, longer, hot, sent)
    if hot:
        high = kept.where(F.expr(f"score > cast(1000 * cast(n as decimal(19, 0)) as decimal(38, 0)) div {above + 1}"))
        again = sorted(set(hot) - {row["lang"] for row in high.groupBy("lang").count().where(F.col("count") >= top).collect()})
        if again:
            texts = rows.where(F.col("lang").isin(again))
            whole = send(frequent_phrases(texts, words_and_pairs, least, max_n, slot_bits))
            kept = kept.where(~F.col("lang").isin(again)).unionByName(kept_of(texts, whole, {}, None))
    kept = kept.select("lang", _plain(F.col("phrase")).alias("phrase"), "a", "l", "r", "n", "score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    first = some.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _oracle(max_n: int = 5, least: int = 100, top: int = 2000, percent: int = 100) -> str:
    """The same in SQL, with all phrases of all lengths counted outright."""
    return rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
grams AS (SELECT lang, w[i:i + m - 1] AS g FROM places, range(1, {max_n + 1}) AS lengths(m) WHERE i + m - 1 <= len(w)),
counted AS MATERIALIZED (SELECT lang, g, count(*)::HUGEINT AS f FROM grams GROUP BY lang, g HAVING count(*) >= {least}),
cuts AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM counted WHERE len(g) > 1),
met AS (SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, n, (1000 * c.a * n) // (x.f * y.f) AS score FROM cuts c
  JOIN counted x ON x.lang = c.lang AND x.g = c.g[:k] JOIN counted y ON y.lang = c.lang AND y.g = c.g[k + 1:] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, a, unnest(list_concat(list_transform(range(1, len(g)), lambda j: g[:j]), list_concat(list_transform(range(2, len(g) + 1), lambda j: g[j:]),
  list_concat(list_transform(range(2, len(g)), lambda j: g[2:j]), list_transform(range(3, len(g)), lambda j: g[3:j]))))) AS g FROM best),
longer AS (SELECT lang, g, max(a) AS a FROM inside GROUP BY lang, g),
kept AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.g = b.g WHERE o.a IS NULL OR 100 * o.a < {percent} * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {top}
"""


ORACLE = _oracle()

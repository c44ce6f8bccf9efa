"""Hashes of words and word shingles over Arrow batches, with numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

#: Entries that a worker's memo of words may hold before it starts afresh.
MEMO_WORDS = 200_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Memo(dict):
    """What a function gives for each word, kept for the words seen lately."""

    def __init__(self, of: Callable, most: int = MEMO_WORDS):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = found = self.of(word)
        return found


def hash_word(word: str) -> int:
    return xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"))


def hashed(words: list[str], memo: Memo) -> np.ndarray:
    """A 64-bit hash for each word; letter case is ignored."""
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; empty if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out * GOLDEN) ^ mix(h[i : i + n] + np.uint64(i))
    return mix(out)


#: Characters of texts whose words are hashed together.
CHUNK_CHARS = 1 << 20


def chunked(texts: list[str | None], most: int = CHUNK_CHARS) -> list[tuple[int, int]]:
    """Ranges of texts of about `most` characters, of one text at least."""
    out, at, size = [], 0, 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > at and size + n > most:
            out.append((at, i))
            at, size = i, 0
        size += n
    return [*out, (at, len(texts))] if len(texts) > at else out


def word_hashes(texts: list[str | None], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of some texts, one after another, and where each text's begin (one more entry
    than texts). A null text has no words."""
    words: list[str] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        if text:
            words += text.lower().split()
        starts[i + 1] = len(words)
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words)), starts


_TO_SPACE = bytes.maketrans(bytes([*range(9, 14), *range(28, 32)]), b" " * 9)
#: Odd weights of places.
WEIGHTS = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def byte_hashes(texts: list[str | None], most: int = CHUNK_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes, without a look at each word: a word's hash is the sum of its UTF-8 bytes, each weighted by its place, mixed."""
    own = [(low if (low := (text or "").lower()).isascii() else " ".join(low.split())).encode("utf-8", "surrogatepass") for text in texts]
    at = np.cumsum([0, *(len(x) + 1 for x in own)])
    data = b" ".join([*own, b""]).translate(_TO_SPACE)
    out, firsts, begin = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while begin < len(data):  # about `most` bytes at a time, cut at a space
        end = data.find(b" ", begin + most) + 1 or len(data)
        raw = np.frombuffer(data, np.uint8, end - begin, begin)
        letter = raw != 32
        edge = np.flatnonzero(np.diff(letter, prepend=False))  # the last byte is a space
        first, n = edge[::2], edge[1::2] - edge[::2]
        if len(first):
            head = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(head, n)
            weights = WEIGHTS if n.max() <= len(WEIGHTS) else mix(np.arange(1, int(n.max()) + 1, dtype=np.uint64)) | np.uint64(1)
            out.append(mix(np.add.reduceat((raw[letter].astype(np.uint64) + np.uint64(1)) * weights[place], head)))
            firsts.append(first + begin)
        begin = end
    return np.concatenate(out), np.searchsorted(np.concatenate(firsts), at)


def lower_memo() -> Memo:
    """Hashes of words that are in lower case already."""
    return Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))


def runs(starts: np.ndarray, k: int) -> np.ndarray:
    """Whether a run of k words that begins at each word ends in the same text."""
    n = int(starts[-1])
    end = np.repeat(starts[1:], np.diff(starts))
    return np.arange(n) + k <= end

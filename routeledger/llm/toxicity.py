"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct words, pairs of neighbours and pairs with one word between, hashed to 2^20 places.
Labelled rows, a bounded sample of them, are dealt over `shards` tasks (one by default: the method learns from one row
after another, and its sample does not grow with the corpus); each runs FTRL-proximal passes over its own rows, with a
rate of its own for every coordinate and an L1 penalty that keeps nearly all weights at zero. The shards' weights are averaged in Spark. What is left is a sparse table, at most 2^20 entries and in practice a few hundred, that
is broadcast to score every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeledger.llm.shared import needs
from routeledger.llm.words import GOLDEN, Memo, hash_word, hashed, mix

BITS = 20
#: Labelled rows that training takes at most; of more, those with the smallest hashes.
SAMPLE_ROWS = 16_000
THRESHOLD = 0.3
STRIPPED = ".,;:!?\"'()[]{}|<>*_-–—…«»“”‘’#"


class Rates(NamedTuple):
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 1.0
    passes: int = 4
    shards: int = 1


def word_memo() -> Memo:
    return Memo(lambda w: hash_word(w.strip(STRIPPED)))


def features(text: str | None, memo: Memo) -> np.ndarray:
    """Places of all words, pairs and skip-grams of a text, repeats included; none for a null or empty text."""
    h = hashed((text or "").split(), memo)
    parts = [mix(h ^ np.uint64(1))]
    for gap in (1, 2):
        if len(h) > gap:
            parts.append(mix(h[:-gap] * GOLDEN + mix(h[gap:]) + np.uint64(gap)))
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def ftrl(rows: list[tuple[np.ndarray, int]], rates: Rates) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights other than zero after some passes over (distinct places, label); place 2^20 is the intercept."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    l1 = np.full((1 << BITS) + 1, rates.l1)
    l1[-1] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1[at], 0.0)
        return -shrunk / ((rates.beta + np.sqrt(n[at])) / rates.alpha + rates.l2 * (at < 1 << BITS))

    for _ in range(rates.passes):
        for places, label in rows:
            at = np.append(places, 1 << BITS)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / rates.alpha * w
    every = np.append(np.nonzero(np.abs(z[:-1]) > rates.l1)[0], 1 << BITS)
    return every, weights(every)


def train(docs: DataFrame, labels: DataFrame, rates: Rates = Rates(), sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> dict[int, float]:
    """Weights by place, learned from the rows of `labels` (doc_id, toxic) that are given; null labels are left out.

    A doc_id with several labels counts once, as toxic if one of them says so, and one with several texts with the least of them. Without any labelled row all scores are 0.5.
    """
    known = needs(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    total = known.count()
    if total > sample_rows:
        some = min(1 << 30, int((1 << 30) * sample_rows / total * 1.2) + (1 << 20))
        known = known.where(order < some).orderBy(order, "doc_id").limit(sample_rows)  # always the same rows
    # At most sample_rows rows, so that broadcasting them is safe.
    some = needs(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    some = some.withColumn("shard", F.pmod(order, F.lit(rates.shards)))

    def learn(shard: pd.DataFrame) -> pd.DataFrame:
        memo = word_memo()
        shard = shard.sort_values(["order", "doc_id"], kind="stable")
        rows = [(np.unique(features(t, memo)).astype(np.int32), int(y)) for t, y in zip(shard["text"], shard["toxic"], strict=True)]
        places, w = ftrl(rows, rates)
        return pd.DataFrame({"place": places, "w": w})

    ran = some.withColumn("order", order).groupBy("shard").applyInPandas(learn, "place long, w double")
    mean = ran.groupBy("place").agg((F.sum("w") / rates.shards).alias("w")).where("w <> 0")
    return {row["place"]: row["w"] for row in mean.collect()}  # at most 2^20 + 1 rows


def score(docs: DataFrame, model: dict[int, float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with `score` (0 to 1; that of an empty text is the intercept's) and `predicted`, in place of columns of these names. All rows are kept; a null text
    scores as an empty one, long texts are read whole, and repeated rows and rows without doc_id are scored each."""
    dense = np.zeros(1 << BITS)
    for place, w in model.items():
        if place < 1 << BITS:
            dense[place] = w
    used = np.nonzero(dense)[0]
    sent = docs.sparkSession.sparkContext.broadcast((used, dense[used], model.get(1 << BITS, 0.0)))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places, w, intercept = sent.value
        memo, table = word_memo(), np.zeros(1 << BITS, np.float32)
        table[places] = w
        for texts in batches:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                at = features(text, memo)
                out[i] = table[np.unique(at[table[at] != 0])].sum(dtype=float) + intercept
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(out, -30, 30))))

    scored = docs.withColumn("score", probability(docs["text"]))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))

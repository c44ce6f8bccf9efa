"""Exact top-k search by inner product, with a three-phase uniform threshold.

A vector's components are dealt into `blocks` lists; its score is the sum of its partial scores, one in each list.
1. Every partition gathers, for each query and list, its k best partial scores, and sends the k best full scores of
   those entries. The k-th best score of a query over all partitions is a safe cutoff: k entries reach it.
2. The cutoffs of a block of queries are broadcast. An entry that reaches the cutoff c has a partial score of at least
   c / blocks in some list, so every partition collects the entries that do.
3. Only the collected entries are resolved: their partial scores are added in exact integers, and each partition sends its k
   best that reach the cutoff. The k best of those are the result.
Queries go in blocks of bounded size, each broadcast once per phase; no task holds more than a slice of vectors by a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeledger.llm.shared import cut, needs

QUERY_BLOCK_BYTES = 32 << 20
SLICE = 512
SCORES = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and `v`, the components as integers floor(scale * x). Rows with a null vec_id, a null vector, or a
    component that is null or not finite are left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = needs(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.forall("embedding", finite))
    return rows.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def matrix(rows: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows of int64; shorter ones are filled up with zeros, which add nothing to a product."""
    values, ends = rows.flatten().to_numpy(zero_copy_only=False), np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))
    lengths = np.diff(ends, prepend=0)
    out = np.zeros((len(rows), max(dims, int(lengths.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(rows)), lengths), np.arange(len(values)) - np.repeat(ends - lengths, lengths)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of a with those of b: by floating point where 53 bits hold every sum, else by
    Python's integers; sums beyond 64 bits take the nearest 64-bit value."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1)
    if most < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, then smaller vec_id) entries of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -(2**63), np.int64)
        self.q, self.id, self.s = (np.empty(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        good = s >= self.least[q]
        q, ids, s = (np.concatenate(x) for x in ((self.q, q[good]), (self.id, ids[good]), (self.s, s[good])))
        order = np.lexsort((~s, ids, q))  # ~s falls as s rises, without overflow
        q, ids, s = q[order], ids[order], s[order]
        first = np.ones(len(q), bool)  # repeated rows of one vec_id count once
        first[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, s = q[first], ids[first], s[first]
        order = np.lexsort((ids, ~s, q))
        q, ids, s = q[order], ids[order], s[order]
        starts = np.searchsorted(q, q)
        rank = np.arange(len(q)) - starts
        self.q, self.id, self.s = (x[rank < self.k] for x in (q, ids, s))
        full = rank == self.k - 1
        self.least[q[full]] = s[full]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, blocks: int = 4) -> DataFrame:
    """The k best rows of `vectors` for each row of `queries` (both vec_id and v): query_id, rank, vec_id, score.

    Ties go to the smaller vec_id; a row with the query's vec_id is no candidate; fewer candidates than k give all.
    Repeated rows of one vec_id count once, with the best score; of queries the first by value is taken.
    """
    spark = vectors.sparkSession
    queries = cut(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    n, dims = size["n"], max(size["dims"] or 0, 1)
    n_blocks = -(-n // max(1, QUERY_BLOCK_BYTES // (8 * dims)))
    result = None
    for block in range(n_blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block).toArrow()  # at most about QUERY_BLOCK_BYTES
        found = _block(vectors, mine["vec_id"].to_numpy(), matrix(mine["v"].combine_chunks(), dims), k, blocks, spark)
        result = found if result is None else result.union(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if result is None else result


def _block(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, blocks: int, spark) -> DataFrame:
    sent = spark.sparkContext.broadcast((ids, q))

    def gather(cutoffs) -> callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, vec = sent.value
            cutoff = None if cutoffs is None else cutoffs.value
            best = Best(len(own), k)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    rows, cand = part["vec_id"].to_numpy(), matrix(part["v"], vec.shape[1])
                    mine = np.pad(vec, ((0, 0), (0, cand.shape[1] - vec.shape[1])))
                    lists = [products(mine[:, j::blocks], cand[:, j::blocks]) for j in range(blocks)]
                    total = sum(lists)
                    if cutoff is None:
                        take = np.zeros(total.shape, bool)
                        for partial in lists:
                            kth = min(k + 1, len(rows))  # one more, for the query's own row
                            top = np.argpartition(partial, len(rows) - kth, axis=1)[:, len(rows) - kth :]
                            np.put_along_axis(take, top, True, axis=1)
                    else:
                        least = -(-cutoff // blocks)[:, None]
                        take = np.logical_or.reduce([partial >= least for partial in lists]) & (total >= cutoff[:, None])
                    take &= own[:, None] != rows[None, :]
                    i, j = np.nonzero(take)
                    best.add(i, rows[j], total[i, j])
            out = pd.DataFrame({"query_id": own[best.q], "vec_id": best.id, "score": best.s})
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

        return run

    def merged(df: DataFrame) -> DataFrame:
        once = df.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)

    first = merged(vectors.mapInArrow(gather(None), SCORES)).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    cutoff = np.full(len(ids), -(2**63), np.int64)
    place = {int(x): i for i, x in enumerate(ids)}
    for row in first.where(F.col("n") == k).collect():  # a number for each query of the block
        cutoff[place[row["query_id"]]] = row["kth"]
    found = vectors.mapInArrow(gather(spark.sparkContext.broadcast(cutoff)), SCORES)
    return merged(found).select("query_id", "rank", "vec_id", "score")


def every(step: int) -> Column:
    """Rows whose vec_id is divisible by `step`."""
    return F.pmod("vec_id", F.lit(step)) == 0

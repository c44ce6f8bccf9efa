"""Centroid clustering: rounds of exact nearest-centroid assignment, screened in single precision.

A batch of vectors meets all centroids in one float32 matrix product. For a vector x and a centroid c of d components, the product as
computed differs from x.c by at most g * |x| * |c| (Cauchy-Schwarz), where g = m u / (1 - m u), u = 2^-24 and m = d + 2: one rounding
for each of the two conversions and d for products and sums in any order. So |c|^2 - 2 x.c, which orders centroids as the distance
does, lies in an interval of known width. A centroid whose interval begins above the least upper end cannot be nearest. Where one
centroid is left it is the nearest; where intervals overlap, those left are compared by exact integers, ties to the lowest number.

Vectors stay where they are: a task sends one row of sums for each centroid and dimension. The driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routeledger.llm.search import matrix, usable
from routeledger.llm.shared import cut, written

#: Rows of one matrix product.
SLICE = 4096
MOST = 2**63 - 1
UNIT32, UNIT64 = 2.0**-24, 2.0**-53


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x from the rows of c, pair by pair: 64-bit integers where they hold every sum, else Python's."""
    reach = (float(np.abs(x.astype(float)).max(initial=0)) + float(np.abs(c.astype(float)).max(initial=0))) ** 2 * max(x.shape[1], 1)
    diff = x - c if reach < 2.0**62 else x.astype(object) - c.astype(object)
    return (diff * diff).sum(axis=1)


def screened(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x and each centroid whether it may be the nearest, and the best by screening."""
    d = x.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        dot = (x.astype(np.float32) @ c.astype(np.float32).T).astype(float)
        x64, c64 = x.astype(float), c.astype(float)
        size = np.sqrt((x64 * x64).sum(axis=1))[:, None] * np.sqrt((c64 * c64).sum(axis=1))[None, :]
        own = (c64 * c64).sum(axis=1)[None, :]
        m = (d + 2) * UNIT32
        slack = (d + 8) * 2 * UNIT64  # of the sums in double precision: own, size, and what is made of them
        value = own - 2.0 * dot
        width = (2.0 * m / (1.0 - m) * size + slack * (own + 4.0 * size)) * (1.0 + slack)
        may = ~(value - width > (value + width).min(axis=1, keepdims=True))
    certain = np.isfinite(width).all(axis=1) & np.isfinite(dot).all(axis=1)
    may[~certain] = True  # beyond single precision, all are compared exactly
    return may, np.where(may, value, np.inf).argmin(axis=1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row (ties: the lowest) and the exact squared distance."""
    may, cluster = screened(x, c)
    rows = np.flatnonzero(may.sum(axis=1) > 1)
    if len(rows):
        at, number = np.nonzero(may[rows])  # by row, numbers rising
        exact = squared(x[rows[at]], c[number])
        order = np.lexsort((number, exact, at)) if exact.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (at[i], exact[i], number[i])))
        first = np.ones(len(order), bool)
        first[1:] = at[order][1:] != at[order][:-1]
        cluster[rows] = number[order][first]
    return cluster, squared(x, c[cluster])


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, matrix(part["v"], dims)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, dim, sum and n: exact sums over each centroid's vectors."""
    k, dims = centroids.shape
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for _, x in _slices(batches, dims):
            cluster, _ = nearest(x, sent.value)
            n += np.bincount(cluster, minlength=k)
            safe = float(np.abs(x.astype(float)).max(initial=0)) * len(x) < 2.0**62
            for j in np.unique(cluster):
                mine = x[cluster == j]
                sums[j] += (mine if safe else mine.astype(object)).sum(axis=0).astype(object)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(np.repeat(used, dims), pa.int32()), "dim": pa.array(np.tile(np.arange(dims), len(used)), pa.int32()), "sum": [str(s) for j in used for s in sums[j]], "n": pa.array(np.repeat(n[used], dims), pa.int64())})

    parts = vectors.select("v").mapInArrow(run, "cluster int, dim int, sum string, n long")
    return parts.groupBy("cluster", "dim").agg(F.sum(F.col("sum").cast(T.DecimalType(38, 0))).alias("sum"), F.sum("n").alias("n"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest hexadecimal SHA-256 of `seed:vec_id`, in that order; repeated rows of one vec_id by value."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in vectors.orderBy(key, "v").limit(k).select("v").collect()], np.int64)


def centroids_of(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> np.ndarray:
    """Centroids after some rounds over vectors (vec_id and v, integers of one length): k rows, or as many as there are vectors.

    A round gives every centroid the exact floor of its vectors' means; one without vectors stays as it is.
    """
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for r in _sums(vectors, centroids).collect():  # a number for each centroid and dimension
            centroids[r["cluster"], r["dim"]] = int(r["sum"]) // r["n"]
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared, exact; beyond 64 bits the largest long) of every vector."""
    dims = centroids.shape[1]
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, dims):
            cluster, distance = nearest(x, sent.value)
            yield pa.RecordBatch.from_pydict({"vec_id": part["vec_id"], "cluster": pa.array(cluster, pa.int32()), "distance": pa.array([min(int(v), MOST) for v in distance], pa.int64())})

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def kept(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id and v, the components as integers floor(scale * x), of vectors of exactly `dims` components, none null or not finite."""
    return usable(vectors, scale).where(F.size("v") == dims)


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64) -> DataFrame:
    """Every kept vector with its cluster: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    vectors has vec_id and embedding; other columns, whatever their names, are left out, as are rows without vec_id and vectors that
    are null, of other lengths, or hold a null or a number that is not finite. Repeated rows are vectors each. Of fewer vectors than k,
    each is a centroid at first. Integers beyond 64 bits, and sums of distances, take the nearest 64-bit value. No vectors give no rows.
    """
    spark = vectors.sparkSession
    own = cut(kept(vectors, dims, scale))
    centroids = centroids_of(own, k, rounds, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    found = written(assigned(own, centroids))
    sums = {r["cluster"]: int(r["sum"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast(T.DecimalType(38, 0))).alias("sum")).collect()}
    total = min(sum(sums.values()), MOST)
    digest = lambda c: hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest()
    known = spark.createDataFrame([(j, min(s, MOST), total, digest(centroids[j])) for j, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64) -> str:
    """The same in SQL: vectors and centroids as rows of components, one pair of tables for each round."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), v) - 1)::INT AS j, v AS c FROM kept ORDER BY sha256('{seed}:' || vec_id::VARCHAR), v LIMIT {k})",
    ]
    near = """(SELECT r, vec_id, v, j, c, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d FROM kept, c{i}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)"""
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED {near.format(i=i)}")
        parts.append(f"s{i} AS MATERIALIZED (SELECT j, p, sum(v[p])::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT j, v, unnest(range(1, {dims + 1})) AS p FROM a{i}) GROUP BY j, p)")
        parts.append(f"m{i} AS MATERIALIZED (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM s{i} GROUP BY j)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.j, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (j))")
    parts.append(f"a AS MATERIALIZED {near.format(i=rounds)}")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, j::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::VARCHAR), ',')) AS centroid_sha256 FROM a
"""


ORACLE = _oracle()

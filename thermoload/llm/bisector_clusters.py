"""Centroid clustering by a bisector tournament, in integers.

A vector's components x become floor(256 * x). For centroids i < j the bisecting hyperplane
has the integer normal 2(c_j - c_i) and threshold |c_j|^2 - |c_i|^2: the vector is nearer to j
exactly where normal * x - threshold > 0, and zero favours the smaller number. All
k(k-1)/2 normals and thresholds are computed once a round. Each vector then plays a
knock-out tournament: k-1 sign tests, each removing a loser; the first level has the same pairs
for every vector (one matrix product), later ones look up the pair's normal. Only the
winner's distance is computed, exactly.

A round sends k * k * components integers to the tasks, and each task returns one sum per
cluster and component (partial sums, then a grouped sum): bounded by k, however large a cluster
is. The driver divides those sums (exact floor). Nothing else leaves the executors.

Arithmetic is exact: doubles and 64-bit integers while all sizes allow (components up to 2^20), Python
integers beyond; results that don't fit a long raise.

Edge cases: vectors that are null, have another length than ``size`` or a null or non-finite
component are left out. Fewer vectors than k give fewer centroids, none an empty result.
Repeated rows count each, also as starting centroids; equal ids order by their components; a null
id hashes as the empty text. An empty cluster keeps its centroid. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, written

SCALE = 256
CLUSTERS, ROUNDS, SEED, SIZE = 40, 5, 2, 64
SAFE = 1 << 20          # components up to here: every product and sum below is exact in a double
BATCH = 8192


def usable(vec: str):
    """The vector is there, and every component is a finite number."""
    return F.coalesce(F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(column) -> np.ndarray:
    """Rows floor(256 * x) of a list column of equal lengths, as exact integers (int64 or object)."""
    x = np.floor(np.asarray(column.flatten()).astype(np.float64) * SCALE).reshape(len(column), -1)
    if x.size and np.abs(x).max() > SAFE:
        return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return x.astype(np.int64)


def bisectors(centroids: list[list[int]]) -> dict:
    """Normals and thresholds of all pairs, exact."""
    c = np.array(centroids, dtype=object)
    square = (c * c).sum(1)
    out = {"normals": 2 * (c[None, :, :] - c[:, None, :]), "thresholds": square[None, :] - square[:, None], "centroids": c}
    if max(abs(v) for v in c.ravel()) <= SAFE:
        return {k: v.astype(np.int64) for k, v in out.items()}
    return out


def nearest(x: np.ndarray, b: dict) -> np.ndarray:
    """The number of the nearest centroid of each row (ties: the smaller), by k-1 sign tests."""
    normals, thresholds = b["normals"], b["thresholds"]
    if x.dtype == object or normals.dtype == object:
        x, normals = x.astype(object), normals.astype(object)
    else:  # whole numbers below 2^53 throughout: matrix products of doubles are exact
        x, normals = x.astype(np.float64), normals.astype(np.float64)
    k = len(thresholds)
    low = np.arange(0, k - 1, 2)
    # seats keep their order: the left one always has the smaller number
    seats = np.tile(np.arange(0, k, 2), (len(x), 1))
    if len(low):
        seats[:, :len(low)] += (x @ normals[low, low + 1].T - thresholds[low, low + 1] > 0)
    while seats.shape[1] > 1:
        pairs = seats.shape[1] // 2
        winners = seats[:, 0::2].copy()
        for p in range(pairs):
            i, j = seats[:, 2 * p], seats[:, 2 * p + 1]
            side = (x * normals[i, j]).sum(1) - thresholds[i, j]
            winners[:, p] = np.where(side > 0, j, i)
        seats = winners
    return seats[:, 0]


def distances(x: np.ndarray, cluster: np.ndarray, b: dict) -> np.ndarray:
    d = x - b["centroids"][cluster]
    return (d * d).sum(1)


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            yield b.slice(at, BATCH)


def cluster_sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of each cluster that has vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast(bisectors(centroids))
    size = len(centroids[0])

    def run(batches):
        b = sent.value
        total = {}
        for part in _slices(batches):
            x = integers(part.column(0))
            mine = nearest(x, b)
            order = np.argsort(mine, kind="stable")
            present, first, n = np.unique(mine[order], return_index=True, return_counts=True)
            for c, m, s in zip(present.tolist(), n.tolist(), np.add.reduceat(x[order], first, axis=0)):
                old = total.get(c, (0, np.zeros(size, dtype=object)))
                total[c] = (old[0] + m, old[1] + s)
        for c, (m, s) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * (size + 1), pa.int32()), pa.array(range(-1, size), pa.int32()),
                 pa.array([m, *map(int, s)], pa.int64())], names=["cluster", "pos", "value"])
    parts = vectors.select("vec").mapInArrow(run, "cluster int, pos int, value long")
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "pos").agg(F.sum("value").alias("value")).sort("cluster", "pos").collect():
        out.setdefault(r["cluster"], []).append(r["value"])  # at most k * (components + 1) rows
    return {c: (v[0], v[1:]) for c, v in out.items()}


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of seed and id, in hash order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(name.alias("name"), "vec").sort("name", "vec").limit(k).collect()
    return [[int(np.floor(SCALE * float(v))) for v in r["vec"]] for r in rows]


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``id``, ``cluster`` and exact squared ``distance`` of every vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(bisectors(centroids))
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        b = sent.value
        for part in _slices(batches):
            x = integers(part.column(1))
            mine = nearest(x, b)
            far = [int(v) for v in distances(x, mine, b)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(mine, pa.int32()), pa.array(far, pa.int64())],
                                             names=["id", "cluster", "distance"])
    return vectors.select("id", "vec").mapInArrow(run, f"id {kind}, cluster int, distance long")


def cluster(rows: DataFrame, id_col: str = "vec_id", vec: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS,
            seed: int = SEED, size: int = SIZE) -> tuple[DataFrame, list[list[int]]]:
    """(``id``, ``cluster``, ``distance`` per usable vector; the final centroids)."""
    vectors = rows.select(F.col(id_col).alias("id"), F.col(vec).alias("vec")).filter((F.size("vec") == size) & usable("vec"))
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        for c, (n, sums) in cluster_sums(vectors, centroids).items():
            centroids[c] = [s // n for s in sums]
    return written(assign(vectors, centroids), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Each vector with its cluster's and the total inertia and its centroid's digest."""
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    facts = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
             for c, s in sums.items()]
    table = assigned.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster")  # at most k rows


by_value(__name__)

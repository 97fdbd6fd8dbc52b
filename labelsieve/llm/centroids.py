"""Exact k-means over integer vectors, pruned by Ptolemaic pivots.

For points x, c and pivots p, q Ptolemy's inequality gives

    d(x, c) * d(p, q) >= |d(x, p) * d(c, q) - d(x, q) * d(c, p)|.

The pivots are fixed, so the distances of every vector to them are computed once
and stored beside it; a round only needs those of the centroids. All pivot pairs
together bound each distance from below. Bounds are rounded downwards, so a
centroid is passed over only when it is provably farther than the best one
known; for the others the distance is computed exactly in 64-bit integers.

Each round is one scan: tasks add up their vectors by cluster and send at most k
rows. What reaches the driver is k centroids and k sums, whatever the table holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelsieve.llm.vectors import finite, integers, matrix
from labelsieve.storage import materialise

CLUSTERS = 40
ROUNDS = 5
WIDTH = 64
SEED = 2
#: Pivots, and with them PIVOTS * (PIVOTS - 1) / 2 pairs. They change no result.
PIVOTS = 6
#: Relative slack for the few rounded operations behind a bound.
SLACK = 1e-12
#: Rows whose bounds are held at a time.
ROWS = 4096
RESULT = (
    "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, "
    "centroid_sha256 string"
)


def squared(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all others, as int64."""
    found = np.empty((len(points), len(others)), np.int64)
    for column, other in enumerate(others):
        gap = points - other
        found[:, column] = np.einsum("ij,ij->i", gap, gap)
    return found


def between(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles just below and above the roots of exact squares."""
    near = squares.astype(np.float64)
    low = np.nextafter(np.sqrt(np.nextafter(near, 0.0)), 0.0)
    high = np.nextafter(np.sqrt(np.nextafter(near, np.inf)), np.inf)
    return low, high


def far_apart(points: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` different points, each the farthest from those before it."""
    chosen = points[:1]
    while 0 < len(chosen) < count:
        gaps = squared(points, chosen).min(axis=1)
        if not gaps.any():
            break
        chosen = np.vstack([chosen, points[int(gaps.argmax())]])
    return chosen


@dataclass(frozen=True)
class Pruner:
    """Nearest centroids by bounds over pivot pairs, ties to the smaller number."""

    pivots: np.ndarray
    centroids: np.ndarray

    def bounds(self, to_pivots: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances, from those of the points to the pivots."""
        low, high = between(to_pivots)
        c_low, c_high = between(squared(self.centroids, self.pivots))
        _, apart = between(squared(self.pivots, self.pivots))
        best = np.zeros((len(to_pivots), len(self.centroids)))
        for p, q in combinations(range(len(self.pivots)), 2):
            one = np.multiply.outer(low[:, p], c_low[:, q] * (1 - SLACK))
            one -= np.multiply.outer(high[:, q], c_high[:, p] * (1 + SLACK))
            two = np.multiply.outer(low[:, q], c_low[:, p] * (1 - SLACK))
            two -= np.multiply.outer(high[:, p], c_high[:, q] * (1 + SLACK))
            np.maximum(one, two, out=one)
            one /= apart[p, q]
            np.maximum(best, one, out=best)
        return best * best * (1 - SLACK)

    def nearest(self, points: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid, and how many were checked exactly."""
        cluster = np.empty(len(points), np.int64)
        distance = np.empty(len(points), np.int64)
        checked = 0
        for start in range(0, len(points), ROWS):
            part = slice(start, start + ROWS)
            cluster[part], distance[part], n = self._nearest(points[part], to_pivots[part])
            checked += n
        return cluster, distance, checked

    def _nearest(self, points, to_pivots):
        bounds = self.bounds(to_pivots)
        cluster = bounds.argmin(axis=1)
        gap = points - self.centroids[cluster]
        distance = np.einsum("ij,ij->i", gap, gap)
        first, checked = cluster.copy(), len(points)
        for number, centroid in enumerate(self.centroids):
            rows = np.nonzero((bounds[:, number] <= distance) & (first != number))[0]
            gap = points[rows] - centroid
            found = np.einsum("ij,ij->i", gap, gap)
            closer = (found < distance[rows]) | ((found == distance[rows]) & (number < cluster[rows]))
            cluster[rows[closer]], distance[rows[closer]] = number, found[closer]
            checked += len(rows)
        return cluster, distance, checked


def kept(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """``vec_id`` and integer components ``q`` of the vectors that count."""
    fits = finite("embedding") & (F.size("embedding") == width)
    return vectors.select("vec_id", "embedding").where(fits).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), integers("embedding").alias("q")
    )


def start(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest hash of their id, in that order: at most k rows on the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.orderBy(order.asc_nulls_last(), "q").limit(k).collect()
    return np.array([row.q for row in rows], dtype=np.int64)


def _with_pivots(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``points`` with the squared distances to the pivots beside each."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = squared(matrix(batch.column("q"), width), pivots)
            offsets = pa.array(np.arange(0, found.size + 1, len(pivots), dtype=np.int32))
            to_pivots = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, to_pivots], names=["vec_id", "q", "to_pivots"])

    return points.mapInArrow(run, "vec_id bigint, q array<bigint>, to_pivots array<bigint>")


def _sums(points: DataFrame, pruner: Pruner) -> list:
    """Count and component sums by cluster, added up in each task before the shuffle."""
    k, width = pruner.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            q = matrix(batch.column("q"), width)
            cluster, _, _ = pruner.nearest(q, matrix(batch.column("to_pivots"), len(pruner.pivots)))
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, q)
        used = np.nonzero(count)[0]
        offsets = pa.array(np.arange(0, len(used) * width + 1, width, dtype=np.int32))
        sums = pa.ListArray.from_arrays(offsets, pa.array(total[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), sums], names=["cluster", "n", "s"])

    parts = points.select("q", "to_pivots").mapInArrow(run, "cluster bigint, n bigint, s array<bigint>")
    added = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect()


def _assigned(points: DataFrame, pruner: Pruner) -> DataFrame:
    width = pruner.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("q"), width)
            cluster, distance, _ = pruner.nearest(q, matrix(batch.column("to_pivots"), len(pruner.pivots)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "cluster", "distance"],
            )

    return points.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(
    vectors: DataFrame,
    *,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    seed: int = SEED,
    pivots: int = PIVOTS,
) -> DataFrame:
    """Cluster, squared distance, inertias and centroid digest of every vector that counts.

    A vector counts when it has ``width`` components, none null or non-finite. Rows of a
    null vec_id are assigned as any other, but start a centroid only when ids run out;
    rows of one id are taken in the order of their components. Repeated rows
    stay repeated. With fewer than k vectors there are as many centroids as vectors,
    with none the result is empty. A component times 256 beyond 2^27 is an error. Only
    ``vec_id`` and ``embedding`` are read.
    """
    spark = vectors.sparkSession
    points = kept(vectors, width)
    centroids = start(points, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    fixed = far_apart(centroids, pivots)
    points = materialise(_with_pivots(points, fixed), "pivots")
    for _ in range(rounds):
        centroids = centroids.copy()
        for row in _sums(points, Pruner(fixed, centroids)):
            centroids[row.cluster] = [row[f"s{i}"] // row.n for i in range(width)]
    assigned = materialise(_assigned(points, Pruner(fixed, centroids)), "clusters")
    inertias = assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()
    everything = sum(row.d for row in inertias)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame(
        [(row.cluster, row.d, everything, digests[row.cluster]) for row in inertias],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

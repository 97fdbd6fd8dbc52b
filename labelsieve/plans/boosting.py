"""Histogram gradient boosting with best-first trees.

Features are binned once. A tree grows by splitting the leaf of largest gain until it has
``leaves`` leaves; a split counts the histogram of its smaller child and has that of the larger one by
subtraction. Every ``holdout``-th part of the rows, by a hash of their numbers, is not
trained on: training stops when its loss has not improved for ``patience`` trees.

Rows are counted in one of two places, with the same result: in one task, where all binned rows
fit it, or by a Spark job each time. A job counts the children of all leaves that could be
split, so a tree takes about as many jobs as it has levels; each tree writes the rows with
their new margins for the next.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelsieve.plans.trees import (
    TREES, Tree, binned, counted, leaf_of, quantile_bounds, rows_of, scored, training_rows, tree_of, uniform,
)
from labelsieve.storage import materialise

BINS = 255
#: Bytes of binned rows that one task may hold.
TASK_BYTES = 1 << 28
GRID = 2.0**-30


@dataclass(frozen=True)
class Boosting:
    """Settings. ``holdout`` of 0 trains on all rows and for all rounds."""

    rounds: int = 100
    rate: float = 0.1
    leaves: int = 31
    least_rows: int = 20
    least_hessian: float = 1e-3
    holdout: float = 0.1
    patience: int = 10
    tolerance: float = 1e-7
    seed: int = 0


def held(row: np.ndarray, how: Boosting) -> np.ndarray:
    """The rows that are watched and not trained on."""
    return uniform(row, how.seed) < how.holdout


def slopes(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the log loss, on a grid on which sums are exact in any order."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) / GRID) * GRID, np.rint(p * (1 - p) / GRID) * GRID


def loss(margin: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, margin) - y * margin).sum())


def best_cut(sums: np.ndarray, how: Boosting) -> tuple[float, int, int]:
    """Gain, feature and bin of a node's best cut, from its (feature, bin) sums; no gain: -inf."""
    left = np.cumsum(sums, axis=1)
    whole = left[:, -1:]
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sum(s[..., 0] ** 2 / s[..., 1] for s in (left, right)) - whole[..., 0] ** 2 / whole[..., 1]
    able = np.ones(gain.shape, bool)
    for side in (left, right):
        able &= (side[..., 2] >= how.least_rows) & (side[..., 1] >= how.least_hessian)
    gain = np.where(able & (gain > 0), gain, -np.inf)
    at = int(gain.argmax())
    return float(gain.flat[at]), *divmod(at, gain.shape[1])


def best_first(counts, how: Boosting) -> Tree:
    """A tree of at most ``leaves`` leaves, each split the one of largest gain; ties to the older leaf.

    ``counts(tree, nodes)`` gives the sums of nodes of a tree of bins. The tree it sees may have splits
    that are not taken in the end.
    """
    seen = Tree()
    sums = {0: counts(seen, [0])[0]}
    cuts = {0: best_cut(sums[0], how)}
    heap, taken = [(-cuts[0][0], 0)], set()
    while heap and len(taken) + 1 < how.leaves:
        gain, node = heapq.heappop(heap)
        if gain == math.inf:
            break
        if seen.left[node] < 0:
            able = [node, *(n for g, n in heap if g < math.inf and seen.left[n] < 0)] if counts.eager else [node]
            smaller = {}
            for n in able:
                _, feature, cut = cuts[n]
                child = seen.split(n, feature, float(cut))
                below = sums[n][feature, : cut + 1, 2].sum()
                smaller[n] = child + int(below > sums[n][feature, :, 2].sum() - below)
            found = counts(seen, [*smaller.values()])
            for (n, small), s in zip(smaller.items(), found, strict=True):
                child = seen.left[n]
                sums[small], sums[2 * child + 1 - small] = s, sums[n] - s
                cuts.update((c, best_cut(sums[c], how)) for c in (child, child + 1))
        taken.add(node)
        for child in (seen.left[node], seen.left[node] + 1):
            heapq.heappush(heap, (-cuts[child][0], child))
    return _taken(seen, taken, sums, how)


def _taken(seen: Tree, taken: set, sums: dict, how: Boosting) -> Tree:
    """The tree of the splits that were taken, with the values of its leaves."""
    tree, todo = Tree(), [(0, 0)]
    while todo:
        old, new = todo.pop()
        if old in taken:
            child = tree.split(new, seen.feature[old], seen.threshold[old])
            todo += [(seen.left[old], child), (seen.left[old] + 1, child + 1)]
        else:
            g, h = sums[old][0].sum(axis=0)[:2]
            tree.value[new] = -how.rate * g / h if h > 0 else 0.0
    return tree


class Here:
    """Rows in this task."""

    eager = False

    def __init__(self, bins: np.ndarray, y: np.ndarray, watched: np.ndarray, numbers: int, prior: float) -> None:
        self.bins, self.y, self.watched, self.numbers = bins, y, watched, numbers
        self.columns = [column.copy() for column in bins.T]
        self.margin = np.full(len(y), prior)
        self.start()

    def start(self) -> None:
        self.slopes = slopes(self.margin, self.y)
        self.rows = {0: np.nonzero(~self.watched)[0]}

    def __call__(self, tree: Tree, nodes: list[int]) -> list[np.ndarray]:
        found = []
        for node in nodes:
            if node not in self.rows:  # part the rows of its parent
                first = node - 1 if node - 1 in tree.left else node
                parent = tree.left.index(first)
                rows = self.rows.pop(parent)
                goes = self.columns[tree.feature[parent]][rows] > tree.threshold[parent]
                self.rows[first], self.rows[first + 1] = rows[~goes], rows[goes]
            rows = self.rows[node]
            g, h = (s[rows] for s in self.slopes)
            found.append(counted([column[rows] for column in self.columns], self.numbers, g, h, None))
        return found

    def add(self, tree: Tree) -> float:
        packed, aside = tree.packed(), np.nonzero(self.watched)[0]
        parts = [rows for rows in self.rows.values() if len(rows)]
        leaves = leaf_of(packed, self.bins[[rows[0] for rows in parts]])  # rows that were parted alike end in one leaf
        for rows, leaf in zip(parts, leaves.tolist(), strict=True):
            self.margin[rows] += packed[3][leaf]
        self.margin[aside] += packed[3][leaf_of(packed, self.bins[aside])]
        self.start()
        return loss(self.margin[self.watched], self.y[self.watched])


class Spread:
    """Rows in a Spark table of ``row``, ``y``, ``bins`` and ``margin``."""

    eager = True

    def __init__(self, table: DataFrame, width: int, numbers: int, how: Boosting) -> None:
        self.table, self.width, self.numbers, self.how = table, width, numbers, how

    def __call__(self, tree: Tree, nodes: list[int]) -> list[np.ndarray]:
        packed, width, numbers, how = tree.packed(), self.width, self.numbers, self.how

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(nodes), width, numbers, 3))
            for batch in batches:
                bins = unpacked(batch.column("bins"), width)
                kept = ~held(batch.column("row").to_numpy(), how)
                g, h = slopes(batch.column("margin").to_numpy(), batch.column("y").to_numpy())
                under = below(packed, bins)
                for place, node in enumerate(nodes):
                    some = np.nonzero(kept & under(node))[0]
                    sums[place] += counted(bins[some].T, numbers, g[some], h[some], None)
            places = [(p, f) for p in range(len(nodes)) for f in range(width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in places], pa.int32()), pa.array([f for _, f in places], pa.int32()),
                 pa.array([sums[p, f].ravel().tolist() for p, f in places], pa.list_(pa.float64()))],
                names=["place", "feature", "s"],
            )

        added = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(3 * numbers)]
        parts = self.table.mapInArrow(count, "place int, feature int, s array<double>").groupBy("place", "feature")
        found = np.zeros((len(nodes), width, numbers, 3))
        for row in parts.agg(*added).collect():
            found[row.place, row.feature] = np.array(row[2:]).reshape(numbers, 3)
        return list(found)

    def add(self, tree: Tree) -> float:
        packed, width, how = tree.packed(), self.width, self.how

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margin = batch.column("margin").to_numpy()
                margin = margin + packed[3][leaf_of(packed, unpacked(batch.column("bins"), width))]
                y = batch.column("y").to_numpy()
                watched = held(batch.column("row").to_numpy(), how)
                lost = np.where(watched, np.logaddexp(0, margin) - y * margin, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(margin), pa.array(lost)], names=["row", "y", "bins", "margin", "lost"]
                )

        moved = self.table.select("row", "y", "bins", "margin").mapInArrow(
            move, "row bigint, y double, bins binary, margin double, lost double"
        )
        self.table = materialise(moved, "margins")
        return self.table.agg(F.sum("lost")).first()[0] or 0.0


def unpacked(column: pa.BinaryArray | pa.ChunkedArray, width: int) -> np.ndarray:
    """The matrix of rows of bytes, from Arrow's buffers."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [np.zeros(0, np.uint8)]
    for chunk in filter(len, chunks):
        chunk = chunk.cast(pa.large_binary())
        ends = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(parts).reshape(len(column), width)


def below(packed, bins: np.ndarray):
    """Which rows are in a node or under it, for any node."""
    leaf, left = leaf_of(packed, bins), packed[2]

    def under(node: int) -> np.ndarray:
        inside, todo = np.zeros(len(left), bool), [node]
        while todo:
            at = todo.pop()
            inside[at] = True
            if left[at] >= 0:
                todo += [int(left[at]), int(left[at]) + 1]
        return inside[leaf]

    return under


def boost(counts, how: Boosting, start: float) -> list[Tree]:
    """Trees until the rounds are up, nothing is gained, or the watched loss stays."""
    trees, losses = [], [start]
    for _ in range(how.rounds):
        tree = best_first(counts, how)
        if len(tree.feature) == 1:
            break
        trees.append(tree)
        losses.append(counts.add(tree))
        if how.holdout and len(losses) > how.patience:
            if min(losses[-how.patience :]) > losses[-how.patience - 1] - how.tolerance:
                break
    return trees


class Booster:
    """An estimator: fit() gives a BoosterModel."""

    def __init__(
        self, *, featuresCol: str, labelCol: str, maxIter: int = 100, stepSize: float = 0.1, maxLeaves: int = 31,
        minInstancesPerNode: int = 20, holdout: float = 0.1, patience: int = 10, seed: int = 0,
        taskBytes: int = TASK_BYTES,
    ) -> None:
        self.features, self.label, self.task_bytes = featuresCol, labelCol, taskBytes
        self.how = Boosting(maxIter, stepSize, maxLeaves, minInstancesPerNode, holdout=holdout, patience=patience, seed=seed)

    def fit(self, df: DataFrame) -> BoosterModel:
        rows = training_rows(df, self.features, self.label)
        bounds = quantile_bounds(rows, BINS)
        size = rows.agg(F.count("*").alias("n")).first().n
        width, numbers = len(bounds), max(map(len, bounds), default=0) + 1
        if not size:
            raise ValueError("no training rows")

        def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("x")
                made = binned(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1), bounds)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:2], pa.array([row.tobytes() for row in made], pa.binary())], names=["row", "y", "bins"]
                )

        table = rows.mapInArrow(to_bins, "row bigint, y double, bins binary")
        how = self.how
        if size * width > self.task_bytes:
            table = materialise(table, "bins")
        watched = _watched(how)
        shares = {
            r.watched: r for r in table.groupBy(watched("row").alias("watched")).agg(
                F.count("*").alias("n"), F.sum("y").alias("ones")).collect()
        }
        trained, aside = shares.get(False), shares.get(True)
        if not aside:
            how = replace(how, holdout=0.0)
        if not trained or not 0 < trained.ones < trained.n:
            how = replace(how, holdout=0.0)
            n, ones = size, sum(r.ones for r in shares.values())
        else:
            n, ones = trained.n, trained.ones
        if not 0 < ones < n:
            raise ValueError("the training rows hold one class")
        prior = math.log(ones / (n - ones))
        start = 0.0
        if how.holdout:
            start = aside.n * math.log1p(math.exp(prior)) - aside.ones * prior
        if size * width <= self.task_bytes:
            trees = self._here(table, width, numbers, how, prior, start)
        else:
            trees = boost(Spread(table.withColumn("margin", F.lit(prior)), width, numbers, how), how, start)
        for tree in trees:  # bins to values
            tree.threshold = [
                float(bounds[f][int(t)]) if f >= 0 else 0.0 for f, t in zip(tree.feature, tree.threshold, strict=True)
            ]
        return BoosterModel(self.features, prior, [t.packed() for t in trees])

    def _here(self, table: DataFrame, width: int, numbers: int, how: Boosting, prior: float, start: float) -> list[Tree]:
        def run(part: pa.Table) -> pa.Table:
            row, y = (np.asarray(part.column(c).to_numpy()) for c in ("row", "y"))
            bins = unpacked(part.column("bins"), width)
            trees = boost(Here(bins, y, held(row, how), numbers, prior), how, start)
            return rows_of([(i, 0, tree) for i, tree in enumerate(trees)]) if trees else rows_of([(0, 0, Tree())])

        found = table.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(run, TREES).collect()
        return [tree_of(r) for r in sorted(found, key=lambda r: r.tree)]


def _watched(how: Boosting):
    @F.pandas_udf("boolean")
    def watched(row: pd.Series) -> pd.Series:
        return pd.Series(held(row.to_numpy(), how))

    return watched


@dataclass
class BoosterModel:
    features: str
    prior: float
    trees: list[tuple[np.ndarray, ...]]

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.prior)
        for packed in self.trees:
            margin += packed[3][leaf_of(packed, x)]
        return 1 / (1 + np.exp(-margin))

    def transform(self, df: DataFrame) -> DataFrame:
        return scored(df, self.features, self.score)

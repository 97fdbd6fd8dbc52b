"""Decision trees and forests in two phases.

While a node has more rows than a task should hold, it is split from distributed
histograms: every task counts the rows of a level's nodes by class and quantile bin of
each feature, counts are added up, and the best cut of each node comes to the driver. Once
its rows fit, a node's rows are gathered in one task, which finishes the subtree
there with exact cuts between neighbouring values, as deep as it takes. There is no depth limit unless one
is set: rows that differ in some feature end in pure leaves.

A forest weighs each row for each tree by a Poisson draw from a hash of the row's number,
so the draw depends on no layout. Where the whole training set fits a task, a few
cohorts of trees share its rows.

Training rows are written once, in blocks. A task that finishes some nodes reads all blocks and keeps the rows
of its nodes, so no row is shuffled or written again for any of the trees that draw it.

Subtrees are written as a table as they are finished. A model of few bytes is put together on
the driver and sent to all tasks; a larger one stays a table, and the rows it scores are sent to tasks that
hold some of its subtrees each. Both give the same scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from labelsieve.storage import materialise

#: Numbers (rows times features) that a task may hold of a node.
TASK_CELLS = 1 << 24
#: Tasks that grow the trees of a forest over a training set that fits each of them.
COHORTS = 32
#: Bins of a feature in the distributed phase.
BINS = 64
#: Bytes of a model that the driver and every task may hold, and of the part of a larger one that one task holds.
MODEL_BYTES, COHORT_BYTES = 1 << 24, 1 << 28
#: Rows and bytes of a block of training rows, at most.
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 14
#: Tasks that rows are scored in, at least, where their model stays a table.
SCORERS = 32
#: Nodes in a row of the table of a model.
ROW_NODES = 512
ROW = "row_id"
#: Scores of cuts that agree to so many digits are ties.
DIGITS = 12
#: How often a row may be in the bootstrap of a tree, and bits of one of two sums in a float.
MOST_TIMES, HALF = 255, 26
#: Shares that are added up are multiples of it.
GRID = 2.0**-40

# Odd constants that mix the bits of a 64-bit number.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_KINDS = (np.int32, np.float64, np.int32, np.float64)
NODE_BYTES = sum(np.dtype(kind).itemsize for kind in _KINDS)
_TIMES = np.arange(2 * MOST_TIMES + 2) >> 1
_ONES = _TIMES * (np.arange(2 * MOST_TIMES + 2) & 1)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def mixed(numbers: np.ndarray, salt: int) -> np.ndarray:
    """Uniform 64-bit numbers from numbers and a salt."""
    with np.errstate(over="ignore"):
        z = numbers.astype(np.uint64) + np.uint64(salt % (1 << 64)) * _MIX[0] + _MIX[0]
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
    return z ^ (z >> np.uint64(31))


def uniform(numbers: np.ndarray, salt: int) -> np.ndarray:
    return (mixed(numbers, salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def drawn(row_ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the bootstrap of a tree."""
    return np.searchsorted(_POISSON, uniform(row_ids, seed * 1_000_003 + tree), "right").astype(np.float64)


@dataclass
class Tree:
    """Nodes by number; the right child follows the left one. A leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, threshold: float) -> int:
        """Make a node inner; returns its left child."""
        child = len(self.feature)
        self.feature[node], self.threshold[node], self.left[node] = feature, threshold, child
        for part, filler in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.value, self.value[node])):
            part += [filler, filler]
        return child

    def graft(self, node: int, other: Tree) -> None:
        """Put another tree in place of a leaf."""
        moved = len(self.feature) - 1  # its root takes the leaf's place, the others come behind
        self.feature[node], self.threshold[node], self.value[node] = other.feature[0], other.threshold[0], other.value[0]
        self.left[node] = other.left[0] + moved if other.left[0] >= 0 else -1
        self.feature += other.feature[1:]
        self.threshold += other.threshold[1:]
        self.value += other.value[1:]
        self.left += [c + moved if c >= 0 else -1 for c in other.left[1:]]

    def packed(self) -> tuple[np.ndarray, ...]:
        return (
            np.array(self.feature, np.int32), np.array(self.threshold), np.array(self.left, np.int32), np.array(self.value),
        )


def leaf_of(packed: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The leaf that each row of a matrix ends in."""
    feature, threshold, left, _ = packed
    node, live = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(live):
        at = node[live]
        inner = feature[at] >= 0
        live, at = live[inner], at[inner]
        node[live] = left[at] + ~(x[live, feature[at]] <= threshold[at])
    return node


@dataclass(frozen=True)
class Growth:
    """Settings of growing: ``draw`` features are tried at a node, all if 0."""

    max_depth: int | None = None
    least_rows: int = 1
    draw: int = 0
    seed: int = 0


@dataclass(frozen=True)
class Coded:
    """Features as numbers of their values: ``codes`` is (features x rows), ``values`` the ordered values of each."""

    codes: np.ndarray
    values: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray) -> Coded:
        codes, values = np.empty(x.shape[::-1], np.int32), []
        for f in range(x.shape[1]):
            found, known = pd.factorize(x[:, f] + 0.0, sort=True)
            if len(found) and found.min() < 0:  # not a number: as the largest value is
                known = known if len(known) else np.array([np.nan])
                found = np.where(found < 0, len(known) - 1, found)
            codes[f] = found
            values.append(known)
        return cls(codes, values)

    def __getitem__(self, rows: np.ndarray) -> Coded:
        return Coded(np.take(self.codes, rows, axis=1), self.values)


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, how: Growth, depth: int = 0, salt: int = 0) -> Tree:
    """A tree over all rows of positive weight."""
    return Tree(*[part.tolist() for part in grown(Coded.of(x), y, weight, how, depth, salt)])


def grown(x: Coded, y: np.ndarray, weight: np.ndarray, how: Growth, depth: int = 0, salt: int = 0) -> tuple[np.ndarray, ...]:
    """The packed tree over all rows of positive weight, all nodes of a level at a time.

    At every level the rows of all nodes are counted by node and value of a feature, and running sums over these
    give the best cut of every node. The best cut is the one of
    least Gini impurity; the first feature and then the lowest threshold win ties. Weights are whole numbers.
    """
    used = np.nonzero(weight > 0)[0]
    if not len(used):
        return Tree().packed()
    times, ones = weight[used].astype(np.int64), y[used].astype(np.int64)
    if (times != weight[used]).any() or times.max() > MOST_TIMES or (ones != y[used]).any() or ((ones & ~1) != 0).any():
        raise ValueError(f"weights must be whole numbers up to {MOST_TIMES}, and labels 0 or 1")
    codes, values = np.take(x.codes, used, axis=1), x.values
    mark = (times << 1 | ones).astype(np.uint16)
    width, node, first_node, levels = len(values), np.zeros(len(used), np.int32), 0, []
    total, hit, sizes = (np.array([v], np.float64) for v in (times.sum(), (times * ones).sum(), len(used)))
    draw = min(how.draw or width, width)

    def cuttable(total: np.ndarray, hit: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
        live = (hit > 0) & (hit < total)
        if how.least_rows > 1:  # else rows needn't be counted
            live &= sizes >= 2 * how.least_rows
        return live & (how.max_depth is None or depth < how.max_depth)

    live = cuttable(total, hit, sizes, depth)
    while True:
        count = len(live)
        cuts = _best_cuts(codes, values, mark, node, (total, hit, sizes), live, draw, how, salt + depth)
        split = cuts.feature >= 0
        behind, left = first_node + count, np.full(count, -1)
        left[split] = behind + 2 * np.arange(split.sum())
        levels.append((cuts.feature, cuts.threshold, left, hit / total))
        if not split.any():
            break
        lower = [part[split] for part in cuts.left]
        total, hit, sizes = (
            np.stack([a, b[split] - a], axis=1).ravel() for a, b in zip(lower, (total, hit, sizes), strict=True)
        )
        live = cuttable(total, hit, sizes, depth + 1)
        child = np.full(count, -1, np.int32)
        child[split] = 2 * np.arange(split.sum())
        at = np.where(split, cuts.feature, 0)[node] * len(node) + np.arange(len(node))
        moved = child[node]
        moved += (codes.ravel()[at] > cuts.code[node]) & (moved >= 0)
        rows = np.nonzero(np.append(live, False)[moved])[0]  # a row of a node that isn't cut has number -1
        node, mark, codes = moved[rows], mark[rows], np.take(codes, rows, axis=1)
        first_node, depth = behind, depth + 1
    return tuple(np.concatenate(part).astype(kind) for part, kind in zip(zip(*levels), _KINDS, strict=True))


@dataclass
class Cuts:
    """The best cut of each node: rows whose ``feature`` (-1: none) has at most a ``code`` go left.

    ``left`` has their weight, their weight of label 1 and, where leaves must keep some rows, their number.
    """

    feature: np.ndarray
    threshold: np.ndarray
    code: np.ndarray
    left: tuple[np.ndarray, ...]


def _best_cuts(codes, values, mark, node, sums, live, draw, how: Growth, salt) -> Cuts:
    """The best cut of every live node; all rows are in live nodes."""
    count, width = len(live), len(values)
    best, feature = np.full(count, -np.inf), np.full(count, -1)
    threshold, code, left = np.zeros(count), np.zeros(count, np.int32), tuple(np.zeros(count) for _ in sums)
    tried = np.broadcast_to(live[:, None], (count, width)).copy()
    if draw < width and live.any():
        chance = uniform(np.arange(count * width), how.seed * 1_000_003 + salt).reshape(count, width)
        tried &= chance.argsort(axis=1).argsort(axis=1) < draw
    for wanted in (tried, live[:, None] & ~tried):  # the rest only where none of those drawn can cut
        wanted = wanted & (feature < 0)[:, None]
        for f in np.nonzero(wanted.any(axis=0))[0].tolist():
            of = np.nonzero(wanted[:, f])[0]
            number = np.full(count, -1, np.int32)
            number[of] = np.arange(len(of))
            place, column, marks = number[node], codes[f], mark
            if len(of) < live.sum():
                rows = np.nonzero(place >= 0)[0]
                place, column, marks = place[rows], column[rows], marks[rows]
            score, low, high, *parts = _cuts(place, column, marks, len(values[f]), [v[of] for v in sums], how.least_rows)
            better = score > best[of]
            where, low, high = of[better], low[better], high[better]
            best[where], feature[where], code[where] = score[better], f, low
            for side, part in zip(left, parts, strict=True):
                side[where] = part[better]
            low, high = values[f][low], values[f][high]
            middle = low + (high - low) / 2
            threshold[where] = np.where((middle >= low) & (middle < high), middle, low)
    return Cuts(feature, threshold, code, left)


def _cuts(place, column, marks, numbers, sums, least_rows):
    """The best score of a feature's cuts in each node, the codes below and above it, and the sums to its left.

    Rows are counted by node and code: where such cells are fewer than rows by their number, else by sorting
    the rows' marks behind their cells.
    """
    total, hit, sizes = sums
    count, bits = len(total), max(1, (numbers - 1).bit_length())
    if least_rows <= 1 and count << bits <= len(place) and total.sum() < 1 << HALF:
        weights = (_TIMES + (_ONES << HALF)).astype(np.float64)[marks]
        packed = np.bincount((place << bits) | column, weights, count << bits)
        cells = np.nonzero(packed)[0]
        upto = np.cumsum(packed[cells]).astype(np.int64)
        w, ones, rows = upto & ((1 << HALF) - 1), upto >> HALF, np.zeros(len(cells))
    else:
        low = int(marks.max()).bit_length()
        kind = np.uint32 if (count << bits + low) <= 1 << 32 else np.int64
        key = ((place.astype(kind) << kind(bits) | column.astype(kind)) << kind(low)) | marks.astype(kind)
        key.sort()
        cell = key >> kind(low)
        last = np.append(np.nonzero(cell[1:] != cell[:-1])[0], len(cell) - 1)
        upto = np.cumsum((_TIMES + (_ONES << 32))[key & kind((1 << low) - 1)])[last]
        w, ones, rows, cells = upto & 0xFFFFFFFF, upto >> 32, last + 1, cell[last].astype(np.int64)
    of, code = cells >> bits, cells & ((1 << bits) - 1)
    at = np.nonzero(of[1:] == of[:-1])[0]  # a cut is behind each cell of a node but its last one
    owner = of[at]
    many = np.bincount(owner, minlength=count)
    first = np.append(0, np.nonzero(of[1:] != of[:-1])[0] + 1)
    left, left_hit, ahead = ((v[at] - np.append(0, v)[first][owner]).astype(np.float64) for v in (w, ones, rows))
    whole = total[owner]
    right, right_hit = whole - left, hit[owner] - left_hit
    score = (left_hit**2 + (left - left_hit) ** 2) / left + (right_hit**2 + (right - right_hit) ** 2) / right
    score = np.round(score / whole, DIGITS)
    if least_rows > 1:
        score[(ahead < least_rows) | (sizes[owner] - ahead < least_rows)] = -np.inf
    some = many > 0
    top, pick = np.full(count, -np.inf), np.zeros(count, np.int64)
    if some.any():
        begins = (np.cumsum(many) - many)[some]
        top[some] = np.maximum.reduceat(score, begins)
        hits = np.where(score == top[owner], np.arange(len(at)), len(at))
        pick[some] = np.minimum.reduceat(hits, begins)
    else:
        at, left, left_hit, ahead = np.zeros(1, np.int64), *(np.zeros(1) for _ in range(3))
    high = np.minimum(at[pick] + 1, len(code) - 1)
    return top, code[at[pick]], code[high], left[pick], left_hit[pick], ahead[pick]


# Over Spark


def training_rows(df: DataFrame, features: str, label: str) -> DataFrame:
    """``row``, ``y`` and ``x``; rows without a number of their own are numbered by content."""
    x = vector_to_array(features)
    row = F.col(ROW) if ROW in df.columns else F.xxhash64(x, label)
    return df.select(row.cast("bigint").alias("row"), F.col(label).cast("double").alias("y"), x.alias("x"))


def matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


#: A block of training rows.
BLOCKS = "n int, width int, row binary, y binary, x binary"


def blocks_of(rows: DataFrame) -> DataFrame:
    """Training rows in blocks, a byte string for their numbers, labels and features each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            x = matrix(batch.column("x"))
            row, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "y"))
            if not np.isin(y, (0, 1)).all():
                raise ValueError("a training row has a label other than 0 and 1")
            most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, x.shape[1]))))
            starts = range(0, len(x), most)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x[k : k + most]) for k in starts], pa.int32()), pa.array([x.shape[1]] * len(starts), pa.int32()),
                 *(pa.array([v[k : k + most].tobytes() for k in starts], pa.binary()) for v in (row, y.astype(np.uint8), x))],
                names=["n", "width", "row", "y", "x"],
            )

    return rows.mapInArrow(pack, BLOCKS)


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, labels and features of the blocks of a batch."""
    row, y, x = (joined(batch.column(c)) for c in ("row", "y", "x"))
    y = np.frombuffer(y, np.uint8)
    return np.frombuffer(row, np.int64), y, np.frombuffer(x).reshape(len(y), -1)


TREES = "tree int, node int, feature binary, threshold binary, `left` binary, value binary"


def rows_of(trees: list[tuple[int, int, Tree]]) -> pa.Table:
    """(tree, node, Tree) as rows of TREES; a tree's lists as bytes, as there may be millions of nodes."""
    names = ("feature", "threshold", "left", "value")
    columns = zip(*[[part.tobytes() for part in tree.packed()] for _, _, tree in trees], strict=True)
    return pa.table({
        "tree": pa.array([t for t, _, _ in trees], pa.int32()),
        "node": pa.array([n for _, n, _ in trees], pa.int32()),
        **{name: pa.array(list(column), pa.binary()) for name, column in zip(names, columns, strict=True)},
    })


def packed_of(row) -> tuple[np.ndarray, ...]:
    """The arrays of a row of TREES."""
    parts = (row.feature, row.threshold, row["left"], row.value)
    return tuple(np.frombuffer(part, kind) for part, kind in zip(parts, _KINDS, strict=True))


def tree_of(row) -> Tree:
    return Tree(*[part.tolist() for part in packed_of(row)])


#: A subtree in place of a node of a tree, in rows of at most ROW_NODES nodes.
SUBTREES = "tree int, node int, part int, nodes int, feature binary, threshold binary, `left` binary, value binary"


def in_parts(subtrees: list[tuple[int, int, tuple[np.ndarray, ...]]]) -> pa.Table:
    """(tree, node, packed tree) as rows of SUBTREES."""
    parts = [
        (tree, node, at // ROW_NODES, [column[at : at + ROW_NODES] for column in packed])
        for tree, node, packed in subtrees
        for at in range(0, len(packed[0]), ROW_NODES)
    ]
    numbers = [[p[i] for p in parts] for i in range(3)] + [[len(p[3][0]) for p in parts]]
    return pa.table({
        **{name: pa.array(column, pa.int32()) for name, column in zip(("tree", "node", "part", "nodes"), numbers, strict=True)},
        **{name: pa.array([p[3][i].tobytes() for p in parts], pa.binary())
           for i, name in enumerate(("feature", "threshold", "left", "value"))},
    })


def from_parts(table: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, ...]]:
    """Packed trees by (tree, node), in that order, from all their rows of SUBTREES."""
    numbers = [table.column(name).to_numpy() for name in ("tree", "node", "part")]
    columns = [table.column(name).to_pylist() for name in ("feature", "threshold", "left", "value")]
    rows: dict[tuple[int, int], list[int]] = {}
    for at in np.lexsort(numbers[::-1]).tolist():
        rows.setdefault((int(numbers[0][at]), int(numbers[1][at])), []).append(at)
    return {
        key: tuple(np.frombuffer(b"".join(c[i] for i in some), kind) for c, kind in zip(columns, _KINDS, strict=True))
        for key, some in rows.items()
    }


def joined(column) -> bytes:
    return b"".join(column.to_pylist())


class Forest:
    """An estimator of one tree or many: fit() gives a ForestModel, or a StoredForest of more than ``modelBytes``."""

    def __init__(
        self, *, featuresCol: str, labelCol: str, numTrees: int = 1, bootstrap: bool = False, sqrtFeatures: bool = False,
        maxDepth: int | None = None, minInstancesPerNode: int = 1, seed: int = 0, taskCells: int = TASK_CELLS,
        modelBytes: int = MODEL_BYTES,
    ) -> None:
        self.features, self.label, self.count, self.bootstrap = featuresCol, labelCol, numTrees, bootstrap
        self.sqrt, self.task_cells, self.model_bytes = sqrtFeatures, taskCells, modelBytes
        self.how = Growth(maxDepth, minInstancesPerNode, 0, seed)

    def fit(self, df: DataFrame) -> ForestModel | StoredForest:
        rows = training_rows(df, self.features, self.label)
        blocks = materialise(blocks_of(rows), "forest-blocks")
        size = blocks.agg(F.sum("n").alias("n"), F.max("width").alias("width")).first()
        if not size.n:
            raise ValueError("no training rows")
        draw = max(1, math.isqrt(size.width)) if self.sqrt else 0
        how = Growth(self.how.max_depth, self.how.least_rows, draw, self.how.seed)
        trees = [Tree() for _ in range(self.count)]
        if size.n * size.width <= self.task_cells:
            cohorts = min(self.count, COHORTS)
            shares = [[(t, [0]) for t in range(cohort, self.count, cohorts)] for cohort in range(cohorts)]
        else:
            shares = self._in_phases(blocks, quantile_bounds(rows, BINS), trees, size, how)
        subtrees = materialise(self._finished(blocks, trees, shares, how), "subtrees")
        sizes = {
            (r.tree, r.node): r.nodes * NODE_BYTES
            for r in subtrees.groupBy("tree", "node").agg(F.sum("nodes").alias("nodes")).collect()
        }
        if sum(sizes.values()) > self.model_bytes:
            return StoredForest(self.features, [t.packed() for t in trees], subtrees, sizes, self.task_cells)
        for (tree, node), packed in from_parts(subtrees.toArrow()).items():
            trees[tree].graft(node, Tree(*[part.tolist() for part in packed]))
        return ForestModel(self.features, [t.packed() for t in trees])

    def weights(self, row: np.ndarray, tree: int) -> np.ndarray:
        return drawn(row, tree, self.how.seed) if self.bootstrap else np.ones(len(row))

    def _finished(self, blocks: DataFrame, trees: list[Tree], shares: list, how: Growth) -> DataFrame:
        """The subtrees in place of the leaves of some trees; a task for each share, a list of (tree, leaves).

        A task reads all blocks: a product of their one partition and a row for each share, which shuffles nothing.
        """
        spark, weights = blocks.sparkSession, self.weights
        shared = spark.sparkContext.broadcast(([t.packed() for t in trees], shares))

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uppers, shares = shared.value
            share, kept = None, []
            for batch in filter(len, batches):
                share = shares[batch.column("share")[0].as_py()]
                row, y, x = unpacked(batch)
                if all(nodes == [0] for _, nodes in share):
                    kept.append((row, y, x))
                    continue
                for at, (tree, nodes) in enumerate(share):
                    weight, leaf = weights(row, tree), leaf_of(uppers[tree], x)
                    some = np.nonzero((weight > 0) & np.isin(leaf, nodes))[0]
                    kept.append((np.full(len(some), at), leaf[some], weight[some].astype(np.uint8), y[some], x[some]))
            if share is None:
                return
            whole = len(kept[0]) == 3
            *parts, x = (np.concatenate([k[i] for k in kept]) for i in range(len(kept[0])))
            kept.clear()
            if whole:
                row, y = parts
                coded = Coded.of(x)
                del x
                for tree, _ in share:
                    yield from in_parts([(tree, 0, grown(coded, y, weights(row, tree), how, salt=tree << 20))]).to_batches()
                return
            of, leaf, weight, y = parts
            for at, (tree, nodes) in enumerate(share):
                for node in nodes:
                    some = np.nonzero((of == at) & (leaf == node))[0]
                    below = None if how.max_depth is None else max(0, how.max_depth - _depth(uppers[tree], node))
                    lower = Growth(below, how.least_rows, how.draw, how.seed)
                    made = grown(Coded.of(x[some]), y[some], weight[some], lower, salt=(tree << 20) + (node << 8))
                    yield from in_parts([(tree, node, made)]).to_batches()

        numbers = spark.range(0, len(shares), 1, len(shares)).select(F.col("id").cast("int").alias("share"))
        every = blocks.coalesce(1).hint("shuffle_replicate_nl").crossJoin(numbers)
        return every.mapInArrow(finish, SUBTREES)

    def _in_phases(self, blocks: DataFrame, bounds: list[np.ndarray], trees: list[Tree], size, how: Growth) -> list:
        """Grows the upper parts of the trees; gives the shares of the tasks that finish their leaves."""
        room = max(1, self.task_cells // size.width)
        large = [(t, 0) for t in range(self.count)]
        leaves = dict.fromkeys(large, size.n)
        depth = 0
        while large and (how.max_depth is None or depth < how.max_depth):
            ahead = []
            for tree, node, feature, cut, left, right in self._level(blocks, trees, large, bounds, how, depth):
                child = trees[tree].split(node, feature, float(bounds[feature][cut]))
                del leaves[tree, node]
                leaves |= {(tree, child): left, (tree, child + 1): right}
                ahead += [(tree, child + k) for k, n in enumerate((left, right)) if n > room]
            large, depth = ahead, depth + 1
        shares, used = [], math.inf
        for (tree, node), n in sorted(leaves.items()):
            if used + n > room or shares[-1][-1][0] != tree:
                shares.append([(tree, [])])
                used = 0
            shares[-1][-1][1].append(node)
            used += n
        return shares

    def _level(self, blocks: DataFrame, trees, large, bounds, how: Growth, depth: int) -> list[tuple]:
        """The best cuts of the large nodes: (tree, node, feature, bin, rows left, rows right)."""
        wanted: dict[int, list[int]] = {}
        for tree, node in large:
            wanted.setdefault(tree, []).append(node)
        shared = blocks.sparkSession.sparkContext.broadcast(({t: trees[t].packed() for t in wanted}, wanted, bounds))
        weights, width = self.weights, len(bounds)
        numbers = max(map(len, bounds)) + 1

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packed, wanted, bounds = shared.value
            sums = {(t, n): np.zeros((width, numbers, 3)) for t, nodes in wanted.items() for n in nodes}
            for batch in batches:
                if not len(batch):
                    continue
                row, y, x = unpacked(batch)
                bins = binned(x, bounds)
                for tree, nodes in wanted.items():
                    weight, leaf = weights(row, tree), leaf_of(packed[tree], x)
                    for node in nodes:
                        some = np.nonzero((leaf == node) & (weight > 0))[0]
                        if len(some):
                            w = weight[some]
                            sums[tree, node] += counted(bins[some].T, numbers, w, w * y[some], None)
            keys = [(t, n, f) for t, n in sums for f in range(width)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)),
                 pa.array([sums[t, n][f].ravel().tolist() for t, n, f in keys], pa.list_(pa.float64()))],
                names=["tree", "node", "feature", "s"],
            )

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = np.stack([c.to_numpy() for c in batch.columns[3:]], axis=1).reshape(len(batch), numbers, 3)
                left = np.cumsum(sums, axis=1)
                right = left[:, -1:] - left
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = sum((s[..., 1] ** 2 + (s[..., 0] - s[..., 1]) ** 2) / s[..., 0] for s in (left, right))
                able = (left[..., 2] >= how.least_rows) & (right[..., 2] >= how.least_rows)
                pure = (left[:, -1, 1] <= 0) | (left[:, -1, 1] >= left[:, -1, 0])
                score = np.round(score / left[:, -1:, 0], DIGITS)
                score = np.where(able & ~pure[:, None], score, -np.inf)
                at = score.argmax(axis=1)
                pick = np.arange(len(batch)), at
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(score[pick]), pa.array(at.astype(np.int32)),
                     pa.array(left[..., 2][pick]), pa.array(right[..., 2][pick])],
                    names=["tree", "node", "feature", "score", "cut", "lefts", "rights"],
                )

        added = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(3 * numbers)]
        sums = blocks.mapInArrow(count, "tree int, node int, feature int, s array<double>")
        scored = sums.groupBy("tree", "node", "feature").agg(*added).mapInArrow(
            best, "tree int, node int, feature int, score double, cut int, lefts double, rights double"
        )
        found: dict[tuple[int, int], list] = {}
        for r in scored.where("score > double('-infinity')").collect():
            found.setdefault((r.tree, r.node), []).append(r)
        chosen = []
        for (tree, node), cuts in sorted(found.items()):
            if how.draw and how.draw < width:
                chance = uniform(np.arange(width) + node * width, (self.how.seed * 1_000_003 + tree << 20) + depth)
                drawn_ = set(np.argsort(chance)[: how.draw].tolist())
                cuts = [c for c in cuts if c.feature in drawn_] or cuts
            top = max(cuts, key=lambda c: (c.score, -c.feature))
            chosen.append((tree, node, top.feature, top.cut, top.lefts, top.rights))
        return chosen


def _depth(packed: tuple[np.ndarray, ...], node: int) -> int:
    parents = {int(c) + k: i for i, c in enumerate(packed[2]) if c >= 0 for k in (0, 1)}
    depth = 0
    while node in parents:
        node, depth = parents[node], depth + 1
    return depth


def quantile_bounds(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Upper bounds of at most ``bins`` bins of each feature, but for the last one."""
    points = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = (
        rows.select(F.posexplode("x").alias("feature", "value"))
        .groupBy("feature")
        .agg(F.percentile_approx("value", points, 20_000).alias("bounds"), F.max("value").alias("top"))
        .collect()
    )
    return [np.array(sorted(b for b in set(r.bounds) if b < r.top)) for r in sorted(found, key=lambda r: r.feature)]


def binned(x: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: values up to a bound are in its bin."""
    return np.stack([np.searchsorted(b, x[:, f], "left") for f, b in enumerate(bounds)], axis=1).astype(np.uint8)


def counted(columns, numbers: int, *weights: np.ndarray | None) -> np.ndarray:
    """Sums of each weight by feature and bin, from the bins of each feature; None counts rows."""
    sums = np.zeros((len(columns), numbers, len(weights)))
    for f, column in enumerate(columns):
        at = column.astype(np.int64)
        for i, w in enumerate(weights):
            sums[f, :, i] = np.bincount(at, w, numbers)
    return sums


@dataclass
class ForestModel:
    """Trees; the score is the mean share of label 1 of the leaves."""

    features: str
    trees: list[tuple[np.ndarray, ...]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for packed in self.trees:
            total += on_grid(packed[3])[leaf_of(packed, x)]
        return total / len(self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        return scored(df, self.features, self.score)


def on_grid(shares: np.ndarray) -> np.ndarray:
    """Shares on a grid on which sums are exact in any order."""
    return np.rint(shares / GRID) * GRID


@dataclass
class StoredForest:
    """Trees whose upper parts are here and whose subtrees are rows of a table of SUBTREES.

    Subtrees are dealt to cohorts of at most COHORT_BYTES, or of one subtree. Rows go to the cohorts that hold
    a subtree they end in, in parts that fit a task, and the leaves' values are added up by row. Cohorts and parts
    are as many as send the fewest bytes to SCORERS tasks: each part takes the model, each cohort the rows.
    """

    features: str
    uppers: list[tuple[np.ndarray, ...]]
    subtrees: DataFrame
    sizes: dict[tuple[int, int], int]
    task_cells: int = TASK_CELLS

    def cohorts(self, count: int = COHORTS) -> dict[tuple[int, int], int]:
        """The cohort of each subtree; ``count`` of them at least, if there are so many subtrees."""
        room = min(COHORT_BYTES, sum(self.sizes.values()) // count)
        found, cohort, used = {}, 0, 0
        for key, size in sorted(self.sizes.items()):
            if used and used + size > room:
                cohort, used = cohort + 1, 0
            found[key], used = cohort, used + size
        return found

    def layout(self, rows: int, width: int) -> tuple[dict[tuple[int, int], int], int]:
        """The cohort of each subtree, and the number of parts of the rows."""
        fewest, model = max(1, -(-rows * width // self.task_cells)), sum(self.sizes.values())

        def sent(count: int) -> tuple[int, dict[tuple[int, int], int], int]:
            homes = self.cohorts(count)
            cohorts = max(homes.values()) + 1
            parts = max(fewest, -(-SCORERS // cohorts))
            return cohorts * rows * (8 * width + 24) + parts * model, homes, parts

        return min((sent(count) for count in (1, 2, 4, 8, 16, SCORERS)), key=lambda found: found[0])[1:]

    def transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        rows = materialise(df.withColumn("__at", F.monotonically_increasing_id()), "to-score")
        x = vector_to_array(self.features)
        size = rows.agg(F.count("*").alias("n"), F.max(F.size(x)).alias("width")).first()
        homes, parts = self.layout(size.n, size.width or 0)
        shared = spark.sparkContext.broadcast((self.uppers, homes))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uppers, homes = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                at, x = batch.column("at").to_numpy(), matrix(batch.column("x"))
                wanted = np.zeros((max(homes.values()) + 1, len(at)), bool)
                for tree, packed in enumerate(uppers):
                    leaf = leaf_of(packed, x)
                    for node in np.unique(leaf).tolist():
                        wanted[homes[tree, node]] |= leaf == node
                part = int(mixed(at[:1], 0)[0] % np.uint64(parts))
                some = [(cohort, rows) for cohort, rows in enumerate(wanted) if rows.any()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in some], pa.int32()), pa.array([part] * len(some), pa.int32()),
                     *(pa.array([v[rows].tobytes() for _, rows in some], pa.binary()) for v in (at, x))],
                    names=["cohort", "rows", "at", "x"],
                )

        def add(held: pa.Table, dealt: pa.Table) -> pa.Table:
            at = np.frombuffer(joined(dealt.column("at")), np.int64)
            total, uppers = np.zeros(len(at)), shared.value[0]
            x = np.frombuffer(joined(dealt.column("x"))).reshape(len(at), -1) if len(at) else None
            last, leaf = None, None
            for (tree, node), packed in (from_parts(held) if len(at) else {}).items():
                if tree != last:
                    last, leaf = tree, leaf_of(uppers[tree], x)
                some = np.nonzero(leaf == node)[0]
                total[some] += on_grid(packed[3])[leaf_of(packed, x[some])]
            return pa.table({"__at": at, "__sum": total})

        cohort = spark.createDataFrame([(*key, c) for key, c in homes.items()], "tree int, node int, cohort int")
        held = self.subtrees.join(F.broadcast(cohort), ["tree", "node"])
        held = held.withColumn("rows", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        dealt = rows.select(F.col("__at").alias("at"), x.alias("x")).mapInArrow(deal, "cohort int, rows int, at binary, x binary")
        sums = held.groupBy("cohort", "rows").cogroup(dealt.groupBy("cohort", "rows")).applyInArrow(
            add, "__at bigint, __sum double"
        )
        chances = sums.groupBy("__at").agg((F.sum("__sum") / len(self.uppers)).alias("__chance"))
        return predicted(rows.join(chances, "__at").drop("__at"))


def scored(df: DataFrame, features: str, score) -> DataFrame:
    """``probability`` and ``prediction`` of each row; ``score`` maps a matrix to chances of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(score)

    @F.pandas_udf("double")
    def chance(x: pd.Series) -> pd.Series:
        return pd.Series(shared.value(np.stack(x.to_list())) if len(x) else np.zeros(0))

    return predicted(df.withColumn("__chance", chance(vector_to_array(features))))


def predicted(df: DataFrame) -> DataFrame:
    """``probability`` and ``prediction`` in place of the chance of label 1."""
    return df.withColumn(
        "probability", array_to_vector(F.array(1 - F.col("__chance"), F.col("__chance")))
    ).withColumn("prediction", (F.col("__chance") > 0.5).cast("double")).drop("__chance")

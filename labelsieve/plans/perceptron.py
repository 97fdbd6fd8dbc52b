"""A multilayer perceptron that stops early.

Training runs in short rounds, each started from the weights of the last. After a round the loss is
watched on rows held out by a hash of their numbers. The weights of the best round are
kept, and training ends when none of the last ``patience`` rounds was better.

The network, its first weights and its model are Spark ML's: sigmoid layers, softmax, cross entropy. Its
loss and slopes are summed here, as Spark ML's own take ten times as long: training rows are packed into
blocks once, each task sends the sums of its blocks, and the driver takes a step of L-BFGS from them. Where all
rows are less work than a job's own, one task takes all the steps. Both give the same weights, but for rounding.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import ExitStack, closing
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelsieve.plans.trees import ROW
from labelsieve.storage import materialise

#: Parts of a thousand.
SHARES = 1000
#: Rows and bytes of features that a block holds at most, and what a layer may give for a block.
BLOCK_ROWS, BLOCK_BYTES, LAYER_BYTES = 1024, 1 << 23, 1 << 19
#: Rows times weights that are worth a task, and tasks a core that blocks are dealt to at most.
TASK_WORK, CORE_TASKS = 1 << 27, 2
#: Rows times weights that one task takes all steps over, and the bytes of features that it may hold.
ALL_WORK, ALL_BYTES = 1 << 28, 1 << 27
#: Sums of more tasks than this are added up in tasks before they reach the driver.
FAN = 64
SUMS = "n bigint, loss double, slope binary"
#: L-BFGS: steps remembered, tolerance and values that it is held against; trials of a line search, and Wolfe's constants.
MEMORY, TOLERANCE, VALUES = 10, 1e-6, 20
TRIALS, DECREASE, CURVATURE = 10, 1e-4, 0.9


def watched_loss(model, rows: DataFrame, label: str) -> float:
    """Mean log loss."""
    chance = vector_to_array("probability")[F.col(label).cast("int")]
    return model.transform(rows).agg(F.avg(-F.log(F.greatest(chance, F.lit(1e-15))))).first()[0]


def matrices(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(inputs x outputs, offsets) of each layer, as Spark ML lays them out; views, not copies."""
    found, at = [], 0
    for inputs, outputs in zip(layers, layers[1:]):
        end = at + inputs * outputs
        found.append((weights[at:end].reshape(inputs, outputs), weights[end : end + outputs]))
        at = end + outputs
    return found


def activated(network, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The inputs of each layer, and what the last one gives: less its maximum, so that its exponential is finite."""
    inputs = [x]
    for matrix, offset in network[:-1]:
        out = inputs[-1] @ matrix
        out += offset
        np.exp(np.negative(out, out=out), out=out)
        out += 1
        inputs.append(np.reciprocal(out, out=out))
    matrix, offset = network[-1]
    out = inputs[-1] @ matrix + offset
    out -= out.max(axis=1, keepdims=True)
    return inputs, out


def chances(network, x: np.ndarray) -> np.ndarray:
    """The probability of each class."""
    found = np.exp(activated(network, x)[1])
    found /= found.sum(axis=1, keepdims=True)
    return found


def lost(network, x: np.ndarray, y: np.ndarray) -> float:
    """Summed log loss of some rows."""
    return float(-np.log(np.maximum(chances(network, x)[np.arange(len(y)), y], 1e-15)).sum())


def descended(network, x: np.ndarray, y: np.ndarray, slopes) -> float:
    """Summed cross entropy of some rows; its slopes are added to ``slopes``."""
    inputs, out = activated(network, x)
    chance = np.exp(out)
    total = chance.sum(axis=1, keepdims=True)
    at = np.arange(len(y)), y
    loss = float(np.log(total).sum() - out[at].sum())
    error = chance / total
    error[at] -= 1
    for k in reversed(range(len(network))):
        slopes[k][0][...] += inputs[k].T @ error
        slopes[k][1][...] += error.sum(axis=0)
        if k:
            error = error @ network[k][0].T
            error *= inputs[k]
            error *= 1 - inputs[k]
    return loss


def packed(rows: DataFrame, features: str, label: str, width: int, classes: int, widest: int = 1) -> DataFrame:
    """The rows in blocks: classes (y) and features (x), a byte string each; ``widest`` is that of the layers."""
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width), LAYER_BYTES // (8 * widest)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            lists, labels = batch.column("x"), batch.column("y")
            if lists.null_count or labels.null_count or (lists.value_lengths().to_numpy() != width).any():
                raise ValueError(f"a training row lacks a label or has not {width} features")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y = labels.to_numpy()
            if not np.isfinite(x).all() or not np.isin(y, np.arange(classes)).all():
                raise ValueError(f"a training row has a feature that is not finite, or none of {classes} classes")
            y, starts = y.astype(np.int64), range(0, len(y), most)
            blocks = [pa.array([v[k : k + most].tobytes() for k in starts], pa.binary()) for v in (y, x)]
            yield pa.RecordBatch.from_arrays(blocks, names=["y", "x"])

    arrays = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    return arrays.mapInArrow(pack, "y binary, x binary")


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Classes and features of each block."""
    for y, x in zip(batch.column("y"), batch.column("x"), strict=True):
        y = np.frombuffer(y.as_buffer(), np.int64)
        yield y, np.frombuffer(x.as_buffer()).reshape(len(y), -1)


def sums_of(n: int, loss: float, slope: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([n], pa.int64()), pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], names=["n", "loss", "slope"]
    )


class Objective:
    """Mean cross entropy over packed rows and its slope, both from one Spark job each time."""

    def __init__(self, blocks: DataFrame, layers: list[int], tasks: int) -> None:
        self.spark, self.layers, self.tasks = blocks.sparkSession, layers, tasks
        self.blocks = blocks.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)

    @classmethod
    def over(cls, rows: DataFrame, features: str, label: str, layers: list[int]) -> Objective:
        size = sum((inputs + 1) * outputs for inputs, outputs in zip(layers, layers[1:]))
        most = CORE_TASKS * rows.sparkSession.sparkContext.defaultParallelism
        tasks = max(1, min(most, rows.count() * size // TASK_WORK))
        return cls(packed(rows, features, label, layers[0], layers[-1], max(layers)), layers, tasks)

    def close(self) -> None:
        self.blocks.unpersist()

    def __call__(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        layers, shared = self.layers, self.spark.sparkContext.broadcast(weights)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            network, slope = matrices(shared.value, layers), np.zeros(len(shared.value))
            slopes, n, loss = matrices(slope, layers), 0, 0.0
            with np.errstate(all="ignore"):  # exp() of a large number is infinite, its sigmoid 0
                for batch in batches:
                    for y, x in unpacked(batch):
                        loss += descended(network, x, y, slopes)
                        n += len(y)
            yield sums_of(n, loss, slope)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, loss, slope = 0, 0.0, 0.0
            for batch in batches:
                for one in zip(*batch.columns, strict=True):
                    n, loss = n + one[0].as_py(), loss + one[1].as_py()
                    slope = slope + np.frombuffer(one[2].as_buffer())
            if n:
                yield sums_of(n, loss, slope)

        sums = self.blocks.mapInArrow(part, SUMS)
        if self.tasks > FAN:
            sums = sums.repartition(math.isqrt(self.tasks)).mapInArrow(added, SUMS)
        found = sums.collect()
        shared.destroy()
        n = sum(one.n for one in found)
        return sum(one.loss for one in found) / n, sum(np.frombuffer(one.slope) for one in found) / n

    def loss(self, weights: np.ndarray) -> float:
        """Mean log loss."""
        layers, shared = self.layers, self.spark.sparkContext.broadcast(weights)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            network, n, loss = matrices(shared.value, layers), 0, 0.0
            with np.errstate(all="ignore"):
                for batch in batches:
                    for y, x in unpacked(batch):
                        loss, n = loss + lost(network, x, y), n + len(y)
            yield sums_of(n, loss, np.zeros(0))

        found = self.blocks.mapInArrow(part, SUMS).agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
        shared.destroy()
        return found.loss / found.n


class Here:
    """The same over blocks that this task holds."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray]], layers: list[int]) -> None:
        self.blocks, self.layers, self.n = blocks, layers, sum(len(y) for y, _ in blocks)

    def __call__(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        network, slope = matrices(weights, self.layers), np.zeros(len(weights))
        slopes = matrices(slope, self.layers)
        with np.errstate(all="ignore"):
            loss = sum(descended(network, x, y, slopes) for y, x in self.blocks)
        return loss / self.n, slope / self.n

    def loss(self, weights: np.ndarray) -> float:
        network = matrices(weights, self.layers)
        with np.errstate(all="ignore"):
            return sum(lost(network, x, y) for y, x in self.blocks) / self.n


class SearchFailed(Exception):
    """No step along a direction is good enough."""


def wolfe_step(value: Callable, start: float, slope: float, length: float) -> tuple[float, object]:
    """A step that satisfies the strong Wolfe conditions, and what ``value`` found there.

    ``value`` maps a step to (value, slope along the direction, anything). As in Nocedal and Wright,
    algorithms 3.5 and 3.6, with cubic interpolation.
    """
    if not slope <= 0:
        raise SearchFailed(f"the slope is {slope}")

    def between(a, b):
        (p, fp, dp), (q, fq, dq) = sorted((a[:3], b[:3]))
        first = dp + dq - 3 * (fp - fq) / (p - q)
        second = math.sqrt(max(first * first - dp * dq, 0.0))
        bottom = dq - dp + 2 * second
        t = q - (q - p) * (dq + second - first) / bottom if bottom else (p + q) / 2
        return min(max(t, p + 0.1 * (q - p)), p + 0.9 * (q - p))

    def zoom(low, high):
        for _ in range(TRIALS):
            t = between(low, high)
            now = (t, *value(t))
            if now[1] > start + DECREASE * t * slope or now[1] >= low[1]:
                high = now
                continue
            if abs(now[2]) <= CURVATURE * abs(slope):
                return t, now[3]
            if now[2] * (high[0] - low[0]) >= 0:
                high = low
            low = now
        raise SearchFailed("the interval was halved too often")

    low, t = (0.0, start, slope, None), length
    for trial in range(TRIALS):
        now = (t, *value(t))
        if not math.isfinite(now[1]):
            t /= 2
            continue
        if now[1] > start + DECREASE * t * slope or (now[1] >= low[1] and trial):
            return zoom(low, now)
        if abs(now[2]) <= CURVATURE * abs(slope):
            return t, now[3]
        if now[2] >= 0:
            return zoom(now, low)
        low, t = now, t * 1.5
    raise SearchFailed("no step was long enough")


def minimised(objective: Callable, x: np.ndarray, iterations: int, known: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """L-BFGS from ``x`` as Spark ML runs it: after a failed search once more without memory, then it ends.

    Gives the weights, and the loss and slope there; ``known`` is what a run before found at ``x``.
    """
    value, slope = known or objective(x)
    first, values, steps, failed, done = value, deque([math.inf], VALUES), deque(maxlen=MEMORY), False, 0
    while done < iterations and np.linalg.norm(slope) > max(TOLERANCE * value, 1e-8):
        if abs(value - max(values)) <= TOLERANCE * first:
            break
        try:
            way, length = -remembered(steps, slope), 1.0
            if not done:
                length = 1 / np.linalg.norm(way)

            def along(t):
                there = x + way * t
                found, down = objective(there)
                return found, float(down @ way), (there, found, down)

            t, (there, found, down) = wolfe_step(along, value, float(slope @ way), length)
            if t * np.linalg.norm(slope) < 1e-10:
                raise SearchFailed("the step is too short")
        except SearchFailed:
            if failed:
                break
            failed = True
            steps.clear()
            continue
        steps.append((there - x, down - slope))
        x, value, slope, failed, done = there, found, down, False, done + 1
        values.append(value)
    return x, (value, slope)


@dataclass(frozen=True)
class Rounds:
    """Settings of rounds."""

    limit: int
    step: int
    patience: int
    tol: float


def trained(objective: Callable, watched, weights: np.ndarray, how: Rounds) -> tuple[np.ndarray, list[float], int]:
    """The weights of the best round, the losses that were watched and the round's number; one round if nothing is."""
    if watched is None:
        return minimised(objective, weights, how.limit)[0], [], 0
    losses, best, kept, known = [], 0, None, None
    for done in range(0, how.limit, how.step):
        weights, known = minimised(objective, weights, min(how.step, how.limit - done), known)
        losses.append(watched.loss(weights))
        if kept is None or losses[-1] < losses[best] - how.tol:
            kept, best = weights, len(losses) - 1
        elif len(losses) - 1 - best >= how.patience:
            break
    return kept, losses, best


def remembered(steps, slope: np.ndarray) -> np.ndarray:
    """The slope times the inverse curvature that the last steps tell of: two loops over them."""
    way, shares = slope.copy(), []
    for step, change in reversed(steps):
        shares.append((step @ way) / (step @ change))
        way -= shares[-1] * change
    if steps:
        step, change = steps[-1]
        bend = (step @ change) / (change @ change)
        if not bend >= 0:
            raise SearchFailed("the curvature is negative")
        way *= bend
    for step, change in steps:
        way += step * (shares.pop() - (change @ way) / (step @ change))
    return way


@dataclass
class WatchedModel:
    """The model of the best round; ``losses`` after each round, ``best`` is its number, from 0."""

    model: MultilayerPerceptronClassificationModel
    layers: list[int]
    losses: tuple[float, ...] = ()
    best: int = 0

    def transform(self, df: DataFrame) -> DataFrame:
        """``probability`` and ``prediction``, as the model gives them, many rows at a time."""
        layers, features = self.layers, self.model.getFeaturesCol()
        shared = df.sparkSession.sparkContext.broadcast(self.model.weights.toArray())

        @F.pandas_udf("array<double>")
        def chance(x: pd.Series) -> pd.Series:
            network, found = matrices(shared.value, layers), []
            with np.errstate(all="ignore"):
                for at in range(0, len(x), BLOCK_ROWS):
                    found += list(chances(network, np.stack(x.iloc[at : at + BLOCK_ROWS].to_list())))
            return pd.Series(found, dtype=object)

        found = df.withColumn("__chance", chance(vector_to_array(features)))
        most = F.array_position("__chance", F.array_max("__chance")) - 1
        return found.withColumn("probability", array_to_vector("__chance")).withColumn(
            "prediction", most.cast("double")
        ).drop("__chance")


class WatchedPerceptron:
    """An estimator: at most ``maxIter`` iterations in rounds of ``step``.

    One task takes all steps where rows times weights are at most ``allWork``.
    """

    def __init__(
        self, *, featuresCol: str, labelCol: str, layers: list[int], maxIter: int = 60, step: int = 10,
        holdout: float = 0.1, patience: int = 2, tol: float = 1e-4, seed: int = 0, allWork: int = ALL_WORK,
    ) -> None:
        self.columns = {"featuresCol": featuresCol, "labelCol": labelCol}
        self.layers, self.seed, self.holdout, self.patience, self.all_work = layers, seed, holdout, patience, allWork
        self.how = Rounds(maxIter, step, patience, tol)

    def getLayers(self) -> list[int]:
        return self.layers

    def fit(self, df: DataFrame) -> WatchedModel:
        features, label = self.columns.values()
        row = F.col(ROW) if ROW in df.columns else F.xxhash64(vector_to_array(features), label)
        aside = F.pmod(F.xxhash64(row, F.lit(self.seed)), SHARES) < round(self.holdout * SHARES)
        rows = materialise(df.select(features, label, aside.alias("aside")), "perceptron-rows")
        sizes = {r.aside: r.n for r in rows.groupBy("aside").agg(F.count("*").alias("n")).collect()}
        weights = self._model(df.sparkSession, None).weights.toArray()
        train, watched = rows.where("not aside"), rows.where("aside")
        if len(sizes) < 2:
            train, watched = rows, None
        n = sum(sizes.values())
        if n * len(weights) <= self.all_work and n * self.layers[0] * 8 <= ALL_BYTES:
            weights, losses, best = self._here(train, watched, weights)
        else:
            with ExitStack() as held:
                objectives = [
                    None if part is None else held.enter_context(closing(Objective.over(part, features, label, self.layers)))
                    for part in (train, watched)
                ]
                weights, losses, best = trained(*objectives, weights, self.how)
        return WatchedModel(self._model(df.sparkSession, weights), self.layers, tuple(losses), best)

    def _here(self, train: DataFrame, watched: DataFrame | None, weights: np.ndarray) -> tuple[np.ndarray, list[float], int]:
        """Training in one task."""
        features, label = self.columns.values()
        layers, how, shared = self.layers, self.how, train.sparkSession.sparkContext.broadcast(weights)
        parts = [part for part in (train, watched) if part is not None]
        blocks = [
            packed(part, features, label, layers[0], layers[-1], max(layers)).withColumn("part", F.lit(i))
            for i, part in enumerate(parts)
        ]
        count = len(blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list] = [[] for _ in range(count)]
            for batch in batches:
                for part, block in zip(batch.column("part").to_pylist(), unpacked(batch), strict=True):
                    held[part].append(block)
            objectives = [Here(some, layers) for some in held]
            found, losses, best = trained(objectives[0], (*objectives, None)[1], shared.value, how)
            yield pa.RecordBatch.from_arrays(
                [pa.array([found.tobytes()], pa.binary()), pa.array([losses], pa.list_(pa.float64())), pa.array([best], pa.int32())],
                names=["weights", "losses", "best"],
            )

        together = blocks[0] if len(blocks) == 1 else blocks[0].unionByName(blocks[1])
        one = together.coalesce(1).mapInArrow(run, "weights binary, losses array<double>, best int").first()
        shared.destroy()
        return np.frombuffer(one.weights), one.losses, one.best

    def _model(self, spark: SparkSession, weights: np.ndarray | None):
        """Spark ML's model of some weights, or of its first ones: a fit of no iterations, to one row."""
        made = MultilayerPerceptronClassifier(layers=self.layers, maxIter=0, seed=self.seed, **self.columns)
        if weights is not None:
            made = made.setInitialWeights(Vectors.dense(weights))
        row = (Vectors.dense([0.0] * self.layers[0]), 0.0)
        return made.fit(spark.createDataFrame([row], list(self.columns.values())))

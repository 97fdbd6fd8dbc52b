"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label. Each positive opens a window of
scores, from a share of its own score up to it, and the best negatives in it are wanted.
The windows overlap. Their upper limits cut the scores into disjoint slots, so a
negative is in one slot only. Tasks keep the best ``k`` of each (anchor, slot), and the answer of a
window is read off by walking its own slot and those below it downwards: the suffix,
in descending order, cut at the window's lower limit.

Anchors are taken in blocks of bounded size. A block meets all rows in two scans, one for its
positives and one for its negatives; products are made for a bounded piece of rows at a
time. A task returns at most k rows for each anchor and slot of the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelsieve.llm.vectors import finite, inner, integers, lengths, matrix
from labelsieve.storage import materialise, scratch_path

POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least LOW and at most HIGH hundredths of the positive.
LOW, HIGH = 80, 100
EVERY = 100
#: Anchors of a block; they are held by every task.
ANCHORS = 2048
#: Scores held by a task at a time.
SCORES = 1 << 21
RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
    "positive_score bigint, negative_score bigint"
)
BEST = "anchor bigint, slot int, score bigint, vec_id bigint"


@dataclass
class Best:
    """The best ``k`` rows of each (anchor, slot) seen so far."""

    k: int
    anchors: int
    slots: int

    def __post_init__(self):
        self.kept = np.zeros((4, 0), np.int64)  # anchor, slot, score, vec_id
        #: Scores below this can't be among the best any more.
        self.floor = np.full((self.anchors, self.slots), np.iinfo(np.int64).min)

    def add(self, anchor, slot, score, vec_id) -> None:
        useful = score >= self.floor[anchor, slot]
        new = np.stack([anchor[useful], slot[useful], score[useful], vec_id[useful]])
        every = np.concatenate([self.kept, new], axis=1)
        every = every[:, np.lexsort((every[3], -every[2], every[1], every[0]))]
        group = every[0] * self.slots + every[1]
        first = np.searchsorted(group, group)
        place = np.arange(len(group)) - first
        self.kept = every[:, place < self.k]
        last = every[:, place == self.k - 1]
        self.floor[last[0], last[1]] = last[2]


@dataclass(frozen=True)
class Block:
    """Anchors: unique row numbers, labels, vectors, and later the slot limits of their windows."""

    rows: np.ndarray
    labels: np.ndarray
    vectors: list[np.ndarray]
    limits: np.ndarray | None = None  # upper limits by slot, descending; a low filler behind them
    lowest: np.ndarray | None = None  # the lowest score any window takes

    def by_length(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(v) for v in self.vectors])
        found = {}
        for size in np.unique(sizes):
            at = np.nonzero(sizes == size)[0]
            found[int(size)] = (at, np.stack([self.vectors[i] for i in at]))
        return found

    def search(self, batches: Iterator[pa.RecordBatch], k: int) -> Best:
        """The best rows by slot: other rows of the label without limits, rows of others with."""
        best = Best(k, len(self.rows), 1 if self.limits is None else self.limits.shape[1])
        groups = self.by_length()
        for batch in batches:
            lists = batch.column("q")
            sizes = lengths(lists)
            for size, (at, matrix_of) in groups.items():
                wanted = np.nonzero(sizes == size)[0]
                step = max(1, SCORES // len(at))
                for start in range(0, len(wanted), step):
                    part = batch.take(pa.array(wanted[start : start + step]))
                    self._search(best, at, matrix_of, part, size)
        return best

    def _search(self, best, at, anchors, part, size) -> None:
        row, vec_id, label = (part.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        scores = inner(anchors, matrix(part.column("q"), size))
        alike = self.labels[at][:, None] == label
        if self.limits is None:
            a, r = np.nonzero(alike & (scores >= best.floor[at]))
            other = self.rows[at[a]] != row[r]
            a, r = a[other], r[other]
            slot = np.zeros(len(a), np.int64)
        else:
            inside = (scores <= self.limits[at, :1]) & (scores >= self.lowest[at, None]) & ~alike
            a, r = np.nonzero(inside)
            slot = (scores[a, r][:, None] <= self.limits[at[a]]).sum(axis=1) - 1
        best.add(at[a], slot, scores[a, r], vec_id[r])


def _best(rows: DataFrame, block: Block, k: int) -> DataFrame:
    """The best ``k`` rows of all for each (anchor, slot): combined in tasks, then over them."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value.search(batches, k).kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2]), pa.array(found[3])],
            names=["anchor", "slot", "score", "vec_id"],
        )

    order = "row_number() OVER (PARTITION BY anchor, slot ORDER BY score DESC, vec_id)"
    return rows.mapInArrow(run, BEST).withColumn("place", F.expr(order)).where(F.col("place") <= k)


def taking_part(vectors: DataFrame, *, relabel: bool = True) -> DataFrame:
    """Rows that take part, numbered, with integer components."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    fits = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding")
    return vectors.select("vec_id", "label", "embedding").where(fits).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
        (moved if relabel else F.col("label")).cast("bigint").alias("label"),
        integers("embedding").alias("q"),
    )


def slots(positives: list, anchors: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot limits and lowest score by anchor, from (anchor, place, score) of the positives.

    A window of a positive score s takes the scores n of low * s <= 100 * n <= high * s.
    """
    width = max((place for _, place, _ in positives), default=1)
    smallest = np.iinfo(np.int64).min
    limits = np.full((anchors, width), smallest)
    lowest = np.full(anchors, np.iinfo(np.int64).max)
    for anchor, place, score in positives:
        limits[anchor, place - 1] = high * score // 100
        lowest[anchor] = min(lowest[anchor], -(-low * score // 100))
    return limits, lowest


def _answers(best: DataFrame, positives: list, block: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The first ``k`` of each window, from the best by slot."""
    spark = best.sparkSession
    windows = spark.createDataFrame(
        [(p.anchor, p.place, p.vec_id, p.score, block[p.anchor]) for p in positives],
        "anchor bigint, place int, positive_id bigint, positive_score bigint, anchor_id bigint",
    )
    suffixes = best.groupBy("anchor").agg(  # at most k rows a slot, one slot a positive
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id", "slot"))).alias("found")
    )
    taken = F.filter(
        "found",
        lambda x: (x.slot >= F.col("place") - 1) & (-x.down * 100 <= F.col("positive_score") * high)
        & (-x.down * 100 >= F.col("positive_score") * low),
    )
    return (
        suffixes.join(F.broadcast(windows), "anchor")
        .select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(taken, 1, k)).alias("at", "x"))
        .select(
            "anchor_id",
            "positive_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("x.vec_id").alias("negative_id"),
            "positive_score",
            (-F.col("x.down")).alias("negative_score"),
        )
    )


def mine(
    vectors: DataFrame,
    *,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    relabel: bool = True,
    block: int = ANCHORS,
) -> DataFrame:
    """The hard negatives of every anchor and positive.

    Rows with a null vec_id, label or vector or a null or non-finite component take no part.
    Anchors are the rows whose vec_id is divisible by ``every``. Scores are inner products of
    floor(256 * x); rows of another length than the anchor have none with it. Rows stand
    for themselves: repeated rows and ids are others to each other. ``relabel`` moves the label
    of ids divisible by seven, as in the contract of the query. An empty table has an empty
    result; a component times 256 beyond 2^27 is an error. Extra columns are not read.
    """
    spark = vectors.sparkSession
    rows = materialise(taking_part(vectors, relabel=relabel), "takers")
    anchors = materialise(rows.where(F.col("vec_id") % every == 0), "anchors")
    written, after = [], -1
    while True:
        part = anchors.where(F.col("row") > after).orderBy("row").limit(block).collect()
        if not part:
            break
        after = part[-1].row
        found = Block(
            np.array([r.row for r in part]),
            np.array([r.label for r in part]),
            [np.array(r.q, dtype=np.int64) for r in part],
        )
        best = _best(rows, found, positives).select("anchor", "place", "score", "vec_id").collect()
        if not best:
            continue
        limits, lowest = slots([(p.anchor, p.place, p.score) for p in best], len(part), low, high)
        windows = Block(found.rows, found.labels, found.vectors, limits, lowest)
        answers = _answers(_best(rows, windows, negatives), best, [r.vec_id for r in part], negatives, low, high)
        path = scratch_path(spark, "negatives")
        answers.write.parquet(path)
        written.append(path)
    empty = spark.createDataFrame([], RESULT)
    return spark.read.schema(empty.schema).parquet(*written) if written else empty

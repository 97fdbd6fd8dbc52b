"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within them.

Equal vectors of a label are one vector first. Spherical k-means over all of them gives
cells. A vector lives in the cell of its best centroid and visits another
cell when a vector within reach of it could live there: unit vectors x, y of cosine t
are sqrt(2 - 2t) apart, and y lives in cell b rather than in x's cell a only if
y.(b - a) >= 0, so x.(a - b) <= sqrt(2 - 2t) * |a - b|. A visit is made only to cells of
smaller number, so each pair is compared once, in the smaller of its two cells, and
no linked pair is missed. Cells hold the labels apart.

A cell beyond BLOCK members is cut into blocks by hash; every two blocks meet in a task
of their own. Tasks return one row per linked vector: how many it is linked with there
and the smallest member it reaches there. Classes come from these rows by star
contraction. No list of pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from labelsieve.llm.neardup import components
from labelsieve.llm.vectors import finite, lengths
from labelsieve.storage import join_lookup, materialise

THRESHOLD = 0.93
#: Cells and rounds of the clustering. They change no result, only how much is compared.
CELLS = 16
ROUNDS = 3
#: Members of a cell that meet in one task, at most about twice as many.
BLOCK = 2048
#: Rows of a product held at a time.
STRIP = 512
#: Centroids and unit vectors are compared as whole multiples of 1 / GRID, exactly.
GRID = 1 << 20


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of equally long vectors."""
    values = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # so that squares stay finite
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def by_length(raw: list[bytes]) -> Iterator[np.ndarray]:
    """Row numbers of the vectors of each length."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    for size in np.unique(sizes):
        yield np.nonzero(sizes == size)[0]


def on_grid(values: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` components as whole numbers, filled with zeros."""
    found = np.zeros((len(values), width))
    found[:, : values.shape[1]] = np.rint(values[:, :width] * GRID)
    return found


def cells(grid: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector, and for all cells whether it is there, at home or on a visit."""
    scores = grid @ centroids.T  # exact: whole numbers below 2^53
    home = scores.argmax(axis=1)
    best = scores[np.arange(len(grid)), home]
    apart = np.linalg.norm(centroids[:, None] - centroids[None], axis=2)
    reach = np.sqrt(max(2 - 2 * threshold, 0.0)) + 1e-4  # the grid moves a vector by less
    visits = best[:, None] - scores <= reach * GRID * apart[home]
    visits &= np.arange(len(centroids)) < home[:, None]
    visits[np.arange(len(grid)), home] = True
    return home, visits


def _vectors(rows: DataFrame, kind: str) -> DataFrame:
    """Digest of label and vector beside each row, and the vector's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            ends = np.cumsum(lengths(lists))
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + 0.0  # one zero
            raw = [part.tobytes() for part in np.split(values, ends[:-1])] if len(ends) else []
            keep = [i for i, part in enumerate(raw) if np.frombuffer(part, kind).any()]
            labels = batch.column("label").to_pylist()
            digests = [sha256(f"{labels[i]}:".encode() + raw[i]).digest() for i in keep]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(at),
                    batch.column("vec_id").take(at),
                    batch.column("label").take(at),
                    pa.array(digests, pa.binary()),
                    pa.array([raw[i] for i in keep], pa.binary()),
                ],
                names=["row", "vec_id", "label", "key", "raw"],
            )

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"row bigint, vec_id bigint, label {label}, key binary, raw binary")


def _centroids(distinct: DataFrame, kind: str, count: int, rounds: int) -> np.ndarray:
    """Spherical k-means over all distinct vectors, on the grid; ``count`` rows on the driver a round."""
    seeds = [row.raw for row in distinct.orderBy("key").limit(count).select("raw").collect()]
    if not seeds:
        return np.zeros((0, 0))
    width = max(len(raw) for raw in seeds) // np.dtype(kind).itemsize
    centroids = np.vstack([on_grid(units([raw], kind), width) for raw in seeds])
    for _ in range(rounds):
        known = centroids

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            total = np.zeros(known.shape)
            for batch in batches:
                raw = batch.column(0).to_pylist()
                for rows in by_length(raw):
                    grid = on_grid(units([raw[i] for i in rows], kind), width)
                    np.add.at(total, (grid @ known.T).argmax(axis=1), grid)
            used = np.nonzero(total.any(axis=1))[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array([row.tolist() for row in total[used]], pa.list_(pa.float64()))],
                names=["cell", "s"],
            )

        parts = distinct.select("raw").mapInArrow(run, "cell bigint, s array<double>")
        added = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]
        centroids = known.copy()
        for row in parts.groupBy("cell").agg(*added).collect():
            total = np.array(row[1:])
            size = np.linalg.norm(total)
            if size:
                centroids[row.cell] = np.rint(total / size * GRID)
    return centroids


def _placed(distinct: DataFrame, centroids: np.ndarray, kind: str, threshold: float) -> DataFrame:
    """One row for each vector and cell it lives in or visits."""
    width = centroids.shape[1]
    label = distinct.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            for rows in by_length(raw):
                grid = on_grid(units([raw[i] for i in rows], kind), width)
                home, visits = cells(grid, centroids, threshold)
                at, cell = np.nonzero(visits)
                taken = batch.take(pa.array(rows[at]))
                length = np.full(len(at), len(raw[rows[0]]), np.int32)
                group = pa.StructArray.from_arrays(
                    [taken.column("label"), pa.array(length), pa.array(cell.astype(np.int32))],
                    names=["label", "length", "cell"],
                )
                yield pa.RecordBatch.from_arrays(
                    [group, taken.column("uid"), taken.column("n"), pa.array(home[at] == cell), taken.column("raw")],
                    names=["group", "uid", "n", "resident", "raw"],
                )

    return distinct.select("label", "uid", "n", "raw").mapInArrow(
        run,
        f"group struct<label: {label}, length: int, cell: int>, uid bigint, n bigint, resident boolean, raw binary",
    )


def linked(left: np.ndarray, right: np.ndarray, threshold: float, above: bool = False) -> Iterator:
    """Row numbers (left, right) of linked pairs; ``above``: left heads right, each pair of it once."""
    for start in range(0, len(left), STRIP):
        near = left[start : start + STRIP] @ right.T >= threshold
        if above:
            near &= np.arange(len(right)) > np.arange(start, start + len(near))[:, None]
        a, b = np.nonzero(near)
        yield a + start, b


def reach(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row number reachable from each row over the pairs."""
    root = np.arange(size)
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        np.minimum.at(after, root[a], least)
        np.minimum.at(after, root[b], least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def meet(uid, n, resident, block, vectors, threshold: float, within: bool) -> tuple:
    """(uid, links, root) of the vectors linked within one block or else between two blocks."""
    order = np.lexsort((uid, ~resident, block))
    uid, n, resident, block, vectors = uid[order], n[order], resident[order], block[order], vectors[order]
    pairs = []
    if within:
        at_home = np.nonzero(resident)[0]
        pairs += linked(vectors[at_home], vectors, threshold, above=True)  # those at home come first
    else:
        low = block == block[0]  # one of the two may be empty
        home_low, visit_low = np.nonzero(low & resident)[0], np.nonzero(low & ~resident)[0]
        high, home_high = np.nonzero(~low)[0], np.nonzero(~low & resident)[0]
        for left, right in ((home_low, high), (visit_low, home_high)):
            pairs += [(left[a], right[b]) for a, b in linked(vectors[left], vectors[right], threshold)]
    a = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    b = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    links = np.zeros(len(uid), np.int64)
    np.add.at(links, a, n[b])
    np.add.at(links, b, n[a])
    # Number the rows by uid, so that the smallest number is the smallest uid.
    rank = np.empty(len(uid), np.int64)
    by_uid = np.argsort(uid)
    rank[by_uid] = np.arange(len(uid))
    root = uid[by_uid][reach(len(uid), rank[a], rank[b])][rank]
    found = np.nonzero(links)[0]
    return uid[found], links[found], root[found]


def _found(members: DataFrame, kind: str, threshold: float) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in ("uid", "n", "resident", "block")]
        within = table.column("low")[0] == table.column("high")[0]
        found = meet(*columns, units(table.column("raw").to_pylist(), kind), threshold, within)
        return pa.table(dict(zip(("uid", "links", "root"), map(pa.array, found))))

    return members.groupBy("group", "low", "high").applyInArrow(run, "uid bigint, links bigint, root bigint")


def classes(
    vectors: DataFrame,
    *,
    threshold: float = THRESHOLD,
    count: int = CELLS,
    rounds: int = ROUNDS,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row.

    Vectors of equal, non-null label and equal length link at ``threshold`` or more
    (above 0). Null, empty and zero vectors and those with a null or non-finite component
    link with nothing; their rows, as those of a null label, are kept and are their own component.
    Repeated rows are links of each other. Rows of a null vec_id get a class but name none,
    unless all of it are null. Extra columns are not read; an empty table has an empty result.
    """
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    stored = "array<float>" if kind == "<f4" else "array<double>"
    given = materialise(
        vectors.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("vec_id").cast("bigint").alias("vec_id"),
            "label",
            F.when(F.col("label").isNotNull() & finite("embedding"), F.col("embedding").cast(stored)).alias("embedding"),
        ),
        "vectors",
    )
    marked = materialise(_vectors(given.where("embedding is not null"), kind), "digests")
    distinct = materialise(
        marked.groupBy("key")
        .agg(
            F.first("label").alias("label"),
            F.count("*").alias("n"),
            F.min("vec_id").alias("least"),
            F.first("raw").alias("raw"),
        )
        .withColumn("uid", F.monotonically_increasing_id()),
        "distinct-vectors",
    )
    centroids = _centroids(distinct, kind, count, rounds)
    lone = [F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")]
    if len(centroids):
        placed = _placed(distinct, centroids, kind, threshold)
        sizes = materialise(placed.groupBy("group").agg(F.count("*").alias("members")), "cells")
        sized = join_lookup(placed, sizes.withColumn("weight", F.col("members")), "group", "weight")
        blocks = F.ceil(F.col("members") / block).cast("int")
        members = (
            sized.withColumn("blocks", blocks)
            .withColumn("block", F.pmod(F.xxhash64("uid"), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(
                "group", "uid", "n", "resident", "block", "raw",
                F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            )
        )
        found = materialise(_found(members, kind, threshold), "links")
        totals = found.groupBy("uid").agg(F.sum("links").alias("links"))
        roots = components(found.where("uid <> root").select(F.col("uid").alias("a"), F.col("root").alias("b")))
        rooted = materialise(
            distinct.select("key", "uid", "n", "least")
            .join(totals, "uid", "left")
            .join(roots.withColumnRenamed("node", "uid"), "uid", "left")
            .select(
                "key",
                "n",
                "least",
                F.coalesce("root", "uid").alias("root"),
                (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            ),
            "rooted-vectors",
        )
        owners = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("weight"))
        owned = join_lookup(rooted, materialise(owners, "owners"), "root", "weight")
        lookup = materialise(owned.select("key", "n", "n_links", "component_id"), "vector-classes")
        used = join_lookup(marked.select("vec_id", "key"), lookup, "key", "n").select(
            "vec_id", "n_links", "component_id"
        )
        # Rows of zero vectors have no digest; which these are is read off the vector again.
        empty = ~F.exists("embedding", lambda x: x != 0) | F.col("embedding").isNull()
        result = used.unionByName(given.where(empty).select("vec_id", *lone))
    else:
        result = given.select("vec_id", *lone)
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

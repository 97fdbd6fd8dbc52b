import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelsieve.llm import centroids as ce

ROWS = "vec_id bigint, embedding array<double>, label int, cluster string, distance string"


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], ROWS)


def brute(rows, k, rounds, width):
    """(vec_id, cluster, distance) and final centroids, in whole numbers."""
    kept = [
        (i, tuple(math.floor(256 * x) for x in v))
        for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [q for _, q in order[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(nearest(q)[1], []).append(q)
        for n, group in groups.items():
            centers[n] = tuple(sum(c) // len(group) for c in zip(*group))
    return [(i, nearest(q)[1], nearest(q)[0]) for i, q in kept], centers


def check(found, rows, k, rounds, width):
    expected, centers = brute(rows, k, rounds, width)
    got = found.collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=order) == sorted(expected, key=order)
    for r in got:
        assert r.inertia == sum(d for _, _, d in expected)
        assert r.cluster_inertia == sum(d for _, c, d in expected if c == r.cluster)
        text = ",".join(map(str, centers[r.cluster]))
        assert r.centroid_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_same_as_a_loop(vectors):
    draw = random.Random(4)
    centers = [[draw.uniform(-1, 1) for _ in range(5)] for _ in range(6)]
    rows = [(i, [x + draw.gauss(0, 0.2) for x in draw.choice(centers)]) for i in range(400)]
    rows += [(1000 + i, [0.25 * draw.randint(-2, 2) for _ in range(5)]) for i in range(200)]  # many ties
    check(ce.cluster(vectors(rows).repartition(5), k=9, rounds=4, width=5), rows, 9, 4, 5)
    for pivots in (1, 2):
        check(ce.cluster(vectors(rows[:80]), k=9, rounds=2, width=5, pivots=pivots), rows[:80], 9, 2, 5)


def test_odd_rows(vectors):
    inf, nan = math.inf, math.nan
    rows = [
        (1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [-3.0, 0.1]), (None, [9.0, 9.0]), (2, None), (3, []), (4, [1.0]),
        (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [-0.001, 0.001]),
    ]
    check(ce.cluster(vectors(rows), k=40, rounds=3, width=2), rows, 40, 3, 2)
    check(ce.cluster(vectors(rows), k=2, rounds=3, width=2), rows, 2, 3, 2)
    nothing = ce.cluster(vectors([(2, None)]), k=3, width=2)
    assert nothing.collect() == [] and nothing.columns[0] == "vec_id"
    same = [(i, [0.5, 0.5]) for i in range(30)]
    check(ce.cluster(vectors(same), k=4, rounds=2, width=2), same, 4, 2, 2)
    with pytest.raises(Exception, match="beyond"):
        ce.cluster(vectors([(1, [1e30, 0.0])]), width=2).collect()


def test_bounds_never_exceed_and_do_prune():
    draw = np.random.default_rng(8)
    centers = draw.integers(-2000, 2000, (40, 16))
    points = centers[draw.integers(0, 40, 5000)] + draw.integers(-60, 60, (5000, 16))
    for scale in (1, 1 << 15):
        c, p = centers * scale, points * scale
        pruner = ce.Pruner(ce.far_apart(c, ce.PIVOTS), c)
        to_pivots, exact = ce.squared(p, pruner.pivots), ce.squared(p, c)
        assert (pruner.bounds(to_pivots) <= exact).all()
        cluster, distance, checked = pruner.nearest(p, to_pivots)
        assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
        assert checked < 0.2 * exact.size  # most centroids of clustered points are passed over


def test_other_partitions_change_nothing(spark, folder):
    from labelsieve.llm.queries import op11_centroids

    once = op11_centroids(spark, folder)
    table = spark.read.parquet(f"{folder}/embeddings.parquet").withColumn("q", F.lit(1))
    again = ce.cluster(table.repartition(7, F.rand(3)))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))

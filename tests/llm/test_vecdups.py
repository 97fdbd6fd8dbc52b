import math
import random

import numpy as np
import pytest

from labelsieve.llm import vecdups as vd

ROWS = "vec_id bigint, embedding array<{}>, label int, uid string, n string, raw string, `group` string"


@pytest.fixture
def vectors(spark):
    return lambda rows, kind="double": spark.createDataFrame(
        [(i, v, y, "u", "n", "r", "g") for i, v, y in rows], ROWS.format(kind)
    )


def brute(rows, threshold):
    """(vec_id, n_links, component_id, kept) of every row."""
    def fits(v, y):
        return y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        if not (fits(*a) and fits(*b) and a[1] == b[1] and len(a[0]) == len(b[0])):
            return False
        x, y = (np.array(v[0]) / max(map(abs, v[0])) for v in (a, b))
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold

    near = [[j for j, b in enumerate(rows) if j != i and linked(a[1:], b[1:])] for i, a in enumerate(rows)]
    out = []
    for i, row in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in reached:
                    reached.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in reached if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((row[0], len(near[i]), least, row[0] == least))
    return out


def same(found, rows, threshold):
    order = lambda r: tuple((x is None, x or 0) for x in r)
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()]
    assert sorted(got, key=order) == sorted(brute(rows, threshold), key=order)


def near_copies(draw, count, width=8):
    """Vectors around few centres, some chains, exact copies and scaled copies."""
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(count // 20)]
    rows = []
    for i in range(count):
        centre = draw.choice(centres)
        if draw.random() < 0.3 and rows:
            v = [2.0 * x for x in draw.choice(rows)[1]] if draw.random() < 0.5 else list(draw.choice(rows)[1])
        else:
            v = [x + draw.gauss(0, draw.choice([0.02, 0.25, 1.0])) for x in centre]
        rows.append((i, v, draw.choice([0, 0, 0, 1, 2])))
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_no_link_is_lost(vectors, block):
    rows = near_copies(random.Random(7), 500)
    expected = brute(rows, 0.93)
    assert sum(r[1] > 0 for r in expected) > 200 and 20 < sum(r[3] for r in expected) < 450
    for count in (1, 16):
        same(vd.classes(vectors(rows).repartition(4), block=block, count=count), rows, 0.93)


def test_other_thresholds_and_random_vectors(vectors):
    draw = random.Random(2)
    rows = [(i, [draw.gauss(0, 1) for _ in range(3)], 1) for i in range(300)]
    for threshold in (0.5, 0.99):
        same(vd.classes(vectors(rows), threshold=threshold, count=7, block=64), rows, threshold)


def test_odd_rows(vectors):
    inf, nan = math.inf, math.nan
    rows = [
        (5, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (3, [2.0, 4.0], 1), (None, [1.0, 2.01], 1), (1, [1.0, 2.0], None),
        (2, None, 1), (4, [], 1), (6, [0.0, -0.0], 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1),
        (10, [1.0, 2.0, 0.0], 1), (11, [1.0, 2.0, 0.0], 1), (12, [1e300, 2e300], 1), (13, [5e-324, 1e-323], 1),
        (None, [1.0, -1.0], 2), (None, [1.0, -1.0], 2), (14, [-1.0, -2.0], 1),
    ]
    same(vd.classes(vectors(rows)), rows, 0.93)
    assert vd.classes(vectors([])).collect() == []
    only = [(2, None, 1), (1, [1.0], None)]
    same(vd.classes(vectors(only)), only, 0.93)
    floats = [(i, [float(np.float32(x)) for x in (0.1 * i, 1.0, 0.3)], 1) for i in range(12)]
    same(vd.classes(vectors(floats, "float")), floats, 0.93)


def test_each_pair_meets_once():
    draw = np.random.default_rng(1)
    values = draw.normal(size=(400, 6))
    values /= np.linalg.norm(values, axis=1, keepdims=True)
    grid = vd.on_grid(values, 6)
    home, there = vd.cells(grid, grid[:9], 0.93)
    linked = np.argwhere(np.triu(values @ values.T >= 0.93, 1))
    met = (there[linked[:, 0]] & there[linked[:, 1]]) & (
        (home[linked[:, 0], None] == np.arange(9)) | (home[linked[:, 1], None] == np.arange(9))
    )
    assert len(linked) > 50 and (met.sum(axis=1) == 1).all()


def test_reach_is_the_smallest_number():
    assert vd.reach(6, np.array([4, 1, 5]), np.array([1, 3, 0])).tolist() == [0, 1, 2, 1, 1, 0]
    chain = np.arange(999)
    assert not vd.reach(1000, chain[::-1], chain[::-1] + 1).any()

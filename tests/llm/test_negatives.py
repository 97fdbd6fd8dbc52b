import math
import random

import numpy as np
import pytest

from labelsieve.llm import negatives as ne

ROWS = "vec_id bigint, embedding array<double>, label int, score string, anchor string, slot string"


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, v, y, "s", "a", "t") for i, v, y in rows], ROWS)


def brute(rows, every=100, p=5, k=5, low=80, high=100):
    kept = [
        (i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i % 7 == 0 else y)
        for i, v, y in rows
        if i is not None and y is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (anchor, q, label) in enumerate(kept):
        if anchor % every:
            continue
        scores = [
            (-sum(a * b for a, b in zip(q, r[1])), r[0], r[2] == label)
            for n, r in enumerate(kept)
            if n != at and len(r[1]) == len(q)
        ]
        for score, positive, _ in sorted(s for s in scores if s[2])[:p]:
            window = sorted(s for s in scores if not s[2] and low * -score <= 100 * -s[0] <= high * -score)
            out += [(anchor, positive, n + 1, s[1], -score, -s[0]) for n, s in enumerate(window[:k])]
    return sorted(out)


def same(found, expected):
    assert sorted(map(tuple, found.collect())) == expected


def random_rows(count, width=4, spread=1.0):
    draw = random.Random(count)
    return [(i, [1 + draw.gauss(0, spread) for _ in range(width)], draw.randrange(4)) for i in range(count)]


def test_same_as_a_loop(vectors):
    rows = random_rows(700)
    expected = brute(rows)
    assert len(expected) > 100
    table = vectors(rows).repartition(6)
    same(ne.mine(table), expected)
    same(ne.mine(table, block=2), expected)  # several blocks of anchors
    same(ne.mine(table, every=20, positives=3, negatives=2, low=50, high=90), brute(rows, 20, 3, 2, 50, 90))


def test_ties_and_repeats(vectors, monkeypatch):
    monkeypatch.setattr(ne, "SCORES", 64)
    draw = random.Random(1)
    rows = [(100 * (i % 3) + i // 30, [float(draw.randint(0, 2)), 1.0], draw.randrange(3)) for i in range(240)]
    expected = brute(rows)
    assert len(expected) > 60
    same(ne.mine(vectors(rows)), expected)


def test_odd_rows(vectors):
    nan = math.nan
    rows = [
        (100, [1.0, 1.0], 1), (100, [1.0, 1.0], 1), (None, [9.0, 9.0], 2), (3, [0.9, 0.9], None), (200, None, 1),
        (5, [1.0, None], 2), (6, [nan, 1.0], 2), (8, [1.0, 1.0, 1.0], 2), (9, [0.9, 0.9], 2), (10, [0.5, 0.5], 2),
        (11, [-1.0, -1.0], 1), (300, [], 5), (400, [-1.0, 0.0], 7), (401, [1.0, 0.0], 7), (402, [-0.9, 0.0], 8),
    ]
    same(ne.mine(vectors(rows)), brute(rows))
    assert ne.mine(vectors([])).collect() == []
    assert ne.mine(vectors([(1, [1.0], 1)])).collect() == []
    alone = [(100, [1.0], 1), (101, [1.0], 2)]
    same(ne.mine(vectors(alone)), [])
    with pytest.raises(Exception, match="beyond"):
        ne.mine(vectors([(100, [1e30], 1)])).collect()


def test_combiners_agree_with_one_pass():
    """The best of parts, merged, are the best of all, however rows are dealt."""
    draw = np.random.default_rng(5)
    anchor, slot = draw.integers(0, 7, 4000), draw.integers(0, 3, 4000)
    score, ids = draw.integers(-20, 20, 4000), draw.permutation(4000)
    whole, merged = ne.Best(4, 7, 3), ne.Best(4, 7, 3)
    whole.add(anchor, slot, score, ids)
    for part in np.array_split(draw.permutation(4000), 9):
        one = ne.Best(4, 7, 3)
        one.add(anchor[part], slot[part], score[part], ids[part])
        merged.add(*one.kept)
    assert np.array_equal(whole.kept, merged.kept)
    expected = sorted(zip(anchor.tolist(), slot.tolist(), (-score).tolist(), ids.tolist()))
    for a in range(7):
        for s in range(3):
            best = [r for r in expected if r[:2] == (a, s)][:4]
            at = (whole.kept[0] == a) & (whole.kept[1] == s)
            assert [(-r[2], r[3]) for r in best] == list(zip(*whole.kept[2:, at].tolist()))

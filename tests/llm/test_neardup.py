import random

import numpy as np
import xxhash

from labelsieve.llm import neardup as nd
from labelsieve.llm.queries import op6_neardup


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """Smallest index reachable over links of two bits or fewer."""
    values = np.array(prints, dtype=np.uint64)
    label = list(range(len(values)))
    todo = set(label)
    while todo:
        stack, part = [todo.pop()], []
        while stack:
            i = stack.pop()
            part.append(i)
            near = [j for j in np.nonzero(np.bitwise_count(values ^ values[i]) <= 2)[0].tolist() if j in todo]
            todo.difference_update(near)
            stack.extend(near)
        for i in part:
            label[i] = min(part)
    return label


def test_golay_words_within_two_bits_share_a_codeword():
    draw = np.random.default_rng(1)
    words = draw.integers(0, 1 << 23, 4000)
    for flips in (0, 1, 2):
        other = words.copy()
        for _ in range(flips):
            other ^= np.int64(1) << draw.integers(0, 23, len(words))
        a, b = nd.codewords(words), nd.codewords(other)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a, b))
        assert {int((x >= 0).sum()) for x in a} == {1, 6}


def test_query_matches_brute_force(spark, folder, documents):
    ordered = sorted(documents)
    prints = [brute_fingerprint(t) for _, t in ordered]
    label = brute_classes(prints)
    expected = [(i, f"{p:016x}", ordered[c][0]) for (i, _), p, c in zip(ordered, prints, label)]
    rows = op6_neardup(spark, folder).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == expected


def edges_match(spark, values, small):
    table = spark.createDataFrame([(nd._signed(v),) for v in values], "fp bigint").distinct()
    roots = {r.node: r.root for r in nd.components(nd.links(table, small=small)).collect()}
    unique = sorted({nd._signed(v) for v in values})
    label = brute_classes([v % (1 << 64) for v in unique])
    expected = {}
    for v, c in zip(unique, label):
        expected.setdefault(c, []).append(v)
    got = {}
    for v in unique:
        got.setdefault(roots.get(v, v), []).append(v)
    assert sorted(got.values()) == sorted(expected.values())


def test_crowded_buckets_lose_no_link(spark):
    draw = random.Random(5)
    center = draw.getrandbits(64)
    cloud = [center ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 3))) for _ in range(400)]
    cloud = [c % (1 << 64) for c in cloud]
    chain = [center ^ ((1 << 40) - 1)]
    for i in range(30):
        chain.append(chain[-1] ^ (3 << 2 * i))
    values = cloud + chain + [draw.getrandbits(64) for _ in range(300)]
    for small in (2, 32, 10_000):
        edges_match(spark, values, small)


def test_nulls_copies_and_empty(frame):
    text = "one two three four five six seven"
    docs = frame([(5, text), (4, text), (None, text), (7, None), (8, ""), (9, " \n"), (None, "alone in here now")])
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in nd.classes(docs).collect())
    assert got == [(0, 0), (0, 4), (4, 4), (5, 4), (7, 7), (8, 7), (9, 7)]
    assert nd.classes(frame([])).collect() == []

import random

from labelsieve.llm import decontamination as de


def brute(words, items, window=de.WINDOW):
    hit, found = set(), set()
    for name, item in items:
        size = min(window, len(item))
        for s in range(len(item) - size + 1 if item else 0):
            for a in range(len(words) - size + 1):
                if words[a : a + size] == item[s : s + size]:
                    hit.update(range(a, a + size))
                    found.add(name)
    return hit, found


def test_runs_match_brute_force():
    draw = random.Random(3)
    for trial in range(300):
        letters = [b"a", b"b", b"c", b"d"][: draw.randint(1, 4)]
        items = [(str(k), draw.choices(letters, k=draw.randint(1, 9))) for k in range(4)]
        words = draw.choices(letters, k=draw.randint(0, 40))
        counts = {w: draw.randint(0, 3) for w in letters}
        index = de.prefix_index(items, counts, 4)
        runs, found = de.find_runs(words, items, index, 4)
        hit, names = brute(words, items, 4)
        assert {i for a, b in runs for i in range(a, b)} == hit and found == names


def test_blocks_give_the_same(spark, frame, documents):
    bench = spark.createDataFrame(
        [(i, t[40:400]) for i, t in documents[::97]], "item_id bigint, text string"
    )
    docs = frame(documents[:300])
    one = {r.doc_id: r for r in de.contamination(docs, bench).collect()}
    many = {r.doc_id: r for r in de.contamination(docs, bench, block_words=80).collect()}
    assert one == many and any(r["items"] for r in one.values())


def test_nulls_and_edges(spark, frame):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame(
        [(1, item), (10, "Short Item"), (9, "short item"), (2, None), (None, "solo"), (3, "!?")],
        "item_id bigint, text string",
    )
    docs = frame([
        (1, item.upper()), (2, None), (3, ""), (None, "a SHORT, item b"), (5, item[: 12 * 3]), (6, "solo " * 50_000),
        (6, "solo"),
    ])
    rows = {(r.doc_id, r.n_words): r for r in de.flagged(de.contamination(docs, bench)).collect()}
    assert len(rows) == 7
    assert rows[1, 20].n_hit == 20 and rows[1, 20]["items"] == ["1"]
    assert rows[None, 4].n_hit == 2 and rows[None, 4]["items"] == ["10", "9"]
    assert not rows[2, 0].contaminated and rows[5, 12].n_hit == 0
    assert rows[6, 50_000].n_hit == 50_000 and rows[6, 1]["items"] == [""]
    nothing = de.contamination(docs, bench.limit(0)).collect()
    assert len(nothing) == 7 and not any(r.runs for r in nothing)
    assert de.contamination(frame([]), bench).collect() == []


def test_blocks_are_bounded_by_words(spark, frame, documents):
    """Words count as they are matched: not parted by white space, however long an item is."""
    glued = "-".join(f"w{i}" for i in range(2_000))
    rows = [(1, glued), (1, glued), (2, glued.replace("w", "v"))] + [(i, t) for i, t in documents[10:30]]
    bench = spark.createDataFrame(rows, "item_id bigint, text string")
    pieces, count = de._blocks(bench, de.WINDOW, 1_000)
    blocks = pieces.groupBy(de.F.col("place") % count).agg(de.F.sum("n").alias("n")).collect()
    assert count > 3 and max(r.n for r in blocks) <= 1_000
    assert pieces.where("item_id = '1'").count() == len(range(0, 2_000 - 12, 250 - 12))
    docs = frame([(1, glued.upper()), (2, " ".join(f"w{i}" for i in range(80, 120))), (3, "w1 w2 w3"), *documents[10:30]])
    one = {r.doc_id: r for r in de.contamination(docs, bench).collect()}
    many = {r.doc_id: r for r in de.contamination(docs, bench, block_words=1_000).collect()}
    assert one == many and one[1].runs[0].end == 2_000 and one[2]["items"] == ["1"] and not one[3].runs


def test_clashing_columns(spark, frame):
    bench = spark.createDataFrame([(1, "alpha beta", 2, 3)], "item_id int, text string, words int, place int")
    docs = frame([(1, "alpha beta gamma")])
    for name in ("runs", "items", "n_words", "__words_of", "block_runs"):
        docs = docs.withColumn(name, de.F.lit(1))
    got = de.flagged(de.contamination(docs, bench)).first()
    assert (got.n_words, got.n_hit, got["items"]) == (3, 2, ["1"])

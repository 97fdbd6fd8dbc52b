import hashlib

import duckdb
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from labelsieve.llm import decontamination, pieces
from labelsieve.llm.queries import op5_quality

from test_decontamination import brute as brute_hits
from test_lines import brute as brute_lines, kept_text
from test_neardup import brute_classes, brute_fingerprint


def test_pipeline_matches_brute_force(spark, folder, documents):
    kept = {r.doc_id for r in op5_quality(spark, folder).where("predicted = 1").collect()}
    rows = sorted((i, t) for i, t in documents if i in kept)
    lines = brute_lines_of_repeats(rows)
    rows = [(i, kept_text(t, lines[i])) for i, t in rows]
    rows = [(i, t) for i, t in rows if t.strip(" ") or not dict(documents)[i].strip(" ")]
    label = brute_classes([brute_fingerprint(t) for _, t in rows])
    rows = [row for k, row in enumerate(rows) if label[k] == k]
    items = [
        (str(i), decontamination.words_of(t.encode()))
        for i, t in duckdb.sql(f"SELECT item_id, text FROM '{folder}/benchmark.parquet'").fetchall()
    ]
    openings = {tuple(w[s : s + 13]) for _, w in items for s in range(len(w))}
    clean = []
    for i, text in rows:
        words = decontamination.words_of(text.encode())
        likely = any(tuple(words[a : a + 13]) in openings for a in range(len(words)))
        hit = brute_hits(words, items)[0] if likely else ()
        if not hit or 20 * len(hit) < len(words):
            clean.append((i, text))
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    expected = {i: library.encode(t) for i, t in clean}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {i: r.ids for i, r in got.items()} == expected
    assert all(r.round_trip for r in got.values())


def brute_lines_of_repeats(rows):
    """brute() over documents that share a line with another or repeat one; the rest keep all."""
    seen, shared = {}, set()
    for i, text in rows:
        for n, line in enumerate(text.split("\n")):
            key = hashlib.md5(line.strip(" ").encode()).digest()
            if key in seen:
                shared |= {i, seen[key]}
            seen.setdefault(key, i)
    some = [(i, t) for i, t in rows if i in shared]
    whole = {i: [*range(len(t.split("\n")))] for i, t in rows}
    return whole | brute_lines(some, 50)


def test_stages_keep_the_columns_and_take_odd_rows(spark, folder, frame):
    text = "A plain sentence stands here. " * 9
    odd = frame([(1, None), (2, ""), (2, ""), (None, text), (4, text), (5, "x" * 100_000)])
    for docs in (odd, frame([])):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()


def test_repeated_ids_lose_no_other_text(spark, folder, frame):
    one, near = "alpha beta gamma delta " * 40, "alpha beta gamma delta " * 41
    other, third = "completely different words stand in here " * 30, "and a third text of its own kind " * 30
    rows = [(1, one), (1, other), (2, near), (2, third), (5, third), (5, third), (5, other), (None, one), (None, None)]
    rows += [(7, "lonely text with words " * 20)] * 3
    docs = frame(rows).withColumn("text_hash", F.lit("mine")).withColumn("root", F.lit(1))
    got = corpus_pipeline.keep_one_of_each(spark, docs, folder)
    assert got.columns == docs.columns
    texts = [r.text for r in got.collect()]
    kept = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    assert kept == sorted([(0, ""), (1, one), (1, other), (2, third), (7, "lonely text with words " * 20)])
    assert len(texts) == 5
    # Hundreds of rows alike in id and text, under a null id too.
    docs = frame([(None, one)] * 200 + [(3, third)] * 200)
    assert sorted(r.text for r in corpus_pipeline.keep_one_of_each(spark, docs, folder).collect()) == sorted([one, third])

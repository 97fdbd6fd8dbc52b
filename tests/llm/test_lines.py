import random

from labelsieve.llm import lines
from labelsieve.storage import materialise


def brute(docs, min_words):
    """Kept line numbers of each document, by comparing all runs."""
    runs, parsed = {}, []
    for doc_id, text in sorted(docs):
        rows = [(at, line.strip(" "), len(line.split())) for at, line in enumerate(text.split("\n"))]
        full = [r for r in rows if r[2]]
        parsed.append((doc_id, rows, full))
        for a in range(len(full)):
            for b in range(a + 1, len(full) + 1):
                if sum(r[2] for r in full[a:b]) >= min_words:
                    runs.setdefault(tuple(r[1] for r in full[a:b]), []).append((doc_id, a, b))
    doomed = {d: set() for d, _ in docs}
    full_of, rows_of = {d: f for d, _, f in parsed}, {d: r for d, r, _ in parsed}
    for places in runs.values():
        first = places[0]
        for doc_id, a, b in places[1:]:
            if doc_id != first[0] or a >= first[2]:
                full = full_of[doc_id]
                end = full[b][0] if b < len(full) else len(rows_of[doc_id])
                doomed[doc_id].update(range(full[a][0], end))
    return {d: [at for at, _, _ in rows if at not in doomed[d]] for d, rows, _ in parsed}


def kept_text(text, kept):
    parts = text.split("\n")
    return "\n".join(parts[i] for i in kept)


def test_matches_brute_force_over_all_runs(frame):
    draw = random.Random(11)
    pool = [" ".join(draw.choices("abcde", k=draw.randint(1, 4))) for _ in range(9)] + ["", "  "]
    docs = [(i, "\n".join(draw.choices(pool, k=draw.randint(0, 14)))) for i in range(60)]
    docs.append((99, "\n".join(["a b"] * 40)))
    for min_words in (1, 5, 9):
        expected = brute(docs, min_words)
        got = {r.doc_id: r for r in lines.dedup_lines(frame(docs), min_words=min_words).collect()}
        for doc_id, text in docs:
            kept = expected[doc_id]
            assert got[doc_id].text == kept_text(text, kept), (min_words, doc_id, text)
            assert got[doc_id].n_removed == len(text.split("\n")) - len(kept)


def test_long_passages_go_and_short_ones_stay(frame):
    passage = " ".join(f"w{i}" for i in range(55))
    docs = frame([(1, f"one\n{passage}\ntwo"), (2, f"three\n{passage}\nfour"), (3, "one"), (4, "one")])
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == {1: f"one\n{passage}\ntwo", 2: "three\nfour", 3: "one", 4: "one"}


def test_nulls_repeats_clashes_and_empty(frame, spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(None, passage), (None, passage), (2, passage), (2, passage), (3, None), (4, ""), (5, " \n" + passage)]
    docs = frame(rows).withColumnsRenamed({"lang": "n_lines", "source": "n_removed"})
    got = sorted(((r.doc_id or 0), r.text or "-", r.n_lines, r.n_removed) for r in lines.dedup_lines(docs).collect())
    assert got == sorted([
        (0, passage, 1, 0), (0, passage, 1, 0), (2, "-", 1, 1), (2, "-", 1, 1), (3, "-", 1, 0),
        (4, "-", 1, 0), (5, " ", 2, 1),
    ])
    assert lines.dedup_lines(frame([])).collect() == []


def test_winnowing_selects_a_shared_fingerprint(frame):
    shared = "\n".join(f"line {i} of a shared passage with words" for i in range(9))
    docs = frame([(1, "x y\n" + shared), (2, shared + "\nz"), (3, "\n".join(f"own words {i}" for i in range(40)))])
    found = materialise(lines.positions(docs))
    prints = {d: {r.fingerprint for r in found.where(f"doc_id = {d}").collect()} for d in (1, 2, 3)}
    matched = lines.matched_positions(found).collect()
    assert {r.fingerprint for r in matched} == prints[1] & prints[2] and prints[1] & prints[2]
    assert prints[3] and {r.doc_id for r in matched} == {1, 2}


def test_one_row_for_each_selected_position(frame):
    text = "\n".join(f"line {i} of ten words or so a b c d" for i in range(200))
    found = lines.positions(frame([(1, text)])).collect()
    assert len({r.place for r in found}) == len(found) < 150
    assert all(sum(x.w for x in r.before[:-1]) < lines.MIN_WORDS for r in found)


def test_texts_under_one_id_are_different_documents(frame):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(7, f"a\n{passage}"), (7, f"{passage}\nb"), (8, f"c\n{passage}")]
    kept = [r.text for r in lines.dedup_lines(frame(rows)).collect()]
    assert sum(passage in text for text in kept) == 1 and "c" in kept


def test_very_long_texts(frame):
    passage = "\n".join(f"shared line {i} w w w w w w" for i in range(12))
    own = ["\n".join(f"{d} own {i} x y z" for i in range(9000)) for d in (1, 2)]
    docs = frame([(1, own[0] + "\n" + passage + "\n" + own[0]), (2, own[1] + "\n" + passage)])
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert got[1].text == own[0] + "\n" + passage and got[1].n_removed == 9000
    assert got[2].text == own[1] and got[2].n_removed == 12

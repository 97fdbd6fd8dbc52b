import hashlib

import numpy as np

from labelsieve.llm import fingerprints as fp
from labelsieve.llm.queries import op1_fingerprints


def brute(rows):
    """(doc_id, n_chars, edited text) by a loop over rows in descending doc_id."""
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        out[doc_id] = (len(text), text[: len(text) - half] + following[:half], following, text)
    return out


def test_sums_do_not_depend_on_order_and_undo():
    maker = fp.Fingerprinter()
    a, b, c = (maker.paragraph(t) for t in ("one two three four", "five", "six seven"))
    state = maker.state("one two three four\nfive\nsix seven")
    assert np.array_equal(state, maker.state("six seven\none two three four\nfive"))
    assert np.array_equal(fp.delete(state, b), maker.state("six seven\none two three four"))
    assert np.array_equal(fp.insert(fp.insert(a, c), b), state)
    assert not np.array_equal(state, maker.state("one two three four\nfive\nfive\nsix seven"))
    assert np.array_equal(fp.from_text(fp.as_text(state)), state)
    assert not maker.state("").any() and maker.state("\n")[: fp.WIDE].any()


def test_query_matches_brute_force(spark, folder, documents):
    expected, maker = brute(documents), fp.Fingerprinter()
    rows = op1_fingerprints(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(expected)
    for r in rows:
        n_chars, changed, following, text = expected[r.doc_id]
        assert r.n_chars == n_chars
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        state, after = maker.state(text), maker.state(changed)
        assert r.fingerprint == fp.as_text(state) and r.edited_fingerprint == fp.as_text(after)
        assert r.near_edited == fp.likeness(state, after)
        assert r.near_next == fp.likeness(state, maker.state(following))
    long = [r for r in rows if r.n_chars > 400]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95


def test_slices_meet(frame, documents):
    docs = frame(documents[:97])
    expected = brute(documents[:97])
    for slice_rows in (1, 7, 1000):
        rows = fp.fingerprint_edits(docs, slice_rows=slice_rows).collect()
        got = {r.doc_id: r.edited_sha256 for r in rows}
        assert len(rows) == 97
        assert got == {i: hashlib.sha256(e[1].encode()).hexdigest() for i, e in expected.items()}


def test_nulls_ties_and_empty(frame):
    assert fp.fingerprint_edits(frame([])).collect() == []
    rows = fp.fingerprint_edits(
        frame([(None, "ab"), (None, None), (3, "x" * 50_000), (3, ""), (3, ""), (1, "é\U0001f600yz")]),
        slice_rows=2,
    ).collect()
    assert len(rows) == 6
    assert [r.n_chars for r in rows if r.doc_id == 1] == [4]
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {"00" * fp.BYTES}
    alone = fp.fingerprint_edits(frame([(None, "abcd")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_long_texts_of_equal_lines_and_words():
    """Counts beyond 16 bits neither wrap nor vanish."""
    maker = fp.Fingerprinter()
    cycle = ["red green blue"] * 30_000
    short, longer = maker.state(" ".join(cycle)), maker.state(" ".join(cycle + cycle[:10_000]))
    assert fp.likeness(short, longer) > 0.99
    assert fp.likeness(fp.from_text(fp.as_text(short)), fp.from_text(fp.as_text(longer))) > 0.99
    one, many = maker.state("a line of text"), maker.state("\n".join(["a line of text"] * 65_537))
    assert not np.array_equal(one[: fp.WIDE], many[: fp.WIDE])
    assert np.array_equal(many, one * np.uint64(65_537))


def test_one_id_does_not_fill_a_slice(frame):
    rows = [(None, f"text number {i}") for i in range(300)] + [(7, f"other {i}") for i in range(300)]
    slices = fp.dealt(frame(rows), slice_rows=50).groupBy("slice").count().collect()
    assert len(slices) > 6 and max(r["count"] for r in slices) < 200
    got = fp.fingerprint_edits(frame(rows), slice_rows=50).collect()
    assert len(got) == 600 and sum(r.doc_id is None for r in got) == 300
    again = fp.fingerprint_edits(frame(rows[::-1]), slice_rows=7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))

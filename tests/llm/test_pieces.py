import math
import struct

import numpy as np
import pytest
import sentencepiece

from labelsieve.llm import pieces
from labelsieve.llm.queries import op3_sentencepiece

ODD = [
    "", " ", "  a  b\nc\t▁d é \U0001f600 \0 z", "x" * 5000, "\n\n", "café 你好世界 ab12345", "   lead",
    "trail  ", "�​ weird", "<s> </s> <0x0A> <unk>", "(the) \"q\" x.y.com a_b don't 3.14 f(bar)[0]->x;",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_same_as_the_library(library, documents):
    model = pieces.load(pieces.default_model())
    texts = ODD + [t for _, t in documents]
    ids = model.encode(texts)
    assert ids == library.encode(texts)
    assert [model.decode(i) for i in ids] == library.decode(ids)


def test_query_round_trips(spark, folder, library, documents):
    rows = op3_sentencepiece(spark, folder).collect()
    texts = dict(documents)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in rows)
    assert [r.ids for r in rows] == library.encode([texts[r.doc_id] for r in rows])


def test_memory_and_index_limits_change_nothing(monkeypatch, documents):
    model = pieces.load(pieces.default_model())
    texts = [t for _, t in documents[:6]]
    expected = model.encode(texts)
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "INDEXED", 1024)
    assert [model.encode([t])[0] for t in texts] == expected


def test_edges_are_all_occurrences():
    model = pieces.load(pieces.default_model())
    text = "▁the▁theatre\0▁a\0"
    starts, found, lengths = model.edges(text)
    expected = {
        (i, model.ids[text[i : i + n]], n)
        for i in range(len(text))
        for n in range(1, model.longest + 1)
        if len(text[i : i + n]) == n and text[i : i + n] in model.ids
    }
    assert set(zip(starts.tolist(), found.tolist(), lengths.tolist())) == expected


def varint(value):
    out = b""
    while value > 127:
        out, value = out + bytes([value & 127 | 128]), value >> 7
    return out + bytes([value])


def message(*parts):
    """A protocol-buffer message of (number, int, float or bytes)."""
    out = b""
    for number, value in parts:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def model_file(folder, *, bpe, fallback, charsmap=b"", trim=False, extra=(), size=6000):
    """A smaller model of the public one's pieces."""
    public = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    known = [(b"<unk>", 0.0, 2), (b"<s>", 0.0, 3), (b"</s>", 0.0, 3)]
    known += [(f"<0x{b:02X}>".encode(), 0.0, 6) for b in range(256) if fallback]
    names = [public.id_to_piece(i) for i in range(259, public.get_piece_size())]
    singles = [n for n in names if len(n) == 1 and n not in "qxé"]
    longer = [n for n in names if len(n) > 1 and n.strip("▁")][:size]
    # A BPE score tells the order of merges, a unigram one is a logarithm.
    scored = enumerate(longer + singles)
    known += [(n.encode(), -float(i) if bpe else -math.log(10 + 1.3717 * i), 1) for i, n in scored]
    known += list(extra)
    data = message(
        *[(1, message((1, name), (2, score), (3, kind))) for name, score, kind in known],
        (2, message((3, 2 if bpe else 1), (35, int(fallback)))),
        (3, message((1, b"own"), (2, charsmap), (3, 1), (4, int(trim)), (5, 1))),
    )
    path = folder / f"{bpe}{fallback}{len(charsmap)}{trim}.model"
    path.write_bytes(data)
    return str(path)


def charsmap():
    """The character map of the library's usual normaliser."""
    proto = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    spec = next(v for n, v in pieces.fields(proto) if n == 3)
    return next(v for n, v in pieces.fields(spec) if n == 2)


@pytest.mark.parametrize("normal", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("bpe", [False, True])
def test_every_kind_of_model_is_the_library(tmp_path, documents, bpe, fallback, normal):
    path = model_file(tmp_path, bpe=bpe, fallback=fallback, charsmap=charsmap() if normal else b"", trim=normal)
    model = pieces.load(path)
    assert model.bpe == bpe and bool(model.byte_ids) == fallback and (model.normalise is None) != normal
    texts = ODD + ["qq x é qé", "ＡＢＣ ﬁne ①", " q", "q" * 200, "abq" * 90] + [t for _, t in documents[:150]]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert model.encode(texts) == library.encode(texts)


def test_other_models_are_refused(tmp_path):
    for extra in ([(b"<mask>", 0.0, 4)], [(b"the", -1.0, 5)]):
        with pytest.raises(ValueError, match="user or unused"):
            pieces.load(model_file(tmp_path, bpe=True, fallback=True, extra=extra))
        pieces.load.cache_clear()
    words = message((1, message((1, b"a"))), (2, message((3, 3))), (3, message((4, 0))))
    with pytest.raises(ValueError, match="neither unigram nor BPE"):
        pieces.Kind.read(words)


def test_pairs_fit_as_merging_tells(documents):
    model = pieces.load(pieces.default_model())
    draw = np.random.default_rng(3)
    normal = np.nonzero(model.normal)[0]
    left, right = draw.choice(normal, (2, 4000))
    # Halves of pieces meet far more often than any two pieces.
    found = model._formed[0]
    left = np.concatenate([left, found[::40] // len(model.pieces)])
    right = np.concatenate([right, found[::40] % len(model.pieces)])
    expected = [
        model.merged(model.pieces[a] + model.pieces[b]) == [model.pieces[a], model.pieces[b]]
        for a, b in zip(left.tolist(), right.tolist())
    ]
    assert model.fit(left, right).tolist() == expected
    assert model.follows(left, right).tolist() == expected and model.follows(left, right).tolist() == expected
    assert 0 < sum(expected) < len(expected)


def test_memory_only_replays_what_was_relaxed(documents, monkeypatch):
    path = pieces.default_model()
    texts = [t for _, t in documents[:60]]
    pieces.load.cache_clear()
    model, learnt = pieces.load(path), {}
    relax = model._relaxed

    def relaxed(parts):
        found = relax(parts)
        learnt.update(zip(parts, found))
        return found

    monkeypatch.setattr(model, "_relaxed", relaxed)
    first = model.encode(texts)
    # Each stretch went through the suffix array once, none of a second reading did.
    assert model.known == learnt and len(learnt) > 1000
    indexed = len(learnt)
    learnt.clear()
    assert model.encode(texts) == first and not learnt
    cut = {part for t in texts if t for part in model.stretches.findall("▁" + t.replace(" ", "▁"))}
    assert len(cut - set(model.known)) == 0 and indexed == len(model.known)


def test_long_stretches_and_short_ones_agree(monkeypatch, documents):
    model = pieces.load(pieces.default_model())
    texts = ["".join(t.split())[:400] for _, t in documents[:40] if t]
    expected = model.encode(texts)
    model.known.clear()
    monkeypatch.setattr(pieces, "LONG", 0)
    assert model.encode(texts) == expected
    model.known.clear()


def test_unigram_takes_the_best_path():
    names = ["<unk>", "▁", "a", "b", "ab", "▁a", "aab"]
    scores = [0.0, -1.0, -2.0, -2.0, -3.5, -2.5, -3.0]

    def best(text):
        found = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            options = [
                (found[s][0] + scores[names.index(text[s:end])], found[s][1] + [names.index(text[s:end])])
                for s in range(end)
                if s in found and text[s:end] in names[1:]
            ]
            if options:
                found[end] = max(options, key=lambda o: o[0])
        return found[len(text)][1]

    model = pieces.PieceModel(names, scores, [False] + [True] * 6, 0, [], bpe=False)
    for text in ("a", "ab", "aab", "aabab a", "b aab", "ab" * 50):
        assert model.encode([text])[0] == best("▁" + text.replace(" ", "▁"))
    assert model.encode(["ax", "axxa x"]) == [[5, 0], [5, 0, 2, 1, 0]]


def test_rows_and_tables(frame, spark):
    docs = frame([(1, None), (2, ""), (2, "the cat"), (2, "the cat"), (None, "z" * 300_000)])
    rows = pieces.encode(docs).collect()
    assert sorted(len(r.ids) for r in rows)[:2] == [0, 0] and all(r.round_trip for r in rows)
    tokens = pieces.encode(docs.withColumnRenamed("lang", "ids"))
    assert sorted(r.text for r in pieces.decode(tokens).collect()) == ["", "", "the cat", "the cat", "z" * 300_000]
    assert pieces.encode(frame([])).collect() == []

"""Homomorphic multiset fingerprints of documents.

A document is a multiset of paragraphs (lines). Each paragraph is hashed to a
wide vector of 64-bit lanes, and the fingerprint is the sum of those vectors
modulo 2^64. Order of paragraphs doesn't matter, a paragraph is inserted by
adding its vector and deleted by subtracting it, and parts are combined by adding.

The vector has two parts. WIDE lanes are uniform output of SHAKE-128 over the
paragraph: equal sums mean equal multisets. SKETCH lanes are a count sketch
of the paragraph's three-word shingles with hashed places and signs: their
cosine estimates how much two documents share, whatever was moved around. Written as
text, a sketch lane has its lower 32 bits: no text of Spark's has 2^31 shingles.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.llm.common import whole_text

WIDE = 16
SKETCH = 256
LANES = WIDE + SKETCH
#: Bytes of a written fingerprint.
BYTES = 8 * WIDE + 4 * SKETCH
_LANE, _SHORT = np.dtype("<u8"), np.dtype("<i4")
#: Paragraphs hashed at a time.
PARAGRAPHS = 2_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_REMEMBERED = 200_000
#: About so many documents go to one ordered slice; beyond MOST_SLICES slices they grow.
SLICE_ROWS = 500
MOST_SLICES = 20_000
EDITS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


class Fingerprinter:
    """Hashes paragraphs. Remembers word hashes, up to a fixed number of words."""

    def __init__(self) -> None:
        self._words: dict[str, int] = {}

    def paragraph(self, text: str) -> np.ndarray:
        """The vector of one paragraph."""
        return self.paragraphs([text])[0]

    def paragraphs(self, texts: list[str]) -> np.ndarray:
        """The vectors of several paragraphs, a row each."""
        return np.array([self.total([text]) for text in texts], dtype=np.uint64).reshape(-1, LANES)

    def total(self, texts: list[str]) -> np.ndarray:
        """The sum of the vectors of paragraphs, a bounded number of them at a time."""
        state = np.zeros(LANES, dtype=np.uint64)
        for start in range(0, len(texts), PARAGRAPHS):
            state += self._total(texts[start : start + PARAGRAPHS])
        return state

    def _total(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(LANES, dtype=np.uint64)
        known = self._words
        if len(known) > _REMEMBERED:
            known.clear()
        hashes: list[int] = []
        owners, digest = [], xxhash.xxh64_intdigest
        shakes = b"".join([hashlib.shake_128(text.encode()).digest(8 * WIDE) for text in texts])
        out[:WIDE] = np.frombuffer(shakes, _LANE).reshape(-1, WIDE).sum(axis=0, dtype=np.uint64)
        for text in texts:
            words = text.split()
            for word in words:
                if word not in known:
                    known[word] = digest(word)
            if words and len(words) < 3:
                words = [*words, *[""] * (3 - len(words))]
                known[""] = 0
            hashes.extend([known[word] for word in words])
            owners.append(len(words))
        values = np.array(hashes, dtype=np.uint64)
        if len(values):
            owner = np.repeat(np.arange(len(texts)), owners)
            with np.errstate(over="ignore"):
                mixed = values[:-2] * _MIX[0] + values[1:-1] * _MIX[1] + values[2:] * _MIX[2]
                mixed ^= mixed >> np.uint64(29)
                mixed *= _MIX[1]
                mixed ^= mixed >> np.uint64(32)
            mixed = mixed[owner[:-2] == owner[2:]]
            lane = (mixed % np.uint64(SKETCH)).astype(np.int64)
            sign = np.where((mixed >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
            out[WIDE:] = np.bincount(lane, sign, SKETCH).astype(np.int64).view(np.uint64)
        return out

    def state(self, text: str) -> np.ndarray:
        """The fingerprint of a text; no paragraph in an empty one."""
        return self.total(paragraphs_of(text))


def paragraphs_of(text: str) -> list[str]:
    return text.split("\n") if text else []


def insert(state: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return state + vector


def delete(state: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return state - vector


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Cosine of the sketch lanes, within 0 and 1; 1 for equal fingerprints."""
    if np.array_equal(one, other):
        return 1.0
    a = one[WIDE:].view(np.int64).astype(np.float64)
    b = other[WIDE:].view(np.int64).astype(np.float64)
    size = float(a @ a) * float(b @ b)
    return min(1.0, max(0.0, float(a @ b) / size**0.5)) if size else 0.0


def as_text(state: np.ndarray) -> str:
    short = state[WIDE:].view(np.int64).astype(_SHORT)
    return state[:WIDE].astype(_LANE).tobytes().hex() + short.tobytes().hex()


def from_text(text: str) -> np.ndarray:
    raw = bytes.fromhex(text)
    sketch = np.frombuffer(raw[8 * WIDE :], _SHORT).astype(np.int64)
    return np.concatenate([np.frombuffer(raw[: 8 * WIDE], _LANE).astype(np.uint64), sketch.view(np.uint64)])


@dataclass(frozen=True)
class Read:
    """A document that waits for the next one: its text and fingerprint, and that of what an edit touches."""

    doc_id: int | None
    text: str
    state: np.ndarray
    kept: int  # code points that an edit keeps
    whole: int  # lines wholly in them
    touched: np.ndarray

    @classmethod
    def of(cls, maker: Fingerprinter, doc_id: int | None, text: str) -> Read:
        kept = len(text) - len(text) // 2
        whole, lines = text.count("\n", 0, kept), paragraphs_of(text)
        touched = maker.total(lines[whole:])
        return cls(doc_id, text, insert(maker.total(lines[:whole]), touched), kept, whole, touched)

    def edited(self, maker: Fingerprinter, following: str) -> tuple[str, np.ndarray]:
        """The text with its last half replaced, and its fingerprint by deletion and insertion.

        Only lines that the edit touches are hashed anew.
        """
        changed = self.text[: self.kept] + following[: len(self.text) - self.kept]
        added = maker.total(paragraphs_of(changed)[self.whole :])
        return changed, insert(delete(self.state, self.touched), added)


def _order() -> list[Column]:
    """Descending doc_id, null last, then by a hash of the text: smaller comes first."""
    return [
        F.col("doc_id").isNull().cast("bigint").alias("unknown"),
        F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).cast("bigint").alias("down"),
        F.xxhash64("text").alias("hash"),
    ]


def places(heads: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many heads (sorted, by rows) are at or before each row, and whether one is the row itself."""
    every = np.concatenate([heads, rows])
    is_row = np.arange(len(every)) >= len(heads)
    order = np.lexsort((is_row, *every.T[::-1]))
    before = np.empty(len(every), np.int64)
    before[order] = np.cumsum(~is_row[order])
    before = before[len(heads) :]
    own = heads[np.maximum(before - 1, 0)] if len(heads) else rows
    return before, (before > 0) & (own == rows).all(axis=1)


def dealt(docs: DataFrame, *, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Documents dealt into slices of their order, each with the row that follows it.

    ``slice``, ``doc_id``, ``text`` and ``follows``. The first row of each slice
    also goes, with ``follows`` set, to the slice before, and the first row of
    all to the last slice, so every row finds the next one in its own slice. Rows of one
    doc_id, or of none, are parted by their texts; only rows alike in both stay together.
    Texts are shuffled once. The first key of each slice comes to the driver, MOST_SLICES at most.
    """
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text("text").alias("text"))
    slices = min(MOST_SLICES, max(1, -(-docs.count() // slice_rows)))
    firsts = (
        known.select(*_order())
        .repartitionByRange(slices, "unknown", "down", "hash")
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.min(F.struct("unknown", "down", "hash")).alias("first"))
    )
    heads = np.array(sorted(set(tuple(row["first"]) for row in firsts.collect())), dtype=np.int64).reshape(-1, 3)
    last = max(0, len(heads) - 1)

    @F.pandas_udf("array<int>")
    def slices_of(unknown: pd.Series, down: pd.Series, hashes: pd.Series) -> pd.Series:
        """Own slice, and for a slice's first row the slice before."""
        rows = np.stack([c.to_numpy().astype(np.int64) for c in (unknown, down, hashes)], axis=1)
        before, first = places(heads, rows)
        own = np.clip(before - 1, 0, last)
        return pd.Series(
            [[s, s - 1 if s else last] if f else [s] for s, f in zip(own.tolist(), first.tolist(), strict=True)]
        )

    return known.select(
        F.posexplode(slices_of(*_order())).alias("extra", "slice"), "doc_id", "text"
    ).select("slice", "doc_id", "text", (F.col("extra") > 0).alias("follows"))


def fingerprint_edits(docs: DataFrame, *, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    of the next document's, in descending doc_id; the first document follows the last. Rows of null doc_id
    come after all others. Rows of one doc_id are ordered by a hash of their text.
    Null texts are empty; an empty text has the zero fingerprint. Other columns are left out.
    """
    ordered = (
        dealt(docs, slice_rows=slice_rows)
        .repartition("slice")
        .sortWithinPartitions("slice", "follows", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    )

    def run(batches):
        maker, waiting, first, at = Fingerprinter(), None, None, None
        out: list[tuple] = []

        def finish(row: Read, following: str, next_state: np.ndarray) -> None:
            changed, edited_state = row.edited(maker, following)
            out.append(
                (
                    row.doc_id,
                    len(row.text),
                    hashlib.sha256(changed.encode()).hexdigest(),
                    as_text(row.state),
                    as_text(edited_state),
                    likeness(row.state, edited_state),
                    likeness(row.state, next_state),
                )
            )

        def batch_of_out() -> pa.RecordBatch:
            columns = [*zip(*out, strict=True)] if out else [[] for _ in EDITS]
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, EDITS.types, strict=True)],
                names=EDITS.names,
            )
            out.clear()
            return made

        for batch in batches:
            for piece, doc_id, text, follows in zip(
                *(batch.column(i).to_pylist() for i in range(4)), strict=True
            ):
                if piece != at:
                    if waiting:
                        finish(waiting, first[0], first[1])
                    waiting, first, at = None, None, piece
                if follows:
                    if waiting:
                        finish(waiting, text, maker.state(text))
                    waiting = None
                    continue
                read = Read.of(maker, doc_id, text)
                if waiting:
                    finish(waiting, text, read.state)
                waiting = read
                first = first or (text, read.state)
            yield batch_of_out()
        if waiting:
            finish(waiting, first[0], first[1])
        yield batch_of_out()

    return ordered.mapInArrow(
        run,
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )

"""SimHash near-duplicate classes by Golay-code fuzzy hashing.

Fingerprints are 64-bit SimHashes of word shingles. Two link when they differ in
at most two bits. A fingerprint is cut into three segments of at most 23 bits.
Two errors over three segments leave one segment without error, and the segment
after it with at most two. The perfect binary Golay code [23, 12, 7] makes that
second segment searchable: two words of 23 bits that differ in at most two bits
always share a codeword within distance four, and a word has one or six of
those. So a fingerprint gets keys (which segment is exact, its bits, codeword of the next
segment), sixteen on average, and linked fingerprints share at least one.

Only distinct fingerprints are joined, so copies cost nothing. Buckets of at
most SMALL fingerprints are verified pair by pair. In larger ones no pairs are
made: two fingerprints are within two bits exactly when they share a word
within one bit of both, so all words within one bit of each member are grouped
and tied to the smallest member; that loses no link and grows with the members.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.llm.common import per_document
from labelsieve.storage import join_lookup, materialise

SHINGLE = 3
SEED = 42
BITS = 2
#: Buckets up to this size are verified pairwise.
SMALL = 32
SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit number; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        hashes = [
            digest(joined[a:b], SEED)
            for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)
        ]
    values = np.array(hashes, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(values), 65536):  # bounded memory for any text
        part = values[start : start + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(values), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, *, size: int = SHINGLE, carry: dict[str, Column] | None = None) -> DataFrame:
    """Carried columns (doc_id) and ``fp`` for every row; null and empty texts have fingerprint 0."""
    return per_document(
        docs, lambda texts: [[simhash(text, size) for text in texts]], "fp bigint", carry=carry
    )


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits, and for each remainder the patterns of weight four or less.

    Row s of the second table lists all patterns e of at most four bits with
    remainder s: a word w with that remainder has the codewords w ^ e within
    distance four. Rows hold one or six; the rest is -1.
    """

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    upper = np.array([remainder(high << 11) for high in range(4096)], dtype=np.int64)
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for places in combinations(range(23), weight):
            word = sum(1 << p for p in places)
            patterns[remainder(word)].append(word)
    table = np.full((2048, 6), -1, dtype=np.int64)
    for row, found in enumerate(patterns):
        table[row, : len(found)] = found
    return upper, table


def codewords(segments: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance four of each 23-bit word; -1 fills up to six."""
    upper, table = golay_tables()
    errors = table[upper[segments >> 11] ^ (segments & 2047)]
    return np.where(errors < 0, -1, (segments[:, None] ^ errors) >> 11)


def golay_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: exact segment with each nearby codeword of the next."""
    unsigned = values.view(np.uint64)
    parts = [
        ((unsigned >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        for low, width in SEGMENTS
    ]
    rows, keys = [], []
    for exact in range(3):
        near = codewords(parts[(exact + 1) % 3])
        key = (np.int64(exact) << 34) | (parts[exact][:, None] << 12) | near
        row, column = np.nonzero(near >= 0)
        rows.append(row)
        keys.append(key[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, keys = golay_keys(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(values[rows])], names=["key", "fp"]
            )

    return distinct.select("fp").mapInArrow(run, "key bigint, fp bigint")


def links(distinct: DataFrame, *, small: int = SMALL) -> DataFrame:
    """Edges (``a``, ``b``) whose connected parts are the classes of linked fingerprints.

    All edges join fingerprints within two bits, or, in large buckets, tie a fingerprint to
    the smallest one sharing a word within one bit.
    """
    keyed = materialise(_keyed(distinct), "golay-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(keyed.join(sizes, "key"), "golay-buckets")
    pairs = (
        members.where(F.col("n") <= small)
        .groupBy("key")
        .agg(F.collect_list("fp").alias("fps"))
        .select(F.explode("fps").alias("a"), "fps")
        .select("a", F.explode("fps").alias("b"))
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS))
    )
    crowded = members.where(F.col("n") > small).select("fp").distinct()
    near = crowded.select(
        "fp",
        F.explode(
            F.concat(
                F.array("fp"),
                *[F.array(F.col("fp").bitwiseXOR(F.lit(_signed(1 << bit)))) for bit in range(64)],
            )
        ).alias("mid"),
    )
    ties = (
        near.groupBy("mid")
        .agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps"))  # at most 65 members
        .where(F.size("fps") > 1)
        .select(F.explode("fps").alias("a"), "b")
        .where("a > b")
    )
    return pairs.unionByName(ties).distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of the edges.

    Alternates large-star and small-star: each round every node hands its
    larger neighbours to the smallest one, then its smaller ones. The edges of each
    round are written to the shared scratch folder.
    """
    pairs = materialise(edges.select("a", "b").where("a <> b").distinct(), "star")
    state = None
    while True:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        large = materialise(large, "star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct()
        )
        pairs = materialise(small, "star")
        mark = pairs.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if mark == state:
            break
        state = mark
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def classes(docs: DataFrame, *, size: int = SHINGLE, carry: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, ``fp``, ``root`` and ``component_id`` for every row, and what else is carried.

    ``root`` is a fingerprint that names the class, ``component_id`` the smallest doc_id of it. Rows of null doc_id get
    a class but name none, unless all of it are null. Repeated rows stay
    repeated; an empty table has an empty result.
    """
    carried = {"doc_id": F.col("doc_id"), **(carry or {})}
    marked = materialise(fingerprints(docs, size=size, carry=carried), "simhash")
    distinct = materialise(
        marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct"
    )
    roots = components(links(distinct)).withColumnsRenamed({"node": "fp"})
    rooted = materialise(
        distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted"
    )
    owners = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    owned = materialise(
        rooted.join(owners, "root").select("fp", "n", "root", "component_id"), "classes"
    )
    return join_lookup(marked, owned, "fp", "n")


def hex_digits(column: str = "fp"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")

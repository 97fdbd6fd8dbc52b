"""Benchmark decontamination by a prefix-filtered set join.

A window is 13 consecutive words of a benchmark item; an item of fewer words is
one window. A document word is hit when it lies in an occurrence of a window.

The join follows the prefix filter for sets. Words are ordered by rarity over
the whole corpus. A window can only occur where its rarest word does, so that
word alone is its prefix, and one word in every run of about 13 is enough for
an item. A document word equal to a prefix word fixes where the item would have
to lie; the length and position bounds reject placements in which fewer than a
window's words overlap, and the rest are verified word by word, extending both
ways to the whole run.

The items are a query set. They are taken in blocks of bounded size, each block
broadcast in turn and all documents streamed past it, so neither the driver nor
a task ever holds more than one block, whatever the size of the benchmark. Between blocks
the documents are written with what was found so far.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.llm.common import computed, per_document, whole_text
from labelsieve.storage import materialise

WINDOW = 13
#: A document is contaminated when at least this share of its words is hit.
SHARE = 20
#: Words of items in one broadcast block: some tens of MB.
BLOCK_WORDS = 1_000_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The same over text whose letters are as they were.
_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, runs of digits, a-z and non-ASCII."""
    return _WORD.findall(text.lower())


def prefix_index(items: list[tuple[str, list[bytes]]], counts: dict, window: int) -> dict:
    """Word -> [(item, offset)]: for every window of every item its rarest word's place."""
    index: dict[bytes, list[tuple[int, int]]] = {}
    for number, (_, words) in enumerate(items):
        size = min(window, len(words))
        rarity = [(counts.get(w, 0), w) for w in words]
        chosen = {
            min(range(start, start + size), key=lambda i: (rarity[i], i))
            for start in range(len(words) - size + 1)
        }
        for offset in sorted(chosen):
            index.setdefault(words[offset], []).append((number, offset))
    return index


def find_runs(words: list[bytes], items, index: dict, window: int) -> tuple[list, set]:
    """Runs [start, end) of document words that hold windows, and the items found."""
    total, runs, found, reached = len(words), [], set(), {}
    for at, word in enumerate(words):
        for number, offset in index.get(word, ()):
            item = items[number][1]
            length, place = len(item), (number, at - offset)
            need = min(window, length)
            if min(at, offset) + min(total - at, length - offset) < need:
                continue
            if reached.get(place, -1) > at:
                continue
            left = 1
            while left <= offset and left <= at and words[at - left] == item[offset - left]:
                left += 1
            right = 1
            while (
                offset + right < length
                and at + right < total
                and words[at + right] == item[offset + right]
            ):
                right += 1
            reached[place] = at + right
            if left + right - 1 >= need:
                runs.append((at - left + 1, at + right))
                found.add(items[number][0])
    return _merged(runs), found


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """Carried columns (doc_id) with ``n_words``, ``runs`` and ``items``.

    ``runs`` are the hit word ranges [start, end), disjoint and in order;
    ``items`` the ids, as text in sorted order, of the items found. Null texts have no
    words; null item ids count as an empty id; items without words match
    nothing; repeated items and rows are each reported as they stand; an empty
    benchmark hits nothing. Texts are taken whole.
    """
    carried = carry if carry is not None else {"doc_id": F.col("doc_id")}
    queries, n_blocks = _blocks(benchmark, window, block_words)
    found = docs.select(
        *[column.alias(name) for name, column in carried.items()],
        whole_text("text").alias("__words_of"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("runs"),
        F.array().cast("array<string>").alias("items"),
    )
    for block in range(n_blocks):
        rows = queries.where(F.col("place") % n_blocks == block).collect()
        items = sorted((r.item_id, words_of(r.text.encode())) for r in rows)
        last = block == n_blocks - 1
        found = _scan(found, docs, items, window, [*carried], last)
        if not last:  # one scan at a time: each holds a block and has workers of its own
            found = materialise(found, "contamination")
    return found


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[DataFrame, int]:
    """Different items with words as ``item_id``, ``text``, ``place``, and how many blocks to deal them to by place.

    Words are counted as words_of() takes them. An item of more than a quarter of a block is
    cut into pieces that overlap by a window less one word, so each window is in one
    of them. No block has more than ``block_words`` words, unless that is less than a piece of one window.
    """
    named = computed(
        benchmark,
        [F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")],
        words=F.regexp_extract_all(whole_text("text"), F.lit(_WORDS), F.lit(0)),
    )
    size = max(block_words // 4, window)
    step = size - window + 1
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)), F.lit(step))
    pieces = materialise(
        named.where(F.size("words") > 0)
        .select("item_id", "words", F.explode(starts).alias("start"))
        .select("item_id", F.slice("words", F.col("start"), size).alias("words"))
        .select("item_id", F.array_join("words", " ").alias("text"), F.size("words").alias("n"))
        .distinct()
        .withColumn("place", F.xxhash64("item_id", "text").bitwiseAND((1 << 62) - 1)),
        "item-pieces",
    )
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    count = max(1, -(-total // block_words))
    while True:
        fullest = pieces.groupBy(F.col("place") % count).agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first().n
        if (fullest or 0) <= max(block_words, size) or count > 4 * total:
            return pieces, count
        count += -(-count // 2)


def _scan(found: DataFrame, docs: DataFrame, items, window: int, carried, last: bool) -> DataFrame:
    session = docs.sparkSession.sparkContext
    vocabulary = session.broadcast(frozenset(w for _, item in items for w in item))
    counts = _corpus_counts(docs, vocabulary) if items else {}
    index = prefix_index(items, counts, window)
    shared = session.broadcast((items, index))

    def work(texts: list[bytes]) -> list[list]:
        items, index = shared.value
        sizes, runs, names = [], [], []
        for text in texts:
            words = words_of(text)
            hit, found = find_runs(words, items, index, window)
            sizes.append(len(words))
            runs.append([{"start": a, "end": b} for a, b in hit])
            names.append(sorted(found))
        return [sizes, runs, names]

    schema = "block_words bigint, block_runs array<struct<start:bigint,end:bigint>>, block_items array<string>"
    text = [] if last else ["__words_of"]  # another block needs it
    keep = {name: F.col(name) for name in [*carried, *text, "runs", "items"]}
    scanned = per_document(found, work, schema, text="__words_of", carry=keep)
    return scanned.select(
        *carried,
        *text,
        F.col("block_words").alias("n_words"),
        _join_runs("runs", "block_runs").alias("runs"),
        F.array_sort(F.array_union("items", "block_items")).alias("items"),
    )


def _join_runs(one: str, other: str) -> Column:
    """Two lists of disjoint ranges as one."""
    ordered = F.array_sort(F.concat(one, other))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        touches = (F.size(done) > 0) & (run["start"] <= last["end"])
        wider = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end")
        )
        body = F.slice(done, 1, F.size(done) - 1)
        return F.when(touches, F.concat(body, F.array(wider))).otherwise(
            F.concat(done, F.array(run))
        )

    both = (F.size(one) > 0) & (F.size(other) > 0)
    return F.when(both, F.aggregate(ordered, empty, add)).otherwise(F.concat(one, other))


def _corpus_counts(docs: DataFrame, vocabulary) -> dict[bytes, int]:
    """How often each word of one block of items occurs in all documents."""
    spark = docs.sparkSession

    def count(batches):
        import pyarrow as pa

        known, seen = vocabulary.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(filter(known.__contains__, words_of(text)))
        yield pa.RecordBatch.from_pydict(
            {
                "word": pa.array([*seen], pa.binary()),
                "n": pa.array([*seen.values()], pa.int64()),
            }
        )

    texts = docs.select(whole_text("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


def flagged(runs: DataFrame, share: int = SHARE) -> DataFrame:
    """Adds ``n_hit``, ``n_items`` and ``contaminated`` to what contamination() returns."""
    hit = F.aggregate(
        "runs", F.lit(0).cast("bigint"), lambda n, run: n + run["end"] - run["start"]
    )
    return runs.withColumns({"n_hit": hit, "n_items": F.size("items").cast("bigint")}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    )

"""Line deduplication by winnowing over line hashes.

A run of consecutive lines with MIN_WORDS words or more that repeats an earlier
run is deleted. Lines are hashed. From every line the shortest window
reaching MIN_WORDS words is taken, forwards and backwards, and the first smallest line hash in it
is selected as a fingerprint. Only these positions are kept, one row each, with the lines around
them as far as a window reaches. Every line of a repeated run lies in a window inside that run,
which selects the same position in both occurrences: that is guaranteed.

Positions of equal fingerprints are joined; those without a partner are dropped. A match is then
extended both ways from the position: by i lines backwards and the fewest forwards that reach
MIN_WORDS words, and the other way about. Positions alike in all lines around them are extended
once, as one class. Each extent is compared with the earliest position that has it, never with all,
so groups of copies make no pairs. The furthest extents that an earlier position shares,
without overlap in the same document, are the repeated run around the position. Every different
line keeps its first occurrence.

A fingerprint, a class or an extent that holds much of the table is one row after partial
aggregation, and is looked up by broadcast.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.llm.common import computed, whole_text
from labelsieve.storage import join_lookup, join_small, materialise

MIN_WORDS = 50
#: Lines looked at before a window is sought among MIN_WORDS lines.
FEW = 6


def _reach(words: Column, start: Column, min_words: int) -> Column:
    """Lines from ``start`` (1-based) until ``min_words`` words are reached; 0 if they never are."""

    def count(part: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"))

        def add(state: Column, more: Column) -> Column:
            further = F.struct((state["n"] + more).alias("n"), (state["k"] + 1).alias("k"))
            return F.when(state["n"] >= min_words, state).otherwise(further)

        return F.aggregate(
            part, zero, add, lambda s: F.when(s["n"] >= min_words, s["k"]).otherwise(0)
        )

    near = count(F.slice(words, start, F.lit(FEW)))
    far = count(F.slice(words, start, F.lit(min_words)))  # each line has a word at least
    return F.when(near > 0, near).otherwise(far) if min_words > FEW else far


def positions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each selected position: document, place among lines with words, fingerprint, surroundings.

    ``before`` and ``after`` hold second hashes and words of lines, nearest first; ``after`` begins with
    the line itself. ``at`` has their numbers in the text, and that of the line behind them.
    ``context`` hashes both.
    """
    lines = F.split(whole_text("text"), "\n", -1)
    parsed = F.transform(
        lines,
        lambda line, at: F.struct(
            at.alias("at"),
            F.regexp_count(line, F.lit(r"\S+")).alias("w"),
            F.xxhash64(F.trim(line)).alias("h"),
            F.xxhash64(F.trim(line), F.lit("second")).alias("g"),
        ),
    )
    parsed = computed(
        docs,
        ["doc_id"],
        text_hash=F.xxhash64(whole_text("text")),
        n_lines=F.size(lines),
        lines=F.filter(parsed, lambda line: line["w"] > 0),
    )
    rows = computed(
        parsed,
        ["doc_id", "text_hash"],
        h=F.col("lines.h"),
        ws=F.col("lines.w"),
        rs=F.reverse(F.col("lines.w")),
        ls=F.transform("lines", lambda line: F.struct(line["g"].alias("g"), line["w"].alias("w"))),
        ats=F.concat(F.col("lines.at"), F.array("n_lines")),
    ).where(F.size("h") > 0)
    size = F.size("h")

    def least(start: Column, k: Column) -> Column:
        hashes = F.slice(F.col("h"), start, k)
        place = F.array_position(hashes, F.array_min(hashes)).cast("int") + start - 1
        return F.when(k > 0, place).otherwise(0)

    places = F.sequence(F.lit(1), size)
    forward = F.transform(places, lambda i: F.struct(i.alias("s"), _reach(F.col("ws"), i, min_words).alias("k")))
    backward = F.transform(
        places, lambda i: F.struct(i.alias("e"), _reach(F.col("rs"), size - i + 1, min_words).alias("k"))
    )
    chosen = F.array_union(
        F.transform(forward, lambda w: least(w["s"], w["k"])),
        F.transform(backward, lambda w: least(w["e"] - w["k"] + 1, w["k"])),
    )

    def around(words: Column, start: Column, left: Column) -> Column:
        """Lines until a window is full, or all that are left."""
        k = _reach(words, start, min_words)
        return F.when(k > 0, k).otherwise(left)

    def measured(place: Column) -> Column:
        n_before = around(F.col("rs"), size - place + 2, place - 1)
        n_after = around(F.col("ws"), place + 1, size - place)
        return F.struct(place.alias("place"), n_before.alias("n_before"), n_after.alias("n_after"))

    def selected(spot: Column) -> Column:
        place, n_before, n_after = (spot[name] for name in ("place", "n_before", "n_after"))
        return F.struct(
            place.alias("place"),
            F.element_at("h", place).alias("fingerprint"),
            F.reverse(F.slice("ls", place - n_before, n_before)).alias("before"),
            F.slice("ls", place, n_after + 1).alias("after"),
            F.slice("ats", place - n_before, n_before + n_after + 2).alias("at"),
        )

    # surroundings are cut before rows are made of them, so that no row holds a whole document
    kept = ["doc_id", "text_hash"]
    spots = F.transform(F.array_remove(chosen, 0), measured)
    sized = computed(rows, [*kept, "h", "ls", "ats"], spots=spots)
    found = sized.select(*kept, F.inline(F.transform("spots", selected)))
    return found.withColumn("context", F.xxhash64("before.g", F.lit("|"), "after.g"))


def matched_positions(found: DataFrame) -> DataFrame:
    """Positions whose fingerprint is selected at another position too."""
    spot = F.struct("doc_id", "text_hash", "place")
    repeated = (
        found.groupBy("fingerprint")
        .agg(F.min(spot).alias("low"), F.max(spot).alias("high"), F.count("*").alias("weight"))
        .where("low <> high")
        .select("fingerprint", "weight", F.lit(True).alias("repeated"))
    )
    repeated = materialise(repeated, "line-prints")
    return join_lookup(found, repeated, "fingerprint", "weight").where("repeated").drop("repeated")


def _running(lines: Column) -> Column:
    """Words of the first 0, 1, … lines."""
    zero = F.array(F.lit(0))
    return F.aggregate(lines, zero, lambda sums, line: F.concat(sums, F.array(F.element_at(sums, -1) + line["w"])))


def extents(matched: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """For each class of positions alike in context, the extents that several positions may share.

    ``i`` lines before a position and ``j`` after it, with ``low``, the earliest position of that extent.
    """
    spot = [F.col(c) for c in ("doc_id", "text_hash", "place")]
    classes = matched.groupBy("fingerprint", "context").agg(
        F.min(F.struct(*spot, "before", "after")).alias("low"),
        F.max(F.struct(*spot)).alias("high"),
        F.count("*").alias("members"),
    )
    shaped = computed(
        classes,
        ["fingerprint", "context", "high", "members"],
        low=F.struct("low.doc_id", "low.text_hash", "low.place"),
        before=F.col("low.before.g"),
        after=F.col("low.after.g"),
        back=_running(F.col("low.before")),
        # words with the line itself and 0, 1, ... lines after it
        ahead=F.slice(_running(F.col("low.after")), F.lit(2), F.size("low.after")),
    )

    def fewest(have: str, more: str, names: tuple[str, str]) -> Column:
        """Each number of lines on one side with the fewest on the other, where those are enough."""

        def pair(sum_: Column, n: Column) -> Column:
            short = F.size(F.filter(more, lambda other: sum_ + other < min_words))
            sides = {names[0]: n, names[1]: short}
            return F.struct(*[sides[side].alias(side) for side in ("i", "j")])

        pairs = F.transform(have, pair)
        return F.filter(pairs, lambda p: p[names[1]] < F.size(more))

    both = F.array_union(fewest("back", "ahead", ("i", "j")), fewest("ahead", "back", ("j", "i")))
    cut = shaped.select("*", F.explode(both).alias("e"))
    lines = [F.slice("before", F.lit(1), F.col("e.i")), F.slice("after", F.lit(1), F.col("e.j") + 1)]
    cut = cut.select(
        "fingerprint", "context", "members", "low", "high", "e", F.xxhash64("e.i", "e.j", *lines).alias("key")
    )
    cut = materialise(cut, "line-extents")
    keys = ["fingerprint", "key"]
    first = (
        cut.groupBy(*keys)
        .agg(F.min("low").alias("earliest"), F.max("high").alias("latest"), F.count("*").alias("weight"))
        .where("earliest <> latest")
        .drop("latest")
    )
    first = materialise(first, "line-firsts")
    shared = join_lookup(cut, first, keys, "weight").where("earliest is not null")
    return shared.groupBy("fingerprint", "context").agg(
        F.max("members").alias("weight"),
        F.collect_list(F.struct("e.i", "e.j", F.col("earliest").alias("low"))).alias("shared"),
    )


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``doomed``, the numbers of the lines to delete."""
    found = materialise(positions(docs, min_words), "line-positions")
    matched = materialise(matched_positions(found), "line-matches")
    known = materialise(extents(matched, min_words), "line-classes")
    joined = join_lookup(matched, known, ["fingerprint", "context"], "weight").where("shared is not null")

    def repeats(extent: Column) -> Column:
        low = extent["low"]
        same = F.col("doc_id").eqNullSafe(low["doc_id"]) & (F.col("text_hash") == low["text_hash"])
        return ~same | (F.col("place") - low["place"] > extent["i"] + extent["j"])

    extended = computed(
        joined.where("doc_id is not null"),
        ["doc_id", "text_hash", "at", "before"],
        run=F.filter("shared", repeats),
    ).where(F.size("run") > 0)
    here = F.size("before")
    span = F.struct(
        F.get("at", here - F.array_max("run.i")).alias("first_line"),
        (F.get("at", here + F.array_max("run.j") + 1) - 1).alias("last_line"),
    )
    return (
        extended.select("doc_id", "text_hash", span.alias("span"))
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("span").alias("spans"))
        .select(
            "doc_id",
            "text_hash",
            F.array_distinct(
                F.flatten(
                    F.transform("spans", lambda s: F.sequence(s["first_line"], s["last_line"]))
                )
            ).alias("doomed"),
        )
    )


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated runs deleted from ``text``, ``n_lines`` and ``n_removed``.

    Order is that of doc_id, then of lines; different texts under one doc_id are different documents,
    in the order of their hashes. Lines are compared without spaces around
    them; empty lines belong to the line before them. A null text stays null and has one empty
    line. Rows of null doc_id come first and stay whole. Rows that agree in
    doc_id and text count as one occurrence and are treated alike. Columns called n_lines or
    n_removed are replaced; all others go along.
    """
    doomed = materialise(repeated_lines(docs, min_words), "doomed-lines")
    mark = "__text_hash"
    others = docs.drop("n_lines", "n_removed")
    marked = computed(others, ["*"], **{mark: F.xxhash64(whole_text("text"))})
    renamed = doomed.withColumnsRenamed({"text_hash": mark, "doomed": "__doomed"})
    joined = join_small(marked, renamed, ["doc_id", mark], "left")
    joined = computed(joined, ["*"], __lines=F.split("text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__doomed"))
    text = F.array_join(F.transform(kept, lambda i: F.element_at("__lines", i + 1)), "\n")
    removed = F.col("__doomed").isNotNull()
    return joined.select(
        *[
            (F.when(removed, text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`"))
            for c in docs.columns
            if c not in ("n_lines", "n_removed")
        ],
        F.coalesce(F.size("__lines").cast("bigint"), F.lit(1)).alias("n_lines"),
        F.when(removed, F.size("__doomed")).otherwise(0).cast("bigint").alias("n_removed"),
    )

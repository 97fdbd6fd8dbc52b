"""Structural features of a string: how a value is built, not which it is."""

from pyspark.sql import Column, functions as F

from labelsieve.constants import INJECTION_MARKERS, STRUCTURAL_SUFFIXES
from labelsieve.functions.columns import col, present

DIGIT = r"(?U)\d"
LATIN_LETTER = "[A-Za-z]"
PUNCTUATION = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]"


def text_length(text: Column) -> Column:
    return F.length(text).cast("double")


def class_ratio(text: Column, pattern: str) -> Column:
    """Share of characters matching ``pattern``; 0 for the empty string."""
    length = F.length(text)
    hits = F.regexp_count(text, F.lit(pattern))
    return F.when(length > 0, hits / length).otherwise(F.lit(0.0))


def shannon_entropy(text: Column) -> Column:
    """Bits per character, from the counts of the distinct characters.

    Each distinct character is removed in turn from what is left of the text,
    and counted by the loss of length; frequent characters tend to come first,
    so little is left soon. A removal is counted at the next step, where the
    shortened text is at hand.
    """
    size = F.length(text).cast("double")

    def counted(state):
        n = state["before"] - F.length(state["rest"])
        return state["sum"] + F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def remove(state, character):
        return F.struct(
            F.replace(state["rest"], character, F.lit("")).alias("rest"),
            F.length(state["rest"]).alias("before"),
            counted(state).alias("sum"),
        )

    start = F.struct(text.alias("rest"), F.length(text).alias("before"), F.lit(0.0).alias("sum"))
    bits = F.aggregate(
        F.array_distinct(F.split(text, "")), start, remove, lambda state: F.log2(size) - counted(state) / size
    )
    return F.when(size > 0, bits).otherwise(F.lit(0.0))


def contains_any(text: Column, characters: str) -> Column:
    found = F.lit(False)
    for ch in characters:
        found = found | F.contains(text, F.lit(ch))
    return found.cast("double")


def derive(column: Column, prefix: str) -> list[Column]:
    """The thirteen structural features of one column."""
    if not prefix:
        raise ValueError("prefix must not be empty")
    text = F.coalesce(column.cast("string"), F.lit(""))
    values = [
        text_length(text),
        class_ratio(text, DIGIT),
        class_ratio(text, LATIN_LETTER),
        class_ratio(text, PUNCTUATION),
        shannon_entropy(text),
        *(contains_any(text, characters) for _, characters in INJECTION_MARKERS),
    ]
    return [
        value.alias(f"{prefix}__{suffix}") for suffix, value in zip(STRUCTURAL_SUFFIXES, values)
    ]


def derive_many(df, columns) -> list[Column]:
    return [f for name in present(df, columns) for f in derive(col(name), name)]

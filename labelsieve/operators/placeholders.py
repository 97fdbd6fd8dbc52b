"""Collapse the spellings of "absent" to one sentinel."""

from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.constants import ABSENT, IDENTIFIER_COLUMNS, PLACEHOLDERS
from labelsieve.functions.columns import col, present, strip


def check_placeholders(tokens, sentinel: str) -> None:
    if not tokens:
        raise ValueError("tokens must hold at least one placeholder spelling")
    if sentinel in tokens:
        raise ValueError(f"sentinel {sentinel!r} is itself a placeholder spelling")


def stripped(column: Column) -> Column:
    """Trimmed text; null reads as the empty string."""
    return F.coalesce(strip(column.cast("string")), F.lit(""))


def canonicalise(df: DataFrame, columns, *, tokens=PLACEHOLDERS, sentinel: str = ABSENT) -> DataFrame:
    """Replace every placeholder by the sentinel; other cells stay as they are.

    A null counts as the empty string. Where that is not a placeholder, nulls
    stay null.
    """
    check_placeholders(tokens, sentinel)
    changed = {
        name: F.when(stripped(col(name)).isin(*tokens), F.lit(sentinel)).otherwise(
            col(name).cast("string")
        )
        for name in present(df, columns)
    }
    return df.select(
        *[changed[name].alias(name) if name in changed else col(name) for name in df.columns]
    )


def canonicalise_report(df: DataFrame, columns, *, tokens=PLACEHOLDERS, sentinel: str = ABSENT) -> DataFrame:
    """Cells rewritten per column, and the distinct spellings collapsed.

    One aggregate over all columns without a key, so nothing is shuffled but
    one record per task. A spelling set holds placeholders only: it is never
    longer than ``tokens``.
    """
    check_placeholders(tokens, sentinel)
    names = present(df, columns)
    if not names:
        raise ValueError("none of the columns to canonicalise is present")
    texts = df.select(*[stripped(col(name)).alias(f"t{i}") for i, name in enumerate(names)])
    hits = texts.select(*[F.when(F.col(t).isin(*tokens), F.col(t)).alias(t) for t in texts.columns])
    cells = []
    for i in range(len(names)):
        cells += [F.count(f"t{i}").alias(f"n{i}"), F.collect_set(f"t{i}").alias(f"s{i}")]
    entries = [
        F.struct(
            F.lit(name).alias("column"),
            F.col(f"n{i}").alias("replacements"),
            F.sort_array(F.col(f"s{i}")).alias("spellings"),
        )
        for i, name in enumerate(names)
    ]
    report = hits.agg(*cells).select(F.inline(F.array(*entries)))
    return report.withColumns(
        {
            "affected": F.col("replacements") > 0,
            "ambiguous": F.size("spellings") > 1,
        }
    )


def standardise_capture(df: DataFrame) -> DataFrame:
    """Drop identifiers, then canonicalise every remaining column."""
    kept = df.drop(*IDENTIFIER_COLUMNS)
    return canonicalise(kept, kept.columns)

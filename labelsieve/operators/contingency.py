"""Token-by-label counts, and every statistic that follows from them.

All audited columns are unpivoted into one aggregate keyed on (column, token).
Tokens are counted before the shuffle, so a placeholder covering most rows is
one record per task. Each statistic is then a second, small aggregate.
"""

from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.constants import FLOAT_ZERO, MISSING_TOKEN, STRING_ZERO
from labelsieve.functions.columns import binary_label, col, present, quoted, strip, token, xlogx
from labelsieve.storage import materialise


def check_binary_label(df: DataFrame, label: str) -> None:
    """Raise unless every value of ``label`` is numeric and 0 or 1."""
    if label not in df.columns:
        raise KeyError(f"label column {label!r} is missing")
    bad = df.agg(F.count_if(binary_label(col(label)).isNull()).alias("n")).first().n
    if bad:
        raise ValueError(f"label column {label!r} holds {bad} values that are not 0 or 1")


def checked_label(label: str) -> Column:
    """The label as 0 or 1; a row with any other value ends the query with an error."""
    message = F.concat(
        F.lit(f"label column {label!r} holds a value that is not 0 or 1: "),
        F.coalesce(col(label).cast("string"), F.lit("null")),
    )
    return F.coalesce(binary_label(col(label)), F.raise_error(message).cast("int"))


def unpivot_tokens(df: DataFrame, columns, keep=(), render=token) -> DataFrame:
    """Long (column, token) rows of ``columns`` beside the ``keep`` expressions."""
    tokens = [render(col(name)).alias(name) for name in columns]
    kept = [c.alias(alias) for alias, c in keep]
    return df.select(*kept, *tokens).unpivot(
        [alias for alias, _ in keep], [quoted(name) for name in columns], "column", "token"
    )


def contingency(
    df: DataFrame, columns, label: str, *, test: Column = None, missing: str = MISSING_TOKEN
) -> DataFrame:
    """Rows per (column, token) and label: ``n0``, ``n1``.

    With ``test``, a boolean saying whether a row is held out, the held-out
    part is counted too: ``test0``, ``test1``. A label other than 0 or 1 is an
    error, raised by the scan itself.
    """
    keep = [("y", checked_label(label))]
    if test is not None:
        keep.append(("held_out", test))
    long = unpivot_tokens(df, columns, keep, lambda c: token(c, missing))
    counts = [F.count_if(F.col("y") == v).alias(f"n{v}") for v in (0, 1)]
    if test is not None:
        counts += [
            F.count_if((F.col("y") == v) & F.col("held_out")).alias(f"test{v}") for v in (0, 1)
        ]
    return long.groupBy("column", "token").agg(*counts)


def purity_aggregates() -> list[Column]:
    n0, n1 = F.col("n0"), F.col("n1")
    separated = F.when(n1 == 0, n0).when(n0 == 0, n1).otherwise(0)
    return [
        F.sum(n0 + n1).alias("n_rows"),
        F.count("*").alias("n_tokens"),
        F.count_if((n1 == 0) & (n0 > 0)).alias("pure_normal_tokens"),
        F.count_if((n0 == 0) & (n1 > 0)).alias("pure_attack_tokens"),
        F.sum(separated).alias("rows_separated"),
    ]


def with_separation(report: DataFrame) -> DataFrame:
    rows, separated = F.col("n_rows"), F.col("rows_separated")
    rate = F.when(rows > 0, separated / rows).otherwise(F.lit(0.0))
    return report.withColumns(
        {
            "separation_rate": rate,
            "is_fully_separating": (rows > 0) & (separated == rows),
        }
    )


def token_purity(counts: DataFrame) -> DataFrame:
    """Separation statistics per column."""
    return with_separation(counts.groupBy("column").agg(*purity_aggregates()))


def leaking_columns(report: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Columns whose separation rate reaches ``threshold``."""
    if not 0.0 < threshold <= 1.0:
        raise ValueError(f"threshold must be in (0, 1]; got {threshold}")
    return report.where(F.col("separation_rate") >= threshold).select("column", "separation_rate")


def zero_aggregates() -> list[Column]:
    return [
        F.sum(F.when(F.col("token") == spelling, F.col(f"n{v}")).otherwise(0)).alias(
            f"{name}_{label}"
        )
        for name, spelling in (("string_zero", STRING_ZERO), ("float_zero", FLOAT_ZERO))
        for v, label in ((0, "normal"), (1, "attack"))
    ]


def with_zero_verdict(report: DataFrame) -> DataFrame:
    """Marker flag and coverage; null where only one spelling occurs."""
    cells = ["string_zero_normal", "string_zero_attack", "float_zero_normal", "float_zero_attack"]
    sn, sa, fn, fa = (F.col(c) for c in cells)
    testable = (sn + sa > 0) & (fn + fa > 0)
    pure = ((sn == 0) != (sa == 0)) & ((fn == 0) != (fa == 0))
    return report.withColumns(
        {
            "is_provenance_marker": F.when(testable, pure),
            "rows_covered": F.when(testable, sn + sa + fn + fa),
        }
    )


def zero_spelling(counts: DataFrame) -> DataFrame:
    """Labels under the two spellings of zero, for columns holding both."""
    zeros = counts.where(F.col("token").isin(STRING_ZERO, FLOAT_ZERO))
    report = with_zero_verdict(zeros.groupBy("column").agg(*zero_aggregates()))
    return report.where(F.col("rows_covered").isNotNull())


def information_aggregates() -> list[Column]:
    n0, n1 = F.col("n0"), F.col("n1")
    return [
        F.sum(n0).alias("normal_"),
        F.sum(n1).alias("attack_"),
        F.sum(xlogx(n0) + xlogx(n1)).alias("cells_"),
        F.sum(xlogx(n0 + n1)).alias("tokens_"),
        F.count("*").alias("levels_"),
    ]


def normalised_information() -> Column:
    """Mutual information over the mean of both entropies, natural logarithm."""
    n0, n1 = F.col("normal_"), F.col("attack_")
    n = n0 + n1
    labels = xlogx(n0) + xlogx(n1)
    total = xlogx(n)
    information = (F.col("cells_") - F.col("tokens_") - labels + total) / n
    entropies = (2 * total - F.col("tokens_") - labels) / n
    single = (F.col("levels_") <= 1) & ((n0 == 0) | (n1 == 0))
    score = F.when(information <= 2.220446049250313e-16, 0.0).otherwise(
        information / (entropies / 2)
    )
    return F.when(single, 1.0).otherwise(score)


def nmi(counts: DataFrame) -> DataFrame:
    """Normalised mutual information of each column with the label."""
    sums = counts.groupBy("column").agg(*information_aggregates())
    return sums.select("column", normalised_information().alias("nmi_with_label"))


def separation_any_label(df: DataFrame, columns, label: str, threshold: float = 0.999) -> DataFrame:
    """Separation rate where the label is any text; values are trimmed first.

    A token is pure when its smallest and largest label agree, which needs no
    set of labels per token. Null counts as the empty string.
    """
    keep = [("label", strip(token(col(label), "")))]
    long = unpivot_tokens(df, present(df, columns), keep, lambda c: strip(token(c, "")))
    tokens = long.groupBy("column", "token").agg(
        F.count("*").alias("n"), (F.min("label") == F.max("label")).alias("pure")
    )
    rates = tokens.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("pure"), F.col("n")).otherwise(0)).alias("rows_separated"),
    )
    rate = F.col("rows_separated") / F.col("n_rows")
    return rates.withColumns({"separation_rate": rate, "fully_separates": rate > threshold})


def placeholder_label_distribution(df: DataFrame, columns, label: str) -> DataFrame:
    """Rows per label under each zero spelling, and whether it has one label."""
    keep = [("label", strip(token(col(label), "")))]
    long = unpivot_tokens(df, present(df, columns), keep, lambda c: strip(token(c, "")))
    zeros = long.where(F.col("token").isin(STRING_ZERO, FLOAT_ZERO))
    counts = materialise(zeros.groupBy("column", "token", "label").agg(F.count("*").alias("n")), "zeros")
    labels = counts.groupBy("column", "token").agg((F.count("*") == 1).alias("single_label"))
    return counts.join(labels, ["column", "token"])

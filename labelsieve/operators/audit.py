"""The leakage audit: how much of the label one column gives away.

One scan counts tokens by label and by split side; purity, mutual information,
the zero-spelling probe and held-out accuracy all come from those counts.
"""

from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.constants import RANDOM_SEED, TEST_SIZE
from labelsieve.functions.columns import present
from labelsieve.operators.contingency import (
    check_binary_label,
    contingency,
    information_aggregates,
    normalised_information,
    purity_aggregates,
    with_separation,
    with_zero_verdict,
    zero_aggregates,
)
from labelsieve.operators.splits import hold_out

REPORT = [
    "position", "column", "n_rows", "n_tokens", "pure_normal_tokens", "pure_attack_tokens",
    "rows_separated", "separation_rate", "is_fully_separating", "single_column_accuracy",
    "nmi_with_label", "string_zero_normal", "string_zero_attack", "float_zero_normal",
    "float_zero_attack", "is_provenance_marker", "rows_covered",
]


def accuracy_aggregates() -> list[Column]:
    """Sums behind the held-out accuracy of a tree on one one-hot column.

    Such a tree, grown to full depth, answers a token with its majority label
    in the training part, 0 on a tie. A token first seen in the held-out part
    gets the majority label of the whole training part.
    """
    test0, test1 = F.col("test0"), F.col("test1")
    train0, train1 = F.col("n0") - test0, F.col("n1") - test1
    seen = train0 + train1 > 0
    return [
        F.sum(F.when(seen, F.when(train1 > train0, test1).otherwise(test0)).otherwise(0)).alias("hits_"),
        F.sum(F.when(seen, 0).otherwise(test0)).alias("new0_"),
        F.sum(F.when(seen, 0).otherwise(test1)).alias("new1_"),
        F.sum(train0).alias("train0_"),
        F.sum(train1).alias("train1_"),
        F.sum(test0 + test1).alias("tested_"),
        (F.sum(F.col("n0")) * F.sum(F.col("n1")) > 0).alias("two_classes_"),
    ]


def held_out_accuracy() -> Column:
    """Share of held-out rows answered rightly; null for a single class."""
    new = F.when(F.col("train1_") > F.col("train0_"), F.col("new1_")).otherwise(F.col("new0_"))
    return F.when(F.col("two_classes_") & (F.col("tested_") > 0), (F.col("hits_") + new) / F.col("tested_"))


def split_contingency(df, columns, label, key, *, test_size=TEST_SIZE, seed=RANDOM_SEED, missing="<NA>"):
    """Contingency counts with the held-out side of a stratified split.

    Counting classes for the split also finds labels other than 0 and 1, which
    are an error.
    """
    split = hold_out(df, "held_out_", key, label, test_size=test_size, seed=seed)
    return contingency(split, columns, label, test=F.col("held_out_"), missing=missing)


def single_column_accuracy(df, columns, label, key, *, test_size=TEST_SIZE, seed=RANDOM_SEED) -> DataFrame:
    columns = present(df, columns)
    counts = split_contingency(df, columns, label, key, test_size=test_size, seed=seed)
    sums = counts.groupBy("column").agg(*accuracy_aggregates())
    return sums.select("column", held_out_accuracy().alias("single_column_accuracy"))


def audit_columns(
    df: DataFrame, columns, label: str, key=None, *, test_size: float = TEST_SIZE, seed=RANDOM_SEED
) -> DataFrame:
    """One report row per column, numbered in the order given.

    Columns the frame lacks are skipped. ``key`` names the column (or columns)
    that identify a row; without it the held-out accuracy is null.
    """
    columns = present(df, columns)
    if not columns:
        raise ValueError("none of the columns to audit is present")
    if label not in df.columns:
        raise KeyError(f"label column {label!r} is missing")
    if key is None:
        check_binary_label(df, label)
        counts = contingency(df, columns, label)
        extra = []
        accuracy = F.lit(None).cast("double")
    else:
        counts = split_contingency(df, columns, label, key, test_size=test_size, seed=seed)
        extra = accuracy_aggregates()
        accuracy = held_out_accuracy()
    report = counts.groupBy("column").agg(
        *purity_aggregates(), *information_aggregates(), *zero_aggregates(), *extra
    )
    report = with_zero_verdict(with_separation(report)).withColumns(
        {
            "single_column_accuracy": accuracy,
            "nmi_with_label": normalised_information(),
            "position": F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")),
        }
    )
    return report.select(*REPORT)


def audit_column(df: DataFrame, column: str, label: str, key=None, **options) -> DataFrame:
    """The report of one column, which must exist."""
    if column not in df.columns:
        raise KeyError(f"column {column!r} is missing")
    return audit_columns(df, [column], label, key, **options)


def audit_summary(report: DataFrame) -> DataFrame:
    """The nine headline columns, most severe first."""
    return report.select(
        "column",
        F.col("n_tokens").alias("tokens"),
        "pure_normal_tokens",
        "pure_attack_tokens",
        "rows_separated",
        "separation_rate",
        "single_column_accuracy",
        "nmi_with_label",
        F.coalesce("is_provenance_marker", F.lit(False)).alias("provenance_marker"),
    ).orderBy(F.desc("separation_rate"), F.desc_nulls_last("single_column_accuracy"))

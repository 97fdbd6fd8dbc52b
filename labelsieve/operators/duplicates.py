"""Duplicate statistics and removal; nulls equal nulls."""

from pyspark.sql import DataFrame, functions as F

from labelsieve.functions.columns import col
from labelsieve.functions.hashing import fingerprint


def duplicate_statistics(df: DataFrame, label_columns) -> DataFrame:
    """One row: exact, feature-only and contradictory duplicates, with rates.

    Rows are compared by SHA-256 of their values, so the shuffle carries two
    digests a row however wide the rows are, after equal rows of a task have
    been counted together.
    """
    kinds = dict(df.dtypes)
    features = [name for name in df.columns if name not in label_columns]
    labels = [name for name in df.columns if name in label_columns]
    if not features:
        raise ValueError("the frame has no feature columns")
    digests = [fingerprint([(name, kinds[name]) for name in features]).alias("f")]
    label_digest = fingerprint([(name, kinds[name]) for name in labels]) if labels else F.lit("")
    rows = df.select(*digests, label_digest.alias("l"))
    distinct_rows = rows.groupBy("f", "l").agg(F.count("*").alias("n"))
    distinct_features = distinct_rows.groupBy("f").agg(
        F.sum("n").alias("n"), F.count("*").alias("labelled")
    )
    n = F.coalesce(F.sum("n"), F.lit(0))
    exact = n - F.coalesce(F.sum("labelled"), F.lit(0))
    feature = n - F.count("*")

    def rate(count):
        return F.when(n > 0, count / n).otherwise(F.lit(0.0))

    return distinct_features.agg(
        n.alias("n_rows"),
        exact.alias("exact_duplicate_rows"),
        rate(exact).alias("exact_duplicate_rate"),
        feature.alias("feature_duplicate_rows"),
        rate(feature).alias("feature_duplicate_rate"),
        (feature - exact).alias("contradictory_duplicate_rows"),
    )


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Rows without any null."""
    filled = F.lit(True)
    for name in df.columns:
        filled = filled & col(name).isNotNull()
    return df.where(filled)


def occurrence_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """Add a unique key to rows that have none: their digest and a number among equal rows.

    Equal rows are counted, before the shuffle too, and spread out again, so a row
    that repeats a million times is no single task's work. The key depends on
    the rows only, not on files or partitions.
    """
    counted = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("copies_"))
    numbered = counted.select(
        *[col(c) for c in df.columns], F.explode(F.sequence(F.lit(1), F.col("copies_"))).alias("copy_")
    )
    key = F.concat_ws(":", fingerprint(df.dtypes), F.col("copy_").cast("string"))
    return numbered.withColumn(name, key).drop("copy_")


def deduplicate(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows; copies are merged before the shuffle."""
    return df.dropDuplicates()

"""Column profiles: which columns are numbers, which have few values."""

import math

from pyspark.sql import DataFrame, functions as F

from labelsieve.constants import MAX_ONEHOT_CARDINALITY
from labelsieve.functions.columns import col, numeric, present
from labelsieve.operators.contingency import unpivot_tokens

def parse_rates(df: DataFrame, columns) -> dict[str, float]:
    """Share of each column that parses as a number, in one aggregate."""
    columns = list(columns)
    if not columns:
        return {}
    row = df.agg(
        F.count("*").alias("n"),
        *[F.count(numeric(col(name))).alias(f"p{i}") for i, name in enumerate(columns)],
    ).first()
    return {name: (row[f"p{i}"] / row.n if row.n else 0.0) for i, name in enumerate(columns)}


def column_profile(df: DataFrame, columns) -> DataFrame:
    """Exact parse rate and distinct count (null included) per column."""
    keep = [("one", F.lit(1))]
    long = unpivot_tokens(df, present(df, columns), keep, lambda c: c.cast("string"))
    tokens = long.groupBy("column", "token").agg(F.count("*").alias("n"))
    return tokens.groupBy("column").agg(
        (F.sum(F.when(numeric(F.col("token")).isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias(
            "parse_rate"
        ),
        F.count("*").alias("n_distinct"),
    )


def low_cardinality_levels(df: DataFrame, columns, limit: int = MAX_ONEHOT_CARDINALITY) -> dict[str, list]:
    """Sorted values (null as None) of the columns with at most ``limit`` of them.

    A sketch first rules out wide columns without a shuffle. ``k`` values
    touch at most ``k`` of its registers, so its estimate for a column within
    the limit stays below ``ceiling``; a column above is wide for certain. The
    few left are counted exactly.
    """
    columns = list(columns)
    if not columns:
        return {}
    # The sketch does not count null, so null may add one value.
    registers = 2 ** max(9, math.ceil(math.log2(4 * limit)))
    error = 1.106 / math.sqrt(registers)
    ceiling = math.ceil(registers * math.log(registers / (registers - limit))) + 1
    sketch = df.agg(
        *[
            F.approx_count_distinct(col(name), error).alias(f"d{i}")
            for i, name in enumerate(columns)
        ]
    ).first()
    candidates = [name for i, name in enumerate(columns) if sketch[f"d{i}"] <= ceiling]
    if not candidates:
        return {}
    keep = [("one", F.lit(1))]
    long = unpivot_tokens(df, candidates, keep, lambda c: c.cast("string"))
    values = long.select("column", "token").distinct()
    rows = (
        values.groupBy("column").agg(F.count("*").alias("k")).where(F.col("k") <= limit)
        .select("column").join(values, "column").collect()
    )
    levels = {name: [] for name in candidates if any(r["column"] == name for r in rows)}
    for row in rows:
        levels[row["column"]].append(row["token"])
    return {name: sorted(found, key=lambda v: (v is None, v)) for name, found in levels.items()}

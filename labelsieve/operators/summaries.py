"""Class balance, last rows, latency, vector means and uplink budgets."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from labelsieve.constants import (
    BACKHAUL_KBPS,
    BINARY_LABEL,
    BITS_PER_PARAMETER,
    DEVICE_COLUMN,
    LAYER_COLUMN,
    MULTICLASS_LABEL,
)
from labelsieve.functions.columns import binary_label, col, token
from labelsieve.operators.ranking import running_totals
from labelsieve.storage import join_small, materialise

BALANCE_DIMENSIONS = (MULTICLASS_LABEL, DEVICE_COLUMN, LAYER_COLUMN)


def class_balance(df: DataFrame, label: str = BINARY_LABEL, dimensions=BALANCE_DIMENSIONS) -> DataFrame:
    """Normal and attack rows per value of each dimension, and over all.

    The table is aggregated once on all dimensions together; the single
    dimensions are summed from that small result.
    """
    y = binary_label(col(label))
    cube = df.groupBy(*[col(d) for d in dimensions]).agg(
        F.count_if(y == 0).alias("n_normal"), F.count_if(y == 1).alias("n_attack")
    )
    parts = [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value"))] + [
        F.struct(F.lit(d).alias("dimension"), token(col(d)).alias("value")) for d in dimensions
    ]
    return (
        cube.select(F.inline(F.array(*parts)), "n_normal", "n_attack")
        .groupBy("dimension", "value")
        .agg(F.sum("n_normal").alias("n_normal"), F.sum("n_attack").alias("n_attack"))
        .withColumns(
            {
                "n_rows": F.col("n_normal") + F.col("n_attack"),
                "attack_rate": F.col("n_attack") / (F.col("n_normal") + F.col("n_attack")),
            }
        )
        .orderBy("dimension", F.desc("n_rows"), "value")
    )


def last_per_group(df: DataFrame, group: str, order: str) -> DataFrame:
    """The row of each group with the largest ``order``, nulls last.

    One aggregate, combined before the shuffle: each task sends one row of a
    group. A tie goes to the row of the largest hash over all columns.
    """
    tie = F.xxhash64(*[col(name) for name in df.columns])
    rank = F.struct(col(order).isNotNull().alias("known"), col(order).alias("order"), tie.alias("tie"))
    row = F.struct(*[col(name).alias(name) for name in df.columns])
    return df.groupBy(col(group).alias("group_")).agg(F.max_by(row, rank).alias("row_")).select("row_.*")


def percentiles(df: DataFrame, value: str, fractions: dict, *, by) -> DataFrame:
    """Exact linearly interpolated percentiles per group.

    Equal values are counted together, then placed by running totals, so no
    group has to fit in the memory of one task.
    """
    by = list(by)
    counted = df.where(col(value).isNotNull()).groupBy(*by, col(value).alias("v")).agg(F.count("*").alias("n"))
    placed = materialise(running_totals(counted, "v", ["n"], groups=by), "placed")
    totals = placed.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = join_small(placed, totals, by)

    def at(position):
        inside = (position >= F.col("n_upto") - F.col("n")) & (position < F.col("n_upto"))
        return F.max(F.when(inside, F.col("v")))

    last = F.col("total") - 1
    cells = []
    for name, fraction in fractions.items():
        position = last * F.lit(fraction)
        low = F.floor(position)
        weight = F.max(position - low)
        lower, upper = at(low), at(F.least(low + 1, last))
        cells.append((lower + (upper - lower) * weight).alias(name))
    return joined.groupBy(*by).agg(F.max("total").alias("n"), *cells)


def latency_summary(measurements: DataFrame, *, by=("model", "batch_size"), micros="micros") -> DataFrame:
    """Median and 95th percentile latency, and rows a second; cheapest first."""
    table = percentiles(measurements, micros, {"median_latency_us": 0.5, "p95_latency_us": 0.95}, by=by)
    median = F.col("median_latency_us")
    throughput = F.when(median > 0, F.lit(1e6) * F.col("batch_size") / median)
    return table.withColumn("throughput_per_second", throughput).orderBy("median_latency_us")


def weighted_vector_mean(df: DataFrame, vector: str, weight: str, *, by=()) -> DataFrame:
    """Mean of equal-length vectors weighted by ``weight``, per group.

    Each task adds up whole vectors, so the shuffle carries one vector per
    group and task.
    """
    w = col(weight).cast("double")
    check = df.groupBy(*by).agg(F.sum(w).alias("w"), F.min(w).alias("least"))
    bad = check.where(F.col("w").isNull() | (F.col("w") <= 0) | (F.col("least") < 0)).limit(1).count()
    if bad or check.limit(1).count() == 0:
        raise ValueError("weights must not be negative and must sum to a positive value in every group")
    mean = Summarizer.mean(array_to_vector(col(vector).cast("array<double>")), w)
    return df.groupBy(*by).agg(vector_to_array(mean).alias("mean"))


def uplink_budget(payloads: DataFrame, rounds: int, *, by=(), parameters="parameters") -> DataFrame:
    """Uplink time per round and for all rounds under each backhaul profile.

    ``payloads`` has a row per client with the parameters it uploads a round.
    """
    if rounds <= 0:
        raise ValueError("rounds must be positive")
    if payloads.where(~(col(parameters) > 0) | col(parameters).isNull()).limit(1).count():
        raise ValueError("every client must upload a positive number of parameters")
    totals = payloads.groupBy(*by).agg(
        F.count("*").alias("n_clients"), (F.sum(col(parameters)) * BITS_PER_PARAMETER).alias("bits")
    )
    profiles = F.array(
        *[F.struct(F.lit(n).alias("backhaul"), F.lit(k).alias("uplink_kbps")) for n, k in BACKHAUL_KBPS.items()]
    )
    seconds = F.col("bits") / (F.col("uplink_kbps") * 1000.0)
    return totals.where(F.col("n_clients") > 0).select(*by, "n_clients", "bits", F.inline(profiles)).select(
        *by, "n_clients", "backhaul", "uplink_kbps",
        seconds.alias("seconds_per_round"), (seconds * rounds / 60.0).alias("minutes_full_training"),
    )

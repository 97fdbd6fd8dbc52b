"""Build a source-attributed benchmark from raw captures, and check it."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from labelsieve.constants import (
    ATTACK_PREFIX,
    BINARY_LABEL,
    DEVICE_COLUMN,
    LABEL_COLUMNS,
    MAX_ROWS_PER_ATTACK,
    MAX_ROWS_PER_DEVICE,
    PROVENANCE_COLUMNS,
    RANDOM_SEED,
    RECIPE_DUMMY_COLUMNS,
    SEPARATION_THRESHOLD,
    TEST_SIZE,
)
from labelsieve.functions.columns import col, present
from labelsieve.operators.audit import audit_columns, audit_summary
from labelsieve.operators.duplicates import duplicate_statistics
from labelsieve.operators.encoders import model_matrix
from labelsieve.operators.metrics import lodo_pivot
from labelsieve.operators.placeholders import standardise_capture
from labelsieve.operators.splits import capped_sample, lodo_draw, source_counts
from labelsieve.plans.evaluate import Runs, swept
from labelsieve.plans.models import MODELS
from labelsieve.sources.captures import STEM, attribute
from labelsieve.storage import materialise, scratch_path


@dataclass(frozen=True)
class BenchmarkConfig:
    """Sampling policy of the build."""

    max_rows_per_device: int = MAX_ROWS_PER_DEVICE
    max_rows_per_attack: int = MAX_ROWS_PER_ATTACK
    seed: int = RANDOM_SEED

    def __post_init__(self):
        if self.max_rows_per_device <= 0 or self.max_rows_per_attack <= 0:
            raise ValueError("row caps must be positive")


def build_benchmark(
    captures: DataFrame, dimension: DataFrame, config: BenchmarkConfig = None, *, key: str = None
) -> DataFrame:
    """Sample every capture to its cap, standardise and attribute the rows.

    ``captures`` has a ``capture`` column naming the source; rows of sources
    outside ``dimension`` are left out. A capture without rows is an error, as
    is a sample without rows.
    """
    config = config or BenchmarkConfig()
    sources = dimension.select(STEM, BINARY_LABEL).collect()
    known = captures.where(col(STEM).isin(*[row[0] for row in sources]))
    counts = materialise(source_counts(known, STEM), "counts")
    stems = [row[0] for row in sources]
    _check_filled(counts, stems, "capture is empty")
    attacks = [row[0] for row in sources if row[1] == 1]
    caps = F.when(F.col("source").isin(*attacks), config.max_rows_per_attack).otherwise(
        config.max_rows_per_device
    )
    sampled = materialise(capped_sample(known, STEM, caps, key, counts=counts, seed=config.seed), "sampled")
    _check_filled(source_counts(sampled, STEM), stems, "sampling kept no rows of")
    kept = [STEM, *([key] if key else [])]
    standard = standardise_capture(sampled.select("*", *[col(c).alias(f"{c}__kept") for c in kept]).drop(*kept))
    for name in kept:
        kind = dict(sampled.dtypes)[name]
        standard = standard.withColumn(name, col(f"{name}__kept").cast(kind)).drop(f"{name}__kept")
    return attribute(standard, dimension).drop(STEM)


def _check_filled(counts: DataFrame, stems, problem: str) -> None:
    filled = {row.source for row in counts.where(F.col("n") > 0).collect()}
    empty = sorted(set(stems) - filled)
    if empty:
        raise ValueError(f"{problem}: {empty}")


def write_benchmark(df: DataFrame, path: str) -> DataFrame:
    """Write a built benchmark in folders by device, and read it with the schema it had."""
    df.write.partitionBy(DEVICE_COLUMN).parquet(path)
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(path).select(*[col(c) for c in df.columns])


def benchmark_sweep(
    captures: DataFrame, dimension: DataFrame, devices, config: BenchmarkConfig = None, *, key: str, specs=MODELS, **options
) -> Runs:
    """From captures to scores: build, write, encode, and hold out every device in turn.

    The build is written once; the matrix of its features once more, in the layout of the sweep.
    """
    spark = captures.sparkSession
    config = config or BenchmarkConfig()
    built = write_benchmark(build_benchmark(captures, dimension, config, key=key), scratch_path(spark, "benchmark"))
    seed, fraction = options.pop("seed", RANDOM_SEED), options.get("attack_fraction", TEST_SIZE)
    seed = draw_seed(built, key, fraction, seed, config.seed)
    return swept(model_matrix(built, key=key), key, devices, specs, seed=seed, **options)


def draw_seed(built: DataFrame, key: str, attack_fraction: float, seed, sampled_by):
    """The seed of the attacks' draw for testing.

    Under one seed the sample and the draw go by the same hash. A sample of no larger share than the draw's
    would then be drawn whole, and no attack left to train on; such a draw takes a seed of its own.
    """
    if seed != sampled_by:
        return seed
    attacks = lodo_draw(built, key, attack_fraction=attack_fraction, seed=seed).where(
        col(DEVICE_COLUMN).startswith(ATTACK_PREFIX)
    )
    drawn = attacks.agg(F.min("attack_drawn").alias("all")).first()["all"]
    return f"{seed}:draw" if drawn else seed


def sweep_pivots(scores: DataFrame, devices) -> tuple[DataFrame, DataFrame]:
    """Balanced accuracy by held-out device with mean and worst, and macro-F1 with the mean."""
    splits = [f"lodo_{device}" for device in devices]
    return lodo_pivot(scores, splits), lodo_pivot(scores, splits, "f1_macro", worst=False)


def recheck_benchmark(df: DataFrame, key=None, columns=RECIPE_DUMMY_COLUMNS) -> DataFrame:
    """Audit of the built table with the verdict and its duplicate rate per row."""
    audited = audit_summary(audit_columns(df, present(df, columns), BINARY_LABEL, key))
    bare = df.drop(*PROVENANCE_COLUMNS, *([key] if key else []))
    duplicates = duplicate_statistics(bare, LABEL_COLUMNS).select("exact_duplicate_rows", "exact_duplicate_rate").first()
    return audited.withColumns(
        {
            "fully_separating": F.col("separation_rate") >= SEPARATION_THRESHOLD,
            "exact_duplicate_rows": F.lit(duplicates[0]),
            "exact_duplicate_rate": F.lit(duplicates[1]),
        }
    )


def acceptance_status(recheck: DataFrame) -> int:
    """0 when no column separates the labels, else 2."""
    return 2 if recheck.where("fully_separating").limit(1).count() else 0

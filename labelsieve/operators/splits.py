"""Samples and splits by seeded hash of the row key.

Exact sizes come from hash cuts, so a split is a filter on the scan: the rows
themselves are neither sorted nor shuffled.
"""

from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.constants import ATTACK_PREFIX, DEVICE_COLUMN, RANDOM_SEED, TEST_SIZE
from labelsieve.functions.columns import binary_label, col
from labelsieve.functions.hashing import hash_unit
from labelsieve.operators.ranking import hash_cuts, repeated_hash_cuts
from labelsieve.storage import join_small, materialise

TRAIN, TEST = "train", "test"


def source_counts(df: DataFrame, source: str) -> DataFrame:
    """Records per source."""
    return df.groupBy(col(source).alias("source")).agg(F.count("*").alias("n"))


def capped_sample(
    df: DataFrame, source: str, caps: Column, key=None, *, counts: DataFrame = None, seed=RANDOM_SEED
) -> DataFrame:
    """Keep about ``caps`` rows of each source, each row with equal probability.

    ``caps`` is an expression over the ``source`` column; a null cap, also that
    of a null source, keeps all. Sources within their cap are kept whole. With ``key`` a row's fate hangs on its key; without,
    on a seeded generator, which repeats for the same file splits. ``counts``
    are the source counts, if known already.
    """
    if counts is None:
        counts = materialise(source_counts(df, source), "counts")
    rates = counts.select("source", F.coalesce(F.least(F.lit(1.0), caps / F.col("n")), F.lit(1.0)).alias("rate_"))
    draw = F.rand(int(seed)) if key is None else hash_unit(key, seed)
    drawn = df.withColumns({"draw_": draw, "source_": col(source)})
    same = F.col("source_").eqNullSafe(F.col("of_"))
    kept = join_small(drawn, rates.withColumnRenamed("source", "of_"), same)
    # The default keeps the planner from testing the draw for null, and hashing twice.
    chosen = F.coalesce(F.col("draw_") < F.col("rate_"), F.lit(False))
    return kept.where(chosen).drop("draw_", "rate_", "source_", "of_")


def subsample(df: DataFrame, n: int, key, *, seed=RANDOM_SEED) -> DataFrame:
    """Exactly ``n`` rows, or all of them when there are no more."""
    if n <= 0:
        raise ValueError(f"n must be positive; got {n}")
    cuts = hash_cuts(df, key, lambda size: F.array(F.least(size, F.lit(n))), seed=seed)
    return cuts.attach(df, "chunk_").where(F.col("chunk_") == 0).drop("chunk_")


def hold_out(df: DataFrame, name: str, key, label: str, *, test_size=TEST_SIZE, seed=RANDOM_SEED) -> DataFrame:
    """Add a boolean: held out are round(size * test_size) rows of each class."""
    if not 0.0 < test_size < 1.0:
        raise ValueError(f"test_size must be in (0, 1); got {test_size}")
    cuts = hash_cuts(
        df, key, lambda size: F.array(F.round(size * F.lit(test_size))),
        seed=seed, stratum=binary_label(col(label)),
    )
    if None in cuts.hashes:
        raise ValueError(f"label column {label!r} holds values that are not 0 or 1")
    return cuts.attach(df, name).withColumn(name, F.col(name) == 0)


def stratified_split(df: DataFrame, key, label: str, *, test_size=TEST_SIZE, seed=RANDOM_SEED) -> DataFrame:
    """Add ``split``: ``test`` for the held-out rows of each class, else ``train``."""
    split = hold_out(df, "split", key, label, test_size=test_size, seed=seed)
    return split.withColumn("split", F.when(F.col("split"), TEST).otherwise(TRAIN))


def kfold_assign(
    df: DataFrame, key, label: str, *, n_splits: int = 5, n_repeats: int = 3, seed=RANDOM_SEED
) -> DataFrame:
    """Add ``fold_0``, ``fold_1``, …: the fold of a row in each repeat.

    In each repeat the rows of a class are ordered afresh and cut into
    ``n_splits`` parts whose sizes differ by at most one.
    """
    if n_splits < 2 or n_repeats < 1:
        raise ValueError("n_splits must be at least 2 and n_repeats at least 1")
    stratum = binary_label(col(label))
    sizes = df.groupBy(stratum.alias("s")).count().collect()
    if any(row.s is None for row in sizes):
        raise ValueError(f"label column {label!r} holds values that are not 0 or 1")
    smallest = min((row["count"] for row in sizes), default=0)
    if smallest < n_splits:
        raise ValueError(f"the smallest class has {smallest} rows, fewer than {n_splits} folds")
    seeds = [f"{seed}:{repeat}" for repeat in range(n_repeats)]
    cuts = repeated_hash_cuts(df, key, part_ends(n_splits), seeds=seeds, stratum=stratum)
    for repeat, one in enumerate(cuts):
        df = one.attach(df, f"fold_{repeat}")
    return df


def part_ends(parts: int):
    """Last rank of each of ``parts`` near-equal parts but the last.

    The first (size mod parts) parts get one row more.
    """

    def ranks(size: Column) -> Column:
        base, longer = F.floor(size / F.lit(parts)), size % F.lit(parts)
        return F.array(*[base * (i + 1) + F.least(longer, F.lit(i + 1)) for i in range(parts - 1)])

    return ranks


def holdout_side(holdout: Column, device: Column, draw: Column, attack_fraction: float) -> Column:
    attack_test = device.startswith(ATTACK_PREFIX) & (draw < F.lit(attack_fraction))
    return F.when((device == holdout) | attack_test, TEST).otherwise(TRAIN)


def lodo_split(
    df: DataFrame, holdout: str, key, label: str, *, device=DEVICE_COLUMN, attack_fraction=TEST_SIZE, seed=RANDOM_SEED
) -> DataFrame:
    """Hold out one device: its rows and a fixed draw of the attacks are tested."""
    side = holdout_side(F.lit(holdout), col(device), hash_unit(key, seed), attack_fraction)
    split = df.withColumn("split", side)
    classes = F.count_distinct(binary_label(col(label)))
    found = {r.split: r.k for r in split.groupBy("split").agg(classes.alias("k")).collect()}
    if not df.where(col(device) == holdout).limit(1).count():
        raise ValueError(f"device {holdout!r} is absent")
    if found.get(TRAIN, 0) < 2 or found.get(TEST, 0) < 2:
        raise ValueError(f"holding out {holdout!r} leaves a single-class side: {found}")
    return split


def lodo_draw(
    df: DataFrame, key, *, device=DEVICE_COLUMN, attack_fraction=TEST_SIZE, seed=RANDOM_SEED
) -> DataFrame:
    """Add ``attack_drawn``: whether an attack row is tested under every held-out device.

    With the device it tells the side of a row whichever device is held out: tested
    are the rows of that device and the drawn attacks. One row stays one row.
    """
    attack = F.coalesce(col(device).startswith(ATTACK_PREFIX), F.lit(False))
    return df.withColumn("attack_drawn", attack & (hash_unit(key, seed) < F.lit(attack_fraction)))

"""Encoders of a categorical column, and the encoding of a whole table."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.constants import (
    LABEL_COLUMNS,
    MAX_ONEHOT_CARDINALITY,
    NUMERIC_PARSE_RATE,
    PROVENANCE_COLUMNS,
    RANDOM_SEED,
    TEST_SIZE,
)
from labelsieve.functions.columns import col, numeric_or_zero, present, token
from labelsieve.functions.text import derive_many
from labelsieve.operators.audit import accuracy_aggregates, held_out_accuracy, split_contingency
from labelsieve.operators.profile import low_cardinality_levels, parse_rates
from labelsieve.operators.ranking import running_totals
from labelsieve.storage import join_lookup, materialise

NULL_TEXT = "nan"


def feature_columns(df: DataFrame, extra=()) -> list[str]:
    """All columns but labels, provenance and ``extra`` ones such as the key."""
    excluded = {*LABEL_COLUMNS, *PROVENANCE_COLUMNS, *extra}
    return [name for name in df.columns if name not in excluded]


def onehot(name: str, levels) -> list[Column]:
    """A 0/1 column ``name_value`` per value; null is zero in all of them."""
    return [
        F.coalesce((col(name).cast("string") == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{name}_{v}")
        for v in levels
        if v is not None
    ]


def distinct_names(names) -> list[str]:
    """The names, with ``~2``, ``~3`` … after those that Spark would take for an earlier one.

    Column names are compared without case, so ``GET`` and ``get`` would be one; so would
    token ``b_c`` of column ``a`` and token ``c`` of column ``a_b``.
    """
    taken, out = set(), []
    for name in names:
        number, chosen = 1, name
        while chosen.lower() in taken:
            number += 1
            chosen = f"{name}~{number}"
        taken.add(chosen.lower())
        out.append(chosen)
    return out


def tokens_of(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("token_", token(col(column), NULL_TEXT))


def _attach(df: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Look a code up by token; ``table`` has token_, weight_ and the code."""
    return join_lookup(df, table.select("token_", "weight_", F.col(name).cast("double")), "token_", "weight_")


def encode_label(df: DataFrame, column: str, key: str) -> DataFrame:
    """Add ``code``: tokens numbered from 0 in order of their smallest key."""
    rows = tokens_of(df, column)
    table = rows.groupBy("token_").agg(F.count("*").alias("weight_"), F.min(col(key)).alias("first_"), F.lit(1).alias("one"))
    ranked = running_totals(table, "first_", ["one"])
    codes = ranked.withColumn("code", F.col("one_upto") - 1)
    return _attach(rows, codes, "code").drop("token_")


def encode_ordinal(df: DataFrame, column: str) -> DataFrame:
    """Add ``ordinal``: rank of the token in code-point order, from 0."""
    return attach_ordinal(df, column, ordinal_codes(df, column))


def ordinal_codes(df: DataFrame, column: str) -> DataFrame:
    """``token_``, ``weight_`` (its rows) and ``ordinal`` of each token."""
    table = tokens_of(df, column).groupBy("token_").agg(F.count("*").alias("weight_"), F.lit(1).alias("one"))
    ranked = running_totals(table, "token_", ["one"])
    return ranked.select("token_", "weight_", (F.col("one_upto") - 1).alias("ordinal"))


def attach_ordinal(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    return _attach(tokens_of(df, column), codes, "ordinal").drop("token_")


def encode_frequency(df: DataFrame, column: str) -> DataFrame:
    """Add ``frequency``: the share of rows holding the token."""
    rows = tokens_of(df, column)
    table = materialise(rows.groupBy("token_").agg(F.count("*").alias("weight_")), "tokens")
    total = table.agg(F.sum("weight_").alias("n")).first().n or 1
    shares = table.withColumn("frequency", F.col("weight_") / F.lit(total))
    return _attach(rows, shares, "frequency").drop("token_")


ENCODERS = ("onehot", "label", "ordinal", "frequency")


def encoding_agnostic(df: DataFrame, columns, label: str, key, *, test_size=TEST_SIZE, seed=RANDOM_SEED) -> DataFrame:
    """Held-out single-column accuracy of a full-depth tree under each of four encodings.

    A token of the training part is answered alike under one-hot, label and ordinal codes. A token
    first seen in the held-out part has no one-hot column, so the whole training part answers;
    under a code it falls between the trained codes around it. Label codes number tokens by their
    smallest key, ordinal codes by code-point order. Frequency codes merge tokens of
    equal count: their counts are added before the majority is taken.
    """
    columns = present(df, columns)
    counts = materialise(
        split_contingency(df, columns, label, key, test_size=test_size, seed=seed, missing=NULL_TEXT), "tokens"
    )
    merged = counts.groupBy("column", (F.col("n0") + F.col("n1")).alias("count_")).agg(
        *[F.sum(c).alias(c) for c in ("n0", "n1", "test0", "test1")]
    )
    keys = [key] if isinstance(key, str) else list(key)
    long = df.select(
        F.struct(*[col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("key_"),
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), token(col(c), NULL_TEXT).alias("token")) for c in columns
        ])),
    )
    firsts = long.groupBy("column", "token").agg(F.min("key_").alias("first_"))

    def accuracy(table, name):
        sums = table.groupBy("column").agg(*accuracy_aggregates())
        return sums.select("column", held_out_accuracy().alias(name))

    scores = accuracy(counts, "onehot").join(accuracy(merged, "frequency"), "column")
    scores = scores.join(neighbour_accuracy(counts.join(firsts, ["column", "token"]), "first_", "label"), "column")
    scores = scores.join(neighbour_accuracy(counts, "token", "ordinal"), "column")
    return scores.select("column", *ENCODERS, F.least(*ENCODERS).alias("minimum"))


def neighbour_accuracy(counts: DataFrame, order: str, name: str) -> DataFrame:
    """Held-out accuracy per column of a full-depth tree on the codes of tokens in an order.

    The tree parts two trained codes halfway. A code that was not trained on is answered as the
    nearer trained one is, the lower on a tie; beyond the last as the last. The trained codes
    around it are looked up by how many trained tokens come before it.
    """
    train0, train1 = F.col("n0") - F.col("test0"), F.col("n1") - F.col("test1")
    marked = counts.withColumns(
        {"one": F.lit(1), "known": (train0 + train1 > 0).cast("int"), "attack": train1 > train0}
    )
    ranked = materialise(running_totals(marked, order, ["one", "known"], groups=["column"]), "codes")
    trained = ranked.where("known = 1").select(
        "column", F.col("known_upto").alias("place"), F.col("one_upto").alias("code"), "attack"
    )
    unseen = ranked.where("known = 0 AND test0 + test1 > 0").select(
        "column", "one_upto", "known_upto", (F.col("known_upto") + 1).alias("next"), "test0", "test1"
    )
    below = trained.selectExpr("column", "place AS known_upto", "code AS low", "attack AS low_attack")
    above = trained.selectExpr("column", "place AS next", "code AS high", "attack AS high_attack")
    nearer = F.col("high").isNull() | (F.col("one_upto") - F.col("low") <= F.col("high") - F.col("one_upto"))
    answer = F.when(F.col("low").isNotNull() & nearer, F.col("low_attack")).otherwise(F.col("high_attack"))
    new = unseen.join(below, ["column", "known_upto"], "left").join(above, ["column", "next"], "left")
    new_hits = new.groupBy("column").agg(F.sum(F.when(answer, F.col("test1")).otherwise(F.col("test0"))).alias("more_"))
    sums = counts.groupBy("column").agg(*accuracy_aggregates()).join(new_hits, "column", "left")
    hits = F.col("hits_") + F.coalesce("more_", F.lit(0))
    return sums.select(
        "column", F.when(F.col("two_classes_") & (F.col("tested_") > 0), hits / F.col("tested_")).alias(name)
    )


@dataclass(frozen=True)
class Encoding:
    """How each column of a table becomes features, in output order."""

    numeric: list = field(default_factory=list)
    levels: dict = field(default_factory=dict)
    structural: list = field(default_factory=list)

    def features(self, df: DataFrame) -> list[Column]:
        numbers = [numeric_or_zero(col(name)).alias(name) for name in self.numeric]
        dummies = [c for name, values in self.levels.items() for c in onehot(name, values)]
        names = [*self.numeric, *[f"{c}_{v}" for c, values in self.levels.items() for v in values if v is not None]]
        apart = distinct_names(names)
        columns = [c.alias(n) for c, n in zip(numbers + dummies, apart, strict=True)]
        return columns + derive_many(df, self.structural)

    def slots(self) -> list[tuple]:
        """(feature, column, token) of each number and one-hot column, in output order; no token for a number."""
        pairs = [(name, None) for name in self.numeric]
        pairs += [(c, v) for c, values in self.levels.items() for v in values if v is not None]
        names = distinct_names([c if v is None else f"{c}_{v}" for c, v in pairs])
        return [(name, *pair) for name, pair in zip(names, pairs, strict=True)]

    def apply(self, df: DataFrame, keep) -> DataFrame:
        features = self.features(df)
        if not features:
            raise ValueError("the encoding leaves no feature")
        return df.select(*[col(name) for name in keep], *features)


def categorical_encoding(df: DataFrame, columns, limit: int = MAX_ONEHOT_CARDINALITY) -> tuple[dict, list]:
    """One-hot levels of narrow columns, and the names of wide ones."""
    if limit <= 0:
        raise ValueError("the one-hot limit must be positive")
    levels = low_cardinality_levels(df, columns, limit)
    narrow = {name: levels[name] for name in columns if name in levels}
    return narrow, [name for name in columns if name not in levels]


def model_matrix(df: DataFrame, *, key: str = None, max_onehot_cardinality: int = MAX_ONEHOT_CARDINALITY) -> DataFrame:
    """Encode a benchmark table; labels, device and key stay beside the features.

    A column is numeric when at least 99% of it parses. Other columns are
    one-hot encoded up to ``max_onehot_cardinality`` values and replaced by
    structural features beyond.
    """
    if max_onehot_cardinality <= 0:
        raise ValueError("max_onehot_cardinality must be positive")
    device = PROVENANCE_COLUMNS[0]
    for required in (*LABEL_COLUMNS, device):
        if required not in df.columns:
            raise KeyError(f"the benchmark lacks column {required!r}")
    keep = [key] if key else []
    candidates = feature_columns(df, keep)
    rates = parse_rates(df, candidates)
    numbers = [name for name in candidates if rates[name] >= NUMERIC_PARSE_RATE]
    rest = [name for name in candidates if name not in numbers]
    levels, wide = categorical_encoding(df, rest, max_onehot_cardinality)
    encoding = Encoding(numbers, levels, wide)
    return encoding.apply(df, [*keep, *LABEL_COLUMNS, device])


def standardise(df: DataFrame, columns, *, train: Column = None) -> DataFrame:
    """Scale columns to zero mean and unit population variance.

    Mean and deviation come from the rows where ``train`` holds. A constant
    column is centred only.
    """
    fitted = df if train is None else df.where(train)
    moments = fitted.agg(
        *[F.avg(col(name)).alias(f"m{i}") for i, name in enumerate(columns)],
        *[F.stddev_pop(col(name)).alias(f"s{i}") for i, name in enumerate(columns)],
    ).first()
    scaled = {}
    for i, name in enumerate(columns):
        mean, deviation = moments[f"m{i}"], moments[f"s{i}"]
        if mean is None:
            raise ValueError(f"column {name!r} has no training values")
        scaled[name] = (col(name) - F.lit(mean)) / F.lit(deviation or 1.0)
    return df.select(*[scaled[c].alias(c) if c in scaled else col(c) for c in df.columns])

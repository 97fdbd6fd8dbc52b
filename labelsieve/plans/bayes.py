"""Gaussian naive Bayes as one column expression, and cross-validation from one aggregate.

The parameters are one aggregate over (class, feature). They are compiled into the log odds of a
row, an expression over its feature array, so predicting is a projection over the scan.

Count, mean and spread add up over parts of a table. So all folds of all repeats are aggregated
together, in one scan, and the training statistics of a fold are put together from those of the
others; nothing is fitted again. Majorities of tokens are additive too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

#: What is added to a variance: this share of the feature's variance over both classes.
SMOOTHING = 1e-9


@dataclass(frozen=True)
class GaussianBayes:
    """Priors, means and variances of classes 0 and 1; a feature of one value tells nothing and is left out."""

    counts: tuple[int, int]
    means: tuple[tuple[float, ...], tuple[float, ...]]
    variances: tuple[tuple[float, ...], tuple[float, ...]]
    used: tuple[int, ...]  # positions of the features

    def log_odds(self, x: Column) -> Column:
        """Of class 1 against class 0, over an array of all features."""
        start = math.log(self.counts[1] / self.counts[0])
        start -= 0.5 * sum(math.log(b / a) for a, b in zip(*self.variances, strict=True))
        if not self.used:
            return F.lit(start)
        place = F.array(*[F.lit(i) for i in self.used])
        means, variances = ([F.array(*[F.lit(v) for v in side]) for side in both] for both in (self.means, self.variances))

        def part(at: Column, i: Column) -> Column:
            value = F.get(x, at)
            near, far = (F.pow(value - F.get(means[k], i), 2) / (2 * F.get(variances[k], i)) for k in (0, 1))
            return near - far

        return F.aggregate(F.transform(place, part), F.lit(start), lambda total, more: total + more)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``probability`` and ``prediction``; a tie is class 0."""
        odds = df.withColumn("__odds", self.log_odds(vector_to_array(features)))
        chance = 1 / (1 + F.exp(-F.col("__odds")))
        return odds.withColumn("probability", array_to_vector(F.array(1 - chance, chance))).withColumn(
            "prediction", (F.col("__odds") > 0).cast("double")
        ).drop("__odds")


class GaussianBayesEstimator:
    def __init__(self, *, featuresCol: str, labelCol: str) -> None:
        self.features, self.label = featuresCol, labelCol

    def fit(self, df: DataFrame):
        model = fit(df.select(vector_to_array(self.features).alias("x"), F.col(self.label).alias("y")))
        return Fitted(model, self.features)


@dataclass(frozen=True)
class Fitted:
    model: GaussianBayes
    features: str

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df, self.features)


def moments(rows: DataFrame, *by: str) -> DataFrame:
    """Count, mean and summed squared deviation by ``by``, class ``y`` and feature of the array ``x``."""
    long = rows.select(*by, F.col("y").cast("int").alias("y"), F.posexplode("x").alias("feature", "value"))
    value = F.col("value").cast("double")
    return long.groupBy(*by, "y", "feature").agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count("*")).alias("spread")
    )


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Moments of several parts together: means by weight, spreads with what lies between the means."""
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    between = F.sum(F.col("n") * F.pow(F.col("mean") - F.col("centre"), 2))
    centre = parts.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"))
    return parts.join(centre, list(by)).groupBy(*by).agg(
        n.alias("n"), mean.alias("mean"), (F.sum("spread") + between).alias("spread")
    )


def compiled(rows: list) -> GaussianBayes:
    """A model from moments of (y, feature): a few numbers for each."""
    cells = {(r.y, r.feature): r for r in rows}
    features = sorted({r.feature for r in rows})
    if not {0, 1} <= {r.y for r in rows}:
        raise ValueError("the training rows hold one class")
    used, means, variances = [], ([], []), ([], [])
    for f in features:
        a, b = cells[0, f], cells[1, f]
        n = a.n + b.n
        spread = a.spread + b.spread + a.n * b.n / n * (a.mean - b.mean) ** 2
        if not spread > 0:
            continue
        used.append(f)
        for k, cell in enumerate((a, b)):
            means[k].append(float(cell.mean))
            variances[k].append(float(cell.spread / cell.n + SMOOTHING * spread / n))
    counts = tuple(cells[k, features[0]].n for k in (0, 1))
    return GaussianBayes(counts, tuple(map(tuple, means)), tuple(map(tuple, variances)), tuple(used))


def fit(rows: DataFrame) -> GaussianBayes:
    """From an array ``x`` and a class ``y`` of 0 or 1."""
    return compiled(moments(rows).collect())


def with_folds(rows: DataFrame, folds: list[str]) -> DataFrame:
    """A row for each repeat: ``repeat`` and the ``fold`` it is tested in."""
    pairs = [F.struct(F.lit(i).alias("repeat"), F.col(name).cast("int").alias("fold")) for i, name in enumerate(folds)]
    return rows.select("*", F.inline(F.array(*pairs)))


def fold_models(rows: DataFrame, folds: list[str], n_splits: int) -> dict[tuple[int, int], GaussianBayes]:
    """The model of every (repeat, fold), trained on the other folds of the repeat, from one aggregate."""
    cells = moments(with_folds(rows, folds), "repeat", "fold")
    without = cells.withColumn(
        "tested", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda f: f != F.col("fold")))
    )
    training: dict[tuple[int, int], list] = {}
    for row in merged(without, "repeat", "tested", "y", "feature").collect():
        training.setdefault((row.repeat, row.tested), []).append(row)
    return {key: compiled(cells) for key, cells in training.items()}


def fold_predictions(rows: DataFrame, folds: list[str], models: dict[tuple[int, int], GaussianBayes]) -> DataFrame:
    """``repeat``, ``fold``, ``y`` and ``log_odds`` of every row under the model that did not see it."""
    odds = F.lit(None).cast("double")
    for (repeat, fold), model in models.items():
        mine = (F.col("repeat") == repeat) & (F.col("fold") == fold)
        odds = F.when(mine, model.log_odds(F.col("x"))).otherwise(odds)
    return with_folds(rows, folds).select("repeat", "fold", F.col("y").cast("int").alias("y"), odds.alias("log_odds"))


def fold_token_majorities(rows: DataFrame, columns: list[str], label: str, folds: list[str]) -> DataFrame:
    """Held-out accuracy of each column's token majorities in every fold, from one aggregate.

    A token is predicted as most of its training rows are, 0 on a tie; a token that the training
    folds lack as most of all training rows.
    """
    y = F.col(label).cast("int")
    long = with_folds(rows, folds).unpivot(
        ["repeat", "fold", label], [f"`{c}`" for c in columns], "column", "token"
    )
    cells = long.groupBy("repeat", "column", "fold", "token").agg(
        F.sum(1 - y).alias("n0"), F.sum(y).alias("n1")
    )
    # A token's folds, then a fold's tokens: the others are all less these.
    token = cells.groupBy("repeat", "column", "token").agg(
        F.sum("n0").alias("all0"), F.sum("n1").alias("all1"), F.collect_list(F.struct("fold", "n0", "n1")).alias("parts")
    )
    part = token.select("repeat", "column", "all0", "all1", F.inline("parts"))
    fold = cells.groupBy("repeat", "column", "fold").agg(F.sum("n0").alias("f0"), F.sum("n1").alias("f1"))
    whole = fold.groupBy("repeat", "column").agg(F.sum("f0").alias("w0"), F.sum("f1").alias("w1"))
    sides = fold.join(whole, ["repeat", "column"]).select(
        "repeat", "column", "fold", (F.col("w1") - F.col("f1") > F.col("w0") - F.col("f0")).alias("mostly")
    )
    t0, t1 = F.col("all0") - F.col("n0"), F.col("all1") - F.col("n1")
    attack = F.when(t0 + t1 == 0, F.col("mostly")).otherwise(t1 > t0)
    return part.join(F.broadcast(sides), ["repeat", "column", "fold"]).groupBy("repeat", "fold", "column").agg(
        F.sum(F.col("n0") + F.col("n1")).alias("n_test"),
        (F.sum(F.when(attack, F.col("n1")).otherwise(F.col("n0"))) / F.sum(F.col("n0") + F.col("n1"))).alias("accuracy"),
    )

"""Classification metrics from confusion counts, and tables of scores."""

from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.constants import FOLD_METRICS, Z_95
from labelsieve.functions.columns import col
from labelsieve.operators.ranking import running_totals

RUN = ("model", "protocol", "split")


def confusion(predictions: DataFrame, by=RUN, label="label", prediction="prediction") -> DataFrame:
    """Rows per (label, prediction) pair: at most classes squared per run."""
    return predictions.groupBy(
        *by, col(label).cast("string").alias("label"), col(prediction).cast("string").alias("prediction")
    ).agg(F.count("*").alias("n"))


def per_class(counts: DataFrame, by=RUN) -> DataFrame:
    """True positives, support and predictions of every class seen on a side."""
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )
    return (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def classification_metrics(counts: DataFrame, by=RUN) -> DataFrame:
    """Accuracy, balanced accuracy and macro and weighted scores per run.

    Balanced accuracy averages recall over the classes that occur as labels.
    The macro scores average over all classes seen as label or prediction,
    with 0 for an undefined ratio.
    """
    support, predicted, hits = F.col("support"), F.col("predicted"), F.col("hits")
    recall, precision = _ratio(hits, support), _ratio(hits, predicted)
    f1 = _ratio(2 * hits, support + predicted)
    return (
        per_class(counts, by)
        .groupBy(*by)
        .agg(
            F.sum(support).alias("n_test"),
            (F.sum(hits) / F.sum(support)).alias("accuracy"),
            F.avg(F.when(support > 0, recall)).alias("balanced_accuracy"),
            F.avg(precision).alias("precision_macro"),
            F.avg(recall).alias("recall_macro"),
            F.avg(f1).alias("f1_macro"),
            (F.sum(f1 * support) / F.sum(support)).alias("f1_weighted"),
        )
    )


def per_class_recall(counts: DataFrame, by=RUN) -> DataFrame:
    """Recall of each class that occurs as a label, in long form."""
    return (
        per_class(counts, by)
        .where(F.col("support") > 0)
        .select(*by, "class", (F.col("hits") / F.col("support")).alias("recall"))
    )


def recall_map(counts: DataFrame, by=RUN) -> DataFrame:
    """The recalls of a run as one map from class to recall."""
    entries = F.collect_list(F.struct("class", "recall"))
    return per_class_recall(counts, by).groupBy(*by).agg(F.map_from_entries(entries).alias("per_class_recall"))


def roc_auc(predictions: DataFrame, by=RUN, label="label", score="score") -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null for one class.

    Rows of equal score are counted together first. A positive then beats the
    negatives of lower scores and half of those of its own.
    """
    by = list(by)
    scores = predictions.groupBy(*by, col(score).alias("score")).agg(
        F.count_if(col(label) == 0).alias("neg"), F.count_if(col(label) == 1).alias("pos")
    )
    ordered = running_totals(scores, "score", ["neg"], groups=by)
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ordered.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("roc_auc"))


def fold_aggregate(scores: DataFrame, by=("model", "protocol", "metric"), value="value") -> DataFrame:
    """Mean, sample deviation and 95% interval over folds."""
    base = scores.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.count(value).alias("n_folds"),
    )
    half = F.lit(Z_95) * F.col("std") / F.sqrt(F.col("n_folds").cast("double"))
    return base.select(
        *by, "mean", "std",
        (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"),
        half.alias("half_width"), "n_folds",
    )


def formatted_pivot(aggregates: DataFrame, protocols, metric: str = "f1_macro", digits: int = 4) -> DataFrame:
    """Model by protocol table of ``mean ± half width``."""
    if metric not in FOLD_METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {FOLD_METRICS}")
    cell = F.format_string(f"%.{digits}f ± %.{digits}f", "mean", "half_width")
    chosen = aggregates.where(F.col("metric") == metric).select("model", "protocol", cell.alias("cell"))
    return chosen.groupBy("model").pivot("protocol", list(protocols)).agg(F.first("cell"))


def delta_pivot(scores: DataFrame, first="readme", second="clean", metrics=("accuracy", "f1_macro")) -> DataFrame:
    """Each metric under two protocols and their difference, per model."""

    def under(metric, protocol):
        return F.avg(F.when(F.col("protocol") == protocol, F.col(metric)))

    columns = []
    for metric in metrics:
        columns += [
            under(metric, second).alias(f"{metric}_{second}"),
            under(metric, first).alias(f"{metric}_{first}"),
            (under(metric, first) - under(metric, second)).alias(f"{metric}_delta"),
        ]
    return scores.groupBy("model").agg(*columns)


def lodo_pivot(scores: DataFrame, splits, metric: str = "balanced_accuracy", worst: bool = True) -> DataFrame:
    """Model by held-out device, with the mean and the worst device."""
    cells = [F.avg(F.when(F.col("split") == s, F.col(metric))).alias(s) for s in splits]
    table = scores.groupBy("model").agg(*cells)
    values = F.array_compact(F.array(*[col(s) for s in splits]))
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    table = table.withColumn("mean", F.when(F.size(values) > 0, total / F.size(values)))
    if worst:
        table = table.withColumn("worst", F.array_min(values))
    return table.orderBy(F.desc("mean"))


def score_table(scores: DataFrame) -> DataFrame:
    """Scores by protocol, best macro-F1 first."""
    return scores.orderBy(F.asc("protocol"), F.desc("f1_macro"))

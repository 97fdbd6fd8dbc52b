"""Fit models under a split protocol and score them.

Each fit is distributed; a suite runs a few at a time, as one alone leaves cores
waiting for the driver between its small jobs. Predictions go to a folder of each
run in the scratch folder, and all runs are scored together from them.
"""

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelsieve.constants import (
    BINARY_LABEL,
    DEVICE_COLUMN,
    FOLD_METRICS,
    LABEL_COLUMNS,
    RANDOM_SEED,
    TEST_SIZE,
)
from labelsieve.functions.columns import col
from labelsieve.operators.alignment import align, shared_features
from labelsieve.operators.metrics import (
    RUN,
    classification_metrics,
    confusion,
    fold_aggregate,
    per_class,
    recall_map,
    roc_auc,
)
from labelsieve.operators.splits import TEST, TRAIN, kfold_assign, lodo_draw, stratified_split
from labelsieve.plans.bayes import GaussianBayesEstimator, fold_models, fold_predictions
from labelsieve.plans.models import FEATURES, LABEL, MODELS
from labelsieve.plans.perceptron import ALL_WORK, WatchedPerceptron
from labelsieve.plans.trees import ROW
from labelsieve.storage import materialise, scratch_path

#: Rows in a partition of a matrix, about, and the fewest partitions.
PARTITION_ROWS, FEWEST_PARTITIONS = 10_000, 2
#: Fits of a suite that run at the same time: at least, and at most where there are more cores.
PARALLEL_FITS, MOST_FITS = 8, 16


def assemble(df: DataFrame, features, label: str = BINARY_LABEL, keep=(), key=None) -> DataFrame:
    """Feature vector and numeric label, beside the ``keep`` columns; with ``key`` a number of the row."""
    labelled = [*[col(c) for c in keep], col(label).cast("double").alias(LABEL)]
    if key is not None:
        names = [key] if isinstance(key, str) else list(key)
        labelled.append(F.xxhash64(*[col(name).cast("string") for name in names]).alias(ROW))
    if list(features) == [FEATURES]:
        return df.select(*labelled, FEATURES)
    plain = [col(name).cast("double").alias(f"f{i}") for i, name in enumerate(features)]
    inputs = [f"f{i}" for i in range(len(features))]
    vectors = VectorAssembler(inputCols=inputs, outputCol=FEATURES).transform(df.select(*labelled, *plain))
    return vectors.drop(*inputs)


def dealt(rows: DataFrame, label: str) -> DataFrame:
    """The rows, written once in partitions and in an order of their numbers.

    Parts of it are then read by a filter, without a shuffle, and the layout depends on the rows only.
    """
    partitions = max(FEWEST_PARTITIONS, rows.count() // PARTITION_ROWS)
    return materialise(rows.repartition(partitions, ROW).sortWithinPartitions(ROW), label)


@dataclass
class Runs:
    """Predictions of several fits, a folder each, and the facts about each fit."""

    spark: SparkSession
    path: str
    facts: list = field(default_factory=list)
    folders: list = field(default_factory=list)
    skipped: list = field(default_factory=list)

    @classmethod
    def start(cls, spark: SparkSession) -> "Runs":
        return cls(spark, scratch_path(spark, "predictions"))

    def fit(self, spec, train: DataFrame, test: DataFrame, protocol: str, split: str, **settings) -> None:
        """Fit, predict and append; ``test`` may be (part, frame) pairs."""
        classes = {row[0]: row[1] for row in train.groupBy(LABEL).count().collect()}
        if len(classes) < 2:
            raise ValueError(f"the training rows of {split!r} hold {len(classes)} classes")
        width = len(train.select(FEATURES).first()[0])
        parts = test if isinstance(test, list) else [(split, test)]
        started = time.perf_counter()
        model = spec.build(width, sum(classes.values()), **settings).fit(train)
        fitted = time.perf_counter()
        folder = f"{self.path}/{spec.name}-{uuid.uuid4().hex}"
        for name, rows in parts:
            scored = model.transform(rows).select(
                F.lit(spec.name).alias("model"), F.lit(protocol).alias("protocol"), F.lit(name).alias("split"),
                F.col(LABEL).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
                vector_to_array("probability")[1].alias("score"),
            )
            scored.write.mode("append").parquet(folder)
        predicted = time.perf_counter()
        self.folders.append(folder)  # only now: a half run has no part in the scores
        for name, _ in parts:
            self.facts.append(
                (spec.name, protocol, name, sum(classes.values()), width, fitted - started, predicted - fitted)
            )

    def fit_folds(self, spec, rows: DataFrame, folds: list[str], n_splits: int, protocol: str) -> None:
        """All folds of a model whose statistics add up: one aggregate, one scan of predictions."""
        arrays = rows.select(*folds, vector_to_array(FEATURES).alias("x"), F.col(LABEL).alias("y"))
        started = time.perf_counter()
        models = fold_models(arrays, folds, n_splits)
        fitted = time.perf_counter()
        split = F.concat_ws("_", F.lit("fold"), "repeat", "fold")
        predicted = fold_predictions(arrays, folds, models).select(
            F.lit(spec.name).alias("model"), F.lit(protocol).alias("protocol"), split.alias("split"),
            F.col("y").alias("label"), (F.col("log_odds") > 0).cast("int").alias("prediction"),
            (1 / (1 + F.exp(-F.col("log_odds")))).alias("score"),
        )
        folder = f"{self.path}/{spec.name}-{uuid.uuid4().hex}"
        predicted.write.parquet(folder)
        seconds = time.perf_counter() - fitted
        self.folders.append(folder)
        width = len(rows.select(FEATURES).first()[0])
        for (repeat, fold), model in models.items():
            self.facts.append(
                (spec.name, protocol, f"fold_{repeat}_{fold}", sum(model.counts), width,
                 (fitted - started) / len(models), seconds / len(models))
            )

    def try_fit(self, spec, *args, **settings) -> None:
        """Fit; a run that cannot be fitted is noted and left out."""
        try:
            self.fit(spec, *args, **settings)
        except (ValueError, PySparkException, Py4JJavaError) as problem:
            protocol, split = args[2], args[3]
            self.skipped.append((spec.name, protocol, split, str(problem)[:500]))

    def fit_all(self, jobs) -> None:
        """Fit each (spec, train, test, protocol, split, settings), a few at a time.

        Perceptrons go first, as they take longest. With other fits beside them they have a share of the cores
        only, so one task takes their steps up to as many times the work.
        """
        jobs = sorted(jobs, key=lambda job: job[0].estimator is not WatchedPerceptron)
        fits = max(PARALLEL_FITS, min(self.spark.sparkContext.defaultParallelism, MOST_FITS))
        work = {"allWork": ALL_WORK * min(fits, len(jobs))}

        def fit(job) -> None:
            spec, settings = job[0], job[5]
            self.try_fit(*job[:5], **({**work, **settings} if spec.estimator is WatchedPerceptron else settings))

        with ThreadPoolExecutor(fits) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(fit), jobs))

    def skipped_frame(self) -> DataFrame:
        """The runs that could not be fitted, and why."""
        return self.spark.createDataFrame(
            self.skipped, "model string, protocol string, split string, problem string"
        )

    def predictions(self) -> DataFrame:
        if not self.facts:
            raise ValueError(f"no run was completed: {self.skipped}")
        schema = "model string, protocol string, split string, label int, prediction int, score double"
        return self.spark.read.schema(schema).parquet(*self.folders)

    def scores(self, auc: bool = True) -> DataFrame:
        """A row per run: sizes, metrics, recall of each class, and the time each phase took.

        A run that could not be fitted has a row too: ``problem`` says why, the rest is null.
        """
        predictions = self.predictions()
        counts = materialise(confusion(predictions), "confusion")
        metrics = classification_metrics(counts).join(recall_map(counts), list(RUN), "left")
        if auc:
            metrics = metrics.join(roc_auc(predictions), list(RUN))
        facts = self.spark.createDataFrame(
            self.facts,
            "model string, protocol string, split string, n_train long, n_features int, "
            "fit_seconds double, predict_seconds double",
        )
        micros = F.col("predict_seconds") * 1e6 / F.col("n_test")
        card = metrics.join(F.broadcast(facts), list(RUN)).withColumn("predict_us_per_sample", micros)
        return card.withColumn("problem", F.lit(None).cast("string")).unionByName(
            self.skipped_frame(), allowMissingColumns=True
        )


def fit_and_score(spec, train: DataFrame, test: DataFrame, *, protocol: str, split: str, **settings) -> DataFrame:
    """Score card of one model on one split of assembled rows."""
    if not train.limit(1).count() or not test.limit(1).count():
        raise ValueError("training and test rows must not be empty")
    runs = Runs.start(train.sparkSession)
    runs.fit(spec, train, test, protocol, split, **settings)
    return runs.scores()


def fit_split(runs: Runs, prepared, specs, *, test_size=TEST_SIZE, seed=RANDOM_SEED, settings=None) -> None:
    """Fit every model on a stratified split of a prepared table."""
    key = prepared.frame.columns[0]
    split = stratified_split(prepared.frame, key, BINARY_LABEL, test_size=test_size, seed=seed)
    rows = dealt(assemble(split, prepared.features, keep=("split",), key=key), "matrix")
    train = rows.where(F.col("split") == TRAIN).drop("split")
    test = rows.where(F.col("split") == TEST).drop("split")
    runs.fit_all(
        (spec, train, test, prepared.protocol, "random_stratified", (settings or {}).get(spec.name, {})) for spec in specs
    )


def compared(prepared, specs=MODELS, **options) -> Runs:
    """Runs of the models under each preparation protocol."""
    runs = Runs.start(prepared[0].frame.sparkSession)
    for one in prepared:
        fit_split(runs, one, specs, **options)
    return runs


def compare_protocols(prepared, specs=MODELS, **options) -> DataFrame:
    """Scores of the models under each preparation protocol."""
    return compared(prepared, specs, **options).scores()


def fold_scores(scores: DataFrame) -> DataFrame:
    """Long (model, protocol, metric, value) rows of the per-fold metrics."""
    return scores.unpivot(["model", "protocol", "split"], list(FOLD_METRICS), "metric", "value")


def repeated_kfold(
    prepared, specs=MODELS, *, n_splits: int = 5, n_repeats: int = 3, seed=RANDOM_SEED, settings=None
) -> DataFrame:
    """Mean and interval of each metric over repeated stratified folds.

    Naive Bayes is not fitted fold by fold: its statistics of all folds come from one aggregate.
    """
    key = prepared.frame.columns[0]
    folded = kfold_assign(prepared.frame, key, BINARY_LABEL, n_splits=n_splits, n_repeats=n_repeats, seed=seed)
    folds = [f"fold_{repeat}" for repeat in range(n_repeats)]
    rows = dealt(assemble(folded, prepared.features, keep=folds, key=key), "folds")
    runs = Runs.start(rows.sparkSession)
    additive = [spec for spec in specs if spec.estimator is GaussianBayesEstimator]
    specs = [spec for spec in specs if spec not in additive]
    for spec in additive:
        runs.fit_folds(spec, rows, folds, n_splits, prepared.protocol)
    runs.fit_all(
        (
            spec,
            rows.where(F.col(fold) != number).drop(*folds),
            rows.where(F.col(fold) == number).drop(*folds),
            prepared.protocol,
            f"{fold}_{number}",
            (settings or {}).get(spec.name, {}),
        )
        for fold in folds
        for number in range(n_splits)
        for spec in specs
    )
    return fold_aggregate(fold_scores(runs.scores(auc=False)))


def lodo_sweep(matrix: DataFrame, key: str, devices, specs=MODELS, **options) -> DataFrame:
    """Scores of every model with every device held out in turn."""
    return swept(matrix, key, devices, specs, **options).scores()


def swept(
    matrix: DataFrame, key: str, devices, specs=MODELS, *, attack_fraction=TEST_SIZE, seed=RANDOM_SEED, settings=None
) -> Runs:
    """Runs of every model with every device held out in turn.

    The matrix is written once, in folders by device and by whether an attack row is drawn for testing. Which
    folders a held-out device trains and tests on is a filter on the folders' names, so a run reads no
    others. Class counts of all sides come from one aggregate. A device that cannot be held out is skipped.
    """
    features = [c for c in matrix.columns if c not in (key, *LABEL_COLUMNS, DEVICE_COLUMN)]
    drawn = lodo_draw(matrix, key, attack_fraction=attack_fraction, seed=seed)
    rows = assemble(drawn, features, keep=(DEVICE_COLUMN, "attack_drawn"), key=key)
    spark = rows.sparkSession
    path = scratch_path(spark, "sweep")
    partitions = max(FEWEST_PARTITIONS, matrix.count() // PARTITION_ROWS)
    rows.repartition(partitions, ROW).sortWithinPartitions(DEVICE_COLUMN, "attack_drawn", ROW).write.partitionBy(
        DEVICE_COLUMN, "attack_drawn"
    ).parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    sizes = rows.groupBy(DEVICE_COLUMN, "attack_drawn", LABEL).count().collect()
    runs, jobs = Runs.start(spark), []
    for device in devices:
        problem = sweep_problem(sizes, device)
        if problem:
            runs.skipped.extend((spec.name, "benchmark", f"lodo_{device}", problem) for spec in specs)
            continue
        train, test = sweep_sides(rows, device)
        jobs += [
            (spec, train, test, "benchmark", f"lodo_{device}", (settings or {}).get(spec.name, {})) for spec in specs
        ]
    runs.fit_all(jobs)
    return runs


def sweep_sides(rows: DataFrame, device: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows with a device held out, by the folders they are in."""
    tested = F.coalesce(F.col(DEVICE_COLUMN) == device, F.lit(False)) | F.col("attack_drawn")
    train, test = (rows.where(side).drop(DEVICE_COLUMN, "attack_drawn") for side in (~tested, tested))
    return train, test


def sweep_problem(sizes, device: str) -> str | None:
    """Why a device can't be held out, from counts by device, draw and label; None if it can."""
    sides = {True: set(), False: set()}
    for row in sizes:
        sides[row[DEVICE_COLUMN] == device or row.attack_drawn].add(row[LABEL])
    if not any(row[DEVICE_COLUMN] == device for row in sizes):
        return f"device {device!r} is absent"
    if min(map(len, sides.values())) < 2:
        return f"holding out {device!r} leaves a single-class side"
    return None


IN_DOMAIN, CROSS_DOMAIN = "in_domain", "cross_domain"


def cross_domain_metrics(predictions: DataFrame) -> DataFrame:
    """In- and cross-domain scores per model from predictions of both parts.

    Attack recall is null when the target holds no attack.
    """
    counts = confusion(predictions, ("model", "split"))
    metrics = classification_metrics(counts, ("model", "split"))
    attacks = per_class(counts, ("model", "split")).where((F.col("class") == "1") & (F.col("support") > 0))
    recall = attacks.select("model", "split", (F.col("hits") / F.col("support")).alias("attack_recall"))
    both = metrics.join(recall, ["model", "split"], "left")

    def of(part, metric):
        return F.max(F.when(F.col("split") == part, F.col(metric)))

    in_f1, cross_f1 = of(IN_DOMAIN, "f1_macro"), of(CROSS_DOMAIN, "f1_macro")
    return both.groupBy("model").agg(
        of(IN_DOMAIN, "n_test").alias("n_source_test"),
        of(CROSS_DOMAIN, "n_test").alias("n_target"),
        of(IN_DOMAIN, "accuracy").alias("in_domain_accuracy"),
        in_f1.alias("in_domain_f1_macro"),
        of(CROSS_DOMAIN, "accuracy").alias("cross_domain_accuracy"),
        of(CROSS_DOMAIN, "balanced_accuracy").alias("cross_domain_balanced_accuracy"),
        cross_f1.alias("cross_domain_f1_macro"),
        of(CROSS_DOMAIN, "attack_recall").alias("cross_domain_attack_recall"),
        (in_f1 - cross_f1).alias("f1_macro_drop"),
    ).orderBy(F.desc("cross_domain_f1_macro"))


def cross_domain(
    source: DataFrame, features, key: str, target: DataFrame, specs=MODELS, *,
    label: str = BINARY_LABEL, target_label: str = "label", test_size=TEST_SIZE, seed=RANDOM_SEED, settings=None,
) -> DataFrame:
    """Train on the source's shared features, score on it and on the target.

    A model that could not be fitted has a row too: ``problem`` says why, the rest is null.
    """
    pairs = shared_features(features, [c for c in target.columns if c != target_label])
    names = [pair[0] for pair in pairs]
    split = stratified_split(source, key, label, test_size=test_size, seed=seed)
    aligned = align(split.withColumn("key_", col(key)), pairs, side=0, keep=(label, "split", "key_"))
    rows = dealt(assemble(aligned, names, label, keep=("split",), key="key_"), "source")
    foreign = target.withColumnRenamed(target_label, "target_label_")
    other = materialise(assemble(align(foreign, pairs, side=1, keep=("target_label_",)), names, "target_label_"), "target")
    train = rows.where(F.col("split") == TRAIN).drop("split")
    test = rows.where(F.col("split") == TEST).drop("split")
    runs = Runs.start(rows.sparkSession)
    both = [(IN_DOMAIN, test), (CROSS_DOMAIN, other)]
    runs.fit_all((spec, train, both, "cross_domain", "source", (settings or {}).get(spec.name, {})) for spec in specs)
    table = cross_domain_metrics(runs.predictions()).withColumn("shared_features", F.lit(len(pairs)))
    failed = runs.skipped_frame().select("model", "problem")
    return table.withColumn("problem", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def gaussian_parameters(df: DataFrame, columns, label: str) -> DataFrame:
    """Mean and population variance per class and feature, and class priors."""
    long = df.select(col(label).cast("int").alias("label"), *[col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["label"], [f"`{c}`" for c in columns], "feature", "value"
    )
    total = df.count()
    return long.groupBy("label", "feature").agg(
        F.avg("value").alias("mean"), F.var_pop("value").alias("variance"),
        (F.count("*") / F.lit(total)).alias("prior"),
    )

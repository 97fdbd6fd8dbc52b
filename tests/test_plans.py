"""Preparation protocols, metrics and model runs."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from labelsieve.catalog.fixtures import TRAFFIC, view
from labelsieve.operators import metrics, summaries
from labelsieve.plans import evaluate, models, recipes

SMALL = {"RandomForest": {"numTrees": 3, "maxDepth": 3}, "HistGradientBoosting": {"maxIter": 2}, "MLP": {"maxIter": 3}}


@pytest.fixture(scope="module")
def traffic(spark):
    events = spark.range(600).select(
        F.col("id").alias("event_id"), (F.col("id") % 40).alias("user_id"),
        F.when(F.col("id") % 4 == 0, "error").otherwise("view").alias("event_type"),
        (F.col("id") * 7 % 100).cast("double").alias("value"),
    )
    return view(events, TRAFFIC).drop("event_id")


def test_planted_leak_is_removed_by_the_clean_protocol(traffic):
    readme, clean = recipes.prepare_readme(traffic), recipes.prepare_clean(traffic)
    assert "mqtt.topic" in clean.notes["leaking_columns_removed"]
    assert not [f for f in clean.features if f.startswith("mqtt.topic")]
    assert "dns.qry.name.len" in clean.notes["ambiguous_placeholder_columns"]
    assert "dns.qry.name.len_0" in readme.features and "dns.qry.name.len_0" not in clean.features
    assert readme.notes["rows_in"] == 600 and readme.notes["rows_out"] == readme.frame.count()
    assert readme.frame.select(recipes.ROW_KEY).distinct().count() == readme.notes["rows_out"]


def test_switches_of_the_clean_protocol(traffic):
    keyed = traffic.withColumn("k", F.monotonically_increasing_id())
    off = {"canonical": False, "distinct": False, "drop_leaking": False}
    kept = recipes.prepare_clean(keyed, key="k", max_onehot=3, **off)
    assert kept.notes["rows_out"] == 600 and kept.notes["duplicates_removed"] == 0
    assert "mqtt.topic_probe" in kept.features and "http.referer__entropy" in kept.features
    assert kept.notes["placeholder_replacements"] == 0
    with pytest.raises(ValueError, match="key"):
        recipes.prepare_clean(traffic, distinct=False)


def test_preparation_is_checked(spark, traffic):
    for prepare in (recipes.prepare_readme, recipes.prepare_clean):
        with pytest.raises(KeyError):
            prepare(traffic.drop("Attack_type"))
        with pytest.raises(ValueError):
            prepare(traffic.withColumn("Attack_label", F.lit("2")))
        with pytest.raises(ValueError):
            prepare(traffic.where("false"))
    only = spark.createDataFrame([("0", "N", "a"), ("1", "X", "b")], "Attack_label string, Attack_type string, `mqtt.topic` string")
    with pytest.raises(ValueError, match="no feature"):
        recipes.prepare_clean(only)


def test_sparse_features_equal_wide_ones(traffic):
    wide = recipes.prepare_readme(traffic)
    sparse = recipes.prepare_readme(traffic, vector=True)
    assert sparse.features == ("features",)
    left = {r.row_key: tuple(r[f] for f in wide.features) for r in wide.frame.collect()}
    right = {r.row_key: tuple(r.v) for r in sparse.frame.select("row_key", vector_to_array("features").alias("v")).collect()}
    assert left == right


def test_feature_counts_of_the_published_tables():
    """61 fields, 15 dropped and 7 encoded, leave 39 numbers beside the tokens."""
    from labelsieve.constants import RECIPE_DROP_COLUMNS, RECIPE_DUMMY_COLUMNS

    numbers = 61 - len(RECIPE_DROP_COLUMNS) - len(RECIPE_DUMMY_COLUMNS)
    assert (numbers + 35, numbers + 56) == (74, 95)


def test_metrics_by_hand(spark):
    pairs = [(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 1 + [(1, 2)] * 1
    df = spark.createDataFrame([("m", "p", "s", y, p) for y, p in pairs], "model string, protocol string, split string, label int, prediction int")
    counts = metrics.confusion(df)
    row = metrics.classification_metrics(counts).first()
    assert row.n_test == 10 and row.accuracy == 0.7
    assert abs(row.balanced_accuracy - (0.75 + 0.5) / 2) < 1e-12
    assert abs(row.recall_macro - (0.75 + 0.5 + 0) / 3) < 1e-12
    assert abs(row.precision_macro - (1 + 1 / 3 + 0) / 3) < 1e-12
    f0, f1 = 12 / 14, 2 / 5
    assert abs(row.f1_macro - (f0 + f1) / 3) < 1e-12 and abs(row.f1_weighted - (f0 * 8 + f1 * 2) / 10) < 1e-12
    assert metrics.recall_map(counts).first().per_class_recall == {"0": 0.75, "1": 0.5}


def test_fold_interval_and_single_fold(spark):
    df = spark.createDataFrame(
        [("m", "p", "f1_macro", v) for v in (0.5, 0.7)] + [("one", "p", "f1_macro", 0.9)],
        "model string, protocol string, metric string, value double",
    )
    rows = {r.model: r for r in metrics.fold_aggregate(df).collect()}
    assert rows["one"].std == 0.0 and rows["one"].ci_low == rows["one"].ci_high == 0.9 and rows["one"].n_folds == 1
    assert abs(rows["m"].half_width - 1.959963985 * (0.02**0.5) / 2**0.5) < 1e-12
    table = metrics.formatted_pivot(metrics.fold_aggregate(df), ["p"]).where("model = 'one'").first()
    assert table.p == "0.9000 ± 0.0000"
    with pytest.raises(ValueError):
        metrics.formatted_pivot(df, ["p"], metric="nope")


def test_uplink_of_the_published_setting(spark):
    df = spark.createDataFrame([(28450,)] * 5, "parameters long")
    rows = {r.backhaul: r for r in summaries.uplink_budget(df, 20).collect()}
    assert abs(rows["lorawan_sf7"].seconds_per_round - 832.1755027422304) < 1e-9
    assert rows["nb_iot"].seconds_per_round == 18.208
    with pytest.raises(ValueError):
        summaries.uplink_budget(df, 0)
    with pytest.raises(ValueError):
        summaries.uplink_budget(spark.createDataFrame([(0,)], "parameters long"), 1)


def test_vector_mean(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1), ([4.0, 5.0], 2)], "v array<double>, w int")
    assert summaries.weighted_vector_mean(df, "v", "w").first().mean == [3.0, 4.0]
    for bad in (df.where("false"), df.withColumn("w", F.lit(0))):
        with pytest.raises(ValueError):
            summaries.weighted_vector_mean(bad, "v", "w")


def test_registry():
    assert models.get_model("MLP").scaled and not models.get_model("RandomForest").scaled
    assert [m.name for m in models.edge_models()] == [m.name for m in models.MODELS if m.name != "MLP"]
    with pytest.raises(ValueError):
        models.get_model("SVM")
    logistic = models.get_model("LogisticRegression").build(3, 50).getStages()[-1]
    assert logistic.getRegParam() == 1 / 50 and logistic.getMaxIter() == 1000
    assert models.get_model("DeepMLP").build(3, 50).getStages()[-1].getLayers() == [3, 256, 128, 64, 2]


@pytest.fixture(scope="module")
def prepared(traffic):
    return recipes.prepare_readme(traffic), recipes.prepare_clean(traffic)


def test_bayes_loses_its_score_once_the_leak_is_gone(prepared):
    suite = [models.get_model("GaussianNB"), models.get_model("DecisionTree")]
    scores = evaluate.compare_protocols(list(prepared), suite)
    rows = {(r.model, r.protocol): r for r in scores.collect()}
    assert rows["DecisionTree", "readme"].accuracy == 1.0
    delta = {r.model: r for r in metrics.delta_pivot(scores).collect()}
    assert all(r.accuracy_delta >= 0 for r in delta.values())
    row = rows["GaussianNB", "clean"]
    assert row.n_features == len(prepared[1].features) and row.fit_seconds > 0 and row.predict_us_per_sample > 0


@pytest.mark.parametrize("name", ["RandomForest", "HistGradientBoosting", "MLP", "LogisticRegression"])
def test_each_model_fits(prepared, name):
    runs = evaluate.Runs.start(prepared[0].frame.sparkSession)
    evaluate.fit_split(runs, prepared[0], [models.get_model(name)], settings=SMALL)
    assert not runs.skipped and runs.scores().first().accuracy > 0.5


def test_kfold_and_failing_fits(prepared):
    table = evaluate.repeated_kfold(prepared[1], [models.get_model("GaussianNB")], n_splits=2, n_repeats=2)
    assert {r.metric: r.n_folds for r in table.collect()} == {"accuracy": 4, "balanced_accuracy": 4, "f1_macro": 4}
    one = recipes.Prepared(prepared[1].frame.where("Attack_label = 0"), prepared[1].features, "clean", (), {})
    runs = evaluate.Runs.start(one.frame.sparkSession)
    evaluate.fit_split(runs, one, [models.get_model("GaussianNB")])
    assert runs.skipped
    with pytest.raises(ValueError, match="no run"):
        runs.scores()


def test_fit_needs_rows(spark):
    empty = spark.createDataFrame([], "label double, features array<double>")
    with pytest.raises(ValueError):
        evaluate.fit_and_score(models.get_model("GaussianNB"), empty, empty, protocol="p", split="s")


def test_sweep_skips_absent_devices(spark):
    df = spark.range(300).select(
        F.col("id").alias("key"), (F.col("id") % 3 == 0).cast("int").alias("Attack_label"), F.lit("x").alias("Attack_type"),
        F.when(F.col("id") % 3 == 0, "attack:X").otherwise(F.concat(F.lit("d"), F.col("id") % 2)).alias("source_device"),
        (F.col("id") % 3).cast("double").alias("f"), (F.col("id") % 7).cast("double").alias("g"),
    )
    scores = evaluate.lodo_sweep(df, "key", ["d0", "d1", "gone"], [models.get_model("DecisionTree")])
    assert {r.split for r in scores.where("problem is null").collect()} == {"lodo_d0", "lodo_d1"}
    assert [(r.split, r.model) for r in scores.where("problem is not null").collect()] == [("lodo_gone", "DecisionTree")]
    row = metrics.lodo_pivot(scores, ["lodo_d0", "lodo_d1"]).first()
    assert row.mean == 1.0 and row.worst == 1.0


def test_last_row_of_each_group(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("b", 2, "z"), (None, 5, "n"), (None, 4, "m")]
    df = spark.createDataFrame(rows, "scheme string, round int, v string")
    got = sorted(((r.scheme, r.v) for r in summaries.last_per_group(df, "scheme", "round").collect()), key=str)
    assert got == [("a", "y"), ("b", "z"), (None, "n")]


def test_last_row_keeps_groups_of_null_order(spark):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), ("b", None, "only"), (None, 5, "n")], "g string, o int, v string"
    )
    assert sorted((r.g or "", r.v) for r in summaries.last_per_group(df, "g", "o").collect()) == [("", "n"), ("a", "y"), ("b", "only")]


def test_a_failing_fit_is_reported(spark):
    df = spark.createDataFrame([(i, float(i % 7), i % 2) for i in range(60)], "key int, f0 double, y int")
    rows = evaluate.assemble(df, ["f0"], "y")
    runs = evaluate.Runs.start(spark)
    tree = models.get_model("DecisionTree")
    broken = rows.withColumn("label", F.when(F.col("label") == 1, F.expr("1 / int(label - label)")).otherwise(0))
    runs.fit_all([
        (tree, rows, rows, "p", "good", {}),
        (tree, rows, [("half", rows), ("broken", broken)], "p", "bad", {}),
        (tree, rows.where("label = 0"), rows, "p", "single", {}),
    ])
    card = {r.split: r for r in runs.scores(auc=False).collect()}
    assert set(card) == {"good", "bad", "single"}
    assert card["good"].problem is None and set(card["good"].per_class_recall) == {"0", "1"}
    assert "DIVIDE_BY_ZERO" in card["bad"].problem and "1 classes" in card["single"].problem


def test_tokens_alike_but_for_case(spark):
    methods = ["GET", "get", "nan", "NaN"]
    rows = [(str(i % 2), "N" if i % 2 else "X", methods[i % 4 if i % 3 else 0], str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "Attack_label string, Attack_type string, `http.request.method` string, n string")
    prepared = [recipes.prepare_readme(df), recipes.prepare_clean(df)]
    assert len({f.lower() for f in prepared[0].features}) == len(prepared[0].features) == 5
    scores = evaluate.compare_protocols(prepared, [models.get_model("DecisionTree")])
    assert scores.where("problem is null").count() == 2


def test_vector_form_lists_its_slots(traffic):
    prepared = recipes.prepare_readme(traffic, vector=True)
    slots = sorted(r.slot for r in prepared.levels.collect())
    width = prepared.notes["n_features"]
    assert slots == list(range(width - prepared.notes["n_dummy_features"], width))
    assert not prepared.frame.schema["features"].metadata


def test_vector_form_lists_its_slots_without_the_rows(traffic):
    """Slots come from the ranked tokens; the rows are not joined again for them."""
    prepared = recipes.prepare_readme(traffic, vector=True)
    assert "Join" not in prepared.levels._jdf.queryExecution().optimizedPlan().toString()
    tokens = [(r["column"], r.token) for r in prepared.levels.collect()]
    assert len(tokens) == len(set(tokens)) == prepared.notes["n_dummy_features"]

"""Queries of metrics, score tables, summaries and model fits."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from labelsieve.catalog import protocols, sqltext as s
from labelsieve.catalog.fixtures import (
    ATTACKS, CAPTURE, CATEGORICAL, DEVICES, NUMBER_FEATURES, NUMBERS, PREDICTIONS, PROVENANCE, TRAFFIC, read, rounded, sql, view,
)
from labelsieve.constants import (
    ATTACK_PREFIX, BACKHAUL_KBPS, BINARY_LABEL, DEVICE_COLUMN, FOLD_METRICS, MAX_ONEHOT_CARDINALITY,
    NUMERIC_PARSE_RATE, RANDOM_SEED, Z_95,
)
from labelsieve.operators import metrics, summaries
from labelsieve.operators.splits import TEST, TRAIN, kfold_assign, stratified_split
from labelsieve.plans import bayes, benchmark, evaluate, models, recipes
from labelsieve.sources import captures
from labelsieve.storage import materialise

KEY = "event_id"
SPLITS = ("fold_0", "fold_1", "fold_2", "fold_3", "fold_4", "solo")


def _predictions(spark, folder):
    return view(read(spark, folder, "events"), PREDICTIONS)


def _scores(spark, folder):
    return metrics.classification_metrics(metrics.confusion(_predictions(spark, folder)))


def _folds(spark, folder):
    return metrics.fold_aggregate(evaluate.fold_scores(_scores(spark, folder)))


def class_balance(spark, folder):
    df = view(read(spark, folder, "events"), TRAFFIC, PROVENANCE)
    return rounded(summaries.class_balance(df))


def latency_summary(spark, folder):
    measured = view(
        read(spark, folder, "events"), {"model": "event_type", "batch_size": "CAST(1 AS INT)", "micros": "value"}
    )
    return rounded(summaries.latency_summary(measured))


def weighted_vector_mean(spark, folder):
    df = read(spark, folder, "embeddings").withColumn("weight", F.expr("vec_id % 7 + 1"))
    means = summaries.weighted_vector_mean(df, "embedding", "weight", by=["label"])
    return rounded(means.select("label", F.posexplode("mean").alias("position", "mean")), 5)


def uplink_budget(spark, folder):
    payloads = (
        read(spark, folder, "orders").groupBy("o_orderpriority", "o_custkey").agg((F.count("*") * 1000).alias("parameters"))
    )
    return rounded(summaries.uplink_budget(payloads, 20, by=["o_orderpriority"]))


def cross_domain_metrics(spark, folder):
    predicted = _predictions(spark, folder).select(
        "model", F.when(F.col("protocol") == "clean", "in_domain").otherwise("cross_domain").alias("split"),
        "label", "prediction",
    )
    return rounded(evaluate.cross_domain_metrics(predicted))


def gaussian_nb_params(spark, folder):
    return rounded(evaluate.gaussian_parameters(view(read(spark, folder, "events"), NUMBERS), NUMBER_FEATURES, BINARY_LABEL))


def _matrix(spark, folder):
    """Training and test rows of the numeric view, split by class."""
    df = view(read(spark, folder, "events"), NUMBERS)
    split = stratified_split(df, KEY, BINARY_LABEL)
    rows = evaluate.dealt(evaluate.assemble(split, NUMBER_FEATURES, keep=(KEY, "split"), key=KEY), "matrix")
    return [rows.where(F.col("split") == part).drop("split") for part in (TRAIN, TEST)]


def fit_card(name, spark, folder):
    """Score card of one registered model at its registered settings, with its timings."""
    train, test = _matrix(spark, folder)
    return evaluate.fit_and_score(models.get_model(name), train, test, protocol="numbers", split="random_stratified")


def _facts(runs):
    """What SQL knows of runs: sizes, rows of each class in the confusion, a score above chance.

    Chance is what a constant score has: an area of one half.
    """
    counts = evaluate.confusion(runs.predictions())
    tested = counts.groupBy("model", "protocol", "split").agg(
        *[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"tested_{k}") for k in (0, 1)]
    )
    card = runs.scores().join(tested, ["model", "protocol", "split"], "left")
    return card.select(
        "model", "protocol", "split", "n_train", "n_features", "tested_0", "tested_1",
        F.greatest("tested_0", "tested_1").alias("majority"),
        (F.col("roc_auc") > 0.5).alias("above_chance"), "problem",
    )


def _fit(name):
    """A model's facts, and how many training rows it gets right where it can tell all different rows apart."""

    def query(spark, folder):
        train, test = _matrix(spark, folder)
        runs = evaluate.Runs.start(spark)
        both = [("random_stratified", test), ("training", train)]
        runs.fit(models.get_model(name), train, both, "numbers", "random_stratified")
        facts = _facts(runs)
        hits = runs.predictions().where("split = 'training'").agg(
            F.sum((F.col("label") == F.col("prediction")).cast("bigint")).alias("learnt")
        )
        learnt = F.lit(hits.first().learnt if name == "DecisionTree" else None).cast("bigint")
        return facts.where("split = 'random_stratified'").withColumn("learnt", learnt)

    return query


def fit_gaussian_nb(spark, folder):
    """Log odds and prediction of every test row."""
    train, test = _matrix(spark, folder)
    model = models.get_model("GaussianNB").build(len(NUMBER_FEATURES), 0).fit(train).model
    return rounded(
        test.withColumn("log_odds", model.log_odds(vector_to_array("features"))).select(
            KEY, F.col("label").cast("int").alias("label"), (F.col("log_odds") > 0).cast("int").alias("prediction"), "log_odds"
        )
    )


def _folded(spark, folder, columns):
    df = view(read(spark, folder, "events"), columns)
    return kfold_assign(df, KEY, BINARY_LABEL, n_splits=5, n_repeats=3)


FOLDS = ("fold_0", "fold_1", "fold_2")


def kfold_bayes(spark, folder):
    """Naive Bayes on every fold of every repeat, from one aggregate over all of them."""
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in NUMBER_FEATURES])
    rows = materialise(_folded(spark, folder, NUMBERS).select(*FOLDS, x.alias("x"), F.col(BINARY_LABEL).alias("y")), "folds")
    found = bayes.fold_predictions(rows, list(FOLDS), bayes.fold_models(rows, list(FOLDS), 5))
    predictions = found.select(
        F.lit("bayes").alias("model"), F.concat("repeat", F.lit("")).alias("protocol"),
        F.concat("fold", F.lit("")).alias("split"), F.col("y").alias("label"),
        (F.col("log_odds") > 0).cast("int").alias("prediction"),
    )
    return rounded(metrics.score_table(metrics.classification_metrics(metrics.confusion(predictions))))


def kfold_tokens(spark, folder):
    """Token majorities on every fold of every repeat, from one aggregate."""
    rows = _folded(spark, folder, TRAFFIC)
    return rounded(bayes.fold_token_majorities(rows, list(CATEGORICAL), BINARY_LABEL, list(FOLDS)))


def leaky_vs_clean(spark, folder):
    """All models under both protocols; the leak makes the tree perfect."""
    df = view(read(spark, folder, "events"), TRAFFIC).drop(KEY)
    runs = evaluate.compared([recipes.prepare_readme(df), recipes.prepare_clean(df)])
    leaked = (F.col("model") == "DecisionTree") & (F.col("protocol") == recipes.README)
    hits = runs.predictions().where(leaked).groupBy("model", "protocol").agg(
        F.sum((F.col("label") == F.col("prediction")).cast("bigint")).alias("right")
    )
    return _facts(runs).join(hits, ["model", "protocol"], "left")


def repeated_kfold(spark, folder):
    """All models over all repeats and folds; the mean scores of naive Bayes in full."""
    df = view(read(spark, folder, "events"), NUMBERS)
    prepared = recipes.Prepared(df, NUMBER_FEATURES, "numbers", (), {})
    table = evaluate.repeated_kfold(prepared)
    exact = F.when(F.col("model") == "GaussianNB", F.round("mean", 6))
    inside = (F.col("mean") >= F.col("ci_low")) & (F.col("mean") <= F.col("ci_high"))
    return table.select("model", "protocol", "metric", "n_folds", exact.alias("mean"), inside.alias("inside"))


def lodo_sweep(spark, folder):
    """All models with every device held out in turn."""
    matrix = view(read(spark, folder, "events"), NUMBERS, {DEVICE_COLUMN: PROVENANCE[DEVICE_COLUMN]})
    return _facts(evaluate.swept(matrix, KEY, DEVICES)).drop("above_chance")


def benchmark_sweep(spark, folder):
    """Captures, build, matrix and sweep: the facts of every run, and whether both pivots agree with the scores."""
    df = view(read(spark, folder, "events"), TRAFFIC, CAPTURE)
    dimension = captures.catalogue(spark, captures.device_rows(DEVICES) + captures.attack_rows(ATTACKS))
    runs = benchmark.benchmark_sweep(df, dimension, DEVICES, protocols.CONFIG, key=KEY)
    facts = materialise(_facts(runs).drop("above_chance"), "facts")
    balanced, f1 = benchmark.sweep_pivots(runs.scores(auc=False), DEVICES)
    worst = balanced.select("model", (F.col("worst") <= F.col("mean")).alias("worst_below_mean"))
    pivoted = worst.join(f1.select("model", F.col("mean").isNotNull().alias("f1_known")), "model")
    return facts.join(F.broadcast(pivoted), "model")


def cross_domain(spark, folder):
    """Train all models on events, test on the same columns under foreign names."""
    source = view(read(spark, folder, "events"), NUMBERS)
    target = view(
        read(spark, folder, "orders"),
        {"Shifted": "o_totalprice / 1000", "USER": "CAST(o_custkey AS DOUBLE)", "other": "o_orderkey",
         "label": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END"},
    )
    table = evaluate.cross_domain(source, NUMBER_FEATURES, KEY, target)
    exact = [F.when(F.col("model") == "GaussianNB", F.round(c, 6)).alias(c) for c in (
        "in_domain_accuracy", "cross_domain_accuracy", "cross_domain_attack_recall")]
    drop = F.abs(F.col("in_domain_f1_macro") - F.col("cross_domain_f1_macro") - F.col("f1_macro_drop")) < 1e-9
    return table.select(
        "model", "n_source_test", "n_target", "shared_features", *exact, drop.alias("drop_adds_up"), "problem"
    )


QUERIES = {
    "class_balance": class_balance,
    "classification_metrics": lambda spark, folder: rounded(_scores(spark, folder)),
    "per_class_recall": lambda spark, folder: rounded(metrics.per_class_recall(metrics.confusion(_predictions(spark, folder)))),
    "roc_auc": lambda spark, folder: rounded(metrics.roc_auc(_predictions(spark, folder))),
    "fold_aggregate": lambda spark, folder: rounded(_folds(spark, folder)),
    "formatted_pivot": lambda spark, folder: metrics.formatted_pivot(_folds(spark, folder), ("clean", "readme")),
    "delta_pivot": lambda spark, folder: rounded(metrics.delta_pivot(_scores(spark, folder))),
    "lodo_pivot": lambda spark, folder: rounded(metrics.lodo_pivot(_scores(spark, folder), SPLITS)),
    "score_table": lambda spark, folder: rounded(metrics.score_table(_scores(spark, folder))),
    "last_per_group": lambda spark, folder: summaries.last_per_group(read(spark, folder, "events"), "event_type", "event_id"),
    "latency_summary": latency_summary,
    "weighted_vector_mean": weighted_vector_mean,
    "uplink_budget": uplink_budget,
    "cross_domain_metrics": cross_domain_metrics,
    "gaussian_nb_params": gaussian_nb_params,
    "fit_decision_tree": _fit("DecisionTree"),
    "fit_random_forest": _fit("RandomForest"),
    "fit_gbt": _fit("HistGradientBoosting"),
    "fit_logistic": _fit("LogisticRegression"),
    "fit_gaussian_nb": fit_gaussian_nb,
    "kfold_bayes": kfold_bayes,
    "kfold_tokens": kfold_tokens,
    "fit_mlp": _fit("MLP"),
    "fit_mlp_deep": _fit("DeepMLP"),
    "leaky_vs_clean": leaky_vs_clean,
    "repeated_kfold": repeated_kfold,
    "lodo_sweep": lodo_sweep,
    "benchmark_sweep": benchmark_sweep,
    "lodo_f1_pivot": lambda spark, folder: rounded(
        metrics.lodo_pivot(_scores(spark, folder), SPLITS, "f1_macro", worst=False)
    ),
    "cross_domain": cross_domain,
}

_CONFUSION = f"""predictions AS ({sql('events', PREDICTIONS)}),
confusion AS (SELECT model, protocol, split, label, prediction, count(*) AS n FROM predictions GROUP BY ALL)"""
_METRICS = f"WITH {_CONFUSION}, {s.METRICS}"
_SCORES = ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted")
_ROUNDED = "model, protocol, split, n_test, " + ", ".join(f"round({m}, 6) AS {m}" for m in _SCORES)
_FOLDS = _METRICS + f""", long AS ({' UNION ALL '.join(
    f"SELECT model, protocol, '{m}' AS metric, {m} AS value FROM metrics" for m in ('accuracy', 'balanced_accuracy', 'f1_macro'))}),
folds AS (SELECT model, protocol, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, count(*) AS n_folds
  FROM long GROUP BY ALL),
widths AS (SELECT *, {Z_95}::DOUBLE * std / sqrt(n_folds) AS half_width FROM folds)"""


def _balance(dimension, value):
    return f"""SELECT '{dimension}' AS dimension, {value} AS value, count(*) FILTER (WHERE "Attack_label" = '0') AS n_normal,
count(*) FILTER (WHERE "Attack_label" = '1') AS n_attack, count(*) AS n_rows,
round(avg("Attack_label"::INTEGER), 6) AS attack_rate FROM ({sql('events', TRAFFIC, PROVENANCE)}) GROUP BY {value}"""


def _of(part, metric):
    return f"max(CASE WHEN split = '{part}' THEN {metric} END)"


ORACLES = {
    "class_balance": " UNION ALL ".join(
        [_balance("all", "'all'"), _balance("Attack_type", '"Attack_type"'), _balance("source_device", "source_device"),
         _balance("source_layer", "source_layer")]
    ),
    "classification_metrics": f"{_METRICS} SELECT {_ROUNDED} FROM metrics",
    "per_class_recall": f"""{_METRICS} SELECT model, protocol, split, class::VARCHAR AS class, round(recall, 6) AS recall
FROM rates WHERE support > 0""",
    "roc_auc": f"""WITH predictions AS ({sql('events', PREDICTIONS)}),
ranked AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY model, protocol, split, score) - 1) / 2 AS r
  FROM predictions WINDOW w AS (PARTITION BY model, protocol, split ORDER BY score)),
sums AS (SELECT model, protocol, split, sum(CASE WHEN label = 1 THEN r END) AS rs,
  count(*) FILTER (WHERE label = 1)::DOUBLE AS p, count(*) FILTER (WHERE label = 0)::DOUBLE AS q FROM ranked GROUP BY ALL)
SELECT model, protocol, split, round(CASE WHEN p * q > 0 THEN (rs - p * (p + 1) / 2) / (p * q) END, 6) AS roc_auc FROM sums""",
    "fold_aggregate": f"""{_FOLDS} SELECT model, protocol, metric, round(mean, 6) AS mean, round(std, 6) AS std,
round(mean - half_width, 6) AS ci_low, round(mean + half_width, 6) AS ci_high, round(half_width, 6) AS half_width, n_folds FROM widths""",
    "formatted_pivot": _FOLDS + " SELECT model, " + ", ".join(
        f"max(CASE WHEN protocol = '{p}' THEN printf('%.4f ± %.4f', mean, half_width) END) AS {p}" for p in ("clean", "readme")
    ) + " FROM widths WHERE metric = 'f1_macro' GROUP BY model",
    "delta_pivot": _METRICS + " SELECT model, " + ", ".join(
        f"""round(avg({m}) FILTER (WHERE protocol = 'clean'), 6) AS {m}_clean,
round(avg({m}) FILTER (WHERE protocol = 'readme'), 6) AS {m}_readme,
round(avg({m}) FILTER (WHERE protocol = 'readme') - avg({m}) FILTER (WHERE protocol = 'clean'), 6) AS {m}_delta"""
        for m in ("accuracy", "f1_macro")
    ) + " FROM metrics GROUP BY model",
    "lodo_pivot": _METRICS + ", cells AS (SELECT model, " + ", ".join(
        f"avg(balanced_accuracy) FILTER (WHERE split = '{p}') AS {p}" for p in SPLITS
    ) + " FROM metrics GROUP BY model) SELECT model, " + ", ".join(f"round({p}, 6) AS {p}" for p in SPLITS)
    + f""", round(({' + '.join(SPLITS)}) / {len(SPLITS)}, 6) AS mean, round(least({', '.join(SPLITS)}), 6) AS worst FROM cells""",
    "lodo_f1_pivot": _METRICS + ", cells AS (SELECT model, " + ", ".join(
        f"avg(f1_macro) FILTER (WHERE split = '{p}') AS {p}" for p in SPLITS
    ) + " FROM metrics GROUP BY model) SELECT model, " + ", ".join(f"round({p}, 6) AS {p}" for p in SPLITS)
    + f", round(({' + '.join(SPLITS)}) / {len(SPLITS)}, 6) AS mean FROM cells",
    "score_table": f"{_METRICS} SELECT {_ROUNDED} FROM metrics",
    "last_per_group": "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1",
    "latency_summary": """SELECT event_type AS model, 1 AS batch_size, count(*) AS n,
round(quantile_cont(value, 0.5), 6) AS median_latency_us, round(quantile_cont(value, 0.95), 6) AS p95_latency_us,
round(1e6 / quantile_cont(value, 0.5), 6) AS throughput_per_second FROM events GROUP BY event_type""",
    "weighted_vector_mean": """SELECT label, (p - 1)::INTEGER AS position, round(sum(x::DOUBLE * w) / sum(w), 5) + 0.0 AS mean
FROM (SELECT label, vec_id % 7 + 1 AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)
GROUP BY label, p""",
    "uplink_budget": f"""WITH payloads AS (SELECT o_orderpriority, o_custkey, count(*) * 1000 AS parameters FROM orders GROUP BY ALL),
totals AS (SELECT o_orderpriority, count(*) AS n_clients, sum(parameters)::DOUBLE * 32 AS bits FROM payloads GROUP BY o_orderpriority)
SELECT o_orderpriority, n_clients, backhaul, uplink_kbps::DOUBLE AS uplink_kbps,
round(bits / (uplink_kbps::DOUBLE * 1000), 6) AS seconds_per_round,
round(bits / (uplink_kbps::DOUBLE * 1000) * 20 / 60, 6) AS minutes_full_training
FROM totals, (VALUES {', '.join(f"('{n}', {k})" for n, k in BACKHAUL_KBPS.items())}) AS p(backhaul, uplink_kbps)""",
    "cross_domain_metrics": f"""WITH predictions AS (SELECT model, 'x' AS protocol,
  CASE WHEN protocol = 'clean' THEN 'in_domain' ELSE 'cross_domain' END AS split, label, prediction FROM ({sql('events', PREDICTIONS)})),
confusion AS (SELECT model, protocol, split, label, prediction, count(*) AS n FROM predictions GROUP BY ALL), {s.METRICS},
attacks AS (SELECT model, split, recall AS attack_recall FROM rates WHERE class = 1 AND support > 0)
SELECT model, {_of('in_domain', 'n_test')} AS n_source_test, {_of('cross_domain', 'n_test')} AS n_target,
round({_of('in_domain', 'accuracy')}, 6) AS in_domain_accuracy, round({_of('in_domain', 'f1_macro')}, 6) AS in_domain_f1_macro,
round({_of('cross_domain', 'accuracy')}, 6) AS cross_domain_accuracy,
round({_of('cross_domain', 'balanced_accuracy')}, 6) AS cross_domain_balanced_accuracy,
round({_of('cross_domain', 'f1_macro')}, 6) AS cross_domain_f1_macro,
round({_of('cross_domain', 'attack_recall')}, 6) AS cross_domain_attack_recall,
round({_of('in_domain', 'f1_macro')} - {_of('cross_domain', 'f1_macro')}, 6) AS f1_macro_drop
FROM metrics LEFT JOIN attacks USING (model, split) GROUP BY model""",
    "gaussian_nb_params": " UNION ALL ".join(
        f"""SELECT "Attack_label" AS label, '{f}' AS feature, round(avg("{f}"), 6) AS mean, round(var_pop("{f}"), 6) AS variance,
round(count(*) / (SELECT count(*) FROM events), 6) AS prior FROM ({sql('events', NUMBERS)}) GROUP BY "Attack_label\""""
        for f in NUMBER_FEATURES
    ),
}


_NUMBERS = sql("events", NUMBERS)
_MODELS = [m.name for m in models.MODELS]
_FITS = {
    "fit_decision_tree": "DecisionTree", "fit_random_forest": "RandomForest", "fit_gbt": "HistGradientBoosting",
    "fit_logistic": "LogisticRegression", "fit_mlp": "MLP", "fit_mlp_deep": "DeepMLP",
}
_SUITE = f"(SELECT unnest({_MODELS!r}) AS model)"
_ATTACK = f"starts_with({DEVICE_COLUMN}, '{ATTACK_PREFIX}')"
_X = ", ".join(f'"{f}"' for f in NUMBER_FEATURES)


def _split_rows(base, digits="0.2"):
    """Rows of a base with ``tested`` and the label ``y``, split by class."""
    return f"""SELECT *, "{BINARY_LABEL}"::INTEGER AS y, row_number() OVER (PARTITION BY "{BINARY_LABEL}" ORDER BY {s.digest(KEY)})
  <= round(count(*) OVER (PARTITION BY "{BINARY_LABEL}") * {digits}) AS tested FROM ({base})"""


def _odds(names):
    """Log odds of class 1 from columns m<k>_<i>, v<k>_<i> and c<k> of the training rows."""
    parts = [f"(ln(v0_{i} / v1_{i}) / 2 + power(x.{n} - m0_{i}, 2) / (2 * v0_{i}) - power(x.{n} - m1_{i}, 2) / (2 * v1_{i}))"
             for i, n in enumerate(names)]
    return f"(ln(c1::DOUBLE / c0) + {' + '.join(parts)})"


def _bayes(names, where, by=""):
    """Parameters of naive Bayes over the rows of ``rows`` that satisfy ``where``."""
    items = [f"count(*) FILTER (WHERE y = {k}) AS c{k}" for k in (0, 1)]
    for i, n in enumerate(names):
        for k in (0, 1):
            items += [f"avg({n}) FILTER (WHERE y = {k}) AS m{k}_{i}",
                      f"var_pop({n}) FILTER (WHERE y = {k}) + 1e-9::DOUBLE * var_pop({n}) AS v{k}_{i}"]
    return f"SELECT {by}{', '.join(items)} FROM rows WHERE {where}"


_QUOTED = [f'"{f}"' for f in NUMBER_FEATURES]


def _fold_number(repeat):
    """The fold of a row in a repeat: consecutive parts of its class's hash order."""
    order = f"""row_number() OVER (PARTITION BY "{BINARY_LABEL}" ORDER BY {s.digest(KEY, f'{RANDOM_SEED}:{repeat}')}) - 1"""
    n = f'count(*) OVER (PARTITION BY "{BINARY_LABEL}")'
    return f"""CASE WHEN {order} < ({n} % 5) * ({n} // 5 + 1) THEN ({order}) // ({n} // 5 + 1)
  ELSE ({n} % 5) + ({order} - ({n} % 5) * ({n} // 5 + 1)) // ({n} // 5) END"""


def _folded_rows(base):
    return " UNION ALL ".join(
        f"""SELECT *, "{BINARY_LABEL}"::INTEGER AS y, {r} AS repeat, {_fold_number(r)} AS fold FROM ({base})""" for r in range(3)
    )


_FOLD_BAYES = f"""rows AS ({_folded_rows(_NUMBERS)}),
params AS ({' UNION ALL '.join(
    f"SELECT {f} AS fold, * FROM ({_bayes(_QUOTED, f'fold <> {f}', 'repeat, ')} GROUP BY repeat)" for f in range(5))}),
confusion AS (SELECT 'bayes' AS model, ''||x.repeat AS protocol, ''||x.fold AS split, y AS label,
  ({_odds(_QUOTED)} > 0)::INTEGER AS prediction, count(*) AS n
  FROM rows x JOIN params USING (repeat, fold) GROUP BY ALL), {s.METRICS}"""


def _tested(base, where="tested"):
    return f"""SELECT count(*) FILTER (WHERE NOT ({where})) AS n_train, count(*) FILTER (WHERE {where} AND y = 0) AS tested_0,
  count(*) FILTER (WHERE {where} AND y = 1) AS tested_1 FROM ({base})"""


def _learnt(base):
    """Training rows that a tree without limits gets right: the majority of each different row."""
    return f"""(SELECT sum(greatest(a, b))::BIGINT FROM (SELECT {_X}, count(*) FILTER (WHERE y = 0) AS a,
  count(*) FILTER (WHERE y = 1) AS b FROM ({base}) WHERE NOT tested GROUP BY {_X}))"""


_SPLIT = _split_rows(_NUMBERS)
_COMMON = """n_train::BIGINT AS n_train, {features}::INTEGER AS n_features, tested_0::BIGINT AS tested_0, tested_1::BIGINT AS tested_1,
greatest(tested_0, tested_1)::BIGINT AS majority"""
_SWEEP_BASE = f"""SELECT device, y, {DEVICE_COLUMN} = device OR ({_ATTACK} AND {s.unit(KEY)} < 0.2) AS tested
FROM (SELECT *, "{BINARY_LABEL}"::INTEGER AS y FROM ({sql('events', NUMBERS, {DEVICE_COLUMN: PROVENANCE[DEVICE_COLUMN]})})),
  (SELECT unnest({list(DEVICES)!r}) AS device)"""
ORACLES |= {
    query: f"""SELECT '{name}' AS model, 'numbers' AS protocol, 'random_stratified' AS split,
{_COMMON.format(features=len(NUMBER_FEATURES))}, least(tested_0, tested_1) > 0 AS above_chance, NULL::VARCHAR AS problem,
{_learnt(_SPLIT) if name == 'DecisionTree' else 'NULL::BIGINT'} AS learnt FROM ({_tested(_SPLIT)})"""
    for query, name in _FITS.items()
} | {
    "fit_gaussian_nb": f"""WITH rows AS ({_SPLIT}), params AS ({_bayes(_QUOTED, 'NOT tested')})
SELECT event_id, y AS label, (odds > 0)::INTEGER AS prediction, round(odds, 6) + 0.0 AS log_odds
FROM (SELECT event_id, y, {_odds(_QUOTED)} AS odds FROM rows x, params WHERE tested)""",
    "kfold_bayes": f"WITH {_FOLD_BAYES} SELECT {_ROUNDED} FROM metrics",
    "kfold_tokens": f"""WITH rows AS ({_folded_rows(sql('events', TRAFFIC))}),
long AS ({' UNION ALL '.join(f"SELECT repeat, fold, y, '{c}' AS col, {s.name(c)} AS token FROM rows" for c in CATEGORICAL)}),
folds AS (SELECT unnest(range(5)) AS tested),
mostly AS (SELECT repeat, col, tested, sum(y) * 2 > count(*) AS mostly FROM long, folds WHERE fold <> tested GROUP BY ALL),
votes AS (SELECT repeat, col, token, tested, sum(y) * 2 > count(*) AS vote FROM long, folds WHERE fold <> tested GROUP BY ALL)
SELECT l.repeat::INTEGER AS repeat, l.fold::INTEGER AS fold, l.col AS "column", count(*) AS n_test,
  round(avg((coalesce(vote, mostly)::INTEGER = y)::INTEGER), 6) AS accuracy
FROM long l LEFT JOIN votes v ON l.repeat = v.repeat AND l.col = v.col AND l.fold = v.tested AND l.token IS NOT DISTINCT FROM v.token
JOIN mostly m ON l.repeat = m.repeat AND l.col = m.col AND l.fold = m.tested GROUP BY l.repeat, l.fold, l.col""",
    "leaky_vs_clean": " UNION ALL ".join(
        f"""SELECT model, '{protocol}' AS protocol, 'random_stratified' AS split, {_COMMON.format(features=features)},
least(tested_0, tested_1) > 0 AS above_chance, NULL::VARCHAR AS problem,
CASE WHEN model = 'DecisionTree' AND '{protocol}' = 'readme' THEN (tested_0 + tested_1)::BIGINT END AS right FROM {_SUITE},
(SELECT sum(n - t) AS n_train, max(t) FILTER (WHERE y = 0) AS tested_0, max(t) FILTER (WHERE y = 1) AS tested_1
 FROM (SELECT "{BINARY_LABEL}"::INTEGER AS y, count(*) AS n, round(count(*) * 0.2)::BIGINT AS t FROM ({rows}) GROUP BY 1))"""
        for protocol, rows, features in (
            ("readme", protocols._README_ROWS, len(protocols.NUMBERS) + protocols._N_README),
            ("clean", protocols._CLEAN_ROWS, len(protocols.NUMBERS) + protocols._N_CLEAN),
        )
    ),
    "repeated_kfold": f"""WITH {_FOLD_BAYES}, long AS ({' UNION ALL '.join(
        f"SELECT '{m}' AS metric, {m} AS value FROM metrics" for m in FOLD_METRICS)}),
means AS (SELECT metric, avg(value) AS mean, count(*) AS n FROM long GROUP BY metric)
SELECT model, 'numbers' AS protocol, metric, n AS n_folds, CASE WHEN model = 'GaussianNB' THEN round(mean, 6) END AS mean,
  n > 1 AS inside FROM {_SUITE}, means""",
    "lodo_sweep": f"""SELECT model, 'benchmark' AS protocol, 'lodo_' || device AS split, {_COMMON.format(features=len(NUMBER_FEATURES))},
NULL::VARCHAR AS problem FROM {_SUITE}, (SELECT device, count(*) FILTER (WHERE NOT tested) AS n_train,
  count(*) FILTER (WHERE tested AND y = 0) AS tested_0, count(*) FILTER (WHERE tested AND y = 1) AS tested_1
  FROM ({_SWEEP_BASE}) GROUP BY device)""",
    "benchmark_sweep": f"""WITH built AS ({protocols._BUILD}),
widths AS ({' UNION ALL '.join(
    f"""SELECT CASE WHEN count({s.number(s.name(c))}) >= {NUMERIC_PARSE_RATE} * count(*) THEN 1
  WHEN count(DISTINCT {s.name(c)}) + max(({s.name(c)} IS NULL)::INTEGER) <= {MAX_ONEHOT_CARDINALITY} THEN count(DISTINCT {s.name(c)})
  ELSE 13 END AS w FROM built""" for c in protocols._BUILD_COLUMNS)}),
sides AS (SELECT device, "Attack_label" AS y, source_device = device OR ({_ATTACK} AND {s.unit(KEY)} < 0.2) AS tested
  FROM built, (SELECT unnest({list(DEVICES)!r}) AS device))
SELECT model, 'benchmark' AS protocol, 'lodo_' || device AS split, n_train, (SELECT sum(w) FROM widths)::INTEGER AS n_features,
  tested_0, tested_1, greatest(tested_0, tested_1) AS majority, NULL::VARCHAR AS problem,
  n_train > 0 AS worst_below_mean, tested_1 > 0 AS f1_known
FROM {_SUITE}, (SELECT device, count(*) FILTER (WHERE NOT tested) AS n_train,
  count(*) FILTER (WHERE tested AND y = 0) AS tested_0, count(*) FILTER (WHERE tested AND y = 1) AS tested_1
  FROM sides GROUP BY device)""",
    "cross_domain": f"""WITH rows AS ({_SPLIT}), params AS ({_bayes(['"user"', '"shifted"'], 'NOT tested')}),
source AS (SELECT avg((({_odds(['"user"', '"shifted"'])} > 0)::INTEGER = y)::INTEGER) AS accuracy, count(*) AS n FROM rows x, params WHERE tested),
foreign_rows AS (SELECT o_totalprice / 1000 AS shifted, o_custkey::DOUBLE AS "user", (o_orderstatus = 'F')::INTEGER AS y FROM orders),
target AS (SELECT avg((hit = y)::INTEGER) AS accuracy, avg(hit) FILTER (WHERE y = 1) AS recall, count(*) AS n
  FROM (SELECT y, ({_odds(['"user"', '"shifted"'])} > 0)::INTEGER AS hit FROM foreign_rows x, params))
SELECT model, source.n AS n_source_test, target.n AS n_target, 2::INTEGER AS shared_features,
CASE WHEN model = 'GaussianNB' THEN round(source.accuracy, 6) END AS in_domain_accuracy,
CASE WHEN model = 'GaussianNB' THEN round(target.accuracy, 6) END AS cross_domain_accuracy,
CASE WHEN model = 'GaussianNB' THEN round(target.recall, 6) END AS cross_domain_attack_recall,
source.n > 0 AS drop_adds_up, NULL::VARCHAR AS problem FROM {_SUITE}, source, target""",
}

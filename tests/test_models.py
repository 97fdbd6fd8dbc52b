"""Trees, forests, boosting, naive Bayes and the perceptron against plain versions of themselves."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from labelsieve.plans import bayes, boosting, evaluate, models, perceptron, trees


@pytest.fixture(scope="module")
def table(spark):
    """label, features and row_id from a matrix and labels."""

    def make(x, y, numbered=True):
        rows = [(float(b), a.tolist(), i) for i, (a, b) in enumerate(zip(np.asarray(x, float), y))]
        df = spark.createDataFrame(rows, "label double, x array<double>, row_id bigint")
        return df.select("label", array_to_vector("x").alias("features"), *(["row_id"] if numbered else []))

    return make


def naive_tree(x, y, w, least=1):
    """Nested (feature, threshold, left, right) or the share of label 1, cut by cut."""
    share = (w * y).sum() / w.sum()
    if share in (0.0, 1.0) or len(y) < 2 * least:
        return share
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            t = low + (high - low) / 2
            left = x[:, f] <= t
            if min(left.sum(), (~left).sum()) < least:
                continue
            score = 0.0
            for side in (left, ~left):
                n, k = w[side].sum(), (w * y)[side].sum()
                score += (k**2 + (n - k) ** 2) / n
            score = round(score / w.sum(), 12)
            if best is None or score > best[0]:
                best = score, f, t, left
    if best is None:
        return share
    _, f, t, left = best
    return f, t, naive_tree(x[left], y[left], w[left], least), naive_tree(x[~left], y[~left], w[~left], least)


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    child = tree.left[node]
    return tree.feature[node], tree.threshold[node], nested(tree, child), nested(tree, child + 1)


def same_tree(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[0] == b[0] and a[1] == pytest.approx(b[1]) and same_tree(a[2], b[2]) and same_tree(a[3], b[3])
    return not isinstance(a, tuple) and not isinstance(b, tuple) and a == pytest.approx(b)


def sample(n, seed, noise=0.2):
    draw = np.random.default_rng(seed)
    x = np.stack([draw.integers(0, 6, n), draw.random(n).round(3) * 9, draw.integers(0, 2, n), np.ones(n)], axis=1)
    y = ((x[:, 0] > 2) ^ (x[:, 2] > 0) ^ (draw.random(n) < noise)).astype(float)
    return x, y


def test_tree_is_the_greedy_one():
    for seed, least in ((1, 1), (2, 1), (3, 5)):
        x, y = sample(150, seed)
        weight = np.random.default_rng(seed).integers(1, 4, 150).astype(float)
        for w in (np.ones(150), weight):
            made = trees.grow(x, y, w, trees.Growth(least_rows=least))
            assert same_tree(nested(made), naive_tree(x, y, w, least))


def test_any_depth_and_limits():
    n = 400  # labels alternate along one feature: a tree without a depth limit tells all rows apart
    x, y = np.arange(n, dtype=float)[:, None], np.arange(n) % 2.0
    made = trees.grow(x, y, np.ones(n), trees.Growth())
    packed = made.packed()
    assert (packed[3][trees.leaf_of(packed, x)] == y).all()
    one = trees.grow(x, y, np.ones(n), trees.Growth(max_depth=1))
    assert len(one.feature) == 3
    assert len(trees.grow(x * 0, y, np.ones(n), trees.Growth()).feature) == 1
    assert trees.grow(x, y * 0, np.ones(n), trees.Growth()).value == [0.0]
    drawn = trees.grow(np.hstack([x * 0, x]), y, np.ones(n), trees.Growth(draw=1, seed=5)).packed()
    assert (drawn[3][trees.leaf_of(drawn, np.hstack([x * 0, x]))] == y).all()  # a constant feature is no dead end


def predicted(model, df):
    rows = model.transform(df).select("row_id", "label", "prediction", vector_to_array("probability")[1].alias("p"))
    return {r.row_id: r for r in rows.collect()}


@pytest.mark.parametrize("cells", [1 << 24, 400])
def test_tree_is_perfect_on_distinct_rows(table, cells):
    x, y = sample(900, 4, noise=0.4)
    x[:, 3] = np.arange(900)  # rows differ
    df = table(x, y)
    made = trees.Forest(featuresCol="features", labelCol="label", taskCells=cells).fit(df.repartition(5))
    assert all(r.label == r.prediction and r.p == r.label for r in predicted(made, df).values())


def test_phases_cut_alike(table):
    """With fewer values than bins, the distributed phase cuts as a task does."""
    x, y = sample(600, 6)
    x[:, 1] = x[:, 1].round()
    df = table(x, y)
    options = {"featuresCol": "features", "labelCol": "label", "minInstancesPerNode": 3}
    here = predicted(trees.Forest(**options).fit(df), df)
    phases = predicted(trees.Forest(**options, taskCells=200).fit(df), df)
    assert {i: r.p for i, r in here.items()} == {i: pytest.approx(r.p) for i, r in phases.items()}


def test_forest_depends_on_no_layout(table):
    x, y = sample(500, 7)
    df = table(x, y)
    options = {"featuresCol": "features", "labelCol": "label", "numTrees": 20, "bootstrap": True, "sqrtFeatures": True, "seed": 3, "minInstancesPerNode": 15}
    one = predicted(trees.Forest(**options).fit(df), df)
    two = predicted(trees.Forest(**options).fit(df.repartition(7, F.rand(1))), df)
    assert {i: r.p for i, r in one.items()} == {i: r.p for i, r in two.items()}
    phased = predicted(trees.Forest(**options, taskCells=500).fit(df), df)
    truth = (x[:, 0] > 2) ^ (x[:, 2] > 0)
    for found in (one, phased):
        assert np.mean([found[i].prediction == truth[i] for i in found]) > 0.9
    assert len({r.p for r in one.values()}) > 20
    draws = np.array([trees.drawn(np.arange(4000), t, 3) for t in range(5)])
    assert abs(draws.mean() - 1) < 0.03 and abs(draws.var() - 1) < 0.06 and abs(np.corrcoef(draws[:2])[0, 1]) < 0.05
    unnumbered = trees.Forest(**options).fit(df.drop("row_id"))
    assert unnumbered.transform(df).count() == 500
    with pytest.raises(ValueError):
        trees.Forest(**options).fit(df.where("false"))


def naive_boost(bins, y, watched, how):
    """Margins after boosting, leaf by leaf with sums over rows."""
    train = ~watched
    margin = np.full(len(y), math.log(y[train].sum() / (train.sum() - y[train].sum())))
    losses = [boosting.loss(margin[watched], y[watched])]
    for _ in range(how.rounds):
        g, h = boosting.slopes(margin, y)

        def cut(rows):
            best = (-math.inf, None, None)
            for f in range(bins.shape[1]):
                for b in range(bins[:, f].max() + 1):
                    sides = [rows[bins[rows, f] <= b], rows[bins[rows, f] > b]]
                    if min(map(len, sides)) < how.least_rows or min(h[s].sum() for s in sides) < how.least_hessian:
                        continue
                    gain = sum(g[s].sum() ** 2 / h[s].sum() for s in sides) - g[rows].sum() ** 2 / h[rows].sum()
                    if gain > best[0]:
                        best = (gain, f, b)
            return best

        rows = np.nonzero(train)[0]
        leaves = [(cut(rows), np.arange(len(y)), rows)]
        while len(leaves) < how.leaves:
            at = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
            (gain, f, b), every, rows = leaves[at]
            if not gain > 0:
                break
            parts = [(every[c(bins[every, f], b)], rows[c(bins[rows, f], b)]) for c in (np.less_equal, np.greater)]
            leaves[at : at + 1] = [(cut(r), e, r) for e, r in parts]
        if len(leaves) == 1:
            break
        margin = margin.copy()
        for _, every, rows in leaves:
            margin[every] -= how.rate * g[rows].sum() / h[rows].sum()
        losses.append(boosting.loss(margin[watched], y[watched]))
        if how.holdout and len(losses) > how.patience and min(losses[-how.patience :]) > losses[-how.patience - 1] - how.tolerance:
            break
    return margin, len(losses) - 1


@pytest.mark.parametrize("size", [1 << 28, 10])
def test_boosting_is_the_plain_one(table, size):
    """In one task and as Spark jobs."""
    x, y = sample(500, 11)
    df = table(x, y)
    made = boosting.Booster(
        featuresCol="features", labelCol="label", maxIter=4, maxLeaves=6, minInstancesPerNode=10, seed=2, taskBytes=size
    )
    model = made.fit(df.repartition(3))
    bounds = trees.quantile_bounds(trees.training_rows(df, "features", "label"), boosting.BINS)
    bins = trees.binned(x, bounds)
    margin, rounds = naive_boost(bins, y, boosting.held(np.arange(500), made.how), made.how)
    found = predicted(model, df)
    assert len(model.trees) == rounds == 4
    assert [found[i].p for i in range(500)] == pytest.approx((1 / (1 + np.exp(-margin))).tolist(), abs=1e-9)


def test_boosting_stops_early(table):
    draw = np.random.default_rng(5)
    x, y = draw.random((800, 3)), (draw.random(800) < 0.3).astype(float)  # nothing to learn
    options = {"featuresCol": "features", "labelCol": "label", "patience": 3}
    assert len(boosting.Booster(**options).fit(table(x, y)).trees) < 20
    assert len(boosting.Booster(**options, holdout=0.0, maxIter=30).fit(table(x, y)).trees) == 30
    with pytest.raises(ValueError):
        boosting.Booster(**options).fit(table(x, y * 0))
    few = boosting.Booster(**options).fit(table(x[:30], y[:30]))
    assert few.transform(table(x[:30], y[:30])).count() == 30


def test_boosting_separates(table):
    x, y = sample(2000, 12, noise=0.05)
    df = table(x, y)
    found = predicted(boosting.Booster(featuresCol="features", labelCol="label").fit(df), df)
    assert np.mean([r.label == r.prediction for r in found.values()]) > 0.93


def naive_odds(x, train, y):
    total = 0.0
    a, b = train[y == 0], train[y == 1]
    total += math.log(len(b) / len(a))
    for f in range(train.shape[1]):
        if train[:, f].var() == 0:
            continue
        logs = []
        for side in (a, b):
            v = side[:, f].var() + bayes.SMOOTHING * train[:, f].var()
            logs.append(-0.5 * math.log(2 * math.pi * v) - (x[f] - side[:, f].mean()) ** 2 / (2 * v))
        total += logs[1] - logs[0]
    return total


def test_bayes_is_one_expression(spark, table):
    x, y = sample(400, 9)
    x[:, 1] += 1e6  # far from zero
    df = table(x, y)
    model = bayes.GaussianBayesEstimator(featuresCol="features", labelCol="label").fit(df.repartition(4))
    found = predicted(model, df)
    for i in range(0, 400, 7):
        odds = naive_odds(x[i], x, y)
        assert math.log(found[i].p / (1 - found[i].p)) == pytest.approx(odds, rel=1e-6, abs=1e-6)
        assert found[i].prediction == (odds > 0)
    plan = model.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    with pytest.raises(ValueError):
        bayes.GaussianBayesEstimator(featuresCol="features", labelCol="label").fit(df.where("label = 0"))


def test_folds_from_one_aggregate_are_refits(spark, table):
    x, y = sample(300, 10)
    draw = np.random.default_rng(1)
    folds = [draw.permutation(300) % 5 for _ in range(3)]
    rows = spark.createDataFrame(
        [(a.tolist(), int(b), *map(int, f)) for a, b, *f in zip(x, y, *folds)],
        "x array<double>, y int, fold_0 int, fold_1 int, fold_2 int",
    )
    names = ["fold_0", "fold_1", "fold_2"]
    models = bayes.fold_models(rows, names, 5)
    assert len(models) == 15
    for (repeat, fold), model in models.items():
        again = bayes.fit(rows.where(F.col(names[repeat]) != fold))
        assert model.counts == again.counts and model.used == again.used
        for one, two in ((model.means, again.means), (model.variances, again.variances)):
            assert np.allclose(one, two, rtol=1e-9)
    predicted = bayes.fold_predictions(rows, names, models)
    assert predicted.count() == 900 and predicted.where("log_odds is null").count() == 0


def test_token_majorities_are_refits(spark):
    draw = np.random.default_rng(3)
    rows = [(str(draw.choice(["a", "b", "c", "d", None])), f"t{draw.integers(0, 150)}", int(draw.integers(0, 2)), i % 4, (i * 7) % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "p string, q string, y string, fold_0 int, fold_1 int".replace("y string", "y int"))
    got = {(r.column, r["repeat"], r.fold): (r.n_test, r.accuracy) for r in bayes.fold_token_majorities(df, ["p", "q"], "y", ["fold_0", "fold_1"]).collect()}
    for c, column in enumerate("pq"):
        for repeat in (0, 1):
            for fold in range(4):
                train, test = ([r for r in rows if (r[3 + repeat] == fold) == side] for side in (False, True))
                mostly = sum(r[2] for r in train) * 2 > len(train)
                right = 0
                for r in test:
                    alike = [t[2] for t in train if t[c] == r[c]]
                    right += (sum(alike) * 2 > len(alike) if alike else mostly) == r[2]
                assert got[column, repeat, fold] == (len(test), pytest.approx(right / len(test)))


def test_perceptron_keeps_the_best_round(table):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 4))
    y = (x[:, 0] + draw.normal(size=300) * 1.5 > 0).astype(float)  # soon learnt by heart
    df = table(x, y)
    made = perceptron.WatchedPerceptron(
        featuresCol="features", labelCol="label", layers=[4, 32, 2], maxIter=60, step=5, holdout=0.3, seed=1
    )
    model = made.fit(df)
    assert len(model.losses) < 12  # stopped before 60 iterations
    assert model.best == int(np.argmin(model.losses)) and len(model.losses) == model.best + 1 + made.patience
    row = F.pmod(F.xxhash64("row_id", F.lit(1)), 1000) < 300
    assert perceptron.watched_loss(model.model, df.where(row), "label") == pytest.approx(model.losses[model.best], rel=1e-9)
    assert model.transform(df).count() == 300
    whole = perceptron.WatchedPerceptron(featuresCol="features", labelCol="label", layers=[4, 3, 2], maxIter=3, holdout=0.0)
    assert whole.fit(df).losses == ()


def test_perceptron_trains_as_spark_ml_does_without_its_fit(table, monkeypatch):
    """The weights are those of Spark ML's own training, which sees no more than the row that a model is made with."""
    draw = np.random.default_rng(7)
    x = draw.normal(size=(512, 4))
    y = (np.sin(3 * x[:, 0]) + draw.normal(size=512) * 0.5 > 0).astype(float)
    df, options = table(x, y).coalesce(1), {"layers": [4, 8, 5, 2], "maxIter": 14, "seed": 3}
    theirs = perceptron.MultilayerPerceptronClassifier(**options).fit(df)
    seen, fit = [], perceptron.MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(
        perceptron.MultilayerPerceptronClassifier, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows)
    )
    made = perceptron.WatchedPerceptron(featuresCol="features", labelCol="label", holdout=0.0, **options)
    ours = made.fit(df)
    assert max(seen) == 1
    assert ours.model.weights.toArray() == pytest.approx(theirs.weights.toArray(), rel=1e-6, abs=1e-6)
    first, last = theirs.summary().objectiveHistory[0], theirs.summary().objectiveHistory[-1]
    assert last < first
    blocks = perceptron.packed(df, "features", "label", 4, 2)
    weights = ours.model.weights.toArray()
    found = []
    for tasks, fan in ((1, 64), (5, 64), (5, 2)):  # in one task, in some, and with a stage that adds their sums
        monkeypatch.setattr(perceptron, "FAN", fan)
        found.append(perceptron.Objective(blocks, [4, 8, 5, 2], tasks)(weights))
        assert found[-1][0] == pytest.approx(last, rel=1e-8)
        assert found[-1][1] == pytest.approx(found[0][1], abs=1e-12)


def test_perceptron_refuses_rows_that_tell_nothing(table):
    x, y = np.zeros((20, 2)), np.arange(20) % 2.0
    made = perceptron.WatchedPerceptron(featuresCol="features", labelCol="label", layers=[2, 3, 2], maxIter=2, holdout=0.0)
    for bad in ({"x": np.nan}, {"x": np.inf}, {"y": 2.0}, {"y": 0.5}):
        x_bad, y_bad = x.copy(), y.copy()
        x_bad[7, 1], y_bad[7] = bad.get("x", 0.0), bad.get("y", y[7])
        with pytest.raises(Exception, match="a training row"):
            made.fit(table(x_bad, y_bad))
    with pytest.raises(Exception, match="a training row"):
        made.fit(table(np.zeros((20, 3)), y))


def test_large_forests_stay_a_table(table):
    """A forest too large for the driver scores from its table as a small one does from memory."""
    x, y = sample(500, 11, noise=0.4)
    df = table(x, y)
    options = {"featuresCol": "features", "labelCol": "label", "numTrees": 6, "bootstrap": True, "sqrtFeatures": True, "seed": 3}
    for cells in (1 << 24, 800):  # grown whole, and in phases
        here = trees.Forest(**options, taskCells=cells).fit(df)
        stored = trees.Forest(**options, taskCells=cells, modelBytes=100).fit(df)
        assert isinstance(here, trees.ForestModel) and isinstance(stored, trees.StoredForest)
        assert len(set(stored.cohorts().values())) > 1
        assert not any(len(upper[0]) > 100 for upper in stored.uppers)
        twice = df.union(df.where("row_id < 3"))  # rows that repeat are scored one by one
        assert stored.transform(twice).count() == 503
        found = predicted(stored, df)
        assert {i: r.p for i, r in predicted(here, df).items()} == {i: r.p for i, r in found.items()}
        assert stored.transform(df.where("false")).count() == 0


def test_boosting_in_a_task_moves_every_margin():
    """Margins are moved leaf by leaf, as walking the tree with each row does; bins come from Arrow's buffers."""
    draw = np.random.default_rng(4)
    bins, y = draw.integers(0, 9, (400, 3)).astype(np.uint8), draw.integers(0, 2, 400).astype(float)
    how = boosting.Boosting(leaves=6, least_rows=5, seed=1)
    here = boosting.Here(bins, y, boosting.held(np.arange(400), how), 9, 0.25)
    tree = boosting.best_first(here, how)
    here.add(tree)
    packed = tree.packed()
    assert len(packed[0]) > 5 and (here.margin == 0.25 + packed[3][trees.leaf_of(packed, bins)]).all()
    rows = pa.array([row.tobytes() for row in bins], pa.binary())
    column = pa.chunked_array([rows.slice(30, 50), rows.slice(0, 0), rows.slice(200, 7)])
    assert (boosting.unpacked(column, 3) == np.concatenate([bins[30:80], bins[200:207]])).all()


@pytest.mark.parametrize("cells", [1 << 24, 400])
def test_forest_shuffles_no_row_for_its_trees(table, monkeypatch, cells):
    """Training rows are written once; what the trees are finished from reads them without an exchange."""
    x, y = sample(600, 13)
    plans, write = {}, trees.materialise

    def spied(df, label="frame"):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(trees, "materialise", spied)
    options = {"featuresCol": "features", "labelCol": "label", "numTrees": 5, "bootstrap": True, "taskCells": cells}
    df = table(x, y)
    made = trees.Forest(**options).fit(df)
    assert "Exchange" not in plans["subtrees"]
    score = made.score(x)
    expected = np.zeros(600)
    for tree in range(5):
        packed = trees.grown(trees.Coded.of(x), y, trees.drawn(np.arange(600), tree, 0), trees.Growth())
        expected += packed[3][trees.leaf_of(packed, x)] / 5
    if cells > 400:
        assert score == pytest.approx(expected)
    assert np.corrcoef(score, expected)[0, 1] > 0.8


def test_stored_forests_send_few_copies_of_many_rows():
    """Rows go to one cohort where the model is small beside them, and in parts that keep the tasks busy."""
    sizes = {(tree, 0): 1_000_000 for tree in range(100)}
    made = trees.StoredForest("features", [trees.Tree().packed()] * 100, None, sizes)
    homes, parts = made.layout(30_000_000, 4)
    assert set(homes) == set(sizes) and len(set(homes.values())) == 1 and parts >= trees.SCORERS
    homes, parts = made.layout(10_000, 4)
    assert len(set(homes.values())) * parts >= trees.SCORERS and parts == 1


def test_cells_are_counted_alike_by_number_and_by_order(monkeypatch):
    """The best cuts are the same whether rows are counted in cells or sorted, with keys of 32 bits or of 64."""
    x, y = sample(3000, 14)
    weight = trees.drawn(np.arange(3000), 0, 1)
    coded = trees.Coded.of(np.hstack([x, np.arange(3000.0)[:, None]]))
    for draw in (0, 2):
        counted = trees.grown(coded, y, weight, trees.Growth(draw=draw, seed=1))
        with monkeypatch.context() as patch:
            patch.setattr(trees, "HALF", 0)
            ordered = trees.grown(coded, y, weight, trees.Growth(draw=draw, seed=1))
        for one, two in zip(counted, ordered, strict=True):
            assert len(one) > 100 and (one == two).all()
    for bad in ({"w": 0.5}, {"w": 300.0}, {"y": 2.0}):
        w, label = np.ones(9), np.zeros(9)
        w[3], label[3] = bad.get("w", 1.0), bad.get("y", 0.0)
        with pytest.raises(ValueError):
            trees.grow(x[:9], label, w, trees.Growth())


def test_perceptron_looks_at_no_weights_twice():
    """A round goes on from the loss and slope that the last one ended with."""
    seen = []

    class Bowl:
        def __call__(self, weights):
            seen.append(weights.copy())
            return float(((weights - 3) ** 4).sum()), 4 * (weights - 3) ** 3

        def loss(self, weights):
            return float(((weights - 3) ** 4).sum())

    how = perceptron.Rounds(12, 3, 2, 0.0)
    weights, losses, best = perceptron.trained(Bowl(), Bowl(), np.array([0.0, 1.0]), how)
    assert len(losses) == 4 and losses == sorted(losses, reverse=True) and best == 3
    assert len({w.tobytes() for w in seen}) == len(seen) > 12


def test_perceptron_in_one_task_is_the_distributed_one(table, monkeypatch):
    """Few rows are trained on by one task, with the same weights; predictions are those of Spark ML's model."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(400, 4))
    y = (np.sin(3 * x[:, 0]) + draw.normal(size=400) * 0.5 > 0).astype(float)
    df, options = table(x, y).coalesce(1), {"featuresCol": "features", "labelCol": "label", "layers": [4, 6, 2], "maxIter": 9, "step": 3, "seed": 2}
    spread = perceptron.WatchedPerceptron(**options, allWork=0).fit(df)
    monkeypatch.setattr(perceptron, "Objective", None)
    here = perceptron.WatchedPerceptron(**options).fit(df)
    assert here.losses == pytest.approx(spread.losses, rel=1e-9) and here.best == spread.best
    assert here.model.weights.toArray() == pytest.approx(spread.model.weights.toArray(), rel=1e-7, abs=1e-7)
    theirs, ours = predicted(here.model, df), predicted(here, df)
    assert {i: r.prediction for i, r in ours.items()} == {i: r.prediction for i, r in theirs.items()}
    assert {i: r.p for i, r in ours.items()} == {i: pytest.approx(r.p) for i, r in theirs.items()}


def test_suites_start_perceptrons_first_and_in_one_task(spark, monkeypatch):
    """Beside other fits a perceptron takes its steps in one task up to more work; given settings stay."""
    asked = {}
    monkeypatch.setattr(evaluate, "PARALLEL_FITS", 1)
    monkeypatch.setattr(evaluate, "MOST_FITS", 1)
    monkeypatch.setattr(evaluate.Runs, "try_fit", lambda self, spec, *args, **settings: asked.update({spec.name: settings}))
    jobs = [(models.get_model(n), None, None, "p", "s", {"seed": 1} if n == "MLP" else {}) for n in ["DecisionTree", "MLP", "DeepMLP"]]
    evaluate.Runs.start(spark).fit_all(iter(jobs))
    assert list(asked) == ["MLP", "DeepMLP", "DecisionTree"]
    assert asked == {"MLP": {"allWork": perceptron.ALL_WORK, "seed": 1}, "DeepMLP": {"allWork": perceptron.ALL_WORK}, "DecisionTree": {}}
    monkeypatch.setattr(evaluate, "PARALLEL_FITS", 8)
    evaluate.Runs.start(spark).fit_all(jobs)
    assert asked["MLP"]["allWork"] == 3 * perceptron.ALL_WORK

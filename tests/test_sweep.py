"""Codes of unseen tokens, and the device sweep over a written matrix."""

import numpy as np
from pyspark.sql import DataFrame, functions as F

import pytest

from labelsieve.constants import DEVICE_COLUMN
from labelsieve.functions.hashing import hash_unit
from labelsieve.operators import clients, encoders
from labelsieve.operators.splits import lodo_draw, stratified_split
from labelsieve.plans import benchmark, evaluate, models, trees


def test_codes_are_answered_as_a_tree_answers_them(spark):
    draw = np.random.default_rng(6)
    rows = [
        (i, str(int(y)), f"t{int(draw.integers(0, 60)):03d}" if i % 9 else None, f"u{i:03d}", "same")
        for i, y in enumerate(draw.random(400) < 0.4)
    ]
    df = spark.createDataFrame(rows, "key int, y string, many string, own string, one string")
    got = {r.column: r for r in encoders.encoding_agnostic(df, ["many", "own", "one"], "y", "key").collect()}
    side = {r.key: r.split == "test" for r in stratified_split(df, "key", "y").collect()}
    test = np.array([side[r[0]] for r in rows])
    y = np.array([float(r[1]) for r in rows])
    differ = 0
    for place, column in ((2, "many"), (3, "own"), (4, "one")):
        tokens = ["nan" if r[place] is None else r[place] for r in rows]
        first = list(dict.fromkeys(tokens))
        for name, order in (("label", first), ("ordinal", sorted(set(tokens)))):
            codes = np.array([[float(order.index(t))] for t in tokens])
            packed = trees.grow(codes[~test], y[~test], np.ones((~test).sum()), trees.Growth()).packed()
            answer = packed[3][trees.leaf_of(packed, codes[test])] > 0.5
            assert abs(got[column][name] - (answer == y[test]).mean()) < 1e-12, (column, name)
            differ += got[column][name] != got[column]["onehot"]
    assert differ >= 2 and got["one"]["label"] == got["one"]["onehot"]


def test_sweep_reads_only_the_folders_it_needs(spark, monkeypatch):
    df = spark.range(400).select(
        F.col("id").alias("key"), (F.col("id") % 4 == 0).cast("int").alias("Attack_label"), F.lit("x").alias("Attack_type"),
        F.when(F.col("id") % 4 == 0, "attack:X / y").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("d "), F.col("id") % 2)).alias(DEVICE_COLUMN),
        (F.col("id") % 4).cast("double").alias("f"),
    )
    seen, sides = [], evaluate.sweep_sides
    monkeypatch.setattr(evaluate, "sweep_sides", lambda rows, device: seen.append((device, *sides(rows, device))) or seen[-1][1:])
    runs = evaluate.swept(df, "key", ["d 0", "d 1", "gone"], [models.get_model("DecisionTree")])
    card = {r.split: r for r in runs.scores().collect()}
    assert "absent" in card["lodo_gone"].problem and card["lodo_d 0"].problem is None
    rows = df.collect()
    for device, train, test in seen:
        plan = train._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [" in plan and "attack_drawn" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert len(test.inputFiles()) > 0 and train.count() + test.count() == 400
        assert card[f"lodo_{device}"].n_test == test.count() >= sum(r[DEVICE_COLUMN] == device for r in rows)
        assert card[f"lodo_{device}"].n_train == train.count()


class Broken:
    def __init__(self, **_):
        pass

    def fit(self, df):
        raise ValueError("cannot be fitted")


def test_cross_domain_lists_models_that_failed(spark):
    df = spark.range(200).select(
        F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("Attack_label"), (F.col("id") % 7).cast("double").alias("size")
    )
    target = df.select(F.col("Attack_label").alias("label"), F.col("size").alias("Size"))
    specs = [models.get_model("GaussianNB"), models.Model("Broken", Broken, lambda p, n: {})]
    rows = {r.model: r for r in evaluate.cross_domain(df, ["size"], "key", target, specs).collect()}
    assert set(rows) == {"GaussianNB", "Broken"} and rows["GaussianNB"].problem is None
    assert "cannot be fitted" in rows["Broken"].problem and rows["Broken"].in_domain_accuracy is None


def test_partitioners_check_their_clients(spark, monkeypatch):
    df = spark.range(60).select(
        F.col("id").alias("key"), (F.col("id") % 3 == 0).cast("int").alias("Attack_label"),
        F.when(F.col("id") % 3 == 0, "attack:X").otherwise(F.concat(F.lit("d"), F.col("id") % 2)).alias(DEVICE_COLUMN),
    )
    checked = []
    check = clients.check_partition

    def noted(dealt, names):
        plain = [row.client for row in names.collect()] if isinstance(names, DataFrame) else names
        checked.append(sorted(plain))
        check(dealt, names)

    monkeypatch.setattr(clients, "check_partition", noted)
    clients.partition_iid(df, 3, "key")
    clients.partition_by_device(df, "key")
    clients.partition_by_farm(df, [["d0"], ["d1"]], "key")
    assert checked == [["client_00", "client_01", "client_02"], ["d0", "d1"], ["farm_00", "farm_01"]]
    with pytest.raises(ValueError, match="without rows"):
        check(df.withColumn("client", F.lit("a")), ["a", "b"])
    with pytest.raises(ValueError, match="without rows: \\['b'\\]"):
        check(df.withColumn("client", F.lit("a")), spark.createDataFrame([("a",), ("b",)], "client string"))


def test_a_sample_under_the_draws_hash_keeps_attacks_to_train_on(spark):
    """Sample and draw share a hash; a sample no larger than the draw would be drawn whole."""
    rows = spark.range(4000).select(
        F.col("id").alias("key"), F.when(F.col("id") % 2 == 0, "attack:XSS").otherwise("d0").alias(DEVICE_COLUMN)
    )
    for share in (0.1, 0.5):
        sampled = rows.where(hash_unit("key", 42) < share)
        seed = benchmark.draw_seed(sampled, "key", 0.2, 42, 42)
        assert (seed == 42) == (share > 0.2)  # as before wherever some attack is left
        drawn = lodo_draw(sampled, "key", attack_fraction=0.2, seed=seed).where(F.col(DEVICE_COLUMN) != "d0")
        found = drawn.agg(F.avg(F.col("attack_drawn").cast("int"))).first()[0]
        assert 0.1 < found < 0.5
    assert benchmark.draw_seed(rows, "key", 0.2, 7, 42) == 7
    assert benchmark.draw_seed(rows.where("key % 2 = 1"), "key", 0.2, 42, 42) == 42

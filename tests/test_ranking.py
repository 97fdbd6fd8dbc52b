"""Ranks, splits and deals against brute force, on every internal path."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelsieve import storage
from labelsieve.constants import RANDOM_SEED
from labelsieve.operators import clients, encoders, metrics, ranking, splits, summaries


def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(5000).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    return df.withColumn("source_device", F.when(F.col("y") == 1, "attack:XSS").otherwise(F.concat(F.lit("d"), F.col("id") % 3)))


@pytest.mark.parametrize("sort_rows, inline", [(10**6, 64), (50, 64), (1, 64), (1, 0)])
def test_stratified_split_is_exact(rows, monkeypatch, sort_rows, inline):
    monkeypatch.setattr(ranking, "SORT_ROWS", sort_rows)
    monkeypatch.setattr(ranking, "INLINE_PREFIXES", inline)
    split = splits.stratified_split(rows, "id", "y", test_size=0.3, seed=5)
    got = {r.id for r in split.where("split = 'test'").collect()}
    expected = set()
    for y in (0, 1):
        ids = sorted((i for i in range(5000) if (i % 7 == 0) == bool(y)), key=lambda i: digest(5, i))
        expected |= set(ids[: int(len(ids) * 0.3 + 0.5)])
    assert got == expected


def test_subsample_sizes(rows):
    assert splits.subsample(rows, 123, "id").count() == 123
    assert splits.subsample(rows, 9999, "id").count() == 5000
    with pytest.raises(ValueError):
        splits.subsample(rows, 0, "id")


def test_repeated_key_is_refused(spark, monkeypatch):
    same = spark.range(100).withColumn("id", F.lit(1))
    with pytest.raises(ValueError, match="not unique"):
        splits.subsample(same, 10, "id")
    monkeypatch.setattr(ranking, "SORT_ROWS", 5)
    with pytest.raises(ValueError, match="not unique"):
        splits.subsample(same, 10, "id")


def test_folds_are_even_within_each_class(rows):
    folded = splits.kfold_assign(rows, "id", "y", n_splits=4, n_repeats=2)
    for fold in ("fold_0", "fold_1"):
        sizes = Counter((r.y, r[fold]) for r in folded.collect())
        for y in (0, 1):
            per_fold = [sizes[y, k] for k in range(4)]
            assert max(per_fold) - min(per_fold) <= 1
    assert folded.where("fold_0 <> fold_1").count() > 0


def test_folds_are_checked(rows):
    for options in ({"n_splits": 1}, {"n_repeats": 0}, {"n_splits": 1000}):
        with pytest.raises(ValueError):
            splits.kfold_assign(rows, "id", "y", **options)


@pytest.mark.parametrize("inline", [256, 5])
def test_many_parts(rows, monkeypatch, inline):
    monkeypatch.setattr(ranking, "INLINE_CUTS", inline)
    sizes = clients.label_skew(clients.partition_iid(rows, 40, "id"), "y").collect()
    assert len(sizes) == 40 and sizes[0].client == "client_00" and {r.n_rows for r in sizes} == {125}


@pytest.mark.parametrize("inline", [256, 5])
def test_many_folds(rows, monkeypatch, inline):
    monkeypatch.setattr(ranking, "INLINE_CUTS", inline)
    folded = splits.kfold_assign(rows, "id", "y", n_splits=40, n_repeats=1)
    sizes = folded.groupBy("y", "fold_0").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r.y == label]
        assert len(counts) == 40 and max(counts) - min(counts) <= 1


def dealt_plainly(keys, takers):
    """The taker of each key: the md5 order cut into near-equal parts, larger ones first."""
    order = sorted(keys, key=lambda k: hashlib.md5(f"{RANDOM_SEED}:{k}".encode()).hexdigest())
    size, longer = divmod(len(order), len(takers))
    ends = [size + (i < longer) for i in range(len(takers))]
    names = [name for name, n in zip(takers, ends) for _ in range(n)]
    return dict(zip(order, names))


@pytest.mark.parametrize("n,parts,digits", [(0, 3, 3), (7, 10, 3), (1000, 7, 3), (5000, 5000, 3), (5000, 700, 1)])
def test_deal_equals_plain_cuts(spark, monkeypatch, n, parts, digits):
    monkeypatch.setattr(ranking, "PREFIX_DIGITS", digits)
    monkeypatch.setattr(ranking, "DEALT_TAKERS", 1 if n == 5000 else 16)
    takers = spark.range(parts).select(F.col("id").alias("part"), F.format_string("t%05d", "id").alias("taker"))
    df = spark.range(n).select("id", F.lit(None).cast("string").alias("a.b"))
    dealt = ranking.deal(df, "id", takers, "taker", seed=RANDOM_SEED)
    assert dealt.columns == ["id", "a.b", "taker"]
    expected = dealt_plainly(range(n), [f"t{i:05d}" for i in range(parts)])
    assert {r.id: r.taker for r in dealt.collect()} == expected


def test_deal_refuses_repeated_keys(spark, monkeypatch):
    takers = spark.range(2).select(F.col("id").alias("part"), F.col("id").cast("string").alias("taker"))
    same = spark.range(100).select(F.lit(1).alias("id"))
    with pytest.raises(Exception, match="not unique"):
        ranking.deal(same, "id", takers, "taker", seed=1).collect()
    monkeypatch.setattr(ranking, "SORT_ROWS", 50)
    with pytest.raises(ValueError, match="not unique"):
        ranking.deal(same, "id", takers, "taker", seed=1)


def test_a_hundred_thousand_devices(spark):
    def traffic(devices, rows):
        normal = spark.range(devices).select("id", F.format_string("d%06d", "id").alias("source_device"), F.lit(0).alias("Attack_label"))
        attacks = spark.range(1_000_000, 1_000_000 + rows).select("id", F.lit("attack:X").alias("source_device"), F.lit(1).alias("Attack_label"))
        return normal.unionByName(attacks)

    few = clients.partition_by_device(traffic(10, 1000), "id")
    many = clients.partition_by_device(traffic(100_000, 250_000), "id")
    plans = [len(df._jdf.queryExecution().optimizedPlan().toString()) for df in (few, many)]
    assert abs(plans[0] - plans[1]) < 100
    sizes = many.groupBy("client").agg(F.count_if(F.col("Attack_label") == 1).alias("n")).groupBy("n").count().collect()
    assert {r.n: r["count"] for r in sizes} == {2: 50_000, 3: 50_000}
    assert many.where("client = 'd000000' AND Attack_label = 1").count() == 3


def test_more_parts_than_rows(spark, rows):
    few = rows.where("id < 3")
    assert clients.partition_iid(few, 3, "id").select("client").distinct().count() == 3
    for bad in (0, 4):
        with pytest.raises(ValueError):
            clients.partition_iid(few, bad, "id")


def test_lodo(rows):
    split = splits.lodo_split(rows, "d1", "id", "y")
    assert split.where("source_device = 'd1' AND split <> 'test'").count() == 0
    assert split.where("source_device IN ('d0', 'd2') AND split <> 'train'").count() == 0
    with pytest.raises(ValueError):
        splits.lodo_split(rows, "gone", "id", "y")
    with pytest.raises(ValueError):
        splits.lodo_split(rows.where("y = 0"), "d1", "id", "y")


def test_device_and_farm_clients(rows):
    df = rows.withColumnRenamed("y", "Attack_label")
    by_device = clients.partition_by_device(df, "id")
    shares = {r.client: r.n_attack for r in clients.label_skew(by_device).collect()}
    assert set(shares) == {"d0", "d1", "d2"} and max(shares.values()) - min(shares.values()) <= 1
    farms = clients.partition_by_farm(df, [["d0"], ["d2"]], "id")
    assert farms.where("source_device = 'd1'").count() == 0
    assert {r[0] for r in farms.where("source_device = 'd2'").select("client").distinct().collect()} == {"farm_01"}
    clients.check_partition(farms, ["farm_00", "farm_01"])
    with pytest.raises(ValueError):
        clients.check_partition(farms, ["farm_00", "farm_02"])
    for bad in ([], [[]], [["d0"], ["d0"]], [["nope"]]):
        with pytest.raises(ValueError):
            clients.partition_by_farm(df, bad, "id")
    with pytest.raises(ValueError):
        clients.partition_by_device(df.where("Attack_label = 1"), "id")
    with pytest.raises(KeyError):
        clients.partition_by_device(df.drop("Attack_label"), "id")


def test_capped_sample(rows):
    kept = splits.capped_sample(rows, "source_device", F.when(F.col("source").startswith("d"), 300).otherwise(10**6), "id", seed=3)
    sizes = {r.source: r.n for r in splits.source_counts(kept, "source_device").collect()}
    assert sizes["attack:XSS"] == 715
    expected = sum(1 for i in range(5000) if i % 7 and i % 3 == 0 and int(digest(3, i)[:12], 16) / 16**12 < 300 / 1428)
    assert sizes["d0"] == expected
    unkeyed = splits.capped_sample(rows, "source_device", F.lit(100), seed=3)
    assert 200 < unkeyed.count() < 600


@pytest.mark.parametrize("range_rows", [10**6, 40])
def test_running_totals(spark, monkeypatch, range_rows):
    monkeypatch.setattr(ranking, "RANGE_ROWS", range_rows)
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), (F.col("id") % 2).alias("g"), (F.col("id") % 5).alias("n"))
    got = {(r.g, r.v): r.n_upto for r in ranking.running_totals(df, "v", ["n"], groups=["g"]).collect()}
    data = [(r.g, r.v, r.n) for r in df.collect()]
    assert got == {(g, v): sum(n for h, w, n in data if h == g and w <= v) for g, v, _ in data}


@pytest.mark.parametrize("range_rows", [10**6, 20])
def test_auc_and_percentiles_on_every_path(spark, monkeypatch, range_rows):
    monkeypatch.setattr(ranking, "RANGE_ROWS", range_rows)
    df = spark.range(400).select(
        F.lit("m").alias("model"), (F.col("id") % 2).cast("int").alias("label"),
        ((F.col("id") * 37 % 101 + F.col("id") % 2 * 20) / 10).alias("score"),
    )
    data = [(r.label, r.score) for r in df.collect()]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    wins = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
    auc = metrics.roc_auc(df, by=("model",)).first().roc_auc
    assert abs(auc - wins / (len(pos) * len(neg))) < 1e-12
    assert metrics.roc_auc(df.where("label = 1"), by=("model",)).first().roc_auc is None
    import numpy as np

    row = summaries.percentiles(df, "score", {"a": 0.5, "b": 0.95, "c": 1.0}, by=["model"]).first()
    scores = [s for _, s in data]
    assert np.allclose([row.a, row.b, row.c], [np.percentile(scores, q) for q in (50, 95, 100)])


@pytest.mark.parametrize("bound, share", [(200_000, 1000), (0, 4), (0, 1000)])
def test_lookup_on_every_path(spark, monkeypatch, bound, share):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(storage, "HOT_SHARE", share)
    tokens = ["hot"] * 50 + [f"t{i}" for i in range(30)] + [None] * 3
    df = spark.createDataFrame(list(enumerate(tokens)), "id long, c string")
    codes = {r.id: r.code for r in encoders.encode_label(df, "c", "id").collect()}
    ranks = {r.id: r.ordinal for r in encoders.encode_ordinal(df, "c").collect()}
    shares = {r.id: r.frequency for r in encoders.encode_frequency(df, "c").collect()}
    text = [t or "nan" for t in tokens]
    first = list(dict.fromkeys(text))
    assert codes == {i: float(first.index(t)) for i, t in enumerate(text)}
    assert ranks == {i: float(sorted(first).index(t)) for i, t in enumerate(text)}
    assert shares == {i: text.count(t) / len(text) for i, t in enumerate(text)}


def test_capped_sample_keeps_rows_of_null_sources(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, src string")
    assert splits.capped_sample(df, "src", F.lit(100), "id").count() == 3


def test_folds_refuse_other_labels(rows):
    with pytest.raises(ValueError, match="not 0 or 1"):
        splits.kfold_assign(rows.withColumn("y", F.when(F.col("id") == 3, 2).otherwise(F.col("y"))), "id", "y")


def test_composite_keys_are_framed(spark):
    from labelsieve.functions.hashing import hash_hex

    df = spark.createDataFrame([("a:b", "c"), ("a", "b:c")], "x string, y string")
    assert df.select(hash_hex(["x", "y"], 1).alias("h")).distinct().count() == 2


def test_lodo_draw_tells_every_side(rows):
    drawn = splits.lodo_draw(rows, "id").collect()
    for device in ("d0", "d1"):
        split = {r.id: r.split for r in splits.lodo_split(rows, device, "id", "y").collect()}
        assert split == {r.id: "test" if r.attack_drawn or r.source_device == device else "train" for r in drawn}


def test_running_totals_over_rows(spark, monkeypatch):
    """The order may be a struct, such as a key of several columns, of which some are null."""
    monkeypatch.setattr(ranking, "RANGE_ROWS", 40)
    key = F.struct((F.col("id") % 23).alias("k0"), F.when(F.col("id") % 10 > 0, F.concat(F.lit("t"), "id")).alias("k1"), F.col("id").alias("k2"))
    df = spark.range(1000).select("id", key.alias("v"), (F.col("id") % 5).alias("n"))
    got = {r.id: r.n_upto for r in ranking.running_totals(df, "v", ["n"]).collect()}
    total, expected = 0, {}
    for i in sorted(range(1000), key=lambda i: (i % 23, f"t{i}" if i % 10 else "", i)):
        total += i % 5
        expected[i] = total
    assert got == expected

"""Folded and stateful audits of a stream equal the audit of the whole table."""

import tempfile

import pytest
from pyspark.sql import functions as F

from labelsieve.operators.contingency import contingency, token_purity
from labelsieve.streaming import incremental, tiers

SCHEMA = "y string, t string"


def rows(number):
    return [(str(i % 2), f"t{(i * number) % 5}" if i % 3 else None) for i in range(6)]


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


class Crash(Exception):
    pass


def test_hundred_batches_with_crashes(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="labelsieve-tiers-")
    made = tiers.Tiers(spark, path, fanout=4)
    counted = {n: {} for n in range(100)}
    for n in counted:
        for y, t in rows(n):
            pair = counted[n].setdefault(t or "<NA>", [0, 0])
            pair[int(y)] += 1
    frame = lambda n: spark.createDataFrame(
        [("t", t, a, b) for t, (a, b) in counted[n].items()], tiers.COUNTS
    ).coalesce(1)
    swap, crashes = tiers.Tiers.swap, []

    def failing(self, folders):
        if any(row[1] > 0 for row in folders) and len(crashes) in (0, 2) and folders[-1][1] > 0:
            crashes.append("between merge and swap")
            raise Crash
        if len(crashes) in (1, 3):
            crashes.append("went on")
        swap(self, folders)

    monkeypatch.setattr(tiers.Tiers, "swap", failing)
    for n in range(100):
        try:
            made.add(frame(n), n)
        except Crash:
            made.add(frame(n), n)  # the batch is replayed
            made.fold()
        if n == 50:
            made.add(frame(20), 20)  # an old batch again
    total = {}
    for part in counted.values():
        for t, (a, b) in part.items():
            pair = total.setdefault(t, [0, 0])
            total[t] = [pair[0] + a, pair[1] + b]
    assert len(crashes) == 4
    assert as_set(made.counts()) == sorted((("t", t, a, b) for t, (a, b) in total.items()), key=str)
    _, live = made.manifest()
    assert len(live) <= 3 * 4 and max(row[1] for row in live) == 3  # fewer than 4 folders of 4 levels
    covered = sorted(n for _, _, first, last in live for n in range(first, last + 1))
    assert covered == list(range(100))
    assert made.drop_replaced() > 100
    assert as_set(made.counts()) == sorted((("t", t, a, b) for t, (a, b) in total.items()), key=str)


def test_manifest_without_its_mark_does_not_count(spark):
    path = tempfile.mkdtemp(prefix="labelsieve-tiers-")
    made = tiers.Tiers(spark, path)
    assert made.manifest() == (0, []) and made.counts().collect() == []
    made.add(spark.createDataFrame([("t", "a", 1, 2)], tiers.COUNTS), 0)
    half = spark.createDataFrame([("nowhere", 0, 0, 9)], tiers.MANIFEST).coalesce(1)
    half.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/manifest/7")
    files, place = tiers._files(spark, f"{path}/manifest/7/_SUCCESS")
    files.delete(place, True)
    assert as_set(made.counts()) == [("t", "a", 1, 2)]
    with pytest.raises(ValueError):
        tiers.Tiers(spark, path, fanout=1)


@pytest.mark.parametrize("kind", ["folded", "stateful"])
def test_restarted_streams_equal_the_table(spark, kind):
    data, path, offsets = (tempfile.mkdtemp(prefix="labelsieve-tiers-") + "/x" for _ in range(3))
    start = {"folded": tiers.start_folded_audit, "stateful": tiers.start_stateful_audit}[kind]
    report = {"folded": tiers.folded_audit, "stateful": tiers.stateful_audit}[kind]
    for n in (1, 2, 3):
        spark.createDataFrame(rows(n) * n, SCHEMA).repartition(2).write.mode("append").parquet(data)
        stream = incremental.read_pieces(spark, data, spark.read.parquet(data).schema, files_per_batch=1)
        start(stream, ["t"], "y", path, offsets).awaitTermination()
        whole = spark.read.parquet(data)
        assert as_set(report(spark, path)) == as_set(token_purity(contingency(whole, ["t"], "y")))
    stream = incremental.read_pieces(spark, data, spark.read.parquet(data).schema, files_per_batch=1)
    start(stream, ["t"], "y", path, offsets).awaitTermination()  # nothing new
    assert as_set(report(spark, path)) == as_set(token_purity(contingency(spark.read.parquet(data), ["t"], "y")))


def test_snapshot_takes_the_last_total(spark):
    path = tempfile.mkdtemp(prefix="labelsieve-tiers-")
    for batch, n in ((0, 1), (2, 5), (10, 7)):
        spark.createDataFrame([("t", "a", n, 0)], tiers.COUNTS).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    assert as_set(tiers.snapshot(spark, path).select(F.col("token"), "n0")) == [("a", 7)]

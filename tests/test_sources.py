"""Files in, files out, and the stream."""

import csv
import json
import os
import random

import pytest
from pyspark.sql import Row, functions as F

from labelsieve.functions.columns import strip
from labelsieve.functions.text import derive
from labelsieve.operators import alignment, contingency as c
from labelsieve.plans import benchmark
from labelsieve.sources import captures, tables
from labelsieve.streaming import incremental


def write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as handle:
        handle.write(text)
    return str(path)


def test_strings_keep_their_spelling(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'Attack_label,a.b,c\n0,0,NA\n1,0.0," 0 "\n0,"q""q",\n')
    assert tables.read_header(spark, path) == ["Attack_label", "a.b", "c"]
    rows = [tuple(r) for r in tables.read_strings(spark, path).collect()]
    assert rows == [("0", "0", None), ("1", "0.0", " 0 "), ("0", 'q"q', None)]
    raw = tables.read_strings(spark, path, columns=["c"], missing=False).collect()
    assert raw[0].c == "NA"
    assert tables.read_strings(spark, path, limit=2).count() == 2


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'a,b\n"x\r\ny",1\n')
    assert tables.read_strings(spark, path, multiline=True).collect() == [("x\r\ny", "1")]


@pytest.fixture
def short_ranges(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("seed", range(3))
def test_ranges_equal_one_task(spark, tmp_path, short_ranges, ending, seed):
    draw = random.Random(seed)
    alphabet = ["a", "b c", '""', "\n", "\r\n", ",", "é", "0", "\n\n", "x" * 90]

    def cell():
        kind = draw.random()
        if kind < 0.3:
            return draw.choice(["", "plain", '""', " 0 ", "NA"])
        return '"' + "".join(draw.choices(alphabet, k=draw.randrange(0, 12))) + '"'

    for name in "mn":
        records = [f"{i},{cell()},{cell()}" for i in range(60)]
        write(tmp_path / f"{name}.csv", ending.join(["id,a.b,c", *records]) + draw.choice(["", ending]))
    paths = [str(tmp_path / "m.csv"), str(tmp_path / "n.csv")]
    by_ranges = tables.read_strings(spark, paths, by_ranges=True, missing=False)
    whole = tables.read_strings(spark, paths, multiline=True, missing=False)
    assert by_ranges.columns == whole.columns
    found = by_ranges.collect()
    if ending == "\n":  # with CR LF the one-task reader turns CR LF inside cells into LF
        assert sorted(map(str, found)) == sorted(map(str, whole.collect()))
    plain = []
    for path in paths:
        with open(path, encoding="utf-8", newline="") as handle:
            plain += list(csv.reader(handle))[1:]
    assert sorted(tuple(cell or "" for cell in row) for row in found) == sorted(map(tuple, plain))
    assert len(found) == 120
    assert spark.read.text(paths[0]).rdd.getNumPartitions() > 10
    stems = captures.scan_captures(spark, paths, by_ranges=True).groupBy("capture").count().collect()
    assert {r.capture: r["count"] for r in stems} == {"m": 60, "n": 60}


def test_ranges_are_checked(spark, tmp_path, short_ranges):
    good = write(tmp_path / "g.csv", "\ufeffa,b\n1,2\n\n3\n4,5,6\n" + '"' + "\n" * 200 + '",8\n')
    read = tables.read_strings(spark, good, by_ranges=True)
    assert read.columns == ["a", "b"]
    assert sorted(map(str, read.collect())) == sorted(
        str(Row(a=a, b=b)) for a, b in (("1", "2"), ("3", None), ("4", "5"), ("\n" * 200, "8"))
    )
    whole = tables.read_strings(spark, good, by_ranges=True, skip_ragged=True)
    assert sorted(r.b for r in whole.collect()) == ["2", "8"]
    with pytest.raises(ValueError, match="not balanced"):
        tables.read_strings(spark, write(tmp_path / "u.csv", 'a,b\n1,"2\n'), by_ranges=True)
    other = write(tmp_path / "o.csv", "b,a\n1,2\n")
    with pytest.raises(Exception, match="another header"):
        tables.read_strings(spark, [good, other], by_ranges=True).collect()
    empty = write(tmp_path / "e.csv", "a,b\n")
    assert tables.read_strings(spark, empty, by_ranges=True).count() == 0


def test_header_mark_and_ragged_rows(spark, tmp_path):
    path = write(tmp_path / "r.csv", "﻿a,b\n1,2\n3\n4,5,6\n7,8\n")
    df = tables.read_strings(spark, path, skip_ragged=True)
    assert df.columns == ["a", "b"]
    assert sorted(r.a for r in df.select("a").collect()) == ["1", "7"]
    spaced = write(tmp_path / "s.csv", " a ,b\n1,2\n")
    assert tables.read_strings(spark, spaced, trim_header=True, columns=["a"]).columns == ["a"]


def test_reading_is_checked(spark, tmp_path):
    path = write(tmp_path / "b.csv", "Attack_label,a\nx,1\n")
    with pytest.raises(ValueError, match="absent"):
        tables.read_strings(spark, path, columns=["gone"])
    with pytest.raises(ValueError, match="not numbers"):
        tables.read_strings(spark, path)
    with pytest.raises(Exception):
        tables.read_header(spark, str(tmp_path / "gone.csv"))


def test_row_keys_are_unique(spark, tmp_path):
    path = str(tmp_path / "k")
    spark.range(1000).select((F.col("id") % 3).alias("v")).repartition(4).write.parquet(path)
    df = tables.read_keyed_parquet(spark, path)
    assert df.select("row_key").distinct().count() == 1000


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "n string, v int")
    tables.write_report(df, str(tmp_path / "csv"))
    tables.write_report(df, str(tmp_path / "json"), "json")
    part = [f for f in os.listdir(tmp_path / "json") if f.endswith(".json")]
    assert len(part) == 1 and json.loads((tmp_path / "json" / part[0]).read_text()) == {"n": "a", "v": 1}


@pytest.fixture(scope="module")
def capture_files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("captures")
    head = "frame.time,mqtt.topic,tcp.len,tcp.srcport,Attack_label,Attack_type\n"
    for stem, n in (("phValue", 50), ("Modbus", 400), ("XSS_attack", 30)):
        lines = [f"t{i},{'0.0' if 'attack' in stem else '0'},{i % 3},{i},9,junk\n" for i in range(n)]
        write(folder / f"{stem}.csv", head + "".join(lines))
    write(folder / "Heart_Rate.csv", head)
    return folder


def _build(spark, folder, devices, attacks, **caps):
    paths = [str(folder / f"{stem}.csv") for stem in (*devices, *attacks)]
    dimension = captures.catalogue(spark, captures.device_rows(devices) + captures.attack_rows(attacks))
    config = benchmark.BenchmarkConfig(**caps)
    return benchmark.build_benchmark(captures.scan_captures(spark, paths), dimension, config)


def test_build_from_files(spark, capture_files, tmp_path):
    built = _build(spark, capture_files, ["phValue", "Modbus"], ["XSS_attack"], max_rows_per_device=100)
    sizes = {r.source_device: r["count"] for r in built.groupBy("source_device").count().collect()}
    assert sizes["phValue"] == 50 and sizes["attack:XSS"] == 30 and 60 < sizes["Modbus"] < 150
    assert "frame.time" not in built.columns and "tcp.srcport" in built.columns and "capture" not in built.columns
    row = built.where("source_device = 'attack:XSS'").first()
    assert (row.Attack_label, row.Attack_type, row.source_layer, row["mqtt.topic"]) == (1, "XSS", "adversary", "__absent__")
    assert built.where("source_device = 'Modbus'").first().source_layer == "actuation"
    path = str(tmp_path / "bench")
    tables.write_benchmark(built, path)
    back = tables.read_benchmark(spark, path)
    assert back.count() == built.count() and set(back.columns) == set(built.columns)
    recheck = benchmark.recheck_benchmark(back)
    assert benchmark.acceptance_status(recheck) == 0
    leaky = back.withColumn("mqtt.topic", F.col("source_layer"))
    assert benchmark.acceptance_status(benchmark.recheck_benchmark(leaky)) == 2


def test_build_is_checked(spark, capture_files):
    with pytest.raises(ValueError, match="Heart_Rate"):
        _build(spark, capture_files, ["phValue", "Heart_Rate"], ["XSS_attack"])
    with pytest.raises(ValueError):
        benchmark.BenchmarkConfig(max_rows_per_attack=0)
    with pytest.raises(ValueError):
        captures.device_rows(["Toaster"])
    with pytest.raises(ValueError):
        captures.attack_rows(["nothing"])


def test_foreign_labels(spark):
    values = [" Normal ", "BENIGN", "0.0", "background", "DDoS", None, "0"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, l string")
    labels = [r.label for r in alignment.load_target(df, "l").orderBy("i").collect()]
    assert labels == [0, 0, 0, 0, 1, 1, 0]
    custom = [r.label for r in alignment.load_target(df, "l", attack_values=(" ddos",)).orderBy("i").collect()]
    assert custom == [0, 0, 0, 0, 1, 0, 0]
    with pytest.raises(KeyError):
        alignment.load_target(df, "gone")


def test_feature_names_align():
    assert alignment.shared_features(["TCP Flags", "b"], ["tcp-flags", "c"]) == [("TCP Flags", "tcp-flags")]
    with pytest.raises(ValueError):
        alignment.shared_features(["a"], ["b"])
    with pytest.raises(ValueError):
        alignment.shared_features(["a b", "a-b"], ["a_b"])


def test_strip_equals_python(spark):
    points = [chr(i) for i in range(1, 0x3100)]
    df = spark.createDataFrame([(i, f"{ch}x{ch}") for i, ch in enumerate(points)], "i int, s string")
    got = [r.t for r in df.select("i", strip(F.col("s")).alias("t")).orderBy("i").collect()]
    assert got == [f"{ch}x{ch}".strip() for ch in points]


def test_text_features_of_edge_cases(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "<a1 'é'>"), (3, "🙂🙂ab")], "i int, s string")
    rows = {r.i: r for r in df.select("i", *derive(F.col("s"), "p")).collect()}
    assert rows[0].p__length == 0.0 and rows[0].p__entropy == 0.0 and rows[1].p__alpha_ratio == 0.0
    assert rows[2].p__length == 8.0 and rows[2].p__digit_ratio == 1 / 8 and rows[2].p__punct_ratio == 4 / 8
    assert rows[2].p__has_angle_bracket == rows[2].p__has_quote == rows[2].p__has_whitespace == 1.0
    assert rows[2].p__has_dollar == 0.0 and rows[3].p__length == 4.0 and rows[3].p__entropy == 1.5
    with pytest.raises(ValueError):
        derive(F.col("s"), "")


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    data, counts, offsets = (str(tmp_path / n) for n in ("data", "counts", "offsets"))
    rows = spark.range(300).select(
        (F.col("id") % 2).cast("string").alias("y"), (F.col("id") % 2 * 5 + F.col("id") % 3).cast("string").alias("t")
    )
    for part in range(2):
        rows.where(F.lit(part) == F.col("t").cast("int") % 2).repartition(3).write.mode("append").parquet(data)
        stream = incremental.read_pieces(spark, data, rows.schema, files_per_batch=1)
        incremental.start_audit(stream, ["t"], "y", counts, offsets).awaitTermination()
    assert len([d for d in os.listdir(counts) if d.startswith("batch=")]) == 6
    batch = c.token_purity(c.contingency(rows, ["t"], "y")).collect()
    assert incremental.audit_so_far(spark, counts).collect() == batch
    with pytest.raises(ValueError):
        incremental.read_pieces(spark, data, rows.schema, files_per_batch=0)


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_strings(spark, paths).collect()
    with pytest.raises(Exception, match="(?i)header"):
        captures.scan_captures(spark, paths).collect()


def test_sources_stay_text(spark, tmp_path):
    df = spark.createDataFrame([("0", 1), ("0.0", 2)], "source_device string, v int")
    tables.write_benchmark(df, str(tmp_path / "b"))
    assert sorted(map(tuple, tables.read_benchmark(spark, str(tmp_path / "b")).select("source_device", "v").collect())) == [("0", 1), ("0.0", 2)]


def test_unknown_captures_are_an_error(spark):
    dimension = captures.catalogue(spark, captures.device_rows(["Modbus"]))
    rows = spark.createDataFrame([("Modbus", "1"), ("Other", "2")], "capture string, v string")
    with pytest.raises(Exception, match="no such capture"):
        captures.attribute(rows, dimension).collect()
    assert captures.attribute(rows.where("capture = 'Modbus'"), dimension).first().source_device == "Modbus"

"""The audit on small tables: planted leaks, published counts, bad input."""

import math

import pytest
from pyspark.sql import functions as F

from labelsieve.operators import audit, contingency as c, duplicates, encoders, placeholders, profile


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in columns.items()))


@pytest.fixture(scope="module")
def leaky(spark):
    rows = []
    for i in range(200):
        attack = i % 4 == 0
        rows.append((i, "1" if attack else "0", "0.0" if attack else "0", None if i % 5 == 0 else "x", "a.b"))
    return frame(spark, rows, {"id": "long", "y": "string", "leak.age": "string", "mixed": "string", "one": "string"})


def counts(spark, rows):
    return frame(spark, rows, {"column": "string", "token": "string", "n0": "long", "n1": "long"})


def test_planted_leak_is_found(leaky):
    report = {r["column"]: r for r in audit.audit_columns(leaky, ["leak.age", "mixed", "one", "gone"], "y", "id").collect()}
    assert set(report) == {"leak.age", "mixed", "one"}
    leak = report["leak.age"]
    assert leak.position == 1 and leak.is_fully_separating and leak.single_column_accuracy == 1.0
    assert math.isclose(leak.nmi_with_label, 1.0) and leak.is_provenance_marker and leak.rows_covered == 200
    assert report["mixed"].n_tokens == 2 and report["mixed"].is_provenance_marker is None
    assert report["one"].separation_rate == 0.0 and report["one"].single_column_accuracy == 0.75


def test_summary_puts_the_leak_first(leaky):
    rows = audit.audit_summary(audit.audit_columns(leaky, ["one", "mixed", "leak.age"], "y", "id")).collect()
    assert rows[0]["column"] == "leak.age" and rows[0].provenance_marker is True


def test_audit_without_key_has_no_accuracy(leaky):
    assert audit.audit_column(leaky, "mixed", "y").first().single_column_accuracy is None


def test_audit_rejects_bad_input(spark, leaky):
    with pytest.raises(KeyError):
        audit.audit_column(leaky, "gone", "y", "id")
    with pytest.raises(KeyError):
        audit.audit_columns(leaky, ["one"], "gone", "id")
    bad = leaky.withColumn("y", F.when(F.col("id") == 3, "no").otherwise(F.col("y")))
    for key in ("id", None):
        with pytest.raises(ValueError):
            audit.audit_columns(bad, ["one"], "y", key)
    three = leaky.withColumn("y", (F.col("id") % 3).cast("string"))
    with pytest.raises(ValueError):
        audit.audit_columns(three, ["one"], "y")


def test_single_class_gives_null_accuracy_and_full_information(spark):
    df = frame(spark, [(i, "0", "t") for i in range(10)], {"id": "long", "y": "string", "c": "string"})
    row = audit.audit_column(df, "c", "y", "id").first()
    assert row.single_column_accuracy is None and row.nmi_with_label == 1.0 and row.separation_rate == 1.0


def test_published_spelling_counts(spark):
    """Spelling counts of two published columns, and their verdicts."""
    table = counts(spark, [
        ("dns.qry.name.len", "0", 24272, 0), ("dns.qry.name.len", "0.0", 0, 133272),
        ("http.referer", "0", 0, 30399), ("http.referer", "0.0", 24301, 102810),
        ("one", "0", 5, 5), ("one", "1", 1, 1),
    ])
    rows = {r["column"]: r for r in c.zero_spelling(table).collect()}
    assert set(rows) == {"dns.qry.name.len", "http.referer"}
    assert rows["dns.qry.name.len"].is_provenance_marker and rows["dns.qry.name.len"].rows_covered == 157544
    assert not rows["http.referer"].is_provenance_marker


def test_information_against_direct_formula(spark):
    cells = {"a": (10, 3), "b": (0, 7), "c": (5, 5)}
    row = c.nmi(counts(spark, [("c", t, *n) for t, n in cells.items()])).first()
    total = sum(map(sum, cells.values()))
    label = [sum(n[y] for n in cells.values()) for y in (0, 1)]
    mi = sum(n / total * math.log(n * total / (sum(cells[t]) * label[y])) for t in cells for y, n in enumerate(cells[t]) if n)
    h = -sum(sum(n) / total * math.log(sum(n) / total) for n in cells.values())
    hy = -sum(n / total * math.log(n / total) for n in label)
    assert math.isclose(row.nmi_with_label, mi / ((h + hy) / 2), rel_tol=1e-12)


def test_threshold_is_checked(spark):
    report = c.token_purity(counts(spark, [("a", "x", 999, 0), ("a", "y", 1, 1)]))
    assert c.leaking_columns(report, 0.99).count() == 1 and c.leaking_columns(report).count() == 0
    for bad in (0.0, 1.5):
        with pytest.raises(ValueError):
            c.leaking_columns(report, bad)


def test_unseen_tokens_get_the_training_majority(spark):
    table = frame(spark, [("c", "a", 6, 2, 1, 0), ("c", "new", 1, 1, 1, 1)],
                  {"column": "string", "token": "string", "n0": "long", "n1": "long", "test0": "long", "test1": "long"})
    row = table.groupBy("column").agg(*audit.accuracy_aggregates()).select(audit.held_out_accuracy().alias("a")).first()
    assert row.a == 2 / 3


def test_duplicates_are_null_safe_and_count_contradictions(spark):
    rows = [(None, "a", 0), (None, "a", 0), (None, "a", 1), ("x", None, 0), ("x", "", 0)]
    df = frame(spark, rows, {"p": "string", "q": "string", "y": "int"})
    row = duplicates.duplicate_statistics(df, ("y",)).first()
    assert (row.n_rows, row.exact_duplicate_rows, row.feature_duplicate_rows, row.contradictory_duplicate_rows) == (5, 1, 2, 1)
    assert duplicates.deduplicate(df).count() == 4
    assert duplicates.drop_null_rows(df).count() == 1
    with pytest.raises(ValueError):
        duplicates.duplicate_statistics(df, ("p", "q", "y"))
    empty = duplicates.duplicate_statistics(df.where("false"), ("y",)).first()
    assert empty.n_rows == 0 and empty.exact_duplicate_rate == 0.0


def test_duplicate_fingerprint_merges_zeros(spark):
    df = frame(spark, [(0.0, 1), (-0.0, 1), (float("nan"), 1), (float("nan"), 1)], {"v": "double", "y": "int"})
    assert duplicates.duplicate_statistics(df, ("y",)).first().exact_duplicate_rows == 2


CELLS = ["0", "0.0", "", " ", " nan ", " NULL ", None, "GET", " keep "]


def test_canonicalise_cells(spark):
    df = frame(spark, [(i, v, v) for i, v in enumerate(CELLS)], {"id": "long", "a.b": "string", "c": "string"})
    done = [r["a.b"] for r in placeholders.canonicalise(df, ["a.b", "gone"]).orderBy("id").collect()]
    assert done == ["__absent__"] * 7 + ["GET", " keep "]
    assert [r.c for r in placeholders.canonicalise(df, ["a.b"]).orderBy("id").collect()] == CELLS
    report = placeholders.canonicalise_report(df, ["a.b"]).first()
    assert report.replacements == 7 and report.ambiguous and report.spellings == ["", "0", "0.0", "NULL", "nan"]


def test_canonicalise_keeps_null_unless_empty_is_a_placeholder(spark):
    df = frame(spark, [("0",), (None,)], {"a": "string"})
    assert {r.a for r in placeholders.canonicalise(df, ["a"], tokens=("0",)).collect()} == {"__absent__", None}
    clean = placeholders.canonicalise_report(frame(spark, [("x",)], {"a": "string"}), ["a"]).first()
    assert clean.replacements == 0 and not clean.affected and clean.spellings == []


def test_canonicalise_rejects_bad_tokens(spark):
    df = frame(spark, [("0",)], {"a": "string"})
    with pytest.raises(ValueError):
        placeholders.canonicalise(df, ["a"], tokens=())
    with pytest.raises(ValueError):
        placeholders.canonicalise(df, ["a"], tokens=("0",), sentinel="0")


def test_any_label_audit_trims(spark):
    df = frame(spark, [(" a", "x "), ("a", "x"), ("b", "x"), ("b", "y"), (None, "z")], {"t": "string", "l": "string"})
    row = c.separation_any_label(df, ["t", "gone"], "l").first()
    assert row.rows_separated == 3 and row.n_rows == 5 and not row.fully_separates


@pytest.mark.parametrize("distinct", [1, 3, 16, 17, 40, 3000])
def test_cardinality_limit_is_exact(spark, distinct):
    df = spark.range(6000).select((F.col("id") % distinct).cast("string").alias("a.b"))
    levels = profile.low_cardinality_levels(df, ["a.b"], 16)
    assert ("a.b" in levels) == (distinct <= 16)
    assert len(levels.get("a.b", [])) in (0, distinct)


def test_null_counts_as_a_value(spark):
    df = spark.range(40).select(F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string")).alias("a"))
    assert profile.low_cardinality_levels(df, ["a"], 3) == {}
    assert profile.low_cardinality_levels(df, ["a"], 4) == {"a": ["1", "2", "3", None]}


def test_numbers_are_parsed_as_text_readers_do(spark):
    cells = ["1", " 2.5 ", "1e3", "1d", "1f", "0x10", "NaN", "inf", "", None, ".5", "5.", "1_0"]
    df = frame(spark, [(i, v) for i, v in enumerate(cells)], {"id": "long", "v": "string"})
    from labelsieve.functions.columns import col, numeric

    values = [r.n for r in df.select("id", numeric(col("v")).alias("n")).orderBy("id").collect()]
    assert values == [1.0, 2.5, 1000.0, None, None, None, None, float("inf"), None, None, 0.5, 5.0, None]


def test_model_matrix_checks(spark):
    df = frame(spark, [("1", "Normal", "d", "5", "t")], {"Attack_label": "string", "Attack_type": "string", "source_device": "string", "n": "string", "s": "string"})
    matrix = encoders.model_matrix(df)
    assert matrix.columns == ["Attack_label", "Attack_type", "source_device", "n", "s_t"]
    with pytest.raises(ValueError):
        encoders.model_matrix(df, max_onehot_cardinality=0)
    with pytest.raises(KeyError):
        encoders.model_matrix(df.drop("source_device"))
    with pytest.raises(ValueError):
        encoders.model_matrix(df.drop("n", "s"))


def test_standardise_constant_and_empty(spark):
    df = frame(spark, [(1.0, 2.0), (3.0, 2.0)], {"a": "double", "b": "double"})
    assert sorted(tuple(r) for r in encoders.standardise(df, ["a", "b"]).collect()) == [(-1.0, 0.0), (1.0, 0.0)]
    with pytest.raises(ValueError):
        encoders.standardise(df, ["a"], train=F.lit(False))


def test_other_labels_end_the_audit(spark):
    from labelsieve.operators.contingency import contingency, token_purity

    df = spark.createDataFrame([("a", "0"), ("b", "1"), ("c", None)], "t string, y string")
    with pytest.raises(Exception, match="not 0 or 1: null"):
        token_purity(contingency(df, ["t"], "y")).collect()
    assert token_purity(contingency(df.where("y is not null"), ["t"], "y")).first().n_rows == 2

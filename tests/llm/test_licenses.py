import re

from labelsieve.llm import licenses

GPL = licenses.NOTICES["GPL-3.0-header"]


def test_damaged_and_moved_notices(frame):
    words = GPL.split()
    damaged = " ".join(words[:30] + ["CHANGED"] + words[31:])
    halved = " ".join(words[: len(words) // 2])
    filler = " ".join(f"f{i}" for i in range(777))
    docs = frame([
        (1, filler + " " + GPL + " " + filler), (2, damaged.upper()), (3, halved), (4, None), (5, "MIT"),
        (6, "x. Released under the MIT\nLicense! y"), (7, ""), (None, "Licensed under CC BY-NC 4.0."),
    ])
    got = {(r.doc_id, r.license): r for r in licenses.scan(docs).collect()}
    assert got[1, "GPL-3.0-header"].containment == 1.0
    assert got[1, "GPL-3.0-header"].first_word == 777
    assert got[1, "GPL-3.0-header"].last_word == 777 + len(re.findall(r"\w+", GPL)) - 1
    assert 0.8 <= got[2, "GPL-3.0-header"].containment < 1
    assert (3, "GPL-3.0-header") not in got
    assert {(d, n) for d, n in got if d != 1 and d != 2} == {(6, "MIT"), (None, "CC-BY-NC-4.0")}


def test_many_templates_take_the_same_way(frame, spark, monkeypatch):
    docs = frame([(i, f"{'pad ' * i}{text} tail") for i, text in enumerate(licenses.NOTICES.values())])
    few = sorted(map(tuple, licenses.scan(docs).collect()))
    monkeypatch.setattr(licenses, "LITERAL_SHINGLES", 0)
    assert sorted(map(tuple, licenses.scan(docs).collect())) == few
    assert {row[1] for row in few} == set(licenses.NOTICES)


def test_empty_tables(frame, spark):
    assert licenses.scan(frame([])).collect() == []
    nothing = spark.createDataFrame([(None, None), ("X", "too short")], "license string, text string")
    assert licenses.scan(frame([(1, "some text that is long enough to look at")]), nothing).collect() == []

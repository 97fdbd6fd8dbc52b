import math

import numpy as np
import pytest
import regex
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from labelsieve.llm import quality, toxicity
from labelsieve.llm.queries import op5_quality, op8_toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def accuracy(scored, labels, label):
    both = scored.where("held_out").join(labels, "doc_id")
    return both.agg(
        F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("right"),
        F.avg(F.when(F.col(label) == 1, F.col("predicted"))).alias("found"),
        F.avg(F.when(F.col(label) == 0, F.col("predicted"))).alias("false"),
    ).first()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_quality_of_held_out_rows(spark, labels):
    scored = op5_quality(spark, "/root/testdata/sf0.1")
    seen = accuracy(scored, labels, "quality")
    assert seen.right > 0.98 and seen.found > 0.99
    assert scored.where("score is null or score < 0 or score > 1").count() == 0


def test_toxicity_of_held_out_rows(spark, labels):
    scored = op8_toxicity(spark, "/root/testdata/sf0.1")
    seen = accuracy(scored, labels, "toxic")
    assert seen.right > 0.97 and seen.found > 0.85 and seen.false < 0.01
    assert scored.where("score is null or score < 0 or score > 1").count() == 0


def test_held_out_labels_are_not_learnt(spark, frame, documents, folder):
    docs = frame(documents[:400])
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    turned = labels.withColumn(
        "quality", F.when(F.expr("crc32(string(doc_id)) % 5 = 0"), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    assert quality.fit(docs, labels) == quality.fit(docs, turned)


def test_rules_from_a_printed_tree():
    text = "\n".join([
        "RandomForestClassificationModel: uid=x, numTrees=1", "  Tree 0 (weight 1.0):", "    If (feature 0 <= 0.5)",
        "     If (feature 2 <= 2.5)", "      Predict: 0.0", "     Else (feature 2 > 2.5)", "      Predict: 1.0",
        "    Else (feature 0 > 0.5)", "     Predict: 1.0",
    ])
    a, c = quality.STATISTICS[0], quality.STATISTICS[2]
    assert [r.terms for r in quality.tree_rules(text)] == [
        ((a, False, 0.5),),
        ((c, False, 2.5), (a, False, 0.5)) if c < a else ((a, False, 0.5), (c, False, 2.5)),
        ((a, False, 0.5), (c, True, 2.5)) if a < c else ((c, True, 2.5), (a, False, 0.5)),
        ((a, True, 0.5),),
    ]


def test_no_labels_one_label_and_odd_rows(spark, frame):
    docs = frame([(1, None), (2, ""), (2, ""), (None, "x" * 200_000), (4, "Hello there.")])
    docs = docs.withColumn("quality_score", F.lit(9.0))
    none = spark.createDataFrame([], LABELS)
    one = spark.createDataFrame([(4, 1, 1), (4, 1, 1), (2, 0, 0), (2, 1, 1), (None, 0, 0)], LABELS)
    for labels in (none, one):
        rows = quality.scored(docs, quality.fit(docs, labels)).collect()
        assert len(rows) == 5 and all(0 < r.quality_score < 1 for r in rows)
        rows = toxicity.fit(docs, labels).transform(docs).collect()
        assert len(rows) == 5 and all(0 < r.score < 1 for r in rows)
    model = quality.RuleEnsemble(0.5, ())
    assert quality.scored(frame([]), model).collect() == []


def test_features_of_a_text():
    lexicon = toxicity.Lexicon({"idiot": (9, 0), "begin*": (5, 1)}, 10, 100)
    found = dict(zip(toxicity.FEATURES, toxicity.Measurer(lexicon).features("You idiot! beginning OF 1d10t sooo far")))
    assert found["hits"] == 2 and found["kinds"] == 2 and found["near_you"] == 1.0
    assert found["shouted"] == 0 and found["exclamations"] > 0 and found["stretched"] > 0
    assert found["hidden_hits"] == 1
    own = toxicity.Measurer(lexicon).features("idiot", (1, 0))
    assert own[0] < toxicity.Measurer(lexicon).features("idiot")[0]
    assert toxicity.Measurer(lexicon).features("") == [0.0] * len(toxicity.FEATURES)


def naive_statistics(text):
    """The statistics of a text, character by character and word by word."""
    import unicodedata

    text = text or ""
    java_space = " \t\n\x0b\f\r"
    words, word = [], ""
    for c in text + " ":
        if c in java_space:
            words += [word] if word else []
            word = ""
        else:
            word += c
    kind = [unicodedata.category(c) for c in text]
    n, chars = len(words), len(text)
    over = lambda a, b: a / b if b else 0.0
    symbols = sum(not k.startswith(("L", "N")) and c not in java_space for c, k in zip(text, kind))
    odd = 0
    for w in words:
        tail = 0
        while tail < len(w) and unicodedata.category(w[-1 - tail])[0] not in "LN" and w[-1 - tail] not in ".,;:?'\")]":
            tail += 1
        odd += tail > 0
    repeated, i = 0, 0
    while i + 1 < n:  # pairs do not overlap, and one space lies between
        repeated += words[i] == words[i + 1]
        i += 2 if words[i] == words[i + 1] else 1
    return {
        "log_chars": math.log1p(chars),
        "word_length": over(sum(map(len, words)), n),
        "distinct_share": over(len(set(words)), n),
        "distinct_root": over(len(set(words)), math.sqrt(n)),
        "capital_share": over(sum(k == "Lu" for k in kind), chars),
        "symbol_share": over(symbols, chars),
        "digit_share": over(sum(k.startswith("N") for k in kind), chars),
        "odd_endings": over(odd, n),
        "repeated_next": over(repeated, n),
        "words_a_line": over(n, text.count("\n") + 1),
    }


def test_each_statistic_against_a_loop(frame, documents):
    plain = [(i, t) for i, t in documents if t and not regex.search(r"\s{2}|[^\P{Z} ]", t)][:120]
    texts = plain + [(-1, None), (-2, ""), (-3, "the the the cat $$ sat%% 12³ ½ Ünder (a) b]"), (-4, " x "), (-5, "a\nb\nb")]
    rows = quality.measured(frame(texts), ["doc_id"]).collect()
    assert len(rows) == len(texts) > 50
    for row in rows:
        expected = naive_statistics(dict(texts)[row.doc_id])
        for name in quality.STATISTICS:
            if name == "repeated_next" and "\n" in (dict(texts)[row.doc_id] or ""):
                continue
            assert row[name] == pytest.approx(expected[name], abs=1e-12), (row.doc_id, name)


def test_score_is_the_rules_evaluated_one_by_one(spark, frame, documents, folder):
    docs = frame(documents[:300])
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert len(model.weights) > 1
    measured = {r.doc_id: r for r in quality.measured(docs, ["doc_id"]).collect()}
    for row in quality.scored(docs, model).collect():
        margin = model.intercept
        for rule, weight in model.weights:
            stats = measured[row.doc_id]
            if all(stats[n] > b if above else stats[n] <= b for n, above, b in rule.terms):
                margin += weight
        assert row.quality_score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-12)


def test_lasso_is_at_its_optimum(spark, frame, documents, folder):
    """Slopes of the loss equal the penalty where a weight is not zero, and stay within it elsewhere."""
    docs, labels = frame(documents), spark.read.parquet(f"{folder}/labels.parquet")
    stored = quality.measured(quality.labelled_sample(docs, labels, "quality", 500), ["doc_id", "label"])
    rows = [r.asDict() for r in stored.collect()]
    rules = [quality.Rule(((n, True, float(np.median([r[n] for r in rows]))),)) for n in quality.STATISTICS]
    x = np.array([[float(r[t[0]] > t[2]) for (t,) in (rule.terms for rule in rules)] for r in rows])
    y = np.array([r["label"] for r in rows])
    made = spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y)], "label double, v array<double>")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=0.01, maxIter=300, tol=1e-10, standardization=False)
    model = lasso.fit(made.select("label", array_to_vector("v").alias("features")))
    weights = np.array(model.coefficients)
    slope = x.T @ (1 / (1 + np.exp(-(x @ weights + model.intercept))) - y) / len(y)
    assert (np.abs(slope) <= 0.01 + 1e-4).all() and (weights != 0).any()
    assert np.allclose(slope[weights != 0], -0.01 * np.sign(weights[weights != 0]), atol=1e-4)


def test_sample_is_bounded_by_rows(spark, frame):
    docs = frame([(i % 40, f"text {i} " * 5) for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], LABELS)
    rows = quality.labelled_sample(docs, labels, "quality", 20).collect()
    assert len(rows) == 20 and len({r.doc_id for r in rows}) == 20
    again = quality.labelled_sample(docs.repartition(5, F.rand(2)), labels, "quality", 20).collect()
    assert sorted(rows) == sorted(again)


def naive_features(text, lexicon):
    """The toxicity features, token by token."""
    lower = text.lower()
    words, word = [], ""
    for c in lower + " ":
        if c.isalpha():
            word += c
        else:
            words += [word] if word else []
            word = ""

    def weight(w):
        forms = [w] + [w[:n] + "*" for n in range(4, 9) if n <= len(w)]
        lifts = [
            math.log((lexicon.counts[f][0] + 0.5) / (lexicon.toxic + 1)) - math.log((lexicon.counts[f][1] + 0.5) / (lexicon.other + 1))
            for f in forms if f in lexicon.counts
        ]
        return max([0.0, *lifts])

    strong = sorted((weight(w) for w in set(words) if weight(w) > 0), reverse=True)
    places = [i for i, w in enumerate(words) if weight(w) > 0]
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = [abs(i - j) for i in places for j in you]
    n, chars = len(words), max(1, len(text))
    shouted = 0
    for token in regex.findall(r"\w+", text):
        shouted += len(token) >= 3 and all(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or c in "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ" for c in token)
    marks = sum(not (c.isalnum() or c == "_" or c.isspace()) for c in text)
    return {
        "strongest": strong[0] if strong else 0.0, "second": strong[1] if len(strong) > 1 else 0.0,
        "density": len(places) / max(1, n), "hits": float(len(places)), "kinds": float(len(strong)),
        "weight_a_word": sum(strong) / max(1, n), "near_you": 1 / max(1, min(near)) if near else 0.0,
        "you_share": len(you) / max(1, n), "capitals": sum(c.isupper() for c in text) / chars,
        "shouted": shouted / max(1, n), "exclamations": text.count("!") / chars, "punctuation": marks / chars,
        "log_words": math.log1p(n),
    }


def test_features_against_a_loop(documents):
    lexicon = toxicity.Lexicon({"idiot": (9, 0), "begi*": (5, 1), "the": (1, 0), "stup*": (4, 0)}, 10, 100)
    texts = [t for _, t in documents[:150] if t] + ["", "You IDIOT! " * 80, "beginner, STUPID ÉTÉ a_b", "you " * 3]
    for text in texts:
        found = dict(zip(toxicity.FEATURES, toxicity.Measurer(lexicon).features(text)))
        for name, value in naive_features(text, lexicon).items():
            assert found[name] == pytest.approx(value, abs=1e-12), (name, text[:60])
    many = dict(zip(toxicity.FEATURES, toxicity.Measurer(lexicon).features("you idiot " * 500 + "1d10t " * 90)))
    assert many["hits"] == 500 and many["hidden_hits"] == 90  # not cut off
    assert many["obfuscated"] > 0 and many["stretched"] == 0


def pooled(pairs):
    """Isotonic regression by pooling adjacent violators."""
    groups = {}
    for x, y in pairs:
        groups.setdefault(x, []).append(y)
    blocks = []
    for x in sorted(groups):
        blocks.append([sum(groups[x]), len(groups[x]), [x]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {x: s / n for s, n, xs in blocks for x in xs}


def test_calibration_is_pooling_on_its_own_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    fold = {r.doc_id for r in labels.where("crc32(string(doc_id)) % 5 = 4").collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    raw = toxicity.ToxicityModel(model.lexicon, model.trees, None, model.base)
    some = docs.where(F.col("doc_id").isin(list(fold)))
    scores = {r.doc_id: r.score for r in raw.transform(some).collect()}
    expected = pooled([(s, marks[i]) for i, s in scores.items()])
    got = {r.doc_id: r.score for r in model.transform(some).collect()}
    assert all(got[i] == pytest.approx(expected[scores[i]], abs=1e-9) for i in got)
    # The labels of that fold change neither lexicon nor trees.
    turned = labels.withColumn(
        "toxic", F.when(F.expr("crc32(string(doc_id)) % 5 = 4"), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    other = toxicity.fit(docs, turned)
    assert other.lexicon == model.lexicon and other.trees.toDebugString == model.trees.toDebugString.replace(
        model.trees.uid, other.trees.uid
    )

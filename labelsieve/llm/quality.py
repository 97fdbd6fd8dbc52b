"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees are grown on statistics of labelled texts. Every path from a root
is a conjunctive rule (a few statistics above or below thresholds). A lasso logistic regression
over all rules keeps those that matter, and the survivors
are compiled into one Spark column expression, so scoring is a
projection over the scan: no join, no shuffle, no Python.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.llm.common import computed, held_out, whole_text
from labelsieve.storage import materialise

#: Labelled rows that a fit uses at most, the ones with the smallest hashes of their id.
SAMPLE = 20_000
TREES, DEPTH = 16, 3
LASSO = 0.001
KEEP = 0.3


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the STATISTICS of each whole text; 0 where there is nothing to count."""
    words = F.filter(F.split(whole_text("text"), r"\s+"), lambda w: w != "")
    split = computed(docs, [*keep, whole_text("text").alias("__text")], __words=words)
    text, n_words = F.col("__text"), F.size("__words")
    chars, distinct = F.length(text), F.size(F.array_distinct("__words"))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    def over(part: Column, base: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), base.cast("double")), F.lit(0.0))

    return computed(
        split,
        keep,
        log_chars=F.log1p(chars.cast("double")),
        word_length=over(count(r"\S"), n_words),
        distinct_share=over(distinct, n_words),
        distinct_root=over(distinct, F.sqrt(n_words.cast("double"))),
        capital_share=over(count(r"\p{Lu}"), chars),
        symbol_share=over(count(r"[^\p{L}\p{N}\s]"), chars),
        digit_share=over(count(r"\p{N}"), chars),
        odd_endings=over(count(r"[^\p{L}\p{N}\s.,;:?'\")\]]+(?=\s|$)"), n_words),
        repeated_next=over(count(r"(?<!\S)(\S+) \1(?!\S)"), n_words),
        words_a_line=over(n_words, count(r"\n") + 1),
    )


STATISTICS = (
    "log_chars", "word_length", "distinct_share", "distinct_root", "capital_share",
    "symbol_share", "digit_share", "odd_endings", "repeated_next", "words_a_line",
)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        made = F.lit(True)
        for name, above, bound in self.terms:
            made &= F.col(name) > bound if above else F.col(name) <= bound
        return made


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1, over columns named as STATISTICS."""
        margin = F.lit(self.intercept)
        for rule, weight in self.weights:
            margin += F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-margin))


def tree_rules(description: str) -> list[Rule]:
    """The paths to all nodes of an ensemble, from its printed form."""
    rules: dict[Rule, None] = {}
    path: list[tuple[int, tuple[str, bool, float]]] = []
    for line in description.splitlines():
        depth = len(line) - len(line.lstrip())
        if re.match(r"\s*Tree \d+", line):
            path = []
        found = re.search(r"(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if not found:
            continue
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (STATISTICS[int(found[1])], found[2] == ">", float(found[3]))))
        rules[Rule(_simplified(tuple(term for _, term in path)))] = None
    return [*rules]


def _simplified(terms) -> tuple:
    """The tightest bound for each statistic and side, in one order."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, above, bound in terms:
        tighter = max if above else min
        bounds[name, above] = tighter(bound, bounds.get((name, above), bound))
    return tuple((name, above, bounds[name, above]) for name, above in sorted(bounds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """``doc_id``, ``text``, ``label`` of at most ``limit`` labelled documents outside the held-out fold.

    Ids with the smallest hashes are taken; of an id's several texts the one of the smallest hash. Ids
    without a label, or with labels that disagree, are left out. The ids are broadcast: there are at
    most ``limit``.
    """
    chosen = (
        labels.where(~held_out("doc_id") & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("low"), F.max(label).alias("high"))
        .where((F.col("low") == F.col("high")) & F.col("low").isin(0, 1))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
        .select("doc_id", F.col("low").cast("double").alias("label"))
    )
    text = whole_text("text")
    return (
        docs.select("doc_id", F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("one"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("one").alias("one"))
        .select("doc_id", F.col("one.text").alias("text"), "label")
    )


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Grow trees on a bounded sample of labelled rows, and weigh their paths by lasso.

    Without rows of both labels the score is the smoothed share of label 1.
    """
    rows = labelled_sample(docs, labels, label, sample)
    # At most `sample` rows of a few numbers: one ordered partition makes the fit repeatable.
    stored = materialise(measured(rows, ["doc_id", "label"]), "quality-sample").coalesce(1)
    ordered = stored.sortWithinPartitions("doc_id", *STATISTICS)
    counts = {r.label: r["count"] for r in ordered.groupBy("label").count().collect()}
    ones, zeros = counts.get(1.0, 0), counts.get(0.0, 0)
    if not ones or not zeros:
        return RuleEnsemble(math.log((ones + 0.5) / (zeros + 0.5)), ())
    vectors = ordered.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="onethird", seed=7
    ).fit(vectors)
    rules = tree_rules(forest.toDebugString)
    held = F.array(*[rule.column().cast("double") for rule in rules]) if rules else F.array(F.lit(0.0))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60)
    model = lasso.fit(ordered.select("label", array_to_vector(held).alias("features")))
    weights = [(r, float(w)) for r, w in zip(rules, model.coefficients) if w]
    return RuleEnsemble(float(model.intercept), tuple(weights))


def scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """The documents with ``quality_score`` (0 to 1). Null texts are scored as empty ones.

    Rows, ties and repeats stay as they are; a column of that name is replaced.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "quality_score"]
    packed = docs.select(F.struct(*columns).alias("__row"), "text")
    found = measured(packed, ["__row"])
    return found.select("__row.*", model.score().alias("quality_score"))

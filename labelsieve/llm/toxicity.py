"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learnt from labelled texts, with the log
of how much likelier each is in toxic ones. Features are lexicon densities and strengths,
closeness of lexicon words to second-person words, and rates of capitals, punctuation and
obfuscation. A training row's own counts are taken out of the lexicon when its features are
computed, so the trees don't learn to trust words seen once. One fold is kept from lexicon and
trees; the calibration is learnt on it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from labelsieve.llm.common import fold, per_document
from labelsieve.llm.quality import labelled_sample
from labelsieve.storage import materialise

#: Labelled rows that a fit uses at most.
SAMPLE = 20_000
#: Entries of the lexicon, and toxic texts an entry must be in.
ENTRIES, SUPPORT = 1_000, 3
LEAST_LIFT = 4.0
BEGINNINGS = range(4, 9)
#: Of the folds 1 to 4 that may be learnt from, the one kept for calibration.
CALIBRATION_FOLD = 4
ROUNDS, DEPTH = 30, 3

# Second-person words of the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur tu te ton ta tes toi vous votre vos du dich dir dein deine "
    "euch ihr usted ustedes ti tú vosotros tuyo".split()
)
_TOKEN = re.compile(r"\S+")
_PLAIN = re.compile(r"[^\W\d_]+")
_LEET = str.maketrans("0134578@$!|", "oieastbasil")
_OBFUSCATED = re.compile(r"[^\W\d_][\d@$*|]+[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")

FEATURES = (
    "strongest", "second", "density", "hits", "kinds", "weight_a_word", "near_you", "you_share",
    "capitals", "shouted", "exclamations", "punctuation", "obfuscated", "stretched", "hidden_hits", "log_words",
)


@dataclass(frozen=True)
class Lexicon:
    """Toxic and other texts with each entry; ``word`` or ``begin*``."""

    counts: dict[str, tuple[int, int]]
    toxic: int
    other: int

    def weight(self, entry: str, minus: tuple[int, int] = (0, 0)) -> float:
        found = self.counts.get(entry)
        if found is None:
            return 0.0
        return log_lift(found[0] - minus[0], found[1] - minus[1], self.toxic - minus[0], self.other - minus[1])


def log_lift(toxic: int, other: int, all_toxic: int, all_other: int) -> float:
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((other + 0.5) / (all_other + 1))


def entries_of(word: str) -> list[str]:
    return [word, *[word[:n] + "*" for n in BEGINNINGS if n <= len(word)]]


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Count entries in labelled texts; keep the ENTRIES most telling ones."""

    def count(batches):
        toxic, other, sizes = Counter(), Counter(), [0, 0]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(_PLAIN.findall(text.lower()))
                seen = {e for w in words for e in entries_of(w)}
                (toxic if label else other).update(seen)
                sizes[0 if label else 1] += 1
        every = [*(toxic.keys() | other.keys()), ""]
        toxic[""], other[""] = sizes
        yield pa.RecordBatch.from_pydict(
            {
                "entry": pa.array(every, pa.string()),
                "toxic": pa.array([toxic[e] for e in every], pa.int64()),
                "other": pa.array([other[e] for e in every], pa.int64()),
            }
        )

    counted = materialise(
        rows.select("text", "label")
        .mapInArrow(count, "entry string, toxic bigint, other bigint")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where((F.col("toxic") >= SUPPORT) | (F.col("entry") == "")),
        "lexicon",
    )
    sizes = counted.where("entry = ''").first()
    toxic, other = (sizes.toxic, sizes.other) if sizes else (0, 0)
    lift = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("other") + 0.5) / (other + 1))
    kept = (
        counted.where(F.col("entry") != "")
        .withColumn("lift", lift)
        .where(F.col("lift") >= LEAST_LIFT)
        .orderBy(F.desc(F.log("lift") * F.col("toxic")), "entry")
        .limit(ENTRIES)  # the size of the lexicon
        .collect()
    )
    return Lexicon({r.entry: (r.toxic, r.other) for r in kept}, toxic, other)


class Measurer:
    """Features of texts. Remembers the weights of words, up to a fixed number."""

    def __init__(self, lexicon: Lexicon, remembered: int = 500_000) -> None:
        self.lexicon, self.remembered = lexicon, remembered
        self._weights: dict[str, float] = {}

    def weight(self, word: str, minus: tuple[int, int]) -> float:
        """The largest log lift of the word and its beginnings; 0 outside the lexicon."""
        if minus != (0, 0):
            return max(0.0, *[self.lexicon.weight(e, minus) for e in entries_of(word)])
        known = self._weights.get(word)
        if known is None:
            if len(self._weights) >= self.remembered:
                self._weights.clear()
            known = max(0.0, *[self.lexicon.weight(e) for e in entries_of(word)])
            self._weights[word] = known
        return known

    def features(self, text: str, minus: tuple[int, int] = (0, 0)) -> list[float]:
        lower = text.lower()
        words = _PLAIN.findall(lower)
        n, chars = len(words), max(1, len(text))
        distinct = set(words)
        strong = {w: v for w in distinct if (v := self.weight(w, minus)) > 0}
        found = sorted(strong.values(), reverse=True)
        places = [i for i, w in enumerate(words) if w in strong] if strong else []
        you = [i for i, w in enumerate(words) if w in SECOND_PERSON] if distinct & SECOND_PERSON else []
        hidden = 0
        obfuscated = _OBFUSCATED.findall(lower)
        if obfuscated:
            for token in _TOKEN.findall(lower):
                if _OBFUSCATED.search(token):
                    plain = re.sub(r"[^\w]|\d|_", "", token.translate(_LEET))
                    hidden += self.weight(plain, minus) > 0
        capitals = sum(map(str.isupper, text)) if not text.isascii() else len(_CAPITALS.findall(text))
        return [
            found[0] if found else 0.0,
            found[1] if len(found) > 1 else 0.0,
            len(places) / max(1, n),
            float(len(places)),
            float(len(found)),
            sum(found) / max(1, n),
            _closeness(places, you),
            len(you) / max(1, n),
            capitals / chars,
            len(_SHOUTED.findall(text)) / max(1, n),
            text.count("!") / chars,
            len(_MARKS.findall(text)) / chars,
            len(obfuscated) / max(1, n),
            len(_STRETCHED.findall(lower)) / max(1, n),
            float(hidden),
            math.log1p(n),
        ]


_CAPITALS = re.compile(r"[A-Z]")
_SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_MARKS = re.compile(r"[^\w\s]")


def _closeness(places: list[int], you: list[int]) -> float:
    """1 / distance of the closest lexicon and second-person words; 0 if either is missing."""
    if not places or not you:
        return 0.0
    at = np.searchsorted(you, places)
    ends = np.array([-(1 << 60), *you, 1 << 60], dtype=np.int64)
    spots = np.array(places, dtype=np.int64)
    near = np.minimum(spots - ends[at], ends[at + 1] - spots)
    return 1.0 / max(1, int(near.min()))


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: Model | None
    calibration: Model | None
    base: float

    def transform(self, docs: DataFrame, carry=None) -> DataFrame:
        """Carried columns (doc_id) and ``score`` (0 to 1). Null texts are scored as empty ones."""
        spread = docs.sparkSession.sparkContext.broadcast(self.lexicon)

        def work(texts: list[str]) -> list:
            measurer = _measurer(spread)
            return [[measurer.features(text) for text in texts]]

        measured = per_document(docs, work, "measured array<double>", carry=carry, binary=False)
        kept = measured.drop("measured").columns
        if self.trees is None:
            return measured.select(*kept, F.lit(self.base).alias("score"))
        return self._scores(measured).select(*kept, "score")

    def _scores(self, measured: DataFrame) -> DataFrame:
        made = self.trees.transform(measured.withColumn("features", array_to_vector("measured")))
        made = made.withColumn("raw", vector_to_array("probability")[1])
        if self.calibration is None:
            return made.withColumn("score", F.col("raw"))
        ready = made.drop("prediction").withColumn("raw_vector", array_to_vector(F.array("raw")))
        return self.calibration.transform(ready).withColumn(
            "score", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0))
        )


_MEASURERS: dict[int, Measurer] = {}


def _measurer(spread) -> Measurer:
    """One Measurer for each lexicon that a worker meets, the last one only."""
    found = _MEASURERS.get(id(spread.value))
    if found is None:
        _MEASURERS.clear()
        found = _MEASURERS[id(spread.value)] = Measurer(spread.value)
    return found


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learn lexicon, trees and calibration from a bounded sample of labelled rows.

    Rows of the held-out fold are never used, and those of the calibration fold for nothing else,
    unless the other folds lack a label; then there is no calibration. Without rows of both labels the
    score is the smoothed share of label 1.
    """
    sampled = labelled_sample(docs, labels, label, sample).withColumn("apart", fold("doc_id") == CALIBRATION_FOLD)
    rows = materialise(sampled, "toxicity-sample")
    if rows.where("not apart").select("label").distinct().count() < 2:
        rows = rows.withColumn("apart", F.lit(False))
    lexicon = learn_lexicon(rows.where("not apart"))
    spread = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches):
        for batch in batches:
            measurer = Measurer(spread.value)
            texts, marks, apart = (batch.column(c).to_pylist() for c in ("text", "label", "apart"))
            own = [(0, 0) if a else (1, 0) if y else (0, 1) for y, a in zip(marks, apart, strict=True)]
            made = [measurer.features(t, o) for t, o in zip(texts, own, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("label"),
                    batch.column("apart"),
                    pa.array(made, pa.list_(pa.float64())),
                ],
                names=["doc_id", "label", "apart", "measured"],
            )

    measured = rows.select("doc_id", "label", "apart", "text").mapInArrow(
        measure, "doc_id bigint, label double, apart boolean, measured array<double>"
    )
    # At most `sample` rows of a few numbers: one ordered partition makes the fit repeatable.
    stored = materialise(measured, "toxicity-features").coalesce(1).sortWithinPartitions("doc_id", "measured")
    counts = {r.label: r["count"] for r in stored.groupBy("label").count().collect()}
    ones, zeros = counts.get(1.0, 0), counts.get(0.0, 0)
    base = (ones + 0.5) / (ones + zeros + 1)
    if not ones or not zeros:
        return ToxicityModel(lexicon, None, None, base)
    ready = stored.withColumn("features", array_to_vector("measured"))
    trees = GBTClassifier(
        maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.2, maxBins=64, seed=7
    ).fit(ready.where("not apart").select("label", "features"))
    uncalibrated = ToxicityModel(lexicon, trees, None, base)
    held = uncalibrated._scores(stored.where("apart"))
    if len(held.select("label").distinct().take(2)) < 2:
        return uncalibrated
    isotonic = IsotonicRegression(
        featuresCol="raw_vector", labelCol="label", predictionCol="calibrated"
    ).fit(held.select("label", array_to_vector(F.array("raw")).alias("raw_vector")))
    return ToxicityModel(lexicon, trees, isotonic, base)

"""The model suite: estimators and the settings they train with.

Logistic regression and the perceptron's rounds are Spark ML's; trees, boosting and naive Bayes are this
library's own.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler

from labelsieve.constants import RANDOM_SEED
from labelsieve.plans.bayes import GaussianBayesEstimator
from labelsieve.plans.boosting import Booster
from labelsieve.plans.perceptron import WatchedPerceptron
from labelsieve.plans.trees import Forest

FEATURES, LABEL, SCALED = "features", "label", "scaled"
#: Rows that a leaf of a tree or forest keeps at least.
LEAF_ROWS = 1


@dataclass(frozen=True)
class Model:
    """An estimator class, its settings for a training set, and its use.

    ``settings`` maps the number of features and of rows to estimator
    parameters. A ``scaled`` model gets standardised features; an ``edge``
    model is one a gateway could run.
    """

    name: str
    estimator: type
    settings: Callable[[int, int], dict]
    scaled: bool = False
    edge: bool = True

    def build(self, n_features: int, n_rows: int, **overrides):
        """A fresh, unfitted estimator: fit() gives a model, whose transform() adds predictions."""
        column = SCALED if self.scaled else FEATURES
        parameters = {**self.settings(n_features, n_rows), **overrides}
        estimator = self.estimator(featuresCol=column, labelCol=LABEL, **parameters)
        return Scaled(estimator) if self.scaled else estimator


@dataclass
class Scaled:
    """Standardises features before an estimator, and before its model."""

    estimator: object
    scaler: object = None

    def fit(self, df):
        scaler = StandardScaler(inputCol=FEATURES, outputCol=SCALED, withMean=True).fit(df)
        return Scaled(self.estimator.fit(scaler.transform(df)), scaler)

    def transform(self, df):
        return self.estimator.transform(self.scaler.transform(df))

    def getStages(self):
        return [self.estimator]


def full_depth(n_features: int, n_rows: int) -> dict:
    """A tree that grows until its leaves are pure or their rows alike, however deep.

    Large trees stay a table; ``minInstancesPerNode`` makes smaller ones, and none is derived from the data.
    """
    return {"minInstancesPerNode": LEAF_ROWS, "seed": RANDOM_SEED}


def hidden_layers(*widths: int):
    def settings(n_features: int, n_rows: int) -> dict:
        return {"layers": [n_features, *widths, 2], "maxIter": 60, "seed": RANDOM_SEED}

    return settings


MODELS = (
    Model("DecisionTree", Forest, full_depth),
    Model(
        "RandomForest", Forest,
        lambda p, n: {"numTrees": 100, "bootstrap": True, "sqrtFeatures": True, **full_depth(p, n)},
    ),
    Model("HistGradientBoosting", Booster, lambda p, n: {"maxIter": 100, "stepSize": 0.1, "seed": RANDOM_SEED}),
    # A penalty of C = 1 on the summed loss is 1/n on the mean loss.
    Model(
        "LogisticRegression", LogisticRegression,
        lambda p, n: {"maxIter": 1000, "regParam": 1.0 / max(n, 1), "standardization": False}, scaled=True,
    ),
    Model("GaussianNB", GaussianBayesEstimator, lambda p, n: {}),
    Model("MLP", WatchedPerceptron, hidden_layers(64, 32), scaled=True, edge=False),
)
DEEP_MLP = Model("DeepMLP", WatchedPerceptron, hidden_layers(256, 128, 64), scaled=True, edge=False)


def get_model(name: str) -> Model:
    by_name = {model.name: model for model in (*MODELS, DEEP_MLP)}
    if name not in by_name:
        raise ValueError(f"unknown model {name!r}; known are {sorted(by_name)}")
    return by_name[name]


def edge_models() -> list[Model]:
    return [model for model in MODELS if model.edge]

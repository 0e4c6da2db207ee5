"""Components a candidate may use: `pyspark.ml` estimators and transformers by dotted name.

Names resolve through this table only; nothing is imported on request.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import classification, feature, regression

from loomwork.operators.tagging import MODEL, TRANSFORM

# input kinds: a vector of all columns, numeric columns, string columns
VECTOR, NUMBERS, STRINGS = "vector", "numbers", "strings"


@dataclass(frozen=True)
class Component:
    name: str
    role: str
    build: Callable
    takes: str = VECTOR
    # a vector operation that treats every slot alone: fitting all columns together equals
    # fitting them one by one
    slotwise: bool = False
    task: str = "classification"


def _pca(width: int):
    return feature.PCA(k=max(1, min(width, 3)))


_COMPONENTS = [
    Component("pyspark.ml.feature.StandardScaler", TRANSFORM,
              lambda w: feature.StandardScaler(withMean=True, withStd=True), slotwise=True),
    Component("pyspark.ml.feature.MinMaxScaler", TRANSFORM,
              lambda w: feature.MinMaxScaler(), slotwise=True),
    Component("pyspark.ml.feature.MaxAbsScaler", TRANSFORM,
              lambda w: feature.MaxAbsScaler(), slotwise=True),
    Component("pyspark.ml.feature.RobustScaler", TRANSFORM,
              lambda w: feature.RobustScaler(withCentering=True), slotwise=True),
    Component("pyspark.ml.feature.Normalizer", TRANSFORM, lambda w: feature.Normalizer()),
    Component("pyspark.ml.feature.PCA", TRANSFORM, _pca),
    Component("pyspark.ml.feature.PolynomialExpansion", TRANSFORM,
              lambda w: feature.PolynomialExpansion(degree=2)),
    Component("pyspark.ml.feature.Imputer", TRANSFORM, lambda w: feature.Imputer(), NUMBERS),
    Component("pyspark.ml.feature.QuantileDiscretizer", TRANSFORM,
              lambda w: feature.QuantileDiscretizer(numBuckets=8, handleInvalid="keep"),
              NUMBERS),
    Component("pyspark.ml.feature.StringIndexer", TRANSFORM,
              lambda w: feature.StringIndexer(handleInvalid="keep"), STRINGS),
    Component("pyspark.ml.classification.LogisticRegression", MODEL,
              lambda w: classification.LogisticRegression(maxIter=30)),
    Component("pyspark.ml.classification.DecisionTreeClassifier", MODEL,
              lambda w: classification.DecisionTreeClassifier(seed=0)),
    Component("pyspark.ml.classification.RandomForestClassifier", MODEL,
              lambda w: classification.RandomForestClassifier(numTrees=10, seed=0)),
    Component("pyspark.ml.classification.GBTClassifier", MODEL,
              lambda w: classification.GBTClassifier(maxIter=10, seed=0)),
    Component("pyspark.ml.classification.LinearSVC", MODEL,
              lambda w: classification.LinearSVC(maxIter=20)),
    Component("pyspark.ml.classification.NaiveBayes", MODEL,
              lambda w: classification.NaiveBayes(modelType="gaussian")),
    Component("pyspark.ml.regression.LinearRegression", MODEL,
              lambda w: regression.LinearRegression(maxIter=30), task="regression"),
    Component("pyspark.ml.regression.DecisionTreeRegressor", MODEL,
              lambda w: regression.DecisionTreeRegressor(seed=0), task="regression"),
    Component("pyspark.ml.regression.RandomForestRegressor", MODEL,
              lambda w: regression.RandomForestRegressor(numTrees=10, seed=0),
              task="regression"),
    Component("pyspark.ml.regression.GBTRegressor", MODEL,
              lambda w: regression.GBTRegressor(maxIter=10, seed=0), task="regression"),
    Component("pyspark.ml.regression.GeneralizedLinearRegression", MODEL,
              lambda w: regression.GeneralizedLinearRegression(), task="regression"),
]
CATALOG = {c.name: c for c in _COMPONENTS}


def resolve(name: str) -> Component:
    """The component of a dotted name; unknown names fail."""
    if name not in CATALOG:
        raise KeyError(f"unknown component {name}")
    return CATALOG[name]


def library_catalog(role: str, task: str = "classification") -> list[str]:
    """Sorted names of all transforms, or of all models of a task."""
    return sorted(
        c.name for c in _COMPONENTS
        if c.role == role and (role == TRANSFORM or c.task == task)
    )

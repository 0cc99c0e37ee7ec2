"""The pair classifier: gradient-boosted trees on Spark ML, prefixes of the ensemble, and stacking by folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.operators.ranking import group_features
from affinis.operators.sampling import group_fold

# Learning rate, leaves (as depth), rows of a leaf, shares of features and rows, seed.
SETTINGS = {"stepSize": 0.05, "maxDepth": 7, "minInstancesPerNode": 100, "featureSubsetStrategy": "0.8", "subsamplingRate": 0.8, "seed": 42}


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def fit(df: DataFrame, features: Sequence[str], label: str = "label", validation: str | None = None, rounds: int = 50, **settings) -> GBTClassificationModel:
    """Boosted trees on named columns; a boolean validation column stops early."""
    options = SETTINGS | settings | {"maxIter": rounds, "labelCol": label, "featuresCol": "features"}
    if validation:
        options["validationIndicatorCol"] = validation
    rows = assembled(df, features).withColumn(label, F.col(label).cast("double"))
    return GBTClassifier(**options).fit(rows)


def predict(model: GBTClassificationModel, df: DataFrame, features: Sequence[str], to: str = "p") -> DataFrame:
    """Adds the probability of a match."""
    out = model.transform(assembled(df, features))
    return out.withColumn(to, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def predict_prefix(model: GBTClassificationModel, df: DataFrame, features: Sequence[str], rounds: int, to: str = "p") -> DataFrame:
    """The probability that the first trees alone give: their weighted sum, doubled, through the logistic curve."""
    rows = assembled(df, features)
    margin: Column = F.lit(0.0)
    for k, (tree, weight) in enumerate(zip(model.trees[:rounds], model.treeWeights[:rounds], strict=True)):
        rows = tree.setPredictionCol(f"_t{k}").setFeaturesCol("features").transform(rows)
        margin = margin + F.col(f"_t{k}") * weight
    out = rows.withColumn(to, 1 / (1 + F.exp(-2 * margin)))
    return out.drop("features", *[f"_t{k}" for k in range(min(rounds, len(model.trees)))])


def importance(model: GBTClassificationModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Features by falling importance."""
    return sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def out_of_fold(df: DataFrame, features: Sequence[str], key: Column, label: str = "label", folds: int = 3, rounds: int = 20, to: str = "p", **settings) -> tuple[DataFrame, list[GBTClassificationModel]]:
    """Adds p of the model that has not seen a row's fold; rows of one key share a fold.  Also gives the models."""
    split = df.withColumn("_fold", group_fold(key, folds))
    parts, models = [], []
    for k in range(folds):
        model = fit(split.filter(F.col("_fold") != k), features, label, rounds=rounds, **({"stepSize": 0.1, "seed": 7} | settings))
        models.append(model)
        parts.append(predict(model, split.filter(F.col("_fold") == k), features, to))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_fold"), models


def mean_prediction(df: DataFrame, models: Sequence[GBTClassificationModel], features: Sequence[str], to: str = "p") -> DataFrame:
    """Adds the mean probability of several models, for rows that none has seen."""
    for k, m in enumerate(models):
        df = predict(m, df, features, f"_p{k}")
    total = sum((F.col(f"_p{k}") for k in range(len(models))), F.lit(0.0))
    return df.withColumn(to, total / len(models)).drop(*[f"_p{k}" for k in range(len(models))])


def stacked_features(scored: DataFrame, group: Sequence[str] = ("country", "s1"), tie: str = "r") -> DataFrame:
    """The first stage's probability p with its standing among the pairs of an S1 record."""
    return group_features(scored, group, "p", tie)

"""Classifiers that give a probability per encoded class.

The centroid model is portable: nearest class mean with a softmax, in plain expressions. xgboost, lightgbm and catboost name the ways of growing
trees in boosting.py, with those libraries' usual parameters, rf the forest of forest.py. The others wrap MLlib. Names whose weights
are not available raise, which the harness turns into an error row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setcast.operators import boosting, codes, forest

#: Digits that probabilities are rounded to, so that engines agree on ties and thresholds.
DIGITS = 9
SHARPNESS = 10.0
SUPPORT = 5_000
NEIGHBOURS = 15
NAMES = ("dummy", "linear", "rf", "xgboost", "lightgbm", "catboost", "tabpfn", "tabicl", "centroid", "gbt", "knn")
_ABSENT = {"tabpfn": "tabpfn", "tabicl": "tabicl"}
_BOOSTED = {"xgboost": boosting.LEVEL_WISE, "lightgbm": boosting.LEAF_WISE, "catboost": boosting.SYMMETRIC}
#: A name that starts so is a model over output codes.
CODED = "coded-"


def _matrix(rows: list) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), "array<array<double>>")


@dataclass
class Centroids:
    """Class means; a class without training rows has probability 0. As many numbers as classes times dimensions."""

    means: list[list[float] | None]

    def probabilities(self, features: Column, digits: int | None = DIGITS) -> Column:
        shown = lambda v: v if digits is None else F.round(v, digits)
        minus = F.transform(_matrix(self.means), lambda c: -SHARPNESS * F.aggregate(F.zip_with(features, c, lambda a, b: a.cast("double") - b), F.lit(0.0), lambda s, d: s + d * d))
        powers = F.transform(F.array(minus), lambda z: F.transform(z, lambda v: F.coalesce(F.exp(v - F.array_max(z)), F.lit(0.0))))
        return F.element_at(F.transform(powers, lambda e: F.transform(e, lambda v: shown(v / F.aggregate(e, F.lit(0.0), lambda s, d: s + d)))), 1)


Sums = dict[int, tuple[int, list[float]]]


def _class_sums(train: DataFrame, by: str = "class_idx", counted: Column | None = None) -> Sums:
    """Rows and sums of each dimension by class, in one aggregation that is combined before the shuffle; the driver gets a number per class and dimension.
    Rows that don't count make their class known, with no sums."""
    features = F.col("features") if counted is None else F.when(counted, F.col("features"))
    rows = train.select(by, F.posexplode_outer(features).alias("d", "x")).groupBy(by, "d").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("double")).alias("s")).collect()
    out: Sums = {r[by]: (0, []) for r in rows if r[by] is not None}
    for r in sorted((r for r in rows if r["d"] is not None and r[by] is not None), key=lambda r: r["d"]):
        out[r[by]] = (r["n"], [*out[r[by]][1], r["s"]])
    return out


def encoded_centroids(rows: DataFrame) -> tuple[list[int], Centroids]:
    """rows(split, code, features): the sorted distinct codes of all rows, and the centroids of the training rows, from one aggregation."""
    sums = _class_sums(rows, "code", F.col("split") == "train")
    codes_found = sorted(sums)
    return codes_found, _means(sums, [[c] for c in codes_found])


def _means(sums: Sums, groups: list[list[int]]) -> Centroids:
    """The mean of the rows of each group of classes."""
    means: list[list[float] | None] = []
    for own in groups:
        found = [sums[k] for k in own if k in sums and sums[k][0]]
        n = sum(x[0] for x in found)
        means.append([sum(x) / n for x in zip(*(x[1] for x in found), strict=True)] if n else None)
    return Centroids(means)


def fit_centroids(train: DataFrame, n_classes: int) -> Centroids:
    """train(features, class_idx), features of one length."""
    return _means(_class_sums(train), [[k] for k in range(n_classes)])


def coded_centroids(train: DataFrame, score: DataFrame, n_classes: int, digits: int | None = DIGITS) -> DataFrame:
    """Output codes over centroids: the models of all places come from one aggregation, as a sign's mean is that of its classes."""
    book, sums = codes.code_book(n_classes), _class_sums(train)
    places = []
    for j in range(len(book[0])):
        signs, n = codes.signs(book, j)
        model = _means(sums, [[k for k, s in enumerate(signs) if s == sign] for sign in range(n)])
        places.append(model.probabilities(F.col("features"), None))
    return score.withColumn("p", codes.decoded(places, book, digits))


def with_probabilities(name: str, train: DataFrame, score: DataFrame, n_classes: int, n_estimators: int = 500, seed: int = 0) -> DataFrame:
    """score with p: array<double> over all encoded classes, 0 for those that the model never saw."""
    if name in _ABSENT:
        __import__(_ABSENT[name])  # an error row where it is not installed
        raise NotImplementedError(f"{name} is installed but has no adapter")
    if name == "centroid":
        return score.withColumn("p", fit_centroids(train, n_classes).probabilities(F.col("features")))
    if name == "dummy":
        top = train.groupBy("class_idx").count().orderBy(F.desc("count"), "class_idx").first()
        return score.withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: (k == top["class_idx"]).cast("double")))
    if name in _BOOSTED:
        return score.withColumn("p", boosting.fit(train, n_classes, n_estimators, replace(_BOOSTED[name], seed=seed)).probabilities(F.col("features"), DIGITS))
    if name == f"{CODED}centroid" and n_classes > codes.ALPHABET:
        return coded_centroids(train, score, n_classes)
    if name.startswith(CODED):
        base = lambda t, s, k: with_probabilities(name.removeprefix(CODED), t, s, k, n_estimators, seed)
        return codes.with_probabilities(base, train, score, n_classes)
    if name == "knn":
        return _neighbours(train, score, n_classes)
    if name == "rf":
        return forest.with_probabilities(train, score, n_classes, n_estimators, seed=seed)
    vector = lambda df: df.withColumn("v", array_to_vector(F.transform("features", lambda x: x.cast("double"))))
    n = train.count()
    if name == "linear":
        scaler = StandardScaler(inputCol="v", outputCol="scaled", withMean=True)
        model = Pipeline(stages=[scaler, LogisticRegression(featuresCol="scaled", labelCol="class_idx", family="multinomial", maxIter=2000, regParam=1 / max(1, n), elasticNetParam=0.0)])
    elif name == "gbt":
        model = OneVsRest(classifier=GBTClassifier(maxIter=n_estimators, maxDepth=4, seed=seed), featuresCol="v", labelCol="class_idx")
    else:
        raise ValueError(f"unknown model {name!r}; there are {', '.join(NAMES)}, and {CODED}NAME over output codes")
    out = model.fit(vector(train)).transform(vector(score))
    if name == "gbt":  # margins only: a softmax makes them comparable
        margins = vector_to_array("rawPrediction")
        powers = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
        p = F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda s, d: s + d))
    else:
        p = vector_to_array("probability")
    filled = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.coalesce(F.get(p, k), F.lit(0.0)))
    return out.withColumn("p", filled).select(*score.columns, "p")


def _neighbours(train: DataFrame, score: DataFrame, n_classes: int) -> DataFrame:
    """Votes of the nearest rows of a support set of at most SUPPORT rows, which every task holds: an in-context stand-in. Ties go to the support row
    that comes first; features are of one length; with no support every probability is 0."""
    support = train.orderBy(F.md5(F.col("sample_id").cast("string"))).limit(SUPPORT).select("class_idx", "features").collect()
    points = np.array([r["features"] for r in support], np.float64)
    classes = np.array([r["class_idx"] for r in support], np.int64)
    squares, k = (points * points).sum(1) if support else np.zeros(0), min(NEIGHBOURS, len(support))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros((len(batch), n_classes))
            if k and len(batch):
                x = np.array([np.asarray(v, np.float64) for v in batch])
                near = np.argsort(squares - 2 * x @ points.T, axis=1, kind="stable")[:, :k]
                np.add.at(out, (np.repeat(np.arange(len(batch)), k), classes[near].ravel()), 1 / k)
            yield pd.Series(list(out))

    return score.withColumn("p", votes("features"))


def predicted(df: DataFrame) -> Column:
    """The likeliest class, the lowest among ties."""
    return (F.array_position("p", F.array_max("p")) - 1).cast("int")

"""Classification, trees, clusters and components: Spark's own library where it has the method."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.columns import require
from .association import covariance
from .basic import as_list
from .design import complete, features_of, two_values
from .regression import area_under_curve
from .result import AnalysisError, Result, analysis, result, too_few


def assembled(rows: DataFrame, names: list[str], target: str, test_size: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with a features vector; a hash of the row decides, so a rerun deals alike."""
    u = F.pmod(F.xxhash64(*[f"`{c}`" for c in rows.columns], F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows.withColumn("_u", u)).select(F.col(f"`{target}`").alias("label"), "features", "_u")
    return vectors.where(F.col("_u") >= test_size), vectors.where(F.col("_u") < test_size)


def _quality(kind: str, n: int, scored: DataFrame, positive: str, **more: Any) -> Result:
    at = {(int(r.label), int(r.prediction)): r["count"] for r in scored.groupBy("label", "prediction").count().collect()}
    tp, fp, tn, fn = (at.get(k, 0) for k in ((1, 1), (0, 1), (0, 0), (1, 0)))
    total = tp + fp + tn + fn
    precision, recall = tp / (tp + fp) if tp + fp else None, tp / (tp + fn) if tp + fn else None
    auc = area_under_curve(scored.select(vector_to_array("probability")[1].alias("s"), F.col("label").alias("y"))) if total else None
    return result(kind, n, {"positive": positive, "accuracy": (tp + tn) / total if total else None, "precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision and recall else None, "auc": auc}, tables={"confusion": {"true_positive": tp, "false_positive": fp, "true_negative": tn, "false_negative": fn}, **more})


def _classify(kind: str, df: DataFrame, target: str, positive_value: Any, test_size: float, seed: int, p: dict, make) -> Result:
    rows, positive = two_values(df, target, positive_value)
    names = features_of(df, target, p)
    rows = complete(rows, ["_y", *names])
    train, test = assembled(rows, names, "_y", test_size, seed)
    n = rows.count()
    if n < 10:
        return too_few(kind, n, 10)
    model, more = make(train, names)
    return _quality(kind, n, model.transform(test), positive, **more(model))


@analysis("logistic_regression_classification")
def logistic_classification(df: DataFrame, target: str, positive_value: Any = None, test_size: float = 0.2, seed: int = 42, **p: Any) -> Result:
    def make(train: DataFrame, names: list[str]):
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(train)
        model = LogisticRegression(featuresCol="scaled", standardization=False).fit(scaler.transform(train))

        class Both:
            def transform(self, rows: DataFrame) -> DataFrame:
                return model.transform(scaler.transform(rows))

        return Both(), lambda _: {"coefficients": dict(zip(["intercept", *names], [model.intercept, *model.coefficients.toArray().tolist()], strict=True))}

    return _classify("logistic_regression_classification", df, target, positive_value, test_size, seed, p, make)


@analysis("decision_tree")
def decision_tree(df: DataFrame, target: str, positive_value: Any = None, max_depth: int = 5, test_size: float = 0.2, seed: int = 42, **p: Any) -> Result:
    def make(train: DataFrame, names: list[str]):
        return DecisionTreeClassifier(impurity="gini", maxDepth=max_depth, seed=seed).fit(train), lambda m: {"importances": dict(zip(names, m.featureImportances.toArray().tolist(), strict=True)), "tree": m.toDebugString}

    return _classify("decision_tree", df, target, positive_value, test_size, seed, p, make)


@analysis("random_forest")
def random_forest(df: DataFrame, target: str, positive_value: Any = None, n_trees: int = 50, max_depth: int = 5, test_size: float = 0.2, seed: int = 42, **p: Any) -> Result:
    def make(train: DataFrame, names: list[str]):
        return RandomForestClassifier(numTrees=n_trees, maxDepth=max_depth, seed=seed).fit(train), lambda m: {"importances": dict(zip(names, m.featureImportances.toArray().tolist(), strict=True))}

    return _classify("random_forest", df, target, positive_value, test_size, seed, p, make)


@analysis("random_forest_regression")
def random_forest_regression(df: DataFrame, target: str, n_trees: int = 50, max_depth: int = 5, test_size: float = 0.2, seed: int = 42, **p: Any) -> Result:
    names = features_of(df, target, p)
    rows = complete(df, [target, *names])
    n = rows.count()
    if n < 10:
        return too_few("random_forest_regression", n, 10)
    train, test = assembled(rows, names, target, test_size, seed)
    model = RandomForestRegressor(numTrees=n_trees, maxDepth=max_depth, seed=seed).fit(train)
    e = F.col("label") - F.col("prediction")
    r = model.transform(test).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("label").alias("v")).first()
    return result("random_forest_regression", n, {"mse": r.mse, "mae": r.mae, "r_squared": 1 - r.mse / r.v if r.v else None}, tables={"importances": dict(zip(names, model.featureImportances.toArray().tolist(), strict=True))})


#: Rows that one task holds as vectors, some 170 bytes each.
TASK_ROWS = 1_000_000


def spread(vectors: DataFrame, n: int) -> DataFrame:
    """``n`` rows dealt so that no task holds many more than TASK_ROWS of them: a split of a file with few columns read is many rows."""
    # splits tell nothing of this: all rows of a row group are in one
    return vectors.repartition(max(-(-n // TASK_ROWS), vectors.rdd.getNumPartitions())) if n > TASK_ROWS else vectors


@analysis("kmeans")
def kmeans(df: DataFrame, features: Any = None, n_clusters: int = 3, seed: int = 42, max_iter: int = 300, **p: Any) -> Result:
    """Lloyd's algorithm on unscaled columns; the silhouette compares distances to centroids."""
    names = require(df, as_list(features)) if features else features_of(df, "", p)
    rows = complete(df, names)
    n = rows.count()
    if n < n_clusters + 1:
        return too_few("kmeans", n, n_clusters + 1)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    vectors = spread(vectors, n)
    model = KMeans(k=n_clusters, seed=seed, maxIter=max_iter).fit(vectors)
    centres = model.clusterCenters()
    dist = F.array_sort(F.array(*[F.sqrt(sum((F.pow(F.col(f"`{c}`") - float(m[i]), 2) for i, c in enumerate(names)), F.lit(0.0))) for m in centres]))
    near, other = dist[0], dist[1] if len(centres) > 1 else dist[0]
    r = rows.agg(F.avg(F.try_divide(other - near, F.greatest(other, near))).alias("s"), F.sum(near * near).alias("inertia")).first()
    return result("kmeans", n, {"inertia": r.inertia, "silhouette": r.s}, tables={"centres": [dict(zip(names, map(float, m), strict=True)) for m in centres], "sizes": list(model.summary.clusterSizes)})


@analysis("pca")
def pca(df: DataFrame, features: Any = None, n_components: int | None = None, **p: Any) -> Result:
    """Eigenvectors of one covariance matrix of complete rows; each is signed so that its largest loading is positive."""
    names = require(df, as_list(features)) if features else features_of(df, "", p)
    if len(names) < 2:
        raise AnalysisError("two columns at least")
    m, n = covariance(df, names)
    if n < 3:
        return too_few("pca", n)
    value, vector = np.linalg.eigh(m)
    order = value.argsort()[::-1][: n_components or len(names)]
    total, rows = value.sum(), []
    for k in order:
        v = vector[:, k] * np.sign(vector[np.abs(vector[:, k]).argmax(), k])
        rows.append({"variance": value[k], "ratio": value[k] / total if total else None, "loadings": dict(zip(names, v.tolist(), strict=True))})
    return result("pca", n, tables={"components": rows})

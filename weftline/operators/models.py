"""Fitted models by Spark ML: clusters chosen by silhouette, hashed embeddings, boosted regression."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, HashingTF, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster_choice(rows: DataFrame, features: list[str], ks: Iterable[int], weak: float = 0.15, strong: float = 0.35, seed: int = 7) -> DataFrame:
    """(k, silhouette, chosen, verdict) for each number of clusters, on standardised features.

    The greatest silhouette is chosen, the smaller k of equal ones; below ``weak`` there is no structure, from ``strong`` on it is clear.
    """
    wide = VectorAssembler(inputCols=features, outputCol="raw").transform(rows.na.drop(subset=features))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(wide).transform(wide).select("features").cache()
    found, enough = [], scaled.distinct().count()
    for k in ks:
        if k < enough:
            fitted = KMeans(k=k, seed=seed).fit(scaled)
            found.append((k, float(ClusteringEvaluator().evaluate(fitted.transform(scaled)))))
    scaled.unpersist()
    best = min(found, key=lambda f: (-f[1], f[0]))[0] if found else None
    verdict = lambda s: "none" if s < weak else "clear" if s >= strong else "weak"
    return rows.sparkSession.createDataFrame([(k, s, k == best, verdict(s)) for k, s in found], "k int, silhouette double, chosen boolean, verdict string")


def hashed_embedding(rows: DataFrame, key: str, items: str, buckets: int, size: int) -> DataFrame:
    """(key, vector): items hashed into buckets, the first ``size`` principal directions, standardised."""
    hashed = HashingTF(numFeatures=buckets, inputCol=items, outputCol="hashed").transform(rows)
    reduced = PCA(k=size, inputCol="hashed", outputCol="reduced").fit(hashed).transform(hashed)
    scaled = StandardScaler(inputCol="reduced", outputCol="scaled", withMean=True).fit(reduced).transform(reduced)
    return scaled.select(key, vector_to_array("scaled").alias("vector"))


def boosted_regression(rows: DataFrame, key: str, features: list[str], target: str, share: float = 0.8, seed: int = 7) -> DataFrame:
    """(name, value): r2 and rmse on held-out rows (by a hash of the key), and each feature's importance."""
    wide = VectorAssembler(inputCols=features, outputCol="features").transform(rows.na.drop(subset=[*features, target]))
    place = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1000)) < int(1000 * share)
    fitted = GBTRegressor(featuresCol="features", labelCol=target, maxIter=10, maxDepth=3, seed=seed).fit(wide.where(place))
    held = fitted.transform(wide.where(~place))
    score = lambda m: float(RegressionEvaluator(labelCol=target, metricName=m).evaluate(held)) if not held.isEmpty() else None
    found = [("r2", score("r2")), ("rmse", score("rmse")), *[(f"importance_{c}", float(v)) for c, v in zip(features, fitted.featureImportances.toArray(), strict=True)]]
    return rows.sparkSession.createDataFrame(found, "name string, value double")

"""Anomaly scores (M17): distance to the k-means centroid, Mahalanobis
distance and an isolation forest.

Model state is small and bounded (k centroids, a d x d covariance, trees grown
on 256-row samples), is fitted by distributed jobs and reaches the executors
as a broadcast; only the feature column goes through Arrow batches to numpy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors.to_numpy()]) if len(vectors) else np.zeros((0, 0))


def centroid_distance(df: DataFrame, features: str, k: int = 3, seed: int = 42) -> DataFrame:
    """Euclidean distance of each row (array<double> ``features``) to its
    k-means centroid, as ``centroid_distance``."""
    from pyspark.ml.functions import array_to_vector
    vec = df.withColumn("__v", array_to_vector(F.col(features)))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(vec)
    centers = np.stack([np.asarray(c) for c in model.clusterCenters()])
    out = model.transform(vec).drop("__v")
    # k short literal rows; the distance stays a JVM expression
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers])
    return out.withColumn("centroid_distance", F.sqrt(F.aggregate(
        F.zip_with(F.col(features).cast("array<double>"), F.element_at(table, F.col("cluster") + 1), lambda a, b: (a - b) * (a - b)),
        F.lit(0.0), lambda a, v: a + v)))


def mahalanobis(df: DataFrame, features: str) -> DataFrame:
    """sqrt((x - mu)' S^-1 (x - mu)) with the sample covariance S assembled
    from the distributed correlation matrix and standard deviations."""
    from pyspark.ml.functions import array_to_vector
    vec = df.select(array_to_vector(F.col(features)).alias("v"))
    corr = np.asarray(Correlation.corr(vec, "v").first()[0].toArray())
    st = vec.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).first()["s"]
    mu = np.asarray(st["mean"].toArray())
    sd = np.sqrt(np.asarray(st["variance"].toArray()))
    cov = corr * np.outer(sd, sd)
    inv = np.linalg.pinv(np.nan_to_num(cov))
    bc = df.sparkSession.sparkContext.broadcast((mu, inv))

    @F.pandas_udf("double")
    def distance(vectors: pd.Series) -> pd.Series:
        m, s = bc.value
        x = _rows(vectors) - m if len(vectors) else np.zeros((0, len(m)))
        return pd.Series(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, s, x), 0.0)))
    return df.withColumn("mahalanobis", distance(F.col(features)))


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


TREE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, size int")


def isolation_forest(df: DataFrame, features: str, trees: int = 100, sample: int = 256, seed: int = 42,
                     key: Sequence[str] | None = None) -> DataFrame:
    """Isolation-forest score 2^(-E[h(x)] / c(sample)) per row.

    Each tree gets its own Bernoulli sample of about ``sample`` rows (hash of
    the row and the tree id), trees are grown in parallel with
    ``groupBy(tree).applyInPandas``, and the node tables (bounded by trees x
    2 x sample) are broadcast to score every row."""
    n = df.count()
    rate = min(1.0, sample * 1.25 / max(n, 1))
    cols = key or df.columns
    h = [F.xxhash64(F.lit(seed), F.lit(j), *[F.col(c) for c in cols]) for j in range(trees)]
    picks = F.filter(F.array(*[F.when(F.pmod(h[j], F.lit(1 << 30)) < int(rate * (1 << 30)), F.lit(j))
                               for j in range(trees)]), lambda x: x.isNotNull())
    samp = df.select(F.explode(picks).alias("tree"), F.col(features).alias("x"),
                     F.xxhash64(F.lit(seed + 1), *[F.col(c) for c in cols]).alias("h"))
    limit = int(math.ceil(math.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        # the smallest hashes, so a tree does not depend on the order of arrival
        x = _rows(pdf.sort_values("h", kind="stable")["x"].head(sample))
        rng = np.random.default_rng(seed * 1000003 + tree)
        nodes = []

        def build(idx, depth):
            nid = len(nodes)
            nodes.append([tree, nid, -1, 0.0, -1, -1, len(idx)])
            if depth >= limit or len(idx) <= 1:
                return nid
            sub = x[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.nonzero(hi > lo)[0]
            if len(cand) == 0:
                return nid
            f = int(rng.choice(cand))
            t = float(rng.uniform(lo[f], hi[f]))
            left = idx[sub[:, f] < t]
            right = idx[sub[:, f] >= t]
            nodes[nid][2], nodes[nid][3] = f, t
            nodes[nid][4] = build(left, depth + 1)
            nodes[nid][5] = build(right, depth + 1)
            return nid
        build(np.arange(len(x)), 0)
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size"])

    forest = samp.groupBy("tree").applyInPandas(grow, TREE_SCHEMA).collect()  # bounded: trees x 2 x sample rows
    tables = {}
    for r in forest:
        tables.setdefault(r["tree"], []).append(r)
    packed = []
    for t, rows in tables.items():
        rows.sort(key=lambda r: r["node"])
        packed.append(np.array([[r["feature"], r["threshold"], r["left"], r["right"], r["size"]] for r in rows]))
    bc = df.sparkSession.sparkContext.broadcast((packed, _c(min(sample, n))))

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        trees_, cn = bc.value
        x = _rows(vectors)
        total = np.zeros(len(x))
        for tb in trees_:
            node = np.zeros(len(x), dtype=int)
            depth = np.zeros(len(x))
            active = np.ones(len(x), dtype=bool)
            while active.any():
                f = tb[node, 0].astype(int)
                leaf = f < 0
                done = active & leaf
                depth[done] += np.array([_c(s) for s in tb[node[done], 4]])
                active &= ~leaf
                if not active.any():
                    break
                idx = np.nonzero(active)[0]
                go_left = x[idx, f[idx]] < tb[node[idx], 1]
                node[idx] = np.where(go_left, tb[node[idx], 2], tb[node[idx], 3]).astype(int)
                depth[idx] += 1
            total += depth
        mean = total / max(len(trees_), 1)
        return pd.Series(np.power(2.0, -mean / cn) if cn > 0 else np.zeros(len(x)))
    return df.withColumn("anomaly_score", score(F.col(features)))

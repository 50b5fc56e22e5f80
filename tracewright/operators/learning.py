"""Learned anomalies, pattern clusters, neighbour models, centroids and effects.

What is learned is small (trees, a covariance matrix, centroids of a block) and
is learned from aggregates or from a bounded sample; scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import erfc, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Rows that a forest may be grown from; each tree takes its own few of them.
POOL = 8192


def clean(features: DataFrame, columns: list[str]) -> DataFrame:
    """Null, NaN and infinite values become 0, as doubles."""
    x = lambda c: F.col(c).cast("double")
    bad = lambda c: x(c).isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf"))
    return features.select("address", *[F.when(bad(c), 0.0).otherwise(x(c)).alias(c) for c in columns])


def _average_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, float)
    many = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(many - 1) + np.euler_gamma) - 2 * (many - 1) / many))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, np.ndarray]:
    """One tree as arrays; a node's feature is -1 where it is a leaf, whose depth is then known."""
    feature, cut, left, depth = [], [], [], []
    waiting = [(x, 0)]
    for rows, d in waiting:  # the list grows while it is read: breadth first
        spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 and d < limit else []
        if not len(spread):
            feature.append(-1), cut.append(0.0), left.append(0), depth.append(d + float(_average_depth(len(rows))))
            continue
        f = int(rng.choice(spread))
        at = rng.uniform(rows[:, f].min(), rows[:, f].max())
        below = rows[:, f] <= at
        feature.append(f), cut.append(at), left.append(len(waiting)), depth.append(0.0)
        waiting += [(rows[below], d + 1), (rows[~below], d + 1)]
    return {"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left), "depth": np.array(depth)}


def _depths(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    at, rows = np.zeros(len(x), int), np.arange(len(x))
    while True:
        f = tree["feature"][at]
        if (f < 0).all():
            return tree["depth"][at]
        right = x[rows, np.maximum(f, 0)] > tree["cut"][at]
        at = np.where(f < 0, at, tree["left"][at] + right)


def isolation_forest(features: DataFrame, columns: list[str], share: float = 0.1, trees: int = 100, take: int = 256, seed: int = 42) -> DataFrame:
    """Addresses that few random cuts set apart: the ``share`` with the shortest paths.

    The forest grows from at most ``POOL`` rows, those of least hash; every row is
    scored, in Arrow batches.  An empty table gives no rows.
    """
    df = clean(features, columns)
    pool = df.orderBy(F.xxhash64("address", F.lit(seed)), "address").limit(POOL).select(*columns).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    n = min(take, len(pool))
    forest = [_grow(pool[rng.choice(len(pool), n, replace=False)], rng, max(1, int(np.ceil(log(max(n, 2), 2))))) for _ in range(trees if n else 0)]
    norm = max(float(_average_depth(n)), 1e-9)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[columns].to_numpy(float)
            mean = sum((_depths(t, x) for t in forest), np.zeros(len(x))) / max(len(forest), 1)
            yield pd.DataFrame({"address": b["address"], "isolation": 2 ** (-mean / norm)})

    return _furthest(df.mapInPandas(score, "address string, isolation double"), "isolation", share, "isolation_forest")


def _furthest(scored: DataFrame, of: str, share: float, method: str) -> DataFrame:
    """The ``share`` of rows with the highest values, as anomalies; scores by a logistic around the bound."""
    bound = scored.agg(F.percentile_approx(of, 1 - share, 100_000).alias("bound"))  # an exact one would hold every distinct score in one task
    far = scored.join(F.broadcast(bound)).where(F.col(of) > F.col("bound"))  # one row
    score = 1 / (1 + F.exp(-5 * (F.col(of) - F.col("bound"))))
    return far.select("address", F.lit(method).alias("method"), score.alias("score"), score.alias("confidence"))


def _moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and covariances, from one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(F.count("*"), *[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).first()
    k = len(columns)
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[1 + k :]):
        cov[i, j] = cov[j, i] = v if v is not None and np.isfinite(v) else 0.0
    return row[0], np.array([v or 0.0 for v in row[1 : 1 + k]]), cov


def covariance_distance(features: DataFrame, columns: list[str], share: float = 0.1) -> DataFrame:
    """Addresses far from the mean in units of the covariance (in place of a one-class machine).

    Means and covariances of all rows are aggregates; the distance is a column expression.
    """
    df = clean(features, columns)
    _, mean, cov = _moments(df, columns)
    values, vectors = np.linalg.eigh(cov)
    parts = [
        F.pow(sum(((F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, mean, vectors[:, i])), F.lit(0.0)) / float(sqrt(v)), F.lit(2))
        for i, v in enumerate(values) if v > 1e-10 * max(values.max(), 1e-300)
    ]
    scored = df.select("address", F.sqrt(sum(parts, F.lit(0.0)) / max(len(parts), 1)).alias("distance"))
    return _furthest(scored, "distance", share, "covariance_distance")


def combine(*found: DataFrame) -> DataFrame:
    """Addresses named by two methods, or with a confidence of 0.8 in all."""
    rows = reduce(lambda a, b: a.unionByName(b), [f.select("address", "method", "score", "confidence") for f in found])
    out = rows.groupBy("address").agg(F.sum("score").alias("combined_score"), F.count("*").alias("method_count"), F.sum("confidence").alias("c"), F.array_sort(F.collect_set("method")).alias("methods"))
    out = out.where((F.col("method_count") >= 2) | (F.col("c") >= 0.8))
    return out.select("address", "combined_score", "method_count", "methods", (F.col("c") / F.col("method_count")).alias("confidence"))


def pattern_clusters(features: DataFrame, columns: list[str], ks=(2, 3, 4), seed: int = 42) -> DataFrame:
    """Each row's k-means cluster over standardised features, or their first ten principal components.

    Constant columns are left out; of ``ks`` the number with the best silhouette
    is taken.  With fewer rows than clusters, or no varying column, all rows are in cluster 0.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    df = clean(features, columns)
    n, _, cov = _moments(df, columns)
    varying = [c for c, v in zip(columns, np.diag(cov)) if v > 0]
    if not varying or n <= max(ks):
        return df.withColumn("cluster", F.lit(0))
    stages = [VectorAssembler(inputCols=varying, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]
    if len(varying) > 10:
        stages.append(PCA(k=10, inputCol="scaled", outputCol="reduced"))
    df = cut(df)  # every fit and evaluation reads it again
    ready = Pipeline(stages=stages).fit(df).transform(df)
    of = stages[-1].getOutputCol()
    fits = [KMeans(k=k, seed=seed, featuresCol=of, predictionCol="cluster").fit(ready) for k in ks]
    judge = ClusteringEvaluator(featuresCol=of, predictionCol="cluster")
    best = max(fits, key=lambda m: judge.evaluate(m.transform(ready)))
    return best.transform(ready).select("address", *columns, "cluster")


def pattern_profiles(rows: DataFrame) -> DataFrame:
    """Means of deposit behaviour in each cluster, its kind and its risk."""
    names = "deposit_count withdrawal_count total_deposits total_withdrawals interleaving_score uses_round_amounts time_consistency_score pattern_complexity".split()
    mean = {c: F.avg(c) for c in names}
    ratio = F.avg(F.col("total_deposits") / F.greatest("total_withdrawals", F.lit(1e-10)))
    out = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.avg(((F.col("deposit_count") > 0) & (F.col("withdrawal_count") > 0)).cast("double")).alias("both"), ratio.alias("volume_ratio"), *[v.alias(c) for c, v in mean.items()])
    c = F.col
    kind = (
        F.when((c("both") > 0.5) & (c("interleaving_score") > 0.5), "active_mixer").when(c("deposit_count") > 2 * c("withdrawal_count"), "deposit_heavy").when(c("withdrawal_count") > 2 * c("deposit_count"), "withdrawal_heavy")
        .when((c("time_consistency_score") > 0.7) & (c("uses_round_amounts") > 0.7), "systematic_user").when(c("time_consistency_score") <= 0.7, "irregular_user").otherwise("balanced_user")
    )
    risk = F.least(0.3 * F.abs(1 - c("volume_ratio")), F.lit(0.3)) + 0.2 * (1 - c("time_consistency_score")) + 0.2 * c("interleaving_score") + F.least(c("pattern_complexity") / 10, F.lit(0.3))
    return out.withColumns({"pattern_type": kind, "risk_score": F.least(risk, F.lit(1.0))})


def outliers_in_clusters(rows: DataFrame, columns: list[str], bound: float = 3.0) -> DataFrame:
    """The features of a row that lie more than ``bound`` sample deviations from its cluster's mean.

    Means come from an aggregate and join back, so that no cluster is in one task.
    """
    stats = rows.groupBy("cluster").agg(*[f(c).alias(f"{p}_{c}") for c in columns for p, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}"))).alias("z")) for c in columns])
    tall = rows.join(stats, "cluster").select("address", "cluster", F.explode(z).alias("x"))
    return tall.select("address", "cluster", "x.feature", F.col("x.z").alias("z_score")).where(F.col("z_score") > bound)


def neighbour_features(edges: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """An address's own features and the means of its neighbours', as ``near_<name>``; 0 without neighbours."""
    links = edges.where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("address"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("address"), F.col("src").alias("other")))).alias("l")).select("l.*").distinct()
    df = clean(features, columns)
    means = links.join(df.withColumnRenamed("address", "other"), "other").groupBy("address").agg(*[F.avg(c).alias(f"near_{c}") for c in columns])
    return df.join(means, "address", "left").na.fill(0.0)


def neighbour_risk(edges: DataFrame, features: DataFrame, columns: list[str], label: DataFrame, share: float = 0.7) -> DataFrame:
    """A logistic model over own and neighbours' features; learned from ``share`` of the labelled rows.

    ``label`` is (address, label); rows held out are told by the address's hash.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    wide = neighbour_features(edges, features, columns)
    names = [c for c in wide.columns if c != "address"]
    held = F.pmod(F.xxhash64("address"), F.lit(1000)) >= int(1000 * share)
    rows = cut(wide.join(label, "address").withColumns({"held_out": held, "label": F.col("label").cast("double")}))
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LogisticRegression(featuresCol="x", regParam=0.01, maxIter=50)]).fit(rows.where(~F.col("held_out")))
    p = vector_to_array("probability")
    return model.transform(rows).select("address", "label", "held_out", F.element_at(p, -1).alias("risk_score"))


def centroids(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """The mean vector of each cluster."""
    tall = rows.where(F.col(cluster).isNotNull() & F.col(vector).isNotNull()).select(F.col(cluster).alias("cluster"), F.posexplode(vector).alias("i", "x"))
    means = tall.groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_centroid(rows: DataFrame, key: str, vector: str, means: DataFrame, block: int = 4096) -> DataFrame:
    """The cluster with the most similar centroid, by cosine; ties go to the smaller cluster.

    Centroids reach the workers in blocks of ``block``, whatever their number;
    the best of each block is kept.  Null vectors and those of length 0 take no part.
    """
    kind = means.schema["cluster"].dataType.simpleString()
    key_kind = rows.schema[key].dataType.simpleString()
    known = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    out, held = None, []

    def part(some: list) -> DataFrame:
        names = [r["cluster"] for r in some]
        unit = np.array([r["centroid"] for r in some], float)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x = np.array(b["v"].tolist(), float)
                length = np.linalg.norm(x, axis=1)
                cos = x @ unit.T / np.maximum(length, 1e-300)[:, None]
                top = cos.argmax(1)
                found = pd.DataFrame({"key": b["key"], "cluster": [names[i] for i in top], "similarity": cos[np.arange(len(x)), top]})
                yield found[length > 0]

        return known.mapInPandas(best, f"key {key_kind}, cluster {kind}, similarity double")

    for r in means.orderBy("cluster").toLocalIterator():
        held.append(r)
        if len(held) == block:
            out, held = (part(held) if out is None else out.unionByName(part(held))), []
    if held or out is None:
        if not held:
            return known.limit(0).select(F.col("key").alias(key), F.lit(None).cast(kind).alias("cluster"), F.lit(0.0).alias("similarity"))
        out = part(held) if out is None else out.unionByName(part(held))
    top = out.groupBy("key").agg(F.max_by(F.struct("cluster", "similarity"), "similarity").alias("t"))
    return top.select(F.col("key").alias(key), "t.cluster", "t.similarity")


def average_effect(df: DataFrame, treatment: str, outcome: str, confounders: list[str]) -> DataFrame:
    """One row: the effect of ``treatment`` on ``outcome`` with ``confounders`` held, by least squares.

    Solved from covariances, which are one aggregate over all rows.
    """
    names = [treatment, *confounders, outcome]
    n, _, cov = _moments(df.select(*[F.col(c).cast("double").alias(c) for c in names]).na.fill(0.0), names)
    inverse = np.linalg.pinv(cov[:-1, :-1])
    beta = inverse @ cov[:-1, -1]
    free = max(n - len(names), 1)
    left = max(cov[-1, -1] - float(beta @ cov[:-1, -1]), 0.0) * max(n - 1, 0) / free
    error = sqrt(left * max(inverse[0, 0], 0.0) / max(n - 1, 1))
    row = (treatment, outcome, float(beta[0]), error, int(n))
    return df.sparkSession.createDataFrame([row], "treatment string, outcome string, effect double, std_error double, n long")


def dependence_graph(df: DataFrame, columns: list[str], alpha: float = 0.05, most: int = 3) -> DataFrame:
    """Pairs of columns that stay dependent given any up to ``most`` of their neighbours (PC skeleton).

    Correlations are one aggregate over all rows; tests are Fisher's z on partial
    correlations.  Constant columns are left out, and of two that correlate by
    0.98 or more the later one.
    """
    n, _, cov = _moments(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.fill(0.0), columns)
    keep: list[int] = []
    for i, v in enumerate(np.diag(cov)):
        if v > 0 and all(abs(cov[i, j]) / sqrt(v * cov[j, j]) < 0.98 for j in keep):
            keep.append(i)
    names = [columns[i] for i in keep]
    sd = np.sqrt(np.diag(cov)[keep])
    r = cov[np.ix_(keep, keep)] / np.outer(sd, sd)

    def partial(i: int, j: int, given: tuple[int, ...]) -> float:
        p = np.linalg.pinv(r[np.ix_([i, j, *given], [i, j, *given])])
        return float(np.clip(-p[0, 1] / sqrt(max(p[0, 0] * p[1, 1], 1e-300)), -1 + 1e-12, 1 - 1e-12))

    def independent(i: int, j: int, given: tuple[int, ...]) -> bool:
        c = partial(i, j, given)
        z = 0.5 * log((1 + c) / (1 - c)) * sqrt(max(n - len(given) - 3, 0))
        return erfc(abs(z) / sqrt(2)) > alpha

    near = {i: set(range(len(names))) - {i} for i in range(len(names))}
    for size in range(most + 1):
        before = {i: sorted(s) for i, s in near.items()}  # a level removes by the neighbours at its start
        for i, j in combinations(range(len(names)), 2):
            if j in near[i]:
                sides = (combinations([k for k in before[a] if k != b], size) for a, b in ((i, j), (j, i)))
                if any(independent(i, j, given) for side in sides for given in side):
                    near[i].discard(j), near[j].discard(i)
    found = [(names[i], names[j], float(r[i, j])) for i, j in combinations(range(len(names)), 2) if j in near[i]]
    return df.sparkSession.createDataFrame(found, "a string, b string, correlation double")

"""How well transfers through mixers can be linked: timing, values and gas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import entropy


def hourly_pattern(rows: DataFrame, quantile: float = 0.95) -> DataFrame:
    """One row: hours with transfers, their mean, maximum and entropy, and hours above a quantile."""
    hours = rows.groupBy(F.floor(F.col("timestamp") / 3600).alias("hour")).agg(F.count("*").alias("n"))
    total = F.sum("n")
    ends = hours.agg(F.count("*").alias("hours"), F.avg("n").alias("mean_per_hour"), F.max("n").alias("max_per_hour"), (F.ln(total) - F.sum(F.col("n") * F.ln("n")) / total).alias("temporal_entropy"), F.percentile("n", F.lit(quantile)).alias("bound"))
    bursts = hours.join(F.broadcast(ends.select("bound"))).where("n > bound").agg(F.count("*").alias("burst_hours"))  # one row
    return ends.drop("bound").join(F.broadcast(bursts))  # one row each


def value_clusters(rows: DataFrame, eps: float = 0.1, least: int = 5) -> DataFrame:
    """Density clusters of values: each cluster's bounds and core points, as by DBSCAN in one dimension.

    Values are cut into buckets a hair narrower than ``eps``, so that rounding
    cannot part this from a comparison of differences.  Points of one bucket are
    all within ``eps``, so in a bucket of ``least`` points all are core; only
    points of thinner buckets, fewer than ``least`` in each, look at the two
    buckets on either side.  Buckets join on their number; a cluster begins in
    a bucket whose least core point is farther than ``eps`` from the one before.
    """
    bucket = F.floor(F.col("v") / (eps * (1 - 1e-6)))
    points = rows.where("value_eth is not null").groupBy(F.col("value_eth").alias("v")).agg(F.count("*").alias("n")).withColumn("b", bucket)
    own = points.groupBy("b").agg(F.sum("n").alias("here"))
    marked = points.join(own, "b")
    dense = marked.where(F.col("here") >= least).select("b", "v", "n")
    sides = F.array(*[F.col("b") + d for d in (-2, -1, 1, 2)])
    thin = marked.where(F.col("here") < least).select("v", "n", "here", F.col("b").alias("home"), F.explode(sides).alias("b"))
    near = thin.join(points.select("b", F.col("v").alias("w"), F.col("n").alias("m")), "b", "left")
    near = near.groupBy("home", "v", "n", "here").agg(F.sum(F.when(F.abs(F.col("v") - F.col("w")) <= eps, F.col("m")).otherwise(0)).alias("around"))
    core = dense.unionByName(near.where(F.col("here") + F.col("around") >= least).select(F.col("home").alias("b"), "v", "n"))
    spans = core.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("n"))
    before = spans.select(F.explode(F.array(F.col("b") + 1, F.col("b") + 2)).alias("b"), F.col("hi").alias("last")).groupBy("b").agg(F.max("last").alias("last"))
    return spans.join(before, "b", "left").withColumn("begins", F.coalesce(F.col("lo") - F.col("last") > eps, F.lit(True)))


def gas_pattern(rows: DataFrame) -> DataFrame:
    """One row: entropies of gas and gas price, variation and variety of gas."""
    k = rows.withColumn("k", F.lit(1))
    out = entropy(k, ["k"], "gas", "gas_entropy", base=None).join(entropy(k, ["k"], "gas_price", "price_entropy", base=None), "k")
    g = k.groupBy("k").agg(F.try_divide(F.stddev_samp("gas"), F.avg("gas")).alias("gas_variation"), F.countDistinct("gas").alias("unique_gas"), F.count("gas").alias("n"))
    return out.join(g, "k").withColumn("potential_leak", F.col("unique_gas") < 0.8 * F.col("n")).drop("k", "n")


def crowded_blocks(rows: DataFrame, most: int = 10) -> DataFrame:
    """Blocks with more than ``most`` transfers."""
    return rows.groupBy("block_number").agg(F.count("*").alias("n_tx"), F.countDistinct("from_addr").alias("senders"), F.sum("value_eth").alias("volume")).where(F.col("n_tx") > most)


def linkability(rows: DataFrame) -> DataFrame:
    """One row: low entropy of hours and gas, and many value clusters, make transfers easy to link."""
    n = value_clusters(rows).agg(F.count_if("begins").alias("clusters"))
    all_ = hourly_pattern(rows).select("temporal_entropy").join(F.broadcast(gas_pattern(rows).select("gas_entropy"))).join(F.broadcast(n))  # one row each
    floor = lambda x: F.greatest(F.lit(0.0), x)
    score = 0.4 * floor(1 - F.col("temporal_entropy") / 5) + 0.3 * F.least(F.col("clusters") / 10, F.lit(1.0)) + 0.3 * floor(1 - F.col("gas_entropy") / 3)
    return all_.withColumn("linkability_score", score)

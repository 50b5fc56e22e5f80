"""Clusters of addresses: statistics, quality, agreement, flows between them.

An assignment is a frame (address, cluster_id).  No step gathers a cluster's
rows in one place: all of them are aggregates, or equi-joins on address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import gini
from .incidence import cluster_incidence

HOUR, DAY = 3600, 86400


def cluster_stats(tx: DataFrame, assignment: DataFrame) -> DataFrame:
    """Size, transfers, volume, life span and rate of each cluster, and two temporal flags.

    A transfer counts once for a cluster, whatever ends it has there.
    """
    size = assignment.groupBy("cluster_id").agg(F.countDistinct("address").alias("node_count"))
    t = F.col("timestamp")
    rows = cluster_incidence(tx, assignment).groupBy("cluster_id").agg(
        F.count("*").alias("n_tx"), F.sum("value_eth").alias("volume"), F.min(t).alias("first_seen"), F.max(t).alias("last_seen")
    )
    out = size.join(rows, "cluster_id", "left").na.fill(0, ["n_tx"]).na.fill(0.0, ["volume"])
    hours = (F.col("last_seen") - F.col("first_seen")) / HOUR
    out = out.withColumn("duration_hours", hours).withColumn("tx_per_hour", F.col("n_tx") / F.greatest(F.col("duration_hours"), F.lit(1.0)))
    burst = F.coalesce((F.col("duration_hours") < 24) & (F.col("node_count") > 10), F.lit(False))
    return out.withColumns({"coordinated_burst": burst, "high_frequency": F.coalesce(F.col("tx_per_hour") > 100, F.lit(False))})


def overlapping(stats: DataFrame, least: int = HOUR, width: int = DAY * 30) -> DataFrame:
    """Pairs of clusters alive together for more than ``least`` seconds.

    Lives are cut into buckets of ``width``; a pair is kept in the bucket where
    the later of the two begins, so that it comes out once.
    """
    live = stats.where("first_seen is not null").select("cluster_id", "first_seen", "last_seen")
    bucket = lambda c: F.floor(F.col(c) / width)
    cut = live.withColumn("bucket", F.explode(F.sequence(bucket("first_seen"), bucket("last_seen"))))
    a = cut.select("bucket", F.col("cluster_id").alias("a"), F.col("first_seen").alias("a_first"), F.col("last_seen").alias("a_last"))
    b = cut.select("bucket", F.col("cluster_id").alias("b"), F.col("first_seen").alias("b_first"), F.col("last_seen").alias("b_last"))
    start, end = F.greatest("a_first", "b_first"), F.least("a_last", "b_last")
    met = a.join(b, "bucket").where((F.col("a") < F.col("b")) & (end - start > least) & (F.floor(start / width) == F.col("bucket")))
    return met.select("a", "b", (end - start).alias("overlap"))


def _two_sided(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Edges with the clusters of both ends; null where an end has none."""
    one = assignment.select("address", "cluster_id")
    left = one.withColumnsRenamed({"address": "src", "cluster_id": "src_cluster"})
    right = one.withColumnsRenamed({"address": "dst", "cluster_id": "dst_cluster"})
    return edges.join(left, "src", "left").join(right, "dst", "left")


def inter_cluster_flows(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Volume and transfers between each ordered pair of different clusters."""
    rows = _two_sided(edges, assignment).where("src_cluster <> dst_cluster")
    return rows.groupBy("src_cluster", "dst_cluster").agg(F.sum("weight").alias("volume"), F.sum("n_tx").alias("n_tx"))


def connectivity(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """For each cluster its inner pairs, its pairs to other clusters, and its density.

    A pair is an unordered pair of different, linked addresses.
    """
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    rows = _two_sided(pairs, assignment).where("src_cluster is not null and dst_cluster is not null")
    inner = F.col("src_cluster") == F.col("dst_cluster")
    ends = F.when(inner, F.array("src_cluster")).otherwise(F.array("src_cluster", "dst_cluster"))
    counts = rows.select(F.explode(ends).alias("cluster_id"), inner.alias("inner")).groupBy("cluster_id")
    counts = counts.agg(F.count_if("inner").alias("inner_pairs"), F.count_if(~F.col("inner")).alias("outer_pairs"))
    size = assignment.groupBy("cluster_id").agg(F.countDistinct("address").alias("node_count"))
    out = size.join(counts, "cluster_id", "left").na.fill(0, ["inner_pairs", "outer_pairs"])
    n = F.col("node_count")
    density = F.when(n > 1, 2 * F.col("inner_pairs") / (n * (n - 1))).otherwise(0.0)
    return out.withColumn("density", density)


def internal_topology(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Directed density and volume of each cluster over edges with both ends inside, and their Gini."""
    rows = _two_sided(edges, assignment).where("src_cluster = dst_cluster").withColumnRenamed("src_cluster", "cluster_id")
    total = rows.groupBy("cluster_id").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("volume"), F.max("weight").alias("max_edge"))
    size = assignment.groupBy("cluster_id").agg(F.countDistinct("address").alias("node_count"))
    out = size.join(total, "cluster_id", "left").join(gini(rows, ["cluster_id"], "weight", "flow_gini"), "cluster_id", "left")
    out = out.na.fill(0, ["n_edges"]).na.fill(0.0, ["volume", "max_edge", "flow_gini"])
    n = F.col("node_count")
    return out.withColumn("density", F.when(n > 1, F.col("n_edges") / (n * (n - 1))).otherwise(0.0))


def topology_risk(topology: DataFrame) -> DataFrame:
    """A fifth for each sign: dense and large, unequal flow, large volume."""
    signs = [(F.col("density") > 0.5) & (F.col("node_count") > 10), F.col("flow_gini") > 0.8, F.col("volume") > 1000]
    return topology.withColumn("risk_score", F.least(F.lit(1.0), 0.2 * sum((s.cast("int") for s in signs), F.lit(0))))


def size_profile(assignment: DataFrame, large: float = 0.1) -> DataFrame:
    """One row: how cluster sizes are spread, and what share of addresses large clusters hold."""
    size = assignment.groupBy("cluster_id").agg(F.countDistinct("address").alias("n"))
    n = F.col("n")
    q = lambda p: F.percentile(n, F.lit(p))
    out = size.agg(
        F.count("*").alias("clusters"), F.sum(n).alias("members"), F.min(n).alias("min_size"), F.max(n).alias("max_size"), F.avg(n).alias("mean_size"), q(0.5).alias("median_size"),
        q(0.25).alias("p25"), q(0.75).alias("p75"), q(0.95).alias("p95"), F.stddev_pop(n).alias("std_size"), F.skewness(n).alias("size_skewness"), F.kurtosis(n).alias("size_kurtosis"),
        F.count_if(n == 1).alias("singletons"), F.coalesce(F.stddev_pop(n) / F.avg(n), F.lit(0.0)).alias("size_variation"),
    )
    return out.withColumns({"singleton_ratio": F.try_divide(F.col("singletons").cast("double"), F.col("clusters")), "giant": F.col("max_size") > large * F.col("members")})


def checks(assignment: DataFrame, addresses: DataFrame) -> DataFrame:
    """One row: unassigned share over a half, a cluster over ten times the mean, weak ones over 30 %."""
    one = F.lit(1).alias("k")
    known = addresses.select("address").distinct().join(assignment.select("address", "cluster_id").dropDuplicates(["address"]), "address", "left")
    share = known.agg(F.avg(F.col("cluster_id").isNull().cast("double")).alias("unassigned_ratio")).select("*", one)
    size = assignment.groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    spread = size.agg((F.max("n") / F.avg("n")).alias("max_over_mean"), F.avg((F.col("c") < 0.5).cast("double")).alias("weak_ratio")).select("*", one)
    out = share.join(spread, "k").drop("k")
    return out.withColumn("issues", (F.col("unassigned_ratio") > 0.5).cast("int") + (F.col("max_over_mean") > 10).cast("int") + (F.col("weak_ratio") > 0.3).cast("int"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: adjusted Rand index, normalised mutual information and likeness of counts of two assignments.

    Both follow from the table of common members, so no pair of addresses is formed.
    """
    both = a.select("address", F.col("cluster_id").alias("x")).join(b.select("address", F.col("cluster_id").alias("y")), "address")
    cells = both.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    n = F.col("n")
    parts = F.sum(n * (n - 1) / 2), F.sum(n * F.ln(n))
    side = lambda k: cells.groupBy(k).agg(F.sum("n").alias("n")).agg(parts[0].alias(f"pairs_{k}"), parts[1].alias(f"log_{k}"), F.count("*").alias(f"k_{k}"), F.lit(1).alias("k"))
    t = cells.agg(parts[0].alias("pairs"), parts[1].alias("log"), F.sum("n").alias("total"), F.lit(1).alias("k")).join(side("x"), "k").join(side("y"), "k")
    c = F.col
    chance = c("pairs_x") * c("pairs_y") / F.nullif(c("total") * (c("total") - 1) / 2, F.lit(0.0))
    most = (c("pairs_x") + c("pairs_y")) / 2
    ari = F.when(most == chance, 1.0).otherwise((c("pairs") - chance) / (most - chance))
    hx, hy = (F.ln("total") - c(f"log_{k}") / c("total") for k in "xy")
    mutual = F.ln("total") + (c("log") - c("log_x") - c("log_y")) / c("total")
    nmi = F.when((hx + hy) == 0, 1.0).otherwise(2 * mutual / (hx + hy))
    alike = F.try_divide(F.least("k_x", "k_y").cast("double"), F.greatest("k_x", "k_y"))
    out = t.select(F.coalesce(ari, F.lit(1.0)).alias("ari"), nmi.alias("nmi"), alike.alias("count_similarity"))
    return out.withColumn("overall", 0.4 * F.col("ari") + 0.4 * F.col("nmi") + 0.2 * F.col("count_similarity"))


# Weights of the categories of cluster quality.
QUALITY_WEIGHTS = {"basic_stats": 0.3, "connectivity": 0.3, "distribution": 0.2, "performance": 0.1, "batch_comparison": 0.1}


def basic_score(assigned: Column, singletons: Column, spread: Column) -> Column:
    """Share assigned, few singletons and even sizes."""
    even = F.greatest(F.lit(0.0), 1 - F.least(spread, F.lit(2.0)) / 2)
    return assigned * 0.5 + (1 - F.least(singletons, F.lit(0.8))) * 0.3 + even * 0.2


def connectivity_score(inner_ratio: Column, density: Column, isolated: Column) -> Column:
    return inner_ratio * 0.4 + density * 0.4 + (1 - isolated) * 0.2


def distribution_score(confidence: Column, strong: Column, skewness: Column) -> Column:
    return confidence * 0.5 + strong * 0.3 + F.greatest(F.lit(0.0), 1 - F.abs(skewness) / 3) * 0.2


def overall_quality(scores: dict[str, Column]) -> Column:
    """Weighted mean of the categories that there are."""
    total = sum(QUALITY_WEIGHTS[k] for k in scores)
    return sum((s * QUALITY_WEIGHTS[k] for k, s in scores.items()), F.lit(0.0)) / total


def quality(tx_edges: DataFrame, assignment: DataFrame, addresses: DataFrame) -> DataFrame:
    """One row: the scores of three categories and their weighted mean."""
    one = F.lit(1).alias("k")
    sizes = size_profile(assignment).select("singleton_ratio", "size_variation", "size_skewness", one)
    known = addresses.select("address").distinct().join(assignment.select("address", "cluster_id").dropDuplicates(["address"]), "address", "left")
    share = known.agg(F.avg(F.col("cluster_id").isNotNull().cast("double")).alias("assigned")).select("*", one)
    links = connectivity(tx_edges, assignment)
    inner, outer = F.sum("inner_pairs"), F.sum("outer_pairs") / 2
    isolated = F.avg(((F.col("inner_pairs") + F.col("outer_pairs")) == 0).cast("double"))
    links = links.agg(F.coalesce(F.try_divide(inner.cast("double"), inner + outer), F.lit(0.0)).alias("inner_ratio"), F.avg("density").alias("density"), isolated.alias("isolated")).select("*", one)
    trust = assignment.agg(F.avg("confidence").alias("confidence"), F.avg((F.col("confidence") > 0.7).cast("double")).alias("strong")).select("*", one)
    c = F.col
    all_ = sizes.join(share, "k").join(links, "k").join(trust, "k")
    scores = {
        "basic_stats": basic_score(c("assigned"), c("singleton_ratio"), c("size_variation")),
        "connectivity": connectivity_score(c("inner_ratio"), c("density"), c("isolated")),
        "distribution": distribution_score(c("confidence"), c("strong"), F.coalesce(F.nanvl("size_skewness", F.lit(0.0)), F.lit(0.0))),
    }
    return all_.select(*[s.alias(k) for k, s in scores.items()], overall_quality(scores).alias("overall"))


def timeline(tx: DataFrame, assignment: DataFrame) -> DataFrame:
    """Transfers and volume of each cluster by day."""
    day = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd").alias("day")
    return cluster_incidence(tx, assignment).groupBy("cluster_id", day).agg(F.count("*").alias("n_tx"), F.sum("value_eth").alias("volume"))


def consensus(evidence: dict[str, DataFrame]) -> DataFrame:
    """Share of the approaches that name an address: a union of flags, no outer joins."""
    rows = None
    for k, df in evidence.items():
        part = df.select("address", F.lit(k).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    n = F.countDistinct("kind")
    return rows.groupBy("address").agg(n.alias("n_sources"), (n / len(evidence)).alias("confidence"), F.array_sort(F.collect_set("kind")).alias("sources"))


def stratified_sample(assignment: DataFrame, share: float) -> DataFrame:
    """The same share of every cluster, at least one member, chosen by the address's hash.

    ``percentile`` would need a cluster in one task; the hash is compared with the share instead.
    """
    h = F.pmod(F.xxhash64("address"), F.lit(1_000_000)) / 1_000_000
    least = assignment.groupBy("cluster_id").agg(F.min_by("address", F.struct(h, F.col("address"))).alias("address"))
    return assignment.where(h < share).select("cluster_id", "address").unionByName(least.select("cluster_id", "address")).distinct()

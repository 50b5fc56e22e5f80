"""Clusters from links: the link graph by the band join, the size rule, and consensus of several assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import components, cut
from .incidence import band_matches, incidence

#: Larger components are no cluster.
MOST_MEMBERS = 1000


def link_graph(tx: DataFrame, excluded: DataFrame | None = None, width: int = 259200) -> DataFrame:
    """(u, v, n_tx): pairs of addresses joined by transfers of a standard amount that has matches elsewhere.

    ``excluded``: addresses (exchanges, protocols, busy ones) that take no part.
    """
    rows = tx.where("from_addr is not null and to_addr is not null and from_addr <> to_addr").join(band_matches(tx, width, farthest=False).select("hash"), "hash", "left_semi")
    pairs = rows.groupBy(F.least("from_addr", "to_addr").alias("u"), F.greatest("from_addr", "to_addr").alias("v")).agg(F.count("*").alias("n_tx"))
    if excluded is not None:
        for end in ("u", "v"):
            pairs = pairs.join(excluded.select(F.col("address").alias(end)), end, "left_anti")
    return pairs.select("u", "v", "n_tx")


def linked_clusters(tx: DataFrame, links: DataFrame, excluded: DataFrame | None = None, most: int = MOST_MEMBERS) -> DataFrame:
    """(address, component, members, cluster_id): an address without links is a cluster of its own; a component of more than ``most`` has no cluster."""
    everyone = incidence(tx).select("address").distinct()
    if excluded is not None:
        everyone = everyone.join(excluded.select("address"), "address", "left_anti")
    of = everyone.join(components(links.select("u", "v")).withColumnRenamed("node", "address"), "address", "left").withColumn("component", F.coalesce("component", "address"))
    sizes = of.groupBy("component").agg(F.count("*").alias("members"))
    return of.join(sizes, "component").select("address", "component", "members", F.when(F.col("members") <= most, F.col("component")).alias("cluster_id"))


def consensus_edges(assignments: DataFrame, most: int = MOST_MEMBERS) -> DataFrame:
    """(u, v, weight): pairs that share a cluster in some assignment (address, cluster_type, cluster_id, confidence).

    A cluster's weight is the confidence of its first address by name; of
    several shared clusters the highest counts.  Clusters of more than ``most``
    addresses, which the size rule does not make, are left out.
    """
    group = ["cluster_type", "cluster_id"]
    heads = assignments.groupBy(*group).agg(F.countDistinct("address").alias("members"), F.min_by("confidence", "address").alias("weight")).where(F.col("members") <= most)
    rows = assignments.select(*group, "address").distinct().join(heads, group)
    met = rows.alias("x").join(rows.alias("y"), group).where("x.address < y.address")
    return met.groupBy(F.col("x.address").alias("u"), F.col("y.address").alias("v")).agg(F.max("x.weight").alias("weight"))


def consensus(assignments: DataFrame, rounds: int = 10, alone: float = 0.1) -> DataFrame:
    """(address, cluster_id, confidence) by weighted label propagation over :func:`consensus_edges`.

    A round gives each address the label with most weight around it (of equals
    the least), its own edge-weighted vote included, and at most ``rounds`` are
    made; confidence is the highest weight of an edge, ``alone`` without one.
    """
    e = cut(consensus_edges(assignments))
    both = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")))
    top = both.groupBy(F.col("u").alias("address")).agg(F.max("weight").alias("confidence"))
    label = cut(assignments.select("address").distinct().withColumn("label", F.col("address")))
    for _ in range(rounds):
        votes = both.join(label.select(F.col("address").alias("v"), "label"), "v").select(F.col("u").alias("address"), "label", "weight")
        own = label.join(top, "address").select("address", "label", F.col("confidence").alias("weight"))
        sums = votes.unionByName(own).groupBy("address", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        best = W.partitionBy("address").orderBy(F.col("w").desc(), "label")
        new = sums.withColumn("n", F.row_number().over(best)).where("n = 1").select("address", F.col("label").alias("new"))
        now = cut(label.join(new, "address", "left").select("address", F.coalesce("new", "label").alias("label")))
        moved = now.join(label.withColumnRenamed("label", "before"), "address").where("label <> before").count()
        label = now
        if not moved:
            break
    return label.join(top, "address", "left").select("address", F.col("label").alias("cluster_id"), F.coalesce("confidence", F.lit(alone)).alias("confidence"))

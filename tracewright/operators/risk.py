"""Evidence and its fusion into one score for each address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Weights of the evidence types.
WEIGHTS = {
    "foundation_risk": 0.2,
    "TORNADO_CASH_INTERACTION": 0.8,
    "PEELING_CHAIN_DETECTED": 0.9,
    "STRUCTURING_DETECTED": 0.9,
    "multihop_risk": 0.85,
    "network_topology": 0.6,
    "gnn_risk": 0.7,
    "graphsage_risk": 0.65,
    "hgn_risk": 0.7,
    "temporal_gnn_risk": 0.75,
    "ANOMALY_DETECTED": 0.5,
    "BEHAVIORAL_SEQUENCE": 0.85,
    "DEPOSIT_WITHDRAWAL_ANOMALY": 0.8,
    "CROSS_CHAIN_RISK_PROPAGATION": 1.0,
    "ZK_PROOF_VULNERABILITY": 1.0,
}
DEFAULT_WEIGHT = 0.05


def component(df: DataFrame, kind: str, score: Column, confidence: Column | float) -> DataFrame:
    """Evidence rows of one type."""
    value = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return df.select("address", F.lit(kind).alias("component_type"), score.cast("double").alias("risk_score"), value.alias("confidence"))


def weight_of(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p])
    return F.coalesce(F.try_element_at(table, kind), F.lit(DEFAULT_WEIGHT))


def category(score: Column) -> Column:
    return F.when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").when(score >= 0.4, "MEDIUM").when(score >= 0.2, "LOW").otherwise("MINIMAL")


def active(evidence: DataFrame, order: str = "created_at") -> DataFrame:
    """The latest row of each address and type: what soft deactivation leaves."""
    latest = W.partitionBy("address", "component_type").orderBy(F.col(order).desc())
    return evidence.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


def final_scores(evidence: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Weighted sum of active evidence through a logistic; a weighted mean confidence."""
    if kinds:
        evidence = evidence.where(F.col("component_type").isin(kinds))
    w, c = F.col("w"), F.col("confidence")
    rows = evidence.withColumn("w", weight_of(F.col("component_type")))
    raw = F.sum(F.col("risk_score") * w * c)
    out = rows.groupBy("address").agg((1 / (1 + F.exp(-5 * (raw - 0.5)))).alias("final_score"), (F.sum(w * c) / F.sum(w)).alias("confidence"))
    return out.withColumn("risk_category", category(F.col("final_score")))


def propagate(scores: DataFrame, assignment: DataFrame) -> DataFrame:
    """A cluster's highest score, given to all of its members.

    An aggregate that joins back, so that a large cluster is not one task.
    """
    joined = scores.join(assignment.select("address", "cluster_id"), "address", "left")
    top = joined.where("cluster_id is not null").groupBy("cluster_id").agg(F.max("final_score").alias("__top"))
    out = joined.join(top, "cluster_id", "left").withColumn("cluster_score", F.when(F.col("cluster_id").isNotNull(), F.col("__top")).otherwise(F.col("final_score")))
    return out.select(*joined.columns, "cluster_score")


def best_assignment(assignments: DataFrame) -> DataFrame:
    order = W.partitionBy("address").orderBy(F.col("confidence").desc(), F.col("created_at").desc(), "cluster_type")
    return assignments.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows replace ``old`` rows with their key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def severity(score: Column) -> Column:
    return F.when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").otherwise("MEDIUM")

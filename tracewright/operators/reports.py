"""Reports over scores and evidence, the data of charts, and the sink that writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .risk import weight_of


def address_report(scores: DataFrame, evidence: DataFrame, assignment: DataFrame) -> DataFrame:
    """Each scored address with its cluster, its evidence by falling score, and the strongest type.

    Ties of score go by type.
    """
    rank = F.struct((-F.col("risk_score")).alias("s"), "component_type")
    types = F.transform(F.array_sort(F.collect_list(rank)), lambda r: r["component_type"])
    found = evidence.groupBy("address").agg(F.array_join(types, ", ").alias("evidence"), F.min_by("component_type", rank).alias("strongest"), F.count("*").alias("n_evidence"))
    return scores.join(assignment.select("address", "cluster_id"), "address", "left").join(found, "address", "left")


def contributions(evidence: DataFrame) -> DataFrame:
    """What each evidence row adds to its address's raw score, and its share of it."""
    rows = evidence.withColumn("contribution", F.col("risk_score") * weight_of(F.col("component_type")) * F.col("confidence"))
    total = rows.groupBy("address").agg(F.sum("contribution").alias("total"))
    return rows.join(total, "address").select("address", "component_type", "contribution", F.coalesce(F.try_divide("contribution", "total"), F.lit(0.0)).alias("share"))


def score_histogram(scores: DataFrame, of: str = "final_score", bins: int = 50) -> DataFrame:
    """Occupied bins of equal width over 0 to 1; 1 is in the last bin."""
    b = F.least(F.floor(F.col(of) * bins), F.lit(bins - 1))
    return scores.where(F.col(of).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def attribution(scores: DataFrame, least: float = 0.8) -> DataFrame:
    """Addresses above ``least``, highest first."""
    return scores.where(F.col("final_score") > least).orderBy(F.col("final_score").desc(), "address")


def evidence_log(evidence: DataFrame, assignments: DataFrame, scores: DataFrame) -> DataFrame:
    """Evidence, assignments and final scores as one log of (address, kind, subject, detail as JSON)."""
    row = lambda df, kind, subject, *cs: df.select("address", F.lit(kind).alias("kind"), subject.alias("subject"), F.to_json(F.struct(*cs)).alias("detail"))
    return (
        row(evidence, "evidence", F.col("component_type"), "risk_score", "confidence")
        .unionByName(row(assignments, "cluster", F.col("cluster_id"), "confidence"))
        .unionByName(row(scores, "final", F.col("risk_category"), "final_score", "confidence"))
    )


def linked_addresses(evidence: DataFrame, column: str = "evidence_json") -> DataFrame:
    """Links held in stored evidence: one row for each of ``linked_addresses``."""
    links = F.from_json(column, "linked_addresses array<string>")["linked_addresses"]
    return evidence.select("address", F.explode(links).alias("linked")).where("linked is not null and linked <> address").distinct()


def heat_map(tx: DataFrame) -> DataFrame:
    """Transfers by weekday (rows) and hour (columns h0 to h23), without gaps."""
    cells = tx.groupBy("day_of_week").pivot("hour_of_day", list(range(24))).count().na.fill(0)
    return cells.select("day_of_week", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, in parallel; arrays and structs as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)

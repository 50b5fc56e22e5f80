"""Statistics that Spark lacks, or defines otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def sample_skewness(x: Column) -> Column:
    """Adjusted for sample size; null below three values or without variance."""
    n = F.count(x)
    return F.when((n > 2) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def variation(x: Column) -> Column:
    """Sample deviation over mean; null where the mean is 0."""
    return F.try_divide(F.stddev_samp(x), F.avg(x))


def entropy(rows: DataFrame, key: list[str], of: str, into: str, base: float | None = 2.0) -> DataFrame:
    """Shannon entropy of ``of`` for each ``key``; null values of ``of`` are left out."""
    counts = rows.where(F.col(of).isNotNull()).groupBy(*key, of).agg(F.count("*").alias("n"))
    total, terms = F.sum("n"), F.sum(F.col("n") * F.ln("n"))
    h = F.ln(total) - terms / total
    return counts.groupBy(*key).agg(F.when(F.count("*") <= 1, 0.0).otherwise(h / (F.ln(F.lit(base)) if base else 1)).alias(into))


def gini(rows: DataFrame, key: list[str], of: str, into: str) -> DataFrame:
    """Gini coefficient; 0 for a single value or a sum of 0."""
    i = F.row_number().over(W.partitionBy(*key).orderBy(of))
    n, total = F.count("*"), F.sum(of)
    g = 2 * F.sum(F.col("i") * F.col(of)) / (n * total) - (n + 1) / n
    return rows.where(F.col(of).isNotNull()).withColumn("i", i).groupBy(*key).agg(F.when((n <= 1) | (total == 0), 0.0).otherwise(g).alias(into))


def equal_width_bin(x: Column, low: Column, high: Column, bins: int = 10) -> Column:
    """1 to ``bins``; the least value is in the first one; a constant has one bin."""
    return F.when(high == low, 1).otherwise(F.least(F.greatest(F.ceil((x - low) / ((high - low) / bins)), F.lit(1)), F.lit(bins))).cast("int")


def is_round(value: Column) -> Column:
    """A positive multiple of 0.01, decided in decimal arithmetic."""
    return (value > 0) & (F.round(value, 9).cast("decimal(38,9)") % F.lit("0.01").cast("decimal(3,2)") == 0)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def smoothed_entropy(rows: DataFrame, key: list[str], of: str, bins: int, into: str) -> DataFrame:
    """Natural entropy over a fixed number of bins, one added to each count.

    Empty bins add 1 * ln 1 = 0 to the sum, so only occupied ones are needed.
    """
    counts = rows.where(F.col(of).isNotNull()).groupBy(*key, of).agg((F.count("*") + 1).alias("n"))
    total = F.sum(F.col("n") - 1) + bins
    return counts.groupBy(*key).agg((F.ln(total) - F.sum(F.col("n") * F.ln("n")) / total).alias(into))

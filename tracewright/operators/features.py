"""The address features, in seven families.

Every family is an aggregate over the incidence rows of an address; gaps to the
previous transaction and statistics over all of an address's rows are windows on
the same key, so a family costs one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import entropy, equal_width_bin, gini, is_round, sample_skewness, share
from .incidence import counterparty, incidence

EPS = 1e-10


def me():
    return W.partitionBy("address")


def by_time():
    return me().orderBy("timestamp", "hash")


def hours(*which: int) -> Column:
    return F.col("hour_of_day").isin(*which)


def with_gaps(inc: DataFrame) -> DataFrame:
    return inc.withColumns(
        {
            "gap": F.col("timestamp") - F.lag("timestamp").over(by_time()),
            "block_gap": F.col("block_number") - F.lag("block_number").over(by_time()),
        }
    )


def zeros(*names: str) -> list[Column]:
    return [F.lit(0.0).alias(n) for n in names]


def temporal(inc: DataFrame) -> DataFrame:
    gap = F.col("gap") / 3600
    n, span = F.count("*"), (F.max("timestamp") - F.min("timestamp")) / 86400 + 1
    many = lambda x: F.when(n > 1, x).otherwise(0.0)
    std = F.stddev_pop(gap)
    return with_gaps(inc).groupBy("address").agg(
        span.alias("activity_span_days"),
        (n / span).alias("tx_frequency_daily"),
        (n / span * 7).alias("tx_frequency_weekly"),
        F.countDistinct("day_of_week").alias("active_days_count"),
        F.countDistinct("hour_of_day").alias("active_hours_count"),
        F.mode("hour_of_day", True).alias("peak_activity_hour"),
        share(F.col("day_of_week").isin(5, 6)).alias("weekend_activity_ratio"),
        share(hours(22, 23, 0, 1, 2, 3, 4, 5)).alias("night_activity_ratio"),
        many(F.avg(gap)).alias("avg_time_gap_hours"),
        many(F.var_pop(gap)).alias("time_gap_variance"),
        many(F.max(gap) / 24).alias("max_inactive_period_days"),
        F.count_if(gap < 1).alias("burst_activity_count"),
        many(F.when(std > 0, 1 / (1 + std)).otherwise(1.0)).alias("temporal_regularity_score"),
        *zeros("temporal_entropy", "circadian_rhythm_strength", "temporal_clustering_score"),
    )


def economic(inc: DataFrame) -> DataFrame:
    rows = inc.where("value_eth is not null").withColumns(
        {
            "incoming": F.col("to_addr") == F.col("address"),
            "q25": F.percentile("value_eth", 0.25).over(me()),
            "q75": F.percentile("value_eth", 0.75).over(me()),
            "bin": equal_width_bin(F.col("value_eth"), F.min("value_eth").over(me()), F.max("value_eth").over(me())),
        }
    )
    v = F.col("value_eth")
    into = F.sum(F.when(F.coalesce(F.col("incoming"), F.lit(False)), v).otherwise(0.0))
    out = F.sum(F.when(F.coalesce(F.col("incoming"), F.lit(False)), 0.0).otherwise(v))
    base = rows.groupBy("address").agg(
        F.sum(v).alias("total_volume_eth"), into.alias("incoming_volume_eth"), out.alias("outgoing_volume_eth"), (into - out).alias("net_flow_eth"),
        F.avg(v).alias("avg_value"), F.median(v).alias("median_value"), F.max(v).alias("max_value"), F.min(v).alias("min_value"),
        F.var_samp(v).alias("value_variance"), F.stddev_samp(v).alias("value_std_deviation"), sample_skewness(v).alias("value_skewness"),
        (F.stddev_samp(v) / (F.avg(v) + EPS)).alias("coefficient_of_variation"),
        ((into - out) / ((F.max("timestamp") - F.min("timestamp")) / 86400 + 1)).alias("wealth_accumulation_rate"),
        share(v >= F.col("q75")).alias("large_tx_ratio"), share(v <= F.col("q25")).alias("small_tx_ratio"), share(is_round(v)).alias("round_number_ratio"),
    )
    return base.join(gini(rows, ["address"], "value_eth", "gini_coefficient"), "address").join(entropy(rows, ["address"], "bin", "economic_diversity_score"), "address")


def behavioral(inc: DataFrame) -> DataFrame:
    a, n = F.col("address"), F.count("*")
    into, out = F.count_if(F.col("to_addr") == a), F.count_if(F.col("from_addr") == a)
    rows = inc.withColumn("other", counterparty())
    base = rows.groupBy("address").agg(
        n.alias("total_tx_count"), into.alias("incoming_tx_count"), out.alias("outgoing_tx_count"), (out / (into + EPS)).alias("tx_direction_ratio"),
        share(F.col("is_self_transaction")).alias("self_transaction_ratio"), share(F.col("is_zero_value")).alias("zero_value_tx_ratio"), share(F.col("has_method")).alias("contract_interaction_ratio"),
        F.countDistinct("method_name").alias("unique_methods_count"), (1 - F.countDistinct("other") / n).alias("repeat_counterparty_ratio"),
        F.avg("gas").alias("avg_gas_per_tx"), F.var_samp("gas").alias("gas_usage_variance"), F.var_samp("gas_price_gwei").alias("gas_price_variance"),
        *zeros("gas_optimization_score", "automation_likelihood", "interaction_complexity", "behavioral_consistency", "pattern_entropy", "operational_sophistication"),
    )
    loyal = rows.where("other is not null").groupBy("address", "other").count().groupBy("address").agg((F.max("count") / F.sum("count")).alias("counterparty_loyalty"))
    return base.join(entropy(rows, ["address"], "method_name", "method_diversity_entropy"), "address", "left").join(loyal, "address", "left")


def risk(inc: DataFrame) -> DataFrame:
    v, n = F.col("value_eth"), F.count("*")
    rows = with_gaps(inc).withColumns(
        {
            "other": counterparty(),
            "g_avg": F.avg("gas_price_gwei").over(me()), "g_std": F.stddev_samp("gas_price_gwei").over(me()),
            "v_avg": F.avg("value_eth").over(me()), "v_std": F.stddev_samp("value_eth").over(me()),
        }
    )
    tenth = F.round(v, 9).cast("decimal(38,9)") % F.lit("0.1").cast("decimal(2,1)") == 0
    base = rows.groupBy("address").agg(
        share(F.col("hour_of_day").between(2, 6)).alias("unusual_timing_score"),
        share(F.abs(F.col("gas_price_gwei") - F.col("g_avg")) > 3 * F.col("g_std")).alias("gas_price_anomaly_score"),
        share(v > F.col("v_avg") + 2 * F.col("v_std")).alias("volume_spike_indicator"),
        (F.countDistinct("other") / n).alias("mixing_behavior_score"),
        share((v > 0) & (v <= 1) & tenth).alias("privacy_seeking_score"),
        (F.count_if(F.col("gap") < 300) / n).alias("high_frequency_burst_score"),
        share(is_round(v)).alias("round_amount_preference"),
        *zeros("evasion_pattern_score"),
    )
    c = F.col
    base = base.withColumn("laundering_risk_indicator", (c("mixing_behavior_score") + c("evasion_pattern_score") + c("privacy_seeking_score")) / 3)
    base = base.withColumn("anonymity_behavior_score", (c("unusual_timing_score") + c("privacy_seeking_score") + c("round_amount_preference")) / 3)
    base = base.withColumn("suspicious_timing_pattern", (c("unusual_timing_score") + c("high_frequency_burst_score")) / 2)
    return base.withColumn("composite_risk_score", (c("laundering_risk_indicator") + c("anonymity_behavior_score") + c("suspicious_timing_pattern") + c("volume_spike_indicator")) / 4)


def operational(inc: DataFrame) -> DataFrame:
    rows = with_gaps(inc).withColumn("q80", F.percentile("gas_price", 0.8).over(me()))
    n = F.count("*")
    many = lambda x: F.when(n > 1, F.coalesce(x, F.lit(0.0))).otherwise(0.0)
    steady = lambda x: 1 / (1 + F.stddev_pop(x) / (F.avg(x) + EPS))
    functions, methods = F.countDistinct("function_name"), F.countDistinct("method_name")
    c = F.col
    base = rows.groupBy("address").agg(
        F.avg("gas").alias("avg_gas_limit"), F.avg("gas").alias("avg_gas_used"),
        F.count_if(c("method_name") == "constructor").alias("contract_deployment_count"), share(c("has_method")).alias("contract_call_frequency"),
        functions.alias("advanced_function_usage"), ((functions + methods) / 20).alias("operational_complexity"),
        many(steady(c("gas"))).alias("gas_efficiency_ratio"), many(steady(c("gas_price_gwei"))).alias("gas_price_strategy"),
        many(share(c("gas_price") >= c("q80"))).alias("priority_fee_behavior"),
        many(F.when(F.avg("block_gap") > 0, 1 / (1 + F.stddev_pop("block_gap") / F.avg("block_gap"))).otherwise(0.0)).alias("block_timing_consistency"),
        (F.count_if(c("gap") < 60) / n).alias("batch_transaction_score"), *zeros("gas_optimization_trend"),
    )
    base = base.withColumn("mev_resistance_score", (c("gas_price_strategy") + c("block_timing_consistency")) / 2)
    base = base.withColumn("technical_sophistication", (c("operational_complexity") + c("gas_efficiency_ratio") + c("gas_price_strategy") + c("block_timing_consistency")) / 4)
    return base.withColumn("infrastructure_usage", (c("contract_call_frequency") + c("batch_transaction_score") + c("priority_fee_behavior")) / 3)


def contextual(inc: DataFrame) -> DataFrame:
    rows = inc.withColumn("q70", F.percentile("gas_price", 0.7).over(me()))
    week, n = F.col("day_of_week") < 5, F.count("*")
    office = share(F.col("hour_of_day").between(9, 17) & week)
    congested = F.when(n > 1, share(F.col("gas_price") > F.col("q70"))).otherwise(0.0)
    peak = share(hours(9, 10, 11, 14, 15, 16, 17))
    base = rows.groupBy("address").agg(
        peak.alias("peak_hours_preference"), share(hours(22, 23, 0, 1, 2, 3, 4, 5, 6)).alias("off_peak_activity"),
        (F.count_if(week) / (F.count_if(~week) + EPS)).alias("weekday_vs_weekend_ratio"), office.alias("institutional_timing"), (1 - office).alias("retail_behavior_score"),
        congested.alias("network_congestion_behavior"), congested.alias("fee_market_adaptation"), ((peak + congested) / 2).alias("ecosystem_participation"),
        *zeros("market_timing_correlation", "seasonal_activity_pattern", "economic_event_sensitivity", "bear_market_behavior", "bull_market_behavior", "crisis_period_activity"),
    )
    days = rows.groupBy("address", F.floor(F.col("timestamp") / 86400).alias("day")).count()
    swing = days.groupBy("address").agg(F.when(F.count("*") < 2, 0.0).otherwise(F.least(F.lit(1.0), F.stddev_samp("count") / (F.avg("count") + EPS))).alias("market_volatility_response"))
    return base.join(swing, "address")


FAMILIES = {"temporal": temporal, "economic": economic, "behavioral": behavioral, "risk": risk, "operational": operational, "contextual": contextual}


def matrix(tx: DataFrame, network: DataFrame | None = None) -> DataFrame:
    """All features of every address; ``network`` comes from the graph operators."""
    inc = incidence(tx)
    parts = [f(inc) for f in FAMILIES.values()] + ([network] if network is not None else [])
    return reduce(lambda a, b: a.join(b, "address", "left"), parts)


def validation(features: DataFrame, expected: int) -> DataFrame:
    """Feature count, missing share, constant columns and values outside +-1000, in one pass."""
    names = [c for c in features.columns if c != "address"]
    x = {c: F.col(c).cast("double") for c in names}
    total = reduce(lambda a, b: a + b, [F.sum(v.isNull().cast("int")) for v in x.values()])
    constant = reduce(lambda a, b: a + b, [(F.coalesce(F.max(v) == F.min(v), F.lit(True))).cast("int") for v in x.values()])
    outside = reduce(lambda a, b: a + b, [F.coalesce(F.count_if(F.abs(v) > 1000), F.lit(0)) for v in x.values()])
    return features.agg(
        F.lit(len(names)).alias("n_features"), F.lit(len(names) == expected).alias("complete"),
        (total / (F.count("*") * len(names))).alias("missing_ratio"), constant.alias("n_constant"), outside.alias("n_outside"),
    )

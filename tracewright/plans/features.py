"""Registered queries: ledger cleaning, incidence and the feature families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as O
from ..operators.incidence import incidence
from ..sources.ledger import INCIDENCE, TX, event_ledger
from .catalog import outer, query, rounded

WITH = f"WITH {TX}, {INCIDENCE}"
GAPS = """g AS (SELECT *, timestamp - lag(timestamp) OVER w AS gap, block_number - lag(block_number) OVER w AS block_gap FROM inc WINDOW w AS (PARTITION BY address ORDER BY timestamp, hash))"""


def _inc(spark, sf_dir):
    return incidence(event_ledger(spark, sf_dir))


@query(f"WITH {TX} SELECT hash, timestamp::BIGINT AS timestamp, from_addr, to_addr, round(value_eth, 6) + 0.0 AS value_eth, gas::BIGINT AS gas, gas_price::BIGINT AS gas_price, method_name, day_of_week::BIGINT AS day_of_week, hour_of_day::BIGINT AS hour_of_day, is_self_transaction, is_zero_value, has_method FROM tx")
def c3_enriched_ledger(spark, sf_dir):
    return rounded(event_ledger(spark, sf_dir).select("hash", "timestamp", "from_addr", "to_addr", "value_eth", "gas", "gas_price", "method_name", "day_of_week", "hour_of_day", "is_self_transaction", "is_zero_value", "has_method"))


@query(f"{WITH} SELECT address, count(*)::BIGINT AS n_tx, count(DISTINCT hash)::BIGINT AS n_hash, min(timestamp)::BIGINT AS first_seen, max(timestamp)::BIGINT AS last_seen FROM inc GROUP BY address")
def j1_incidence(spark, sf_dir):
    return rounded(_inc(spark, sf_dir).groupBy("address").agg(F.count("*").alias("n_tx"), F.countDistinct("hash").alias("n_hash"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")))


F1 = """SELECT address, (max(timestamp) - min(timestamp)) / 86400 + 1 AS activity_span_days, count(*) / activity_span_days AS tx_frequency_daily, count(*) / activity_span_days * 7 AS tx_frequency_weekly,
 count(DISTINCT day_of_week) AS active_days_count, count(DISTINCT hour_of_day) AS active_hours_count,
 (SELECT h FROM (SELECT hour_of_day AS h, count(*) AS n FROM inc i WHERE i.address = g.address GROUP BY 1 ORDER BY n DESC, h LIMIT 1)) AS peak_activity_hour,
 avg((day_of_week IN (5, 6))::INT) AS weekend_activity_ratio, avg((hour_of_day IN (22,23,0,1,2,3,4,5))::INT) AS night_activity_ratio,
 CASE WHEN count(*) > 1 THEN avg(gap / 3600) ELSE 0 END AS avg_time_gap_hours, CASE WHEN count(*) > 1 THEN var_pop(gap / 3600) ELSE 0 END AS time_gap_variance,
 CASE WHEN count(*) > 1 THEN max(gap / 3600) / 24 ELSE 0 END AS max_inactive_period_days, count(*) FILTER (gap < 3600) AS burst_activity_count,
 CASE WHEN count(*) > 1 THEN CASE WHEN stddev_pop(gap / 3600) > 0 THEN 1 / (1 + stddev_pop(gap / 3600)) ELSE 1 END ELSE 0 END AS temporal_regularity_score,
 0.0::DOUBLE AS temporal_entropy, 0.0::DOUBLE AS circadian_rhythm_strength, 0.0::DOUBLE AS temporal_clustering_score FROM g GROUP BY address"""


@query(f"{WITH}, {GAPS} " + outer(F1, "address ~activity_span_days ~tx_frequency_daily ~tx_frequency_weekly #active_days_count #active_hours_count #peak_activity_hour ~weekend_activity_ratio ~night_activity_ratio ~avg_time_gap_hours ~time_gap_variance ~max_inactive_period_days #burst_activity_count ~temporal_regularity_score ~temporal_entropy ~circadian_rhythm_strength ~temporal_clustering_score"))
def f1_temporal_features(spark, sf_dir):
    return rounded(O.temporal(_inc(spark, sf_dir)))


F2 = """SELECT v.*, gini_coefficient, economic_diversity_score FROM (
 SELECT address, sum(value_eth) AS total_volume_eth, coalesce(sum(value_eth) FILTER (to_addr = address), 0) AS incoming_volume_eth, coalesce(sum(value_eth) FILTER (to_addr IS DISTINCT FROM address), 0) AS outgoing_volume_eth,
  incoming_volume_eth - outgoing_volume_eth AS net_flow_eth, avg(value_eth) AS avg_value, median(value_eth) AS median_value, max(value_eth) AS max_value, min(value_eth) AS min_value,
  var_samp(value_eth) AS value_variance, stddev_samp(value_eth) AS value_std_deviation, CASE WHEN count(*) > 2 AND var_pop(value_eth) > 0 THEN skewness(value_eth) END AS value_skewness,
  stddev_samp(value_eth) / (avg(value_eth) + 1e-10) AS coefficient_of_variation, net_flow_eth / ((max(timestamp) - min(timestamp)) / 86400 + 1) AS wealth_accumulation_rate,
  avg((value_eth >= q75)::INT) AS large_tx_ratio, avg((value_eth <= q25)::INT) AS small_tx_ratio, avg((value_eth > 0 AND round(value_eth, 9)::DECIMAL(38,9) % 0.01 = 0)::INT) AS round_number_ratio
 FROM q GROUP BY address) v
 JOIN (SELECT address, CASE WHEN count(*) <= 1 OR sum(value_eth) = 0 THEN 0 ELSE 2 * sum(i * value_eth) / (count(*) * sum(value_eth)) - (count(*) + 1) / count(*) END AS gini_coefficient
   FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY value_eth) AS i FROM inc) GROUP BY address) USING (address)
 JOIN (SELECT address, CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(p * log2(p)) END AS economic_diversity_score FROM (SELECT address, bin, count(*) / sum(count(*)) OVER (PARTITION BY address) AS p FROM q GROUP BY address, bin) GROUP BY address) USING (address)"""
Q2 = """q AS (SELECT i.*, q25, q75, CASE WHEN hi = lo THEN 1 ELSE least(greatest(ceil((value_eth - lo) / ((hi - lo) / 10)), 1), 10) END AS bin FROM inc i JOIN
 (SELECT address, quantile_cont(value_eth, 0.25) AS q25, quantile_cont(value_eth, 0.75) AS q75, min(value_eth) AS lo, max(value_eth) AS hi FROM inc GROUP BY address) USING (address))"""


@query(f"{WITH}, {Q2} " + outer(F2, "address ~total_volume_eth ~incoming_volume_eth ~outgoing_volume_eth ~net_flow_eth ~avg_value ~median_value ~max_value ~min_value ~value_variance ~value_std_deviation ~value_skewness ~coefficient_of_variation ~wealth_accumulation_rate ~large_tx_ratio ~small_tx_ratio ~round_number_ratio ~gini_coefficient ~economic_diversity_score", 5))
def f2_economic_features(spark, sf_dir):
    return rounded(O.economic(_inc(spark, sf_dir)), 5)


F4 = """SELECT b.*, method_diversity_entropy, counterparty_loyalty FROM (
 SELECT address, count(*) AS total_tx_count, count(*) FILTER (to_addr = address) AS incoming_tx_count, count(*) FILTER (from_addr = address) AS outgoing_tx_count, outgoing_tx_count / (incoming_tx_count + 1e-10) AS tx_direction_ratio,
  avg(is_self_transaction::INT) AS self_transaction_ratio, avg(is_zero_value::INT) AS zero_value_tx_ratio, avg(has_method::INT) AS contract_interaction_ratio, count(DISTINCT method_name) AS unique_methods_count,
  1 - count(DISTINCT other) / count(*) AS repeat_counterparty_ratio, avg(gas) AS avg_gas_per_tx, var_samp(gas) AS gas_usage_variance, var_samp(gas_price / 1e9) AS gas_price_variance,
  0.0::DOUBLE AS gas_optimization_score, 0.0::DOUBLE AS automation_likelihood, 0.0::DOUBLE AS interaction_complexity, 0.0::DOUBLE AS behavioral_consistency, 0.0::DOUBLE AS pattern_entropy, 0.0::DOUBLE AS operational_sophistication FROM o GROUP BY address) b
 LEFT JOIN (SELECT address, CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(p * log2(p)) END AS method_diversity_entropy FROM (SELECT address, method_name, count(*) / sum(count(*)) OVER (PARTITION BY address) AS p FROM inc GROUP BY address, method_name) GROUP BY address) USING (address)
 LEFT JOIN (SELECT address, max(n) / sum(n) AS counterparty_loyalty FROM (SELECT address, other, count(*) AS n FROM o WHERE other IS NOT NULL GROUP BY ALL) GROUP BY address) USING (address)"""
OTHER = "o AS (SELECT *, CASE WHEN to_addr = address THEN from_addr ELSE to_addr END AS other FROM inc)"


@query(f"{WITH}, {OTHER} " + outer(F4, "address #total_tx_count #incoming_tx_count #outgoing_tx_count ~tx_direction_ratio ~self_transaction_ratio ~zero_value_tx_ratio ~contract_interaction_ratio #unique_methods_count ~repeat_counterparty_ratio ~avg_gas_per_tx ~gas_usage_variance ~gas_price_variance ~gas_optimization_score ~automation_likelihood ~interaction_complexity ~behavioral_consistency ~pattern_entropy ~operational_sophistication ~method_diversity_entropy ~counterparty_loyalty", 5))
def f4_behavioral_features(spark, sf_dir):
    return rounded(O.behavioral(_inc(spark, sf_dir)), 5)


F5 = """SELECT *, (mixing_behavior_score + evasion_pattern_score + privacy_seeking_score) / 3 AS laundering_risk_indicator, (unusual_timing_score + privacy_seeking_score + round_amount_preference) / 3 AS anonymity_behavior_score,
 (unusual_timing_score + high_frequency_burst_score) / 2 AS suspicious_timing_pattern, (laundering_risk_indicator + anonymity_behavior_score + suspicious_timing_pattern + volume_spike_indicator) / 4 AS composite_risk_score FROM (
 SELECT address, avg((hour_of_day BETWEEN 2 AND 6)::INT) AS unusual_timing_score, avg(coalesce(abs(gas_price_gwei - g_avg) > 3 * g_std, false)::INT) AS gas_price_anomaly_score, avg(coalesce(value_eth > v_avg + 2 * v_std, false)::INT) AS volume_spike_indicator,
  count(DISTINCT CASE WHEN to_addr = address THEN from_addr ELSE to_addr END) / count(*) AS mixing_behavior_score, avg((value_eth > 0 AND value_eth <= 1 AND round(value_eth, 9)::DECIMAL(38,9) % 0.1 = 0)::INT) AS privacy_seeking_score,
  count(*) FILTER (gap < 300) / count(*) AS high_frequency_burst_score, avg((value_eth > 0 AND round(value_eth, 9)::DECIMAL(38,9) % 0.01 = 0)::INT) AS round_amount_preference, 0.0::DOUBLE AS evasion_pattern_score
 FROM (SELECT *, avg(gas_price_gwei) OVER a AS g_avg, stddev_samp(gas_price_gwei) OVER a AS g_std, avg(value_eth) OVER a AS v_avg, stddev_samp(value_eth) OVER a AS v_std FROM g WINDOW a AS (PARTITION BY address)) GROUP BY address)"""
F5_COLUMNS = "address ~unusual_timing_score ~gas_price_anomaly_score ~volume_spike_indicator ~mixing_behavior_score ~privacy_seeking_score ~high_frequency_burst_score ~round_amount_preference ~evasion_pattern_score ~laundering_risk_indicator ~anonymity_behavior_score ~suspicious_timing_pattern ~composite_risk_score"


@query(f"{WITH}, {GAPS} " + outer(F5, F5_COLUMNS))
def f5_risk_features(spark, sf_dir):
    return rounded(O.risk(_inc(spark, sf_dir)))


F6 = """SELECT *, (gas_price_strategy + block_timing_consistency) / 2 AS mev_resistance_score, (operational_complexity + gas_efficiency_ratio + gas_price_strategy + block_timing_consistency) / 4 AS technical_sophistication,
 (contract_call_frequency + batch_transaction_score + priority_fee_behavior) / 3 AS infrastructure_usage FROM (
 SELECT address, avg(gas) AS avg_gas_limit, avg(gas) AS avg_gas_used, count(*) FILTER (method_name = 'constructor') AS contract_deployment_count, avg(has_method::INT) AS contract_call_frequency, count(DISTINCT function_name) AS advanced_function_usage,
  (count(DISTINCT function_name) + count(DISTINCT method_name)) / 20 AS operational_complexity, CASE WHEN count(*) > 1 THEN 1 / (1 + stddev_pop(gas) / (avg(gas) + 1e-10)) ELSE 0 END AS gas_efficiency_ratio,
  CASE WHEN count(*) > 1 THEN 1 / (1 + stddev_pop(gas_price_gwei) / (avg(gas_price_gwei) + 1e-10)) ELSE 0 END AS gas_price_strategy, CASE WHEN count(*) > 1 THEN avg((gas_price >= q80)::INT) ELSE 0 END AS priority_fee_behavior,
  CASE WHEN count(*) > 1 AND avg(block_gap) > 0 THEN 1 / (1 + stddev_pop(block_gap) / avg(block_gap)) ELSE 0 END AS block_timing_consistency, count(*) FILTER (gap < 60) / count(*) AS batch_transaction_score, 0.0::DOUBLE AS gas_optimization_trend
 FROM g JOIN (SELECT address, quantile_cont(gas_price::DOUBLE, 0.8) AS q80 FROM inc GROUP BY address) USING (address) GROUP BY address)"""


@query(f"{WITH}, {GAPS} " + outer(F6, "address ~avg_gas_limit ~avg_gas_used #contract_deployment_count ~contract_call_frequency #advanced_function_usage ~operational_complexity ~gas_efficiency_ratio ~gas_price_strategy ~priority_fee_behavior ~block_timing_consistency ~batch_transaction_score ~gas_optimization_trend ~mev_resistance_score ~technical_sophistication ~infrastructure_usage"))
def f6_operational_features(spark, sf_dir):
    return rounded(O.operational(_inc(spark, sf_dir)))


F7 = """SELECT b.*, (peak_hours_preference + network_congestion_behavior) / 2 AS ecosystem_participation, market_volatility_response FROM (
 SELECT address, avg((hour_of_day IN (9,10,11,14,15,16,17))::INT) AS peak_hours_preference, avg((hour_of_day IN (22,23,0,1,2,3,4,5,6))::INT) AS off_peak_activity,
  count(*) FILTER (day_of_week < 5) / (count(*) FILTER (day_of_week >= 5) + 1e-10) AS weekday_vs_weekend_ratio, avg((hour_of_day BETWEEN 9 AND 17 AND day_of_week < 5)::INT) AS institutional_timing, 1 - institutional_timing AS retail_behavior_score,
  CASE WHEN count(*) > 1 THEN avg((gas_price > q70)::INT) ELSE 0 END AS network_congestion_behavior, network_congestion_behavior AS fee_market_adaptation,
  0.0::DOUBLE AS market_timing_correlation, 0.0::DOUBLE AS seasonal_activity_pattern, 0.0::DOUBLE AS economic_event_sensitivity, 0.0::DOUBLE AS bear_market_behavior, 0.0::DOUBLE AS bull_market_behavior, 0.0::DOUBLE AS crisis_period_activity
 FROM inc JOIN (SELECT address, quantile_cont(gas_price::DOUBLE, 0.7) AS q70 FROM inc GROUP BY address) USING (address) GROUP BY address) b
 JOIN (SELECT address, CASE WHEN count(*) < 2 THEN 0 ELSE least(1, stddev_samp(n) / (avg(n) + 1e-10)) END AS market_volatility_response FROM (SELECT address, timestamp // 86400 AS day, count(*) AS n FROM inc GROUP BY ALL) GROUP BY address) USING (address)"""


@query(f"{WITH} " + outer(F7, "address ~peak_hours_preference ~off_peak_activity ~weekday_vs_weekend_ratio ~institutional_timing ~retail_behavior_score ~network_congestion_behavior ~fee_market_adaptation ~market_timing_correlation ~seasonal_activity_pattern ~economic_event_sensitivity ~bear_market_behavior ~bull_market_behavior ~crisis_period_activity ~ecosystem_participation ~market_volatility_response", 5))
def f7_contextual_features(spark, sf_dir):
    return rounded(O.contextual(_inc(spark, sf_dir)), 5)


@query()
def f8_feature_matrix(spark, sf_dir):
    from ..operators.graph import network_features

    tx = event_ledger(spark, sf_dir)
    return O.matrix(tx, network_features(tx))


@query()
def f10_feature_validation(spark, sf_dir):
    """All seven families, the network family included."""
    from ..operators.graph import network_features

    tx = event_ledger(spark, sf_dir)
    return O.validation(O.matrix(tx, network_features(tx)), 111)


COMPONENT = "SELECT address, 'foundation_risk' AS component_type, composite_risk_score AS risk_score, 0.85::DOUBLE AS confidence FROM f5"


@query(f"{WITH}, {GAPS}, f5 AS ({F5}) " + outer(COMPONENT, "address component_type ~risk_score ~confidence"))
def f9_foundation_component(spark, sf_dir):
    from ..operators.risk import component

    return rounded(component(O.risk(_inc(spark, sf_dir)), "foundation_risk", F.col("composite_risk_score"), 0.85))


R1 = """SELECT address, 1 / (1 + exp(-5 * (sum(risk_score * w * confidence) - 0.5))) AS final_score, sum(w * confidence) / sum(w) AS confidence,
 CASE WHEN final_score >= 0.8 THEN 'CRITICAL' WHEN final_score >= 0.6 THEN 'HIGH' WHEN final_score >= 0.4 THEN 'MEDIUM' WHEN final_score >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END AS risk_category
 FROM (SELECT *, 0.2::DOUBLE AS w FROM c) GROUP BY address"""


@query(f"{WITH}, {GAPS}, f5 AS ({F5}), c AS ({COMPONENT}) " + outer(R1, "address ~final_score ~confidence risk_category"))
def r1_final_risk_score(spark, sf_dir):
    from ..operators.risk import component, final_scores

    return rounded(final_scores(component(O.risk(_inc(spark, sf_dir)), "foundation_risk", F.col("composite_risk_score"), 0.85)))

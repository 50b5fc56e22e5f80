"""Scoring of single transfers: features, rules, the models' weighted composite, thresholds and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the models, of the rules, and the percentiles that set thresholds.
MODEL_WEIGHTS = {"random_forest": 1.0, "gradient_boosting": 1.2, "xgboost": 1.3, "neural_network": 1.1}
RULES = {"is_tornado_method": 0.3, "is_mixer_method": 0.25, "is_round_value": 0.1}
STANDARD = (0.1, 1.0, 10.0, 100.0, 1000.0)


def transfer_features(tx: DataFrame, mixers: DataFrame | None = None) -> DataFrame:
    """``tx`` with flags of kind, method, value and addresses, as doubles; a null gives 0."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    method, v = F.lower("method_name"), F.col("value_eth")
    out = tx.withColumns({
        "is_deposit": flag(method == "deposit"), "is_withdrawal": flag(method == "withdraw"), "is_transfer": flag(method == "transfer"),
        "is_tornado_method": flag(method.contains("tornado")), "is_swap_method": flag(method.contains("swap")), "is_mixer_method": flag(method.rlike("mix|tumble|anonymize")),
        "is_round_value": flag(v.isin(*STANDARD)), "is_small_value": flag(v < 0.1), "is_large_value": flag(v > 100), "address_reuse": flag(F.col("from_addr") == F.col("to_addr")),
    })
    if mixers is not None:
        known = mixers.select(F.col("contract").alias("to_addr"), F.lit(1.0).alias("is_known_mixer")).distinct()
        out = out.join(known, "to_addr", "left").withColumn("is_known_mixer", F.coalesce("is_known_mixer", F.lit(0.0)))
    return out


def rule_score(anomaly: Column | None = None, timing: Column | None = None) -> Column:
    """Sum of the rules' weights for the flags that hold, at most 1; ``anomaly`` and ``timing`` above 0.7 add 0.2 and 0.15."""
    total = sum((F.when(F.col(c) > 0.5, w).otherwise(0.0) for c, w in RULES.items()), F.lit(0.0))
    for score, w in ((anomaly, 0.2), (timing, 0.15)):
        if score is not None:
            total = total + F.when(score > 0.7, w).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def cleaned(x: Column) -> Column:
    """Nulls and what is not finite as 0, the rest between -1e10 and 1e10."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.greatest(F.lit(-1e10), F.least(F.lit(1e10), x)))


def model_weight(model: str, accuracy: float | None = None) -> float:
    """A model's weight, scaled by half plus its accuracy once that is known."""
    return MODEL_WEIGHTS.get(model, 1.0) * (1.0 if accuracy is None else 0.5 + accuracy)


def composite(scores: dict[str, Column], accuracies: dict[str, float] | None = None) -> Column:
    """Weighted mean of the models' scores, between 0 and 1; missing scores do not count."""
    weigh = {m: model_weight(m, (accuracies or {}).get(m)) for m in scores}
    total = sum((F.coalesce(s * weigh[m], F.lit(0.0)) for m, s in scores.items()), F.lit(0.0))
    weight = sum((F.when(s.isNotNull(), weigh[m]).otherwise(0.0) for m, s in scores.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(weight > 0, total / weight).otherwise(0.0)))


def level(score: Column) -> Column:
    return F.when(score >= 0.8, "critical").when(score >= 0.6, "high").when(score >= 0.4, "medium").when(score >= 0.2, "low").otherwise("minimal")


def factors(mixer: Column, scores: list[Column]) -> Column:
    high = sum((F.coalesce(s > 0.7, F.lit(False)).cast("int") for s in scores), F.lit(0))
    return F.array_compact(F.array(F.when(mixer, "tornado_interaction"), F.when(high > 2, "multiple_model_alerts")))


def advice(score: Column, rapid: Column | None = None) -> Column:
    """What to do, by score; ``rapid`` adds watching the sequence."""
    words = lambda *w: F.array(*map(F.lit, w))
    by_score = (
        F.when(score > 0.8, words("immediate_investigation", "freeze_suspicious_addresses", "alert_compliance_team"))
        .when(score > 0.6, words("enhanced_monitoring", "request_additional_verification"))
        .when(score > 0.4, words("standard_monitoring", "periodic_review")).otherwise(words("routine_processing"))
    )
    return by_score if rapid is None else F.concat(by_score, F.when(rapid, words("monitor_sequence_completion")).otherwise(F.array().cast("array<string>")))


def thresholds(scores: DataFrame, order: list[str], score: str = "score", last: int = 1000, least: int = 100) -> DataFrame:
    """One row: percentiles 95, 80 and 60 of the ``last`` scores by ``order``; null with ``least`` or fewer."""
    recent = scores.orderBy(*[F.col(c).desc() for c in order]).limit(last)
    p = F.percentile(score, F.array(F.lit(0.95), F.lit(0.8), F.lit(0.6)))
    some = recent.agg(F.count(score).alias("n"), p.alias("p"))
    return some.select("n", *[F.when(F.col("n") > least, F.col("p")[k]).alias(c) for k, c in enumerate(("critical", "high", "medium"))])

"""Mixers, bridges, contracts: discovery, profiles and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import share, variation
from .incidence import DENOMINATIONS, counterparty, direction, incidence
from .meeting import judged

MIXER_WORDS = "deposit|withdraw|mix|tornado"


def load_contracts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of category -> address -> label as (address, category, label, rank), lower-case."""
    text = spark.read.text(path, wholetext=True)
    tall = text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,map<string,string>>"))).alias("rank", "c"))
    return tall.select(F.explode("c.value").alias("address", "label"), F.col("c.key").alias("category"), "rank").select(F.lower("address").alias("address"), "category", "label", "rank")


def first_category(contracts: DataFrame) -> DataFrame:
    """One row for each address: the first category in file order."""
    return contracts.groupBy("address").agg(F.min_by(F.struct("category", "label"), "rank").alias("c")).select("address", "c.category", "c.label")


def discover_mixers(tx: DataFrame, by_method: int = 100, by_value: int = 50) -> DataFrame:
    method = tx.where(F.lower("method_name").rlike(MIXER_WORDS)).groupBy("to_addr").agg(F.count("*").alias("n")).where(F.col("n") > by_method).select("to_addr")
    value = tx.where(F.col("value_eth").isin(*DENOMINATIONS)).groupBy("to_addr").agg(F.count("*").alias("n"), F.countDistinct("value_eth").alias("k")).where((F.col("n") > by_value) & (F.col("k") <= 4)).select("to_addr")
    return method.unionByName(value).distinct().withColumnRenamed("to_addr", "contract")


def mixer_rows(tx: DataFrame, mixers: DataFrame) -> DataFrame:
    """Incidence rows whose other side is a mixer: address, contract, deposit flag."""
    inc = incidence(tx).withColumn("contract", counterparty())
    return inc.join(mixers, "contract").withColumn("deposit", F.col("from_addr") == F.col("address"))


def mixer_profiles(tx: DataFrame, mixers: DataFrame) -> DataFrame:
    """Counts, volumes, patterns, indicators and a score for each address that used a mixer."""
    by = W.partitionBy("address").orderBy("timestamp", "hash")
    rows = mixer_rows(tx, mixers).join(mixers.select(F.col("contract").alias("address")), "address", "left_anti")
    rows = rows.withColumns({"gap": F.col("timestamp") - F.lag("timestamp").over(by), "after_deposit": F.lag("deposit").over(by)})
    gap, v = F.col("gap"), F.col("value_eth")
    dep, wit = F.count_if("deposit"), F.count_if(~F.col("deposit"))
    vol_in, vol_out = F.sum(F.when(F.col("deposit"), v).otherwise(0.0)), F.sum(F.when(F.col("deposit"), 0.0).otherwise(v))
    quick = F.count_if(~F.col("deposit") & F.col("after_deposit") & (gap > 0) & (gap < 7200))
    out = rows.groupBy("address").agg(
        F.count("*").alias("n_tx"), dep.alias("n_deposits"), wit.alias("n_withdrawals"), vol_in.alias("deposit_volume"), vol_out.alias("withdrawal_volume"), F.countDistinct("contract").alias("n_contracts"),
        F.count_if(gap < 3600).alias("rapid"), F.count(gap).alias("gaps"), variation(gap).alias("gap_cv"), variation(v).alias("value_cv"),
        share(v.isin(*DENOMINATIONS)).alias("standard_ratio"), quick.alias("quick_turnarounds"),
    )
    c = F.col
    tags = F.array_compact(F.array(
        F.when(c("rapid") > 2, "rapid_transactions"), F.when((c("gaps") > 3) & (c("gap_cv") < 0.1), "regular_timing"), F.when((c("n_tx") > 2) & (c("value_cv") < 0.1), "consistent_amounts"),
        F.when(c("standard_ratio") > 0.5, "standard_denominations"), F.when((c("n_deposits") > 0) & (c("n_withdrawals") > 0), "deposit_withdrawal_sequence"), F.when(c("quick_turnarounds") > 0, "quick_turnaround"),
    ))
    out = out.withColumn("patterns", tags)
    total, ratio = c("deposit_volume") + c("withdrawal_volume"), F.try_divide(c("n_deposits").cast("double"), c("n_withdrawals").cast("double"))
    flags = [
        c("n_tx") > 10, total > 50, (ratio > 3) | (ratio < 0.33), (c("n_withdrawals") == 0) & (c("n_deposits") > 5), (c("n_deposits") == 0) & (c("n_withdrawals") > 5), c("n_contracts") > 3, F.size("patterns") > 3,
    ]
    n = sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0))
    return out.withColumn("n_indicators", n).withColumn("risk_score", F.least(F.lit(1.0), 0.4 + 0.2 * F.col("n_indicators")))


def overlaps(rows: DataFrame, width: int = 3600, digits: int | None = None) -> DataFrame:
    """Pairs of addresses at one mixer within ``width`` seconds: meetings and their strength."""
    nothing = rows.select("address", F.array().cast("array<double>").alias("facts")).distinct()
    return judged(rows, nothing, width, lambda fa, fb, p, q, k, s: ((k, s), None), {"meetings": "long", "strength": "double"}, directed=False, digits=digits)


def mixer_jaccard(rows: DataFrame) -> DataFrame:
    """Pairs that share a mixer, and the share of mixers they have in common."""
    used = rows.select("address", "contract").distinct()
    n = used.groupBy("address").agg(F.count("*").alias("n"))
    shared = used.alias("x").join(used.alias("y"), F.col("x.contract") == F.col("y.contract")).where("x.address < y.address").groupBy(F.col("x.address").alias("a"), F.col("y.address").alias("b")).agg(F.count("*").alias("c"))
    out = shared.join(n.select(F.col("address").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("address").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"))


def contract_stats(tx: DataFrame, least: int = 10) -> DataFrame:
    """Busy receivers with an estimated type and what to do about them."""
    s = tx.where("to_addr is not null and to_addr <> ''").groupBy(F.col("to_addr").alias("contract")).agg(F.count("*").alias("total_interactions"), F.countDistinct("from_addr").alias("unique_senders"), F.countDistinct("method_name").alias("unique_methods"))
    n, m, d = F.col("total_interactions"), F.col("unique_methods"), F.col("unique_senders") / F.col("total_interactions")
    kind = F.when((n > 10000) & (d > 0.7), "likely_exchange").when((n > 1000) & (m > 10), "likely_defi_protocol").when((m <= 3) & (d > 0.5), "likely_bridge").when(d < 0.1, "likely_bot_or_automated").otherwise("unknown_contract")
    advice = F.when(F.col("estimated_type").isin("likely_exchange", "likely_defi_protocol"), "EXCLUDE_FROM_CLUSTERING").when(F.col("estimated_type") == "likely_bridge", "CONTEXT_DEPENDENT").otherwise("INVESTIGATE")
    return s.where(n >= least).withColumn("estimated_type", kind).withColumn("recommendation", advice)


def busy_addresses(tx: DataFrame, most_tx: int = 1000, most_partners: int = 500) -> DataFrame:
    """Addresses too busy for link clustering."""
    inc = incidence(tx)
    s = inc.groupBy("address").agg(F.count("*").alias("n"), F.countDistinct("from_addr").alias("f"), F.countDistinct("to_addr").alias("t"))
    return s.where((F.col("n") > most_tx) & (F.col("f") + F.col("t") > most_partners)).select("address", F.col("n").alias("n_tx"), (F.col("f") + F.col("t")).alias("n_partners"))


def discover_bridges(tx: DataFrame, words: str = "bridge|transfer|send|swap", least_tx: int = 100, least_senders: int = 50, diversity: float = 0.5, most: int | None = None) -> DataFrame:
    """Contracts by method name, and busy ones with many senders: all of them, or the ``most`` busiest."""
    named = tx.where(F.lower("method_name").rlike(words) | F.lower("function_name").rlike(words)).select("to_addr").distinct()
    s = tx.where("to_addr is not null and to_addr <> ''").groupBy("to_addr").agg(F.count("*").alias("n"), F.countDistinct("from_addr").alias("k"))
    busy = s.where((F.col("n") > least_tx) & (F.col("k") > least_senders) & (F.col("k") / F.col("n") > diversity))
    busy = busy.orderBy(F.col("n").desc(), "to_addr").limit(most) if most else busy
    return named.unionByName(busy.select("to_addr")).distinct().withColumnRenamed("to_addr", "contract")


def bridge_score(ratio: Column, high_risk: Column, wrapped: Column, timing: Column, automated: Column) -> Column:
    """Bridge share, high-risk patterns, token and timing indicators, automation: at most 1."""
    base = F.when(ratio > 0.5, 0.3).when(ratio > 0.2, 0.2).when(ratio > 0.1, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), base + 0.15 * high_risk + 0.1 * wrapped + 0.2 * timing + F.when(automated >= 2, 0.3).otherwise(0.0))


def deposit_features(tx: DataFrame, contracts: DataFrame, least: int = 3) -> DataFrame:
    """Deposit and withdrawal behaviour of each user of ``contracts``."""
    by = W.partitionBy("address").orderBy("timestamp", "hash")
    rows = mixer_rows(tx, contracts).join(contracts.select(F.col("contract").alias("address")), "address", "left_anti")
    later = F.min(F.when(~F.col("deposit"), F.col("timestamp"))).over(by.rowsBetween(0, W.unboundedFollowing))
    earlier = F.max(F.when(~F.col("deposit"), F.col("timestamp"))).over(by.rowsBetween(W.unboundedPreceding, 0))
    t = F.col("timestamp")
    rows = rows.withColumns({"gap": t - F.lag("timestamp").over(by), "turn": F.col("deposit") != F.lag("deposit").over(by), "near": F.when(F.col("deposit"), F.least(later - t, t - earlier))})
    v, d = F.col("value_eth"), F.col("deposit")
    dv, wv = F.when(d, v), F.when(~d, v)
    n = F.count("*")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    near = lambda x, y: F.abs(x - y) < 0.001
    out = rows.groupBy("address").agg(
        n.alias("n_tx"), F.count_if(d).alias("deposit_count"), F.count_if(~d).alias("withdrawal_count"), zero(F.sum(dv)).alias("total_deposits"), zero(F.sum(wv)).alias("total_withdrawals"),
        zero(F.avg(dv)).alias("avg_deposit_amount"), zero(F.avg(wv)).alias("avg_withdrawal_amount"), zero(F.stddev_samp(dv)).alias("deposit_amount_std"), zero(F.stddev_samp(wv)).alias("withdrawal_amount_std"),
        zero(F.min("near") / 3600).alias("min_deposit_withdrawal_gap_hours"), F.count_if("turn").alias("transaction_transitions"), (F.count_if("turn") / F.greatest(n - 1, F.lit(1))).alias("interleaving_score"),
        share(near(v, 0.1) | near(v, 1) | near(v, 10) | near(v, 100)).alias("uses_round_amounts"), variation(F.col("gap")).alias("cv"), F.avg("gap").alias("mean_gap"), zero(F.stddev_samp("gas_price_gwei")).alias("gas_price_std"),
    ).where(F.col("n_tx") >= least)
    c = F.col
    steady = F.when(c("n_tx") <= 2, 1.0).when(c("mean_gap") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - c("cv")))
    out = out.withColumn("time_consistency_score", zero(steady)).withColumn("has_both_types", (c("deposit_count") > 0) & (c("withdrawal_count") > 0)).drop("cv", "mean_gap")
    spread = lambda s, m: F.least(c(s) / F.greatest(c(m), F.lit(1.0)), F.lit(1.0))
    both = c("has_both_types").cast("int")
    out = out.withColumns({k: F.when(c("has_both_types"), c(k)).otherwise(0) for k in ("min_deposit_withdrawal_gap_hours", "transaction_transitions", "interleaving_score")})
    return out.withColumn("pattern_complexity", 2 * both + 3 * c("interleaving_score") + spread("deposit_amount_std", "avg_deposit_amount") + spread("withdrawal_amount_std", "avg_withdrawal_amount") + 2 * (1 - c("time_consistency_score")))


def directed(tx: DataFrame) -> DataFrame:
    return incidence(tx).withColumn("direction", direction())

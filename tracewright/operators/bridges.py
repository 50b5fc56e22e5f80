"""Use of bridges between chains: patterns, signs, a score and its roll-up by cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import variation
from .incidence import counterparty, incidence
from .mixers import bridge_score

# Names of wrapped tokens, chains and stablecoins looked for in method names.
WRAPPED = ("weth", "wbtc", "wmatic", "wavax")
CHAINS = ("eth", "bsc", "polygon", "avalanche", "arbitrum", "optimism")
STABLE = ("usdc", "usdt", "dai", "busd", "frax")


def bridge_profiles(tx: DataFrame, bridges: DataFrame) -> DataFrame:
    """Counts, patterns, signs and a score for each address that used a contract of ``bridges``.

    A quick turnaround is a row received within two hours after one sent, found
    from the last sending before it.  Names are looked for in all of an
    address's methods; nulls never match.
    """
    inc = incidence(tx).withColumn("contract", counterparty())
    known = bridges.select("contract").distinct()
    inc = inc.join(known.select(F.col("contract").alias("address")), "address", "left_anti")
    rows = inc.join(known.withColumn("is_bridge", F.lit(True)), "contract", "left").withColumn("is_bridge", F.coalesce("is_bridge", F.lit(False)))
    method = F.lower("method_name")
    hits = lambda words: sum((F.max(F.coalesce(method.contains(w), F.lit(False)).cast("int")) for w in words), F.lit(0))
    every = rows.groupBy("address").agg(F.count("*").alias("n_all"), hits(WRAPPED).alias("wrapped"), hits(CHAINS).alias("chains"), hits(STABLE).alias("stable"))

    by = W.partitionBy("address").orderBy("timestamp", "hash")
    before = W.partitionBy("address").orderBy("timestamp").rangeBetween(W.unboundedPreceding, -1)  # strictly earlier
    sent = F.col("from_addr") == F.col("address")
    used = rows.where("is_bridge").withColumns(
        {"gap": F.col("timestamp") - F.lag("timestamp").over(by), "sent": sent, "last_sent": F.max(F.when(sent, F.col("timestamp"))).over(before)}
    )
    v, since = F.col("value_eth"), F.col("timestamp") - F.col("last_sent")
    one = used.groupBy("address").agg(
        F.count("*").alias("n_bridge"), F.count_if(F.col("gap") < 3600).alias("rapid"), F.count_if(v > 50).alias("large"), F.countDistinct("value_eth").alias("amounts"), F.count_if(F.abs(v - F.round(v, 1)) < 0.01).alias("round_amounts"),
        F.countDistinct("method_name").alias("methods"), F.countDistinct("contract").alias("contracts"), variation(F.col("gap")).alias("gap_cv"), F.count_if(~F.col("sent") & (since < 7200)).alias("turnarounds"),
    )
    out = one.join(every, "address")
    c = F.col
    n = c("n_bridge")
    risky = {"high_bridge_activity": n > 10, "rapid_bridge_transactions": c("rapid") > 2, "large_value_bridging": c("large") > 0, "diverse_bridge_methods": c("methods") > 3, "multiple_bridge_contracts": c("contracts") > 3}
    automatic = {"consistent_bridge_amounts": (n > 3) & (c("amounts") <= 2), "round_value_bridging": c("round_amounts") > 0.7 * n}
    timing = {"regular_bridge_timing": (n > 2) & F.coalesce(c("gap_cv") < 0.1, F.lit(False)), "quick_bridge_turnaround": c("turnarounds") > 0}
    tags = F.array_compact(F.array(*[F.when(f, k) for k, f in {**risky, **automatic, **timing}.items()]))
    count = lambda flags: sum((f.cast("int") for f in flags.values()), F.lit(0))
    score = bridge_score(n / c("n_all"), count(risky), c("wrapped") + c("stable"), count(timing), count(automatic))
    return out.withColumns({"bridge_ratio": n / c("n_all"), "patterns": tags, "risk_score": score})


def cluster_bridge_use(profiles: DataFrame, assignment: DataFrame) -> DataFrame:
    """For each cluster its bridge users, their highest score and how far three patterns are shared.

    Coordination is a third of the sum of the shares of users with frequent,
    rapid or equal amounts; 0 for a single user.
    """
    rows = profiles.join(assignment.select("address", "cluster_id"), "address")
    has = lambda p: F.avg(F.array_contains("patterns", p).cast("double"))
    shared = 0.33 * (has("high_bridge_activity") + has("rapid_bridge_transactions") + has("consistent_bridge_amounts"))
    n = F.count("*")
    return rows.groupBy("cluster_id").agg(n.alias("users"), F.sum("n_bridge").alias("n_bridge"), F.max("risk_score").alias("risk_score"), F.when(n > 1, F.least(shared, F.lit(1.0))).otherwise(0.0).alias("coordination"))


def bridge_totals(tx: DataFrame, bridges: DataFrame) -> DataFrame:
    """Transfers, users and volume of each bridge, in both directions."""
    known = bridges.select("contract").distinct()
    inc = incidence(tx).join(known.select(F.col("contract").alias("address")), "address").withColumn("user", counterparty())
    return inc.groupBy(F.col("address").alias("contract")).agg(F.count("*").alias("n_tx"), F.countDistinct("user").alias("users"), F.sum("value_eth").alias("volume"))

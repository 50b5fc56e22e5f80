"""How the graph changes over sliding windows.

A window's number stands in for its times, so neighbouring windows meet in an
equi-join on that number and no window function runs over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import share
from .incidence import DENOMINATIONS

WIDTH, STEP = 86400, 43200


def windows(tx: DataFrame, width: int = WIDTH, step: int = STEP) -> DataFrame:
    """A row of each transfer for each complete window that holds it: ``k`` (from 0) and ``start``.

    Windows are half-open, begin at the first transfer and end no later than the last.
    """
    ends = tx.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    rows = tx.join(F.broadcast(ends))  # one row
    last = F.floor((F.col("timestamp") - F.col("lo")) / step)
    first = F.greatest(F.floor((F.col("timestamp") - F.col("lo") - width) / step) + 1, F.lit(0))
    rows = rows.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    start = F.col("lo") + F.col("k") * step
    return rows.withColumn("start", start).where(F.col("start") + width <= F.col("hi")).drop("lo", "hi")


def is_mixer() -> Column:
    return F.col("method_name").isin("deposit", "withdraw") | F.col("value_eth").isin(*DENOMINATIONS)


def graph_by_window(rows: DataFrame) -> DataFrame:
    """Edges of each window, self-loops left out."""
    return rows.where("from_addr <> to_addr").groupBy("k", F.col("from_addr").alias("src"), F.col("to_addr").alias("dst")).agg(F.sum("value_eth").alias("weight"), F.count("*").alias("n_tx"))


def window_metrics(rows: DataFrame) -> DataFrame:
    """Nodes, edges, density, mean degree, mixer share and deposits per withdrawal of each window."""
    g = graph_by_window(rows)
    edges = g.groupBy("k").agg(F.count("*").alias("edges"))
    nodes = g.select("k", F.explode(F.array("src", "dst")).alias("node")).groupBy("k").agg(F.countDistinct("node").alias("nodes"))
    m = F.col("method_name")
    flow = rows.groupBy("k", "start").agg(
        F.count("*").alias("n_tx"), F.sum("value_eth").alias("volume"), share(is_mixer()).alias("mixer_share"), (F.count_if(m == "deposit") / F.greatest(F.count_if(m == "withdraw"), F.lit(1))).alias("deposit_ratio")
    )
    out = flow.join(nodes, "k", "left").join(edges, "k", "left").na.fill(0, ["nodes", "edges"])
    n, e = F.col("nodes"), F.col("edges")
    return out.withColumns({"density": F.when(n > 1, e / (n * (n - 1))).otherwise(0.0), "avg_degree": F.when(n > 0, 2 * e / n).otherwise(0.0)})


def evolution(metrics: DataFrame, spread: float = 2.0) -> DataFrame:
    """Change of each window to the next one, and whether it stands out.

    A change stands out above the mean of all changes by ``spread`` population deviations.
    """
    now = metrics.select("k", "nodes", "edges", "density")
    after = metrics.select((F.col("k") - 1).alias("k"), F.col("nodes").alias("n2"), F.col("edges").alias("e2"), F.col("density").alias("d2"))
    d = now.join(after, "k").select(
        "k", (F.col("n2") - F.col("nodes")).alias("node_growth"), (F.col("e2") - F.col("edges")).alias("edge_growth"), ((F.col("e2") - F.col("edges")) / F.greatest("edges", F.lit(1))).alias("growth_rate"), (F.col("d2") - F.col("density")).alias("density_change")
    )
    shift = F.abs("density_change")
    ends = d.agg(
        F.avg("growth_rate").alias("m1"), F.stddev_pop("growth_rate").alias("s1"), F.avg(shift).alias("m2"), F.stddev_pop(shift).alias("s2"), (1 / (1 + F.stddev_pop("density_change"))).alias("stability")
    )
    out = d.join(F.broadcast(ends))  # one row
    return out.select("k", "node_growth", "edge_growth", "growth_rate", "density_change", "stability", (F.col("growth_rate") > F.col("m1") + spread * F.col("s1")).alias("growth_spike"), (shift > F.col("m2") + spread * F.col("s2")).alias("density_shift"))


def activity_spikes(metrics: DataFrame, spread: float = 2.0) -> DataFrame:
    """Windows with more transfers than the mean by ``spread`` population deviations."""
    ends = metrics.agg((F.avg("n_tx") + spread * F.stddev_pop("n_tx")).alias("threshold"))
    return metrics.join(F.broadcast(ends)).where("n_tx > threshold").select("k", "n_tx", "threshold")  # one row


def cluster_activity(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """Transfers, senders, span and rate (of at least an hour) by window and the sender's cluster."""
    t = F.col("timestamp")
    joined = rows.join(assignment.select(F.col("address").alias("from_addr"), "cluster_id"), "from_addr")
    out = joined.groupBy("k", "cluster_id").agg(F.count("*").alias("n_tx"), F.countDistinct("from_addr").alias("members"), (F.max(t) - F.min(t)).alias("span"))
    return out.withColumn("tx_per_hour", F.col("n_tx") / F.greatest(F.col("span") / 3600, F.lit(1.0)))


def activations(activity: DataFrame) -> DataFrame:
    """Clusters active in a window and not in the one before, counted by window; the first window has none before."""
    now = activity.select("k", "cluster_id").where("k > 0")
    before = activity.select((F.col("k") + 1).alias("k"), "cluster_id")
    return now.join(before, ["k", "cluster_id"], "left_anti").groupBy("k").agg(F.count("*").alias("activated"))


def synchronised(activity: DataFrame, spread: float = 2.0) -> DataFrame:
    """Windows in which unusually many clusters wake."""
    a = activations(activity)
    ends = a.agg((F.avg("activated") + spread * F.stddev_pop("activated")).alias("threshold"))
    return a.join(F.broadcast(ends)).where("activated > threshold and activated > 1")  # one row


def busy_nodes(rows: DataFrame, least: int = 10, quantile: float = 0.95) -> DataFrame:
    """Nodes of a window whose degree is above its quantile and above ``least``."""
    g = graph_by_window(rows)
    degree = g.select("k", F.explode(F.array("src", "dst")).alias("node")).groupBy("k", "node").agg(F.count("*").alias("degree"))
    bound = degree.groupBy("k").agg(F.percentile("degree", F.lit(quantile)).alias("bound"))
    return degree.join(bound, "k").where((F.col("degree") > F.col("bound")) & (F.col("degree") > least)).select("k", "node", "degree")


def snapshots(tx: DataFrame, bins: int = 50) -> DataFrame:
    """The ledger in ``bins`` equal spans of time; the last one is closed."""
    ends = tx.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    t = F.col("timestamp")
    bin_ = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((t - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    rows = tx.join(F.broadcast(ends)).withColumn("bin", bin_)  # one row
    return rows.groupBy("bin").agg(F.count("*").alias("n_tx"), F.countDistinct("from_addr").alias("senders"), F.sum("value_eth").alias("volume"))


def sessions(inc: DataFrame, gap: str = "1 hour") -> DataFrame:
    """Runs of an address's transfers, each within ``gap`` of the one before."""
    s = F.session_window(F.timestamp_seconds("timestamp"), gap).alias("s")
    out = inc.groupBy("address", s).agg(F.count("*").alias("n_tx"), F.sum("value_eth").alias("volume"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
    return out.drop("s")

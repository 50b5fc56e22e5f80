"""Registered queries: use of bridges.  The test ledger's named contracts stand for bridges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bridges as B
from ..sources.ledger import INCIDENCE, TX, event_ledger
from .catalog import outer, query, rounded
from .clusters import ASSIGNED, _assignment
from .typology import KNOWN, ROWS, _known

_hits = lambda words: " + ".join(f"max(coalesce(contains(lower(method_name), '{w}'), false)::INT)" for w in words)
PROFILES = f"""bs AS (SELECT a.*, (SELECT max(b.timestamp) FROM mg b WHERE b.address = a.address AND b.deposit AND b.timestamp < a.timestamp) AS last_sent FROM mg a),
 bu AS (SELECT address, count(*) AS n_bridge, count(*) FILTER (gap < 3600) AS rapid, count(*) FILTER (value_eth > 50) AS large, count(DISTINCT value_eth) AS amounts, count(*) FILTER (abs(value_eth - round(value_eth, 1)) < 0.01) AS round_amounts, count(DISTINCT method_name) AS methods, count(DISTINCT contract) AS contracts,
  CASE WHEN avg(gap) <> 0 THEN stddev_samp(gap) / avg(gap) END AS gap_cv, count(*) FILTER (NOT deposit AND timestamp - last_sent < 7200) AS turnarounds FROM bs GROUP BY 1),
 ba AS (SELECT address, count(*) AS n_all, {_hits(B.WRAPPED)} AS wrapped, {_hits(B.CHAINS)} AS chains, {_hits(B.STABLE)} AS stable FROM inc GROUP BY 1),
 bf AS (SELECT *, n_bridge / n_all AS bridge_ratio, (n_bridge > 10)::INT + (rapid > 2)::INT + (large > 0)::INT + (methods > 3)::INT + (contracts > 3)::INT AS risky, (n_bridge > 3 AND amounts <= 2)::INT + (round_amounts > 0.7 * n_bridge)::INT AS automatic,
  (n_bridge > 2 AND coalesce(gap_cv < 0.1, false))::INT + (turnarounds > 0)::INT AS timing FROM bu JOIN ba USING (address)),
 bp AS (SELECT *, risky + automatic + timing AS n_patterns, least(1, CASE WHEN bridge_ratio > 0.5 THEN 0.3 WHEN bridge_ratio > 0.2 THEN 0.2 WHEN bridge_ratio > 0.1 THEN 0.1 ELSE 0 END + 0.15 * risky + 0.1 * (wrapped + stable) + 0.2 * timing + CASE WHEN automatic >= 2 THEN 0.3 ELSE 0 END) AS risk_score FROM bf)"""
WITH = f"WITH {TX}, {INCIDENCE}, {KNOWN}, {ROWS}, {ASSIGNED}, {PROFILES}"
NAMES = "n_bridge rapid large amounts round_amounts methods contracts turnarounds wrapped chains stable n_patterns".split()


def _profiles(spark, sf_dir):
    tx = event_ledger(spark, sf_dir)
    return B.bridge_profiles(tx, _known(tx)).withColumn("n_patterns", F.size("patterns"))


@query(f"{WITH} " + outer("SELECT * FROM bp", "address ~bridge_ratio ~risk_score " + " ".join("#" + c for c in NAMES)))
def x2_bridge_profiles(spark, sf_dir):
    return rounded(_profiles(spark, sf_dir).select("address", "bridge_ratio", "risk_score", *NAMES))


@query(f"{WITH} " + outer("SELECT cluster_id, count(*) AS users, sum(n_bridge) AS n_bridge, max(risk_score) AS risk_score, CASE WHEN count(*) > 1 THEN least(1, 0.33 * (avg((n_bridge > 10)::INT) + avg((rapid > 2)::INT) + avg((n_bridge > 3 AND amounts <= 2)::INT))) ELSE 0 END AS coordination FROM bp JOIN asg USING (address) GROUP BY 1", "cluster_id #users #n_bridge ~risk_score ~coordination"))
def x5_cluster_bridge_use(spark, sf_dir):
    return rounded(B.cluster_bridge_use(_profiles(spark, sf_dir), _assignment(event_ledger(spark, sf_dir))))


@query(f"{WITH} " + outer("SELECT address AS contract, count(*) AS n_tx, count(DISTINCT CASE WHEN to_addr = address THEN from_addr ELSE to_addr END) AS users, sum(value_eth) AS volume FROM inc WHERE address IN (SELECT contract FROM k) GROUP BY 1", "contract #n_tx #users ~volume"))
def x6_bridge_totals(spark, sf_dir):
    tx = event_ledger(spark, sf_dir)
    return rounded(B.bridge_totals(tx, _known(tx)))

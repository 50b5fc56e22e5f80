"""Registered queries: mixers, bridges, contracts and behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixers as M
from ..operators.incidence import band_matches, coactivity
from ..sources.ledger import INCIDENCE, TX, event_ledger
from .catalog import outer, query, rounded

MIX = """m AS (SELECT to_addr AS contract FROM tx WHERE regexp_matches(lower(method_name), 'deposit|withdraw|mix|tornado') GROUP BY 1 HAVING count(*) > 100
 UNION SELECT to_addr FROM tx WHERE value_eth IN (0.1, 1, 10, 100) GROUP BY 1 HAVING count(*) > 50 AND count(DISTINCT value_eth) <= 4)"""
#: Mixer contracts of the test ledger, known by name.
KNOWN = "k AS (SELECT DISTINCT to_addr AS contract FROM tx WHERE to_addr LIKE '0xmix%')"
ROWS = """mr AS (SELECT i.*, from_addr = address AS deposit, CASE WHEN to_addr = address THEN from_addr ELSE to_addr END AS contract FROM inc i WHERE address NOT LIKE '0xmix%' AND CASE WHEN to_addr = address THEN from_addr ELSE to_addr END LIKE '0xmix%'),
mg AS (SELECT *, timestamp - lag(timestamp) OVER w AS gap, lag(deposit) OVER w AS after_deposit FROM mr WINDOW w AS (PARTITION BY address ORDER BY timestamp, hash))"""
WITH = f"WITH {TX}, {INCIDENCE}, {KNOWN}, {ROWS}"


def _known(tx):
    return tx.where("to_addr like '0xmix%'").select(F.col("to_addr").alias("contract")).distinct()


@query(f"WITH {TX}, {MIX} SELECT contract FROM m")
def m1_mixer_discovery(spark, sf_dir):
    return M.discover_mixers(event_ledger(spark, sf_dir))


M2 = """SELECT address, count(*) AS n_tx, count(*) FILTER (deposit) AS n_deposits, count(*) FILTER (NOT deposit) AS n_withdrawals, coalesce(sum(value_eth) FILTER (deposit), 0) AS deposit_volume, coalesce(sum(value_eth) FILTER (NOT deposit), 0) AS withdrawal_volume,
 count(DISTINCT contract) AS n_contracts, count(*) FILTER (gap < 3600) AS rapid, count(gap) AS gaps, CASE WHEN avg(gap) <> 0 THEN stddev_samp(gap) / avg(gap) END AS gap_cv, CASE WHEN avg(value_eth) <> 0 THEN stddev_samp(value_eth) / avg(value_eth) END AS value_cv,
 avg((value_eth IN (0.1, 1, 10, 100))::INT) AS standard_ratio, count(*) FILTER (NOT deposit AND after_deposit AND gap > 0 AND gap < 7200) AS quick_turnarounds FROM mg GROUP BY address"""
M4 = f"""SELECT address, n_tx, n_deposits, n_withdrawals, deposit_volume, withdrawal_volume, n_patterns, k AS n_indicators, least(1, 0.4 + 0.2 * k) AS risk_score FROM (SELECT *,
 (n_tx > 10)::INT + (deposit_volume + withdrawal_volume > 50)::INT + (n_withdrawals > 0 AND (n_deposits / n_withdrawals > 3 OR n_deposits / n_withdrawals < 0.33))::INT + (n_withdrawals = 0 AND n_deposits > 5)::INT + (n_deposits = 0 AND n_withdrawals > 5)::INT + (n_contracts > 3)::INT + (n_patterns > 3)::INT AS k
 FROM (SELECT *, (rapid > 2)::INT + coalesce(gaps > 3 AND gap_cv < 0.1, false)::INT + coalesce(n_tx > 2 AND value_cv < 0.1, false)::INT + (standard_ratio > 0.5)::INT + (n_deposits > 0 AND n_withdrawals > 0)::INT + (quick_turnarounds > 0)::INT AS n_patterns FROM ({M2})))"""


@query(f"{WITH} " + outer(M4, "address #n_tx #n_deposits #n_withdrawals ~deposit_volume ~withdrawal_volume #n_patterns #n_indicators ~risk_score"))
def m2_mixer_profiles(spark, sf_dir):
    tx = event_ledger(spark, sf_dir)
    p = M.mixer_profiles(tx, _known(tx)).withColumn("n_patterns", F.size("patterns"))
    return rounded(p.select("address", "n_tx", "n_deposits", "n_withdrawals", "deposit_volume", "withdrawal_volume", "n_patterns", "n_indicators", "risk_score"))


@query(f"{WITH} " + outer("SELECT x.address AS a, y.address AS b, count(*) AS meetings, sum(1 - abs(x.timestamp - y.timestamp) / 3600) AS strength FROM mr x JOIN mr y ON x.contract = y.contract AND x.address < y.address AND abs(x.timestamp - y.timestamp) <= 3600 GROUP BY 1, 2", "a b #meetings ~strength"))
def j7_mixer_overlaps(spark, sf_dir):
    tx = event_ledger(spark, sf_dir)
    return M.overlaps(M.mixer_rows(tx, _known(tx)).where("address not like '0xmix%'"), digits=6)


@query(f"{WITH}, u AS (SELECT DISTINCT address, contract FROM mr), n AS (SELECT address, count(*) AS n FROM u GROUP BY 1), s AS (SELECT x.address AS a, y.address AS b, count(*) AS c FROM u x JOIN u y ON x.contract = y.contract AND x.address < y.address GROUP BY 1, 2) "
       + outer("SELECT a, b, c / (x.n + y.n - c) AS jaccard FROM s JOIN n x ON a = x.address JOIN n y ON b = y.address", "a b ~jaccard"))
def m6_mixer_jaccard(spark, sf_dir):
    tx = event_ledger(spark, sf_dir)
    return rounded(M.mixer_jaccard(M.mixer_rows(tx, _known(tx)).where("address not like '0xmix%'")))


@query(f"WITH {TX}, s AS (SELECT to_addr AS contract, count(*) AS total_interactions, count(DISTINCT from_addr) AS unique_senders, count(DISTINCT method_name) AS unique_methods FROM tx GROUP BY 1 HAVING count(*) >= 10), t AS (SELECT *, CASE WHEN total_interactions > 10000 AND unique_senders / total_interactions > 0.7 THEN 'likely_exchange' WHEN total_interactions > 1000 AND unique_methods > 10 THEN 'likely_defi_protocol' WHEN unique_methods <= 3 AND unique_senders / total_interactions > 0.5 THEN 'likely_bridge' WHEN unique_senders / total_interactions < 0.1 THEN 'likely_bot_or_automated' ELSE 'unknown_contract' END AS estimated_type FROM s) "
       + outer("SELECT *, CASE WHEN estimated_type IN ('likely_exchange', 'likely_defi_protocol') THEN 'EXCLUDE_FROM_CLUSTERING' WHEN estimated_type = 'likely_bridge' THEN 'CONTEXT_DEPENDENT' ELSE 'INVESTIGATE' END AS recommendation FROM t", "contract #total_interactions #unique_senders #unique_methods estimated_type recommendation"))
def m8_contract_types(spark, sf_dir):
    return rounded(M.contract_stats(event_ledger(spark, sf_dir)))


@query(f"WITH {TX}, {INCIDENCE} SELECT address, count(*)::BIGINT AS n_tx, (count(DISTINCT from_addr) + count(DISTINCT to_addr))::BIGINT AS n_partners FROM inc GROUP BY 1 HAVING count(*) > 100 AND n_partners > 100")
def l2_busy_addresses(spark, sf_dir):
    return rounded(M.busy_addresses(event_ledger(spark, sf_dir), 100, 100))


@query(f"WITH {TX} SELECT to_addr AS contract FROM tx WHERE regexp_matches(lower(method_name), 'bridge|transfer|send|swap') UNION SELECT contract FROM (SELECT to_addr AS contract FROM tx GROUP BY 1 HAVING count(*) > 100 AND count(DISTINCT from_addr) > 50 AND count(DISTINCT from_addr) / count(*) > 0.5)")
def x1_bridge_discovery(spark, sf_dir):
    return M.discover_bridges(event_ledger(spark, sf_dir))


B2 = """SELECT address, count(*) AS n_tx, count(*) FILTER (deposit) AS deposit_count, count(*) FILTER (NOT deposit) AS withdrawal_count, coalesce(sum(value_eth) FILTER (deposit), 0) AS total_deposits, coalesce(sum(value_eth) FILTER (NOT deposit), 0) AS total_withdrawals,
 coalesce(avg(value_eth) FILTER (deposit), 0) AS avg_deposit_amount, coalesce(avg(value_eth) FILTER (NOT deposit), 0) AS avg_withdrawal_amount, deposit_count > 0 AND withdrawal_count > 0 AS has_both_types,
 CASE WHEN has_both_types THEN count(*) FILTER (deposit <> after_deposit) ELSE 0 END AS transaction_transitions, CASE WHEN has_both_types THEN count(*) FILTER (deposit <> after_deposit) / greatest(count(*) - 1, 1) ELSE 0 END AS interleaving_score,
 avg((abs(value_eth - 0.1) < 0.001 OR abs(value_eth - 1) < 0.001 OR abs(value_eth - 10) < 0.001 OR abs(value_eth - 100) < 0.001)::INT) AS uses_round_amounts,
 CASE WHEN count(*) <= 2 THEN 1 WHEN avg(gap) = 0 THEN 0 ELSE greatest(0, 1 - stddev_samp(gap) / avg(gap)) END AS time_consistency_score FROM mg GROUP BY address HAVING count(*) >= 3"""


@query(f"{WITH} " + outer(B2, "address #n_tx #deposit_count #withdrawal_count ~total_deposits ~total_withdrawals ~avg_deposit_amount ~avg_withdrawal_amount has_both_types #transaction_transitions ~interleaving_score ~uses_round_amounts ~time_consistency_score"))
def b2_deposit_features(spark, sf_dir):
    tx = event_ledger(spark, sf_dir)
    names = "address n_tx deposit_count withdrawal_count total_deposits total_withdrawals avg_deposit_amount avg_withdrawal_amount has_both_types transaction_transitions interleaving_score uses_round_amounts time_consistency_score"
    return rounded(M.deposit_features(tx, _known(tx)).select(*names.split()))


@query(f"WITH {TX}, b AS (SELECT *, CASE WHEN abs(value_eth - 0.1) <= 0.005 THEN 0.1 WHEN abs(value_eth - 1) <= 0.05 THEN 1 WHEN abs(value_eth - 10) <= 0.5 THEN 10 WHEN abs(value_eth - 100) <= 5 THEN 100 END::DOUBLE AS denom FROM tx) "
       + outer("SELECT x.hash AS hash, count(*) AS matches, max(abs(x.timestamp - y.timestamp)) AS farthest FROM b x JOIN b y ON x.denom = y.denom AND abs(x.timestamp - y.timestamp) <= 259200 AND y.from_addr <> x.from_addr AND y.to_addr <> x.from_addr AND x.hash <> y.hash GROUP BY 1", "hash #matches #farthest"))
def j6_band_join(spark, sf_dir):
    return rounded(band_matches(event_ledger(spark, sf_dir)))


@query(f"WITH {TX}, {INCIDENCE}, s AS (SELECT DISTINCT address, hash, timestamp FROM inc), n AS (SELECT address, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 5) "
       + outer("SELECT x.address AS a, y.address AS b, count(DISTINCT x.hash) / any_value(n.n) AS coactivity FROM s x JOIN s y ON x.address <> y.address AND abs(x.timestamp - y.timestamp) <= 3600 JOIN n ON n.address = x.address JOIN n ny ON ny.address = y.address GROUP BY 1, 2 HAVING count(DISTINCT x.hash) / any_value(n.n) > 0.7", "a b ~coactivity"))
def j14_coactivity(spark, sf_dir):
    return rounded(coactivity(event_ledger(spark, sf_dir)))

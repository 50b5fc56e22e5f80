"""Registered queries: sequences, windows, top-k, set operations, reports and charts' data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as O
from ..operators import sequences as S
from ..operators.incidence import incidence
from ..sources.ledger import INCIDENCE, TX, event_ledger
from .catalog import outer, query, rounded
from .features import F5, F5_COLUMNS, GAPS

WITH = f"WITH {TX}, {INCIDENCE}"


@query(f"{WITH}, t AS (SELECT address, method_name AS state, lead(method_name) OVER (PARTITION BY address ORDER BY timestamp, hash) AS nxt FROM inc), c AS (SELECT address, state, nxt, count(*) AS k FROM t WHERE nxt IS NOT NULL AND address IN (SELECT address FROM inc GROUP BY 1 HAVING count(*) >= 10) GROUP BY ALL) "
       + outer('SELECT address, state, nxt AS "next", k, k / sum(k) OVER (PARTITION BY address, state) AS p FROM c', "address state next #k ~p"))
def q4_markov_transitions(spark, sf_dir):
    return rounded(S.transitions(incidence(event_ledger(spark, sf_dir)), "method_name"))


@query(f"{WITH}, t AS (SELECT address, method_name AS a, lead(method_name, 1) OVER w AS b, lead(method_name, 2) OVER w AS c FROM inc WINDOW w AS (PARTITION BY address ORDER BY timestamp, hash)) "
       + outer("SELECT a || '>' || b || '>' || c AS gram, count(*) AS n, count(DISTINCT address) AS addresses, count(DISTINCT address) / (SELECT count(DISTINCT address) FROM inc) AS support FROM t WHERE c IS NOT NULL GROUP BY 1", "gram #n #addresses ~support"))
def q2_frequent_ngrams(spark, sf_dir):
    return rounded(S.ngrams(incidence(event_ledger(spark, sf_dir)), "method_name"))


Q5 = """SELECT address, ((gaps > 5 AND cv < 0.1)::INT + (n > 5 AND prices <= 3)::INT + (n > 5 AND vals <= 0.3 * n)::INT + (n > 5 AND h < 1)::INT + (n > 5 AND gas_cv < 0.1)::INT + (minute > 0.3)::INT + (rapid > 0.2 * n)::INT + (abs(weekend - 2 / 7) < 0.1 AND abs(night - 8 / 24) < 0.1)::INT) / 8 AS automation_score,
 ((n > 5 AND price_cv > 0.5)::INT + (gaps > 5 AND cv > 0.3 AND cv < 2)::INT) / 5 AS evasion_score
 FROM (SELECT address, count(*) AS n, count(gap) AS gaps, coalesce(stddev_samp(gap) / nullif(avg(gap), 0), 99) AS cv, count(DISTINCT gas_price) AS prices, count(DISTINCT value_eth) AS vals, coalesce(stddev_samp(gas) / nullif(avg(gas), 0), 99) AS gas_cv, coalesce(stddev_samp(gas_price_gwei) / nullif(avg(gas_price_gwei), 0), 0) AS price_cv,
  avg((timestamp % 60 = 0)::INT) AS minute, count(*) FILTER (gap < 60) AS rapid, avg((day_of_week >= 5)::INT) AS weekend, avg((hour_of_day >= 22 OR hour_of_day < 6)::INT) AS night
  FROM (SELECT *, timestamp - lag(timestamp) OVER (PARTITION BY address ORDER BY timestamp, hash) AS gap FROM inc) GROUP BY 1 HAVING count(*) >= 10)
 JOIN (SELECT address, ln(sum(k)) - sum(k * ln(k)) / sum(k) AS h FROM (SELECT address, method_name, count(*) AS k FROM inc GROUP BY ALL) GROUP BY 1) USING (address)"""


@query(f"{WITH} " + outer(Q5, "address ~automation_score ~evasion_score"))
def q5_automation_scores(spark, sf_dir):
    return rounded(S.automation(incidence(event_ledger(spark, sf_dir))))


RISKS = [c.strip("~") for c in F5_COLUMNS.split()[1:]]
A4 = " UNION ALL ".join(f"SELECT address, '{c}' AS feature, round(coalesce(abs(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0)), 0), 9) AS z FROM f5" for c in RISKS)


@query(f"{WITH}, {GAPS}, f5 AS ({F5}), zs AS ({A4}), zt AS (SELECT address, arg_max(feature, (z, feature)) AS feature, max(z) AS z FROM zs GROUP BY 1) " + outer("SELECT address, feature, z AS z_score, least(1, z / 10) AS score, least(1, z / 3) AS confidence FROM zt WHERE z > 3", "address feature ~z_score ~score ~confidence"))
def a4_statistical_anomalies(spark, sf_dir):
    return rounded(S.anomalies(O.risk(incidence(event_ledger(spark, sf_dir)))))


@query(f"WITH {TX} " + outer("SELECT day_of_week, hour_of_day, count(*) AS n, sum(value_eth) AS volume FROM tx GROUP BY ALL", "#day_of_week #hour_of_day #n ~volume"))
def k3b_day_hour_heat_map(spark, sf_dir):
    return rounded(event_ledger(spark, sf_dir).groupBy("day_of_week", "hour_of_day").agg(F.count("*").alias("n"), F.sum("value_eth").alias("volume")))


@query(f"WITH {TX} " + outer("SELECT strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT from_addr) AS senders, sum(value_eth) AS volume FROM tx GROUP BY 1", "day #n #senders ~volume"))
def k3j_daily_activity(spark, sf_dir):
    day = F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd").alias("day")
    return rounded(event_ledger(spark, sf_dir).groupBy(day).agg(F.count("*").alias("n"), F.countDistinct("from_addr").alias("senders"), F.sum("value_eth").alias("volume")))


@query(f"WITH {TX} " + outer("SELECT from_addr, to_addr, sum(value_eth) AS volume FROM tx GROUP BY 1, 2 ORDER BY round(sum(value_eth), 6) DESC, 1, 2 LIMIT 25", "from_addr to_addr ~volume"))
def t1_top_flows(spark, sf_dir):
    total = event_ledger(spark, sf_dir).groupBy("from_addr", "to_addr").agg(F.round(F.sum("value_eth"), 6).alias("volume"))
    return rounded(total.orderBy(F.col("volume").desc(), "from_addr", "to_addr").limit(25))


@query(f"WITH {TX} SELECT count(*)::BIGINT AS transactions, count(DISTINCT hash)::BIGINT AS hashes, min(timestamp)::BIGINT AS first_ts, max(timestamp)::BIGINT AS last_ts, sum(gas)::BIGINT AS gas FROM tx")
def g26_ledger_summary(spark, sf_dir):
    return rounded(event_ledger(spark, sf_dir).agg(F.count("*").alias("transactions"), F.countDistinct("hash").alias("hashes"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.sum("gas").alias("gas")))


@query(f"WITH {TX} SELECT from_addr AS address FROM tx UNION SELECT to_addr FROM tx")
def u2_affected_addresses(spark, sf_dir):
    from ..sources.ingest import affected_addresses

    return affected_addresses(event_ledger(spark, sf_dir))


@query("WITH r AS (SELECT '0x' || l_orderkey || '-' || l_linenumber AS hash, l_partkey, l_suppkey, l_extendedprice FROM lineitem) SELECT hash, l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey, round(l_extendedprice, 6) + 0.0 AS l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM r) WHERE n = 1")
def c7_first_row_per_hash(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("hash", F.concat(F.lit("0x"), F.concat_ws("-", "l_orderkey", "l_linenumber")))
    first = li.groupBy("hash").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("r"))
    return rounded(first.select("hash", "r.*"))


@query(f"WITH {TX} " + outer("SELECT timestamp // 3600 * 3600 AS hour, count(*) AS n, count(DISTINCT from_addr) AS senders, avg((method_name IN ('deposit', 'withdraw') OR value_eth IN (0.1, 1, 10, 100))::INT) AS mixer_share FROM tx GROUP BY 1", "#hour #n #senders ~mixer_share"))
def v6_hourly_windows(spark, sf_dir):
    tx = event_ledger(spark, sf_dir)
    mixer = F.col("method_name").isin("deposit", "withdraw") | F.col("value_eth").isin(0.1, 1.0, 10.0, 100.0)
    out = tx.groupBy(F.window(F.timestamp_seconds("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("from_addr").alias("senders"), F.avg(mixer.cast("double")).alias("mixer_share"))
    return rounded(out.select(F.unix_timestamp("w.start").alias("hour"), "n", "senders", "mixer_share"))


@query(f"WITH {TX}, s AS (SELECT min(timestamp) AS lo, max(timestamp) AS hi FROM tx), w AS (SELECT unnest(range(0, (SELECT (hi - lo - 86400) // 43200 + 1 FROM s))) AS k), b AS (SELECT k, lo + k * 43200 AS start FROM w, s) "
       "SELECT start::BIGINT AS start, count(*)::BIGINT AS n, count(DISTINCT (from_addr, to_addr))::BIGINT AS edges FROM b JOIN tx ON timestamp >= start AND timestamp < start + 86400 GROUP BY 1")
def v1_sliding_windows(spark, sf_dir):
    tx = event_ledger(spark, sf_dir)
    ends = tx.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    rows = tx.join(F.broadcast(ends))  # one row
    k = F.floor((F.col("timestamp") - F.col("lo")) / 43200)
    rows = rows.withColumn("k", F.explode(F.array(k, k - 1))).where((F.col("k") >= 0) & (F.col("lo") + F.col("k") * 43200 + 86400 <= F.col("hi")))
    return rounded(rows.groupBy((F.col("lo") + F.col("k") * 43200).alias("start")).agg(F.count("*").alias("n"), F.countDistinct("from_addr", "to_addr").alias("edges")))

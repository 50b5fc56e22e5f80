"""Ledgers of transfers: the two test ledgers, their schema, and de-duplicating ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = (
    "hash string, block_number long, timestamp long, from_addr string, to_addr string, contract_addr string, value string, value_eth double, gas long, gas_price long, "
    "gas_price_gwei double, method_name string, function_name string, transaction_type string, hop int, day_of_week int, hour_of_day int, file_source string, source_folder string, "
    "is_self_transaction boolean, is_zero_value boolean, has_method boolean"
)
ADDRESSES = "address string, first_seen long, last_seen long, is_contract boolean, is_tornado boolean, cluster_id string, cluster_confidence double, risk_score double"
EVIDENCE = "address string, component_type string, risk_score double, confidence double, evidence_json string, source_analysis string, weight double, is_active boolean, created_at long"
ASSIGNMENTS = "address string, cluster_id string, cluster_type string, confidence double, created_at long"


def enriched(df: DataFrame) -> DataFrame:
    """Adds weekday (Monday 0), hour (UTC) and the three flags."""
    at = F.timestamp_seconds("timestamp")
    method = F.coalesce(F.col("method_name") != "", F.lit(False))
    return df.withColumns(
        {
            "day_of_week": F.weekday(at),
            "hour_of_day": F.hour(at),
            "is_self_transaction": F.coalesce(F.col("from_addr") == F.col("to_addr"), F.lit(False)),
            "is_zero_value": F.coalesce(F.col("value_eth") == 0, F.lit(False)),
            "has_method": method,
            "gas_price_gwei": F.col("gas_price") / 1e9,
        }
    )


def address(kind: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(kind), F.lpad(number.cast("string"), width, "0"))


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense, cyclic ledger with four mixer contracts, derived from ``events``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = address("0x", F.col("user_id"), 40)
    mixer = address("0xmix", F.col("event_id") % 4, 37)
    step = F.when(F.col("event_id") % 97 == 0, 0).otherwise(1 + F.col("event_id") % 5)
    peer = address("0x", (F.col("user_id") + step) % 150, 40)
    kind = F.col("event_type")
    steps = F.element_at(F.array(*map(F.lit, (0.1, 1.0, 10.0, 100.0))), (F.col("event_id") % 4 + 1).cast("int"))
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    df = e.select(
        address("0x", F.col("event_id"), 64).alias("hash"),
        at.alias("timestamp"),
        F.floor(at / 12).alias("block_number"),
        F.when(kind == "signup", mixer).otherwise(user).alias("from_addr"),
        F.when(kind == "purchase", mixer).when(kind == "signup", user).otherwise(peer).alias("to_addr"),
        F.when(kind.isin("purchase", "signup"), steps).when(kind == "error", 0.0).otherwise(F.col("value")).alias("value_eth"),
        (21000 + F.col("event_id") % 7 * 1000).alias("gas"),
        ((20 + F.col("event_id") % 50) * 1000000000).alias("gas_price"),
        F.create_map(*[F.lit(x) for p in (("purchase", "deposit"), ("signup", "withdraw"), ("click", "transfer"), ("error", "swap"), ("view", "")) for x in p])[kind].alias("method_name"),
        F.lit("").alias("function_name"),
    )
    return enriched(df)


def order_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layered, acyclic ledger: customers pay suppliers, suppliers pay nations."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    first = read("lineitem").join(read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    first = first.select(
        F.concat_ws("-", F.lit("0xo"), "l_orderkey", "l_linenumber").alias("hash"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
        key("0xc", "o_custkey").alias("from_addr"), key("0xs", "l_suppkey").alias("to_addr"), F.col("l_extendedprice").alias("value_eth"),
    )
    second = read("supplier").select(
        key("0xt", "s_suppkey").alias("hash"), F.lit(1704067200).cast("long").alias("timestamp"),
        key("0xs", "s_suppkey").alias("from_addr"), key("0xn", "s_nationkey").alias("to_addr"), F.col("s_acctbal").alias("value_eth"),
    )
    return first.unionByName(second)


#: The same ledgers in SQL, for comparison.
TX = """tx AS (SELECT *, timestamp // 12 AS block_number, (isodow(make_timestamp(timestamp * 1000000)) - 1)::INT AS day_of_week, hour(make_timestamp(timestamp * 1000000))::INT AS hour_of_day,
  from_addr = to_addr AS is_self_transaction, value_eth = 0 AS is_zero_value, method_name <> '' AS has_method, gas_price / 1e9 AS gas_price_gwei, '' AS function_name
 FROM (SELECT '0x' || lpad(event_id::VARCHAR, 64, '0') AS hash, floor(epoch(ts))::BIGINT AS timestamp,
  CASE WHEN event_type = 'signup' THEN '0xmix' || lpad((event_id % 4)::VARCHAR, 37, '0') ELSE '0x' || lpad(user_id::VARCHAR, 40, '0') END AS from_addr,
  CASE event_type WHEN 'purchase' THEN '0xmix' || lpad((event_id % 4)::VARCHAR, 37, '0') WHEN 'signup' THEN '0x' || lpad(user_id::VARCHAR, 40, '0')
    ELSE '0x' || lpad(((user_id + CASE WHEN event_id % 97 = 0 THEN 0 ELSE 1 + event_id % 5 END) % 150)::VARCHAR, 40, '0') END AS to_addr,
  CASE WHEN event_type IN ('purchase','signup') THEN [0.1,1.0,10.0,100.0][(event_id % 4 + 1)::INT]::DOUBLE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE value END AS value_eth,
  21000 + event_id % 7 * 1000 AS gas, (20 + event_id % 50) * 1000000000 AS gas_price,
  CASE event_type WHEN 'purchase' THEN 'deposit' WHEN 'signup' THEN 'withdraw' WHEN 'click' THEN 'transfer' WHEN 'error' THEN 'swap' ELSE '' END AS method_name FROM events))"""
INCIDENCE = """inc AS (SELECT from_addr AS address, * FROM tx WHERE from_addr IS NOT NULL UNION ALL SELECT to_addr AS address, * FROM tx WHERE to_addr IS NOT NULL AND to_addr IS DISTINCT FROM from_addr)"""
ORDERS = """ox AS (SELECT '0xo-' || l_orderkey || '-' || l_linenumber AS hash, epoch(l_shipdate::TIMESTAMP)::BIGINT AS timestamp, '0xc' || o_custkey AS from_addr, '0xs' || l_suppkey AS to_addr, l_extendedprice AS value_eth
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL
  SELECT '0xt' || s_suppkey, 1704067200, '0xs' || s_suppkey, '0xn' || s_nationkey, s_acctbal FROM supplier)"""

"""Registered queries: cleaning, load status, insertion and replacement, on the event ledger as an explorer would export it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import ingest as I
from ..sources.ledger import INCIDENCE, TX, event_ledger
from .catalog import query, rounded

FILE = "'data/' || CASE WHEN method_name IN ('deposit', 'withdraw') THEN method_name ELSE 'other' END || '/' || (timestamp // 86400) || '.csv'"
KEPT = "hash block_number timestamp from_addr to_addr value_eth gas gas_price gas_price_gwei method_name transaction_type hop day_of_week hour_of_day file_source source_folder is_self_transaction is_zero_value has_method".split()


def _with_files(tx):
    kind = F.when(F.col("method_name").isin("deposit", "withdraw"), F.col("method_name")).otherwise("other")
    day = F.floor(F.col("timestamp") / 86400).cast("string")
    return tx.withColumn("file_source", F.concat(F.lit("data/"), kind, F.lit("/"), day, F.lit(".csv")))


def _raw(spark, sf_dir):
    """The ledger in an explorer's names, all text: each row twice, and rows that cleaning must drop."""
    tx = _with_files(event_ledger(spark, sf_dir))
    text = tx.select(
        "hash", F.col("timestamp").cast("string").alias("timeStamp"), F.col("block_number").cast("string").alias("blockNumber"), F.col("from_addr").alias("from"), F.col("to_addr").alias("to"),
        F.when(F.col("value_eth") == 0, F.lit("none")).otherwise((F.col("value_eth") * 1e18).cast("string")).alias("value"), F.col("gas").cast("string").alias("gasLimit"),
        F.col("gas_price").cast("string").alias("gasPrice"), F.col("method_name").alias("methodName"), "file_source",
    )
    bad = text.withColumn("hash", F.concat(F.lit("row-"), "hash")).unionByName(text.withColumn("timeStamp", F.lit("soon")))
    copies = text.withColumn("__row", F.lit(0)).unionByName(text.withColumn("__row", F.lit(1)).withColumn("gasLimit", F.lit("1"))).unionByName(bad.withColumn("__row", F.lit(2)))
    return copies.withColumn("__block", F.lit(0))


@query(f"WITH {TX} SELECT hash, block_number::BIGINT AS block_number, timestamp, from_addr, to_addr, round(value_eth, 6) + 0.0 AS value_eth, gas::BIGINT AS gas, gas_price::BIGINT AS gas_price, round(gas_price_gwei::DOUBLE, 6) + 0.0 AS gas_price_gwei, method_name, "
       f"CASE WHEN method_name IN ('deposit', 'withdraw') THEN method_name ELSE 'unknown' END AS transaction_type, 0::BIGINT AS hop, day_of_week::BIGINT AS day_of_week, hour_of_day::BIGINT AS hour_of_day, {FILE} AS file_source, 'data/input' AS source_folder, is_self_transaction, is_zero_value, has_method FROM tx")
def c1_clean_transactions(spark, sf_dir):
    """Renamed, checked, converted, defaulted and derived; the first row of each hash stays."""
    return rounded(I.clean_transactions(_raw(spark, sf_dir)).select(*KEPT))


@query(f"WITH {TX}, {INCIDENCE} SELECT DISTINCT address FROM inc WHERE length(address) = 42 AND address LIKE '0x%'")
def c6_clean_addresses(spark, sf_dir):
    """Valid addresses of the ledger, each once, out of a list with repeats and malformed ones."""
    a = I.affected_addresses(event_ledger(spark, sf_dir))
    listed = a.unionByName(a.select(F.concat("address", F.lit("0")).alias("address"))).unionByName(a)
    return I.clean_addresses(listed.withColumns({"file_source": F.lit("a.csv"), "__block": F.lit(0), "__row": F.lit(0)})).select("address")


@query(f"WITH {TX}, o AS (SELECT * FROM tx WHERE method_name <> 'deposit'), n AS (SELECT * FROM tx WHERE method_name IN ('deposit', 'withdraw')) SELECT hash, 'old' AS origin FROM o UNION ALL SELECT hash, 'new' FROM n WHERE hash NOT IN (SELECT hash FROM o)")
def c8_insert_if_absent(spark, sf_dir):
    """A load that overlaps what is there: only unseen hashes come in."""
    tx = event_ledger(spark, sf_dir).select("hash", "method_name")
    old, new = tx.where("method_name <> 'deposit'").withColumn("origin", F.lit("old")), tx.where("method_name in ('deposit', 'withdraw')").withColumn("origin", F.lit("new"))
    return I.insert_if_absent(old, new).select("hash", "origin")


@query(f"WITH {TX}, f AS (SELECT hash, {FILE} AS file_source, method_name, gas FROM tx), n AS (SELECT * FROM f WHERE method_name = 'deposit' AND gas > 24000) SELECT hash, file_source, 'old' AS origin FROM f WHERE file_source NOT IN (SELECT file_source FROM n) UNION ALL SELECT hash, file_source, 'new' FROM n")
def c9_replace_files(spark, sf_dir):
    """Files that are loaded again with fewer rows: their old rows go."""
    old = _with_files(event_ledger(spark, sf_dir)).select("hash", "file_source", "method_name", "gas").withColumn("origin", F.lit("old"))
    new = old.where("method_name = 'deposit' and gas > 24000").withColumn("origin", F.lit("new"))
    return I.replace_files(old, new).select("hash", "file_source", "origin")


DAYS = "SELECT timestamp // 86400 AS day, count(*) AS n FROM tx GROUP BY 1"


@query(f"WITH {TX}, d AS ({DAYS}) SELECT 'data/' || day || '.csv' AS path, CASE WHEN day % 3 = 0 THEN 'new' WHEN day % 3 = 1 THEN 'unchanged' ELSE 'modified' END AS load_status FROM d")
def s5_load_status(spark, sf_dir):
    """A file a day; the log knows two of three days, one of them with other contents."""
    path = F.concat(F.lit("data/"), F.col("day").cast("string"), F.lit(".csv"))
    d = event_ledger(spark, sf_dir).groupBy(F.floor(F.col("timestamp") / 86400).alias("day")).agg(F.count("*").alias("n"))
    files = d.select("day", path.alias("path"), F.sha2(F.concat_ws(":", "day", "n"), 256).alias("file_hash"))
    log = files.where("day % 3 > 0").withColumn("file_hash", F.when(F.col("day") % 3 == 1, F.col("file_hash")).otherwise("earlier"))
    return I.load_status(files, log).select("path", "load_status")

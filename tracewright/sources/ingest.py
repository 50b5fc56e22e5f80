"""CSV ingest: discovery, fingerprints, load status, cleaning, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ledger import enriched

# Names in explorer files and in the ledger.
NAMES = {
    "blockNumber": "block_number", "timeStamp": "timestamp", "from": "from_addr", "to": "to_addr", "contractAddress": "contract_addr",
    "gasPrice": "gas_price", "gasLimit": "gas", "functionName": "function_name", "methodName": "method_name",
}
DEFAULTS = {"method_name": "", "function_name": "", "contract_addr": None, "value": None, "gas": None, "gas_price": None, "block_number": None}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All CSV files under ``path``, every column as text, with file path and place in the file."""
    raw = spark.read.option("recursiveFileLookup", "true").option("header", True).option("pathGlobFilter", "*.csv").csv(path)
    return raw.select("*", F.col("_metadata.file_path").alias("file_source"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))


def table_type(columns: list[str]) -> str:
    return "addresses" if "address" in columns and not {"hash", "from", "from_addr"} & set(columns) else "transactions"


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path)
    return files.select("path", F.sha2("content", 256).alias("file_hash"), "length")


def load_status(files: DataFrame, log: DataFrame) -> DataFrame:
    """new, unchanged or modified, against the log of loaded files."""
    old = log.select("path", F.col("file_hash").alias("__old"))
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__old") == F.col("file_hash"), "unchanged").otherwise("modified")
    return files.join(old, "path", "left").withColumn("load_status", status).drop("__old")


def scenario(status: DataFrame) -> DataFrame:
    s = F.col("load_status")
    return status.agg(F.when(F.every(s == "new"), "all_new").when(F.every(s == "unchanged"), "all_unchanged").otherwise("mixed").alias("scenario"))


def structure(df: DataFrame, needed: str = "hash", sample: int = 100) -> DataFrame:
    """One row: is it empty, does it lack the key, columns without values in the first rows."""
    names = [c for c in df.columns if not c.startswith("__")]
    empty = [F.when(F.count(F.col(f"`{c}`")) == 0, F.lit(c)) for c in names]
    return df.limit(sample).agg((F.count("*") == 0).alias("empty"), F.lit(needed not in names).alias("lacks_key"), F.array_compact(F.array(*empty)).alias("all_null"))


def clean_transactions(raw: DataFrame) -> DataFrame:
    """Rename, validate, convert, default, derive, and keep the first row of each hash."""
    df = raw.withColumnsRenamed({k: v for k, v in NAMES.items() if k in raw.columns})
    for name, value in DEFAULTS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value).cast("string"))
    at = F.col("timestamp").try_cast("double").cast("long")
    df = df.where(F.col("hash").startswith("0x") & (at > 1000000000) & (at < 2000000000))
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    df = df.withColumns(
        {
            "timestamp": at, "block_number": F.coalesce(F.col("block_number").try_cast("long"), F.lit(0)), "value_eth": number("value") / 1e18, "gas": number("gas").cast("long"), "gas_price": number("gas_price").cast("long"),
            "hop": F.lit(0), "source_folder": F.lit("data/input"),
            "transaction_type": F.coalesce(F.nullif(F.regexp_extract("file_source", "/(deposit|withdraw)/", 1), F.lit("")), F.lit("unknown")),
        }
    )
    first = W.partitionBy("hash").orderBy("file_source", "__block", "__row")
    df = df.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    names = "hash block_number timestamp from_addr to_addr contract_addr value value_eth gas gas_price gas_price_gwei method_name function_name transaction_type hop day_of_week hour_of_day file_source source_folder is_self_transaction is_zero_value has_method"
    return enriched(df).select(*names.split())


def clean_addresses(raw: DataFrame) -> DataFrame:
    """42-character 0x addresses, numbers or 0, the last row of each address."""
    df = raw.where(F.col("address").startswith("0x") & (F.length("address") == 42))
    for c in ("total_volume_in_eth", "total_volume_out_eth", "total_transactions"):
        df = df.withColumn(c, F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0))
    last = W.partitionBy("address").orderBy(F.col("file_source").desc(), F.col("__block").desc(), F.col("__row").desc())
    return df.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__block", "__row")


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str = "hash") -> DataFrame:
    return existing.unionByName(new.join(existing, key, "left_anti"))


def replace_files(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of files that are loaded again make way for the new rows; files by full path."""
    return existing.join(new.select("file_source").distinct(), "file_source", "left_anti").unionByName(new.select(*existing.columns))


def affected_addresses(tx: DataFrame) -> DataFrame:
    return tx.select(F.explode(F.array_compact(F.array("from_addr", "to_addr"))).alias("address")).distinct()

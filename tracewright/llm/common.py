"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What every contract here calls a word: a run of characters that are not
#: ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

#: Used only where the session names no shared folder, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
BATCH = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL_CHECKPOINTS
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch: long texts then cannot fill a worker's memory.

    The session keeps the bound.  It is the same for all operators here, so the
    order in which plans are built and run does not matter.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def give_back() -> None:
    """Return what a worker has freed to the system: workers live on, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc only
        libc.malloc_trim(0)


def id_crc(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def fold(modulus: int, remainder: int, column: str = "doc_id") -> Column:
    """True where the id belongs to the held-out fold; a null id counts as held out."""
    return F.coalesce(id_crc(column) % modulus == remainder, F.lit(True))


def learnable(labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, y) outside the held-out fold, without null ids and labels; an id of both classes counts for the larger one."""
    return (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~fold(modulus, remainder))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )


def bounded_ids(labels: DataFrame, label: str, per_class: int, modulus: int, remainder: int) -> DataFrame:
    """At most ``per_class`` learnable ids of each class 0 and 1, least hash first.

    The result has at most ``2 * per_class`` rows (doc_id, y), so it may be broadcast.
    """
    one = learnable(labels, label, modulus, remainder)
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    parts = [one.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])

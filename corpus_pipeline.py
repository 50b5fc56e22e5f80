"""A corpus pipeline: five of the training-data operators, one after another.

Every stage works on all documents that its predecessor kept, is written as
Parquet and read again as the next one's input.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import language_id, mixing, ngram_join, secret_scan, sentencepiece_codec
from tracewright.llm.common import WORD, shared_dir, table
from tracewright.llm.queries import TOKENIZER

#: Documents whose language is less certain than this are rejected.
LEAST_SCORE = 0.4

ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or null, and those of no certain language."""
    columns = docs.columns
    found = language_id.identify(docs, language_id.fit(docs), into=("__lang", "__score"))
    return found.where((F.col("__lang") != language_id.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, that with the least id; of equal texts, one.  Texts without words are classes of their own."""
    columns = docs.columns
    first = ngram_join.firsts(docs).select(F.col("key").alias("__first"), F.col("id").alias("__id"))
    keyed = docs.withColumn("__key", ngram_join.text_key())
    kept = keyed.join(first, (F.col("__key") == F.col("__first")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    wordless = keyed.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return kept.dropDuplicates(["__key"]).unionByName(wordless).select(*[F.col(f"`{c}`") for c in columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in a text by its kind; keeps every document."""
    columns = docs.columns
    found = secret_scan.scan(docs, into="__secrets")
    clean = found.withColumn("text", secret_scan.redact(F.col("text"), F.col("__secrets")))
    if "n_chars" in columns:
        clean = clean.withColumn("n_chars", F.when(F.size("__secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*[F.col(f"`{c}`") for c in columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document for each time it is taken, the last one of a source cut to what is left."""
    columns = docs.columns
    return mixing.emit(mixing.mix(docs, keep=tuple(columns)), columns, size_column="n_chars" if "n_chars" in columns else None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text of the mix, ready to be packed."""
    vocabulary = sentencepiece_codec.read_model(TOKENIZER)
    coded = sentencepiece_codec.encode(docs.select("doc_id", "source", "text"), vocabulary)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [("language_id", languages), ("ngram_jaccard_join", near_duplicates), ("secret_scan", secrets), ("source_mixing", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

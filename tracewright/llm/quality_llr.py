"""Quality rules: fixed counts, and a hashed n-gram likelihood ratio, in DataFrame operations only.

Fixed counts are those of :func:`counts`.  The verdict on the rest compares two
multinomials over ``BUCKETS`` hashed unigrams and bigrams, one of trusted
documents, one of the raw corpus (every n-gram of every document, added up in
the map tasks): a document's score is the sum of log(trusted / raw) over its
n-grams, divided by their number.  Every document whose score is ``THRESHOLD``
or more is kept; nothing is drawn at random.

Trusted documents are all whose label is 1; without any, all scores are 0 and
the fixed counts decide alone.  An id labelled both ways counts as trusted.

Repeated three-word windows are found inside a row, from the sorted hashes of
its windows, so no word leaves its row.  Windows are told apart by 64-bit
hashes; two different windows of one text that share a hash would count as
repeated (one in 10^11 for a text of 20,000 words).

Defined results: a null or wordless text has all counts 0 and score 0, and
fails the base rule.  Repeated rows repeat their result; equal scores fare
equally; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD

#: Hashed n-grams are told apart by so many buckets; a document of trusted words shares few of them with others.
BUCKETS = 1 << 16
THRESHOLD = -0.15
#: Up to so many distinct repeated windows are looked up one by one.
FEW = 48


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def counts(text: Column, w: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols and n_dup_lines; w: the text's words."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": F.when(F.instr(t, "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long"),
    }


def window_hashes(w: Column) -> Column:
    last = F.size(w) - 2
    hashed = F.transform(F.slice(w, F.lit(1), F.greatest(last, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(last > 0, hashed).otherwise(F.array().cast("array<bigint>"))


def with_repeats(df: DataFrame) -> DataFrame:
    """``df`` with n_repeat_words, words inside windows found twice or more, for its ``hashes``.

    Each array is a column of its own: a lambda that holds an expression would
    work it out again for every element.
    """
    ordered, again, pairs = F.col("ordered"), F.col("again"), F.col("pairs")
    df = df.withColumn("ordered", F.sort_array("hashes"))
    df = df.withColumn("again", F.array_distinct(F.filter(ordered, lambda x, i: (i > 0) & (x == F.get(ordered, i - 1)))))
    tagged = F.transform("hashes", lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    df = df.withColumn("pairs", F.when(F.size(again) > FEW, F.sort_array(tagged)))
    same = lambda e, k: F.coalesce(F.get(pairs, k)["h"] == e["h"], F.lit(False))
    few = F.filter(F.transform("hashes", lambda x, i: F.when(F.array_contains(again, x), i)), lambda i: i.isNotNull())
    many = F.transform(F.filter(pairs, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["i"])
    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))
    repeats = F.when(F.size(again) == 0, 0).when(F.size(again) <= FEW, covered(few)).otherwise(covered(many))
    return df.withColumn("n_repeat_words", repeats.cast("long"))


def grams(w: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of a text's unigrams, then of its bigrams."""
    one = F.transform(w, lambda x: F.pmod(F.hash(x), F.lit(buckets)))
    two = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.pmod(F.hash(x, F.get(w, i + 1)), F.lit(buckets)))
    return F.concat(one, two)


def log_ratios(documents: DataFrame, labels: DataFrame, label: str = "quality", buckets: int = BUCKETS) -> DataFrame:
    """One row, ``ratios``: array<float> of log(trusted / raw) by bucket; empty without trusted rows."""
    ids = labels.where(F.col("doc_id").isNotNull() & (F.col(label).cast("int") == 1)).select(F.col("doc_id").alias("trusted_id")).distinct()
    sums = (
        documents.select("doc_id", "text")
        .join(ids.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left")  # the ids grow with the input
        .select(F.col("trusted_id").isNotNull().alias("good"), words(F.col("text")).alias("w"))
        .select("good", F.explode(grams(F.col("w"), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count_if("good").alias("good"))
    )
    every = documents.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(sums, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "good")])
    # one row over ``buckets`` entries
    packed = full.agg(F.sum("raw").alias("raws"), F.sum("good").alias("goods"), F.array_sort(F.collect_list(F.struct("bucket", "raw", "good"))).alias("all"))
    log = lambda n, total: F.log((n + 1) / (total + buckets))
    ratios = F.transform("all", lambda b: (log(b["good"], F.col("goods")) - log(b["raw"], F.col("raws"))).cast("float"))
    return packed.select(F.when(F.col("goods") > 0, ratios).otherwise(F.array().cast("array<float>")).alias("ratios"))


def score(w: Column, ratios: Column, buckets: int = BUCKETS) -> Column:
    n = F.size(w)
    total = F.aggregate(
        F.transform(w, lambda x, i: F.get(ratios, F.pmod(F.hash(x), F.lit(buckets))) + F.when(i + 1 < n, F.get(ratios, F.pmod(F.hash(x, F.get(w, i + 1)), F.lit(buckets)))).otherwise(F.lit(0).cast("float"))),
        F.lit(0.0),
        lambda a, x: a + x.cast("double"),
    )
    return F.when((n == 0) | (F.size(ratios) == 0), 0.0).otherwise(total / (2 * n - 1))


def judge(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the fixed counts, n_repeat_words, score, base_failed and kept, for every row."""
    ratios = log_ratios(documents, labels)
    text = F.col("text")
    rows = documents.select("doc_id", "text").select("doc_id", "text", words(text).alias("w"), ratios.scalar().alias("ratios"))
    counted = rows.select("doc_id", *[c.alias(n) for n, c in counts(text, F.col("w")).items()], window_hashes(F.col("w")).alias("hashes"), score(F.col("w"), F.col("ratios")).alias("score"))
    out = with_repeats(counted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))

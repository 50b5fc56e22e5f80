"""Mixing sources to target weights, with DataFrame operations only.

Sizes are counted in words.  A source's target is its share, by weight, of the
budget (``share`` times all sizes), but never above ``limit`` times its own
size; what is cut off there goes to the other sources by weight, until no
source is above.  The level at which that comes to rest follows from one sort
of the sources by limit over weight and running sums.

A target of ``e`` complete epochs and a rest takes every document ``e`` times
and fills the rest with Efraimidis-Spirakis sampling: documents are ordered by
an exponential key divided by the document's quality weight, and taken from the
front until the rest is full; the last one is cut at the word where it is.

Keys run over a fixed number of ranges in each source, which follow the keys'
own distribution: for no quality weight does a range hold more than about twice
its even share.  Sizes are first summed by source and range, running sums over
ranges give each range its start, and the order within a range is all that a task
has to sort: a source with most of the rows is spread over all of its ranges.
Sources themselves, a row each, are put in order in one task.

Defined results: a null text has size 0; size-0 documents are never taken.  A
null source is a source, the last one.  Repeated rows are documents of their
own and share a key; of equal keys, ids and sizes the text's hash decides, so only
equal texts are interchangeable.  Keys depend on id and size only, so reruns
agree.  An empty table gives an empty mix.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT = 1.5, 2.0
RANGES = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.25 to 1: lower for texts made of very short or very long "words"."""
    chars = F.length(text) - F.regexp_count(text, F.lit(SPACE))
    mean = chars / F.greatest(size_of(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.25), F.least(F.lit(1.0), mean / 4, F.lit(10.0) / F.greatest(mean, F.lit(1e-9)))), F.lit(0.25))


def uniform(seed: str, *columns: Column) -> Column:
    """Above 0 and below 1, the same for the same values."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size) -> also target.  Rows: one for each source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("turn") - 1, F.lit(len(weights))).cast("int") + 1)
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("turn"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, W.unboundedFollowing)
    ranked = (
        sizes.withColumn("turn", F.row_number().over(order))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(limit))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    )
    # the first source (by cap over weight) that is not filled up sets the level for it and all later ones
    final = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("turn"), F.col("level"))))
    return ranked.withColumn("final", final.over(everything)["level"]).select(
        "source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight"))).alias("target")
    )


def mix(
    documents: DataFrame,
    text: str = "text",
    source: str = "source",
    id_column: str = "doc_id",
    keep: tuple[str, ...] = (),
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    seed: str = "mix",
    quality: Column | None = None,
) -> DataFrame:
    """One row for each document: id, source, size, source_size, target, epochs, extra, taken, and ``keep``.

    ``taken = epochs * size + extra``.  Columns named in ``keep`` ride along
    unchanged in a struct ``kept``, so their names cannot clash.  ``quality`` is a
    weight for each document (a classifier's score, say), taken from 0.25 to 1;
    without it, :func:`quality_weight` of the text.
    """
    if quality is None:
        weight = quality_weight(F.col(text))
    else:
        weight = F.coalesce(F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.nanvl(quality.cast("double"), F.lit(0.25)))), F.lit(0.25))
    size = size_of(F.col(text))
    u = uniform(seed, F.col(id_column), size)
    rows = (
        documents.select(
            F.col(id_column).alias("id"),
            F.col(source).alias("source"),
            size.alias("size"),
            (-F.log(u) / weight).alias("key"),
            F.xxhash64(text).alias("digest"),
            F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(None).cast("int").alias("none")]).alias("kept"),
        )
        # between the distributions of keys of weights 0.25 and 1: even ranges, in the keys' order
        .withColumn("range", F.least(F.floor((1 - (F.exp(-F.col("key") / 4) + F.exp(-F.col("key"))) / 2) * RANGES), F.lit(RANGES - 1)).cast("int"))
    )
    if not keep:
        rows = cut(rows)  # narrow rows: texts are read once
    in_source = W.partitionBy("source")
    so_far = in_source.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    starts = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(so_far), F.lit(0))).withColumn("source_size", F.sum("range_size").over(in_source))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, limit)
    plan = starts.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(
        F.col("s.source").alias("p_source"), F.col("s.range").alias("p_range"), "start", "s.source_size", "target"
    )
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("range") == F.col("p_range")))
    within = W.partitionBy("source", "range").orderBy("key", "id", "size", "digest").rowsBetween(W.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("target") - F.col("epochs") * F.col("source_size") - (F.col("start") + F.sum("size").over(within) - F.col("size"))
    return (
        joined.withColumn("epochs", epochs)
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.floor(left + F.lit(1e-6)).cast("long"))).cast("long"))
        .select("id", "source", "size", "source_size", "target", "epochs", "extra", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"), "kept")
    )


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th word."""
    # white space is kept as it is: pieces are a word with the space before it
    pieces = F.regexp_extract_all(text, F.lit(rf"{SPACE}*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def emit(mixed: DataFrame, columns: list[str], text: str = "text", size_column: str | None = "n_chars") -> DataFrame:
    """The mix itself: each document as often as it is taken, in the columns it had.

    ``mixed`` comes from :func:`mix` with ``keep`` = ``columns``.
    """
    copies = F.array_repeat(F.lit(-1).cast("long"), F.col("epochs").cast("int"))
    copies = F.concat(copies, F.when(F.col("extra") > 0, F.array(F.col("extra"))).otherwise(F.array().cast("array<bigint>")))
    out = mixed.where(F.col("taken") > 0).select("kept", "size", F.explode(copies).alias("words"))
    whole = F.col("kept")[text]
    cut = F.when((F.col("words") < 0) | (F.col("words") >= F.col("size")), whole).otherwise(first_words(whole, F.col("words")))
    out = out.select("kept", cut.alias("__cut"))
    new = {text: F.col("__cut")}
    if size_column:
        new[size_column] = F.length("__cut").cast("long")
    return out.select(*[(new[c] if c in new else F.col("kept")[c]).alias(c) for c in columns])

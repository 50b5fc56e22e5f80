"""Address-transaction incidence and the joins by band and by interval."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def incidence(tx: DataFrame) -> DataFrame:
    """One row for each address and transaction; a self-transfer gives one row.

    An explode and equi-joins in place of a join on ``from = a OR to = a``,
    which could only run as a nested loop.
    """
    ends = F.array_distinct(F.array_compact(F.array("from_addr", "to_addr")))
    return tx.select(F.explode(ends).alias("address"), "*")


def cluster_incidence(tx: DataFrame, assignment: DataFrame) -> DataFrame:
    """Distinct (cluster_id, transaction) rows."""
    rows = incidence(tx).join(assignment.select("address", "cluster_id"), "address").drop("address")
    return rows.dropDuplicates(["cluster_id", "hash"])


def counterparty() -> Column:
    return F.when(F.col("to_addr") == F.col("address"), F.col("from_addr")).otherwise(F.col("to_addr"))


def direction() -> Column:
    """self, in, out or unknown."""
    a = F.col("address")
    return (
        F.when((F.col("from_addr") == a) & (F.col("to_addr") == a), "self")
        .when(F.col("to_addr") == a, "in").when(F.col("from_addr") == a, "out").otherwise("unknown")
    )


def near_in_time(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, width: int) -> DataFrame:
    """Pairs with equal ``keys`` and times at most ``width`` apart.

    Time is cut into buckets of ``width``; a left row meets the right rows of its
    own and both neighbouring buckets, so the join is an equi-join.
    """
    here = F.floor(F.col(left_time) / width)
    a = left.withColumn("__bucket", F.explode(F.array(here - 1, here, here + 1)))
    b = right.withColumn("__bucket", F.floor(F.col(right_time) / width))
    return a.join(b, [*keys, "__bucket"]).where(F.abs(F.col(left_time) - F.col(right_time)) <= width).drop("__bucket")


DENOMINATIONS = (0.1, 1.0, 10.0, 100.0)


def denomination(value: Column, tolerance: float = 0.05) -> Column:
    """The standard amount within ``tolerance`` of the value, else null; bands do not overlap."""
    out = F.lit(None).cast("double")
    for d in DENOMINATIONS:
        out = F.when(F.abs(value - d) <= d * tolerance, F.lit(d)).otherwise(out)
    return out


#: Seconds of time, or places in a row, that one group of a window holds.
SPAN = 65536


def _earlier(points: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, at, n), each second once, and ``asked`` (keys, at, ...), with ``before`` and ``place``: the n and the number of points earlier than ``at``.

    Sums run within ``SPAN`` seconds and go on from the sums of the spans before, so no task holds all rows of a key.
    """
    rows = points.withColumn("point", F.lit(1)).unionByName(asked.withColumns({"n": F.lit(0), "point": F.lit(0)}), allowMissingColumns=True).withColumn("span", F.floor(F.col("at") / SPAN))
    spans = rows.groupBy(*keys, "span").agg(F.sum("n").alias("n"), F.sum("point").alias("p"))
    past = W.partitionBy(*keys).orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select(*keys, "span", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n0"), F.coalesce(F.sum("p").over(past), F.lit(0)).alias("p0"))
    here = W.partitionBy(*keys, "span").orderBy("at", "point").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"before": F.sum("n").over(here) - F.col("n"), "place": F.sum("point").over(here) - F.col("point")}).join(spans, [*keys, "span"])
    return rows.withColumns({"before": F.col("before") + F.col("n0"), "place": F.col("place") + F.col("p0")}).drop("n0", "p0", "span")


def _runs(places: DataFrame, keys: list[str], ahead: bool) -> DataFrame:
    """Each of ``places`` (keys, place) with ``end``: the last (or, not ``ahead``, first) place of its run of consecutive ones."""
    p = F.col("place") if ahead else -F.col("place")
    rows = places.select(*keys, p.alias("p")).withColumn("span", F.floor(F.col("p") / SPAN))
    # from the last place back: Spark goes over the rest of a window again for each row where it is bounded by the row itself, but adds up what came before
    so_far = (W.unboundedPreceding, 0)
    by = W.partitionBy(*keys, "span").orderBy(F.desc("p"))
    stop = F.when(F.coalesce(F.lag("p").over(by) != F.col("p") + 1, F.lit(True)), F.col("p"))
    rows = rows.withColumn("stop", stop).withColumn("end", F.min("stop").over(by.rowsBetween(*so_far)))
    # a run that reaches the end of its span goes on where the next span begins with it
    first = rows.where(F.col("p") == F.col("span") * SPAN).select(*keys, "span", "end")
    over = W.partitionBy(*keys).orderBy(F.desc("span"))
    goes_on = (F.col("end") == F.col("span") * SPAN + SPAN - 1) & F.coalesce(F.lag("span").over(over) == F.col("span") + 1, F.lit(False))
    first = first.withColumn("stop", F.when(~goes_on, F.col("end"))).withColumn("far", F.min("stop").over(over.rowsBetween(*so_far))).select(*keys, (F.col("span") - 1).alias("span"), "far")
    end = F.when(F.col("end") == F.col("span") * SPAN + SPAN - 1, F.coalesce("far", "end")).otherwise(F.col("end"))
    return rows.join(first, [*keys, "span"], "left").select(*keys, (F.col("p") if ahead else -F.col("p")).alias("place"), (end if ahead else -end).alias("end"))


def band_matches(tx: DataFrame, width: int = 259200, tolerance: float = 0.05, farthest: bool = True) -> DataFrame:
    """(hash, matches, farthest): for each transfer near a standard amount, others near the same one within ``width`` seconds that do not touch its sender.

    They are counted, not paired: all transfers of the amount in the window less
    those that touch the sender.  The farthest is the first or last second of
    the window that holds a transfer of others; runs of seconds in which all
    transfers touch the sender are stepped over at once.  Only transfers whose
    hash is not theirs alone are paired, as theirs must be left out by hash.
    """
    from .graph import cut

    rows = tx.withColumn("denom", denomination(F.col("value_eth"), tolerance)).where("denom is not null and timestamp is not null and hash is not null")
    rows = cut(rows.select("hash", "denom", F.col("timestamp").alias("t"), F.col("from_addr").alias("a"), F.col("to_addr").alias("d")))
    others = rows.where("a is not null and d is not null")
    senders = rows.where("a is not null")
    again = rows.groupBy("hash").agg(F.count("*").alias("k")).where("k > 1").select("hash")
    alone = senders.join(again, "hash", "left_anti")

    seconds = others.groupBy("denom", F.col("t").alias("at")).agg(F.count("*").alias("n"))
    touched = others.select("denom", F.col("t").alias("at"), F.explode(F.array_distinct(F.array("a", "d"))).alias("a")).groupBy("denom", "a", "at").agg(F.count("*").alias("n"))
    ends = F.explode(F.array(F.struct((F.col("t") - width).alias("at"), F.lit(0).alias("end")), F.struct((F.col("t") + width + 1).alias("at"), F.lit(1).alias("end"))))
    asked = senders.select("denom", "a", "t").distinct().select("denom", "a", "t", ends.alias("e")).select("denom", "a", "t", "e.at", "e.end")
    placed = cut(_earlier(seconds, asked, ["denom"]))
    sums = placed.where("point = 0").select("denom", "a", "t", "end", "before", "place").unionByName(
        _earlier(touched, asked, ["denom", "a"]).where("point = 0").select("denom", "a", "t", "end", (-F.col("before")).alias("before"), F.lit(None).cast("long").alias("place"))
    )
    at = lambda k, c: F.when(F.col("end") == k, F.col(c))
    counted = sums.groupBy("denom", "a", "t").agg(
        (F.sum(at(1, "before")) - F.sum(at(0, "before"))).alias("matches"), F.max(at(0, "place")).alias("lo"), (F.max(at(1, "place")) - 1).alias("hi")
    ).where("matches > 0")
    if farthest:
        places = placed.where("point = 1").select("denom", "at", "n", "place")
        full = cut(touched.join(places, ["denom", "at", "n"]).select("denom", "a", "place"))
        time = lambda c: places.select("denom", F.col("place").alias(c), F.col("at").alias(f"t_{c}"))
        for c, ahead, step in (("lo", True, 1), ("hi", False, -1)):
            counted = counted.join(_runs(full, ["denom", "a"], ahead).withColumnRenamed("place", c), ["denom", "a", c], "left")
            counted = counted.withColumn(c, F.coalesce(F.col("end") + step, F.col(c))).drop("end").join(time(c), ["denom", c])
        counted = counted.withColumn("farthest", F.greatest(F.abs(F.col("t") - F.col("t_lo")), F.abs(F.col("t_hi") - F.col("t"))))
    out = ["hash", "matches", *(["farthest"] if farthest else [])]
    left = senders.join(again, "hash", "left_semi").select("hash", "denom", F.col("t").alias("t1"), "a")
    right = others.select(F.col("hash").alias("h2"), "denom", F.col("t").alias("t2"), F.col("a").alias("f2"), F.col("d").alias("d2"))
    met = near_in_time(left, right, ["denom"], "t1", "t2", width).where("f2 <> a and d2 <> a and hash <> h2")
    paired = met.groupBy("hash").agg(F.count("*").alias("matches"), F.max(F.abs(F.col("t1") - F.col("t2"))).alias("farthest"))
    return alone.join(counted, ["denom", "a", "t"]).select(*out).unionByName(paired.select(*out))


#: Rows of a block of addresses, on average, and addresses whose hours are compared at once.
BLOCK_ROWS, BLOCK_ADDRESSES, BLOCK_HOURS = 1 << 19, 1024, 4096


def _covered(width: int, above: float):
    """Of two blocks of addresses, the pairs (a, b, share) with more than ``above`` of a's transfers within ``width`` of one of b's."""

    def starts(ids):
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
        return first, np.r_[first, len(ids)]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"ia": np.zeros(0, np.int64), "ib": np.zeros(0, np.int64), "coactivity": np.zeros(0)})
        if left.empty or right.empty:
            return none
        left, right = left.sort_values(["ia", "ta"]), right.sort_values(["ib", "tb"])
        (fa, ea), (fb, eb) = starts(left["ia"].to_numpy()), starts(right["ib"].to_numpy())
        ia, ib, n = left["ia"].to_numpy()[fa], right["ib"].to_numpy()[fb], left["na"].to_numpy()[fa].astype(float)
        ta, k, tb = left["ta"].to_numpy(), left["ka"].to_numpy().astype(float), right["tb"].to_numpy()
        hours, ha = np.unique(ta // width, return_inverse=True)
        ra, rb = np.repeat(np.arange(len(fa)), np.diff(ea)), np.repeat(np.arange(len(fb)), np.diff(eb))
        out = []
        for y in range(0, len(fb), BLOCK_ADDRESSES):
            yb = slice(eb[y], eb[min(y + BLOCK_ADDRESSES, len(fb))])
            ny = min(BLOCK_ADDRESSES, len(fb) - y)
            for x in range(0, len(fa), BLOCK_ADDRESSES):
                xa = slice(ea[x], ea[min(x + BLOCK_ADDRESSES, len(fa))])
                nx = min(BLOCK_ADDRESSES, len(fa) - x)
                # at most a's transfers in hours that have, or are next to, one of b's
                most = np.zeros((nx, ny))
                for h in range(0, len(hours), BLOCK_HOURS):
                    some = hours[h : h + BLOCK_HOURS]
                    mine = np.zeros((nx, len(some)), np.float32)
                    here = (ha[xa] >= h) & (ha[xa] < h + BLOCK_HOURS)
                    np.add.at(mine, (ra[xa][here] - x, ha[xa][here] - h), k[xa][here])
                    theirs = np.zeros((len(some), ny), np.float32)
                    for d in (-1, 0, 1):
                        at = np.searchsorted(some, tb[yb] // width + d)
                        hit = (at < len(some)) & (some[np.minimum(at, len(some) - 1)] == tb[yb] // width + d)
                        theirs[at[hit], rb[yb][hit] - y] = 1
                    most += mine @ theirs
                maybe = most > above * n[x : x + nx, None] * (1 - 1e-5)
                for b in np.flatnonzero(maybe.any(axis=0)):
                    rows = np.flatnonzero(maybe[ra[xa] - x, b])
                    t, times = ta[xa][rows], tb[eb[y + b] : eb[y + b + 1]]
                    near = np.searchsorted(times, t - width) < np.searchsorted(times, t + width, "right")
                    share = np.bincount(ra[xa][rows] - x, k[xa][rows] * near, nx) / n[x : x + nx]
                    a = np.flatnonzero(maybe[:, b] & (share > above) & (ia[x : x + nx] != ib[y + b]))
                    out.append(pd.DataFrame({"ia": ia[x + a], "ib": np.full(len(a), ib[y + b]), "coactivity": share[a]}))
        return pd.concat(out) if out else none

    return run


def coactivity(tx: DataFrame, width: int = 3600, least: int = 5, above: float = 0.7) -> DataFrame:
    """(a, b, coactivity): share of a's transfers that have one of b's within ``width`` seconds; addresses with ``least`` transfers.

    Both sides are first reduced to counts by address and second, so that
    repeated activity in a second is compared once.  Addresses are dealt into
    blocks, and each task compares two blocks: by hours first, which bounds the
    share from above, and by seconds where that bound is high enough.
    """
    from .graph import cut

    s = incidence(tx).select("address", "hash", "timestamp")
    n = s.groupBy("address").agg(F.countDistinct("hash").alias("n")).where(F.col("n") >= least)
    ids = cut(n.withColumn("id", F.monotonically_increasing_id()))
    s = cut(s.join(ids, "address").where("timestamp is not null").groupBy("id", "n", F.col("timestamp").alias("t")).agg(F.countDistinct("hash").alias("k")))
    blocks = max(1, -(-s.count() // BLOCK_ROWS))
    own, every = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = s.select(own.alias("i"), every.alias("j"), F.col("id").alias("ia"), F.col("n").alias("na"), F.col("t").alias("ta"), F.col("k").alias("ka"))
    right = s.select(every.alias("i"), own.alias("j"), F.col("id").alias("ib"), F.col("t").alias("tb"))
    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_covered(width, above), "ia long, ib long, coactivity double")
    name = lambda c: ids.select(F.col("id").alias(f"i{c}"), F.col("address").alias(c))
    return pairs.join(name("a"), "ia").join(name("b"), "ib").select("a", "b", "coactivity")

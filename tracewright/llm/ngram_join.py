"""N-gram Jaccard join: five-word shingles, similarity 0.8 or more, every link kept.

1. Texts that are equal form one representative.
2. A representative gets a MinHash signature; bands of three values propose
   pairs.  A band's bucket of any size is dealt into chunks by hash, and pairs of
   chunks are tasks of their own, so a bucket is never gathered as a whole.
3. Inside a task, MinHash values are compared a few at a time.  A pair is dropped
   once the posterior probability (uniform prior) that its similarity reaches the
   threshold falls below ``TOLERANCE``.  A pair that meets in several bands is
   looked at only in the first of them.
4. What is left is verified exactly on the full shingle sets.  Tasks give link
   counts and a spanning forest of the links, never the pairs themselves.
5. Connected components of the forest are the classes.

Rows come back to their texts by text and salt, so a text with very many copies is
spread over ``SALTS`` tasks; so is a class's centre when components are formed.
A bucket's rows meet its size in a join that adaptive execution splits where it
is skewed.  Within one group of m distinct texts that are all near each other,
every pair is compared, as every link counts: about m^2 / ``CHUNK`` rows are moved a band.

A pair of similarity 0.8 escapes all 20 bands with probability 6e-7 and step 3
with at most ``TOLERANCE``; pairs above are safer still.

Words are lower-case runs of anything but ASCII white space; a text of fewer
than five words is one shingle.  Defined results: null or wordless texts are
linked to nothing and are classes of their own; repeated rows are copies of one
representative; a class is named by its least id, ignoring null ids; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from .common import bounded_batches, cut, give_back

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 3
STEP = 12
TOLERANCE = 1e-7
#: Representatives of one bucket that meet in one task: twice so many at most.
CHUNK = 512
PAIRS_AT_ONCE = 100_000
SALTS = 64


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_words = WordHashes()
_rng = np.random.default_rng(20_240_501)
_MULTIPLY = (_rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, len(words) if len(words) < n else n, np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(of: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(of), 4096):
        np.minimum(out, (of[None, at : at + 4096] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


@lru_cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n values compared, the fewest matches that leave a pair a chance.

    Under a uniform prior, P(similarity >= t | m of n match) is the
    probability that a binomial of n + 1 trials at t gives at most m.
    """
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def promising(sig: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) meet first in their ``band`` and survive the Bayesian pruning."""
    alive = np.arange(len(i))
    matches = np.zeros(len(i), np.int32)
    first = np.full(len(i), BANDS, np.int32)
    for at in range(0, BANDS * ROWS, STEP):
        equal = sig[i[alive], at : at + STEP] == sig[j[alive], at : at + STEP]
        matches[alive] += equal.sum(axis=1, dtype=np.int32)
        whole = equal.reshape(len(alive), STEP // ROWS, ROWS).all(axis=2)
        own = np.where(whole.any(axis=1), at // ROWS + whole.argmax(axis=1), BANDS)
        first[alive] = np.minimum(first[alive], own)
        ok = (matches[alive] >= least_matches()[at + STEP]) & (first[alive] >= band[i[alive]])
        alive = alive[ok]
    return alive[first[alive] == band[i[alive]]]


@lru_cache(maxsize=256)
def _triangle(k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(k, 1)


def _group_pairs(start: int, left: np.ndarray, whole: bool, k: int):
    """Pairs of one group's rows, as slices; left: which rows are of the lower chunk."""
    if whole and k <= 64:
        i, j = _triangle(k)
        yield i + start, j + start
    elif whole:
        for i in range(k - 1):
            yield np.full(k - 1 - i, start + i), np.arange(start + i + 1, start + k)
    else:
        a, b = start + np.flatnonzero(left), start + np.flatnonzero(~left)
        for i in a.tolist():
            yield np.full(len(b), i), b


def _groups(frames, columns: list[str]):
    """Whole groups (runs of equal ``columns``) of sorted frames, some thousand rows at a time."""
    rest: list[pd.DataFrame] = []
    size = 0
    for pdf in frames:
        rest.append(pdf)
        size += len(pdf)
        if size < 2 * CHUNK:
            continue
        pdf = pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0]
        keys = pdf[columns].to_numpy()
        change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
        if len(change):
            at = int(change[-1]) + 1
            yield pdf.iloc[:at].reset_index(drop=True)
            pdf = pdf.iloc[at:].reset_index(drop=True)
        rest, size = [pdf], len(pdf)
    if size:
        yield pd.concat(rest, ignore_index=True)


def _bounds(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    keys = pdf[columns].to_numpy()
    return np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(pdf)]


GROUP = ["bucket", "lo", "hi"]


def prune(frames):
    """Groups of candidates -> rows with their surviving peers (places in the group's result)."""
    for pdf in _groups(frames, GROUP):
        sig = np.stack(pdf["sig"].to_numpy())
        band, lo, hi, chunk = (pdf[c].to_numpy() for c in ("band", "lo", "hi", "chunk"))
        bounds = _bounds(pdf, GROUP)
        kept_i, kept_j, ii, jj, waiting = [], [], [], [], 0

        def flush():
            nonlocal ii, jj, waiting
            if ii:
                i, j = np.concatenate(ii), np.concatenate(jj)
                ok = promising(sig, band, i, j)
                kept_i.append(i[ok].astype(np.int32))
                kept_j.append(j[ok].astype(np.int32))
            ii, jj, waiting = [], [], 0

        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            for i, j in _group_pairs(s, chunk[s:e] == lo[s], lo[s] == hi[s], e - s):
                ii.append(i)
                jj.append(j)
                waiting += len(i)
                if waiting > PAIRS_AT_ONCE:
                    flush()
        flush()
        if not kept_i or not sum(map(len, kept_i)):
            continue
        i, j = np.concatenate(kept_i), np.concatenate(kept_j)
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        used = np.zeros(len(pdf), bool)
        used[i] = used[j] = True
        rows = np.flatnonzero(used)
        group = np.searchsorted(bounds, rows, "right") - 1
        place = np.full(len(pdf), -1)
        place[rows] = np.arange(len(rows)) - np.searchsorted(group, group)
        peers: list = [np.empty(0, np.int32)] * len(rows)
        cuts = np.flatnonzero(np.r_[True, np.diff(i) > 0])
        back = np.searchsorted(rows, i[cuts])
        for at, part in zip(back.tolist(), np.split(place[j].astype(np.int32), cuts[1:])):
            peers[at] = part
        out = pdf.loc[rows, [*GROUP, "key"]].reset_index(drop=True)
        out["peers"] = pd.Series(peers, dtype=object)
        yield out
        del out, peers, i, j, kept_i, kept_j, order, sig
        give_back()


def verify(frames, threshold: float = THRESHOLD):
    """Groups of survivors with their shingles -> link counts and a spanning forest."""
    for pdf in _groups(frames, GROUP):
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        keys, peers = pdf["key"].tolist(), pdf["peers"].tolist()
        links = np.zeros(len(pdf), np.int64)
        root = list(range(len(pdf)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b = [], []
        bounds = _bounds(pdf, GROUP)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            for i in range(s, e):
                if not len(peers[i]):
                    continue
                js = s + np.asarray(peers[i], np.int64)
                own, others = sets[i], [sets[j] for j in js]
                sizes = np.array([len(o) for o in others])
                flat = np.concatenate(others)
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                common = np.add.reduceat(own[at] == flat, np.r_[0, np.cumsum(sizes)[:-1]], dtype=np.int64)
                for j in js[common >= threshold * (len(own) + sizes - common) - 1e-9].tolist():
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        a.append(keys[i])
                        b.append(keys[j])
        linked = np.flatnonzero(links)
        yield pd.DataFrame({"a": a + [keys[k] for k in linked], "b": b + [None] * len(linked), "links": [0] * len(a) + links[linked].tolist()})
        del sets, keys, peers, pdf
        give_back()


@F.pandas_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("sig", T.ArrayType(T.IntegerType()))]))
def _signed(texts: pd.Series) -> pd.DataFrame:
    sets = [shingles(t) for t in texts]
    give_back()
    return pd.DataFrame({"n": np.array([len(s) for s in sets], np.int32), "sig": pd.Series([signature(s) if len(s) else None for s in sets], dtype=object)})


@F.pandas_udf(T.BinaryType())
def _shingled(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)


def text_key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def by_texts(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, salt, n, sig), and distinct texts with words: key, rep, copies, n_links, class_id, root."""
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col(id_column).alias("id"), text_key(text).alias("key"), F.col(text).alias("text"))
    # rows are numbered for their salts; the checkpoint fixes them
    signed = cut(rows.select("id", "key", _signed("text").alias("s"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")).select("id", "key", "salt", "s.n", "s.sig"))
    reps = cut(signed.where("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")))

    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * ROWS + 1, F.lit(ROWS))))).alias("band", "bucket")
    banded = reps.select("key", band)
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = banded.join(shared, "bucket").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    met = met.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    dealt = met.select("key", "band", "bucket", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("key", "band", "bucket", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    together = dealt.join(reps.select("key", "sig"), "key").repartition(*GROUP).sortWithinPartitions(*GROUP, "key")
    left = cut(together.select("key", "band", *GROUP, "chunk", "sig").mapInPandas(prune, "bucket long, lo int, hi int, key binary, peers array<int>"))

    wanted = left.select("key").distinct().join(reps.select("key", F.col("rep").alias("id")), "key")
    # one row for each wanted text: by id and text, so that copies do not meet
    texts = rows.join(wanted, (rows["key"] == wanted["key"]) & rows["id"].eqNullSafe(wanted["id"]), "left_semi")
    sets = texts.select("key", _shingled("text").alias("shingles")).dropDuplicates(["key"])
    checked = left.join(sets, "key").repartition(*GROUP).sortWithinPartitions(*GROUP, "key")
    found = cut(checked.select(*GROUP, "key", "peers", "shingles").mapInPandas(verify, "a binary, b binary, links long"))

    links = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("n_links"))
    forest = found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(forest).withColumnsRenamed({"node": "key", "component": "root"})
    linked = links.join(roots, "key").join(reps.select("key", "rep"), "key")
    names = linked.groupBy("root").agg(F.min("rep").alias("class_id"))
    linked = linked.join(names, "root").select("key", "n_links", "class_id", "root")
    return signed, reps.select("key", "rep", "copies").join(linked, "key", "left")


def firsts(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, id): the text that stands for each class, and its least id; null ids come last."""
    _, by_text = by_texts(documents, id_column, text)
    order = F.struct(F.col("rep").isNull().alias("unnamed"), F.col("rep").alias("id"), "key")
    return by_text.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(order).alias("f")).select("f.key", "f.id")


def join(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``documents``: doc_id, class_id, n_links, rep_id, n_copies.

    ``n_links`` counts the other distinct texts at the threshold or above;
    ``rep_id`` is the least id with the same text, ``n_copies`` their number.
    """
    signed, by_text = by_texts(documents, id_column, text)
    rows = signed.select("id", "key", "salt", "n")
    there = rows.where("n > 0").select("key", "salt").distinct().join(by_text, "key")
    return rows.join(there, ["key", "salt"], "left").select(
        F.col("id").alias(id_column),
        F.coalesce("class_id", "rep", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("rep", "id").alias("rep_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )

"""Exact top-k search by inner product, with norm buckets.

Vectors are sorted by length (Euclidean norm) and packed into buckets of at most
``BUCKET`` vectors.  The longest vectors, a bounded number, give each query a
first k-th best score.  A query then meets only buckets whose longest vector can
still reach that score.  Inside a bucket the score becomes a cosine threshold
for the bucket's longest vector, and sets how candidates are thinned out:

* a low threshold: by length, the bucket's vectors are cut off where even a
  parallel vector would be too short;
* a high threshold: by coordinates, the query's largest coordinates give ranges
  that a unit vector at that angle must fall into.

What is left is verified with exact integer products.  Both cuts allow for
rounding and never drop a vector that ties with the k-th best.

Queries travel in blocks, ordered by how long a vector must be to serve them, and
blocks and buckets in groups of ``GROUP``.  Group headers (no vectors) are joined
and pruned first; only for pairs of groups that are left are vectors fetched, by
joins on group and salt, and a pair of groups is one task's tile: it holds the
tile's queries and reads its buckets one by one.  Neither all queries nor all
vectors are ever in one place, and a pack never holds more than ``PACK_BYTES``.

Components become floor(256 * x).  Defined results: rows without an id, and vectors that are null or
hold a null or a number that is not finite take no part (an empty table gives an
empty result); vectors are compared
only to those of their own dimension; a row never meets itself, though it does
meet other rows with its id; scores outside 64 bits are clipped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, cut

SCALE = 256
BUCKET, BLOCK, TOP, GROUP = 4096, 4096, 2048, 16
PACK_BYTES = 4 << 20
#: Queries whose whole products with a bucket are formed at once.
AT_ONCE = 512
FOCUS = 4
#: Tiles that one task may fetch the vectors of a group for.
TILES_A_TASK = 64
PACKED = "dim int, grp long, ids binary, marks binary, vectors binary, lows binary, bound double"
NONE = -(2**63)

def quantised(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    usable = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))) & F.col(id_column).isNotNull()
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    return (
        df.where(usable)
        .select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
        .withColumn("dim", F.size("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    )


def pack(size: int, by: str):
    """Runs of equal dimension of a sorted partition -> packed rows of ``size`` vectors at most, in groups.

    ``bound`` is the greatest norm of a pack of vectors, or the least need of a pack of queries.
    """

    def run(frames):
        base, group, held, last = TaskContext.get().partitionId() << 32, 0, 0, None
        for pdf in frames:
            dims = pdf["dim"].to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(dims)) + 1, len(pdf)]
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                dim = int(dims[s]) if e > s else 0
                width = max(1, min(size, PACK_BYTES // max(8 * dim, 1)))
                for at in range(s, e, width):
                    if held == GROUP or dim != last:
                        group, held, last = group + 1, 0, dim
                    held += 1
                    part = pdf.iloc[at : min(at + width, e)]
                    vectors = np.stack(part["v"].to_numpy()).astype("<f8") if dim else np.zeros((len(part), 0))
                    lows = part["low"].to_numpy(np.int64) if "low" in part else np.zeros(0, np.int64)
                    bound = float(part[by].max() if by == "norm" else part[by].min())
                    packed = [part["id"].to_numpy(np.int64), part["mark"].to_numpy(np.int64), vectors, lows]
                    yield pd.DataFrame([[dim, base + group, *[x.tobytes() for x in packed], bound]], columns=["dim", "grp", "ids", "marks", "vectors", "lows", "bound"])

    return run


def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    return ids, np.frombuffer(row.marks, np.int64), np.frombuffer(row.vectors, "<f8").reshape(len(ids), row.dim)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products of whole-number vectors, (queries, vectors)."""
    if not len(q) or not len(v) or not v.shape[1]:
        return np.zeros((len(q), len(v)), np.int64)
    bound = np.abs(q).max() * np.abs(v).max() * v.shape[1]
    if bound < 2.0**53:
        return np.rint(q @ v.T).astype(np.int64)  # every sum on the way is a whole number below 2**53
    total = np.zeros((len(q), len(v)), object)
    for i, a in enumerate(limbs(q)):
        for j, b in enumerate(limbs(v)):
            for at in range(0, v.shape[1], 1 << 16):  # 2**16 products of two limbs stay below 2**53
                total += np.rint(a[:, at : at + (1 << 16)] @ b[:, at : at + (1 << 16)].T).astype(np.int64).astype(object) << LIMB * (i + j)
    return np.clip(total, -(2**63), 2**63 - 1).astype(np.int64)


LIMB = 18


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as signed digits of ``LIMB`` bits, the lowest first."""
    out, left, sign = [], np.abs(x), np.sign(x)
    while left.any():
        high = np.floor(left / 2.0**LIMB)
        out.append(sign * (left - high * 2.0**LIMB))
        left = high
    return out


def candidates(q: np.ndarray, q_norm: float, v: np.ndarray, norms: np.ndarray, floor: float) -> np.ndarray | None:
    """Places in the bucket (longest first) that can reach ``floor``; None: all of them."""
    if floor <= 0 or q_norm <= 0:
        return None
    slack = 1 + 1e-9
    local = floor / (q_norm * max(norms[0], 1e-300) * slack)
    if local > 1:
        return np.empty(0, np.int64)
    if local < 0.6:  # length
        n = int(np.searchsorted(-norms, -floor / (q_norm * slack), "right"))
        return None if n == len(v) else np.arange(n)
    unit = q / q_norm  # coordinates
    alive = np.arange(len(v))
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        at = v[alive, f] / np.maximum(norms[alive], 1e-300)
        middle, reach = unit[f] * local, np.sqrt(max(0.0, 1 - unit[f] ** 2) * max(0.0, 1 - local**2)) + 1e-9
        high = 1.0 if unit[f] >= local else middle + reach
        low = -1.0 if unit[f] <= -local else middle - reach
        alive = alive[(at >= low - 1e-9) & (at <= high + 1e-9)]
    return alive


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 8 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= edge)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def floors(k: int):
    """Blocks with the longest vectors of their dimension -> queries with their first floors."""

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                ids, marks, q = unpack(r)
                f_ids, f_marks = np.frombuffer(r.f_ids, np.int64)[:TOP], np.frombuffer(r.f_marks, np.int64)[:TOP]
                v = np.frombuffer(r.f_vectors, "<f8").reshape(-1, r.dim)[:TOP] if r.dim else np.zeros((len(f_ids), 0))
                low = np.full(len(q), NONE)
                for at in range(0, len(q) if len(v) > k else 0, AT_ONCE):
                    some = slice(at, at + AT_ONCE)
                    s = products(q[some], v)
                    s[(ids[some, None] == f_ids) & (marks[some, None] == f_marks)] = NONE
                    low[some] = np.partition(s, len(v) - k, axis=1)[:, len(v) - k]
                norms = np.sqrt((q * q).sum(axis=1))
                # how long a vector must be to reach the floor
                need = np.where(low > 0, low / np.maximum(norms, 1e-300), -1.0)
                yield pd.DataFrame({"dim": r.dim, "id": ids, "mark": marks, "v": list(q), "low": low, "need": need})

    return run


class Tile:
    """The queries of a pair of groups, and the best of the buckets read so far."""

    def __init__(self, k: int):
        self.k, self.blocks = k, []

    def add(self, r) -> None:
        ids, marks, q = unpack(r)
        shape = (len(ids), self.k)
        self.blocks.append([ids, marks, q, np.sqrt((q * q).sum(axis=1)), np.frombuffer(r.lows, np.int64).copy(), np.full(shape, NONE), np.zeros(shape, np.int64), np.zeros(shape, bool)])

    def meet(self, r) -> None:
        b_ids, b_marks, v = unpack(r)
        norms = np.sqrt((v * v).sum(axis=1))
        for ids, marks, q, q_norms, lows, scores, found, filled in self.blocks:
            chosen = [candidates(q[i], q_norms[i], v, norms, float(lows[i])) for i in range(len(q))]
            whole = [i for i, c in enumerate(chosen) if c is None or len(c) > len(v) // 4]
            for at in range(0, len(whole), AT_ONCE):
                rows = whole[at : at + AT_ONCE]
                for i, s in zip(rows, products(q[rows], v)):
                    chosen[i] = None
                    self.keep(i, np.arange(len(v)), s, b_ids, b_marks, ids, marks, lows, scores, found, filled)
            for i, c in enumerate(chosen):
                if c is not None and len(c):
                    self.keep(i, c, products(q[i : i + 1], v[c])[0], b_ids, b_marks, ids, marks, lows, scores, found, filled)

    def keep(self, i, at, s, b_ids, b_marks, ids, marks, lows, scores, found, filled) -> None:
        ok = (s >= lows[i]) & ~((b_ids[at] == ids[i]) & (b_marks[at] == marks[i]))
        at, s = at[ok], s[ok]
        if not len(at):
            return
        b = best(b_ids[at], s, self.k)
        s, at = np.r_[scores[i][filled[i]], s[b]], np.r_[found[i][filled[i]], b_ids[at][b]]
        b = best(at, s, self.k)
        scores[i, : len(b)], found[i, : len(b)], filled[i, : len(b)] = s[b], at[b], True
        if len(b) == self.k:
            lows[i] = max(lows[i], s[b[-1]])

    def result(self) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": [], "query_mark": [], "vec_id": [], "score": []}, dtype=np.int64)]
        for ids, marks, _, _, _, scores, found, filled in self.blocks:
            i, j = np.nonzero(filled)
            parts.append(pd.DataFrame({"query_id": ids[i], "query_mark": marks[i], "vec_id": found[i, j], "score": scores[i, j]}))
        return pd.concat(parts, ignore_index=True)


def tiles(k: int):
    """Sorted rows of tiles, queries before buckets -> each tile's best."""

    def run(frames):
        now, tile = None, None
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if (r.q_grp, r.b_grp) != now:
                    if tile:
                        yield tile.result()
                    now, tile = (r.q_grp, r.b_grp), Tile(k)
                tile.meet(r) if r.kind else tile.add(r)
        if tile:
            yield tile.result()

    return run


def search(df: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every row, for every row where ``is_query``, a condition on ``id``."""
    bounded_batches(df.sparkSession)
    # a row's own mark tells it apart from other rows with its id; fixed by the checkpoint
    rows = cut(quantised(df, id_column, vector).withColumn("mark", F.monotonically_increasing_id()))
    order = [F.col("dim"), F.col("norm").desc(), F.col("id"), F.col("mark")]
    packed = lambda x, size: x.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pack(size, "norm"), PACKED)
    buckets, blocks = cut(packed(rows, BUCKET)), cut(packed(rows.where(is_query), BLOCK))

    # the longest vectors of each dimension, TOP at most, give every query a first floor
    bytes_ = lambda c, n: F.substring(c, 1, n)
    first = F.struct(bytes_(F.col("ids"), 8 * TOP).alias("f_ids"), bytes_(F.col("marks"), 8 * TOP).alias("f_marks"), F.expr(f"substring(vectors, 1, {8 * TOP} * dim)").alias("f_vectors"))
    front = buckets.groupBy(F.col("dim").alias("f_dim")).agg(F.max_by(first, F.struct("bound", F.xxhash64("ids", "marks"))).alias("f"))
    salts = max(1, min(1024, blocks.count() // GROUP))
    front = front.select("f_dim", "f.*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("f_salt"))
    salt = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    met = blocks.withColumn("salt", salt(salts, "ids", "marks")).join(front, (F.col("dim") == F.col("f_dim")) & (F.col("salt") == F.col("f_salt")))
    asked = met.select("dim", "ids", "marks", "vectors", "f_ids", "f_marks", "f_vectors").mapInPandas(floors(k), "dim int, id long, mark long, v array<double>, low long, need double")
    by_need = [F.col("dim"), F.col("need").desc(), F.col("id"), F.col("mark")]
    asked = cut(asked.repartitionByRange(*by_need).sortWithinPartitions(*by_need).mapInPandas(pack(BLOCK, "need"), PACKED))

    # headers first: which groups can serve which
    q_heads = cut(asked.groupBy("dim", F.col("grp").alias("q_grp")).agg(F.min("bound").alias("need")))
    b_heads = cut(buckets.groupBy("dim", F.col("grp").alias("b_grp")).agg(F.max("bound").alias("longest")))
    n_q, n_b = q_heads.count(), b_heads.count()
    salts = max(1, min(4096, n_q * n_b // 1_000_000))
    dealt = q_heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = b_heads.withColumn("salt", salt(salts, "b_grp")).join(dealt, ["dim", "salt"]).where(F.col("longest") * (1 + 1e-9) >= F.col("need"))
    pairs = cut(pairs.select("q_grp", "b_grp"))

    def fetched(packs: DataFrame, own: str, other: str, n: int, kind: int) -> DataFrame:
        spread = -(-n // TILES_A_TASK) or 1
        copies = packs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).withColumnRenamed("grp", own)
        return copies.join(pairs.withColumn("salt", salt(spread, other)), [own, "salt"]).select("q_grp", "b_grp", F.lit(kind).alias("kind"), "dim", "ids", "marks", "vectors", "lows")

    together = fetched(asked, "q_grp", "b_grp", n_b, 0).unionByName(fetched(buckets, "b_grp", "q_grp", n_q, 1))
    found = together.repartition("q_grp", "b_grp").sortWithinPartitions("q_grp", "b_grp", "kind").mapInPandas(tiles(k), "query_id long, query_mark long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "query_mark").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

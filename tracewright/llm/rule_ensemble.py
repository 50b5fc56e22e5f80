"""Quality classifier: a sparse ensemble of rules, compiled to Spark columns.

Statistics of a text are column expressions.  On a bounded labelled sample,
shallow regression trees are boosted in numpy (Newton steps on the logistic loss);
every path from a root to a node is a rule, a conjunction of comparisons of
statistics.  An L1-penalised logistic regression over the rules' outcomes keeps a
few of them with weights.  These become one column expression, so scoring needs no
Python.  Each class weighs what it weighs among all learnable labels, however many
rows of it were sampled, so a score means the same at every size.

Defined results: null texts count as empty; an empty text has all statistics 0
and gets a score like any other.  A training set without both classes gives the
share of label 1, or 0.5 without rows, for every text.  Repeated rows repeat their
result; an empty table gives an empty result; other columns are left as they are,
but for one named like the result, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bounded_ids, learnable
from .mixing import size_of

#: Labelled documents of each class that the model may learn from.
ROWS_PER_CLASS = 10_000
#: Of boosting: how far a tree moves the scores, and what is added to a leaf's curvature.
RATE, SHRINK = 0.3, 1.0
STATISTICS = ("chars", "words", "mean_word", "symbols", "marks", "digits", "letters", "capitals", "distinct_words", "distinct_lines", "words_a_line")


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a struct ``__stats`` of the statistics of ``text``."""
    t = F.coalesce(F.col("__text"), F.lit(""))
    share = lambda n: n / F.greatest(F.col("__chars"), F.lit(1))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    distinct = lambda a: F.size(F.array_distinct(a)) / F.greatest(F.size(a), F.lit(1))
    df = df.withColumn("__text", F.col(text)).withColumn("__chars", F.length(t)).withColumn("__words", size_of(t))
    df = df.withColumn("__split", F.split(t, f"{SPACE}+")).withColumn("__lines", F.split(t, "\n"))
    stats = {
        "chars": F.col("__chars"),
        "words": F.col("__words"),
        "mean_word": (F.col("__chars") - count(SPACE)) / F.greatest(F.col("__words"), F.lit(1)),
        "symbols": share(count(r"[#*$%&|<>]")),
        "marks": share(count(r"[!?]")),
        "digits": share(count(r"[0-9]")),
        "letters": share(count(r"\p{L}")),
        "capitals": share(count(r"\p{Lu}")),
        "distinct_words": distinct(F.col("__split")),
        "distinct_lines": distinct(F.col("__lines")),
        "words_a_line": F.col("__words") / F.size("__lines"),
    }
    return df.withColumn("__stats", F.struct(*[c.cast("double").alias(n) for n, c in stats.items()])).drop("__text", "__chars", "__words", "__split", "__lines")


@dataclass
class Rules:
    """Rules are tuples of (statistic, is greater, bound); a score is the logistic of their weighted sum."""

    rules: list[tuple] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def column(self, stats: str = "__stats") -> Column:
        value = lambda s: F.col(f"{stats}.{STATISTICS[s]}")
        test = lambda s, above, bound: value(s) > bound if above else value(s) <= bound
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(reduce(lambda a, b: a & b, [test(*x) for x in rule]), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def outcomes(self, x: np.ndarray) -> np.ndarray:
        return outcomes(self.rules, x)


def outcomes(rules: list[tuple], x: np.ndarray) -> np.ndarray:
    test = lambda s, above, bound: x[:, s] > bound if above else x[:, s] <= bound
    return np.stack([reduce(np.logical_and, [test(*c) for c in r], np.ones(len(x), bool)) for r in rules], axis=1).astype(float) if rules else np.zeros((len(x), 0))


def grow(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int, path: tuple = ()) -> tuple[list[tuple], list[tuple]]:
    """A regression tree by gradients and curvatures: (path, value) of its leaves, and the paths to all its nodes.

    Of equal gains the first statistic and the lowest bound win.
    """
    value, rules = float(g.sum() / (h.sum() + SHRINK)), [path] if path else []
    if depth == 0 or len(g) < 2 * least:
        return [(path, value)], rules
    best, at = 1e-9, None
    gain_of = lambda a, b: a**2 / (b + SHRINK)
    for s in range(bins.shape[1]):
        below = lambda w=None: np.bincount(bins[:, s], w, len(cuts[s]) + 1)[:-1].cumsum()  # noqa: B023, E731
        n, gl, hl = below(), below(g), below(h)
        ok = (n >= least) & (len(g) - n >= least)
        if ok.any():
            gain = np.where(ok, gain_of(gl, hl) + gain_of(g.sum() - gl, h.sum() - hl) - gain_of(g.sum(), h.sum()), -1)
            k = int(gain.argmax())
            if gain[k] > best:
                best, at = gain[k], (s, k)
    if at is None:
        return [(path, value)], rules
    s, k = at
    low, leaves = bins[:, s] <= k, []
    for side, above in ((low, False), (~low, True)):
        own, more = grow(bins[side], cuts, g[side], h[side], depth - 1, least, (*path, (s, above, float(cuts[s][k]))))
        leaves += own
        rules += more
    return leaves, rules


def simplified(path: tuple) -> tuple:
    """One bound for each statistic and side."""
    bounds: dict = {}
    for s, above, bound in path:
        old = bounds.get((s, above))
        bounds[s, above] = bound if old is None else (max if above else min)(old, bound)
    return tuple(sorted((s, above, b) for (s, above), b in bounds.items()))


def train(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 1e-3, steps: int = 600, seed: int = 5, counts: dict[int, int] | None = None) -> Rules:
    """``counts``: rows of each class that could have been sampled; a class's rows weigh as much as these together."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Rules(bias=float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    rng = np.random.default_rng(seed)
    cuts = []
    for s in range(x.shape[1]):
        # halfway between values, so a bound never depends on the last bit of a value
        q = np.unique(np.quantile(x[:, s], np.linspace(0, 1, 34)))
        cuts.append((q[:-1] + q[1:]) / 2)
    bins = np.stack([np.searchsorted(cuts[s], x[:, s]) for s in range(x.shape[1])], axis=1)
    weigh = np.ones(len(y))
    for k in (0, 1):
        weigh[y == k] = (counts or {}).get(k) or np.sum(y == k)
        weigh[y == k] /= np.sum(y == k)
    weigh /= weigh.mean()
    share = np.clip(np.average(y, weights=weigh), 1e-6, 1 - 1e-6)
    f, rules = np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(trees):
        take = rng.random(len(y)) < 0.6
        if take.sum() < 4:
            take[:] = True
        p = 1 / (1 + np.exp(-f))
        leaves, found = grow(bins[take], cuts, ((y - p) * weigh)[take], (p * (1 - p) * weigh)[take], depth, max(2, len(y) // 200))
        rules += found
        for path, value in leaves:  # each row lies in one of them
            f[outcomes([path], x)[:, 0] > 0] += RATE * np.clip(value, -4, 4)
    rules = sorted({simplified(r) for r in rules})
    m = outcomes(rules, x)
    _, first = np.unique(m, axis=1, return_index=True)  # rules that hold for the same rows count once
    rules = [rules[i] for i in sorted(first)]
    m = m[:, sorted(first)]
    center = np.average(m, axis=0, weights=weigh)
    a = m - center
    w, b = np.zeros(a.shape[1]), 0.0
    v, vb, t = w.copy(), b, 1.0
    step = 4 / (np.linalg.norm(a * np.sqrt(weigh)[:, None], 2) ** 2 / len(y) + 1)
    for _ in range(steps):  # accelerated proximal gradient
        e = (1 / (1 + np.exp(-np.clip(a @ v + vb, -35, 35))) - y) * weigh
        new = v - step * (a.T @ e) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = vb - step * e.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    live = np.flatnonzero(np.abs(w) > 1e-6)
    return Rules([rules[i] for i in live], w[live].tolist(), float(b - w @ center))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = ROWS_PER_CLASS) -> Rules:
    """Learn from at most ``per_class`` labelled documents of each class outside the held-out fold."""
    ids = bounded_ids(labels, label, per_class, 5, 0).withColumnRenamed("doc_id", "__id")
    sample = documents.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))  # at most 2 * per_class rows
    rows = with_statistics(sample.select("y", "text")).select("y", "__stats.*").limit(4 * per_class).collect()
    data = np.array(sorted([list(r) for r in rows]), float).reshape(-1, 1 + len(STATISTICS))
    counts = {r["y"]: r["n"] for r in learnable(labels, label, 5, 0).groupBy("y").agg(F.count("*").alias("n")).collect()}
    return train(data[:, 1:], data[:, 0], counts=counts)


def score(documents: DataFrame, rules: Rules, text: str = "text", into: str = "score") -> DataFrame:
    return with_statistics(documents, text).withColumn(into, rules.column()).drop("__stats")

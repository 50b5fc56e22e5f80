"""Toxicity scores from subword bags.

A word (a run of letters and digits) is the bag of itself and its character
n-grams (3 to 5, with marks at its ends), hashed into ``BUCKETS`` rows of an
embedding table; a segment of ``SEGMENT`` words is the mean of its words'
vectors, and a linear softmax over it gives two classes.  Table and softmax are
trained together, in numpy.  A misspelling that was never seen still shares
most n-grams with the known word; digits count as letters, so ``st0pid`` does.

Labels belong to documents, not to segments: training first gives every
segment its document's label, then, of a toxic document, only the most
suspicious segments.  A document is judged by its most suspicious segments: the
means of its 1, 2, 4 and 8 highest, and its length, are put on the scale of
probabilities by a logistic fit over a quarter of the sampled documents, which
the embeddings were not fitted to.  There both classes weigh the same, so a
score does not depend on how many of each were sampled.  As mean and softmax are
linear up to the last step, a word is one number: prediction looks up the
distinct words of a batch once and sums by segment over whole texts.

Defined results: null and empty texts, and texts without words, get the score
of an empty segment; whole texts and whole words are read, however long.
Repeated rows repeat their result; an empty table gives an empty result.  A
training set without both classes gives 0 for all.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_ids, give_back

BUCKETS, DIMENSIONS, SEGMENT, SHARED = 1 << 17, 2, 2, 8
GRAMS = (3, 4, 5)
#: A document is judged by its most suspicious segments: the means of so many of them.
TOPS = (1, 2, 4, 8)
#: Segments of a toxic document that training takes for toxic.
LEARNT = 4
#: Labelled documents of each class that the model may learn from, and the
#: characters of the longest one.
ROWS_PER_CLASS, LONGEST = 1000, 30_000
#: Characters hashed at once.
AT_ONCE = 1 << 20
words_of = re.compile(r"[^\W_]+").findall
_MULTIPLY, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.arange(max(GRAMS) + 1, dtype=np.uint64) * _SPREAD


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _SPREAD
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of all words, and the word that each belongs to."""
    marked = [f"<{w}>" for w in words]
    lengths = np.array([len(w) for w in marked], np.int64)
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    left = (starts + lengths)[owner] - np.arange(len(c))  # characters of the word from here on
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(lengths.max(initial=1)) - 1, _MULTIPLY))])
    found, owners = [_bucket(np.add.reduceat(c * powers[lengths[owner] - left], starts) ^ _SPREAD)], [np.arange(len(words))]
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * _MULTIPLY + c[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(left[: len(h)] >= n)
            found.append(_bucket(h[at] + _SALTS[n]))
            owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners)


@dataclass
class SubwordModel:
    weight: np.ndarray | None = None  # of each bucket: embedding times softmax difference
    bias: float = 0.0
    scale: np.ndarray | None = None  # of each sign
    shift: float = 0.0

    def word_values(self, words: list[str]) -> np.ndarray:
        """One number for each word."""
        out, ends = np.zeros(len(words)), np.cumsum([len(w) + 2 for w in words])
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            found, owner = bags(words[at:to])
            out[at:to] = np.bincount(owner, self.weight[found], to - at) / np.bincount(owner, minlength=to - at)
            at = to
        return out

    def signs(self, texts: list[str | None]) -> np.ndarray:
        """For each text: its most suspicious segment, the means of its ``TOPS`` most suspicious ones, and its length."""
        split = [words_of((t or "").lower()) for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        out = np.zeros((len(texts), len(TOPS) + 1))
        out[:, :-1] = self.bias
        if not counts.sum():
            return out
        codes, distinct = pd.factorize(np.array([w for x in split for w in x], object))
        del split
        total = np.concatenate([[0.0], np.cumsum(self.word_values(distinct.tolist())[codes])])
        some = np.flatnonzero(counts)
        counts, first = counts[some], (np.cumsum(counts) - counts)[some]
        segments = -(-counts // (SEGMENT // 2))  # they overlap by half
        owner = np.repeat(np.arange(len(some)), segments)
        begin = np.cumsum(segments) - segments
        at = first[owner] + (np.arange(len(owner)) - begin[owner]) * (SEGMENT // 2)
        ends = np.minimum(at + SEGMENT, (first + counts)[owner])
        values = (total[ends] - total[at]) / np.maximum(ends - at, SEGMENT // 2)
        values = np.concatenate([[0.0], np.cumsum(values[np.lexsort((-values, owner))])])
        for k, n in enumerate(TOPS):
            n = np.minimum(segments, n)
            out[some, k] += (values[begin + n] - values[begin]) / n
        out[some, -1] = np.log(segments)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weight is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.signs(texts) @ self.scale + self.shift, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def train(rows: list[tuple[str, int]], seed: int = 11, rate: float = 0.13, steps: int = 60, warm: int = 10, decay: float = 0.02) -> SubwordModel:
    """Full-batch Adam over embeddings and softmax together.

    Buckets that fewer than ``SHARED`` training documents use are left at
    zero: what they would learn is one document's own words.
    """
    model = SubwordModel()
    if len({y for _, y in rows}) < 2:
        return model
    rng = np.random.default_rng(seed)
    kept = [r for r in rows if zlib.crc32((r[0] or "").encode("utf-8", "replace")) % 4 == 0]
    if len({y for _, y in kept}) == 2 and len(kept) >= 40:
        rows = [r for r in rows if zlib.crc32((r[0] or "").encode("utf-8", "replace")) % 4]
    else:
        kept = []
    ids: dict[str, int] = {}
    segments, owner, uses = [], [], []
    for d, (text, _) in enumerate(rows):
        w = [ids.setdefault(x, len(ids)) for x in words_of((text or "").lower())]
        uses.append(np.unique(np.array(w, np.int64)))
        for at in range(0, len(w), SEGMENT):
            segments.append(w[at : at + SEGMENT])
            owner.append(d)
    if not segments:
        return model
    owner = np.array(owner)
    label = np.array([y for _, y in rows])[owner]
    flat, word_of_sub = bags(list(ids))
    order = np.argsort(word_of_sub, kind="stable")
    flat, word_of_sub = flat[order], word_of_sub[order]
    sizes = np.bincount(word_of_sub, minlength=len(ids))
    begin = np.cumsum(sizes) - sizes
    seen = np.zeros(BUCKETS, np.int64)
    for u in uses:
        if len(u):
            n = sizes[u]
            seen[np.unique(flat[np.repeat(begin[u] - (np.cumsum(n) - n), n) + np.arange(n.sum())])] += 1
    live = seen >= min(SHARED, len(rows))
    keep = live[flat]
    flat, word_of_sub = flat[keep], word_of_sub[keep]
    lengths = np.array([len(s) for s in segments])
    parts = np.maximum(lengths, SEGMENT // 2).astype(float)  # as in prediction
    local, segment_of = np.concatenate(segments), np.repeat(np.arange(len(segments)), lengths)
    p = {
        "table": rng.normal(0, 0.05, (DIMENSIONS, BUCKETS)) * live,
        "soft": rng.normal(0, 1.0, (DIMENSIONS, 2)),
        "offset": np.zeros(2),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    positives, negatives = max(1, len(set(owner[label == 1]))), max(1, len(set(owner[label == 0])))
    n_segments = np.bincount(owner, minlength=len(rows))
    share, first = n_segments[owner], np.cumsum(n_segments) - n_segments

    def gathered(values: np.ndarray, source: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(target, weights=x[source], minlength=n) for x in values])

    for step in range(1, steps + 1):
        v = gathered(p["table"], flat, word_of_sub, len(ids)) / sizes
        mean = gathered(v, local, segment_of, len(segments)) / parts
        z = mean.T @ p["soft"] + p["offset"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        if step > warm:  # of a toxic document, only the most suspicious segments are taken for toxic
            by = np.lexsort((z[:, 0] - z[:, 1], owner))
            top = by[np.arange(len(by)) - first[owner[by]] < LEARNT]
            weight = np.where(label == 0, 1 / negatives, 0.0)
            weight[top[label[top] == 1]] = 1 / positives
        else:
            weight = np.where(label == 0, 1 / (negatives * share), 1 / (positives * share))
        q[np.arange(len(q)), label] -= 1
        q *= weight[:, None]
        dv = gathered((q @ p["soft"].T / parts[:, None]).T, segment_of, local, len(ids)) / sizes
        g = {"soft": mean @ q, "offset": q.sum(axis=0), "table": gathered(dv, word_of_sub, flat, BUCKETS)}
        for k, x in p.items():
            a, b = moments[k]
            a += 0.1 * (g[k] - a)
            b += 0.01 * (g[k] ** 2 - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
        p["table"] *= 1 - decay
    model.weight = ((p["soft"][:, 1] - p["soft"][:, 0]) @ p["table"]).astype(np.float32)
    model.bias = float(p["offset"][1] - p["offset"][0])
    check = kept or rows  # documents that the weights were not fitted to
    x = model.signs([t for t, _ in check])
    y = np.array([y for _, y in check])
    weigh = 0.5 / np.where(y == 1, max(np.mean(y), 1e-9), max(np.mean(1 - y), 1e-9))
    center, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-6] = np.inf  # what does not vary tells nothing
    x, a, b = (x - center) / spread, np.zeros(x.shape[1]), 0.0
    for _ in range(3000):
        e = (1 / (1 + np.exp(-np.clip(x @ a + b, -30, 30))) - y) * weigh
        a -= 0.3 * (x.T @ e / len(y) + 1e-3 * a)
        b -= 0.3 * np.mean(e)
    model.scale = a / spread
    model.shift = float(b - center @ model.scale)
    return model


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = ROWS_PER_CLASS, longest: int = LONGEST) -> SubwordModel:
    """Learn from at most ``per_class`` labelled documents of each class outside the held-out fold.

    Labelled documents of more than ``longest`` characters are not learned
    from, so the driver holds a bounded sample; every text is scored whole.
    """
    ids = bounded_ids(labels, label, per_class, 5, 0)
    sample = (
        documents.select("doc_id", "text")
        .where(F.col("text").isNotNull() & (F.length("text") <= longest))
        .join(F.broadcast(ids), "doc_id")  # at most 2 * per_class rows
        .select("text", "y")
        .orderBy(F.xxhash64("text"), "text", "y")  # ids may repeat
        .limit(4 * per_class)
        .collect()
    )
    return train(sorted((r["text"], r["y"]) for r in sample))


def score(documents: DataFrame, model: SubwordModel, text: str = "text", into: str = "score") -> DataFrame:
    """``documents`` with a score from 0 to 1; a column of that name is replaced."""
    bounded_batches(documents.sparkSession)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        out, at, size = np.zeros(len(texts)), 0, 0
        for k, t in enumerate(texts):  # a few million characters at a time
            size += len(t or "")
            if size > 2 * AT_ONCE or k + 1 == len(texts):
                out[at : k + 1] = model.scores(texts.iloc[at : k + 1].tolist())
                at, size = k + 1, 0
        give_back()
        return pd.Series(out)

    return documents.withColumn(into, run(F.col(text)))

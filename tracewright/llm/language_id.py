"""Language identification with a byte convolutional network.

The network reads windows of ``WINDOW`` UTF-8 bytes.  Filters of widths 2, 3
and 4 slide over one-hot bytes, each filter keeps its largest response in the
window (max pooling), a rectifier follows, and a dense softmax gives a
probability for each learnt language.  It is trained here, in numpy, with Adam.

For prediction the filters are tabulated: a filter of width 4 is the sum of a
table entry for its first byte pair and one for its second pair, so a response
costs two look-ups.  Every byte of a text falls into one window; a document's
probabilities are the mean over its windows, weighted by their bytes.

Defined results: a null text, or one without any letter, gives ``und`` with
score 0.  A training set without rows gives a model that knows no language;
it answers ``und`` for everything; an empty table gives an empty result.  Of
languages equally likely, the first by name is given.  Rows are independent:
repeated rows repeat their result, and no other column is read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold, give_back

WINDOW = 192
FILTERS = 8
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
#: The sample of labelled rows that the network may learn from, for each
#: language, and the windows taken from each sampled text.
ROWS_PER_LANGUAGE = 600
WINDOWS_PER_ROW = 4
#: The languages that the network may know: those with most rows.
MOST_LANGUAGES = 500


@dataclass
class ByteNet:
    languages: list[str]
    filters: dict[int, np.ndarray] = field(default_factory=dict)  # width -> (width, 256, FILTERS)
    bias: np.ndarray | None = None
    dense: np.ndarray | None = None
    offset: np.ndarray | None = None
    _tables: dict | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_tables": None}  # tables are rebuilt where they are used

    def tables(self) -> dict:
        if self._tables is None:
            pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
            f = self.filters
            self._tables = {
                "two": pair(f[2][0], f[2][1]),
                "three": pair(f[3][0], f[3][1]),
                "last": np.ascontiguousarray(f[3][2]),
                "front": pair(f[4][0], f[4][1]),
                "back": pair(f[4][2], f[4][3]),
            }
        return self._tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(n, WINDOW) bytes -> (n, languages)."""
        t, out = self.tables(), np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), 128):
            w = windows[at : at + 128]
            pairs = w[:, :-1].astype(np.int32) * 256 + w[:, 1:]
            two = t["two"].take(pairs, axis=0).max(axis=1)
            three = t["three"].take(pairs[:, :-1], axis=0)
            three += t["last"].take(w[:, 2:], axis=0)
            four = t["front"].take(pairs[:, :-2], axis=0)
            four += t["back"].take(pairs[:, 2:], axis=0)
            pooled = np.concatenate([two, three.max(axis=1), four.max(axis=1)], axis=1) + self.bias
            out[at : at + 128] = softmax(np.maximum(pooled, 0) @ self.dense + self.offset)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text that each belongs to, and its share of real bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // WINDOW))
    data = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts.tolist()))
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    place = np.arange(len(owner)) - first[owner]
    weight = np.clip(sizes[owner] - place * WINDOW, 1, WINDOW).astype(np.float64)
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), owner, weight


def train(rows: list[tuple[bytes, str]], steps: int = 700, batch: int = 64, rate: float = 0.02, seed: int = 7) -> ByteNet:
    """Fit the network to (bytes of a window, language) pairs."""
    languages = sorted({lang for _, lang in rows})
    net = ByteNet(languages)
    if not rows:
        return net
    rng = np.random.default_rng(seed)
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, (text, _) in enumerate(rows):
        x[i, : min(len(text), WINDOW)] = np.frombuffer(text[:WINDOW], np.uint8)
    of = {lang: k for k, lang in enumerate(languages)}
    y = np.array([of[lang] for _, lang in rows])
    by_class = [np.flatnonzero(y == k) for k in range(len(languages))]
    p = {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    p |= {"bias": np.zeros(FILTERS * 3, np.float32), "dense": rng.normal(0, 0.2, (FILTERS * 3, len(languages))).astype(np.float32), "offset": np.zeros(len(languages), np.float32)}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for step in range(1, steps + 1):
        take = np.concatenate([rng.choice(c, max(1, batch // len(languages))) for c in by_class])
        w, target = x[take].copy(), y[take]
        short = rng.random(len(w)) < 0.3  # so that short texts are known as well
        for i in np.flatnonzero(short):
            w[i, rng.integers(12, WINDOW) :] = 0
        places, pooled = {}, []
        for width in WIDTHS:
            n = WINDOW - width + 1
            r = sum(p[width][k].take(w[:, k : k + n], axis=0) for k in range(width))
            places[width] = r.argmax(axis=1)
            pooled.append(np.take_along_axis(r, places[width][:, None, :], axis=1)[:, 0])
        z = np.concatenate(pooled, axis=1) + p["bias"]
        hidden = np.maximum(z, 0)
        d = softmax(hidden @ p["dense"] + p["offset"])
        d[np.arange(len(d)), target] -= 1
        d /= len(d)
        g = {"dense": hidden.T @ d, "offset": d.sum(axis=0)}
        dz = (d @ p["dense"].T) * (z > 0)
        g["bias"] = dz.sum(axis=0)
        rows_, cols = np.arange(len(w))[:, None], np.arange(FILTERS)[None, :]
        for i, width in enumerate(WIDTHS):
            part = dz[:, i * FILTERS : (i + 1) * FILTERS]
            g[width] = np.zeros_like(p[width])
            for k in range(width):
                np.add.at(g[width][k], (w[rows_, places[width] + k], np.broadcast_to(cols, part.shape)), part)
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in p.items():
            m, s = moments[k]
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] ** 2 - s)
            v -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    net.filters = {w: p[w] for w in WIDTHS}
    net.bias, net.dense, net.offset = p["bias"], p["dense"], p["offset"]
    return net


def fit(documents: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE, languages: int = MOST_LANGUAGES) -> ByteNet:
    """Learn from a bounded sample of the rows outside the held-out fold.

    About ``rows_per_language`` rows of each language are taken by hash of id
    and text, at most twice as many; of each, ``WINDOWS_PER_ROW`` windows at
    even distances.  Rows with null text, null language or id are left out; so
    are languages beyond the ``languages`` with most rows (of equals, by name).
    """
    usable = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~fold(4, 2, id_column))
    counts = {r[0]: r[1] for r in usable.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "l").limit(languages).collect()}
    if not counts:
        return train([])
    span = 1 << 30
    least = F.lit(0)
    for name, n in sorted(counts.items()):
        least = F.when(F.col(lang) == name, int(span * min(1.0, rows_per_language / n))).otherwise(least)
    size = F.length(text)
    starts = F.array(*[F.floor(size * k / WINDOWS_PER_ROW).cast("int") + 1 for k in range(WINDOWS_PER_ROW)])
    sample = (
        usable.where(F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.substring(text, 1, 64)), F.lit(span)) < least)
        .select(F.col(lang).alias("lang"), F.transform(starts, lambda s: F.substring(F.col(text), s, F.lit(WINDOW))).alias("parts"))
        .orderBy(F.xxhash64("parts"), "lang", "parts")  # binds only where rows repeat
        .limit(2 * rows_per_language * len(counts))
        .collect()
    )
    rows = sorted({(p.encode(), r["lang"]) for r in sample for p in r["parts"] if p and any(c.isalpha() for c in p)})
    return train(rows)


def predictor(net: ByteNet):
    """A vectorised function: texts -> struct(lang, score)."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t] if net.languages else []
        group, size = [], 0
        for k, i in enumerate(known):
            group.append(i)
            size += len(texts.iat[i])
            if size > 1 << 20 or k + 1 == len(known):
                windows, owner, weight = cut_windows([texts.iat[j].encode("utf-8", "replace") for j in group])
                p = net.probabilities(windows) * weight[:, None]
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                mean = np.add.reduceat(p, starts) / np.add.reduceat(weight, starts)[:, None]
                best = mean.argmax(axis=1)
                lang[group] = np.array(net.languages, object)[best]
                score[group] = np.clip(mean[np.arange(len(group)), best], 0, 1)
                group, size = [], 0
        give_back()
        return pd.DataFrame({"lang": lang, "score": score})

    return predict


def identify(documents: DataFrame, net: ByteNet, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``documents`` with two more columns; columns of these names are replaced."""
    bounded_batches(documents.sparkSession)
    letters: Column = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    found = predictor(net)(F.when(letters, F.col(text)))
    keep = [F.col(f"`{c}`") for c in documents.columns if c not in into]
    return documents.select(*keep, found.alias("__found")).select(
        *keep, F.col("__found.lang").alias(into[0]), F.col("__found.score").alias(into[1])
    )

"""Operator 4: text quality by a regularised quadratic discriminant.

A document is a vector of transformed statistics of its text.  Each class has
a mean and a covariance matrix, shrunk towards its diagonal and a multiple of
the identity; the score is the difference of the Gaussian log-densities, by
Mahalanobis distances over the cached Cholesky factors, and a logistic
temperature fitted on the same rows makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

U64 = np.uint64
_CLASSES = {
    "space": [0x20], "line": [0x0A], "lower": range(0x61, 0x7B), "upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A),
    "stop": [0x2E, 0x3F, 0x21], "comma": [0x2C, 0x3B, 0x3A], "pipe": [0x7C], "odd": [*b"#$%&*+/<=>@[\\]^_`{}~"], "high": range(0x80, 0x100),
}
NAMES = ["bytes", "words", "word_length", "word_spread", "short_words", "long_words", "distinct_words", "repeated_pairs", "distinct_lines", "top_word", "line_length", *_CLASSES, "shout"]
_TABLES = np.zeros((len(_CLASSES), 256), dtype=np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _TABLES[_i, list(_bytes)] = 1


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype("f8")


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document and its most frequent value's count."""
    n = len(bounds) - 1
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])))
    runs, of = np.diff(np.append(fresh, len(h))), o[fresh]
    most = np.zeros(n)
    np.maximum.at(most, of, runs)
    return np.bincount(of, minlength=n).astype("f8"), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each document; an empty text has a row of its own kind."""
    starts, ends, counts = tk.word_bounds(data, offsets, tk.NOT_SPACE)
    size, words = np.diff(offsets).astype("f8"), np.diff(counts).astype("f8")
    length = ends - starts
    hashes = tk.word_hashes(data, starts, ends)
    per = np.maximum(words, 1)
    mean = _sums(length, counts) / per
    spread = np.sqrt(np.maximum(_sums(length * length, counts) / per - mean**2, 0))
    distinct, most = _distinct(hashes, counts)
    pairs = tk.word_grams(hashes, 2)
    pairs = np.append(pairs, np.zeros(len(hashes) - len(pairs), dtype=U64))
    if len(pairs):
        last = counts[1:][counts[1:] > counts[:-1]] - 1
        pairs[last] = last.astype(U64)  # a document's last word has no pair: a value of its own
    pair_kinds, _ = _distinct(pairs, counts)
    is_line = np.ones(256, dtype=bool)
    is_line[0x0A] = False
    begin, finish, lines = tk.word_bounds(data, offsets, is_line)
    line_kinds, _ = _distinct(tk.word_hashes(data, begin, finish), lines)
    n_lines = np.maximum(np.diff(lines), 1)
    share = [_sums(t[data], offsets) / np.maximum(size, 1) for t in _TABLES]
    shout = share[3] / np.maximum(share[2] + share[3], 1e-3)
    columns = [
        np.log1p(size), np.log1p(words), np.log1p(mean), np.log1p(spread), _sums(length <= 3, counts) / per, _sums(length >= 14, counts) / per,
        np.log((distinct + 1) / (words + 1)), np.sqrt(1 - np.minimum(pair_kinds / per, 1)), np.log((line_kinds + 1) / (n_lines + 1)), np.sqrt(most / per), np.log1p(size / n_lines), *(np.sqrt(s) for s in share), shout,
    ]
    return np.stack(columns, axis=1)


def features(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, x): statistics of every whole text; null counts as empty."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for i, j, data, offsets in tk.batches(batch, "t"):
                x = statistics(data, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), flat], names=["d", "x"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("d"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"d {kind}, x array<double>").withColumnRenamed("d", id)


@dataclass
class Model:
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    slope: float
    shift: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        side = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            side.append(constant - 0.5 * (z * z).sum(axis=0))
        return side[1] - side[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.log_odds(x) + self.shift, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, *, shrink: float = 0.1) -> Model:
    """With a class of fewer than two rows every score is the share of label 1 (0.5 without rows)."""
    width = len(NAMES)
    if min(np.count_nonzero(y == 0), np.count_nonzero(y == 1)) < 2:
        share = np.clip(y.mean(), 0.01, 0.99) if len(y) else 0.5
        return Model(np.zeros((2, width)), np.stack([np.eye(width)] * 2), np.zeros(2), 0.0, float(np.log(share / (1 - share))))
    scale = x.std(axis=0) ** 2 + 1e-6
    means, factors, constants = [], [], []
    for c in (0, 1):
        mine = x[y == c]
        cov = np.cov(mine.T)
        cov = (1 - shrink) * cov + 0.5 * shrink * np.diag(np.diag(cov)) + 0.5 * shrink * np.diag(scale)
        factor = np.linalg.cholesky(cov + 1e-9 * np.eye(width))
        means.append(mine.mean(axis=0))
        factors.append(factor)
        constants.append(np.log(len(mine) / len(x)) - np.log(np.diag(factor)).sum())
    model = Model(np.array(means), np.array(factors), np.array(constants), 1.0, 0.0)
    z = np.stack([model.log_odds(x) / 10, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = float(w[0] / 10), float(w[1])
    return model


def training_rows(x: DataFrame, labels: DataFrame, *, label: str, train: Column, id: str = "doc_id", most: int = 20000) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` labelled training rows, chosen by a hash of the id.  Null ids and labels are left out; of several labels of one id the largest counts."""
    known = labels.where(train & F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id).alias("d")).agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("d"), "d").limit(most)
    rows = x.select(F.col(id).alias("d"), "x").join(F.broadcast(known), "d").groupBy("d").agg(F.min("x").alias("x"), F.max("y").alias("y")).toPandas().sort_values("d")
    return np.array(rows["x"].tolist()).reshape(-1, len(NAMES)), rows["y"].to_numpy(dtype="f8")


def scores(x: DataFrame, model: Model, *, id: str = "doc_id") -> DataFrame:
    """(id, score) of feature rows."""
    held = x.sparkSession.sparkContext.broadcast(model)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            if batch.num_rows:
                rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(rows))], names=["d", "score"])

    kind = x.schema[id].dataType.simpleString()
    return x.select(F.col(id).alias("d"), "x").mapInArrow(run, f"d {kind}, score double").withColumnRenamed("d", id)

"""Operator 9: toxicity by compression distance.

Two pairs of zstandard dictionaries are made.  The trained pair holds one
dictionary trained on windows of toxic documents and one trained on windows of
ordinary documents.  The marked pair has a common base, trained on ordinary
text, so that plain wording costs the same under either; its toxic one goes on
with the wording that marks toxic documents, its ordinary one with as much
ordinary text.  A window that gets shorter under a toxic dictionary than under
the ordinary one of its pair is closer to toxic text.  For each pair the
numbers of windows beyond each of several thresholds on that difference are
taken, and all of them are calibrated to a probability by a ridge logistic
regression on documents the dictionaries have not seen.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(rb"[^\x00-\x20]+")
_LETTERS = re.compile(rb"[^a-z\x80-\xff]")
THRESHOLDS = np.arange(2, 10)


@dataclass
class Model:
    pairs: list[tuple[bytes, bytes]]  # (toxic, ordinary): marked and trained
    window: int
    level: int
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def windows(data: bytes, size: int) -> list[bytes]:
    """The text in windows of at most ``size`` bytes, cut at spaces where there are any."""
    out, i, n = [], 0, len(data)
    while i < n:
        j = i + size
        if j < n:
            cut = data.rfind(b" ", i + size // 2, j)
            j = cut if cut > 0 else j
        out.append(data[i:j])
        i = j
    return out


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)


def _compressors(model: Model) -> list[tuple]:
    return [(_compressor(a, model.level), _compressor(b, model.level)) for a, b in model.pairs]


def profile(text: str | None, pairs: list[tuple], size: int) -> np.ndarray:
    """For each pair the windows beyond each threshold (log) and the same as a share; the number of windows (log)."""
    cut = windows((text or "").encode().lower(), size)
    out = []
    for toxic, ordinary in pairs:
        gain = np.fromiter((len(ordinary.compress(w)) - len(toxic.compress(w)) for w in cut), np.int64, len(cut))
        beyond = np.array([np.count_nonzero(gain >= t) for t in THRESHOLDS], dtype="f8")
        out += [np.log1p(beyond), np.sqrt(beyond / max(1, len(cut)))]
    return np.concatenate([*out, [np.log1p(len(cut))]])


def _trained(texts: list[bytes], size: int, most: int) -> tuple[bytes, list[bytes]]:
    """A dictionary trained on at most ``most`` windows of the texts, chosen by a hash, and these windows."""
    cut = [w for t in texts for w in windows(t, 64)]
    cut = [w for _, w in sorted((zlib.crc32(w), w) for w in cut)][:most]
    try:
        return zstandard.train_dictionary(size, cut).as_bytes(), cut
    except zstandard.ZstdError:  # too little text to train on: it is the dictionary
        return b"".join(cut)[:size], cut


def _sketches(data: bytes) -> set[tuple[int, int]]:
    """Smallest of several hashes of four successive words: near copies agree in one at least."""
    words = _WORD.findall(data)
    hashes = np.array([zlib.crc32(b" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))], dtype=np.uint32)
    return {(n, int((hashes * np.uint32(a)).min())) for n, a in enumerate((1, 2654435761, 2246822519, 3266489917, 668265263, 374761393))}


def _document_counts(texts: list[bytes]) -> tuple[Counter, int]:
    """Documents with each word and each beginning of 5 to 7 bytes of one (stems), one of each group of copies."""
    seen, counts, n = set(), Counter(), 0
    for t in texts:
        if not (sketches := _sketches(t)) & seen:
            n += 1
            words = {_LETTERS.sub(b"", w) for w in _WORD.findall(t)}
            counts.update(words.union(w[:k] for w in words for k in (5, 6, 7) if len(w) > k))
        seen |= sketches
    return counts, n


def fit(rows: list[tuple[str, int]], *, share: float | None = None, window: int = 32, level: int = 3, base_bytes: int = 16384, own_bytes: int = 65536, most: int = 60000, own_most: int = 200000) -> Model:
    """rows: (text, 0 or 1); ``share``: of label 1 among all labelled rows, if the sample has another.

    The marked pair's base is trained on at most ``most`` windows of 64 bytes
    and has ``base_bytes``; each dictionary of the trained pair is trained on at
    most ``own_most`` windows and has ``own_bytes``.
    With one class only, or none, every score is near that class's label (or 0.5).
    """
    texts = [[(t or "").encode().lower() for t, y in rows if y == c] for c in (0, 1)]
    first = [x[: len(x) * 3 // 5 + 1] for x in texts]
    later = [x[len(x) * 3 // 5 + 1 :] or x for x in texts]
    (ordinary, no), (toxic, nt) = map(_document_counts, first)
    least = max(3, 0.008 * nt)
    marks = [w for w, n in toxic.items() if len(w) >= 4 and n >= least and n / max(1, nt) > 10 * (ordinary[w] + 0.5) / max(1, no)]
    marks.sort(key=lambda w: (toxic[w], w))
    base, plain = _trained(first[0], base_bytes, most)
    own = b" " + b" ".join(marks) + b" "
    pairs = [(base + own, base + b"".join(plain)[: len(own)]), (_trained(first[1], own_bytes, own_most)[0], _trained(first[0], own_bytes, own_most)[0])]
    model = Model(pairs, window, level, np.zeros(1), np.ones(1), np.zeros(1))
    made = _compressors(model)
    x = np.array([profile(t.decode(), made, window) for part in later for t in part]).reshape(-1, 2 * len(pairs) * len(THRESHOLDS) + 1)
    y = np.concatenate([np.full(len(part), c, dtype="f8") for c, part in enumerate(later)])
    mine = y.mean() if len(y) else 0.5
    model.center, model.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    model.weights = np.zeros(x.shape[1] + 1)
    if 0 < mine < 1:
        model.weights = _logistic((x - model.center) / model.scale, y)
        if share and share < 1:
            # half of the way to the natural odds: about where precision and recall balance
            model.weights[-1] += 0.5 * (np.log(share / (1 - share)) - np.log(mine / (1 - mine)))
    elif len(y):
        model.weights[-1] = 6.0 if mine else -6.0
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, *, label: str, train: Column, id: str = "doc_id", text: str = "text", each: int = 2500, longest: int = 65536) -> tuple[list[tuple[str, int]], float]:
    """At most ``each`` training rows of either label, chosen by a hash of the id, and the share of label 1 among all.

    Rows are bounded, not which texts may teach: of a text of more than
    ``longest`` characters a stretch of that many, chosen by a hash of the id,
    is taken.  Null ids, labels and texts are left out; of several labels of one
    id the largest counts, of several texts the first in order.
    """
    known = labels.where(train & F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id).alias("d")).agg(F.max(label).cast("int").alias("y"))
    share = known.agg(F.avg("y")).first()[0] or 0.0
    best = known.where("y = 0").orderBy(F.xxhash64("d"), "d").limit(each).unionByName(known.where("y = 1").orderBy(F.xxhash64("d"), "d").limit(each))
    texts = docs.select(F.col(id).alias("d"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    begin = F.when(F.length("t") > longest, F.pmod(F.xxhash64("d"), F.length("t") - longest + 1).cast("int")).otherwise(0)
    # one text for each chosen id: no more than 2 * each texts of ``longest`` characters reach the driver
    found = texts.join(F.broadcast(best), "d").select("d", "y", F.substring("t", begin + 1, F.lit(longest)).alias("t")).groupBy("d").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    rows = sorted((r["d"], r["t"], r["y"]) for r in found.collect())
    rows.sort(key=lambda r: zlib.crc32(str(r[0]).encode()))
    return [(t, y) for _, t, y in rows], float(share)


def scores(docs: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score): probability of toxic wording in the whole text; null counts as empty.  Rows with equal ids are scored each."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        made = _compressors(m)
        for batch in arrow:
            for i in range(0, batch.num_rows, 512):
                few = batch.slice(i, 512)
                x = np.array([profile(t, made, m.window) for t in few.column(1).to_pylist()])
                z = ((x - m.center) / m.scale) @ m.weights[:-1] + m.weights[-1]
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["d", "score"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("d"), F.col(text).cast("string")).mapInArrow(run, f"d {kind}, score double").withColumnRenamed("d", id)

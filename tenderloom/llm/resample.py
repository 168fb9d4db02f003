"""Operator 12: importance resampling towards a target distribution.

Words and word pairs, hashed to buckets, are counted over the corpus and over
the target.  A bucket's gain is its log ratio, a document's weight the mean
gain of its features: both are arrays, one scan each.  With a Gumbel value from
its id added, the highest scores are a draw without replacement.  The exact
k-th key is found by radix selection: each round counts one digit of the key
over the cluster and keeps the digit where the k-th key lies.  Only rows up to
that key are sorted, by ranges, and ranked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import written

U32 = np.uint32


def _crc_table() -> np.ndarray:
    """Steps of the CRC-32 of zlib by byte."""
    step = np.arange(256, dtype=U32)
    for _ in range(8):
        step = np.where(step & U32(1), U32(0xEDB88320) ^ (step >> U32(1)), step >> U32(1))
    return step


CRC = _crc_table()
#: Longer words go through zlib one by one; shorter ones byte by byte, all words together.
LONG = 64


def crc_states(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of each range, from ``state``."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    starts, length, out = starts[order], length[order], state[order]
    long = int(np.searchsorted(-length, -LONG, "left"))
    for i in range(long):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + length[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for at in range(int(length[long]) if long < len(length) else 0):
        end = int(np.searchsorted(-length, -at, "left"))
        now = out[long:end]
        out[long:end] = CRC[(now ^ data[starts[long:end] + at]) & U32(0xFF)] ^ (now >> U32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words and of each word with its follower, which of the latter lie in one document, and words before each document."""
    data = tk.LOWER[data]
    starts, ends, counts = tk.word_bounds(data, offsets, tk.ALNUM)
    words = crc_states(data, starts, ends, np.full(len(starts), 0xFFFFFFFF, dtype=U32))
    spaced = CRC[(words[:-1] ^ U32(0x20)) & U32(0xFF)] ^ (words[:-1] >> U32(8))
    pairs = crc_states(data, starts[1:], ends[1:], spaced)
    together = np.ones(len(pairs), dtype=bool)
    edge = counts[(counts > 0) & (counts < len(starts))]
    together[edge - 1] = False
    return (words ^ U32(0xFFFFFFFF)) % U32(buckets), (pairs ^ U32(0xFFFFFFFF)) % U32(buckets), together, counts


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features of the column ``t`` in each bucket: one row a task and bucket, summed over the cluster."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in arrow:
            for _, _, data, offsets in tk.batches(batch, "t"):
                words, pairs, together, _ = features(data, offsets, buckets)
                total += np.bincount(words, minlength=buckets) + np.bincount(pairs[together], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], schema=schema)

    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in texts.mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log of the bucket's share in the target over that in the corpus, both smoothed by one."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``docs`` (id, t) with n_words, n_features and weight instead of the text."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema["id"].dataType.simpleString()

    def weigh(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in arrow:
            for i, j, data, offsets in tk.batches(batch, "t"):
                words, pairs, together, counts = features(data, offsets, len(gain))
                n = np.diff(counts)
                own = np.concatenate([[0], np.cumsum(gain[words])])
                joint = np.concatenate([[0], np.cumsum(np.where(together, gain[pairs], 0)), [0]])
                joint[-1] = joint[-2]
                size = np.maximum(2 * n - 1, 0)
                total = own[counts[1:]] - own[counts[:-1]] + np.where(n > 0, joint[np.maximum(counts[1:] - 1, 0)] - joint[counts[:-1]], 0)
                made = [pa.array(n), pa.array(size), pa.array(np.where(size > 0, total // np.maximum(size, 1), 0))]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")).slice(i, j - i), *made], names=["id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(weigh, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(id: Column, seed: int) -> Column:
    """Floored thousandths of the Gumbel value that the SHA-256 of ``seed:id`` gives."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0)))


_SIGN = 1 << 63


def kth_key(rows: DataFrame, names: list[str], k: int, bits: int = 16) -> list[int]:
    """The ``k``-th smallest key of the bigint columns ``names``, as far as it must be known.

    The rows whose first columns are no larger than the returned ones are
    exactly ``k``, if keys are unique.  Each round is one count over the rows
    that are still open; at most two to the power ``bits`` counts reach the
    driver.
    """
    key: list[int] = []
    for name in names:
        column = F.col(name)
        low, high, n = rows.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
        while low < high and n > k:
            a, b = low + _SIGN, high + _SIGN
            shift = max(0, (a ^ b).bit_length() - bits)
            digit = F.shiftrightunsigned(column.bitwiseXOR(F.lit(-_SIGN)), shift)
            counts = sorted((d % (2 * _SIGN), m) for d, m in rows.where(column.between(low, high)).groupBy(digit.alias("d")).count().collect())
            for d, m in counts:
                if k <= m:
                    break
                k -= m
            low, high, n = max(low, (d << shift) - _SIGN), min(high, ((d + 1) << shift) - 1 - _SIGN), m
        key.append(high)
        if n == k:
            break
        rows = rows.where(column == high)
    return key


def up_to(names: list[str], key: list[int]) -> Column:
    """Whether the key is no larger than ``key``, column by column."""
    *before, last = zip(names, key, strict=False)
    found = F.col(last[0]) <= last[1]
    for name, value in reversed(before):
        found = (F.col(name) < value) | ((F.col(name) == value) & found)
    return found


KEY = ["down", "place", "row"]


def resample(
    docs: DataFrame, target: DataFrame, *, id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7,
) -> DataFrame:
    """Every document's id, n_words, n_features, weight and score, and the rank of those that are drawn.

    ``id`` is integral.  Null texts have no words; documents without features
    have weight 0; only those with ``least_words`` are drawn.  Highest scores
    first, ties to the smaller id, null ids (hashed as empty) last; rows with
    equal ids are rows of their own, in the order of the table's files.  Empty
    tables count nothing; further columns are ignored.
    """
    if docs.schema[id].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id} must be integral")
    slim = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("t"))
    gain = gains(bucket_counts(slim.select("t"), buckets), bucket_counts(target.select(F.col(target_text).cast("string").alias("t")), buckets))
    scored = weights(slim, gain).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumns(
        {"down": -F.col("score"), "place": F.coalesce(F.col("id").cast("bigint"), F.lit((1 << 63) - 1)), "row": F.monotonically_increasing_id()}
    )
    scored = written(scored, "scores")
    able = scored.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    out = [F.col("id").alias(id), "n_words", "n_features", "weight", "score"]
    if not k:
        return scored.select(*out, F.lit(None).cast("bigint").alias("rank"))
    inside = (F.col("n_words") >= least_words) & up_to(KEY, kth_key(able.select(*KEY), KEY, k))
    order = scored.where(inside).repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("at", F.monotonically_increasing_id())
    order = written(order, "drawn")
    part, start, starts = F.shiftright("at", 33), 0, []
    for p, n in sorted(order.groupBy(part.alias("p")).count().collect()):  # one row a partition
        starts.append((p, start))
        start += n
    first = docs.sparkSession.createDataFrame(starts, "p bigint, start bigint")
    ranked = order.join(F.broadcast(first), part == F.col("p")).withColumn("rank", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return scored.where(~inside).select(*out, F.lit(None).cast("bigint").alias("rank")).unionByName(ranked.select(*out, "rank"))

"""Operator 1: benchmark decontamination by winnowing.

Both sides are cut into word k-grams; of each sliding window the smallest
k-gram hash (the rightmost of equals) is a fingerprint.  With windows of
``span - k + 1`` k-grams, two texts that share ``span`` successive words choose
the same fingerprint inside that span, so the join of document and benchmark
fingerprints misses no shared span.  Each joined pair is then extended to both
sides, word by word, and only pairs that reach ``span`` words count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

U64 = np.uint64


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the fingerprints: rightmost smallest of each ``window`` successive values."""
    n = len(grams)
    if n < window or not n:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(n - window + 1)
    value = grams[: n - window + 1].copy()
    for t in range(1, window):
        other = grams[t : t + n - window + 1]
        better = other <= value
        value = np.where(better, other, value)
        best = np.where(better, best - best + np.arange(t, t + n - window + 1), best)
    return np.unique(best)


@dataclass
class Index:
    """A block of the benchmark: word hashes, item of each word, fingerprints, short items."""

    words: np.ndarray
    item: np.ndarray
    names: list[str]
    prints: np.ndarray
    places: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and the number of words before each document."""
    data = tk.LOWER[data]
    starts, ends, counts = tk.word_bounds(data, offsets, tk.ALNUM)
    return tk.word_hashes(data, starts, ends), counts


def build_index(names: list[str], texts: list[str | None], span: int, k: int) -> Index:
    data, offsets = tk.buffers(pa.array(texts, type=pa.string()))
    words, counts = tokens(data, offsets)
    item = np.repeat(np.arange(len(names)), np.diff(counts))
    grams = tk.word_grams(words, k)
    places, short = [], {}
    for i, (a, b) in enumerate(zip(counts[:-1], counts[1:], strict=True)):
        if b - a >= span:
            places.append(a + winnow(grams[a : b - k + 1], span - k + 1))
        elif b > a:
            short.setdefault(int(b - a), []).append(i)
    places = np.concatenate(places) if places else np.zeros(0, dtype=np.int64)
    order = np.argsort(grams[places], kind="stable")
    whole = {}
    for m, items in short.items():
        value = tk.word_grams(words, m)[counts[items]]
        by = np.argsort(value, kind="stable")
        whole[m] = (value[by], np.asarray(items)[by])
    return Index(words, item, names, grams[places][order], places[order], whole)


def _matches(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (index into values, index into the sorted table) of equal values."""
    low, high = np.searchsorted(table, values, "left"), np.searchsorted(table, values, "right")
    found = np.flatnonzero(high > low)
    times = (high - low)[found]
    left = np.repeat(found, times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[found], times)
    return left, right


def find_hits(words: np.ndarray, counts: np.ndarray, index: Index, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, item) of every hit in the buffer."""
    out = []
    owner = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
    if len(words) >= span and len(index.prints):
        grams = tk.word_grams(words, k)
        # fingerprints that windows across documents add cost a lookup and cannot pass the extension
        at = winnow(grams, span - k + 1)
        left, right = _matches(grams[at], index.prints)
        d, b = at[left], index.places[right]
        same = (owner[d] == owner[np.minimum(d + k - 1, len(words) - 1)])
        d, b = d[same], b[same]
        before, after = np.zeros(len(d), dtype=np.int64), np.zeros(len(d), dtype=np.int64)
        for t in range(k):
            ok = words[d + t] == index.words[b + t]
            d, b, before, after = d[ok], b[ok], before[ok], after[ok]
        going = np.ones(len(d), dtype=bool)
        for t in range(1, span - k + 1):
            x, y = np.maximum(d - t, 0), np.maximum(b - t, 0)
            going &= (d >= t) & (b >= t) & (owner[x] == owner[d]) & (index.item[y] == index.item[b]) & (words[x] == index.words[y])
            before += going
        going = np.ones(len(d), dtype=bool)
        for t in range(k, span):
            x, y = np.minimum(d + t, len(words) - 1), np.minimum(b + t, len(index.words) - 1)
            going &= (d + t < len(words)) & (b + t < len(index.words)) & (owner[x] == owner[d]) & (index.item[y] == index.item[b]) & (words[x] == index.words[y])
            after += going
        long = before + k + after >= span
        out.append((d[long] - before[long], d[long] + k + after[long], index.item[b[long]]))
    for m, (value, items) in index.short.items():
        if len(words) < m:
            continue
        grams = tk.word_grams(words, m)
        left, right = _matches(grams, value)
        inside = owner[left] == owner[left + m - 1]
        left, right = left[inside], right[inside]
        out.append((left, left + m, items[right]))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _merged(start: np.ndarray, end: np.ndarray) -> list[dict]:
    spans: list[dict] = []
    for a, b in sorted(zip(start.tolist(), end.tolist(), strict=True)):
        if spans and a <= spans[-1]["end"]:
            spans[-1]["end"] = max(b, spans[-1]["end"])
        else:
            spans.append({"start": a, "end": b})
    return spans


HIT_TYPE = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    span: int = 10, k: int = 5, block_bytes: int = 32 << 20,
) -> DataFrame:
    """Per document row: its id, ``n_words``, the hit ``spans`` (in words) and the hit ``items``.

    Null or empty texts have no words and no hits; rows with equal or null ids
    stay rows of their own; items of fewer than ``span`` words are matched
    whole; items without words never match; further columns are ignored.  The
    benchmark is broadcast in blocks of at most ``block_bytes`` of text (one
    longer item makes a block of its own); a benchmark of more than one block
    is a pass over the documents for each, merged by row afterwards.
    """
    sc = docs.sparkSession.sparkContext
    bench = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    total = bench.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    blocks = -(-2 * total // block_bytes) if total > block_bytes else 1
    slim = docs.select(F.col(id).alias("d"), F.col(text).cast("string").alias("t"))
    if blocks == 1:
        return _pass(slim, sc.broadcast(_rows_index(bench, span, k)), span, k, docs.schema[id].dataType.simpleString()).withColumnRenamed("d", id)
    slim = docs.select(F.struct(F.col(id).alias("d"), F.monotonically_increasing_id().alias("r")).alias("d"), F.col(text).cast("string").alias("t"))
    kind = f"struct<d:{docs.schema[id].dataType.simpleString()},r:bigint>"
    parts = [_pass(slim, sc.broadcast(_rows_index(bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n), span, k)), span, k, kind) for n in range(blocks)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.groupBy("d").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    merged = """aggregate(array_sort(s), cast(array() as array<struct<start:bigint,end:bigint>>), (out, x) ->
        case when size(out) > 0 and get(out, size(out) - 1).end >= x.start
             then concat(slice(out, 1, size(out) - 1), array(named_struct('start', get(out, size(out) - 1).start, 'end', greatest(get(out, size(out) - 1).end, x.end))))
             else concat(out, array(x)) end)"""
    return rows.select(F.col("d.d").alias(id), "n_words", F.expr(merged).alias("spans"), "items")


def _rows_index(bench: DataFrame, span: int, k: int) -> Index:
    rows = bench.collect()
    return build_index([r["i"] for r in rows], [r["t"] for r in rows], span, k)


def _pass(slim: DataFrame, index, span: int, k: int, kind: str) -> DataFrame:
    def scan(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
        held = index.value
        for batch in arrow:
            for i, j, data, offsets in tk.batches(batch, "t"):
                words, counts = tokens(data, offsets)
                start, end, item = find_hits(words, counts, held, span, k)
                spans: list[list] = [[] for _ in range(j - i)]
                items: list[list] = [[] for _ in range(j - i)]
                doc = np.searchsorted(counts, start, "right") - 1
                for n in np.unique(doc):
                    mine = doc == n
                    spans[n] = _merged(start[mine] - counts[n], end[mine] - counts[n])
                    items[n] = sorted({held.names[x] for x in np.unique(item[mine])})
                made = pa.RecordBatch.from_arrays([pa.array(np.diff(counts)), pa.array(spans, out.field("spans").type), pa.array(items, out.field("items").type)], schema=out)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *made.columns], names=["d", *out.names])

    return slim.mapInArrow(scan, f"d {kind}, {HIT_TYPE}")

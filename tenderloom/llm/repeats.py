"""Operator 3: removal of long repeated passages by suffix sorting.

A byte goes if a string of ``length`` bytes that covers it starts at another
place too, in any document.

Finding candidates without moving texts.  Of each ``length`` bytes the
smallest hash of its ``GRAM``-byte strings is its anchor (the rightmost of
equals), so equal strings have the anchor at the same distance, and every
start of a string belongs to exactly one anchor.  The starts of an anchor make
a cell; all strings of a cell share a core, and only cells whose core hash
occurs again are looked at.

*  If all occurrences of a core have the same fragment (all bytes that the
   strings of the cell cover), all its strings are repeated.
*  Else the distinct fragments of a core are put side by side and their suffixes
   sorted in two stages: directly sorted are only suffixes smaller than their
   successors, the others are induced by a scan over the buckets.  Neighbours
   in that order with a common prefix of ``length`` bytes start repeated strings.
*  A core with very many distinct fragments is cut into finer cells by the
   distance to the anchor first, until a cell is one string, so no group is unbounded; where a passage that very
   many documents share begins and ends, few strings are left to each cell.

Counts are added up before they are shuffled, by hash.  The rows are dealt once
to a table bucketed by a number of their own; anchors, fragments and removed
spans then go to the texts, not the texts to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import bucketed, written

U64 = np.uint64


def window_of(length: int) -> int:
    """How many successive grams have an anchor: the largest power of two up to two thirds of the length."""
    return 1 << (max(2, length * 2 // 3).bit_length() - 1)


def widths_of(length: int) -> list[int]:
    """Widths of the cells, coarse to fine: the first is all starts of an anchor, the last one string."""
    window = window_of(length)
    return [window, *(w for w in (window // 8, window // 32) if w > 1), 1]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor, first start, last start), in the buffer's positions, of all runs of starts with one anchor, and the anchors' hashes."""
    window = window_of(length)
    gram = length - window + 1
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, np.zeros((2, 0), dtype=np.int64)
    hashes = tk.RangeHash(data).grams(gram)
    bits = U64((1 << 24) - 1)
    if len(data) > 1 << 24:
        bits = U64((1 << int(len(data)).bit_length()) - 1)
    least = (hashes & ~bits) | (bits - np.arange(len(hashes), dtype=U64))
    step = 1
    while step < window:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    at = (bits - (least & bits)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - length + 1, 0))
    if not len(doc):
        return none, none, none, np.zeros((2, 0), dtype=np.int64)
    whole = np.maximum(np.diff(offsets) - length + 1, 0)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole) + np.repeat(offsets[:-1], whole)
    at = at[start]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], at[first], np.stack([start[first], start[last]]), hashes[at[first]].astype(np.int64)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of their suffixes, by two stages; ties after ``depth`` characters may come in any order.

    text: small non-negative integers.  A suffix is of kind B if it is smaller
    than the one after it.  B suffixes are sorted by prefix doubling among
    themselves; a suffix of kind A comes after the suffix that follows it, so a
    scan over the buckets of first characters, in order, finds the A suffixes of
    each bucket in their order: they are the predecessors of what was scanned.
    """
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    text = text.astype(np.int64)
    # kind of i: compare with the next character; in a run of equals as at the run's end; the last suffix is A
    differs = np.flatnonzero(text[1:] != text[:-1])
    kind_b = np.zeros(n, dtype=bool)
    if len(differs):
        nxt = np.searchsorted(differs, np.arange(n - 1))
        real = nxt < len(differs)
        ends = differs[np.minimum(nxt, len(differs) - 1)]
        kind_b[: n - 1] = real & (text[ends] < text[np.minimum(ends + 1, n - 1)])
    b = np.flatnonzero(kind_b)
    order_b = b[_direct_order(text, b, depth)]
    # buckets: A suffixes of a character first, then its B suffixes
    out, size = np.empty(n, dtype=np.int64), np.bincount(text)
    starts = np.concatenate([[0], np.cumsum(size)])
    by_char = text[order_b]
    bounds = np.searchsorted(by_char, np.arange(len(size) + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in size]
    # the suffix after the last one is empty and smallest: it induces the last one
    waiting[text[n - 1]].append(np.array([n - 1], dtype=np.int64))

    def induce(found: np.ndarray, char: int) -> np.ndarray:
        """Hands on the predecessors of kind A; returns those in this very bucket."""
        before = found[found > 0] - 1
        before = before[~kind_b[before]]
        chars = text[before]
        same = before[chars == char]
        rest, keys = before[chars != char], chars[chars != char]
        if len(rest):
            by = np.argsort(keys, kind="stable")
            keys, rest = keys[by], rest[by]
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            for a, z in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
                waiting[keys[a]].append(rest[a:z])
        return same

    for char in np.flatnonzero(size):
        at = starts[char]
        wave = np.concatenate(waiting[char]) if waiting[char] else np.zeros(0, dtype=np.int64)
        while len(wave):
            out[at : at + len(wave)] = wave
            at += len(wave)
            wave = induce(wave, char)
        mine = order_b[bounds[char] : bounds[char + 1]]
        out[at : at + len(mine)] = mine
        induce(mine, char)
    return out


def _direct_order(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes at ``at`` by their first ``depth`` characters.

    Groups of still equal suffixes are split by their next few characters at a
    time; a hash of the next hundred tells which groups can pass over them.
    """
    n, count = len(text), len(at)
    padded = np.concatenate([text + 1, np.zeros(8, dtype=np.int64)]).astype(U64)
    packed = np.zeros(n + 1, dtype=U64)
    width = 7 if int(text.max(initial=0)) < 511 else 3
    shift = U64(9 if width == 7 else 20)
    for t in range(width):
        packed[:n] = (packed[:n] << shift) | padded[t : t + n]
    up, down = tk.powers(n + 1)
    sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(tk.mix(padded[:n]) * up[:n], dtype=U64)])
    order, group, reach = np.arange(count), np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    tied = np.arange(count)
    while len(tied):
        mine, g = order[tied], group[tied]
        heads = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        sizes = np.diff(np.append(heads, len(g)))
        passed = np.zeros(len(tied), dtype=bool)
        for skip in (112, 28):
            a = np.minimum(at[mine] + reach[mine], n)
            z = np.minimum(a + skip, n)
            h = (sums[z] - sums[a]) * down[a] + (z - a).astype(U64)
            even = np.repeat(np.minimum.reduceat(h, heads) == np.maximum.reduceat(h, heads), sizes) & ~passed
            reach[mine[even]] += skip
            passed |= even
        rest = tied[~passed]
        if len(rest):
            mine = order[rest]
            key = packed[np.minimum(at[mine] + reach[mine], n)]
            by = np.lexsort((key, group[rest]))
            mine = mine[by]
            order[rest] = mine
            reach[mine] += width
            key, g = key[by], group[rest]
            fresh = np.append(True, (key[1:] != key[:-1]) | (g[1:] != g[:-1]))
            group[rest] = rest[np.maximum.accumulate(np.where(fresh, np.arange(len(rest)), 0))]
        g = group[tied]
        alone = np.append(True, g[1:] != g[:-1]) & np.append(g[1:] != g[:-1], True)
        tied = tied[~alone & (reach[order[tied]] < depth)]
    return order


def repeated_starts(fragments: list[bytes], length: int) -> list[np.ndarray]:
    """For each fragment the starts of ``length``-byte strings that also start elsewhere in the fragments."""
    joined, starts = [], np.zeros(len(fragments) + 1, dtype=np.int64)
    for n, f in enumerate(fragments):
        joined += [np.frombuffer(f, np.uint8).astype(np.int64) + 1, np.zeros(1, dtype=np.int64)]
        starts[n + 1] = starts[n] + len(f) + 1
    text = np.concatenate(joined)
    order = suffix_order(text, length)
    common = _common_prefixes(text, order, length)
    marked = np.zeros(len(text), dtype=bool)
    marked[order[1:][common]] = True
    marked[order[:-1][common]] = True
    return [np.flatnonzero(marked[a : b - 1]) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each neighbour in the order shares ``length`` characters (none of them a separator, 0) with the one before."""
    borders = np.flatnonzero(text == 0)
    ends = borders[np.searchsorted(borders, np.arange(len(text)))]
    room = (ends - np.arange(len(text)))[order]
    fits = np.flatnonzero((room[1:] >= length) & (room[:-1] >= length))
    a, b = order[:-1][fits], order[1:][fits]
    eight = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(text.astype(np.uint16)).view(np.uint8), 8)[::2]
    packed = np.ascontiguousarray(eight).view("<u8").ravel()  # four characters each
    same = np.arange(len(fits))
    for t in [*range(0, length - 3, 4), max(0, length - 4)]:
        same = same[packed[a[same] + t] == packed[b[same] + t]] if length >= 4 else same[text[a[same] + t] == text[b[same] + t]]
    out = np.zeros(max(0, len(order) - 1), dtype=bool)
    out[fits[same]] = True
    return out


KEYS = "d bigint, h bigint, at bigint, low bigint, high bigint"
CELLS = "d bigint, h bigint, f bigint, back int, fore int, at bigint"


#: Longer documents are hashed in stretches of so many bytes.
STRETCH = 1 << 21


def dealt(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """The rows with a number of their own (d) and the text (t), bucketed by the number, and how many buckets.

    The other columns are c0, c1, ... in their order.  As many buckets as the
    input has partitions, and no more than Spark allows: every later step brings
    its few numbers to the texts, which are moved this once.
    """
    most = int(docs.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    count = min(max(1, docs.rdd.getNumPartitions()), most)
    others = [c for c in docs.columns if c != text]
    numbered = docs.select(F.monotonically_increasing_id().alias("d"), F.col(f"`{text}`").cast("string").alias("t"), *(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(others)))
    return bucketed(numbered, "d", count, "rows"), count


def _anchor_rows(slim: DataFrame, length: int) -> DataFrame:
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for i, j, data, offsets in tk.batches(batch, "t"):
                long = j - i == 1 and len(data) > 2 * STRETCH
                for skip in range(0, len(data) - length + 1, STRETCH) if long else (0,):
                    part = data[skip : skip + STRETCH + length - 1] if long else data
                    doc, at, runs, h = anchors(part, np.array([0, len(part)]) if long else offsets, length)
                    base = offsets[doc] - skip
                    if len(doc):
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(h), pa.array(at - base), pa.array(runs[0] - base), pa.array(runs[1] - base)], names=["d", "h", "at", "low", "high"])

    return slim.mapInArrow(run, KEYS)


def _cells(held: DataFrame, length: int, width: int, most: int = 1 << 16) -> DataFrame:
    """held: (d, t, runs): a document and the runs to cut.  (d, core hash, fragment hash, farthest and nearest distance to the anchor, anchor).

    At most ``most`` cells of STRETCH bytes of text are made at once.
    """
    window = window_of(length)

    def cut(ids: pa.Array, doc: np.ndarray, runs: pa.Array, data: np.ndarray, skip: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``data`` holds document n from its byte skip[n] on, at offsets[n]; size[n]: its whole length."""
        hashed = tk.RangeHash(data)
        step = max(1, most // (window // width))
        for a in range(0, len(doc), step):
            of = doc[a : a + step]
            at, low, high, h = (runs.field(n).to_numpy()[a : a + step] for n in ("at", "low", "high", "h"))
            first, last = (at - high) // width, (at - low) // width
            times = last - first + 1
            of, at, low, high, h = (np.repeat(x, times) for x in (of, at, low, high, h))
            cell = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
            back, fore = np.minimum(at - low, (cell + 1) * width - 1), np.maximum(at - high, cell * width)
            base = offsets[of] - skip[of]
            # the core may reach beyond a run that the text's border cuts: then it is the fragment's own
            begin, end = at - cell * width, at - (cell + 1) * width + 1 + length
            core = hashed(base + np.clip(begin, 0, size[of]), base + np.clip(end, 0, size[of]))
            core = tk.mix(core ^ tk.mix(h.astype(U64) + cell.astype(U64) * U64(0x9FB21C651E98DF25)))
            fragment = hashed(base + at - back, base + at - fore + length)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(core.astype(np.int64)), pa.array(fragment.astype(np.int64)), pa.array(back.astype(np.int32)), pa.array(fore.astype(np.int32)), pa.array(at)], names=["d", "h", "f", "back", "fore", "at"])

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for i, j, data, offsets in tk.batches(batch, "t"):
                ids, mine = batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i)
                flat = mine.flatten()
                if j - i > 1 or len(data) <= 2 * STRETCH:
                    doc = np.repeat(np.arange(j - i), np.diff(np.asarray(mine.offsets)))
                    yield from cut(ids, doc, flat, data, np.zeros(j - i, dtype=np.int64), offsets, np.diff(offsets))
                    continue
                flat = flat.take(pa.compute.array_sort_indices(flat.field("at")))
                at = flat.field("at").to_numpy()
                for skip in range(0, len(data), STRETCH):
                    a, z = np.searchsorted(at, [skip, skip + STRETCH])
                    if z > a:  # strings of an anchor begin within two windows before it and end within their length behind it
                        begin, end = max(0, skip - 2 * window), min(len(data), skip + STRETCH + length + window)
                        yield from cut(ids, np.zeros(z - a, dtype=np.int64), flat.slice(a, z - a), data[begin:end], np.array([begin]), np.zeros(1, dtype=np.int64), np.array([len(data)]))

    return held.mapInArrow(run, CELLS)


def _with_texts(slim: DataFrame, runs: DataFrame, count: int) -> DataFrame:
    """(d, t, runs): each document that has runs, with all of them; the runs go to the buckets of the texts."""
    listed = runs.repartition(count, "d").groupBy("d").agg(F.collect_list(F.struct("at", "low", "high", "h")).alias("runs"))
    return slim.join(listed, "d").select("d", "t", "runs")


def _cut(held: DataFrame, length: int, width: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Starts that are repeated (d, low, high); fragments to sort (d, h, at, low, high); runs to cut finer."""
    cells = written(_cells(held, length, width), "cells")
    fragments = cells.groupBy("h", "f", "back", "fore").agg(F.count("*").alias("n"), F.min(F.struct("d", "at")).alias("one"))
    cores = fragments.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    cores = written(cores.where("n > 1"), "cores")
    state = written(fragments.select("h", "f", "back", "fore", F.col("n").alias("copies"), "one").join(cores, "h"), "fragments")
    spans = cells.join(state.where("copies > 1 or kinds = 1").select("h", "f", "back", "fore"), ["h", "f", "back", "fore"])
    done = spans.select("d", (F.col("at") - F.col("back")).alias("low"), (F.col("at") - F.col("fore")).alias("high"))
    # several fragments of a core: those that occur once are still open, one of each other kind is there to be met
    ranges = state.where("kinds > 1").select("h", "kinds", "copies", F.col("one.d").alias("d"), F.col("one.at").alias("at"), (F.col("one.at") - F.col("back")).alias("low"), (F.col("one.at") - F.col("fore")).alias("high"))
    return done, ranges.where(F.col("kinds") <= most).drop("kinds"), ranges.where(F.col("kinds") > most).drop("kinds")


def _sorted_groups(slim: DataFrame, ranges: DataFrame, length: int, count: int) -> DataFrame:
    """(d, low, high): repeated starts among the fragments of each core."""

    def cut(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for i in range(0, batch.num_rows, 256):
                few = batch.slice(i, 256)
                rows = [(d, r["h"], r["low"], t[r["low"] : r["high"] + length]) for d, t, runs in zip(few.column(0).to_pylist(), (x.as_py().encode() for x in few.column(1)), few.column(2).to_pylist(), strict=True) for r in runs]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], few.schema.field(0).type), *(pa.array([r[n] for r in rows], t) for n, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.binary())))], names=["d", "h", "low", "fragment"])

    def group(rows: pa.RecordBatch) -> pa.Table:
        # many small groups share a sort: a core's strings meet only each other, as its fragments carry the core
        ids, low = rows.column("d"), rows.column("low").to_numpy()
        found = repeated_starts(rows.column("fragment").to_pylist(), length)
        doc, first, last = [], [], []
        for n, starts in enumerate(found):
            if len(starts):
                new = np.flatnonzero(np.append(True, np.diff(starts) > 1))
                first += (low[n] + starts[new]).tolist()
                last += (low[n] + starts[np.append(new[1:], len(starts)) - 1]).tolist()
                doc += [n] * len(new)
        return pa.table([ids.take(pa.array(doc, pa.int64())), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["d", "low", "high"])

    def sort(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by core; whole cores are put together to about half a MB."""
        held, size, core = [], 0, None
        for batch in arrow:
            h = batch.column("h").to_numpy()
            weight = np.asarray(pa.compute.binary_length(batch.column("fragment")))
            cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else []
            for a, b in zip(cuts, [*cuts[1:], len(h)], strict=True):
                if h[a] != core and size > 4 * tk.PIECE:
                    yield from group(pa.Table.from_batches(held).combine_chunks()).to_batches()
                    held, size = [], 0
                core = h[a]
                held.append(batch.slice(a, b - a))
                size += int(weight[a:b].sum()) + b - a
        if held:
            yield from group(pa.Table.from_batches(held).combine_chunks()).to_batches()

    fragments = _with_texts(slim, ranges, count).mapInArrow(cut, "d bigint, h bigint, low bigint, fragment binary")
    return fragments.repartition("h").sortWithinPartitions("h").mapInArrow(sort, "d bigint, low bigint, high bigint")


def repeated_spans(rows: DataFrame, count: int, *, length: int = 400, most: int = 64) -> DataFrame:
    """rows: (d, t), ``count`` buckets by d.  (d, low, high): runs of starts of repeated ``length``-byte strings; runs may repeat and touch."""
    slim = rows.select("d", "t").where(F.octet_length("t") >= length)
    runs = written(_anchor_rows(slim, length), "anchors")
    # written, so that the join below deals both sides anew and can split a hash that very many runs have
    again = written(runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    found, todo = [], written(runs.join(again, "h"), "runs")
    for width in widths_of(length):
        done, ranges, hot = _cut(_with_texts(slim, todo, count), length, width, most if width > 1 else 1 << 62)
        found.append(done)
        if width == 1:
            break
        ranges = written(ranges, "open")
        found.append(_sorted_groups(slim, ranges, length, count))
        todo = written(hot, "hot").select("d", "h", "at", "low", "high")
        if todo.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def remove_repeats(docs: DataFrame, *, text: str = "text", length: int = 400, most: int = 64, as_text: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text, and ``kept`` (the bytes left), ``removed`` (spans of bytes) and ``n_bytes``.

    With ``as_text``, ``kept`` is text: of a character that a cut goes through
    the bytes left are dropped too.  Every row is a document of its own, whatever
    its other columns hold (repeated or null ids); a null text is empty; texts
    shorter than ``length`` bytes stay whole; equal texts of that length all go.
    Columns called ``kept``, ``removed`` or ``n_bytes`` are replaced.  Builds its
    intermediate tables at once.
    """
    named = ["kept", "removed", "n_bytes"]
    docs = docs.drop(*named)
    others = [c for c in docs.columns if c != text]
    rows, count = dealt(docs, text)
    spans = repeated_spans(rows, count, length=length, most=most)
    starts = spans.repartition(count, "d").distinct().groupBy("d").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    numbers = [f"c{n}" for n in range(len(others))]
    fields = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(numbers, others, strict=True))
    out_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for i in range(0, batch.num_rows, 256):
                few = batch.slice(i, 256)
                kept, removed, sizes = [], [], []
                for t, runs in zip(few.column("t"), few.column("runs").to_pylist(), strict=True):
                    raw = (t.as_py() or "").encode()
                    cut: list[dict] = []
                    for r in sorted((r["low"], r["high"] + length) for r in runs or ()):
                        if cut and r[0] <= cut[-1]["end"]:
                            cut[-1]["end"] = max(cut[-1]["end"], r[1])
                        else:
                            cut.append({"start": r[0], "end": r[1]})
                    at, left = 0, []
                    for c in cut:
                        left.append(raw[at : c["start"]])
                        at = c["end"]
                    left.append(raw[at:])
                    kept.append("".join(x.decode(errors="ignore") for x in left) if as_text else b"".join(left))
                    removed.append(cut)
                    sizes.append(len(raw))
                yield pa.RecordBatch.from_arrays([*(few.column(n) for n in numbers), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(removed, out_type), pa.array(sizes, pa.int64())], names=[*numbers, *named])

    joined = rows.join(starts, "d", "left").select(*numbers, "t", "runs")
    made = joined.mapInArrow(run, f"{fields}{', ' if fields else ''}kept {'string' if as_text else 'binary'}, removed array<struct<start:bigint,end:bigint>>, n_bytes bigint")
    return made.select(*(F.col(n).alias(c) for n, c in zip(numbers, others, strict=True)), *named)

"""Operator 2: document fingerprints by randomised edit embedding.

All texts are walked with the same random bits: at step j of the walk the
character under the pointer is put out, and the bit of (j, character) decides
whether the pointer moves on.  After an edit two walks fall into step again, so
the Hamming distance of what they put out follows the edit distance.  A
fingerprint keeps a sample of the steps.  Every slot samples one step of the
walk's length by a sequence of record values, so texts of nearly equal length
sample nearly the same steps, and each step is as likely as any other.

The bits repeat every ``PERIOD`` steps; a slot keeps four bits of a hash of the
four characters at the pointer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import written

SLOTS = 256
PERIOD = 1 << 13
_SEED = 20240229
_LONGEST = 1 << 40


@lru_cache(maxsize=1)
def jumps() -> np.ndarray:
    """Steps from step j of the period until the pointer has left character class c: index c * PERIOD + j."""
    bits = np.random.default_rng(_SEED).integers(0, 2, size=(256, PERIOD), dtype=np.uint8).astype(bool)
    twice = np.concatenate([bits, bits], axis=1)
    nxt = np.full((256, 2 * PERIOD + 1), 4 * PERIOD, dtype=np.int32)
    for j in range(2 * PERIOD - 1, -1, -1):
        nxt[:, j] = np.where(twice[:, j], j, nxt[:, j + 1])
    return (nxt[:, :PERIOD] - np.arange(PERIOD) + 1).astype(np.int32).ravel()


@lru_cache(maxsize=1)
def records() -> np.ndarray:
    """For each slot the steps it would sample, in rising order: it samples the last one below the walk's length."""
    rng = np.random.default_rng(_SEED + 1)
    rows = []
    for _ in range(SLOTS):
        row, at = [0], 0
        while at < _LONGEST:
            at = int((at + 1) / max(rng.random(), 1e-9))
            if at > row[-1]:
                row.append(at)
        rows.append(row)
    width = max(map(len, rows))
    return np.array([r + [1 << 62] * (width - len(r)) for r in rows], dtype=np.int64)


@lru_cache(maxsize=1)
def salts() -> np.ndarray:
    return np.random.default_rng(_SEED + 2).integers(0, 1 << 63, size=SLOTS, dtype=np.uint64) | np.uint64(1)


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes (a hash of the code point to 8 bits) of all texts, and offsets."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mixed = code * np.uint32(2654435761)
    return ((code ^ (mixed >> np.uint32(24))) & np.uint32(255)).astype(np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def walk(code: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step at which the pointer reaches each character, and each walk's length; all texts move at once."""
    table, lengths = jumps(), np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    active = len(lengths) - np.searchsorted(lengths[order][::-1], np.arange(int(lengths.max(initial=0))), side="right")
    base, at = offsets[:-1][order], np.zeros(len(lengths), dtype=np.int64)
    reached = np.zeros(len(code), dtype=np.int64)
    wide = code.astype(np.int64) * PERIOD
    for i, m in enumerate(active.tolist()):
        place, now = base[:m] + i, at[:m]
        reached[place] = now
        now += table[wide[place] + (now & (PERIOD - 1))]
    total = np.zeros(len(lengths), dtype=np.int64)
    total[order] = at
    return reached, total


def fingerprints_of(texts: list[str]) -> list[str]:
    """One string of ``SLOTS`` hexadecimal digits for each text; equal texts have equal ones."""
    code, offsets = classes(texts)
    reached, total = walk(code, offsets)
    padded = np.concatenate([code, np.zeros(4, dtype=np.uint8)]).astype(np.uint64)
    steps, salt, out = records(), salts(), []
    for n, length in enumerate(total.tolist()):
        if not length:
            out.append("0" * SLOTS)
            continue
        a, b = int(offsets[n]), int(offsets[n + 1])
        sampled = np.take_along_axis(steps, (np.count_nonzero(steps < length, axis=1) - 1)[:, None], axis=1)[:, 0]
        pointer = a + np.searchsorted(reached[a:b], sampled, side="right") - 1
        symbol = np.zeros(SLOTS, dtype=np.uint64)
        for t in range(4):
            symbol = symbol * np.uint64(257) + np.where(pointer + t < b, padded[pointer + t] + np.uint64(1), np.uint64(0))
        symbol = (symbol ^ salt) * np.uint64(0x9E3779B97F4A7C15)
        symbol ^= symbol >> np.uint64(29)
        nibble = ((symbol * salt) >> np.uint64(60)).astype(np.uint8)
        out.append(((nibble[0::2] << 4) | nibble[1::2]).tobytes().hex())
    return out


def likeness_of(a: str, b: str) -> float:
    """Share of equal slots, less what chance gives: 0 to 1."""
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    return float(max(0.0, (np.count_nonzero(x == y) / SLOTS - 1 / 16) * 16 / 15))


def _pieces(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if len(texts) > start:
        yield start, len(texts)


def fingerprints(docs: DataFrame, *, text: str = "text", output: str = "fingerprint", piece_chars: int = 1 << 22) -> DataFrame:
    """All columns of ``docs`` but the text, and ``output``.  A null text counts as empty; an existing column ``output`` is replaced."""
    docs = docs.drop(output)
    others = [c for c in docs.columns if c != text]

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            made = [f for i, j in _pieces(texts, piece_chars) for f in fingerprints_of(texts[i:j])]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array(made, pa.string())], names=[*others, output])

    return docs.mapInArrow(run, ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others] + [f"`{output}` string"]))


def likeness(a: str, b: str) -> Column:
    """``likeness_of`` for two fingerprint columns, without Python."""
    equal = f"size(filter(sequence(1, {SLOTS}), i -> substr({a}, i, 1) = substr({b}, i, 1)))"
    return F.expr(f"greatest(0D, ({equal} / {SLOTS}D - 0.0625D) * 16D / 15D)")


def _nibbles(prints: list[str]) -> np.ndarray:
    return np.frombuffer("".join(prints).encode(), dtype=np.uint8).reshape(-1, SLOTS)


def band_links(prints: DataFrame, *, id: str = "doc_id", fingerprint: str = "fingerprint", bands: int = 32, least: float = 0.8, block: int = 512) -> DataFrame:
    """(id, other, likeness): links between distinct fingerprints of at least ``least`` likeness that share a band, enough to connect all of them.

    A band is a run of neighbouring slots (slots sample independent steps);
    equal fingerprints are grouped first, each group stands as its smallest id.
    First every member of a bucket is compared with the bucket's smallest id, n
    - 1 candidates for n members.  Buckets whose members are then of several
    components are compared whole: all members outside of the largest component
    with all members, in blocks of at most about ``block`` that large buckets
    are split into.  Rows without an id or fingerprint have no links; rows with
    one id and several fingerprints are left to the smallest.
    """
    kind = prints.schema[id].dataType.simpleString()
    width = SLOTS // bands
    one = written(_classes(prints, id, fingerprint).groupBy("f").agg(F.min("i").alias("i")), "prints")
    banded = one.select("i", F.posexplode(F.expr(f"transform(sequence(0, {bands - 1}), b -> xxhash64(b, substr(f, b * {width} + 1, {width})))")).alias("n", "v")).select("i", "n", "v")
    leaders = banded.groupBy("v").agg(F.min("i").alias("l"), F.count("*").alias("all")).where("`all` > 1")
    shared = written(banded.join(leaders, "v"), "shared")
    pairs = shared.where("i <> l").select("i", "l").distinct()
    near = pairs.join(one.select("i", F.col("f").alias("fi")), "i").join(one.select(F.col("i").alias("l"), F.col("f").alias("fl")), "l")
    near = written(near.select("i", F.col("l").alias("o"), likeness("fi", "fl").alias("likeness")).where(F.col("likeness") >= least), "near")

    parts = components(near, "i", "o")
    members = shared.where("`all` > 2").join(parts, shared["i"] == parts["node"], "left").select("n", "v", "i", F.coalesce("component", "i").alias("c"))
    counts = members.groupBy("v", "c").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("v").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("kinds")).where("kinds > 1")
    buckets = buckets.select("v", "main", F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("sb"), F.ceil(F.col("all") / block).cast("int").alias("mb"))
    open_ = written(members.join(buckets, "v"), "members").join(one, "i")
    block_of = lambda n: F.pmod(F.xxhash64("i"), n).cast("int")
    seekers = open_.where("c <> main").select("v", "n", "i", "c", "f", F.lit(True).alias("seeks"), block_of(F.col("sb")).alias("s"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"))
    others = open_.select("v", "n", "i", "c", "f", F.lit(False).alias("seeks"), F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("s"), block_of(F.col("mb")).alias("m"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        prints, band = _nibbles(group.column("f").to_pylist()), group.column("n")[0].as_py()
        c, ids = group.column("c").combine_chunks().dictionary_encode().indices.to_numpy().copy(), group.column("i")
        seeks, found = group.column("seeks").to_numpy(zero_copy_only=False), []
        right = np.flatnonzero(~seeks)
        for i in np.flatnonzero(seeks):
            mine = right[c[right] != c[i]]
            equal = prints[mine] == prints[i]
            value = np.maximum(0.0, (equal.sum(axis=1) / SLOTS - 1 / 16) * 16 / 15)
            # a pair belongs to the first band that it shares
            first = equal[:, : (band + 1) * width].reshape(len(mine), band + 1, width).all(axis=2).argmax(axis=1) == band
            for at in np.flatnonzero(first & (value >= least)):
                j = mine[at]
                if c[j] != c[i]:
                    found.append((i, j, value[at]))
                    c[c == c[j]] = c[i]
        rows = [pa.array([x[n] for x in found], t) for n, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))]
        return pa.table([ids.take(rows[0]), ids.take(rows[1]), rows[2]], names=["i", "o", "likeness"])

    rest = seekers.unionByName(others).groupBy("v", "s", "m").applyInArrow(compare, f"i {kind}, o {kind}, likeness double").dropDuplicates(["i", "o"])
    return near.unionByName(written(rest, "rest")).select(F.col("i").alias(id), F.col("o").alias("other"), "likeness")


def _classes(prints: DataFrame, id: str, fingerprint: str) -> DataFrame:
    known = prints.where(F.col(fingerprint).isNotNull() & F.col(id).isNotNull())
    return known.groupBy(F.col(id).alias("i")).agg(F.min(fingerprint).alias("f"))


def near_classes(prints: DataFrame, *, id: str = "doc_id", fingerprint: str = "fingerprint", least: float = 0.8) -> DataFrame:
    """(id, class_id, n_links): for each id with a fingerprint the smallest id that links reach, itself included, and how many links found name its fingerprint."""
    rows = written(_classes(prints, id, fingerprint), "classes")
    links = written(band_links(rows.select(F.col("i").alias(id), F.col("f").alias(fingerprint)), id=id, fingerprint=fingerprint, least=least), "links")
    parts = components(links, id, "other")
    degree = links.select(F.explode(F.array(id, "other")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    stands = rows.groupBy("f").agg(F.min("i").alias("r"))
    found = stands.join(parts, stands["r"] == parts["node"], "left").drop("node").join(degree, F.col("r") == degree["node"], "left")
    found = found.select("f", F.coalesce("component", "r").alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
    return rows.join(found, "f").select(F.col("i").alias(id), "class_id", "n_links")


def _range_of(bounds: list, kind: str) -> Column:
    """How many of the sorted bounds are above d: first among every so many of them, then within those."""
    if not bounds:
        return F.lit(0)
    some = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + some] for i in range(0, len(bounds), some)]
    typed = lambda values: F.array(*(F.lit(v).cast(kind) for v in values))
    below = lambda values: F.size(F.filter(values, lambda x: x <= F.col("d")))
    row = F.greatest(below(typed([r[0] for r in rows])) - 1, F.lit(0))
    return len(bounds) - row * some - below(F.element_at(F.array(*map(typed, rows)), row + 1))


def edited_probe(docs: DataFrame, *, id: str = "doc_id", text: str = "text", part_bytes: int = 6 << 20) -> DataFrame:
    """Each text against an edited one, whose last third is taken from the next document by descending id.

    Ids may be of any type that has an order.  Documents are dealt to ranges of
    ids and sorted there; the first document of every range is also sent to the
    range before it, so no document needs more than its own range.  Rows with
    equal ids follow one another by text; rows without an id are left out, as
    they have no place in the order.  There are 65,536 ranges at most: a range
    is a sorted stream, so its size is not bound to memory, and its borders are
    literals in the plan.  Runs the jobs that find them at once.
    """
    kind = docs.schema[id].dataType.simpleString()
    slim = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    total = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = min(1 << 16, max(1, -(-total // part_bytes)))
    firsts = slim.select("d").repartitionByRange(count, "d").groupBy(F.spark_partition_id()).agg(F.min("d").alias("d")).collect() if count > 1 else []
    dealt = slim.withColumn("p", _range_of(sorted(r["d"] for r in firsts)[1:], kind).cast("int"))
    first = {r["p"]: r["d"] for r in dealt.groupBy("p").agg(F.max("d").alias("d")).collect()}  # a number for each range
    ranges = sorted(first)
    if ranges:
        before = dict(zip(ranges, [ranges[-1], *ranges[:-1]], strict=True))
        # only the first document of its own range goes to another one as well
        is_first = F.element_at(F.array(*(F.lit(first.get(p, first[ranges[0]])).cast(kind) for p in range(ranges[-1] + 1))), F.col("p") + 1) == F.col("d")
        to = F.when(is_first, F.element_at(F.array(*(F.lit(before.get(p, 0)) for p in range(ranges[-1] + 1))), F.col("p") + 1))
        dealt = dealt.select("d", "t", F.explode(F.filter(F.array(F.struct("p", F.lit(False).alias("copy")), F.struct(to.alias("p"), F.lit(True).alias("copy"))), lambda x: x["p"].isNotNull())).alias("x")).select("x.p", "x.copy", "d", "t")
    else:
        dealt = dealt.select("p", F.lit(False).alias("copy"), "d", "t")
    dealt = dealt.repartitionByRange(max(1, len(ranges)), "p").sortWithinPartitions("p", "copy", F.col("d").desc(), "t")

    id_type = None

    def probe(rows: list[tuple], out: list[str]) -> pa.RecordBatch:
        """rows: documents in order, each but the last with its successor behind it."""
        edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for (_, t), (_, u) in zip(rows, rows[1:], strict=False)]
        prints, changed = fingerprints_of([t for _, t in rows]), fingerprints_of(edited)
        near = [[likeness_of(f, g) for f, g in zip(prints, x, strict=False)] for x in (changed, prints[1:])]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows[:-1]], id_type), pa.array([len(t) for _, t in rows[:-1]], pa.int64()), pa.array(edited, pa.string()), pa.array(prints[:-1], pa.string()), pa.array(changed, pa.string()), *(pa.array(x, pa.float64()) for x in near)], names=out)

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        out = ["d", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held, size, now, copied = [], 0, None, False
        for batch in arrow:
            for i in range(0, batch.num_rows, 256):
                few, id_type = batch.slice(i, 256).to_pydict(), batch.schema.field("d").type
                for p, copy, d, t in zip(few["p"], few["copy"], few["d"], few["t"], strict=True):
                    if p != now:  # the range before ended with its copy
                        if len(held) > 1:
                            yield probe(held, out)
                        held, size, now, copied = [], 0, p, False
                    if copied:
                        continue
                    copied = copy
                    held.append((d, t))
                    size += len(t)
                    if size >= 1 << 22 and not copy:
                        if len(held) > 1:
                            yield probe(held, out)
                            held, size = held[-1:], len(t)
        if len(held) > 1:
            yield probe(held, out)

    made = dealt.mapInArrow(run, f"d {kind}, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.withColumnRenamed("d", id)

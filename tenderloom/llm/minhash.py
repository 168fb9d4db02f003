"""Operator 6: near duplicates by MinHash bands and sequential Bayesian verification.

1.  Equal shingle sets are grouped; one document stands for each group.
2.  Banded signatures give buckets; every member of a bucket is compared with
    the bucket's smallest id, so n members give n - 1 candidates.
3.  Signatures are compared batch by batch; a pair is dropped as soon as the
    posterior probability that its similarity reaches the threshold falls under
    ``miss`` (uniform prior).  What is left is verified on the whole sets.
4.  Pairs that step 2 does not compare matter only where a bucket's members
    are not yet one component.  In such buckets all members outside of the most
    frequent component are compared with all members, in blocks of bounded size
    that large buckets are split into: first by signatures alone; texts are
    fetched only for the members of a block that the signatures leave a partner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import components
from .store import written

U64 = np.uint64
ROWS, BANDS = 4, 30
HASHES = ROWS * BANDS
STEP = 24
_SEEDS = tk.mix(np.arange(1, 2 * HASHES + 1, dtype=U64) * U64(0x8CB92BA72F3D8DD7))
_MULTIPLY = (_SEEDS[:HASHES] >> U64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (_SEEDS[HASHES:] >> U64(32)).astype(np.uint32)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over each set: sets x HASHES; sets must not be empty."""
    short = (values >> U64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    out = np.empty((len(bounds) - 1, HASHES), dtype=np.uint32)
    if len(bounds) > 1:
        for h in range(HASHES):
            x = short * _MULTIPLY[h] + _ADD[h]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            out[:, h] = np.minimum.reduceat(x, bounds[:-1])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(U64)
    key = np.full(rows.shape[:2], 0, dtype=U64) + np.arange(1, BANDS + 1, dtype=U64) * U64(0xA24BAED4963EE407)
    for r in range(ROWS):
        key = tk.mix(key ^ rows[:, :, r]) * U64(0x9FB21C651E98DF25)
    return key.astype(np.int64)


def least_matches(threshold: float, miss: float) -> np.ndarray:
    """For each number of compared hashes (multiples of STEP): the fewest matches that are not dropped."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        # P(similarity >= t | m of n match), uniform prior: the Beta(m + 1, n - m + 1) tail is a binomial sum
        tail = [sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1)) for m in range(n + 1)]
        out.append(next((m for m in range(n + 1) if tail[m] >= miss), n))
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Indices of the pairs of signatures (row by row) that no batch drops."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for n, fewest in enumerate(least):
        part = slice(n * STEP, (n + 1) * STEP)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
        keep = matches >= fewest
        alive, matches = alive[keep], matches[keep]
    return alive


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and their bounds."""
    data, offsets = tk.buffers(texts)
    values, bounds = [], [np.zeros(1, dtype=np.int64)]
    for i, j in tk.pieces(offsets, tk.PIECE):
        low = tk.LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, counts = tk.word_bounds(low, offsets[i : j + 1] - offsets[i], tk.NOT_SPACE)
        v, b = tk.shingles(tk.word_hashes(low, starts, ends), counts, k)
        values.append(v)
        bounds.append(b[1:] + bounds[-1][-1])
    return np.concatenate(values) if values else np.zeros(0, dtype=U64), np.concatenate(bounds)


FEATURES = "n bigint, s1 bigint, s2 bigint, signature binary"
#: Up to so many bytes of ids are sent to all tasks, to move only the texts that are needed; beyond, the join itself selects them.
MOST_BYTES = 8 << 20


def features(docs: DataFrame, k: int) -> DataFrame:
    """docs: (d, t).  Set size, a digest of the set, and the signature, which is null for an empty set."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for start in range(0, batch.num_rows, 250):
                few = batch.slice(start, 250)
                values, bounds = shingle_sets(few.column(1), k)
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                total = np.concatenate([np.zeros((1, 2), dtype=U64), np.cumsum(np.stack([tk.mix(values), tk.mix(values ^ U64(0x5851F42D4C957F2D))], axis=1), axis=0, dtype=U64)])
                digest = (total[bounds[1:]] - total[bounds[:-1]]).astype(np.int64)
                signature = signatures(values, np.append(bounds[:-1][full], bounds[-1]))
                packed = [None] * len(size)
                for i, n in enumerate(full):
                    packed[n] = signature[i].tobytes()
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(size), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(packed, pa.binary())], names=["d", "n", "s1", "s2", "signature"])

    return docs.mapInArrow(run, f"d {docs.schema['d'].dataType.simpleString()}, {FEATURES}")


def banded(signed: DataFrame) -> DataFrame:
    """(d, band, k): each document in the bucket of each of its bands."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            if batch.num_rows:
                keys = band_keys(_matrix(batch.column(1)))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(keys))), pa.array(keys.ravel())], names=["d", "band", "k"])

    return signed.select("d", "signature").mapInArrow(run, f"d {signed.schema['d'].dataType.simpleString()}, band int, k bigint")


def wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose d is in ``ids`` (d): selected before any shuffle where the ids are few enough to be sent.

    The result is the same either way: what follows joins on d.
    """
    width = ids.select(F.sum(F.octet_length(F.col("d").cast("string")) + 8)).first()[0] or 0
    return docs.join(F.broadcast(ids), "d", "left_semi") if width <= MOST_BYTES else docs


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, HASHES)


def prune(pairs: DataFrame, signed: DataFrame, least: np.ndarray) -> DataFrame:
    """pairs: (d, l).  Those that the signatures don't rule out."""
    kind = pairs.schema["d"].dataType.simpleString()
    left, right = signed.select("d", F.col("signature").alias("p")), signed.select(F.col("d").alias("l"), F.col("signature").alias("q"))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            if batch.num_rows:
                at = pa.array(survivors(_matrix(batch.column(2)), _matrix(batch.column(3)), least))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["d", "l"])

    return pairs.join(left, "d").join(right, "l").select("d", "l", "p", "q").mapInArrow(run, f"d {kind}, l {kind}")


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int, part: int = 64) -> DataFrame:
    """pairs: (d, l), no pair twice.  Those whose whole sets share ``percent`` per cent of their union.

    The texts of all d of an l meet with l's own, in parts of about ``part``
    texts: an l with very many d is many groups.
    """
    kind = pairs.schema["d"].dataType.simpleString()
    parts = pairs.groupBy("l").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    heads = parts.select(F.col("l").alias("d"), "l", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("head"))
    tails = pairs.join(parts, "l").select("d", "l", F.pmod(F.xxhash64("d"), "parts").cast("int").alias("part"), F.lit(False).alias("head"))
    asked = heads.unionByName(tails)
    docs = wanted(docs, written(asked.select("d").distinct(), "ids"))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        head = np.flatnonzero(group.column("head").to_numpy(zero_copy_only=False))[0]
        values, bounds = shingle_sets(group.column("t").combine_chunks(), k)
        sets = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        first, linked = sets[head], []
        for i, s in enumerate(sets):
            if i != head and similar(first, s, percent):
                linked.append(i)
        return group.select(["d", "l"]).take(pa.array(linked, pa.int64()))

    return asked.join(docs, "d").select("d", "l", "part", "head", "t").groupBy("l", "part").applyInArrow(run, f"d {kind}, l {kind}")


def remaining_links(shared: DataFrame, parts: DataFrame, signed: DataFrame, docs: DataFrame, k: int, percent: int, least: np.ndarray, block: int = 256) -> DataFrame:
    """(d, l): links that join components among buckets whose members are of several.  shared: (d, band, k) of buckets of three and more."""
    kind = shared.schema["d"].dataType.simpleString()
    members = shared.join(parts, shared["d"] == parts["node"], "left").select("band", "k", "d", F.coalesce("component", "d").alias("c"))
    counts = members.groupBy("k", "c").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("k").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("kinds")).where("kinds > 1")
    buckets = buckets.select("k", "main", F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("sb"), F.ceil(F.col("all") / block).cast("int").alias("mb"))
    open_ = written(members.join(buckets, "k").select("band", "k", "d", "c", "main", "sb", "mb"), "members").join(signed, "d")
    block_of = lambda n: F.pmod(F.xxhash64("d"), n).cast("int")
    own = ["band", "k", "d", "c", "signature"]
    seekers = open_.where("c <> main").select(*own, F.lit(True).alias("seeks"), block_of(F.col("sb")).alias("s"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"))
    others = open_.select(*own, F.lit(False).alias("seeks"), F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("s"), block_of(F.col("mb")).alias("m"))

    def partners(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """(row that seeks, rows of other components that the signatures leave it, likeliest first); a pair belongs to the first band that it shares."""
        band = group.column("band")[0].as_py()
        signature = _matrix(group.column("signature"))
        c = group.column("c").combine_chunks().dictionary_encode().indices.to_numpy()
        seeks = group.column("seeks").to_numpy(zero_copy_only=False)
        right = np.flatnonzero(~seeks)
        for i in np.flatnonzero(seeks):
            mine = right[c[right] != c[i]]
            mine = mine[survivors(np.broadcast_to(signature[i], (len(mine), HASHES)), signature[mine], least)]
            equal = signature[mine] == signature[i]
            first = equal[:, : (band + 1) * ROWS].reshape(len(mine), band + 1, ROWS).all(axis=2).argmax(axis=1) == band
            mine, equal = mine[first], equal[first]
            if len(mine):
                yield i, mine[np.argsort(-equal.sum(axis=1), kind="stable")]

    def prune_block(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keep = np.zeros(group.num_rows, dtype=bool)
        for i, mine in partners(group):
            keep[i] = True
            keep[mine] = True
        return group.filter(pa.array(keep))

    schema = f"band int, k bigint, d {kind}, c {kind}, signature binary, seeks boolean, s int, m int"
    left = written(seekers.unionByName(others).groupBy("k", "s", "m").applyInArrow(prune_block, schema), "left")
    texts = wanted(docs, written(left.select("d").distinct(), "ids"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        c, d = group.column("c").combine_chunks().dictionary_encode().indices.to_numpy().copy(), group.column("d").to_pylist()
        values, bounds = shingle_sets(group.column("t").combine_chunks(), k)
        sets, found = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], []
        for i, mine in partners(group):
            for j in mine:
                if c[j] != c[i] and similar(sets[i], sets[j], percent):
                    found.append((d[i], d[j]))
                    c[c == c[j]] = c[i]
        return pa.table([pa.array([x for x, _ in found], group.schema.field("d").type), pa.array([y for _, y in found], group.schema.field("d").type)], names=["d", "l"])

    return left.join(texts, "d").groupBy("k", "s", "m").applyInArrow(compare, f"d {kind}, l {kind}").distinct()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share ``percent`` per cent of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    shared = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, miss: float = 1e-5) -> DataFrame:
    """Per document: its id, ``n_shingles``, ``component_id`` and ``kept`` (its id is the smallest of its component).

    Links: 100 * shared >= percent * union, over sets of distinct word
    shingles.  Null or empty texts have no shingles and no links; equal texts
    are linked.  Ids are to be unique: rows with one id count as one node.  Rows
    without an id keep a null component and are kept.
    """
    slim = docs.select(F.col(id).alias("d"), F.col(text).cast("string").alias("t"))
    least = least_matches(percent / 100, miss)
    made = written(features(slim, shingle), "features")
    full = made.where("n > 0 and d is not null")
    # one document for each set, with its signature
    classes = written(full.groupBy("s1", "s2", "n").agg(F.min(F.struct("d", "signature")).alias("r")).select("s1", "s2", "n", F.col("r.d").alias("d"), F.col("r.signature").alias("signature")), "classes")
    member = written(full.select("d", "s1", "s2", "n").join(classes.select("s1", "s2", "n", F.col("d").alias("r")), ["s1", "s2", "n"]).select("d", "r"), "member")
    signed = classes.select("d", "signature")
    placed = banded(signed)
    leaders = placed.groupBy("k").agg(F.min("d").alias("l"), F.count("*").alias("n")).where("n > 1")
    shared = written(placed.join(leaders, "k"), "shared")
    texts = slim.where("d is not null")
    candidates = written(prune(shared.where("d <> l").select("d", "l").distinct(), signed, least), "candidates")
    links = written(verify(candidates, texts, shingle, percent), "verified")
    rest = remaining_links(shared.where("n > 2").select("d", "band", "k"), components(links, "d", "l"), signed, texts, shingle, percent, least)
    links = links.unionByName(written(rest, "rest"))
    parts = components(links, "d", "l")
    found = member.join(parts, member["r"] == parts["node"], "left").groupBy("d").agg(F.min(F.coalesce("component", "r")).alias("c"))
    out = made.select("d", "n").join(found, "d", "left").select(F.col("d").alias(id), F.col("n").alias("n_shingles"), F.coalesce("c", "d").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))

"""Operator 7: a word bigram model with deleted interpolation.

The probability of a word after another one mixes three estimates: the relative
frequency of the pair, the smoothed frequency of the word, and a uniform one.
The mixture weights depend on how often the first word was seen (buckets of
powers of two) and are learned by expectation-maximisation on the counts of a
held-out tenth of the training documents, with frequencies from the rest.

Layout.  Documents are dealt to blocks of a few MB.  A block sends one row for
each bucket of hash values: its distinct words and pairs that fall there, with
their counts.  A bucket adds them up and answers each block with the totals,
in the order asked.  So what is shuffled is one entry for each distinct word or
pair of a block, however often it occurs, and no bucket holds more than its
share of the distinct words and pairs; a very common word is one entry a block.
There are ``PER_BUCKET`` blocks for each bucket, so a bucket's entries are
bounded, and blocks and buckets are dealt to as many tasks as hold a few of them.
The entries grow with the text; the rows that hold them are blocks times buckets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import written

U64 = np.uint64
END, START = U64(0x1F83D9ABFB41BD6B), U64(0x5BE0CD19137E2179)
ADD = 0.1
#: Blocks for each bucket, and blocks in a task (on average).
PER_BUCKET, PER_TASK = 4, 2
#: Steps of a factor of two in the table on which the weights are learned.
STEPS = 8
COUNTS = "kind int, bucket int, block bigint, keys binary, rest binary, held binary"
ANSWERS = "kind int, block bigint, bucket int, rest binary, total binary, sums array<bigint>"


def stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, each document's words and then its end; of the pairs with the token before; tokens before each document."""
    parts = []
    data, offsets = tk.buffers(texts)
    for i, j in tk.pieces(offsets, tk.PIECE):
        low = tk.LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, counts = tk.word_bounds(low, offsets[i : j + 1] - offsets[i], tk.NOT_SPACE)
        words = tk.word_hashes(low, starts, ends)
        bounds = counts + np.arange(len(counts))
        tokens = np.full(bounds[-1], END, dtype=U64)
        tokens[np.arange(len(words)) + np.searchsorted(counts[1:], np.arange(len(words)), side="right")] = words
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[bounds[:-1]] = START
        parts.append((tokens, before, np.diff(bounds)))
    if not parts:
        none = np.zeros(0, dtype=U64)
        return none, none, np.zeros(1, dtype=np.int64)
    tokens, before, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
    return tokens, before, np.concatenate([[0], np.cumsum(lengths)])


def pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return tk.mix(before * U64(0x9E3779B97F4A7C15) + token)


class Block:
    """The distinct words (and contexts) and pairs of a block, in the order of bucket and hash."""

    def __init__(self, texts: pa.Array, buckets: int):
        self.tokens, self.before, self.bounds = stream(texts)
        self.keys, self.index = [], []
        for values in (self.tokens, pair(self.before, self.tokens)):
            key, inverse = np.unique(values, return_inverse=True)
            bucket = (key % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            self.keys.append((key[order], bucket[order]))
            self.index.append(place[inverse])

    def context(self) -> np.ndarray:
        """Place of each token's context among the words; -1 for the start of a document."""
        out = np.full(len(self.tokens), -1, dtype=np.int64)
        out[1:] = self.index[0][:-1]
        out[self.bounds[:-1]] = -1
        return out


def _counts_of(frame: pa.Table, buckets: int) -> pa.Table:
    """What a block asks, and the places of its held-out tokens (kind 2)."""
    block = Block(frame.column("t").combine_chunks() if frame.num_rows else pa.array([], pa.string()), buckets)
    fold = frame.column("fold").to_numpy()
    by_token = np.repeat(fold, np.diff(block.bounds))
    number, rows = frame.column("block")[0].as_py(), []
    for kind in (0, 1):
        key, bucket = block.keys[kind]
        rest = np.bincount(block.index[kind][by_token > 1], minlength=len(key))
        held = np.bincount(block.index[kind][by_token == 1], minlength=len(key))
        ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1 if len(bucket) else []
        start = 0
        for end in ends:
            rows.append((kind, int(bucket[start]), number, tk.pack_sorted(key[start:end]), tk.pack(rest[start:end]), tk.pack(held[start:end])))
            start = end
    mine = by_token == 1
    places = tk.pack(np.concatenate([block.index[1][mine], block.index[0][mine], block.context()[mine] + 1]))
    rows.append((2, number % buckets, number, places, b"", b""))
    # a document's first token has the start as context, whose count is the number of documents
    rows.append((3, number % buckets, number, np.array([np.count_nonzero(fold > 1), np.count_nonzero(fold > 0)], dtype="<u8").tobytes(), b"", b""))
    return pa.Table.from_pandas(pd.DataFrame(rows, columns=["kind", "bucket", "block", "keys", "rest", "held"]).astype({"kind": "int32", "bucket": "int32", "block": "int64"}), schema=pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("rest", pa.binary()), ("held", pa.binary())]), preserve_index=False)


_ANSWER = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("rest", pa.binary()), ("total", pa.binary()), ("sums", pa.list_(pa.int64()))])


def _add_up(asked: pa.Table) -> pa.Table:
    """Totals of a bucket; kind 4: tokens and distinct tokens of this bucket, without and with the held-out ones."""
    kind, bucket = asked.column("kind")[0].as_py(), asked.column("bucket")[0].as_py()
    blocks = asked.column("block").to_pylist()
    if kind >= 2:
        rows = [(kind, b, bucket, k.as_py(), b"", np.frombuffer(k.as_py(), "<i8").tolist() if kind == 3 else None) for b, k in zip(blocks, asked.column("keys"), strict=True)]
    else:
        keys = [tk.unpack_sorted(x.as_py()) for x in asked.column("keys")]
        rest, held = ([tk.unpack(x.as_py()) for x in asked.column(n)] for n in ("rest", "held"))
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate(rest)), np.bincount(place, weights=np.concatenate(rest) + np.concatenate(held))
        rows, start = [], 0
        for b, k in zip(blocks, keys, strict=True):
            mine = place[start : start + len(k)]
            rows.append((kind, b, bucket, *(tk.pack(t[mine].astype("<u8")) for t in totals), None))
            start += len(k)
        if kind == 0:
            rows.append((4, -1, bucket, b"", b"", [int(x) for t in totals for x in (t.sum(), np.count_nonzero(t))]))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ANSWER, strict=True)], schema=_ANSWER)


def _answers(rows: list[dict], column: str) -> list[np.ndarray]:
    """Counts of words and of pairs, in the order in which the block asked."""
    out = []
    for kind in (0, 1):
        mine = sorted((r["bucket"], r[column]) for r in rows if r["kind"] == kind)
        out.append(np.concatenate([tk.unpack(x) for _, x in mine] or [np.zeros(0)]).astype("f8"))
    return out


def estimates(single: np.ndarray, double: np.ndarray, starts: float, total: float, distinct: float, words, pairs, contexts) -> tuple[np.ndarray, ...]:
    """Of each token: bucket of its context, and the probabilities by pair, word and uniform."""
    context = np.where(contexts < 0, starts, single[np.maximum(contexts, 0)] if len(single) else starts)
    by_pair = np.divide(double[pairs], context, out=np.zeros(len(pairs)), where=context > 0)
    bucket = np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)
    by_word = (single[words] + ADD) / (total + ADD * (distinct + 1))
    return bucket, by_pair, by_word, np.full(len(pairs), 1 / (distinct + 1))


def learn_weights(cells: list[tuple[int, float, float, float]], uniform: float, rounds: int = 40) -> dict[int, list[float]]:
    """Weights of pair, word and uniform for each bucket, from (bucket, pair, word, count); -1: all buckets together."""
    table = np.array(cells, dtype="f8").reshape(-1, 4)
    out = {}
    for bucket in [-1, *np.unique(table[:, 0]).astype(int).tolist()]:
        mine = table if bucket < 0 else table[table[:, 0] == bucket]
        if not len(mine):
            out[bucket] = [0.6, 0.3, 0.1]
            continue
        each = np.stack([mine[:, 1], mine[:, 2], np.full(len(mine), uniform)])
        weight = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = weight[:, None] * each
            share /= share.sum(axis=0)
            weight = (share * mine[:, 3]).sum(axis=1) / mine[:, 3].sum()
        weight = np.maximum(weight, 1e-6)
        out[bucket] = (weight / weight.sum()).tolist()
    return out


def model_scores(docs: DataFrame, *, held_out: Column, id: str = "doc_id", text: str = "text", deleted: Column | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """Per document: its id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    ``held_out`` documents are not learned from; of the others, those with
    ``deleted`` (by default a tenth, by a hash of the id) give the held-out
    counts for the weights.  Null texts are empty: one token, the end.  Rows
    with equal or null ids are documents of their own.  Without any training
    document all estimates are uniform.  Further columns are ignored.
    """
    kind = docs.schema[id].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    deleted = (F.pmod(F.xxhash64(F.col(id)), F.lit(10)) == 0) if deleted is None else deleted
    fold = F.when(F.coalesce(held_out, F.lit(False)), 0).when(F.coalesce(deleted, F.lit(False)), 1).otherwise(2)
    slim = docs.select(F.col(id).alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), fold.cast("int").alias("fold"))
    slim = slim.withColumn("block", F.pmod(F.xxhash64("d", "t"), F.lit(blocks)).cast("long"))
    buckets, tasks = -(-blocks // PER_BUCKET), -(-blocks // PER_TASK)
    slim = slim.repartition(tasks, "block")

    asked = slim.groupBy("block").applyInArrow(lambda frame: _counts_of(frame, buckets), COUNTS)
    answers = written(asked.repartition(4 * buckets, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(_add_up, ANSWERS), "counts")

    # as many small rows as buckets and blocks
    sums = answers.where("kind in (3, 4)").groupBy("kind").agg(*(F.sum(F.get("sums", F.lit(i))).alias(str(i)) for i in range(4)))
    sums = {r["kind"]: [float(x or 0) for x in r[1:]] for r in sums.collect()}
    starts, tokens = sums.get(3, [0.0] * 4)[:2], (sums.get(4, [0.0] * 4)[:2], sums.get(4, [0.0] * 4)[2:])

    def cells(frame: pa.Table) -> pa.Table:
        rows = frame.to_pylist()
        pairs, words, contexts = tk.unpack(next(r["rest"] for r in rows if r["kind"] == 2)).astype(np.int64).reshape(3, -1)
        contexts = contexts - 1
        bucket, by_pair, by_word, _ = estimates(*_answers(rows, "rest"), starts[0], *tokens[0], words, pairs, contexts)
        step = [np.where(p > 0, np.round(np.log2(np.where(p > 0, p, 1)) * STEPS), 1).astype(np.int64) for p in (by_pair, by_word)]
        key, n = np.unique(np.stack([bucket, *step]), axis=1, return_counts=True)
        return pa.table([*(pa.array(k, pa.int64()) for k in key), pa.array(n, pa.int64())], names=["b", "p", "w", "n"])

    # a cell for each step of both probabilities and bucket: bounded by the steps, not by the corpus
    grid = answers.where("kind <= 2").select("kind", "block", "bucket", "rest").repartition(tasks, "block").groupBy("block").applyInArrow(cells, "b bigint, p bigint, w bigint, n bigint").groupBy("b", "p", "w").agg(F.sum("n").alias("n"))
    value = lambda x: 0.0 if x == 1 else 2.0 ** (x / STEPS)
    uniform = 1 / (tokens[0][1] + 1)
    weights = learn_weights([(r["b"], value(r["p"]), value(r["w"]), r["n"]) for r in grid.collect()], uniform)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.column("t").combine_chunks(), buckets)
        single, double = _answers(right.to_pylist(), "total")
        bucket, by_pair, by_word, flat = estimates(single, double, starts[1], *tokens[1], block.index[0], block.index[1], block.context())
        top = int(bucket.max(initial=0)) + 1
        table = np.array([weights.get(b, weights[-1]) for b in range(top)])
        mixed = table[bucket].T.copy()
        mixed[0][by_pair == 0] = 0
        none = bucket == 0  # no pair estimate: the other weights share what it would have had
        mixed[:, none] /= np.maximum(mixed[1:, none].sum(axis=0), 1e-12)
        mixed[0][none] = 0
        logs = [np.log10(mixed[0] * by_pair + mixed[1] * by_word + mixed[2] * flat), np.log10(by_word), single[block.index[0]] > 0]
        model, base, known = (np.add.reduceat(x.astype("f8"), block.bounds[:-1]) if len(x) else np.zeros(0) for x in logs)
        return pa.table([left.column("d"), pa.array(left.column("fold").to_numpy() == 0), pa.array(np.diff(block.bounds)), pa.array(known.astype(np.int64)), pa.array(np.full(len(model), int(tokens[1][0]))), pa.array(base), pa.array(model)], names=OUTPUT)

    schema = f"d {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    right = answers.where("kind < 2").select("kind", "block", "bucket", "total").repartition(tasks, "block")
    return slim.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(score, schema).withColumnRenamed("d", id)


OUTPUT = ["d", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


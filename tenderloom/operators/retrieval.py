"""Text retrieval: hashed sparse embeddings and top-k by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 1536


def embed(df: DataFrame, key: str, text: str, *, unit: bool = False, most: int = 4000) -> DataFrame:
    """(key, bucket, weight) of each row: words at two places, neighbouring pairs at one, added up; of unit length if asked.

    A row's words, pairs and sums need nothing else than the row: one pass over
    Arrow batches, no shuffle.  Rows with equal keys are embedded each; a text
    without words has no rows.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for i in range(0, batch.num_rows, 256):
                few = batch.slice(i, 256)
                row, bucket, weight = _places([t or "" for t in few.column(1).to_pylist()], most)
                if unit:
                    norm = np.sqrt(np.bincount(row, weight * weight, minlength=few.num_rows))
                    weight = weight / np.where(norm > 0, norm, 1.0)[row]
                yield pa.RecordBatch.from_arrays([few.column(0).take(pa.array(row)), pa.array(bucket.astype(np.int32)), pa.array(weight)], names=[key, "bucket", "weight"])

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, bucket int, weight double")


def unit(embedded: DataFrame, key: str) -> DataFrame:
    """Weights already added up, made of unit length."""
    norms = embedded.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_n"))
    return embedded.join(norms, key).select(key, "bucket", (F.col("weight") / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0)).alias("weight"))


_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x30:0x3A] = _LETTER[0x61:0x7B] = True


def _hash_on(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """32-bit FNV-1a of each run of bytes, going on from ``state``."""
    state = state.copy()
    order = np.argsort(-size, kind="stable")
    longest = int(size.max(initial=0))
    active = len(size) - np.searchsorted(size[order][::-1], np.arange(longest), side="right")
    for n, m in enumerate(active.tolist()):
        mine = order[:m]
        state[mine] = ((state[mine] ^ data[start[mine] + n]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    return state


def _places(texts: list[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of all texts, sorted, each row and bucket once."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), dtype=np.uint8)
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
    inside = np.concatenate([[False], _LETTER[data], [False]])
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    long = end - start >= 2
    start, size = start[long], (end - start)[long]
    row = np.searchsorted(begin, start, side="right") - 1
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    start, size, row = start[nth < most], size[nth < most], row[nth < most]
    data = data.astype(np.uint64)
    word = _hash_on(np.full(len(row), 2166136261, dtype=np.uint64), data, start, size)
    follows = np.flatnonzero(row[1:] == row[:-1])
    pair = ((word[follows] ^ np.uint64(ord("_"))) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    pair = _hash_on(pair, data, start[follows + 1], size[follows + 1])
    at = np.concatenate([word % np.uint64(DIMENSIONS), (word >> np.uint64(7)) % np.uint64(DIMENSIONS), pair % np.uint64(DIMENSIONS)]).astype(np.int64)
    weight = np.repeat([1.0, 0.5, 0.75], [len(word), len(word), len(pair)])
    place, inverse = np.unique(np.concatenate([row, row, row[follows]]) * DIMENSIONS + at, return_inverse=True)
    return place // DIMENSIONS, place % DIMENSIONS, np.bincount(inverse, weight, minlength=len(place))


def top_k(vectors: DataFrame, queries: DataFrame, *, key: str, vector: str, query_key: str, query_vector: str, k: int = 6, block_bytes: int = 8 << 20) -> DataFrame:
    """(query_key, key, similarity, rank) of the k nearest dense vectors by cosine.

    The stated queries are compared with all rows, a block of queries at a time:
    as many as have ``block_bytes`` go to the tasks, each of which sends on only
    its k best rows of a query.  Rows that have no similarity (a null vector, one
    of another length or of length zero) come last; ties by key.  Counts the
    queries and fetches their blocks at once.
    """
    slim = queries.select(F.col(query_key).alias("i"), F.col(query_vector).cast("array<double>").alias("q"))
    total = slim.agg(F.sum(8 * F.size("q") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    types = f"`{query_key}` {queries.schema[query_key].dataType.simpleString()}, `{key}` {vectors.schema[key].dataType.simpleString()}, similarity double"
    rows, found = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")), None
    for block in range(blocks):
        asked = slim.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).toArrow().combine_chunks()
        best = rows.mapInArrow(_nearest(asked, k), types)
        found = best if found is None else found.unionByName(best)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc_nulls_last("similarity"), key)))
    return ranked.where(F.col("rank") <= k)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of this width as rows; others are rows of NaN."""
    out = np.full((len(column), width), np.nan)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    for n in np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width):
        out[n] = column[n].values.to_numpy(zero_copy_only=False)
    return out


def _nearest(asked: pa.Table, k: int):
    """A function over a partition's vectors: the k best of each query."""
    widths = asked.column("q").combine_chunks().value_lengths().fill_null(0).to_pylist() if asked.num_rows else []

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts = None, []
        groups = [(w, np.flatnonzero([x == w for x in widths])) for w in sorted(set(widths))]
        kept = [[] for _ in groups]
        for batch in arrow:
            names = batch.column(0).type
            for g, (width, mine) in enumerate(groups):
                q = _matrix(asked.column("q").take(pa.array(mine)), width)
                q_norm = np.sqrt((q * q).sum(axis=1))
                step = max(k, (1 << 21) // max(1, len(mine)))
                for i in range(0, batch.num_rows, step):
                    few = batch.slice(i, step)
                    v = _matrix(few.column(1), width)
                    norms = np.sqrt((v * v).sum(axis=1))[:, None] * q_norm
                    with np.errstate(invalid="ignore", divide="ignore"):
                        value = np.where(norms > 0, np.round(v @ q.T / norms, 6), np.nan)
                    kept[g] = _best(kept[g], few.column(0), value, k)
        for (_, mine), x in zip(groups, kept, strict=True):
            if x:
                keys, at, value = x
                query = np.repeat(mine, at.shape[1])
                parts.append([asked.column("i").combine_chunks().take(pa.array(query)), keys.take(pa.array(at.ravel())), pa.array(value.ravel(), pa.float64(), from_pandas=True)])
        for p in parts:
            yield pa.RecordBatch.from_arrays(p, names=["i", "k", "similarity"])

    return run


def _best(kept: list, keys: pa.Array, value: np.ndarray, k: int) -> list:
    """(keys, places, values): of what was kept and the new rows the k best of each query, ties by key."""
    if kept:
        old_keys, old_at, old_value = kept
        keys = pa.concat_arrays([old_keys, keys])
    rank = np.empty(len(keys), dtype=np.int64)
    rank[pa.compute.sort_indices(keys).to_numpy()] = np.arange(len(keys))
    fresh = len(keys) - len(value)
    at = np.broadcast_to(np.arange(fresh, len(keys)), (value.shape[1], len(value)))
    scores = value.T
    if kept:
        at, scores = np.concatenate([old_at, at], axis=1), np.concatenate([old_value, scores], axis=1)
    order = np.lexsort((rank[at], -np.where(np.isnan(scores), -np.inf, scores)))[:, :k]
    at, scores = np.take_along_axis(at, order, axis=1), np.take_along_axis(scores, order, axis=1)
    used, place = np.unique(at, return_inverse=True)
    return [keys.take(pa.array(used)), place.reshape(at.shape), scores]


def parse_verdicts(df: DataFrame, reply: str, size: str) -> DataFrame:
    """Verdicts of a model's reply: the JSON array between the first [ and the last ].

    Rows are exploded; an index outside of 0..size-1 is dropped; scores are
    rounded and held to 0..100, unreadable ones are 0; recommendations are BID,
    NO_BID or REVIEW; reasons are cut to 240 characters.
    """
    body = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    rows = F.from_json(body, "array<struct<i:string,score:string,rec:string,reason:string>>")
    out = df.select("*", F.explode(rows).alias("_v")).withColumn("i", F.col("_v.i").try_cast("int"))
    out = out.where((F.col("i") >= 0) & (F.col("i") < F.col(size)))
    number = F.coalesce(F.col("_v.score").try_cast("double"), F.lit(0.0))
    rec = F.upper(F.regexp_replace(F.coalesce("_v.rec", F.lit("")), "[ -]", "_"))
    return out.select(*df.columns, "i", F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.when(F.isnan(number), 0.0).otherwise(number) + 0.5))).cast("int").alias("score"), F.when(rec.isin("NOBID", "NO_BID"), "NO_BID").when(rec == "BID", "BID").otherwise("REVIEW").alias("recommendation"), F.coalesce(F.nullif(F.substring("_v.reason", 1, 240), F.lit("")), F.lit("No reason given")).alias("reason"))

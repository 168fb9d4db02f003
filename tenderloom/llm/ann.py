"""Operator 13: approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by balanced splits.  Every vector goes
to the list of its nearest centroid and, near a border, to further ones that lie
in other directions.  The nearest centroids, of vectors and of queries, are
found by a best-first search in a neighbour graph that each task holds.  A query
reads the lists whose distance is at most ``ratio`` times that of the nearest;
the ratio is fitted on the sample.  Largest inner products become smallest
distances by one more component, which gives all vectors the same norm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Vectors that the fit sees, about.
SAMPLE = 32_768
#: Vectors a list, about, and the most lists; beyond that lists grow and come in blocks.
LIST, LISTS = 256, 8192
#: Most lists of one vector, and how much farther than the nearest they may be.
REPLICAS, NEAR = 4, 1.1
#: Largest block of a list, and of the queries that read it.
BLOCK = 2048


@dataclass
class Lists:
    """Centroids and their neighbour graph, the ratio of distances that is searched, and the sample with its ids."""

    centroids: np.ndarray
    graph: np.ndarray
    norm: float
    ratio: float
    sample: np.ndarray
    ids: pa.Array


def raised(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors over ``norm``, and what they lack to norm 1."""
    x = vectors / norm
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))[:, None]], axis=1)


def aimed(queries: np.ndarray) -> np.ndarray:
    """Queries as directions: their lengths change no order."""
    x = queries / np.abs(queries).max(axis=1, keepdims=True)
    return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, np.einsum("ij,ij->i", a, a)[:, None] - 2 * a @ b.T + np.einsum("ij,ij->i", b, b)))


def balanced_split(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Cluster of each row: k-means whose distances grow with the size of a cluster in the round before."""
    centre = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    weight = np.zeros(k)
    for _ in range(8):
        d = distances(x, centre) ** 2
        own = np.argmin(d + weight * d.mean(), axis=1)
        size = np.bincount(own, minlength=k)
        weight = np.maximum(0, weight + 0.1 * (size * k / len(x) - 1))
        centre = np.stack([x[own == j].mean(axis=0) if size[j] else x[j] for j in range(k)])
    return own


def fit_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """About ``lists`` centroids, by splits into at most eight until a cluster holds its share of the sample."""
    share, out, todo = max(1.0, len(x) / lists), [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        k = min(8, round(len(rows) / share))
        own = balanced_split(x[rows], k, len(out)) if k > 1 else np.zeros(len(rows), dtype=int)
        if own.max(initial=0) == own.min(initial=0):
            out.append(x[rows].mean(axis=0))
        else:
            todo += [rows[own == j] for j in range(k) if (own == j).any()]
    return np.stack(out)


def neighbour_graph(centroids: np.ndarray, degree: int = 16) -> np.ndarray:
    """The nearest centroids of each, and its neighbours in the order of the splits, which keep the graph in one piece."""
    n = len(centroids)
    near = np.concatenate([np.argsort(distances(centroids[i : i + 512], centroids), axis=1, kind="stable")[:, 1 : degree + 1] for i in range(0, n, 512)])
    ring = np.arange(n)
    return np.concatenate([near, ((ring + 1) % n)[:, None], ((ring - 1) % n)[:, None]], axis=1)


def graph_search(x: np.ndarray, lists: Lists, ratio: float, least: int = 8, at_once: int = 4) -> np.ndarray:
    """Distances of each row to the centroids that a best-first search visits, else infinite.

    Every row begins at evenly spaced centroids, and goes on from the nearest
    ones not yet left as long as they are within ``ratio`` of the best, or among
    the ``least`` best.
    """
    n, c = len(x), lists.centroids
    d = np.full((n, len(c)), np.inf)
    left = np.zeros(d.shape, dtype=bool)
    start = np.unique(np.linspace(0, len(c) - 1, min(len(c), 16)).astype(int))
    d[:, start] = distances(x, c[start])
    norms, own = np.einsum("ij,ij->i", c, c), np.einsum("ij,ij->i", x, x)
    least, at_once, rows = min(least, len(c)), min(at_once, len(c)), np.arange(n)
    while len(rows):
        seen = d[rows]
        bound = np.maximum(ratio * seen.min(axis=1), np.partition(seen, least - 1, axis=1)[:, least - 1])
        open_ = np.where(left[rows], np.inf, seen)
        pick = np.argpartition(open_, at_once - 1, axis=1)[:, :at_once]
        good = np.take_along_axis(open_, pick, axis=1)
        good = np.isfinite(good) & (good <= bound[:, None])
        going = good.any(axis=1)
        rows, pick, good = rows[going], pick[going], good[going]
        row, node = np.repeat(rows, at_once)[good.ravel()], pick.ravel()[good.ravel()]
        left[row, node] = True
        to = lists.graph[node]
        row, to = np.repeat(row, to.shape[1]), to.ravel()
        new = np.isinf(d[row, to])
        row, to = row[new], to[new]
        d[row, to] = np.sqrt(np.maximum(0, own[row] - 2 * np.einsum("ij,ij->i", x[row], c[to]) + norms[to]))
    return d


def places(x: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every vector: its nearest list, and near ones that are nearer to it than to a list it has."""
    d = graph_search(x, lists, NEAR)
    row, chosen = [], []
    order = np.argsort(d, axis=1, kind="stable")[:, : 4 * REPLICAS]
    value = np.take_along_axis(d, order, axis=1)
    for i in range(len(x)):
        held: list[int] = []
        for j, far in zip(order[i], value[i], strict=True):
            if held and (far > NEAR * value[i, 0] or len(held) == REPLICAS):
                break
            if np.isfinite(far) and all(np.linalg.norm(lists.centroids[j] - lists.centroids[h]) >= far for h in held):
                held.append(int(j))
        row += [i] * len(held)
        chosen += held
    return np.asarray(row, dtype=np.int64), np.asarray(chosen, dtype=np.int64)


def fit(sample: np.ndarray, ids: pa.Array, norm: float, lists: int, k: int, reach: float, trials: int = 128) -> Lists:
    """Centroids, graph, and the ratio at which trial vectors of the sample find the share ``reach`` of their neighbours in it."""
    x = raised(sample, norm)
    found = Lists(c := fit_centroids(x, lists), neighbour_graph(c), norm, 1.0, sample, ids)
    trial = np.linspace(0, len(x) - 1, min(len(x), trials)).astype(int)
    scores = sample[trial] @ sample.T
    scores[np.arange(len(trial)), trial] = -np.inf
    few = max(1, min(k, len(x) - 1))
    near = np.argpartition(scores, len(x) - few, axis=1)[:, len(x) - few :]
    del scores
    wanted, back = np.unique(near, return_inverse=True)
    row, chosen = places(x[wanted], found)
    to = distances(aimed(sample[trial]), c)
    to /= np.maximum(to.min(axis=1, keepdims=True), 1e-9)
    needed = np.full((len(trial), len(wanted)), np.inf)
    for r, j in zip(row, chosen, strict=True):
        needed[:, r] = np.minimum(needed[:, r], to[:, j])
    found.ratio = float(np.quantile(np.take_along_axis(needed, back.reshape(near.shape), axis=1), reach)) + 1e-9
    return found


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def best_of(queries: np.ndarray, vectors: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, inner product) of the ``k`` best of each query, ties at the end included, if no less than its bound."""
    row, col = [], []
    for i in range(0, len(queries), 256):
        scores = queries[i : i + 256] @ vectors.T
        least = bound[i : i + 256].copy()
        if vectors.shape[0] > k:
            least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
        a, b = np.nonzero(scores >= (least - 1e-9 * np.abs(least))[:, None])
        row.append(a + i)
        col.append(b)
    row, col = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (row, col))
    # not the product above, whose roundings depend on the place in the block
    return row, col, np.concatenate([np.zeros(0), *[(queries[row[i : i + 4096]] * vectors[col[i : i + 4096]]).sum(axis=1) for i in range(0, len(row), 4096)]])


def nearest(
    rows: DataFrame, queries: DataFrame, *, id: str = "vec_id", vector: str = "embedding", k: int = 20, reach: float = 0.97,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query, ties to the smaller id.

    ``queries`` are rows of the same columns.  A query's own row, and any other
    of its id, is no candidate.  Rows that repeat both id and vector count once;
    rows of one vector share a place in the index under their ``k + 1`` smallest
    ids, which are all that a result can hold.  Null, zero and non-finite
    vectors, those of another length than most and rows without an id take no
    part.  Further columns are ignored; empty tables give no rows.  The index
    holds every vector; its fit sees about ``SAMPLE`` distinct ones, chosen by
    a hash.
    """
    spark = rows.sparkSession
    slim = rows.select(F.col(id).alias("id"), F.col(vector).alias("vec"))
    length = slim.where("vec is not null").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    kind = rows.schema[id].dataType.simpleString()
    shape = f"query_id {kind}, rank int, vec_id {kind}, score double"
    sound = f"""id is not null and size(vec) = {length[0] if length else 0} and exists(vec, x -> x <> 0)
        and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"""
    groups = (
        slim.where(sound).select("vec", "id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
        .groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("vec", "ids", F.struct(F.col("ids")[0].alias("first"), F.monotonically_increasing_id().alias("row")).alias("id"))
    )
    groups = written(groups, "vectors")  # known by the smallest id and, as ids may repeat, a number
    n, largest = groups.agg(F.count(F.lit(1)), F.max(F.expr("sqrt(aggregate(vec, 0D, (s, x) -> s + double(x) * double(x)))"))).first()
    if not n:
        return spark.createDataFrame([], shape)
    part = groups.select("id", "vec").where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / n))) if n > SAMPLE else groups.select("id", "vec")
    taken = part.orderBy("id.first").toArrow()
    if not len(taken):
        taken = groups.select("id", "vec").orderBy("id.first").limit(1).toArrow()
    held = spark.sparkContext.broadcast(fit(matrix(taken.column("vec")), taken.column("id").combine_chunks(), float(largest) or 1.0, max(1, min(LISTS, n // LIST)), k, reach))

    asked = queries.select(F.col(id).alias("query_id"), F.col(vector).alias("vec")).where(sound.replace("id is", "query_id is")).distinct()
    one = written(asked.select("vec").distinct().select("vec", F.monotonically_increasing_id().alias("query")), "queries")
    members = written(asked.join(one, "vec").select("query_id", "query"), "members")
    asked = one

    def place(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for i in range(0, len(batch), 512):
                some = batch.slice(i, 512)
                row, chosen = places(raised(matrix(some.column(1)), held.value.norm), held.value)
                picked = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(chosen.astype(np.int32)), picked.column(0), picked.column(1)], names=["list", "id", "vec"])

    def select(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists of each query (list, bound), and its best of the sample (id, score)."""
        lists = held.value
        for batch in arrow:
            for i in range(0, len(batch), 128):
                some = batch.slice(i, 128)
                q = matrix(some.column(1))
                d = graph_search(aimed(q), lists, lists.ratio)
                a, b = np.nonzero(d <= lists.ratio * d.min(axis=1, keepdims=True))
                row, col, score = best_of(q, lists.sample, np.full(len(q), -np.inf), k + 1)
                bound = np.full(len(q), np.inf)
                np.minimum.at(bound, row, score)
                if len(lists.sample) <= k:
                    bound[:] = -np.inf
                ids = some.column(0)
                none_list, none_id = pa.nulls(len(row), pa.int32()), pa.nulls(len(a), lists.ids.type)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([ids.take(pa.array(a)), ids.take(pa.array(row))]), pa.concat_arrays([pa.array(b.astype(np.int32)), none_list]),
                        pa.concat_arrays([pa.array(bound[a]), pa.nulls(len(row), pa.float64())]), pa.concat_arrays([none_id, lists.ids.take(pa.array(col))]),
                        pa.concat_arrays([pa.nulls(len(a), pa.float64()), pa.array(score)]),
                    ],
                    names=["query", "list", "bound", "id", "score"],
                )

    vec_kind, key_kind = (groups.schema[c].dataType.simpleString() for c in ("vec", "id"))
    postings = written(groups.select("id", "vec").mapInArrow(place, f"list int, id {key_kind}, vec {vec_kind}"), "postings")
    chosen = written(asked.select("query", "vec").mapInArrow(select, f"query bigint, list int, bound double, id {key_kind}, score double"), "chosen")

    # a list and the queries that read it meet in blocks of bounded size
    sizes = postings.groupBy("list").count().select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    reads = chosen.where("list is not null").groupBy("list").count().select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("chunks"))
    dealt = F.broadcast(spark.createDataFrame(sizes.join(reads, "list").collect(), "list int, blocks int, chunks int"))  # a row a list: LISTS at most

    def share(key: str, by: str):
        return F.pmod(F.xxhash64(key), F.col(by)).cast("int")

    every = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    left = postings.join(dealt, "list").withColumns({"block": share("id", "blocks"), "chunk": every("chunks")}).select("list", "block", "chunk", "id", "vec")
    right = chosen.where("list is not null").select("query", "list", "bound").join(asked, "query").join(dealt, "list")
    right = right.withColumns({"chunk": share("query", "chunks"), "block": every("blocks")}).select("list", "block", "chunk", "query", "bound", "vec")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        row, col, score = best_of(matrix(b.column("vec")), matrix(a.column("vec")), b.column("bound").to_numpy(), k + 1) if len(a) and len(b) else ([], [], [])
        row, col = pa.array(row, pa.int64()), pa.array(col, pa.int64())
        return pa.table({"query": b.column("query").take(row), "id": a.column("id").take(col), "score": pa.array(score, pa.float64())})

    key = ["list", "block", "chunk"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, f"query bigint, id {key_kind}, score double")
    best = chosen.where("list is null").select("query", "id", "score").unionByName(met)
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    # a vector is met at most once a list and once in the sample
    best = best.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= (k + 1) * (REPLICAS + 1)).select("query", "id", "score").distinct()
    best = best.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1)
    copies = groups.where("size(ids) > 1").select("id", "ids")
    best = best.join(copies, "id", "left").select("query", F.explode(F.coalesce("ids", F.array("id.first"))).alias("vec_id"), "score")
    out = members.join(best, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

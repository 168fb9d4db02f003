"""An index for nearest vectors: inverted lists around centroids, exact re-ranking, and an exact search by the lists' widths.

Vectors of the index's length that are neither zero nor hold null or
non-finite components take part; others do not, in the index or as queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import new_folder
from .retrieval import _best, _matrix

#: Vectors and queries that meet in one task at once.
ROWS, QUERIES = 2048, 1024
MOST_LISTS = 4096


@dataclass(frozen=True)
class Lists:
    """Written lists: rows (list, spread, k, v) by list, their centroids (of length one), and each list's rows and widest angle."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    angles: np.ndarray
    key: str

    @property
    def width(self) -> int:
        return self.centroids.shape[1]


def _usable(vector: str, width: int) -> Column:
    square = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)
    return (F.size(vector) == width) & (square > 0) & (square < float("inf"))


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norms > 0, norms, 1.0)


def _closest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and cosine of the closest centroid of each row, some rows at a time."""
    place, cosine = np.empty(len(rows), dtype=np.int32), np.empty(len(rows))
    for i in range(0, len(rows), 1024):
        near = rows[i : i + 1024] @ centroids.T
        place[i : i + 1024] = near.argmax(axis=1)
        cosine[i : i + 1024] = near.max(axis=1)
    return place, cosine


def _centroids(sample: np.ndarray, count: int, rounds: int) -> np.ndarray:
    """Centroids of the sample on the sphere; one that loses all its members stays where it was."""
    sample = _unit(sample)
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(7)
    centroids = distinct[rng.choice(len(distinct), min(count, len(distinct)), replace=False)]
    for _ in range(rounds):
        place, _ = _closest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, place, sample)
        moved = np.abs(sums).max(axis=1) > 1e-12
        centroids[moved] = _unit(sums[moved])
    return centroids


def build(vectors: DataFrame, path: str, *, key: str, vector: str, lists: int | None = None, sample_bytes: int = 16 << 20, rounds: int = 8) -> Lists:
    """Writes the lists below ``path``, a shared folder, and returns them.

    The centroids are fitted on a sample of about ``sample_bytes`` of vectors
    (twice as much at most), chosen by a hash of the key; every vector of the
    most common length is then put into the list of its closest centroid.
    There are about as many lists as the square root of the vectors, at most
    4,096 and no more than an eighth of the sample.  Keys should be unique.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    widths = slim.where("size(v) > 0").groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width, total = widths if widths else (0, 0)
    good = slim.where(_usable("v", width))
    take = max(1, sample_bytes // (8 * max(1, width)))
    chosen = good if total <= take else good.where(F.pmod(F.xxhash64("k"), F.lit(total)) < take)
    chosen = chosen.select("v").limit(2 * take).toArrow()
    sample = _matrix((chosen if chosen.num_rows else good.select("v").limit(take).toArrow()).column("v"), width)
    count = lists or min(round(total**0.5), MOST_LISTS, len(sample) // 8)
    centroids = _centroids(sample, max(1, count), rounds) if len(sample) else np.zeros((0, width))
    shared = spark.sparkContext.broadcast(centroids)
    kind = slim.schema["k"].dataType.simpleString()

    def assign(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            place, cosine = _closest(_unit(_matrix(batch.column(1), width)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(np.arccos(np.clip(cosine, -1, 1)))], names=["k", "v", "spread", "list", "angle"])

    # a common list may hold much of the table: its rows are dealt to parts by a hash of their place, whatever their keys
    placed = good.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())).mapInArrow(assign, f"k {kind}, v array<double>, spread bigint, list int, angle double")
    if len(sample):
        placed.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/rows")
    else:
        placed.limit(0).write.parquet(f"{path}/rows")
    told = {r["list"]: r for r in spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()}
    facts = [(n, c.tolist(), told[n]["n"] if n in told else 0, told[n]["angle"] if n in told else 0.0) for n, c in enumerate(centroids)]
    spark.createDataFrame(facts, "list int, centroid array<double>, n bigint, angle double").write.parquet(f"{path}/centroids")
    return load(spark, path, key=key)


def load(spark: SparkSession, path: str, *, key: str) -> Lists:
    """Lists that ``build`` wrote."""
    facts = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return Lists(spark.read.parquet(f"{path}/rows"), np.array([r["centroid"] for r in facts]) if facts else np.zeros((0, 1)), np.array([r["n"] for r in facts]), np.array([r["angle"] for r in facts]), key)


def search(index: Lists, queries: DataFrame, *, query_key: str, query_vector: str, k: int = 6, probe: int = 8, exact: bool = False) -> DataFrame:
    """(query_key, key, similarity, rank) of the k nearest by cosine, ties by key, in the ``probe`` lists closest to a query.

    With ``exact`` a second pass reads every further list in which, by the
    angle to its centroid and its widest angle, a vector as near as the k-th
    may be, so the result is that of comparing all.  Query keys are unique;
    queries that take no part have no rows.  Jobs count the queries of each
    list when called, and with ``exact`` the first pass is written.
    """
    asked = queries.select(F.col(query_key).alias("i"), F.col(query_vector).cast("array<double>").alias("q")).where(_usable("q", index.width))
    names = [F.col("i").alias(query_key), F.col("k").alias(index.key), "similarity", "rank"]
    found = _ranked(_meet(index, _routes(index, asked.withColumn("least", F.lit(None).cast("double")), probe, False), k), k)
    if exact:
        path = new_folder(index.rows.sparkSession, "nearest")
        found.write.parquet(path)
        found = found.sparkSession.read.parquet(path)
        least = found.groupBy("i").agg(F.when(F.count("*") == k, F.min("similarity")).alias("least"))
        further = _meet(index, _routes(index, asked.join(least, "i", "left"), probe, True), k)
        found = _ranked(found.drop("rank").unionByName(further), k)
    return found.select(*names)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("similarity"), "k"))).where(F.col("rank") <= k)


def _routes(index: Lists, asked: DataFrame, probe: int, further: bool) -> DataFrame:
    """(i, q, list): the closest ``probe`` lists of each query, or those further ones that may hold a vector of cosine ``least``."""
    shared = asked.sparkSession.sparkContext.broadcast((index.centroids, index.angles, np.flatnonzero(index.sizes)))
    width = index.width

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, angles, filled = shared.value
        for batch in arrow:
            for n in range(0, batch.num_rows, 256):
                few = batch.slice(n, 256)
                near = np.clip(_unit(_matrix(few.column(1), width)) @ centroids[filled].T, -1, 1)
                order = np.argsort(-near, axis=1, kind="stable")
                chosen = np.zeros(near.shape, dtype=bool)
                np.put_along_axis(chosen, order[:, :probe], True, axis=1)
                if further:
                    least = few.column(2).fill_null(-2.0).to_numpy(zero_copy_only=False)
                    # a hair more than the angles say, for rounding
                    bound = np.cos(np.maximum(0, np.arccos(near) - angles[filled] - 1e-6)) + 2e-6
                    chosen = ~chosen & (bound >= least[:, None])
                row, place = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays([few.column(0).take(pa.array(row)), few.column(1).take(pa.array(row)), pa.array(filled[place].astype(np.int32))], names=["i", "q", "list"])

    return asked.select("i", "q", "least").mapInArrow(run, f"i {asked.schema['i'].dataType.simpleString()}, q array<double>, list int")


def _meet(index: Lists, routes: DataFrame, k: int) -> DataFrame:
    """(i, k, similarity): of each list, part of its vectors and part of its queries the k best of a query."""
    spark, width = index.rows.sparkSession, index.width
    kinds = {c: d.schema[c].dataType for d, c in ((routes, "i"), (index.rows, "k"))}
    schema = f"i {kinds['i'].simpleString()}, k {kinds['k'].simpleString()}, similarity double"
    asked = {r["list"]: r["count"] for r in routes.groupBy("list").count().collect()}
    if not asked:
        return spark.createDataFrame([], schema)
    cells = [(n, -(-int(index.sizes[n]) // ROWS), -(-count // QUERIES)) for n, count in asked.items()]
    grid = F.broadcast(spark.createDataFrame(cells, "list int, parts int, sides int"))
    some = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    cell = ["list", "part", "side"]
    rows = index.rows.where(F.col("list").isin(sorted(asked))).join(grid, "list").select("list", F.pmod("spread", "parts").cast("int").alias("part"), some("sides").alias("side"), "k", "v")
    asks = routes.join(grid, "list").select("list", some("parts").alias("part"), F.pmod(F.xxhash64("i"), F.col("sides")).cast("int").alias("side"), "i", "q")

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table([mine.column("i").slice(0, 0), theirs.column("k").slice(0, 0), pa.array([], pa.float64())], names=["i", "k", "similarity"])
        q, v = _matrix(mine.column("q"), width), _matrix(theirs.column("v"), width)
        value = np.round(v @ q.T / (np.sqrt((v * v).sum(axis=1))[:, None] * np.sqrt((q * q).sum(axis=1))), 6)
        keys, at, scores = _best([], theirs.column("k").combine_chunks(), value, k)
        query = np.repeat(np.arange(len(q)), at.shape[1])
        return pa.table([mine.column("i").combine_chunks().take(pa.array(query)), keys.take(pa.array(at.ravel())), pa.array(scores.ravel())], names=["i", "k", "similarity"])

    return asks.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(compare, schema)

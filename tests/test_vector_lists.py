"""The index of inverted lists against comparing all vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.operators import lists, retrieval
from tenderloom.sources.tables import new_folder


def _rows(kind: str, n: int = 3000, width: int = 16):
    rng = np.random.default_rng(3)
    if kind == "noise":
        return rng.normal(size=(n, width))
    near = rng.normal(size=(40, width)) * 4
    rows = near[rng.integers(0, 40, n)] + rng.normal(size=(n, width)) * 0.4
    rows[: n // 3] = rows[0]  # a third of the rows are copies
    return rows


def _tables(spark, kind):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(_rows(kind))]
    vectors = spark.createDataFrame(rows, "id long, v array<double>").repartition(6)
    return vectors, vectors.where("id % 25 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))


def _got(df):
    return {(r["query"], r["rank"]): (r["id"], round(r["similarity"], 5)) for r in df.collect()}


@pytest.mark.parametrize("kind", ["noise", "groups"])
def test_exact_search_equals_comparing_all_and_recall(spark, kind):
    vectors, queries = _tables(spark, kind)
    index = lists.build(vectors, new_folder(spark, "lists"), key="id", vector="v")
    assert index.sizes.sum() == 3000 and 40 <= len(index.sizes) <= 60
    want = _got(retrieval.top_k(vectors, queries, key="id", vector="v", query_key="query", query_vector="q", k=5))
    assert _got(lists.search(index, queries, query_key="query", query_vector="q", k=5, probe=3, exact=True)) == want
    few = _got(lists.search(index, queries, query_key="query", query_vector="q", k=5, probe=28 if kind == "noise" else 6))
    least = {q: s for (q, r), (_, s) in want.items() if r == 5}
    assert sum(s >= least[q] for (q, _), (_, s) in few.items()) >= 0.9 * len(want)


def test_further_lists_are_left_out_where_groups_are_tight(spark):
    vectors, queries = _tables(spark, "groups")
    index = lists.build(vectors, new_folder(spark, "lists"), key="id", vector="v")
    asked = queries.withColumnRenamed("query", "i")
    routed = lists._routes(index, asked.withColumn("least", F.lit(0.99)), 3, True).count()
    assert routed < 0.2 * asked.count() * len(index.sizes)
    assert lists._routes(index, asked.withColumn("least", F.lit(None).cast("double")), 3, True).count() == asked.count() * (int((index.sizes > 0).sum()) - 3)


def test_blocks_of_a_hot_list_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(lists, "ROWS", 100)
    monkeypatch.setattr(lists, "QUERIES", 7)
    vectors, queries = _tables(spark, "groups")
    odd = spark.createDataFrame([(9001, None), (9002, [0.0] * 16), (9003, [1.0]), (9004, [None] + [1.0] * 15), (9005, [float("nan")] * 16), (9006, [float("inf")] * 16)], "id long, v array<double>")
    path = new_folder(spark, "lists")
    index = lists.build(vectors.unionByName(odd).withColumn("list", F.lit("x")), path, key="id", vector="v", lists=4)
    again = lists.load(spark, path, key="id")
    assert index.sizes.sum() == again.sizes.sum() == 3000 and index.sizes.max() > 900
    asked = queries.unionByName(odd.select(F.col("id").alias("query"), F.col("v").alias("q")))
    want = _got(retrieval.top_k(vectors, queries, key="id", vector="v", query_key="query", query_vector="q", k=5))
    assert _got(lists.search(again, asked, query_key="query", query_vector="q", k=5, probe=1, exact=True)) == want
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id long, v array<double>")
    small = lists.build(few, new_folder(spark, "lists"), key="id", vector="v")
    assert _got(lists.search(small, few.toDF("query", "q"), query_key="query", query_vector="q", exact=True)) == {(1, 1): (1, 1.0), (1, 2): (2, 0.0), (2, 1): (2, 1.0), (2, 2): (1, 0.0)}
    for none in (few.limit(0), odd.where("id = 9001")):
        empty = lists.build(none, new_folder(spark, "lists"), key="id", vector="v")
        assert lists.search(empty, few.toDF("query", "q"), query_key="query", query_vector="q", exact=True).count() == 0
    assert lists.search(small, few.limit(0).toDF("query", "q"), query_key="query", query_vector="q").count() == 0

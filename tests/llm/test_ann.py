"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tenderloom.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, label int, list int, id string"


def brute(rows, k=20, by=20):
    """Exact answer: every query row against all other rows, by plain Python."""
    length = max((sizes := [len(v) for _, v in rows if v is not None]), key=lambda n: (sizes.count(n), -n), default=0)
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == length and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = []
    for i, v in good:
        if i % by == 0:
            found = sorted(((-(np.asarray(v) * np.asarray(w)).sum(), j) for j, w in good if j != i))[:k]
            out += [(i, n + 1, j, float(-s)) for n, (s, j) in enumerate(found)]
    return sorted(out)


def answers(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in ann.nearest(df, df.where("vec_id % 20 = 0"), **how).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    made = [(i, [float(x) for x in rng.integers(-4, 5, 6)]) for i in range(150)]  # integers: many ties, no roundings
    made += [(i, [1.0, 2.0, 3.0, -1.0, 0.0, 4.0]) for i in range(200, 280)]
    made += [(300, None), (320, [0.0] * 6), (321, [float("nan")] + [1.0] * 5), (322, [float("inf")] + [1.0] * 5), (340, [None] + [1.0] * 5), (360, [1.0]), (None, [1.0] * 6), (380, [])]
    return [*made, made[0], made[20], (40, [9.0] * 6)]


def test_one_list_is_exact(spark, rows):
    assert answers(spark, rows) == brute(rows)


def test_blocks_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    assert answers(spark, rows) == brute(rows)


def test_few_vectors_and_none(spark):
    assert answers(spark, []) == []
    assert answers(spark, [(0, None)]) == []
    assert answers(spark, [(0, [1.0, 2.0])]) == []
    few = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (1, [0.0, 1.0])]
    assert answers(spark, few) == brute(few)


def recall(found, exact):
    wanted = {}
    for q, _, v, _ in exact:
        wanted.setdefault(q, set()).add(v)
    got = {}
    for q, _, v, _ in found:
        got.setdefault(q, set()).add(v)
    return np.mean([len(wanted[q] & got.get(q, set())) / len(wanted[q]) for q in wanted])


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_recall_with_many_lists_and_a_small_sample(spark, monkeypatch, spread):
    monkeypatch.setattr(ann, "LIST", 32)
    monkeypatch.setattr(ann, "SAMPLE", 800)
    monkeypatch.setattr(ann, "BLOCK", 64)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(25, 12))
    rows = [(i, [float(x) for x in np.float32(centre[i % 25] + spread * rng.normal(size=12))]) for i in range(2000)]
    found, exact = answers(spark, rows), brute(rows)
    assert len(found) == len(exact) and recall(found, exact) >= 0.9
    best = {(q, v): s for q, _, v, s in exact}
    assert all(abs(best[q, v] - s) < 1e-9 for q, _, v, s in found if (q, v) in best)


def test_query_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r[0], r[1]) for r in queries.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    found = [tuple(r) for r in queries.op13_nearest_neighbours(spark, sf).collect()]
    exact = brute(rows)
    assert len(found) == len(exact) and recall(found, exact) >= 0.9


def test_graph_search_finds_the_nearest_centroid():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    lists = ann.fit(x, np.arange(3000), float(np.linalg.norm(x, axis=1).max()), 100, 10, 0.97)
    raised = ann.raised(x[:300], lists.norm)
    seen = ann.graph_search(raised, lists, ann.NEAR)
    exact = ann.distances(raised, lists.centroids)
    assert (seen.argmin(axis=1) == exact.argmin(axis=1)).mean() > 0.95
    row, _ = ann.places(raised, lists)
    assert set(row) == set(range(300)) and np.bincount(row).max() <= ann.REPLICAS

"""Importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import queries
from tenderloom.llm import resample as rs

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))
    return len(words), [zlib.crc32(f) % 10000 for f in [*words, *(a + b" " + b for a, b in zip(words, words[1:], strict=False))]]


def brute(docs, target):
    held = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for n, (i, words, f) in enumerate(held):
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= 20, n))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    rank = {r[5]: n + 1 for n, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((*r[:4], rank.get(r[5])) for r in rows), key=str)


def answers(spark, docs, target):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, id string, rank int").coalesce(1)
    b = spark.createDataFrame([(t, 3) for t in target], "text string, n int")
    return sorted((tuple(r) for r in rs.resample(d, b).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_draw_equals_plain_python(spark):
    random.seed(8)
    vocabulary = ["".join(random.choice("abcdeéñZ9") for _ in range(random.randint(1, 7))) for _ in range(80)]
    make = lambda n: random.choice([" ", "\n", ", ", "-"]).join(random.choice(vocabulary) for _ in range(n))
    docs = [(n - 50, make(random.randint(0, 60))) for n in range(200)]
    docs += [(500, ""), (501, None), (None, make(40)), (502, "..."), (503, "y" * 300), (504, make(5000)), (505, "w" * 65 + " " + "v" * 64 + " a" * 30), (506, "é " * 40), (-(2**63), make(30)), (2**63 - 1, make(30))]
    docs += [(507, docs[7][1])] * 40
    target = [make(30), None, "", make(2), "y" * 300]
    assert answers(spark, docs, target) == brute(docs, target)
    assert answers(spark, docs, []) == brute(docs, [])


def test_empty_tables_and_small_draws(spark):
    assert answers(spark, [], ["a b"]) == []
    few = [(i, "a b c " * 9) for i in range(3)]
    assert answers(spark, few, ["a"]) == brute(few, ["a"])


def test_ids_must_be_integral(spark):
    with pytest.raises(TypeError):
        rs.resample(spark.createDataFrame([("x", "y")], "doc_id string, text string"), spark.createDataFrame([("x",)], "text string"))


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_kth_key_is_the_sorted_one(spark, bits):
    random.seed(bits)
    rows = [(random.choice([-3, 0, 7, 2**40]), random.choice([-(2**63), -1, 5, 2**63 - 1]), n) for n in range(60)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    for k in (1, 2, 17, 59, 60):
        key = rs.kth_key(df, ["a", "b", "c"], k, bits)
        assert sorted(tuple(r) for r in df.where(rs.up_to(["a", "b", "c"], key)).collect()) == sorted(rows)[:k]


def test_crc_of_ranges():
    data = np.frombuffer(b"one" + b"x" * 200 + b"three", dtype=np.uint8)
    starts, ends = np.array([0, 3, 203, 5, 8]), np.array([3, 203, 208, 5, 72])
    found = rs.crc_states(data, starts, ends, np.full(5, 0xFFFFFFFF, dtype=np.uint32)) ^ np.uint32(0xFFFFFFFF)
    assert found.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


def test_query_equals_plain_python_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r[0], r[1]) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    target = [r[0] for r in queries.table(spark, sf, "benchmark").select("text").collect()]
    found = queries.op12_importance_resample(spark, sf)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, target)
    assert found.where(F.col("rank").isNotNull()).agg(F.max("rank")).first()[0] == found.where("rank is not null").count()

"""Links, nearest vectors, embeddings, joined texts, detail pages and handler links, on small and awkward tables."""

from __future__ import annotations

import json
import math
import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from tenderloom.functions import scalars as fn
from tenderloom.operators import ordering, retrieval, workflow
from tenderloom.sources import discovery, portals


def test_absolute_links(spark):
    bases = ["https://h.org/a/b/c.html?x=1#top", "http://h.org", "http://h.org/", "https://h.org:81/a/"]
    hrefs = ["d.pdf", "./d.pdf", "../d.pdf", "../../../d", "/x/./y/../z.pdf", "//o.org/p", "?q=2", "#f", "https://z.org/1", "mailto:a@b", "e/", ".", "..", "x?u=/../y"]
    rows = [(b, h) for b in bases for h in hrefs]
    got = spark.createDataFrame(rows, "b string, h string").select("b", "h", fn.absolute(F.col("b"), F.col("h")).alias("a")).collect()
    # an address without a path has the path "/"
    slash = lambda b: b + "/" if b.count("/") == 2 else b
    assert {(r["b"], r["h"]): r["a"] for r in got} == {(b, h): urljoin(slash(b), h) for b, h in rows}
    # empty folders stay, as the URL standard has it (urljoin drops them)
    assert spark.range(1).select(fn.absolute(F.lit("https://h.org/a/b"), F.lit("c//d"))).first()[0] == "https://h.org/a/c//d"
    odd = [(None, "x"), ("h", "http://a"), ("", "y"), ("https://h.org", None), ("https://h.org", "")]
    got = spark.createDataFrame(odd, "b string, h string").select(fn.absolute(F.col("b"), F.col("h")).alias("a")).collect()
    assert [r["a"] for r in got] == [None, "http://a", None, None, None]


def test_nearest_vectors_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(n, [float(rng.randint(-3, 3)) for _ in range(4)]) for n in range(300)]
    rows += [(300, None), (301, [0.0] * 4), (302, [1.0]), (303, rows[0][1]), (304, rows[0][1])]
    asked = [(f"q{n}", rows[n][1]) for n in (0, 7, 300, 301)] + [("short", [2.0]), ("q0", rows[5][1])]
    vectors = spark.createDataFrame(rows, "id int, v array<double>").repartition(5)
    queries = spark.createDataFrame(asked, "id string, q array<double>").withColumnRenamed("id", "query")

    def cosine(a, b):
        if not a or not b or len(a) != len(b):
            return None
        norm = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / norm, 6) if norm else None

    for block in (1 << 20, 100):
        got = retrieval.top_k(vectors, queries.where("query <> 'q0'"), key="id", vector="v", query_key="query", query_vector="q", k=5, block_bytes=block).collect()
        for name, q in asked[1:-1]:
            order = sorted(((cosine(v, q), n) for n, v in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:5]
            mine = sorted((r["rank"], r["id"], r["similarity"]) for r in got if r["query"] == name)
            assert [(i, s) for _, i, s in mine] == [(i, s) for s, i in order], name
    assert retrieval.top_k(vectors, queries.limit(0), key="id", vector="v", query_key="query", query_vector="q").count() == 0
    assert retrieval.top_k(vectors.limit(0), queries, key="id", vector="v", query_key="query", query_vector="q").count() == 0


def test_embedding_matches_plain_python(spark):
    def fnv(text):
        h = 2166136261
        for c in text.encode():
            h = ((h ^ c) * 16777619) & 0xFFFFFFFF
        return h

    import re
    from collections import Counter

    rows = [(1, "Cloud-cloud migration, Ünder 42 x yz"), (1, "aa"), (2, None), (3, ""), (4, "ab cd " * 3000), (5, "é"), (6, "a b c"), (7, "longest" * 40 + " tail")]
    want = Counter()
    for n, (key, text) in enumerate(rows):
        words = re.findall("[a-z0-9]{2,}", (text or "").lower())[:4000]
        for w in words:
            want[n, key, fnv(w) % 1536] += 1
            want[n, key, (fnv(w) >> 7) % 1536] += 0.5
        for a, b in zip(words, words[1:], strict=False):
            want[n, key, fnv(f"{a}_{b}") % 1536] += 0.75
    got = [tuple(r) for r in retrieval.embed(spark.createDataFrame(rows, "key int, t string"), "key", "t").collect()]
    assert sorted(got) == sorted((k, b, float(x)) for (_, k, b), x in want.items())
    length = retrieval.embed(spark.createDataFrame(rows[:1], "key int, t string"), "key", "t", unit=True).agg(F.sum(F.col("weight") ** 2)).first()[0]
    assert abs(length - 1) < 1e-9


def test_joined_texts_of_many_and_of_long_ones(spark):
    rng = random.Random(4)
    rows = [(n % 3 if n < 600 else 0, n, "x" * rng.randint(0, 30) + str(n)) for n in range(2000)] + [(4, 1, "y" * 500), (4, 2, "z"), (5, 1, " "), (6, 1, None), (None, 1, "n")]
    rng.shuffle(rows)
    got = {r["k"]: r["joined"] for r in ordering.joined_texts(spark.createDataFrame(rows, "k int, o int, t string"), "k", "t", ["o"], 300, "--", salts=4).collect()}
    want = {}
    for k, _, t in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if t and t.strip():
            want.setdefault(k, []).append(t[:300])
    assert got == {k: "--".join(t)[:300] for k, t in want.items()}


def test_details_are_taken_only_if_they_name_the_record(spark):
    pages = spark.createDataFrame([(0, json.dumps({"lines": [{"solicitationId": f"T{n}", "title": "t"} for n in range(4)]}))], "page int, payload string")
    detail = {"description": "<p>a</p>b", "value": "12.5 x", "attachments": [{"fileName": " f ", "fileURL": "/f"}, {"fileName": None, "fileURL": "/g"}]}
    details = spark.createDataFrame([("T0", json.dumps(detail)), ("T1", "<html>"), ("T2", json.dumps({"value": "-3"})), ("T9", json.dumps(detail)), ("T3", None)], "external_id string, payload string")
    got = {r["external_id"]: (r["description"], r["estimated_value"], r["attachments"]) for r in portals.enriched(portals.tx(pages), portals.tx_details(details, "https://o")).collect()}
    assert got["T0"] == ("a\nb", 12.5, [("f", "https://o/f")]) and {k: v[:2] for k, v in got.items() if k != "T0"} == {f"T{n}": (None, None) for n in (1, 2, 3)}
    other = spark.createDataFrame([("T0", "T1", "wrong"), ("T1", "T1", "right"), ("T1", "T1", "sight")], "external_id string, echoed string, description string")
    assert {r["external_id"]: r["description"] for r in portals.enriched(portals.tx(pages), other).collect()} == {"T0": None, "T1": "right", "T2": None, "T3": None}


def test_handler_links(spark):
    html = "<a href=\"javascript:downloadFile('12')\">Spec  <b>one</b></a><a href=\"javascript:downloadFile(12)\">again</a><a href=\"javascript:downloadFile('7')\"></a><a href=\"/x\">x</a>"
    pages = spark.createDataFrame([(1, "https://p.example/bid?docId=B-1&x=2", html), (2, "https://p.example/bid", html), (3, None, html), (4, "https://p.example/bid?docId=B", None)], "id int, url string, html string")
    got = {(r["id"], r["filename"], r["url"]) for r in discovery.handler_downloads(pages, "id", "html", F.col("url")).collect()}
    address = "https://p.example/bso/external/bidDetail.sda?docId=B-1&downloadFileNbr={}&mode=download&parentUrl=close&external=true"
    assert got == {(1, "Spec one", address.format(12)), (1, "document-7", address.format(7))}


def test_manual_changes_and_alerts(spark):
    rows = spark.createDataFrame([(1, "OPEN"), (2, "OPEN"), (3, None)], "id int, status string")
    changes = spark.createDataFrame([(1, "CLOSED", "amy", "why"), (2, "OPEN", None, None), (3, "OPEN", None, None), (9, "OPEN", None, None)], "id int, value string, actor string, reason string")
    got = {r["id"]: (r["old_value"], r["new_value"], r["changed_by"], r["reason"], r["closed_at"] is None) for r in workflow.status_changes(rows, changes, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert got == {1: ("OPEN", "CLOSED", "amy", "why", False), 3: (None, "OPEN", "user", None, True)}
    runs = spark.createDataFrame([(1, "failed", "boom"), (2, "success", "")], "source_id int, outcome string, log string")
    alerts = workflow.failure_alerts(spark.createDataFrame([(1, "S")], "id int, name string"), runs).collect()
    assert [(r["title"], r["body"], r["severity"]) for r in alerts] == [("Crawl failed: S", "boom", "critical")]

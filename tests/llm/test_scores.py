"""Scores of operators 4, 5 and 9 against plain versions, and their awkward tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import bpe, decontaminate, editprint, interpolate, language, licenses, minhash, quality, queries, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    return docs, labels


def remainder(i, by):
    return zlib.crc32(str(i).encode()) % by


# --- 4: quality


def plain_statistics(text):
    """The statistics one by one, from their names."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, size = max(1, len(words)), max(1, len(raw))
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    spread = np.sqrt(max(0.0, sum(x * x for x in lengths) / n - mean**2))
    lines = [x for x in raw.split(b"\n") if x]
    share = [sum(b in set(c) for b in raw) / size for c in quality._CLASSES.values()]
    pairs = len(set(zip(words, words[1:], strict=False))) + (1 if words else 0)
    return np.array([
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(mean), np.log1p(spread), sum(x <= 3 for x in lengths) / n, sum(x >= 14 for x in lengths) / n,
        np.log((len(set(words)) + 1) / (len(words) + 1)), np.sqrt(1 - min(pairs / n, 1)), np.log((len(set(lines)) + 1) / (max(1, len(lines)) + 1)), np.sqrt(max(Counter(words).values(), default=0) / n),
        np.log1p(len(raw) / max(1, len(lines))), *np.sqrt(share), share[3] / max(share[2] + share[3], 1e-3),
    ])


def test_quality_scores_match_a_plain_discriminant(spark, tables):
    docs, labels = tables
    x = {i: plain_statistics(t) for i, t in docs.items()}
    train = sorted(i for i in docs if i in labels and labels[i]["quality"] in (0, 1) and remainder(i, 4) != 2)
    rows, y = np.array([x[i] for i in train]), np.array([labels[i]["quality"] for i in train], dtype=float)
    common, sides = np.diag(rows.var(axis=0) + 1e-6), []
    for c in (0, 1):
        mine = rows[y == c]
        cov = np.cov(mine, rowvar=False)
        cov = 0.9 * cov + 0.05 * np.diag(np.diag(cov)) + 0.05 * common + 1e-9 * np.eye(len(cov))
        sides.append((mine.mean(axis=0), np.linalg.inv(cov), np.log(len(mine) / len(rows)) - 0.5 * np.linalg.slogdet(cov)[1]))
    density = lambda v, s: s[2] - 0.5 * (v - s[0]) @ s[1] @ (v - s[0])
    odds = {i: density(v, sides[1]) - density(v, sides[0]) for i, v in x.items()}
    z, w = np.array([[odds[i] / 10, 1.0] for i in train]), np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w + np.linalg.solve((z.T * (p * (1 - p))) @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
    got = {r["doc_id"]: r for r in queries.op4_quality(spark, DATA).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        want = 1 / (1 + np.exp(-np.clip(w[0] * odds[i] / 10 + w[1], -30, 30)))
        assert abs(r["score"] - want) < 1e-5, i
        assert r["held_out"] == (remainder(i, 4) == 2) and r["predicted"] == int(r["score"] >= 0.7)


# --- 5: language


def test_page_languages_match_a_plain_version(spark):
    """Text, markup, suffix and three levels of priors, page by page."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", language.markup_language(F.col("html")).alias("l"), language.visible_text(F.col("html")).alias("t"), language.address_host(F.col("url")).alias("h")).collect()
    rows = [(r["page_id"], r["t"] or "", r["l"], r["h"] or "") for r in pages]
    assert max(Counter(lang for _, _, lang, _ in rows).values()) < 500  # all rows teach
    model = language.fit_text([(t, lang) for _, t, lang, _ in rows if lang and t])
    part = lambda rx, h: (re.search(rx, h) or [None, ""])[1]
    keys = {h: (h, part(r"([^.]+\.[^.]+)$", h), part(r"\.([^.]+)$", h)) for _, _, _, h in rows}
    seen = [Counter((keys[h][n], lang) for _, _, lang, h in rows if lang) for n in range(3)]
    every = Counter(lang for _, _, lang, _ in rows if lang)
    suffixes = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en"}
    got = {r["page_id"]: r for r in queries.op5_language_id(spark, DATA).collect()}
    assert set(got) == {i for i, *_ in rows}
    for i, t, lang, h in rows:
        prior = {x: (every[x] + 1) / sum(every[c] + 1 for c in model.languages) for x in model.languages}
        for n in (2, 1, 0):
            mine = {x: seen[n][(keys[h][n], x)] for x in model.languages}
            prior = {x: (mine[x] + 20 * prior[x]) / (20 + sum(mine.values())) for x in model.languages}
        data = np.frombuffer(t.encode(), np.uint8)
        buckets, _ = language.text_buckets(data, np.array([0, len(data)]))
        score = []
        for n, x in enumerate(model.languages):
            text = np.clip(language.TEMPER * sum(model.weights[n][b] for b in buckets), -language.LIMIT, language.LIMIT)
            score.append(text + np.log(prior[x]) + 3.0 * (lang == x) + 3.0 * (suffixes.get(keys[h][2]) == x))
        chance = np.exp(np.array(score) - max(score))
        assert got[i]["language"] == model.languages[int(np.argmax(score))], i
        assert abs(got[i]["confidence"] - 1 / chance.sum()) < 1e-6 and got[i]["reliable"] == (len(buckets) > 0 and 1 / chance.sum() >= 0.5)


# --- 9: toxicity


def test_toxicity_scores_match_a_plain_version(spark, tables):
    """The model is fitted once more on the same rows; each text is then compressed window by window."""
    import zstandard

    docs, labels = tables
    train = [i for i in docs if i in labels and labels[i]["toxic"] in (0, 1) and remainder(i, 5) != 0 and docs[i] is not None]
    train.sort(key=lambda i: (zlib.crc32(str(i).encode()), i))
    every = [i for i in labels if labels[i]["toxic"] in (0, 1) and remainder(i, 5) != 0]
    model = toxicity.fit([(docs[i], labels[i]["toxic"]) for i in train], share=float(np.mean([labels[i]["toxic"] for i in every])))

    def size(dictionary, window):
        held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=model.level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    got = {r["doc_id"]: r for r in queries.op9_toxicity(spark, DATA).collect()}
    assert set(got) == set(docs)
    for i in sorted(docs, key=lambda i: len(docs[i] or ""))[:60]:
        cut = toxicity.windows((docs[i] or "").lower().encode(), model.window)
        x = []
        for toxic, ordinary in model.pairs:
            gains = [size(ordinary, w) - size(toxic, w) for w in cut]
            beyond = [sum(g >= t for g in gains) for t in toxicity.THRESHOLDS]
            x += [np.log1p(b) for b in beyond] + [np.sqrt(b / max(1, len(cut))) for b in beyond]
        x = (np.array([*x, np.log1p(len(cut))]) - model.center) / model.scale
        want = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
        assert abs(got[i]["score"] - want) < 1e-6, i
    assert all(r["held_out"] == (remainder(i, 5) == 0) and r["predicted"] == int(r["score"] >= 0.5) for i, r in got.items())


# --- long texts, repeated and null ids, clashing names


def awkward(spark):
    long = "the cat and the mouse saw a bird over there " * 30000
    rows = [(1, long), (1, "the cat"), (None, "the mouse"), (2, None), (3, ""), (4, "zxq " * 200000), (5, "é" * 300000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("d", "t", "x", "h", "k", "p", "g", "w", "f", "n", "i", "l", "c", "fold", "block", "line", "score", "signature", "language"):
        docs = docs.withColumn(name, F.lit("own"))
    return docs, rows


def test_awkward_tables_of_every_scoring_operator(spark):
    import public_tokenizers

    docs, rows = awkward(spark)
    none = docs.limit(0)
    ids = Counter(i for i, _ in rows)
    count = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    model = quality.fit(np.zeros((0, len(quality.NAMES))), np.zeros(0))
    assert count(quality.scores(quality.features(docs), model)) == ids and count(quality.scores(quality.features(none), model)) == {}
    toxic = toxicity.fit([])
    assert count(toxicity.scores(docs, toxic)) == ids
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    assert toxicity.sample(docs, labels, label="toxic", train=F.lit(True), longest=100)[0][0][1] == 1
    found = language.identify(docs.withColumn("lang", F.lit("en")), text="text", host=F.lit(None).cast("string"), declared=F.col("lang"), key=F.col("doc_id"))
    assert count(found) == ids and {r["language"] for r in found.collect()} == {"en"} and found.first()["d"] == "own"
    assert count(interpolate.model_scores(docs, held_out=F.col("doc_id") == 4)) == ids
    assert count(minhash.near_duplicates(docs)) == ids
    hits = decontaminate.contamination(docs, spark.createDataFrame([("a", "a bird over there the cat and the mouse saw"), ("a", "zxq"), (None, "the")], "item_id string, text string"))
    assert sorted((r["doc_id"] or 0, r["n_words"], len(r["items"])) for r in hits.collect()) == [(0, 2, 0), (1, 2, 0), (1, 300000, 1), (2, 0, 0), (3, 0, 0), (4, 200000, 1), (5, 1, 0)]
    prints = editprint.fingerprints(docs.where("doc_id < 4"))
    assert count(prints) == Counter({1: 2, 2: 1, 3: 1}) and prints.first()["fold"] == "own" and editprint.near_classes(prints).count() == 3
    assert licenses.scan(docs).count() == 0 and licenses.scan(none).count() == 0
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    assert count(bpe.round_trip(docs.where("doc_id is null or doc_id <> 5"), path=path, pattern=pattern)) == ids - Counter({5: 1})

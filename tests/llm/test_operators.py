"""The ten operators against brute force, round trips and held-out accuracy, on small and awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import bpe, decontaminate, editprint, interpolate, language, licenses, minhash, quality, repeats, toxicity

DATA = "/root/testdata/sf0.001"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def documents(spark, rows):
    """Awkward columns beside: names that the operators use inside, and nulls."""
    return spark.createDataFrame([(i, t, None, 1) for i, t in rows], "doc_id long, text string, lang string, d int")


def words_of(text, rx=rb"[^\x20\x09-\x0D]+"):
    return re.findall(rx, (text or "").encode().translate(LOWER))


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    vocabulary = ["".join(random.choice("abcdeéñ") for _ in range(random.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    rows = [make(random.randint(5, 200)) for _ in range(60)]
    base = make(150).split()
    for _ in range(25):  # near copies of one text
        copy = list(base)
        for _ in range(random.randint(0, 6)):
            copy[random.randrange(len(copy))] = random.choice(vocabulary)
        rows.append(" ".join(copy))
    rows += [rows[3], rows[3], "", None, "  \n ", "x", "ä ö", "aaaa" * 400, "ab" * 500, make(6000), rows[5] + " " + rows[7]]
    passage = make(90)
    rows += [f"{make(20)} {passage} {make(20)}" for _ in range(6)]
    return list(enumerate(rows))


# --- 1: decontamination


def brute_hits(text, items, span=10):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))
    hit, found = set(), set()
    for name, item in items:
        iw = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").encode().translate(LOWER))
        m = min(span, len(iw))
        if not m:
            continue
        windows = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)}
        for i in range(len(words) - m + 1):
            if tuple(words[i : i + m]) in windows:
                hit.update(range(i, i + m))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


def test_contamination_matches_brute_force_in_one_and_many_blocks(spark, texts):
    random.seed(2)
    source = [t for _, t in texts if t and len(t.split()) > 40]
    items = [(n, " ".join(random.choice(source).split()[k : k + random.choice([3, 9, 10, 14, 30])])) for n, k in enumerate(random.choices(range(20), k=40))]
    items += [(90, None), (91, "."), (92, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, items) for i, t in texts}
    for block in (1 << 20, 400):
        got = decontaminate.contamination(documents(spark, texts), bench, block_bytes=block).collect()
        assert len(got) == len(texts)
        for r in got:
            assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), sorted(r["items"])) == want[r["doc_id"]], r


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents(spark, [(1, "a b")]), none).collect()[0]["spans"] == []
    assert decontaminate.contamination(documents(spark, []), none).count() == 0


# --- 2: edit fingerprints


def test_fingerprints_follow_edits(spark):
    random.seed(1)
    base = "".join(random.choice("abcdefgh ") for _ in range(3000))
    near = base[:100] + "xyz" + base[104:1500] + base[1502:2500] + "--" + base[2500:]
    other = "".join(random.choice("abcdefgh ") for _ in range(3000))
    a, b, c, d, e, f = editprint.fingerprints_of([base, near, other, base, "", ""])
    assert a == d and e == f and len(a) == editprint.SLOTS
    assert 1 > editprint.likeness_of(a, b) > 0.8 > 0.2 > editprint.likeness_of(a, c)
    links = editprint.band_links(editprint.fingerprints(documents(spark, [(1, base), (2, near), (3, other), (4, base), (5, None)]).select("doc_id", "text")))
    assert {(r["doc_id"], r["other"]) for r in links.collect()} == {(2, 1)}


def test_likeness_follows_edit_distance():
    """The more characters are changed, the less alike; one in two hundred keeps most, one in ten leaves little."""
    rng = random.Random(11)
    mean = []
    for share in (0.0, 0.005, 0.01, 0.02, 0.05, 0.1):
        near = []
        for _ in range(40):
            a = [rng.choice("abcdefgh ") for _ in range(1500)]
            b = list(a)
            for _ in range(int(share * len(a))):
                k = rng.randrange(len(b))
                b[k : k + rng.randrange(2)] = rng.choice(["", "x", "yz"])
            near.append(editprint.likeness_of(*editprint.fingerprints_of(["".join(a), "".join(b)])))
        mean.append(float(np.mean(near)))
    assert mean[0] == 1.0 and all(x > y for x, y in zip(mean, mean[1:], strict=False)) and mean[1] > 0.6 > 0.3 > mean[-1], mean


@pytest.mark.parametrize("block", [512, 4])
def test_near_classes_match_all_pairs(spark, block, monkeypatch):
    """Texts that share a long part with a smaller id that is unlike them, near copies, equal texts, and a bucket of many."""
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common, rows = make(1500), []
    for _ in range(12):
        own = common + make(900)
        rows += [own, own[:2000] + "#" + own[2001:], own + "!"]
    rows += [rows[4], rows[4], "", "", make(400)]
    table = [(f"k{i:03d}", t) for i, t in enumerate(rows)]
    table += [(None, rows[0]), ("k000", rows[0])]
    docs = spark.createDataFrame(table, "key string, text string")
    prints = editprint.fingerprints(docs, text="text")
    whole = editprint.band_links
    monkeypatch.setattr(editprint, "band_links", lambda *a, **k: whole(*a, **k, block=block))
    got = {r["key"]: r["class_id"] for r in editprint.near_classes(prints, id="key").collect()}
    ids, marks = [i for i, _ in table if i][:-1], editprint.fingerprints_of([t for i, t in table if i][:-1])
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in zip(ids, marks, strict=True):
        for j, b in zip(ids, marks, strict=True):
            if i < j and editprint.likeness_of(a, b) >= 0.8:
                root[max(top(i), top(j))] = min(top(i), top(j))
    assert got == {i: top(i) for i in ids} and len(set(got.values())) > 10
    assert editprint.near_classes(prints.limit(0), id="key").count() == 0


def test_edited_probe_with_text_ids_and_repeated_rows(spark):
    rows = [("b", "bbbbbb"), ("a", "aaaaaa"), ("c", None), ("b", "bbb"), (None, "none"), ("d", "d" * 3000), ("e", "é" * 9)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("d", F.lit(1)).withColumn("p", F.lit(2))
    for part in (3, 1 << 20):
        got = sorted((r["doc_id"], r["n_chars"], r["edited"]) for r in editprint.edited_probe(docs, part_bytes=part).collect())
        assert got == sorted([("e", 9, "é" * 6 + "ddd"), ("d", 3000, "d" * 2000), ("c", 0, ""), ("b", 3, "bbb"), ("b", 6, "bbbbaa"), ("a", 6, "aaaaéé")])


def test_edited_probe_takes_the_next_document(spark, texts):
    ordered = sorted(((i, t or "") for i, t in texts), reverse=True)
    want = {}
    for n, (i, t) in enumerate(ordered):
        u = ordered[(n + 1) % len(ordered)][1]
        k = len(t) // 3
        want[i] = t[: len(t) - k] + u[:k]
    got = editprint.edited_probe(documents(spark, texts).select("doc_id", "text").repartition(3), part_bytes=3000).collect()
    assert {r["doc_id"]: r["edited"] for r in got} == want
    prints = dict(zip([i for i, _ in ordered], editprint.fingerprints_of([t for _, t in ordered]), strict=True))
    assert all(r["fingerprint"] == prints[r["doc_id"]] and r["n_chars"] == len(dict(ordered)[r["doc_id"]]) for r in got)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert editprint.edited_probe(documents(spark, [])).count() == 0
    assert editprint.edited_probe(documents(spark, [(7, "abc")])).collect()[0]["edited"] == "aba"


# --- 3: repeated passages


def test_suffix_order_and_repeats_of_fragments():
    random.seed(3)
    for _ in range(150):
        t = np.array([random.randint(0, random.choice([1, 3, 20])) for _ in range(random.randint(1, 60))])
        assert repeats.suffix_order(t, 100).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    for _ in range(80):
        parts = [bytes(random.choice(b"ab") for _ in range(random.randint(6, 40))) for _ in range(random.randint(1, 5))]
        n = random.randint(4, 8)
        count = Counter(p[i : i + n] for p in parts for i in range(len(p) - n + 1))
        assert [g.tolist() for g in repeats.repeated_starts(parts, n)] == [[i for i in range(len(p) - n + 1) if count[p[i : i + n]] > 1] for p in parts]


@pytest.mark.parametrize(("length", "most"), [(400, 64), (100, 64), (100, 2)])
def test_removal_matches_brute_force(spark, texts, length, most):
    raw = {i: (t or "").encode() for i, t in texts}
    count = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    got = repeats.remove_repeats(documents(spark, texts), length=length, most=most).collect()
    assert len(got) == len(texts)
    for r in got:
        b = raw[r["doc_id"]]
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        assert bytes(r["kept"]) == bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert sum(s["end"] - s["start"] for s in r["removed"]) == gone.sum() and r["n_bytes"] == len(b)


def test_removal_of_empty_tables_and_as_text(spark):
    assert repeats.remove_repeats(documents(spark, [])).count() == 0
    cut = {r["doc_id"]: r["kept"] for r in repeats.remove_repeats(documents(spark, [(1, "é" * 210 + "a"), (2, "é" * 210 + "b"), (3, None)]), as_text=True).collect()}
    assert cut == {1: "a", 2: "b", 3: ""}


def test_no_more_buckets_than_spark_allows(spark, texts):
    docs = documents(spark, texts).repartition(7)
    whole = {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(docs).collect()}
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        rows, count = repeats.dealt(docs, "text")
        assert count == 3 and rows.count() == len(texts)
        assert {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(docs).collect()} == whole
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")


def test_removal_by_row_whatever_the_ids(spark):
    passage = "".join(random.Random(9).choice("abcdefg ") for _ in range(550))
    rows = [("a", passage, 1), ("a", "short", 2), ("b", passage, 3), (None, "x" + passage, 4), (None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_bytes int").withColumn("d", F.col("n_bytes")).withColumn("t", F.lit("own"))
    got = {r["d"]: (r["doc_id"], r["kept"], r["n_bytes"], r["t"]) for r in repeats.remove_repeats(docs, as_text=True).collect()}
    assert got == {1: ("a", "", 550, "own"), 2: ("a", "short", 5, "own"), 3: ("b", "", 550, "own"), 4: (None, "x", 551, "own"), 5: (None, "", 0, "own")}


def test_long_documents_are_cut_in_stretches(spark, monkeypatch):
    """Anchors, cells and fragments of a long text, stretch by stretch, against all strings of it."""
    monkeypatch.setattr(repeats, "STRETCH", 700)
    rng = random.Random(6)
    passage = [rng.choice(b"abcdef") for _ in range(900)]
    long = [rng.choice(b"abcdef") for _ in range(300)]
    for _ in range(12):
        a = rng.randrange(500)
        long += [rng.choice(b"abcdef") for _ in range(rng.randrange(500))] + passage[a : a + rng.randrange(350, 900 - a + 350)]
    texts = [bytes(long), bytes(passage[200:750])]
    count = Counter(b[i : i + 400] for b in texts for i in range(len(b) - 400 + 1))
    whole = pa.record_batch([pa.array([0, 1]), pa.array([t.decode() for t in texts])], names=["d", "t"])
    made = [None]

    class Frame:
        def mapInArrow(self, run, schema):
            made[0] = list(run(iter([held])))
            return self

    held = whole
    repeats._anchor_rows(Frame(), 400)
    runs = pa.Table.from_batches(made[0]).to_pylist()
    starts = sorted((r["d"], i) for r in runs for i in range(r["low"], r["high"] + 1))
    assert starts == [(d, i) for d, b in enumerate(texts) for i in range(len(b) - 399)]
    listed = [[{k: r[k] for k in ("at", "low", "high", "h")} for r in runs if r["d"] == d] for d in (0, 1)]
    held = whole.append_column("runs", pa.array(listed, pa.list_(pa.struct([(k, pa.int64()) for k in ("at", "low", "high", "h")]))))
    for width in repeats.widths_of(400):
        repeats._cells(Frame(), 400, width, most=300)
        cells = pa.Table.from_batches(made[0]).to_pylist()
        assert sorted((c["d"], i) for c in cells for i in range(c["at"] - c["back"], c["at"] - c["fore"] + 1)) == starts
        # equal strings lie in cells of one core
        core = {(c["d"], i): c["h"] for c in cells for i in range(c["at"] - c["back"], c["at"] - c["fore"] + 1)}
        first = {}
        for (d, i), h in core.items():
            assert first.setdefault(texts[d][i : i + 400], h) == h
    assert max(count.values()) > 1


# --- 4: quality


def test_quality_learns_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    x = quality.features(docs)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    model = quality.fit(*quality.training_rows(x, labels, label="quality", train=train))
    held = quality.scores(x, model).join(labels.where(~train), "doc_id").collect()
    right = np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in held])
    assert right > 0.85 and all(0 <= r["score"] <= 1 for r in held)


def test_quality_of_awkward_rows(spark, texts):
    x = quality.features(documents(spark, texts))
    one_class = quality.fit(np.zeros((1, len(quality.NAMES))), np.ones(1))
    got = quality.scores(x, one_class).collect()
    assert len(got) == len(texts) and all(np.isfinite(r["score"]) for r in got)
    rows = {r["doc_id"]: r["x"] for r in x.collect()}
    assert all(np.isfinite(v).all() for v in rows.values())
    assert quality.features(documents(spark, [])).count() == 0


# --- 5: language


def test_language_by_text_markup_and_host(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) > 100")
    found = language.identify(docs, text="text", host=F.col("source"), declared=F.lit(None).cast("string"), key=F.col("doc_id"), known=F.col("lang")).collect()
    assert np.mean([r["language"] == r["lang"] for r in found]) > 0.95
    rows = [(1, "http://a.example.de/x", "<html lang='de'><body>123</body></html>"), (2, None, None), (3, "http://a.example.de/y", "<html><body></body></html>"), (4, "https://b.example.fr", "<html LANG=fr><p>le la les des une dans pour avec sur tout" + " mot" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    html = F.col("html")
    got = {r["page_id"]: r for r in language.identify(pages.withColumn("t", language.visible_text(html)), text="t", host=language.address_host(F.col("url")), declared=language.markup_language(html), key=F.col("page_id")).collect()}
    assert len(got) == 4 and got[1]["language"] is not None and not got[2]["reliable"]
    none = spark.createDataFrame([], "page_id long, url string, t string")
    assert language.identify(none, text="t", host=F.col("url"), declared=F.lit(None).cast("string"), key=F.col("page_id")).count() == 0


# --- 6: near duplicates


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[n : n + k]) for n in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and 100 * len(a & b) >= percent * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80), (1, 60)])
def test_near_duplicates_match_brute_force(spark, texts, k, percent):
    got = minhash.near_duplicates(documents(spark, texts), shingle=k, percent=percent, miss=1e-9).collect()
    want = brute_components(texts, k, percent)
    if percent == 60:  # beyond what the bands are made for: whatever is linked is right
        assert all(want[r["doc_id"]][0] == r["n_shingles"] for r in got)
        return
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    got = minhash.near_duplicates(documents(spark, [(None, "a b c"), (2, "a b c"), (2, "a b c"), (1, None)])).collect()
    assert len(got) == 4 and {r["component_id"] for r in got} == {None, 1, 2}


def test_posterior_bounds_keep_similar_pairs():
    least = minhash.least_matches(0.85, 1e-5)
    assert all(a <= b for a, b in zip(least, least[1:], strict=False)) and least[-1] < 0.85 * minhash.HASHES


def test_rare_languages_are_known(spark):
    """Three pages of a language among thousands, one with short pages only, and three-letter codes."""
    plain = "the quick brown fox and the lazy dog of this house were here and there for a long time "
    rows = [(n, plain * 3, "h.com", "eng" if n % 2 else "en-US") for n in range(3000)]
    rows += [(5000 + n, "ang mga bata ay naglalaro sa labas ng bahay at kumakain ng mangga " * 5, "x.ph", "fil") for n in range(3)]
    rows += [(6000 + n, "kot spi na dywanie", "k.pl", "pl") for n in range(3)]
    rows += [(7000 + n, "", "g.fi", "fi") for n in range(3)]
    rows += [(8000, "ang mga bata ay naglalaro sa labas ng bahay at kumakain ng mangga " * 5, "x.ph", None), (8001, "kot spi na dywanie", "k.pl", None)]
    docs = spark.createDataFrame(rows, "page_id long, t string, h string, l string")
    got = {r["page_id"]: r for r in language.identify(docs, text="t", host=F.col("h"), declared=F.col("l"), key=F.col("page_id")).collect()}
    assert all(got[n]["language"] == "en" and got[n]["reliable"] for n in range(3000))
    assert {got[n]["language"] for n in (5000, 5001, 5002, 8000)} == {"fil"} and {got[n]["language"] for n in (6000, 6001, 6002)} == {"pl"}
    assert got[8001]["language"] == "pl" and not got[7000]["reliable"]
    codes = spark.createDataFrame([("fil",), ("kok",), ("DEU",), ("pt_BR",), ("",), (None,)], "c string").select(language.language_code(F.col("c"))).collect()
    assert [r[0] for r in codes] == ["fil", "kok", "de", "pt", None, None]


# --- 7: language model


def test_model_scores_match_brute_force_counts(spark, texts):
    held = lambda i: i % 10 == 0
    got = {r["doc_id"]: r for r in interpolate.model_scores(documents(spark, texts), held_out=F.col("doc_id") % 10 == 0, deleted=F.col("doc_id") % 10 == 1, block_bytes=4000).collect()}
    streams = {i: [*words_of(t), None] for i, t in texts}
    count = Counter(w for i, s in streams.items() if not held(i) for w in s)
    total = sum(count.values())
    for i, s in streams.items():
        base = sum(np.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1))) for w in s)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(s), sum(count[w] > 0 for w in s), total, held(i))
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and np.isfinite(r["score"])


def test_model_scores_match_brute_force_scores(spark, texts):
    """The mixture, its weights and its logarithms, token by token in plain Python."""
    fold = {i: 0 if i % 10 == 0 else 1 if i % 10 == 1 else 2 for i, _ in texts}
    streams = {i: [*words_of(t), b"\n"] for i, t in texts}

    def counts(folds):
        mine = [s for i, s in streams.items() if fold[i] in folds]
        return Counter(w for s in mine for w in s), Counter(p for s in mine for p in zip([None, *s], s, strict=False)), len(mine)

    def parts(before, word, single, double, starts):
        context = starts if before is None else single[before]
        pair = double[before, word] / context if context else 0.0
        return int(np.log2(context)) + 1 if context else 0, pair, (single[word] + 0.1) / (sum(single.values()) + 0.1 * (len(single) + 1)), 1 / (len(single) + 1)

    rest, whole = counts({2}), counts({1, 2})
    cells = Counter()
    for i, s in streams.items():
        if fold[i] == 1:
            for p in zip([None, *s], s, strict=False):
                bucket, pair, word, _ = parts(*p, *rest)
                cells[(bucket, *(2.0 ** (round(np.log2(x) * interpolate.STEPS) / interpolate.STEPS) if x else 0.0 for x in (pair, word)))] += 1
    flat, weights = 1 / (len(rest[0]) + 1), {}
    for bucket in [-1, *{b for b, _, _ in cells}]:
        mine, w = [(pair, word, flat, n) for (b, pair, word), n in cells.items() if bucket in (b, -1)], [1 / 3] * 3
        for _ in range(40):
            sums = [0.0] * 3
            for *x, n in mine:
                mixed = sum(a * b for a, b in zip(w, x, strict=True))
                sums = [t + n * a * b / mixed for t, a, b in zip(sums, w, x, strict=True)]
            w = [t / sum(sums) for t in sums]
        w = [max(x, 1e-6) for x in w]
        weights[bucket] = [x / sum(w) for x in w]
    got = {r["doc_id"]: r["score"] for r in interpolate.model_scores(documents(spark, texts), held_out=F.col("doc_id") % 10 == 0, deleted=F.col("doc_id") % 10 == 1, block_bytes=4000).collect()}
    for i, s in streams.items():
        want = 0.0
        for p in zip([None, *s], s, strict=False):
            bucket, pair, word, uniform = parts(*p, *whole)
            w = weights.get(bucket, weights[-1])
            w = [0.0, w[1] / (w[1] + w[2]), w[2] / (w[1] + w[2])] if not bucket else w
            want += np.log10(w[0] * pair + w[1] * word + w[2] * uniform)
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want)), i


def test_model_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = interpolate.model_scores(docs, held_out=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert interpolate.model_scores(documents(spark, []), held_out=F.lit(False)).count() == 0
    only = interpolate.model_scores(documents(spark, [(1, "a b")]), held_out=F.lit(True)).collect()
    assert only[0]["train_tokens"] == 0 and np.isfinite(only[0]["score"])


def test_probabilities_of_a_context_add_up():
    vocabulary = 3
    single, double = np.array([4.0, 2.0, 1.0]), np.array([1.0, 2.0, 0.0])
    words = np.arange(3)
    _, pair, word, flat = interpolate.estimates(single, double, 2.0, 7.0, vocabulary, words, words, np.full(3, 0))
    assert abs(pair.sum() - 0.75) < 1e-12 and word.sum() < 1 and abs(flat.sum() - 3 / 4) < 1e-12
    weights = interpolate.learn_weights([(2, 0.5, 0.1, 10.0), (2, 0.0, 0.2, 5.0)], 0.25)
    assert abs(sum(weights[2]) - 1) < 1e-9 and set(weights) == {-1, 2}


# --- 8: licences


def test_license_scan_against_python(spark):
    whole = " ".join(licenses.TEMPLATES["MIT text"].split())
    changed = whole.replace("Software", "Program").replace("free of charge", "at no cost").replace("AUTHORS", "WRITERS", 1)
    rows = [
        (1, "Released under the MIT License.\nfoo bar"), (2, "released UNDER the mit license"), (3, None), (4, ""), (5, "All rights reserved."), (6, "all rights"),
        (7, "Licensed under the Apache License, Version 2.1."), (7, "x\n\nAll rights reserved, all rights reserved"), (8, "Copyright 2024 X. All rights reserved. More words follow here"),
        (9, "Licensed under the Apache\nLicense, Version 2.0 for all"), (10, "foo " * 300 + whole.replace(" ", "\n", 40) + " bar" * 5000), (11, changed), (12, "A file. " + licenses.TEMPLATES["GPL-3.0 header"]),
        (13, "the " * 20000), (14, "of"),
    ]

    def grams(w):
        return set(zip(w, w[1:], strict=False))

    def words(t):
        return re.sub("[^a-z0-9]+", " ", t.lower()).split()

    want = {}
    for i, t in rows:
        for name, template in licenses.TEMPLATES.items():
            n, b, w = len(words(template)), grams(words(template)), words(t or "")
            last = max(0, len(w) - n)
            places = [("line", k, grams(words(line))) for k, line in enumerate((t or "").split("\n"), 1)]
            places += [("word", s + 1, grams(w[s : s + n])) for s in range(last + 1)]
            for kind, k, a in places:
                dice = 2 * len(a & b) / (len(a) + len(b))
                if a and dice >= licenses.THRESHOLD:
                    x = want.setdefault((i, name), {"line": [], "word": [], "dice": 0})
                    x[kind].append(k)
                    x["dice"] = max(x["dice"], dice)
    got = {(r["doc_id"], r["license"]): (r["n_lines"], r["n_windows"], r["first_line"], r["first_word"], round(r["dice"], 6)) for r in licenses.scan(documents(spark, rows)).collect()}
    assert got == {k: (len(x["line"]), len(x["word"]), min(x["line"], default=None), min(x["word"], default=None), round(x["dice"], 6)) for k, x in want.items()}
    assert {(8, "Proprietary"), (9, "Apache-2.0"), (10, "MIT text"), (11, "MIT text"), (12, "GPL-3.0 header")} <= set(got)
    assert licenses.scan(documents(spark, [])).count() == 0 and licenses.scan(documents(spark, rows), templates={}).count() == 0


def test_license_windows_lose_none_at_random_places(spark):
    """Licence texts with some words exchanged, anywhere in a longer text, repeated and with their own words around them."""
    rnd = random.Random(11)
    names, rows, want = ["MIT text", "Apache-2.0 header", "BSD disclaimer", "GPL-3.0 header"], [], {}
    words = {name: re.sub("[^a-z0-9]+", " ", t.lower()).split() for name, t in licenses.TEMPLATES.items()}
    for i in range(60):
        own = words[rnd.choice(names)]
        other = [f"w{k}" for k in range(900)] + (own if i % 3 == 0 else [])
        fill = lambda: [rnd.choice(other) for _ in range(rnd.randrange(120))]  # noqa: B023, E731
        copies = [[rnd.choice(other) if rnd.random() < 0.08 else w for w in own] + fill() for _ in range(1 + i % 2)]
        rows.append((i, " ".join(fill() + sum(copies, []))))
        w = rows[-1][1].split()
        for name, t in words.items():
            b, n = set(zip(t, t[1:], strict=False)), len(t)
            for s in range(max(0, len(w) - n) + 1):
                a = set(zip(w[s : s + n], w[s + 1 : s + n], strict=False))
                dice = 2 * len(a & b) / (len(a) + len(b))
                if a and dice >= licenses.THRESHOLD:
                    want[i, name, s + 1] = round(dice, 6)
    got = {(r["doc_id"], r["license"], r["word"]): round(r["dice"], 6) for r in licenses.scan_windows(documents(spark, rows)).collect()}
    assert got == want and len({i for i, _, _ in want}) > 50


# --- 9: toxicity


def test_toxicity_separates_planted_words(spark):
    random.seed(4)
    make = lambda n: " ".join("".join(random.choice("aeiourstln") for _ in range(random.randint(2, 8))) for _ in range(n))
    spoil = lambda t: " ".join(w if random.random() > 0.15 else random.choice(["zgrabble", "vixnork", "quompf"]) for w in t.split())
    rows = [(spoil(make(80)), 1) for _ in range(150)] + [(make(80), 0) for _ in range(300)]
    model = toxicity.fit(rows, share=1 / 3)
    test = [(n, spoil(make(80)) if n % 2 else make(80)) for n in range(60)] + [(100, None), (101, "")]
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(documents(spark, test), model).collect()}
    assert len(got) == 62 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[n] >= 0.5) == bool(n % 2) for n in range(60)]) > 0.9
    assert toxicity.scores(documents(spark, []), toxicity.fit([])).count() == 0


def test_toxicity_by_combinations_of_ordinary_words():
    """No single word marks these toxic documents: only a dictionary trained on toxic text has their phrases."""
    rng = random.Random(8)
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    phrases = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(12)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    bad = lambda: " ".join(make(30) + [rng.choice(phrases)] + make(20) + [rng.choice(phrases)] + make(20))
    rows = [(bad(), 1) for _ in range(200)] + [(" ".join(make(82)), 0) for _ in range(400)]
    model = toxicity.fit(rows)
    test = [(bad() if n % 2 else " ".join(make(82)), n % 2) for n in range(200)]
    x = np.array([toxicity.profile(t, toxicity._compressors(model), model.window) for t, _ in test])
    right = ((x - model.center) / model.scale @ model.weights[:-1] + model.weights[-1] >= 0) == np.array([y for _, y in test], dtype=bool)
    assert right.mean() > 0.9


def test_long_texts_may_teach(spark):
    """All toxic rows are longer than the stretch that is taken of a row."""
    rng = random.Random(3)
    make = lambda n: " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(n, make(400) if n % 2 else make(40)) for n in range(20)] + [(20, None), (21, ""), (None, "x"), (1, "zz")]
    labels = spark.createDataFrame([(n, n % 2) for n in range(22)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got, share = toxicity.sample(documents(spark, rows), labels, label="toxic", train=F.lit(True), longest=500)
    whole = {t for _, t in rows if t}
    assert len(got) == 21 and sum(y for _, y in got) == 11 and abs(share - 0.5) < 1e-9
    assert all(len(t) <= 500 and (not t or any(t in w for w in whole)) for t, _ in got) and sum(len(t) == 500 for t, _ in got) >= 9


def test_windows_lose_nothing():
    random.seed(6)
    for n in (0, 1, 31, 32, 33, 500):
        data = bytes(random.choice(b"abc  ") for _ in range(n))
        assert b"".join(toxicity.windows(data, 32)) == data


# --- 10: byte-level BPE


def test_bpe_matches_the_library_and_decodes(spark, texts):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [*texts, (500, "it's  a\n\n test 123abc <|endoftext|>   x 🙂 " * 40), (501, "don't stop 12 " * 900)]
    enc = bpe.encoding(path, pattern)
    for size in (64, 1 << 16):
        got = bpe.round_trip(documents(spark, rows), path=path, pattern=pattern, part_chars=size).collect()
        for r in got:
            text = dict(rows)[r["doc_id"]] or ""
            assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(text) and bytes(r["decoded"]).decode() == text
    digest = {r["doc_id"]: r for r in bpe.digests(bpe.decode(bpe.encode(documents(spark, rows), path=path, pattern=pattern), path=path, pattern=pattern)).collect()}
    assert all(digest[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows)


def test_clashing_column_names(spark):
    clash = spark.createDataFrame([(1, "le chat et la souris " * 30, "x", 0.5, 3, "y", 1, 2), (2, "the cat and the mouse " * 30, None, None, None, None, None, None)], "doc_id long, text string, prior string, letters double, language int, _host string, _runs int, kept int")
    found = language.identify(clash, text="text", host=F.lit("h"), declared=F.when(F.col("doc_id") == 1, "fr").otherwise("en"), key=F.col("doc_id"))
    assert {(r["doc_id"], r["language"], r["prior"], r["_host"]) for r in found.collect()} == {(1, "fr", "x", "y"), (2, "en", None, None)}
    cut = repeats.remove_repeats(clash).orderBy("doc_id").collect()
    assert [(r["_runs"], r["prior"], len(r["kept"])) for r in cut] == [(1, "x", 0), (None, None, 0)]

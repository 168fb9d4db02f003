"""The pipeline against plain Python, stage by stage, and the registration of its queries."""

from __future__ import annotations

import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tenderloom.llm import language, queries
from tests.llm.test_operators import brute_components, brute_hits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark):
    """Real documents, copies of some, a leak, and rows without letters."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120").collect()
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [tuple(d[c] for c in COLUMNS) for d in docs]
    plain = [r for r in rows if r[1] and 600 < len(r[1]) < 3000]
    passage = plain[0][1][:500]
    extra = [plain[1][1], plain[2][1] + " tail", passage + " " + plain[3][1][::-1], "prefix " + passage, bench.first()["text"] + " and more words here", "12345 67890", "", None]
    rows += [(1000 + i, t, "en", "src0", len(t or "")) for i, t in enumerate(extra)]
    out = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    bench.write.parquet(f"{out}/benchmark.parquet")
    return out


def cut(texts: dict[int, str], length: int = corpus_pipeline.PASSAGE) -> dict[int, str]:
    raw = {i: t.encode() for i, t in texts.items()}
    count = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs, start = [], 0
        for k in range(len(b) + 1):
            if k == len(b) or gone[k]:
                runs.append(b[start:k].decode(errors="ignore"))
                start = k + 1
        out[i] = "".join(runs)
    return out


def test_pipeline_matches_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.identify_language(spark, docs, folder)
    assert first.columns == COLUMNS
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    letterless = {1005, 1006, 1007}
    assert not letterless & set(kept) and len(kept) >= docs.count() - len(letterless) - 5
    parts = brute_components(sorted(kept.items()), 5, 80)
    kept = {i: t for i, t in kept.items() if parts[i][1] == i}
    kept = {i: t for i, t in cut(kept).items() if t}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not brute_hits(t, items)[1]}
    assert 1004 not in kept
    import public_tokenizers

    from tenderloom.llm import bpe

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == {i: enc.encode_ordinary(t) for i, t in kept.items()}
    assert all(r["exact"] for r in got)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(5)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash", "suffix_dedup", "decontaminate", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == COLUMNS


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_contract_columns(spark):
    want = {
        "op1_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated", "op2_edit_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op3_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op4_quality": "doc_id held_out score predicted", "op6_minhash": "doc_id n_shingles component_id kept",
        "op7_interpolated_lm": "doc_id held_out n_tokens n_known train_tokens base_score score", "op9_toxicity": "doc_id held_out score predicted", "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op11_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256", "op12_importance_resample": "doc_id n_features weight score rank", "op13_nearest_neighbours": "query_id rank vec_id score",
    }
    for name, columns in want.items():
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert got.columns == columns.split()
        assert got.agg(F.count("*")).first()[0] == {"op11_conversation_repair": 20, "op13_nearest_neighbours": 25 * 20}.get(name, 200)


def test_language_stage_keeps_what_a_brute_force_keeps(spark):
    """Text, host and declaration added up one document at a time, in plain Python."""
    words = {"en": "the quick brown fox and the lazy dog of this house", "fr": "avec le chat et la souris dans une maison", "de": "der Hund und die Katze sind nicht im Haus"}
    rows = [(10 * i + n, f"{w} " * (4 + i), lang, f"src{n}") for i in range(20) for n, (lang, w) in enumerate(words.items())]
    rows += [(900, "This.", "en", "src1"), (901, "Avec.", "fr", "src9"), (902, "A.\nAll rights", "en", "src0"), (903, "Die tz.", "de", None), (904, "12 34", "en", "src0"), (905, "", "fr", "src1"), (906, None, "fr", "src1"), (907, "zzz", None, "src9")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    model = language.fit_text([(t, lang) for _, t, lang, _ in rows if t and lang])  # all rows: each language has fewer than its bound
    declared = Counter((s or "", lang) for _, _, lang, s in rows)
    totals = Counter(lang for _, _, lang, _ in rows)
    whole = {lang: (totals[lang] + 1) / sum(totals[x] + 1 for x in model.languages) for lang in model.languages}
    want = set()
    for i, t, lang, s in rows:
        data = (t or "").encode()
        buckets, _ = language.text_buckets(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        seen = [declared[(s or "", x)] for x in model.languages]
        # neither domain nor suffix: all hosts share theirs
        share = {x: (totals[x] + 20 * whole[x]) / (20 + sum(totals[y] for y in model.languages)) for x in model.languages}
        share = {x: (totals[x] + 20 * share[x]) / (20 + sum(totals[y] for y in model.languages)) for x in model.languages}
        score = np.array([
            np.clip(language.TEMPER * model.weights[n][buckets].sum(), -language.LIMIT, language.LIMIT) + np.log((seen[n] + 20 * share[x]) / (20 + sum(seen))) + (3.0 if lang == x else 0.0)
            for n, x in enumerate(model.languages)
        ])
        chance = np.exp(score - score.max())
        if len(buckets) and 1 / chance.sum() >= 0.5:
            want.add(i)
    assert {900, 901, 902, 903} <= want and not {904, 905, 906} & want
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert {r["doc_id"] for r in got.collect()} == want


def test_empty_documents_pass_through(spark, folder):
    """No rows in, no rows out, the same columns at every stage."""
    out = tempfile.mkdtemp(prefix="spark-")
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{out}/benchmark.parquet")
    got = corpus_pipeline.run(spark, out)
    assert got.count() == 0 and got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "exact"]
    docs = spark.read.parquet(f"{out}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, out).columns == COLUMNS

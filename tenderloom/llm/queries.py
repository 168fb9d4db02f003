"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, conversations, decontaminate, editprint, interpolate, language, licenses, minhash, quality, repeats, resample, toxicity
from .store import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op2_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = editprint.edited_probe(table(spark, sf_dir, "documents"))
    return probe.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def edit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2's banding and verification: the class of each document by fingerprints."""
    prints = editprint.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return editprint.near_classes(written(prints, "prints"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", language.markup_language(html).alias("declared"), language.visible_text(html).alias("text"))
    pages = written(pages, "pages")  # or every pass over the texts takes them out of the pages again
    return language.identify(pages, text="text", host=language.address_host(F.col("url")), declared=F.col("declared"), key=F.col("page_id"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def remainder(by: int) -> Column:
    """crc32 of doc_id as text, modulo ``by``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    x = written(quality.features(table(spark, sf_dir, "documents")), "features")
    model = quality.fit(*quality.training_rows(x, labels, label="quality", train=remainder(4) != 2))
    scored = quality.scores(x, model)
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return interpolate.model_scores(docs, held_out=remainder(10) == 0, deleted=remainder(10) == 1)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows, share = toxicity.sample(docs, labels, label="toxic", train=remainder(5) != 0)
    model = toxicity.fit(rows, share=share)
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.round_trip(docs, path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))
    return conversations.digests(found).withColumnRenamed("conv", "conv_id")


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_edit_fingerprints": op2_edit_fingerprints,
    "edit_neighbours": edit_neighbours,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality": op4_quality,
    "op5_language_id": op5_language_id,
    "op6_minhash": op6_minhash,
    "op8_license_scan": op8_license_scan,
    "op7_interpolated_lm": op7_interpolated_lm,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_importance_resample": op12_importance_resample,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every window of every item against every run of as many words of every document.
_CONTAMINATION = f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    bk AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
    dk AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bk) WHERE len(w) >= m)),
    h AS (SELECT doc_id, i, m, item_id FROM dk JOIN bk USING (m, k)),
    c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY 1),
    t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

ORACLES: dict[str, str] = {"op1_decontaminate": _CONTAMINATION, "op8_license_scan": licenses.oracle()}

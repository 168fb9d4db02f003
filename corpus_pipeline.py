"""A corpus pipeline: language, near copies, repeated passages, benchmark leaks, tokens.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next stage's ``docs``.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.llm import bpe, decontaminate, language, minhash, repeats
from tenderloom.llm.store import small_batches, written


#: Bytes of a passage that may not repeat.  Of 51 successive words of the corpora at hand 99 % have 230 bytes or more.
PASSAGE = 220


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those of no clear language; the source serves as host and ``lang`` as declaration."""
    small_batches(spark)
    found = language.identify(docs, text="text", host=F.col("source"), declared=F.col("lang"), key=F.col("doc_id"), keep_text=True)
    return found.where("reliable").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    small_batches(spark)
    gone = written(minhash.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages of PASSAGE bytes out of the texts; documents of which nothing is left go."""
    small_batches(spark)
    cut = repeats.remove_repeats(docs, length=PASSAGE, as_text=True)
    left = cut.where("n_bytes = 0 or kept <> ''")
    return left.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten successive words (or a whole shorter item) with the benchmark."""
    small_batches(spark)
    hits = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("size(spans) > 0")
    return docs.join(written(hits.select("doc_id"), "leaks"), "doc_id", "left_anti").select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit), and whether they decode to the text's bytes."""
    import public_tokenizers

    small_batches(spark)
    slim = docs.select("doc_id", "lang", "source", "text", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    coded = bpe.round_trip(slim, path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", (F.col("decoded") == F.col("raw")).alias("exact"))


STAGES = [
    ("language_id", identify_language),
    ("minhash", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("decontaminate", drop_benchmark_leaks),
    ("bpe", encode_tokens),
]

#: Several stages cannot be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

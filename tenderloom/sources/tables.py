"""Table sinks without a table format: append, upsert, update, delete, replace children, versioned state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` take the place of those of ``old`` with the same key; of equal new keys one stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def update(old: DataFrame, patch: DataFrame, key: list[str], when: Column | None = None) -> DataFrame:
    """Sets the patch's values that are not null, where ``when`` holds for the old row."""
    changed = [c for c in patch.columns if c not in key]
    p = patch.select(*key, *(F.col(c).alias(f"_p_{c}") for c in changed))
    ok = when if when is not None else F.lit(True)
    return old.join(p, key, "left").select(*(F.when(ok & F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in old.columns))


def delete(old: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    return old.join(ids.select(*key), key, "left_anti")


def replace_children(df: DataFrame, path: str, parent: str) -> None:
    """Writes the children of the parents in ``df`` in place of those that the path has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(path)


def setting(settings: DataFrame, key: str, fallback: str) -> DataFrame:
    """One row: the value of a setting as a whole, or the fallback."""
    return settings.where(F.col("key") == key).agg(F.coalesce(F.first("value", ignorenulls=True), F.lit(fallback)).alias("value"))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(title, text) of text files; the title is the file's name without its extension."""
    files = spark.read.option("pathGlobFilter", "*.{txt,md,markdown,csv,json}").text(folder, wholetext=True)
    name = F.try_element_at(F.split(F.input_file_name(), "/"), F.lit(-1))
    return files.select(F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "").alias("title"), F.col("value").alias("text"))


def manual_record(df: DataFrame) -> DataFrame:
    """A hand-entered record: texts trimmed, blanks null, the value without dollar signs and commas."""
    from ..functions.scalars import money

    return df.select(*(money(F.col(c)).alias(c) if c == "estimated_value" else F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not yet used in the folder that all executors share: ``spark.checkpoint.dir``, or in local mode without it a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"

"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage, survives a lost executor and is computed
once.  The folder is the session's ``spark.checkpoint.dir``; only where a
session in local mode has none (tests, a laptop) a temporary one is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _own.setdefault(app, _own.get(app) or tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, count: int, name: str) -> DataFrame:
    """The same rows as a table in the shared folder, in ``count`` buckets by ``key``, one file each."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(count, key).write.bucketBy(count, key).format("parquet").option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of a few MB for the Python stages, where the session still has Spark's 64 MB.

    Whole texts make large batches, which the executor holds outside of its heap, twice for each task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, f"{most}b")

"""Numbers of rows in a global order, without a window in one task, and batches made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.tables import new_folder


def numbered(rows: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Rows with their exact place from 1 in the given order, which should leave no ties.

    Sorted by ranges and written once; a row's place is its place in its part
    and what the parts before hold, of which the driver sees a count each.
    """
    spark = rows.sparkSession
    path = new_folder(spark, "numbered")
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    sorted_ = spark.read.schema(StructType([*rows.schema.fields, StructField("_at", LongType())])).parquet(path)
    part, before, starts = F.shiftright("_at", 33), 0, []
    for p, n in sorted(sorted_.groupBy(part.alias("p")).count().collect()):
        starts.append((p, before))
        before += n
    first = F.broadcast(spark.createDataFrame(starts, "_part bigint, _before bigint"))  # a row a part
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return sorted_.join(first, part == F.col("_part")).withColumn(name, place).drop("_at", "_part", "_before")


def batches(rows: DataFrame, *order: Column | str, size: int = 10) -> DataFrame:
    """Rows with ``batch`` (from 0) and ``i``, their place in it (from 0): ``size`` successive rows each."""
    placed = numbered(rows, *order, name="_place")
    at = F.col("_place") - 1
    return placed.withColumns({"batch": F.floor(at / size).cast("bigint"), "i": (at % size).cast("int")}).drop("_place")

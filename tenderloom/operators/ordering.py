"""Order-dependent operators: merging duplicates, continuation rows, pivots by row number, chunks, capped lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_of_each(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def merge_duplicates(df: DataFrame, key: str, position: str, fill: list[str], union: list[str]) -> DataFrame:
    """One row a key: for ``fill`` the first value that is not null, for ``union`` all distinct elements in order of first sight.

    An aggregation with map-side combination; positions are to be unique.
    """
    at = F.struct(position)
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in fill]
    lists = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("p"), F.col(c).alias("v")))), lambda x: x["v"]))).alias(c) for c in union]
    return df.groupBy(key).agg(*firsts, *lists)


def attach_continuations(df: DataFrame, group: list[str], position: str, header: str) -> DataFrame:
    """Gives rows without a header value that of the last row before them that has one."""
    before = Window.partitionBy(*group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(header, F.last(header, ignorenulls=True).over(before))


def pivot_rows(df: DataFrame, group: list[str], field: str, value: str, fields: list[str]) -> DataFrame:
    """Cells named FIELD$N to a row for each N: (group, row, the fields)."""
    cells = df.select(*group, F.regexp_extract(field, r"^(.+)\$(\d+)$", 1).alias("_f"), F.nullif(F.regexp_extract(field, r"^(.+)\$(\d+)$", 2), F.lit("")).cast("int").alias("row"), value).where("row is not null")
    return cells.groupBy(*group, "row").pivot("_f", fields).agg(F.first(value))


def chunks(text: Column, size: int = 1200, overlap: int = 150) -> Column:
    """Overlapping pieces of the text with white space collapsed, as an array; a blank text has none."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    step = size - overlap
    many = F.transform(F.sequence(F.lit(0), F.length(flat) - 1, F.lit(step)), lambda i: F.substring(flat, i + 1, F.lit(size)))
    return F.when(F.length(flat) == 0, F.array().cast("array<string>")).when(F.length(flat) <= size, F.array(flat)).otherwise(many)


def joined_texts(df: DataFrame, key: str, text: str, order: list[str], most: int, separator: str = "\n", header: Column | None = None, salts: int = 64) -> DataFrame:
    """Texts of a key in order, joined and cut to ``most`` characters; blank ones are left out.

    A text is gathered only if those before it leave room: first among the texts
    of its salt, which are fewer than all before it, then among what is left.  So
    a key gathers little more than ``most`` characters, and a key with very many
    texts is many groups first.
    """
    kept = df.where(F.length(F.trim(text)) > 0)
    part = F.substring(F.concat(header, F.col(text)) if header is not None else F.col(text), 1, most)
    rows = kept.select(F.col(key).alias("_k"), F.struct(*order).alias("_o"), part.alias("_t"))
    rows = rows.withColumn("_s", F.pmod(F.xxhash64("_o"), F.lit(salts)))
    for within in (["_k", "_s"], ["_k"]):
        before = Window.partitionBy(*within).orderBy("_o", "_t").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_n", F.coalesce(F.sum(F.length("_t") + len(separator)).over(before), F.lit(0))).where(F.col("_n") < most)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"])
    return rows.groupBy(F.col("_k").alias(key)).agg(F.substring(F.array_join(parts, separator), 1, most).alias("joined"))

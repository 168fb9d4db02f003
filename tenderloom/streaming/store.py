"""The crawl's tables: the state as a base with changes on top, and five outputs of every batch.

    base/through=<n>/_source=<s>/bucket=<b>   the state after batch n, by source and hash of the key
    bases/through=<n>                         that this base is whole
    begun/batch=<n>                           the time of batch n, written first
    taken/batch=<n>                           its rows, one a key: all else reads these, so the batch itself is evaluated once
    staged/batch=<n>                          its keys, classified against the state before
    <table>/batch=<n>                         opportunities (changed rows only), versions, log, attachments, notifications, counts
    commits/batch=<n>                         its counters, written last

Only committed batches are read.  What is written follows the batch, not the
state; the state is read by the sources and buckets that the batch touches.  A
batch that broke off is run again with the time that it began with, against the
same state, into the same folders; one that is committed changes nothing.  So
any number of replays leaves the tables as one clean run does.  Counts of the
state by its dimensions are kept: a batch writes what it takes from the old
values of its rows and adds to the new ones.  ``compact``
makes a new base; it may break off anywhere too.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cdc

TABLES = ("opportunities", "versions", "log", "attachments", "notifications", "counts")
#: What the outputs read of a snapshot's row; columns that it lacks are null.
SEEN = {"title": "string", "content_hash": "string", "due_date": "timestamp", "bucket": "string", "urgency": "string", "attachments": "array<struct<filename:string,url:string>>"}


@dataclass(frozen=True)
class Store:
    """``root``: a folder that all executors share.  After ``most`` batches on top of a base there is a new one."""

    root: str
    buckets: int = 64
    most: int = 32
    #: What the state is counted by: sets of its columns.
    dimensions: tuple[tuple[str, ...], ...] = (("status",), ("source_id",), ("source_id", "status"))


def _write(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(path) if by else rows.write.mode("overwrite").parquet(path)


def _bucket(store: Store) -> Column:
    return F.pmod(F.xxhash64(*cdc.KEY), F.lit(store.buckets)).cast("int")


def _write_base(rows: DataFrame, store: Store, through: int) -> None:
    dealt = rows.withColumns({"_source": F.col("source_id").cast("string"), "bucket": _bucket(store)}).repartition("_source", "bucket")
    _write(dealt, f"{store.root}/base/through={through}", "_source", "bucket")
    _write(rows.sparkSession.createDataFrame([(rows.sparkSession.version,)], "spark string"), f"{store.root}/bases/through={through}")


def _counted(rows: DataFrame, store: Store, n: int) -> DataFrame:
    """(dimension, value, n) of rows, each counting ``n``; values of several columns are joined by a bar, nulls are empty."""
    sets = [F.struct(F.lit("/".join(d)).alias("dimension"), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in d)).alias("value")) for d in store.dimensions]
    return rows.select(F.explode(F.array(*sets)).alias("d")).select("d.*", F.lit(n).alias("n"))


def _summed(counted: DataFrame) -> DataFrame:
    return counted.groupBy("dimension", "value").agg(F.sum("n").alias("n")).where("n <> 0")


def counts(spark: SparkSession, store: Store) -> DataFrame:
    """Rows of the state by every dimension and value, from the kept counts: no row of the state is read."""
    done = [r[0] for r in spark.read.parquet(f"{store.root}/commits").select("batch").collect()]
    return _summed(spark.read.option("basePath", f"{store.root}/counts").parquet(*(f"{store.root}/counts/batch={n}" for n in done)))


def create(store: Store, stored: DataFrame) -> None:
    """A store whose state before batch 0 is ``stored``, with keys, ``version_no`` (the last), status, dates and content_hash."""
    rows = stored if "version_no" in stored.columns else stored.withColumn("version_no", F.lit(1))
    _write_base(rows, store, -1)
    base = rows.sparkSession.read.parquet(f"{store.root}/base/through=-1")
    _write(_summed(_counted(base, store, 1)), f"{store.root}/counts/batch=-1")
    _write(rows.sparkSession.createDataFrame([(0, 0, 0, 0)], "items_found bigint, new_count bigint, changed_count bigint, closed_count bigint"), f"{store.root}/commits/batch=-1")


def committed(spark: SparkSession, store: Store) -> DataFrame:
    """The counters of every committed batch."""
    return spark.read.parquet(f"{store.root}/commits").where("batch >= 0")


def _numbers(spark: SparkSession, store: Store) -> tuple[int, list[int]]:
    """The last whole base, and the committed batches on top of it (``most`` and a few)."""
    through = spark.read.parquet(f"{store.root}/bases").agg(F.max("through")).first()[0]
    return through, sorted(r[0] for r in spark.read.parquet(f"{store.root}/commits").where(F.col("batch") > through).select("batch").collect())


def table(spark: SparkSession, store: Store, name: str) -> DataFrame:
    """All committed rows of an output, with their batch."""
    done = [r[0] for r in committed(spark, store).select("batch").collect()]
    return spark.read.option("basePath", f"{store.root}/{name}").parquet(*(f"{store.root}/{name}/batch={n}" for n in done))


def state(spark: SparkSession, store: Store, sources: Iterable[str] | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
    """The state after the last committed batch; of the given sources and buckets only, if any are given.

    Rows of the base that no change has replaced, and the last change of each
    other key: one anti join with the changed keys, no shuffle of the base if
    these are few.
    """
    through, batches = _numbers(spark, store)
    base = spark.read.parquet(f"{store.root}/base/through={through}")
    near = (F.lit(True) if sources is None else F.col("_source").isin(*sources)) & (F.lit(True) if buckets is None else F.col("bucket").isin(*buckets))
    base = base.where(near).drop("_source", "bucket")
    if not batches:
        return base
    changes = spark.read.option("basePath", f"{store.root}/opportunities").parquet(*(f"{store.root}/opportunities/batch={n}" for n in batches))
    changes = changes.withColumns({"_source": F.col("source_id").cast("string"), "bucket": _bucket(store)}).where(near)
    others = [c for c in base.columns if c not in cdc.KEY]
    last = changes.groupBy(*cdc.KEY).agg(F.max_by(F.struct(*others), "batch").alias("_r")).select(*cdc.KEY, "_r.*")
    return base.join(last.select(*cdc.KEY), cdc.KEY, "left_anti").unionByName(last)


def _begun(spark: SparkSession, store: Store, number: int, now: datetime | str | None) -> datetime:
    """The time of a batch: what an earlier try has written down, else ``now``."""
    path = f"{store.root}/begun"
    mine = spark.range(1).select((F.current_timestamp() if now is None else F.lit(now).cast("timestamp")).alias("at"))
    try:
        before = spark.read.parquet(path).where(F.col("batch") == number).first()
    except Exception as missing:  # the first batch of a store
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
            raise
        before = None
    if before is None:
        _write(mine, f"{path}/batch={number}")
        before = spark.read.parquet(f"{path}/batch={number}").first()
    return before["at"]


def _unique(rows: DataFrame) -> DataFrame:
    """One row a key: the first by ``position``, if there is such a column, then by its content."""
    whole = F.xxhash64(*[c for c in rows.columns if c != "position"])
    place = F.struct(F.col("position") if "position" in rows.columns else F.lit(0).alias("position"), whole.alias("h"))
    return cdc.first_of_each(rows.withColumn("_p", place), cdc.KEY, "_p").drop("_p", "position")


def outputs(classified: DataFrame, store: Store, at: Column) -> dict[str, DataFrame]:
    """The outputs of a batch, by table."""
    last = F.coalesce("stored.version_no", F.lit(0))
    number = F.when(F.col("change").isin("NEW", "AMENDED"), last + 1).otherwise(last)
    after, before = cdc.next_state(classified, at, number), classified.where("stored is not null").select(*cdc.KEY, "stored.*")
    return {
        "counts": _summed(_counted(after, store, 1).unionByName(_counted(before, store, -1))), "opportunities": after, "versions": cdc.version_rows(classified, number, at), "log": cdc.status_log(classified, at), "attachments": cdc.attachments(classified), "notifications": cdc.notifications(classified),
    }


def apply(spark: SparkSession, store: Store, batch: DataFrame, number: int, as_of: datetime | str | None = None, complete: bool = False) -> bool:
    """Takes a batch of snapshot rows in; False if it has been before.

    With ``complete`` the batch lists all that its sources have: keys of these
    sources that it lacks are closed or removed.  Batches are numbered in order.
    """
    if not spark.read.parquet(f"{store.root}/commits").where(F.col("batch") >= number).isEmpty():
        return False
    at = F.lit(_begun(spark, store, number, as_of))
    snapshot = _unique(batch.select("*", *(F.lit(None).cast(k).alias(c) for c, k in SEEN.items() if c not in batch.columns)))
    _write(snapshot, f"{store.root}/taken/batch={number}")
    snapshot = spark.read.schema(snapshot.schema).parquet(f"{store.root}/taken/batch={number}")
    near = snapshot.select(F.col("source_id").cast("string").alias("s"), _bucket(store).alias("b")).distinct().collect()
    sources = sorted({r["s"] for r in near if r["s"] is not None})
    buckets = None if complete else sorted({r["b"] for r in near})
    stored = state(spark, store, sources, buckets)
    if not complete:
        stored = stored.join(snapshot.select(*cdc.KEY), cdc.KEY, "left_semi")
    _write(cdc.classify(stored, snapshot, at, complete).where("change not in ('TERMINAL', 'ABSENT')"), f"{store.root}/staged/batch={number}")
    classified = spark.read.parquet(f"{store.root}/staged/batch={number}")
    for name, rows in outputs(classified, store, at).items():
        _write(rows, f"{store.root}/{name}/batch={number}")
    _write(cdc.counters(classified), f"{store.root}/commits/batch={number}")
    if len(_numbers(spark, store)[1]) >= store.most:
        compact(spark, store)
    return True


def compact(spark: SparkSession, store: Store) -> int:
    """A new base of all committed batches; the old one and the changes stay for readers that have begun."""
    through, batches = _numbers(spark, store)
    if batches:
        through = batches[-1]
        _write_base(state(spark, store), store, through)
    return through

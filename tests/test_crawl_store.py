"""The crawl's tables: broken batches, replays, compaction, and what a batch writes."""

from __future__ import annotations

import os
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tenderloom.operators import cdc
from tenderloom.streaming import crawl, store

NOW = datetime(2026, 7, 1)
STORED = "source_id int, external_id string, title string, status string, due_date timestamp, content_hash string, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp, version_no int"
SEEN = "source_id int, external_id string, title string, due_date timestamp, content_hash string, bucket string, urgency string, attachments array<struct<filename:string,url:string>>, position int"


def stored_rows(n=40):
    status = ("NEW", "OPEN", "AMENDED", "CLOSED")
    return [(i % 3, f"k{i}", f"t{i}", status[i % 4], NOW + timedelta(days=i - 20), f"h{i}", NOW, NOW, None, 1 + i % 2) for i in range(n)]


def batch_rows(b):
    """Keys of the store, changed ones, new ones and a repeated one."""
    rows = [(i % 3, f"k{i}", f"t{i}", NOW, f"h{i}" if i % 2 else f"h{i}-{b}", "IGNORE", None, None, 0) for i in range(b, 40, 4)]
    rows += [(1, f"new{b}", "Fresh", NOW, "x", "PURSUE", "URGENT", [("", "https://u/1"), ("b.pdf", "https://u/2")], 1), (1, f"new{b}", "Later", NOW, "y", "PURSUE", "URGENT", None, 2)]
    return rows + [(1, f"new{b - 1}", "Fresh again", NOW, "z", "CAPTURE_REVIEW", "URGENT", None, 0)]


def fresh(spark, **how):
    s = store.Store(tempfile.mkdtemp(prefix="spark-"), buckets=4, **how)
    store.create(s, spark.createDataFrame(stored_rows(), STORED))
    return s


def everything(spark, s):
    found = {name: sorted(map(str, store.table(spark, s, name).collect())) for name in store.TABLES}
    return found | {"state": sorted(str(r) for r in store.state(spark, s).select(sorted(store.state(spark, s).columns)).collect()), "commits": sorted(map(str, store.committed(spark, s).collect()))}


def run(spark, s, batches=3, complete=False):
    return [store.apply(spark, s, spark.createDataFrame(batch_rows(b), SEEN), b, NOW + timedelta(hours=b), complete) for b in range(batches)]


@pytest.fixture(scope="module")
def clean(spark):
    s = fresh(spark)
    assert run(spark, s) == [True] * 3
    return everything(spark, s)


def test_a_batch_equals_the_whole_join(spark):
    """State and outputs against the one full outer join over everything."""
    s = fresh(spark)
    stored = spark.createDataFrame(stored_rows(), STORED)
    for b in range(3):
        at = F.lit(NOW + timedelta(hours=b))
        rows = spark.createDataFrame(batch_rows(b), SEEN)
        whole = cdc.classify(stored, cdc.first_of_each(rows, cdc.KEY, "position").drop("position"), at, complete=False)
        last = F.when(F.col("change") == "NEW", 1).when(F.col("change") == "AMENDED", F.col("stored.version_no") + 1).otherwise(F.col("stored.version_no"))
        stored = spark.createDataFrame(cdc.next_state(whole, at, last).collect(), STORED)
        run(spark, s, b + 1)
        mine = store.state(spark, s).select(stored.columns)
        assert sorted(map(str, mine.collect())) == sorted(map(str, stored.collect()))
        recount = {("status", str(r["status"])): r["n"] for r in mine.groupBy("status").agg(F.count("*").alias("n")).collect()}
        recount |= {("source_id", str(r["source_id"])): r["n"] for r in mine.groupBy("source_id").agg(F.count("*").alias("n")).collect()}
        recount |= {("source_id/status", f"{r['source_id']}|{r['status']}"): r["n"] for r in mine.groupBy("source_id", "status").agg(F.count("*").alias("n")).collect()}
        assert {(r["dimension"], r["value"]): r["n"] for r in store.counts(spark, s).collect()} == recount
        assert {r["version_no"] for r in mine.where(f"external_id = 'new{b}'").collect()} == {1}
        assert tuple(store.committed(spark, s).where(F.col("batch") == b).select("items_found", "new_count", "changed_count", "closed_count").first()) == tuple(cdc.counters(whole).first())


@pytest.mark.parametrize("broken", [1, 4, 8])
def test_broken_batches_end_as_a_clean_run(spark, clean, monkeypatch, broken):
    """The batch breaks off before each of its writes (times, keys, six tables, commit) and is run again at a later time."""
    s, real = fresh(spark), store._write
    run(spark, s, 1)
    count = 0

    def failing(rows, path, *by):
        nonlocal count
        count += 1
        if count == broken + 1:
            raise OSError("lost")
        real(rows, path, *by)

    monkeypatch.setattr(store, "_write", failing)
    with pytest.raises(OSError, match="lost"):
        store.apply(spark, s, spark.createDataFrame(batch_rows(1), SEEN), 1, NOW + timedelta(hours=1))
    monkeypatch.setattr(store, "_write", real)
    before = everything(spark, s)
    assert len(before["commits"]) == 1
    assert store.apply(spark, s, spark.createDataFrame(batch_rows(1), SEEN), 1, NOW + timedelta(days=9))
    assert store.apply(spark, s, spark.createDataFrame(batch_rows(2), SEEN), 2, NOW + timedelta(hours=2))
    assert everything(spark, s) == clean


def test_replays_and_compaction_change_nothing(spark, clean):
    s = fresh(spark)
    run(spark, s)
    assert run(spark, s) == [False] * 3
    assert everything(spark, s) == clean
    assert store.compact(spark, s) == 2 and store.compact(spark, s) == 2
    assert everything(spark, s) == clean
    often = fresh(spark, most=1)
    run(spark, often)
    assert everything(spark, often) == clean and sorted(os.listdir(f"{often.root}/base")) == [f"through={n}" for n in (-1, 0, 1, 2)]


def test_complete_snapshots_close_what_they_lack(spark):
    s = fresh(spark)
    rows = spark.createDataFrame([r for r in batch_rows(0) if r[0] == 1], SEEN)
    store.apply(spark, s, rows, 0, NOW, complete=True)
    whole = cdc.classify(spark.createDataFrame(stored_rows(), STORED).where("source_id = 1"), cdc.first_of_each(rows, cdc.KEY, "position").drop("position"), F.lit(NOW))
    want = {(r["external_id"]): r["new_status"] for r in whole.collect()}
    assert {r["external_id"]: r["status"] for r in store.state(spark, s).where("source_id = 1").collect()} == want
    assert {r["status"] for r in store.state(spark, s).where("source_id <> 1").collect()} == {"NEW", "OPEN", "AMENDED", "CLOSED"}


def test_a_batch_writes_and_reads_by_its_own_size(spark):
    def size(folder):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))

    written = {}
    for n in (2_000, 40_000):
        s = store.Store(tempfile.mkdtemp(prefix="spark-"), buckets=16)
        big = spark.range(n).select((F.col("id") % 3).cast("int").alias("source_id"), F.concat(F.lit("k"), "id").alias("external_id"), F.sha2(F.col("id").cast("string"), 256).alias("title"), F.lit("OPEN").alias("status"), F.lit(NOW).alias("due_date"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), *(F.lit(NOW).alias(c) for c in ("first_seen_at", "last_seen_at")), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(1).alias("version_no"))
        store.create(s, big)
        base = size(s.root)
        store.apply(spark, s, spark.createDataFrame([(1, "k1", "t", NOW, "new", None, None, None, 0)], SEEN), 0, NOW)
        written[n] = (size(s.root) - base, base)
    assert written[40_000][0] < 1.2 * written[2_000][0] and written[40_000][1] > 8 * written[2_000][1]
    few = store.state(spark, s, ["1"], [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in few and "_source" in few.split("PartitionFilters: [")[1].split("]")[0] and "bucket" in few.split("PartitionFilters: [")[1].split("]")[0]


def test_streamed_crawl(spark, clean):
    s, folder = fresh(spark), tempfile.mkdtemp(prefix="spark-")
    numbers = []
    for b in range(3):
        spark.createDataFrame(batch_rows(b), SEEN).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        crawl.follow(spark, f"{folder}/in", spark.createDataFrame([], SEEN).schema, s, f"{folder}/check", NOW + timedelta(hours=b), on_batch=numbers.append).awaitTermination(120)
    assert numbers == [0, 1, 2]
    assert everything(spark, s) == clean


def test_a_batch_is_evaluated_once(spark):
    s = fresh(spark)
    seen = spark.sparkContext.accumulator(0)

    def told(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame(batch_rows(0), SEEN)
    assert store.apply(spark, s, rows.mapInArrow(told, rows.schema), 0, NOW) and seen.value == len(batch_rows(0))

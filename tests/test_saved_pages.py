"""Saved pages as a data source."""

from __future__ import annotations

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tenderloom.sources import portals, saved


@pytest.fixture(scope="module")
def folder(spark):
    events = lambda *names: json.dumps({"data": [{"id": f"26RFP{n}", "eventName": f"Event {n}\nof two lines"} for n in names]})
    rows = [("sd", 0, events(0, 1)), ("sd", 1, events(2, 3)), ("sd", 2, events(4)), ("sd", 3, events(8, 9)), ("wv", 0, json.dumps([{"DOC_ID": "B é"}])), ("x", 0, "")]
    path = tempfile.mkdtemp(prefix="spark-") + "/pages"
    saved.save(spark.createDataFrame(rows, saved.SCHEMA), path)
    return path, rows


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_every_page_is_a_partition(spark, folder, scheme):
    path, rows = folder
    df = saved.load(spark, scheme + path)
    assert sorted(map(tuple, df.collect())) == sorted(rows) and df.rdd.getNumPartitions() == len(rows)


@pytest.mark.parametrize(
    ("condition", "files"), [("key = 'sd'", 4), ("key in ('sd', 'x') and page < 2", 3), ("page >= 1 and page <= 2", 2), ("key = 'sd' and payload like '%26RFP8%'", 4), ("upper(key) = 'WV'", 6), ("key = 'none'", 0)]
)
def test_filters_choose_files(spark, folder, condition, files):
    path, rows = folder
    df = saved.load(spark, path).where(condition)
    want = spark.createDataFrame(rows, saved.SCHEMA).where(condition)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    assert df.rdd.getNumPartitions() == max(files, 1)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters: [") and line != "PushedFilters: []"]
    assert bool(pushed) == (files < 6)


def test_dialects_read_the_source_as_they_read_a_table(spark, folder):
    path, rows = folder
    mine = saved.whole(saved.load(spark, path).where("key = 'sd'"), F.size(F.from_json(F.get_json_object("payload", "$.data"), "array<struct<id:string>>")), 2)
    plain = spark.createDataFrame([r for r in rows if r[0] == "sd" and r[1] < 3], saved.SCHEMA)
    found = sorted(map(str, portals.sd(mine).collect()))
    assert found == sorted(map(str, portals.sd(plain).collect())) and len(found) == 5


@pytest.mark.parametrize("condition", ["key = 'sd'", "page = 3", "page in (1, 9)", "page > 3 and page < 9", "page >= 4 and page <= 5", "key = 'sd' and page < 1", "page > 40", "payload like '%é%'"])
def test_pages_saved_in_runs_are_read_as_pages_of_their_own(spark, condition):
    rows = [(k, n, f'{k} {n}\n"é"\u2028 \\ ') for k in ("sd", "x") for n in range(10)] + [("x", 10, "")]
    path = tempfile.mkdtemp(prefix="spark-") + "/pages"
    saved.save(spark.createDataFrame(rows, saved.SCHEMA), path, per_file=4)
    df = saved.load(spark, path)
    assert df.rdd.getNumPartitions() == 6 and sorted(map(tuple, df.collect())) == rows
    assert sorted(map(tuple, df.where(condition).collect())) == sorted(map(tuple, spark.createDataFrame(rows, saved.SCHEMA).where(condition).collect()))


def test_many_files_are_few_partitions(spark, folder, monkeypatch):
    path, rows = folder
    monkeypatch.setattr(saved, "SINGLE", 2)
    reader = saved.SavedPagesReader(path)
    parts = reader.partitions()
    assert len(parts) <= 4 and sorted((f.key, f.first) for p in parts for f in p.files) == sorted(r[:2] for r in rows)
    assert sorted(tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()) == sorted(rows)

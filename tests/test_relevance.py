"""Global numbers, batches, prompts and verdicts."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tenderloom.functions.profile import DEFAULT
from tenderloom.operators import numbering, relevance, workflow

SCHEMA = "id int, title string, agency string, category string, naics_code string, description string, relevance_score int"


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_are_the_global_order(spark, parts):
    random.seed(parts)
    rows = [(i, random.choice([None, "a", "b", "c"])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, name string").repartition(parts)
    got = {r["id"]: r["position"] for r in numbering.numbered(df, "name", F.desc("id")).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", -r[0]))
    assert got == {i: n + 1 for n, (i, _) in enumerate(order)}
    assert numbering.numbered(df.limit(0), "id").count() == 0


def test_verdicts_by_batches(spark):
    rows = [(i, f"Title {i}" * 40, None, "c", None, "two\n  lines", i) for i in range(23)]
    df = spark.createDataFrame(rows, SCHEMA)
    about = relevance.profile_text("Acme", None, DEFAULT)
    assert about.startswith("Company: Acme\nCertifications: SBA-certified 8(a)") and "Target NAICS: 541511" in about and "About" not in about
    found = {r["batch"]: (r["size"], r["prompt"]) for r in relevance.prompts(numbering.batches(df, "id"), about).collect()}
    assert {b: n for b, (n, _) in found.items()} == {0: 10, 1: 10, 2: 3}
    listed = json.loads(found[2][1].split("SOLICITATIONS (JSON)\n")[1].split("\n\n")[0])
    assert [x["i"] for x in listed] == [0, 1, 2] and listed[0] == {"i": 0, "title": ("Title 20" * 40)[:220], "agency": "", "category": "c", "naics": "", "desc": "two lines"}
    reply = F.when(F.col("batch") == 0, '[{"i":3,"score":88,"rec":"BID","reason":"fits"},{"i":10,"score":1}]').when(F.col("batch") == 1, "no json").otherwise('[{"i":2,"score":5,"rec":"no bid"}]')
    verdicts = relevance.classify(df, about, "id", ask=lambda p: p.withColumn("reply", reply))
    assert {tuple(r) for r in verdicts.collect()} == {(3, 88, "BID", "fits"), (22, 5, "NO_BID", "No reason given")}
    offline = relevance.classify(df, about, "id")
    assert offline.count() == 0
    assert {(r["id"], r["relevance_score"]) for r in workflow.merge_verdicts(df.select("id", "relevance_score"), offline).collect()} == {(i, i) for i in range(23)}

"""Scoring goldens, change capture, serving, scalars, portals, tables and streams."""

from __future__ import annotations

import json
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tenderloom.functions import matching, scalars as fn
from tenderloom.functions import profile as prof
from tenderloom.operators import cdc, drafting, ordering, reminders, retrieval, scoring
from tenderloom.plans import serving
from tenderloom.sources import portals, tables

NOW = datetime(2026, 7, 1)


def as_of():
    return F.lit("2026-07-01").cast("timestamp")


COLUMNS = "id int, title string, description string, category string, agency string, naics_code string, source_state string, estimated_value double, due_date timestamp, doc_text string"


#: All rows are scored in one job: the profile's plan is large and costs more to compile than to run.
CASES = {
    "sum": dict(title="RFP: Cloud Migration and Software Development", description="8(a) set-aside. GSA MAS. Help Desk, Tier 1.", naics_code="541512", source_state="VA", estimated_value=500_000.0),
    "roof": dict(title="Roofing replacement"),
    "kept": dict(title="Construction management with Data Analytics"),
    "weak": dict(title="Construction and Network Support"),
    "plural": dict(title="Software Developers"), "labor": dict(title="QA Analyst"), "symbols": dict(title="C# and .NET developers, SQL"), "inside": dict(title="retail maintenance of associates"),
    "tier": dict(title="Tier 2 widget"), "tier_support": dict(title="Tier 2 support"), "dod": dict(title="Sources Sought", agency="Department of Defense"),
    "dod_it": dict(title="Cloud Support, Software Development", agency="DoD"), "wosb": dict(title="WOSB small business"),
    "doc": dict(title="x", doc_text="y" * 29_990 + " AWS later"), "doc_cut": dict(title="x", doc_text="y" * 30_000 + " AWS"), "state": dict(title="", agency="Ohio State Board"),
    **{f"due{d}": dict(title="x", due_date=None if d is None else NOW + timedelta(days=d)) for d in (9, 10, 20, 21, 45, 46, None)},
    **{f"value{v}": dict(title="x", estimated_value=v) for v in (24_999.0, 25_000.0, 100_000.0, 1_000_000.0, 10_000_000.0, 0.0, -5.0, None)},
}


@pytest.fixture(scope="module")
def scored(spark):
    empty = {"title": "", "description": None, "category": None, "agency": None, "naics_code": None, "source_state": None, "estimated_value": None, "due_date": NOW + timedelta(days=30), "doc_text": None}
    rows = [tuple(({"id": i} | empty | given)[c.split()[0]] for c in COLUMNS.split(", ")) for i, given in enumerate(CASES.values())]
    found = scoring.score(spark.createDataFrame(rows, COLUMNS), prof.DEFAULT, as_of()).collect()
    return {name: next(r for r in found if r["id"] == i) for i, name in enumerate(CASES)}


def test_scores_add_up(scored):
    r = scored["sum"]
    assert (r["pursuit_score"], r["bucket"], r["urgency"]) == (8 + 10 + 7 + 6 + 2 + 10 + 5 + 6 + 2, "MANUAL_REVIEW", "STANDARD")
    assert r["set_asides"] == ["8(a) Set-Aside"] and r["contract_vehicle"] == "GSA MAS" and r["solicitation_type"] == "RFP" and r["agency_priority"]
    assert [e["criterion"] for e in r["breakdown"]][:3] == ["Application Development", "Cloud", "Service Desk"] and sum(e["points"] for e in r["breakdown"]) == r["pursuit_score"]


def test_exclusions_and_overrides(scored):
    out = scored["roof"]
    assert (out["pursuit_score"], out["bucket"], out["excluded_reason"]) == (0, "IGNORE", "Roofing (Construction)")
    assert scored["kept"]["excluded_reason"] is None and any(e["criterion"] == "Exclusion overridden (Construction)" for e in scored["kept"]["breakdown"])
    assert scored["weak"]["excluded_reason"] == "Construction (Construction)"  # six points do not override


def test_small_rules(scored):
    points = {"plural": 0, "labor": 10, "symbols": 19, "inside": 0, "tier": 0, "tier_support": 7, "dod": 1, "dod_it": 24, "doc": 8, "doc_cut": 0, "state": 5}
    assert {n: scored[n]["pursuit_score"] for n in points} == points
    assert scored["wosb"]["set_asides"] == ["WOSB Set-Aside"]


def test_urgency_and_value_bands(scored):
    bands = {9: "INSUFFICIENT_TIME", 10: "URGENT", 20: "URGENT", 21: "STANDARD", 45: "STANDARD", 46: "EARLY_CAPTURE", None: "NO_DATE"}
    assert {d: scored[f"due{d}"]["urgency"] for d in bands} == bands
    points = {24_999.0: -2, 25_000.0: 0, 100_000.0: 2, 1_000_000.0: 3, 10_000_000.0: 1, 0.0: 0, -5.0: 0, None: 0}
    assert {v: scored[f"value{v}"]["pursuit_score"] for v in points} == points


def test_profile_text_and_versions():
    assert prof.parse_pairs("Java -> dev\nbad line\n -> x") == (("Java", "dev"),)
    assert prof.parse_points("RFP: 2\nno points:\nA: b: -3") == (("RFP", 2), ("A: b", -3))
    assert prof.parse_agencies("DoD | Defense; War | IT-ONLY\nGSA\n\n") == (prof.Agency("DoD", ("Defense", "War"), True), prof.Agency("GSA"))
    assert prof.next_version(prof.DEFAULT, 4).version == 5
    with pytest.raises(ValueError, match="pursue"):
        prof.next_version(prof.Profile(pursue="80"), 1)
    terms = sum(len(c.phrases) for c in prof.DEFAULT.capabilities)
    assert (len(prof.DEFAULT.capabilities), terms, len(prof.DEFAULT.labor), len(prof.DEFAULT.technologies), len(prof.DEFAULT.federal), len(prof.DEFAULT.states)) == (11, 93, 21, 23, 21, 13)
    assert matching.is_case_sensitive("C#") and not matching.is_case_sensitive("Java")


def test_content_hash_and_fallback(spark):
    text = lambda x: F.lit(x).cast("string")
    row = spark.range(1).select(
        cdc.content_hash(text('Cloud "Migration" '), text("DIT"), text("2026-08-01T21:00:00.000Z"), text(None), text(None), F.lit(250000.0), text("Open"), F.array(F.lit("https://b/x.pdf"), F.lit("https://a/y.pdf"))).alias("a"),
        cdc.content_hash(text("X"), text(None), text(None), text(None), text(None), F.lit(None).cast("double"), text(None), F.lit(None).cast("array<string>")).alias("b"),
        cdc.fallback_id(text("Cloud Migration"), text("DIT"), text("2026-08-01")).alias("c"), fn.fnv1a(F.lit("software")).alias("d"),
    ).first()
    assert row["a"] == "bf2be58ceb485523e6018c50b9d6a778e9eecd6ef6b1961cf756e4cc07fa4120" and row["b"] == "6577a3a84e5f4625d13c4721cf3900908b8ad5f959460eb7b8fc10140193e937"
    assert row["c"] == "02d055b29da20be92d80789f" and row["d"] == 1109888656


STORED = "source_id int, external_id string, title string, status string, due_date timestamp, content_hash string, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp"


def crawl_tables(spark):
    old = lambda k, status, due=None, h="h": (1, k, k, status, due, h, NOW, NOW, None)
    stored = spark.createDataFrame([old("same", "NEW"), old("same2", "AMENDED"), old("diff", "OPEN"), old("diffclosed", "CLOSED"), old("late", "OPEN", NOW - timedelta(days=1)), old("gone", "OPEN", NOW + timedelta(days=1)), old("undated", "NEW"), old("done", "AWARDED")], STORED)
    seen = spark.createDataFrame([(1, "fresh", "Fresh", NOW, "h", "PURSUE", "URGENT"), (1, "same", "same", None, "h", None, None), (1, "same2", "same2", None, "h", None, None), (1, "diff", "Diff", None, "x", "IGNORE", None), (1, "diffclosed", "d", None, "x", None, None)], "source_id int, external_id string, title string, due_date timestamp, content_hash string, bucket string, urgency string")
    return stored, seen


def test_change_capture(spark):
    stored, seen = crawl_tables(spark)
    c = cdc.classify(stored, seen, as_of())
    got = {r["external_id"]: (r["change"], r["new_status"]) for r in c.collect()}
    assert got == {"fresh": ("NEW", "NEW"), "same": ("UNCHANGED", "OPEN"), "same2": ("UNCHANGED", "AMENDED"), "diff": ("AMENDED", "AMENDED"), "diffclosed": ("AMENDED", "CLOSED"), "late": ("CLOSED", "CLOSED"), "gone": ("REMOVED", "REMOVED"), "undated": ("REMOVED", "REMOVED"), "done": ("TERMINAL", "AWARDED")}
    assert tuple(cdc.counters(c).first()) == (5, 1, 2, 3)
    assert {r["external_id"] for r in cdc.status_log(c, as_of()).collect()} == {"fresh", "diff", "late", "gone", "undated"}
    assert {(r["external_id"], r["type"], r["severity"]) for r in cdc.notifications(c).collect()} == {("fresh", "NEW_OPPORTUNITY", "warning"), ("diff", "AMENDMENT", "warning"), ("diffclosed", "AMENDMENT", "warning")}
    history = spark.createDataFrame([(1, "diff", 4)], "source_id int, external_id string, version_no int")
    assert {(r["external_id"], r["version_no"]) for r in cdc.versions(c, history, as_of()).collect()} == {("fresh", 1), ("diff", 5), ("diffclosed", 1)}
    state = cdc.next_state(c, as_of())
    again = {r["external_id"]: r["change"] for r in cdc.classify(state, seen, as_of()).collect()}
    assert not {"NEW", "AMENDED"} & set(again.values())  # the same snapshot again changes nothing
    partial = {r["external_id"]: r["change"] for r in cdc.classify(stored, seen.limit(0), as_of(), complete=False).collect()}
    assert set(partial.values()) == {"ABSENT", "TERMINAL"}


def test_reminders(spark):
    rows = [(1, "OPEN", NOW + timedelta(hours=20)), (2, "OPEN", NOW + timedelta(days=3)), (3, "OPEN", NOW + timedelta(days=7)), (4, "CLOSED", NOW + timedelta(days=1)), (5, "NEW", None), (6, "OPEN", NOW - timedelta(hours=1))]
    sent = spark.createDataFrame([(3, "DEADLINE", 7)], "id int, type string, days_out int")
    got = reminders.deadline_reminders(spark.createDataFrame(rows, "id int, status string, due_date timestamp"), sent, as_of()).collect()
    assert {(r["id"], r["days_out"], r["severity"]) for r in got} == {(1, 1, "critical"), (2, 3, "warning")}


def test_scalars(spark):
    texts = {"a": "7/22/2026", "b": "7/22/26", "c": "7/22/2026 2:00 PM", "d": "7/22/2026 12:05:09 am", "e": "13/40/2026", "f": ""}
    r = spark.range(1).select(*(fn.us_date(F.lit(t)).alias(k) for k, t in texts.items()), fn.ms_date(F.lit("/Date(1782411340000)/")).alias("ms"), fn.month_name_date(F.lit("2:00 p.m., Thursday, August 27, 2026")).alias("prose"), fn.half_day_time(F.lit("2026-07-22"), F.lit("01:30")).alias("half"), fn.local_time(F.lit("2026-07-22T11:00:00"), F.lit("CT")).alias("local"), fn.bracketed_id(F.lit("x [a][b-2]")).alias("id"), fn.money(F.lit("$1,200.50")).alias("money"), fn.money(F.lit("0")).alias("zero"), fn.file_name(F.lit("https://h/a/b%20c.pdf?x=1")).alias("file"), fn.slug_id(F.lit("  A b/C! ")).alias("slug"), fn.status_of_attachments(F.lit("Notice of Award")).alias("status"), fn.currency(F.lit(2_500_000.0)).alias("cur")).first()
    assert r["a"] == r["b"] == datetime(2026, 7, 22, 5) and r["c"] == datetime(2026, 7, 22, 19) and r["d"] == datetime(2026, 7, 22, 5, 5, 9) and r["e"] is None and r["f"] is None
    assert r["ms"] == datetime(2026, 6, 25, 18, 15, 40) and r["prose"] == datetime(2026, 8, 27, 19) and r["half"] == datetime(2026, 7, 22, 17, 30) and r["local"] == datetime(2026, 7, 22, 16)
    assert (r["id"], r["money"], r["zero"], r["file"], r["slug"], r["status"], r["cur"]) == ("b-2", 1200.5, None, "b c.pdf", "a-b-c", "Intent to Award Posted", "$2.5M")


def test_chunks_and_drafts(spark):
    text = "ab " * 900
    got = spark.createDataFrame([(1, text), (2, ""), (3, "x")], "id int, t string").select("id", ordering.chunks(F.col("t")).alias("c")).collect()
    flat = " ".join(text.split())
    assert got[0]["c"] == [flat[i : i + 1200] for i in range(0, len(flat), 1050)] and got[1]["c"] == [] and got[2]["c"] == ["x"]
    lines = drafting.markdown_lines(spark.createDataFrame([(1, "# T\n- b\n> q\n\n|a|\np")], "id int, t string"), "id", "t").orderBy("line").collect()
    assert [(r["kind"], r["content"]) for r in lines] == [("heading1", "T"), ("bullet", "b"), ("quote", "q"), ("blank", ""), ("table", "|a|"), ("paragraph", "p")]
    drafts = [(1, "T *x*", "# T **b**\n- b\n> q\n\n|a|\np"), (2, None, None), (3, "", "  **a****b** *c*\r\n*  **\n-x\n> > y **z\n|\n||\n####  n\n###\n### ")]
    lines = drafting.export_lines(spark.createDataFrame(drafts, "id int, h string, t string"), "id", "h", "t").orderBy("id", "line").collect()
    assert [(r["id"], r["kind"], [(x["text"], x["bold"]) for x in r["runs"]]) for r in lines] == [
        (1, "title", [("T *x*", False)]), (1, "heading1", [("T **b**", False)]), (1, "bullet", [("b", False)]), (1, "quote", [("q", False)]), (1, "blank", []), (1, "table", [("a", False)]), (1, "paragraph", [("p", False)]),
        (2, "title", [("", False)]), (3, "title", [("", False)]), (3, "paragraph", [("a", True), ("b", True), (" *c*", False)]), (3, "bullet", [("", True)]), (3, "paragraph", [("-x", False)]),
        (3, "quote", [("> y **z", False)]), (3, "paragraph", [("|", False)]), (3, "table", []), (3, "paragraph", [("####  n", False)]), (3, "paragraph", [("###", False)]), (3, "paragraph", [("###", False)]),
    ]
    named = spark.createDataFrame([("A b", "R 1/2", "o"), (None, None, "o"), (None, None, "")], "t string, e string, o string")
    assert [tuple(r) for r in named.select(drafting.export_title(F.col("t"), F.col("e"), F.col("o")), drafting.export_name(F.col("e"))).collect()] == [("A b — R 1/2", "Response_R_1_2.docx"), ("o", None), ("Proposal", None)]
    made = spark.range(1).select(drafting.prompt(F.lit("T"), F.lit(None).cast("string"), F.lit("D"), F.lit(""), F.lit("E"), False).alias("p")).first()["p"]
    assert "EXAMPLES:\nE" in made and "DOCUMENTS" not in made and "AGENCY: unknown" in made


def test_embedding_and_verdicts(spark):
    rows = {r["bucket"]: r["weight"] for r in retrieval.embed(spark.createDataFrame([(1, "Cloud migration services")], "id int, t string"), "id", "t").collect()}
    assert rows == {43: 1, 148: 0.75, 300: 0.5, 894: 1, 1077: 1.75, 1340: 0.5, 1362: 0.5}
    unit = retrieval.unit(retrieval.embed(spark.createDataFrame([(1, "Cloud migration services")], "id int, t string"), "id", "t"), "id").agg(F.sum(F.col("weight") ** 2)).first()[0]
    assert abs(unit - 1) < 1e-9
    replies = [(1, "no json"), (2, 'x [{"i":0,"score":72.5,"rec":"nobid","reason":""},{"i":9,"score":1}] y'), (3, '[{"i":1,"score":"abc","rec":"maybe"}]'), (4, '[{"i":0,"score":140,"rec":"bid"}]'), (5, "[bad"), (6, None)]
    got = {(r["id"], r["i"]): (r["score"], r["recommendation"]) for r in retrieval.parse_verdicts(spark.createDataFrame([(i, t, 2) for i, t in replies], "id int, reply string, size int"), "reply", "size").collect()}
    assert got == {(2, 0): (73, "NO_BID"), (3, 1): (0, "REVIEW"), (4, 0): (100, "BID")}


def payload(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page int, payload string")


def test_json_portals(spark):
    one = lambda df: df.orderBy("external_id").collect()
    r = one(portals.tx(payload(spark, json.dumps({"lines": [{"solicitationId": "T1", "title": " A  b ", "responseDue": "7/22/2026", "responseTime": "4:00 PM", "nigpCodes": "92000 - Data; 91800 - Advice"}, {"title": "no id"}, {"solicitationId": "T1", "title": "again"}]}))))
    assert len(r) == 1 and r[0]["title"] == "A b" and r[0]["due_date"] == datetime(2026, 7, 22, 21) and r[0]["category"] == "Data; Advice"
    r = one(portals.nc(payload(spark, json.dumps({"Records": [{"Id": "i", "Attributes": [{"Name": "evp_solicitationnbr", "DisplayValue": "N-1"}, {"Name": "evp_opendate", "Value": "/Date(1782411340000)/"}]}]}))))
    assert r[0]["external_id"] == "N-1" and r[0]["title"] == "N-1" and r[0]["due_date"] == datetime(2026, 6, 25, 18, 15, 40)
    assert all(f(payload(spark, "not json", "")).count() == 0 for f in portals.REGISTRY.values())


def test_html_portals(spark):
    cells = lambda *x: "<tr>" + "".join(f"<td>{c}</td>" for c in x) + "</tr>"
    ma = portals.REGISTRY["ma"](payload(spark, cells("M1", "", "Agency", "", "", "", "First", "7/22/2026"), cells("M1", "", "Agency", "", "", "", "Second", "7/22/2026"))).collect()
    assert [r["title"] for r in ma] == ["Second"] and ma[0]["due_date"] == datetime(2026, 7, 22, 4)
    span = lambda f, n, x: f'<span class="v" id="{f}${n}">{x}</span>'
    ok = portals.grid(payload(spark, span("SCP_PUB_AUC_VW_AUC_ID", 0, "K1") + span("SCP_PUB_AUC_VW_AUC_NAME", 0, "Name") + span("SCP_PUB_AUC_VW_AUC_NAME", 1, "no id"))).collect()
    assert [(r["external_id"], r["title"]) for r in ok] == [("K1", "Name")]
    with pytest.raises(KeyError):
        portals.preview("nowhere", payload(spark, ""))


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, v string, w string")
    assert {tuple(r) for r in tables.upsert(old, spark.createDataFrame([(2, "c", "z"), (3, "d", None)], "k int, v string, w string"), ["k"]).collect()} == {(1, "a", "x"), (2, "c", "z"), (3, "d", None)}
    assert {tuple(r) for r in tables.update(old, spark.createDataFrame([(1, "n"), (2, "n")], "k int, v string"), ["k"], F.col("w").isNotNull()).collect()} == {(1, "n", "x"), (2, "b", None)}
    assert [r["k"] for r in tables.delete(old, old.where("k = 1"), ["k"]).collect()] == [2]
    path = tempfile.mkdtemp(prefix="spark-") + "/t"
    tables.replace_children(old, path, "k")
    tables.replace_children(spark.createDataFrame([(2, "new", None)], "k int, v string, w string"), path, "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "new")}
    assert tables.setting(spark.createDataFrame([], "key string, value string"), "ai", "{}").first()["value"] == "{}"
    assert tables.manual_record(spark.createDataFrame([(" t ", " ", "$0")], "title string, agency string, estimated_value string")).first().asDict() == {"title": "t", "agency": None, "estimated_value": None}


def test_default_view_and_plan(spark):
    f = serving.default_view()
    assert (f.bucket, f.sort, f.min_days, f.limit) == ("ACTIONABLE", "score", 10, 400) and serving.default_view("ALL").bucket is None


def test_registered_queries_have_columns(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60

"""Work that grows no faster than its input, and values at the edges of larger tables."""

from __future__ import annotations

import json

import duckdb
from pyspark.sql import functions as F

from tenderloom import catalogue
from tenderloom.functions import scalars as fn
from tenderloom.functions import texts
from tenderloom.sources import markup as mk
from tenderloom.sources import portals


def test_labels_are_read_below_the_explode(spark):
    pages = spark.createDataFrame([(0, json.dumps({"data": {}}))], "page int, payload string")
    lines = portals.REGISTRY["ky"](pages)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    explode = next(n for n, line in enumerate(lines) if "Generate" in line)
    assert all(n > explode for n, line in enumerate(lines) if "codedValuesList" in line)


def test_ties_of_vector_literals_are_even(spark):
    values = [n / 2**7 for n in range(-40, 41)] + [n / 2**24 for n in range(0, 2**24, 65537)] + [1e9 + 0.5, -0.0, 123456.78125, float("inf"), float("-inf"), float("nan")]
    mine = spark.createDataFrame([(values,)], "v array<float>").select(fn.vector_literal(F.col("v"))).first()[0]
    theirs = duckdb.execute("SELECT '[' || array_to_string(list_transform(?::FLOAT[], lambda x: printf('%.6f', x::DOUBLE)), ',') || ']'", [values]).fetchone()[0]
    assert mine == theirs


def test_parts_of_a_page_are_trees_of_their_own(spark):
    rows = "".join(f"<tr><td>{n}</td><td><a href='/{n}'>é {n}</a></td></tr>" for n in range(60))
    pages = spark.createDataFrame([(0, f"<title>A page</title><p>before</p><table class='bid'>{rows}</table>")], "page int, payload string")
    parts = mk.parts(pages, ("tr",), lambda e: "bid" if e["classes"] == "bid" else None)
    got = parts.select("position", "head", F.size("nodes").alias("n"), F.length("words").alias("w"), mk.text(mk.node(F.lit(3))).alias("link"), F.col("around")[0]["place"].alias("place"), mk.inside("bid", 0).alias("inside")).collect()
    assert [tuple(r) for r in got] == [(n, "A page", 4, len(f"{n}é {n}"), f"é {n}", n, True) for n in range(60)]


def test_plain_pages_are_read_as_others():
    class Slow(mk.Tree):
        def _plain(self, page):
            return False

    pages = [
        "<TABLE Class='bid x'><tr><td>a &amp; b<br/>c<td title=\"1 > 0\" hidden>d &lt;e</table>tail &nbsp;", "<p>one<p id='h'>two <b>deep</b></p></div><ul><li>x<li><a href='?a=1&amp;b=2&copy=3'>y</a></ul>", "no tags & none", "",
        "<a href='x' href='z'>t</a><img src='i'/><dl><dt>h<dd><p>q</p></dl>", "<a href=bare>1 < 2</a>", "<!-- <p> --><p>z</p>", "<script>'<p>'</script><p>w", "<title><b></title><p>v", "<td class='x'\n id = 'q'>s</td >", "<p\u00a0x='1'>r</p>", "a<br",
    ]
    for page in pages:
        for hidden in (frozenset(), frozenset("h")):
            fast, slow = mk.Tree(page, hidden), Slow(page, hidden)
            assert fast.elements == slow.elements and "".join(fast.parts) == "".join(slow.parts), page
    assert sum(mk.Tree(p)._plain(p) for p in pages) >= 5


def test_cleaned_text_is_as_with_every_run_replaced(spark):
    runs = ["", " ", "  ", "\t", " \n", "\n ", " ", "   ", " 　", "\x1c", "​", " \t \r\n "]
    rows = [(f"{a}x{b}y z{c}",) for a in runs for b in runs for c in runs] + [(None,), ("",), ("   ",)]
    got = spark.createDataFrame(rows, "t string").select(fn.clean(F.col("t")).alias("a"), F.trim(F.regexp_replace("t", r"(?U)\s+", " ")).alias("b"))
    assert got.where("not a <=> b").isEmpty()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cells_become_text_once(spark):
    pages = spark.createDataFrame([(0, "<table></table>")], "page int, payload string")
    for key in ("ma", "ar", "mt"):
        tags = _plan(portals.REGISTRY[key](pages)).count("<[^>]*>, ,")
        assert tags <= (3 if key == "mt" else 2), (key, tags)


def test_a_date_is_searched_once(spark):
    rows = spark.createDataFrame([("due 1/31/96, 12:05 a.m. or 2/1/97",), ("13/1/1996",), ("",), (None,)], "t string")
    dates = rows.select(fn.us_date(F.col("t")).cast("string").alias("d"))
    assert [r[0] for r in dates.collect()] == ["2096-01-31 05:05:00", None, None, None]
    assert _plan(rows.select(fn.us_date(F.col("t")).alias("d"))).count(r"(\d{1,2})/(\d{1,2})/") == 2


def test_text_without_tags_is_as_with_the_whole_reading(spark):
    parts = ["", " ", "a", "\n", " \n \n", "\t", "<b>", "</p>", "&amp;", "<", ">", "\u00a0", "&nbsp;"]
    rows = [(x + "q" + y + z,) for x in parts for y in parts for z in parts] + [(None,)] + [(x + y,) for x in parts for y in parts]
    got = spark.createDataFrame(rows, "t string").select(portals.text_of(F.col("t")).alias("a"), fn.clean(fn.html_to_text(F.col("t"))).alias("b"))
    assert got.where("not a <=> b").isEmpty()


def test_first_of_each_needs_no_set_of_all_rows(spark):
    assert "Aggregate" not in _plan(catalogue.QUERIES["dedupe_first_wins"](spark, "/root/testdata/sf0.001"))


def test_spans_of_a_page_are_put_together_in_its_row(spark):
    pages = spark.createDataFrame([(0, "")], "page int, payload string")
    assert "Aggregate" not in _plan(portals.REGISTRY["ok"](pages))


def test_spans_are_read_as_by_the_whole_reading(spark):
    span = lambda f, n, x, more="": f"<SPAN {more} id = \"{f}${n}\" >{x}</span>"
    ident, title, to = "SCP_PUB_AUC_VW_AUC_ID", "SCP_PUB_AUC_VW_AUC_NAME", "SCP_COSP_WK_FL_SCP_END_DATE_CHAR"
    first = span(ident, 10, " A \n 1\u00a0") + span(title, 2, "<b>x</b>&amp;&nbsp;y") + span(ident, 2, "B") + span(title, 10, "one \u0001 two \u0001 three", "title='1 < 2'") + span(title, 10, "one")
    second = span(ident, 0, "C") + span(title, 0, "", "data-id='SCP_PUB_AUC_VW_AUC_TYPE$0'") + span(to, 0, "1/31/1996 12:05 a.m. CDT") + span(title, 1, "no id") + span(ident, 2, "B") + "<span id='a>b$3'>odd</span><span id='X$4'>a > b</span>"
    pages = spark.createDataFrame([(0, first), (1, second), (2, ""), (3, None), (4, "<span>no</span>")], "page int, payload string")
    got = portals.REGISTRY["ok"](pages).select("external_id", "title", "category", F.col("due_date").cast("string"))
    assert sorted(map(tuple, got.collect())) == [("A 1", "one \u0001 two \u0001 three", None, None), ("B", "x& y", None, None), ("C", "C", None, "1996-01-31 05:05:00")]


def test_a_panel_is_read_once(spark):
    pages = spark.createDataFrame([("1", "<PAGE><![CDATA[<span id='SCP_P_AUCDTL_VW_AUC_ID$0'> 1 </span>]]><![CDATA[<textarea id='SCP_P_AUCDTL_VW_DESCRLONG$0'>a &lt; b</textarea>]]></PAGE>"), ("2", "")], "external_id string, payload string")
    records = spark.createDataFrame([("1", "x", "Posted"), ("2", "y", "Posted")], "external_id string, description string, status_on_site string")
    found = portals.enriched(records, portals.ok_details(pages))
    assert sorted(map(tuple, found.collect())) == [("1", "a < b", "Posted"), ("2", "y", "Posted")]
    for name in ("VW_AUC_ID", "DESCRLONG", "AUC_STATUS"):
        assert _plan(found).count(name) == 1


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_pages_are_gathered_behind_their_exchange(spark):
    lines = _nodes(catalogue.QUERIES["portal_ks_details"](spark, "/root/testdata/sf0.001"))
    gathered = [n for n, line in enumerate(lines) if "collect_list" in line]
    exchange = next(n for n, line in enumerate(lines) if "Exchange hashpartitioning(page" in line)
    assert gathered and max(gathered) < exchange


def test_attributes_are_looked_for_once(spark):
    attributes = [{"Name": "evp_name", "Value": "first"}, {"Name": "evp_name", "Value": "second"}, {"Name": None, "Value": "x"}, {"Name": "evp_opendate", "Value": 86400000}]
    pages = spark.createDataFrame([(0, json.dumps({"Records": [{"Id": "g1", "Attributes": attributes}, {"Id": "g2", "Attributes": None}, {"Id": "g3"}, {"Attributes": attributes}]}))], "page int, payload string")
    found = portals.REGISTRY["nc"](pages)
    got = found.select("external_id", "title", F.col("due_date").cast("string"))
    assert sorted(map(tuple, got.collect())) == [("g1", "first", "1970-01-02 00:00:00"), ("g2", "g2", None), ("g3", "g3", None)]
    plan = _plan(found)
    assert all(plan.count(name) == 1 for name in portals.NC_ATTRIBUTES.values())


def test_seconds_of_a_date_are_not_written_out(spark):
    rows = spark.createDataFrame([("1/31/96 11:05:59 pm",), ("1/31/1996 11:05:60 PM",), ("2/30/1996",), ("12/31/9999 12:00 AM",)], "t string")
    dates = rows.select(fn.us_date(F.col("t"), F.lit(-240)).cast("string").alias("d"))
    assert [r[0] for r in dates.collect()] == ["2096-02-01 03:05:59", "1996-02-01 03:06:00", None, "9999-12-31 04:00:00"]
    assert "as double) as decimal" not in _plan(dates)


def test_texts_are_as_the_columns_make_them(spark):
    spaces = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and c > 0]
    rows = [f"a{c} {c}b{c}" for c in spaces] + ["", " ", "  x  y ", "\u00a0x\u00a0", "x"]
    got = spark.createDataFrame([(r, texts.clean(r)) for r in rows], "t string, b string")
    assert got.where(~fn.clean(F.col("t")).eqNullSafe(F.col("b"))).isEmpty()
    days = ["1/31/96", "13/1/1996", "2/29/1996", "2/29/1997", "0/1/1996", "12/31/9999", "1/1/0099", "1/1/0100", "1/1/123", "11/2/33/4/1999", "", "x", "7/1/2026"]
    times = ["", " 12:05 am", ", 12:05 P.M.", " 7:60", " 24:00", " 23:59:59", " 23:59:60 PM", " 11:05:61", "\u00a08:00", " 3:00PM CDT", " 13:00 pm", " 1:2"]
    dates = [(a, texts.us_date(a, fn.EASTERN)) for a in (pre + d + t for pre in ("", "due ", "9") for d in days for t in times)]
    got = spark.createDataFrame(dates, "t string, b bigint").withColumn("a", F.unix_micros(fn.us_date(F.col("t"), fn.EASTERN)))
    assert got.where("not a <=> b").collect() == [] and sum(b is not None for _, b in dates) > 100


PLAIN_ROWS = [
    "<tr></tr>", "<tr class='a b'> \n<td></td> </tr>", "<tr><td>a &amp; b</td><td x=\"1 > 0\">c &lt;i&gt;</td></tr>", "<tr><td><a href='/x?a=1&amp;b=2' >t <b id=\"q\">u</b>&nbsp;v</a> w<br/>x<br>y</td></tr>",
    "<tr><td><div class='c d'>one <a href='2' href='3'>two</a></div><span id='h'>hidden</span><a ID='z' HREF>three</a></td><td nowrap>\u00e9</td></tr>", "<tr><td><a><b>x</b>&copy=1</a>&ampx</td><td><i>a</i><i>b</i></td></tr>",
]
OTHER_ROWS = [
    "<tr id='g'><td>a</td></tr>", "<TR><td>a</td></TR>", "<tr><td>a<td>b</tr>", "<tr><td><b>a<i>b</b></i></td></tr>", "<tr><td><table><tr><td>a</td></tr></table></td></tr>", "<tr><th>a</th></tr>", "<tr><td><a href=x>a</a></td></tr>", "<tr><td><p>a</p></td></tr>",
    "<tr><td><span id='g'><b>a</b></span></td></tr>", "<tr><td><a id='g'><b>a</b></a></td></tr>", "<tr><td>a < b</td></tr>", "<tr><td title='<b>'>a</td></tr>", "<tr>x</tr>", "<tr><td>a</td>", "<tr><td><a href='1'><a href='2'>a</a></a></td></tr>", "<tr><td><a/>b</td></tr>",
]


def _read(row):
    return row.cells(), [(a.get("id"), a.get("href"), t) for a, t in row.links()]


def _all_by_tree(page, mark):
    tree = mk.Tree(page)
    words = "".join(tree.parts)
    return [(n, [(x["mark"], x["nth"]) for x in chain if x["mark"] is not None], _read(mk.TreeRow(tree, e["at"], words))) for e, chain, n in mk._walk(tree, words, ("tr",), mark)]


def test_plain_rows_are_read_as_by_the_tree():
    assert all(mk.PLAIN_ROW.fullmatch(r) for r in PLAIN_ROWS) and not any(mk.PLAIN_ROW.fullmatch(r) for r in OTHER_ROWS)
    mark = lambda e: "grid" if e["id"] == "g" else None
    pages = [f"<p>x<table id='g'>{a}\n{b}{c} </table>{a}<table id='g'>{c}" for a in PLAIN_ROWS for b in PLAIN_ROWS + OTHER_ROWS for c in PLAIN_ROWS]
    pages += [f"<table id='g'><tr><td>outer {a}{b}</td></tr></table><table id='g'>{b}</table>" for a in PLAIN_ROWS + OTHER_ROWS for b in PLAIN_ROWS]
    pages += [f"{a}<table id='g'>{b}</table>{c}" for a in ("", "<!-- ", "<script>", "<p title=\"", "<p title='", "<textarea>", "a < b", "\x01", "<tr><td>open") for b in PLAIN_ROWS for c in ("", " -->", "</script>", "\">", "'>", "</textarea>")]
    for page in pages:
        assert [(n, marks, _read(row)) for n, marks, row in mk.table_rows(page, mark)] == _all_by_tree(page, mark), page


def test_plain_rows_are_no_elements():
    class Counted(mk.Tree):
        made = 0

        def _end(self, depth):
            super()._end(depth)
            Counted.made = max(Counted.made, len(self.elements))

    page = f"<table>{'<tr><td>a</td><td><a>b</a></td></tr> ' * 500}</table>"
    tree, mk.Tree = mk.Tree, Counted
    try:
        assert len([r.cells() for _, _, r in mk.table_rows(page)]) == 500 and Counted.made < 5
    finally:
        mk.Tree = tree


def test_rows_of_a_grid_come_as_texts(spark):
    pages = spark.createDataFrame([(0, "")], "page int, payload string")
    for key in ("pa", "wy", "ms"):
        assert "nodes" not in _plan(portals.REGISTRY[key](pages)), key


def test_named_months_and_addresses_are_as_the_columns_make_them(spark):
    days = ["Jul 1, 2026", "july 31 2026", "Sept. 3, 1999", "feb 30, 2026", "Feb 29, 0000", "Dec 31, 9999", "xmay 1, 2026", "may_1, 2026", "Mayor 1, 2026", "Jun 1, 20", "", "1 may 1 2026"]
    dates = [(a, texts.month_name_date(a, -360)) for a in (f"{x}{d}{t}" for x in ("", "on 9:00 p.m. ", "7:60 am ") for d in days for t in ("", " 8:00:00 AM MDT", " 12:05 a.m.", " 12:00 pm", " 13:00 p m", " 24:00 am", " 1:02:60 Am"))]
    got = spark.createDataFrame(dates, "t string, b bigint").withColumn("a", F.unix_micros(fn.month_name_date(F.col("t"), -360)))
    assert got.where("not a <=> b").collect() == [] and sum(b is not None for _, b in dates) > 50
    hrefs = ["/", "/a", "/a/b/", "/a?x=./..#y", "/a#b?c", "//h/a", "/a//b", "/a/../b", "/./a", "/..", "/a/.", "/a/..#b", "/a.b/..c/.d?../.", "/a.pdf", "a", "", "?a", "#a", "/a b?c d", "/a\n?b", "/a\u00e9", "http://x/y", "mailto:a", "/a:b", "/x?\ny"]
    origin = "https://h.gov"
    for base in (origin, f"{origin}/x/y.aspx"):
        got = spark.createDataFrame([(h, texts.rooted(origin, h)) for h in hrefs], "h string, b string").withColumn("a", fn.absolute(F.lit(base), F.col("h")))
        assert got.where("b is not null and not a <=> b").collect() == [] and got.where("b is not null").count() == 10


def test_script_rows_are_read_as_by_the_tree(spark):
    read = lambda row: (*_read(row), row.cells(own=True), list(map(_named_class, row.blocks())), portals._wy_rest(row.tree()))
    _named_class = lambda b: (b[0].get("id"), b[0].get("class"), b[1])
    mine = ["<td><a href=\\\"/b?bidId=1\\\">t<span id=\\\"d0\\\">no</span></a>' + tooltip + '</td><td>it\\'s &amp; b</td>", "<td>x<div id=\\\"d1\\\">no</div>y<div class=\\\"a balloonstyle\\\">z</div>w</td>", "<td title=\\\"<i id=\\'d0\\'>a</i>\\\">b</td>"]
    mine += ["<td><div id=\\\"d0\\\"><b>no</b></div>c</td>", "<td><span id=\\\"d0\\\">open</td>", "<td>a</table>", "<!-- ", "-->", "<td><table><tr><td>in</td></tr></table></td>", "<td>a\\n\\\\b\\tc</td>"]
    script = lambda *rows: "tooltip = '<div class=\\\"balloonstyle\\\">about</div>';" + "".join(f"$(\"tr_{n}\").update('{r}');" for n, r in enumerate(rows)) + 'action("d0", "d1");xaction("d2"); action( "d3" action("d4"'
    titles = ["", "<title>a: Owner Home Page &amp; b</title>", "<TITLE>c</TITLE>", "<title x='</title>"]
    for title in titles:
        for a in mine:
            for b in mine:
                page = title + script(a, mine[0], mine[0], b, mine[1])
                tree = mk.Tree(*mk.scripted(page))
                words = "".join(tree.parts)
                head, rows = mk.script_rows(page)
                assert head == next((words[e["begin"] : e["end"]] for e in tree.elements if e["tag"] == "title"), None)
                assert [read(r) for r in rows] == [read(mk.TreeRow(tree, e["at"], words)) for e in tree.elements if e["tag"] == "tr"], page


def test_dates_in_other_letters_are_read_too(spark):
    row = lambda n, about, posted, due: f"$(\"tr_{n}\").update('<td><a href=\\\"/b?bidId={n}\\\"></a>Rope {n}<div class=\\\"balloonstyle\\\">{about}</div></td><td>{posted}</td><td>{due}</td>');"
    page = row(1, "\u00e9 Questions until 3:00 p.m. on July 15, 2026.", "\u00e9 Jul 1, 2026", "\u00e9 Jul 2, 2026 9:00 AM MST") + row(2, "Questions until July 15, 2026 3:00 p.m.", "", "Jul 2, 2026")
    found = portals.wy(spark.createDataFrame([(0, page)], "page int, payload string"))
    got = found.select("external_id", "title", F.col("posted_date").cast("string"), F.col("due_date").cast("string"), F.col("q_and_a_deadline").cast("string")).orderBy("external_id")
    assert list(map(tuple, got.collect())) == [("1", "Rope 1", "2026-07-01", "2026-07-02 16:00:00", "2026-07-15 21:00:00"), ("2", "Rope 2", None, "2026-07-02 06:00:00", "2026-07-15 06:00:00")]


def test_prose_dates_and_slugs_are_as_the_columns_make_them(spark):
    days = ["August 27, 2026", "may 1st 2031", "JUNE 31, 2026", "xmay 1, 2026", "May 1, 1999", "May 1, 20261", "Aug 1, 2026", "", "march 2nd,2026 or May 1, 2026"]
    rows = [f"{a}{d}{b}" for a in ("", "at 2:00 p.m., ", "9 am ", "12 A.M. on ", "24:00 pm ", "1a2 pm ") for d in days for b in ("", ", 7:60 am", "_")] + ["--a  B--", "x" * 100, "a-b c"]
    got = spark.createDataFrame([(r, texts.prose_date(r, -300), texts.slug_id(r)) for r in rows], "t string, b bigint, s string")
    assert got.where(~F.unix_micros(fn.prose_date(F.col("t"))).eqNullSafe(F.col("b")) | (fn.slug_id(F.col("t")) != F.col("s"))).collect() == []
    assert got.where("b is not null").count() > 20


def test_files_are_as_links(spark):
    hrefs = ["/a.pdf", "/b", "/b", "b/c.pdf", "mailto:x", " TEL:1", "", " ", "/x/../y.pdf", "https://h/q%20r.pdf", "/ c", "//h/z"]
    pages = [f"<p><a href='{x}'>{a}</a><a>no</a><a href='{y}'>{b}</a></p>" for x in hrefs for y in hrefs for a in ("one", "") for b in ("two  x", " ")]
    base = "https://h.gov/p/q"
    by_columns = mk.parsed(spark.createDataFrame(list(enumerate(pages)), "n int, payload string")).select("n", mk.links(mk.node(F.lit(0)), base).alias("a"))
    found = [(n, *mk.files(next(mk.elements(p, "p", lambda e: None))[2].links(), "https://h.gov")) for n, p in enumerate(pages)]
    mine = spark.createDataFrame(found, f"n int, files {mk.FILES}, links {mk.LINKS}").select("n", F.coalesce("files", mk.named(F.col("links"), F.lit(base))).alias("b"))
    assert by_columns.join(mine, "n").where("not a <=> b").isEmpty() and sum(f is not None for _, f, _ in found) > 100


def test_pages_of_four_shapes_are_read_in_one_pass(spark):
    pages = spark.createDataFrame([(0, "")], "page int, payload string")
    assert _plan(portals.ms(pages)).count("MapInArrow") == 1


def test_prose_in_other_letters_is_read_too(spark):
    page = '<dl class="ckeditor-accordion"><dt>\u00e9 Fuel</dt><dd>\u00e9 RFP 3160007003 at 2:00 p.m., August 27, 2026</dd><dt>\u00e9 Paper</dt><dd>RFP 12</dd></dl>'
    lease = '<table class="tblwdt"><tr><td>Ann\u00e9e</td><td>x</td><td>9/1/2026</td></tr></table>'
    found = portals.ms(spark.createDataFrame([(1, page), (None, lease), (-5, lease.replace("Ann", "Bnn")), (-4, lease)], "page int, payload string"))
    got = found.select("external_id", "title", F.col("due_date").cast("string")).orderBy("external_id")
    assert list(map(tuple, got.collect())) == [
        ("MSLEASE-ann-e-x-9-1-2026", "Request for Lease Proposals \u2014 Ann\u00e9e (x)", "2026-09-01 05:00:00"), ("MSLEASE-bnn-e-x-9-1-2026", "Request for Lease Proposals \u2014 Bnn\u00e9e (x)", "2026-09-01 05:00:00"),
        ("MSPURCH-paper", "\u00e9 Paper", None), ("RFx-3160007003", "\u00e9 Fuel", "2026-08-27 19:00:00"),
    ]

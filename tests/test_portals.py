"""Portal dialects on hand-written pages in the portals' own markup; every output column is stated (unstated ones are null)."""

from __future__ import annotations

import base64
import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tenderloom.sources import discovery, portals


def pages(spark, *texts, **more):
    rows = [(n, t, *(v[n] for v in more.values())) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, "page int, payload string" + "".join(f", {k} string" for k in more))


def expect(found, *records):
    got = [r.asDict(recursive=True) for r in found.orderBy("external_id").collect()]
    for r in got:
        r["attachments"] = [(a["filename"], a["url"]) for a in r["attachments"]] if r["attachments"] is not None else None
    want = [dict.fromkeys(portals.FIELDS) | r for r in sorted(records, key=lambda r: r["external_id"])]
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w


def test_sam(spark):
    page = {"totalRecords": 2, "opportunitiesData": [
        {"noticeId": "abc", "title": " Cloud  services ", "solicitationNumber": "W91-26", "fullParentPathName": "DEPT OF DEFENSE.DEPT OF THE ARMY.ACC", "postedDate": "2026-07-01", "type": "Solicitation", "typeOfSetAsideDescription": "Total Small Business", "responseDeadLine": "2026-08-03T14:00:00-04:00", "naicsCode": "541512", "description": "https://api.sam.gov/desc", "uiLink": "https://sam.gov/opp/abc/view", "resourceLinks": [f"https://sam.gov/f/{n}" for n in range(12)]},
        {"noticeId": "def", "title": "Plain", "solicitationNumber": "", "type": None},
    ]}
    expect(
        portals.sam(pages(spark, json.dumps(page))),
        {"external_id": "W91-26", "title": "Cloud services", "agency": "DEPT OF DEFENSE · DEPT OF THE ARMY", "category": "Solicitation · Total Small Business", "naics_code": "541512", "description": "https://api.sam.gov/desc", "posted_date": date(2026, 7, 1), "due_date": datetime(2026, 8, 3, 18), "detail_url": "https://sam.gov/opp/abc/view", "status_on_site": "Open", "attachments": [(f"attachment-{n + 1}", f"https://sam.gov/f/{n}") for n in range(10)]},
        {"external_id": "def", "title": "Plain", "detail_url": "https://sam.gov/opp/def/view", "status_on_site": "Open", "attachments": []},
    )


@pytest.mark.parametrize(("key", "url"), [("ak", "https://iris-vss.alaska.gov/PRDVSS1X1/Advantage4"), ("ky", "https://vss.ky.gov/vssprod-ext/Advantage4")])
def test_advantage(spark, key, url):
    rows = [
        {"DOC_REF": "[RFP,08,270000001,1][RFP-08-270000001-1]", "DOC_DSCR": "Road salt", "DEPT_NM": "Transportation", "SO_CAT_CD": "2", "SO_STA": "O", "BUYR_NM": "Pat Doe", "BUYR_EMAIL_AD": "pat@x.gov", "DOC_CD_CONCAT": "Request for Proposal", "PUB_DT": 1782411340000, "SO_CLSNG_DT_TM": 1783411340000},
        {"DOC_REF": "[ITB-1]", "DOC_DSCR": "Bolts", "SO_CAT_CD": "9", "SO_STA": "", "PUB_DT": "", "SO_CLSNG_DT_TM": ""},
        {"DOC_REF": "[a][b]", "DOC_DSCR": " "},
    ]
    coded = {"SO_CAT_CD": {"codedValuesList": [{"1": "Goods"}, {"2": "Services"}]}, "SO_STA": {"codedValuesList": [{"O": "Open"}]}}
    page = {"page_metadata": {"datasources": {"T1SO_SRCH_QRY": {"columns": coded}}}, "data": {"ds_data": {"T1SO_SRCH_QRY": {"row_data": rows}}}}
    expect(
        portals.REGISTRY[key](pages(spark, json.dumps(page))),
        {"external_id": "RFP-08-270000001-1", "title": "Road salt", "agency": "Transportation", "category": "Services", "description": "Request for Proposal — Buyer: Pat Doe — pat@x.gov", "posted_date": date(2026, 6, 25), "due_date": datetime(2026, 7, 7, 8, 2, 20), "detail_url": url, "status_on_site": "Open"},
        {"external_id": "[ITB-1]", "title": "Bolts", "category": "9", "detail_url": url},
    )


def test_mo(spark):
    items = [
        {"AuctionHeaderId": 7, "Negotiation": "RFPS30034", "NegotiationTitle": "Buses", "NegotiationType": "RFP", "ProcurementBUName": "Office of Administration", "Synopsis": "City buses", "AmendmentDescription": "Dates moved", "NegotiationStatus": "Active (Amended)", "NegotiationStatusCode": "AMENDED", "CloseDate": "2026-07-22T19:00:00+00:00", "PostingDate": "2026-06-26", "attachments": {"items": [{"FileName": "spec.pdf", "Title": "Spec", "FileUrl": "/files/1"}, {"Title": "Terms", "FileUrl": "https://x.gov/2"}, {"FileName": "lost"}]}},
        {"AuctionHeaderId": 8, "Negotiation": " ", "AmendmentDescription": "only this", "PublishDate": "2026-06-27T00:00:00+00:00", "attachments": {"items": []}},
    ]
    page = "https://ewqg.fa.us8.oraclecloud.com/fscmUI/redwood/negotiation-abstracts/view/abstractlisting?prcBuId=300000005255687"
    expect(
        portals.mo(pages(spark, json.dumps({"items": items, "hasMore": False}))),
        {"external_id": "RFPS30034", "title": "Buses", "agency": "Office of Administration", "category": "RFP", "description": "City buses — Amendment: Dates moved", "posted_date": date(2026, 6, 26), "due_date": datetime(2026, 7, 22, 19), "detail_url": page, "status_on_site": "Active (Amended)", "attachments": [("spec.pdf", "https://ewqg.fa.us8.oraclecloud.com/files/1"), ("Terms", "https://x.gov/2")]},
        {"external_id": "8", "title": "8", "description": "Amendment: only this", "posted_date": date(2026, 6, 27), "detail_url": page},
    )


def test_phx_and_its_detail_pages(spark):
    projects = [
        {"id": 11, "title": "Park lights", "status": "open", "financialId": "RFP 26-01", "departmentName": " ", "postedAt": "2026-07-01T15:00:00.000Z", "proposalDeadline": "2026-08-01T21:00:00.000Z", "qaDeadline": "2026-07-15T21:00:00.000Z", "comingSoon": False, "isPrivate": False, "template": {"title": "Request for Proposal", "processAcronym": "RFP"}},
        {"id": 12, "title": "Soon", "status": "draft", "financialId": None, "departmentName": "Water", "postScheduledAt": "2026-09-01T15:00:00.000Z", "comingSoon": True, "isPrivate": False, "template": {"title": "Bid"}},
        {"id": 13, "title": "Hidden", "status": "open", "isPrivate": True}, {"id": 14, "title": " ", "status": "open", "isPrivate": False}, {"id": 15, "title": "Shut", "status": "closed"},
    ]
    listed = portals.phx(pages(spark, json.dumps({"projects": projects, "count": 5})))
    park = {"external_id": "RFP 26-01", "title": "Park lights", "agency": "City of Phoenix", "category": "RFP", "posted_date": date(2026, 7, 1), "due_date": datetime(2026, 8, 1, 21), "q_and_a_deadline": datetime(2026, 7, 15, 21), "detail_url": "https://procurement.opengov.com/portal/phoenix/projects/11", "status_on_site": "open"}
    soon = {"external_id": "12", "title": "Soon", "agency": "Water", "category": "Bid", "posted_date": date(2026, 9, 1), "detail_url": "https://procurement.opengov.com/portal/phoenix/projects/12", "status_on_site": "Coming Soon"}
    expect(listed, park, soon)
    detail = {"summary": "<p>New lamps.</p><p>Forty<br>of them</p>", "background": "<p>old</p>", "categories": [{"code": "28500", "title": "Electrical "}, {"code": "2", "title": "Lighting"}], "attachments": [{"filename": "a.pdf", "url": "https://x/a"}, {"title": "Plan", "url": "https://x/b"}, {"title": "none", "url": ""}]}
    details = spark.createDataFrame([("RFP 26-01", json.dumps(detail)), ("12", json.dumps({"summary": None, "background": "<div>Later</div>"}))], "external_id string, payload string")
    expect(
        portals.enriched(listed, portals.phx_details(details)),
        park | {"description": "New lamps. Forty of them", "naics_code": "28500", "category": "Electrical; Lighting", "attachments": [("a.pdf", "https://x/a"), ("Plan", "https://x/b")]}, soon | {"description": "Later"},
    )


def test_sd(spark):
    board = "https://postingboard.esmsolutions.com/3444a404-3818-494f-84c5-2a850acd7779"
    rows = [
        {"eventId": 9981, "id": "26RFP-SDSU", "eventName": "Dairy  plant", "publishedDate": "2026-07-01T08:30:00", "eventDueDate": "2026-07-22T11:00:00", "timezoneNameAbbreviation": "CT", "status": {"description": "Published"}},
        {"eventId": 5, "id": "", "eventName": "Hay", "eventDueDate": "2026-07-22T11:00", "timezoneNameAbbreviation": "et"}, {"eventId": 6, "id": "x", "eventName": None},
    ]
    expect(
        portals.sd(pages(spark, json.dumps({"data": rows, "totalCount": 3}))),
        {"external_id": "26RFP-SDSU", "title": "Dairy plant", "agency": "State of South Dakota", "category": "RFP", "description": "Dairy plant", "posted_date": date(2026, 7, 1), "due_date": datetime(2026, 7, 22, 16), "detail_url": f"{board}/eventDetail?eventId=9981", "status_on_site": "Published"},
        {"external_id": "5", "title": "Hay", "agency": "State of South Dakota", "description": "Hay", "due_date": datetime(2026, 7, 22, 15), "detail_url": f"{board}/eventDetail?eventId=5"},
    )


def test_wv(spark):
    row = {"DOC_DSCR": " Tractor ", "DOC_DEPT_CD": "0304", "DEPT_NM": "Tourism", "DOC_CD": "CRFQ", "DOC_ID": "TOR2600000001", "SO_DSCR": "Equipment", "PUB_DT": "2026-07-01", "CLSNG_DT": "2026-07-22", "CLSNG_TM": "01:30"}
    found = portals.wv(pages(spark, json.dumps([row, {"DOC_ID": " "}]), json.dumps([{"DOC_ID": "B2", "CLSNG_DT": "2026-07-23"}]), "[]", json.dumps([row | {"DOC_DSCR": "later"}])))
    expect(
        found,
        {"external_id": "0304_TOR2600000001", "title": "Tractor", "agency": "Tourism", "category": "Equipment", "description": "CRFQ TOR2600000001 — Tractor", "posted_date": date(2026, 7, 1), "due_date": datetime(2026, 7, 22, 17, 30), "detail_url": "https://www.state.wv.us/admin/purchase/Commodities.html", "status_on_site": "Open"},
        {"external_id": "B2", "title": "B2", "category": "Construction", "description": "B2", "due_date": datetime(2026, 7, 23, 4), "detail_url": "https://www.state.wv.us/admin/purchase/ConstructionBids.html", "status_on_site": "Open"},
    )


def test_pa(spark):
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    link = lambda n, sid: f'<a id="ctl00_MainBody_grdResults_ctl0{n}_HyperLink1" href="Solicitations.aspx?SID={sid}">go {sid}</a>'
    page = (
        "<table><tr><td>menu</td></tr></table><table id='ctl00_MainBody_grdResults'><tr><th>Number</th></tr>"
        + row("6100", "IFB", "Road salt", "Deliver salt", "PennDOT", "York", "x", "7/1/2026", "7/22/2026 2:00 PM", "later", "", "Pat " + link(2, "6100"))
        + row("", "RFP", "", "", "Revenue", "", "", "", "", "", "Amended", link(3, "61%2001")) + row("9", "x", "no link", "", "", "", "", "", "", "", "") + "</table>"
    )
    expect(
        portals.pa(pages(spark, page)),
        {"external_id": "6100", "title": "Road salt", "agency": "PennDOT", "category": "IFB", "description": "Deliver salt", "posted_date": date(2026, 7, 1), "due_date": datetime(2026, 7, 22, 18), "detail_url": "https://www.emarketplace.state.pa.us/Solicitations.aspx?SID=6100", "status_on_site": "Open"},
        {"external_id": "61 01", "title": "go 61%2001", "agency": "Revenue", "category": "RFP", "detail_url": "https://www.emarketplace.state.pa.us/Solicitations.aspx?SID=61%2001", "status_on_site": "Amended"},
    )


def test_tn(spark):
    first = """<table><tbody><tr><td>Number</td><td>Dates</td><td>Title</td></tr>
      <tr><td><a href="/content/rfp.pdf">RFP&nbsp;32110-1</a><br><a href="/content/plan">Plan</a> <a href="https://o.gov/q.xlsx">Questions</a></td><td>7/1/2026<br>7/22/2026</td><td>Prison <i>phones</i></td></tr>
      <tr><td>no link</td><td>7/1/2026</td><td>x</td></tr></tbody></table><table><tr><td></td></tr><tr><td><a href="/z">RFP 9</a></td><td></td><td>other</td></tr></table>"""
    second = '<table><tr><th>h</th></tr><tr><td><a href="/content/itb-updates/4471/doc.html">ITB </a></td><td>8/2/2026 8/9/2026</td><td></td></tr></table>'
    expect(
        portals.tn(pages(spark, first, second)),
        {"external_id": "32110-1", "title": "Prison phones", "category": "RFP", "posted_date": date(2026, 7, 1), "due_date": datetime(2026, 7, 22, 5), "detail_url": "https://www.tn.gov/content/rfp.pdf", "status_on_site": "Open", "attachments": [("Plan", "https://www.tn.gov/content/plan"), ("Questions", "https://o.gov/q.xlsx")]},
        {"external_id": "4471", "title": "ITB", "category": "ITB", "posted_date": date(2026, 8, 2), "due_date": datetime(2026, 8, 9, 5), "detail_url": "https://www.tn.gov/content/itb-updates/4471/doc.html", "status_on_site": "Open", "attachments": []},
    )


def test_la(spark):
    page = """<table class="bid wide"><tr><th>Bid</th></tr>
      <tr><td rowspan="2"><span>30-22</span></td><td>Ferry <br>repair<strong>Original:</strong> <a href="agency/pdf/30-22.pdf">30-22</a> <strong>Attachments:</strong> <a href="agency/pdf/a.doc">Annex</a></td><td>7/1/2026</td><td rowspan="2">7/22/2026 10:00:00 AM</td><td>?</td></tr>
      <tr><td>Addendum 1 <a href="agency/pdf/ad1.pdf">Addendum 1</a> <a href="agency/pdf/a.doc">again</a></td><td>7/3/2026</td></tr>
      <tr><td><span>30-23</span></td><td>Tug <strong>Bid Cancelled:</strong> 7/2/2026</td><td>7/1/2026</td><td>12/30/9999</td></tr></table>"""
    base = "https://wwwcfprd.doa.louisiana.gov/osp/lapac/"
    index = f'<a href="dspBid.cfm?search=department&term=7">Ports of Call - (2)</a><a href="{base}dspBid.cfm?search=department&amp;term=7">twice</a><a href="x.cfm">x</a>'
    departments = portals.la_departments(pages(spark, index)).collect()
    assert [(r["term"], r["department"], r["url"]) for r in departments] == [("7", "Ports of Call", f"{base}dspBid.cfm?search=department&term=7")]
    expect(
        portals.la(pages(spark, page, department=["Ports of Call"], url=[f"{base}dspBid.cfm?search=department&term=7"])),
        {"external_id": "30-22", "title": "Ferry repair", "agency": "Ports of Call", "description": "Ferry repairOriginal: 30-22 Attachments: Annex", "posted_date": date(2026, 7, 1), "due_date": datetime(2026, 7, 22, 15), "detail_url": f"{base}agency/pdf/30-22.pdf", "status_on_site": "Open", "attachments": [("30-22", f"{base}agency/pdf/30-22.pdf"), ("Annex", f"{base}agency/pdf/a.doc"), ("Addendum 1", f"{base}agency/pdf/ad1.pdf")]},
        {"external_id": "30-23", "title": "Tug", "agency": "Ports of Call", "description": "Tug Bid Cancelled: 7/2/2026", "posted_date": date(2026, 7, 1), "detail_url": f"{base}dspBid.cfm?search=department&term=7", "status_on_site": "Cancelled", "attachments": []},
    )


def test_wy(spark):
    page = r"""<html><head><title>Public Purchase: State of Wyoming GSD Home Page</title></head><script>
      tooltip = '<div class=\"balloonstyle\" id=\"b1\">Snow plows. ';
      tooltip += 'Questions are due by 3:00 p.m. on July 15, 2026.</div>';
      $("tr_1").update('<td><a href=\"/gems/bid/bidView?bidId=' + 214313 + '\">Bid #0014-N - Plows' + '<span id=\"d1\">decoy</span></a>' + tooltip + '</td><td>Jul 1, 2026 8:00:00 AM MDT</td><td>Jul 22, 2026 9:00:00 AM MST</td><td>3 days</td><td></td>');
      tooltip = 'it\'s plain';
      $("tr_2").update('<td><a href=\"/gems/bid/bidView?bidId=' + 5 + '\"></a>Rope</td><td></td><td>AUGUST 5, 2026</td>');
      $("tr_3").update('<td>no link</td>');
      action("d1", "d9");</script></html>"""
    expect(
        portals.wy(pages(spark, page)),
        {"external_id": "214313", "title": "Bid #0014-N - Plows", "agency": "State of Wyoming GSD", "category": "Bid", "description": "Snow plows. Questions are due by 3:00 p.m. on July 15, 2026.", "posted_date": date(2026, 7, 1), "due_date": datetime(2026, 7, 22, 16), "q_and_a_deadline": datetime(2026, 7, 15, 21), "detail_url": "https://www.publicpurchase.com/gems/bid/bidView?bidId=214313", "status_on_site": "Open"},
        {"external_id": "5", "title": "Rope", "agency": "State of Wyoming GSD", "due_date": datetime(2026, 8, 5, 6), "detail_url": "https://www.publicpurchase.com/gems/bid/bidView?bidId=5", "status_on_site": "Open"},
    )


def test_ok_and_its_detail_panels(spark):
    span = lambda field, n, x: f"<span  class='ps_box-value' id='{field}${n}'>{x}</span>"
    page = "".join([span("SCP_PUB_AUC_VW_AUC_ID", 0, "EV00000123"), span("SCP_PUB_AUC_VW_AUC_NAME", 0, "Chip seal"), span("BUS_UNIT_AUC_VW_DESCR", 0, "ODOT"), span("SCP_PUB_AUC_VW_AUC_TYPE", 0, "RFx"), span("SCP_COSP_WK_FL_SCP_STRT_DATE_CHAR", 0, "07/01/2026 8:00AM CDT"), span("SCP_COSP_WK_FL_SCP_END_DATE_CHAR", 0, "07/22/2026 3:00PM CDT"), span("SCP_PUB_AUC_VW_AUC_NAME", 1, "no id")])
    panel = "<PAGE><GENSCRIPT id='x'><![CDATA[var a = '<span id=\"SCP_P_AUCDTL_VW_AUC_ID$0\">wrong</span>';]]></GENSCRIPT><FIELD><![CDATA[" + span("SCP_P_AUCDTL_VW_AUC_ID", 0, "EV00000123") + span("SCP_P_AUCDTL_VW_AUC_STATUS", 0, "Open Round") + "<textarea disabled id='SCP_P_AUCDTL_VW_DESCRLONG$0'>Seal  roads</textarea>]]></FIELD></PAGE>"
    details = portals.ok_details(spark.createDataFrame([("EV00000123", panel)], "external_id string, payload string"))
    record = {"external_id": "EV00000123", "title": "Chip seal", "agency": "ODOT", "category": "RFx", "posted_date": date(2026, 7, 1), "due_date": datetime(2026, 7, 22, 20), "detail_url": "https://financials.ok.gov/psc/SOKLFP1DS/SUPPLIER/ERP/c/SCP_PUBLIC_MENU_FL.SCP_PUB_BID_CMP_FL.GBL", "status_on_site": "Posted"}
    listed = portals.REGISTRY["ok"](pages(spark, page))
    expect(listed, record)
    expect(portals.enriched(listed, details), record | {"description": "Seal roads", "status_on_site": "Open Round"})


HUB, SITE = "https://www.dfa.ms.gov/bids-and-rfps-notices", "https://www.dfa.ms.gov"


def test_ms_four_shapes(spark):
    hub = """<dl class="ckeditor-accordion"><dt>Current DFA Bids</dt><dd><p>RFx# 3160007001 - Audit <b>services</b></p><ul><li><a href="/files/rfp.pdf">RFP</a></li><li><a href="/files/am1.pdf">Amendment 1</a></li></ul>
      <p>plain words</p><p>RFx 3160007002 – Chairs</p></dd><dt>DFA Completed Procurements</dt><dd><p>RFx# 3160000001 - Old</p></dd><dt>no body</dt></dl>"""
    purchasing = """<dl class="ckeditor-accordion"><dt>Fuel cards</dt><dd><p>RFP 3160007003, Smart RFP # 12. Responses are received at 2:00 p.m., Thursday, August 27, 2026.</p><a href="mailto:x@y">mail</a><a href="docs/fuel%20card.pdf"></a></dd>
      <dt>Copy paper &amp; toner</dt><dd>Open until filled.</dd></dl>"""
    construction = """<dl class="ckeditor-accordion"><dt>GS 104-230</dt><dd><ul><li><span>GS No:</span> 104-230</li><li><span>Project Title:</span> Roof</li><li><span>Using Agency:</span> State Hospital</li><li><span>Professional:</span> A. Smith</li><li><span>Date:</span> 8/20/2026 2:00 PM</li><li><span>RFx#:</span> 3160007001</li></ul><a href="/files/roof.pdf">Plans</a><a href="/files/rfp.pdf">again</a></dd>
      <dt>GS 200-1</dt><dd><ul><li><span>Date:</span> 8/21/2026</li></ul></dd></dl><dl class="ckeditor-accordion"><dt>GS 1</dt><dd><ul><li><span>GS No:</span> 1</li></ul></dd></dl>"""
    leases = """<table class="tblwdt"><thead><tr><td>AGENCY</td><td>CITY</td><td>DEADLINE</td></tr></thead><tbody><tr><td>Revenue</td><td><a href="/files/lease.pdf">Jackson / Hinds</a></td><td>9/1/2026</td></tr><tr><td></td><td>x</td><td>y</td></tr></tbody></table>
      <table class="tblwdt"><tbody><tr><td>Awarded</td><td>a</td><td>b</td></tr></tbody></table>"""
    dfa = "Mississippi Department of Finance and Administration"
    buyer = "MS DFA Office of Purchasing, Travel and Fleet Management"
    expect(
        portals.ms(pages(spark, hub, purchasing, construction, leases)),
        {"external_id": "RFx-3160007001", "title": "Audit services", "agency": dfa, "category": "Current DFA Bids", "description": "Audit services", "due_date": datetime(2026, 8, 20, 19), "detail_url": f"{SITE}/files/rfp.pdf", "status_on_site": "Amended", "attachments": [("RFP", f"{SITE}/files/rfp.pdf"), ("Amendment 1", f"{SITE}/files/am1.pdf"), ("Plans", f"{SITE}/files/roof.pdf")]},
        {"external_id": "RFx-3160007002", "title": "Chairs", "agency": dfa, "category": "Current DFA Bids", "description": "Chairs", "detail_url": HUB, "status_on_site": "Open"},
        {"external_id": "RFx-3160007003", "title": "Fuel cards", "agency": buyer, "category": "Purchasing", "description": "RFP 3160007003, Smart RFP # 12. Responses are received at 2:00 p.m., Thursday, August 27, 2026.mail", "due_date": datetime(2026, 8, 27, 19), "detail_url": f"{SITE}/current-bids-and-proposals", "status_on_site": "Open", "attachments": [("fuel card.pdf", f"{SITE}/docs/fuel%20card.pdf")]},
        {"external_id": "MSPURCH-copy-paper-toner", "title": "Copy paper & toner", "agency": buyer, "category": "Purchasing", "description": "Open until filled.", "detail_url": f"{SITE}/current-bids-and-proposals", "status_on_site": "Open"},
        {"external_id": "GS-200-1", "title": "GS 200-1", "agency": "MS DFA Bureau of Building, Grounds and Real Property Management", "category": "Construction", "description": "GS 200-1", "due_date": datetime(2026, 8, 21, 5), "detail_url": f"{SITE}/construction-solicitations-bid-tabs", "status_on_site": "Open"},
        {"external_id": "MSLEASE-revenue-jackson-hinds-9-1-2026", "title": "Request for Lease Proposals — Revenue (Jackson, Hinds)", "agency": "Revenue", "category": "Real Property / Lease", "description": "Request for Lease Proposals — Revenue (Jackson, Hinds)", "due_date": datetime(2026, 9, 1, 5), "detail_url": f"{SITE}/files/lease.pdf", "status_on_site": "Open", "attachments": [("Jackson / Hinds", f"{SITE}/files/lease.pdf")]},
    )


def test_documents_of_a_page(spark):
    html = """<a href="#x.pdf">jump</a><a href="mailto:a.pdf">m</a><a href="/f/a.pdf">Plans  <b>A</b></a><a href="f2.docx?x"></a><a href="/page">Home</a><a href="/get?id=4">Scope of Work</a><a href="here">Exhibit</a>
      <a href="/a/BidAttachment/9">nine</a><a href="https://h/download.aspx?OriginalFileName=t%20x.pdf"></a><iframe src="/e.docx"></iframe><iframe src="/video"></iframe><object data="https://h/v/showDocument?n=1"></object><a href="/f/a.pdf">again</a>"""
    df = spark.createDataFrame([(1, "https://p.gov/dir/list.html", html), (2, "https://p.gov/", None)], "id int, url string, html string")
    got = [(r["url"], r["filename"]) for r in discovery.documents(df, "id", "html", F.col("url")).orderBy("position").collect()]
    assert got == [
        ("https://p.gov/f/a.pdf", "Plans A"), ("https://p.gov/dir/f2.docx?x", "document"), ("https://p.gov/get?id=4", "Scope of Work"), ("https://p.gov/a/BidAttachment/9", "nine"),
        ("https://h/download.aspx?OriginalFileName=t%20x.pdf", "t x.pdf"), ("https://p.gov/e.docx", "document"), ("https://h/v/showDocument?n=1", "showDocument"),
    ]
    assert [r["url"] for r in discovery.documents(df, "id", "html", F.col("url"), most=2).orderBy("position").collect()] == [u for u, _ in got[:2]]


def test_no_pages_and_other_pages(spark):
    for key, dialect in portals.REGISTRY.items():
        assert dialect(pages(spark, "not json", "", None, "<p>other</p>")).count() == 0, key


def test_nc(spark):
    def record(guid, **parts):
        return {"Id": guid, "Attributes": [{"Name": n, **a} for n, a in parts.items()]}

    records = [
        record(
            "g1", evp_solicitationnbr={"Value": "10-26", "DisplayValue": "10-2026"}, evp_name={"Value": "Road  salt"}, owningbusinessunit={"Value": {"Id": "u"}, "DisplayValue": None, "FormattedValue": "DOT"}, evp_description={"Value": "Bulk", "DisplayValue": "Bulk salt"},
            evp_posteddate={"Value": "/Date(1782864000000)/", "DisplayValue": "1/1/2001"}, evp_opendate={"Value": 1785600000000}, statuscode={"Value": 1, "FormattedValue": "Open"},
        ),
        record("g2", evp_solicitationnbr={"Value": 5}, evp_name={"DisplayValue": ""}, evp_posteddate={"Value": "1782864000000", "DisplayValue": "7/2/2026"}, evp_opendate={"Value": {"x": 1}, "DisplayValue": "8/3/2026 2:00 PM"}, statuscode={"Value": 1}),
        {"Id": "g3", "Attributes": None},
    ]
    page, url = json.dumps({"Records": records, "MoreRecords": False}), "https://evp.nc.gov/solicitations/details/?id="
    want = [
        {"external_id": "10-2026", "title": "Road salt", "agency": "DOT", "description": "Bulk salt", "posted_date": date(2026, 7, 1), "due_date": datetime(2026, 8, 1, 16), "detail_url": f"{url}g1", "status_on_site": "Open"},
        {"external_id": "g2", "title": "(untitled)", "posted_date": date(2026, 7, 2), "due_date": datetime(2026, 8, 3, 18), "detail_url": f"{url}g2"},
        {"external_id": "g3", "title": "(untitled)", "detail_url": f"{url}g3"},
    ]
    expect(portals.nc(pages(spark, page, "not json"), untitled="(untitled)"), *want)
    # another layout's names for the same attributes
    renamed = {k: v.replace("evp_", "new_") for k, v in portals.NC_ATTRIBUTES.items()}
    expect(portals.nc(pages(spark, page.replace("evp_", "new_")), renamed, "(untitled)"), *want)


def test_nc_layout(spark):
    layouts = [{"Base64SecureConfiguration": "abc=", "SortExpression": "", "Columns": [1, {"x": None}]}, {"Base64SecureConfiguration": "no"}]
    plain = json.dumps(layouts)
    values = [base64.b64encode(plain.encode()).decode(), plain, json.dumps(layouts[0]), "?", None, "[]", '[{"SortExpression": "a ASC"}]']
    rows = spark.createDataFrame(list(enumerate(values)), "n int, t string").select("n", portals.nc_layout(F.col("t")).alias("x")).orderBy("n").collect()
    usual = "evp_posteddate DESC"
    assert [tuple(r["x"]) for r in rows] == [("abc=", usual), ("abc=", usual), (None, usual), (None, usual), (None, usual), (None, usual), (None, "a ASC")]

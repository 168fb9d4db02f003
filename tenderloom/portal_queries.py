"""Queries over portal payloads: saved pages are written from the domain tables and read back by the dialects.

What a dialect reads must be what was written, so the SQL of these queries
states the records themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plans.views import Views
from .sources import portals, saved
from .sources.tables import new_folder

#: Records of a saved page.
PAGE = 200


def _rows(v: Views) -> DataFrame:
    return v.opportunities.withColumn("page", F.floor(F.col("id") / PAGE).cast("int"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by page before any are gathered: gathering in the scan's tasks first sorts all of a task's rows there, as many as its split has."""
    return rows.repartition("page")


def _json_pages(rows: DataFrame, path: str, record: Column) -> DataFrame:
    body = F.collect_list(record)
    return _dealt(rows).groupBy("page").agg((F.to_json(F.struct(body.alias(path))) if path else F.to_json(body)).alias("payload"))


def _html_pages(rows: DataFrame, line: Column) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"])
    return _dealt(rows).groupBy("page").agg(F.concat(F.lit("<html><table>"), F.array_join(lines, "\n"), F.lit("</table></html>")).alias("payload"))


def _cells(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td class='x'>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>"))


def _shown(records: DataFrame, *columns: str) -> DataFrame:
    links = F.array_join(F.transform("attachments", lambda a: F.concat(a["filename"], F.lit("="), a["url"])), ";")
    return records.withColumn("links", F.coalesce(links, F.lit(""))).withColumn("posted_date", F.col("posted_date").cast("string")).select("external_id", *columns)


def _whole(records: DataFrame) -> DataFrame:
    """Every column of a record, as text where DuckDB has another type for it."""
    links = F.array_join(F.transform("attachments", lambda a: F.concat(a["filename"], F.lit("="), a["url"])), ";")
    return records.select(*(F.coalesce(links, F.lit("")).alias("links") if c == "attachments" else F.col(c).cast("string") if c == "posted_date" else F.col(c) for c in portals.FIELDS))


def stated(rows: str = "opportunities", **columns: str) -> str:
    """SQL of records with these columns; the others are null, and there are no links."""
    kinds = {"string": "VARCHAR", "date": "VARCHAR", "timestamp": "TIMESTAMP", "double": "DOUBLE"}
    made = [f"{columns.get(c, f'CAST(NULL AS {kinds[k]})')} AS {c}" for c, k in portals.FIELDS.items() if c != "attachments"]
    return f"SELECT {', '.join(made)}, {columns.get('links', chr(39) * 2)} AS links FROM {rows}"


def us(column: str, pattern: str = "M/d/yyyy") -> Column:
    return F.date_format(column, pattern)


def text(value: str) -> Column:
    return F.lit(value)


def local() -> Column:
    """Day and time of a due date, five hours before UTC."""
    return F.col("due_date") - F.expr("interval 5 hours")


def later(time: Column) -> Column:
    """Twenty years on: two dialects read only dates of this century."""
    return time + F.expr("interval 20 years")


ID, TITLE = "external_id", "title"


def register(query: Callable) -> None:
    """Adds the queries by the catalogue's decorator."""
    o = "opportunities"

    day, noon, tall = "CAST(posted_date AS VARCHAR)", "due_date", "CAST(id AS VARCHAR)"

    @query("portal_sam", stated(external_id="CASE WHEN id % 2 = 0 THEN external_id ELSE 'n' || id END", title="title", agency="agency || ' · Office'", category="concat_ws(' · ', category, CASE WHEN id % 3 = 0 THEN 'Set aside' END)", naics_code="naics_code", description="description", posted_date=day, due_date=noon, detail_url="CASE WHEN id % 5 = 0 THEN 'https://sam.example/' || id ELSE 'https://sam.gov/opp/n' || id || '/view' END", status_on_site="'Open'", links="'attachment-1=https://sam.example/f/' || id || ';attachment-2=https://sam.example/g'"), o)
    def _(v):
        n = F.col("id").cast("string")
        record = F.struct(
            F.concat(text("n"), n).alias("noticeId"), F.when(F.col("id") % 2 == 0, F.col(ID)).otherwise("").alias("solicitationNumber"), F.concat(text("  "), TITLE, text(" ")).alias("title"), F.concat("agency", text(".Office.Branch")).alias("fullParentPathName"), F.col("category").alias("type"),
            F.when(F.col("id") % 3 == 0, "Set aside").alias("typeOfSetAsideDescription"), F.col("naics_code").alias("naicsCode"), F.col("description"), F.date_format("posted_date", "yyyy-MM-dd").alias("postedDate"), F.date_format("due_date", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("responseDeadLine"),
            F.when(F.col("id") % 5 == 0, F.concat(text("https://sam.example/"), n)).alias("uiLink"), F.array(F.concat(text("https://sam.example/f/"), n), text("https://sam.example/g")).alias("resourceLinks"),
        )
        return _whole(portals.sam(_json_pages(_rows(v), "opportunitiesData", record)))

    @query("portal_tx_details", """SELECT external_id, title, agency, CASE WHEN id % 4 < 3 THEN 'Scope ' || id || chr(10) || 'and terms' END AS description, CAST(posted_date AS VARCHAR) AS posted_date, due_date, CASE WHEN id % 4 < 2 THEN CAST(id % 1000 + 0.5 AS DOUBLE) END AS estimated_value,
        CASE WHEN id % 4 < 3 THEN 'a.pdf=https://tx.example/files/' || id || '.pdf;b.pdf=http://other.example/b.pdf' ELSE '' END AS links FROM opportunities""", o)
    def _(v):
        rows = _rows(v)
        record = F.struct(F.col(ID).alias("solicitationId"), TITLE, F.col("agency").alias("agencyName"), us("posted_date").alias("postingDate"), F.date_format(local(), "M/d/yyyy").alias("responseDue"), F.date_format(local(), "h:mm a").alias("responseTime"))
        files = F.array(F.struct(text("a.pdf").alias("fileName"), F.concat(text("/files/"), F.col("id").cast("string"), text(".pdf")).alias("fileURL")), F.struct(text("b.pdf").alias("fileName"), text("http://other.example/b.pdf").alias("fileURL")), F.struct(F.lit(None).cast("string").alias("fileName"), text("x").alias("fileURL")))
        value = F.when(F.col("id") % 4 < 2, F.concat((F.col("id") % 1000).cast("string"), text(".5 USD"))).otherwise("none")
        detail = F.to_json(F.struct(F.concat(text("<p>Scope "), F.col("id").cast("string"), text("</p><div>and terms</div>")).alias("description"), value.alias("value"), files.alias("attachments")))
        details = rows.select(F.col(ID), F.when(F.col("id") % 4 == 3, "<html>not found</html>").otherwise(detail).alias("payload"))
        found = portals.enriched(portals.tx(_json_pages(rows, "lines", record)), portals.tx_details(details, "https://tx.example"))
        return _shown(found, "title", "agency", "description", "posted_date", "due_date", "estimated_value", "links")

    def advantage_query(key: str, url: str) -> None:
        @query(f"portal_{key}", stated(external_id="CASE WHEN id % 4 = 3 THEN '[' || external_id || ']' ELSE external_id END", title="title", agency="agency", category="CASE id % 2 WHEN 0 THEN 'Goods' ELSE '02' END", description="'RFP — Buyer: Pat' || CASE WHEN id % 3 = 0 THEN ' — pat@x.gov' ELSE '' END", posted_date=day, due_date=noon, detail_url=f"'{url}'", status_on_site="'Open'"), o)
        def _(v):
            reference = F.concat(F.when(F.col("id") % 4 == 3, "").otherwise("[RFP,1]"), text("["), ID, text("]"))
            record = F.struct(
                reference.alias("DOC_REF"), F.col(TITLE).alias("DOC_DSCR"), F.col("agency").alias("DEPT_NM"), F.when(F.col("id") % 2 == 0, "01").otherwise("02").alias("SO_CAT_CD"), text("O").alias("SO_STA"), text("RFP").alias("DOC_CD_CONCAT"),
                text("Pat ").alias("BUYR_NM"), F.when(F.col("id") % 3 == 0, "pat@x.gov").otherwise("").alias("BUYR_EMAIL_AD"), F.unix_millis(F.col("posted_date").cast("timestamp")).alias("PUB_DT"), F.coalesce(F.unix_millis("due_date").cast("string"), text("")).alias("SO_CLSNG_DT_TM"),
            )
            labels = text('"page_metadata":{"datasources":{"T1SO_SRCH_QRY":{"columns":{"SO_CAT_CD":{"codedValuesList":[{"01":"Goods"},{"03":"Other"}]},"SO_STA":{"codedValuesList":[{"O":"Open"}]}}}}}')
            rows = _json_pages(_rows(v), "row_data", record)
            return _whole(portals.REGISTRY[key](rows.withColumn("payload", F.concat(text('{"data":{"ds_data":{"T1SO_SRCH_QRY":'), "payload", text("}},"), labels, text("}")))))

    for key, url in (("ak", "https://iris-vss.alaska.gov/PRDVSS1X1/Advantage4"), ("ky", "https://vss.ky.gov/vssprod-ext/Advantage4")):
        advantage_query(key, url)

    @query("portal_mo", stated(external_id="external_id", title="title", agency="agency", category="category", description="nullif(concat_ws(' — ', description, CASE WHEN id % 3 = 0 THEN 'Amendment: more' END), '')", posted_date=day, due_date=noon, detail_url="'https://ewqg.fa.us8.oraclecloud.com/fscmUI/redwood/negotiation-abstracts/view/abstractlisting?prcBuId=300000005255687'", status_on_site="'Active'", links="CASE WHEN id % 2 = 0 THEN 'spec.pdf=https://ewqg.fa.us8.oraclecloud.com/f/' || id ELSE '' END"), o)
    def _(v):
        posted = F.date_format("posted_date", "yyyy-MM-dd")
        file = F.struct(text("spec.pdf").alias("FileName"), text("Spec").alias("Title"), F.concat(text("/f/"), F.col("id").cast("string")).alias("FileUrl"))
        record = F.struct(
            F.col(ID).alias("Negotiation"), F.col(TITLE).alias("NegotiationTitle"), F.col("category").alias("NegotiationType"), F.col("agency").alias("ProcurementBUName"), F.coalesce("description", text("")).alias("Synopsis"), F.when(F.col("id") % 3 == 0, "more").alias("AmendmentDescription"),
            text("Active").alias("NegotiationStatus"), text("ACTIVE").alias("NegotiationStatusCode"), F.date_format("due_date", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("CloseDate"), F.when(F.col("id") % 4 > 0, posted).alias("PostingDate"), posted.alias("PublishDate"),
            F.struct(F.when(F.col("id") % 2 == 0, F.array(file)).alias("items")).alias("attachments"),
        )
        return _whole(portals.mo(_json_pages(_rows(v), "items", record)))

    @query("portal_nc", stated(external_id="CASE WHEN id % 7 = 0 THEN 'g' || id ELSE external_id END", title="CASE WHEN id % 11 = 0 THEN '(untitled)' ELSE title END", agency="agency", description="description", posted_date=day, due_date="CASE WHEN id % 3 < 2 THEN " + noon + " END", detail_url="'https://evp.nc.gov/solicitations/details/?id=g' || id", status_on_site="CASE WHEN id % 4 > 0 THEN 'Open' END"), o)
    def _(v):
        """Attributes of which each shows itself in another of three ways, and dates of three kinds."""
        none, kind = F.lit(None).cast("string"), F.col("id") % 3
        empty = F.lit(None).cast("variant")

        def part(name, value=empty, display=none, formatted=none):
            return F.struct(text(name).alias("Name"), value.alias("Value"), display.alias("DisplayValue"), formatted.alias("FormattedValue"))

        def any_way(name, value):
            return part(name, F.when(kind == 0, value.cast("variant")).otherwise(F.parse_json(text('{"Id": 1}'))), F.when(kind == 1, value), F.when(kind == 2, value))

        def date(name, millis, display):
            marked = F.concat(text("/Date("), millis.cast("string"), text(")/"))
            return part(name, F.when(kind == 0, marked.cast("variant")).when(kind == 1, millis.cast("variant")), F.when(kind == 2, display))

        record = F.struct(
            F.concat(text("g"), F.col("id").cast("string")).alias("Id"),
            F.array(
                part("other", display=text("x")), any_way("evp_solicitationnbr", F.when(F.col("id") % 7 > 0, F.col(ID)).otherwise(" ")), any_way("evp_name", F.when(F.col("id") % 11 > 0, F.col(TITLE)).otherwise("")), any_way("owningbusinessunit", F.col("agency")),
                any_way("evp_description", F.col("description")), date("evp_posteddate", F.unix_millis(F.col("posted_date").cast("timestamp")), us("posted_date")), date("evp_opendate", F.unix_millis("due_date"), none),
                part("statuscode", F.lit(1).cast("variant"), F.when(F.col("id") % 4 > 0, text("Open"))),
            ).alias("Attributes"),
        )
        return _whole(portals.nc(_json_pages(_rows(v), "Records", record), untitled="(untitled)"))

    @query("portal_phx", stated("opportunities WHERE id % 5 < 3", external_id="external_id", title="title", agency="CASE WHEN id % 3 = 0 THEN 'City of Phoenix' ELSE agency END", category="CASE WHEN id % 4 = 0 THEN 'Lights; Poles' ELSE category END", naics_code="CASE WHEN id % 4 = 0 THEN '28500' END", description="CASE WHEN id % 4 = 0 THEN 'New lamps ' || id WHEN id % 4 = 1 THEN 'Later' END", posted_date=day, due_date=noon, q_and_a_deadline="due_date - INTERVAL 1 DAY", detail_url="'https://procurement.opengov.com/portal/phoenix/projects/' || id", status_on_site="CASE id % 5 WHEN 2 THEN 'Coming Soon' ELSE 'open' END", links="CASE WHEN id % 4 = 0 THEN 'a.pdf=https://x.example/a;Plan=https://x.example/b' ELSE '' END"), o)
    def _(v):
        n, iso = F.col("id") % 5, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
        record = F.struct(
            "id", F.col(TITLE), F.when(n < 2, "open").otherwise("draft").alias("status"), F.col(ID).alias("financialId"), F.when(F.col("id") % 3 == 0, " ").otherwise(F.col("agency")).alias("departmentName"), (n == 2).alias("comingSoon"), (n == 4).alias("isPrivate"),
            F.when(F.col("id") % 2 == 0, F.date_format("posted_date", iso)).alias("postedAt"), F.date_format("posted_date", iso).alias("postScheduledAt"), F.date_format("due_date", iso).alias("proposalDeadline"), F.date_format(F.col("due_date") - F.expr("interval 1 day"), iso).alias("qaDeadline"), F.struct(F.col("category").alias("title")).alias("template"),
        )
        kinds = F.array(F.struct(text("28500").alias("code"), text(" Lights").alias("title")), F.struct(text("2").alias("code"), text("Poles").alias("title")))
        files = F.array(F.struct(text("a.pdf").alias("filename"), text("").alias("title"), text("https://x.example/a").alias("url")), F.struct(F.lit(None).cast("string").alias("filename"), text("Plan").alias("title"), text("https://x.example/b").alias("url")))
        full = F.to_json(F.struct(F.concat(text("<p>New lamps</p> "), F.col("id").cast("string")).alias("summary"), text("<p>old</p>").alias("background"), kinds.alias("categories"), files.alias("attachments")))
        details = _rows(v).where("id % 4 < 2").select(ID, F.when(F.col("id") % 4 == 0, full).otherwise('{"background":"<div>Later</div>"}').alias("payload"))
        return _whole(portals.enriched(portals.phx(_json_pages(_rows(v), "projects", record)), portals.phx_details(details)))

    @query("portal_ok", stated(external_id="external_id", title="title", agency="agency", category="'RFx'", description="CASE WHEN id % 3 = 0 THEN 'Long ' || id END", posted_date=day, due_date=noon, detail_url="'https://financials.ok.gov/psc/SOKLFP1DS/SUPPLIER/ERP/c/SCP_PUBLIC_MENU_FL.SCP_PUB_BID_CMP_FL.GBL'", status_on_site="CASE WHEN id % 3 = 0 THEN 'Open Round' ELSE 'Posted' END"), o)
    def _(v):
        rows = _rows(v)
        names = {"SCP_PUB_AUC_VW_AUC_ID": F.col(ID), "SCP_PUB_AUC_VW_AUC_NAME": F.col(TITLE), "BUS_UNIT_AUC_VW_DESCR": F.col("agency"), "SCP_PUB_AUC_VW_AUC_TYPE": text("RFx"), "SCP_COSP_WK_FL_SCP_STRT_DATE_CHAR": us("posted_date"), "SCP_COSP_WK_FL_SCP_END_DATE_CHAR": F.coalesce(F.concat(F.date_format(local(), "M/d/yyyy h:mma"), text(" CDT")), text(""))}
        span = lambda field, n, value: F.concat(text(f"<span class='ps_box-value' id='{field}$"), n, text("'>"), value, text("</span>"))
        line = F.concat(*(span(f, (F.col("id") % PAGE).cast("string"), value) for f, value in names.items()))
        echoed = F.when(F.col("id") % 3 == 1, "OPP-OTHER").otherwise(F.col(ID))
        panel = F.concat(text("<PAGE><GENSCRIPT><![CDATA[x]]></GENSCRIPT><FIELD><![CDATA["), span("SCP_P_AUCDTL_VW_AUC_ID", text("0"), echoed), span("SCP_P_AUCDTL_VW_AUC_STATUS", text("0"), text("Open Round")), text("<textarea id='SCP_P_AUCDTL_VW_DESCRLONG$0'>Long "), F.col("id").cast("string"), text("</textarea>]]></FIELD></PAGE>"))
        return _whole(portals.enriched(portals.REGISTRY["ok"](_html_pages(rows, line)), portals.ok_details(rows.where("id % 3 < 2").select(ID, panel.alias("payload")))))

    @query("portal_ar", "SELECT external_id, title, agency, due_date, CASE WHEN id % 6 = 0 THEN 'Amended' ELSE 'Open' END AS status_on_site FROM opportunities", o)
    def _(v):
        mark = F.when(F.col("id") % 6 == 0, "<img alt=\"Recently updated\">").otherwise("")
        line = _cells(mark, F.concat(text("<b>"), TITLE, text("</b>")), F.col("agency"), F.coalesce(F.date_format(local(), "M/d/yyyy h:mm a"), text("")), F.concat(text("<a href='/bid'>"), ID, text("</a>")))
        return _shown(portals.REGISTRY["ar"](_html_pages(_rows(v), line)), "title", "agency", "due_date", "status_on_site")

    site = "https://www.dfa.ms.gov"
    slug = "trim(substr(trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80))"
    shape = "CAST(id // 200 AS BIGINT) % 4"
    rfx = f"(({shape}) = 0 OR id % 2 = 0 AND ({shape}) < 3)"

    @query("portal_ms", stated(
        f"(SELECT *, {shape} AS shape, 'files/' || id || '.pdf' AS file, strftime(due_date - INTERVAL 5 HOUR, '%-m/%-d/%Y') AS due_day FROM opportunities)",
        external_id=f"CASE WHEN {rfx} THEN 'RFx-' || (1000000 + id) WHEN shape = 1 THEN 'MSPURCH-' || {slug.format("title || ' ' || id")} WHEN shape = 2 THEN 'GS-' || id ELSE 'MSLEASE-' || {slug.format("concat_ws('-', agency || ' ' || id, 'Jackson, Hinds', coalesce(due_day, ''))")} END",
        title="CASE WHEN shape = 3 THEN 'Request for Lease Proposals — ' || agency || ' ' || id || ' (Jackson, Hinds)' WHEN shape = 1 THEN title || ' ' || id ELSE title END",
        agency="CASE shape WHEN 0 THEN 'Mississippi Department of Finance and Administration' WHEN 1 THEN 'MS DFA Office of Purchasing, Travel and Fleet Management' WHEN 2 THEN agency ELSE agency || ' ' || id END",
        category="CASE shape WHEN 0 THEN 'Current Bids' WHEN 1 THEN 'Purchasing' WHEN 2 THEN 'Construction' ELSE 'Real Property / Lease' END",
        description="CASE shape WHEN 0 THEN title WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 'RFP ' || (1000000 + id) || ' ' ELSE '' END || 'Responses are received' || coalesce(' at ' || strftime(due_date - INTERVAL 5 HOUR, '%-I:%M') || CASE WHEN hour(due_date - INTERVAL 5 HOUR) < 12 THEN ' a.m., ' ELSE ' p.m., ' END || strftime(due_date - INTERVAL 5 HOUR + INTERVAL 20 YEAR, '%B %-d, %Y'), '') || ' Plans' WHEN 2 THEN title || ' — ' || agency ELSE 'Request for Lease Proposals — ' || agency || ' ' || id || ' (Jackson, Hinds)' END",
        due_date="CASE shape WHEN 1 THEN date_trunc('minute', due_date - INTERVAL 5 HOUR + INTERVAL 20 YEAR) + INTERVAL 5 HOUR WHEN 2 THEN date_trunc('minute', due_date) WHEN 3 THEN date_trunc('day', due_date - INTERVAL 5 HOUR) + INTERVAL 5 HOUR END",
        detail_url=f"CASE WHEN shape = 1 THEN '{site}/current-bids-and-proposals' ELSE '{site}/' || file END", status_on_site="CASE WHEN shape = 0 AND id % 3 = 0 THEN 'Amended' ELSE 'Open' END",
        links=f"CASE shape WHEN 0 THEN CASE WHEN id % 3 = 0 THEN 'Amendment ' || id ELSE 'Plans' END WHEN 3 THEN 'Jackson / Hinds' ELSE 'Plans' END || '={site}/' || file",
    ), o)
    def _(v):
        n, number, kind = F.col("id").cast("string"), (F.col("id") + 1_000_000).cast("string"), F.floor(F.col("id") / PAGE) % 4
        file = lambda name: F.concat(text('<a href="/files/'), n, text('.pdf">'), name, text("</a>"))
        at = F.coalesce(F.concat(text(" at "), F.date_format(local(), "h:mm"), F.when(F.hour(local()) < 12, " a.m., ").otherwise(" p.m., "), F.date_format(later(local()), "MMMM d, yyyy")), text(""))
        item = lambda label, value: F.concat(text(f"<li><span>{label}:</span> "), value, text("</li>"))
        hub = F.concat(text("<p>RFx# "), number, text(" - "), TITLE, text("</p><ul><li>"), file(F.when(F.col("id") % 3 == 0, F.concat(text("Amendment "), n)).otherwise("Plans")), text("</li></ul>"))
        purchasing = F.concat(text("<dt>"), TITLE, text(" "), n, text("</dt><dd>"), F.when(F.col("id") % 2 == 0, F.concat(text("RFP "), number, text(" "))).otherwise(""), text("Responses are received"), at, text(" "), file(text("Plans")), text("</dd>"))
        construction = F.concat(text("<dt>GS "), n, text("</dt><dd><ul>"), item("Project Title", F.col(TITLE)), item("Using Agency", F.col("agency")), item("Date", F.coalesce(F.date_format(local(), "M/d/yyyy h:mm a"), text(""))), F.when(F.col("id") % 2 == 0, item("RFx#", number)).otherwise(""), text("</ul>"), file(text("Plans")), text("</dd>"))
        lease = F.concat(text("<tr><td>"), "agency", text(" "), n, text("</td><td>"), file(text("Jackson / Hinds")), text("</td><td>"), F.coalesce(F.date_format(local(), "M/d/yyyy"), text("")), text("</td></tr>"))
        line = F.when(kind == 0, hub).when(kind == 1, purchasing).when(kind == 2, construction).otherwise(lease)
        lines = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"])
        body, kind = F.array_join(lines, "\n"), F.col("page") % 4
        folded = F.when(kind == 0, F.concat(text("<dt>Current Bids</dt><dd>"), body, text("</dd><dt>Completed</dt><dd><p>RFx# 9999999 - Old</p></dd>"))).otherwise(body)
        page = F.when(kind == 3, F.concat(text('<table class="tblwdt"><thead><tr><td>A</td><td>B</td><td>C</td></tr></thead><tbody>'), body, text("</tbody></table>"))).otherwise(F.concat(text('<dl class="ckeditor-accordion">'), folded, text("</dl>")))
        return _whole(portals.ms(_dealt(_rows(v)).groupBy("page").agg(page.alias("payload"))))

    la_base = "https://wwwcfprd.doa.louisiana.gov/osp/lapac/"

    @query("portal_la", stated(external_id="external_id", title="title", agency="'Dept ' || (id // 200)", description="title || 'Original: ' || external_id || CASE WHEN id % 4 = 0 THEN ' Bid Cancelled: today' ELSE '' END", posted_date=day, due_date="CASE WHEN id % 4 > 0 THEN due_date END", detail_url=f"'{la_base}f/' || id || '.pdf'", status_on_site="CASE WHEN id % 4 = 0 THEN 'Cancelled' ELSE 'Open' END", links=f"external_id || '={la_base}f/' || id || '.pdf' || CASE WHEN id % 3 = 0 THEN ';addendum={la_base}f/' || id || '-2.pdf' ELSE '' END"), o)
    def _(v):
        number = F.col("id").cast("string")
        link = lambda tail, name: F.concat(text("<a href='f/"), number, text(f"{tail}'>"), name, text("</a>"))
        opens = F.when(F.col("id") % 4 == 0, "12/30/9999").otherwise(F.coalesce(F.date_format(local(), "M/d/yyyy h:mm:ss a"), text("")))
        about = F.concat(TITLE, text("<strong>Original:</strong> "), link(".pdf", F.col(ID)), F.when(F.col("id") % 4 == 0, " Bid Cancelled: today").otherwise(""))
        more = F.when(F.col("id") % 3 == 0, _cells(F.concat(text("Addendum "), link("-2.pdf", text("addendum"))), text("7/1/2026"))).otherwise("")
        pages = _html_pages(_rows(v), F.concat(_cells(F.concat(text("<span>"), ID, text("</span>")), about, us("posted_date"), opens), more))
        pages = pages.select("page", F.replace("payload", text("<table>"), text("<table class='bid'>")).alias("payload"), F.concat(text("Dept "), F.col("page").cast("string")).alias("department"), text(la_base).alias("url"))
        return _whole(portals.la(pages))

    @query("portal_ks_details", """SELECT external_id, title, agency, CASE WHEN id % 3 = 0 THEN 'Line ' || id % 10 ELSE 'RFP' END AS category, CAST(posted_date AS VARCHAR) AS posted_date, CASE WHEN id % 3 = 0 THEN 'Long ' || id || ' — Line ' || id % 10 END AS description, CASE WHEN id % 3 = 0 THEN 'Open Round' ELSE 'Posted' END AS status_on_site FROM opportunities""", o)
    def _(v):
        rows = _rows(v)
        names = {"SCP_PUB_AUC_VW_AUC_ID": F.col(ID), "SCP_PUB_AUC_VW_AUC_NAME": F.col(TITLE), "BUS_UNIT_AUC_VW_DESCR": F.col("agency"), "SCP_PUB_AUC_VW_AUC_TYPE": text("RFP"), "SCP_COSP_WK_FL_SCP_STRT_DATE_CHAR": us("posted_date")}
        span = lambda field, n, value: F.concat(text(f"<span class='c' id=\"{field}$"), n, text("\">"), value, text("</span>"))
        line = F.concat(*(span(f, (F.col("id") % PAGE).cast("string"), value) for f, value in names.items()))
        echoed = F.when(F.col("id") % 3 == 1, "OPP-OTHER").otherwise(F.col(ID))
        page = F.concat(
            span("KS_AUCDTL_VW_AUC_ID", text("0"), echoed), text("<textarea id=\"KS_AUCDTL_VW_DESCRLONG$0\">Long "), F.col("id").cast("string"), text("</textarea>"),
            span("KS_AUC_LN_VW_DESCR254_MIXED", text("0"), F.concat(text("Line "), (F.col("id") % 10).cast("string"))), span("KS_AUCDTL_VW_AUC_STATUS", text("0"), text("Open Round")),
        )
        details = rows.where("id % 3 < 2").select(F.col(ID), page.alias("payload"))
        found = portals.enriched(portals.grid(_html_pages(rows, line)), portals.ks_details(details))
        return _shown(found, "title", "agency", "category", "posted_date", "description", "status_on_site")

    @query("portal_ma", "SELECT external_id, title, agency, due_date - INTERVAL 1 HOUR AS due_date, 'Sent' AS status_on_site FROM opportunities", o)
    def _(v):
        none = text("")
        row = lambda title: _cells(F.col(ID), none, F.col("agency"), none, none, none, title, F.coalesce(F.date_format(local(), "M/d/yyyy h:mm a"), none), none, none, text("Sent"))
        return _shown(portals.REGISTRY["ma"](_html_pages(_rows(v), F.concat(row(text("earlier title")), row(F.col(TITLE))))), "title", "agency", "due_date", "status_on_site")

    @query("portal_tn", stated(external_id="external_id", title="title", category="CASE WHEN (id // 200) % 2 = 0 THEN 'RFP' ELSE 'ITB' END", posted_date="strftime(posted_date + INTERVAL 20 YEAR, '%Y-%m-%d')", due_date="date_trunc('day', due_date - INTERVAL 5 HOUR + INTERVAL 20 YEAR) + INTERVAL 5 HOUR", detail_url="'https://www.tn.gov/d/' || id", status_on_site="'Open'", links="CASE WHEN id % 2 = 0 THEN 'Plan=https://www.tn.gov/p' ELSE '' END"), o)
    def _(v):
        dates = F.concat_ws("<br>", F.date_format(later(F.col("posted_date")), "M/d/yyyy"), F.date_format(later(local()), "M/d/yyyy"))
        first = F.concat(text("<a href='/d/"), F.col("id").cast("string"), text("'>RFP&nbsp;"), ID, text("</a>"), F.when(F.col("id") % 2 == 0, " <a href='/p'>Plan</a>").otherwise(""))
        pages = _html_pages(_rows(v), _cells(first, dates, F.concat(text("<i>"), TITLE, text("</i>"))))
        return _whole(portals.tn(pages.withColumn("payload", F.replace("payload", text("<table>"), text("<table><tr><td>Number</td><td>Dates</td><td>Title</td></tr>")))))

    @query("portal_pa", stated(external_id="CASE WHEN id % 5 = 0 THEN 'S' || id ELSE external_id END", title="title", agency="agency", category="category", description="description", posted_date=day, due_date="due_date - INTERVAL 1 HOUR", detail_url="'https://www.emarketplace.state.pa.us/Solicitations.aspx?SID=S' || id", status_on_site="CASE WHEN id % 4 = 0 THEN 'Bid Opened' ELSE 'Open' END"), o)
    def _(v):
        none, n = text(""), F.col("id").cast("string")
        link = F.concat(text("<a id='ctl00_HyperLink1' href='Solicitations.aspx?SID=S"), n, text("'>go</a>"))
        line = _cells(F.when(F.col("id") % 5 == 0, "").otherwise(F.col(ID)), F.coalesce("category", none), F.col(TITLE), F.coalesce("description", none), F.col("agency"), none, none, us("posted_date"), F.coalesce(F.date_format(local(), "M/d/yyyy h:mm a"), none), none, F.when(F.col("id") % 4 == 0, "Bid Opened").otherwise(""), link)
        pages = _html_pages(_rows(v), line)
        return _whole(portals.pa(pages.withColumn("payload", F.replace("payload", text("<table>"), text("<table id='ctl00_MainBody_grdResults'><tr><th>Number</th></tr>")))))

    sd_board = "https://postingboard.esmsolutions.com/3444a404-3818-494f-84c5-2a850acd7779"

    @query("portal_sd", stated(external_id="CASE WHEN id % 3 = 0 THEN CAST(id AS VARCHAR) ELSE external_id || '-RFQ' END", title="title", agency="'State of South Dakota'", category="CASE WHEN id % 3 > 0 THEN 'RFQ' END", description="title", posted_date=day, due_date="due_date - CASE WHEN id % 2 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END", detail_url=f"'{sd_board}/eventDetail?eventId=' || id", status_on_site="'Published'"), o)
    def _(v):
        naive = "yyyy-MM-dd'T'HH:mm:ss"
        record = F.struct(F.col("id").alias("eventId"), F.when(F.col("id") % 3 > 0, F.concat(ID, text("-RFQ"))).alias("id"), F.col(TITLE).alias("eventName"), F.date_format("posted_date", naive).alias("publishedDate"), F.date_format(local(), naive).alias("eventDueDate"), F.when(F.col("id") % 2 == 0, "ET").otherwise("CT").alias("timezoneNameAbbreviation"), F.struct(text("Published").alias("description")).alias("status"))
        return _whole(portals.sd(_json_pages(_rows(v), "data", record)))

    @query("saved_pages", "SELECT CASE WHEN id % 3 = 0 THEN CAST(id AS VARCHAR) ELSE external_id || '-RFQ' END AS external_id, title, 'https://sd.example/' || id AS about FROM opportunities", o)
    def _(v):
        """Pages of two portals and an older crawl's, read by the data source: one portal, up to its first short page."""
        record = F.struct(F.col("id").alias("eventId"), F.when(F.col("id") % 3 > 0, F.concat(ID, text("-RFQ"))).alias("id"), F.col(TITLE).alias("eventName"), F.struct(F.concat(text("https://sd.example/"), F.col("id").cast("string")).alias("description")).alias("status"))
        # behind an empty page an earlier crawl has left some
        end = (_rows(v).agg(F.max("page")).first()[0] or 0) + 1
        kinds = (text("sd"), F.col("page"), F.col("payload")), (text("sd"), F.col("page") + end + 1, F.replace("payload", text('"eventName":"'), text('"eventName":"old '))), (text("wv"), F.col("page"), F.col("payload"))
        # the pages are made once and written in all three ways
        pages = _json_pages(_rows(v), "data", record).select(F.inline(F.array(*(F.struct(k.alias("key"), n.alias("page"), p.alias("payload")) for k, n, p in kinds))))
        folder = new_folder(v.spark, "pages")
        saved.save(pages.unionByName(v.spark.createDataFrame([("sd", end, '{"data":[]}')], pages.schema)), folder, per_file=PAGE)
        count = F.size(F.from_json(F.get_json_object("payload", "$.data"), "array<struct<eventId:string>>"))
        found = portals.sd(saved.whole(saved.load(v.spark, folder).where("key = 'sd'"), count, 1))
        return found.select("external_id", "title", F.col("status_on_site").alias("about"))

    wv_pages = "CASE (id // 200) % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{}' ELSE '{}' END"

    @query("portal_wv", stated(external_id="CASE WHEN id % 3 = 0 THEN external_id ELSE 'D_' || external_id END", title="title", agency="agency", category="CASE WHEN id % 2 = 0 THEN 'Equipment' ELSE " + wv_pages.format("Commodities & Services", "Construction", "Architecture & Engineering") + " END", description="'CRFQ ' || external_id || ' — ' || title", posted_date=day, due_date="CAST(posted_date AS TIMESTAMP) + INTERVAL 13 HOUR + INTERVAL 30 MINUTE + INTERVAL 4 HOUR", detail_url=wv_pages.format(*(f"https://www.state.wv.us/admin/purchase/{p}.html" for p in ("Commodities", "ConstructionBids", "ArchitectureandEngineering"))), status_on_site="'Open'"), o)
    def _(v):
        posted = F.date_format("posted_date", "yyyy-MM-dd")
        record = F.struct(F.when(F.col("id") % 3 == 0, " ").otherwise("D").alias("DOC_DEPT_CD"), F.col(ID).alias("DOC_ID"), text("CRFQ").alias("DOC_CD"), F.col(TITLE).alias("DOC_DSCR"), F.col("agency").alias("DEPT_NM"), F.when(F.col("id") % 2 == 0, "Equipment").alias("SO_DSCR"), posted.alias("PUB_DT"), posted.alias("CLSNG_DT"), text("01:30").alias("CLSNG_TM"))
        return _whole(portals.wv(_json_pages(_rows(v), "", record)))

    @query("portal_mt", "SELECT external_id, title, 'State of Montana' AS agency, category FROM opportunities", o)
    def _(v):
        line = _cells(F.concat(text("<a href='/e'>"), TITLE, text("</a>")), F.concat(text("<b>Number</b> "), ID), F.concat(text("<b>Type</b> "), F.col("category"), text("<b>Type</b> second")))
        return _shown(portals.mt(_html_pages(_rows(v), line)), "title", "agency", "category")

    @query("portal_wy", stated(external_id=tall, title="'Bid #' || id || ' - ' || title", agency="'State of Wyoming'", category="'Bid'", description="'Plows. Questions due by July 15, 2026.'", posted_date=day, due_date="date_trunc('minute', due_date) + INTERVAL 2 HOUR", q_and_a_deadline="TIMESTAMP '2026-07-15 06:00:00'", detail_url="'https://www.publicpurchase.com/gems/bid?bidId=' || id", status_on_site="'Open'"), o)
    def _(v):
        n = F.col("id").cast("string")
        quoted = F.replace(TITLE, text("'"), text("\\'"))
        line = F.concat(
            text("tooltip = '<div class=\\\"balloonstyle\\\">Plows. '; tooltip += 'Questions due by July 15, 2026.</div>'; $(\"tr_"), n, text("\").update('<td><a href=\\\"/gems/bid?bidId=' + "), n, text(" + '\\\">Bid #' + "), n, text(" + ' - "), quoted, text("<span id=\\\"d"),
            (F.col("id") % 3).cast("string"), text("\\\">decoy</span></a>' + tooltip + '</td><td>"), F.date_format("posted_date", "MMM d, yyyy"), text("</td><td>"), F.coalesce(F.concat(F.date_format(local(), "MMM d, yyyy h:mm:00 a"), text(" MST")), text("")), text("</td>');"),
        )
        pages = _html_pages(_rows(v), line).withColumn("payload", F.concat(text("<title>Public Purchase: State of Wyoming Home Page</title><script>"), "payload", text("action(\"d0\",\"d1\");action(\"d2\")</script>")))
        return _whole(portals.wy(pages))

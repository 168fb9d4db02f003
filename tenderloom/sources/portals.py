"""Portal dialects: saved payloads of solicitation portals to one record shape.

A payload is a row (page, payload): the page's number and its JSON or HTML
text.  Each dialect is a function from payload rows to normalized rows; the
work is native expressions over exploded records, so any number of saved pages
is one scan.  Fetching is not done here.  Records without an id are left
out; of equal ids the first by page and position stays (the last for ``ma``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..functions import texts
from . import markup as mk

#: Addresses of the portals' pages, and what they call their owners.
ADVANTAGE = {"ak": "https://iris-vss.alaska.gov/PRDVSS1X1/Advantage4", "ky": "https://vss.ky.gov/vssprod-ext/Advantage4"}
MO_ORIGIN = "https://ewqg.fa.us8.oraclecloud.com"
MO_LIST = f"{MO_ORIGIN}/fscmUI/redwood/negotiation-abstracts/view/abstractlisting?prcBuId=300000005255687"
PHX_PORTAL = "https://procurement.opengov.com/portal/phoenix"
SD_BOARD = "https://postingboard.esmsolutions.com/3444a404-3818-494f-84c5-2a850acd7779"
WV_PAGES = (
    ("Commodities & Services", "https://www.state.wv.us/admin/purchase/Commodities.html"), ("Construction", "https://www.state.wv.us/admin/purchase/ConstructionBids.html"),
    ("Architecture & Engineering", "https://www.state.wv.us/admin/purchase/ArchitectureandEngineering.html"),
)
PA_BASE, TN_BASE, WY_ORIGIN, LA_BASE = "https://www.emarketplace.state.pa.us/", "https://www.tn.gov", "https://www.publicpurchase.com", "https://wwwcfprd.doa.louisiana.gov/osp/lapac/"
OK_LIST = "https://financials.ok.gov/psc/SOKLFP1DS/SUPPLIER/ERP/c/SCP_PUBLIC_MENU_FL.SCP_PUB_BID_CMP_FL.GBL"
MS_HUB, MS_PURCHASING, MS_CONSTRUCTION, MS_LEASE = (
    f"https://www.dfa.ms.gov/{path}" for path in ("bids-and-rfps-notices", "current-bids-and-proposals", "construction-solicitations-bid-tabs", "real-property-management-solicitations")
)

FIELDS = {
    "external_id": "string", "title": "string", "agency": "string", "category": "string", "naics_code": "string", "description": "string", "posted_date": "date",
    "due_date": "timestamp", "q_and_a_deadline": "timestamp", "estimated_value": "double", "detail_url": "string", "status_on_site": "string",
    "attachments": "array<struct<filename:string,url:string>>",
}


def normalized(records: DataFrame, fields: dict[str, Column], *, last: bool = False, clean: bool = False) -> DataFrame:
    """records: with page and position.  Blank texts are null; a missing title is the id.  ``clean``: the texts are clean as they are."""
    rows = _normal(records, fields, "page", "position", clean=clean)
    order = [F.desc("page"), F.desc("position")] if last else [F.col("page"), F.col("position")]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("external_id").orderBy(*order))).where("_n = 1").select(*FIELDS)


def _normal(records: DataFrame, fields: dict[str, Column], *more: str, clean: bool = False) -> DataFrame:
    columns = []
    for name, kind in FIELDS.items():
        value = fields.get(name, F.lit(None))
        columns.append((F.nullif(value if clean else fn.clean(value), F.lit("")) if kind == "string" else value).cast(kind).alias(name))
    return records.select(*more, *columns).where("external_id is not null").withColumn("title", F.coalesce("title", "external_id"))


def _json(payloads: DataFrame, path: str, schema: str) -> DataFrame:
    """The records of a JSON array below ``path`` ("" for the payload itself)."""
    body = F.col("payload") if not path else F.get_json_object("payload", f"$.{path}")
    return payloads.select("page", F.posexplode(F.from_json(body, f"array<struct<{schema}>>")).alias("position", "r"))


def _text(names: str) -> str:
    return ",".join(f"{n}:string" for n in names.split())


def _blank(text: Column | str) -> Column:
    """Cleaned text; null if nothing is left."""
    return F.nullif(fn.clean(F.col(text) if isinstance(text, str) else text), F.lit(""))


def _joined(separator: str, *parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), separator)


def sam(payloads: DataFrame) -> DataFrame:
    r = _json(payloads, "opportunitiesData", _text("noticeId solicitationNumber title fullParentPathName postedDate responseDeadLine naicsCode type typeOfSetAsideDescription description uiLink") + ",resourceLinks:array<string>")
    agency = F.array_join(F.slice(F.split("r.fullParentPathName", r"\."), 1, 2), " · ")
    page = F.coalesce("r.uiLink", F.concat(F.lit("https://sam.gov/opp/"), "r.noticeId", F.lit("/view")))
    files = F.transform(F.slice(F.coalesce("r.resourceLinks", F.array().cast("array<string>")), 1, 10), lambda u, i: F.struct(F.concat(F.lit("attachment-"), (i + 1).cast("string")).alias("filename"), u.alias("url")))
    return normalized(r, {"external_id": F.coalesce(_blank("r.solicitationNumber"), "r.noticeId"), "title": F.col("r.title"), "agency": agency, "category": _joined(" · ", _blank("r.type"), _blank("r.typeOfSetAsideDescription")), "naics_code": F.col("r.naicsCode"), "description": fn.trim_description(F.col("r.description")), "posted_date": F.try_to_timestamp("r.postedDate"), "due_date": F.try_to_timestamp("r.responseDeadLine"), "detail_url": page, "status_on_site": F.lit("Open"), "attachments": files})


def advantage(payloads: DataFrame, key: str = "ak") -> DataFrame:
    """The grid of ``ak`` and ``ky``: coded values by the page's own labels, epoch dates, the id in the last of two brackets or more."""
    grid = "T1SO_SRCH_QRY"
    labels = [F.from_json(F.get_json_object("payload", f"$.page_metadata.datasources.{grid}.columns.{c}.codedValuesList"), "array<map<string,string>>").alias(c) for c in ("SO_CAT_CD", "SO_STA")]
    body = F.from_json(F.get_json_object("payload", f"$.data.ds_data.{grid}.row_data"), f"array<struct<{_text('SO_CAT_CD SO_STA DOC_CD DOC_DSCR DEPT_NM BUYR_NM BUYR_EMAIL_AD DOC_REF DOC_CD_CONCAT SO_CLSNG_DT_TM PUB_DT')}>>")
    # labels are read once a page: beside the explode in one select they would be read from the whole payload for each record
    r = payloads.select("page", *labels, body.alias("rows")).select("page", "SO_CAT_CD", "SO_STA", F.posexplode("rows").alias("position", "r"))

    def label(field: str) -> Column:
        code = F.nullif(F.col(f"r.{field}"), F.lit(""))
        own = F.try_element_at(F.filter(field, lambda m: F.map_contains_key(m, code)), F.lit(-1))
        return F.when(code.isNotNull(), F.coalesce(F.try_element_at(own, code), code))

    brackets = F.regexp_extract_all("r.DOC_REF", F.lit(r"\[([^\]]*)\]"), F.lit(1))
    number = F.when(F.size(brackets) >= 2, _blank(F.element_at(brackets, -1))).otherwise(_blank("r.DOC_REF"))
    about = _joined(" — ", _blank("r.DOC_CD_CONCAT"), F.concat(F.lit("Buyer: "), _blank("r.BUYR_NM")), _blank("r.BUYR_EMAIL_AD"))
    return normalized(r.where(_blank("r.DOC_DSCR").isNotNull()), {"external_id": number, "title": F.col("r.DOC_DSCR"), "agency": F.col("r.DEPT_NM"), "category": label("SO_CAT_CD"), "description": fn.trim_description(about), "posted_date": fn.epoch_millis(F.col("r.PUB_DT")), "due_date": fn.epoch_millis(F.col("r.SO_CLSNG_DT_TM")), "detail_url": F.lit(ADVANTAGE[key]), "status_on_site": label("SO_STA")})


def mo(payloads: DataFrame) -> DataFrame:
    r = _json(payloads, "items", "AuctionHeaderId:bigint," + _text("Negotiation NegotiationTitle NegotiationType ProcurementBUName Synopsis AmendmentDescription NegotiationStatus CloseDate PostingDate PublishDate") + ",attachments:struct<items:array<struct<FileName:string,Title:string,FileUrl:string>>>")
    description = _joined(" — ", _blank("r.Synopsis"), F.concat(F.lit("Amendment: "), _blank("r.AmendmentDescription")))
    files = F.transform("r.attachments.items", lambda a: F.struct(F.coalesce(_blank(a["FileName"]), _blank(a["Title"])).alias("filename"), fn.absolute(F.lit(MO_ORIGIN), a["FileUrl"]).alias("url")))
    files = F.filter(files, lambda a: a["filename"].isNotNull() & a["url"].isNotNull())
    return normalized(r, {"external_id": F.coalesce(_blank("r.Negotiation"), F.col("r.AuctionHeaderId").cast("string")), "title": F.col("r.NegotiationTitle"), "agency": F.col("r.ProcurementBUName"), "category": F.col("r.NegotiationType"), "description": fn.trim_description(description), "posted_date": F.coalesce(F.try_to_timestamp("r.PostingDate"), F.try_to_timestamp("r.PublishDate")), "due_date": F.try_to_timestamp("r.CloseDate"), "detail_url": F.lit(MO_LIST), "status_on_site": F.col("r.NegotiationStatus"), "attachments": F.when(F.size(files) > 0, files)})


#: The attributes that hold a record's fields.
NC_ATTRIBUTES = {
    "external_id": "evp_solicitationnbr", "title": "evp_name", "agency": "owningbusinessunit", "description": "evp_description",
    "posted_date": "evp_posteddate", "due_date": "evp_opendate", "status_on_site": "statuscode",
}


def nc_layout(value: Column) -> Column:
    """(configuration, sort) of a grid's first layout: a JSON array, as base64 or plain; null configuration if it is neither.

    Layouts differ in their other fields, so they are kept as VARIANT and asked for these two by path.
    """
    readings = [F.try_parse_json(F.try_to_binary(value, F.lit("base64")).cast("string")), F.try_parse_json(value)]
    layouts = F.coalesce(*(F.when(F.schema_of_variant(r).startswith("ARRAY"), r) for r in readings))
    first = lambda name: F.nullif(F.try_variant_get(layouts, f"$[0].{name}", "string"), F.lit(""))
    return F.struct(first("Base64SecureConfiguration").alias("configuration"), F.coalesce(first("SortExpression"), F.lit("evp_posteddate DESC")).alias("sort"))


def nc(payloads: DataFrame, names: dict[str, str] | None = None, untitled: str | None = None) -> DataFrame:
    """Records as lists of named attributes, whose values are texts, numbers or objects; ``names`` says where a field is called otherwise.

    A missing title is ``untitled`` (the portal's own rule has "(untitled)"), or the id without one.
    An attribute shows its display value, else its formatted value, else a
    value that is a text.  A date is a text of milliseconds, a number of them,
    or its display value.
    """
    names = NC_ATTRIBUTES | (names or {})
    r = _json(payloads, "Records", "Id:string,Attributes:array<struct<Name:string,Value:variant,DisplayValue:string,FormattedValue:string>>")
    # each attribute is looked for once, and read once: what a field takes of it would look again
    named = lambda name: F.get("r.Attributes", F.array_position("r.Attributes.Name", F.lit(name)).cast("int") - 1)
    r = once(r.select("page", "position", "r"), **{f"a_{field}": named(name) for field, name in names.items()})
    r = r.select("page", "position", F.col("r.Id").alias("Id"), *(f"a_{field}" for field in names))
    kind = lambda a: F.schema_of_variant(a["Value"])
    told = lambda a: F.when(kind(a) == "STRING", F.try_variant_get(a["Value"], "$", "string"))
    number = lambda a: F.when(F.rlike(kind(a), F.lit("^(BIGINT|DOUBLE|DECIMAL)")), F.try_variant_get(a["Value"], "$", "double").cast("bigint"))
    date = lambda a: F.coalesce(fn.ms_date(told(a)), F.timestamp_millis(number(a)), fn.us_date(a["DisplayValue"], fn.EASTERN))
    found = {field: F.col(f"a_{field}") for field in names}
    dates = {field: date(found.pop(field)) for field in ("posted_date", "due_date")}
    shown = {field: F.coalesce(a["DisplayValue"], a["FormattedValue"], told(a)) for field, a in found.items()}
    r = once(r, **shown, **dates).select("page", "position", "Id", *shown, *dates)
    return normalized(r, {
        "external_id": F.coalesce(_blank("external_id"), "Id"), "title": F.coalesce(_blank("title"), F.lit(untitled)), "agency": F.col("agency"), "description": fn.trim_description(F.col("description")),
        "posted_date": F.col("posted_date"), "due_date": F.col("due_date"), "detail_url": F.concat(F.lit("https://evp.nc.gov/solicitations/details/?id="), "Id"), "status_on_site": F.col("status_on_site"),
    })


def phx(payloads: DataFrame) -> DataFrame:
    """Open and announced projects; descriptions, codes and files are on their detail pages."""
    r = _json(payloads, "projects", _text("id title status financialId departmentName postedAt postScheduledAt proposalDeadline qaDeadline") + ",comingSoon:boolean,isPrivate:boolean,template:struct<title:string,processAcronym:string>")
    soon = F.coalesce("r.comingSoon", F.lit(False))
    r = r.where(~F.coalesce("r.isPrivate", F.lit(False)) & (F.coalesce(_blank("r.status") == "open", F.lit(False)) | soon) & _blank("r.title").isNotNull())
    kind = F.coalesce("r.template.processAcronym", "r.template.title")
    return normalized(r, {"external_id": F.coalesce(_blank("r.financialId"), "r.id"), "title": F.col("r.title"), "agency": F.coalesce(_blank("r.departmentName"), F.lit("City of Phoenix")), "category": kind, "posted_date": F.try_to_timestamp(F.coalesce("r.postedAt", "r.postScheduledAt")), "due_date": F.try_to_timestamp("r.proposalDeadline"), "q_and_a_deadline": F.try_to_timestamp("r.qaDeadline"), "detail_url": F.concat(F.lit(f"{PHX_PORTAL}/projects/"), "r.id"), "status_on_site": F.when(soon, "Coming Soon").otherwise(F.col("r.status"))})


def sd(payloads: DataFrame) -> DataFrame:
    r = _json(payloads, "data", _text("eventId id eventName publishedDate eventDueDate timezoneName timezoneNameAbbreviation") + ",status:struct<description:string>")
    number = F.coalesce(_blank("r.id"), _blank("r.eventId"))
    zone = F.when(F.upper(F.coalesce("r.timezoneNameAbbreviation", "r.timezoneName")) == "ET", "ET").otherwise("CT")
    page = F.coalesce(F.concat(F.lit(f"{SD_BOARD}/eventDetail?eventId="), "r.eventId"), F.lit(f"{SD_BOARD}/events"))
    return normalized(r.where(_blank("r.eventName").isNotNull()), {"external_id": number, "title": F.col("r.eventName"), "agency": F.lit("State of South Dakota"), "category": fn.category_of_id(number), "description": fn.trim_description(F.col("r.eventName")), "posted_date": fn.local_time(F.col("r.publishedDate"), zone), "due_date": fn.local_time(F.col("r.eventDueDate"), zone), "detail_url": page, "status_on_site": F.col("r.status.description")})


def tx(payloads: DataFrame) -> DataFrame:
    r = _json(payloads, "lines", _text("solicitationId title responseDue responseTime agencyName statusName postingDate nigpCodes"))
    labels = F.array_join(F.transform(F.split("r.nigpCodes", ";"), lambda c: F.trim(F.regexp_replace(c, r"^\s*\d{5}\s*-", ""))), "; ")
    due = F.concat_ws(" ", F.nullif(F.trim("r.responseDue"), F.lit("")), F.nullif(F.trim("r.responseTime"), F.lit("")))
    return normalized(r, {"external_id": F.col("r.solicitationId"), "title": F.col("r.title"), "agency": F.col("r.agencyName"), "category": labels, "posted_date": fn.us_date(F.col("r.postingDate")), "due_date": fn.us_date(due), "status_on_site": F.col("r.statusName")})


def wv(payloads: DataFrame) -> DataFrame:
    """Pages come in threes, one for each category."""
    r = _json(payloads, "", _text("DOC_DSCR DOC_DEPT_CD DEPT_NM DOC_CD DOC_ID SO_DSCR PUB_DT CLSNG_DT CLSNG_TM"))
    number, title = _blank("r.DOC_ID"), _blank("r.DOC_DSCR")
    of_page = lambda part: F.get(F.array(*(F.lit(p[part]) for p in WV_PAGES)), F.col("page") % len(WV_PAGES))
    about = _joined(" — ", F.concat_ws(" ", _blank("r.DOC_CD"), number), title)
    return normalized(r.where(number.isNotNull()), {"external_id": F.concat_ws("_", _blank("r.DOC_DEPT_CD"), number), "title": F.coalesce(title, number), "agency": F.col("r.DEPT_NM"), "category": F.coalesce(_blank("r.SO_DSCR"), of_page(0)), "description": fn.trim_description(about), "posted_date": F.try_to_timestamp(F.trim("r.PUB_DT")), "due_date": fn.half_day_time(F.col("r.CLSNG_DT"), F.col("r.CLSNG_TM")), "detail_url": of_page(1), "status_on_site": F.lit("Open")})


# --- HTML tables


def text_of(html: Column) -> Column:
    # without tags and entities only white space is to be made single, which is what cleaning does
    return F.when(F.rlike(html, F.lit("[<&]")), fn.clean(fn.html_to_text(html))).otherwise(fn.clean(html))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with more columns that are evaluated once a row: filters on them stay above, where those on a projection's columns would evaluate them again below."""
    return rows.select(*rows.columns, F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def table_rows(payloads: DataFrame, payload: Column | None = None) -> DataFrame:
    """(page, position, row, cells, links) of every table row that has cells; cells are HTML."""
    body = F.col("payload") if payload is None else payload
    rows = payloads.select("page", F.posexplode(F.regexp_extract_all(body, F.lit(r"(?is)<tr\b([^>]*>.*?)</tr>"), F.lit(1))).alias("position", "row"))
    rows = once(rows, cells=F.regexp_extract_all("row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)))
    return rows.where(F.size("cells") > 0).withColumn("links", _anchors(F.col("row")))


def _anchors(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    return F.transform(found, lambda a: F.struct(text_of(a).alias("filename"), F.regexp_extract(a, r"(?i)href\s*=\s*[\"']([^\"']*)", 1).alias("url")))


@dataclass(frozen=True)
class Layout:
    """Where a table has its fields: numbers of cells, from 0; negative from the end."""

    external_id: int
    title: int
    agency: int | None = None
    posted: int | None = None
    due: int | None = None
    status: int | None = None
    least: int = 1
    offset: int = fn.CENTRAL
    last: bool = False


#: Cell numbers of the portals' result tables.
LAYOUTS = {
    "ma": Layout(0, 6, agency=2, due=7, status=10, least=8, offset=fn.EASTERN, last=True),
    "ar": Layout(-1, -4, agency=-3, due=-2, least=4),
}


def table(payloads: DataFrame, layout: Layout, agency: Column | None = None) -> DataFrame:
    """A portal of one row a record; a date cell with two dates has the posted and the due one."""
    # the cells that fields are taken from become text once
    taken = [i for i in dict.fromkeys((layout.external_id, layout.title, layout.agency, layout.posted, layout.due, layout.status)) if i is not None]
    cells = F.array(*(F.try_element_at("cells", F.lit(i + 1 if i >= 0 else i)) for i in taken))
    rows = once(table_rows(payloads).where(F.size("cells") >= layout.least), texts=F.transform(cells, text_of))
    cell = lambda i: F.get("texts", F.lit(taken.index(i)))
    dates = lambda i: fn.find_dates(cell(i))
    due = None if layout.due is None else F.get(dates(layout.due), F.lit(1 if layout.due == layout.posted else 0))
    fields = {"external_id": cell(layout.external_id), "title": cell(layout.title), "attachments": F.filter("links", lambda a: F.coalesce(F.rlike(a["url"], F.lit(fn.DISCOVERABLE)), F.lit(False)))}
    if due is not None:
        fields["due_date"] = F.when(~F.startswith(due, F.lit("12/30/9999")), fn.us_date(due, layout.offset))
    if layout.posted is not None:
        fields["posted_date"] = fn.us_date(F.get(dates(layout.posted), F.lit(0)), layout.offset)
    if layout.agency is not None or agency is not None:
        fields["agency"] = agency if agency is not None else cell(layout.agency)
    whole = F.array_join("cells", " ")
    open_ = F.when(F.rlike(whole, F.lit("(?i)bid cancelled")), "Cancelled").when(F.rlike(whole, F.lit("(?i)alt=\"[^\"]*updated")), "Amended").otherwise("Open")
    fields["status_on_site"] = F.coalesce(F.nullif(cell(layout.status), F.lit("")), open_) if layout.status is not None else open_
    return normalized(rows, fields, last=layout.last)


# --- pages read as trees


def _records(pages: DataFrame, records: Column, *more: str) -> DataFrame:
    return pages.select("page", *more, F.posexplode(records).alias("position", "r"))


def _first_with(elements: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(elements, test), F.lit(0))


def la(payloads: DataFrame) -> DataFrame:
    """A page a department, whose name and address are the columns ``department`` and ``url``, if there are any.

    Rows without a number in their first cell go on the record above: the links
    of their last cell but one are added to its own.
    """
    for name in ("department", "url"):
        payloads = payloads if name in payloads.columns else payloads.withColumn(name, F.lit(None).cast("string"))
    rows = mk.parts(payloads, ("tr",), lambda e: "bid" if e["tag"] == "table" and "bid" in (e["classes"] or "").split() else None).where(mk.inside("bid"))
    cell = lambda i: F.get("cells", F.lit(i))
    rows = rows.withColumn("cells", mk.children(mk.node(F.lit(0)), "td")).where(F.size("cells") > 0)
    rows = rows.withColumn("number", _first_with(mk.below(cell(0)), lambda e: e["tag"] == "span"))
    rows = rows.withColumn("about", F.when(F.col("number").isNotNull(), cell(1)).otherwise(F.get("cells", F.greatest(F.size("cells") - 2, F.lit(0)))))
    about = F.col("about")
    # the title ends where the first strong or linked part of the cell begins
    rows = rows.withColumn("stop", _first_with(mk.children(about, "strong", "a"), lambda e: F.lit(True)))
    head = fn.clean(F.substr(F.col("words"), about["begin"] + 1, F.coalesce(F.col("stop")["begin"], about["end"]) - about["begin"]))
    made = F.struct(
        F.col("number").isNotNull().alias("own"), F.nullif(mk.text(F.col("number")), F.lit("")).alias("id"), F.size("cells").alias("cells"), head.alias("title"), mk.text(about).alias("about"),
        mk.text(cell(2)).alias("issued"), mk.text(cell(3)).alias("opens"), mk.links(about, LA_BASE).alias("links"),
    )
    r = rows.select("page", "department", "url", "position", made.alias("r"))
    before = Window.partitionBy("page").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("head", F.last(F.when(F.col("r.own") & (F.col("r.cells") >= 4) & F.col("r.id").isNotNull(), F.col("position")), ignorenulls=True).over(before)).where("head is not null")
    # a record and the rows that go on it meet in one aggregation, so pages are read once
    own = F.when(F.col("position") == F.col("head"), F.struct("department", "url", "r"))
    more = F.collect_list(F.when(~F.col("r.own"), F.struct("position", "r.links")))
    heads = r.groupBy("page", F.col("head").alias("_head")).agg(F.first(own, ignorenulls=True).alias("_own"), F.array_sort(more).alias("more"))
    heads = heads.select("page", F.col("_head").alias("position"), "_own.*", F.flatten("more.links").alias("more"))
    links = mk.once(F.concat("r.links", "more"))
    original = F.coalesce(_first_with(F.col("r.links"), lambda a: a["filename"] == F.col("r.id")), F.get("r.links", F.lit(0)))["url"]
    return normalized(heads, {
        "external_id": F.col("r.id"), "title": F.col("r.title"), "agency": F.col("department"), "description": fn.trim_description(F.col("r.about")), "posted_date": fn.us_date(F.col("r.issued")),
        "due_date": F.when(~F.contains("r.opens", F.lit("12/30/9999")), fn.us_date(F.col("r.opens"))), "detail_url": F.coalesce(original, "url"),
        "status_on_site": F.when(F.rlike("r.about", F.lit("(?i)Bid Cancelled")), "Cancelled").otherwise("Open"), "attachments": links,
    })


def la_departments(payloads: DataFrame) -> DataFrame:
    """(page, position, term, department, url) of the index page's links to departments, the first of each term."""
    pages = mk.parsed(payloads)
    found = F.filter(mk.tagged(F.col("nodes"), "a"), lambda a: F.contains(a["href"], F.lit("dspBid.cfm")) & F.contains(a["href"], F.lit("search=department")))
    rows = F.transform(found, lambda a: F.struct(F.nullif(F.url_decode(F.regexp_extract(a["href"], r"[?&]term=([^&#]*)", 1)), F.lit("")).alias("term"), fn.strip_count(mk.text(a)).alias("department"), fn.absolute(F.lit(LA_BASE), a["href"]).alias("url")))
    r = _records(pages, rows).where("r.term is not null")
    return r.withColumn("n", F.row_number().over(Window.partitionBy("r.term").orderBy("page", "position"))).where("n = 1").select("page", "position", "r.*")


def tn(payloads: DataFrame) -> DataFrame:
    """The first table of each page; pages are in turn of requests for proposals and invitations to bid."""
    rows = mk.parts(payloads, ("tr",), lambda e: "table" if e["tag"] == "table" else None)
    rows = rows.where(F.exists("around", lambda x: (x["mark"] == "table") & (x["nth"] == 0) & (x["place"] > 0)))
    rows = rows.withColumn("cells", mk.tagged(mk.below(mk.node(F.lit(0))), "td")).where(F.size("cells") >= 3)
    named = F.filter(mk.tagged(mk.below(F.get("cells", F.lit(0))), "a"), lambda a: (F.coalesce(a["href"], F.lit("")) != "") & (mk.text(a) != ""))
    files = F.transform(named, lambda a: F.struct(mk.text(a).alias("filename"), F.coalesce(fn.absolute(F.lit(TN_BASE), a["href"]), a["href"]).alias("url")))
    made = F.struct(files.alias("links"), mk.text(F.get("cells", F.lit(1))).alias("dates"), mk.text(F.get("cells", F.lit(2))).alias("title"))
    r = rows.select("page", "position", made.alias("r")).where(F.size("r.links") > 0)
    first = F.get("r.links", F.lit(0))
    number = F.nullif(F.trim(F.regexp_replace(first["filename"], r"(?i)^(RFP|ITB|RFI|Event)[\s\u00a0]*", "")), F.lit(""))
    number = F.coalesce(number, F.nullif(F.regexp_extract(first["url"], r"(?i)(rfp|itb|rfi)-updates/([^/]+)/", 2), F.lit("")))
    date = lambda i: fn.us_date(F.get(F.regexp_extract_all("r.dates", F.lit(r"[0-1]?\d/[0-3]?\d/20\d{2}"), F.lit(0)), F.lit(i)))
    return normalized(r, {"external_id": number, "title": F.coalesce(_blank("r.title"), first["filename"]), "category": F.when(F.col("page") % 2 == 0, "RFP").otherwise("ITB"), "posted_date": date(0), "due_date": date(1), "detail_url": first["url"], "status_on_site": F.lit("Open"), "attachments": F.slice("r.links", 2, F.size("r.links"))})


def _pa_rows(page: str, *_: object) -> Iterator[tuple]:
    """(position, clean cells, the link's text and address, posted, due) of the rows of the first grid that have eleven cells and the link."""
    for position, marks, row in mk.table_rows(page, lambda e: "grid" if e["id"] == "ctl00_MainBody_grdResults" else None):
        if ("grid", 0) in marks:
            link = next(((a.get("href"), text) for a, text in row.links() if (a.get("id") or "").endswith("_HyperLink1")), None)
            cells = row.cells() if link is not None else ()
            if len(cells) >= 11:
                cells = [texts.clean(c) for c in cells[:11]]
                yield position, cells, texts.clean(link[1]), link[0] or "", texts.us_date(cells[7], fn.EASTERN), texts.us_date(cells[8], fn.EASTERN)


def pa(payloads: DataFrame) -> DataFrame:
    """Rows of the result grid that link to a solicitation; the reader gives clean texts, so they are not cleaned again."""
    r = mk.records(payloads, _pa_rows, {"position": "int", "cells": "array<string>", "named": "string", "href": "string", "posted": "bigint", "due": "bigint"})
    cell = lambda i: F.nullif(F.get("cells", F.lit(i)), F.lit(""))
    r = once(r, sid=F.nullif(F.url_decode(F.regexp_extract("href", "(?i)SID=([^&]+)", 1)), F.lit("")))
    r = once(r, number=F.coalesce(cell(0), F.nullif(fn.clean(F.col("sid")), F.lit(""))))
    # a file of the base's own folder, for which nothing is to be resolved
    own = F.concat(F.lit(f"{PA_BASE}Solicitations.aspx?SID="), F.replace(F.url_encode("sid"), F.lit("+"), F.lit("%20")))
    return normalized(r, {"external_id": F.col("number"), "title": F.coalesce(cell(2), "named"), "agency": cell(4), "category": cell(1), "description": F.trim(F.substring(cell(3), 1, 4000)), "posted_date": F.timestamp_micros("posted"), "due_date": F.timestamp_micros("due"), "detail_url": F.when(F.col("sid").isNotNull(), own).otherwise(fn.clean(fn.absolute(F.lit(PA_BASE), F.col("href")))), "status_on_site": F.coalesce(cell(10), F.lit("Open"))}, clean=True)


_WY_OWNER = re.compile(r":\s*(.+?)\s+Home Page", re.A | re.I)
_WY_ID = re.compile(r"bidId=(\d+)", re.A)
_WY_KIND = re.compile(r"(.*?)#\s*(.+?)\s+-\s+", re.A)
_WY_ASKED = re.compile(r"\bquestions?\b.*", re.A | re.I | re.S)
_WY_DAY = re.compile(r"(.*?)([A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4})", re.A | re.S)
_WY_TIME = re.compile(r"\d{1,2}:\d{2}\s*[ap]\.?\s*m", re.A | re.I)


_WY_STANDARD = re.compile(r"\bMST\b", re.A)
_WY_BLOCK = re.compile(r"(?:.*\s)?balloonstyle(?:\s.*)?", re.A | re.S)


def _wy_rest(row: mk.TreeRow) -> str:
    """The text of the first cell without the block that describes the bid."""
    first = next((e for e in row.below if e["tag"] == "td" and e["parent"] == row.top["at"]), None)
    block = next((e for e in row.tagged("div") if _WY_BLOCK.fullmatch(e["classes"] or "")), None)
    if first is None:
        return ""
    stop, behind = (first["end"], first["end"]) if block is None else (block["begin"], block["end"])
    return row.words[first["begin"] : max(stop, first["begin"])] + row.words[behind : max(first["end"], behind)]


def _wy_deadline(about: str) -> int | None:
    """The first day named behind the word question, at the first time that stands between."""
    asked = _WY_ASKED.search(about)
    day = asked and _WY_DAY.match(asked[0][:400])
    if not day:
        return None
    time = _WY_TIME.search(day[1])
    return texts.month_name_date(f"{day[2]} {time[0] if time else ''}", fn.MOUNTAIN_DAYLIGHT)


def _wy_rows(page: str, *_: object) -> Iterator[tuple]:
    """(position, number, address, the same from its root, title, owner, kind, about, posted, due, questions until, and the texts of these three if they are not ASCII)."""
    head, rows = mk.script_rows(page)
    owner = _WY_OWNER.search(texts.clean(head or ""))
    owner = texts.clean(owner[1] if owner else "") or "State of Wyoming"
    for position, row in enumerate(rows):
        href, named = next(((a["href"], text) for a, text in row.links() if "bidId=" in (a.get("href") or "")), (None, ""))
        number = href and _WY_ID.search(href)
        title = number and (texts.clean(named) or texts.clean(_wy_rest(row.tree())))
        if not title:
            continue
        about = texts.clean(next((text for a, text in row.blocks() if _WY_BLOCK.fullmatch(a.get("class") or "")), ""))
        posted, due = (*map(texts.clean, row.cells(own=True)[1:3]), "", "")[:2]
        kind = _WY_KIND.match(title)
        zone = fn.MOUNTAIN_STANDARD if _WY_STANDARD.search(due) else fn.MOUNTAIN_DAYLIGHT
        days = (texts.month_name_date(posted, fn.MOUNTAIN_DAYLIGHT) if posted.isascii() else None, texts.month_name_date(due, zone) if due.isascii() else None, _wy_deadline(about) if about.isascii() else None)
        url = texts.rooted(WY_ORIGIN, href)
        yield position, number[1], href, url and texts.clean(url), title, owner, texts.clean(kind[1]) if kind else None, about, *days, *(None if t.isascii() else t for t in (posted, due, about))


def wy(payloads: DataFrame) -> DataFrame:
    """Rows that a script writes; the description is a block in the title's cell, which the title goes without.

    The reader gives clean texts and the dates of texts in ASCII; other dates are read here.
    """
    kinds = "position:int number:string href:string url:string title:string owner:string kind:string about:string posted:bigint due:bigint asked:bigint posted_text:string due_text:string about_text:string"
    r = mk.records(payloads, _wy_rows, dict(k.split(":") for k in kinds.split()))
    zone = lambda text: F.when(F.rlike(text, F.lit(r"\bMST\b")), fn.MOUNTAIN_STANDARD).otherwise(fn.MOUNTAIN_DAYLIGHT)
    named = lambda text: fn.month_name_date(F.col(text), zone(F.col(text)) if text == "due_text" else fn.MOUNTAIN_DAYLIGHT)
    asked = F.substring(F.regexp_extract("about_text", r"(?is)(\bquestions?\b.*)", 1), 1, 400)
    day = F.regexp_extract(asked, r"(?s)^(.*?)([A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4})", 2)
    ahead = F.regexp_extract(asked, r"(?s)^(.*?)([A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4})", 1)
    time = F.regexp_extract(ahead, r"(?i)\d{1,2}:\d{2}\s*[ap]\.?\s*m", 0)
    deadline = F.when(day != "", fn.month_name_date(F.concat_ws(" ", day, time), fn.MOUNTAIN_DAYLIGHT))
    told = lambda name, other: F.when(F.col(f"{name}_text").isNull(), F.timestamp_micros(name if name != "about" else "asked")).otherwise(other)
    return normalized(r, {
        "external_id": F.col("number"), "title": F.col("title"), "agency": F.col("owner"), "category": F.col("kind"), "description": F.trim(F.substring("about", 1, 4000)),
        "posted_date": told("posted", named("posted_text")), "due_date": told("due", named("due_text")), "q_and_a_deadline": told("about", deadline),
        "detail_url": F.coalesce("url", fn.clean(fn.absolute(F.lit(WY_ORIGIN), F.col("href")))), "status_on_site": F.lit("Open"),
    }, clean=True)


MS_RFX = re.compile(r"RFx\s*#?\s*(\d{6,})\s*[-–—]+\s*(.+)", re.A | re.I)
_MS_NUMBER = re.compile(r"\bRF[PQXI]\s*#?\s*(\d{6,})", re.A | re.I)
MS_PAGES = (MS_HUB, MS_PURCHASING, MS_CONSTRUCTION, MS_LEASE)
MS_ORIGIN = MS_HUB.rpartition("/")[0]
MS_MARKS = {("dl", "ckeditor-accordion"): "folding", ("table", "tblwdt"): "leases"}


def _ms_mark(e: dict) -> str | None:
    return next((MS_MARKS[e["tag"], c] for c in (e["classes"] or "").split() if (e["tag"], c) in MS_MARKS), None)


def _ms_hub(page: str) -> Iterator[dict]:
    """Paragraphs "RFx# number - title", each with a list of files behind it, but for the panel of completed ones."""
    for position, around, p in mk.elements(page, "p", _ms_mark):
        panels = (texts.clean(x["label"]) for above, x in zip(around, around[1:], strict=False) if x["tag"] == "dd" and x["before"] == "dt" and above["mark"] == "folding")
        panel = next((label for label in panels if not re.search("completed", label, re.A | re.I)), None)
        found = panel is not None and MS_RFX.search(texts.clean(p.text()))
        if found:
            below = p.following("ul", "ol")
            yield {"position": position, "number": found[1], "title": found[2].strip(" "), "category": panel, "about": found[2], "links": below.links() if below else ()}


def _ms_panels(page: str) -> Iterator[tuple[int, int, str, mk.TreeRow]]:
    """(position, number of the list, heading, body) of the headings of folding lists that have a body behind them."""
    for position, around, dt in mk.elements(page, "dt", _ms_mark):
        body = dt.following("dd")
        if around and around[-1]["mark"] == "folding" and body is not None:
            yield position, around[-1]["nth"], texts.clean(dt.text()), body


def _ms_purchasing(page: str) -> Iterator[dict]:
    """The heading is the title; number and deadline are in the prose of the body."""
    for position, _, heading, body in _ms_panels(page):
        about = texts.clean(body.text())
        number = _MS_NUMBER.search(about) if about.isascii() else None
        yield {
            "position": position, "number": number and number[1], "slug": texts.slug_id(heading) if heading.isascii() else None, "title": heading, "about": about,
            "due": texts.prose_date(about, fn.CENTRAL) if about.isascii() else None, "prose": None if about.isascii() else about, "links": body.links(),
        }


def _ms_construction(page: str) -> Iterator[dict]:
    """Of the first list only: items "label: value" are the fields, the last of a label counts."""
    for position, nth, heading, body in _ms_panels(page):
        if nth:
            continue
        fields = {}
        for li in body.tagged("li"):
            span = next((e for e in body.inside(li).below if e["tag"] == "span"), None)
            label = (texts.clean(body.text(span)) if span else "").removesuffix(":")
            fields[label.lower()] = texts.clean(texts.clean(body.text(li))[len(label) + 1 :].lstrip(": \t\n\v\f\r"))
        title = fields.get("project title") or heading
        agency, professional, due = (fields.get(k) for k in ("using agency", "professional", "date"))
        yield {
            "position": position, "number": fields.get("rfx#") or fields.get("rfx") or None, "other": fields.get("gs no") or re.sub(r"^GS\s*", "", heading, flags=re.A | re.I) or None, "title": title, "agency": agency or None,
            "about": " — ".join(filter(None, (title, agency, professional and f"Professional: {professional}"))), "due": texts.us_date(due or "", fn.CENTRAL), "links": body.links(),
        }


def _ms_leases(page: str) -> Iterator[dict]:
    """Of the first table only, but for its head: agency, place, deadline."""
    first = ("leases", 0)
    for position, marks, row in mk.table_rows(page, lambda e: "thead" if e["tag"] == "thead" else _ms_mark(e)):
        cells = row.cells() if first in marks and all(m != "thead" for m, _ in marks[marks.index(first) :]) else ()
        agency = texts.clean(cells[0]) if len(cells) >= 3 else ""
        if agency:
            place, due = re.sub(r"\s*/\s*", ", ", texts.clean(cells[1]), flags=re.A), texts.clean(cells[2])
            title = f"Request for Lease Proposals — {agency}" + (f" ({place})" if place else "")
            whole = f"{agency}-{place}-{due}"
            yield {"position": position, "title": title, "agency": agency, "about": title, "other": whole, "slug": texts.slug_id(whole) if whole.isascii() else None, "due": texts.us_date(due, fn.CENTRAL), "links": row.links_of(1)}


MS_KINDS = {"position": "int", "shape": "int", "number": "string", "other": "string", "slug": "string", "prose": "string", "title": "string", "agency": "string", "category": "string", "about": "string", "due": "bigint", "files": mk.FILES, "links": mk.LINKS}


def _ms_rows(payload: str, page: int | None, *_: object) -> Iterator[tuple]:
    shape = 3 if page is None or page < 0 and page % 4 else page % 4
    for made in (_ms_hub, _ms_purchasing, _ms_construction, _ms_leases)[shape](payload):
        files, links = mk.files(made.pop("links"), MS_ORIGIN)
        made |= {"shape": shape, "files": files, "links": links}
        yield tuple(made.get(k) for k in MS_KINDS)


def _ms_records(payloads: DataFrame) -> DataFrame:
    """Records with clean texts; ``prose`` is one that is not ASCII, of which number and deadline are read here."""
    r = mk.records(payloads.select("page", "payload"), _ms_rows, MS_KINDS)
    of = lambda *values: F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), F.col("shape") + 1)
    shape = lambda n: F.col("shape") == n
    r = once(r, attachments=F.when(F.col("files").isNotNull(), F.col("files")).otherwise(mk.named(F.col("links"), of(*MS_PAGES))), rfx=F.coalesce("number", F.nullif(F.regexp_extract("prose", r"(?i)\bRF[PQXI]\s*#?\s*(\d{6,})", 1), F.lit(""))))
    named = F.coalesce(F.concat(F.lit("RFx-"), "rfx"), F.when(shape(1), F.concat(F.lit("MSPURCH-"), F.coalesce("slug", fn.slug_id(F.col("title"))))).when(shape(2), F.concat(F.lit("GS-"), "other")).when(shape(3), F.concat(F.lit("MSLEASE-"), F.coalesce("slug", fn.slug_id(F.col("other"))))))
    none, first = F.lit(None).cast("string"), F.get("attachments", F.lit(0))["url"]
    first = F.when(F.col("files").isNotNull(), first).otherwise(fn.clean(first))
    agency = F.coalesce("agency", of("Mississippi Department of Finance and Administration", "MS DFA Office of Purchasing, Travel and Fleet Management", "MS DFA Bureau of Building, Grounds and Real Property Management", none))
    status = F.when(shape(0), fn.status_of_attachments(F.array_join(F.transform("attachments", lambda a: a["filename"]), " | "))).otherwise("Open")
    columns = {
        "external_id": named, "title": F.col("title"), "agency": agency, "category": F.coalesce("category", of(none, "Purchasing", "Construction", "Real Property / Lease")), "description": F.trim(F.substring("about", 1, 4000)),
        "due_date": F.when(F.col("prose").isNotNull(), fn.prose_date(F.col("prose"))).otherwise(F.timestamp_micros("due")), "detail_url": F.when(shape(1), MS_PURCHASING).otherwise(F.coalesce(first, of(*MS_PAGES))), "status_on_site": status,
    }
    return once(r, **{f"_{n}": c for n, c in columns.items()}).select("page", "position", *(F.col(f"_{n}").alias(n) for n in columns), "attachments")


def ms(payloads: DataFrame) -> DataFrame:
    """Pages come in fours, each in a shape of its own: hub, purchasing, construction, leases.

    Of one id the first record stays, with the first due date that any has and
    the files of all, once an address.
    """
    r = _ms_records(payloads)
    r = r.where("external_id is not null and title <> ''")
    # first by id and address, then by id: pages are read once
    place = F.struct("page", "position")
    rest = [c for c in r.columns if c not in ("page", "position", "due_date", "attachments", "external_id")]
    links = r.select("external_id", *rest, "page", "position", "due_date", F.posexplode_outer("attachments").alias("n", "a"))
    due = F.when(F.col("due_date").isNotNull(), F.struct("page", "position", "due_date"))
    links = links.groupBy("external_id", F.col("a.url").alias("url")).agg(F.min(F.struct("page", "position", "n", "a.filename")).alias("x"), F.min_by(F.struct(*rest), place).alias("f"), F.min(place).alias("p"), F.min(due).alias("due"))
    merged = links.groupBy("external_id").agg(F.min_by("f", "p").alias("f"), F.min("due").alias("due"), F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("x", "url")))).alias("xs"))
    files = F.transform("xs", lambda y: F.struct(y["x"]["filename"].alias("filename"), y["url"].alias("url")))
    merged = merged.select("external_id", "f.*", "due.due_date", F.when(F.size("xs") > 0, files).alias("attachments"))
    return _normal(merged, {n: F.col(n) for n in merged.columns if n in FIELDS}, clean=True).select(*FIELDS)


def grid(payloads: DataFrame, key: str = "ok") -> DataFrame:
    """The grids of ``ks`` and ``ok``: spans named FIELD$N are the fields of row N of their page.

    A page's spans are put together in its own row: after sorting those of a
    row stand side by side, so a task holds a page's spans, not its share of all.
    """
    named = r"""(?i)\bid\s*=\s*["']([^"']+)\$(\d+)["']"""
    # a span of plain text is read by one pattern; what it does not match stays and begins with "<"
    plain = r"""(?is)^<span\b[^<>\x01]*?\bid\s*=\s*["']([^"'<>\x01]+)\$(\d+)["'][^<>]*>([^<&]*)</span>$"""
    found = F.regexp_extract_all("payload", F.lit(r"""(?is)(<span\b[^>]*\bid\s*=\s*["'][^"']+\$\d+["'][^>]*>.*?</span>)"""), F.lit(1))
    cut = F.transform(found, lambda s: F.struct(s.alias("s"), F.split(F.regexp_replace(s, plain, "$1\u0001$2\u0001$3"), "\u0001", 3).alias("p")))

    def span(y: Column) -> Column:
        odd, s, part = F.startswith(y["p"][0], F.lit("<")), y["s"], lambda i: F.get(y["p"], F.lit(i))
        return F.struct(
            F.when(odd, F.regexp_extract(s, named, 2)).otherwise(part(1)).cast("int").alias("position"), F.when(odd, F.regexp_extract(s, named, 1)).otherwise(part(0)).alias("f"),
            F.when(odd, text_of(s)).otherwise(fn.clean(part(2))).alias("x"),
        )

    rows = once(payloads.select("page", "payload"), spans=F.sort_array(F.transform(cut, span))).where(F.size("spans") > 0)
    at = lambda i: F.get("spans", i)["position"]
    rows = once(rows.select("page", "spans"), starts=F.filter(F.sequence(F.lit(0), F.size("spans") - 1), lambda i: (i == 0) | (at(i) != at(i - 1))))
    records = F.transform("starts", lambda b, k: F.slice("spans", b + 1, F.coalesce(F.get("starts", k + 1), F.size("spans")) - b))
    rows = rows.select("page", F.explode(records).alias("r"))
    names = {"id": "SCP_PUB_AUC_VW_AUC_ID", "title": "SCP_PUB_AUC_VW_AUC_NAME", "agency": "BUS_UNIT_AUC_VW_DESCR", "type": "SCP_PUB_AUC_VW_AUC_TYPE", "from": "SCP_COSP_WK_FL_SCP_STRT_DATE_CHAR", "to": "SCP_COSP_WK_FL_SCP_END_DATE_CHAR"}
    value = lambda field: F.array_max(F.transform(F.filter("r", lambda y: y["f"] == field), lambda y: y["x"]))
    rows = once(rows, position=F.get("r", F.lit(0))["position"], **{n: value(field) for n, field in names.items()}).drop("r")
    return normalized(rows, {"external_id": F.col("id"), "title": F.col("title"), "agency": F.col("agency"), "category": F.col("type"), "posted_date": fn.us_date(F.col("from")), "due_date": fn.us_date(F.col("to")), "detail_url": F.lit(OK_LIST) if key == "ok" else F.lit(None), "status_on_site": F.lit("Posted")})


#: The labels of a record's fields.
MT_LABELS = ("Number", "Type", "Open", "Close")


def mt(payloads: DataFrame) -> DataFrame:
    """Rows of label and value pairs; the first value of a label counts."""
    pairs = F.regexp_extract_all("row", F.lit(r"(?is)(<(?:dt|th|label|b|strong)\b[^>]*>[^<]*</(?:dt|th|label|b|strong)>\s*(?:<[^>]*>\s*)*[^<]+)"), F.lit(1))
    rows = once(table_rows(payloads), pairs=F.transform(pairs, lambda p: F.struct(F.lower(text_of(p)).alias("k"), p.alias("p"))))
    first = lambda name: F.get(F.filter("pairs", lambda x: F.startswith(x["k"], F.lit(name.lower()))), F.lit(0))["p"]
    rows = once(rows, labels=F.transform(F.array(*map(first, MT_LABELS)), lambda p: text_of(F.regexp_replace(p, r"(?is)^.*?</(?:dt|th|label|b|strong)>", ""))))
    label = lambda name: F.nullif(F.get("labels", F.lit(MT_LABELS.index(name))), F.lit(""))
    zone = lambda name: F.when(F.rlike(label(name), F.lit("MST")), fn.MOUNTAIN_STANDARD).otherwise(fn.MOUNTAIN_DAYLIGHT)
    return normalized(rows, {"external_id": label("Number"), "title": F.get("links.filename", F.lit(0)), "agency": F.lit("State of Montana"), "category": label("Type"), "posted_date": fn.us_date(label("Open"), zone("Open")), "due_date": fn.us_date(label("Close"), zone("Close")), "status_on_site": F.lit("Open")})


# --- detail pages


def enriched(records: DataFrame, details: DataFrame) -> DataFrame:
    """Records with the fields of their detail page where it has them.

    details: (external_id, echoed, some of FIELDS), by the id that was asked
    for.  A page that names another id is not taken; of several pages of an id
    the first in order is.
    """
    fields = [c for c in details.columns if c in FIELDS and c != "external_id"]
    sure = details.where(F.col("external_id") == F.col("echoed")).groupBy("external_id").agg(F.min(F.struct(*fields)).alias("_d"))
    taken = {c: F.coalesce(F.col(f"_d.{c}"), F.col(c)).alias(c) for c in fields}
    return records.join(sure, "external_id", "left").select(*(taken.get(c, F.col(c)) for c in records.columns))


def tx_details(payloads: DataFrame, origin: str) -> DataFrame:
    """payloads: (external_id, payload), a JSON object each; relative file addresses are below ``origin``."""
    d = payloads.select("external_id", F.from_json("payload", "description:string,value:string,attachments:array<struct<fileName:string,fileURL:string>>".replace(":", " ")).alias("d"), F.rlike("payload", F.lit(r"^\s*\{")).alias("ok")).where("ok")
    value = F.regexp_extract(fn.clean(F.col("d.value")), r"^[+-]?(\d+\.?\d*|\.\d+)", 0).try_cast("double")
    files = F.filter("d.attachments", lambda a: (F.coalesce(a["fileURL"], F.lit("")) != "") & (F.coalesce(a["fileName"], F.lit("")) != ""))
    files = F.transform(files, lambda a: F.struct(fn.clean(a["fileName"]).alias("filename"), F.when(F.startswith(a["fileURL"], F.lit("http")), a["fileURL"]).otherwise(F.concat(F.lit(origin), a["fileURL"])).alias("url")))
    text = F.nullif(F.regexp_replace(fn.html_to_text(F.col("d.description")), r"^\s+|\s+$", ""), F.lit(""))
    return d.select("external_id", F.col("external_id").alias("echoed"), text.alias("description"), F.when(value > 0, value).alias("estimated_value"), F.when(F.size(files) > 0, files).alias("attachments"))


def _panel(payloads: DataFrame, **fields: tuple[str, str]) -> DataFrame:
    """(external_id, the fields): the text of the first element with the tag whose id begins with the name, null if it has none.

    Elements and texts are made once: the filter on the echoed id would look for them again, below the joins even.
    """
    first = lambda name, tag: F.regexp_extract("payload", rf"""(?is)<{tag}\b[^>]*\bid\s*=\s*["']{name}[^"']*["'][^>]*>(.*?)</{tag}>""", 1)
    rows = once(payloads.select("external_id", "payload"), **{f"_{n}": first(*f) for n, f in fields.items()})
    rows = once(rows.drop("payload"), **{n: text_of(F.col(f"_{n}")) for n in fields})
    return rows.select("external_id", *(F.nullif(n, F.lit("")).alias(n) for n in fields))


def ks_details(payloads: DataFrame) -> DataFrame:
    """payloads: (external_id, payload), an HTML page each, which names its id."""
    d = _panel(payloads, echoed=(r"KS_AUCDTL_VW_AUC_ID\$0", "span"), long=("KS_AUCDTL_VW_DESCRLONG", "textarea"), category=("KS_AUC_LN_VW_DESCR254_MIXED", "span"), status_on_site=(r"KS_AUCDTL_VW_AUC_STATUS\$0", "span"))
    text = F.nullif(fn.trim_description(F.concat_ws(" — ", "long", "category")), F.lit(""))
    return d.select("external_id", "echoed", text.alias("description"), "category", "status_on_site")


def ok_details(payloads: DataFrame) -> DataFrame:
    """payloads: (external_id, payload), partial pages whose markup is in CDATA sections, which name their id."""
    bare = F.regexp_replace("payload", r"(?s)<GENSCRIPT.*?</GENSCRIPT>", "")
    pages = once(payloads.select("external_id", "payload"), page=F.regexp_replace(bare, r"<!\[CDATA\[|\]\]>", ""))
    d = _panel(pages.select("external_id", F.col("page").alias("payload")), echoed=(r"SCP_P_AUCDTL_VW_AUC_ID\$", "span"), long=("SCP_P_AUCDTL_VW_DESCRLONG", "textarea"), status_on_site=(r"SCP_P_AUCDTL_VW_AUC_STATUS\$", "span"))
    return d.select("external_id", "echoed", F.nullif(fn.trim_description(F.col("long")), F.lit("")).alias("description"), "status_on_site")


def phx_details(payloads: DataFrame) -> DataFrame:
    """payloads: (external_id, payload), a JSON object each, by the record that was asked for."""
    kind = "summary string, background string, categories array<struct<code:string,title:string>>, attachments array<struct<filename:string,title:string,url:string>>"
    d = payloads.select("external_id", F.from_json("payload", kind).alias("d")).where(F.rlike("payload", F.lit(r"^\s*\{")))
    about = lambda part: F.nullif(fn.trim_description(fn.html_to_text(F.col(f"d.{part}"))), F.lit(""))
    titles = _joined("; ", F.array_join(F.filter(F.transform("d.categories", lambda c: fn.clean(c["title"])), lambda t: t != ""), "; "))
    files = F.transform("d.attachments", lambda a: F.struct(fn.clean(F.coalesce(a["filename"], a["title"])).alias("filename"), fn.clean(a["url"]).alias("url")))
    files = F.filter(files, lambda a: (a["filename"] != "") & (a["url"] != ""))
    return d.select("external_id", F.col("external_id").alias("echoed"), F.coalesce(about("summary"), about("background")).alias("description"), _blank(F.get("d.categories", F.lit(0))["code"]).alias("naics_code"), F.nullif(titles, F.lit("")).alias("category"), F.when(F.size(files) > 0, files).alias("attachments"))


REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "sam": sam, "ak": advantage, "ky": lambda payloads: advantage(payloads, "ky"), "ks": lambda payloads: grid(payloads, "ks"), "la": la, "mo": mo, "ms": ms, "mt": mt, "nc": nc, "ok": grid, "pa": pa, "phx": phx, "sd": sd, "tn": tn, "tx": tx, "wv": wv, "wy": wy,
    **{k: (lambda payloads, layout=LAYOUTS[k]: table(payloads, layout)) for k in ("ar", "ma")},
}


def preview(key: str, payloads: DataFrame, limit: int = 5) -> DataFrame:
    if key not in REGISTRY:
        raise KeyError(f"needs_connector: {key}")
    return REGISTRY[key](payloads).limit(limit)

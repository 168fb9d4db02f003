"""Filtered, sorted and limited lists of opportunities, boards and embeds."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cdc import OPEN
from ..operators.numbering import numbered

STAGES = ("BACKLOG", "REVIEWING", "DRAFTING", "APPROVED", "SUBMITTED", "WON", "LOST", "DECLINED")
SORTS = {
    "relevance": lambda: [F.desc_nulls_last("relevance_score"), F.col("id")],
    "score": lambda: [F.desc_nulls_last("pursuit_score"), F.col("id")],
    "due": lambda: [F.asc_nulls_last("due_date"), F.col("id")],
    "newest": lambda: [F.desc_nulls_first("first_seen_at"), F.col("id")],
}


@dataclass(frozen=True)
class Filters:
    """What a list shows; None means no condition.  State and set-aside are tested before the limit."""

    status: str | None = None
    open_only: bool = False
    due_from: datetime | None = None
    due_before: datetime | None = None
    stage: str | None = None
    source_id: int | None = None
    assigned_to: int | None = None
    relevance_min: int | None = None
    bucket: str | None = None
    urgency: str | None = None
    set_aside: str | None = None
    vehicle: str | None = None
    min_days: int | None = None
    search: str | None = None
    state: str | None = None
    sort: str = "newest"
    limit: int = 300


def default_view(view: str | None = None, **given) -> Filters:
    """The list page's defaults: actionable rows by score with ten days left, 400 of them."""
    view = view or "ACTIONABLE"
    days = 10 if view in ("ACTIONABLE", "PURSUE", "CAPTURE_REVIEW") else None
    return Filters(**{"bucket": None if view == "ALL" else view, "sort": "score", "min_days": days, "limit": 400, **given})


def conditions(f: Filters, as_of: Column) -> list[Column]:
    out = []
    for value, column in ((f.status, "status"), (f.stage, "pipeline_stage"), (f.source_id, "source_id"), (f.assigned_to, "assigned_to"), (f.urgency, "urgency")):
        if value is not None:
            out.append(F.col(column) == value)
    if f.open_only:
        out.append(F.col("status").isin(*OPEN))
    if f.due_from is not None:
        out.append(F.col("due_date") >= F.lit(f.due_from))
    if f.due_before is not None:
        out.append(F.col("due_date") <= F.lit(f.due_before))
    if f.relevance_min is not None:
        out.append(F.col("relevance_score") >= f.relevance_min)
    if f.bucket == "ACTIONABLE":
        out.append(F.col("pursuit_bucket").isin("PURSUE", "CAPTURE_REVIEW"))
    elif f.bucket == "INSUFFICIENT_TIME":
        out.append(F.col("urgency") == "INSUFFICIENT_TIME")
    elif f.bucket:
        out.append(F.col("pursuit_bucket") == f.bucket)
    if f.set_aside == "ANY":
        out.append(F.size("set_asides") > 0)
    elif f.set_aside:
        out.append(F.exists("set_asides", lambda s: F.startswith(s, F.lit(f.set_aside))))
    if f.vehicle == "ANY":
        out.append(F.col("contract_vehicle").isNotNull())
    elif f.vehicle:
        out.append(F.col("contract_vehicle") == f.vehicle)
    if f.min_days is not None:
        out.append(F.col("due_date") >= as_of + F.make_interval(days=F.lit(f.min_days)))
    if f.search:
        term = f"%{f.search.replace('%', ' ').replace(',', ' ').strip()}%"
        out.append(F.ilike(F.col("title"), F.lit(term)) | F.ilike(F.col("agency"), F.lit(term)) | F.ilike(F.col("external_id"), F.lit(term)))
    return out


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds source_name, source_slug and state; rows without a source stay."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("slug").alias("source_slug"), "state")
    return rows.join(s, "source_id", "left")


def listing(opportunities: DataFrame, sources: DataFrame, f: Filters, as_of: Column) -> DataFrame:
    """The first ``limit`` rows in order, numbered: a top-k over filters that reach the scan."""
    rows = opportunities
    for c in conditions(f, as_of):
        rows = rows.where(c)
    if f.state is not None:
        rows = with_source(rows, sources).where(F.col("state") == f.state)
    top = rows.orderBy(*SORTS[f.sort]()).limit(f.limit)
    if f.state is None:
        top = with_source(top, sources)
    # at most ``limit`` rows are numbered
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*SORTS[f.sort]())))


def embedded_counts(opportunities: DataFrame, children: DataFrame) -> DataFrame:
    """(id, responses, attachments, versions): children counted before they are joined."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    counts = children.groupBy(F.col("opportunity_id").alias("id")).agg(n("response").alias("responses"), n("attachment").alias("attachments"), n("version").alias("versions"))
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("responses", "attachments", "versions")}
    return opportunities.select("id", "assigned_to").join(counts, "id", "left").select("id", "assigned_to", *zero.values())


def board(opportunities: DataFrame, limit: int = 500) -> DataFrame:
    """The ``limit`` rows due first, by stage: (stage, stage_rank, position, id)."""
    top = opportunities.orderBy(F.asc_nulls_last("due_date"), "id").limit(limit)
    order = F.create_map(*[F.lit(x) for i, s in enumerate(STAGES) for x in (s, i)])
    within = Window.partitionBy("pipeline_stage").orderBy(F.asc_nulls_last("due_date"), "id")
    return top.select(F.col("pipeline_stage").alias("stage"), F.element_at(order, F.col("pipeline_stage")).alias("stage_rank"), F.row_number().over(within).alias("position"), "id")


def stalest_first(sources: DataFrame) -> DataFrame:
    """Active sources in the order in which they are to be crawled."""
    active = sources.where("is_active")
    return active.select("id", "name", "last_success_at", F.row_number().over(Window.orderBy(F.asc_nulls_first("last_success_at"), "name")).alias("turn"))


def connector_status(sources: DataFrame, registry: tuple[str, ...]) -> DataFrame:
    """Sources whose connector is not registered need one."""
    return sources.select("id", "connector_key", F.when(F.col("connector_key").isin(*registry), "active").otherwise("needs_connector").alias("status"))


def of_source(opportunities: DataFrame, sources: DataFrame, slug: str, limit: int = 200) -> DataFrame:
    """The newest rows of one source, such as bids that were entered by hand."""
    mine = sources.where(F.col("slug") == slug).select(F.col("id").alias("source_id"))
    return _newest(opportunities.join(F.broadcast(mine), "source_id", "left_semi"), [F.desc_nulls_first("first_seen_at"), F.col("id")], limit)


def _newest(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def not_model_scored(opportunities: DataFrame, limit: int = 50) -> DataFrame:
    """Rows whose score another method gave, the oldest first; rows without a method are left out."""
    return _newest(opportunities.where("relevance_method <> 'llm'"), [F.asc_nulls_last("first_seen_at"), F.col("id")], limit)


def document_state(attachments: DataFrame) -> DataFrame:
    """Adds ``downloaded`` (and not failed to parse) and ``pending`` (an address, not downloaded yet)."""
    here = F.col("downloaded_at").isNotNull()
    return attachments.withColumn("downloaded", here & (F.coalesce("parse_status", F.lit("")) != "failed")).withColumn("pending", F.col("source_url").isNotNull() & ~here)


def notifications(rows: DataFrame, unread: bool = False, limit: int = 50) -> DataFrame:
    """The newest notifications, or the newest unread ones."""
    return _newest(rows.where(~F.col("is_read")) if unread else rows, [F.desc("created_at"), F.desc("id")], limit)


def recent_runs(runs: DataFrame, sources: DataFrame, limit: int = 30) -> DataFrame:
    """The newest runs with their source's name."""
    top = _newest(runs, [F.desc("started_at"), F.desc("id")], limit)
    return top.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id", "left")


def with_assignee(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Adds assignee_name; rows without one stay."""
    return rows.join(users.select(F.col("id").alias("assigned_to"), F.col("name").alias("assignee_name")), "assigned_to", "left")


def users_in_order(users: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Users by role, in the order of the roles, and name."""
    rank = F.array_position(F.array(*map(F.lit, roles)), F.col("role"))
    return numbered(users, rank, "name", "id")


def chunk_counts(knowledge: DataFrame, chunks: DataFrame) -> DataFrame:
    """Knowledge entries (id) with their number of chunks; chunks: (knowledge_id), counted before they are joined."""
    counts = chunks.groupBy(F.col("knowledge_id").alias("id")).agg(F.count("*").alias("n"))
    return knowledge.join(counts, "id", "left").withColumn("chunks", F.coalesce("n", F.lit(0))).drop("n")


def export_rows(responses: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Responses with their opportunity's title and agency; responses without one are left out."""
    return responses.join(opportunities.select(F.col("id").alias("opportunity_id"), "title", "agency"), "opportunity_id")

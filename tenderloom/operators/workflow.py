"""What people and the crawl do to stored rows: status changes, approvals, run outcomes, verdicts, the daily job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import Profile
from . import reminders
from .cdc import KEY, TERMINAL
from .scoring import fallback_recommendation


def status_changes(opportunities: DataFrame, changes: DataFrame, as_of: Column, field: str = "status") -> DataFrame:
    """Log rows of manual changes: (id, field, old_value, new_value, changed_by, reason, closed_at).

    changes: (id, value, actor, reason).  A change to the value that is there
    is none; ``closed_at`` is set where a status becomes terminal.
    """
    rows = changes.join(opportunities.select("id", F.col(field).alias("old_value")), "id").where(~F.col("old_value").eqNullSafe(F.col("value")))
    closed = F.when(F.lit(field == "status") & F.col("value").isin(*TERMINAL), as_of)
    return rows.select("id", F.lit(field).alias("field"), "old_value", F.col("value").alias("new_value"), F.coalesce("actor", F.lit("user")).alias("changed_by"), "reason", closed.alias("closed_at"))


def approvals(responses: DataFrame, changes: DataFrame) -> DataFrame:
    """Notices of responses that become approved.  responses: (id, opportunity_id, title); changes: (id, status)."""
    rows = changes.where("status = 'APPROVED'").select("id").join(responses, "id")
    title = F.concat(F.lit("Response approved: "), F.coalesce("title", F.lit("draft")))
    return rows.select(F.lit("RESPONSE_APPROVED").alias("type"), title.alias("title"), "opportunity_id", F.lit("info").alias("severity"))


def sources_after(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Sources after a round of crawls: (id, status, consecutive_failures, last_run_at, last_success_at).

    runs: (source_id, outcome, at), one a source; others keep what they have.
    """
    failed = F.col("outcome") == "failed"
    rows = sources.join(runs.withColumnRenamed("source_id", "id"), "id", "left")
    return rows.select(
        "id", F.when(failed, "error").when(F.col("outcome").isNotNull(), "active").otherwise(F.col("status")).alias("status"),
        F.when(failed, F.coalesce("consecutive_failures", F.lit(0)) + 1).when(F.col("outcome").isNotNull(), 0).otherwise(F.col("consecutive_failures")).alias("consecutive_failures"),
        F.coalesce("at", "last_run_at").alias("last_run_at"), F.when(F.coalesce(~failed, F.lit(False)), F.col("at")).otherwise(F.col("last_success_at")).alias("last_success_at"),
    )


def failure_alerts(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Notices of failed crawls.  sources: (id, name); runs: (source_id, outcome, log)."""
    rows = runs.where("outcome = 'failed'").join(sources.select(F.col("id").alias("source_id"), "name"), "source_id", "left")
    return rows.select(F.lit("CRAWL_FAILURE").alias("type"), F.concat(F.lit("Crawl failed: "), F.coalesce("name", F.lit(""))).alias("title"), F.col("log").alias("body"), "source_id", F.lit("critical").alias("severity"))


def survivors(rows: DataFrame, *order: Column, most: int = 80) -> DataFrame:
    """The first rows without an exclusion, in crawl order: those that a model is asked about."""
    kept = rows.where(F.coalesce("excluded_reason", F.lit("")) == "").orderBy(*order).limit(most)
    return kept.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def merge_verdicts(rows: DataFrame, verdicts: DataFrame, *, fallback: bool = False) -> DataFrame:
    """Rows with a model's (score, recommendation, reason) where it gave them.

    rows: (id, relevance_score, ...).  Others keep their score, and with
    ``fallback`` get the recommendation that goes with it.
    """
    v = verdicts.select("id", F.col("score").alias("_s"), F.col("recommendation").alias("_r"), F.col("reason").alias("_e"))
    own = fallback_recommendation(F.col("relevance_score")) if fallback else F.lit(None).cast("string")
    out = rows.join(v, "id", "left")
    return out.select(
        *[c for c in rows.columns if c != "relevance_score"], F.coalesce("_s", "relevance_score").alias("relevance_score"), F.coalesce("_r", own).alias("bid_recommendation"),
        F.col("_e").alias("verdict_reason"), F.when(F.col("_r").isNotNull(), "llm").otherwise("rules").alias("relevance_method"),
    )


def bucket_tallies(classified: DataFrame, buckets: tuple[str, ...]) -> DataFrame:
    """One row: how many new and amended keys are in each bucket.  ``seen`` needs bucket."""
    fresh = classified.where(F.col("change").isin("NEW", "AMENDED"))
    return fresh.agg(*(F.count_if(F.col("seen.bucket") == b).alias(b.lower()) for b in buckets))


def daily(classified: DataFrame, opportunities: DataFrame, sent: DataFrame, as_of: Column, profile: Profile) -> DataFrame:
    """The daily job's actions, step by step: crawl changes, deadline reminders, urgency refresh: (step, key, action)."""
    crawl = classified.where(F.col("change").isin("NEW", "AMENDED", "CLOSED", "REMOVED")).select(F.lit(1).alias("step"), F.concat_ws(":", *KEY).alias("key"), F.col("change").alias("action"))
    due = reminders.deadline_reminders(opportunities, sent, as_of).select(F.lit(2).alias("step"), F.col("id").cast("string").alias("key"), F.concat(F.lit("DEADLINE "), F.col("days_out").cast("string")).alias("action"))
    bands = reminders.urgency_refresh(opportunities, as_of, profile).select(F.lit(3).alias("step"), F.col("id").cast("string").alias("key"), F.col("new").alias("action"))
    return crawl.unionByName(due).unionByName(bands)


#: The portals whose detail pages documents can be found on.
DISCOVERABLE_PORTALS = ("nc", "tn", "ma", "pa", "ar")


def document_candidates(opportunities: DataFrame, attachments: DataFrame, recommendations: tuple[str, ...] = ("BID",), most: int = 800) -> DataFrame:
    """(id, has_attachments, rank): whose documents to look for next, those with known attachments first.

    opportunities: with slug (of the source), detail_url and documents_checked_at;
    attachments: (opportunity_id, downloaded_at).  The ``most`` with the highest
    relevance are looked at (unscored ones first) that have a detail page and
    were not looked at before; of these all go that have a downloaded
    attachment, or have none and are on a portal without findable documents.
    """
    order = [F.desc_nulls_first("relevance_score"), F.col("id")]
    top = opportunities.where(F.col("bid_recommendation").isin(*recommendations) & F.col("detail_url").isNotNull() & F.col("documents_checked_at").isNull()).orderBy(*order).limit(most)
    known = attachments.groupBy(F.col("opportunity_id").alias("id")).agg(F.max(F.col("downloaded_at").isNotNull()).alias("done"))
    rows = top.join(known, "id", "left").where(~F.coalesce("done", F.lit(False)) & (F.col("done").isNotNull() | F.col("slug").isin(*DISCOVERABLE_PORTALS)))
    rows = rows.withColumn("has_attachments", F.col("done").isNotNull())
    return rows.select("id", "has_attachments", F.row_number().over(Window.orderBy(F.desc("has_attachments"), *order)).alias("rank"))  # ``most`` rows


def first_documents(fresh: DataFrame, most: int = 12) -> DataFrame:
    """Of each source's new and amended rows (source_id, bucket, position, ...) those whose documents a crawl downloads: pursued ones first, then reviews, in crawl order."""
    turn = F.array_position(F.array(F.lit("PURSUE"), F.lit("CAPTURE_REVIEW")), F.col("bucket"))
    rows = fresh.where(turn > 0)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy(turn, "position"))).where(F.col("n") <= most)

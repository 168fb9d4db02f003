"""Dashboards and analytics: many counters in one aggregation, fixed lists filled with zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cdc import OPEN
from .serving import STAGES, with_source

BUCKETS = ("PURSUE", "CAPTURE_REVIEW", "MANUAL_REVIEW", "IGNORE")
BANDS = ("URGENT", "STANDARD", "EARLY_CAPTURE", "INSUFFICIENT_TIME")
HISTOGRAM = ("0-9", "10-19", "20-39", "40-59", "60-79", "80+")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def spine(df: DataFrame, name: str, values: tuple[str, ...]) -> DataFrame:
    """A fixed list with its order, one row each."""
    return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"{name} string, rank int")


def filled(df: DataFrame, name: str, values: tuple[str, ...], count: str = "n") -> DataFrame:
    """Counts of a fixed list's values, zero where there are none."""
    counts = df.groupBy(name).agg(F.count("*").alias(count))
    return spine(df, name, values).join(counts, name, "left").select(name, "rank", F.coalesce(count, F.lit(0)).alias(count))


def actionable() -> Column:
    """Open, and not known to be out of time."""
    return F.col("status").isin(*OPEN) & ~F.col("urgency").eqNullSafe(F.lit("INSUFFICIENT_TIME"))


def dashboard(opportunities: DataFrame, as_of: Column) -> DataFrame:
    """One row of counters from one pass."""
    is_open = F.col("status").isin(*OPEN)
    n = F.count_if
    pursue = actionable() & (F.col("pursuit_bucket") == "PURSUE")
    week = F.make_interval(days=F.lit(7))
    value = F.when(is_open & (F.col("estimated_value") != 0), F.col("estimated_value").cast("decimal(18,2)"))
    return opportunities.agg(
        F.count("*").alias("total"), n(is_open).alias("total_open"), n(F.col("status") == "NEW").alias("new_count"), n(F.col("status") == "AMENDED").alias("amended"),
        n((F.col("status") == "NEW") & (F.coalesce("relevance_score", F.lit(0)) >= 70)).alias("relevant_new"),
        n(F.col("pipeline_stage") == "SUBMITTED").alias("submitted"), n(F.col("pipeline_stage") == "WON").alias("won"),
        n(pursue).alias("pursue_now"), n(actionable() & (F.col("pursuit_bucket") == "CAPTURE_REVIEW")).alias("capture_review"),
        n(pursue & (F.col("first_seen_at") >= as_of - F.make_interval(days=F.lit(1)))).alias("new_pursue"),
        n(is_open & F.col("due_date").between(as_of, as_of + week)).alias("closing_soon"),
        F.coalesce(F.sum(value), F.lit(0)).cast("double").alias("pipeline_value"),
    )


def urgency_distribution(opportunities: DataFrame) -> DataFrame:
    return filled(opportunities.where(F.col("status").isin(*OPEN)), "urgency", BANDS)


def stage_counts(opportunities: DataFrame) -> DataFrame:
    return filled(opportunities, "pipeline_stage", STAGES)


def score_histogram(opportunities: DataFrame) -> DataFrame:
    s = F.col("relevance_score")
    band = F.when(s < 10, "0-9").when(s < 20, "10-19").when(s < 40, "20-39").when(s < 60, "40-59").when(s < 80, "60-79").otherwise("80+")
    return filled(opportunities.where(s.isNotNull()).select(band.alias("band")), "band", HISTOGRAM)


def by_state(opportunities: DataFrame, sources: DataFrame) -> DataFrame:
    rows = with_source(opportunities.select("source_id", "status"), sources).where("state <> ''")
    return rows.groupBy("state").agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*OPEN)).alias("open"))


def win_rate(opportunities: DataFrame) -> DataFrame:
    won, lost = F.count_if(F.col("pipeline_stage") == "WON"), F.count_if(F.col("pipeline_stage") == "LOST")
    return opportunities.agg(half_up(F.try_divide(won * 100.0, won + lost)).cast("bigint").alias("win_rate"), half_up(F.avg("relevance_score")).cast("bigint").alias("avg_relevance"))


def win_by_bucket(opportunities: DataFrame) -> DataFrame:
    decided = opportunities.where(F.col("pipeline_stage").isin("WON", "LOST", "SUBMITTED") & F.col("pursuit_bucket").isNotNull())
    n = lambda s: F.count_if(F.col("pipeline_stage") == s)
    rows = decided.groupBy("pursuit_bucket").agg(n("WON").alias("won"), n("LOST").alias("lost"), n("SUBMITTED").alias("submitted"))
    return rows.withColumn("rate", half_up(F.try_divide(F.col("won") * 100.0, F.col("won") + F.col("lost"))).cast("bigint"))


def bucket_by_source(opportunities: DataFrame, sources: DataFrame, bucket: str = "pursuit_bucket") -> DataFrame:
    """Bucket counts by state, or the source's name where there is none; numbered by top buckets."""
    counts = opportunities.groupBy("source_id", bucket).agg(F.count("*").alias("n"))  # few rows before the join
    place = F.coalesce(F.nullif("state", F.lit("")), "source_name", F.lit("Other"))
    rows = with_source(counts, sources).groupBy(place.alias("place")).pivot(bucket, list(BUCKETS)).agg(F.sum("n"))
    return rows.select("place", *(F.coalesce(b, F.lit(0)).alias(b.lower()) for b in BUCKETS))


def exclusions_by_group(opportunities: DataFrame) -> DataFrame:
    group = F.nullif(F.regexp_extract("excluded_reason", r"\(([^)]+)\)\s*$", 1), F.lit(""))
    return opportunities.where("excluded_reason is not null").groupBy(F.coalesce(group, F.lit("Other")).alias("exclusion")).agg(F.count("*").alias("n"))


def source_health(opportunities: DataFrame, sources: DataFrame) -> DataFrame:
    n = opportunities.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("total"), F.count_if(F.col("status").isin(*OPEN)).alias("open"), F.count_if(F.col("status") == "NEW").alias("new"))
    return sources.select("id", "name").join(n, "id", "left").select("id", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "open", "new")))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each source's last run: a maximum with its row, combined before the shuffle."""
    last = runs.groupBy("source_id").agg(F.max(F.struct("started_at", "id", "status", "new_count")).alias("r"))
    return last.select("source_id", F.col("r.id").alias("run_id"), F.col("r.started_at").alias("started_at"), F.col("r.status").alias("status"), F.col("r.new_count").alias("new_count"))


def crawl_success(runs: DataFrame, latest: int = 200) -> DataFrame:
    top = runs.orderBy(F.desc("started_at"), F.desc("id")).limit(latest)
    good = F.count_if(F.col("status").isin("success", "partial"))
    return top.agg(F.count("*").alias("crawls"), half_up(F.try_divide(good * 100.0, F.count("*"))).cast("bigint").alias("success_rate"))


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.sum("new_count").alias("new_total"), F.sum("changed_count").alias("changed_total"), F.count_if(F.col("status") == "failed").alias("failed"))


def mode_usage(responses: DataFrame) -> DataFrame:
    return responses.groupBy("mode").agg(F.count("*").alias("n"))


def latest_responses(responses: DataFrame) -> DataFrame:
    within = Window.partitionBy("opportunity_id", "mode").orderBy(F.desc("turn"))
    return responses.withColumn("_n", F.row_number().over(within)).where("_n = 1").select("opportunity_id", "mode", "turn")


def by_status(opportunities: DataFrame) -> DataFrame:
    return opportunities.groupBy("status").agg(F.count("*").alias("n"))


def with_bar_max(counts: DataFrame, n: str = "n") -> DataFrame:
    """Adds ``most``: the largest count, 1 at least, to scale bars by.  One row is sent to all."""
    return counts.join(F.broadcast(counts.agg(F.greatest(F.coalesce(F.max(n), F.lit(0)), F.lit(1)).cast("bigint").alias("most"))))


def bucket_histogram(scored: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Rows of each bucket, zero where there are none."""
    return filled(scored.select(F.col(bucket).alias("bucket")), "bucket", BUCKETS)

"""Deadline reminders and the daily refresh of urgency bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profile import Profile
from ..functions.scalars import days_until
from .cdc import OPEN, TERMINAL
from .scoring import urgency


def deadline_reminders(opportunities: DataFrame, sent: DataFrame, as_of: Column, days: tuple[int, ...] = (7, 3, 1), due: str = "due_date", kind: str = "DEADLINE") -> DataFrame:
    """(id, days_out, severity) of open rows due in one of ``days`` that have no such reminder yet.  sent: (id, type, days_out)."""
    rows = opportunities.where(F.col("status").isin(*OPEN)).select("id", days_until(F.col(due), as_of).alias("days_out")).where(F.col("days_out").isin(*days) & (F.col("days_out") >= 0))
    fresh = rows.join(sent.where(F.col("type") == kind).select("id", "days_out"), ["id", "days_out"], "left_anti")
    return fresh.select("id", "days_out", F.lit(kind).alias("type"), F.when((F.col("days_out") <= 1) & F.lit(kind == "DEADLINE"), "critical").otherwise("warning").alias("severity"))


def urgency_refresh(opportunities: DataFrame, as_of: Column, profile: Profile) -> DataFrame:
    """(id, old, new) of scored rows, not terminal, whose band is another by now."""
    rows = opportunities.where(F.col("pursuit_bucket").isNotNull() & ~F.col("status").isin(*TERMINAL))
    return rows.select("id", F.col("urgency").alias("old"), urgency(F.col("due_date"), as_of, profile).alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))

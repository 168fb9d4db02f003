"""Change capture: a crawl's snapshot against stored state, and what follows from it.

One full outer join on (source_id, external_id) classifies every key; the new
state, versions, status log, attachments and notifications are projections of
that one classified table.  Both sides arrive by the same key, so state that is
bucketed by it needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("CLOSED", "REMOVED", "AWARDED", "CANCELLED")
OPEN = ("NEW", "OPEN", "AMENDED", "CLOSING_SOON")
KEY = ["source_id", "external_id"]


def _quoted(c: Column) -> Column:
    """A JSON string."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def content_hash(title: Column, agency: Column, due: Column, questions: Column, description: Column, value: Column, status: Column, urls: Column) -> Column:
    """SHA-256 of a JSON array of the fields whose change is an amendment; dates are given as ISO text."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    number = F.when(value.isNull(), F.lit('""')).when(value == F.floor(value), F.floor(value).cast("bigint").cast("string")).otherwise(value.cast("string"))
    links = F.array_join(F.array_sort(F.coalesce(urls, F.array().cast("array<string>"))), "|")
    material = F.concat(F.lit("["), F.concat_ws(",", _quoted(low(title)), _quoted(low(agency)), _quoted(F.coalesce(due, F.lit(""))), _quoted(F.coalesce(questions, F.lit(""))), _quoted(low(description)), number, _quoted(low(status)), _quoted(links)), F.lit("]"))
    return F.sha2(material, 256)


def fallback_id(title: Column, agency: Column, due: Column) -> Column:
    """An id for records that have none."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.sha2(F.lower(F.concat(part(title), F.lit("|"), part(agency), F.lit("|"), part(due))), 256), 1, 24)


def first_of_each(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row of each key by position; equal positions by nothing else, so give a unique one."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(position))).where("_n = 1").drop("_n")


def classify(stored: DataFrame, snapshot: DataFrame, as_of: Column, complete: bool = True) -> DataFrame:
    """Every key with its ``change``, ``old_status`` and ``new_status``, and both sides' rows as ``stored`` and ``seen``.

    NEW, AMENDED (hash differs; a terminal status stays), UNCHANGED (NEW turns
    OPEN), CLOSED (absent and past due), REMOVED (absent), TERMINAL (absent
    and already terminal).  With ``complete=False`` absent keys are left as
    they are (ABSENT).  The snapshot's keys are to be unique: see first_of_each.
    """
    old = stored.select(*KEY, F.struct(*[c for c in stored.columns if c not in KEY]).alias("stored"))
    new = snapshot.select(*KEY, F.struct(*[c for c in snapshot.columns if c not in KEY]).alias("seen"))
    both = old.join(new, KEY, "full_outer")
    terminal = F.col("stored.status").isin(*TERMINAL)
    absent = F.when(terminal, "TERMINAL").when(F.lit(not complete), "ABSENT").when(F.col("stored.due_date") < as_of, "CLOSED").otherwise("REMOVED")
    change = (
        F.when(F.col("stored").isNull(), "NEW").when(F.col("seen").isNull(), absent)
        .when(F.col("stored.content_hash").eqNullSafe(F.col("seen.content_hash")), "UNCHANGED").otherwise("AMENDED")
    )
    status = F.col("stored.status")
    after = (
        F.when(F.col("change") == "NEW", "NEW").when((F.col("change") == "AMENDED") & ~terminal, "AMENDED")
        .when((F.col("change") == "UNCHANGED") & (status == "NEW"), "OPEN").when(F.col("change").isin("CLOSED", "REMOVED"), F.col("change")).otherwise(status)
    )
    return both.withColumn("change", change).withColumn("old_status", status).withColumn("new_status", after)


def counters(classified: DataFrame) -> DataFrame:
    """One row: items found, new, changed and closed."""
    n = lambda *kinds: F.count_if(F.col("change").isin(*kinds))
    return classified.agg(n("NEW", "AMENDED", "UNCHANGED").alias("items_found"), n("NEW").alias("new_count"), n("AMENDED").alias("changed_count"), n("CLOSED", "REMOVED").alias("closed_count"))


def version_rows(classified: DataFrame, number: Column, as_of: Column) -> DataFrame:
    """A version of every new and amended key, with this number."""
    changed = classified.where(F.col("change").isin("NEW", "AMENDED"))
    return changed.select(*KEY, number.alias("version_no"), F.col("seen.content_hash").alias("content_hash"), F.when(F.col("change") == "NEW", "Initial capture").otherwise("Amended on portal").alias("change_summary"), as_of.alias("captured_at"))


def versions(classified: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """New versions: one after the key's last, from 1."""
    last = history.groupBy(*KEY).agg(F.max("version_no").alias("_last"))
    return version_rows(classified.join(last, KEY, "left"), F.coalesce("_last", F.lit(0)) + 1, as_of)


def status_log(classified: DataFrame, as_of: Column) -> DataFrame:
    """Status changes worth a log row; the quiet turn from NEW to OPEN is not."""
    moved = classified.where(F.col("change").isin("NEW", "AMENDED", "CLOSED", "REMOVED") & ~F.col("old_status").eqNullSafe(F.col("new_status")))
    reason = F.create_map(*[F.lit(x) for p in {"NEW": "First seen on portal", "AMENDED": "Content changed on portal", "CLOSED": "Past due date and no longer listed", "REMOVED": "No longer listed on portal"}.items() for x in p])
    return moved.select(*KEY, F.lit("status").alias("field"), F.col("old_status").alias("old_value"), F.col("new_status").alias("new_value"), F.element_at(reason, F.col("change")).alias("reason"), as_of.alias("changed_at"))


def notifications(classified: DataFrame) -> DataFrame:
    """Pursue (unless time is short), capture review, and every amendment.  ``seen`` needs title, bucket and urgency."""
    title, bucket = F.col("seen.title"), F.col("seen.bucket")
    pursue = (F.col("change") == "NEW") & (bucket == "PURSUE") & (F.col("seen.urgency") != "INSUFFICIENT_TIME")
    review = (F.col("change") == "NEW") & (bucket == "CAPTURE_REVIEW")
    kind = F.when(pursue | review, "NEW_OPPORTUNITY").when(F.col("change") == "AMENDED", "AMENDMENT")
    text = F.when(pursue, F.concat(F.lit("Pursue: "), title)).when(review, F.concat(F.lit("Capture review: "), title)).otherwise(F.concat(F.lit("Amended: "), title))
    return classified.select(*KEY, kind.alias("type"), text.alias("title"), F.when(review, "info").otherwise("warning").alias("severity")).where("type is not null")


def next_state(classified: DataFrame, as_of: Column, version: Column | None = None) -> DataFrame:
    """The stored table after the crawl; the seen row's fields replace those of new and amended keys, ``version`` the column version_no."""
    seen = {f.name for f in classified.schema["seen"].dataType}
    fresh = F.col("change").isin("NEW", "AMENDED")
    columns = []
    for f in classified.schema["stored"].dataType:
        old = F.col(f"stored.{f.name}")
        if f.name == "status":
            columns.append(F.col("new_status").alias("status"))
        elif f.name == "version_no" and version is not None:
            columns.append(version.cast(f.dataType).alias(f.name))
        elif f.name == "last_seen_at":
            columns.append(F.when(F.col("seen").isNotNull(), as_of).otherwise(old).alias(f.name))
        elif f.name == "first_seen_at":
            columns.append(F.coalesce(old, as_of).alias(f.name))
        elif f.name == "closed_at":
            columns.append(F.when(F.col("change").isin("CLOSED", "REMOVED"), as_of).otherwise(old).alias(f.name))
        elif f.name in seen:
            columns.append(F.when(fresh, F.col(f"seen.{f.name}").cast(f.dataType)).otherwise(old).alias(f.name))
        else:
            columns.append(old.alias(f.name))
    return classified.select(*KEY, *columns)


def attachments(classified: DataFrame, most: int = 30) -> DataFrame:
    """Pending attachments of new keys, the first ``most`` of each.  ``seen.attachments``: array of (filename, url)."""
    rows = classified.where("change = 'NEW'").select(*KEY, F.posexplode(F.slice("seen.attachments", 1, most)).alias("position", "a"))
    return rows.select(*KEY, "position", F.coalesce(F.nullif("a.filename", F.lit("")), F.lit("attachment")).alias("filename"), F.col("a.url").alias("source_url"), F.lit("pending").alias("parse_status"))


def run_outcome(warnings: Column, failed: Column) -> Column:
    return F.when(failed, "failed").when(warnings > 0, "partial").otherwise("success")

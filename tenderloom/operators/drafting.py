"""Drafts: prompts and deterministic offline texts as string expressions, and markdown lines by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prompt(title: Column, agency: Column, description: Column, documents: Column, examples: Column, own_style: bool) -> Column:
    """The request for a draft; ``own_style`` leaves the examples out."""
    part = lambda head, body, most: F.when(F.length(F.coalesce(body, F.lit(""))) > 0, F.concat(F.lit(head + "\n"), F.substring(body, 1, most)))
    task = "Write a proposal response in your own words." if own_style else "Write a proposal response in the style of the examples."
    parts = [F.lit(task), F.concat(F.lit("OPPORTUNITY: "), title), F.concat(F.lit("AGENCY: "), F.coalesce(agency, F.lit("unknown"))), part("DESCRIPTION:", description, 8000), part("DOCUMENTS:", documents, 28000)]
    return F.concat_ws("\n\n", *parts, *([] if own_style else [part("EXAMPLES:", examples, 8000)]))


def offline_draft(title: Column, agency: Column, mode: Column) -> Column:
    """A fixed text, for when no model can be asked."""
    return F.concat_ws("\n\n", F.concat(F.lit("# Response to "), title), F.concat(F.lit("Prepared for "), F.coalesce(agency, F.lit("the agency")), F.lit(" ("), mode, F.lit(")")), F.lit("## Understanding\n- Scope and outcomes as published"), F.lit("## Approach\n- Plan, deliver, report"))


def next_revision(responses: DataFrame, key: str, number: str) -> DataFrame:
    return responses.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def stage_after_draft(stage: Column) -> Column:
    return F.when(stage.isin("BACKLOG", "REVIEWING"), "DRAFTING").otherwise(stage)


def markdown_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, kind, content): headings, bullets, quotes, table rows, blanks and paragraphs, as written; ``export_lines`` gives a document's."""
    rows = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    kind = (
        F.when(F.rlike("raw", F.lit(r"^###\s")), "heading3").when(F.rlike("raw", F.lit(r"^##\s")), "heading2").when(F.rlike("raw", F.lit(r"^#\s")), "heading1")
        .when(F.rlike("raw", F.lit(r"^\s*[-*]\s")), "bullet").when(F.rlike("raw", F.lit(r"^>")), "quote").when(F.rlike("raw", F.lit(r"^\s*\|")), "table")
        .when(F.trim("raw") == "", "blank").otherwise("paragraph")
    )
    return rows.select(key, "line", kind.alias("kind"), F.trim(F.regexp_replace("raw", r"^\s*(#{1,3}|[-*]|>)\s*", "")).alias("content"))


#: White space of a document's lines.
_SPACE = r"(?U)[\s﻿]"


def export_title(title: Column, external_id: Column, own: Column) -> Column:
    """A document's title: the opportunity's title and id, or the response's own title, or a fixed word."""
    return F.coalesce(F.concat(title, F.lit(" — "), external_id), F.nullif(own, F.lit("")), F.lit("Proposal"))


def export_name(external_id: Column, prefix: str = "Response_") -> Column:
    """File name of an exported draft."""
    return F.concat(F.lit(prefix), F.regexp_replace(external_id, "[^A-Za-z0-9-]+", "_"), F.lit(".docx"))


def runs(content: Column) -> Column:
    """[{text, bold}] of a line: what stands between double stars is bold; empty parts are left out.

    A part of nothing but the stars is a bold run without text.
    """
    bold = r"\*\*[^*]+\*\*"
    # between n bold parts are n + 1 others, some of them empty
    parts = F.flatten(F.zip_with(F.split(content, bold), F.regexp_extract_all(content, F.lit(f"({bold})"), F.lit(1)), lambda plain, marked: F.array(plain, marked)))
    marked = lambda p: F.startswith(p, F.lit("**")) & F.endswith(p, F.lit("**"))
    run = lambda p: F.struct(F.when(marked(p), F.substring(p, F.lit(3), F.greatest(F.length(p) - 4, F.lit(0)))).otherwise(p).alias("text"), marked(p).alias("bold"))
    return F.transform(F.filter(parts, lambda p: p != ""), run)


def export_lines(df: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(key, line, kind, runs) of each draft's document: its title as line 0, then a paragraph a line.

    Kinds are title, heading1 to heading3, bullet, quote, table (cells in one
    plain line), blank and paragraph.  Titles and headings are one plain run,
    blanks have none.  A null title is empty, a null text has no lines.
    """
    lines = F.concat(F.array(F.coalesce(title, F.lit(""))), F.coalesce(F.split(text, "\n"), F.array().cast("array<string>")))
    rows = df.select(key, F.posexplode(lines).alias("line", "raw"))
    trimmed = lambda c: F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")
    rows = rows.select(key, "line", F.when(F.col("line") == 0, F.col("raw")).otherwise(trimmed(F.col("raw"))).alias("t"))
    is_ = lambda pattern: F.rlike("t", F.lit(pattern))
    kind = (
        F.when(F.col("line") == 0, "title").when(F.col("t") == "", "blank")
        .when(is_("^### "), "heading3").when(is_("^## "), "heading2").when(is_("^# "), "heading1")
        .when(is_(rf"^[-*]{_SPACE}"), "bullet").when(is_("^>"), "quote").when(is_(r"^\|.*\|$"), "table").otherwise("paragraph")
    )
    rows = rows.select(key, "line", kind.alias("kind"), "t")
    content = (
        F.when(F.col("kind").startswith("heading"), F.regexp_replace("t", "^#+ ", "")).when(F.col("kind") == "bullet", F.regexp_replace("t", rf"^[-*]{_SPACE}+", ""))
        .when(F.col("kind") == "quote", F.regexp_replace("t", rf"^>{_SPACE}?", "")).when(F.col("kind") == "table", trimmed(F.regexp_replace("t", r"\|", "  "))).otherwise(F.col("t"))
    )
    rows = rows.select(key, "line", "kind", content.alias("content"))
    whole = F.array(F.struct(F.col("content").alias("text"), F.lit(False).alias("bold")))
    return rows.select(key, "line", "kind", F.when(F.col("kind").isin("title", "heading1", "heading2", "heading3"), whole).otherwise(runs(F.col("content"))).alias("runs"))

"""A model's bid or no-bid view of many opportunities: batches, their prompts, and the verdicts that come back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profile import Profile
from .numbering import batches
from .retrieval import parse_verdicts

#: The certifications and the wording that the replies depend on.
CERTIFICATIONS = "SBA-certified 8(a), Woman-Owned Small Business (WOSB), and Minority Business Enterprise (MBE)"
ANSWER = '[{"i":<index>,"score":<0-100 fit to THIS company>,"rec":"BID|REVIEW|NO_BID","reason":"<= 16 words why"}]'


def profile_text(company: str, about: str | None, profile: Profile) -> str:
    """What the model is told of the company: the same profile that the rule engine scores with."""
    names = lambda rows: ", ".join(rows)
    lines = [
        f"Company: {company}", f"About: {about}" if about else "", f"Certifications: {CERTIFICATIONS} — set-aside opportunities matching these are top priority.",
        f"Core capabilities: {names(c.label for c in profile.capabilities)}", f"Target NAICS: {names(profile.naics)}", f"Priority agencies — federal: {names(g.name for g in profile.federal)}. DoD only for IT work.",
        f"Priority states: {names(n for n, _ in profile.states)}", f"Out of scope (NO_BID unless a substantial IT component): {names(g for g, _ in profile.exclusions)}",
    ]
    return "\n".join(x for x in lines if x)


def item(i: Column) -> Column:
    """An opportunity as the JSON object that a prompt lists it by; its texts are cut."""
    part = lambda name, most: F.coalesce(F.substring(name, 1, most), F.lit(""))
    words = F.substring(F.regexp_replace(F.coalesce("description", F.lit("")), r"(?U)\s+", " "), 1, 320)
    return F.to_json(F.struct(i.alias("i"), part("title", 220).alias("title"), part("agency", 80).alias("agency"), part("category", 80).alias("category"), F.coalesce("naics_code", F.lit("")).alias("naics"), words.alias("desc")))


def prompts(batched: DataFrame, about: str) -> DataFrame:
    """(batch, size, prompt) of rows with batch and i."""
    rows = batched.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("i", item(F.col("i")).alias("j")))).alias("l"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]"))
    return rows.select("batch", F.size("l").alias("size"), F.concat(F.lit(f"COMPANY PROFILE\n{about}\n\nSOLICITATIONS (JSON)\n"), listed, F.lit(f"\n\nFor each item return one object. Respond with ONLY a JSON array:\n{ANSWER}")).alias("prompt"))


def classify(rows: DataFrame, about: str, *order: Column | str, ask: Callable[[DataFrame], DataFrame] | None = None, size: int = 10) -> DataFrame:
    """(id, score, recommendation, reason) of the opportunities that the model has a verdict on.

    ``ask`` adds a column ``reply`` to the prompts; without it, or where a reply
    cannot be read, there is no verdict and a row keeps the score that it has.
    """
    batched = batches(rows, *order, size=size)
    if ask is None:
        return batched.where("false").select("id", F.lit(0).alias("score"), F.lit("").alias("recommendation"), F.lit("").alias("reason"))
    verdicts = parse_verdicts(ask(prompts(batched, about)).select("batch", "size", "reply"), "reply", "size")
    return batched.select("id", "batch", "i").join(verdicts, ["batch", "i"]).select("id", "score", "recommendation", "reason")

"""Phrases as Column predicates: whole words, symbols allowed, short upper-case terms case-sensitive."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words about support.
SUPPORT = "(help ?desk|service desk|support|call center|ticket)"


def is_case_sensitive(phrase: str) -> bool:
    return len(phrase) <= 4 and phrase == phrase.upper() and re.fullmatch(r"[A-Z0-9().#]+", phrase) is not None


def pattern(phrase: str) -> str:
    """A Java regular expression that finds the phrase between non-alphanumerics."""
    escaped = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", phrase)
    lead = "(?<![A-Za-z0-9])" if phrase[:1].isascii() and phrase[:1].isalnum() else ""
    tail = "(?![A-Za-z0-9])" if phrase[-1:].isascii() and phrase[-1:].isalnum() else ""
    return ("" if is_case_sensitive(phrase) else "(?i)") + lead + escaped + tail


def found(phrase: str, text: Column, lower: Column) -> Column:
    """Whether the text has the phrase; the substring test comes first, being far cheaper than the expression.

    ``lower`` is the lower-cased text, made once for all phrases.  A null text has nothing.
    """
    cheap = F.contains(text, F.lit(phrase)) if is_case_sensitive(phrase) else F.contains(lower, F.lit(phrase.lower()))
    return F.coalesce(cheap & F.rlike(text, F.lit(pattern(phrase))), F.lit(False))


def found_capability(phrase: str, text: Column, lower: Column) -> Column:
    """As ``found``; a support tier also needs a word about support somewhere in the text."""
    hit = found(phrase, text, lower)
    return hit & F.rlike(lower, F.lit(SUPPORT)) if needs_support(phrase) else hit


def needs_support(phrase: str) -> bool:
    return re.fullmatch("(?i)Tier [123]", phrase) is not None


def hits(phrases: list[tuple[str, Column]]) -> Column:
    """The labels whose condition holds, in order, as an array."""
    if not phrases:
        return F.array().cast("array<string>")
    return F.filter(F.array(*(F.when(condition, F.lit(label)) for label, condition in phrases)), lambda x: x.isNotNull())


def sql_condition(phrase: str, text: str) -> str:
    """The same test for an engine whose expressions have no look-around (RE2)."""
    escaped = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", phrase).replace("'", "''")
    lead = "(^|[^A-Za-z0-9])" if phrase[:1].isalnum() else ""
    tail = "($|[^A-Za-z0-9])" if phrase[-1:].isalnum() else ""
    flag = "" if is_case_sensitive(phrase) else ", 'i'"
    return f"coalesce(regexp_matches({text}, '{lead}{escaped}{tail}'{flag}), false)"

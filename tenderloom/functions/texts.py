"""Functions of ``scalars`` in Python, for readers that go over Arrow batches: the same results without a Column expression for each text."""

from __future__ import annotations

import re
from datetime import date
from functools import lru_cache

from .scalars import MONTHS

#: What Unicode calls white space; Python's own has the four separators below the blank too.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_SPACES = re.compile(f"{_SPACE}+")
_US_DATE = re.compile(r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp])?\.?[Mm]?)?", re.A)
_MONTH_DATE = re.compile(r"\b(?=[jfmasond])(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(\d{1,2}),?\s+(\d{4})", re.A | re.I)
_TIME = re.compile(r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([ap])\.?\s?m", re.A | re.I)
_PROSE_DATE = re.compile(r"\b(?=[jfmasond])(january|february|march|april|may|june|july|august|september|october|november|december)\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(20\d{2})\b", re.A | re.I)
_PROSE_TIME = re.compile(r"\b(\d{1,2})(?::(\d{2}))?\s*([ap])\.?\s?m\.?", re.A | re.I)
_ROOTED = re.compile(r"(?!//)(?:/(?!\.{1,2}(?:[/?#]|\Z))[^/?#]*+)++(?:[?#].*+)?")
_EPOCH = date(1970, 1, 1).toordinal()


def clean(text: str) -> str:
    if text.isascii() and text.isprintable():
        return text.strip(" ") if "  " not in text else " ".join(text.split())
    return _SPACES.sub(" ", text).strip(" ")


def _micros(year: int, month: int, day: int, hour: int, minute: int, second: int, offset: int) -> int | None:
    """A local time as microseconds of UTC; 60 seconds are a minute, other impossible times None."""
    if not (hour < 24 and minute < 60 and second <= 60):
        return None
    try:
        # the year 0 is one to Spark
        days = (date(year, month, day).toordinal() if year else date(400, month, day).toordinal() - 146_097) - _EPOCH
    except ValueError:
        return None
    return (((days * 24 + hour) * 60 + minute - offset) * 60 + second) * 1_000_000


def _hour24(hour: str | None, half: str) -> int:
    h = int(hour or 0)
    return h + 12 if half in "pP" and half and h < 12 else 0 if half in "aA" and half and h == 12 else h


def us_date(text: str, offset: int) -> int | None:
    """``scalars.us_date`` in microseconds; short texts repeat, so those of late are kept."""
    return (_us_date if len(text) <= 40 else _us_date.__wrapped__)(text, offset)


@lru_cache(65536)
def _us_date(text: str, offset: int) -> int | None:
    found = _US_DATE.search(text)
    if found is None:
        return None
    month, day, year, hour, minute, second, half = found.groups()
    return _micros(int(year) + (2000 if int(year) < 100 else 0), int(month), int(day), _hour24(hour, half or ""), int(minute or 0), int(second or 0), offset)


def month_name_date(text: str, offset: int) -> int | None:
    """``scalars.month_name_date`` of an ASCII text, in microseconds; where words end in other texts Java and Python differ on."""
    return (_month_name_date if len(text) <= 40 else _month_name_date.__wrapped__)(text, offset)


@lru_cache(65536)
def _month_name_date(text: str, offset: int) -> int | None:
    found = _MONTH_DATE.search(text)
    if found is None:
        return None
    hour, minute, second, half = time.groups() if (time := _TIME.search(text)) else (None, None, None, None)
    return _micros(int(found[3]), MONTHS[found[1].lower()], int(found[2]), _hour24(hour, half or ""), int(minute or 0), int(second or 0), offset)


def rooted(origin: str, href: str) -> str | None:
    """``scalars.absolute`` of an address from the root that has no folder named . or ..; None for others."""
    return origin + href if _ROOTED.fullmatch(href) and href.isascii() and href.isprintable() else None


def prose_date(text: str, offset: int) -> int | None:
    """``scalars.prose_date`` of an ASCII text, in microseconds."""
    found = _PROSE_DATE.search(text)
    if found is None:
        return None
    hour, minute, half = time.groups() if (time := _PROSE_TIME.search(text)) else (None, None, None)
    return _micros(int(found[3]), MONTHS[found[1][:3].lower()], int(found[2]), _hour24(hour, half or ""), int(minute or 0), 0, offset)


def slug_id(text: str) -> str:
    """``scalars.slug_id`` of an ASCII text."""
    return re.sub("[^a-z0-9]+", "-", text.lower()).strip("-")[:80]

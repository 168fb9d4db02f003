"""All phrases of a profile in one pass over a text, by an Aho-Corasick automaton over Arrow batches.

The automaton finds which phrases a lower-cased text has at all; only these are
then held against the exact test of ``matching``.  So the work follows the
text and what it has, and a plan has one function call, not a predicate for
each phrase.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import matching

SUPPORT = re.compile(matching.SUPPORT, re.ASCII)


class Term(NamedTuple):
    """A phrase that a field (0, 1, 2) is searched for, the family it belongs to and the label that a hit leaves."""

    family: str
    label: str
    phrase: str
    field: int = 0
    support: bool = False


class Index:
    def __init__(self, terms: tuple[Term, ...]):
        self.terms = terms
        self.tests = [re.compile(matching.pattern(t.phrase).removeprefix("(?i)"), re.ASCII | (0 if matching.is_case_sensitive(t.phrase) else re.IGNORECASE)) for t in terms]
        self.automata = []
        for field in range(3):
            by_text: dict[str, list[int]] = {}
            for n, t in enumerate(terms):
                if t.field == field:
                    by_text.setdefault(t.phrase.lower(), []).append(n)
            automaton = ahocorasick.Automaton()
            for text, numbers in by_text.items():
                automaton.add_word(text, numbers)
            if by_text:
                automaton.make_automaton()
            self.automata.append(automaton if by_text else None)

    def hits(self, *fields: str | None) -> dict[str, list[str]]:
        """The labels of each family that has any, in the order of the terms."""
        found: set[int] = set()
        for text, automaton in zip(fields, self.automata, strict=True):
            if text and automaton is not None:
                low = text.lower()
                near = {n for _, numbers in automaton.iter(low) for n in numbers}
                found |= {n for n in near if self.tests[n].search(text) and (not self.terms[n].support or SUPPORT.search(low))}
        out: dict[str, list[str]] = {}
        for n in sorted(found):
            out.setdefault(self.terms[n].family, []).append(self.terms[n].label)
        return out


@lru_cache(maxsize=8)
def index(terms: tuple[Term, ...]) -> Index:
    """Kept by each Python worker for its next batches."""
    return Index(terms)


def find(terms: Iterable[Term], first: Column, second: Column, third: Column) -> Column:
    """map<family, labels> of the phrases in three texts; null texts have none."""
    terms = tuple(terms)

    def hits(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        known = index(terms)
        return pd.Series([known.hits(*texts) for texts in zip(a, b, c, strict=True)], dtype=object)

    return F.pandas_udf(hits, "map<string,array<string>>")(first, second, third)

"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tenderloom.llm import conversations as cv
from tenderloom.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, copies int, part string"


def damage(rows):
    """{conv: turns after damage, in order}, by plain Python."""
    out: dict = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        kept += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def cheapest(faults, rows):
    """Smallest (cost, audit, repaired) over every choice of edits, with at most two inserts in a place."""
    best = None
    edits = [[("D", None)] if f in ("blank", "duplicate") else [("D", None), ("K", r[1]), ("R", "user"), ("R", "assistant")] for f, r in zip(faults, rows, strict=True)]
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for chosen in itertools.product(*edits):
        for places in itertools.product(inserts, repeat=len(rows) + 1):
            cost, audit, made = 0, "", []
            for n in range(len(rows) + 1):
                for role in places[n]:
                    cost, audit = cost + 5, audit + "I"
                    made.append(f"{role}:")
                if n < len(rows):
                    edit, role = chosen[n]
                    cost += {"D": 2, "K": 0, "R": 1}[edit] + (5 if edit != "D" and faults[n] == "truncated" else 0)
                    audit += edit
                    if edit != "D":
                        made.append(f"{role}:{rows[n][2]}")
            if re.fullmatch("(s?(ua)+)?", "".join(m[:1] for m in made)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, made)
    return best


def brute(rows):
    out = []
    for conv, kept in damage(rows).items():
        faults, seen = [], set()
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        initials = [r[:1] for _, r, _ in kept]
        cost, audit, made = cheapest(faults, kept)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def answers(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    found = cv.digests(cv.repair(cv.damaged(df), **sizes))
    return sorted((tuple(r) for r in found.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    random.seed(3)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", "Done. \x0b", "a. b"]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", None]
    made = [(c, t, random.choice(roles), random.choice(texts)) for c in range(60) for t in random.sample(range(9), random.randint(1, 3))]
    made += [(70, None, "user", "Hi."), (70, None, "assistant", None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (None, None, None, None)]
    return [*made, (71, 5, "user", "Same."), (71, 5, "user", "Same."), (71, 5, "assistant", "Same."), (71, -3, "user", "é　")]


@pytest.fixture(scope="module")
def expected(rows):
    return brute(rows)


@pytest.mark.parametrize("sizes", [{}, {"piece_turns": 1}, {"piece_turns": 2}, {"piece_bytes": 1}])
def test_repair_equals_a_search_over_all_edits(spark, rows, expected, sizes):
    assert answers(spark, rows, **sizes) == expected


def test_long_conversations_in_pieces_equal_one_pass(spark):
    random.seed(4)
    rows = [(c, t, random.choice(["user", "user", "assistant", "system"]), random.choice(["Yes.", "so", f"Turn {t}.", f"{t}!"])) for c in range(3) for t in range(700)]
    rows += [(9, 4, "user", "Copy.")] * 500
    whole = {}
    for conv, kept in damage(rows).items():
        seen, turns = set(), []
        for turn, role, text in kept:
            bare = text.strip(cv.SPACE)
            turns.append(cv.Turn(turn, role, text, 1, not bare, bool(bare) and bare[-1] not in ".!?", (role, text) in seen))
            seen.add((role, text))
        whole[conv] = cv.cheapest(cv.passed(turns))
    for sizes in ({}, {"piece_turns": 5}, {"piece_turns": 64}):
        assert {r[0]: (r[6], r[7]) for r in answers(spark, rows, **sizes)} == whole


def test_repaired_turns_follow_the_grammar(spark):
    df = queries.table(spark, "/root/testdata/sf0.001", "conversations")
    for row in cv.repair(cv.damaged(df), piece_turns=10_000).where("not pieces").collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][:1] for t in row["repaired"]))


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert answers(spark, []) == [] and cv.repair(cv.damaged(df)).count() == 0

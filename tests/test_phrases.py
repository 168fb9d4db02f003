"""Phrases by index against literal predicates, on the default profile."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tenderloom.functions.profile import DEFAULT, Capability, Profile
from tenderloom.operators import scoring

COLUMNS = "id int, title string, description string, category string, agency string, doc_text string, naics_code string, source_state string, estimated_value double, due_date timestamp"


def test_index_scores_as_predicates_do(spark):
    random.seed(12)
    words = [t.phrase for t in scoring.profile_terms(DEFAULT)]
    noise = ["the", "support", "ticket", "sai", "Ai", "ai", "rpax", "C#", "(.NET)", "8(a)", "soc", "K", "İt support", "TIER 2", "call center", "\n", "virginia", "Virginian", ""]

    def text(n):
        parts = [random.choice([random.choice(words), random.choice(words).lower(), random.choice(words).upper(), random.choice(noise), random.choice(words) + "s"]) for _ in range(random.randint(0, n))]
        return random.choice([" ", ", ", "-", ""]).join(parts)

    now = datetime(2026, 7, 1)
    rows = [(i, text(6), text(12), random.choice([None, text(2)]), random.choice([None, text(2), "DOT", "Department of Defense"]), random.choice([None, text(20)]), random.choice([None, "541512", "99"]), random.choice([None, "VA", "ZZ"]), random.choice([None, 5e4, 2e6]), random.choice([None, now + timedelta(days=random.randint(0, 90))])) for i in range(300)]
    rows += [(900, None, None, None, None, None, None, None, None, None), (901, "", "", "", "", "", "", "", 0.0, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    plain, fast = (sorted(map(str, scoring.score(df, DEFAULT, F.lit(now), by_index=how).collect())) for how in (False, True))
    assert plain == fast and len({r["bucket"] for r in scoring.score(df, DEFAULT, F.lit(now), by_index=True).collect()}) > 2


def test_plan_does_not_grow_with_the_phrases(spark):
    df = spark.createDataFrame([(1, "a")], "id int, title string")
    size = lambda n: len(scoring.score(df, Profile(capabilities=(Capability("c", "C", 5, tuple(f"phrase {i}" for i in range(n))),)), F.current_timestamp(), by_index=True)._jdf.queryExecution().optimizedPlan().toString())
    assert size(400) < 1.05 * size(4)

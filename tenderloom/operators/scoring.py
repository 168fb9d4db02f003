"""The rule engine: opportunities and a profile to score, bucket, urgency and an explained breakdown.

Every rule family is an array of its matches, built from literal predicates,
so a whole profile is two projections over a scan: one that finds phrases and
one that adds up points.  Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import found, found_capability, hits, needs_support
from ..functions.phrases import Term, find
from ..functions.profile import Profile

ENTRY = "struct<criterion:string,points:int,matched:array<string>,note:string>"
INPUTS = {
    "title": "string", "description": "string", "category": "string", "agency": "string", "doc_text": "string", "naics_code": "string",
    "source_state": "string", "estimated_value": "double", "due_date": "timestamp",
}


def entry(criterion: Column | str, points: Column | int, matched: Column, note: Column | str | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(criterion).alias("criterion"), as_column(points).cast("int").alias("points"), matched.alias("matched"), as_column(note).cast("string").alias("note"))


def joined(*parts: Column) -> Column:
    """Non-empty parts, a line each."""
    return F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts))


def urgency(due: Column, as_of: Column, profile: Profile) -> Column:
    """Band of the whole UTC days from as_of to due."""
    days = F.date_diff(due.cast("date"), as_of.cast("date"))
    return (
        F.when(due.isNull(), "NO_DATE").when(days < profile.min_days, "INSUFFICIENT_TIME")
        .when(days <= profile.urgent_max, "URGENT").when(days <= profile.standard_max, "STANDARD").otherwise("EARLY_CAPTURE")
    )


def bucket(score: Column, excluded: Column, profile: Profile) -> Column:
    return (
        F.when(excluded.isNotNull(), "IGNORE").when(score >= profile.pursue, "PURSUE")
        .when(score >= profile.capture_review, "CAPTURE_REVIEW").when(score >= profile.manual_review, "MANUAL_REVIEW").otherwise("IGNORE")
    )


def _some(condition: Column, value: Column) -> Column:
    """An array with the value, or an empty one."""
    return F.when(condition, F.array(value)).otherwise(F.array().cast(f"array<{ENTRY}>"))


def profile_terms(profile: Profile) -> list[Term]:
    """Every phrase of a profile, with its family; the text is field 0, agency and title 1, the kind of solicitation 2."""
    terms = []
    for c in profile.capabilities:
        family = f"cap_{c.key}"
        terms += [Term(family, p, p, 0, needs_support(p)) for p in c.phrases]
        terms += [Term(family, f"{p} (labor category)", p) for p, g in profile.labor if g == c.key]
        terms += [Term(family, f"{p} (technology)", p) for p, g in profile.technologies if g == c.key]
    for family, phrases in (("functional", profile.functional), ("schedule", profile.schedule_terms), ("vehicle", profile.vehicle_terms)):
        terms += [Term(family, p, p) for p in phrases]
    terms += [Term("solicitation", p, p, 2) for p, _ in profile.solicitations]
    terms += [Term(f"tier_{i}", p, p) for i, (_, _, phrases) in enumerate(profile.set_asides) for p in phrases]
    terms += [Term(f"fed_{i}", p, p, 1) for i, g in enumerate(profile.federal) for p in (g.name, *g.aliases)]
    terms += [Term("state", name, name, 1) for name, _ in profile.states]
    return terms + [Term(f"excl_{i}", p, p) for i, (_, phrases) in enumerate(profile.exclusions) for p in phrases]


def score(df: DataFrame, profile: Profile, as_of: Column, by_index: bool = False) -> DataFrame:
    """Adds pursuit_score, bucket, urgency, breakdown, set_asides, contract_vehicle, solicitation_type, agency_priority, excluded_reason.

    Phrases are found by literal predicates, which suits a few; ``by_index``
    finds all of a large profile in one pass, with the same result.
    Missing input columns count as null; existing output columns are replaced.
    """
    outputs = ["pursuit_score", "bucket", "urgency", "breakdown", "set_asides", "contract_vehicle", "solicitation_type", "agency_priority", "excluded_reason"]
    df = df.drop(*outputs)
    get = {c: F.col(c) if c in df.columns else F.lit(None).cast(t) for c, t in INPUTS.items()}
    text = joined(get["title"], get["description"], get["category"], F.substring(get["doc_text"], 1, 30_000))
    kind_text = F.concat_ws("\n", get["title"], F.coalesce(get["category"], F.lit("")), F.substring(F.coalesce(get["description"], F.lit("")), 1, 400))
    # the array keeps the optimizer from putting the texts' expressions into every predicate
    df = df.withColumn("_t", F.explode(F.array(F.struct(text.alias("t"), joined(get["agency"], get["title"]).alias("a"), kind_text.alias("k")))))
    df = df.withColumn("_x", F.explode(F.array(F.struct("_t.t", "_t.a", "_t.k", F.lower("_t.t").alias("tl"), F.lower("_t.a").alias("al"), F.lower("_t.k").alias("kl"))))).drop("_t")
    t, tl, a, al, k, kl = (F.col(f"_x.{n}") for n in ("t", "tl", "a", "al", "k", "kl"))
    terms = profile_terms(profile)
    families = {}
    if by_index:
        df = df.withColumn("_m", find(terms, t, a, k))
        for name in dict.fromkeys(x.family for x in terms):
            families[name] = F.coalesce(F.try_element_at("_m", F.lit(name)), F.array().cast("array<string>"))
        here = lambda name: F.array_contains(families["state"], name)
    else:
        fields = ((t, tl), (a, al), (k, kl))
        for x in terms:
            families.setdefault(x.family, []).append((x.label, (found_capability if x.support else found)(x.phrase, *fields[x.field])))
        here = dict(families.get("state", ())).get
        families = {name: hits(rows) for name, rows in families.items()}
    families |= {n: F.array_distinct(c) for n, c in families.items() if n.startswith("cap_")}
    families["state"] = hits([(name, F.coalesce(get["source_state"] == code, F.lit(False)) | here(name)) for name, code in profile.states])
    for name in (*(f"cap_{c.key}" for c in profile.capabilities), "functional", "schedule", "vehicle", "solicitation", *(f"tier_{i}" for i in range(len(profile.set_asides))), *(f"fed_{i}" for i in range(len(profile.federal))), *(f"excl_{i}" for i in range(len(profile.exclusions)))):
        families.setdefault(name, F.array().cast("array<string>"))
    df = df.withColumn("_f", F.explode(F.array(F.struct(*(v.alias(n) for n, v in families.items()))))).drop("_x", "_m")

    has = lambda n: F.size(F.col(f"_f.{n}")) > 0
    first = lambda n: F.get(F.col(f"_f.{n}"), F.lit(0))
    only = lambda n: F.array(first(n))
    capability = sum((F.when(has(f"cap_{c.key}"), c.points).otherwise(0) for c in profile.capabilities), F.lit(0))
    parts = [_some(has(f"cap_{c.key}"), entry(c.label, c.points, F.slice(F.col(f"_f.cap_{c.key}"), 1, 8))) for c in profile.capabilities]
    parts.append(_some(has("functional"), entry("Functional area", profile.functional_points, F.slice(F.col("_f.functional"), 1, 6))))
    parts.append(F.when(has("schedule"), F.array(entry("GSA MAS", profile.schedule_points, only("schedule")))).otherwise(_some(has("vehicle"), entry("Contract vehicle", profile.vehicle_points, only("vehicle")))))
    for term, points in profile.solicitations:
        if points:
            parts.append(_some(F.coalesce(first("solicitation") == term, F.lit(False)), entry(f"Solicitation type: {term}", points, F.array(F.lit(term)))))
    earlier, tiers = F.lit(False), []
    for i, (label, points, _) in enumerate(profile.set_asides):
        fires = has(f"tier_{i}") & ~earlier if label == profile.general_label else has(f"tier_{i}")
        parts.append(_some(fires, entry(label, points, only(f"tier_{i}"))))
        tiers.append((label, fires))
        earlier = earlier | has(f"tier_{i}")
    # agencies in order: an IT-only one without a capability leaves a note and the search goes on
    federal = F.lit(False)
    for i, g in enumerate(profile.federal):
        counts = has(f"fed_{i}") & (capability > 0) if g.it_only else has(f"fed_{i}")
        if g.it_only:
            parts.append(_some(has(f"fed_{i}") & (capability == 0) & ~federal, entry(f"Agency: {g.name}", 0, only(f"fed_{i}"), "counts only with an IT capability match; none matched")))
        parts.append(_some(counts & ~federal, entry(f"Federal agency: {g.name}", profile.federal_points, only(f"fed_{i}"))))
        federal = federal | counts
    state = ~federal & has("state")
    parts.append(_some(state, entry(F.concat(F.lit("State government: "), first("state")), profile.state_points, only("state"))))
    naics = get["naics_code"]
    aligned = F.coalesce(F.array_contains(F.transform(F.array(*map(F.lit, profile.naics)), lambda c: F.startswith(naics, c)), True), F.lit(False)) if profile.naics else F.lit(False)
    parts.append(_some(aligned, entry("NAICS alignment", profile.naics_points, F.array(naics))))
    value, past = get["estimated_value"], F.lit(False)
    for most, points, label in profile.value_bands:
        here = (value > 0) & ~past & (value < most if most is not None else F.lit(True))
        if points:
            parts.append(_some(F.coalesce(here, F.lit(False)), entry(f"Estimated value {label}", points, F.array(F.concat(F.lit("$"), F.format_number(value, 0))))))
        past = past | (F.coalesce(value < most, F.lit(False)) if most is not None else F.lit(True))
    reason, stopped = F.lit(None).cast("string"), F.lit(False)
    for i, (group, _) in enumerate(profile.exclusions):
        kept = capability >= profile.override_points
        parts.append(_some(has(f"excl_{i}") & kept, entry(f"Exclusion overridden ({group})", 0, only(f"excl_{i}"), "excluded wording, but a technical capability matched too")))
        stops = has(f"excl_{i}") & ~kept & ~stopped
        parts.append(_some(stops, entry(f"Excluded: {group}", 0, only(f"excl_{i}"), "no technical capability matched")))
        reason = F.when(stops, F.concat(first(f"excl_{i}"), F.lit(f" ({group})"))).otherwise(reason)
        stopped = stopped | (has(f"excl_{i}") & ~kept)

    df = df.withColumns({
        "breakdown": F.concat(*parts),
        "set_asides": hits(tiers),
        "contract_vehicle": F.when(has("schedule"), F.lit("GSA MAS")).otherwise(first("vehicle")),
        "solicitation_type": first("solicitation"),
        "agency_priority": federal | state,
        "excluded_reason": reason,
        "urgency": urgency(get["due_date"], as_of, profile),
    }).drop("_f")
    df = df.withColumn("pursuit_score", F.aggregate("breakdown", F.lit(0), lambda n, e: n + e["points"]))
    return df.withColumn("bucket", bucket(F.col("pursuit_score"), F.col("excluded_reason"), profile))


def relevance_reason(breakdown: Column, excluded: Column) -> Column:
    """The four first positive criteria with their points, or why it is excluded."""
    top = F.slice(F.filter(breakdown, lambda e: e["points"] > 0), 1, 4)
    said = F.array_join(F.transform(top, lambda e: F.concat(e["criterion"], F.lit(" +"), e["points"].cast("string"))), " · ")
    return F.when(excluded.isNotNull(), F.concat(F.lit("Excluded: "), excluded)).when(F.size(top) > 0, said).otherwise("No targeting criteria matched")


def promote(df: DataFrame, recommendation: str = "bid_recommendation", relevance: str = "relevance_score") -> DataFrame:
    """Raises low buckets that an analyst's verdict recommends, and flags top ones that it advises against."""
    up = (F.col(recommendation) == "BID") & F.col("excluded_reason").isNull() & F.col("bucket").isin("MANUAL_REVIEW", "IGNORE")
    to = F.when(F.col(relevance) >= 90, "PURSUE").otherwise("CAPTURE_REVIEW")
    disagrees = (F.col("bucket") == "PURSUE") & (F.col(recommendation) == "NO_BID")
    return df.withColumn("promoted", F.coalesce(up, F.lit(False))).withColumn("disagreement", F.coalesce(disagrees, F.lit(False))).withColumn("bucket", F.when(up, to).otherwise(F.col("bucket")))


def fallback_recommendation(relevance: Column) -> Column:
    return F.when(relevance.isNull(), "REVIEW").when(relevance >= 70, "BID").when(relevance >= 40, "REVIEW").otherwise("NO_BID")


def relevance_label(relevance: Column) -> Column:
    return F.when(relevance.isNull(), "Unscored").when(relevance >= 70, "Strong fit").when(relevance >= 40, "Possible").otherwise("Low fit")


def keyword_relevance(matches: Column, naics_match: Column) -> Column:
    """The older score by number of keyword matches: 22 each up to 100, at least 35 with any, else 8; an industry match lifts it to 85."""
    base = F.when(matches > 0, F.greatest(F.least(F.lit(100), 22 * matches), F.lit(35))).otherwise(8)
    return F.when(naics_match, F.greatest(base, F.lit(85))).otherwise(base)

"""All registered queries of the library and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import portal_queries
from .functions import phrases
from .functions import scalars as fn
from .functions.matching import sql_condition
from .functions.profile import DEFAULT, Agency, Capability, Profile
from .operators import cdc, drafting, ordering, relevance, reminders, retrieval, scoring, workflow
from .operators import lists as vector_lists
from .operators.numbering import batches
from .plans import metrics, serving
from .plans.serving import Filters, default_view
from .plans.views import AS_OF, Views, with_views
from .sources import markup, tables
from .sources.tables import new_folder
from .streaming.store import Store, apply, committed, counts, create, state
from .streaming.store import table as output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A profile whose words occur in the test data.
PROFILE = Profile(
    capabilities=(
        Capability("metal", "Metal", 10, ("bolt", "steel", "ring")), Capability("promo", "Promo", 40, ("PROMO", "blue")), Capability("large", "Large", 30, ("LARGE", "small ring", "gear")),
        Capability("economy", "Economy", 6, ("ECONOMY",)),
    ),
    labor=(("red", "metal"),), technologies=(("nut", "large"),), functional=("Supply of", "green"), schedule_terms=("GSA MAS",), vehicle_terms=("BPA", "Task Order"),
    solicitations=(("RFQ", 2), ("RFP", 2)), set_asides=(("Small Business Set-Aside", 8, ("Total Small Business",)), ("Small Business (general)", 2, ("Small Business",))),
    federal=(Agency("Customer#000000001"), Agency("MACHINERY", it_only=True)), states=(("AMERICA", "AMERICA"), ("ASIA", "ASIA")),
    exclusions=(("Furniture", ("FURNITURE",)), ("Household", ("HOUSEHOLD", "washer"))), naics=("541511", "541512"),
    value_bands=((25_000, -2, "< $25k"), (100_000, 0, "$25k-$100k"), (300_000, 2, "$100k-$300k"), (None, 3, "> $300k")),
)


def query(name: str, sql: str | None = None, *views: str):
    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
        if sql is not None:
            # count_if gives 128-bit integers there
            text = re.sub(r"count_if\(", "count(*) FILTER (", sql)
            ORACLES[name] = with_views(text, *views) if views else text
        return build

    return register


O, S = "opportunities", "sources"
T = f"TIMESTAMP '{AS_OF}'"
OPEN_SQL = "('NEW','OPEN','AMENDED','CLOSING_SOON')"
SOURCE_SQL = "s.name AS source_name, s.slug AS source_slug, s.state AS state"


def list_sql(where: str, order: str, limit: int) -> str:
    return f"""SELECT o.id, source_name, source_slug, state, rank FROM (
        SELECT o.*, {SOURCE_SQL}, CAST(row_number() OVER (ORDER BY {order}, o.id) AS INTEGER) AS rank FROM opportunities o LEFT JOIN sources s ON s.id = o.source_id WHERE {where}) o WHERE rank <= {limit}"""


def lists(name: str, f: Filters, where: str, order: str) -> None:
    QUERIES[name] = lambda spark, folder: (lambda v: serving.listing(v.opportunities, v.sources, f, v.as_of).select("id", "source_name", "source_slug", "state", "rank"))(Views(spark, folder))
    ORACLES[name] = with_views(list_sql(where, order, f.limit), O, S)


DUE, SCORE, NEWEST, RELEVANCE = "due_date ASC NULLS LAST", "pursuit_score DESC NULLS LAST", "first_seen_at DESC NULLS FIRST", "relevance_score DESC NULLS LAST"
lists("list_actionable", default_view(), f"pursuit_bucket IN ('PURSUE','CAPTURE_REVIEW') AND due_date >= {T} + INTERVAL 10 DAY", SCORE)
lists("list_search", Filters(search="blue, 100%", sort="relevance"), "(title ILIKE '%blue  100 %' OR agency ILIKE '%blue  100 %' OR external_id ILIKE '%blue  100 %')".replace("100 %", "100%"), RELEVANCE)
lists("list_search_title", Filters(search="gear", sort="relevance"), "lower(title) LIKE '%gear%' OR lower(agency) LIKE '%gear%' OR lower(external_id) LIKE '%gear%'", RELEVANCE)
lists("list_search_cleaned", Filters(search="%promo,hot", sort="relevance"), "lower(title) LIKE '%promo hot%' OR lower(agency) LIKE '%promo hot%' OR lower(external_id) LIKE '%promo hot%'", RELEVANCE)
lists("list_search_id", Filters(search="OPP-12", sort="newest"), "(title ILIKE '%OPP-12%' OR agency ILIKE '%OPP-12%' OR external_id ILIKE '%OPP-12%')", NEWEST)
lists("list_assigned_standard", Filters(assigned_to=7, urgency="STANDARD"), "assigned_to = 7 AND urgency = 'STANDARD'", NEWEST)
lists("list_state_setaside", Filters(state="ASIA", set_aside="WOSB", sort="due"), "s.state = 'ASIA' AND set_aside_list LIKE 'WOSB%'", DUE)
lists("list_any_setaside_vehicle", Filters(set_aside="ANY", vehicle="ANY", relevance_min=40), "set_aside_list <> '' AND contract_vehicle IS NOT NULL AND relevance_score >= 40", NEWEST)
lists("list_due_window", Filters(open_only=True, due_from=datetime(1998, 8, 2), due_before=datetime(1998, 8, 9), sort="due", limit=8), f"status IN {OPEN_SQL} AND due_date >= {T} AND due_date <= {T} + INTERVAL 7 DAY", DUE)
lists("list_new", Filters(status="NEW", limit=8), "status = 'NEW'", NEWEST)
lists("list_no_time", Filters(bucket="INSUFFICIENT_TIME", stage="BACKLOG", sort="score"), "urgency = 'INSUFFICIENT_TIME' AND pipeline_stage = 'BACKLOG'", SCORE)
lists("list_assigned", Filters(assigned_to=7, source_id=3, urgency="URGENT", vehicle="GSA MAS"), "assigned_to = 7 AND source_id = 3 AND urgency = 'URGENT' AND contract_vehicle = 'GSA MAS'", NEWEST)


@query("list_unscored", """SELECT id, rank FROM (SELECT id, CAST(row_number() OVER (ORDER BY first_seen_at DESC NULLS FIRST, id) AS INTEGER) AS rank FROM opportunities WHERE pursuit_bucket IS NULL) WHERE rank <= 200""", O)
def _(v):
    top = v.opportunities.where("pursuit_bucket is null").select("id", "first_seen_at").orderBy(F.desc_nulls_first("first_seen_at"), "id").limit(200)
    return top.select("id", F.expr("row_number() over (order by first_seen_at desc nulls first, id)").alias("rank"))


@query("embedded_counts", """SELECT o.id, o.assigned_to, coalesce(responses, 0) AS responses, coalesce(attachments, 0) AS attachments, coalesce(versions, 0) AS versions FROM opportunities o LEFT JOIN (
    SELECT opportunity_id, count(*) FILTER (kind = 'response') AS responses, count(*) FILTER (kind = 'attachment') AS attachments, count(*) FILTER (kind = 'version') AS versions FROM children GROUP BY 1) c ON o.id = c.opportunity_id""", O, "children")
def _(v):
    return serving.embedded_counts(v.opportunities, v.children)


STAGE_CASE = "CASE pipeline_stage " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(serving.STAGES)) + " END"


@query("board", f"""SELECT pipeline_stage AS stage, CAST({STAGE_CASE} AS INTEGER) AS stage_rank, CAST(row_number() OVER (PARTITION BY pipeline_stage ORDER BY due_date ASC NULLS LAST, id) AS INTEGER) AS position, id
    FROM (SELECT * FROM opportunities ORDER BY due_date ASC NULLS LAST, id LIMIT 500)""", O)
def _(v):
    return serving.board(v.opportunities)


@query("stalest_first", "SELECT id, name, last_success_at, CAST(row_number() OVER (ORDER BY last_success_at ASC NULLS FIRST, name) AS INTEGER) AS turn FROM sources WHERE is_active", S)
def _(v):
    return serving.stalest_first(v.sources)


@query("connector_status", "SELECT id, connector_key, CASE WHEN connector_key IN ('sam','tx','mo') THEN 'active' ELSE 'needs_connector' END AS status FROM sources", S)
def _(v):
    return serving.connector_status(v.sources, ("sam", "tx", "mo"))


@query("dashboard_stats", f"""SELECT count(*) AS total, count_if(o) AS total_open, count_if(status = 'NEW') AS new_count, count_if(status = 'AMENDED') AS amended, count_if(status = 'NEW' AND coalesce(relevance_score, 0) >= 70) AS relevant_new,
    count_if(pipeline_stage = 'SUBMITTED') AS submitted, count_if(pipeline_stage = 'WON') AS won, count_if(a AND pursuit_bucket = 'PURSUE') AS pursue_now, count_if(a AND pursuit_bucket = 'CAPTURE_REVIEW') AS capture_review,
    count_if(a AND pursuit_bucket = 'PURSUE' AND first_seen_at >= {T} - INTERVAL 1 DAY) AS new_pursue, count_if(o AND due_date BETWEEN {T} AND {T} + INTERVAL 7 DAY) AS closing_soon,
    CAST(coalesce(sum(CAST(estimated_value AS DECIMAL(18,2))) FILTER (o AND estimated_value <> 0), 0) AS DOUBLE) AS pipeline_value
    FROM (SELECT *, status IN {OPEN_SQL} AS o, status IN {OPEN_SQL} AND urgency IS DISTINCT FROM 'INSUFFICIENT_TIME' AS a FROM opportunities)""", O)
def _(v):
    return metrics.dashboard(v.opportunities, v.as_of)


def spine_sql(name: str, values: tuple[str, ...], rows: str) -> str:
    return f"""SELECT {name}, CAST(rank AS INTEGER) AS rank, coalesce(n, 0) AS n FROM (VALUES {', '.join(f"('{v}', {i})" for i, v in enumerate(values))}) x({name}, rank) LEFT JOIN (SELECT {name}, count(*) AS n FROM ({rows}) GROUP BY 1) USING ({name})"""


@query("urgency_distribution", spine_sql("urgency", metrics.BANDS, f"SELECT urgency FROM opportunities WHERE status IN {OPEN_SQL}"), O)
def _(v):
    return metrics.urgency_distribution(v.opportunities)


@query("stage_counts", spine_sql("pipeline_stage", serving.STAGES, "SELECT pipeline_stage FROM opportunities"), O)
def _(v):
    return metrics.stage_counts(v.opportunities)


@query("score_histogram", spine_sql("band", metrics.HISTOGRAM, """SELECT CASE WHEN relevance_score < 10 THEN '0-9' WHEN relevance_score < 20 THEN '10-19' WHEN relevance_score < 40 THEN '20-39'
    WHEN relevance_score < 60 THEN '40-59' WHEN relevance_score < 80 THEN '60-79' ELSE '80+' END AS band FROM opportunities WHERE relevance_score IS NOT NULL"""), O)
def _(v):
    return metrics.score_histogram(v.opportunities)


@query("by_state", f"SELECT s.state, count(*) AS total, count_if(status IN {OPEN_SQL}) AS open FROM opportunities o JOIN sources s ON s.id = o.source_id WHERE s.state <> '' GROUP BY 1", O, S)
def _(v):
    return metrics.by_state(v.opportunities, v.sources)


HALF = "CAST(floor({} + 0.5) AS BIGINT)"


@query("win_rate", f"""SELECT {HALF.format("count_if(pipeline_stage = 'WON') * 100.0 / nullif(count_if(pipeline_stage IN ('WON', 'LOST')), 0)")} AS win_rate, {HALF.format('avg(relevance_score)')} AS avg_relevance FROM opportunities""", O)
def _(v):
    return metrics.win_rate(v.opportunities)


@query("win_by_bucket", f"""SELECT pursuit_bucket, won, lost, submitted, {HALF.format('won * 100.0 / nullif(won + lost, 0)')} AS rate FROM (SELECT pursuit_bucket, count_if(pipeline_stage = 'WON') AS won, count_if(pipeline_stage = 'LOST') AS lost,
    count_if(pipeline_stage = 'SUBMITTED') AS submitted FROM opportunities WHERE pipeline_stage IN ('WON','LOST','SUBMITTED') AND pursuit_bucket IS NOT NULL GROUP BY 1)""", O)
def _(v):
    return metrics.win_by_bucket(v.opportunities)


def bucket_counts_sql(bucket: str) -> str:
    return f"""SELECT coalesce(nullif(s.state, ''), s.name, 'Other') AS place, {', '.join(f"count_if({bucket} = '{b}') AS {b.lower()}" for b in metrics.BUCKETS)} FROM opportunities o LEFT JOIN sources s ON s.id = o.source_id GROUP BY 1"""


@query("stored_bucket_by_source", bucket_counts_sql("pursuit_bucket"), O, S)
def _(v):
    return metrics.bucket_by_source(v.opportunities, v.sources)


@query("exclusions_by_group", r"SELECT coalesce(nullif(regexp_extract(excluded_reason, '\(([^)]+)\)\s*$', 1), ''), 'Other') AS exclusion, count(*) AS n FROM opportunities WHERE excluded_reason IS NOT NULL GROUP BY 1", O)
def _(v):
    return metrics.exclusions_by_group(v.opportunities)


@query("source_health", f"""SELECT s.id, s.name, coalesce(total, 0) AS total, coalesce(open, 0) AS open, coalesce(new, 0) AS new FROM sources s LEFT JOIN (
    SELECT source_id, count(*) AS total, count_if(status IN {OPEN_SQL}) AS open, count_if(status = 'NEW') AS new FROM opportunities GROUP BY 1) o ON o.source_id = s.id""", O, S)
def _(v):
    return metrics.source_health(v.opportunities, v.sources)


@query("latest_run", "SELECT source_id, id AS run_id, started_at, status, new_count FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS n FROM runs) WHERE n = 1", "runs")
def _(v):
    return metrics.latest_runs(v.runs)


@query("crawl_success", f"SELECT count(*) AS crawls, {HALF.format('''count_if(status IN ('success','partial')) * 100.0 / count(*)''')} AS success_rate FROM (SELECT * FROM runs ORDER BY started_at DESC, id DESC LIMIT 200)", "runs")
def _(v):
    return metrics.crawl_success(v.runs)


@query("run_totals", "SELECT CAST(sum(new_count) AS BIGINT) AS new_total, CAST(sum(changed_count) AS BIGINT) AS changed_total, count_if(status = 'failed') AS failed FROM runs", "runs")
def _(v):
    return metrics.run_totals(v.runs)


@query("mode_usage", "SELECT mode, count(*) AS n FROM responses GROUP BY 1", "responses")
def _(v):
    return metrics.mode_usage(v.responses)


@query("latest_response_per_mode", "SELECT opportunity_id, mode, max(turn) AS turn FROM responses GROUP BY 1, 2", "responses")
def _(v):
    return metrics.latest_responses(v.responses)


@query("response_revisions", "SELECT opportunity_id, count(*) AS revisions, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn DESC) AS newest_first FROM responses GROUP BY 1", "responses")
def _(v):
    return v.responses.groupBy("opportunity_id").agg(F.count("*").alias("revisions"), F.array_join(F.sort_array(F.collect_list("turn"), asc=False).cast("array<string>"), ",").alias("newest_first"))


# --- scoring -----------------------------------------------------------------------------------


def scored(v: Views, *columns: str) -> DataFrame:
    rows = v.opportunities.drop("urgency")
    rows = rows.join(F.broadcast(v.sources.select(F.col("id").alias("source_id"), F.col("state").alias("source_state"))), "source_id", "left")  # a row for each source
    return scoring.score(rows, PROFILE, v.as_of).select(*columns) if columns else scoring.score(rows, PROFILE, v.as_of)


#: Every phrase of the default profile that is searched for in the text.
DEFAULT_PHRASES = [(t.family, t.label, t.phrase) for t in scoring.profile_terms(DEFAULT) if t.field == 0 and not t.support]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("phrases_default", f"""SELECT id, array_to_string(hits, '|') AS hits, CAST(len(hits) AS BIGINT) AS n FROM (SELECT id, list_sort(list_filter([{', '.join(f"CASE WHEN {sql_condition(p, 't')} THEN {_quoted(f'{family}:{label}')} END" for family, label, p in DEFAULT_PHRASES)}], lambda x: x IS NOT NULL)) AS hits
    FROM (SELECT id, title || ' ' || p[id % len(p) + 1] || CASE WHEN id % 3 = 0 THEN 'x for ' ELSE ', ' END || lower(p[id * 7 % len(p) + 1]) AS t FROM (SELECT id, title, [{', '.join(_quoted(p) for _, _, p in DEFAULT_PHRASES)}] AS p FROM opportunities)))""", O)
def _(v):
    """Phrases of the default profile in titles, whole, in lower case and with a letter behind them."""
    known = F.array(*(F.lit(p) for _, _, p in DEFAULT_PHRASES))
    size = len(DEFAULT_PHRASES)
    text = F.concat("title", F.lit(" "), F.get(known, (F.col("id") % size).cast("int")), F.when(F.col("id") % 3 == 0, "x for ").otherwise(", "), F.lower(F.get(known, (F.col("id") * 7 % size).cast("int"))))
    found = phrases.find([t for t in scoring.profile_terms(DEFAULT) if t.field == 0 and not t.support], text, F.lit(None).cast("string"), F.lit(None).cast("string"))
    entries = F.flatten(F.transform(F.map_entries("m"), lambda e: F.transform(e["value"], lambda x: F.concat(e["key"], F.lit(":"), x))))
    return v.opportunities.select("id", found.alias("m")).select("id", F.array_sort(entries).alias("l")).select("id", F.array_join("l", "|").alias("hits"), F.size("l").cast("bigint").alias("n"))


def _hit(phrases, text: str) -> str:
    return "(" + " OR ".join(sql_condition(p, text) for p in phrases) + ")"


def _first(phrases, text: str) -> str:
    return "CASE " + " ".join(f"WHEN {sql_condition(p, text)} THEN '{p}'" for p in phrases) + " END"


def score_sql(select: str) -> str:
    p = PROFILE
    groups = {c.key: [*c.phrases, *(t for t, g in (*p.labor, *p.technologies) if g == c.key)] for c in p.capabilities}
    caps = " + ".join(f"CASE WHEN {_hit(groups[c.key], 't')} THEN {c.points} ELSE 0 END" for c in p.capabilities)
    total, general = p.set_asides
    state = " ".join(f"WHEN coalesce(source_state = '{code}', false) OR {sql_condition(n, 'a')} THEN '{n}'" for n, code in p.states)
    aligned = " OR ".join(f"naics_code LIKE '{c}%'" for c in p.naics)
    return f"""WITH base AS (SELECT o.*, s.state AS source_state, concat_ws(chr(10), nullif(title, ''), nullif(description, ''), nullif(category, '')) AS t, concat_ws(chr(10), nullif(agency, ''), nullif(title, '')) AS a,
            concat_ws(chr(10), title, coalesce(category, ''), substr(coalesce(description, ''), 1, 400)) AS k FROM opportunities o LEFT JOIN sources s ON s.id = o.source_id),
        f AS (SELECT *, {caps} AS capability, {_hit(p.functional, 't')} AS functional, {_first(p.schedule_terms, 't')} AS schedule, {_first(p.vehicle_terms, 't')} AS vehicle, {_first([x for x, _ in p.solicitations], 'k')} AS solicitation,
            {_hit(total[2], 't')} AS tier_a, {_hit(general[2], 't')} AS tier_b, {sql_condition(p.federal[0].name, 'a')} AS fed_a, {sql_condition(p.federal[1].name, 'a')} AS fed_b, CASE {state} END AS state_hit,
            {_first(p.exclusions[0][1], 't')} AS excl_a, {_first(p.exclusions[1][1], 't')} AS excl_b, coalesce({aligned}, false) AS aligned FROM base),
        g AS (SELECT *, fed_a OR (fed_b AND capability > 0) AS federal, CASE WHEN estimated_value > 0 THEN CASE WHEN estimated_value < 25000 THEN -2 WHEN estimated_value < 100000 THEN 0 WHEN estimated_value < 300000 THEN 2 ELSE 3 END ELSE 0 END AS band,
            CASE WHEN capability >= 7 THEN NULL WHEN excl_a IS NOT NULL THEN excl_a || ' (Furniture)' WHEN excl_b IS NOT NULL THEN excl_b || ' (Household)' END AS excluded, datediff('day', DATE '{AS_OF[:10]}', CAST(due_date AS DATE)) AS days FROM f),
        z AS (SELECT *, CAST(capability + CASE WHEN functional THEN 4 ELSE 0 END + CASE WHEN schedule IS NOT NULL THEN 6 WHEN vehicle IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN solicitation IS NOT NULL THEN 2 ELSE 0 END
            + CASE WHEN tier_a THEN 8 WHEN tier_b THEN 2 ELSE 0 END + CASE WHEN federal THEN 6 WHEN state_hit IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN aligned THEN 6 ELSE 0 END + band AS INTEGER) AS score,
            CASE WHEN due_date IS NULL THEN 'NO_DATE' WHEN days < 10 THEN 'INSUFFICIENT_TIME' WHEN days <= 20 THEN 'URGENT' WHEN days <= 45 THEN 'STANDARD' ELSE 'EARLY_CAPTURE' END AS band_now FROM g),
        y AS (SELECT *, CASE WHEN excluded IS NOT NULL THEN 'IGNORE' WHEN score >= 80 THEN 'PURSUE' WHEN score >= 60 THEN 'CAPTURE_REVIEW' WHEN score >= 40 THEN 'MANUAL_REVIEW' ELSE 'IGNORE' END AS bucket_now FROM z) {select}"""


@query("score_total_bucket", score_sql("SELECT id, score AS pursuit_score, bucket_now AS bucket, band_now AS urgency FROM y"), O, S)
def _(v):
    return scored(v, "id", "pursuit_score", "bucket", "urgency")


@query("score_vehicle_solicitation", score_sql("SELECT id, CASE WHEN schedule IS NOT NULL THEN 'GSA MAS' ELSE vehicle END AS contract_vehicle, solicitation AS solicitation_type FROM y"), O, S)
def _(v):
    return scored(v, "id", "contract_vehicle", "solicitation_type")


@query("score_setasides", score_sql("SELECT id, CASE WHEN tier_a THEN 'Small Business Set-Aside' WHEN tier_b THEN 'Small Business (general)' ELSE '' END AS tiers FROM y"), O, S)
def _(v):
    return scored(v).select("id", F.array_join("set_asides", "|").alias("tiers"))


@query("score_agency", score_sql("SELECT id, federal OR state_hit IS NOT NULL AS agency_priority FROM y"), O, S)
def _(v):
    return scored(v, "id", "agency_priority")


@query("score_exclusion", score_sql("SELECT id, excluded AS excluded_reason FROM y"), O, S)
def _(v):
    return scored(v, "id", "excluded_reason")


@query("score_capabilities", score_sql("SELECT id, CAST(capability AS INTEGER) AS capability FROM y"), O, S)
def _(v):
    labels = [c.label for c in PROFILE.capabilities]
    return scored(v).select("id", F.aggregate(F.filter("breakdown", lambda e: e["criterion"].isin(labels)), F.lit(0), lambda n, e: n + e["points"]).alias("capability"))


@query("score_naics_value", score_sql("SELECT id, CAST(CASE WHEN aligned THEN 6 ELSE 0 END + band AS INTEGER) AS points FROM y"), O, S)
def _(v):
    return scored(v).select("id", F.aggregate(F.filter("breakdown", lambda e: (e["criterion"] == "NAICS alignment") | F.startswith(e["criterion"], F.lit("Estimated"))), F.lit(0), lambda n, e: n + e["points"]).alias("points"))


def entries_sql() -> str:
    """The breakdown's entries in order, as a list of structs over the columns of ``y``."""
    p = PROFILE

    def entry(when: str, criterion: str, points: int, matched: str, note: str | None = None) -> str:
        told = f"'{note}'" if note else "CAST(NULL AS VARCHAR)"
        return f"CASE WHEN {when} THEN {{'criterion': {criterion}, 'points': CAST({points} AS INTEGER), 'matched': {matched}, 'note': {told}}} END"

    def all_of(phrases, most: int) -> str:
        labels = ", ".join(f"CASE WHEN {sql_condition(x, 't')} THEN '{label}' END" for x, label in phrases)
        return f"array_to_string(list_filter([{labels}], lambda x: x IS NOT NULL)[:{most}], '|')"

    out = []
    for c in p.capabilities:
        rows = [(x, x) for x in c.phrases] + [(x, f"{x} (labor category)") for x, g in p.labor if g == c.key] + [(x, f"{x} (technology)") for x, g in p.technologies if g == c.key]
        out.append(entry(_hit([x for x, _ in rows], "t"), f"'{c.label}'", c.points, all_of(rows, 8)))
    out.append(entry("functional", "'Functional area'", 4, all_of([(x, x) for x in p.functional], 6)))
    out.append(entry("schedule IS NOT NULL", "'GSA MAS'", 6, "schedule"))
    out.append(entry("schedule IS NULL AND vehicle IS NOT NULL", "'Contract vehicle'", 4, "vehicle"))
    out += [entry(f"solicitation = '{term}'", f"'Solicitation type: {term}'", n, f"'{term}'") for term, n in p.solicitations]
    (first, n, terms), (general, m, more) = p.set_asides
    out += [entry("tier_a", f"'{first}'", n, _first(terms, "t")), entry("tier_b AND NOT tier_a", f"'{general}'", m, _first(more, "t"))]
    plain, it_only = p.federal
    out.append(entry("fed_a", f"'Federal agency: {plain.name}'", 6, f"'{plain.name}'"))
    out.append(entry("fed_b AND capability = 0 AND NOT fed_a", f"'Agency: {it_only.name}'", 0, f"'{it_only.name}'", "counts only with an IT capability match; none matched"))
    out.append(entry("fed_b AND capability > 0 AND NOT fed_a", f"'Federal agency: {it_only.name}'", 6, f"'{it_only.name}'"))
    out.append(entry("NOT federal AND state_hit IS NOT NULL", "'State government: ' || state_hit", 5, "state_hit"))
    out.append(entry("aligned", "'NAICS alignment'", 6, "naics_code"))
    value, low = "'$' || format('{:,}', CAST(round_even(estimated_value, 0) AS BIGINT))", 0
    for most, n, label in p.value_bands:
        out += [entry(f"estimated_value > 0 AND estimated_value >= {low}" + (f" AND estimated_value < {most}" if most else ""), f"'Estimated value {label}'", n, value)] if n else []
        low = most
    stopped = "false"
    for (group, _), column in zip(p.exclusions, ("excl_a", "excl_b"), strict=True):
        out.append(entry(f"{column} IS NOT NULL AND capability >= 7", f"'Exclusion overridden ({group})'", 0, column, "excluded wording, but a technical capability matched too"))
        out.append(entry(f"{column} IS NOT NULL AND capability < 7 AND NOT {stopped}", f"'Excluded: {group}'", 0, column, "no technical capability matched"))
        stopped = f"({stopped} OR {column} IS NOT NULL)"
    return f"list_filter([{', '.join(out)}], lambda e: e IS NOT NULL)"


@query("relevance_reasons", score_sql(f"""SELECT id, CASE WHEN excluded IS NOT NULL THEN 'Excluded: ' || excluded WHEN len(top) > 0 THEN array_to_string(list_transform(top, lambda e: e.criterion || ' +' || CAST(e.points AS VARCHAR)), ' · ') ELSE 'No targeting criteria matched' END AS reason
    FROM (SELECT id, excluded, list_filter({entries_sql()}, lambda e: e.points > 0)[:4] AS top FROM y)"""), O, S)
def _(v):
    return scored(v).select("id", scoring.relevance_reason(F.col("breakdown"), F.col("excluded_reason")).alias("reason"))


@query("score_breakdown", score_sql(f"""SELECT id, CAST(position AS INTEGER) AS position, e.criterion AS criterion, e.points AS points, e.matched AS matched, e.note AS note
    FROM (SELECT id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS position FROM (SELECT id, {entries_sql()} AS l FROM y))"""), O, S)
def _(v):
    return scored(v).select("id", F.posexplode("breakdown").alias("position", "e")).select("id", "position", "e.criterion", "e.points", F.array_join("e.matched", "|").alias("matched"), "e.note")


@query("bucket_by_source", score_sql(bucket_counts_sql("bucket_now").replace("FROM opportunities o", "FROM y o")), O, S)
def _(v):
    return metrics.bucket_by_source(scored(v, "id", "source_id", "bucket"), v.sources, "bucket")


@query("promotion_disagreement", score_sql("""SELECT id, p AS promoted, coalesce(bucket_now = 'PURSUE' AND bid_recommendation = 'NO_BID', false) AS disagreement, CASE WHEN p THEN CASE WHEN relevance_score >= 90 THEN 'PURSUE' ELSE 'CAPTURE_REVIEW' END ELSE bucket_now END AS bucket
    FROM (SELECT *, coalesce(bid_recommendation = 'BID' AND excluded IS NULL AND bucket_now IN ('MANUAL_REVIEW', 'IGNORE'), false) AS p FROM y)"""), O, S)
def _(v):
    return scoring.promote(scored(v, "id", "bucket", "excluded_reason", "bid_recommendation", "relevance_score")).select("id", "promoted", "disagreement", "bucket")


@query("legacy_relevance", """SELECT id, CASE WHEN relevance_score IS NULL THEN 'Unscored' WHEN relevance_score >= 70 THEN 'Strong fit' WHEN relevance_score >= 40 THEN 'Possible' ELSE 'Low fit' END AS label,
    CASE WHEN relevance_score IS NULL THEN 'REVIEW' WHEN relevance_score >= 70 THEN 'BID' WHEN relevance_score >= 40 THEN 'REVIEW' ELSE 'NO_BID' END AS recommendation,
    CAST(CASE WHEN id % 3 = 0 THEN greatest(85, CASE WHEN id % 6 > 0 THEN greatest(35, least(100, 22 * (id % 6))) ELSE 8 END) ELSE CASE WHEN id % 6 > 0 THEN greatest(35, least(100, 22 * (id % 6))) ELSE 8 END END AS BIGINT) AS keyword FROM opportunities""", O)
def _(v):
    return v.opportunities.select("id", scoring.relevance_label(F.col("relevance_score")).alias("label"), scoring.fallback_recommendation(F.col("relevance_score")).alias("recommendation"), scoring.keyword_relevance(F.col("id") % 6, F.col("id") % 3 == 0).cast("bigint").alias("keyword"))


# --- change capture ----------------------------------------------------------------------------


def stored_and_seen(v: Views) -> tuple[DataFrame, DataFrame]:
    o = v.opportunities
    value = lambda n: F.sha2(F.concat_ws("|", "title", (F.coalesce(F.floor("estimated_value"), F.lit(0)) + n).cast("bigint").cast("string")), 256)
    stored = o.where("id % 11 <> 0").select("source_id", "external_id", "id", "title", "status", "due_date", value(F.lit(0)).alias("content_hash"), F.col("first_seen_at"), F.col("first_seen_at").alias("last_seen_at"), F.lit(None).cast("timestamp").alias("closed_at"))
    seen = o.where("id % 10 <> 0").select("source_id", "external_id", "id", "title", "due_date", value(F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("content_hash"), F.col("pursuit_bucket").alias("bucket"), "urgency")
    return stored, seen


CHANGES = f"""WITH c AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'NEW' WHEN id % 10 = 0 THEN CASE WHEN status IN ('CLOSED','REMOVED','AWARDED','CANCELLED') THEN 'TERMINAL' WHEN due_date < {T} THEN 'CLOSED' ELSE 'REMOVED' END
    WHEN id % 7 = 0 THEN 'AMENDED' ELSE 'UNCHANGED' END AS change, CASE WHEN id % 11 <> 0 THEN status END AS old_status FROM opportunities WHERE id % 11 <> 0 OR id % 10 <> 0),
    d AS (SELECT *, CASE WHEN change = 'NEW' THEN 'NEW' WHEN change = 'AMENDED' AND status NOT IN ('CLOSED','REMOVED','AWARDED','CANCELLED') THEN 'AMENDED' WHEN change = 'UNCHANGED' AND status = 'NEW' THEN 'OPEN' WHEN change IN ('CLOSED','REMOVED') THEN change ELSE status END AS new_status FROM c) """


def classified(v: Views) -> DataFrame:
    return cdc.classify(*stored_and_seen(v), v.as_of)


@query("cdc_classify", CHANGES + "SELECT source_id, external_id, change, old_status, new_status FROM d", O)
def _(v):
    return classified(v).select(*cdc.KEY, "change", "old_status", "new_status")


@query("cdc_counts", CHANGES + "SELECT count_if(change IN ('NEW','AMENDED','UNCHANGED')) AS items_found, count_if(change = 'NEW') AS new_count, count_if(change = 'AMENDED') AS changed_count, count_if(change IN ('CLOSED','REMOVED')) AS closed_count FROM d", O)
def _(v):
    return cdc.counters(classified(v))


@query("version_numbers", CHANGES + "SELECT d.source_id, d.external_id, CAST(CASE WHEN change = 'NEW' THEN 1 ELSE 1 + id % 3 + 1 END AS INTEGER) AS version_no FROM d WHERE change IN ('NEW','AMENDED')", O)
def _(v):
    history = v.opportunities.where("id % 11 <> 0").select(*cdc.KEY, F.explode(F.sequence(F.lit(1), (F.col("id") % 3 + 1).cast("int"))).alias("version_no"))
    return cdc.versions(classified(v), history, v.as_of).select(*cdc.KEY, "version_no")


@query("status_log", CHANGES + "SELECT source_id, external_id, old_status AS old_value, new_status AS new_value, CASE change WHEN 'NEW' THEN 'First seen on portal' WHEN 'AMENDED' THEN 'Content changed on portal' WHEN 'CLOSED' THEN 'Past due date and no longer listed' ELSE 'No longer listed on portal' END AS reason FROM d WHERE change IN ('NEW','AMENDED','CLOSED','REMOVED') AND old_status IS DISTINCT FROM new_status", O)
def _(v):
    return cdc.status_log(classified(v), v.as_of).select(*cdc.KEY, "old_value", "new_value", "reason")


@query("crawl_notifications", CHANGES + """SELECT source_id, external_id, CASE WHEN change = 'AMENDED' THEN 'AMENDMENT' ELSE 'NEW_OPPORTUNITY' END AS type, CASE WHEN p THEN 'Pursue: ' || title WHEN r THEN 'Capture review: ' || title ELSE 'Amended: ' || title END AS title, CASE WHEN r THEN 'info' ELSE 'warning' END AS severity
    FROM (SELECT *, coalesce(change = 'NEW' AND pursuit_bucket = 'PURSUE' AND urgency <> 'INSUFFICIENT_TIME', false) AS p, coalesce(change = 'NEW' AND pursuit_bucket = 'CAPTURE_REVIEW', false) AS r FROM d) WHERE p OR r OR change = 'AMENDED'""", O)
def _(v):
    return cdc.notifications(classified(v))


@query("next_state", CHANGES + f"SELECT source_id, external_id, new_status AS status, CASE WHEN change = 'NEW' THEN {T} ELSE first_seen_at END AS first_seen_at, CASE WHEN id % 10 <> 0 THEN {T} ELSE first_seen_at END AS last_seen_at, CASE WHEN change IN ('CLOSED','REMOVED') THEN {T} END AS closed_at FROM d", O)
def _(v):
    return cdc.next_state(classified(v), v.as_of).select(*cdc.KEY, "status", "first_seen_at", "last_seen_at", "closed_at")


def crawled(v: Views) -> Store:
    """A store that has taken the snapshot in as three batches, in parts by id, the middle one twice."""
    stored, seen = stored_and_seen(v)
    kept = Store(new_folder(v.spark, "crawl"), buckets=8, most=2)
    create(kept, stored.withColumn("version_no", (F.col("id") % 3 + 1).cast("int")))
    files = F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit("").alias("filename"), F.concat(F.lit("https://x.example/"), F.col("id").cast("string")).alias("url"))))
    seen = seen.withColumns({"attachments": files, "position": F.lit(0)})
    for number in (0, 1, 1, 2):
        apply(v.spark, kept, seen.where(F.col("id") % 3 == number), number, AS_OF)
    return kept


#: As CHANGES, for a snapshot that says nothing of keys that it lacks.
PARTIAL = """WITH c AS (SELECT *, CASE WHEN id % 10 = 0 THEN 'ABSENT' WHEN id % 11 = 0 THEN 'NEW' WHEN id % 7 = 0 THEN 'AMENDED' ELSE 'UNCHANGED' END AS change, CASE WHEN id % 11 <> 0 THEN status END AS old_status FROM opportunities WHERE id % 11 <> 0 OR id % 10 <> 0),
    s AS (SELECT *, CASE WHEN change = 'NEW' THEN 'NEW' WHEN change = 'AMENDED' AND status NOT IN ('CLOSED','REMOVED','AWARDED','CANCELLED') THEN 'AMENDED' WHEN change = 'UNCHANGED' AND status = 'NEW' THEN 'OPEN' ELSE status END AS new_status FROM c) """


@query("crawl_state", PARTIAL + f"""SELECT source_id, external_id, new_status AS status, CASE WHEN change = 'NEW' THEN {T} ELSE first_seen_at END AS first_seen_at, CASE WHEN id % 10 <> 0 THEN {T} ELSE first_seen_at END AS last_seen_at, CAST(NULL AS TIMESTAMP) AS closed_at,
    CAST(CASE change WHEN 'NEW' THEN 1 WHEN 'AMENDED' THEN id % 3 + 2 ELSE id % 3 + 1 END AS INTEGER) AS version_no FROM s""", O)
def _(v):
    return state(v.spark, crawled(v)).select(*cdc.KEY, "status", "first_seen_at", "last_seen_at", "closed_at", "version_no")


@query("crawl_counts", PARTIAL + """SELECT 'status' AS dimension, new_status AS value, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY ALL UNION ALL SELECT 'source_id', CAST(source_id AS VARCHAR), count(*) FROM s GROUP BY ALL
    UNION ALL SELECT 'source_id/status', source_id || '|' || new_status, count(*) FROM s GROUP BY ALL""", O)
def _(v):
    return counts(v.spark, crawled(v))


@query("crawl_outputs", PARTIAL + """SELECT source_id, external_id, 'versions' AS kind, CAST(CASE change WHEN 'NEW' THEN 1 ELSE id % 3 + 2 END AS VARCHAR) AS value, id % 3 AS batch FROM s WHERE change IN ('NEW', 'AMENDED')
    UNION ALL SELECT source_id, external_id, 'log', concat_ws('>', old_status, new_status), id % 3 FROM s WHERE change IN ('NEW', 'AMENDED') AND old_status IS DISTINCT FROM new_status
    UNION ALL SELECT source_id, external_id, 'attachments', 'attachment=https://x.example/' || id, id % 3 FROM s WHERE change = 'NEW' AND id % 2 = 0
    UNION ALL SELECT source_id, external_id, 'notifications', CASE WHEN change = 'AMENDED' THEN 'Amended: ' WHEN pursuit_bucket = 'PURSUE' THEN 'Pursue: ' ELSE 'Capture review: ' END || title, id % 3 FROM s
        WHERE change = 'AMENDED' OR change = 'NEW' AND (pursuit_bucket = 'CAPTURE_REVIEW' OR pursuit_bucket = 'PURSUE' AND urgency <> 'INSUFFICIENT_TIME')
    UNION ALL SELECT NULL, NULL, 'commits', concat_ws(' ', count_if(change IN ('NEW', 'AMENDED', 'UNCHANGED')), count_if(change = 'NEW'), count_if(change = 'AMENDED'), 0), id % 3 FROM s GROUP BY id % 3""", O)
def _(v):
    kept = crawled(v)
    shown = {
        "versions": F.col("version_no").cast("string"), "log": F.concat_ws(">", "old_value", "new_value"), "attachments": F.concat_ws("=", "filename", "source_url"), "notifications": F.col("title"),
    }
    rows = [output(v.spark, kept, name).select(*cdc.KEY, F.lit(name).alias("kind"), value.alias("value"), F.col("batch").cast("bigint")) for name, value in shown.items()]
    none = (F.lit(None).cast(rows[0].schema[k].dataType).alias(k) for k in cdc.KEY)
    out = committed(v.spark, kept).select(*none, F.lit("commits").alias("kind"), F.concat_ws(" ", "items_found", "new_count", "changed_count", "closed_count").alias("value"), F.col("batch").cast("bigint"))
    for more in rows:
        out = out.unionByName(more)
    return out


@query("content_hash", """SELECT id, sha256('[' || to_json(lower(trim(title))) || ',' || to_json(lower(trim(agency))) || ',"","",' || to_json(lower(trim(coalesce(description, '')))) || ',' || coalesce(CAST(CAST(floor(estimated_value) AS BIGINT) AS VARCHAR), '""') || ',' || to_json(lower(status)) || ',"a|b"]') AS hash FROM opportunities""", O)
def _(v):
    none = F.lit(None).cast("string")
    return v.opportunities.select("id", cdc.content_hash(F.col("title"), F.col("agency"), none, none, F.col("description"), F.floor("estimated_value").cast("double"), F.col("status"), F.array(F.lit("b"), F.lit("a"))).alias("hash"))


@query("fallback_id", "SELECT id, substr(sha256(lower(title || '|' || agency || '|' || '')), 1, 24) AS fallback FROM opportunities", O)
def _(v):
    return v.opportunities.select("id", cdc.fallback_id(F.col("title"), F.col("agency"), F.lit(None).cast("string")).alias("fallback"))


@query("deadline_reminders", f"""SELECT id, d AS days_out, 'DEADLINE' AS type, CASE WHEN d <= 1 THEN 'critical' ELSE 'warning' END AS severity FROM (SELECT *, CAST(ceil(epoch_us(due_date - {T}) / 86400000000.0) AS INTEGER) AS d FROM (SELECT id, status, due_date FROM opportunities) WHERE status IN {OPEN_SQL})
    WHERE d IN (7, 3, 1) AND NOT (d = 3 AND id % 2 = 0)""".replace(f"epoch_us(due_date - {T})", f"(epoch_us(due_date) - epoch_us({T}))"), O)
def _(v):
    sent = v.opportunities.where("id % 2 = 0").select("id", F.lit("DEADLINE").alias("type"), F.lit(3).alias("days_out"))
    return reminders.deadline_reminders(v.opportunities, sent, v.as_of)


@query("urgency_refresh", score_sql("SELECT id, urgency AS old, band_now AS new FROM y WHERE pursuit_bucket IS NOT NULL AND status NOT IN ('CLOSED','REMOVED','AWARDED','CANCELLED') AND urgency IS DISTINCT FROM band_now"), O, S)
def _(v):
    return reminders.urgency_refresh(v.opportunities, v.as_of, PROFILE)


# --- order-dependent operators, text ------------------------------------------------------------


@query("dedupe_first_wins", "SELECT part, opportunity_id FROM (SELECT part, opportunity_id, row_number() OVER (PARTITION BY part ORDER BY opportunity_id, line, kind) AS n FROM (SELECT DISTINCT part, opportunity_id, line, kind FROM children)) WHERE n = 1", "children")
def _(v):
    # equal rows need not be removed before: the first of them is the same, and a set of all rows is memory
    rows = v.children.withColumn("position", F.struct("opportunity_id", "line", "kind"))
    return cdc.first_of_each(rows, ["part"], "position").select("part", "opportunity_id")


@query("dedupe_merge", """SELECT opportunity_id, arg_min(part, p) FILTER (kind = 'response') AS response_part, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (SELECT *, line * 1000000 + part AS p FROM (SELECT DISTINCT opportunity_id, line, part, kind FROM children)) GROUP BY 1""", "children")
def _(v):
    rows = v.children.distinct().select("opportunity_id", (F.col("line") * 1000000 + F.col("part")).alias("p"), F.when(F.col("kind") == "response", F.col("part")).alias("response_part"), F.array("kind").alias("kinds"))
    merged = ordering.merge_duplicates(rows, "opportunity_id", "p", ["response_part"], ["kinds"])
    return merged.select("opportunity_id", "response_part", F.array_join(F.array_sort("kinds"), ",").alias("kinds"))


@query("continuation_rows", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS header FROM conversations")
def _(v):
    rows = v.table("conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("header"))
    return ordering.attach_continuations(rows, ["conv_id"], "turn", "header")


@query("pivot_rows", "SELECT conv_id, CAST(turn AS INTEGER) AS \"row\", any_value(role) AS ROLE_, CAST(any_value(length(text)) AS VARCHAR) AS SIZE_ FROM conversations GROUP BY conv_id, turn")
def _(v):
    rows = v.table("conversations").select("conv_id", F.explode(F.array(F.struct(F.concat(F.lit("ROLE_$"), "turn").alias("f"), F.col("role").alias("x")), F.struct(F.concat(F.lit("SIZE_$"), "turn").alias("f"), F.length("text").cast("string").alias("x")))).alias("c")).select("conv_id", "c.f", "c.x")
    return ordering.pivot_rows(rows, ["conv_id"], "f", "x", ["ROLE_", "SIZE_"])


@query("chunk_text", r"""SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, substr(t, CAST(i * 1050 + 1 AS BIGINT), 1200) AS content FROM (SELECT doc_id, t, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) <= 1200 THEN [0] ELSE range(0, CAST(ceil(length(t) / 1050.0) AS BIGINT)) END) AS i
    FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents))""")
def _(v):
    return v.table("documents").select("doc_id", F.posexplode(ordering.chunks(F.col("text"))).alias("chunk_no", "content"))


@query("doc_text_concat", """SELECT CAST(doc_id % 97 AS BIGINT) AS opportunity_id, sha256(substr(string_agg(substr('--- DOCUMENT: ' || CAST(doc_id AS VARCHAR) || ' ---' || chr(10) || text, 1, 28000), chr(10) || chr(10) ORDER BY doc_id), 1, 28000)) AS joined FROM documents WHERE length(trim(text)) > 0 GROUP BY 1""")
def _(v):
    rows = v.table("documents").select((F.col("doc_id") % 97).alias("opportunity_id"), "doc_id", "text")
    header = F.concat(F.lit("--- DOCUMENT: "), F.col("doc_id").cast("string"), F.lit(" ---\n"))
    return ordering.joined_texts(rows, "opportunity_id", "text", ["doc_id"], 28_000, "\n\n", header).select("opportunity_id", F.sha2("joined", 256).alias("joined"))


FNV_SQL = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query("local_embed", f"""WITH w AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, list_slice(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), 1, 4000) AS t FROM documents)),
    p AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) || '_' || w AS b FROM w), h AS (SELECT w, {FNV_SQL.format('w')} AS h FROM (SELECT w FROM p UNION SELECT b FROM p WHERE b IS NOT NULL)),
    x AS (SELECT doc_id, h % 1536 AS b, 1.0::DOUBLE AS x FROM p JOIN h USING (w) UNION ALL SELECT doc_id, (h >> 7) % 1536, 0.5::DOUBLE FROM p JOIN h USING (w) UNION ALL SELECT doc_id, h % 1536, 0.75::DOUBLE FROM p JOIN h ON h.w = p.b)
    SELECT doc_id, CAST(b AS INTEGER) AS bucket, sum(x) AS weight FROM x GROUP BY 1, 2""")
def _(v):
    return retrieval.embed(v.table("documents"), "doc_id", "text")


@query("topk_similar", """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))), 6) AS similarity FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0) q)
    SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, vec_id) AS rank FROM s) WHERE rank <= 6""")
def _(v):
    e = v.table("embeddings")
    return retrieval.top_k(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), key="vec_id", vector="embedding", query_key="query_id", query_vector="q")


@query("verdict_parse", """SELECT id, CAST(0 AS INTEGER) AS i, CAST(least(100, greatest(0, floor(id % 150 - 20 + 0.5))) AS INTEGER) AS score, CASE id % 3 WHEN 0 THEN 'BID' WHEN 1 THEN 'NO_BID' ELSE 'REVIEW' END AS recommendation, CASE WHEN id % 5 = 0 THEN 'No reason given' ELSE 'reason ' || CAST(id AS VARCHAR) END AS reason FROM opportunities""", O)
def _(v):
    rec = F.when(F.col("id") % 3 == 0, "bid").when(F.col("id") % 3 == 1, "NoBid").otherwise("maybe")
    reason = F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit("reason "), F.col("id").cast("string")))
    reply = F.format_string('Sure: [{"i":0,"score":%d,"rec":"%s","reason":"%s"},{"i":7,"score":1,"rec":"BID","reason":"out of range"}] done', F.col("id") % 150 - 20, rec, reason)
    return retrieval.parse_verdicts(v.opportunities.select("id", reply.alias("reply"), F.lit(1).alias("size")), "reply", "size").select("id", "i", "score", "recommendation", "reason")


# --- scalars -----------------------------------------------------------------------------------


@query("us_date_parse", "SELECT id, CAST(posted_date AS TIMESTAMP) + INTERVAL 14 HOUR + INTERVAL 5 MINUTE + INTERVAL 5 HOUR AS parsed FROM opportunities", O)
def _(v):
    return v.opportunities.select("id", fn.us_date(F.concat(F.date_format("posted_date", "M/d/yyyy"), F.lit(" 2:05 PM"))).alias("parsed"))


@query("ms_date", "SELECT id, posted_date::TIMESTAMP AS parsed FROM opportunities", O)
def _(v):
    return v.opportunities.select("id", fn.ms_date(F.concat(F.lit("/Date("), (F.unix_date("posted_date") * F.lit(86_400_000).cast("bigint")).cast("string"), F.lit(")/"))).alias("parsed"))


@query("month_name_date", "SELECT id, posted_date::TIMESTAMP + INTERVAL 9 HOUR + INTERVAL 6 HOUR AS parsed FROM opportunities", O)
def _(v):
    return v.opportunities.select("id", fn.month_name_date(F.concat(F.date_format("posted_date", "MMMM d, yyyy"), F.lit(" 9:00 a.m.")), fn.MOUNTAIN_DAYLIGHT).alias("parsed"))


@query("clean_text", r"SELECT doc_id, sha256(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 4000)) AS cleaned FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.sha2(fn.trim_description(F.col("text")), 256).alias("cleaned"))


@query("html_to_text", r"""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\n\s*\n+', chr(10), 'g'))) AS text FROM pages""")
def _(v):
    return v.table("pages").select("page_id", F.sha2(fn.html_to_text(F.col("html")), 256).alias("text"))


@query("deadline_labels", f"""SELECT id, CASE WHEN due_date IS NULL THEN 'No deadline' WHEN d < 0 THEN 'Closed' WHEN d = 0 THEN 'Due today' WHEN d = 1 THEN 'Due tomorrow' ELSE 'Due in ' || CAST(d AS VARCHAR) || ' days' END AS label FROM (SELECT *, CAST(ceil((epoch_us(due_date) - epoch_us({T})) / 86400000000.0) AS INTEGER) AS d FROM opportunities)""", O)
def _(v):
    return v.opportunities.select("id", fn.deadline_label(F.col("due_date"), v.as_of).alias("label"))


@query("discover_links", r"""SELECT page_id, sha256(string_agg(href || '=' || name, ' ' ORDER BY n)) AS links FROM (SELECT page_id, n, href, trim(regexp_replace(regexp_extract(a, '(?is)>(.*)</a', 1), '<[^>]*>', '', 'g')) AS name FROM
    (SELECT page_id, a, n, regexp_extract(a, '(?is)href\s*=\s*"([^"]*)"', 1) AS href FROM (SELECT page_id, unnest(h) AS a, generate_subscripts(h, 1) AS n FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"[^"#][^"]*"[^>]*>.*?</a') AS h FROM pages)))
    WHERE NOT regexp_matches(href, '(?i)^(mailto|javascript):')) GROUP BY 1""")
def _(v):
    from .sources.discovery import anchors

    rows = anchors(v.table("pages"), "page_id", "html").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat("href", F.lit("="), "text").alias("x")))).alias("l"))
    return rows.select("page_id", F.sha2(F.array_join(F.transform("l", lambda x: x["x"]), " "), 256).alias("links"))


@query("fnv_hash", f"SELECT id, {FNV_SQL.format('external_id')} AS h FROM opportunities", O)
def _(v):
    return v.opportunities.select("id", fn.fnv1a(F.col("external_id")).alias("h"))


@query("doc_eligibility", """WITH t AS (SELECT * FROM (SELECT *, CASE source_id % 4 WHEN 0 THEN 'nc' WHEN 1 THEN 'pa' WHEN 2 THEN 'sam' ELSE 'tx' END AS slug FROM opportunities WHERE bid_recommendation IN ('BID', 'REVIEW') AND id % 9 > 0 AND id % 13 <> 1) ORDER BY relevance_score DESC NULLS FIRST, id LIMIT 800),
    k AS (SELECT opportunity_id AS id, max(line % 5 = 0) AS done FROM children WHERE kind = 'attachment' GROUP BY 1)
    SELECT t.id, done IS NOT NULL AS has_attachments, CAST(row_number() OVER (ORDER BY (done IS NOT NULL) DESC, relevance_score DESC NULLS FIRST, t.id) AS INTEGER) AS rank FROM t LEFT JOIN k USING (id) WHERE NOT coalesce(done, false) AND (done IS NOT NULL OR slug IN ('nc', 'tn', 'ma', 'pa', 'ar'))""", O, "children")
def _(v):
    slug = F.element_at(F.array(*map(F.lit, ("nc", "pa", "sam", "tx"))), (F.col("source_id") % 4 + 1).cast("int"))
    rows = v.opportunities.withColumns({"slug": slug, "detail_url": F.when(F.col("id") % 9 > 0, "https://x.example"), "documents_checked_at": F.when(F.col("id") % 13 == 1, v.as_of)})
    files = v.children.where("kind = 'attachment'").select("opportunity_id", F.when(F.col("line") % 5 == 0, v.as_of).alias("downloaded_at"))
    return workflow.document_candidates(rows, files, ("BID", "REVIEW"))


@query("first_documents", "SELECT source_id, id, CAST(n AS INTEGER) AS n FROM (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY CASE pursuit_bucket WHEN 'PURSUE' THEN 1 ELSE 2 END, id) AS n FROM opportunities WHERE pursuit_bucket IN ('PURSUE', 'CAPTURE_REVIEW')) WHERE n <= 12", O)
def _(v):
    return workflow.first_documents(v.opportunities.select("source_id", "id", F.col("pursuit_bucket").alias("bucket"), F.col("id").alias("position"))).select("source_id", "id", "n")


@query("table_writes", """SELECT id, CASE WHEN id % 4 = 0 THEN 'new ' || id ELSE title END AS title, CASE WHEN id % 6 = 1 AND status = 'OPEN' THEN 'AMENDED' ELSE status END AS status FROM opportunities WHERE id % 10 <> 3
    UNION ALL SELECT -id, 'added', NULL FROM opportunities WHERE id % 8 = 0 AND id > 0""", O)
def _(v):
    """Upserts, then updates under a condition, then deletes."""
    rows = v.opportunities.select("id", "title", "status")
    new = rows.where("id % 4 = 0").select("id", F.concat(F.lit("new "), F.col("id").cast("string")).alias("title"), "status").unionByName(rows.where("id % 8 = 0 and id > 0").select((-F.col("id")).alias("id"), F.lit("added").alias("title"), F.lit(None).cast("string").alias("status")))
    rows = tables.upsert(rows, new, ["id"])
    rows = tables.update(rows, v.opportunities.where("id % 6 = 1").select("id", F.lit("AMENDED").alias("status")), ["id"], F.col("status") == "OPEN")
    return tables.delete(rows, v.opportunities.where("id % 10 = 3"), ["id"])


@query("replaced_children", "SELECT part, source_id, n FROM (SELECT id % 50 AS part, source_id, count(*) AS n FROM opportunities WHERE id % 3 > 0 AND id % 50 >= 20 GROUP BY ALL UNION ALL SELECT id % 50, source_id, count(*) FROM opportunities WHERE id % 3 = 0 AND id % 50 < 20 GROUP BY ALL)", O)
def _(v):
    """Children by parent, of some of which a second write takes the place."""
    rows, path = v.opportunities.select((F.col("id") % 50).alias("part"), "source_id", "id"), new_folder(v.spark, "children")
    tables.replace_children(rows.where("id % 3 > 0"), path, "part")
    for_some = rows.where("id % 3 = 0 and part < 20")
    tables.replace_children(for_some, path, "part")
    return v.spark.read.parquet(path).groupBy(F.col("part").cast("bigint"), "source_id").agg(F.count("*").alias("n"))


@query("draft_texts", """SELECT id, '# Response to ' || title || chr(10) || chr(10) || 'Prepared for ' || agency || ' (' || CASE WHEN id % 2 = 0 THEN 'LLM_ORIGINAL' ELSE 'STYLE_MATCHED' END || ')' || chr(10) || chr(10) || '## Understanding' || chr(10) || '- Scope and outcomes as published' || chr(10) || chr(10) || '## Approach' || chr(10) || '- Plan, deliver, report' AS draft,
    CASE WHEN pipeline_stage IN ('BACKLOG', 'REVIEWING') THEN 'DRAFTING' ELSE pipeline_stage END AS stage FROM opportunities""", O)
def _(v):
    return v.opportunities.select("id", drafting.offline_draft(F.col("title"), F.col("agency"), F.when(F.col("id") % 2 == 0, "LLM_ORIGINAL").otherwise("STYLE_MATCHED")).alias("draft"), drafting.stage_after_draft(F.col("pipeline_stage")).alias("stage"))


@query("export_runs", """SELECT id, l.line, l.kind, l.run, l.text, l.bold FROM (SELECT id, unnest([
    {line: 0, kind: 'title', run: 0, text: title || ' — ' || external_id, bold: false}, {line: 1, kind: 'heading1', run: 0, text: 'Response to **' || title || '**', bold: false},
    {line: 2, kind: 'blank', run: -1, text: '', bold: false}, {line: 3, kind: 'heading3', run: 0, text: 'Scope', bold: false},
    {line: 4, kind: 'bullet', run: 0, text: 'Supply ', bold: false}, {line: 4, kind: 'bullet', run: 1, text: agency, bold: true}, {line: 4, kind: 'bullet', run: 2, text: ' now ', bold: false},
    {line: 4, kind: 'bullet', run: 3, text: ' and ', bold: true}, {line: 4, kind: 'bullet', run: 4, text: 'later**', bold: false},
    {line: 5, kind: 'quote', run: 0, text: ' Quote ', bold: false}, {line: 5, kind: 'quote', run: 1, text: 'a', bold: true}, {line: 6, kind: 'table', run: 0, text: agency || '    ' || id, bold: false},
    {line: 7, kind: 'paragraph', run: 0, text: 'Plain ' || title, bold: false}, {line: 8, kind: 'paragraph', run: 0, text: '#No heading', bold: false}, {line: 9, kind: 'paragraph', run: 0, text: '', bold: true},
    {line: 10, kind: 'blank', run: -1, text: '', bold: false}]) AS l FROM opportunities)""", O)
def _(v):
    """Drafts as the runs of a document's lines; each line of the SQL is stated by hand.  A blank line is run -1."""
    text = F.concat(
        F.lit("# Response to **"), F.col("title"), F.lit("**\n\n  ### Scope \n* Supply **"), F.col("agency"), F.lit("** now ** and **later**\n>  Quote **a**\n| "), F.col("agency"), F.lit(" | "), F.col("id").cast("string"),
        F.lit(" |\nPlain "), F.col("title"), F.lit("   \n#No heading\n**\n"),
    )
    drafts = v.opportunities.select("id", drafting.export_title(F.col("title"), F.col("external_id"), F.lit(None).cast("string")).alias("heading"), text.alias("text"))
    return drafting.export_lines(drafts, "id", "heading", "text").select("id", "line", "kind", F.posexplode_outer("runs").alias("run", "r")).select("id", "line", "kind", *(F.coalesce(F.col(c), F.lit(none)).alias(name) for c, name, none in (("run", "run", -1), ("r.text", "text", ""), ("r.bold", "bold", False))))


@query("next_revisions", "SELECT opportunity_id, max(turn) + 1 AS next FROM responses GROUP BY 1", "responses")
def _(v):
    return drafting.next_revision(v.responses, "opportunity_id", "turn")


@query("scalar_forms", """SELECT id, trim(substr(trim(regexp_replace(lower(title || '!' || agency), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80)) AS slug, 'MANUAL-' || to_base(id, 36) AS manual, posted_date::TIMESTAMP AS posted,
    CASE id % 4 WHEN 0 THEN 'Cancelled' WHEN 1 THEN 'Intent to Award Posted' WHEN 2 THEN 'Amended' ELSE 'Open' END AS status, CASE id % 3 WHEN 0 THEN '92000,91800' ELSE '' END AS codes, regexp_replace(title, '[^A-Za-z0-9._-]+', '_', 'g') AS file FROM opportunities""", O)
def _(v):
    files = F.element_at(F.array(*map(F.lit, ("Notice of cancellation | Amendment 1", "Notice of Award | amendment", "AMENDMENT 2", "Award"))), (F.col("id") % 4 + 1).cast("int"))
    codes = fn.commodity_codes(F.when(F.col("id") % 3 == 0, "92000 - Data; 91800 - Advice").otherwise("none - 12"))
    return v.opportunities.select("id", fn.slug_id(F.concat("title", F.lit("!"), "agency")).alias("slug"), fn.base36(F.col("id")).alias("manual"), fn.epoch_millis(F.unix_millis(F.col("posted_date").cast("timestamp")).cast("string")).alias("posted"), fn.status_of_attachments(files).alias("status"), F.array_join(codes, ",").alias("codes"), fn.safe_file_name(F.col("title")).alias("file"))


@query("page_documents", r"""SELECT page_id, count(*) AS links, count(*) FILTER (d) AS documents, min(h) AS first FROM (SELECT page_id, h, regexp_matches(h, '(?i)\.(pdf|docx?|xlsx?|pptx?|zip|csv|txt|rtf)(\?|#|$)') AS d FROM
    (SELECT page_id, regexp_extract(unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"[^"]*"')), '(?is)href\s*=\s*"([^"]*)"', 1) AS h FROM pages)) GROUP BY 1""")
def _(v):
    """Links of whole pages, read as trees, and which of them lead to documents by their address."""
    trees = markup.parsed(v.table("pages").select("page_id", "html"), column="html")
    links = trees.select("page_id", F.explode(F.filter(markup.tagged(F.col("nodes"), "a"), lambda e: e["href"].isNotNull())).alias("e")).select("page_id", F.col("e.href").alias("h"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(fn.document_address(F.col("h"))).alias("documents"), F.min("h").alias("first"))


# --- daily work, lists and lookups ----------------------------------------------------------------


@query("source_newest", "SELECT id, rank FROM (SELECT id, CAST(row_number() OVER (ORDER BY first_seen_at DESC NULLS FIRST, id) AS INTEGER) AS rank FROM opportunities WHERE source_id IN (SELECT id FROM sources WHERE slug = 'nation_3')) WHERE rank <= 200", O, S)
def _(v):
    return serving.of_source(v.opportunities, v.sources, "nation_3").select("id", "rank")


METHOD = "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN 'llm' ELSE 'rules' END"


@query("list_not_model_scored", f"SELECT id, rank FROM (SELECT id, CAST(row_number() OVER (ORDER BY first_seen_at ASC NULLS LAST, id) AS INTEGER) AS rank FROM opportunities WHERE {METHOD} <> 'llm') WHERE rank <= 50", O)
def _(v):
    return serving.not_model_scored(v.opportunities.withColumn("relevance_method", F.expr(METHOD))).select("id", "rank")


@query("document_state", """SELECT opportunity_id, count_if(here AND NOT failed) AS downloaded, count_if(address AND NOT here) AS pending FROM (SELECT *, part % 3 = 0 AS here, part % 6 = 0 AS failed, part % 4 <> 1 AS address FROM children) GROUP BY 1""", "children")
def _(v):
    rows = v.children.select("opportunity_id", F.expr("case when part % 3 = 0 then 1 end").alias("downloaded_at"), F.expr("case when part % 6 = 0 then 'failed' when part % 3 = 0 then 'parsed' end").alias("parse_status"), F.expr("case when part % 4 <> 1 then 'x' end").alias("source_url"))
    return serving.document_state(rows).groupBy("opportunity_id").agg(F.count_if("downloaded").alias("downloaded"), F.count_if("pending").alias("pending"))


def notices(v: Views) -> DataFrame:
    return v.table("events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("event_id") % 3 == 0).alias("is_read"))


@query("notifications_newest", "SELECT id, rank FROM (SELECT event_id AS id, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events) WHERE rank <= 50")
def _(v):
    return serving.notifications(notices(v)).select("id", "rank")


@query("notifications_unread", "SELECT id, rank FROM (SELECT event_id AS id, CAST(row_number() OVER (ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events WHERE event_id % 3 <> 0) WHERE rank <= 8")
def _(v):
    return serving.notifications(notices(v), unread=True, limit=8).select("id", "rank")


@query("recent_runs", "SELECT r.id, s.name AS source_name, r.status, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY started_at DESC, id DESC) AS rank FROM runs) r LEFT JOIN sources s ON s.id = r.source_id WHERE rank <= 30", "runs", S)
def _(v):
    return serving.recent_runs(v.runs, v.sources).select("id", "source_name", "status", "rank")


@query("assignees", "SELECT o.id, s_name AS assignee_name FROM opportunities o LEFT JOIN supplier ON s_suppkey = o.assigned_to", O)
def _(v):
    users = v.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return serving.with_assignee(v.opportunities, users).select("id", "assignee_name")


@query("users_in_order", "SELECT id, CAST(row_number() OVER (ORDER BY CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END, name, id) AS INTEGER) AS position FROM (SELECT s_suppkey AS id, s_name AS name FROM supplier)")
def _(v):
    role = F.element_at(F.array(*map(F.lit, ("ADMIN", "MANAGER", "VIEWER"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return serving.users_in_order(v.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), role.alias("role")), ("ADMIN", "MANAGER", "VIEWER")).select("id", F.col("position").cast("int"))


@query("knowledge_chunks", r"""SELECT doc_id AS id, CASE WHEN n = 0 OR doc_id % 7 = 0 THEN 0 WHEN n <= 1200 THEN 1 ELSE CAST(ceil(n / 1050.0) AS BIGINT) END AS chunks FROM (SELECT doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM documents)""")
def _(v):
    docs = v.table("documents").select(F.col("doc_id").alias("id"), "text")
    chunks = docs.where("id % 7 <> 0").select(F.col("id").alias("knowledge_id"), F.explode(ordering.chunks(F.col("text"))).alias("c")).select("knowledge_id")
    return serving.chunk_counts(docs.select("id"), chunks)


@query("response_export", "SELECT r.opportunity_id, r.turn, o.title, o.agency FROM responses r JOIN opportunities o ON o.id = r.opportunity_id", "responses", O)
def _(v):
    return serving.export_rows(v.responses, v.opportunities).select("opportunity_id", "turn", "title", "agency")


@query("response_total", "SELECT count(*) AS responses FROM responses", "responses")
def _(v):
    return v.responses.agg(F.count("*").alias("responses"))


@query("by_status", "SELECT status, n, max(n) OVER () AS most FROM (SELECT status, count(*) AS n FROM opportunities GROUP BY 1)", O)
def _(v):
    return metrics.with_bar_max(metrics.by_status(v.opportunities))


@query("rescore_histogram", score_sql(spine_sql("bucket", metrics.BUCKETS, "SELECT bucket_now AS bucket FROM y")), O, S)
def _(v):
    return metrics.bucket_histogram(scored(v, "id", "bucket"))


@query("change_bucket_tallies", CHANGES + "SELECT " + ", ".join(f"count_if(change IN ('NEW','AMENDED') AND pursuit_bucket = '{b}') AS {b.lower()}" for b in metrics.BUCKETS) + " FROM d", O)
def _(v):
    return workflow.bucket_tallies(classified(v), metrics.BUCKETS)


@query("survivors", "SELECT id, position FROM (SELECT id, CAST(row_number() OVER (ORDER BY source_id, id) AS INTEGER) AS position FROM opportunities WHERE coalesce(excluded_reason, '') = '') WHERE position <= 80", O)
def _(v):
    return workflow.survivors(v.opportunities, F.col("source_id"), F.col("id")).select("id", "position")


@query("classify_batches", """SELECT id, n // 10 AS batch, CAST(n % 10 AS INTEGER) AS i, '{"i":' || n % 10 || ',"title":' || to_json(title) || ',"agency":' || to_json(agency) || ',"category":' || to_json(coalesce(category, '')) || ',"naics":"' || coalesce(naics_code, '') || '","desc":' || to_json(coalesce(description, '')) || '}' AS item
    FROM (SELECT *, row_number() OVER (ORDER BY pursuit_score DESC NULLS LAST, id) - 1 AS n FROM opportunities WHERE excluded_reason IS NULL)""", O)
def _(v):
    batched = batches(v.opportunities.where("excluded_reason is null"), F.desc_nulls_last("pursuit_score"), "id")
    return batched.select("id", "batch", "i", relevance.item(F.col("i")).alias("item"))


@query("classify_verdicts", """SELECT id, CAST(n % 10 * 10 AS INTEGER) AS score, CASE WHEN n % 20 < 10 THEN 'BID' ELSE 'NO_BID' END AS recommendation, 'batch ' || n // 10 AS reason FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM opportunities) WHERE n % 10 IN (2, 5) AND n % 30 < 20""", O)
def _(v):
    """Replies name the second and the fifth of a batch; every third reply is no JSON."""
    def ask(asked):
        b, name = F.col("batch"), F.col("batch").cast("string")
        one = lambda i: F.concat(F.lit(f'{{"i":{i},"score":{i * 10},"rec":"'), F.when(b % 2 == 0, "BID").otherwise("no-bid"), F.lit('","reason":"batch '), name, F.lit('"}'))
        return asked.withColumn("reply", F.when(b % 3 == 2, "sorry").otherwise(F.concat(F.lit("Here: ["), one(2), F.lit(","), one(5), F.lit("]"))))

    return relevance.classify(v.opportunities, relevance.profile_text("Acme", "Software", DEFAULT), "id", ask=ask)


@query("verdict_merge", """SELECT id, CASE WHEN id % 4 = 1 THEN CAST(id % 101 AS INTEGER) ELSE relevance_score END AS relevance_score, CASE WHEN id % 4 = 1 THEN CASE WHEN id % 3 = 0 THEN 'BID' ELSE 'NO_BID' END WHEN relevance_score IS NULL THEN 'REVIEW' WHEN relevance_score >= 70 THEN 'BID'
    WHEN relevance_score >= 40 THEN 'REVIEW' ELSE 'NO_BID' END AS bid_recommendation, CASE WHEN id % 4 = 1 THEN 'llm' ELSE 'rules' END AS relevance_method FROM opportunities""", O)
def _(v):
    verdicts = v.opportunities.where("id % 4 = 1").select("id", (F.col("id") % 101).cast("int").alias("score"), F.when(F.col("id") % 3 == 0, "BID").otherwise("NO_BID").alias("recommendation"), F.lit("r").alias("reason"))
    return workflow.merge_verdicts(v.opportunities.select("id", "relevance_score"), verdicts, fallback=True).select("id", "relevance_score", "bid_recommendation", "relevance_method")


@query("status_changes", f"""SELECT id, status AS old_value, v AS new_value, CASE WHEN id % 2 = 0 THEN 'amy' ELSE 'user' END AS changed_by, CASE WHEN v = 'CLOSED' THEN {T} END AS closed_at FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS v FROM opportunities WHERE id % 5 = 0) WHERE v IS DISTINCT FROM status""", O)
def _(v):
    changes = v.opportunities.where("id % 5 = 0").select("id", F.when(F.col("id") % 3 == 0, "CLOSED").otherwise("OPEN").alias("value"), F.when(F.col("id") % 2 == 0, "amy").alias("actor"), F.lit(None).cast("string").alias("reason"))
    return workflow.status_changes(v.opportunities, changes, v.as_of).select("id", "old_value", "new_value", "changed_by", "closed_at")


@query("approvals", "SELECT opportunity_id, 'Response approved: ' || coalesce(CASE WHEN turn % 2 = 0 THEN mode END, 'draft') AS title, 'info' AS severity FROM responses WHERE (opportunity_id + turn) % 4 = 0", "responses")
def _(v):
    rows = v.responses.select(F.struct("opportunity_id", "turn").alias("id"), "opportunity_id", F.when(F.col("turn") % 2 == 0, F.col("mode")).alias("title"))
    changes = rows.select("id", F.when((F.col("id.opportunity_id") + F.col("id.turn")) % 4 == 0, "APPROVED").otherwise("DRAFT").alias("status"))
    return workflow.approvals(rows, changes).select("opportunity_id", "title", "severity")


def last_outcomes(v: Views) -> DataFrame:
    return metrics.latest_runs(v.runs).select("source_id", F.when(F.col("status") == "failed", "failed").otherwise("success").alias("outcome"), F.col("started_at").alias("at"), F.concat(F.lit("run "), F.col("run_id").cast("string")).alias("log"))


LATEST = "(SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS n FROM runs)"


@query("sources_after", f"""SELECT s.id, CASE WHEN r.status = 'failed' THEN 'error' WHEN r.status IS NOT NULL THEN 'active' ELSE 'idle' END AS status, CAST(CASE WHEN r.status = 'failed' THEN s.id % 4 + 1 WHEN r.status IS NOT NULL THEN 0 ELSE s.id % 4 END AS INTEGER) AS consecutive_failures,
    coalesce(started_at, last_success_at) AS last_run_at, CASE WHEN r.status <> 'failed' THEN started_at ELSE last_success_at END AS last_success_at FROM sources s LEFT JOIN (SELECT * FROM {LATEST} WHERE n = 1 AND source_id % 6 <> 0) r ON r.source_id = s.id""", S, "runs")
def _(v):
    sources = v.sources.select("id", F.lit("idle").alias("status"), (F.col("id") % 4).cast("int").alias("consecutive_failures"), F.col("last_success_at").alias("last_run_at"), "last_success_at")
    return workflow.sources_after(sources, last_outcomes(v).where("source_id % 6 <> 0").drop("log"))


@query("failure_alerts", f"SELECT source_id, 'Crawl failed: ' || s.name AS title, 'run ' || r.id AS body, 'critical' AS severity FROM {LATEST} r JOIN sources s ON s.id = r.source_id WHERE n = 1 AND r.status = 'failed'", S, "runs")
def _(v):
    return workflow.failure_alerts(v.sources, last_outcomes(v)).select("source_id", "title", "body", "severity")


@query("daily_actions", CHANGES + f""", a AS (SELECT 1 AS step, change AS action FROM d WHERE change IN ('NEW','AMENDED','CLOSED','REMOVED') UNION ALL
    SELECT 2, 'DEADLINE ' || CAST(n AS VARCHAR) FROM (SELECT id, status, CAST(ceil((epoch_us(due_date) - epoch_us({T})) / 86400000000.0) AS INTEGER) AS n FROM opportunities) WHERE status IN {OPEN_SQL} AND n IN (7, 3, 1) UNION ALL
    SELECT 3, band FROM (SELECT *, CASE WHEN due_date IS NULL THEN 'NO_DATE' WHEN days < 10 THEN 'INSUFFICIENT_TIME' WHEN days <= 20 THEN 'URGENT' WHEN days <= 45 THEN 'STANDARD' ELSE 'EARLY_CAPTURE' END AS band FROM (SELECT *, datediff('day', DATE '{AS_OF[:10]}', CAST(due_date AS DATE)) AS days FROM opportunities))
    WHERE pursuit_bucket IS NOT NULL AND status NOT IN ('CLOSED','REMOVED','AWARDED','CANCELLED') AND urgency IS DISTINCT FROM band) SELECT CAST(step AS INTEGER) AS step, action, count(*) AS n FROM a GROUP BY 1, 2""", O)
def _(v):
    none = v.opportunities.limit(0).select("id", F.lit("DEADLINE").alias("type"), F.lit(0).alias("days_out"))
    return workflow.daily(classified(v), v.opportunities, none, v.as_of, PROFILE).groupBy("step", "action").agg(F.count("*").alias("n"))


@query("topk_labelled", """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))), 6) AS similarity FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 3) e, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0) q)
    SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, vec_id) AS rank FROM s) WHERE rank <= 4""")
def _(v):
    e = v.table("embeddings")
    return retrieval.top_k(e.where("label = 3"), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), key="vec_id", vector="embedding", query_key="query_id", query_vector="q", k=4)


@query("topk_lists", ORACLES["topk_similar"].replace("rank <= 6", "rank <= 10"))
def _(v):
    """The ten nearest by the index of inverted lists, with the pass that makes it exact."""
    e = v.table("embeddings")
    index = vector_lists.build(e, new_folder(v.spark, "lists"), key="vec_id", vector="embedding")
    return vector_lists.search(index, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), query_key="query_id", query_vector="q", k=10, exact=True)


@query("unit_embed", ORACLES["local_embed"].replace("SELECT doc_id, CAST(b AS INTEGER) AS bucket, sum(x) AS weight FROM x GROUP BY 1, 2", ", y AS (SELECT doc_id, CAST(b AS INTEGER) AS bucket, sum(x) AS w FROM x GROUP BY 1, 2) SELECT doc_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM y"))
def _(v):
    return retrieval.embed(v.table("documents"), "doc_id", "text", unit=True).withColumn("weight", F.round("weight", 9))


@query("vector_literals", "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS literal FROM embeddings")
def _(v):
    return v.table("embeddings").select("vec_id", fn.vector_literal(F.col("embedding")).alias("literal"))


@query("absolute_links", r"""SELECT page_id, sha256(string_agg(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href ELSE regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || href END, ' ' ORDER BY n)) AS links
    FROM (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) AS n FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"([^"#][^"]*)"', 1) AS h FROM pages)) WHERE regexp_matches(href, '^(/|[A-Za-z][A-Za-z0-9+.-]*:)') AND NOT regexp_matches(href, '(?i)^(mailto|javascript):') GROUP BY 1""")
def _(v):
    from .sources.discovery import anchors

    pages = v.table("pages")
    links = anchors(pages, "page_id", "html").where(F.rlike("href", F.lit("^(/|[A-Za-z][A-Za-z0-9+.-]*:)"))).join(pages.select("page_id", "url"), "page_id")
    rows = links.select("page_id", "position", fn.absolute(F.col("url"), F.col("href")).alias("a")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("position", "a"))).alias("l"))
    return rows.select("page_id", F.sha2(F.array_join(F.transform("l", lambda x: x["a"]), " "), 256).alias("links"))


@query("encoded_json", "SELECT id, CAST(CASE WHEN id % 3 < 2 THEN id END AS BIGINT) AS first, CASE WHEN id % 3 < 2 THEN title END AS name FROM opportunities", O)
def _(v):
    plain = F.to_json(F.array(F.struct("id", "title")))
    sent = F.when(F.col("id") % 3 == 0, F.base64(F.encode(plain, "UTF-8"))).when(F.col("id") % 3 == 1, plain).otherwise("neither")
    read = v.opportunities.select("id", fn.encoded_json(sent, "array<struct<id:bigint,title:string>>").alias("x"))
    return read.select("id", F.get("x", F.lit(0))["id"].alias("first"), F.get("x", F.lit(0))["title"].alias("name"))


portal_queries.register(query)

"""Domain tables over the star-schema test data, as Spark frames and as SQL for a second engine.

The columns are rules over keys, so both engines build the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-08-02 00:00:00"

_OPPORTUNITIES = """
    SELECT o_orderkey AS id, c_nationkey AS source_id, 'OPP-' || cast(o_orderkey AS {string}) AS external_id,
        p_type || ' ' || p_name || CASE WHEN o_orderkey % 9 = 0 THEN ' RFP' WHEN o_orderkey % 9 = 4 THEN ' task order' ELSE '' END AS title,
        c_name AS agency, c_mktsegment AS category,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Supply of ' || p_name || ', ' || p_brand || ', total small business lot ' || cast(o_orderkey % 7 AS {string}) END AS description,
        CASE WHEN o_orderkey % 3 = 0 THEN '5415' || cast(10 + o_orderkey % 4 AS {string}) ELSE NULL END AS naics_code,
        cast(o_orderdate AS date) AS posted_date,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE cast(o_orderdate AS timestamp) + {days} END AS due_date,
        cast(o_orderdate AS timestamp) AS first_seen_at,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS estimated_value,
        CASE WHEN o_orderkey % 8 = 0 THEN 'NEW' WHEN o_orderkey % 8 < 4 THEN 'OPEN' WHEN o_orderkey % 8 = 4 THEN 'AMENDED' WHEN o_orderkey % 8 = 5 THEN 'CLOSED'
            WHEN o_orderkey % 8 = 6 THEN 'CLOSING_SOON' ELSE 'AWARDED' END AS status,
        CASE o_orderkey % 10 WHEN 0 THEN 'REVIEWING' WHEN 1 THEN 'DRAFTING' WHEN 2 THEN 'SUBMITTED' WHEN 3 THEN 'WON' WHEN 4 THEN 'LOST' WHEN 5 THEN 'DECLINED' ELSE 'BACKLOG' END AS pipeline_stage,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(o_orderkey * 37 % 110 - 9 AS {int}) END AS relevance_score,
        CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE cast(o_orderkey * 53 % 97 AS {int}) END AS pursuit_score,
        CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderkey * 53 % 97 >= 80 THEN 'PURSUE' WHEN o_orderkey * 53 % 97 >= 60 THEN 'CAPTURE_REVIEW' WHEN o_orderkey * 53 % 97 >= 40 THEN 'MANUAL_REVIEW' ELSE 'IGNORE' END AS pursuit_bucket,
        CASE o_orderkey % 6 WHEN 0 THEN 'URGENT' WHEN 1 THEN 'STANDARD' WHEN 2 THEN 'EARLY_CAPTURE' WHEN 3 THEN 'INSUFFICIENT_TIME' WHEN 4 THEN 'NO_DATE' ELSE NULL END AS urgency,
        CASE WHEN o_orderkey % 5 = 0 THEN 'WOSB Set-Aside|HUBZone' WHEN o_orderkey % 5 = 1 THEN 'Small Business Set-Aside' ELSE '' END AS set_aside_list,
        CASE WHEN o_orderkey % 12 = 0 THEN 'GSA MAS' WHEN o_orderkey % 12 = 5 THEN 'BPA' ELSE NULL END AS contract_vehicle,
        CASE WHEN o_orderkey % 14 = 0 THEN 'Roofing (Construction)' WHEN o_orderkey % 14 = 7 THEN 'Fuel (Supplies)' ELSE NULL END AS excluded_reason,
        CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 20 ELSE NULL END AS assigned_to,
        CASE o_orderkey % 4 WHEN 0 THEN 'BID' WHEN 1 THEN 'NO_BID' WHEN 2 THEN 'REVIEW' ELSE NULL END AS bid_recommendation
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)"""

_SOURCES = """
    SELECT n_nationkey AS id, n_name AS name, lower(replace(n_name, ' ', '-')) AS slug, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE r_name END AS state,
        n_nationkey % 7 <> 3 AS is_active,
        CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE TIMESTAMP '1998-07-01 00:00:00' + {days} END AS last_success_at,
        CASE n_nationkey % 4 WHEN 0 THEN 'sam' WHEN 1 THEN 'tx' WHEN 2 THEN 'mo' ELSE 'unknown' END AS connector_key
    FROM nation JOIN region ON n_regionkey = r_regionkey"""

_RUNS = """
    SELECT event_id AS id, user_id % 25 AS source_id, ts AS started_at,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial' ELSE 'success' END AS status,
        cast(event_id % 50 AS {int}) AS new_count, cast(event_id % 20 AS {int}) AS changed_count
    FROM events"""

_CHILDREN = """
    SELECT l_orderkey AS opportunity_id, l_partkey AS part, l_linenumber AS line,
        CASE WHEN l_returnflag = 'R' THEN 'response' WHEN l_returnflag = 'A' THEN 'version' ELSE 'attachment' END AS kind
    FROM lineitem"""

_RESPONSES = """
    SELECT conv_id AS opportunity_id, turn AS turn, CASE WHEN role = 'user' THEN 'STYLE_MATCHED' ELSE 'LLM_ORIGINAL' END AS mode, text AS content FROM conversations"""


def _sql(body: str, engine: str) -> str:
    days = {"opportunities": "o_orderkey % 60", "sources": "n_nationkey"}["opportunities" if "o_orderkey" in body else "sources"]
    words = {"spark": {"string": "string", "int": "int", "days": f"make_interval(0, 0, 0, cast({days} AS int))"}, "duckdb": {"string": "VARCHAR", "int": "INTEGER", "days": f"to_days(cast({days} AS INTEGER))"}}
    return body.format(**words[engine])


def with_views(query: str, *names: str) -> str:
    """SQL for the second engine: the query with the named domain tables before it."""
    bodies = {"opportunities": _OPPORTUNITIES, "sources": _SOURCES, "runs": _RUNS, "children": _CHILDREN, "responses": _RESPONSES}
    parts = [f"{n} AS MATERIALIZED ({_sql(bodies[n], 'duckdb')})" for n in names]
    return f"WITH {', '.join(parts)} {query.strip()}" if not query.strip().upper().startswith("WITH ") else f"WITH {', '.join(parts)}, {query.strip()[5:]}"


class Views:
    """The domain tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.as_of = F.lit(AS_OF).cast("timestamp")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _with(self, body: str, tables: tuple[str, ...]) -> DataFrame:
        sql = _sql(body, "spark")
        frames = {t: self.table(t) for t in tables}
        for t in tables:
            for lead in ("FROM ", "JOIN "):
                sql = sql.replace(f"{lead}{t}", f"{lead}{{{t}}}")
        return self.spark.sql(sql, **frames)

    @cached_property
    def opportunities(self) -> DataFrame:
        rows = self._with(_OPPORTUNITIES, ("orders", "customer", "part"))
        return rows.withColumn("set_asides", F.filter(F.split("set_aside_list", r"\|"), lambda x: x != ""))

    @cached_property
    def sources(self) -> DataFrame:
        return self._with(_SOURCES, ("nation", "region"))

    @cached_property
    def runs(self) -> DataFrame:
        return self._with(_RUNS, ("events",))

    @cached_property
    def children(self) -> DataFrame:
        return self._with(_CHILDREN, ("lineitem",))

    @cached_property
    def responses(self) -> DataFrame:
        return self._with(_RESPONSES, ("conversations",))

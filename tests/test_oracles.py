"""Registered queries against their SQL in a second engine."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tenderloom import catalogue

FOLDER = "/root/testdata/sf0.001"


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) in ("NaT", "<NA>"):
        return ""
    return str(round(float(value), 6)) if isinstance(value, int | float) and not isinstance(value, bool) else str(value)


def _rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple(_plain(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    engine = duckdb.connect(config={"threads": 2})
    for file in os.listdir(FOLDER):
        engine.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    mine, other = catalogue.QUERIES[name](spark, FOLDER).toPandas(), engine.execute(catalogue.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert _rows(mine) == _rows(other)

"""Registered queries against DuckDB on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from punctuality.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "lineitem orders events customer supplier part nation region".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", ["metrics_overall", "all_scopes", "daily_statistics", "rank_airlines", "time_of_day", "trend_by_route", "repeat_cancellations", "fold_hourly", "alerts_disruption", "report_today", "merge_records", "latest_state", "derive_events", "provider_health", "parse_board_a", "flight_detail", "list_flights", "stream_hourly_counts"])
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(v) for v in r) for r in frame.select(*columns).collect())
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got and got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0

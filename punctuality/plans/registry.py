"""All registered queries of the library's own operators."""

from __future__ import annotations

from punctuality.plans import analytics, boards, collection, streams


def queries() -> dict:
    return {**analytics.QUERIES, **collection.QUERIES, **boards.QUERIES, **streams.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**analytics.ORACLE, **collection.ORACLE, **boards.ORACLE, **streams.ORACLE}

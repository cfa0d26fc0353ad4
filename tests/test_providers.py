"""Rests of providers and the attempts that fall in them, against the rules applied call by call."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest

from punctuality.operators import history, providers
from punctuality.params import DEFAULT

CALLS = "provider string, called_at timestamp_ntz, call_id long, ok boolean, rate_limited boolean, retry_after_s int"
START = datetime(2026, 9, 6)


def rested(calls, provider, at, p):
    """The state that the calls before leave, as a cycle keeps it: a success clears it."""
    until, failures, last = None, 0, None
    for name, called, _, ok, limited, retry in sorted(calls, key=lambda c: (c[1], c[2])):
        if name != provider or called >= at:
            continue
        if ok:
            until, failures = None, 0
            continue
        failures, last = failures + 1, called
        if limited:
            until = called + timedelta(seconds=retry or p.provider_recovery_s)
    return bool((until and until > at) or (failures >= p.provider_failures and at - last <= timedelta(seconds=p.provider_recovery_s)))


@pytest.mark.parametrize("failures", [1, 2, 3])
def test_rests_by_the_rules(spark, failures):
    p, rng = replace(DEFAULT, provider_failures=failures), random.Random(failures)
    calls = []
    for i in range(260):
        ok = rng.random() < 0.45
        limited = rng.random() < 0.3
        calls.append((rng.choice("aab"), START + timedelta(seconds=60 * rng.randrange(1500)), i, ok, limited, rng.choice([None, 120, 3600, 9000])))
    attempts = [(i, rng.choice("abc"), START + timedelta(seconds=60 * rng.randrange(1600))) for i in range(150)]
    attempts += [(1000 + c[2], c[0], c[1] + timedelta(seconds=s)) for c in calls[:40] for s in (900,)] + [(2000 + c[2], c[0], c[1]) for c in calls[:40]]
    log = spark.createDataFrame(calls, CALLS)
    got = providers.answers(spark.createDataFrame(attempts, "attempt long, provider string, at timestamp_ntz"), log, p)
    assert {r["attempt"]: r["paused"] for r in got.collect()} == {i: rested(calls, name, at, p) for i, name, at in attempts}


def test_no_calls_and_no_attempts(spark):
    none, attempts = spark.createDataFrame([], CALLS), spark.createDataFrame([(1, "a", START)], "attempt long, provider string, at timestamp_ntz")
    assert [r["paused"] for r in providers.answers(attempts, none).collect()] == [False]
    assert providers.answers(attempts.limit(0), none).count() == 0


def test_a_resting_source_is_passed_over(spark):
    """The first in the order of trust that answered and was not resting."""
    calls = [("primary", START, 1, False, True, 7200), ("second", START, 2, True, False, None)]
    later = [(10, "primary", START + timedelta(hours=1)), (11, "second", START + timedelta(hours=1)), (12, "primary", START + timedelta(hours=3))]
    asked = spark.createDataFrame([(i, n, at, f"r{at.hour}", "IST", True) for i, n, at in later], "attempt long, provider string, at timestamp_ntz, run_id string, origin_iata string, ok boolean")
    told = providers.answers(asked, spark.createDataFrame(calls, CALLS)).withColumnRenamed("provider", "data_source")
    assert sorted((r["run_id"], r["data_source"]) for r in history.failover(told).collect()) == [("r1", "second"), ("r3", "primary")]


def test_runs_count_flights_gone_stale(spark):
    """A row a flight and time; a run finds those gone that its origin's board told nothing of for three hours."""
    hour = lambda h, m=0: START + timedelta(hours=h, minutes=m)
    told = [
        ("TK1", "IST", "SCHEDULED", hour(1), "r01"), ("TK1", "IST", "DELAYED", hour(9), "r09"),  # gone in r05, again in r13
        ("TK2", "IST", "DEPARTED", hour(1), "r01"), ("TK3", "IST", "SCHEDULED", hour(2), "r02"), ("TK3", "IST", "SCHEDULED", hour(5, 30), "r05"),  # told of in r05
        ("TK4", "SAW", "SCHEDULED", hour(1), "r01"),  # its board is never read again
        ("TK5", "IST", "DEPARTED", hour(5, 40), "r05"), ("TK6", "IST", "DEPARTED", hour(13), "r13"),
    ]
    rows = [(n, o, "IKA", START.date(), s, at, i, run) for i, (n, o, s, at, run) in enumerate(told)]
    schema = "flight_number string, origin_iata string, destination_iata string, flight_date_local date, status string, observed_at timestamp_ntz, observation_id long, run_id string"
    got = {r["run_id"]: r["stale_marked"] for r in history.went_stale(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"r05": 1, "r09": 1, "r13": 1}

"""Scalar functions, boards, merges, folds and events on small cases."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from punctuality.functions import scalars
from punctuality.operators import alerts, history, insights, population
from punctuality.sources import boards
from punctuality.streaming import jobs


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.out for r in rows.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_status_words(spark):
    cases = {"In Flight (holding)": "DEPARTED", "CANCELED by carrier": "CANCELLED", "planned": "SCHEDULED", "Final-Call!": "BOARDING", "  ": "UNKNOWN", "no idea": "UNKNOWN", None: "UNKNOWN", "gate arrival": "ARRIVED", "notoperational": "CANCELLED", "will divert": "DIVERTED", "Rescheduled 14:00": "DELAYED"}
    assert column(spark, cases, scalars.status) == list(cases.values())


def test_designators(spark):
    cases = {"lh 0400": "LH400", "QS 12 3B": "QS123B", "7C 0005x": "7C5X", "": None, "\t": None, "zz0000": "ZZ0", "NONE": "NONE", None: None, "U2 91": "U291"}
    assert column(spark, cases, scalars.flight_number) == list(cases.values())


def test_iso_times(spark):
    want = datetime(2026, 9, 6, 5, 15)
    cases = {"2026-09-06 05:15Z": want, "2026-09-06T08:15:00+03:00": want, "2026-09-06 05:15z": want, "2026-09-06T05:15": None, "soon": None, None: None, "2026-09-06T05:15:00Z": want}
    assert column(spark, cases, scalars.parse_iso) == list(cases.values())


def test_minutes_cut_toward_zero(spark):
    a = datetime(2026, 9, 6, 5, 0)
    rows = spark.createDataFrame([(a, a.replace(second=30)), (a.replace(second=30), a), (a, None), (a, a.replace(minute=7, second=59))], "x timestamp_ntz, y timestamp_ntz")
    assert [r[0] for r in rows.select(scalars.minutes_between(F.col("y"), F.col("x"))).collect()] == [0, 0, None, 7]


def test_local_times(spark):
    utc = datetime(2026, 9, 6, 23, 30)
    r = spark.createDataFrame([(utc,)], "t timestamp_ntz").select(scalars.local(F.col("t")).alias("l")).first()
    assert r.l == datetime(2026, 9, 7, 2, 30)
    twice = spark.createDataFrame([(datetime(2025, 10, 26, 2, 30),)], "t timestamp_ntz").select(scalars.assume_zone(F.col("t"), "Europe/Berlin").alias("u")).first()
    assert twice.u == datetime(2025, 10, 26, 0, 30)  # the first of the two


def test_filters_and_windows():
    today = datetime(2026, 9, 10).date()
    assert population.resolve_window("mtd", today)[0].day == 1
    assert (today - population.resolve_window("7d", today)[0]).days == 6
    with pytest.raises(ValueError):
        population.resolve_window("7d", today, start=today, end=today.replace(day=1))
    with pytest.raises(ValueError):
        population.filtered(None, route="IST")


def with_path(item, **changes):
    """A copy of nested JSON with values put at paths (a__b__c)."""
    out = json.loads(json.dumps(item))
    for path, value in changes.items():
        *way, last = path.split("__")
        at = out
        for step in way:
            at = at.setdefault(step, {})
        at[last] = value
    return out


def board(spark, field, *items):
    texts = [json.dumps({field: list(items)}), "{", "[]", "null", None]
    rows = [(t, "SAW", datetime(2027, 2, 3, 11)) for t in texts]
    return spark.createDataFrame(rows, "raw string, origin_iata string, observed_at timestamp_ntz")


def numbered(leg, cases):
    """One item a case, under the numbers Q100, Q101 and so on."""
    return [with_path(leg, **{"number" if "number" in leg else "ident": f"Q{100 + i}"} | changes) for i, (changes, _) in enumerate(cases)]


LEG_A = {"number": "Q1", "departure": {"scheduledTime": {"utc": "2027-02-03 21:40Z"}}, "arrival": {"airport": {"iata": "THR"}}}
#: What is changed, and what comes out: nothing, or status, delay, quality.
CASES_A = [
    ({}, ("UNKNOWN", None, "PARTIAL")),
    ({"status": "boarding", "arrival__scheduledTime__utc": "2027-02-04 01:00Z"}, ("BOARDING", None, "OK")),
    ({"departure__revisedTime__utc": "2027-02-03 21:57Z", "status": "Scheduled"}, ("DELAYED", 17, "PARTIAL")),
    ({"departure__revisedTime__utc": "2027-02-03 21:54Z", "status": "Scheduled"}, ("SCHEDULED", 14, "PARTIAL")),
    ({"departure__runwayTime__utc": "2027-02-03 21:31Z"}, ("DEPARTED", -9, "PARTIAL")),
    ({"status": "was CANCELled today", "departure__revisedTime__utc": "2027-02-03 22:40Z"}, ("CANCELLED", None, "PARTIAL")),
    ({"departure__scheduledTime": {"local": "2027-02-04 00:40+03:00"}}, ("UNKNOWN", None, "PARTIAL")),
    ({"arrival__airport__iata": " thr "}, ("UNKNOWN", None, "PARTIAL")),
    ({"arrival__airport__iata": "ESB"}, None),
    ({"isCargo": True}, None),
    ({"codeshareStatus": "isCODEshared"}, None),
    ({"departure__scheduledTime__utc": "soon"}, None),
    ({"number": " "}, None),
]
LEG_C = {"ident": "Q1", "destination": {"code_iata": "THR"}, "scheduled_off": "2027-02-03T21:40:00Z"}
CASES_C = [
    ({"departure_delay": 1439}, ("DELAYED", 23)),
    ({"departure_delay": -1439, "status": "On its way"}, ("UNKNOWN", -23)),
    ({"scheduled_out": "2027-02-03T21:30:00Z", "actual_off": "2027-02-03T21:41:30Z"}, ("DEPARTED", 11)),
    ({"cancelled": True, "departure_delay": 600}, ("CANCELLED", None)),
    ({"diverted": True}, ("DIVERTED", None)),
    ({"position_only": True}, None),
    ({"destination": {"code": "THR"}}, ("UNKNOWN", None)),
]


def test_boards(spark):
    told = {r.flight_number: (r.status, r.delay_minutes, r.data_quality) for r in boards.parse_a(board(spark, "departures", *numbered(LEG_A, CASES_A)), ("THR",)).collect()}
    assert told == {f"Q{100 + i}": want for i, (_, want) in enumerate(CASES_A) if want}
    rows = board(spark, "scheduled_departures", *numbered(LEG_C, CASES_C))
    told = {r.flight_number: (r.status, r.delay_minutes) for r in boards.parse_c(rows, ("THR",)).collect()}
    assert told == {f"Q{100 + i}": want for i, (_, want) in enumerate(CASES_C) if want}
    assert boards.parse_c(rows, ("THR",), codeshares=True).count() == len(told) + 1 and boards.parse_b(rows).count() == 0


def test_codeshares_and_window_of_board_b(spark):
    """An empty object says nothing about another's number; a window has its start, not its end."""
    leg = lambda number, hour, shared: f"""{{"flight": {{"iata": "{number}", "codeshared": {shared}}}, "arrival": {{"iata": "IKA"}}, "departure": {{"scheduled": "2026-09-06T0{hour}:00:00+00:00"}}}}"""
    text = '{"data": [' + ", ".join([leg("A1", 1, "{}"), leg("A2", 2, "null"), leg("A3", 3, '{"flight_iata": "bb 07"}'), leg("A4", 4, "{}")]) + "]}"
    rows = spark.createDataFrame([(text, "IST", datetime(2026, 9, 6))], "raw string, origin_iata string, observed_at timestamp_ntz")
    assert sorted(r.flight_number for r in boards.parse_b(rows).collect()) == ["A1", "A2", "A4"]
    every = {r.flight_number: (r.is_codeshare, r.codeshare_of) for r in boards.parse_b(rows, codeshares=True).collect()}
    assert every["A3"] == (True, "BB7") and every["A1"] == (False, None)
    at = lambda h: F.lit(f"2026-09-06 0{h}:00:00").cast("timestamp_ntz")
    assert sorted(r.flight_number for r in boards.parse_b(rows, window=(at(1), at(4))).collect()) == ["A1", "A2"]


def test_import_only_into_an_empty_history(spark):
    rows = seen(spark, dict(status="SCHEDULED"), dict(status="CANCELLED", is_cancelled=True, flight_number="M1", is_mock=True))
    new = history.tables(rows)
    taken = history.importable(new, new["flights"].limit(0))
    assert {name: t.count() for name, t in taken.items()} == {"airlines": 0, "flights": 1, "observations": 1, "events": 1, "runs": 1}
    assert all(t.count() == 0 for t in history.importable(new, new["flights"]).values())


def test_export_is_read_back_and_checked(spark, tmp_path):
    rows, path = seen(spark, *[dict(status="SCHEDULED", flight_number=n, is_mock=n == "MOCK1") for n in ("TK1", "TK2", "MOCK1", "TK1")]), str(tmp_path / "export")
    history.export(rows, path)
    held = history.load(spark, path)
    for name, table in history.tables(rows).items():
        assert sorted(map(str, held[name].collect())) == sorted(map(str, table.collect())) and held[name].columns == table.columns
    taken = history.importable(held, held["flights"].limit(0))
    assert {n: t.count() for n, t in taken.items()} | {"airlines": 0} == {"airlines": 0, "flights": 2, "observations": 3, "events": 2, "runs": 1}
    held["events"].limit(1).write.mode("append").parquet(f"{path}/events")
    with pytest.raises(ValueError, match="events has"):
        history.load(spark, path)
    with pytest.raises(ValueError, match="no finished export"):
        history.load(spark, str(tmp_path))


def test_details_are_nested_and_in_order(spark):
    rows = seen(spark, dict(status="DELAYED", delay_minutes=20), dict(status="SCHEDULED", observed_at=datetime(2026, 9, 6, 3)), dict(status="BOARDING", flight_number="TK2"))
    full = {r.flight_number: r for r in history.detail(history.latest_state(rows), rows, history.derive_events(rows)).collect()}
    assert [o.observation_id for o in full["TK878"].observations] == [1, 0] and full["TK878"].status == "DELAYED"
    assert [(e.observation_id, e.event_type) for e in full["TK878"].events] == [(1, "FIRST_SEEN"), (0, "DELAY_INCREASED"), (0, "STATUS_CHANGED")]
    assert len(full["TK2"].observations) == len(full["TK2"].events) == 1


def test_payloads_are_kept_where_asked_for(spark):
    raw = '{"departures": [{"number": "TK 1", "note": {"deep": [1, 2]}, "departure": {"scheduledTime": {"utc": "2026-09-06 05:15Z"}}, "arrival": {"airport": {"iata": "IKA"}}}]}'
    rows = spark.createDataFrame([(raw, "IST", datetime(2026, 9, 6, 4))], "raw string, origin_iata string, observed_at timestamp_ntz")
    assert "raw_payload" not in boards.parse_a(rows).columns
    kept = boards.parse_a(rows, keep_raw=True).select("flight_number", F.try_variant_get("raw_payload", "$.note.deep[1]", "int").alias("deep"))
    assert [tuple(r) for r in kept.collect()] == [("TK1", 2)]


def test_plans_compile(spark):
    """No parser's code is too large to be generated."""
    from punctuality.plans import boards as board_plans

    for name in ("a", "b", "c"):
        plan = board_plans.QUERIES[f"parse_board_{name}"](spark, "/root/testdata/sf0.001")
        code = plan._jdf.queryExecution().debug().codegenToSeq()
        assert code.size() > 0 and all(code.apply(i)._3().maxMethodCodeSize() > 0 for i in range(code.size()))


OBS = {c: "string" for c in (*history.FIELDS, "flight_number", "origin_iata", "destination_iata", "run_id", "data_source", "status", "raw_status", "data_quality")}
OBS |= {c: "timestamp_ntz" for c in OBS if c.endswith("_utc")} | {"observed_at": "timestamp_ntz", "observation_id": "long", "flight_date_local": "date", "delay_minutes": "int", "arrival_delay_minutes": "int"}
OBS |= {c: "boolean" for c in ("is_cancelled", "is_diverted", "is_codeshare", "is_mock")}
SHAPE = ", ".join(f"{c} {t}" for c, t in OBS.items())


def seen(spark, *rows):
    at = datetime(2026, 9, 6, 5, 15)
    base = dict(flight_number="TK878", origin_iata="IST", destination_iata="IKA", flight_date_local=at.date(), run_id="r", data_source="primary", scheduled_departure_utc=at, is_cancelled=False, is_diverted=False, is_codeshare=False, data_quality="OK", is_mock=False)
    full = [base | dict(observation_id=i, observed_at=datetime(2026, 9, 6, 4, i)) | r for i, r in enumerate(rows)]
    full = [r | dict(raw_status=r.get("raw_status", r["status"].lower())) for r in full]
    return spark.createDataFrame([tuple(r.get(c) for c in OBS) for r in full], SHAPE)


def test_three_cycles(spark):
    rows = seen(spark, dict(status="SCHEDULED", delay_minutes=0, gate="A1"), dict(status="DELAYED", delay_minutes=35), dict(status="DEPARTED", delay_minutes=70, gate="B2"))
    (state,) = history.latest_state(rows).collect()
    assert (state.status, state.delay_minutes, state.gate, state.observation_count) == ("DEPARTED", 70, "B2", 3)
    kinds = [r.event_type for r in history.derive_events(rows).orderBy("observation_id").collect()]
    assert sorted(kinds) == sorted(["FIRST_SEEN", "STATUS_CHANGED", "DELAY_INCREASED", "STATUS_CHANGED", "DEPARTED", "DELAY_INCREASED", "GATE_CHANGED"])


def test_states_fold_in_any_order(spark):
    """Each single record a state of its own, folded in several orders and groupings."""
    rows = seen(
        spark, dict(status="SCHEDULED", delay_minutes=0, gate="A1", terminal=""), dict(status="DELAYED", delay_minutes=35, terminal="2", airline_icao="THY"),
        dict(status="DEPARTED", delay_minutes=70, gate="B2", terminal="", airline_icao=""), dict(status="DEPARTED", gate=None, scheduled_departure_utc=datetime(2026, 9, 6, 7)),
    )
    (want,) = history.latest_state(rows).collect()
    assert (want.status, want.delay_minutes, want.gate, want.terminal, want.airline_icao, want.observation_count) == ("DEPARTED", 70, "B2", "2", "THY", 4)
    assert (want.first_scheduled_departure_utc, want.scheduled_hour_local, want.scheduled_dow_local) == (datetime(2026, 9, 6, 5, 15), 10, 7)
    parts = [history.state_of(rows.where(F.col("observation_id") == i)) for i in range(4)]
    for order in ((3, 0, 2, 1), (1, 3, 0, 2)):
        state = parts[order[0]]
        for i in order[1:]:
            state = history.fold_states(state.unionByName(parts[i]))
        assert history.flights_of(state).collect() == [want]
    moved = history.displacement(history.latest_state(rows)).first()
    assert (moved.schedule_moved_minutes, moved.total_displacement_minutes) == (105, 175)


def test_merge_rules(spark):
    at = datetime(2026, 9, 6, 5, 50)
    rows = seen(
        spark, dict(status="SCHEDULED", data_source="third", gate="C3", terminal="1", actual_departure_utc=at, is_cancelled=True, aircraft_type="A333"), dict(status="SCHEDULED", data_source="primary", gate="A1", estimated_departure_utc=datetime(2026, 9, 6, 5, 30)),
        dict(status="SCHEDULED", data_source="other", terminal="9", actual_departure_utc=datetime(2026, 9, 6, 5, 55)), dict(status="ARRIVED", data_source="second", gate="M", aircraft_registration="TC-M", is_mock=True),
    )
    (m,) = history.merge(history.legs(rows)).collect()
    assert (m.gate, m.terminal, m.actual_departure_utc, m.status, m.delay_minutes, m.data_source) == ("A1", "1", at, "DEPARTED", 35, "primary+third+other")
    assert (m.aircraft_type, m.aircraft_registration, m.records) == ("A333", None, 4)
    assert m.field_sources["gate"] == "primary" and m.field_sources["aircraft_type"] == "third" and m.field_sources["status"] == "derived" and m.field_sources["is_cancelled"] == "primary"
    assert "aircraft_registration" not in m.field_sources and sorted(m.conflicts) == ["actual_departure_utc", "is_cancelled"]
    # minutes tell times apart, not seconds
    near = seen(spark, dict(status="DEPARTED", actual_departure_utc=at), dict(status="DEPARTED", data_source="second", actual_departure_utc=at.replace(second=40)))
    assert history.merge(history.legs(near)).first().conflicts == []


def test_a_lone_record_passes_through(spark):
    rows = seen(spark, dict(status="SCHEDULED", delay_minutes=40, arrival_delay_minutes=3, data_quality="PARTIAL"), dict(status="DEPARTED", is_mock=True, data_source="second"))
    (m,) = history.merge(history.legs(rows)).collect()
    assert (m.status, m.delay_minutes, m.arrival_delay_minutes, m.data_quality, m.conflicts) == ("SCHEDULED", 40, 3, "PARTIAL", [])
    assert m.field_sources == dict.fromkeys(history.FIELDS, "primary")
    only_mock = history.merge(history.legs(rows.where("is_mock"))).first()
    assert only_mock.is_mock and only_mock.data_source == "second"


def test_airlines_known_by_icao_alone(spark):
    rows = seen(
        spark, dict(status="SCHEDULED", airline_icao="IRM", airline_name="Old"), dict(status="SCHEDULED", airline_icao="IRM", airline_name="New"), dict(status="SCHEDULED", airline_iata="TK"),
        dict(status="SCHEDULED", airline_iata="TK", airline_icao="THY", airline_name=""), dict(status="SCHEDULED", airline_icao="THY", airline_name="Turkish"), dict(status="SCHEDULED", airline_name="No code"),
    )
    assert sorted(map(tuple, history.airlines(rows).collect()), key=str) == [("TK", "THY", "Turkish"), (None, "IRM", "New")]


def test_run_counters_come_from_events(spark):
    rows = seen(
        spark, dict(status="SCHEDULED", delay_minutes=0), dict(status="SCHEDULED", delay_minutes=1, data_source="second", gate="A"), dict(status="SCHEDULED", delay_minutes=1, data_source="second"),
        dict(status="CANCELLED", is_cancelled=True, run_id="s"), dict(status="CANCELLED", is_cancelled=True, run_id="s", data_source="second"),
    )
    r, s = history.run_summary(rows, ("IST", "IKA")).orderBy("run_id").collect()
    assert (r.flights_seen, r.duplicates_skipped, r.enriched_flights, r.flights_created, r.observations_written, r.missing_origins) == (1, 2, 1, 1, 2, "IKA")
    # two records of a cancelled flight, one event
    assert (s.cancellations_detected, s.flights_created, s.flights_updated, s.merge_conflicts) == (1, 0, 1, 0)


def test_history_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "history")
    one = seen(spark, dict(status="SCHEDULED", run_id="2026090604"), dict(status="SCHEDULED", run_id="2026090604"), dict(status="SCHEDULED", run_id="2026090705"))
    history.append(one, path)
    history.append(one, path)
    history.append(seen(spark, dict(status="SCHEDULED", run_id="2026090604", data_source="second"), dict(status="SCHEDULED", run_id="2026090604")), path)
    assert sorted((r.run_id, r.data_source) for r in spark.read.parquet(path).collect()) == [("2026090604", "primary"), ("2026090604", "second"), ("2026090705", "primary")]


def test_failover_and_cooldown(spark):
    tried = [("r", "IST", "primary", False, False), ("r", "IST", "second", True, False), ("r", "IST", "third", True, False), ("s", "IST", "primary", True, True), ("s", "IST", "third", True, False), ("t", "IST", "primary", False, False)]
    answers = spark.createDataFrame(tried, "run_id string, origin_iata string, data_source string, ok boolean, paused boolean")
    assert sorted(map(tuple, history.failover(answers).collect())) == [("r", "IST", "second"), ("s", "IST", "third")]
    at = lambda m: datetime(2026, 9, 6, 5, m)
    log = [("a", 1, at(0), True, False, None), ("a", 2, at(5), False, True, 60), ("b", 3, at(0), False, True, None), ("b", 4, at(1), True, False, None), ("c", 5, at(1), False, False, None), ("c", 6, at(2), False, False, None), ("c", 7, at(3), False, False, None)]
    calls = spark.createDataFrame(log, "provider string, call_id int, called_at timestamp_ntz, ok boolean, rate_limited boolean, retry_after_s int")
    got = {r.provider: (r.consecutive_failures, r.healthy, r.cooldown_until, r.open_at) for r in history.provider_health(calls).collect()}
    assert got == {"a": (1, True, at(6), at(6)), "b": (0, True, None, None), "c": (3, False, None, at(18))}


def test_ledger(spark):
    built = spark.createDataFrame([("CANCELLATION", k, i, "IST-IKA") for i, k in enumerate("aabc")], "alert_type string, dedup_key string, flight_id long, route string")
    ledger = spark.createDataFrame([("b",)], "dedup_key string")
    assert sorted(r.dedup_key for r in alerts.unsent(built, ledger).collect()) == ["a", "c"]
    (t,) = alerts.tally(built, ledger).collect()
    assert (t.built, t.new, t.duplicate) == (4, 2, 2)


def test_first_schedule(spark):
    flights = spark.createDataFrame([("A1", "AAA", "BBB", datetime(2026, 1, 2, 9)), ("A2", "AAA", "BBB", datetime(2026, 1, 2, 8))], "flight_number string, origin_iata string, destination_iata string, scheduled_departure_utc timestamp_ntz")
    keys = history.FLIGHT
    flights = flights.select(*[(F.col(k) if k in flights.columns else F.lit("x")).alias(k) for k in keys], *[c for c in flights.columns if c not in keys])
    rows = flights.where("flight_number = 'A1'").crossJoin(spark.createDataFrame([(datetime(2026, 1, 2, h),) for h in (9, 7, 8)], "_at timestamp_ntz"))
    got = history.first_schedule(flights, rows.withColumn("scheduled_departure_utc", F.col("_at")).drop("_at"))
    # A2 has no observation: its own schedule
    assert {r["flight_number"]: r["first_scheduled_departure_utc"] for r in got.collect()} == {"A1": datetime(2026, 1, 2, 7), "A2": datetime(2026, 1, 2, 8)}


def test_backfill_reads_all_observations(spark):
    """The earliest schedule of a flight may stand in any row."""
    from punctuality.plans import collection
    from punctuality.sources import adapters

    sf = "/root/testdata/sf0.001"
    least = {}
    for r in adapters.observations(spark, sf).select(*history.FLIGHT, "scheduled_departure_utc").collect():
        if r[-1] is not None:
            least[r[:-1]] = min(r[-1], least.get(r[:-1], r[-1]))
    got = {r[:-1]: r[-1] for r in collection.QUERIES["backfill_first_schedule"](spark, sf).collect()}
    assert got and all(got[k] == v for k, v in least.items())


# --- streams: several micro-batches, out of order, replayed ---


def in_batches(spark, tmp_path, rows, *batches):
    """A stream of files, one a micro-batch, of the given observation ids each."""
    import os
    import time

    folder = tmp_path / "rows"
    for n, ids in enumerate(batches):
        rows.where(F.col("observation_id").isin(ids)).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("*.parquet"):
            if not getattr(in_batches, "seen", set()) & {str(f)}:
                in_batches.seen = getattr(in_batches, "seen", set()) | {str(f)}
                os.utime(f, (time.time() - 1000 + n, time.time() - 1000 + n))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def flown(spark):
    return seen(
        spark, dict(status="SCHEDULED", delay_minutes=0, gate="A1"), dict(status="DELAYED", delay_minutes=35, gate="B2", terminal="1"), dict(status="DELAYED", delay_minutes=35, gate="B2"),
        dict(status="DEPARTED", delay_minutes=70, gate="B3"), dict(status="CANCELLED", is_cancelled=True, flight_number="W5113"), dict(status="SCHEDULED", delay_minutes=9, flight_number="W5113"),
    )


ORDERS = [([0, 1], [2, 3], [4, 5]), ([3, 5], [0, 4], [2], [1]), ([1], [1, 0], [3, 4], [2, 3], [5])]



@pytest.mark.parametrize("order", ORDERS)
def test_streamed_events_are_those_of_the_batch(spark, tmp_path, order):
    rows = flown(spark)
    want = sorted(map(str, history.derive_events(rows).collect()))
    got = jobs.last_word(jobs.run_now(jobs.events(in_batches(spark, tmp_path, rows, *order))))
    assert sorted(map(str, got.select(*history.derive_events(rows).columns).collect())) == want


def test_streamed_events_of_a_long_history(spark, tmp_path):
    """Sixty rows of two flights over three days, in batches of any order."""
    import random

    rng = random.Random(3)
    told = [
        dict(status=rng.choice(["SCHEDULED", "DELAYED", "BOARDING"]), delay_minutes=rng.randrange(60), gate=rng.choice("AB"), flight_number=rng.choice(["TK1", "TK1", "TK2"]),
             observed_at=datetime(2026, 9, 6) + timedelta(minutes=rng.randrange(60 * 44)))
        for _ in range(60)
    ]
    rows, ids = seen(spark, *told), list(range(60))
    rng.shuffle(ids)
    got = jobs.last_word(jobs.run_now(jobs.events(in_batches(spark, tmp_path, rows, ids[:25], ids[20:32], ids[32:59], ids[50:]))))
    want = history.derive_events(rows)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("order", ORDERS)
def test_streamed_state_is_that_of_the_batch(spark, tmp_path, order):
    rows, folder, stats = flown(spark), str(tmp_path / "state"), str(tmp_path / "stats")
    query = jobs.upsert_latest(in_batches(spark, tmp_path, rows, *order), folder, stats)
    query.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    want = history.latest_state(rows)
    assert sorted(map(str, jobs.latest(spark, folder).collect())) == sorted(map(str, want.collect()))
    # a batch that is run again changes nothing
    last = max(int(r.v) for r in spark.read.parquet(folder).select("v").distinct().collect())
    ids = order[-1]
    if len(order) == 3:
        jobs.fold_batch(rows.where(F.col("observation_id").isin(ids)), last, folder)
        assert sorted(map(str, jobs.latest(spark, folder).collect())) == sorted(map(str, want.collect()))
    daily = insights.daily(jobs.facts_of(want))
    assert sorted(map(str, spark.read.parquet(f"{stats}/daily").select(*daily.columns).collect())) == sorted(map(str, daily.collect()))


@pytest.mark.parametrize("killed", [None, "history", "state"])
def test_history_and_state_are_published_together(spark, tmp_path, killed):
    """Killed between its sinks and run again, a batch leaves what the batch jobs give; until
    then readers see what was there before."""
    rows, folder = flown(spark), str(tmp_path / "all")
    rows = rows.withColumn("run_id", F.when(F.col("observation_id") < 3, "2026090604").otherwise("2026090605"))
    first, second = rows.where(F.col("observation_id").isin(0, 3, 4)), rows.where(F.col("observation_id") != 0)
    show = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert jobs.published(spark, folder) == -1 and jobs.history_now(spark, folder, rows.schema).count() == 0
    jobs.ingest_batch(first, 0, folder)
    before = show(jobs.history_now(spark, folder, rows.schema)), show(jobs.latest_now(spark, folder))
    if killed:
        with pytest.raises(RuntimeError):
            jobs.ingest_batch(second, 1, folder, killed)
        assert (show(jobs.history_now(spark, folder, rows.schema)), show(jobs.latest_now(spark, folder))) == before
    for _ in range(2):
        jobs.ingest_batch(second, 1, folder)
    kept = history.append_observations(first, rows.limit(0)).unionByName(history.append_observations(second, first))
    assert show(jobs.history_now(spark, folder, rows.schema)) == show(kept)
    assert show(jobs.latest_now(spark, folder)) == show(history.latest_state(kept))
    jobs.ingest_batch(rows, 2, folder)  # all told before
    assert show(jobs.history_now(spark, folder, rows.schema)) == show(kept) and jobs.published(spark, folder) == 2


@pytest.mark.parametrize("order", [([0, 2], [1, 3], [4], [5], [6]), ([6, 4, 2], [5, 3], [1], [0]), ([0, 1, 2, 3, 4, 5, 6],)])
def test_flights_go_stale_where_their_board_was_read(spark, tmp_path, order):
    """In and out of order: a settled flight, one that fell silent, one of a board that failed, one
    that was told again in time."""
    hour = lambda d, h: datetime(2026, 9, d, h)
    rows = seen(
        spark, dict(status="DEPARTED", observed_at=hour(6, 5)), dict(status="SCHEDULED", observed_at=hour(6, 4)), dict(status="BOARDING", flight_number="W5113", observed_at=hour(6, 5)),
        dict(status="SCHEDULED", flight_number="W5113", observed_at=hour(6, 4)), dict(status="SCHEDULED", flight_number="TK1", origin_iata="MHD", observed_at=hour(6, 4)),
        dict(status="SCHEDULED", flight_number="TK2", observed_at=hour(6, 9)), dict(status="DEPARTED", flight_number="TK3", observed_at=hour(6, 4)),
    )
    read = [("IST", hour(6, 6), True), ("IST", hour(6, 9), True), ("IST", hour(6, 11), False), ("MHD", hour(6, 9), False), ("IST", hour(12, 5), False), ("THR", hour(12, 6), True)]
    folder = str(tmp_path / "boards")
    spark.createDataFrame(read, "origin_iata string, read_at timestamp_ntz, ok boolean").coalesce(1).write.parquet(folder)
    boards = spark.readStream.schema("origin_iata string, read_at timestamp_ntz, ok boolean").parquet(folder)
    got = jobs.run_now(jobs.stale(in_batches(spark, tmp_path, rows, *order), boards, buckets=3)).collect()
    assert [(r.flight_number, r.status) for r in got] == [("W5113", "BOARDING")]


def test_alerts_go_into_the_ledger_once(spark, tmp_path):
    rows, ledger = seen(spark, *[dict(status="CANCELLED", is_cancelled=True, flight_number=n) for n in ("TK1", "TK1", "TK2", "TK1")]), str(tmp_path / "ledger")
    built = in_batches(spark, tmp_path, rows, [0, 1], [2], [3]).select(alerts.cancellation_key().alias("dedup_key"))
    jobs.send_once(built, ledger).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.dedup_key for r in spark.read.parquet(ledger).collect()) == ["CANCELLATION:TK1:2026-09-06", "CANCELLATION:TK2:2026-09-06"]

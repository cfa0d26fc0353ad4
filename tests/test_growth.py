"""Steps whose work must grow no faster than their input."""

from datetime import datetime
from glob import glob
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from punctuality.operators import history, insights, metrics
from punctuality.plans import boards, streams
from punctuality.sources import adapters
from punctuality.sources import boards as parsers
from punctuality.streaming import jobs
from test_collection import ORDERS, flown, in_batches, seen

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def shown(frame):
    return sorted(map(str, frame.collect()))


def test_merges_read_each_row_once(spark):
    """A count of distinct times would expand every record once a count."""
    rows = history.legs(adapters.observations(spark, SF))
    assert "Expand" not in plan(history.merge(rows))


def test_conflicts_are_counted_as_merges_tell_them(spark):
    rows = history.legs(adapters.observations(spark, SF).withColumn("is_diverted", F.col("observation_id") % 3 == 0))
    wide = rows.withColumn("flight_number", F.lit("U1"))  # legs of many records, mock and real
    for table in (rows, wide):
        merged = history.merge(table, by=("run_id",)).select(*history.LEG, "run_id", F.size("conflicts").alias("conflicts"))
        assert shown(history.conflict_counts(table, "run_id").select(merged.columns)) == shown(merged)


def test_an_export_writes_the_tables_that_it_is_given(spark, tmp_path):
    made = history.tables(adapters.observations(spark, SF))
    history.export_tables(made | {"airlines": made["airlines"].limit(1)}, str(tmp_path / "e"))
    assert history.load(spark, str(tmp_path / "e"))["airlines"].count() == 1


def test_rebuild_counts_move_keys_alone(spark):
    """No figures are made for the number of rows; the numbers are those of the statistics."""
    facts = metrics.facts(adapters.flights(spark, SF))
    counts = insights.rebuild_counts(facts)
    assert "Window" not in plan(counts) and "lateness" not in plan(counts)
    both = [of(facts).groupBy("flight_date_local").agg(F.count("*").alias(name)) for of, name in ((insights.daily, "daily_rows"), (insights.hourly, "hourly_rows"))]
    assert shown(counts) == shown(both[0].join(both[1], "flight_date_local"))


@pytest.mark.parametrize("order", ORDERS)
def test_events_told_from_a_table_are_those_of_the_batch(spark, tmp_path, order):
    rows, folder = flown(spark), str(tmp_path / "told")
    jobs.tell(in_batches(spark, tmp_path, rows, *order), folder).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    want = history.derive_events(rows)
    assert shown(jobs.last_word(jobs.told_now(spark, folder)).select(*want.columns)) == shown(want)
    last = len(order) - 1
    jobs.tell_batch(rows.where(F.col("observation_id").isin(order[last])), last, folder)  # run again
    assert shown(jobs.last_word(jobs.told_now(spark, folder)).select(*want.columns)) == shown(want)
    jobs.tell_batch(rows, last + 1, folder)  # nothing is new
    assert spark.read.parquet(folder).where(F.col("batch") > last).count() == 0


@pytest.mark.parametrize("order", [([0, 2], [1, 3], [4], [5], [6]), ([6, 4, 2], [5, 3], [1], [0]), ([0, 1, 2, 3, 4, 5, 6],)])
def test_watched_flights_are_those_of_the_keyed_stream(spark, tmp_path, order):
    at = lambda d, h: datetime(2026, 9, d, h)
    rows = seen(
        spark, dict(status="DEPARTED", observed_at=at(6, 5)), dict(status="SCHEDULED", observed_at=at(6, 4)), dict(status="BOARDING", flight_number="W5113", observed_at=at(6, 5)),
        dict(status="SCHEDULED", flight_number="W5113", observed_at=at(6, 4)), dict(status="SCHEDULED", flight_number="TK1", origin_iata="MHD", observed_at=at(6, 4)),
        dict(status="SCHEDULED", flight_number="TK2", observed_at=at(6, 9)), dict(status="DEPARTED", flight_number="TK3", observed_at=at(6, 4)),
    )
    read = [("IST", at(6, 6), True), ("IST", at(6, 9), True), ("IST", at(6, 11), False), ("MHD", at(6, 9), False), ("IST", at(12, 5), False), ("THR", at(12, 6), True)]
    asked, folder = str(tmp_path / "boards"), str(tmp_path / "watched")
    spark.createDataFrame(read, "origin_iata string, read_at timestamp_ntz, ok boolean").coalesce(1).write.parquet(asked)
    boards = spark.readStream.schema("origin_iata string, read_at timestamp_ntz, ok boolean").parquet(asked)
    jobs.watch(in_batches(spark, tmp_path, rows, *order), boards, folder).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.flight_number, r.status) for r in jobs.gone_now(spark, folder).collect()] == [("W5113", "BOARDING")]


def test_streams_run_no_python_a_flight(spark, monkeypatch):
    """Stateful calls of Python, a flight or an origin's bucket each, took longer than the limit."""
    def none(*_):
        raise AssertionError("keyed state")
    monkeypatch.setattr(jobs, "keyed_state", none)
    for name in ("stream_events", "stream_stale"):
        assert streams.QUERIES[name](spark, SF).count() > 0


def folded(spark, tmp_path, rows, order):
    """The streamed latest state, where it is, and the query that made it."""
    folder = str(tmp_path / "state")
    query = jobs.upsert_latest(in_batches(spark, tmp_path, rows, *order), folder).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination()
    return shown(jobs.latest(spark, folder)), folder, query


def files_of(folder):
    return sorted(str(f.parent) for f in Path(folder).rglob("*.parquet"))


def test_the_latest_state_keeps_no_row_in_memory_and_writes_a_file_a_day(spark, tmp_path):
    """A state store of all rows and a file of every task for every day took longer than the limit."""
    rows = adapters.observations(spark, SF)
    got, folder, query = folded(spark, tmp_path, rows, [[r[0] for r in rows.select("observation_id").collect()]])
    assert got == shown(history.latest_state(rows))
    assert all(not p["stateOperators"] for p in query.recentProgress)
    for table in (folder, f"{folder}-told"):
        assert len(files_of(table)) == len(set(files_of(table))) > 1


@pytest.mark.parametrize("part_rows", [1, 50_000])
@pytest.mark.parametrize("order", [([3, 5, 0], [0, 4, 3], [2, 1], [6, 6, 5], [7]), ([0, 1, 2, 3, 4, 5, 6, 7],)])
def test_the_latest_state_takes_late_and_replayed_rows(spark, tmp_path, monkeypatch, part_rows, order):
    """Rows that come days late, are replayed (in their batch, too) or have no time, and days of several parts."""
    monkeypatch.setattr(jobs, "PART_ROWS", part_rows)
    at = lambda d, h: datetime(2026, 9, d, h)
    rows = seen(
        spark, dict(status="SCHEDULED", gate="A1", observed_at=at(6, 4)), dict(status="DELAYED", gate="", observed_at=at(6, 5)), dict(status="DEPARTED", observed_at=at(2, 5)),
        dict(status="SCHEDULED", flight_number="TK1", observed_at=at(16, 4)), dict(status="BOARDING", flight_number="TK1", terminal="1", observed_at=at(6, 9)),
        dict(status="CANCELLED", is_cancelled=True, flight_number="TK2", observed_at=at(6, 4)), dict(status="DELAYED", flight_number="TK3", observed_at=at(6, 4)),
        dict(status="DELAYED", flight_number="TK3", observed_at=at(6, 8)),
    )
    rows = rows.withColumn("flight_date_local", F.when(F.col("flight_number") != "TK3", F.col("flight_date_local")))
    twice = rows.unionByName(rows.where("observation_id in (1, 6)"))  # told twice in one batch
    got, folder, _ = folded(spark, tmp_path, twice, order)
    assert got == shown(history.latest_state(rows))
    last = len(order) - 1
    again = twice.where(F.col("observation_id").isin(order[last]))
    want = sorted(set(order[last]) - {i for ids in order[:last] for i in ids})
    for _ in range(2):  # run again
        new = jobs.first_told(again, last, f"{folder}-told", ("observation_id",), jobs._sizes(again))
        assert sorted(r.observation_id for r in new.collect()) == want
        jobs.fold_batch(new, last, folder)
    assert shown(jobs.latest(spark, folder)) == got
    assert jobs.first_told(twice, last + 1, f"{folder}-told", ("observation_id",), jobs._sizes(twice)).count() == 0


def test_payloads_are_dealt_out_before_they_are_texts(spark):
    """What is shuffled is what they are made of, by its key: no text, and no sort for a round robin."""
    for make in (boards.payloads_a, boards.payloads_b, boards.payloads_c):
        text = plan(make(boards._flights(spark, SF)))
        moved = [line for line in text.splitlines() if "Repartition" in line]
        assert len(moved) == 1 and "l_orderkey" in moved[0]


def test_boards_compute_the_fields_that_are_asked_for(spark):
    """Fields of a leg that nobody reads are no part of the job."""
    legs = parsers.parse_a(boards.payloads_a(boards._flights(spark, SF)), codeshares=True, keep_raw=True)
    assert "aircraft_registration" in plan(legs) and "aircraft_registration" not in plan(legs.select("flight_number", "status", "raw_payload"))


def test_kept_payloads_are_written_whole_and_flights_dealt_out_once(spark):
    """Items that are read once aren't shredded into columns; the flights beside them go straight to the join."""
    folder, setting = spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "spark.sql.variant.inferShreddingSchema"
    files = lambda: set(glob(f"{folder}/snapshots-*/*.parquet"))
    before, was = files(), spark.conf.get(setting)
    told = boards.QUERIES["kept_payloads"](spark, SF)
    made = files() - before
    assert made and not any("typed_value" in str(pq.read_schema(file)) for file in made) and spark.conf.get(setting) == was
    moved = [line for line in plan(told).splitlines() if "Repartition" in line]
    assert len(moved) == 1 and "flight_number" in moved[0]
    # one flight is told by two lines in this table
    assert sum(r.n for r in told.collect()) == adapters.flights(spark, SF).where("flight_id % 11 > 0").count()

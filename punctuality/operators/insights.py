"""What the metric blocks are made into: statistics tables, profiles, trends, rankings,
verdicts and report tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuality.operators import metrics, ranges, statistics
from punctuality.params import DEFAULT, DEPARTED, PERIODS, SCOPES, Params
from punctuality.session import written

HOURLY = ("OVERALL", "ROUTE", "AIRLINE")


def route_of() -> Column:
    """The route that a scope's key tells, if it tells one."""
    return F.when(F.col("scope") == "ROUTE", F.col("key")).when(F.col("scope").isin("ROUTE_PERIOD", "ROUTE_AIRLINE"), F.split_part("key", F.lit("|"), F.lit(1)))


def daily(facts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return daily_of(statistics.state_of(facts), p)


def hourly(facts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return hourly_of(statistics.state_of(facts), p)


def daily_of(states: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Daily statistics from state rows (see statistics)."""
    return statistics.rolled_up(states, p=p).withColumn("route", route_of())


def hourly_of(states: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return statistics.rolled_up(states, HOURLY, ("flight_date_local", "hour_local"), p).withColumn("route", route_of())


def write_statistics(stats: DataFrame, path: str) -> None:
    """Replace the days that stats has, and no other: keys that vanished go too, and a
    second run changes nothing."""
    stats.withColumn("stat_date", F.col("flight_date_local")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stat_date").parquet(path)


def rebuild_counts(facts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rows that a rebuild writes for each day, in one job for all days: its keys without their figures."""
    n = lambda hourly_: F.count_if(F.col("hour_local").isNotNull() == hourly_)
    return statistics.keys(facts, SCOPES, HOURLY).groupBy("flight_date_local").agg(n(False).alias("daily_rows"), n(True).alias("hourly_rows"))


def fold_hourly(stats: DataFrame) -> DataFrame:
    """Hourly rows of many days as one profile a key: sums, the mean weighted by
    measurable flights, the largest delay (never under 0, and 0 is shown as none)."""
    n = F.sum("measurable_flights")
    over = lambda a, b: a / F.when(b > 0, b)
    sums = [F.sum(c).alias(c) for c in ("total_flights", "cancelled_flights", "delayed_flights", "measurable_flights")]
    top = F.greatest(F.max(F.coalesce("max_delay_minutes", F.lit(0))), F.lit(0))
    return stats.groupBy("key", "hour_local").agg(
        *sums, metrics.rounded(over(F.sum(F.when(F.col("measurable_flights") > 0, F.col("avg_delay_minutes") * F.col("measurable_flights"))), n), 2).alias("avg_delay_minutes"),
        F.nullif(top, F.lit(0)).alias("max_delay_minutes"), over(F.sum("cancelled_flights"), F.sum("total_flights")).alias("cancellation_rate"), over(F.sum("delayed_flights"), n).alias("delay_rate"),
    )


def hour_profile(facts: DataFrame) -> DataFrame:
    """All 24 hours, those without flights too."""
    hours = facts.sparkSession.range(24).select(F.col("id").cast("int").alias("hour_local"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return hours.join(metrics.block(facts, "hour_local"), "hour_local", "left").select("hour_local", zero("total_flights"), zero("cancelled_flights"), zero("delayed_flights"), "avg_delay_minutes", "cancellation_rate", "delay_rate")


def buckets(block: DataFrame, *keys: str, p: Params = DEFAULT) -> DataFrame:
    """The share of measurable flights beyond each bound, a row a bound."""
    n = F.col("measurable_flights")
    each = F.array(*[F.struct(F.lit(b).alias("bucket"), metrics.rounded(F.col(f"delayed_gt_{b}") / F.when(n > 0, n), 4).alias("share")) for b in p.buckets])
    return block.select(*keys, F.inline(each))


def summary(facts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    n = F.col("measurable_flights")
    return metrics.block(facts, least=p.min_flight, p=p).withColumns({f"share_gt_{b}": metrics.rounded(F.col(f"delayed_gt_{b}") / F.when(n > 0, n), 4) for b in p.buckets})


def score_parts(block: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """What each component adds to the score, a row a component."""
    each = F.array(
        *[
            F.struct(F.lit(name).alias("name"), metrics.rounded(raw, 4).alias("raw_value"), metrics.rounded(norm, 4).alias("normalised"), F.lit(w).alias("weight"), metrics.rounded(F.lit(100.0 * w) * norm, 2).alias("contribution"))
            for name, raw, norm, w in metrics.components(p)
        ]
    )
    return block.select("key", "reliability_score", F.inline(each))


def trend(facts: DataFrame, days: int, end: date, key: str = "route", p: Params = DEFAULT) -> DataFrame:
    """The last `days` days against as many before, by key: one scan of both."""
    first = end - timedelta(days=2 * days - 1)
    rows = facts.where(F.col("flight_date_local").between(F.lit(first), F.lit(end))).withColumn("part", F.when(F.col("flight_date_local") > F.lit(end - timedelta(days=days)), "now").otherwise("before"))
    rates = ("cancellation_rate", "delay_rate", "on_time_rate", "avg_delay_minutes")
    both = metrics.block(rows, key, "part", p=p).groupBy(key).agg(*[F.max(F.when(F.col("part") == part, F.col(c))).alias(f"{c}_{part}") for c in ("total_flights", *rates) for part in ("now", "before")])
    now, before = (F.coalesce(f"total_flights_{x}", F.lit(0)) for x in ("now", "before"))
    return both.select(
        key, now.alias("total_now"), before.alias("total_before"), (now - before).alias("total_delta"), *[metrics.rounded(F.col(f"{c}_now") - F.col(f"{c}_before"), 4).alias(f"{c}_delta") for c in rates],
        ((now >= p.min_period) & (before >= p.min_period)).alias("sufficient_data"),
    )


def repeat_cancellations(facts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Flight numbers cancelled again and again, whatever their sample. Airline, route
    and hour are those of the first one cancelled; all from one aggregate."""
    gone = F.col("is_cancelled")
    first = F.min(F.when(gone, F.struct("scheduled_departure_utc", "flight_id", F.coalesce("airline_name", "airline_key").alias("airline"), "route", "hour_local")))
    out = facts.groupBy("flight_number").agg(first.alias("f"), F.count_if(gone).alias("cancellations"), F.count("*").alias("scheduled_occasions"), F.array_sort(F.collect_set(F.when(gone, F.col("flight_date_local")))).alias("dates"))
    return out.where(F.col("cancellations") >= p.repeat_cancellations).select(
        "flight_number", "f.airline", "f.route", F.format_string("%02d:00", F.col("f.hour_local")).alias("scheduled_local_time"), "cancellations", "scheduled_occasions", "dates", metrics.rounded(F.col("cancellations") / F.col("scheduled_occasions"), 3).alias("cancellation_rate")
    )


def ranked(block: DataFrame) -> DataFrame:
    """Positions: ranked ones first, then by score (unknown as -1), sample and key; numbered
    in ranges of that order, as keys can be many."""
    order = (F.desc("is_ranked"), F.desc(F.coalesce("reliability_score", F.lit(-1.0))), F.desc("total_flights"), F.col("key").asc())
    return ranges.numbered(block, *order).withColumn("position", F.col("position").cast("int"))


def rank_airlines(facts: DataFrame, p: Params = DEFAULT, merged: DataFrame | None = None) -> DataFrame:
    """The airlines' leaderboard, each under the name of its latest flight. merged: the facts
    as they count, if they are merged already."""
    name = F.coalesce(F.nullif(F.col("airline_name"), F.lit("")), F.col("airline_key"))
    labels = facts.where("airline_key is not null").groupBy(F.col("airline_key").alias("key")).agg(F.max_by(name, F.struct("scheduled_departure_utc", "flight_id")).alias("label"))
    return ranked(metrics.by_scope(facts if merged is None else merged, "AIRLINE", p).join(labels, "key"))


def best_and_worst(board: DataFrame) -> DataFrame:
    """First and last of the ranked entries (one row, if they are the same)."""
    ranked_ = board.where("is_ranked")
    row = F.struct("position", "key", "reliability_score", "total_flights")
    both = ranked_.agg(F.min(row).alias("best"), F.max(row).alias("worst"))
    each = F.when(F.col("best.position") == F.col("worst.position"), F.array(F.struct(F.lit("best").alias("which"), F.col("best").alias("r")))).otherwise(F.array(F.struct(F.lit("best").alias("which"), F.col("best").alias("r")), F.struct(F.lit("worst").alias("which"), F.col("worst").alias("r"))))
    return both.where("best is not null").select(F.explode(each).alias("x")).select("x.which", "x.r.key", "x.r.reliability_score", "x.r.total_flights")


def time_of_day(facts: DataFrame, p: Params = DEFAULT, routes: DataFrame | None = None) -> DataFrame:
    """Best and worst times of day of each route, among periods with enough flights; with
    fewer than two of those nothing can be compared, and a note says why, as a code. Of
    routes, those without flights are there too."""
    by = metrics.block(facts.withColumn("period", metrics.period(F.col("hour_local"))), "route", "period", least=p.min_period, p=p)
    place = F.coalesce(*[F.when(F.col("period") == label, -i) for i, (label, _, _) in enumerate(PERIODS)])
    score = F.coalesce("reliability_score", F.lit(0.0))
    top = lambda *by_: F.max(F.when(F.col("is_ranked"), F.struct(*by_, F.col("period")))).getField("period")
    found = by.withColumns({"place": place, "score": score}).groupBy("route").agg(
        F.count_if("is_ranked").alias("ranked_periods"),
        top("score", "total_flights", "place").alias("best"),
        top("delay_rate", "score", "total_flights", "place").alias("late"),
        top("cancellation_rate", "score", "total_flights", "place").alias("gone"),
    )
    if routes is not None:
        found = routes.select(F.concat_ws("-", "origin_iata", "destination_iata").alias("route")).join(found, "route", "full")
    ranked_ = F.col("ranked_periods")
    two = ranked_ >= 2
    alike = (F.col("best") == F.col("late")) & (F.col("late") == F.col("gone"))
    note = F.when(ranked_.isNull(), "no_flights").when(ranked_ == 0, "none_ranked").when(ranked_ == 1, "one_ranked").when(alike, "all_alike")
    worst = [F.when(two, F.col(c)).alias(name) for c, name in (("best", "best_period"), ("late", "worst_delay_period"), ("gone", "worst_cancellation_period"))]
    return found.select("route", F.coalesce(ranked_, F.lit(0)).alias("ranked_periods"), *worst, note.alias("note"))


# --- report tables ---


def labelled(routes: DataFrame, airports: DataFrame) -> DataFrame:
    """Routes with a label that states the direction: an airport under its city, else its
    name, else its code."""
    known = lambda c: F.nullif(F.col(c), F.lit(""))
    side = lambda end: F.broadcast(airports.select(F.col("iata").alias(f"{end}_iata"), F.upper(F.coalesce(known("city"), known("name"), "iata")).alias(f"{end}_label")))
    both = routes.withColumn("route", F.concat_ws("-", "origin_iata", "destination_iata")).join(side("origin"), "origin_iata", "left").join(side("destination"), "destination_iata", "left")
    text = lambda end: F.coalesce(f"{end}_label", f"{end}_iata")
    return both.withColumn("label", F.concat(text("origin"), F.lit(" -> "), text("destination")))


def report_today(board: DataFrame, routes: DataFrame, airports: DataFrame) -> DataFrame:
    """Today's figures of each monitored route, those without flights too."""
    counts = board.groupBy("route").agg(F.count_if(F.col("status").isin(*DEPARTED)).alias("departed"), F.count_if(F.col("status").isin("SCHEDULED", "BOARDING", "DELAYED")).alias("still_scheduled"))
    block = metrics.block(board, "route").join(counts, "route")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return labelled(routes, airports).join(block, "route", "left").select(
        "route", "label", *map(zero, ("total_flights", "cancelled_flights", "delayed_flights", "departed", "still_scheduled")), "avg_delay_minutes", "cancellation_rate"
    )


def issues(board: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Of a day's board the cancelled flights, in order of departure, and the late ones
    that haven't left, the worst first."""
    late = ~F.col("is_cancelled") & (F.col("delay_minutes") >= p.delay_threshold) & ~F.col("status").isin(*DEPARTED)
    kind = F.when(F.col("is_cancelled"), "cancelled").when(late, "delayed")
    local = F.convert_timezone(F.lit("UTC"), F.lit(p.zone), F.col("scheduled_departure_utc"))
    return (
        board.withColumn("issue", kind)
        .where("issue is not null")
        .orderBy("issue", F.when(F.col("issue") == "delayed", -F.col("delay_minutes")), "scheduled_departure_utc", "flight_id")
        .select("issue", "flight_id", "flight_number", F.coalesce("airline_name", "airline_iata", F.lit("Unknown")).alias("airline"), F.date_format(local, "HH:mm").alias("scheduled_local"), "destination_iata", "status", "delay_minutes")
    )


COUNTS = tuple(c for c in metrics.BLOCK if c.endswith("_flights") or c.startswith("delayed_gt_"))
FIGURES = tuple(c for c in metrics.BLOCK if c not in (*COUNTS, "is_ranked"))
VERDICT = ("best_period", "worst_delay_period", "worst_cancellation_period", "note")
COMPARED = {
    "total_before": "long",
    "total_delta": "long",
    "cancellation_rate_delta": "double",
    "delay_rate_delta": "double",
    "on_time_rate_delta": "double",
    "avg_delay_minutes_delta": "double",
    "sufficient_data": "boolean",
}


def history_routes(facts: DataFrame, routes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Of each route the block and the verdict on times of day: all that flights are of, and the
    monitored ones; one of those without flights has counts of 0 and says so."""
    named = routes.select(F.concat_ws("-", "origin_iata", "destination_iata").alias("route")).distinct()
    blocks = metrics.block(facts, "route", p=p).select("route", *COUNTS, *FIGURES, "is_ranked")
    verdict = time_of_day(facts, p, routes).select("route", *VERDICT)
    return named.join(blocks, "route", "full").join(verdict, "route", "left").fillna(0, list(COUNTS)).fillna(False, ["is_ranked"])


def history(flights_facts: DataFrame, days: int, end: date, routes: DataFrame, airports: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The report over a rolling window: all flights, the monitored routes (those without
    flights too) with their verdict and their trend against the window before, and the airlines in
    the order of their leaderboard. A row a part, with all figures of its block. Facts are read
    once and merged at the finest grain; the parts read what that leaves."""
    since = lambda rows, n: rows.where(F.col("flight_date_local").between(F.lit(end - timedelta(days=n - 1)), F.lit(end)))
    merged = written(metrics.merged(since(flights_facts, 2 * days), *metrics.GRAIN), "report-facts")
    facts = since(merged, days)
    own = {"label": "string"} | dict.fromkeys(VERDICT, "string") | COMPARED | {"position": "int"}

    def section(rows: DataFrame, name: str, *has: str) -> DataFrame:
        more = [F.col(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in own.items()]
        return rows.select(F.lit(name).alias("section"), "key", *COUNTS, *FIGURES, *more)

    overall = section(metrics.by_scope(facts, "OVERALL", p), "overall")
    compared = trend(merged, days, end, p=p).select("route", *COMPARED)
    label = labelled(routes, airports).select("route", "label").distinct()
    per_route = history_routes(facts, routes, p).join(label.select("route"), "route", "left_semi").join(compared, "route", "left").join(label, "route", "left").withColumnRenamed("route", "key")
    sections = (section(per_route, "route", "label", *VERDICT, *COMPARED), section(rank_airlines(since(flights_facts, days), p, facts), "airline", "position"))
    return overall.unionByName(sections[0]).unionByName(sections[1])

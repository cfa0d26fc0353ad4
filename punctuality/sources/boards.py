"""Departure boards: JSON payloads of three providers as one flight-leg record each.

A payload is a row (raw, origin_iata, observed_at). With keep_raw each record has its item as it
came beside it, as a VARIANT that paths read (try_variant_get). Parsing is from_json with a fixed
schema, explode and projection: one narrow stage, no shuffle. A payload that isn't JSON,
or lacks the list, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuality.functions import scalars
from punctuality.params import DEFAULT, Params

_TIME = "struct<utc:string,local:string>"
_PLACE = "struct<iata:string,icao:string,name:string>"
_STOP = f"struct<airport:{_PLACE},scheduledTime:{_TIME},revisedTime:{_TIME},runwayTime:{_TIME},terminal:string,gate:string>"
BOARD_A = f"departures array<struct<departure:{_STOP},arrival:{_STOP},number:string,callSign:string,status:string,codeshareStatus:string,isCargo:boolean,aircraft:struct<reg:string,model:string>,airline:{_PLACE}>>"
_STOP_B = "struct<iata:string,terminal:string,gate:string,delay:string,scheduled:string,estimated:string,actual:string,actual_runway:string>"
BOARD_B = f"data array<struct<flight_status:string,departure:{_STOP_B},arrival:{_STOP_B},airline:{_PLACE},flight:struct<number:string,iata:string,icao:string,codeshared:map<string,string>>,aircraft:struct<registration:string,iata:string,icao:string>>>"
_TIMES_C = ",".join(f"{kind}_{side}:string" for kind in ("scheduled", "estimated", "actual") for side in ("out", "off", "in", "on"))
BOARD_C = f"scheduled_departures array<struct<ident:string,ident_iata:string,ident_icao:string,operator:string,operator_iata:string,operator_icao:string,destination:struct<code_iata:string,code:string>,{_TIMES_C},cancelled:boolean,diverted:boolean,departure_delay:bigint,arrival_delay:bigint,status:string,gate_origin:string,terminal_origin:string,aircraft_type:string,registration:string,codeshares:array<string>,position_only:boolean>>"


def _leg(rows: DataFrame, source: str, cancelled: Column, diverted: Column, p: Params, **fields: Column) -> DataFrame:
    """The common record from the fields of a provider: rows without a number, a
    schedule or a destination go."""
    none = F.lit(None).cast("int")
    fields = {"_told": none, "_told_arrival": none} | {{"told": "_told", "told_arrival": "_told_arrival"}.get(k, k): v for k, v in fields.items()}
    c = F.col
    kept = [name for name in ("raw_payload",) if name in rows.columns]
    found = rows.select("origin_iata", "observed_at", *kept, cancelled.alias("_cancelled"), diverted.alias("_diverted"), *[v.alias(k) for k, v in fields.items()])
    whole = c("flight_number").isNotNull() & c("scheduled_departure_utc").isNotNull() & c("destination_iata").isNotNull()
    # exploded (once or not at all), as a filter would be pushed down and parse all texts twice; fields that nobody asks for go
    found = found.select("*", F.explode(F.when(whole, F.array(F.lit(0)))).alias("_once")).drop("_once")
    late = scalars.delay(c("scheduled_departure_utc"), c("estimated_departure_utc"), c("actual_departure_utc"), c("_told"))
    arrival = scalars.delay(c("scheduled_arrival_utc"), c("estimated_arrival_utc"), c("actual_arrival_utc"), c("_told_arrival"))
    status = scalars.resolve_known(c("_mapped"), c("_cancelled"), c("_diverted"), c("actual_departure_utc"), c("actual_arrival_utc"), c("_late"), p)
    out = found.withColumns({"_late": late, "_late_arrival": arrival, "_mapped": scalars.status(c("raw_status"))}).withColumn("status", status)
    out = out.withColumns({"delay_minutes": scalars.without_delay(c("status"), c("_late")), "arrival_delay_minutes": scalars.without_delay(c("status"), c("_late_arrival"))})
    out = out.withColumns(
        {"is_cancelled": c("status") == "CANCELLED", "is_diverted": c("status") == "DIVERTED", "data_source": F.lit(source), "data_quality": scalars.quality(c("status"), c("scheduled_departure_utc"), c("delay_minutes"), c("scheduled_arrival_utc").isNotNull())}
    )
    return out.drop("_cancelled", "_diverted", "_told", "_told_arrival", "_late", "_late_arrival", "_mapped")


def _items(payloads: DataFrame, schema: str, field: str, keep_raw: bool = False) -> DataFrame:
    """(origin_iata, observed_at, i) of each item of the payloads; keep_raw: and the item as it came,
    with what the schema doesn't name, as raw_payload (VARIANT)."""
    items = F.from_json("raw", schema)[field]
    if not keep_raw:
        return payloads.select("origin_iata", "observed_at", F.explode(items).alias("i"))
    raws = F.from_json("raw", f"{field} array<variant>")[field]
    both = F.explode(F.arrays_zip(items.alias("i"), raws.alias("r")))
    return payloads.select("origin_iata", "observed_at", both.alias("z")).select("origin_iata", "observed_at", "z.i", F.col("z.r").alias("raw_payload"))


def _destination(rows: DataFrame, code: Column, wanted: tuple[str, ...] | None) -> DataFrame:
    return rows if wanted is None else rows.where(F.upper(F.trim(code)).isin(*wanted))


TIMES = ("scheduled_departure_utc", "estimated_departure_utc", "actual_departure_utc", "scheduled_arrival_utc", "estimated_arrival_utc", "actual_arrival_utc")


def _timed(rows: DataFrame, pairs: list[tuple[Column, Column]]) -> tuple[DataFrame, dict[str, Column]]:
    """rows with the times of pairs of texts (a text, and what stands in for it), and the
    columns for TIMES: the first of each pair that is a time."""
    parsed = rows.withColumn("_times", scalars.parse_isos(*[text for pair in pairs for text in pair]))
    return parsed, {name: F.coalesce(F.col("_times")[2 * i], F.col("_times")[2 * i + 1]) for i, name in enumerate(TIMES)}


def parse_a(
    payloads: DataFrame,
    wanted: tuple[str, ...] | None = None,
    p: Params = DEFAULT,
    codeshares: bool = False,
    keep_raw: bool = False,
) -> DataFrame:
    """Boards with time blocks; cancelled or diverted is what the status text says.
    codeshares: whether flights sold under another's number stay."""
    c, clean = F.col, scalars.clean
    rows = _destination(_items(payloads, BOARD_A, "departures", keep_raw), c("i.arrival.airport.iata"), wanted)
    shared = F.lower(F.trim(F.coalesce(c("i.codeshareStatus"), F.lit("")))) == "iscodeshared"
    rows = rows.where(~F.coalesce(c("i.isCargo"), F.lit(False)) & (F.lit(codeshares) | ~shared))
    blocks = [f"{side}.{kind}Time" for side in ("departure", "arrival") for kind in ("scheduled", "revised", "runway")]
    rows, times = _timed(rows, [(c(f"i.{b}.utc"), c(f"i.{b}.local")) for b in blocks])
    says = lambda word: F.contains(F.lower(F.coalesce(c("i.status"), F.lit(""))), F.lit(word))
    return _leg(
        rows,
        "board_a",
        says("cancel"),
        says("divert"),
        p,
        **times,
        flight_number=scalars.flight_number(c("i.number")),
        destination_iata=clean(F.upper("i.arrival.airport.iata")),
        raw_status=clean(c("i.status")),
        airline_iata=clean(c("i.airline.iata")),
        airline_icao=clean(c("i.airline.icao")),
        airline_name=clean(c("i.airline.name")),
        terminal=clean(c("i.departure.terminal")),
        gate=clean(c("i.departure.gate")),
        aircraft_type=clean(c("i.aircraft.model")),
        aircraft_registration=clean(c("i.aircraft.reg")),
        is_codeshare=shared,
        codeshare_of=F.lit(None).cast("string"),
    )


def parse_b(
    payloads: DataFrame,
    wanted: tuple[str, ...] | None = None,
    p: Params = DEFAULT,
    codeshares: bool = False,
    window: tuple[Column, Column] | None = None,
    keep_raw: bool = False,
) -> DataFrame:
    """Rows with a nested flight; the provider's own delay is a fallback. A flight is sold
    under another's number if the object that says so isn't empty; such go, unless
    codeshares. window: only departures from the first (with it) to the second time."""
    c, clean = F.col, scalars.clean
    rows = _destination(_items(payloads, BOARD_B, "data", keep_raw), c("i.arrival.iata"), wanted)
    shared = F.coalesce(F.size("i.flight.codeshared") > 0, F.lit(False))
    rows = rows.where(F.lit(codeshares) | ~shared)
    none = F.lit(None).cast("string")
    sides = [("departure.scheduled", None), ("departure.estimated", None), ("departure.actual", "departure.actual_runway")]
    sides += [("arrival.scheduled", None), ("arrival.estimated", None), ("arrival.actual", "arrival.actual_runway")]
    rows, times = _timed(rows, [(c(f"i.{a}"), c(f"i.{b}") if b else none) for a, b in sides])
    status = F.lower(F.trim(F.coalesce(c("i.flight_status"), F.lit(""))))
    found = _leg(
        rows,
        "board_b",
        status == "cancelled",
        status == "diverted",
        p,
        **times,
        flight_number=scalars.flight_number(F.coalesce(clean(c("i.flight.iata")), c("i.flight.icao"))),
        destination_iata=clean(F.upper("i.arrival.iata")),
        raw_status=clean(c("i.flight_status")),
        airline_iata=clean(c("i.airline.iata")),
        airline_icao=clean(c("i.airline.icao")),
        airline_name=clean(c("i.airline.name")),
        terminal=clean(c("i.departure.terminal")),
        gate=clean(c("i.departure.gate")),
        aircraft_type=F.coalesce(clean(c("i.aircraft.iata")), clean(c("i.aircraft.icao"))),
        aircraft_registration=clean(c("i.aircraft.registration")),
        is_codeshare=shared,
        codeshare_of=scalars.flight_number(F.try_element_at("i.flight.codeshared", F.lit("flight_iata"))),
        told=F.trim("i.departure.delay").try_cast("int"),
        told_arrival=F.trim("i.arrival.delay").try_cast("int"),
    )
    if window is None:
        return found
    return found.where((c("scheduled_departure_utc") >= window[0]) & (c("scheduled_departure_utc") < window[1]))


def parse_c(
    payloads: DataFrame,
    wanted: tuple[str, ...] | None = None,
    p: Params = DEFAULT,
    codeshares: bool = False,
    keep_raw: bool = False,
) -> DataFrame:
    """Rows with out/off and in/on times and flags; delays are told in seconds. A row that
    only tells a position is another's duplicate and goes, unless codeshares."""
    c, clean = F.col, scalars.clean
    code = F.coalesce(clean(c("i.destination.code_iata")), clean(c("i.destination.code")))
    rows = _destination(_items(payloads, BOARD_C, "scheduled_departures", keep_raw), code, wanted)
    shared = F.coalesce(c("i.position_only"), F.lit(False))
    rows = rows.where(F.lit(codeshares) | ~shared)
    sides = [(f"{kind}_{a}", f"{kind}_{b}") for a, b in (("out", "off"), ("in", "on")) for kind in ("scheduled", "estimated", "actual")]
    rows, times = _timed(rows, [(c(f"i.{a}"), c(f"i.{b}")) for a, b in sides])
    return _leg(
        rows,
        "board_c",
        F.coalesce(c("i.cancelled"), F.lit(False)),
        F.coalesce(c("i.diverted"), F.lit(False)),
        p,
        **times,
        flight_number=scalars.flight_number(F.coalesce(clean(c("i.ident_iata")), c("i.ident"))),
        destination_iata=F.upper(code),
        raw_status=clean(c("i.status")),
        airline_iata=clean(c("i.operator_iata")),
        airline_icao=F.coalesce(clean(c("i.operator_icao")), clean(c("i.operator"))),
        airline_name=clean(c("i.operator")),
        terminal=clean(c("i.terminal_origin")),
        gate=clean(c("i.gate_origin")),
        aircraft_type=clean(c("i.aircraft_type")),
        aircraft_registration=clean(c("i.registration")),
        is_codeshare=shared,
        codeshare_of=scalars.flight_number(F.get("i.codeshares", F.lit(0))),
        told=F.expr("cast(i.departure_delay div 60 as int)"),
        told_arrival=F.expr("cast(i.arrival_delay div 60 as int)"),
    )

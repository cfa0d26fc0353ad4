"""Column functions: times, designators, statuses, delays, quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from punctuality.params import DEFAULT, DEPARTED, SETTLED, Params

# The words that sources use for each status. A word stands for its
# status if it is all of a text, or the longest known one in it (but a text is only
# taken as cancelled or diverted where it says "cancel" or "divert").
STATUS_WORDS = {
    "SCHEDULED": ("scheduled", "expected", "planned", "ontime", "on time", "on-time", "filed", "checkin", "check in", "checkinopen", "notyetdeparted", "unknown/scheduled"),
    "BOARDING": ("boarding", "gateopen", "gate open", "gateclosed", "gate closed", "finalcall", "final call", "lastcall", "readyfordeparture"),
    "DELAYED": ("delayed", "delay", "late", "retarded", "estimated", "rescheduled"),
    "DEPARTED": ("departed", "active", "enroute", "en route", "en-route", "airborne", "inflight", "in flight", "in air", "takenoff", "taxiing", "approaching", "descending"),
    "ARRIVED": ("arrived", "landed", "landed / arrived", "ontheground", "on ground", "gatearrival", "completed", "arrival"),
    "CANCELLED": ("cancelled", "canceled", "cancelled_uncertain", "canceleduncertain", "cancelleduncertain", "notoperational", "not operational"),
    "DIVERTED": ("diverted", "redirected", "divert"),
    "UNKNOWN": ("unknown", "incident", "nostatus", ""),
}
EXPLICIT = ("CANCELLED", "DIVERTED")
LEAST_DELAY, MOST_DELAY = -180, 1440


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body mentions it: as the one
    element of an array that is transformed. It also keeps generated code small."""
    return F.transform(F.array(value), body)[0]


def parse_iso(text: Column) -> Column:
    """ISO text with an offset or Z as a UTC time without a zone; with a blank or T
    between date and time, with or without seconds. Anything else is null."""
    return parse_isos(text)[0]


def parse_isos(*texts: Column) -> Column:
    """The times of several texts, as an array: one piece of code for all of them. What stands
    before an offset of nothing is the time itself, without a look at zones."""

    def one(upper: Column) -> Column:
        before = lambda end: F.when(F.endswith(upper, F.lit(end)), F.substr(upper, F.lit(1), F.length(upper) - len(end)).try_cast("timestamp_ntz"))
        full = F.regexp_replace(upper, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(Z|[+-]\d{2}:\d{2})$", "$1 $2:00$3")
        known = upper.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$")
        moved = F.convert_timezone(F.current_timezone(), F.lit("UTC"), full.try_cast("timestamp").cast("timestamp_ntz"))
        return F.when(known, F.coalesce(before("Z"), before("+00:00"), moved))

    return F.transform(F.array(*[F.upper(F.trim(text)) for text in texts]), one)


def assume_zone(naive: Column, zone: Column | str) -> Column:
    """The UTC time of a local one; without a zone there is none. A local time that
    occurs twice, as clocks go back, is its first occurrence."""
    return F.convert_timezone(F.lit(zone) if isinstance(zone, str) else zone, F.lit("UTC"), naive)


def local(utc: Column, zone: str = DEFAULT.zone) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def minutes_between(later: Column, earlier: Column) -> Column:
    """Whole minutes, cut off toward zero; null if either time is."""
    return F.timestamp_diff("MINUTE", earlier, later).cast("int")


def clean(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def flight_number(text: Column) -> Column:
    """Normal form of a designator: no white space, upper case, no leading zeros in the
    last run of digits, one section letter kept."""
    compact = F.upper(F.regexp_replace(text, r"\s+", ""))
    return F.nullif(F.regexp_replace(compact, "^(.*?)0*([0-9]+[A-Z]?)$", "$1$2"), F.lit(""))


def status(raw: Column) -> Column:
    """One of the eight statuses; what no word explains is UNKNOWN. A text that is a word
    is looked up; else the words, longest first, are searched for in what is left of it."""
    words = {w: s for s, of in STATUS_WORDS.items() for w in of}
    known = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    inner = {w: w.replace(" ", "").replace("-", "") for w in sorted(words, key=len, reverse=True) if words[w] not in EXPLICIT}
    parts = {part: words[w] for w, part in reversed(inner.items()) if part}
    listed = F.array(*[F.lit(part) for part in dict.fromkeys(part for part in inner.values() if part)])
    found = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])

    def mapped(key: Column, compact: Column) -> Column:
        longest = F.get(F.filter(listed, lambda part: F.contains(compact, part)), 0)
        return (
            F.coalesce(F.try_element_at(known, key), F.try_element_at(known, compact), F.when(F.contains(compact, F.lit("cancel")), "CANCELLED"), F.when(F.contains(compact, F.lit("divert")), "DIVERTED"), F.try_element_at(found, longest), F.lit("UNKNOWN"))
        )

    lower = F.lower(F.trim(raw))
    key = F.trim(F.regexp_replace(lower, r"[^\p{L}\p{N} \-/_]", ""))
    searched = let(key, lambda k: let(F.regexp_replace(k, r"[ \-_/]", ""), lambda c: mapped(k, c)))
    return F.when(raw.isNull(), "UNKNOWN").otherwise(F.coalesce(F.try_element_at(known, lower), searched))


def delay(scheduled: Column, estimated: Column, actual: Column, told: Column) -> Column:
    """What happened, else what is expected, else what the source tells; never a guess,
    and early departures stay negative."""
    return F.when(scheduled.isNotNull() & actual.isNotNull(), minutes_between(actual, scheduled)).when(scheduled.isNotNull() & estimated.isNotNull(), minutes_between(estimated, scheduled)).otherwise(told)


def resolve(raw: Column, cancelled: Column, diverted: Column, departure: Column, arrival: Column, delay_: Column, p: Params = DEFAULT) -> Column:
    """The final status: flags first, then a text that says cancelled or diverted, then
    movements, then a measured delay."""
    return resolve_known(status(raw), cancelled, diverted, departure, arrival, delay_, p)


def resolve_known(mapped: Column, cancelled: Column, diverted: Column, departure: Column, arrival: Column, delay_: Column, p: Params = DEFAULT) -> Column:
    """The same for a status that was looked up before (as a column of its own, it is
    not computed again for each mention)."""
    return (
        F.when(F.coalesce(cancelled, F.lit(False)), "CANCELLED").when(F.coalesce(diverted, F.lit(False)), "DIVERTED").when(mapped.isin(*EXPLICIT), mapped)
        .when(arrival.isNotNull(), "ARRIVED").when(departure.isNotNull(), "DEPARTED").when(mapped.isin("SCHEDULED", "UNKNOWN") & (delay_ >= p.delay_threshold), "DELAYED").otherwise(mapped)
    )


def without_delay(status_: Column, delay_: Column) -> Column:
    """A cancelled or diverted flight has no delay."""
    return F.when(~status_.isin(*EXPLICIT), delay_)


def quality(status_: Column, scheduled: Column, delay_: Column, has_arrival: Column) -> Column:
    return (
        F.when(scheduled.isNull(), "UNRELIABLE").when(~delay_.between(LEAST_DELAY, MOST_DELAY), "UNRELIABLE").when(status_ == "UNKNOWN", "PARTIAL")
        .when(status_.isin(*DEPARTED) & delay_.isNull(), "PARTIAL").when(~has_arrival, "PARTIAL").otherwise("OK")
    )


def expected_departure(scheduled: Column, estimated: Column, delay_: Column) -> Column:
    """The later of schedule and estimate; without an estimate the schedule and any
    delay."""
    moved = F.timestamp_add("MINUTE", delay_, scheduled)
    return F.when(estimated.isNotNull(), F.greatest(scheduled, estimated)).when(delay_ > 0, moved).otherwise(scheduled)


def unresolved(status_: Column, expected: Column, as_of: Column, p: Params = DEFAULT) -> Column:
    return ~status_.isin(*SETTLED) & (minutes_between(as_of, expected) > p.unresolved_minutes)

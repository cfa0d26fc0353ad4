"""All settings of the analytics, in one frozen value that every job is given."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime


# The defaults of the settings.
@dataclass(frozen=True)
class Params:
    zone: str = "Europe/Istanbul"
    # delays
    delay_threshold: int = 15  # late from here on (>=)
    buckets: tuple[int, ...] = (15, 30, 60, 120)  # counted above (>)
    # least samples to be ranked
    min_airline: int = 20
    min_flight: int = 10
    min_period: int = 10
    # score: weights, and the worst case of each inverse component
    weight_on_time: float = 0.35
    weight_cancellation: float = 0.30
    weight_avg_delay: float = 0.20
    weight_severe: float = 0.15
    worst_cancellation: float = 0.25
    worst_avg_delay: float = 90.0
    worst_severe: float = 0.35
    # freshness and history
    stale_minutes: int = 180
    unresolved_minutes: int = 120
    history_days: int = 30
    # alerts
    alert_delays: tuple[int, ...] = (60, 120)
    disruption_rate: float = 0.20
    disruption_flights: int = 4
    delay_jitter: int = 5
    repeat_cancellations: int = 2
    provider_failures: int = 3
    provider_recovery_s: int = 900
    # directional routes
    routes: tuple[tuple[str, str], ...] = (("IST", "IKA"), ("IST", "MHD"))

    def __post_init__(self):
        total = self.weight_on_time + self.weight_cancellation + self.weight_avg_delay + self.weight_severe
        if abs(total - 1) > 1e-6:
            raise ValueError(f"score weights sum to {total}, not 1")

    def least_sample(self, scope: str) -> int:
        if scope in ("AIRLINE", "ROUTE_AIRLINE"):
            return self.min_airline
        if scope == "FLIGHT":
            return self.min_flight
        return self.min_period if scope in ("PERIOD", "ROUTE_PERIOD", "DOW", "MONTH") else 1


DEFAULT = Params()

# Time-of-day periods (label, first hour, hour after the last), scopes,
# statuses that say a departure is settled.
PERIODS = (
    ("00:00-06:00", 0, 6),
    ("06:00-10:00", 6, 10),
    ("10:00-14:00", 10, 14),
    ("14:00-18:00", 14, 18),
    ("18:00-22:00", 18, 22),
    ("22:00-00:00", 22, 24),
)
SCOPES = ("OVERALL", "ROUTE", "AIRLINE", "FLIGHT", "PERIOD", "DOW", "MONTH", "ROUTE_PERIOD", "ROUTE_AIRLINE")
DEPARTED = ("DEPARTED", "ARRIVED", "DIVERTED")
SETTLED = ("DEPARTED", "ARRIVED", "CANCELLED", "DIVERTED")

#: The instant that jobs over the test tables take as now.
AS_OF = datetime(2001, 8, 1, 12, 0)
TODAY: date = AS_OF.date()

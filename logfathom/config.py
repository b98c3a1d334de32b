"""Thresholds and cooldowns shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Severity weights used by the minimum-level filter.
LEVEL_WEIGHTS = {"DEBUG": 0, "INFO": 1, "WARN": 2, "ERROR": 3}

# The levels that are clustered, rated and alerted on.
SIGNAL_LEVELS = ("ERROR", "WARN")


@dataclass(frozen=True)
class Config:
    """Tunable thresholds. Rates are counts per tick; the default tick is one second."""

    eps_minor: float = 0.1
    eps_warn: float = 1.0
    eps_critical: float = 5.0
    wps_pressure: float = 50.0
    wps_suspicious: float = 100.0
    wps_preincident: float = 200.0
    idle: float = 0.01
    spike_factor: float = 3.0
    rolling_ticks: int = 60
    hourly_ticks: int = 3600
    critical_cooldown: str = "1 minute"
    spike_cooldown: str = "5 minutes"
    alert_gap: str = "10 seconds"
    alert_cooldown: str = "20 seconds"
    alert_eps: float = 1.0
    context_rows: int = 30_000
    signal_rows: int = 10_000
    history_rows: int = 50_000
    sample_rows: int = 250


DEFAULT = Config()

_UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def micros(duration: str) -> int:
    """Length of a fixed duration such as ``'10 seconds'`` in microseconds."""
    count, unit = duration.split()
    size = _UNIT_MICROS.get(unit.lower().rstrip("s"))
    if size is None or int(count) <= 0:
        raise ValueError(f"not a positive fixed-length duration: {duration!r}")
    return int(count) * size

"""Settings of the fleet operators, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field

CHANNELS = 5


@dataclass(frozen=True)
class Fleet:
    """How readings bind to rounds: names of the detection channels in order, and the rounds' period in seconds."""

    sensors: tuple[str, ...] = ("Temperature", "Humidity", "Pressure", "Gas", "Light")
    quality: tuple[str, ...] = ("MIC", "RSSI", "Accelerometer")
    period: int = 10
    censored: float | None = 65536.0  # a Light value that stands for "at least this"
    log1p: tuple[int, ...] = (4,)  # channels that are scaled after log1p


@dataclass(frozen=True)
class Guard:
    """Runs of equal values: thresholds by channel, values that may repeat, and the longest gap within a run."""

    thresholds: tuple[int, ...] = (30, 8, 40, 400, 200)
    floors: dict[int, tuple[float, ...]] = field(default_factory=dict)
    gap: int = 60


@dataclass(frozen=True)
class Scaler:
    """Robust scaling: rounds of warm-up, and what counts as no spread."""

    rounds: int = 60_480
    epsilon: float = 1e-9
    relative: float | None = None  # IQR below this share of P95 - P5 is replaced
    body: float = 2.44


@dataclass(frozen=True)
class Sliding:
    """Distance-based outliers: window and slide in seconds, radius and neighbours."""

    window: int = 3600
    slide: int = 60
    radius: float = 1.0
    k: int = 10


#: The binding of the driver's events table: five event types as channels, six-hour rounds.
EVENTS = Fleet(sensors=("click", "error", "purchase", "signup", "view"), quality=(), period=21_600, censored=None)

"""Fixed values and settings. All times are UTC milliseconds, all intervals half-open."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

MINUTE = 60_000
HOUR = 3_600_000
DAY = 86_400_000
WEEK = 7 * DAY

# They must equal the published ones for results to agree.
TFS = ("15m", "1h", "4h", "1d")
STEPS = {"15m": 900_000, "1h": HOUR, "4h": 14_400_000, "1d": DAY}
WIDTHS = {"15m": 0.002, "1h": 0.004, "4h": 0.007, "1d": 0.022}
FIXED_WIDTHS = (0.0005, 0.001, 0.002, 0.003, 0.005)
HORIZONS = {"15m": (16, 32, 96), "1h": (4, 8, 24), "4h": (1, 2, 6), "1d": (1, 2, 3)}
TP_SL = (0.003, 0.005)
DIRECTIONS = ("LONG", "SHORT")
LABELS = ("TP_FIRST", "SL_FIRST", "NEITHER", "AMBIGUOUS")
LOOKBACK_DAYS = 850
AGE_BAND_HOURS = (720, 4320, 8760)
AGE_BANDS = ("recent_0_30d", "medium_30_180d", "old_180_365d", "very_old_over_365d")
SCORE_AGE_BANDS = ("0-30d", "30-90d", "90-180d", "180-365d", "365d+")
DETECTOR_CONFIGS = (
    ("A", None),
    ("B", 1),
    ("B", 2),
    ("C", 0.003),
    ("C", 0.005),
    ("D", 50.0),
    ("D", 100.0),
)
MINUTE_ABS_TOL = 0.01
MINUTE_REL_TOL = 0.01
BLOCK_MAX_MINUTES = 5
BLOCK_MAX_GAP_MS = 5000
BLOCK_ABS_TOL = 0.01
BLOCK_REL_TOL = 0.01
MIN_SUPPORT_ROWS = 200
MIN_SUPPORT_WEEKS = 5
MIN_FINITE_DRAWS = 950
DRAWS = 1000


@dataclass(frozen=True)
class Scoring:
    """How levels around a price become one balance per timeframe, and those one number."""

    widths: dict = field(default_factory=lambda: dict(WIDTHS))  # share of the price on which a level counts in full
    outer: float = 1.5  # times that width: where it stops counting
    weights: dict = field(default_factory=lambda: {"1d": 1.0, "15m": 0.85, "1h": 0.7, "4h": 0.55})
    days: int = LOOKBACK_DAYS
    half_life: float = 180.0  # days
    least_weight: float = 0.25  # of the oldest level
    balanced: float = 0.05  # balances up to here are neither side


@dataclass(frozen=True)
class Slopes:
    swings: dict = field(default_factory=lambda: {"short": 2, "medium": 4, "long": 8})  # bars on each side
    days: int = LOOKBACK_DAYS
    horizons: tuple = (4, 8, 16, 32)  # bars after an entry


@dataclass(frozen=True)
class Ranks:
    """Percentiles among earlier values."""

    samples: int = 30  # fewer give none
    bands: tuple = (75, 90, 95)


def _within(low, high):
    return lambda xs: all(low < x < high for x in xs)


# (part, value, what must hold, what is wrong otherwise)
RULES = (
    (Scoring, lambda p: [p.days], _within(0, 3001), "days of levels: 1 to 3000"),
    (Scoring, lambda p: [p.half_life], _within(0, float("inf")), "half life must be positive"),
    (Scoring, lambda p: [p.least_weight], lambda x: 0 <= x[0] <= 1, "least weight: 0 to 1"),
    (Scoring, lambda p: [p.outer], lambda x: x[0] >= 1, "outer width: at least the inner one"),
    (Scoring, lambda p: [p.balanced], lambda x: 0 <= x[0] < 1, "balanced band: 0 to below 1"),
    (Scoring, lambda p: [set(p.widths), set(p.weights)], lambda x: x[0] == x[1] <= set(STEPS), "widths and weights need the same known timeframes"),
    (Scoring, lambda p: p.widths.values(), _within(0, 1), "widths lie between 0 and 1"),
    (Scoring, lambda p: p.weights.values(), _within(0, float("inf")), "weights must be positive"),
    (Slopes, lambda p: [p.days], _within(0, 3001), "days of slopes: 1 to 3000"),
    (Slopes, lambda p: p.swings.values(), _within(0, 101), "swings: 1 to 100 bars"),
    (Ranks, lambda p: [p.samples], lambda x: x[0] >= 1, "at least one sample"),
    (Ranks, lambda p: p.bands, lambda x: len(x) == 3 and 0 < x[0] < x[1] < x[2] < 100, "three rising bands between 0 and 100"),
)


@dataclass(frozen=True)
class Settings:
    """All settings in three parts; JSON has an object for each part that differs from its defaults."""

    scoring: Scoring = field(default_factory=Scoring)
    slopes: Slopes = field(default_factory=Slopes)
    ranks: Ranks = field(default_factory=Ranks)

    def __post_init__(self):
        wrong = [text for kind, values, holds, text in RULES for part in (self.scoring, self.slopes, self.ranks) if isinstance(part, kind) and not holds(values(part))]
        if wrong:
            raise ValueError("; ".join(wrong))

    @classmethod
    def from_json(cls, text: str) -> "Settings":
        kinds = {"scoring": Scoring, "slopes": Slopes, "ranks": Ranks}
        try:
            parts = {n: kinds[n](**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()}) for n, x in json.loads(text).items()}
        except (KeyError, TypeError) as exc:
            raise ValueError(f"unknown setting: {exc}") from None
        return cls(**parts)

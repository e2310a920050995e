"""Frozen rule sets.  Defaults are the nominal five-minute protocol; plans rescale them."""

from __future__ import annotations

from dataclasses import dataclass, field

KEYS = ("entity_id", "split")


@dataclass(frozen=True)
class GapBin:
    label: str
    lower: float | None = None
    upper: float | None = None
    lower_inclusive: bool = False
    upper_inclusive: bool = True


@dataclass(frozen=True)
class ToleranceRule:
    name: str
    lower: float
    upper: float


# The nominal gap bins and adjacency rules, in minutes.
NOMINAL_BINS = (
    GapBin("<4.5", None, 4.5, upper_inclusive=False),
    GapBin("4.5-5.5", 4.5, 5.5, lower_inclusive=True),
    GapBin("5.5-6", 5.5, 6.0),
    GapBin("6-7.5", 6.0, 7.5),
    GapBin("7.5-12.5", 7.5, 12.5),
    GapBin("12.5-17.5", 12.5, 17.5),
    GapBin("17.5-30", 17.5, 30.0),
    GapBin("30-60", 30.0, 60.0),
    GapBin("1-2h", 60.0, 120.0),
    GapBin("2-6h", 120.0, 360.0),
    GapBin("6-24h", 360.0, 1440.0),
    GapBin(">24h", 1440.0, None),
)
NOMINAL_RULES = (
    ToleranceRule("4.5-5.5", 4.5, 5.5),
    ToleranceRule("4-6", 4.0, 6.0),
    ToleranceRule("3.5-6.5", 3.5, 6.5),
    ToleranceRule("3-7", 3.0, 7.0),
)
# Suffix ratios of the varying-termination diagnostic.
SUFFIX_RATIOS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


@dataclass(frozen=True)
class GapProtocol:
    nominal_min: float = 5.0
    valid_min: tuple[float, float] = (4.5, 5.5)
    genuine_gap_min: float = 7.5
    one_missing_max: float = 12.5
    two_missing_max: float = 17.5
    bins: tuple[GapBin, ...] = NOMINAL_BINS
    rules: tuple[ToleranceRule, ...] = NOMINAL_RULES
    lattice_step_min: float = 5.0
    lattice_tolerance_min: float = 1.0
    lattice_genuine_gap_min: float = 7.5
    chunk_min: float = 7 * 1440.0


@dataclass(frozen=True)
class QualityRules:
    readings_per_day: int = 288
    readings_per_window: int = 6
    min_readings: int = 100
    min_windows: int = 10
    max_missing: float = 0.5


# The 21 state features in protocol order with (center, scale).
FEATURE_SCALING = {
    "value_current": (120.0, 50.0),
    "value_delta": (0.0, 20.0),
    "slope_short": (0.0, 2.0),
    "slope_long": (0.0, 2.0),
    "mean_short": (120.0, 50.0),
    "std_short": (0.0, 30.0),
    "mean_long": (120.0, 50.0),
    "std_long": (0.0, 30.0),
    "rate_current": (0.0, 2.0),
    "rate_mean": (0.0, 2.0),
    "delivered_short": (0.0, 10.0),
    "delivered_long": (0.0, 20.0),
    "residual_exposure": (0.0, 10.0),
    "since_action": (0.0, 240.0),
    "exposure_short": (0.0, 100.0),
    "exposure_long": (0.0, 150.0),
    "since_exposure": (0.0, 240.0),
    "time_of_day_sin": (0.0, 1.0),
    "time_of_day_cos": (0.0, 1.0),
    "previous_gap": (5.0, 5.0),
    "missing_fraction": (0.0, 1.0),
}
FEATURES = tuple(FEATURE_SCALING)


@dataclass(frozen=True)
class FeatureProtocol:
    interval_min: float = 5.0
    max_gap_min: float = 5.5
    slope_min: tuple[float, float] = (15.0, 30.0)
    stats_min: tuple[float, float] = (30.0, 120.0)
    delivery_min: tuple[float, float] = (30.0, 120.0)
    residual_horizon_min: float = 240.0
    exposure_min: tuple[float, float] = (30.0, 120.0)
    since_cap_min: float = 240.0
    gap_cap_min: float = 240.0
    rate_mean_min: float = 30.0
    rate_step_min: float = 5.0
    expected_short: int = 7
    chunk_min: float = 7 * 1440.0
    scaling: dict = field(default_factory=lambda: dict(FEATURE_SCALING))


@dataclass(frozen=True)
class RewardRule:
    low: float = 70.0
    high: float = 180.0
    # Ordered utility steps (upper bound, bound belongs to the step, utility).
    steps: tuple[tuple[float, bool, float], ...] = (
        (54.0, False, -4.0), (70.0, False, -2.0), (180.0, True, 1.0), (250.0, True, -1.0))
    above: float = -2.0


@dataclass(frozen=True)
class SupportRule:
    absolute_count_floor: int = 40
    parameter_multiplier: float = 3.0
    min_active_each_side: int = 6
    min_both_sides: int = 5
    min_unique_each_side_action: int = 4
    max_action1_share: float = 0.60
    max_total_share: float = 0.45

    def required(self, dimension: int) -> int:
        import math
        return max(self.absolute_count_floor, math.ceil(self.parameter_multiplier * dimension))

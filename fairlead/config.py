"""Constants of the engine in one place; operators take them as parameters with these defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Box:
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float


#: Study area, units, limits and sentinels of position messages.
STUDY_BOX = Box(54.5, 56.5, 10.0, 13.0)
METRES_PER_DEGREE = 111320.0
KNOT = 0.514444
SOG_INVALID, COG_INVALID = 102.3, 360.0
DRAUGHT_MIN, DRAUGHT_MAX = 1.0, 25.5
DR_THRESHOLD_M, DR_GAP_S = 50.0, 600
DR_GRID_M = (10.0, 25.0, 50.0, 100.0, 250.0, 500.0)
CROSSING_GAP_S, BAND_DEGREES, CORRIDOR_RINGS = 600, 0.04, 2
GRID_STEP_S, GRID_GAP_S = 600, 1200
FERRY_CROSSINGS, TRANSIT_HOURS = 4, 12

#: The signal rule and its evaluation.
WEEKS, MIN_BASE_DAYS, K, MAD_SCALE = 4, 3, 2.0, 1.4826
MIN_LEARN_DAYS = 21
K_GRID = tuple(i / 4 for i in range(4, 17))
WEEK_CHOICES = (2, 3, 4, 6)
CUSUM_REF, CUSUM_GRID = 0.5, (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0)
INJECTED_SIZES, INJECTED_DAYS, AFTER_DAYS, TARGET_DETECTION = (0.1, 0.2, 0.3, 0.4, 0.5), (1, 2, 7), 7, 0.9
#: Size and days of the event that the operating point must find, and of the weak, lasting one.
CASE_EVENT, WEAK_EVENT = (0.3, 2), (0.1, 7)
ROLLING_DAYS = 7
BOOTSTRAP_N, ALPHA, DID_SEED = 2000, 0.05, 20261028

#: Study windows (both ends in) and sampled weekdays (Monday is 0).
WINDOWS = {
    "A26": ("2026-01-12", "2026-02-27"),
    "B26": ("2026-03-09", "2026-05-29"),
    "A25": ("2025-01-13", "2025-02-28"),
    "B25": ("2025-03-10", "2025-05-30"),
}
SAMPLE_WEEKDAYS = (1, 3)
#: Limit of laden tankers, its variants, and the study's metrics as ratios of two daily columns.
TANKER_LIMIT, LIMIT_VARIANTS = 0.8148, (0.7648, 0.8648)
METRICS = {"H1": ("h1", "one"), "H2": ("h2_top", "h2_bottom"), "H3": ("h3", "one")}
#: Centre and half heights (degrees) of the area sweep, and the lay-out trial's box and rows a group.
SWEEP_CENTRE, SWEEP_HEIGHTS = (55.34, 11.00), (0.01, 0.025, 0.05, 0.1, 0.2, 0.4, 0.8)
TRIAL_BOX, GROUP_ROWS = Box(55.28, 55.40, 10.85, 11.15), 100_000

HIGH, LOW, NORMAL, NO_BASE = "szokatlanul magas", "szokatlanul alacsony", "normál", "nincs alapszint"
BOTH_GATES = "Mindkét kapu"

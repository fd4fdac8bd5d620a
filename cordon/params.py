"""Fixed values and default parameters.

Everything under the "fixed values" banner must equal the audited pipeline's
values for results to match; everything else is a tunable default.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must match the audited pipeline exactly)
# ---------------------------------------------------------------------------

# Congestion relief zone (Manhattan south of 60th St), taxi zone ids.
CONGESTION_ZONE_IDS = [
    4, 12, 13, 43, 45, 48, 50, 68, 79, 87, 88, 90, 100, 107, 113, 114, 125,
    137, 140, 141, 144, 148, 158, 161, 162, 163, 164, 170, 186, 209, 211, 224,
    229, 230, 231, 232, 233, 234, 246, 249, 261,
]

# Zones bordering the cordon (just north of 60th St).
BORDER_ZONE_IDS = [142, 143, 151, 236, 237, 238, 239, 262, 263]

# Upper Manhattan zones.
UPPER_MANHATTAN_IDS = [
    24, 41, 42, 74, 75, 116, 120, 127, 128, 152, 153, 166, 194, 202, 243, 244,
]

# Island zones appended to the all-Manhattan roster.
ISLAND_IDS = [103, 104, 105]

# Names of the border zones, id -> name; other names come from the zone lookup.
ZONE_NAMES = {
    142: "Lincoln Square East", 143: "Lincoln Square West", 151: "Manhattan Valley",
    236: "Upper East Side North", 237: "Upper East Side South",
    238: "Upper West Side North", 239: "Upper West Side South",
    262: "Yorkville East", 263: "Yorkville West",
}

# Map coordinates of the border zones, id -> (lat, lon), and the default.
BORDER_COORDS = {
    142: (40.7736, -73.9830), 143: (40.7725, -73.9870),
    151: (40.7968, -73.9664), 236: (40.7804, -73.9530),
    237: (40.7689, -73.9595), 238: (40.7915, -73.9744),
    239: (40.7800, -73.9795), 262: (40.7767, -73.9530),
    263: (40.7756, -73.9595),
}
DEFAULT_COORD = (40.77, -73.97)

# Toll start (inclusive, no upper bound).
CONGESTION_START = "2025-01-05"

# Ghost-trip thresholds.
MAX_SPEED_MPH = 65
MIN_TRIP_MINUTES = 1
TELEPORTER_FARE = 20

# Speed averaging only counts trips longer than this many seconds.
SPEED_MIN_SECONDS = 60

# Missing-month imputation: weights of the two earlier years.
IMPUTE_YEARS = (2023, 2024)
IMPUTE_WEIGHTS = (0.3, 0.7)

# Elasticity labels.
ELASTIC_SLOPE = 1000
INELASTIC_CORR = 0.5

# Ghost class labels, in rule order.
GHOST_IMPOSSIBLE = "impossible_physics"
GHOST_TELEPORTER = "teleporter"
GHOST_STATIONARY = "stationary_ride"

# Trip-file naming and link resolution.
TAXI_TYPES = ["yellow", "green"]
TRIP_FILE_PATTERN = r"(yellow|green)_tripdata_(\d{4})-(\d{2})\.parquet"
TRIP_FILE_FORMAT = "%s_tripdata_%d-%02d.parquet"
TRIP_FILE_HOST = "https://d37ci6vzurychx.cloudfront.net"
TRIP_FILE_DIR = "/trip-data/"

# Month labels, Jan first (index 1 = January).
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
              "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Day labels, Sunday first (day_of_week 0 = Sunday).
DAY_ABBR = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]

# ---------------------------------------------------------------------------
# Tunable defaults (not part of the fixed contract)
# ---------------------------------------------------------------------------

SUSPICIOUS_TOP_N = 5
MISSING_TOP_N = 3
MISSING_MIN_ENTRIES = 100
ANALYSIS_YEAR = 2025
COMPARISON_YEAR = 2024

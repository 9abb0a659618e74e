"""Fixed values that results depend on. Distances in metres, times in seconds."""

# Unit conversions.
FT_PER_M = 3.28084
M_PER_MI = 1609.344
MPS_TO_MPH = 2.236936292054402
M_PER_DEG = 111320.0
M_PER_DEG_LAT_APP = 110540.0
EARTH_R_M = 6371000.0

# Map matching and smoothing defaults.
MAX_PERP_M = 50.0
BANDWIDTH = 20
ARCHIVE_BANDWIDTH = 5
DEGREE = 3
INVERSE_SAMPLES = 4000
INVERSE_EPS_M = 1e-6

# Delay decomposition defaults.
SLOW_MPH = 5.0
MIN_EVENT_S = 15.0
CREEP_MERGE_M = 20.0
DENSE_DT_S = 2.0
CRUISE_MPH = 12.0
NEAR_SIDE_M = 90 / FT_PER_M
DWELL_BACK_M = 30.0
DWELL_AHEAD_M = 10.0
CROSSING_APPROACH_M = 50.0
SIGNAL_APPROACH_M = 91.44
PAST_FACILITY_M = 10.0

# Control point types.
SIGNAL_TYPES = ("traffic_signals", "ped_crossing_signal")
CLUSTER_TYPES = ("traffic_signals", "stop", "give_way")
KEEP_TYPES = ("traffic_signals", "stop", "ped_crossing_signal", "ped_crossing_marked")
CATEGORIES = ("dwell", "crossing", "signal_uniform", "signal_overflow", "slowdown")

# Road classes a vehicle drives on.
VEHICLE_HIGHWAYS = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "unclassified",
    "residential", "service", "living_street", "motorway_link", "trunk_link",
    "primary_link", "secondary_link", "tertiary_link", "road", "busway",
)

# Road feature thresholds.
NODE_PERP_M = 30.0
SIGN_M = 30.0
CLUSTER_GAP_M = 30.0
ANCHOR_M = 40.0
DROP_NEAR_M = 40.0

# Trip selection gates.
MIN_PINGS = 30
GATE_MAX_PERP_M = 80.0
ORIGIN_TOL_M = 600.0
TERMINAL_TOL_M = 150.0
MAX_GAP_S = 300.0
MAX_TRIP_S = 4 * 3600.0
MIN_LAT_SPAN = 0.12
END_MARGIN_S = 300.0
LOCAL_TZ = "America/Chicago"
NON_REVENUE_ROUTES = ("", "0", "992", "999", "None")

# Sensitivity study.
N_LEVELS = 8
POS_TOL_M = 50.0
SPEED_TOL_MPH = 2.5
EVENT_MATCH_MIN_OVERLAP = 0.5
DOOR_MIN_S = 10.0
DOOR_MAX_S = 180.0
DOOR_ANY_S = 5.0
DOOR_TOL_S = 30.0

# Motion sensors.
GAP_SPLIT_S = 0.5
MIN_SEGMENT_SAMPLES = 11
SUSTAINED_HZ = 0.4
GRAVITY_HZ = 0.1
GRAVITY_DETECT = 5.0
HANDLING_DPS = 60.0
HANDLING_HZ = 1.0
HANDLING_PAD_S = 1.0
MOVING_MPS = 3.0
GPS_BANDWIDTH = 15

# Width of the time slices that ordered scans use. One vehicle reports at most
# one fix per timestamp, so a slice holds a bounded number of rows however
# large its trip grows.
SLICE_S = 7200.0

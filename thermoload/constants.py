"""Domain constants.

FIXED VALUES: the station ids, region mappings, thresholds, county lists,
score bands, labels and colours below must equal the values the original
analysis used, so results stay comparable. They are stated plainly, in their
natural order, and every operator takes them as overridable parameters.
"""

from __future__ import annotations

# --- FIXED VALUES: weather stations -----------------------------------------
# station code -> NOAA station id
STATION_IDS: dict[str, str] = {
    "IAD": "72403093738",  # Washington Dulles
    "BOS": "72509014739",  # Boston
    "NYC": "74486094789",  # New York City
    "LAX": "72295023174",  # Los Angeles
}

# station code -> balancing-authority (parent) region
STATION_REGION: dict[str, str] = {
    "IAD": "PJM",
    "BOS": "ISNE",
    "NYC": "NYIS",
    "LAX": "CISO",
}

# parent region -> sub-areas summed into the regional load
REGION_SUBAREAS: dict[str, list[str]] = {
    "PJM": ["DOM"],
    "ISNE": ["4007", "4008"],
    "NYIS": ["ZONJ", "ZONK"],
    "CISO": ["SCE"],
}

YEARS = [2019, 2020, 2021, 2022, 2023, 2024, 2025]
LOAD_PERIOD_START = "2019-01-01T00"
LOAD_PERIOD_END = "2025-08-27T04"
LOAD_PAGE_SIZE = 5000

# --- FIXED VALUES: weather / load cleaning ----------------------------------
TMP_MISSING = "+9999"          # packed temperature sentinel
TMP_SCALE = 10.0               # tenths of a degree C
LOAD_MAX_MWH = 500000.0        # rows with load > max or <= 0 are removed
HOT_DAY_C = 32.22              # daily max at or above this is a hot day
HEATWAVE_MIN_DAYS = 3          # consecutive hot days that make a heatwave

# --- FIXED VALUES: temperature categories (hourly) --------------------------
COLD_BELOW_C = 0.0
HOT_ABOVE_C = 32.0
CAT_COLD = "Cold (<0°C)"
CAT_HOT = "Hot (>32°C)"
CAT_NORMAL = "Normal (0–32°C)"
CATEGORIES = [CAT_COLD, CAT_HOT, CAT_NORMAL]

# --- FIXED VALUES: curve fitting --------------------------------------------
CURVE_POINTS = 200
ANNOTATION_FRACTION = 0.85

# --- FIXED VALUES: facilities -----------------------------------------------
FOCUS_COUNTIES = ["Loudoun", "Fairfax", "Prince William", "Fauqier", "Culpeper"]

# raw facility column (long, human-readable name) -> clean column name
FACILITY_TEXT_COLUMNS = ["company", "brand", "city", "county", "address", "zip"]
FACILITY_POWER_KW = {
    "total generator rate capacity kw": "capacity_mw",
    "estimate power consumption in kw/hr (calculated 30%)": "est_load_30_mw",
    "estimate power consumption in kw/hr (calculated 50%)": "est_load_50_mw",
    "estimate power consumption in kw/hr (calculated 60%)": "est_load_60_mw",
}
FACILITY_ANNUAL_TWH = (
    "estimated data center electricity use in terrawatt-hours a year at 50% capacity",
    "annual_load_50_twh",
)
FACILITY_POPULATION = ("total population within 1 mile of site", "pop_within_mile")
FACILITY_CO = ("co tpy", "co_tons_per_year")
FACILITY_WATER = ("water stress", "water_stress_index")
FACILITY_YEAR = ("data center construct year", "construct_year")
FACILITY_EJ = {
    "us percentile for ej index for particulate matter": "ej_particulate_matter",
    "us percentile for ej index for ozone": "ej_ozone",
    "us percentile for ej index for diesel particulate matter": "ej_diesel_pm",
    "us percentile for ej index for nitrogen dioxide (no2)": "ej_nitrogen_dioxide",
    "us percentile for ej index for traffic proximity and volume": "ej_traffic",
    "us percentile for ej index for hazardous waste proximity": "ej_hazardous_waste",
    "us percentile for ej index for superfund proximity": "ej_superfund",
    "us percentile for ej index for rmp proximity": "ej_rmp",
    "us percentile for ej index for underground storage tanks (ust) indicator": "ej_ust",
    "us percentile for ej index for toxic releases to air": "ej_toxic_air",
    "us percentile for ej index for wastewater discharge indicator": "ej_wastewater",
    "us percentile for ej index for lead paint indicator": "ej_lead_paint",
    "us percentile for ej index for drinking water non-compliance": "ej_drinking_water",
}
EJ_COLUMNS = list(FACILITY_EJ.values())

# --- FIXED VALUES: exemption score rubric -----------------------------------
POWER_POINTS = 28
EJ_POINTS = 20
POPULATION_POINTS = 15
WATER_POINTS = 12
EJ_CONCERN_PERCENTILE = 80.0
POWER_BANDS = [(20, 28), (75, 18), (200, 7)]               # (MW at most, points), above: 0
POPULATION_BANDS = [(1000, 15), (5000, 10), (10000, 5)]    # (residents below, points), from there: 0
WATER_LOW_POINTS = 12
WATER_MEDIUM_HIGH_POINTS = 6
WATER_LOW = ["Low (<10%)", "Low - Medium (10-20%)"]
WATER_MEDIUM_HIGH = "Medium - High (20-40%)"
WATER_HIGH = ["High (40-80%)", "Extremely High (>80%)"]
UNSCORED_CATEGORIES = [  # (category, max points, reason)
    ("Renewable Energy", 10, "No renewable energy data (0/10)"),
    ("CO2 Emissions", 7, "No CO2 emissions data (0/7)"),
    ("Community Engagement", 4, "No community engagement data (0/4)"),
    ("Disclosure", 4, "No disclosure data (0/4)"),
]
UNSCORED_DETAIL = "No data available"
UNSCORED_ISSUE_MARKERS = ["No renewable", "No CO2", "No community", "No disclosure"]
TIER_FULL = (80, "Full Exemption (100%)")
TIER_PARTIAL = (60, "Partial Exemption (50%)")
TIER_NONE = "No Exemption (0%)"

# --- FIXED VALUES: rubric texts ("{}" is where the value goes) -----------------
# failing-criteria reasons
REASON_NO_CAPACITY = "No capacity data"
REASON_HIGH_CAPACITY = "High capacity ({} MW)"
REASON_EJ = "Environmental justice concerns (max percentile: {})"
REASON_NO_POPULATION = "No population data"
REASON_POPULATION = "Population exposure: {} residents"
REASON_POPULATION_HIGH = "High population exposure: {} residents"
REASON_POPULATION_VERY_HIGH = "Very high population exposure: {} residents"
REASON_WATER_MEDIUM_HIGH = "Medium-high water stress"
REASON_WATER_HIGH = "High water stress ({})"
# score breakdown details
DETAIL_NO_DATA = "No data"
DETAIL_POWER = ["{} MW (≤20)", "{} MW (20-75)", "{} MW (75-200)", "{} MW (>200)"]
DETAIL_EJ_OK = "No EJ concerns (all percentiles < 80)"
DETAIL_EJ_FLAG = "EJ flag (max percentile: {})"
DETAIL_POPULATION = ["{} residents (<1,000)", "{} residents (1k-5k)", "{} residents (5k-10k)",
                     "{} residents (≥10k)"]
DETAIL_WATER = ["Low stress: {}", "Med-high stress: {}", "High/extreme stress: {}"]
SCORED_CATEGORIES = ["Power", "Environmental Justice", "Population", "Water Stress"]
UNKNOWN_FACILITY = "Unknown Facility"

# web dashboard variant
WEB_TIERS = [(80, "Full Exemption", "#16a34a"), (60, "Partial Exemption", "#ca8a04")]
WEB_TIER_NONE = ("No Exemption", "#dc2626")
CAPACITY_BANDS = [  # (lower bound exclusive, label, colour), checked top-down
    (200.0, "> 200 MW", "#a00060"),
    (75.0, "75 – 200 MW", "#ff69b4"),
    (20.0, "20 – 75 MW", "#ff6600"),
]
CAPACITY_BAND_LOW = ("≤ 20 MW", "#ffaa00")
CAPACITY_BAND_UNKNOWN = ("Unknown", "#999")
UNKNOWN_MARKER_Z = -1000
HOUSEHOLD_KW = 1.2
CARD_PERCENTILES = [
    ("Particulate Matter", "ej_particulate_matter"),
    ("Diesel Particulate Matter", "ej_diesel_pm"),
    ("Ozone", "ej_ozone"),
    ("Nitrogen Dioxide", "ej_nitrogen_dioxide"),
]
# facility card texts
CARD_NA = "N/A"
CARD_PLACE = "{}, {} County, VA {}"
CARD_PERCENTILE = "{}th"
CARD_SCORE = "{}/100"
CARD_NULL = "null"  # a NULL printed by a JavaScript template
HISTOGRAM_BIN = 5
HISTOGRAM_RANGE = (0, 100)

# --- FIXED VALUES: map layers -------------------------------------------------
STATE_FIPS_PREFIX = "51"
FOCUS_STATES = ["Virginia", "District of Columbia"]
FOCUS_COUNTY_FIPS = ["51107", "51059", "51153", "51047", "51179", "51061",
                     "51683", "51685", "51600", "51013", "51610", "51510"]

# --- FIXED VALUES: dashboard load chart ---------------------------------------
SERIES_LOCATION = "IAD"
SUMMER_WINDOWS = [  # (year, first day, last day)
    (2023, "2023-06-01", "2023-08-31"),
    (2024, "2024-06-01", "2024-08-31"),
    (2025, "2025-06-01", "2025-08-31"),
]
# Test windows inside the driver's event month (its data cover January 2024).
JAN_TEST_WINDOWS = [
    (2024, "2024-01-01", "2024-01-10"),
    (2024, "2024-01-11", "2024-01-20"),
    (2024, "2024-01-21", "2024-01-31"),
]
GRID_CAPACITY_MW = 27000.0
DC_LOAD_50_MW = 10027.0
PEAK_SUMMER_MW = 23905.0
GRID_LABELS = ["Data Center Load", "Peak Summer Load", "Remaining Grid Capacity"]
PEAK_LABEL = "Summer {}<br><b>{} MWh</b>"
PEAK_DAY_REPLACEMENTS = [("-06-", "-07-"), ("-01", "-15")]  # first occurrence each, in order

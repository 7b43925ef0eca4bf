"""Adapters: the reference's raw input shapes derived from the driver tables.

The reference lands NOAA CSV files, load-API pages and a facility table; none
ship with it. These views re-shape the driver's ``events`` and ``part`` tables
into those inputs (rules of FIXTURES.md), row for row, so every query's work
grows with the tables. Nothing is sampled or capped.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- weather observations (NOAA CSV shape: STATION, DATE, TMP as text) -----------

def noaa_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    ev = ev.withColumn("t", F.expr(
        "CAST((CASE WHEN user_id % 5 = 1 THEN -80 ELSE 200 END)"
        " + ((extract(day FROM ts) + 3 * (user_id % 5)) % 11) * 12"
        " + CASE WHEN extract(day FROM ts) % 7 = 0 THEN 80 ELSE 0 END"
        " + event_id % 60 AS INT)"))
    ids = list(K.STATION_IDS.values())
    return ev.select(
        F.expr(f"CASE user_id % 5 WHEN 0 THEN '{ids[0]}' WHEN 1 THEN '{ids[1]}' "
               f"WHEN 2 THEN '{ids[2]}' WHEN 3 THEN '{ids[3]}' ELSE '99999999999' END").alias("STATION"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("DATE"),
        F.expr("CASE WHEN event_id % 23 = 0 THEN '+9999,9' WHEN event_id % 29 = 0 THEN 'bad,1' "
               "WHEN event_id % 31 = 0 THEN concat('+', CAST(100 + event_id % 60 AS STRING), '.7,1') ELSE "
               "concat(CASE WHEN t < 0 THEN '-' ELSE '+' END, lpad(CAST(abs(t) AS STRING), 4, '0'), ',1') END"
               ).alias("TMP"),
    )


# --- load API rows (period, parent, parent-name, subba, value as text) -------------

def eia_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts")
    ev = ev.withColumn("parent", F.expr(
        "CASE event_id % 5 WHEN 0 THEN 'PJM' WHEN 1 THEN 'ISNE' WHEN 2 THEN 'NYIS' "
        "WHEN 3 THEN 'CISO' ELSE 'MISO' END"))
    return ev.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH").alias("period"),
        "parent",
        F.concat("parent", F.lit(" name")).alias("parent_name"),
        F.expr("CASE parent WHEN 'PJM' THEN 'DOM' "
               "WHEN 'ISNE' THEN CASE WHEN event_id % 2 = 0 THEN '4007' ELSE '4008' END "
               "WHEN 'NYIS' THEN CASE WHEN event_id % 2 = 0 THEN 'ZONJ' ELSE 'ZONK' END "
               "WHEN 'CISO' THEN 'SCE' ELSE 'OTH' END").alias("subba"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 97 = 0 THEN '600000' "
               "WHEN event_id % 89 = 0 THEN '-900000' "
               "ELSE CAST(4000 + (event_id * 37) % 9000 AS STRING) END").alias("value"),
    )


def eia_raw_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eia_raw`` as a wider fetch would land it: every seventh value of another sub-area, every
    eleventh out of the configured period."""
    d, n = eia_raw(spark, sf_dir), F.coalesce(F.col("value").cast("bigint"), F.lit(0))
    late = F.when(n % 2 == 0, F.lit("2018-12-31T23")).otherwise(F.lit("2025-08-27T05"))
    return (d.withColumn("subba", F.when(n % 7 == 3, F.concat(F.lit("X"), "subba")).otherwise(F.col("subba")))
            .withColumn("period", F.when(n % 11 == 5, late).otherwise(F.col("period"))))


# --- facility raw table ------------------------------------------------------------

def _wkb_point(x: float, y: float, little: bool) -> str:
    order = "<" if little else ">"
    return struct.pack(f"{order}bIdd", 1 if little else 0, 1, x, y).hex().upper()


# Test geometries, chosen by facility_id % 4 (the last branch is NULL).
FIXTURE_POINTS = [(-77.4875, 39.0437, True), (-77.5, 38.95, False), (-77.123456, 38.654321, True)]
FIXTURE_WKB_HEX = [_wkb_point(x, y, le) for x, y, le in FIXTURE_POINTS]

_FAC_SHORT = [
    "concat('Co', CAST(k % 40 AS STRING)) AS company",
    "CASE WHEN k % 31 = 0 THEN NULL ELSE concat('Brand', CAST(k % 60 AS STRING)) END AS brand",
    "CASE k % 7 WHEN 0 THEN 'Loudoun' WHEN 1 THEN 'Fairfax' WHEN 2 THEN 'Prince William' WHEN 3 THEN 'Fauqier' WHEN 4 THEN 'Culpeper' WHEN 5 THEN 'Fauquier' ELSE 'Arlington' END AS county",
    "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN 'N/A' ELSE CASE WHEN c >= 1000 THEN concat(CAST(CAST(floor(c / 1000) AS INT) AS STRING), ',', lpad(CAST(c % 1000 AS STRING), 3, '0')) ELSE CAST(c AS STRING) END END AS capacity_kw",
    "CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN '1234.7' WHEN k % 37 = 0 THEN 'n/a' ELSE CASE WHEN p >= 1000 THEN concat(CAST(CAST(floor(p / 1000) AS INT) AS STRING), ',', lpad(CAST(p % 1000 AS STRING), 3, '0')) ELSE CAST(p AS STRING) END END AS pop",
    "CASE k % 8 WHEN 0 THEN 'Low (<10%)' WHEN 1 THEN 'Low - Medium (10-20%)' WHEN 2 THEN 'Medium - High (20-40%)' WHEN 3 THEN 'High (40-80%)' WHEN 4 THEN 'Extremely High (>80%)' WHEN 5 THEN 'Arid and Low Water Use' WHEN 6 THEN 'Low (new label)' ELSE NULL END AS water_stress",
    "concat('City', CAST(k % 12 AS STRING)) AS city",
    "CASE WHEN k % 9 = 0 THEN NULL WHEN k % 10 = 0 THEN '' ELSE concat(CAST(k AS STRING), ' Main St') END AS address",
    "concat('20', lpad(CAST(k % 1000 AS STRING), 3, '0')) AS zip",
    "CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(CAST(floor(c * 3 / 10) AS INT) AS STRING) END AS est30_kw",
    "CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(CAST(floor(c * 5 / 10) AS INT) AS STRING) END AS est50_kw",
    "CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(CAST(floor(c * 6 / 10) AS INT) AS STRING) END AS est60_kw",
    "CASE WHEN k % 11 = 0 THEN NULL ELSE concat('0.', lpad(CAST(k % 1000 AS STRING), 3, '0')) END AS annual_twh",
    "CASE WHEN k % 14 = 0 THEN '' ELSE concat('1,', lpad(CAST(k % 1000 AS STRING), 3, '0'), '.5') END AS co_tpy",
    "CASE WHEN k % 16 = 0 THEN 'unknown' ELSE CAST(1990 + k % 35 AS STRING) END AS construct_year",
]

# (short name, multiplier) of the 13 percentile columns; a column is NULL when
# k % (29 + i) = 0, and otherwise (k * mult) % 70 for k % 3 = 0, else % 101.
_EJ_RULE = [(name, 51 + 17 * i, 29 + i) for i, name in enumerate(K.EJ_COLUMNS)]


def _ej_expr(mult: int, null_mod: int) -> str:
    return (f"CASE WHEN k % {null_mod} = 0 THEN NULL WHEN k % 3 = 0 THEN CAST((k * {mult}) % 70 AS STRING) "
            f"ELSE CAST((k * {mult}) % 101 AS STRING) END")


def facility_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility raw rows with short column names (FIXTURES.md §3.3) + geometry."""
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("k"),
        F.expr("(p_partkey * 7919) % 300000 + 500").alias("c"),
        F.expr("(p_partkey * 331) % 15000").alias("p"))
    exprs = ["k AS facility_id"] + _FAC_SHORT
    exprs += [f"{_ej_expr(m, n)} AS {name}" for name, m, n in _EJ_RULE]
    geom = ("CASE k % 4 " + " ".join(f"WHEN {i} THEN unhex('{h}')" for i, h in enumerate(FIXTURE_WKB_HEX))
            + " ELSE NULL END AS geometry")
    return part.selectExpr(*exprs, geom)


def facility_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw facility table with its long, human-readable column names."""
    short_to_long = {
        "capacity_kw": "total generator rate capacity kw",
        "est30_kw": "estimate power consumption in kw/hr (calculated 30%)",
        "est50_kw": "estimate power consumption in kw/hr (calculated 50%)",
        "est60_kw": "estimate power consumption in kw/hr (calculated 60%)",
        "annual_twh": K.FACILITY_ANNUAL_TWH[0],
        "pop": K.FACILITY_POPULATION[0],
        "co_tpy": K.FACILITY_CO[0],
        "water_stress": K.FACILITY_WATER[0],
        "construct_year": K.FACILITY_YEAR[0],
    }
    short_to_long.update({v: k for k, v in K.FACILITY_EJ.items()})
    df = facility_short(spark, sf_dir)
    return df.select([F.col(c).alias(short_to_long.get(c, c)) for c in df.columns])


"""Hourly weather x load: decode, hourly aggregates, alignment by region-hour.

Shuffle plan: the two hourly aggregates each do a map-side partial aggregate
and one shuffle on their group keys (high cardinality: location x hour, so no
hot key survives the partial step); the region-hour join then shuffles two
already-aggregated tables (or AQE broadcasts one of them when its measured
size is small). The station->region mapping is a literal relation of known
size and is broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import (
    dbl, decode_tmp, station_code, strict_double, strict_observation_time, strict_timestamp, trunc_hour,
)

# --- weather --------------------------------------------------------------------


def decode_weather(raw: DataFrame, station_ids: dict[str, str] | None = None) -> DataFrame:
    """``noaa_hourly_temp``: station code, UTC timestamp, temperature in C.

    P1 unknown station ids pass through as text; P3 the timestamp cast is
    strict (malformed text fails the job, as in the reference); P2 decode.
    """
    return raw.select(
        station_code("STATION", station_ids).alias("station"),
        strict_observation_time("DATE").alias("ts_utc"),
        decode_tmp("TMP").alias("temp_C"),
    )


def hourly_temperature(temps: DataFrame) -> DataFrame:
    """``noaa_hourly_avg`` (A1): mean temperature per station and hour.

    Hours whose readings are all NULL stay, with a NULL mean.
    """
    return (temps.groupBy("station", trunc_hour("ts_utc").alias("hour_utc"))
            .agg(F.avg("temp_C").alias("temp_C")))


# --- load --------------------------------------------------------------------------


def load_rows(raw: DataFrame) -> DataFrame:
    """``eia_hourly_raw``: typed load rows; the value cast is strict."""
    cols = set(raw.columns)
    pick = lambda *names: next((F.col(f"`{n}`") for n in names if n in cols), F.lit(None).cast("string"))
    return raw.select(
        F.col("period"), F.col("parent"),
        pick("parent_name", "parent-name").alias("parent_name"),
        F.col("subba"),
        pick("subba_name", "subba-name").alias("subba_name"),
        strict_double("value", "load value").alias("value_mwh"),
    )


def select_load(raw: DataFrame, subareas: dict[str, list[str]] | None = None, start: str = K.LOAD_PERIOD_START,
                end: str = K.LOAD_PERIOD_END) -> DataFrame:
    """The load rows that the original fetch asks for: the configured region and sub-area
    pairs, ``start <= period <= end``. Landed pages may hold others. Plain comparisons on
    text (periods sort like their text), so they reach the scan; rows without a period go."""
    pairs = F.lit(False)
    for region, subs in (subareas or K.REGION_SUBAREAS).items():
        pairs = pairs | ((F.col("parent") == region) & F.col("subba").isin(subs))
    return raw.filter(pairs & (F.col("period") >= start) & (F.col("period") <= end))


def hourly_load(rows: DataFrame) -> DataFrame:
    """``eia_load_hourly`` (A2): load summed over sub-areas per region and hour.

    ``period`` is parsed strictly as ``yyyy-MM-dd'T'HH`` (P10). NULL values are
    skipped by the sum; an hour with only NULL values keeps a NULL load. Which
    rows count is decided before (``select_load``).
    """
    return (rows.groupBy(F.col("parent").alias("region"),
                         strict_timestamp("period", "yyyy-MM-dd'T'HH").alias("hour_utc"))
            .agg(F.sum("value_mwh").alias("load_mwh")))


# --- alignment ---------------------------------------------------------------------


def station_region_mapping(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    """The station -> region relation as an inline VALUES table."""
    return spark.createDataFrame(sorted((mapping or K.STATION_REGION).items()),
                                 "station string, region string")


def combine(spark: SparkSession, temps_hourly: DataFrame, load_hourly: DataFrame,
            mapping: dict[str, str] | None = None, max_load: float = K.LOAD_MAX_MWH) -> DataFrame:
    """``base_combine``: weather and load aligned by region and hour.

    J1 inner join to the (broadcast, fixed-size) mapping; J2 inner join on
    (region, hour); P11 then removes loads above ``max_load`` or <= 0 while
    rows with a NULL load stay (the reference's DELETE keeps them).
    """
    m = F.broadcast(station_region_mapping(spark, mapping))
    joined = (temps_hourly.join(m, "station")
              .join(load_hourly, ["region", "hour_utc"]))
    load = F.col("load_mwh")
    bad = (load > dbl(max_load)) | (load <= dbl(0.0))
    return (joined.filter(~F.coalesce(bad, F.lit(False)))
            .select("hour_utc", F.col("station").alias("location"),
                    F.col("temp_C").alias("temp"), "load_mwh"))


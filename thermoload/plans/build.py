"""End-to-end table builds (the reference's ingest and processing steps).

Each step writes its tables with replace semantics under ``root`` (a shared
folder on a cluster), counts rows while writing, and later steps read the
written tables back. Writing cuts lineage, so a lost executor only costs the
current step, and each table is computed once even when several consumers
use it. Fact tables are partitioned by year and sorted within partitions.

    counts = build_all(spark, noaa_raw, eia_raw, facility_raw, root)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import daily, dashboard, facilities, hourly, response
from ..sources import json_sources as J
from ..sources.sinks import read_table, replace_table, row_audit


def _writer(root: str, database: str | None):
    """``replace_table`` that also points the table's view in ``database`` at it."""
    def put(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_within: list | None = None) -> int:
        view = f"{database}.{path.removeprefix(root + '/')}" if database else None
        return replace_table(df, path, partition_by, sort_within, view)
    return put


def build_hourly(spark: SparkSession, noaa_raw: DataFrame, eia_raw: DataFrame, root: str,
                 select: bool = True, database: str | None = None) -> dict[str, int]:
    """Entry A: weather and load -> hourly tables -> ``base_combine``. ``select`` keeps the
    load rows of the configured sub-areas and period only (``hourly.select_load``)."""
    n: dict[str, int] = {}
    put = _writer(root, database)
    n["noaa_hourly_raw"] = put(noaa_raw, f"{root}/noaa_hourly_raw")
    temps = hourly.decode_weather(read_table(spark, f"{root}/noaa_hourly_raw"))
    n["noaa_hourly_temp"] = put(temps.withColumn("year", F.year("ts_utc")), f"{root}/noaa_hourly_temp",
                                          ["year"], ["station", "ts_utc"])
    temps = read_table(spark, f"{root}/noaa_hourly_temp").drop("year")
    n["noaa_hourly_avg"] = put(hourly.hourly_temperature(temps), f"{root}/noaa_hourly_avg",
                                         sort_within=["station", "hour_utc"])
    rows = hourly.load_rows(hourly.select_load(eia_raw) if select else eia_raw).withColumn("year", F.substring("period", 1, 4))
    n["eia_hourly_raw"] = put(rows, f"{root}/eia_hourly_raw", ["year"], ["parent", "period"])
    rows = read_table(spark, f"{root}/eia_hourly_raw").drop("year")
    n["eia_load_hourly"] = put(hourly.hourly_load(rows), f"{root}/eia_load_hourly",
                                         sort_within=["region", "hour_utc"])
    bc = hourly.combine(spark, read_table(spark, f"{root}/noaa_hourly_avg"),
                        read_table(spark, f"{root}/eia_load_hourly"))
    n["base_combine"] = put(bc, f"{root}/base_combine", sort_within=["hour_utc", "location"])
    return n


def build_daily(spark: SparkSession, root: str, database: str | None = None) -> dict[str, int]:
    """Entry B: daily temperatures, heatwave flags, daily load, merged table."""
    n: dict[str, int] = {}
    put = _writer(root, database)
    hourly_avg = read_table(spark, f"{root}/noaa_hourly_avg")
    n["noaa_daily_temp"] = put(daily.daily_temperature(hourly_avg), f"{root}/noaa_daily_temp",
                                         sort_within=["station", "day_utc"])
    flags = daily.heatwave_flags(read_table(spark, f"{root}/noaa_daily_temp"))
    n["noaa_heatwave_flags"] = put(flags, f"{root}/noaa_heatwave_flags",
                                             sort_within=["station", "day_utc"])
    load = daily.daily_load(read_table(spark, f"{root}/eia_load_hourly"))
    n["eia_daily_load"] = put(load, f"{root}/eia_daily_load", sort_within=["region", "day_utc"])
    hl = daily.heat_load_daily(read_table(spark, f"{root}/noaa_heatwave_flags"),
                               read_table(spark, f"{root}/eia_daily_load"))
    n["heat_load_daily"] = put(hl, f"{root}/heat_load_daily",
                                         sort_within=[F.col("region").asc_nulls_last(), "day_utc"])
    return n


def build_analysis(spark: SparkSession, root: str, database: str | None = None) -> dict[str, int]:
    """Entry C: the analysis results (all small: locations x categories,
    locations x days, locations x grid points)."""
    base = read_table(spark, f"{root}/base_combine")
    n: dict[str, int] = {}
    put = _writer(root, database)
    n["category_means"] = put(response.category_means(base), f"{root}/category_means")
    n["category_pivot"] = put(response.category_pivot(base), f"{root}/category_pivot")
    n["daily_means"] = put(response.daily_means(base), f"{root}/daily_means")
    n["quadratic_fit"] = put(response.quadratic_fit(base), f"{root}/quadratic_fit")
    fit = read_table(spark, f"{root}/quadratic_fit")
    n["fit_curve"] = put(response.fit_curve(fit), f"{root}/fit_curve")
    n["fit_annotation"] = put(response.fit_annotation(fit), f"{root}/fit_annotation")
    days = read_table(spark, f"{root}/daily_means")
    series = response.series_document(response.series_arrays(days))
    series.write.mode("overwrite").text(f"{root}/daily_load_json")
    n["summer_peaks"] = put(response.window_peaks(days), f"{root}/summer_peaks")
    return n


def build_facilities(spark: SparkSession, facility_raw: DataFrame, root: str, database: str | None = None) -> dict[str, int]:
    """Entry D: cleaned facilities, their JSON export, scores and dashboard data."""
    n: dict[str, int] = {}
    put = _writer(root, database)
    n["cleaned_va_datacenters"] = put(facilities.clean_facilities(facility_raw),
                                                f"{root}/cleaned_va_datacenters")
    clean = read_table(spark, f"{root}/cleaned_va_datacenters")
    clean = clean.drop("geometry")  # the exports and scores use lat and lon
    J.write_json_lines(clean, f"{root}/data_json")
    scored = facilities.exemption_scores(clean)
    n["exemption_scores"] = put(scored, f"{root}/exemption_scores")
    scored = read_table(spark, f"{root}/exemption_scores")
    n["score_breakdown"] = put(facilities.score_breakdown(scored), f"{root}/score_breakdown")
    n["facility_cards"] = put(dashboard.facility_card(clean), f"{root}/facility_cards")
    n["facility_markers"] = put(dashboard.facility_markers(clean), f"{root}/facility_markers")
    n["score_histogram"] = put(dashboard.score_histogram(dashboard.scored_web(clean)),
                                         f"{root}/score_histogram")
    return n


def build_all(spark: SparkSession, noaa_raw: DataFrame, eia_raw: DataFrame, facility_raw: DataFrame,
              root: str, database: str | None = None) -> dict[str, int]:
    """All steps in order; the row count of every written table (observed
    during its write) is returned and also stored as the ``row_audit`` table. With ``database`` every table
    is also a view there, which follows each replacement."""
    counts = build_hourly(spark, noaa_raw, eia_raw, root, database=database)
    counts.update(build_daily(spark, root, database))
    counts.update(build_analysis(spark, root, database))
    counts.update(build_facilities(spark, facility_raw, root, database))
    put = _writer(root, database)
    put(row_audit(spark, counts).coalesce(1), f"{root}/row_audit")  # one row per table
    return counts

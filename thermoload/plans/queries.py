"""Registered queries: one per operator group of the blueprint.

Each takes ``(spark, sf_dir)``, reads the driver tables through the adapters
and returns a lazy DataFrame whose column names match the DuckDB oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import daily, dashboard, facilities, hourly, positional, response
from ..session import scratch_path
from ..sources import fixtures, sinks
from ..sources import json_sources as J
from ..sources.weather_csv import detect_types, read_csv_union, write_csv
from .finish import rounded

Query = Callable[[SparkSession, str], DataFrame]

# --- shared lazy steps -------------------------------------------------------------

def weather(spark: SparkSession, sf: str) -> DataFrame:
    return hourly.decode_weather(fixtures.noaa_raw(spark, sf))


def weather_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return hourly.hourly_temperature(weather(spark, sf))


def load_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return hourly.hourly_load(hourly.load_rows(fixtures.eia_raw(spark, sf)))


def base_combine_df(spark: SparkSession, sf: str) -> DataFrame:
    return hourly.combine(spark, weather_hourly(spark, sf), load_hourly(spark, sf))


def weather_daily(spark: SparkSession, sf: str) -> DataFrame:
    return daily.daily_temperature(weather_hourly(spark, sf))


def flags_df(spark: SparkSession, sf: str) -> DataFrame:
    return daily.heatwave_flags(weather_daily(spark, sf))


def load_daily_df(spark: SparkSession, sf: str) -> DataFrame:
    return daily.daily_load(load_hourly(spark, sf))


def daily_means_df(spark: SparkSession, sf: str) -> DataFrame:
    return response.daily_means(base_combine_df(spark, sf))


def fit_df(spark: SparkSession, sf: str) -> DataFrame:
    return response.quadratic_fit(base_combine_df(spark, sf))


def fac_clean_df(spark: SparkSession, sf: str) -> DataFrame:
    return facilities.clean_facilities(fixtures.facility_raw(spark, sf), keep_geometry=False)


def scored_df(spark: SparkSession, sf: str) -> DataFrame:
    return facilities.exemption_scores(fac_clean_df(spark, sf))


# --- queries --------------------------------------------------------------------------

def q_temp_decode(spark, sf):
    return rounded(weather(spark, sf))


def q_hourly_temp(spark, sf):
    return rounded(weather_hourly(spark, sf))


def q_hourly_load(spark, sf):
    return rounded(load_hourly(spark, sf))


def q_base_combine(spark, sf):
    return rounded(base_combine_df(spark, sf))


def q_rows_per_location(spark, sf):
    return response.rows_per_location(base_combine_df(spark, sf))


def q_daily_temp(spark, sf):
    return rounded(weather_daily(spark, sf))


def q_hot_days(spark, sf):
    return rounded(daily.heatwave_runs(weather_daily(spark, sf)))


def q_heatwave_flags(spark, sf):
    return rounded(flags_df(spark, sf))


def q_heatwave_counts(spark, sf):
    return daily.heatwave_counts(flags_df(spark, sf))


def q_daily_load(spark, sf):
    return rounded(load_daily_df(spark, sf))


def q_heat_load_daily(spark, sf):
    return rounded(daily.heat_load_daily(flags_df(spark, sf), load_daily_df(spark, sf)))


def q_heat_load_daily_mapped(spark, sf):
    return rounded(daily.heat_load_daily(flags_df(spark, sf), load_daily_df(spark, sf), mode="mapped"))


def q_temp_category_mean(spark, sf):
    return rounded(response.category_means(base_combine_df(spark, sf)))


def q_temp_category_pivot(spark, sf):
    return rounded(response.category_pivot(base_combine_df(spark, sf)))


def q_daily_mean_load(spark, sf):
    return rounded(daily_means_df(spark, sf))


FIT_DIGITS = {"beta0": 4, "beta1": 4, "beta2": 4, "temp": 4, "load_pred": 4,
              "x_annot": 4, "y_annot": 4, "beta2_1dp": 1}


def q_quadratic_fit(spark, sf):
    return rounded(fit_df(spark, sf), per_column=FIT_DIGITS)


def q_fit_curve(spark, sf):
    return rounded(response.fit_curve(fit_df(spark, sf)), per_column=FIT_DIGITS)


def q_fit_annotation(spark, sf):
    return rounded(response.fit_annotation(fit_df(spark, sf)), per_column=FIT_DIGITS)


def q_series_export(spark, sf):
    rows = response.series_rows(response.series_arrays(daily_means_df(spark, sf)))
    return rounded(rows.withColumn("idx", F.col("idx").cast("bigint")))


def q_temp_fahrenheit(spark, sf):
    return rounded(response.fahrenheit(daily_means_df(spark, sf)))


def q_summer_peak(spark, sf):
    return rounded(response.window_peaks(daily_means_df(spark, sf)))


def q_window_peak_jan2024(spark, sf):
    return rounded(response.window_peaks(daily_means_df(spark, sf), K.JAN_TEST_WINDOWS))


NULLABLE_INTS = ["pop_within_mile", "construct_year"]


def q_facility_clean(spark, sf):
    # nullable integers leave as DOUBLE: pandas maps NULL-able INT columns
    # differently per engine, DOUBLE the same way everywhere
    d = facilities.clean_facilities(fixtures.facility_raw(spark, sf)).withColumn("geometry", F.hex("geometry"))
    return rounded(d.select([F.col(c).cast("double") if c in NULLABLE_INTS else F.col(c) for c in d.columns]))


def q_facility_points(spark, sf):
    from ..functions.wkb import with_point_xy
    raw = fixtures.facility_raw(spark, sf).select("facility_id", "geometry")
    return rounded(with_point_xy(raw).select("facility_id", "lon", "lat"))


def q_exemption_score(spark, sf):
    return rounded(scored_df(spark, sf).select(
        "facility_id", "ej_max_percentile", "ej_concern", "power_points", "ej_points", "pop_points",
        "water_points", "exemption_score", "exemption_tier"))


def q_exemption_reasons(spark, sf):
    return facilities.reasons_rows(scored_df(spark, sf))


def q_score_breakdown(spark, sf):
    return facilities.score_breakdown(scored_df(spark, sf))


def q_key_issues(spark, sf):
    return facilities.key_issues(scored_df(spark, sf))


def _sampled(spark, sf):
    """The keys of the five sampled facilities, and the scores of those facilities only: the id
    filter reaches the scan, so the lookup scores five rows."""
    scored = scored_df(spark, sf)
    keys = positional.select_positions(scored, ["exemption_score", "facility_id"],
                                       positional.quartile_positions).collect()  # at most five rows
    table = spark.createDataFrame([(k.sample_no, k.position, k.facility_id) for k in keys],
                                  "sample_no int, position bigint, facility_id bigint")
    return F.broadcast(table), scored.filter(F.col("facility_id").isin([k.facility_id for k in keys]))


def q_score_sample(spark, sf):
    keys, s = _sampled(spark, sf)
    return s.select("facility_id", facilities.facility_label(s).alias("label"), "county",
                    "exemption_score", "exemption_tier").join(keys, "facility_id")


def q_sample_breakdown(spark, sf):
    """W3 + F7: the per-category report of the five sampled facilities."""
    keys, s = _sampled(spark, sf)
    sample = s.select("facility_id", facilities.facility_label(s).alias("label"), "county",
                      "exemption_tier").join(keys, "facility_id")
    return facilities.sample_breakdown(sample, s)


def q_score_web(spark, sf):
    return dashboard.scored_web(fac_clean_df(spark, sf)).select("facility_id", "web_score", "web_tier", "web_colour")


def q_score_histogram(spark, sf):
    return dashboard.score_histogram(dashboard.scored_web(fac_clean_df(spark, sf)))


def q_facility_card(spark, sf):
    return dashboard.facility_card(fac_clean_df(spark, sf))


def q_facility_markers(spark, sf):
    return rounded(dashboard.facility_markers(fac_clean_df(spark, sf)))


def q_grid_breakdown(spark, sf):
    return rounded(dashboard.grid_breakdown(fac_clean_df(spark, sf)))


def q_grid_breakdown_reference(spark, sf):
    """A17 with the original's constant load, beside the load of the table it stands for."""
    total = fac_clean_df(spark, sf).agg(F.sum("est_load_50_mw").alias("table_mw"))
    return rounded(dashboard.grid_breakdown(spark=spark).join(F.broadcast(total)))


def q_quadratic_fit_degenerate(spark, sf):
    """F1 where T has one value (LAX), two values (BOS, NYC) or any (IAD): least-norm coefficients."""
    base = base_combine_df(spark, sf)
    temp = (F.when(F.col("location") == "LAX", F.lit(12.5))
            .when(F.col("location") == "BOS", F.when(F.col("temp") < 5, -4.0).otherwise(F.lit(11.0)))
            .when(F.col("location") == "NYC", F.when(F.hour("hour_utc") < 6, 0.0).otherwise(F.lit(21.5)))
            .otherwise(F.col("temp")))
    return rounded(response.quadratic_fit(base.withColumn("temp", temp)), per_column=FIT_DIGITS)


def q_window_peaks_table(spark, sf):
    """J6/A15 with the windows as a table: a window of 1 to 150 days around January 2024 for every order."""
    o = fixtures.read_table(spark, sf, "orders")
    start = F.date_add(F.lit("2023-11-01").cast("date"), (F.col("o_orderkey") % 97).cast("int"))
    end = F.date_add(start, (F.col("o_custkey") % 150).cast("int"))
    windows = o.select(F.col("o_orderkey").cast("int").alias("year"), start.cast("string").alias("x0"), end.cast("string").alias("x1"))
    return rounded(response.window_peaks(daily_means_df(spark, sf), windows))


def q_location_ranking(spark, sf):
    """O2 with the position of each row."""
    return response.location_ranking(base_combine_df(spark, sf))


def q_score_order(spark, sf):
    """O3: every facility's position in the order of score and id."""
    scores = scored_df(spark, sf).select("facility_id", "exemption_score")
    return positional.number_rows(scores, ["exemption_score", "facility_id"])


def q_marker_order(spark, sf):
    """Every facility's position with those of unknown capacity first."""
    fac = fac_clean_df(spark, sf).select("facility_id", F.col("capacity_mw").isNull().alias("unknown"))
    return positional.number_rows(fac, [F.desc("unknown"), "facility_id"])


def q_csv_types(spark, sf):
    """The types of all columns over landings with different headers."""
    ev = fixtures.read_table(spark, sf, "events")
    root = scratch_path(spark, "typed-csv")
    day = F.col("event_id") % 3
    half = ev.filter(day == 0).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("seen"), "value", "event_type",
                                      F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_id") % 2 == 0).alias("even"))
    write_csv(half, f"{root}/a")
    write_csv(ev.filter(day == 1).select(F.col("value").cast("long").alias("VALUE"), "props", "event_id",
                                         F.date_format("ts", "yyyy-MM-dd").alias("seen"), F.date_format("ts", "HH:mm:ss").alias("clock"),
                                         F.lpad(F.col("user_id").cast("string"), 4, "0").alias("code")), f"{root}/b")
    write_csv(ev.filter(day == 2).select("event_id", F.lit("").alias("nothing"), F.col("event_id").alias("mixed"),
                                         F.when(F.col("event_id") % 5 > 0, F.col("user_id")).alias("some")), f"{root}/c")
    write_csv(ev.filter(day == 2).select("event_id", F.col("event_type").alias("mixed")), f"{root}/d")
    return detect_types(read_csv_union(spark, f"{root}/*")).withColumn("column_name", F.lower("column_name"))


def q_landing_guards(spark, sf):
    """What the guards find in the landed load pages."""
    root = scratch_path(spark, "guarded-pages")
    J.write_load_pages(fixtures.eia_raw(spark, sf), root)
    return J.landing_guards(spark, root, [*J.LOAD_REQUIRED, "subba-name"])


def q_locations(spark, sf):
    """The distinct locations."""
    return response.locations(base_combine_df(spark, sf))


def q_series_document(spark, sf):
    """One JSON document keyed by location, written and read back."""
    root = scratch_path(spark, "series")
    doc = response.series_document(response.series_arrays(daily_means_df(spark, sf)))
    doc.write.mode("overwrite").text(root)
    rows = response.series_rows(response.read_series_document(spark.read.text(root)))
    return rounded(rows.withColumn("idx", F.col("idx").cast("bigint")))


def q_summer_peak_shifted(spark, sf):
    """J6/A15 on the original summer windows, with the days moved half a year on into them."""
    days = daily_means_df(spark, sf).withColumn("date", F.date_add("date", 182))
    return rounded(response.window_peaks(days))


def q_hourly_load_selected(spark, sf):
    """A2 after the load selection: pages also hold other sub-areas and hours out of the period."""
    raw = fixtures.eia_raw_wide(spark, sf)
    return rounded(hourly.hourly_load(hourly.load_rows(hourly.select_load(raw))))


def q_table_replace(spark, sf):
    """A partitioned, sorted table written, replaced and read back."""
    path = f"{scratch_path(spark, 'replace')}/hourly"
    temps = weather_hourly(spark, sf).withColumn("month", F.month("hour_utc"))
    sinks.replace_table(temps.filter("station = 'IAD'"), path, ["month"], ["station", "hour_utc"])
    sinks.replace_table(temps, path, ["month"], ["station", "hour_utc"])
    return rounded(sinks.read_table(spark, path).select("station", "hour_utc", "temp_C", F.col("month").cast("int").alias("month")))


def q_table_order(spark, sf):
    """O1: the partitioned table's rows in file order: how many stand after a larger key (none)."""
    path = f"{scratch_path(spark, 'order')}/hourly"
    temps = weather_hourly(spark, sf).withColumn("month", F.month("hour_utc"))
    sinks.replace_table(temps, path, ["month"], ["station", "hour_utc"])
    place = F.struct(F.col("station"), F.col("hour_utc"))
    rows = sinks.read_table(spark, path).select("month", place.alias("key"), F.input_file_name().alias("file"),
                                                F.monotonically_increasing_id().alias("at"))
    before = F.lag("key").over(Window.partitionBy("file").orderBy("at"))
    late = rows.select("month", (before > F.col("key")).alias("late"))
    return late.groupBy(F.col("month").cast("int").alias("month")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("out_of_order"))


def q_table_staged(spark, sf):
    """A version that was written but not published changes nothing for readers."""
    path = f"{scratch_path(spark, 'staged')}/hourly"
    temps = weather_hourly(spark, sf)
    sinks.replace_table(temps.filter("station = 'IAD'"), path)
    sinks.stage_table(temps.filter("station <> 'IAD'"), path)
    return rounded(sinks.read_table(spark, path).select("station", "hour_utc", "temp_C"))


def q_table_catalog(spark, sf):
    """Written tables registered as relations, listed, and counted by SQL."""
    root = scratch_path(spark, "catalog")
    names = ["noaa_daily_temp", "eia_daily_load"]
    for n, df in zip(names, (weather_daily(spark, sf), load_daily_df(spark, sf))):
        sinks.replace_table(df, f"{root}/{n}")
    sinks.register_tables(spark, root, names)
    listed = [n for n in sinks.list_tables(spark) if n in names]
    return spark.sql(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows FROM {n}" for n in listed))


# --- sources and sinks: files written to a fresh folder, read back --------------------------

def q_csv_union(spark, sf):
    """Landings with different header sets, a lower-case header, a nested folder, and
    fields with doubled quotes and line feeds, unioned by name."""
    raw = fixtures.noaa_raw(spark, sf)
    ids = list(K.STATION_IDS.values())
    st = F.col("STATION")
    root = scratch_path(spark, "weather-csv")
    note = F.concat(F.lit('say "x, y"\nend '), F.col("TMP")).alias("REMARKS")
    write_csv(raw.filter(st.isin(ids[0])).select("STATION", note, "DATE", "TMP"), f"{root}/a")
    write_csv(raw.filter(st.isin(ids[1])).select(F.col("STATION").alias("station"), F.col("DATE").alias("date"),
                                                 F.col("TMP").alias("tmp")), f"{root}/a2/nested")
    write_csv(raw.filter(st.isin(ids[2], ids[3])).select("DATE", "TMP", F.lit("4").alias("SOURCE"), "STATION"),
              f"{root}/b")
    write_csv(raw.filter(~st.isin(ids)).select("STATION", "DATE"), f"{root}/c")
    landed = read_csv_union(spark, f"{root}/*", columns=["STATION", "DATE", "TMP"])
    return rounded(hourly.decode_weather(landed))


def q_json_pages(spark, sf):
    """Load rows landed as API pages of <= 5000 rows, read back."""
    root = scratch_path(spark, "load-pages")
    J.write_load_pages(fixtures.eia_raw(spark, sf), root)
    return rounded(hourly.load_rows(J.read_load_pages(spark, root)))


def q_json_lines_roundtrip(spark, sf):
    """S6/S13 -> S5: cleaned facilities as sorted-key JSON lines, read back."""
    root = scratch_path(spark, "facility-json")
    J.write_json_lines(fac_clean_df(spark, sf), root)
    d = J.read_facility_json(spark, root)
    return rounded(d.select([F.col(c).cast("double") if c in NULLABLE_INTS else F.col(c) for c in d.columns]))


def q_json_key_order(spark, sf):
    """The keys of every exported line, in the order in which they are written."""
    root = scratch_path(spark, "facility-keys")
    J.write_json_lines(fac_clean_df(spark, sf), root)
    return spark.read.text(root).select(F.get_json_object("value", "$.facility_id").cast("bigint").alias("facility_id"),
                                        F.array_join(F.json_object_keys("value"), ",").alias("keys"))


def q_key_normalise(spark, sf):
    """Records with mixed-case, empty and colliding keys, normalised."""
    fac = fixtures.facility_short(spark, sf)
    keys = ["Facility_ID", "Company", "BRAND", "County", "county", "", "Water Stress"]
    vals = [F.col("facility_id").cast("string"), "company", "brand", "county", F.upper("county"), "zip",
            "water_stress"]
    text = F.to_json(F.map_from_arrays(F.array(*[F.lit(k) for k in keys]),
                                       F.array(*[F.col(v) if isinstance(v, str) else v for v in vals])),
                     {"ignoreNullFields": "false"})
    root = scratch_path(spark, "records")
    fac.select(text.alias("value")).write.mode("overwrite").text(root)
    m = J.normalise_records(spark.read.text(root)).select("record")
    return m.select(F.col("record")["facility_id"].cast("bigint").alias("facility_id"),
                    F.explode("record").alias("key", "value"))


def _features(spark, sf, id_expr: str, name_expr: str) -> DataFrame:
    fac = fixtures.facility_short(spark, sf)
    root = scratch_path(spark, "geojson")
    J.write_feature_collections(fac.select(F.expr(id_expr).alias("id"), F.expr(name_expr).alias("name")), root)
    return J.read_features(spark, root)


COUNTY_ID = ("CASE WHEN facility_id % 10 = 0 THEN NULL WHEN facility_id % 10 = 1 THEN '' ELSE "
             "concat(CASE WHEN facility_id % 3 = 0 THEN '24' ELSE '51' END, "
             "lpad(CAST(facility_id % 1000 AS STRING), 3, '0')) END")
COUNTY_NAME = "concat(county, ' County')"
STATE_ID = "concat('S', CAST(facility_id AS STRING))"
STATE_NAME = ("CASE facility_id % 4 WHEN 0 THEN 'Virginia' WHEN 1 THEN 'District of Columbia' "
              "WHEN 2 THEN 'Maryland' ELSE NULL END")


def q_geo_flags(spark, sf):
    """County features of one state with the focus-county flag."""
    return J.county_layer(_features(spark, sf, COUNTY_ID, COUNTY_NAME))


def q_state_flags(spark, sf):
    """State features with the focus-state flag."""
    return J.state_layer(_features(spark, sf, STATE_ID, STATE_NAME))


def q_row_audit(spark, sf):
    """Row counts of the nine built tables. The sources are read once, for the two hourly
    tables, and their rows counted on the way; the daily tables are counted from the hourly ones."""
    root = scratch_path(spark, "audit")
    seen = {n: Observation(n) for n in ("noaa_hourly_raw", "noaa_hourly_temp", "eia_hourly_raw")}
    counted = lambda df, n: df.observe(seen[n], F.count(F.lit(1)).alias("rows"))
    temps = counted(hourly.decode_weather(counted(fixtures.noaa_raw(spark, sf), "noaa_hourly_raw")), "noaa_hourly_temp")
    load = counted(hourly.load_rows(fixtures.eia_raw(spark, sf)), "eia_hourly_raw")
    counts = {"noaa_hourly_avg": sinks.replace_table(hourly.hourly_temperature(temps), f"{root}/temps"),
              "eia_load_hourly": sinks.replace_table(hourly.hourly_load(load), f"{root}/load")}
    counts.update({n: int(o.get["rows"]) for n, o in seen.items()})
    days = daily.daily_temperature(sinks.read_table(spark, f"{root}/temps"))
    flags, load_days = daily.heatwave_flags(days), daily.daily_load(sinks.read_table(spark, f"{root}/load"))
    return sinks.row_audit(spark, counts, {"noaa_daily_temp": days, "noaa_heatwave_flags": flags, "eia_daily_load": load_days,
                                           "heat_load_daily": daily.heat_load_daily(flags, load_days)})


def q_hourly_temp_stream(spark, sf):
    """Streaming: landed weather files ingested incrementally (two landings with
    different headers, two micro-batches) into the hourly table."""
    from ..streaming.landed_weather import hourly_table, start_hourly_ingest
    raw = fixtures.noaa_raw(spark, sf)
    root = scratch_path(spark, "stream")
    half = F.coalesce(F.col("DATE") < F.lit("2024-01-16"), F.lit(False))
    write_csv(raw.filter(half), f"{root}/landing/part1")
    q = start_hourly_ingest(spark, f"{root}/landing/*", f"{root}/hourly", f"{root}/ckpt")
    q.awaitTermination()
    # the second landing carries another header (reordered, one extra column)
    write_csv(raw.filter(~half).select("DATE", "TMP", F.lit("4").alias("SOURCE"), "STATION"),
              f"{root}/landing/part2")
    q = start_hourly_ingest(spark, f"{root}/landing/*", f"{root}/hourly", f"{root}/ckpt")
    q.awaitTermination()
    return rounded(hourly_table(spark, f"{root}/hourly"))


QUERIES: dict[str, Query] = {
    "temp_decode": q_temp_decode,
    "hourly_temp": q_hourly_temp,
    "hourly_load": q_hourly_load,
    "base_combine": q_base_combine,
    "rows_per_location": q_rows_per_location,
    "daily_temp": q_daily_temp,
    "hot_days": q_hot_days,
    "heatwave_flags": q_heatwave_flags,
    "heatwave_counts": q_heatwave_counts,
    "daily_load": q_daily_load,
    "heat_load_daily": q_heat_load_daily,
    "heat_load_daily_mapped": q_heat_load_daily_mapped,
    "temp_category_mean": q_temp_category_mean,
    "temp_category_pivot": q_temp_category_pivot,
    "daily_mean_load": q_daily_mean_load,
    "quadratic_fit": q_quadratic_fit,
    "fit_curve": q_fit_curve,
    "fit_annotation": q_fit_annotation,
    "series_export": q_series_export,
    "temp_fahrenheit": q_temp_fahrenheit,
    "summer_peak": q_summer_peak,
    "window_peak_jan2024": q_window_peak_jan2024,
    "facility_clean": q_facility_clean,
    "facility_points": q_facility_points,
    "exemption_score": q_exemption_score,
    "exemption_reasons": q_exemption_reasons,
    "score_breakdown": q_score_breakdown,
    "key_issues": q_key_issues,
    "score_sample": q_score_sample,
    "sample_breakdown": q_sample_breakdown,
    "score_web": q_score_web,
    "score_histogram": q_score_histogram,
    "facility_card": q_facility_card,
    "facility_markers": q_facility_markers,
    "grid_breakdown": q_grid_breakdown,
    "grid_breakdown_reference": q_grid_breakdown_reference,
    "locations": q_locations,
    "quadratic_fit_degenerate": q_quadratic_fit_degenerate,
    "window_peaks_table": q_window_peaks_table,
    "location_ranking": q_location_ranking,
    "score_order": q_score_order,
    "marker_order": q_marker_order,
    "csv_types": q_csv_types,
    "landing_guards": q_landing_guards,
    "series_document": q_series_document,
    "summer_peak_shifted": q_summer_peak_shifted,
    "hourly_load_selected": q_hourly_load_selected,
    "table_replace": q_table_replace,
    "table_order": q_table_order,
    "table_staged": q_table_staged,
    "table_catalog": q_table_catalog,
    "csv_union": q_csv_union,
    "json_pages": q_json_pages,
    "json_lines_roundtrip": q_json_lines_roundtrip,
    "json_key_order": q_json_key_order,
    "key_normalise": q_key_normalise,
    "geo_flags": q_geo_flags,
    "state_flags": q_state_flags,
    "row_audit": q_row_audit,
    "hourly_temp_stream": q_hourly_temp_stream,
}

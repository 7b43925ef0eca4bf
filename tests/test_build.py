"""End-to-end table build on the smallest tables (counts of SURVEY §5)."""

from thermoload.plans.build import build_all
from thermoload.sources import fixtures
from thermoload.sources.sinks import list_tables, read_table, register_tables

SF = "/root/testdata/sf0.001"


def test_build_all(spark, tmp_dir):
    counts = build_all(spark, fixtures.noaa_raw(spark, SF), fixtures.eia_raw(spark, SF),
                       fixtures.facility_raw(spark, SF), tmp_dir)
    assert counts["noaa_hourly_temp"] == 1000
    assert counts["noaa_hourly_avg"] == 868
    assert counts["noaa_hourly_raw"] == 1000
    assert counts["eia_load_hourly"] == 799  # the configured sub-areas only: MISO hours are left out
    assert counts["base_combine"] == 306
    assert counts["cleaned_va_datacenters"] == 144
    assert counts["noaa_heatwave_flags"] == counts["noaa_daily_temp"] == counts["heat_load_daily"]
    register_tables(spark, tmp_dir, ["base_combine", "heat_load_daily"])
    assert {"base_combine", "heat_load_daily"} <= set(list_tables(spark))
    hw = spark.sql("SELECT sum(is_heatwave_day) FROM heat_load_daily").first()[0]
    assert hw == 38  # days inside runs of >= 3 hot days at sf0.001 (SURVEY §5)
    assert spark.read.text(f"{tmp_dir}/daily_load_json").count() == 1  # one document keyed by location
    audit = {r.table_name: r.rows for r in read_table(spark, f"{tmp_dir}/row_audit").collect()}
    assert audit == counts


def test_command_line_build_from_landed_files(spark, tmp_dir):
    from thermoload.plans.run import main
    from thermoload.sources.json_sources import write_load_pages
    from thermoload.sources.weather_csv import write_csv
    write_csv(fixtures.noaa_raw(spark, SF), f"{tmp_dir}/landing/noaa")
    write_load_pages(fixtures.eia_raw(spark, SF), f"{tmp_dir}/landing/eia")
    fixtures.facility_raw(spark, SF).write.parquet(f"{tmp_dir}/landing/dc.parquet")
    counts = main(["--weather", f"{tmp_dir}/landing/noaa/*.csv", "--load-pages", f"{tmp_dir}/landing/eia",
                   "--facilities", f"{tmp_dir}/landing/dc.parquet", "--out", f"{tmp_dir}/out"], spark=spark)
    assert counts["base_combine"] == 306 and counts["cleaned_va_datacenters"] == 144
    assert counts["noaa_hourly_temp"] == 1000


def test_old_scratch_folders_are_deleted(spark, tmp_dir):
    import os
    import time
    from thermoload.session import clean_scratch, scratch_path, shared_dir
    old, new = scratch_path(spark, "old"), scratch_path(spark, "new")
    for path in (old, new):
        spark.range(3).write.parquet(path)
    local = old.replace("file:", "", 1) if old.startswith("file:") else old
    os.utime(local, (time.time() - 7200,) * 2)
    assert clean_scratch(spark, older_than_hours=1.0) == [old.rsplit("/", 1)[1]]
    assert spark.read.parquet(new).count() == 3 and clean_scratch(spark) == [] and shared_dir(spark)


def test_views_follow_the_tables(spark, tmp_dir):
    from thermoload.plans.build import build_daily, build_hourly
    spark.sql("CREATE DATABASE IF NOT EXISTS heat_views")
    try:
        for keep in ("event_id < 500", "true"):  # built twice: the views see the second build
            noaa = fixtures.noaa_raw(spark, SF).limit(10 ** 9)
            counts = build_hourly(spark, noaa if keep == "true" else noaa.filter("STATION = '72403093738'"),
                                  fixtures.eia_raw(spark, SF), tmp_dir, database="heat_views")
            counts.update(build_daily(spark, tmp_dir, "heat_views"))
            for name, n in counts.items():
                assert spark.table(f"heat_views.{name}").count() == n
        assert counts["base_combine"] == 306
    finally:
        spark.sql("DROP DATABASE heat_views CASCADE")

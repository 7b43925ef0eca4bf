"""Streaming ingest: only new files are read, landings with different headers
align by name, and the partials merge to the batch result."""

import pytest

from thermoload.operators.hourly import decode_weather, hourly_temperature
from thermoload.sources import fixtures
from thermoload.sources.weather_csv import write_csv
from thermoload.streaming.landed_weather import compact_partials, hourly_table, start_hourly_ingest

SF = "/root/testdata/sf0.001"


def test_incremental_ingest_matches_batch(spark, tmp_dir):
    raw = fixtures.noaa_raw(spark, SF)
    first = raw.filter("DATE < '2024-01-10'")
    write_csv(first, f"{tmp_dir}/landing/a")
    q = start_hourly_ingest(spark, f"{tmp_dir}/landing/*", f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    q.awaitTermination()
    assert hourly_table(spark, f"{tmp_dir}/out").count() == hourly_temperature(decode_weather(first)).count()
    # the second landing has another header: columns reordered plus an extra one
    later = raw.filter("DATE >= '2024-01-10'").selectExpr("DATE", "TMP", "'4' AS SOURCE", "STATION")
    write_csv(later, f"{tmp_dir}/landing/b")
    q = start_hourly_ingest(spark, f"{tmp_dir}/landing/*", f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    q.awaitTermination()
    got = {(r.station, r.hour_utc): r.temp_C for r in hourly_table(spark, f"{tmp_dir}/out").collect()}
    want = {(r.station, r.hour_utc): r.temp_C for r in hourly_temperature(decode_weather(raw)).collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None and want[k] is None) or abs(got[k] - want[k]) < 1e-9 for k in want)
    batches = spark.read.parquet(f"{tmp_dir}/out/partials").select("batch").distinct().count()
    assert batches == 2  # the second run read only the newly landed files


def test_second_checkpoint_is_refused(spark, tmp_dir):
    write_csv(fixtures.noaa_raw(spark, SF).filter("DATE < '2024-01-03'"), f"{tmp_dir}/landing/a")
    for _ in range(2):  # the same checkpoint may go on
        start_hourly_ingest(spark, f"{tmp_dir}/landing/*", f"{tmp_dir}/out", f"{tmp_dir}/ckpt").awaitTermination()
    with pytest.raises(ValueError, match="another checkpoint"):
        start_hourly_ingest(spark, f"{tmp_dir}/landing/*", f"{tmp_dir}/out", f"{tmp_dir}/ckpt2")


def test_compaction_counts_every_batch_once(spark, tmp_dir, monkeypatch):
    from thermoload.streaming import landed_weather
    raw = fixtures.noaa_raw(spark, SF)
    days = ["2024-01-01", "2024-01-06", "2024-01-11", "2024-01-16", "2024-02-30"]
    want = {(r.station, r.hour_utc): r.temp_C for r in hourly_temperature(decode_weather(raw)).collect()}

    def rows():
        return {(r.station, r.hour_utc): r.temp_C for r in hourly_table(spark, f"{tmp_dir}/out").collect()}

    def land(k):
        write_csv(raw.filter(f"DATE >= '{days[k]}' AND DATE < '{days[k + 1]}'"), f"{tmp_dir}/landing/{k}")
        start_hourly_ingest(spark, f"{tmp_dir}/landing/*", f"{tmp_dir}/out", f"{tmp_dir}/ckpt").awaitTermination()
    land(0)
    assert compact_partials(spark, f"{tmp_dir}/out") is None  # the newest batch stays
    land(1)
    land(2)
    before = rows()
    with monkeypatch.context() as m:  # stops after the swap, before the merged batches are deleted
        m.setattr(landed_weather, "delete", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            compact_partials(spark, f"{tmp_dir}/out")
    assert rows() == before
    assert compact_partials(spark, f"{tmp_dir}/out") == 1 and rows() == before
    land(3)
    assert compact_partials(spark, f"{tmp_dir}/out") == 2
    got = rows()
    assert got.keys() == want.keys() and all((got[k] is None and want[k] is None) or abs(got[k] - want[k]) < 1e-9 for k in want)
    assert spark.read.parquet(f"{tmp_dir}/out/partials").select("batch").distinct().count() < 4

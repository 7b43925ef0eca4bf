"""Edge rows for the operators and quirks."""

import datetime as dt
import json
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from thermoload import constants as K
from thermoload.operators import daily, dashboard, facilities, hourly, positional, response
from thermoload.sources import json_sources as J
from thermoload.sources.sinks import read_table, replace_table
from thermoload.sources.weather_csv import detect_types, read_csv_union


def test_load_clean_keeps_null(spark):
    t = spark.createDataFrame([("IAD", dt.datetime(2024, 1, 1, h), 10.0) for h in range(5)],
                              "station string, hour_utc timestamp_ntz, temp_C double")
    load = spark.createDataFrame([("PJM", dt.datetime(2024, 1, 1, h), v) for h, v in
                                  enumerate([500000.0, 500000.01, 0.0, None, -3.0])],
                                 "region string, hour_utc timestamp_ntz, load_mwh double")
    out = hourly.combine(spark, t, load).orderBy("hour_utc").collect()
    assert [r.load_mwh for r in out] == [500000.0, None]


def _daily(spark, rows):
    return spark.createDataFrame([(s, dt.datetime(2024, 1, d) if d < 32 else dt.datetime(2024, 2, d - 31), m, m)
                                  for s, d, m in rows],
                                 "station string, day_utc timestamp_ntz, daily_max_temp_C double, avg_temp_C double")


def test_heatwave_runs(spark):
    rows = [("A", 1, 33.0), ("A", 2, 33.0), ("A", 3, 20.0),            # 2-day run: no
            ("A", 5, 32.22), ("A", 6, 40.0), ("A", 7, 35.0),           # 3-day run incl. 32.22: yes
            ("A", 9, 33.0), ("A", 10, None), ("A", 11, 33.0),          # NULL max splits
            ("B", 30, 33.0), ("B", 31, 33.0), ("B", 32, 33.0)]         # run across month end
    f = {(r.station, r.day_utc.day, r.day_utc.month): (r.is_hot_day, r.is_heatwave_day)
         for r in daily.heatwave_flags(_daily(spark, rows)).collect()}
    assert f[("A", 1, 1)] == (1, 0) and f[("A", 5, 1)] == (1, 1) and f[("A", 7, 1)] == (1, 1)
    assert f[("A", 10, 1)] == (0, 0) and f[("A", 9, 1)] == (1, 0)
    assert f[("B", 30, 1)] == (1, 1) and f[("B", 1, 2)] == (1, 1)
    runs = daily.heatwave_runs(_daily(spark, rows)).orderBy("station").collect()
    assert [(r.station, r.run_days) for r in runs] == [("A", 3), ("B", 3)]


def test_heat_load_join_quirk(spark):
    flags = daily.heatwave_flags(_daily(spark, [(s, 1, 30.0) for s in ["IAD", "BOS", "NYC", "LAX", "X"]]))
    load = spark.createDataFrame([(r, dt.datetime(2024, 1, 1), v, v) for r, v in
                                  [("PJM", 1.0), ("ISNE", 2.0), ("NYIS", 3.0), ("CISO", 4.0)]],
                                 "region string, day_utc timestamp_ntz, daily_total_mwh double, daily_peak_mwh double")
    ref = {r.station: (r.region, r.daily_total_mwh) for r in daily.heat_load_daily(flags, load).collect()}
    assert ref == {"IAD": ("PJM", 1.0), "BOS": ("ISNE", 2.0), "NYC": (None, 2.0), "LAX": (None, 2.0),
                   "X": (None, 2.0)}
    mapped = {r.station: (r.region, r.daily_total_mwh)
              for r in daily.heat_load_daily(flags, load, mode="mapped").collect()}
    assert mapped["NYC"] == ("NYIS", 3.0) and mapped["X"] == (None, None)


def test_temperature_category(spark):
    df = spark.createDataFrame([(v,) for v in [None, float("nan"), 0.0, 32.0, -0.1, 32.1]], "temp double")
    got = [r[0] for r in df.select(response.temperature_category()).collect()]
    assert got == [K.CAT_NORMAL] * 4 + [K.CAT_COLD, K.CAT_HOT]


def test_quadratic_fit_recovers_coefficients(spark):
    rows = [("A", float(t), 100.0 + 2.0 * t + 0.5 * t * t) for t in range(-10, 30)] + [("A", 5.0, None)]
    base = spark.createDataFrame(rows, "location string, temp double, load_mwh double")
    r = response.quadratic_fit(base).first()
    assert r.n_obs == 40
    assert abs(r.beta0 - 100) < 1e-8 and abs(r.beta1 - 2) < 1e-9 and abs(r.beta2 - 0.5) < 1e-10
    none = base.withColumn("load_mwh", F.lit(None).cast("double"))
    assert response.quadratic_fit(none).first().beta2 is None


def test_quadratic_fit_of_few_temperatures_is_the_pseudo_inverse(spark):
    sets = {"one": [(12.5, 3.0), (12.5, 5.0)], "zero": [(0.0, 7.0)], "two": [(1.0, 1.0), (2.0, 2.0), (1.0, 1.5)],
            "wide": [(-4.0, 9000.0), (11.0, 12000.5), (11.0, 11000.25), (-4.0, 9100.0), (-4.0, 8950.0)],
            "mirrored": [(-7.0, 5.0), (7.0, 3.0)], "with_zero": [(0.0, 800.0), (31.25, 950.0)]}
    rows = [(k, t, y) for k, v in sets.items() for t, y in v]
    got = {r.location: r for r in response.quadratic_fit(spark.createDataFrame(
        rows, "location string, temp double, load_mwh double")).collect()}
    for k, v in sets.items():
        x = np.array([[1, t, t * t] for t, _ in v])
        want = np.linalg.pinv(x) @ np.array([y for _, y in v])
        assert np.allclose([got[k].beta0, got[k].beta1, got[k].beta2], want, rtol=1e-9, atol=1e-9), k


def _fac(spark, rows):
    cols = ["facility_id", "capacity_mw", "pop_within_mile", "water_stress_index"] + K.EJ_COLUMNS
    data = [(i, cap, pop, ws, *([ej] + [None] * 12)) for i, cap, pop, ws, ej in rows]
    schema = ("facility_id long, capacity_mw double, pop_within_mile int, water_stress_index string, "
              + ", ".join(f"{c} double" for c in K.EJ_COLUMNS))
    return spark.createDataFrame(data, schema).select(cols)


def test_scores(spark):
    rows = [(1, 20.0, 999, "Low (<10%)", 79.9), (2, 75.0, 1000, "Medium - High (20-40%)", 80.0),
            (3, 200.0, 5000, "High (40-80%)", None), (4, 200.5, 10000, "Low (new label)", None),
            (5, None, None, None, None)]
    s = {r.facility_id: r for r in facilities.exemption_scores(_fac(spark, rows)).collect()}
    assert [s[i].exemption_score for i in range(1, 6)] == [75, 34, 32, 20, 20]
    assert s[1].exemption_tier == "Partial Exemption (50%)" and s[2].exemption_tier == "No Exemption (0%)"
    assert s[4].failing_criteria[:2] == ["High capacity (200 MW)", "Very high population exposure: 10000 residents"]
    assert s[5].failing_criteria[:2] == ["No capacity data", "No population data"]
    assert s[2].failing_criteria[0] == "Environmental justice concerns (max percentile: 80)"
    assert len(s[1].failing_criteria) == 4  # only the four no-data lines
    web = {r.facility_id: r.web_score for r in dashboard.scored_web(_fac(spark, rows)).collect()}
    assert web[4] == 20 + 12  # web rule: any label starting with 'Low' scores
    bd = facilities.score_breakdown(facilities.exemption_scores(_fac(spark, rows))).filter("facility_id = 4")
    det = {r.category: r.detail for r in bd.collect()}
    assert det["Power"] == "200 MW (>200)" and det["Population"] == "10,000 residents (≥10k)"
    issues = facilities.key_issues(facilities.exemption_scores(_fac(spark, rows))).filter("facility_id = 1")
    assert issues.count() == 0


def test_positional_sample(spark):
    for n, expect in [(1, [0, 0, 0, 0, 0]), (4, [0, 1, 2, 3, 3]), (5, [0, 1, 2, 3, 4])]:
        df = spark.createDataFrame([(i, 7) for i in range(n)], "facility_id long, exemption_score int")
        got = positional.select_positions(df, ["exemption_score", "facility_id"], positional.quartile_positions).orderBy("sample_no").collect()
        assert [r.position for r in got] == expect
        assert [r.facility_id for r in got] == expect  # equal scores: tie-break by id
    assert positional.select_positions(df.limit(0), ["facility_id"], positional.quartile_positions).count() == 0


def test_positional_sample_large_equal_group(spark):
    n = 10001
    df = spark.range(n).select(F.col("id").alias("facility_id"), F.lit(1).alias("exemption_score"))
    got = positional.select_positions(df, ["exemption_score", "facility_id"], positional.quartile_positions).orderBy("sample_no").collect()
    assert [r.facility_id for r in got] == [0, n // 4, n // 2, 3 * n // 4, n - 1]


@pytest.mark.parametrize("few", [1, 40])
def test_positions_by_counts(spark, monkeypatch, few):
    """Small bins and limits: every key is cut several times, with missing, equal and very wide values."""
    monkeypatch.setattr(positional, "BINS", 4)
    monkeypatch.setattr(positional, "FEW", few)
    rnd = random.Random(few)
    rows = [(rnd.choice([None, 1, 1, 1, 5, -3]), rnd.choice([None, rnd.randrange(50), 2 ** 63 - 1, -2 ** 63])) for _ in range(600)]
    rows += [(1, 7)] * 300  # equal in all keys
    df = spark.createDataFrame(rows, "a int, b long").repartition(3)
    order = sorted(rows, key=lambda r: [(x is not None, x or 0) for x in r])
    places = [0, 3, 150, 299, 450, 600, 899]
    got = positional.select_positions(df, ["a", "b"], lambda n: places).orderBy("sample_no").collect()
    assert [(r.a, r.b) for r in got] == [order[p] for p in places] and [r.position for r in got] == places


def test_positions_of_computed_keys(spark, monkeypatch):
    """Keys that are wide expressions (the rubric): many passes, the same rows, nothing left behind."""
    from thermoload.plans import queries as Q
    from thermoload.session import shared_dir
    before = {tuple(r) for r in Q.q_score_sample(spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.setattr(positional, "BINS", 8)
    monkeypatch.setattr(positional, "FEW", 5)
    assert {tuple(r) for r in Q.q_score_sample(spark, "/root/testdata/sf0.001").collect()} == before and len(before) == 5
    assert not [x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x.startswith("work-positions")]


def test_every_row_is_numbered(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 1.5, 1.5, 2.0]), "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, v double, position string").repartition(5)
    got = positional.number_rows(df.drop("position"), [F.col("v").isNotNull(), F.desc("id")], num_partitions=6).collect()
    want = sorted((r[:2] for r in rows), key=lambda r: (r[1] is not None, -r[0]))
    assert [(r.id, r.v) for r in sorted(got, key=lambda r: r.position)] == want and [*range(2000)] == sorted(r.position for r in got)


def test_csv_union_by_name(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/a.csv", "w") as f:
        f.write("STATION,DATE,TMP\n72403093738,2024-01-01T00:10:00,\"+0100,1\"\n")
    with open(f"{tmp_dir}/in/b.csv", "w") as f:
        f.write("\"DATE\",\"TMP\",\"STATION\",\"X\"\n2024-01-01T00:20:00,\"+0200,1\",72509014739,q\n")
    with open(f"{tmp_dir}/in/c.csv", "w") as f:
        f.write("DATE,STATION\n2024-01-01T00:30:00,1\n")
    df = read_csv_union(spark, f"{tmp_dir}/in/*.csv", columns=["STATION", "DATE", "TMP"])
    got = sorted(tuple(r) for r in hourly.decode_weather(df).collect())
    assert [(g[0], g[2]) for g in got] == [("1", None), ("BOS", 20.0), ("IAD", 10.0)]
    types = {r.column_name: r.column_type for r in detect_types(read_csv_union(spark, f"{tmp_dir}/in/*.csv")).collect()}
    assert types == {"STATION": "BIGINT", "DATE": "TIMESTAMP", "TMP": "VARCHAR", "X": "VARCHAR"}


def test_json_pages(spark, tmp_dir):
    pages = [{"response": {"data": [{"period": "2024-01-01T00", "parent": "PJM", "subba": "DOM", "value": 5}]}},
             {"response": {"data": [{"period": "2024-01-01T00", "parent": "PJM", "subba": "DOM", "value": "7.5"}]}},
             {"response": {"data": []}}, {"response": {}}, {}]
    for i, p in enumerate(pages):
        with open(f"{tmp_dir}/p{i}.json", "w") as f:
            json.dump(p, f, indent=2)
    rows = J.read_load_pages(spark, tmp_dir, multi_line=True)
    out = hourly.hourly_load(hourly.load_rows(rows)).collect()
    assert [(r.region, r.load_mwh) for r in out] == [("PJM", 12.5)]


def test_key_normalise(spark):
    df = spark.createDataFrame([('{"B": 1, "a": "x", "": null, "b": -2}',)], "value string")
    for policy in ["LAST_WIN", "EXCEPTION"]:  # native de-duplication and the explicit fallback
        spark.conf.set("spark.sql.mapKeyDedupPolicy", policy)
        try:
            got = J.normalise_records(df).select(F.to_json("record", {"ignoreNullFields": "false"})).first()[0]
        finally:
            spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        assert json.loads(got) == {"a": "x", "b": "-2", "unknown": None}
        assert list(json.loads(got)) == ["a", "b", "unknown"]


def test_json_lines_keep_nulls_and_sorted_keys(spark, tmp_dir):
    df = spark.createDataFrame([(1, None, "x")], "z long, a string, m string")
    J.write_json_lines(df, f"{tmp_dir}/j")
    line = spark.read.text(f"{tmp_dir}/j").first()[0]
    assert line == '{"a":null,"m":"x","z":1}'


def test_geojson_layers(spark, tmp_dir):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "51107", "properties": {"name": "Loudoun"}},
        {"type": "Feature", "id": "24031", "properties": {"name": "Montgomery"}},
        {"type": "Feature", "id": None, "properties": {"name": "?"}},
        {"type": "Feature", "id": "51001", "properties": {"name": "Accomack"}}]}
    with open(f"{tmp_dir}/c.json", "w") as f:
        json.dump(doc, f, indent=1)
    feats = J.read_features(spark, tmp_dir, multi_line=True)
    got = sorted((r.feature_id, r.is_focus_county) for r in J.county_layer(feats).collect())
    assert got == [("51001", False), ("51107", True)]


def test_replace_table_counts_rows(spark, tmp_dir):
    df = spark.range(10).withColumn("year", F.lit(2024))
    assert replace_table(df, f"{tmp_dir}/t", partition_by=["year"], sort_within=["id"]) == 10
    assert replace_table(df.limit(3), f"{tmp_dir}/t") == 3
    assert read_table(spark, f"{tmp_dir}/t").count() == 3


def test_window_peaks(spark):
    d = spark.createDataFrame([("IAD", dt.date(2023, 7, 1), 10.0), ("IAD", dt.date(2023, 9, 1), 99.0),
                               ("IAD", dt.date(2024, 6, 1), -5.0), ("LAX", dt.date(2023, 7, 2), 50.0)],
                              "location string, date date, load_mwh double")
    out = {r.year: (r.peak_mwh, r.label_day) for r in response.window_peaks(d).collect()}
    assert out == {2023: (10.0, "2023-07-15"), 2024: (0.0, "2024-07-15"), 2025: (0.0, "2025-07-15")}


def test_required_columns_and_empty_guard(spark):
    import pytest
    df = spark.createDataFrame([("2024-01-01T00", "PJM", "DOM", "1")], "period string, parent string, subba string, value string")
    assert J.require_columns(df, J.LOAD_REQUIRED) is df
    with pytest.raises(ValueError, match="missing expected columns"):
        J.require_columns(df.drop("value"), J.LOAD_REQUIRED)
    assert J.ensure_not_empty(df) is df
    with pytest.raises(ValueError, match="no rows"):
        J.ensure_not_empty(df.limit(0), "load pages")


def test_rows_per_location_and_locations(spark):
    base = spark.createDataFrame([("IAD",), ("BOS",), ("IAD",)], "location string")
    assert [tuple(r) for r in response.rows_per_location(base).collect()] == [("IAD", 2), ("BOS", 1)]
    assert sorted(r.location for r in response.locations(base).collect()) == ["BOS", "IAD"]


def test_dashboard_card_rules(spark):
    rows = [(1, 20.0, None, "High (40-80%)", 79.5, "B", "C", "A St", "X", "Loudoun", "20100", 1234.5678, 0.5),
            (2, 20.01, 12345, "Low (<10%)", None, None, None, "", None, None, None, None, None),
            (3, 200.0, 5, "Arid and Low Water Use", 12.5, "B", "C", None, "X", "Fairfax", "20101", 1.0, 2.0),
            (4, None, 999, None, None, "B", "C", "x", "X", "Culpeper", "20102", None, None)]
    schema = ("facility_id long, capacity_mw double, pop_within_mile int, water_stress_index string, "
              "ej_particulate_matter double, brand string, company string, address string, city string, "
              "county string, zip string, est_load_50_mw double, annual_load_50_twh double")
    df = spark.createDataFrame(rows, schema)
    for c in K.EJ_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    card = {r.facility_id: r for r in dashboard.facility_card(df).collect()}
    assert card[1].capacity_band == "≤ 20 MW" and card[2].capacity_band == "20 – 75 MW"
    assert card[3].capacity_band == "75 – 200 MW" and card[4].capacity_band == "Unknown"
    assert [card[i].water_class for i in (1, 2, 3, 4)] == ["high", "low", "other", ""]
    assert card[1].households == "16,667" and card[4].households == "N/A"  # Math.round(20000 / 1.2)
    assert card[1].pct_particulate_matter == "80th" and card[3].pct_particulate_matter == "13th"
    assert card[2].pct_particulate_matter == "N/A"
    assert card[2].title == "null" and card[2].address_line == "N/A" and card[3].address_line == "N/A"
    assert card[2].place_line == "null, null County, VA null"
    assert card[1].est_load_50 == "1,234.568 MW" and card[1].annual_load == "0.5 TWh"
    assert card[2].population == "12,345" and card[1].population == "N/A"
    assert card[1].score_text == "48/100" and card[1].web_tier == "No Exemption"  # 28 + 20 + 0 + 0
    pts = df.withColumn("lat", F.lit(39.0)).withColumn("lon", F.lit(-77.5))
    mk = {r.facility_id: (r.z_offset, r.draw_layer, r.colour) for r in dashboard.facility_markers(pts).collect()}
    assert mk[4] == (-1000, 0, "#999") and mk[1] == (0, 1, "#ffaa00")


def test_window_peaks_overlapping_windows(spark):
    d = spark.createDataFrame([("IAD", dt.date(2024, 1, 5), 7.0), ("IAD", dt.date(2024, 1, 15), 9.0)],
                              "location string, date date, load_mwh double")
    wins = [(1, "2024-01-01", "2024-01-10"), (2, "2024-01-05", "2024-01-20"), (3, "2024-02-01", "2024-02-02")]
    out = {r.year: r.peak_mwh for r in response.window_peaks(d, wins).collect()}
    assert out == {1: 7.0, 2: 9.0, 3: 0.0}


def test_thousands_of_overlapping_windows(spark):
    """The bucket join against DuckDB's own range join, with missing days, values and ends."""
    rnd = random.Random(11)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    days = [(rnd.choice("ab"), day(rnd.randrange(900)), rnd.choice([None, rnd.uniform(-5, 5)])) for _ in range(1500)]
    windows = [(i, rnd.choice("abc"), day(a := rnd.randrange(-50, 950)), day(a + rnd.choice([-1, 0, 3, 40, 400, 2000]))) for i in range(4000)]
    windows += [(4000, "a", None, day(3)), (4001, "a", day(3), None)]
    d = spark.createDataFrame(days, "k string, date date, v double")
    w = spark.createDataFrame(windows, "id int, k string, x0 date, x1 date")
    got = sorted((r.id, r.max_value) for r in response.interval_max(d, w, "v", by=["k"]).collect())
    dd, ww = d.toPandas(), w.toPandas()  # noqa: F841
    want = duckdb.sql("""SELECT id, max(v) FROM ww LEFT JOIN dd ON dd.k = ww.k AND CAST(dd.date AS DATE) BETWEEN CAST(x0 AS DATE) AND CAST(x1 AS DATE)
                         GROUP BY id ORDER BY id""").fetchall()
    assert [i for i, _ in got] == [i for i, _ in want] and sum(v is not None for _, v in got) > 1000
    assert all(a == b or (a is None and (b is None or b != b)) for (_, a), (_, b) in zip(got, want))


def test_guards_as_a_relation(spark, tmp_dir):
    with open(f"{tmp_dir}/p.json", "w") as f:
        f.write(json.dumps({"response": {"data": [{"period": "2024-01-01T00", "value": None}, {"period": "x"}]}}))
    got = {(r.guard, r.subject): (r.found, r.passed) for r in J.landing_guards(spark, tmp_dir, ["period", "value", "subba"]).collect()}
    assert got == {("not empty", "records"): (2, True), ("required key", "period"): (2, True),
                   ("required key", "value"): (1, True), ("required key", "subba"): (0, False)}
    with open(f"{tmp_dir}/p.json", "w") as f:
        f.write("{}")
    assert {r.subject for r in J.landing_guards(spark, tmp_dir, ["period"]).collect() if not r.passed} == {"records"}

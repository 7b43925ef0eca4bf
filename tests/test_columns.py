"""Edge rows for the scalar traps."""

import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from thermoload.functions import columns as C
from thermoload.functions.wkb import with_point_xy


def one_col(spark, values, expr, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_decode_tmp(spark):
    got = one_col(spark, ["+0123,1", "-0050,1", "+9999,9", "bad,1", None, "+0000,1"], C.decode_tmp)
    assert got == [12.3, -5.0, None, None, None, 0.0]


def test_lenient_int(spark):
    got = one_col(spark, ["1,234", "1234.7", "2.5", "-2.5", "1e3", "", "abc", None],
                  lambda c: C.lenient_int(c, strip_commas=True))
    assert got == [1234, 1235, 3, -3, 1000, None, None, None]


def test_lenient_int_without_comma_strip(spark):
    assert one_col(spark, ["1,234", "2001"], C.lenient_int) == [None, 2001]


def test_strict_double_raises(spark):
    with pytest.raises(PySparkException):
        one_col(spark, ["12", "abc"], C.strict_double)


def test_decode_weather_time_is_strict_without_ansi(spark):
    from thermoload.operators.hourly import decode_weather
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        ok = spark.createDataFrame([("1", "2024-01-01T00:52:00", "+0010,1")], "STATION string, DATE string, TMP string")
        assert str(decode_weather(ok).first().ts_utc) == "2024-01-01 00:52:00"
        bad = spark.createDataFrame([("1", "Jan 1st", "+0010,1")], "STATION string, DATE string, TMP string")
        with pytest.raises(PySparkException):
            decode_weather(bad).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_strict_timestamp_raises_on_wrong_format(spark):
    ok = one_col(spark, ["2019-01-01T05"], lambda c: C.strict_timestamp(c, "yyyy-MM-dd'T'HH"))
    assert str(ok[0]) == "2019-01-01 05:00:00"
    with pytest.raises(PySparkException):
        one_col(spark, ["2019-01-01"], lambda c: C.strict_timestamp(c, "yyyy-MM-dd'T'HH"))


def test_trunc_hour_is_zone_free(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:45' AS ts")  # inside a DST gap
        assert str(df.select(C.trunc_hour("ts")).first()[0]) == "2024-03-10 02:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_station_code(spark):
    got = one_col(spark, ["72403093738", "72295023174", "99999999999", None], C.station_code)
    assert got == ["IAD", "LAX", "99999999999", None]


def test_fmt0_half_even_and_js_round_half_up(spark):
    assert one_col(spark, [200.5, 201.5, 12.4], C.fmt0, "v double") == ["200", "202", "12"]
    assert one_col(spark, [-2.5, 2.5, 0.49], C.js_round, "v double") == [-2, 3, 0]


def test_locale_number(spark):
    got = one_col(spark, [12345.0, 1234.5678, 0.5, 12.0, None],
                  lambda c: C.display_or_na(c, " MW"), "v double")
    assert got == ["12,345 MW", "1,234.568 MW", "0.5 MW", "12 MW", "N/A"]


def test_replace_first(spark):
    got = one_col(spark, ["2023-06-01", "2024-01-01", "x"],
                  lambda c: C.replace_first(C.replace_first(c, "-06-", "-07-"), "-01", "-15"))
    assert got == ["2023-07-15", "2024-15-01", "x"]


def test_row_max_skips_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (None, None, None)], "a double, b double, c double")
    assert [r[0] for r in df.select(C.row_max(["a", "b", "c"])).collect()] == [1.0, None]


def _wkb(x, y, little=True, gtype=1):
    o = "<" if little else ">"
    return bytearray(struct.pack(f"{o}bIdd", 1 if little else 0, gtype, x, y))


@pytest.mark.parametrize("x,y,little", [(-77.4875, 39.0437, True), (-77.4875, 39.0437, False),
                                         (0.0, -0.5, True), (179.999999, 0.001, False),
                                         (5e-324, -1e300, True)])
def test_wkb_points(spark, x, y, little):
    df = spark.createDataFrame([(_wkb(x, y, little),)], "g binary")
    r = with_point_xy(df, "g", "x", "y").first()
    assert (r.x, r.y) == (x, y) and df.columns == ["g"]


def test_wkb_rejects(spark):
    rows = [(None,), (_wkb(float("nan"), float("nan")),), (_wkb(1.0, 2.0, gtype=2),), (bytearray(b"\x01\x01"),)]
    df = spark.createDataFrame(rows, "g binary")
    assert [(r.x, r.y) for r in with_point_xy(df, "g", "x", "y").collect()] == [(None, None)] * 4


def test_wkb_round_trip_random_doubles(spark):
    import random
    rnd = random.Random(11)
    vals = [rnd.uniform(-180, 180) for _ in range(400)] + [rnd.uniform(-1e-300, 1e-300) for _ in range(100)]
    vals += [struct.unpack("<d", struct.pack("<Q", rnd.getrandbits(63)))[0] for _ in range(400)]
    vals = [v for v in vals if v == v and abs(v) != float("inf")]
    rows = [(i, _wkb(v, -v, little=bool(i % 2)), v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "i long, g binary, v double")
    out = with_point_xy(df, "g", "x", "y").collect()
    assert all(r.x == r.v and r.y == -r.v for r in out)


def test_lenient_casts_match_duckdb_try_cast(spark):
    """The lenient casts follow DuckDB's TRY_CAST text rules (the engine the
    original cleaning ran on): decimal text rounds half away from zero on its
    digits, '0x' hex and digit-group underscores are numbers, other scripts'
    digits are not."""
    import duckdb
    vals = ["12", " 12", "+5", "-0.5", "0.5", "2.5", "-2.5", "5.", ".5", "1e3", "1e-3", "12.5e1", "0x10", "1_000",
            "1,000", "inf", "nan", "2147483647.4", "2147483647.6", "-2147483648.5", "2147483648", "", "abc",
            "12abc", "٣", "0012", "3.4999999999999999", "99999999999999999999", "0e5"]
    con = duckdb.connect()
    want = con.execute("SELECT TRY_CAST(v AS INTEGER), TRY_CAST(v AS DOUBLE) FROM (SELECT unnest(?) AS v, "
                       "generate_subscripts(?, 1) AS i) ORDER BY i", [vals, vals]).fetchall()
    df = spark.createDataFrame(list(enumerate(vals)), "i int, v string").orderBy("i")
    got = [(r[0], r[1]) for r in df.select(C.lenient_int("v"), C.lenient_double("v")).collect()]
    nan_safe = lambda rows: [tuple("NaN" if v != v else v for v in r) for r in rows]
    assert nan_safe(got) == nan_safe(want)


def test_hour_start_in_any_zone(spark):
    import datetime as dt
    times = [dt.datetime(1, 1, 1, 0, 59), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 3, 10, 2, 30),
             dt.datetime(2024, 11, 3, 1, 59, 59), dt.datetime(9999, 12, 31, 23, 0), None]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = [r[0] for r in df.select(C.trunc_hour("t")).collect()]
            assert got == [t and t.replace(minute=0, second=0, microsecond=0) for t in times]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)

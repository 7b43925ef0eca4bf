"""Landed files whose rows a careless reader would lose or shift, against DuckDB's reader or a raised error."""

import json
import os

import duckdb
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from thermoload.operators import hourly
from thermoload.plans import queries as Q
from thermoload.sources import json_sources as J
from thermoload.sources import files as files_module
from thermoload.sources import sinks
from thermoload.sources.files import list_files
from thermoload.sources.weather_csv import detect_types, read_csv_typed, read_csv_union

COLS = ["STATION", "DATE", "TMP"]


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def duck(pattern):
    return sorted(duckdb.sql(f"SELECT STATION, DATE, TMP FROM read_csv('{pattern}', union_by_name=true, all_varchar=true,"
                             " header=true, quote='\"', escape='\"')").fetchall(), key=str)


@pytest.mark.parametrize("text", [
    'STATION,DATE,REMARKS,TMP\n1,2024-01-01T00:00:00,"say ""x, y"" end","+0100,1"\n',
    'STATION,DATE,REMARKS,TMP\n1,2024-01-01T00:00:00,"two\nlines","+0100,1"\n2,2024-01-01T01:00:00,x,"+0110,1"\n',
    'station,date,tmp\n1,2024-01-01T00:00:00,"+0100,1"\n',
    'TMP,STATION,DATE\n"+0100,1",1,2024-01-01T00:00:00\n',
])
def test_csv_fields_match_duckdb(spark, tmp_dir, text):
    put(f"{tmp_dir}/a.csv", text)
    got = rows(read_csv_union(spark, f"{tmp_dir}/*.csv", COLS))
    assert got == duck(f"{tmp_dir}/*.csv") and all(r[2] for r in got)


def test_csv_folders_of_any_depth(spark, tmp_dir):
    for d in ("a", "a/b", "a/b/c"):
        put(f"{tmp_dir}/land/{d}/f.csv", "STATION,DATE,TMP\n" + f"{len(d)},2024-01-01T00:00:00,1\n")
    put(f"{tmp_dir}/land/_tmp/f.csv", "junk\n")
    assert len(list_files(spark, f"{tmp_dir}/land")) == 3
    assert read_csv_union(spark, f"{tmp_dir}/land", COLS).count() == 3


def test_no_csv_files(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/empty")
    put(f"{tmp_dir}/hollow/a.csv", "")
    for pattern in (f"{tmp_dir}/none/*.csv", f"{tmp_dir}/none", f"{tmp_dir}/empty", f"{tmp_dir}/hollow", []):
        with pytest.raises(FileNotFoundError):
            read_csv_union(spark, pattern)
    assert read_csv_union(spark, [f"{tmp_dir}/hollow/a.csv"], COLS).count() == 0


def test_csv_errors(spark, tmp_dir):
    put(f"{tmp_dir}/blank/a.csv", "\nSTATION,DATE,TMP\n1,2024-01-01T00:00:00,1\n")
    with pytest.raises(ValueError, match="blank header"):
        read_csv_union(spark, f"{tmp_dir}/blank/*.csv", COLS)
    put(f"{tmp_dir}/lacks/a.csv", "STATION,DATE\n1,2024-01-01T00:00:00\n")
    with pytest.raises(ValueError, match="TMP"):
        read_csv_union(spark, f"{tmp_dir}/lacks/*.csv", COLS)
    put(f"{tmp_dir}/lacks/b.csv", "STATION,DATE,TMP\n2,2024-01-01T00:00:00,5\n")
    assert rows(read_csv_union(spark, f"{tmp_dir}/lacks/*.csv", COLS))[0][2] is None


def test_json_pages_malformed_or_pretty(spark, tmp_dir):
    page = {"response": {"data": [{"period": "2024-01-01T00", "parent": "PJM", "subba": "DOM", "value": "5"}]}}
    put(f"{tmp_dir}/ok/a.json", json.dumps(page) + "\n")
    assert J.read_load_pages(spark, f"{tmp_dir}/ok").count() == 1
    put(f"{tmp_dir}/cut/a.json", json.dumps(page) + "\n" + json.dumps(page)[:-20] + "\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        J.read_load_pages(spark, f"{tmp_dir}/cut").collect()
    put(f"{tmp_dir}/pretty/a.json", json.dumps(page, indent=1))
    with pytest.raises((PySparkException, Py4JJavaError)):
        J.read_load_pages(spark, f"{tmp_dir}/pretty").collect()
    assert J.read_load_pages(spark, f"{tmp_dir}/pretty", multi_line=True).count() == 1


def test_page_keys(spark, tmp_dir):
    lacks = {"response": {"data": [{"period": "2024-01-01T00", "parent": "PJM", "subba": "DOM"}]}}
    put(f"{tmp_dir}/p/a.json", json.dumps(lacks))
    with pytest.raises(ValueError, match="value"):
        J.require_page_keys(spark, f"{tmp_dir}/p")
    lacks["response"]["data"][0]["value"] = None
    put(f"{tmp_dir}/p/a.json", json.dumps(lacks))
    J.require_page_keys(spark, f"{tmp_dir}/p")


def test_malformed_record_raises(spark):
    df = spark.createDataFrame([('{"A": 1',)], "value string")
    with pytest.raises((PySparkException, Py4JJavaError)):
        J.normalise_records(df).collect()


def test_no_stale_plan(spark, tmp_dir):
    """Rows appended between two calls in one session are seen."""
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.write.parquet(f"{tmp_dir}/events.parquet")
    before = Q.q_temp_decode(spark, tmp_dir).count()
    ev.write.mode("append").parquet(f"{tmp_dir}/events.parquet")
    assert Q.q_temp_decode(spark, tmp_dir).count() == 2 * before


def test_replace_table_files_are_sorted(spark, tmp_dir):
    df = spark.range(0, 5000, 1, 7).select(F.hash("id").alias("k"), (F.col("id") % 3).alias("year"))
    path = f"{tmp_dir}/t"
    assert sinks.replace_table(df.limit(10), path, ["year"], ["k"]) == 10
    read = Observation("input")
    assert sinks.replace_table(df.observe(read, F.count(F.lit(1)).alias("n")), path, ["year"], ["k"]) == 5000
    assert read.get["n"] == 5000  # the input is computed once
    files = list_files(spark, sinks.table_location(spark, path))
    assert files and sinks.read_table(spark, path).count() == 5000
    for f in files:
        ks = [r.k for r in spark.read.parquet(f).collect()]
        assert ks == sorted(ks)


def test_a_hot_year_is_written_by_several_tasks(spark, tmp_dir):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        df = spark.range(0, 300_000, 1, 6).select(F.hash("id").alias("k"), F.when(F.col("id") % 10 < 8, 2024).otherwise(2000 + F.col("id") % 10).alias("year"))
        sinks.replace_table(df, f"{tmp_dir}/t", ["year"], ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = list_files(spark, sinks.table_location(spark, f"{tmp_dir}/t"))
    assert sum("year=2024" in f for f in files) > 2
    for f in files:
        ks = [r.k for r in spark.read.parquet(f).collect()]
        assert ks == sorted(ks)


def test_failed_replace_keeps_the_old_table(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    sinks.replace_table(spark.range(5), path)
    bad = spark.range(5).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises((PySparkException, Py4JJavaError)):
        sinks.replace_table(bad, path)
    assert sinks.read_table(spark, path).count() == 5


def test_a_job_that_stops_before_the_swap(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, path)
    sinks.replace_table(spark.range(5), path, view="swapped")
    held = sinks.read_table(spark, path)  # a reader that has planned its scan
    folder, rows = sinks.stage_table(spark.range(7).withColumn("more", F.lit(1)), path)  # written whole, not published
    assert rows == 7 and sinks.read_table(spark, path).count() == 5 and spark.table("swapped").count() == 5
    sinks.publish_table(spark, path, folder, view="swapped")
    assert sinks.read_table(spark, path).count() == 7 and spark.table("swapped").columns == ["id", "more"] and held.count() == 5
    for n in (8, 9):
        sinks.replace_table(spark.range(n), path, view="swapped")
    assert spark.table("swapped").count() == 9
    assert len([x for x in os.listdir(path) if x.startswith("_v")]) == 2  # the current version and the one before
    spark.sql("DROP VIEW swapped")


def test_many_files_are_opened_by_executors_only(spark, tmp_dir, monkeypatch):
    """2,000 small files and a large one, three headers; the driver's file system opens none."""
    for i in range(2000):
        head, row = [("STATION,DATE,TMP", "s,d,t"), ("\ufeffDATE,TMP,station,X", "d,t,s,x"), ("DATE,STATION", "d,s")][i % 3]
        put(f"{tmp_dir}/{i % 7}/f {i}%20.csv", f"{head}\r\n{row}\n")
    put(f"{tmp_dir}/0/empty.csv", "")
    put(f"{tmp_dir}/1/large one%.csv", "TMP,DATE,STATION\n" + "t,d,s\n" * 200_000)
    real = files_module._fs

    class Listing:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            assert name not in ("open", "openFile")
            return getattr(self.fs, name)
    monkeypatch.setattr(files_module, "_fs", lambda s, p: (real(s, p)[0], Listing(real(s, p)[1])))
    monkeypatch.setattr(SparkSession, "createDataFrame", None)
    groups = files_module.files_by_header(spark, tmp_dir)
    assert {k: len(v) for k, v in groups.items()} == {"STATION,DATE,TMP": 667, "DATE,TMP,station,X": 667, "DATE,STATION": 666, "TMP,DATE,STATION": 1}
    got = read_csv_union(spark, tmp_dir, COLS).groupBy(*COLS).count().collect()
    assert set(map(tuple, got)) == {("s", "d", None, 666), ("s", "d", "t", 201_334)}


def test_long_files_may_be_split(spark, tmp_dir):
    put(f"{tmp_dir}/a.csv", "STATION,DATE,TMP\n" + 's,d,"+0100,1"\n' * 50_000)
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    df = read_csv_union(own, f"{tmp_dir}/a.csv", COLS, line_feeds=False)
    assert df.rdd.getNumPartitions() > 5 and df.filter("TMP = '+0100,1'").count() == 50_000
    put(f"{tmp_dir}/b.csv", 'STATION,DATE,TMP\ns,d,"two\nlines"\n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_csv_union(spark, f"{tmp_dir}/b.csv", COLS, line_feeds=False).collect()


TYPED = {"a": ["true", "F"], "b": ["0", "1"], "c": ["-9223372036854775808", "12"], "d": ["1.5", "2"], "e": ["1e3", ".5"], "f": ["007", "12"],
         "g": ["2024-01-05", "2024-02-29"], "h": ["2024-02-30", "2024-01-01"], "i": ["2024-01-05T10:00:00", "2024-01-05 11:00:00.25"],
         "j": ["2024-01-05T10:00:00Z", "2024-01-05T11:00:00Z"], "k": ["10:00:00", "11:30:00"], "l": ["", ""], "m": ["", "5"],
         "n": ["x", "1"], "o": ["true", "1"], "p": [" 5", "6 "], "q": ["1_000", "2"], "r": ["+1", "2"], "s": ['"1,5"', "2"]}


def test_types_match_duckdb(spark, tmp_dir):
    for i in (0, 1):  # the columns of each file in another order
        cols = sorted(TYPED, reverse=bool(i))
        put(f"{tmp_dir}/{i}.csv", ",".join(cols) + "\n" + "".join(",".join(TYPED[c][k] for c in cols) + "\n" for k in (0, 1, 0)))
    put(f"{tmp_dir}/2.csv", "t,u,g\n1,2024-01-05,2024-01-06\n")
    put(f"{tmp_dir}/3.csv", "u,t,extra\n2024-01-05T01:00:00,2.5,\n")
    duck = dict(r[:2] for r in duckdb.sql(f"DESCRIBE SELECT * FROM read_csv('{tmp_dir}/*.csv', header=true, union_by_name=true, "
                                          "sample_size=-1)").fetchall())
    got = {r.column_name: r.column_type for r in detect_types(read_csv_union(spark, f"{tmp_dir}/*.csv")).collect()}
    assert got == duck and got["t"] == "DOUBLE" and got["u"] == "TIMESTAMP" and len(set(got.values())) == 8
    typed = read_csv_typed(spark, f"{tmp_dir}/*.csv")
    assert typed.count() == 8 and dict(typed.dtypes)["b"] == "bigint" and dict(typed.dtypes)["u"] == "timestamp_ntz"
    assert sorted(r.d for r in typed.collect() if r.d) == [1.5] * 4 + [2.0] * 2


@pytest.mark.parametrize("text", ["2024", "2024-01", "2024-01-05T10", "x"])
def test_partial_observation_times_raise(spark, text):
    df = spark.createDataFrame([("1", text, "+0010,1")], "STATION string, DATE string, TMP string")
    with pytest.raises((PySparkException, Py4JJavaError)):
        hourly.decode_weather(df).collect()


def test_whole_observation_times(spark):
    texts = ["2024-01-05", "2024-01-05 10:00", "2024-01-05T10:00:00", "2024-1-5", " 2024-01-05T10:00:00 ", None]
    df = spark.createDataFrame([("1", t, "+12.7,1") for t in texts], "STATION string, DATE string, TMP string")
    got = hourly.decode_weather(df).collect()
    want = [duckdb.execute("SELECT CAST(? AS TIMESTAMP)", [t]).fetchone()[0] for t in texts]
    assert [r.ts_utc for r in got] == want and got[0].temp_C == 1.3

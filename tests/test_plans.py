"""Plan shape: broadcasts only where bounded, pushdown, shuffle counts, no
Python UDFs anywhere, exchange reuse in the positional sample."""

import pytest

from thermoload.operators import facilities, positional
from thermoload.plans import queries as Q
from thermoload.sources import fixtures

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def explain(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_no_python_udfs(spark, name):
    p = plan(Q.QUERIES[name](spark, SF))
    assert "PythonUDF" not in p and "EvalPython" not in p and "FlatMapGroupsInPandas" not in p


def test_base_combine_broadcasts_only_the_mapping(spark):
    # as at scale: no table is small enough for a size-based broadcast
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(Q.q_base_combine(spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("BroadcastExchange") == 1  # the 4-row station->region relation (explicit hint)
    assert "SortMergeJoin" in p  # region-hour alignment of the two aggregated tables


def test_base_combine_parses_each_time_once(spark):
    import re
    p = explain(Q.q_base_combine(spark, SF))
    pushed = [x for x in re.findall(r"Condition : (.*)", p) if "isnotnull" in x]
    assert pushed and all(x.count("try_cast") + x.count("gettimestamp") <= 1 for x in pushed)


def test_reasons_filter_holds_no_rubric(spark):
    import re
    p = explain(Q.q_exemption_reasons(spark, SF))
    assert all("capacity" not in x for x in re.findall(r"Condition : (.*)", p))


def test_scan_prunes_columns(spark):
    p = explain(Q.q_hourly_load(spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in p


def test_county_filter_pushed_to_scan(spark, tmp_dir):
    fixtures.facility_raw(spark, SF).write.parquet(f"{tmp_dir}/raw")
    clean = facilities.clean_facilities(spark.read.parquet(f"{tmp_dir}/raw"))
    p = explain(clean)
    assert "PushedFilters: [In(county, [Culpeper,Fairfax,Fauqier,Loudoun,Prince William])]" in p


def test_heatwave_flags_one_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        daily_in = Q.weather_daily(spark, SF)
        before = plan(daily_in).count("Exchange")
        after = plan(Q.flags_df(spark, SF)).count("Exchange")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert after - before == 1  # both windows share the station partitioning; no join


def test_positional_sample_sorts_no_table(spark, monkeypatch):
    """No global sort and no checkpoint: counts, then a window over the few rows of the positions' bins."""
    scores = Q.scored_df(spark, SF).select("facility_id", "exemption_score")
    for method in ("repartitionByRange", "checkpoint", "localCheckpoint", "orderBy"):
        monkeypatch.setattr(type(scores), method, None)
    got = positional.select_positions(scores, ["exemption_score", "facility_id"], positional.quartile_positions)
    assert got.count() == 5

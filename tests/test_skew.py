"""A station holding most of the rows: results equal a brute-force pandas
computation, and every aggregate combines map-side before its shuffle."""

import datetime as dt
import random

import pandas as pd

from thermoload.operators import hourly, response


def _skewed(spark, n=20000):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        st = "IAD" if i % 10 else rnd.choice(["BOS", "NYC", "LAX"])  # IAD holds 90%
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 20))
        rows.append((st, ts, rnd.uniform(-10, 40), rnd.uniform(1000, 20000)))
    return rows


def test_hourly_mean_under_skew(spark):
    rows = _skewed(spark)
    df = spark.createDataFrame([(s, t, v) for s, t, v, _ in rows], "station string, ts_utc timestamp_ntz, temp_C double")
    got = {(r.station, r.hour_utc): r.temp_C for r in hourly.hourly_temperature(df).collect()}
    pdf = pd.DataFrame([(s, t.replace(minute=0, second=0), v) for s, t, v, _ in rows], columns=["s", "h", "v"])
    want = pdf.groupby(["s", "h"])["v"].mean().to_dict()
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = hourly.hourly_temperature(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_avg") > plan.index("Exchange")  # partial aggregate sits below the shuffle


def test_quadratic_fit_under_skew(spark):
    import numpy as np
    rows = _skewed(spark)
    base = spark.createDataFrame([(s, t, v, y) for s, t, v, y in rows],
                                 "location string, hour_utc timestamp_ntz, temp double, load_mwh double")
    got = {r.location: (r.beta0, r.beta1, r.beta2) for r in response.quadratic_fit(base).collect()}
    for loc in ["IAD", "BOS"]:
        x = np.array([v for s, _, v, _ in rows if s == loc])
        y = np.array([l for s, _, _, l in rows if s == loc])
        coef, *_ = np.linalg.lstsq(np.column_stack([np.ones_like(x), x, x * x]), y, rcond=None)
        assert np.allclose(got[loc], coef, rtol=1e-8, atol=1e-8)

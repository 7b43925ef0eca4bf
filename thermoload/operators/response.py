"""Temperature response of load: categories, daily means, quadratic fits.

The per-region fit ``load = b0 + b1*T + b2*T^2`` is one grouped aggregate of
built-in, numerically stable central moments (``var_pop``/``covar_pop``,
merged map-side), solved in closed form: no rows leave the executors and the
aggregate stays correct when one region holds most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import dbl, fill, is_finite, js_round, nan_to_null, null_double, replace_first, thousands


def rows_per_location(base: DataFrame) -> DataFrame:
    """Rows per location, most first. Locations come from the fixed
    station mapping (``combine`` joins to it, so there are never more), so the ordered
    result is sorted in a single partition instead of paying a range-sort sampling job."""
    return (base.groupBy("location").agg(F.count(F.lit(1)).alias("rows"))
            .coalesce(1).sortWithinPartitions(F.desc("rows"), "location"))


def location_ranking(base: DataFrame) -> DataFrame:
    """O2: the same rows with their 0-based position; a window over one row per location."""
    order = Window.orderBy(F.desc("rows"), "location")
    return rows_per_location(base).withColumn("position", (F.row_number().over(order) - 1).cast("long"))


def locations(base: DataFrame) -> DataFrame:
    """The distinct locations present."""
    return base.select("location").distinct()


def temperature_category(c: str = "temp"):
    """Three-way category; NULL/NaN temperature falls through to Normal."""
    t = nan_to_null(c)
    return (F.when(t < dbl(K.COLD_BELOW_C), F.lit(K.CAT_COLD))
            .when(t > dbl(K.HOT_ABOVE_C), F.lit(K.CAT_HOT))
            .otherwise(F.lit(K.CAT_NORMAL)))


def category_means(base: DataFrame) -> DataFrame:
    """A10: mean load per location and temperature category (NULL loads skipped)."""
    return (base.groupBy("location", temperature_category().alias("temp_category"))
            .agg(F.avg(nan_to_null("load_mwh")).alias("mean_load_mwh")))


PIVOT_NAMES = {K.CAT_COLD: "cold_load_mwh", K.CAT_HOT: "hot_load_mwh", K.CAT_NORMAL: "normal_load_mwh"}


def category_pivot(base: DataFrame) -> DataFrame:
    """One row per location, one mean-load column per category.

    Written as conditional averages in one aggregation: the same result as
    ``groupBy(location).pivot(category, values).avg(load)``, whose two-phase
    plan costs a second shuffle."""
    cat = temperature_category()
    load = nan_to_null("load_mwh")
    return base.groupBy("location").agg(
        *[F.avg(F.when(cat == F.lit(k), load)).alias(v) for k, v in PIVOT_NAMES.items()])


def daily_means(base: DataFrame) -> DataFrame:
    """Daily mean load (and mean temperature) per location."""
    return (base.groupBy("location", F.to_date("hour_utc").alias("date"))
            .agg(F.avg(nan_to_null("load_mwh")).alias("load_mwh"),
                 F.avg(nan_to_null("temp")).alias("temp")))


def quadratic_fit(base: DataFrame, det_tol: float = 1e-12) -> DataFrame:
    """OLS of load on (1, T, T^2) per location, plus A13 min/max T.

    Slopes solve the 2x2 covariance system of (T, T^2); the intercept follows
    from the means. Only rows with finite T and load enter the fit (P14);
    min/max temperature use every row with a temperature, as the reference's
    plotting grid does. Where T has one or two distinct values many parabolas fit equally
    well and the one whose coefficients have the smallest norm is returned, as a pseudo-inverse does. It
    follows from the same moments (see ``_least_norm``). No row to fit: NULL coefficients.
    """
    ok = is_finite("temp") & is_finite("load_mwh")
    t = F.when(ok, F.col("temp"))
    t2 = F.when(ok, F.col("temp") * F.col("temp"))
    y = F.when(ok, F.col("load_mwh"))
    m = base.groupBy("location").agg(
        F.count(t).alias("n_obs"),
        F.avg(t).alias("mt"), F.avg(t2).alias("mt2"), F.avg(y).alias("my"),
        F.var_pop(t).alias("vt"), F.var_pop(t2).alias("vt2"),
        F.covar_pop(t, t2).alias("ct_t2"), F.covar_pop(t, y).alias("ct_y"),
        F.covar_pop(t2, y).alias("ct2_y"), F.min(t).alias("t_lo"), F.max(t).alias("t_hi"),
        F.min(nan_to_null("temp")).alias("temp_min"), F.max(nan_to_null("temp")).alias("temp_max"))
    det = F.col("vt") * F.col("vt2") - F.col("ct_t2") * F.col("ct_t2")
    good = det > dbl(det_tol) * F.col("vt") * F.col("vt2")
    b1 = (F.col("ct_y") * F.col("vt2") - F.col("ct_t2") * F.col("ct2_y")) / det
    b2 = (F.col("vt") * F.col("ct2_y") - F.col("ct_t2") * F.col("ct_y")) / det
    b0 = F.col("my") - b1 * F.col("mt") - b2 * F.col("mt2")
    least = _least_norm()
    return m.select(
        "location", "n_obs",
        *[F.when(F.col("n_obs") == 0, null_double()).when(good, b).otherwise(other).alias(f"beta{i}")
          for i, (b, other) in enumerate(zip((b0, b1, b2), least))],
        "temp_min", "temp_max")


def _least_norm() -> list[Column]:
    """Coefficients of the smallest norm for temperatures with one or two distinct values.

    One value t: every fit has b . (1, t, t^2) = mean load, the shortest b is along that vector. Two
    values t_lo, t_hi: the fits are the line through both mean loads plus any multiple of
    (T - t_lo)(T - t_hi); the shortest is at right angles to that parabola's coefficients."""
    lo, hi, my = F.col("t_lo"), F.col("t_hi"), F.col("my")
    one = dbl(1.0)
    x = [one, lo, lo * lo]
    length = x[0] + x[1] * x[1] + x[2] * x[2]
    slope = F.col("ct_y") / F.nullif(F.col("vt"), dbl(0))  # used for two values only
    line = [my - slope * F.col("mt"), slope, dbl(0.0)]
    null = [lo * hi, -(lo + hi), one]
    along = (line[0] * null[0] + line[1] * null[1]) / (null[0] * null[0] + null[1] * null[1] + one)
    return [F.when(lo == hi, my * xi / length).otherwise(p - along * v) for xi, p, v in zip(x, line, null)]


def _grid(fit: DataFrame, points: int) -> DataFrame:
    """The fit rows expanded to the curve grid, coefficients kept (J7: each
    grid point carries its own region's model)."""
    step = (F.col("temp_max") - F.col("temp_min")) / dbl(points - 1)
    g = fit.select("location", "beta0", "beta1", "beta2", "temp_min", "temp_max",
                   F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    temp = (F.when(F.col("point") == points - 1, F.col("temp_max"))
            .otherwise(F.col("point").cast("double") * step + F.col("temp_min")))
    g = g.withColumn("temp", temp)
    pred = F.col("beta0") + F.col("beta1") * F.col("temp") + F.col("beta2") * (F.col("temp") * F.col("temp"))
    return g.withColumn("load_pred", pred)


def fit_curve(fit: DataFrame, points: int = K.CURVE_POINTS) -> DataFrame:
    """``points`` evenly spaced temperatures from min to max per location
    (``numpy.linspace``: ``i * step + lo``, last point exactly max) and the
    fitted load at each. ``fit`` has one row per location, so the expansion
    is bounded by locations x points."""
    return _grid(fit, points).select("location", "point", "temp", "load_pred")


def fit_annotation(fit: DataFrame, points: int = K.CURVE_POINTS,
                   fraction: float = K.ANNOTATION_FRACTION) -> DataFrame:
    """curvature label ``'LOC: b2'`` (one decimal) placed at grid point
    ``int(fraction * points)``."""
    idx = int(fraction * points)
    b2 = F.round(F.col("beta2"), 1)
    pts = (_grid(fit, points).filter(F.col("point") == idx)
           .withColumn("beta2_1dp", F.when(b2 == 0, F.lit(0.0)).otherwise(b2)))
    return (pts.select("location", "beta2_1dp",
                    F.concat(F.col("location"), F.lit(": "),
                             F.format_string("%.1f", F.col("beta2_1dp"))).alias("label"),
                    F.col("temp").alias("x_annot"), F.col("load_pred").alias("y_annot")))


def series_arrays(daily: DataFrame) -> DataFrame:
    """Per location, parallel arrays of dates, daily load and temperature
    ordered by date (the dashboard's series document). Arrays are bounded by
    the number of days."""
    s = daily.groupBy("location").agg(
        F.array_sort(F.collect_list(F.struct("date", "load_mwh", "temp"))).alias("pts"))
    return s.select(
        "location",
        F.transform("pts", lambda p: F.date_format(p["date"], "yyyy-MM-dd")).alias("dates"),
        F.transform("pts", lambda p: p["load_mwh"]).alias("load"),
        F.transform("pts", lambda p: p["temp"]).alias("temp"))


def series_document(arrays: DataFrame) -> DataFrame:
    """The dashboard's file: one JSON object keyed by location (one row). Locations come
    from the station mapping and a series has one entry per day, so the document is small."""
    entry = F.struct(F.col("location").alias("key"), F.struct("dates", "load", "temp").alias("value"))
    doc = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return arrays.agg(F.to_json(doc, {"ignoreNullFields": "false"}).alias("value"))


def read_series_document(doc: DataFrame) -> DataFrame:
    """``series_arrays`` back from the document."""
    kind = "map<string, struct<dates: array<string>, load: array<double>, temp: array<double>>>"
    m = doc.select(F.explode(F.from_json("value", kind, {"mode": "FAILFAST"})).alias("location", "s"))
    return m.select("location", "s.*")


def series_rows(arrays: DataFrame) -> DataFrame:
    """The series arrays back as rows (position, date, load, temp)."""
    z = arrays.select("location", F.posexplode(F.arrays_zip("dates", "load", "temp")).alias("idx", "p"))
    return z.select("location", "idx", F.col("p.dates").alias("date"),
                    F.col("p.load").alias("load_mwh"), F.col("p.temp").alias("temp"))


def fahrenheit(daily: DataFrame) -> DataFrame:
    """Dashboard hover text value, ``Math.round(c * 9/5 + 32)`` (a JS
    Number, so DOUBLE)."""
    f = F.floor(F.col("temp") * dbl(9) / dbl(5) + dbl(32) + dbl(0.5)).cast("double")
    return daily.select("location", "date", "temp", f.alias("temp_f"))


BUCKET_DAYS = 32


def interval_max(days: DataFrame, windows: DataFrame, value: str, day: str = "date", by: list[str] | None = None) -> DataFrame:
    """Every window of ``windows`` (``x0``, ``x1`` and any other columns) with ``max_value``, the
    largest ``value`` of the rows of ``days`` with ``x0 <= day <= x1`` and equal ``by`` columns; NULL
    where there is none.

    A range join by day buckets: days are reduced to one row per day and per bucket of
    ``BUCKET_DAYS`` days, a window is expanded to the buckets it touches. Buckets that lie wholly inside
    are looked up as one row, the (at most two) others day by day, all by equality. The join's rows per window are thus bounded by its
    length / ``BUCKET_DAYS`` + 2 * ``BUCKET_DAYS``, however many windows overlap, and no side is
    collected or broadcast unless adaptive execution finds it small."""
    by = by or []
    bucket = lambda d: F.floor(F.unix_date(d) / F.lit(BUCKET_DAYS)).cast("int")
    daily = days.filter(F.col(value).isNotNull() & F.col(day).isNotNull()).groupBy(*by, F.col(day).alias("__day")).agg(F.max(value).alias("__v"))
    daily = daily.withColumn("__bucket", bucket(F.col("__day")))
    whole = daily.groupBy(*by, "__bucket").agg(F.max("__v").alias("__v"))
    numbered = windows.filter("x0 <= x1").select(*by, "x0", "x1").distinct()
    touched = numbered.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("x0")), bucket(F.col("x1")))))
    first = F.col("__bucket") * BUCKET_DAYS
    inside = (first >= F.unix_date("x0")) & (first + (BUCKET_DAYS - 1) <= F.unix_date("x1"))
    keys = [*by, "__bucket"]
    hits = (touched.filter(inside).join(whole, keys)
            .unionByName(touched.filter(~inside).join(daily, keys).filter("__day BETWEEN x0 AND x1"), allowMissingColumns=True))
    best = hits.groupBy(*by, "x0", "x1").agg(F.max("__v").alias("max_value"))
    return windows.join(best, [*by, "x0", "x1"], "left")


def window_peaks(daily: DataFrame, windows: DataFrame | list[tuple[int, str, str]] | None = None,
                 location: str = K.SERIES_LOCATION) -> DataFrame:
    """Peak daily mean load of ``location`` inside each date window
    (``x0 <= day <= x1``), floored at 0; windows without data give 0.

    ``windows`` is a table with ``year``, ``x0``, ``x1`` (dates as text) or a list of such rows, of any number and
    overlap (``interval_max``).
    Label day and text follow the dashboard (first-occurrence replaces, then
    ``'Summer YYYY'`` with the JS-rounded peak and thousands separators).
    """
    if not isinstance(windows, DataFrame):
        windows = daily.sparkSession.createDataFrame(windows or K.SUMMER_WINDOWS, "year int, x0 string, x1 string")
    spans = windows.select("year", F.col("x0").alias("x0_text"), F.col("x1").alias("x1_text"),
                           F.to_date("x0").alias("x0"), F.to_date("x1").alias("x1"))
    loads = daily.filter(F.col("location") == location).select("date", nan_to_null("load_mwh").alias("load_mwh"))
    j = interval_max(loads, spans, "load_mwh").select("year", F.col("x0_text").alias("x0"), F.col("x1_text").alias("x1"), "max_value")
    peak = F.greatest(F.coalesce(F.col("max_value"), dbl(0)), dbl(0))
    label_day = F.col("x0")
    for old, new in K.PEAK_DAY_REPLACEMENTS:
        label_day = replace_first(label_day, old, new)
    return j.select(
        "year", "x0", "x1", peak.alias("peak_mwh"), label_day.alias("label_day"),
        fill(K.PEAK_LABEL, F.col("year").cast("string"), thousands(js_round(peak))).alias("label"))

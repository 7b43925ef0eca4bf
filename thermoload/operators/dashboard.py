"""Dashboard derivations: web score variant, facility card, map markers,
score histogram and grid breakdown.

The web page recomputes the rubric slightly differently from the scoring
script (water: any label starting with 'Low' scores; percentiles floor at
0), formats numbers the browser way (``toLocaleString``, ``Math.round``)
and prints NULL text as 'null'. All of it is per-row projection except the
histogram and the grid totals, which are small grouped aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import banded, dbl, display_or_na, fill, js_round, js_text, locale_number, nan_to_null


def web_score(df: DataFrame, ej_cols: list[str] | None = None) -> Column:
    """the browser's ``calcExemptionScore``."""
    ej_cols = ej_cols or K.EJ_COLUMNS
    cap = F.col("capacity_mw")
    power = banded(cap, K.POWER_BANDS, 0, True)
    max_ej = F.greatest(dbl(0), *[nan_to_null(c) for c in ej_cols if c in df.columns])
    ej = F.when(max_ej < dbl(K.EJ_CONCERN_PERCENTILE), K.EJ_POINTS).otherwise(0)
    pop = F.col("pop_within_mile")
    popp = banded(pop, K.POPULATION_BANDS, 0, False)
    ws = F.coalesce(F.col("water_stress_index"), F.lit(""))
    water = (F.when(ws.startswith("Low"), K.WATER_LOW_POINTS)
             .when(ws == K.WATER_MEDIUM_HIGH, K.WATER_MEDIUM_HIGH_POINTS).otherwise(0))
    return power + ej + popp + water


def web_tier(score: Column) -> tuple[Column, Column]:
    """tier label and colour."""
    (t1, l1, c1), (t2, l2, c2) = K.WEB_TIERS
    label = F.when(score >= t1, l1).when(score >= t2, l2).otherwise(K.WEB_TIER_NONE[0])
    colour = F.when(score >= t1, c1).when(score >= t2, c2).otherwise(K.WEB_TIER_NONE[1])
    return label, colour


def capacity_band(cap: Column) -> tuple[Column, Column]:
    """P25: capacity band label and colour; NULL capacity is 'Unknown'."""
    label = F.when(cap.isNull(), F.lit(K.CAPACITY_BAND_UNKNOWN[0]))
    colour = F.when(cap.isNull(), F.lit(K.CAPACITY_BAND_UNKNOWN[1]))
    for lo, lab, col in K.CAPACITY_BANDS:
        label = label.when(cap > dbl(lo), F.lit(lab))
        colour = colour.when(cap > dbl(lo), F.lit(col))
    return label.otherwise(F.lit(K.CAPACITY_BAND_LOW[0])), colour.otherwise(F.lit(K.CAPACITY_BAND_LOW[1]))


def water_class(c: str = "water_stress_index") -> Column:
    """P26: '' for missing/empty, then 'high' / 'low' by prefix, else 'other'."""
    ws = F.col(c)
    return (F.when(ws.isNull() | (ws == ""), F.lit("")).when(ws.startswith("High"), F.lit("high"))
            .when(ws.startswith("Low"), F.lit("low")).otherwise(F.lit("other")))


def scored_web(df: DataFrame) -> DataFrame:
    s = df.withColumn("web_score", web_score(df))
    label, colour = web_tier(F.col("web_score"))
    return s.withColumn("web_tier", label).withColumn("web_colour", colour)


def facility_card(df: DataFrame, id_col: str = "facility_id") -> DataFrame:
    """the side-panel text of every facility."""
    s = scored_web(df)
    cap = F.col("capacity_mw")
    households = F.when(cap.isNull(), F.lit(K.CARD_NA)).otherwise(
        locale_number(js_round(cap * dbl(1000) / dbl(K.HOUSEHOLD_KW))))
    band, _ = capacity_band(cap)
    pct = []
    for label, c in K.CARD_PERCENTILES:
        v = F.col(c)
        pct.append(F.when(v.isNull(), F.lit(K.CARD_NA))
                   .otherwise(fill(K.CARD_PERCENTILE, js_round(v).cast("string")))
                   .alias(c.replace("ej_", "pct_")))
    return s.select(
        id_col,
        js_text("brand").alias("title"),
        js_text("company").alias("subtitle"),
        F.when(F.coalesce(F.col("address"), F.lit("")) == "", F.lit(K.CARD_NA)).otherwise(F.col("address"))
         .alias("address_line"),
        fill(K.CARD_PLACE, js_text("city"), js_text("county"), js_text("zip")).alias("place_line"),
        display_or_na("pop_within_mile").alias("population"),
        F.when(F.coalesce(F.col("water_stress_index"), F.lit("")) == "", F.lit(K.CARD_NA))
         .otherwise(F.col("water_stress_index")).alias("water_stress"),
        water_class().alias("water_class"),
        display_or_na("capacity_mw", " MW").alias("capacity"),
        band.alias("capacity_band"),
        display_or_na("est_load_50_mw", " MW").alias("est_load_50"),
        display_or_na("annual_load_50_twh", " TWh").alias("annual_load"),
        households.alias("households"),
        fill(K.CARD_SCORE, F.col("web_score").cast("string")).alias("score_text"),
        "web_score", "web_tier", "web_colour", *pct)


def facility_markers(df: DataFrame, id_col: str = "facility_id") -> DataFrame:
    """Map markers; unknown-capacity markers draw first (layer 0) and
    sit below the others (z offset -1000)."""
    cap = F.col("capacity_mw")
    band, colour = capacity_band(cap)
    unknown = cap.isNull()
    return df.select(
        id_col, "lat", "lon", band.alias("capacity_band"), colour.alias("colour"),
        F.when(unknown, F.lit(K.UNKNOWN_MARKER_Z)).otherwise(F.lit(0)).alias("z_offset"),
        F.when(unknown, F.lit(0)).otherwise(F.lit(1)).alias("draw_layer")).orderBy("draw_layer", id_col)


def score_histogram(df: DataFrame, score_col: str = "web_score") -> DataFrame:
    """Facilities per score bin of width 5 over [0, 100], empty bins 0.
    The bin table is fixed (20 rows); counts are a map-side-combined
    aggregate joined to it."""
    lo, hi = K.HISTOGRAM_RANGE
    w = K.HISTOGRAM_BIN
    b = F.least(F.floor(F.col(score_col) / w) * w, F.lit(hi - w)).cast("int")
    # scores lie in [0, 75] by construction; no range filter (a filter on the
    # computed score would be pushed into the scan and re-evaluate it)
    counts = df.groupBy(b.alias("bin_start")).agg(
        F.count(F.lit(1)).alias("facilities"))
    bins = df.sparkSession.range(lo, hi, w).select(F.col("id").cast("int").alias("bin_start"))
    return (bins.join(counts, "bin_start", "left")
            .select("bin_start", (F.col("bin_start") + w).alias("bin_end"),
                    F.coalesce("facilities", F.lit(0).cast("bigint")).alias("facilities")))


def grid_breakdown(facilities: DataFrame | None = None, dc_load_mw: float = K.DC_LOAD_50_MW,
                   peak_mw: float = K.PEAK_SUMMER_MW, capacity_mw: float = K.GRID_CAPACITY_MW,
                   spark=None) -> DataFrame:
    """Facility load, the rest of the summer peak, remaining capacity,
    each with its share of the total. With ``facilities`` the facility load
    is ``sum(est_load_50_mw)`` of that table; otherwise ``dc_load_mw``. A facility
    load above the peak leaves nothing of the peak, and one above the
    capacity is the whole; no slice is ever negative."""
    if facilities is not None:
        dc = facilities.agg(F.coalesce(F.sum("est_load_50_mw"), dbl(0)).alias("dc"))
    else:
        dc = spark.createDataFrame([(float(dc_load_mw),)], "dc double")
    l1, l2, l3 = K.GRID_LABELS
    top = F.greatest(F.col("dc"), dbl(peak_mw))
    rows = F.array(
        F.struct(F.lit(1).alias("slice_no"), F.lit(l1).alias("label"), F.col("dc").alias("value_mw")),
        F.struct(F.lit(2).alias("slice_no"), F.lit(l2).alias("label"), (top - F.col("dc")).alias("value_mw")),
        F.struct(F.lit(3).alias("slice_no"), F.lit(l3).alias("label"), F.greatest(dbl(capacity_mw) - top, dbl(0)).alias("value_mw")))
    # the slices add up to the capacity, or to the facility load where that is larger
    total = F.greatest(F.col("dc"), dbl(capacity_mw)).alias("total")
    out = dc.select(total, F.inline(rows))
    return out.withColumn("share", F.col("value_mw") / F.col("total")).drop("total")

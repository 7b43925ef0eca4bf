"""Facility cleaning and the tax-exemption rubric, as native column logic.

Everything here is a per-row projection (no shuffle): the rubric that the
original ran as a Python row function is a sum of ``when`` chains, the
reason list an array expression, the breakdown an ``inline`` of eight
structs. Whole-stage codegen covers all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import banded, dbl, fill, fmt0, lenient_double, lenient_int, nan_to_null, row_max, thousands
from ..functions.wkb import with_point_xy

# --- cleaning ----------------------------------------------------------------------


def raw_columns() -> list[str]:
    """The columns that the raw facility table must have."""
    pairs = [K.FACILITY_ANNUAL_TWH, K.FACILITY_POPULATION, K.FACILITY_CO, K.FACILITY_WATER, K.FACILITY_YEAR]
    return [*K.FACILITY_TEXT_COLUMNS, *K.FACILITY_POWER_KW, *[src for src, _ in pairs], *K.FACILITY_EJ, "geometry"]


def clean_facilities(raw: DataFrame, counties: list[str] | None = None,
                     keep_geometry: bool = True) -> DataFrame:
    """``cleaned_va_datacenters``: typed facility rows in the focus counties.

    P6 kW text -> MW (commas stripped, lenient), P7 lenient integers,
    P8 pass-through identity and labels, lenient percentiles, P4 county
    filter (pushed down to the scan), P21/G1 lat/lon from the WKB point; the
    WKB ``geometry`` itself stays last unless ``keep_geometry`` is off.
    """
    c = lambda name: F.col(f"`{name}`")  # noqa: E731  (raw names hold blanks, %, parentheses)
    cols: list[Column] = []
    if "facility_id" in raw.columns:
        cols.append(c("facility_id"))
    cols += [c(n) for n in K.FACILITY_TEXT_COLUMNS]
    cols += [(lenient_double(c(src), strip_commas=True) / dbl(1000)).alias(dst)
             for src, dst in K.FACILITY_POWER_KW.items()]
    src, dst = K.FACILITY_ANNUAL_TWH
    cols.append(lenient_double(c(src), strip_commas=True).alias(dst))
    src, dst = K.FACILITY_POPULATION
    cols.append(lenient_int(c(src), strip_commas=True).alias(dst))
    src, dst = K.FACILITY_CO
    cols.append(lenient_double(c(src), strip_commas=True).alias(dst))
    src, dst = K.FACILITY_WATER
    cols.append(c(src).alias(dst))
    src, dst = K.FACILITY_YEAR
    cols.append(lenient_int(c(src)).alias(dst))
    cols += [lenient_double(c(src)).alias(dst) for src, dst in K.FACILITY_EJ.items()]
    cols += [F.col("lat"), F.col("lon")]
    if keep_geometry:
        cols.append(c("geometry"))
    focus = raw.filter(c("county").isin(counties or K.FOCUS_COUNTIES))
    return with_point_xy(focus, "geometry", x="lon", y="lat").select(cols)


# --- rubric (Python variant) --------------------------------------------------------------


def score_parts(df: DataFrame, ej_cols: list[str] | None = None) -> DataFrame:
    """Adds the four scored criteria: points, reason (NULL = none) and detail.

    Power 28, environmental justice 20, population 15, water 12; the other 25
    points are never awarded (no data). Missing percentiles count as no
    concern; missing population or capacity give 0 points with a reason;
    an unknown water label gives 0 points and no reason.
    """
    ej_cols = ej_cols or [c for c in df.columns if c.startswith("ej_")]
    cap = nan_to_null(F.col("capacity_mw").try_cast("double"))
    ejm = row_max(ej_cols)  # pandas max(axis=1): NULL/NaN skipped
    pop = F.col("pop_within_mile").try_cast("double")
    ws = F.col("water_stress_index")
    d = df.withColumn("capacity_numeric", cap).withColumn("ej_max_percentile", ejm)
    d = d.withColumn("ej_concern", F.coalesce(F.col("ej_max_percentile") >= dbl(K.EJ_CONCERN_PERCENTILE),
                                              F.lit(False)))
    cap, ejm = F.col("capacity_numeric"), F.col("ej_max_percentile")
    none = F.lit(None).cast("string")
    w_lo, w_mid, w_hi = K.DETAIL_WATER
    concern = F.col("ej_concern")
    return d.select(
        "*",
        banded(cap, K.POWER_BANDS, 0, True).alias("power_points"),
        F.when(cap.isNull(), F.lit(K.REASON_NO_CAPACITY))
         .when(cap > K.POWER_BANDS[-1][0], fill(K.REASON_HIGH_CAPACITY, fmt0(cap))).alias("power_reason"),
        F.when(cap.isNull(), F.lit(K.DETAIL_NO_DATA)).otherwise(banded(
            cap, [(b, fill(x, fmt0(cap))) for (b, _), x in zip(K.POWER_BANDS, K.DETAIL_POWER)],
            fill(K.DETAIL_POWER[-1], fmt0(cap)), True)).alias("power_detail"),
        F.when(concern, 0).otherwise(K.EJ_POINTS).alias("ej_points"),
        F.when(concern, fill(K.REASON_EJ, fmt0(ejm))).alias("ej_reason"),
        F.when(concern, fill(K.DETAIL_EJ_FLAG, fmt0(ejm))).otherwise(F.lit(K.DETAIL_EJ_OK)).alias("ej_detail"),
        banded(pop, K.POPULATION_BANDS, 0, False).alias("pop_points"),
        F.when(pop.isNull(), F.lit(K.REASON_NO_POPULATION)).otherwise(banded(
            pop, [(b, x) for (b, _), x in zip(K.POPULATION_BANDS, (
                none, fill(K.REASON_POPULATION, fmt0(pop)), fill(K.REASON_POPULATION_HIGH, fmt0(pop))))],
            fill(K.REASON_POPULATION_VERY_HIGH, fmt0(pop)), False)).alias("pop_reason"),
        F.when(pop.isNull(), F.lit(K.DETAIL_NO_DATA)).otherwise(banded(
            pop, [(b, fill(x, thousands(pop))) for (b, _), x in zip(K.POPULATION_BANDS, K.DETAIL_POPULATION)],
            fill(K.DETAIL_POPULATION[-1], thousands(pop)), False)).alias("pop_detail"),
        F.when(ws.isin(K.WATER_LOW), K.WATER_LOW_POINTS).when(ws == K.WATER_MEDIUM_HIGH, K.WATER_MEDIUM_HIGH_POINTS)
         .otherwise(0).alias("water_points"),
        F.when(ws.isin(K.WATER_LOW), none).when(ws == K.WATER_MEDIUM_HIGH, F.lit(K.REASON_WATER_MEDIUM_HIGH))
         .when(ws.isin(K.WATER_HIGH), fill(K.REASON_WATER_HIGH, ws)).alias("water_reason"),
        F.when(ws.isin(K.WATER_LOW), fill(w_lo, ws)).when(ws == K.WATER_MEDIUM_HIGH, fill(w_mid, ws))
         .when(ws.isin(K.WATER_HIGH), fill(w_hi, ws)).otherwise(F.lit(K.DETAIL_NO_DATA)).alias("water_detail"),
    )


def tier(score: Column) -> Column:
    """Full (>= 80, unreachable: the maximum is 75), Partial (>= 60), No."""
    return (F.when(score >= K.TIER_FULL[0], F.lit(K.TIER_FULL[1]))
            .when(score >= K.TIER_PARTIAL[0], F.lit(K.TIER_PARTIAL[1]))
            .otherwise(F.lit(K.TIER_NONE)))


def exemption_scores(df: DataFrame) -> DataFrame:
    """``exemption_score``, ``exemption_tier`` and ``failing_criteria``
    (the reasons in rubric order, then the four fixed no-data lines)."""
    d = score_parts(df)
    score = F.col("power_points") + F.col("ej_points") + F.col("pop_points") + F.col("water_points")
    reasons = F.concat(
        F.array_compact(F.array("power_reason", "ej_reason", "pop_reason", "water_reason")),
        F.array(*[F.lit(r) for _, _, r in K.UNSCORED_CATEGORIES]))
    return (d.withColumn("exemption_score", score)
            .withColumn("exemption_tier", tier(F.col("exemption_score")))
            .withColumn("failing_criteria", reasons))


def score_breakdown(scored: DataFrame, id_col: str = "facility_id") -> DataFrame:
    """eight rows per facility: category, points, max points, detail,
    whether the category is scored, and the facility total."""
    parts = list(zip(K.SCORED_CATEGORIES, ["power_points", "ej_points", "pop_points", "water_points"],
                     [K.POWER_POINTS, K.EJ_POINTS, K.POPULATION_POINTS, K.WATER_POINTS],
                     ["power_detail", "ej_detail", "pop_detail", "water_detail"]))
    structs = [F.struct(F.lit(i + 1).alias("category_no"), F.lit(name).alias("category"),
                        F.col(pts).alias("points"), F.lit(mx).alias("max_points"),
                        F.col(det).alias("detail"), F.lit(True).alias("scored"))
               for i, (name, pts, mx, det) in enumerate(parts)]
    structs += [F.struct(F.lit(5 + i).alias("category_no"), F.lit(name).alias("category"),
                         F.lit(0).alias("points"), F.lit(mx).alias("max_points"),
                         F.lit(K.UNSCORED_DETAIL).alias("detail"), F.lit(False).alias("scored"))
                for i, (name, mx, _) in enumerate(K.UNSCORED_CATEGORIES)]
    return scored.select(id_col, F.col("exemption_score").alias("total_points"),
                         F.inline(F.array(*structs)))


def key_issues(scored: DataFrame, id_col: str = "facility_id") -> DataFrame:
    """Failing criteria minus the four fixed no-data lines, one row
    per remaining issue with its 1-based position."""
    markers = K.UNSCORED_ISSUE_MARKERS
    keep = F.filter("failing_criteria",
                    lambda x: ~F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(x, m)))
    return (scored.select(id_col, F.posexplode(keep).alias("pos", "issue"))
            .select(id_col, (F.col("pos") + 1).alias("issue_no"), "issue"))


def reasons_rows(scored: DataFrame, id_col: str = "facility_id") -> DataFrame:
    """F6 as rows: one per reason with its 1-based position."""
    return (scored.select(id_col, F.posexplode_outer("failing_criteria").alias("pos", "reason"))  # never empty; outer: no size filter to push
            .select(id_col, (F.col("pos") + 1).alias("reason_no"), "reason"))


def facility_label(df: DataFrame) -> Column:
    """``row.get('brand', row.get('company', 'Unknown Facility'))`` - the
    choice depends on which columns exist; a NULL brand is kept as NULL."""
    if "brand" in df.columns:
        return F.col("brand")
    if "company" in df.columns:
        return F.col("company")
    return F.lit(K.UNKNOWN_FACILITY)


def sample_breakdown(sample: DataFrame, scored: DataFrame, id_col: str = "facility_id") -> DataFrame:
    """The scoring script's report: for each sampled facility (at most five
    rows, broadcast) its eight category rows with points and detail. Pass the
    scores of the sampled facilities only (``scored`` of a filtered table)."""
    rows = score_breakdown(scored, id_col)
    return rows.join(F.broadcast(sample.select("sample_no", id_col, "label", "county", "exemption_tier")), id_col)

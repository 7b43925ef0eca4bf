"""Reusable column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(x: float) -> Column:
    """A DOUBLE literal (a plain ``10.0`` would become DECIMAL in SQL)."""
    return F.lit(float(x)).cast("double")


def null_double() -> Column:
    return F.lit(None).cast("double")


# --- time -------------------------------------------------------------------

def trunc_hour(ts: str | Column) -> Column:
    """Hour start of a TIMESTAMP_NTZ, time-zone free, result stays NTZ.

    The whole hours since the first day of year 1 (an interval between zone-free times has no zone
    either), so that a parse inside ``ts`` is evaluated once."""
    start = F.expr("TIMESTAMP_NTZ'0001-01-01 00:00:00'")
    return start + (col(ts) - start).cast("interval day to hour")


def trunc_day(ts: str | Column) -> Column:
    """Midnight of a TIMESTAMP_NTZ as TIMESTAMP_NTZ (``date_trunc('day')``)."""
    return F.to_date(col(ts)).cast("timestamp_ntz")


# --- text -> numbers -------------------------------------------------------------

def strict_cast(c: str | Column, to: str, what: str = "value") -> Column:
    """CAST that raises on malformed text regardless of the session's ANSI mode."""
    x = col(c)
    return F.coalesce(x.try_cast(to), _malformed(x, what))


def _malformed(x: Column, what: str) -> Column:
    """NULL for a NULL, an error for any other value: the last branch of a strict cast."""
    return F.when(x.isNotNull(), F.raise_error(F.concat(F.lit(f"malformed {what}: "), x)))


def strict_observation_time(c: str | Column) -> Column:
    """Observation time text as TIMESTAMP_NTZ; raises on a year or month alone and on an
    hour without minutes, which Spark's own cast would fill up. Text with a colon is neither, so
    the pattern is tried on other text only."""
    x = col(c)
    whole = F.when((F.instr(x, ":") > 0) | ~x.rlike(r"^\s*\d+(-\d+)?\s*$|[T ]\d+\s*$"), x)
    return F.coalesce(whole.try_cast("timestamp_ntz"), _malformed(x, "observation time"))


def strict_double(c: str | Column, what: str = "value") -> Column:
    """CAST(x AS DOUBLE), strict."""
    return strict_cast(c, "double", what)


def strict_timestamp(c: str | Column, fmt: str, what: str = "period") -> Column:
    """Format parse that raises on a mismatch (like STRPTIME), result NTZ."""
    x = col(c)
    # raises by itself in ANSI mode, gives NULL otherwise
    return F.coalesce(F.to_timestamp_ntz(x, F.lit(fmt)), _malformed(x, what))


def _numeric_text(c: str | Column, strip_commas: bool) -> Column:
    x = col(c)
    if strip_commas:
        x = F.replace(x, F.lit(","), F.lit(""))
    # digit-group underscores ('1_000') are accepted by the original engine's
    # casts; the regex only runs on text that has an underscore at all
    return F.when(F.instr(x, "_") > 0, F.regexp_replace(x, r"(\d)_(?=\d)", "$1")).otherwise(x)


def lenient_double(c: str | Column, strip_commas: bool = False) -> Column:
    """TRY_CAST(x AS DOUBLE), optionally after removing thousands commas."""
    return _numeric_text(c, strip_commas).try_cast("double")


def lenient_int(c: str | Column, strip_commas: bool = False) -> Column:
    """TRY_CAST(x AS INTEGER) with rounding of decimal text.

    ``'1234.7' -> 1235``, ``'2.5' -> 3``, ``'-2.5' -> -3``, ``'1e3' -> 1000``,
    ``'0x10' -> 16``, ``'1_000' -> 1000``, junk -> NULL. Spark's own
    ``try_cast(.. AS INT)`` gives NULL for the decimal forms, so the text is
    parsed as DECIMAL and rounded half away from zero.
    """
    x = F.trim(_numeric_text(c, strip_commas))
    # exact decimal rounding of the text, half away from zero ('3.4999999999999999' -> 3)
    # (scale 28 keeps the whole fraction and still 10 integer digits: the INT range)
    dec = F.when(x.rlike("^[ -~]*$"),  # ASCII only: Java would also read other scripts' digits
                 F.round(x.try_cast("decimal(38,28)")).try_cast("int"))
    hexa = F.when(x.rlike(r"^[+-]?0[xX][0-9a-fA-F]+$"),
                  F.conv(F.regexp_replace(x, r"^([+-]?)0[xX]", "$1"), 16, 10).try_cast("int"))
    return F.coalesce(dec, hexa)


def decode_tmp(c: str | Column) -> Column:
    """Packed NOAA temperature ``'+0123,1'`` -> 12.3 (DOUBLE, degrees C).

    First comma field, decimal text rounded; the ``+9999`` sentinel and unparsable text give NULL;
    the quality code (second field) is ignored.
    """
    field = F.substring_index(col(c), ",", 1)  # the same as a split's first part, and cheaper
    return (F.when(field == F.lit(K.TMP_MISSING), null_double())
            .otherwise(F.coalesce(field.try_cast("int"), lenient_int(field)).cast("double") / dbl(K.TMP_SCALE)))


def station_code(c: str | Column, ids: dict[str, str] | None = None) -> Column:
    """NOAA station id -> readable code; unknown ids pass through as text."""
    x = col(c).cast("string")
    expr = None
    for code, sid in (ids or K.STATION_IDS).items():
        expr = (F.when(x == F.lit(sid), F.lit(code)) if expr is None
                else expr.when(x == F.lit(sid), F.lit(code)))
    return expr.otherwise(x)


# --- NULL / NaN -------------------------------------------------------------------

def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL (Spark orders NaN above every number; pandas skips it)."""
    return F.nanvl(col(c), null_double())


def is_finite(c: str | Column) -> Column:
    x = col(c)
    return (x.isNotNull() & ~F.isnan(x)
            & (x != F.lit(float("inf"))) & (x != F.lit(float("-inf"))))


def row_max(cols: list[str]) -> Column:
    """Row-wise max over columns, NULL/NaN skipped, NULL when all missing."""
    return F.greatest(*[nan_to_null(c) for c in cols])


def banded(value: Column, bands: list[tuple[float, object]], last, inclusive: bool) -> Column:
    """The entry of the first band that ``value`` lies in (bounds ascending), else ``last``. NULL
    values take ``last`` too."""
    out = None
    for bound, entry in bands:
        test = value <= bound if inclusive else value < bound
        out = F.when(test, entry) if out is None else out.when(test, entry)
    return out.otherwise(last)


# --- display formatting ----------------------------------------------------------

def fmt0(c: str | Column) -> Column:
    """Python ``f'{x:.0f}'``: round half to even, integer text."""
    return F.bround(col(c), 0).cast("bigint").cast("string")


def js_round(c: str | Column) -> Column:
    """JavaScript ``Math.round``: halves go up (towards +infinity)."""
    return F.floor(col(c) + dbl(0.5))


def thousands(c: str | Column) -> Column:
    """Integer with thousands separators (``12345 -> '12,345'``)."""
    return F.format_number(col(c).cast("bigint"), 0)


def locale_number(c: str | Column) -> Column:
    """en-US ``Number.toLocaleString()``: grouping, at most 3 decimals."""
    return F.call_function("format_number", F.round(col(c).cast("double"), 3), F.lit("#,##0.###"))


def display_or_na(c: str | Column, suffix: str = "") -> Column:
    """``fmt(val, suffix)`` of the dashboard: number text + suffix or 'N/A'."""
    x = col(c)
    return F.when(x.isNull(), F.lit(K.CARD_NA)).otherwise(F.concat(locale_number(x), F.lit(suffix)))


def js_text(c: str | Column) -> Column:
    """``${value}`` in a JavaScript template: NULL prints as 'null'."""
    return F.coalesce(col(c).cast("string"), F.lit(K.CARD_NULL))


def fill(template: str, *values: str | Column) -> Column:
    """Text template with ``{}`` slots filled by column values (concat)."""
    parts = template.split("{}")
    assert len(parts) == len(values) + 1, template
    out: list[Column] = []
    for text, v in zip(parts, list(values) + [None]):
        if text:
            out.append(F.lit(text))
        if v is not None:
            out.append(col(v))
    return F.concat(*out)


def replace_first(s: str | Column, old: str, new: str) -> Column:
    """JavaScript ``str.replace(old, new)`` with a string pattern (first hit)."""
    x = col(s)
    pos = F.instr(x, old)  # 1-based, 0 when absent
    head = F.substring_index(x, old, 1)
    tail = F.substr(x, pos + F.lit(len(old)))
    return F.when(pos == 0, x).otherwise(F.concat(head, F.lit(new), tail))

"""Many weather CSV files whose header sets differ, unioned by name, and their types.

A single ``spark.read.csv`` over mixed files maps columns by position and
silently shifts values, so files are grouped by their header line (read and grouped by
executors, see ``files.files_by_header``) and each group is read with an all-string schema in its
own column order; the groups are then unioned by column name, missing columns becoming NULL.
Production types come from the explicit decode step (P1-P3); ``detect_types`` finds the narrowest
type of every column over all rows of all files.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.columns import strict_cast
from .files import files_by_header


def _group_by_header(spark: SparkSession, pattern: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """Files by column names. A blank first line is an error: the file's columns are unknown."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for line, files in files_by_header(spark, pattern).items():
        if not line.strip():
            raise ValueError(f"blank header line in {files[0]}")
        header = tuple(next(csv.reader([line])))
        if len({c.lower() for c in header}) < len(header):
            raise ValueError(f"the header of {files[0]} repeats a column name: {header}")
        groups.setdefault(header, []).extend(files)
    return groups


def read_csv_union(spark: SparkSession, pattern: str | list[str], columns: list[str] | None = None,
                   require: bool = True, line_feeds: bool = True) -> DataFrame:
    """All files matching ``pattern`` (or the given list of files), aligned by
    header name without regard to case.

    ``columns`` narrows the result to those names (the weather decode needs
    STATION, DATE, TMP). A file without one of them gives NULL there; a column
    that no file has is an error unless ``require`` is off (a micro-batch may
    hold such files only). Quotes are doubled inside quoted fields. Quoted
    fields may hold line feeds, which makes a file one task: landed files are
    station-years, a few megabytes each. ``line_feeds=False`` splits larger files over tasks; a field
    with a line feed then raises.
    """
    groups = _group_by_header(spark, pattern) if pattern else {}
    if not groups:
        if isinstance(pattern, list) and columns:  # e.g. a micro-batch of empty files
            return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))
        raise FileNotFoundError(f"no CSV files with a header match {pattern}")
    names: dict[str, str] = {c.lower(): c for c in columns or []}
    for header in sorted(groups):
        for c in header:
            names.setdefault(c.lower(), c)
    present = {c.lower() for header in groups for c in header}
    absent = [c for c in columns or [] if c.lower() not in present]
    if absent and require:
        raise ValueError(f"no file has the columns {absent}")
    parts = []
    for header, found in sorted(groups.items()):
        schema = StructType([StructField(names[c.lower()], StringType()) for c in header])
        df = (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", True)
              .option("quote", '"').option("escape", '"').option("multiLine", line_feeds).csv(sorted(found)))
        if columns:
            have = set(schema.names)
            df = df.select([F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in columns])
        parts.append(df)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# --- S2: the narrowest type of each column over all files ------------------------------------

_DAY, _CLOCK, _ZONE = r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?", r"\s?(Z|[+-]\d{2}(:?\d{2})?)"
# FIXED VALUES: the words that count as booleans
BOOLEANS = ["true", "false", "t", "f", "yes", "no"]


def _readings(x: Column) -> dict[str, Column]:
    """For a text without blanks around it: by type, whether it can be read as that type. Whole numbers
    with a plus sign or leading zeros are text (an id keeps them); both kinds of time are timestamps."""
    def castable(pattern: str, to: str) -> Column:
        return F.coalesce(F.when(x.rlike(f"^({pattern})$"), x.try_cast(to)).isNotNull(), F.lit(False))
    number = r"-?(0|[1-9]\d*)(\.\d*)?([eE][+-]?\d+)?|-?\.\d+([eE][+-]?\d+)?"
    return {
        "BOOLEAN": F.lower(x).isin(BOOLEANS),
        "BIGINT": castable(r"-?(0|[1-9]\d*)", "bigint"),
        "DOUBLE": castable(number, "double"),
        "TIME": x.rlike(f"^([01]?\\d|2[0-3]):[0-5]\\d(:[0-5]\\d(\\.\\d+)?)?$"),
        "DATE": castable(_DAY, "date"),
        "TIMESTAMP": castable(f"{_DAY}([T ]{_CLOCK})?", "timestamp_ntz"),
        "TIMESTAMP WITH TIME ZONE": castable(f"{_DAY}([T ]{_CLOCK}({_ZONE})?)?", "timestamp"),
    }


def detect_types(rows: DataFrame) -> DataFrame:
    """``column_name``, ``column_type`` of an all-text table: the first type in the order of ``_readings``
    as which every value can be read, else VARCHAR. DATE widens to TIMESTAMP, BIGINT to DOUBLE;
    any other mixture is VARCHAR, as is a column without a value. Empty fields are missing values.

    One aggregate over all rows: a count per column and type, combined before its one-row shuffle."""
    counts, kinds = [], list(_readings(F.lit("")))
    for i, c in enumerate(rows.columns):
        x = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        counts.append(F.count(x).alias(f"n{i}"))
        counts += [F.count_if(test).alias(f"n{i}_{k}") for k, test in enumerate(_readings(x).values())]
    one = rows.agg(*counts)
    found = []
    for i, c in enumerate(rows.columns):
        n = F.col(f"n{i}")
        kind = F.when(n == 0, "VARCHAR")
        for k, name in enumerate(kinds):
            kind = kind.when(F.col(f"n{i}_{k}") == n, name)
        found.append(F.struct(F.lit(c).alias("column_name"), kind.otherwise("VARCHAR").alias("column_type")))
    return one.select(F.inline(F.array(*found)))


SPARK_TYPES = {"BOOLEAN": "boolean", "BIGINT": "bigint", "DOUBLE": "double", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
               "TIMESTAMP WITH TIME ZONE": "timestamp"}


def read_csv_typed(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """``read_csv_union`` with every column in its detected type (a TIME stays text)."""
    rows = read_csv_union(spark, pattern)
    types = {r.column_name: SPARK_TYPES.get(r.column_type) for r in detect_types(rows).collect()}  # a row per column
    out = []
    for c in rows.columns:
        x = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        out.append((strict_cast(x, types[c], c) if types[c] else F.col(f"`{c}`")).alias(c))
    return rows.select(out)


def write_csv(df: DataFrame, path: str) -> None:
    """Land rows as CSV files with a header line (one file per partition); quotes
    inside fields are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

"""Output normalisation shared by every registered query.

Doubles are rounded (Spark's ``round`` and DuckDB's agree on every probed
value, half away from zero on the shortest decimal form) and a rounded
negative zero becomes 0.0, and DATE columns are emitted as midnight
TIMESTAMP_NTZ, so an independent engine can compare values.
Only registered query outputs are rounded; library tables keep full values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType


def rounded(df: DataFrame, digits: int = 6, per_column: dict[str, int] | None = None) -> DataFrame:
    per_column = per_column or {}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            r = F.round(c.cast("double"), per_column.get(f.name, digits))
            c = F.when(r == 0, F.lit(0.0)).otherwise(r)
        elif isinstance(f.dataType, DateType):
            c = c.cast("timestamp_ntz")  # pandas maps DuckDB DATE to datetime64 too
        out.append(c.alias(f.name))
    return df.select(out)

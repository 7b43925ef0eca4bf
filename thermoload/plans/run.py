"""Command-line build from landed files (launched by ``run_build.py``).

    spark-submit --py-files thermoload.zip run_build.py \\
        --weather '/landing/noaa/*.csv' --load-pages /landing/eia --facilities /landing/dc.parquet \\
        --out /shared/thermoload

Reads the landed weather CSV files (grouped by header, unioned by name), the
load-API page files and the raw facility table (Parquet, or CSV whose
``geometry`` column holds WKB as hex), runs every build step and prints the
row count of each written table as one JSON object.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import build_session
from ..operators.facilities import raw_columns
from ..sources.json_sources import ensure_not_empty, read_load_pages, require_columns, require_page_keys
from ..sources.weather_csv import read_csv_union
from ..streaming.landed_weather import WEATHER_COLUMNS
from .build import build_all


def read_facilities(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "parquet":
        return require_columns(spark.read.parquet(path), raw_columns())
    df = require_columns(read_csv_union(spark, path), raw_columns())  # every column as text, files aligned by name
    return df.withColumn("geometry", F.unhex(F.col("geometry")))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, int]:
    ap = argparse.ArgumentParser(description=__doc__.split("\n\n")[0])
    ap.add_argument("--weather", required=True, help="glob of landed weather CSV files")
    ap.add_argument("--load-pages", required=True, help="folder of landed load-API pages")
    ap.add_argument("--pages-multiline", action="store_true", help="one pretty-printed page per file")
    ap.add_argument("--facilities", required=True, help="raw facility table")
    ap.add_argument("--facilities-format", choices=["parquet", "csv"], default="parquet")
    ap.add_argument("--out", required=True, help="shared output folder")
    ap.add_argument("--database", help="catalog database whose views follow the tables")
    a = ap.parse_args(argv)

    spark = spark or build_session()
    noaa = read_csv_union(spark, a.weather, columns=WEATHER_COLUMNS)
    require_page_keys(spark, a.load_pages, multi_line=a.pages_multiline)
    load = ensure_not_empty(read_load_pages(spark, a.load_pages, a.pages_multiline), "the load pages")
    fac = read_facilities(spark, a.facilities, a.facilities_format)
    counts = build_all(spark, noaa, load, fac, a.out.rstrip("/"), a.database)
    print(json.dumps(counts, sort_keys=True))
    return counts


if __name__ == "__main__":
    main()

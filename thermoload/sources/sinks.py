"""S8 replace-table sink, S10 table listing and A9 row audit.

A table at ``path`` is a folder of versions (``_v<number>-<id>``). A new version is written
beside the others and counts only from the moment its marker file exists; creating that file is
the swap, on any file system and without a rename. A job that stops anywhere before leaves the old
version in place. ``read_table`` reads the newest version with a marker; the one
before it is kept for readers that have already planned their scan, older ones are deleted. The
folders' names start with an underscore, so reading ``path`` itself fails instead of mixing versions.
For SQL users a catalog view can follow the swap (``view``): one replacement of its definition.

Sorted tables are rebalanced by their partition columns before the write: the input is computed
once (no sampling of key ranges), adaptive execution splits a year that holds most rows over
tasks and merges small ones, and every file is sorted. The row count of every written table is taken during the write itself
with ``DataFrame.observe``, so auditing costs no second pass over the data.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .files import _fs, delete, exists

_MARKER = "_published"
_VERSION = re.compile(r"_v(\d{8})-[0-9a-f]+")


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool, str]]:
    """(number, published, folder) of every version, oldest first; equal numbers of two writers order by name."""
    p, fs = _fs(spark, path)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    found = sorted((int(m[1]), m[0]) for m in map(_VERSION.fullmatch, names) if m)
    return [(n, exists(spark, f"{path}/{name}/{_MARKER}"), f"{path}/{name}") for n, name in found]


def table_location(spark: SparkSession, path: str) -> str:
    """The folder of the table's current version."""
    published = [folder for _, done, folder in _versions(spark, path.rstrip("/")) if done]
    if not published:
        raise FileNotFoundError(f"no table at {path}")
    return published[-1]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of the table at ``path``."""
    return spark.read.parquet(table_location(spark, path))


def stage_table(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_within: list | None = None) -> tuple[str, int]:
    """Write ``df`` as a version of its own that nobody reads yet: (folder, rows)."""
    spark, path = df.sparkSession, path.rstrip("/")
    number = max((n for n, *_ in _versions(spark, path)), default=0) + 1
    folder = f"{path}/_v{number:08d}-{uuid.uuid4().hex[:12]}"
    obs = Observation(f"rows-{uuid.uuid4().hex}")
    out = df
    if sort_within:
        # partition columns first: the writer then keeps this order in every folder
        out = (out.hint("rebalance", *(partition_by or []))
               .sortWithinPartitions(*(partition_by or []), *sort_within))
    w = out.observe(obs, F.count(F.lit(1)).alias("rows")).write  # counted by the writing tasks: a repeated shuffle counts once
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(folder)
    return folder, int(obs.get["rows"])


def publish_table(spark: SparkSession, path: str, folder: str, view: str | None = None) -> None:
    """Make a staged version the current one, and point the catalog view at it."""
    path = path.rstrip("/")
    p, fs = _fs(spark, f"{folder}/{_MARKER}")
    fs.create(p).close()
    if view:
        spark.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM parquet.`{folder}`")
    versions = _versions(spark, path)
    published = [v for v in versions if v[1]]
    for n, _, old in versions:
        if len(published) > 1 and n < published[-2][0]:
            delete(spark, old)


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_within: list | None = None,
                  view: str | None = None) -> int:
    """DROP + CREATE TABLE AS: replace the table at ``path`` with ``df``; returns its row
    count (observed while writing)."""
    folder, rows = stage_table(df, path, partition_by, sort_within)
    publish_table(df.sparkSession, path, folder, view)
    return rows


def register_tables(spark: SparkSession, root: str, names: list[str]) -> None:
    """Expose written tables as temporary views (queryable with SQL)."""
    for n in names:
        read_table(spark, f"{root}/{n}").createOrReplaceTempView(n)


def list_tables(spark: SparkSession) -> list[str]:
    """``SHOW TABLES`` of the current session."""
    return sorted(t.name for t in spark.catalog.listTables())


def row_audit(spark: SparkSession, counts: dict[str, int], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(table_name, rows) of counts that were observed while tables were written, which are
    neither computed nor read again, and of ``tables`` to be counted now."""
    out = spark.createDataFrame(sorted(counts.items()), "table_name string, rows bigint")
    for n, df in (tables or {}).items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows"))
    return out

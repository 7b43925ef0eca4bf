"""File listing, and header lines read by executors.

Works for any filesystem Spark can read (local, HDFS, object stores). No file is
opened by the driver: listings come from the Hadoop FileSystem or from Spark's own file index,
header lines from a job over the files.
"""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_FILE = 1 << 20  # files up to here are read whole for their header line
ONE_A_TASK = str(1 << 36)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files matching a glob; folders are followed to any depth. Names that
    start with ``_`` or ``.`` are skipped, as Spark's own readers do."""
    p, fs = _fs(spark, pattern)
    todo, out = list(fs.globStatus(p) or []), []
    while todo:
        st = todo.pop()
        if st.isDirectory():
            todo += [c for c in fs.listStatus(st.getPath()) if not c.getPath().getName().startswith(("_", "."))]
        else:
            out.append(st.getPath().toString())
    return sorted(out)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def files_by_header(spark: SparkSession, pattern: str | list[str]) -> dict[str, list[str]]:
    """The files matching ``pattern`` by their first line (without byte order mark); files
    without a byte are left out. Lines are read and grouped by executors; the driver sees a row per
    distinct line (and kind of file), with the names of its files.

    Files up to ``SMALL_FILE`` are read whole, many to a task. A larger file gets a task of its own,
    which stops after the first rows: what it reads does not grow with the file."""
    try:
        landed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    text = F.substring_index(F.substring_index(F.col("content").cast("string"), "\n", 1), "\r", 1)
    small = landed.filter(f"length > 0 AND length <= {SMALL_FILE}").select("path", text.alias("line"))
    groups = _grouped(small)
    large = [r.path for r in landed.filter(f"length > {SMALL_FILE}").select("path").collect()]  # names only
    if large:
        def first_row(batches):
            for b in batches:
                if b.num_rows and b.column(2)[0].as_py() == 0:  # not a later part of a huge file
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), b.column(1).slice(0, 1)],
                                                     names=["path", "line"])
                return
        own = spark.newSession()  # these settings hold for this read only
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            own.conf.set(k, ONE_A_TASK)
        own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        lines = own.read.text(large).select(F.col("_metadata.file_path").alias("path"), "value",
                                            F.col("_metadata.file_block_start").alias("start"))
        for line, paths in _grouped(lines.mapInArrow(first_row, "path string, line string")).items():
            groups.setdefault(line, []).extend(unquote(x) for x in paths)  # this column is percent-encoded
    return {line: sorted(paths) for line, paths in groups.items()}


def _grouped(lines: DataFrame) -> dict[str, list[str]]:
    rows = lines.groupBy(F.regexp_replace("line", "^\ufeff", "").alias("line")).agg(F.collect_list("path").alias("paths"))
    return {r.line: list(r.paths) for r in rows.collect()}

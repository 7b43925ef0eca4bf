"""Incremental ingest of landed weather CSV files (Structured Streaming).

The reference re-downloads only files that are not yet on disk and then
rebuilds its tables. The streaming equivalent: a file source over the landing
folder picks up only files it has not seen (tracked in the checkpoint), and
the observations are decoded exactly like the batch path.

The hourly mean is kept without streaming state: every micro-batch reduces
its own rows to per (station, hour) partial sums and counts and writes them
to a folder named by the checkpoint and the batch id: a replayed batch
overwrites its own folder, so output is exactly-once. A new checkpoint would
read all landed files again, so it is refused on a table that another
checkpoint has written. The hourly table is the merge of all
partials, ``sum(sums) / sum(counts)``. ``compact_partials`` merges finished batches into one
table, so that a reader does not merge every batch ever written. Late files (a whole station-year can
land after later years) need no watermark, no state store grows with the
history, and each trigger writes only its own partials.

New files are discovered with the ``binaryFile`` source selecting only the
path (Spark then does not read the content); each micro-batch reads its own
files through the batch union-by-name reader, so landings whose header sets
differ (columns added, reordered or missing) are aligned by name, exactly as
in the batch build. ``max_files_per_trigger`` bounds a micro-batch.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from ..functions.columns import trunc_hour
from ..operators.hourly import decode_weather
from ..sources.files import delete, list_files
from ..sources.sinks import read_table, replace_table
from ..sources.weather_csv import read_csv_union

WEATHER_COLUMNS = ["STATION", "DATE", "TMP"]
BINARY_FILE = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()),
                          StructField("length", LongType()), StructField("content", BinaryType())])


def landed_files(spark: SparkSession, landing_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Stream of newly landed file paths (contents are not read here)."""
    return (spark.readStream.format("binaryFile").schema(BINARY_FILE)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(landing_dir).select("path"))


def observations(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    """Decoded observations of the given files (station, ts_utc, temp_C)."""
    return decode_weather(read_csv_union(spark, paths, columns=columns or WEATHER_COLUMNS, require=False))


def hourly_partials(obs: DataFrame) -> DataFrame:
    """Per (station, hour): sum and count of the non-NULL temperatures."""
    return (obs.groupBy("station", trunc_hour("ts_utc").alias("hour_utc"))
            .agg(F.sum("temp_C").alias("temp_sum"), F.count("temp_C").alias("temp_n")))


def _run_name(checkpoint_dir: str) -> str:
    return hashlib.sha256(checkpoint_dir.rstrip("/").encode()).hexdigest()[:16]


def start_hourly_ingest(spark: SparkSession, landing_dir: str, table_path: str, checkpoint_dir: str,
                        available_now: bool = True, max_files_per_trigger: int = 1000,
                        columns: list[str] | None = None) -> StreamingQuery:
    """Run the stream; ``available_now`` processes what has landed and stops,
    otherwise it triggers every minute. A micro-batch holds at most
    ``max_files_per_trigger`` paths, the only rows brought to the driver."""
    others = [f for f in list_files(spark, f"{table_path}/partials/run=*")
              if f"/run={_run_name(checkpoint_dir)}/" not in f]
    if others:
        raise ValueError(f"{table_path} was written with another checkpoint; its rows would count twice")
    run = _run_name(checkpoint_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.collect()]
        if paths:
            out = hourly_partials(observations(spark, paths, columns))
            out.write.mode("overwrite").parquet(f"{table_path}/partials/run={run}/batch={batch_id}")

    w = (landed_files(spark, landing_dir, max_files_per_trigger).writeStream
         .option("checkpointLocation", checkpoint_dir).foreachBatch(write_batch))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("station", "hour_utc").agg(F.sum("temp_sum").alias("temp_sum"), F.sum("temp_n").alias("temp_n"))


def _partials(spark: SparkSession, table_path: str, last: int | None = None) -> DataFrame:
    """Sums and counts of all batches up to ``last``: the compacted ones, and those after them."""
    cols = ["station", "hour_utc", "temp_sum", "temp_n"]
    later = spark.read.parquet(f"{table_path}/partials")
    if last is not None:
        later = later.filter(F.col("batch") <= last)
    try:
        base = read_table(spark, f"{table_path}/compacted")
    except FileNotFoundError:
        return later.select(cols)
    upto = base.agg(F.max("upto")).first()[0]
    return base.select(cols).unionByName(later.filter(F.col("batch") > upto).select(cols))


def compact_partials(spark: SparkSession, table_path: str) -> int | None:
    """Merge all batches but the newest, which a restarted query may write again, into one table; returns the
    last batch that it holds (None: nothing to merge). The swap is the table's (``sinks``): a job that stops anywhere leaves
    every batch counted once, because the batches that the table names are no longer looked at."""
    later = spark.read.parquet(f"{table_path}/partials")
    newest = later.agg(F.max("batch")).first()[0]
    upto = newest - 1
    try:
        done = read_table(spark, f"{table_path}/compacted").agg(F.max("upto")).first()[0]
    except FileNotFoundError:
        done = -1
    if upto <= done:
        return None if done < 0 else done
    replace_table(_merged(_partials(spark, table_path, upto)).withColumn("upto", F.lit(upto)), f"{table_path}/compacted", sort_within=["station", "hour_utc"])
    for folder in {f.rsplit("/", 1)[0] for f in list_files(spark, f"{table_path}/partials")}:
        if int(folder.rsplit("batch=", 1)[1]) <= upto:
            delete(spark, folder)
    return upto


def hourly_table(spark: SparkSession, table_path: str) -> DataFrame:
    """``noaa_hourly_avg`` from all partials written so far. An hour whose
    readings are all NULL keeps a NULL mean, as in the batch build."""
    return _merged(_partials(spark, table_path)).select(
        "station", "hour_utc", F.when(F.col("temp_n") > 0, F.col("temp_sum") / F.col("temp_n")).alias("temp_C"))

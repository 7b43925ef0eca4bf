"""Spark session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC labels, ANSI casts (strict casts raise),
# AQE for runtime re-planning (coalescing, skew splitting, broadcast by
# measured size).
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # dynamic records: a key repeated inside one object keeps its last value
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # checkpoint files (positional sample) are removed once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Wide CASE/string projections generate big methods; HotSpot does not JIT
    # methods over 8000 bytes, so cap whole-stage codegen there (Spark's own
    # recommendation) and let the JVM compile the rest.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # no Python call site for every column expression: a third of the time that building a wide plan takes
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.dataFrameQueryContext.enabled": "false",
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}


# Starting points for a large cluster (pass as ``extra``): shuffle partitions
# about 2-3x the total cores (AQE coalesces small ones and splits skewed ones)
# and large scan splits for the raw observation files. No state-store
# settings are needed: the streaming ingest keeps no aggregate state.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
}


def build_session(master: str | None = None, app: str = "thermoload",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    On a cluster leave ``master`` unset and let the launcher decide; shuffle
    partitions should then be sized to the data (AQE coalesces small ones).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only
    when nothing is configured *and* Spark runs in local mode (tests) do we
    create one ourselves; a cluster must name a shared folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    d = tempfile.mkdtemp(prefix="thermoload-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one job's files."""
    return f"{shared_dir(spark)}/work-{name}-{uuid.uuid4().hex[:12]}"


def clean_scratch(spark: SparkSession, older_than_hours: float = 48.0) -> list[str]:
    """Delete the folders of ``scratch_path`` that were last changed before that time: results of queries
    read theirs when they are run, so nothing else knows when they are done. Returns the names."""
    root = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = (time.time() - older_than_hours * 3600) * 1000
    old = [st.getPath() for st in (fs.listStatus(p) if fs.exists(p) else [])
           if st.getPath().getName().startswith("work-") and st.getModificationTime() < before]
    for folder in old:
        fs.delete(folder, True)
    return sorted(folder.getName() for folder in old)

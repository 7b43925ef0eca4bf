"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def by_value(module: str) -> None:
    """Send the module's functions to the workers themselves, not by name: workers then
    need no copy of this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts
    lineage, and a lost executor never repeats the work behind it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` whose last reader has been written itself."""
    for t in tables:
        spark = t.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.written_at)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def words(text: str | Column) -> Column:
    """Array of the text's words (null: empty)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: str | Column) -> Column:
    """Word count as long (null: 0)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once per row, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


by_value(__name__)

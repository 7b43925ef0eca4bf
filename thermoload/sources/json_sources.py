"""JSON sources and sinks.

S3/U2  load-API pages ``{"response": {"data": [...]}}`` -> rows
S5     JSON facility records -> typed table
S6/S13 JSON-lines sink with sorted keys and explicit nulls
S7     record key normalisation (lower case, empty -> 'unknown', last wins)
S14    GeoJSON FeatureCollections -> feature rows

Documents are written in bounded chunks (``chunked_documents``): rows are
grouped by (task, running index // chunk size), so no document, group or
task ever holds more than ``chunk`` records, whatever the key skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType,
)

from .. import constants as K

_LOW33 = (1 << 33) - 1


def chunked_documents(rows: DataFrame, record: Column, chunk: int, wrap) -> DataFrame:
    """One JSON text per chunk of at most ``chunk`` records.

    ``wrap(array_column)`` builds the document struct around the record array.
    """
    r = rows.select(record.alias("_r"), F.spark_partition_id().alias("_p"),
                    F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33)) / chunk).alias("_c"))
    docs = r.groupBy("_p", "_c").agg(F.collect_list("_r").alias("_rs"))
    return docs.select(F.to_json(wrap(F.col("_rs")), {"ignoreNullFields": "false"}).alias("value"))


def _read_json(spark: SparkSession, path: str, schema: StructType, multi_line: bool) -> DataFrame:
    """JSON documents with a declared schema; a malformed or truncated document, or a
    pretty-printed one read line by line, fails the job instead of vanishing."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)


# --- S3: load API pages ----------------------------------------------------------------

LOAD_RECORD = StructType([StructField(n, StringType()) for n in
                          ["period", "parent", "parent-name", "subba", "subba-name", "value"]])
LOAD_PAGE = StructType([StructField("response", StructType([
    StructField("data", ArrayType(LOAD_RECORD))]))])
LOAD_REQUIRED = ["period", "parent", "subba", "value"]


def write_load_pages(rows: DataFrame, path: str, page_size: int = K.LOAD_PAGE_SIZE) -> None:
    """Land load rows as API-shaped pages (one page document per line)."""
    rec = F.struct(*[F.col(c).alias(c.replace("_", "-")) if c in ("parent_name", "subba_name") else F.col(c)
                     for c in rows.columns])
    docs = chunked_documents(rows, rec, page_size,
                             lambda a: F.struct(F.struct(a.alias("data")).alias("response")))
    docs.write.mode("overwrite").text(path)


def read_load_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Rows of every landed page. Pages without ``response`` or ``data`` add
    no rows; values arrive as text whether the page held strings or numbers
    (the strict cast happens in ``hourly.load_rows``). ``multi_line`` reads
    one pretty-printed document per file."""
    pages = _read_json(spark, path, LOAD_PAGE, multi_line)
    rows = pages.select(F.explode("response.data").alias("r")).select("r.*")
    return rows.select([F.col(f"`{c}`").alias(c.replace("-", "_")) for c in rows.columns])


def landing_guards(spark: SparkSession, path: str, required: list[str] = LOAD_REQUIRED, multi_line: bool = False) -> DataFrame:
    """P15/P16 as a relation: ``guard``, ``subject``, ``found``, ``passed``. A row per required key with the number of records
    that have it (a null value counts as present) and a row for the records themselves, which must not be
    none. The keys are looked up in the documents, because a
    read with a declared schema has every column. One pass, one row before it is spread out."""
    keyed = StructType([StructField("response", StructType([
        StructField("data", ArrayType(MapType(StringType(), StringType())))]))])
    rec = _read_json(spark, path, keyed, multi_line).select(F.explode("response.data").alias("r"))
    one = rec.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.map_contains_key("r", k)).alias(f"k{i}") for i, k in enumerate(required)])
    row = lambda guard, subject, n, ok: F.struct(F.lit(guard).alias("guard"), F.lit(subject).alias("subject"),
                                                 n.alias("found"), ok.alias("passed"))
    rows = [row("required key", k, F.col(f"k{i}"), (F.col(f"k{i}") > 0) | (F.col("n") == 0)) for i, k in enumerate(required)]
    return one.select(F.inline(F.array(row("not empty", "records", F.col("n"), F.col("n") > 0), *rows)))


def require_page_keys(spark: SparkSession, path: str, required: list[str] = LOAD_REQUIRED,
                      multi_line: bool = False) -> None:
    """Fail when no record of any page has one of the ``required`` keys."""
    failed = landing_guards(spark, path, required, multi_line).filter("guard = 'required key' AND NOT passed").collect()
    if failed:
        raise ValueError(f"input is missing expected columns: {[r.subject for r in failed]}")


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail when expected columns are absent (schema-inferred reads)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"input is missing expected columns: {missing}")
    return df


def ensure_not_empty(df: DataFrame, what: str = "input") -> DataFrame:
    """Stop early when a source produced no rows (one-row probe)."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


# --- S5/S6/S13: facility records as JSON -------------------------------------------------

FACILITY_SCHEMA = StructType(
    [StructField("facility_id", LongType())]
    + [StructField(c, StringType()) for c in K.FACILITY_TEXT_COLUMNS]
    + [StructField(c, DoubleType()) for c in
       ["capacity_mw", "est_load_30_mw", "est_load_50_mw", "est_load_60_mw", "annual_load_50_twh"]]
    + [StructField("pop_within_mile", IntegerType()), StructField("co_tons_per_year", DoubleType()),
       StructField("water_stress_index", StringType()), StructField("construct_year", IntegerType())]
    + [StructField(c, DoubleType()) for c in K.EJ_COLUMNS]
    + [StructField("lat", DoubleType()), StructField("lon", DoubleType())])


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, keys in sorted order, NULLs written
    as ``null`` (Spark drops them unless told otherwise)."""
    df.select(sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_facility_json(spark: SparkSession, path: str, multi_line: bool = False,
                       schema: StructType = FACILITY_SCHEMA) -> DataFrame:
    """Facility records (JSON lines, or one JSON array per file with
    ``multi_line``) with the declared schema; columns in schema order."""
    df = _read_json(spark, path, schema, multi_line)
    return df.select([f.name for f in schema.fields])


# --- S7: key normalisation ----------------------------------------------------------------

def normalise_records(df: DataFrame, text_col: str = "value", out: str = "record") -> DataFrame:
    """Adds ``out``: the JSON object in ``text_col`` as a key-sorted map whose
    keys are lower-cased (an empty key becomes 'unknown'); when two keys
    collide the later one wins. A malformed record fails the job. Values stay JSON text. Exact duplicate keys
    inside one object need ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` (set by
    ``session.build_session``).

    With that policy the map builder de-duplicates natively; otherwise an
    explicit filter keeps each entry that no later entry overrides (the entry
    array is its own projection there, so the lambda does not re-parse).
    """
    m = F.from_json(F.col(text_col), "map<string,string>", {"mode": "FAILFAST"})
    e = F.transform(F.map_entries(m), lambda x: F.struct(
        F.when(x["key"] == "", F.lit("unknown")).otherwise(F.lower(x["key"])).alias("key"),
        x["value"].alias("value")))
    policy = df.sparkSession.conf.get("spark.sql.mapKeyDedupPolicy", "EXCEPTION").upper()
    if policy == "LAST_WIN":
        return df.withColumn(out, F.map_from_entries(F.sort_array(F.map_entries(F.map_from_entries(e)))))
    d = df.withColumn("_e", e)
    ent = F.col("_e")
    last = F.filter(ent, lambda x, i: ~F.exists(F.slice(ent, i + 2, F.greatest(F.size(ent) - i - 1, F.lit(0))),
                                                lambda y: y["key"] == x["key"]))
    return d.withColumn(out, F.map_from_entries(F.sort_array(last))).drop("_e")


# --- S14: GeoJSON -------------------------------------------------------------------------------

FEATURE = StructType([StructField("type", StringType()), StructField("id", StringType()),
                      StructField("properties", StructType([StructField("name", StringType())]))])
FEATURE_COLLECTION = StructType([StructField("type", StringType()),
                                 StructField("features", ArrayType(FEATURE))])


def write_feature_collections(features: DataFrame, path: str, chunk: int = 5000) -> None:
    """Features (id, name) as FeatureCollection documents, one per line."""
    rec = F.struct(F.lit("Feature").alias("type"), F.col("id"),
                   F.struct(F.col("name").alias("name")).alias("properties"))
    docs = chunked_documents(features, rec, chunk, lambda a: F.struct(
        F.lit("FeatureCollection").alias("type"), a.alias("features")))
    docs.write.mode("overwrite").text(path)


def read_features(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    fc = _read_json(spark, path, FEATURE_COLLECTION, multi_line)
    return fc.select(F.explode("features").alias("f")).select(
        F.col("f.id").alias("feature_id"), F.col("f.properties.name").alias("name"))


def county_layer(features: DataFrame, prefix: str = K.STATE_FIPS_PREFIX,
                 focus: list[str] | None = None) -> DataFrame:
    """Counties of one state (ids starting with ``prefix``; NULL/empty ids
    dropped) with the focus-county flag (P23)."""
    fid = F.col("feature_id")
    return (features.filter(fid.isNotNull() & (fid != "") & fid.startswith(prefix))
            .withColumn("is_focus_county", fid.isin(focus or K.FOCUS_COUNTY_FIPS)))


def state_layer(features: DataFrame, focus: list[str] | None = None) -> DataFrame:
    """States with the focus-state flag (P24); a NULL name is not in focus."""
    return features.withColumn("is_focus_state",
                               F.coalesce(F.col("name").isin(focus or K.FOCUS_STATES), F.lit(False)))

"""Exact deduplication by skew-safe combining.

Equal texts (null counts as empty) form a group; the row with the largest id
stays. Three combining stages, each of which groups by the digest AND the full
text, so two texts are merged only when every character agrees:

1. local: each task merges its own equal texts (Spark's map-side combine; the
   salt is the input partition's number, so a task sends one row per text),
2. salted: rows meet by (salt, digest, text); a text that makes up a third of
   all rows meets in ``salts`` places instead of one,
3. global: at most ``salts`` winners per text are combined into one.

Every document then looks up its group's winner by the group's reference
(SHA-256, length and a second 64-bit hash). The join's large side is small
columns only, and Spark splits its hot keys (adaptive skew join).

Edge cases: a null text equals the empty text. A null id loses against any
other; a group of null ids keeps a null id. Rows repeated with the same id and
text are one document: the ledger has a row for each and all carry the same
``kept``; ``survivors`` returns one of them. An empty table gives an empty
result. Columns of the input other than id and text are never looked at, so
their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

REF = ["__sha", "__len", "__xx"]


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _ref(text: str) -> list[Column]:
    t = _text(text)
    return [F.sha2(t.cast("binary"), 256).alias("__sha"), F.length(t).alias("__len"),
            F.xxhash64(t).alias("__xx")]


def winners(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct text: reference columns, ``keep_id``, ``group_size``, ``n_keep``
    (rows that carry the id which stays)."""
    rows = docs.select(F.col(id_col).alias("__id"), _text(text).alias("__text"))
    salted = (rows
              .withColumn("__salt", F.spark_partition_id() % salts)
              .withColumn("__sha", F.sha2(F.col("__text").cast("binary"), 256))
              .groupBy("__salt", "__sha", "__text")
              .agg(F.max("__id").alias("__max"), F.count(F.lit(1)).alias("__n")))
    merged = (salted.groupBy("__sha", "__text")
              .agg(F.max("__max").alias("keep_id"), F.sum("__n").alias("group_size")))
    return merged.select(*_ref("__text"), "keep_id", "group_size")


def dedup_ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    won = winners(docs, id_col, text, salts)
    rows = docs.select(F.col(id_col).alias("__id"), *_ref(text))
    out = rows.join(won, REF, "inner")
    return out.select(F.col("__id").alias(id_col), "keep_id", "group_size",
                      F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.col("__sha").alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """The rows that stay, one per distinct text, with all columns of ``docs``.

    The lookup is by (reference, id), which no group of copies can make hot.
    Rows repeated with id and text are rare, so only they are numbered.
    """
    won = written(winners(docs, id_col, text, salts), "dedup-winners")
    cols = docs.columns
    rows = docs.withColumns({"__sha": F.sha2(_text(text).cast("binary"), 256),
                             "__len": F.length(_text(text)), "__xx": F.xxhash64(_text(text))})
    key = won.select(*[F.col(c).alias(f"__w{c}") for c in REF], F.col("keep_id").alias("__keep"))
    same = [F.col(c) == F.col(f"__w{c}") for c in REF] + [F.col(id_col).eqNullSafe(F.col("__keep"))]
    hit = rows.join(key, same, "left_semi")
    small = docs.select(F.col(id_col).alias("__id"), *_ref(text))
    again = [F.col(c) == F.col(f"__w{c}") for c in REF] + [F.col("__id").eqNullSafe(F.col("__keep"))]
    repeats = small.join(key, again, "left_semi").groupBy("__id", *REF).count().filter("count > 1")
    if not repeats.isEmpty():  # rows repeated with id and text: one of them stays
        hit = hit.dropDuplicates(["__sha", "__len", "__xx", id_col])
    return hit.select(*cols)

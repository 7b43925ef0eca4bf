"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns ``a``, ``b``, both long);
    ``root`` is the smallest node that it is connected with.

    Each round links every node to its smallest neighbour (large star, then small
    star), which keeps connectivity and halves the depth of the trees. A node's
    neighbours are reduced by ``min`` before the shuffle and never gathered, so a
    star of any size is safe. Each round is written to the shared folder; the
    loop ends when a round changes nothing. No edges: an empty table.
    """
    cur = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (both.join(low, both.a == low.u).filter("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        hop = large.join(least, large.a == least.u)
        small = (hop.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(hop.select("a", F.col("m").alias("b")))
                 .filter("a <> b").distinct())
        last, cur = cur, written(small, "edges")
        discard(last)
        # the contraction is finished when every node points to a root
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    out = written(cur.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
                  .unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "labels")
    discard(cur)
    return out

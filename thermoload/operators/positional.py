"""Positions in a total order: a few wanted ones (W3) and all of them.

``select_positions`` finds the rows at a handful of positions by counts alone, without a global sort:
the range of each key in turn is cut into at most ``BINS`` bins, one grouped count says which bin
holds each position, and only those bins are looked at further. Once a position's bin holds at most
``FEW`` rows (or rows equal in all keys), these are numbered in a window of their own. Every
pass sends at most ``BINS`` counts for each wanted position to the driver, whatever the number of rows, and
a score that a third of the rows share is simply cut further by the next key. The passes read a table of
the keys, written once and deleted afterwards.

``number_rows`` numbers all rows: the rows are range partitioned by the order,
sorted and numbered inside the partitions and written; the counts per partition (at
most ``num_partitions`` rows) give each partition's offset. Range bounds come from a sample, so
the numbered rows are written once and read back: counts and rows are of the same cut, and
a lost executor cannot renumber them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.files import delete

BINS = 1024
FEW = 10_000
_LOW33 = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in the low 33 bits


class _Range:
    """Rows that hold a wanted position: earlier keys fixed, the current key within [low, high]."""

    def __init__(self, fixed: tuple, low: int | None, high: int | None, before: int, count: int):
        self.fixed, self.low, self.high, self.before, self.count = fixed, low, high, before, count


def select_positions(df: DataFrame, order_cols: list[str], positions: Callable[[int], list[int]]) -> DataFrame:
    """Sort keys at global positions ``positions(n)`` (0-based, ``n`` = row count)
    of ``df`` in the ascending order of ``order_cols`` (integer columns; missing values first). Adds ``sample_no`` (1-based, in the
    order given) and ``position``. A position repeated by the list yields the
    row once per sample number, like repeated ``iloc`` calls. At most one row
    per position: callers look the rows up by these keys."""
    spark = df.sparkSession
    keys = df.select(*[F.col(c).cast("long").alias(c) for c in order_cols])
    n = keys.count()
    wanted = [(i + 1, p) for i, p in enumerate(positions(n))] if n else []
    path = scratch_path(spark, "positions") if n > FEW else None
    if path:  # several passes: they read the keys alone, and don't compute them again in every condition
        keys.write.parquet(path)
        keys = spark.read.parquet(path)
    found = _found(keys, order_cols, n, wanted)
    if path:
        delete(spark, path)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order_cols)
    return spark.createDataFrame([(*found[p], sample, p) for sample, p in wanted], f"{schema}, sample_no int, position bigint")


def _found(keys: DataFrame, order_cols: list[str], n: int, wanted: list[tuple[int, int]]) -> dict[int, tuple]:
    """The keys at each wanted position."""
    at = {p: _Range((), None, None, 0, n) for _, p in wanted}
    for depth, key in enumerate(order_cols):
        at = _narrow(keys, order_cols, depth, key, at)
    # rows equal in all keys need no number; of the other ranges at most FEW rows each are left
    values = {p: r.fixed for p, r in at.items() if len(r.fixed) == len(order_cols)}
    few = {p: r for p, r in at.items() if p not in values}
    if few:
        ranges = _distinct(few)
        number = {_name(r): i for i, r in enumerate(ranges)}
        numbered = _tagged(keys, order_cols, ranges).withColumn(
            "__no", F.row_number().over(Window.partitionBy("__range").orderBy(*order_cols)) - 1)
        places = {(number[_name(r)], p - r.before): p for p, r in few.items()}
        for h in numbered.filter(_any([(F.col("__range") == i) & (F.col("__no") == k) for i, k in places])).collect():
            values[places[h["__range"], h["__no"]]] = tuple(h[c] for c in order_cols)  # a row per position
    return values


def _name(r: _Range) -> tuple:
    return r.fixed, r.low, r.high


def _distinct(at: dict[int, _Range]) -> list[_Range]:
    return list({_name(r): r for r in at.values()}.values())


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _inside(order_cols: list[str], r: _Range) -> Column:
    """The condition of a range on the keys."""
    test = F.lit(True)
    for c, v in zip(order_cols, r.fixed):
        test = test & (F.col(c).isNull() if v is None else F.col(c) == v)
    if r.low is not None:
        c = order_cols[len(r.fixed)]
        test = test & (F.col(c) >= r.low) & (F.col(c) <= r.high)
    return test


def _tagged(keys: DataFrame, order_cols: list[str], ranges: list[_Range]) -> DataFrame:
    """The rows of the given (disjoint) ranges with the number of their range."""
    tag = F.lit(None).cast("int")
    for i, r in enumerate(ranges):
        tag = F.when(_inside(order_cols, r), F.lit(i)).otherwise(tag)
    return keys.filter(_any([_inside(order_cols, r) for r in ranges])).withColumn("__range", tag)


def _narrow(keys: DataFrame, order_cols: list[str], depth: int, key: str, at: dict[int, _Range]) -> dict[int, _Range]:
    """Cut the ranges of all positions by one key until each is small or holds one value of it."""
    open_ = {p: r for p, r in at.items() if r.count > FEW and len(r.fixed) == depth}
    ends: dict[tuple, tuple] = {}
    while open_:
        ranges = _distinct(open_)
        tagged = _tagged(keys, order_cols, ranges)
        fresh = [i for i, r in enumerate(ranges) if r.low is None and r.fixed not in ends]
        if fresh:  # bounds of the key, and how many values are missing
            for b in tagged.groupBy("__range").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n")).collect():
                ends[ranges[b["__range"]].fixed] = (b["lo"], b["hi"], b["n"])
        for p, r in list(open_.items()):
            if r.low is None:
                low, high, there = ends[r.fixed]
                missing = r.count - there
                if p - r.before < missing:  # among the missing ones, which come first
                    open_.pop(p)
                    at[p] = _Range((*r.fixed, None), None, None, r.before, missing)
                else:
                    open_[p] = _Range(r.fixed, low, high, r.before + missing, there)
        ranges = _distinct(open_)
        if not ranges:
            break
        widths = [-(-(r.high - r.low + 1) // BINS) for r in ranges]
        tagged = _tagged(keys, order_cols, ranges)
        bin_no = F.lit(None).cast("long")
        for i, (r, w) in enumerate(zip(ranges, widths)):
            # wide decimals: the difference of two longs may not fit a long
            offset = F.col(key).cast("decimal(20,0)") - F.lit(r.low).cast("decimal(20,0)")
            bin_no = F.when(F.col("__range") == i, F.call_function("div", offset, F.lit(w).cast("decimal(20,0)"))).otherwise(bin_no)
        counts: dict[int, list] = {}
        for b in tagged.groupBy("__range", bin_no.alias("bin")).count().sort("__range", "bin").collect():
            counts.setdefault(b["__range"], []).append((b["bin"], b["count"]))
        numbers = {_name(r): i for i, r in enumerate(ranges)}
        for p, r in list(open_.items()):
            i, before = numbers[_name(r)], r.before
            for bin_, c in counts[i]:
                if p < before + c:
                    break
                before += c
            low = r.low + bin_ * widths[i]
            high = min(low + widths[i] - 1, r.high)
            if low == high:
                open_.pop(p)
                at[p] = _Range((*r.fixed, low), None, None, before, c)
            elif c <= FEW:
                open_.pop(p)
                at[p] = _Range(r.fixed, low, high, before, c)
            else:
                open_[p] = _Range(r.fixed, low, high, before, c)
    return at


def quartile_positions(n: int) -> list[int]:
    """0, n//4, n//2, 3n//4, n-1 (integer division), as in the score sample."""
    return [0, n // 4, n // 2, 3 * n // 4, n - 1]


def number_rows(df: DataFrame, order: list[str | Column], name: str = "position", num_partitions: int | None = None) -> DataFrame:
    """``df`` with every row's 0-based position in the order of ``order`` (columns or ordered
    columns; they should end in a unique one)."""
    spark = df.sparkSession
    n_part = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "numbered")
    (df.repartitionByRange(n_part, *order).sortWithinPartitions(*order)
     .withColumn("__part", F.spark_partition_id())
     .withColumn("__no", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33)))
     .write.parquet(path))
    rows = spark.read.parquet(path)
    # at most n_part rows: a single-partition window here is bounded by configuration
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (rows.join(F.broadcast(offsets), "__part")
            .select(*df.columns, (F.col("__before") + F.col("__no")).cast("long").alias(name)))

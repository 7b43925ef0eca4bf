"""Mixing sources to target weights by fixed-length blocks and index permutations.

1. Targets. Each source has a weight and may be used ``max_epochs`` times at
   most. Shares of the total size are proportional to the weights; a share above
   the limit is cut to it and the excess is shared out again by weight among the
   others, until none is above.
2. Packing. The words of a source, document after document, are one stream that
   is cut into blocks of ``block`` words. A document's offset in the stream is a
   prefix sum in two steps: rows are dealt to buckets by a hash of the id, a
   window sums within a bucket, and the buckets' totals (a bounded table) are
   summed up per source. A source with a third of all rows is spread over
   ``buckets`` buckets; rows that are equal in all columns are one row with a number of copies until their
   offsets are known, and then expanded in chunks.
3. Drawing. A source's target is a number of its blocks (epochs times blocks); the sum over all sources
   is the number of slots, dealt to output shards of about ``slots``. Each shard draws a multinomial
   count of every source, given the sources' totals: without replacement, so the totals are
   met at every size. The draws follow a binary tree over the shards: a node's counts are split between its
   halves (multivariate hypergeometric) by a generator seeded by (seed, node). A task walks down to its
   own shards; what went to the left on the way is the index at which its draws of a source begin.
4. Mapping. Index i of a source with n blocks is epoch i // n; within an epoch a
   keyed pseudorandom permutation (a Feistel network with cycle walking) maps
   i % n to a block, so an epoch uses each block once.
5. Joining. Slots meet the documents' pieces of their block by (source, block).

No source has more slots than ``max_epochs`` passes through it, so no
word is used more often. Everything is a function of the data and the seed: reruns and
recomputed tasks agree. Only one row per source (sizes, weights) reaches the
driver.

Edge cases: null text has size 0 and takes nothing; null source is a source of
its own, last in order; null ids and repeated rows are rows like any other
(ordered by id, then a hash of the whole row). An empty table or one without words gives every
row a target of its source and ``taken`` 0. Extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import by_value, n_words, written

BLOCK = 64
SLOTS = 512
MAX_EPOCHS = 3
WEIGHTS = (1.0, 2.0, 3.0)  # repeated over the sources in code point order, null last
SEED = 20240607
BUCKETS = 1024
CHUNK = 4096          # copies of one row that are expanded in one place
TOGETHER = 64         # shards that a task draws
EXACT_TOTAL = 500_000_000  # slots up to which a split is drawn exactly (the generator's limit is 10^9)


def targets(sizes: list[int], weights: list[float], limit: float = MAX_EPOCHS) -> list[float]:
    """Words of each source: weighted shares of the total, none above ``limit`` times its size."""
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        per = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if per * weights[i] > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in over:
            out[i] = float(limit * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in over]
    return out


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1, the same for the same key."""
    half = max(1, (max(1, (n - 1).bit_length()) + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.SeedSequence(key).generate_state(4, np.uint64)
    out = i.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        x = (left << np.uint64(half)) | right
        out[todo] = x
        todo = todo[x >= n]
    return out.astype(np.int64)


def slot_counts(sizes: np.ndarray, target: np.ndarray, block: int) -> np.ndarray:
    """Blocks to draw from each source: its target in blocks, each used ``MAX_EPOCHS`` times at most."""
    blocks = -(-sizes // block)
    want = np.divide(target * blocks, sizes, out=np.zeros(len(sizes)), where=sizes > 0)
    return np.minimum(np.rint(want).astype(np.int64), MAX_EPOCHS * blocks)


def split(counts: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """``n`` of the slots ``counts``, drawn without replacement. Beyond ``EXACT_TOTAL`` slots, where one draw
    hardly matters, every source gives its share, and the last few are drawn."""
    rng, total = np.random.default_rng(key), int(counts.sum())
    if total <= EXACT_TOTAL:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out = np.array([int(c) * n // total for c in counts.tolist()], np.int64)
    left = (counts - out > 0).nonzero()[0]
    out[rng.choice(left, n - int(out.sum()), replace=False)] += 1  # fewer than there are sources
    return out


def shard_draws(counts: np.ndarray, shards: int, first: int, last: int, seed: int):
    """(shard, count by source, index of the first draw by source) for the shards first..last-1."""
    total = int(counts.sum())
    start = lambda shard: total * shard // shards
    todo = [(0, shards, counts, np.zeros_like(counts))] if shards else []
    while todo:
        low, high, c, index = todo.pop()
        if high <= first or low >= last:
            continue
        if high - low == 1:
            yield low, c, index
            continue
        mid = (low + high) // 2
        left = split(c, start(mid) - start(low), (seed, low, high))
        todo.append((mid, high, c - left, index + left))
        todo.append((low, mid, left, index))


def sizes_by_source(docs: DataFrame) -> DataFrame:
    return docs.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__copies")).alias("size"))


def with_offsets(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A row for every copy of ``rows`` (``__id``, ``__source``, ``__size``, ``__hash``, ``__copies``) with
    its ``__offset`` in its source's stream."""
    rows = (rows.withColumn("__bucket", F.pmod(F.xxhash64("__id", "__hash"), F.lit(buckets)).cast("int"))
            .withColumn("__words", F.col("__size") * F.col("__copies")))
    sums = rows.groupBy("__source", "__bucket").agg(F.sum("__words").alias("__n"))
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (sums.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
              .select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), "__start"))
    within = (Window.partitionBy("__source", "__bucket").orderBy("__id", "__hash")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("__in", F.coalesce(F.sum("__words").over(within), F.lit(0)))
    same = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b"))
    placed = (placed.join(starts.hint("merge"), same).withColumn("__offset", F.col("__in") + F.col("__start"))
              .drop("__in", "__start", "__s", "__b", "__bucket", "__words"))
    if (rows.agg(F.max("__copies")).first()[0] or 0) > 1:  # copies lie one after another
        placed = (placed.withColumn("__chunk", F.explode(F.expr(f"sequence(0L, (__copies - 1) div {CHUNK})")))
                  .repartition("__id", "__hash", "__chunk")
                  .withColumn("__copy", F.explode(F.expr(f"sequence(__chunk * {CHUNK}, least((__chunk + 1) * {CHUNK}, __copies) - 1)")))
                  .withColumn("__offset", F.col("__offset") + F.col("__copy") * F.col("__size")).drop("__chunk", "__copy"))
    return placed.drop("__copies")


def draws(spark, sources: pd.DataFrame, slots: int, seed: int, block: int) -> DataFrame:
    """One row for each slot of the mix: ``shard``, ``slot``, ``number`` (of the source), ``block``,
    ``epoch``. ``sources``: one row per source with ``size``, ``target``, in order."""
    size = sources["size"].to_numpy(np.int64)
    n_blocks = -(-size // block)
    counts = slot_counts(size, sources["target"].to_numpy(float), block)
    total = int(counts.sum())
    shards = max(1, round(total / slots)) if total else 0

    def place(batches):
        for b in batches:
            for part in b.column(0).to_pylist():
                for shard, n, first in shard_draws(counts, shards, part * TOGETHER, (part + 1) * TOGETHER, seed):
                    num = np.repeat(np.arange(len(n)), n)
                    i = np.arange(len(num)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                    epoch, at = i // n_blocks[num], np.empty(len(i), np.int64)
                    for k, e in np.unique(np.stack([num, epoch]), axis=1).T.tolist():  # at most sources * epochs groups
                        here = (num == k) & (epoch == e)
                        blocks = int(n_blocks[k])
                        at[here] = permute(i[here] % blocks, blocks, (seed * 1009 + k) * 31 + e)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(i), shard, np.int64)), pa.array(np.arange(len(i))), pa.array(num), pa.array(at), pa.array(epoch)],
                        names=["shard", "slot", "number", "block", "epoch"])
    parts = -(-shards // TOGETHER)
    return spark.range(parts, numPartitions=max(1, parts)).mapInArrow(
        place, "shard long, slot long, number long, block long, epoch long")


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
            weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, slots: int = SLOTS,
            seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents, uses), without texts. documents: ``__id``, ``__hash`` (of the row), ``__source``,
    ``__size``, ``__offset``, and the source's ``source_size``, ``target`` and ``number``.
    uses: for each slot and document piece ``number``, ``__offset`` (of the document), ``epoch``,
    ``shard``, ``slot``, ``start``, ``n`` (words of the document from ``start``)."""
    spark = docs.sparkSession
    rows = written(docs.select(F.col(id_col).alias("__id"), F.col(source).alias("__source"),
                               n_words(text).alias("__size"), row_hash(docs).alias("__hash"))
                   .groupBy("__id", "__source", "__size", "__hash").agg(F.count(F.lit(1)).alias("__copies")), "mix-sizes")
    sources = sizes_by_source(rows).toPandas()  # one row per source
    if not len(sources):
        sources = pd.DataFrame({"__source": pd.Series(dtype=object), "size": pd.Series(dtype="int64")})
    sources["null"] = sources["__source"].isna()
    sources = sources.sort_values(["null", "__source"]).reset_index(drop=True)
    sources["number"] = np.arange(len(sources))
    weight = [weights[i % len(weights)] for i in range(len(sources))]
    sources["target"] = targets([int(x) for x in sources["size"]], weight)
    table = spark.createDataFrame(
        [(None if n else s, int(i), int(z), float(t)) for s, n, i, z, t in
         sources[["__source", "null", "number", "size", "target"]].itertuples(index=False)],
        T.StructType([T.StructField("__s", docs.schema[source].dataType), T.StructField("number", T.LongType()),
                      T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]))
    placed = with_offsets(rows).join(table, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    placed = written(placed, "mix-documents")
    slot = draws(spark, sources, slots, seed, block)
    pieces = (placed.filter("__size > 0").select(
        "number", "__offset", "__size",
        F.explode(F.expr(f"sequence(__offset div {block}, (__offset + __size - 1) div {block})")).alias("block"))
        .withColumn("__from", F.greatest(F.col("__offset"), F.col("block") * block))
        .withColumn("n", F.least(F.col("__offset") + F.col("__size"), (F.col("block") + 1) * block) - F.col("__from"))
        .select("number", "block", "__offset", (F.col("__from") - F.col("__offset")).alias("start"), "n"))
    # Spark can't know how many slots a shard's row becomes: never broadcast them
    uses = slot.hint("merge").join(pieces, ["number", "block"]).select(
        "number", "__offset", "epoch", "shard", "slot", "start", "n")
    return placed, uses


def taken_words(docs: DataFrame, **params) -> DataFrame:
    """One row per document: ``__id``, ``size``, ``source_size``, ``target``, ``taken``."""
    placed, uses = mixture(docs, **params)
    sums = uses.groupBy("number", "__offset").agg(F.sum("n").alias("taken"))
    filled = placed.filter("__size > 0").join(sums.hint("merge"), ["number", "__offset"], "left")
    empty = placed.filter("__size = 0").withColumn("taken", F.lit(None).cast("long"))
    return filled.unionByName(empty).select(
        "__id", F.col("__size").alias("size"), "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                    n_chars: str = "n_chars", **params) -> DataFrame:
    """The mix as documents: a row for each document and epoch that takes words of it, with
    the taken words as text (the whole text unchanged where all of it is taken) and all
    columns of ``docs``; ``n_chars`` is counted anew where there is such a column."""
    cols = docs.columns
    placed, uses = mixture(docs, id_col, text, source, **params)
    runs = uses.groupBy("number", "__offset", "epoch").agg(
        F.sum("n").alias("__n"), F.array_sort(F.collect_list(F.struct("start", "n"))).alias("__runs"))
    # a row is found again by its hash; rows with equal hashes are equal
    key = F.xxhash64("__id", "__hash")
    plan = (placed.filter("__size > 0").select("number", "__offset", key.alias("__pk"), "__size")
            .join(runs.hint("merge"), ["number", "__offset"]).select("__pk", "__size", "__n", "__runs"))
    rows = docs.select(F.col(id_col).alias("__id"), row_hash(docs).alias("__hash"), *[F.col(c).alias(f"__k_{c}") for c in cols])
    rows = rows.select(key.alias("__key"), *[f"__k_{c}" for c in cols])
    if not placed.groupBy("__id", "__hash").count().filter("count > 1").isEmpty():  # one row stands for its copies
        rows = written(rows.groupBy("__key").agg(F.first(F.struct(*[f"__k_{c}" for c in cols])).alias("r")).select("__key", "r.*"), "mix-rows")
    rows = rows.join(plan.hint("merge"), F.col("__key") == F.col("__pk"))
    ws = F.filter(F.split(F.col(f"__k_{text}"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    part = F.array_join(F.flatten(F.transform(F.col("__runs"), lambda r: F.slice(
        F.col("__ws"), (r["start"] + 1).cast("int"), r["n"].cast("int")))), " ")
    whole = F.col("__n") == F.col("__size")
    rows = rows.withColumn("__ws", F.when(~whole, ws)).withColumn(
        f"__k_{text}", F.when(whole, F.col(f"__k_{text}")).otherwise(part))
    out = {c: F.col(f"__k_{c}").alias(c) for c in cols}
    if n_chars in out:
        out[n_chars] = F.length(f"__k_{text}").cast(docs.schema[n_chars].dataType).alias(n_chars)
    return rows.select(*out.values())


by_value(__name__)

"""Hard negatives by threshold joins in the manner of L2AP, on integer vectors.

For every anchor: its positives, the rows of its label with the largest inner products; and for
every positive the hardest negatives, the rows of another label whose product lies in the window
[percent/100 * positive's product, positive's product]. Both are threshold joins whose
thresholds start high and are lowered until every window is full.

One join (``Index.above``) finds all rows whose product with an anchor is at least the anchor's threshold:

* Components are ordered by weight and cut into blocks. A row is in the inverted list of a block only
  while the norm of what remains of it, times the largest such norm of the anchors, reaches the lowest
  threshold. The blocks after that are covered by the bound: alone they can't reach a threshold.
* Partial products are accumulated list by list. After each, a pair is dropped where partial product +
  remaining norm of the row * remaining norm of the anchor is below the anchor's threshold.
* What is left of the candidates is completed from their vectors, block by block under the same
  bound, and finally pair by pair, so every product that is returned is exact.

Scale: the anchors are a stated query set; they meet all rows in blocks. Rows are dealt by a hash of
their contents to chunks of about ``ROWS``, anchors to groups of about ``ANCHORS``; a task holds one
chunk and one group, whatever the number of rows or of equal labels. Each returns at
most its own best ``n`` per anchor and window, and ranks over these give the whole result: a row
missing from its chunk's best n can't be among the best n of all. Nothing is broadcast or
collected. Rows equal in id, label and vector are merged before that, so copies don't meet in one chunk.

Arithmetic is exact: whole numbers in doubles while all products stay below 2^53, Python integers beyond
(scores that don't fit a long raise). Norm bounds are widened by 1e-9 against rounding.

Edge cases: rows with a null id, label or vector, or a null or non-finite component take no part. Rows
equal in id, label and vector count once; rows that share only an id are rows of their own, but
never each other's positives. Only vectors of the same length have a product. Ties go to the smaller
id. An anchor without positives, and a positive without negatives in its window (any positive with a product below
0), give no rows. Empty tables give empty results; extra columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, written

SCALE = 256
ROWS = 16_384        # rows of a chunk, on average
ANCHORS = 16_384     # anchors of a group, on average
LEAST_ROWS = 1024    # a chunk is not made smaller to employ more tasks
TOGETHER = 256       # anchors whose products with a chunk are held at once
STEP = 8             # components of a block
LOWER = 0.8          # factor from one threshold for positives to the next
CLOSER = 0.95        # the same within a window of negatives
FEW = 1 / 16         # share of pairs from which on they are completed one by one
SLACK = 1 + 1e-9


# --- the join of one chunk of rows with some anchors ----------------------------------------

def remaining_norms(x: np.ndarray) -> np.ndarray:
    """Norm of each row from the start of each block on; a last column of zeros."""
    square = x.astype(np.float64) ** 2
    blocks = np.arange(0, x.shape[1], STEP)
    left = np.zeros((len(x), len(blocks) + 1))
    if len(blocks):
        left[:, :-1] = np.add.reduceat(square, blocks, axis=1)[:, ::-1].cumsum(1)[:, ::-1]
    return np.sqrt(left)


class Index:
    def __init__(self, x: np.ndarray):
        self.order = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
        self.x = x[:, self.order]
        self.left = remaining_norms(self.x) * SLACK

    def above(self, q: np.ndarray, threshold: np.ndarray):
        """(anchor, row, product) of all pairs with product >= threshold[anchor]."""
        q = q[:, self.order]
        mine = remaining_norms(q) * SLACK
        blocks = self.left.shape[1] - 1
        lists = (self.left[:, :-1] * mine.max(0)[:-1] >= threshold.min()).sum(1)
        rows = np.argsort(-lists, kind="stable")
        if blocks:
            rows = rows[lists[rows] > 0]
        done = lists[rows].copy()  # blocks accumulated so far
        x, left = self.x[rows], self.left[rows]
        partial = np.zeros((len(rows), len(q)), dtype=q.dtype)
        alive = np.ones(partial.shape, bool)

        def add(at, j):
            block = slice(j * STEP, (j + 1) * STEP)
            partial[at] += x[at, block] @ q[:, block].T
            alive[at] &= partial[at] + left[at, j + 1, None] * mine[None, :, j + 1] >= threshold
        for j in range(done.max(initial=0)):  # the inverted lists
            add(slice(0, int(np.searchsorted(-done, -j, side="left"))), j)
        for j in range(blocks):  # what the index omits, of candidates only
            if not alive.size or alive.mean() <= FEW:
                break
            late = np.flatnonzero((done <= j) & alive.any(1))
            if len(late):
                add(late, j)
                done[late] = j + 1
        row, anchor = np.nonzero(alive)
        product = partial[row, anchor]
        for j in np.unique(done[row]):
            if j < blocks:
                pairs = np.flatnonzero(done[row] == j)
                for part in np.array_split(pairs, max(1, len(pairs) >> 15)):
                    product[part] += (x[row[part], j * STEP:] * q[anchor[part], j * STEP:]).sum(1)
        found = product >= threshold[anchor]
        return anchor[found], rows[row[found]], product[found].astype(np.int64)

    def most(self, q: np.ndarray) -> np.ndarray:
        """A bound of each anchor's products."""
        return np.sqrt((q.astype(np.float64) ** 2).sum(1)) * (self.left[:, 0].max(initial=0)) * SLACK


def best(group: np.ndarray, product: np.ndarray, name: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first n of each group by product (falling), then name."""
    order = np.lexsort((name, -product, group))
    g = group[order]
    first = np.searchsorted(g, g, side="left")
    return order[np.arange(len(g)) - first < n]


def fullest(index: Index, names: np.ndarray, q: np.ndarray, own: np.ndarray, n: int):
    """Each anchor's n best rows with another name than its own, thresholds lowered until there are n."""
    threshold = index.most(q) * LOWER
    floor = threshold * 0.1
    todo, out = np.arange(len(q)), []
    while len(todo):
        anchor, row, product = index.above(q[todo], threshold[todo])
        other = names[row] != own[todo][anchor]
        anchor, row, product = anchor[other], row[other], product[other]
        full = (np.bincount(anchor, minlength=len(todo)) >= n) | (threshold[todo] == -np.inf)
        top = best(anchor, product, names[row], n)
        top = top[full[anchor[top]]]
        out.append((todo[anchor[top]], row[top], product[top]))
        todo = todo[~full]
        threshold[todo] = np.where(threshold[todo] * LOWER > floor[todo], threshold[todo] * LOWER, -np.inf)
    return [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [(), (), ()])]


def windows(index: Index, names: np.ndarray, other, q: np.ndarray, high: np.ndarray, percent: int, n: int):
    """(anchor, window, row, product): the n best rows of each anchor and window for which
    ``other(anchor, row)`` holds. ``high``: upper ends by anchor, in object integers, None where there is no window."""
    low = np.array([[None if h is None else -(-percent * h // 100) for h in r] for r in high], dtype=object)
    there = np.array([[h is not None and l <= h for h, l in zip(a, b)] for a, b in zip(high, low)], bool).reshape(high.shape)
    # exact comparisons are on integers; thresholds are lowered in doubles
    hi = np.where(there, high, 0).astype(np.int64)
    lo = np.where(there, low, 0).astype(np.int64)
    todo, t = np.arange(len(q)), np.full(len(q), np.inf)
    open_ = there.copy()
    out = []
    while True:
        todo = todo[open_[todo].any(1)]
        if not len(todo):
            break
        following = np.maximum(lo[todo], np.floor(CLOSER * np.minimum(t[todo, None], hi[todo])))
        t[todo] = np.where(open_[todo], following, -np.inf).max(1)
        anchor, row, product = index.above(q[todo], np.nextafter(t[todo], -np.inf))  # rounded down, whatever the size
        ok = other(todo[anchor], row)
        anchor, row, product = anchor[ok], row[ok], product[ok]
        for w in range(high.shape[1]):
            mine = open_[todo, w]
            inside = mine[anchor] & (product <= hi[todo[anchor], w]) & (product >= lo[todo[anchor], w])
            a, r, p = anchor[inside], row[inside], product[inside]
            closed = mine & ((np.bincount(a, minlength=len(todo)) >= n) | (t[todo] <= lo[todo, w]))
            top = best(a, p, names[r], n)
            top = top[closed[a[top]]]
            out.append((todo[a[top]], np.full(len(top), w), r[top], p[top]))
            open_[todo[closed], w] = False
    return [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [(), (), (), ()])]


# --- the Spark side -----------------------------------------------------------------------------

def prepare(rows: DataFrame, id_col: str = "vec_id", label: str | Column = "label", vec: str = "embedding") -> DataFrame:
    """``id``, ``label``, ``vec`` (integers floor(256 * x)) and ``key`` (a hash of these) of the rows that take part."""
    usable = F.forall(F.col(vec), lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    whole = lambda x: F.when(F.abs(x) < 2.0 ** 62, F.floor(x)).otherwise(F.raise_error(F.lit("component too large")))
    out = rows.select(F.col(id_col).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                      F.when(usable, F.transform(F.col(vec), lambda x: whole(x.cast("double") * SCALE))).alias("vec"))
    out = out.filter("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").distinct()
    return out.withColumn("key", F.xxhash64("id", "label", "vec"))


def _matrix(table: pa.Table, size: int) -> np.ndarray:
    flat = table["vec"].combine_chunks().flatten()
    return np.asarray(flat).reshape(table.num_rows, size)


def _exact(x: np.ndarray, q: np.ndarray):
    """Doubles where all products of the two stay whole in them, else Python integers."""
    norm = lambda m: np.sqrt((m.astype(np.float64) ** 2).sum(1).max(initial=0))
    kind = np.float64 if norm(x) * norm(q) < 2.0 ** 52 else object
    return x.astype(kind), q.astype(kind)


def _met(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Rows by chunk and anchors by group, every chunk with every group: the two sides of a cogroup."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    chunks = max(math.ceil(n_rows / ROWS), min(tasks, math.ceil(n_rows / LEAST_ROWS)), 1)
    groups = max(math.ceil(n_anchors / ANCHORS), 1)
    dealt = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # both sides may come from one table: the left gets columns of its own
    left = rows.select(*[F.col(c).alias(c) for c in ("id", "label", "vec")], F.size("vec").alias("size"), dealt(chunks, 1).alias("chunk"), every(groups).alias("grp"))
    right = anchors.select("*", F.size("vec").alias("size"), dealt(groups, 2).alias("grp"), every(chunks).alias("chunk"))
    keys, parts = ["size", "chunk", "grp"], max(tasks, 2 * chunks * groups)
    return (left.repartition(parts, *keys).groupBy(*keys), right.repartition(parts, *keys).groupBy(*keys))


def _ranked(df: DataFrame, by: list[str], score: str, name: str, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), name)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def positives(rows: DataFrame, anchors: DataFrame, n: int, sizes: tuple[int, int]) -> DataFrame:
    """``key`` and ``id`` of each anchor with its n best rows of the same label: ``positive_id``,
    ``positive_score``, ``rank``."""
    def run(key, left, right):
        empty = pa.table({"key": pa.array([], pa.int64()), "id": pa.array([], pa.int64()),
                          "positive_id": pa.array([], pa.int64()), "positive_score": pa.array([], pa.int64())})
        if not left.num_rows or not right.num_rows:
            return empty
        size = key[0].as_py()
        x, q = _exact(_matrix(left, size), _matrix(right, size))
        ids, labels = left["id"].to_numpy(), left["label"].to_numpy()
        own, want, keys = right["id"].to_numpy(), right["label"].to_numpy(), right["key"].to_numpy()
        found = []
        for label in np.unique(want):
            at, asked = np.flatnonzero(labels == label), np.flatnonzero(want == label)
            if len(at):
                index = Index(x[at])
                for some in np.array_split(asked, math.ceil(len(asked) / TOGETHER)):
                    a, r, p = fullest(index, ids[at], q[some], own[some], n)
                    found.append((some[a], at[r], p))
        if not found:
            return empty
        a, r, p = (np.concatenate(c) for c in zip(*found))
        return pa.table({"key": keys[a], "id": own[a], "positive_id": ids[r], "positive_score": p})
    left, right = _met(rows, anchors, *sizes)
    parts = left.cogroup(right).applyInArrow(run, "key long, id long, positive_id long, positive_score long")
    return _ranked(parts, ["key", "id"], "positive_score", "positive_id", n)


def negatives(rows: DataFrame, asked: DataFrame, n: int, percent: int, sizes: tuple[int, int]) -> DataFrame:
    """``asked``: anchors with ``wanted``, the array of their (positive_id, positive_score)."""
    schema = "key long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"

    def run(key, left, right):
        names = [f.split()[0] for f in schema.split(", ")]
        empty = pa.table({c: pa.array([], pa.int64()) for c in names})
        if not left.num_rows or not right.num_rows:
            return empty
        size = key[0].as_py()
        x, q = _exact(_matrix(left, size), _matrix(right, size))
        ids, labels = left["id"].to_numpy(), left["label"].to_numpy()
        own, mine, keys = right["id"].to_numpy(), right["label"].to_numpy(), right["key"].to_numpy()
        wanted = right["wanted"].to_pylist()
        width = max(map(len, wanted))
        high = np.full((len(wanted), width), None, dtype=object)
        partner = np.zeros((len(wanted), width), np.int64)
        for i, w in enumerate(wanted):
            for j, p in enumerate(w):
                high[i, j], partner[i, j] = p["positive_score"], p["positive_id"]
        index, found = Index(x), []
        for some in np.array_split(np.arange(len(q)), math.ceil(len(q) / TOGETHER)):
            a, w, r, p = windows(index, ids, lambda a, r, s=some: labels[r] != mine[s[a]], q[some], high[some], percent, n)
            found.append((some[a], w, r, p))
        a, w, r, p = (np.concatenate(c).astype(np.int64) for c in zip(*found))
        return pa.table({"key": keys[a], "anchor_id": own[a], "positive_id": partner[a, w],
                         "positive_score": np.array(high[a, w], dtype=np.int64), "negative_id": ids[r], "negative_score": p})
    left, right = _met(rows, asked, *sizes)
    parts = left.cogroup(right).applyInArrow(run, schema)
    return _ranked(parts, ["key", "anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", n)


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, percent: int = 80) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``. ``vectors``
    as ``prepare`` gives them; ``is_anchor`` is a condition on ``id``."""
    rows = written(vectors, "vectors")
    anchors = rows.filter(is_anchor)
    sizes = (rows.count(), anchors.count())
    near = written(positives(rows, anchors, n_positives, sizes), "positives")
    wanted = near.groupBy("key", "id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("wanted"))
    asked = anchors.join(wanted, ["key", "id"])  # at most n_positives entries an anchor
    out = negatives(rows, asked, n_negatives, percent, sizes)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
                      "negative_score")


by_value(__name__)

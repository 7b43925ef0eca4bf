"""Jaccard similarity self-join on word shingles by universe partitioning.

A text's set: the distinct 5-word shingles of its A-Z-lowered words (a shorter
text is one shingle; no words: the empty set, linked with nothing). Two sets
link when ``100 * |intersection| >= threshold * |union|``.

Method. Sets are put in size bands (below 64, then doubling). A pair belongs to
the band of its larger set; smaller sets from 75 % of a band's lower end take
part in it too. In a band, the universe of shingle hashes is cut into ``m``
segments. Linked sets of sizes l and s differ in at most
``H = (l+s)(100-t) // (100+t)`` shingles, so of any H+1 non-empty segments of
one of them at least one holds the same subset in the other: the pigeonhole.

* Signatures are hashes of (band, segment, subset). Empty segments give none.
* One-deletion neighbourhoods: on a band's first ``c`` segments the subsets
  with one shingle deleted are signatures too. Such a segment with two or more
  shingles finds sets which differ in it by one, and counts for two.
* Cost-based allocation: ``m`` is the smallest number whose expected non-empty
  segments exceed H+1 by four deviations at every size of the band; ``c`` is the
  smallest number with which every set of the corpus reaches H+1, found by an
  aggregate over all sets (0 as a rule). Where no ``c`` is enough, and below 64
  shingles, each shingle is a segment of its own, which always reaches H+1.
* A signature found in one set only is dropped. A set with H+1 or more such
  segments in a band has no partner there, and is dropped with the rest of its
  signatures: that is what frees sets which merely share a common passage.
* Of what is left, each set meets the two sets that are most central to its
  signatures, those with the fewest segments of their own (linear in the sets), and the pairs are verified exactly on their
  texts. Members then still in different components are compared where
  they can link: those that met the same centre by a prefix filter over their
  differences from it (``family_pairs``), others by the signatures that they need
  within the sizes that their unshared shingles leave in reach, and are verified. Links inside a component
  cannot change it, so no link between components is lost and a huge group of
  near copies costs a few comparisons a member.

Sets are named by a 64-bit hash of their shingle hashes, so equal sets are one
node however many documents have it; each task names a set once. (Two of n
different sets share a name with probability n*n/2^65.)

Scale: only signatures (two longs and a packed int), candidate pairs and the
texts of candidates are shuffled. The broadcast filter that picks the
candidates' texts has 2^26 bits whatever the input; the collected allocation
has one row per band.

Edge cases: null text: empty set; its component is its own id. A null id is
ignored as a smallest id. Repeated rows are equal sets. Extra columns pass
through ``representatives`` untouched, whatever their names. Empty table: empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import by_value, discard, written
from .graph import connected_components
from .text_hash import P1 as _P1
from .text_hash import P2 as _P2
from .text_hash import S32 as _S32
from .text_hash import mix as _mix
from .text_hash import text_chunks, word_hashes

SHINGLE = 5
THRESHOLD = 75
FIRST_BAND = 64
NEVER = 1 << 20          # a number of segments that no set has
FILTER_BITS = 26
RUN = 500_000            # signature rows that a task holds
COMMON = 8               # sets with a signature in a run from which on it is marked
HOT, PROOF = 1 << 60, 1 << 61
SALTS = 4096
CENTRES = 2
_SEGMENTS: dict[tuple[int, int], int] = {}


# --- sets ----------------------------------------------------------------------------

def _chunk_sets(b: np.ndarray, edges: np.ndarray, k: int):
    """Sorted distinct shingle hashes of each text; texts lie end to end in ``b``, cut at ``edges``."""
    words, at, _, _ = word_hashes(b, edges)
    if len(words) >= k:
        acc = np.full(len(words) - k + 1, k, np.uint64)
        for j in range(k):
            acc = _mix((acc + words[j:len(words) - k + 1 + j]) * _P1)
    for i in range(len(edges) - 1):
        n = at[i + 1] - at[i]
        if n >= k:
            s = np.sort(acc[at[i]:at[i + 1] - k + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        elif n:
            one = np.uint64(n)
            one = np.array([one])
            for w in words[at[i]:at[i + 1]]:
                one = _mix((one + w) * _P1)
            yield one
        else:
            yield np.empty(0, np.uint64)


def shingle_sets(column: pa.Array, k: int = SHINGLE):
    """The set of each text of a string column, read from its UTF-8 buffer."""
    for b, edges in text_chunks(column):
        yield from _chunk_sets(b, edges, k)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of one text's shingles."""
    return next(shingle_sets(pa.array([text], pa.string()), k))


def set_name(s: np.ndarray) -> int:
    """The node: a signed 64-bit hash of the set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


# --- bands and allocation --------------------------------------------------------------

def allowed_difference(l: int, s: int, t: int = THRESHOLD) -> int:
    return (l + s) * (100 - t) // (100 + t)


def band_of(n: int) -> int:
    return 0 if n < FIRST_BAND else (n // FIRST_BAND).bit_length()


def band_start(b: int) -> int:
    return 1 if b == 0 else FIRST_BAND << (b - 1)


def bands(n: int, t: int = THRESHOLD) -> list[int]:
    """The set's own band, and the next one if it can have partners there."""
    own = band_of(n)
    return [own, own + 1] if 100 * n >= t * band_start(own + 1) else [own]


def need(n: int, band: int, t: int = THRESHOLD) -> int:
    """Segments that must be looked up: one more than any partner in the band may differ in."""
    return allowed_difference(n, min(band_start(band + 1) - 1, n * 100 // t), t) + 1


def segments(band: int, t: int = THRESHOLD) -> int:
    """m of a band; 0: each shingle is a segment."""
    if (band, t) not in _SEGMENTS:
        _SEGMENTS[band, t] = _segments(band, t) if band else 0
    return _SEGMENTS[band, t]


def _segments(band: int, t: int) -> int:
    low, high = band_start(band), band_start(band + 1) - 1
    sizes = np.unique(np.linspace(low * t // 100, high, 40).astype(int))
    wanted = np.array([need(int(x), band, t) for x in sizes])
    m = int(wanted.max())
    while True:
        load = sizes / m
        empty = np.exp(-load)
        spread = np.sqrt(m * empty * (1 - (1 + load) * empty))
        if np.all(m * (1 - empty) - 4 * spread >= wanted):
            return m
        m = math.ceil(m * 1.01)


def cut(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment numbers and start positions of the non-empty segments of a sorted set."""
    seg = ((s >> _S32) * np.uint64(m)) >> _S32
    starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    return seg[starts], starts


def neighbourhoods_needed(s: np.ndarray, band: int, t: int = THRESHOLD) -> int:
    """How many first segments must carry one-deletion neighbourhoods for this set."""
    m = segments(band, t)
    if not m:
        return 0
    seg, starts = cut(s, m)
    missing = need(len(s), band, t) - len(seg)
    if missing <= 0:
        return 0
    sizes = np.diff(np.r_[starts, len(s)])
    double = seg[sizes >= 2]
    return int(double[missing - 1]) + 1 if len(double) >= missing else NEVER


def signatures(s: np.ndarray, band: int, c: int, t: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, int]:
    """Signature hashes, which of them are whole segments, and the slack: how many
    whole segments there are beyond those needed."""
    m = 0 if c >= NEVER else segments(band, t)
    salt = np.uint64((band + 1) * int(_P2) % (1 << 64))
    if not m:
        return _mix((s ^ salt) * _P1), np.ones(len(s), bool), len(s) - need(len(s), band, t)
    seg, starts = cut(s, m)
    mixed = _mix(s * _P1)
    total = np.add.reduceat(mixed, starts)
    place = (seg + np.uint64(1)) * _P1 + salt
    sig = _mix(total + place)
    whole = np.ones(len(sig), bool)
    if c:
        sizes = np.diff(np.r_[starts, len(s)])
        more = [np.repeat(total[i], sizes[i]) - mixed[starts[i]:starts[i] + sizes[i]]
                + place[i]
                for i in np.flatnonzero((seg < c) & (sizes >= 2))]
        if more:
            extra = _mix(np.concatenate(more))
            sig, whole = np.r_[sig, extra], np.r_[whole, np.zeros(len(extra), bool)]
    return sig, whole, int(whole.sum()) - need(len(s), band, t)


# --- passes over the texts ----------------------------------------------------------------

def _sets(batch: pa.RecordBatch, name: str):
    return shingle_sets(batch.column(batch.schema.get_field_index(name)))


def named_sets(docs: DataFrame, id_col: str, text: str, t: int = THRESHOLD) -> DataFrame:
    """``id``, ``node`` (null: empty set), ``n_shingles``, and the set's bands with the
    neighbourhoods needed there."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("node", T.LongType()),
                           T.StructField("n_shingles", T.LongType()),
                           T.StructField("need", T.ArrayType(T.StructType([
                               T.StructField("band", T.IntegerType()), T.StructField("c", T.IntegerType())])))])

    def run(batches):
        for b in batches:
            names, sizes, needs = [], [], []
            for s in _sets(b, "__text"):
                names.append(set_name(s) if len(s) else None)
                sizes.append(len(s))
                found = [(x, neighbourhoods_needed(s, x, t)) for x in bands(len(s), t)] if len(s) else []
                needs.append([{"band": x, "c": c} for x, c in found if c])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(needs, pa.list_(pa.struct([("band", pa.int32()), ("c", pa.int32())])))],
                names=["id", "node", "n_shingles", "need"])
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("__text")).mapInArrow(run, schema)


def signature_rows(docs: DataFrame, text: str, allocation: dict[int, int], t: int = THRESHOLD) -> DataFrame:
    """``sig``, ``node``, ``info`` = wholes * 2^32 + spare * 2^8 + band * 2 + whole; a task names a set once.
    Spare is the slack plus one, 0 for any set short of segments.

    A signature that ``COMMON`` sets or more have in one run of about ``RUN`` rows is shared, whatever other
    tasks have. Its rows are marked (``HOT``) and need not meet each other; two of them are repeated (``PROOF``) for the
    rows that other runs have of it. So no more rows of a signature meet than ``COMMON`` + 1 from a run."""
    def run(batches):
        seen: set[int] = set()
        for b in batches:
            sigs, nodes, infos, held = [], [], [], 0
            for s in _sets(b, "__text"):
                if not len(s) or (name := set_name(s)) in seen:
                    continue
                seen.add(name)
                for x in bands(len(s), t):
                    sig, whole, slack = signatures(s, x, allocation.get(x, 0), t)
                    sigs.append((sig >> np.uint64(16)).view(np.int64))  # 48 bits are enough to meet by
                    nodes.append(np.full(len(sig), name, np.int64))
                    spare = max(slack, -1) + 1
                    infos.append(((int(whole.sum()) << 32) + (spare << 8) + x * 2 + whole).astype(np.int64))
                    held += len(sig)
                if held > RUN:
                    yield _rows(sigs, nodes, infos)
                    sigs, nodes, infos, held = [], [], [], 0
            if held:
                yield _rows(sigs, nodes, infos)

    def _rows(*cols):
        sig, node, info = marked(*(np.concatenate(c) for c in cols))
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(node), pa.array(info)], names=["sig", "node", "info"])
    return docs.select(F.col(text).alias("__text")).mapInArrow(run, "sig long, node long, info long")


def marked(sig: np.ndarray, node: np.ndarray, info: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows with ``HOT`` set where their signature is common here, and two rows with ``PROOF`` for each such signature."""
    order = np.argsort(sig, kind="stable")
    start = np.flatnonzero(np.r_[True, sig[order][1:] != sig[order][:-1]])
    n = np.diff(np.r_[start, len(sig)])
    hot = n >= COMMON
    if not hot.any():
        return sig, node, info
    rows = order[np.repeat(hot, n)]
    proof = order[np.concatenate([start[hot], start[hot] + 1])]
    out = info.copy()
    out[rows] |= HOT
    return np.r_[sig, sig[proof]], np.r_[node, node[proof]], np.r_[out, info[proof] | PROOF]


def member_filter(nodes: DataFrame) -> np.ndarray:
    """Bit table of the nodes' low ``FILTER_BITS`` bits (false positives possible): at most
    2^20 words reach the driver, whatever the input."""
    bit = F.col("node").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = (nodes.select(F.shiftright(bit, 6).alias("w"),
                         F.expr(f"shiftleft(1L, CAST((node & {(1 << FILTER_BITS) - 1}) & 63 AS INT))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas())
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64)
    return table


def node_texts(docs: DataFrame, text: str, nodes: DataFrame) -> DataFrame:
    """One text for each node of ``nodes`` (and a few more)."""
    table = docs.sparkSession.sparkContext.broadcast(member_filter(nodes))

    def run(batches):
        bits, seen = table.value, set()
        for b in batches:
            names, texts = [], []
            for i, s in enumerate(_sets(b, "__text")):
                if not len(s):
                    continue
                name = set_name(s)
                low = name & ((1 << FILTER_BITS) - 1)
                if name not in seen and (int(bits[low >> 6]) >> (low & 63)) & 1:
                    seen.add(name)
                    names.append(name)
                    texts.append(b.column(0)[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(texts, pa.string())],
                                             names=["node", "text"])
    found = docs.select(F.col(text).alias("__text")).mapInArrow(run, "node long, text string")
    return found.dropDuplicates(["node"])


def verify(pairs: DataFrame, texts: DataFrame, t: int = THRESHOLD) -> DataFrame:
    """``a``, ``b`` and whether their texts' sets are ``linked``."""
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        last, kept = None, None
        for batch in batches:
            linked = []
            col = {n: batch.column(batch.schema.get_field_index(n)) for n in ("a", "b", "ta", "tb")}
            for i, other in enumerate(shingle_sets(col["tb"])):
                a = col["a"][i].as_py()
                if a != last:  # rows come sorted by a
                    last, kept = a, shingle_set(col["ta"][i].as_py())
                both = len(np.intersect1d(kept, other, assume_unique=True))
                linked.append(100 * both >= t * (len(kept) + len(other) - both))
            yield pa.RecordBatch.from_arrays([col["a"], col["b"], pa.array(linked, pa.bool_())], names=["a", "b", "linked"])
    joined = pairs.join(tb, "b").join(ta, "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean")


# --- the join ------------------------------------------------------------------------------

def shared_signatures(rows: DataFrame) -> DataFrame:
    """The signatures that two sets or more have, without those of sets that have no
    partner in their band: ``sig``, ``node``, ``kind`` (band * 2 + whole), ``slack`` (-1 for any
    set short of segments), and ``own``, the number of the set's segments that no other set has."""
    hot = F.col("info").bitwiseAND(F.lit(HOT)) != 0
    # marked rows are known to be shared: they only meet their own copies from other tasks
    by_sig = Window.partitionBy("sig", "__salt")
    rows = rows.withColumn("__salt", F.when(hot, F.pmod(F.col("node"), F.lit(SALTS))).otherwise(-1))
    some = (rows.withColumn("__first", F.min("node").over(by_sig))
            .withColumn("__last", F.max("node").over(by_sig))
            .withColumn("__before", F.lag("node").over(by_sig.orderBy("node")))
            .filter((hot | (F.col("__first") != F.col("__last"))) & (F.col("__before").isNull() | (F.col("__before") != F.col("node")))
                    & (F.col("info").bitwiseAND(F.lit(PROOF)) == 0)))
    rows = some.select("sig", "node", F.col("info").bitwiseAND(F.lit(HOT - 1)).alias("info"), F.expr("CAST((info >> 1) & 127 AS INT)").alias("band"))
    by_set = Window.partitionBy("node", "band")
    # a set's row may be marked in one task and not in another
    rows = rows.withColumn("__before", F.lag("sig").over(by_set.orderBy("sig"))).filter("__before IS NULL OR __before <> sig").drop("__before")
    shared = F.sum(F.expr("CAST(info & 1 AS INT)")).over(by_set)
    alive = rows.withColumn("shared", shared).filter("shared >= CAST((info >> 8) & 16777215 AS INT)")
    return alive.select("sig", "node", F.expr("CAST(info & 255 AS INT)").alias("kind"),
                        F.expr("CAST((info >> 8) & 16777215 AS INT) - 1").alias("slack"),
                        F.expr("CAST((info >> 32) - shared AS INT)").alias("own"))


def star_pairs(rows: DataFrame) -> DataFrame:
    """Sets (``b``) with the centres (``a``) of their signatures: of a signature's members the one
    with the fewest segments of its own, as an unedited original has among its edited copies.
    Each set meets the ``CENTRES`` that most of its signatures have; other pairs are left to
    ``crossing_pairs``, which leaves none out."""
    # a table of its own, so that the join may split a signature that very many sets have
    centres = written(rows.groupBy("sig").agg(F.min(F.struct("own", "node")).alias("c")).select("sig", F.col("c.node").alias("a")), "centres")
    met = rows.select("sig", F.col("node").alias("b")).join(centres, "sig").filter("a <> b").groupBy("a", "b").count()
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("count"), "a"))
    pairs = written(met.withColumn("__rank", rank).filter(f"__rank <= {CENTRES}").select("a", "b"), "star-pairs")
    discard(centres)
    return pairs


def pivots(tested: DataFrame) -> DataFrame:
    """``node``, ``pivot``: of the centres that a set met, and itself, the one that met most sets."""
    met = tested.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    both = (tested.select("a", F.col("b").alias("node")).join(met, "a")
            .unionByName(met.select("a", F.col("a").alias("node"), "n")))
    best = both.groupBy("node").agg(F.max(F.struct("n", (-F.col("a")).alias("c"))).alias("x"))
    return best.select("node", (-F.col("x.c")).alias("pivot"))


def memberships(tested: DataFrame, labels: DataFrame) -> DataFrame:
    """``node``, ``root``, ``pivot``, and ``near``: whether the set is in its pivot's component. Sets that
    met no centre and link with nothing are left out: they are their own root and pivot."""
    both = (pivots(tested).join(labels, "node", "full")
            .select("node", F.coalesce("root", "node").alias("root"), F.coalesce("pivot", "node").alias("pivot")))
    roots = labels.select(F.col("node").alias("pivot"), F.col("root").alias("__r"))
    return both.join(roots, "pivot", "left").select(
        "node", "root", "pivot", (F.coalesce("__r", "pivot") == F.col("root")).alias("near"))


def open_signatures(rows: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of signatures whose members lie in several components, with their memberships
    and whether the signature's members have several pivots (``mixed``).

    The pigeonhole again: a set shares more whole segments than it has slack with a partner in the band, and
    with a partner in another component all of these are open. Sets with fewer open ones in a band, such as
    those that share but a passage with other components, have no such partner and are left out there."""
    own_place = members.select(F.col("node").alias("__node"), "root", "pivot")
    at = (rows.drop("own").join(own_place, F.col("node") == F.col("__node"), "left").drop("__node")
          .withColumn("root", F.coalesce("root", "node")).withColumn("pivot", F.coalesce("pivot", "node")))
    at = written(at, "placed")
    ends = (at.groupBy("sig").agg(F.min("root").alias("__lo"), F.max("root").alias("__hi"), F.count(F.lit(1)).alias("n"),
                                  (F.min("pivot") != F.max("pivot")).alias("mixed")).filter("__lo <> __hi").select("sig", "n", "mixed"))
    ends = written(ends, "open-signatures")
    found = written(enough(at.join(ends, "sig")), "open")
    discard(at, ends)
    return found


def enough(found: DataFrame) -> DataFrame:
    """The rows of sets that have more whole segments left in a band than they have slack there."""
    in_band = F.sum(F.expr("kind & 1")).over(Window.partitionBy("node", F.expr("kind div 2")))
    return found.withColumn("__left", in_band).filter("__left > slack").drop("__left")


def needed_signatures(found: DataFrame) -> DataFrame:
    """The mixed rows of ``open_signatures``, and whether the set needs to look them up for a
    partner with another pivot (``probe``).

    Of its segments a set may leave out as many as it has slack. Those not shared, or not
    mixed, lead to no such partner: of the mixed ones, the most common are left out, and a set that has no more
    of them than slack is left out altogether.
    """
    own = Window.partitionBy("node", "kind")
    ranked = (enough(found.filter("mixed")).withColumn("__rank", F.row_number().over(own.orderBy("n", "sig")))
              .withColumn("__open", F.count(F.lit(1)).over(own)))
    return ranked.select("sig", "node", "root", "pivot",
                         F.expr("kind & 1 = 0 OR __rank <= __open - slack").alias("probe"))


def reach(texts: DataFrame, nodes: DataFrame, t: int = THRESHOLD) -> DataFrame:
    """``node``, ``size`` and ``most``: the largest size of a set that it can link with, given how
    many of its shingles no other set of ``nodes`` has.

    A set r with u such shingles has u or more outside any s; a link allows
    (|r| - |s| + H) / 2 of them, so |s| (100+t-(100-t)) <= |r| * 200 - 2 u (100+t).
    """
    def run(batches):
        for b in batches:
            for node, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), node, np.int64))],
                                                 names=["token", "node"])
    tokens = texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(run, "token long, node long")
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("one"))
    alone = df.filter("n = 1").groupBy(F.col("one").alias("node")).agg(F.count(F.lit(1)).alias("u"))
    sizes = tokens.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(alone, "node", "left").select("node", "size", F.expr(
        f"(size * 200 - 2 * coalesce(u, 0) * {100 + t}) div {2 * t}").alias("most"))


def difference_rows(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``node``, ``pivot``, ``token`` for each shingle in which a member (``node``, ``pivot``, ...)
    differs from its pivot."""
    tn = texts.select("node", F.col("text").alias("tn"))
    tp = texts.select(F.col("node").alias("pivot"), F.col("text").alias("tp"))

    def run(batches):
        last, centre = None, None
        for batch in batches:
            out = [[] for _ in range(3)]
            for i, s in enumerate(shingle_sets(batch.column(2))):
                pivot = batch.column(1)[i].as_py()
                if pivot != last:  # rows come sorted by pivot
                    last, centre = pivot, shingle_set(batch.column(3)[i].as_py())
                diff = np.setxor1d(s, centre, assume_unique=True)
                n = len(diff)
                for col, v in zip(out, (np.full(n, batch.column(0)[i].as_py()), np.full(n, pivot), diff.view(np.int64))):
                    col.append(v.astype(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out],
                                                 names=["node", "pivot", "token"])
    joined = members.select("node", "pivot").join(tn, "node").join(tp, "pivot").select("node", "pivot", "tn", "tp")
    return joined.mapInArrow(run, "node long, pivot long, token long")


def family_pairs(members: DataFrame, texts: DataFrame, t: int = THRESHOLD) -> DataFrame:
    """Candidate pairs among sets with the same pivot that lie in different components.

    With X the difference of a set from the pivot, r and s differ in |Xr ^ Xs|
    shingles, so a link needs o = (|Xr| + |Xs| - H) / 2 of them in common. (Where
    o <= 0 both link with the pivot itself, and are in one component.) Then, with X
    ordered by rarity, the first |X| - o + 1 of either share one: at most H + 1 of the larger
    difference and H / 2 + 1 of the smaller, the only ones that are kept. What an edited copy
    alone has comes first, so copies that were edited differently don't meet,
    however many there are. ``members``: ``node``, ``size``, ``pivot``, ``root``, ``near``
    (in the pivot's component).
    """
    rows = difference_rows(members, texts)
    rarity = F.count(F.lit(1)).over(Window.partitionBy("pivot", "token"))
    own = Window.partitionBy("node")
    rows = (rows.withColumn("df", rarity).withColumn("rank", F.row_number().over(own.orderBy("df", "token")))
            .withColumn("d", F.count(F.lit(1)).over(own)).filter("df > 1").drop("df"))
    # |Xs| >= |Xr| - H, or o would be more than Xs has: no more than H + 1 of any difference can be a prefix
    most = f"(size + size * 100 div {t}) * {100 - t} div {100 + t}"
    rows = rows.join(members.select("node", "size", "root", "near"), "node").filter(f"rank <= {most} + 1")
    rows = written(rows, "differences")
    # the smaller difference is looked up: its prefix for any partner in another component
    first = f"least(IF(near, d * 100 div {100 + t}, d), {most} div 2) + 2"
    probe = rows.filter(f"rank <= {first}").select(
        "pivot", "token", F.col("node").alias("p"), F.col("d").alias("pd"), F.col("size").alias("ps"),
        F.col("root").alias("pr"), F.col("rank").alias("pk"))
    need = f"(d + pd - (size + ps) * {100 - t} div {100 + t})"
    met = probe.join(rows, ["pivot", "token"]).filter(
        f"pr <> root AND (pd < d OR pd = d AND p < node) AND {need} <= 2 * pd AND 2 * pk <= 2 * pd - {need} + 2"
        f" AND 2 * rank <= 2 * d - {need} + 2 AND size * 100 >= ps * {t} AND ps * 100 >= size * {t}")
    pairs = written(met.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct(), "family-pairs")
    discard(rows)
    return pairs


def stranger_pairs(found: DataFrame, texts: DataFrame, t: int = THRESHOLD) -> DataFrame:
    """Candidate pairs among sets with different pivots that lie in different components: those
    that share a signature which the larger one needs.

    Sets meet by signature and size class (5 % wide), and only within each other's
    ``reach``.
    """
    found = written(found, "mixed")
    known = written(reach(texts, found.select("node").distinct(), t), "reach")
    size_class = lambda c: F.floor(F.log(c.cast("double")) / math.log(1.05)).cast("int")
    rows = found.join(known, "node").filter(f"most * 100 >= size * {t}")
    probe = rows.filter("probe").select(
        "sig", F.col("node").alias("p"), F.col("root").alias("pr"), F.col("size").alias("ps"), F.col("most").alias("pm"),
        F.col("pivot").alias("pp"),
        F.explode(F.sequence(size_class(F.ceil(F.col("size") * t / 100)), size_class(F.least("size", "most")))).alias("class"))
    index = rows.select("sig", "node", "root", "size", "most", "pivot", size_class(F.col("size")).alias("class"))
    met = probe.join(index, ["sig", "class"]).filter(
        f"pr <> root AND pp <> pivot AND size <= ps AND size <= pm AND ps <= most AND size * 100 >= ps * {t}")
    pairs = written(met.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct(), "stranger-pairs")
    discard(found, known)
    return pairs


def crossing_pairs(rows: DataFrame, sizes: DataFrame, labels: DataFrame, tested: DataFrame, texts: DataFrame,
                   t: int = THRESHOLD) -> DataFrame:
    """Candidate pairs of sets in different components. ``sizes``: ``node``, ``size``."""
    places = written(memberships(tested, labels), "members")
    found = open_signatures(rows, places)
    members = found.select("node", "root", "pivot").distinct()
    split = members.groupBy("pivot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    family = (members.join(split.select("pivot"), "pivot").join(sizes, "node")
              .join(places.select("node", "near"), "node", "left").withColumn("near", F.coalesce("near", F.lit(True))))
    family = written(family, "family")
    pairs = family_pairs(family, texts, t).unionByName(stranger_pairs(needed_signatures(found), texts, t)).distinct()
    discard(places, found, family)
    return pairs


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", t: int = THRESHOLD) -> DataFrame:
    """One row per document: ``id``, ``node``, ``n_shingles``, ``component_id`` (the smallest id
    that can be reached by links)."""
    named = written(named_sets(docs, id_col, text, t), "sets")
    wanted = (named.select(F.explode("need").alias("x")).groupBy("x.band").agg(F.max("x.c").alias("c")).collect())
    allocation = {r["band"]: r["c"] for r in wanted}  # at most one row per band
    rows = written(shared_signatures(signature_rows(docs, text, allocation, t)), "shared")
    texts = written(node_texts(docs, text, rows.select("node").distinct()), "candidates")
    tested = written(verify(star_pairs(rows), texts, t), "tested")
    links = tested.filter("linked")
    labels = connected_components(links)
    sizes = named.filter("node IS NOT NULL").groupBy("node").agg(F.max("n_shingles").alias("size"))
    more = written(verify(crossing_pairs(rows, sizes, labels, tested, texts, t), texts, t).filter("linked"), "links")
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))
    discard(rows, texts, tested, more)  # what is left reads the sets and the labels
    sets = named.filter("node IS NOT NULL")
    roots = (sets.groupBy("node").agg(F.min("id").alias("__id"))
             .join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = roots.groupBy("root").agg(F.min("__id").alias("component_id"))
    by_node = roots.join(least, "root").select("node", "component_id")
    linked = sets.join(by_node, "node").select("id", "node", "n_shingles", "component_id")
    alone = named.filter("node IS NULL").select("id", "node", "n_shingles", F.col("id").alias("component_id"))
    return linked.unionByName(alone)


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", t: int = THRESHOLD) -> DataFrame:
    """The documents that stay: of each component the one with the smallest id (documents
    with an empty set all stay), with all columns of ``docs``."""
    cols = docs.columns
    found = components(docs, id_col, text, t).filter(F.col("id").eqNullSafe(F.col("component_id")))
    rows_of = found.groupBy("component_id", "node").agg(F.count(F.lit(1)).alias("n"))
    best = rows_of.groupBy("component_id", F.isnull("node").alias("__e")).agg(
        F.min("node").alias("__node"), F.max("n").alias("n"))
    keys = written(best.select(F.col("component_id").alias("__id"), F.coalesce("__node", F.lit(0)).alias("__node"), "n"), "keep")
    schema = T.StructType([*docs.schema.fields, T.StructField("__set", T.LongType())])

    def run(batches):
        for b in batches:
            names = []
            for s in _sets(b, text):
                names.append(set_name(s) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.int64())], names=[*cols, "__set"])
    rows = docs.mapInArrow(run, schema)
    kept = rows.join(keys.drop("n"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__set") == F.col("__node")), "left_semi")
    if not keys.filter("n > 1").isEmpty():  # rows repeated with id and text: one of them stays
        kept = kept.dropDuplicates([id_col, "__set"])
    return kept.select(*cols)


by_value(__name__)

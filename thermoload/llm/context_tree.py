"""Language-model scoring by context-tree weighting over bytes.

A text is the sequence of its words (A-Z lowered), one space between two, and an
end mark; its start is preceded by end marks. Each byte is eight binary decisions
down a tree of bit prefixes. A node (context of the last d bytes, prefix), for
every d from 0 to ``DEPTH``, counts the zeros and ones that followed it in the
training texts.

Training. Each task counts the (context, byte) grams of its texts and Spark adds
them up, so the counts cover all training documents. From the deepest level up,
one grouped sum per level gives every node's Krichevsky-Trofimov probability Pe
and weighted probability Pw = (Pe + product of the children's Pw) / 2. A node's
share is w = Pe / (Pe + product of the children's Pw).

Scoring. A bit's probability mixes the estimates of all depths along its context:
w * KT + (1 - w) * (the same one byte deeper); the deepest node seen in training
takes the whole rest. From the root down, one join per level (a node with its parent
context's) carries the mixture made so far and the weight left over, so a deepest node
has the bit's probability. Grams of texts outside the training take part in the tree
with counts of zero, which change no other node; such a node has its parent's
probability. Eight nodes make a gram's log-probability: every gram of the corpus has
an exact one, in a table that grows with the corpus.

The most frequent grams (by a count threshold, at most ``GRAM_SLOTS``) are broadcast
as a cache with their full keys, 2^``SLOT_BITS`` slots whatever the corpus (64 MB). A
text's other grams meet their log-probabilities in a join and are summed back.

The unigram baseline is exact: counts of the most frequent words, as many as fit
``WORD_SLOTS`` (by a count threshold, so ties fall on one side), are broadcast;
all other words of the texts meet their counts in a join. Words are compared by
64-bit hashes.

Edge cases: null text: empty, only its end token. Without training texts every
bit has probability 1/2. A null id counts as the empty text for the split.
Repeated rows are rows like any other; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, written
from .text_hash import P1, mix, tables, text_chunks, word_hashes

DEPTH = 5
SLOT_BITS = 22
GRAM_SLOTS = 1 << 21
GROUPS = 64        # steps in which the cache is filled
BINS = 16          # bins of counts for each doubling
PROBES = 4         # slots that may hold a gram; one that finds them taken is joined like a rare one
OUTSIDE = 62       # key bit of grams and words outside the training, while they are counted
WORD_SLOTS = 1 << 19
END = 10           # the end mark's byte; no word holds it
HELD = 1 << 20     # bytes of text whose scores a task holds before it hands them on
FLUSH = 1_000_000  # distinct grams that a task holds before it hands them on


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


# --- streams of bytes ----------------------------------------------------------------------

def byte_keys(b: np.ndarray, edges: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray,
              depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(keys, text of each): a key holds a byte and, above it, the ``depth`` bytes before."""
    n = len(edges) - 1
    keep = np.append(~tables(1)[1][b], False)
    follows = np.ones(len(ends), bool)
    lasts = at[1:][at[1:] > at[:-1]] - 1             # a text's last word has no space after it
    follows[lasts] = False
    keep[ends[follows] + 1] = True
    pos = np.flatnonzero(keep)
    text = np.repeat(np.arange(n), np.diff(np.r_[0, np.cumsum(keep)][edges]))
    low = b[pos].copy()
    low[(low >= 65) & (low <= 90)] += 32
    low[tables(1)[1][low]] = 32
    out = np.full(len(pos) + n * (depth + 1), END, np.uint8)
    out[np.arange(len(pos)) + text * (depth + 1) + depth] = low
    sizes = np.bincount(text, minlength=n) + 1       # bytes to code, with the end mark
    first = np.cumsum(sizes + depth) - sizes
    target = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    keys = out[target].astype(np.uint64)
    for d in range(1, depth + 1):
        keys |= out[target - d].astype(np.uint64) << np.uint64(8 * d)
    return keys, np.repeat(np.arange(n), sizes)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def corpus_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``kind`` (0: grams, 1: words, 2: texts), ``key``, ``n`` (in training texts), ``m`` (grams: in all texts)
    from columns ``text`` and ``train``: partial counts by task, added up."""
    def run(batches):
        held = {0: [], 1: []}
        sizes, texts = {0: 0, 1: 0}, 0
        bit = np.uint64(1 << OUTSIDE)

        def rows(kind):
            keys, m = _merge(held[kind])
            held[kind], sizes[kind] = [], 0
            n = np.where(keys & bit, 0, m) if kind == 0 else m
            keys = keys & ~bit if kind == 0 else keys
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)),
                                               pa.array(n.astype(np.int64)), pa.array(m.astype(np.int64))],
                                              names=["kind", "key", "n", "m"])
        for batch in batches:
            train, first = batch.column(1).to_numpy(zero_copy_only=False).astype(bool), 0
            for b, edges in text_chunks(batch.column(0)):
                words, at, starts, ends = word_hashes(b, edges)
                inside = train[first:first + len(edges) - 1]
                first += len(edges) - 1
                texts += int(inside.sum())
                keys, whose = byte_keys(b, edges, at, starts, ends, depth)
                keys = np.where(inside[whose], keys, keys | bit)
                for kind, found in ((0, keys), (1, words[np.repeat(inside, np.diff(at))])):
                    if len(found):
                        part = np.unique(found, return_counts=True)
                        held[kind].append(part)
                        sizes[kind] += len(part[0])
                    if sizes[kind] > 2 * FLUSH:
                        held[kind] = [_merge(held[kind])]
                        sizes[kind] = len(held[kind][0][0])
                        if sizes[kind] > FLUSH:
                            yield rows(kind)
        for kind in (0, 1):
            if held[kind]:
                yield rows(kind)
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64()),
                                              pa.array([texts], pa.int64())], names=["kind", "key", "n", "m"])
    parts = docs.mapInArrow(run, "kind int, key long, n long, m long")
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


# --- the tree ----------------------------------------------------------------------------------

def _lgamma(x: str) -> str:
    """log Gamma by Stirling's series, eight steps up."""
    z = f"({x} + 8)"
    steps = " * ".join(f"({x} + {i})" for i in range(8))
    return (f"(({z} - 0.5) * ln({z}) - {z} + 0.9189385332046727 + 1 / (12 * {z}) - 1 / (360 * {z} * {z} * {z})"
            f" - ln({steps}))")


_LOG_KT = f"({_lgamma('(n0 + 0.5D)')} + {_lgamma('(n1 + 0.5D)')} - {_lgamma('(n0 + n1 + 1D)')} - 1.1447298858494002)"


def tree_levels(grams: DataFrame, depth: int = DEPTH) -> list[DataFrame]:
    """From the deepest level to the root: ``depth``, ``ctx``, ``node``, ``n0``, ``n1``, ``w``, ``lpw``."""
    bits = grams.select(F.expr("shiftrightunsigned(key, 8)").alias("ctx"), F.expr("key & 255").alias("byte"), "n",
                        F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    bits = bits.select("ctx", F.expr("CAST(shiftleft(1L, j) | shiftright(byte, 8 - j) AS INT)").alias("node"),
                       F.expr("CASE WHEN shiftright(byte, 7 - j) & 1 = 0 THEN n ELSE 0L END").alias("n0"),
                       F.expr("CASE WHEN shiftright(byte, 7 - j) & 1 = 1 THEN n ELSE 0L END").alias("n1"))
    below, out = bits.withColumn("lpw", F.lit(0.0)), []
    for d in range(depth, -1, -1):
        sums = (below.select(F.expr(f"ctx & {(1 << 8 * d) - 1}L").alias("ctx"), "node", "n0", "n1", "lpw")
                .groupBy("ctx", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lpw").alias("deeper")))
        level = sums.withColumn("pe", F.expr(f"IF(n0 + n1 = 0, 0D, {_LOG_KT})"))
        if d == depth:
            level = level.withColumn("w", F.lit(1.0)).withColumn("lpw", F.col("pe"))
        else:
            level = (level.withColumn("w", F.expr("1 / (1 + exp(least(deeper - pe, 700D)))"))
                     .withColumn("lpw", F.expr("greatest(pe, deeper) + ln(1 + exp(-abs(pe - deeper))) - ln(2D)")))
        level = written(level.select(F.lit(d).alias("depth"), "ctx", "node", "n0", "n1", "w", "lpw"), f"level{d}")
        out.append(level)
        below = level
    return out


def mixed_level(levels: list[DataFrame]) -> DataFrame:
    """``ctx``, ``node`` and ``p`` of the deepest level: the probability of a one there. ``a`` and ``r`` are
    the mixture of the depths so far and the weight left to deeper ones."""
    one = "(n1 + 0.5D) / (n0 + n1 + 1D)"
    above = None
    for d, level in enumerate(reversed(levels)):
        if above is None:
            rows = level.selectExpr("*", "0D AS a0", "1D AS r0", "0.5D AS p0")
        else:
            up = above.selectExpr("ctx AS c0", "node AS k0", "a AS a0", "r AS r0", "p AS p0")
            rows = level.join(up, (F.expr(f"ctx & {(1 << 8 * (d - 1)) - 1}L") == F.col("c0")) & (F.col("node") == F.col("k0")))
        above = rows.selectExpr("ctx", "node", f"IF(n0 + n1 = 0, p0, a0 + r0 * {one}) AS p",
                                f"a0 + r0 * w * {one} AS a", "r0 * (1 - w) AS r")
    return above.select("ctx", "node", "p")


def gram_logs(grams: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``key``, ``m`` and ``log10p``, the exact log10 P(byte | the bytes before), of every gram of the corpus."""
    # a context has at most 255 nodes and 256 bytes: they meet in one row, the bytes numbered from 256
    bytes_of = grams.selectExpr("shiftrightunsigned(key, 8) AS ctx", "CAST(256 + (key & 255) AS INT) AS node",
                                "CAST(m AS DOUBLE) AS p")
    rows = (mixed_level(levels).unionByName(bytes_of).groupBy("ctx")
            .agg(F.collect_list(F.struct("node", "p")).alias("x")).selectExpr("ctx", "x.node AS node", "x.p AS p"))

    def run(batches):
        for b in batches:
            for first in range(0, b.num_rows, 4096):
                part = b.slice(first, 4096)
                ctx = part.column(0).to_numpy().view(np.uint64)
                row = np.repeat(np.arange(len(ctx)), part.column(1).value_lengths().to_numpy())
                node, value = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
                table = np.full((len(ctx), 256), 0.5)
                inner = node < 256
                table[row[inner], node[inner]] = value[inner]
                row, byte, m = row[~inner], node[~inner] - 256, value[~inner]
                total = np.zeros(len(row))
                for j in range(8):
                    one = table[row, (1 << j) | (byte >> (8 - j))]
                    total += np.log10(np.where((byte >> (7 - j)) & 1, one, 1 - one))
                keys = (ctx[row] << np.uint64(8)) | byte.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(m.astype(np.int64)), pa.array(total)],
                                                 names=["key", "m", "log10p"])
    return rows.mapInArrow(run, "key long, m long, log10p double")


EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)  # no gram: keys have 8 * (DEPTH + 1) bits


def gram_cache(keys: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and log-probabilities by slot; of the ``PROBES`` slots after its own a key takes the first free one.
    Keys come in order of falling count and are placed in groups: what finds no slot (a few of the last) is
    rarer than what has taken its slots."""
    bits = SLOT_BITS
    held, value = np.full(1 << bits, EMPTY), np.zeros(1 << bits)
    home = (mix(keys * P1) & np.uint64((1 << bits) - 1)).astype(np.int64)
    for left in np.array_split(np.arange(len(keys)), GROUPS):
        for k in range(PROBES):
            at = (home[left] + k) & ((1 << bits) - 1)
            free = held[at] == EMPTY
            _, first = np.unique(at[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            held[at[taken]], value[at[taken]] = keys[left[taken]], logs[left[taken]]
            left = np.delete(left, taken)
    return held, value


def cached_logs(keys: np.ndarray, cache: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability or 0, whether the cache has it) of each key."""
    held, value = cache
    at = (mix(keys * P1) & np.uint64(len(held) - 1)).astype(np.int64)
    hit = held[at] == keys
    logs = np.where(hit, value[at], 0.0)
    left = np.flatnonzero(~hit)
    for k in range(1, PROBES):
        place = (at[left] + k) & (len(held) - 1)
        found = held[place] == keys[left]
        logs[left[found]], hit[left[found]] = value[place[found]], True
        left = left[~found]
    return logs, hit


# --- scoring -------------------------------------------------------------------------------------

def frequent(rows: DataFrame, count: str, value: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of the most frequent rows, at most ``most``, in order of falling count. The threshold lies
    between two of at most 64 * ``BINS`` logarithmic bins of counts, so ties fall on one side."""
    bin_of = F.floor(F.log2(F.col(count).cast("double")) * BINS).cast("int")
    by_bin = rows.filter(F.col(count) > 0).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("k")).collect()
    least, held = None, 0
    for n, k in sorted(((r["bin"], r["k"]) for r in by_bin), reverse=True):
        if held + k > most:
            break
        least, held = n, held + k
    if least is None:
        return np.empty(0, np.uint64), np.empty(0)
    got = rows.filter((F.col(count) > 0) & (bin_of >= least)).select("key", value, F.col(count).alias("__n")).toArrow()
    order = np.argsort(-got.column("__n").to_numpy(), kind="stable")
    return got.column("key").to_numpy().view(np.uint64)[order], got.column(value).to_numpy()[order]


def score(docs: DataFrame, train_filter: Column, id_col: str = "doc_id", text: str = "text",
          depth: int = DEPTH) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``,
    ``score``, ``bytes`` (with the end mark) and ``bits_per_byte``."""
    spark = docs.sparkSession
    marked = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(train_filter, F.lit(False)).alias("train"))
    counts = written(corpus_counts(marked, depth), "counts")
    grams = counts.filter("kind = 0").select("key", "n", "m")
    logs_by_gram = written(gram_logs(grams, tree_levels(grams, depth)), "grams")
    words = counts.filter("kind = 1").select("key", "n")
    sums = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    ends = counts.filter("kind = 2").agg(F.sum("n")).first()[0] or 0
    total = (sums[0] or 0) + ends
    norm = total + 0.5 * ((sums[1] or 0) + (1 if ends else 0) + 1)
    common, times = frequent(words, "n", "n", WORD_SLOTS)
    order = np.argsort(common)
    common, times = common[order], times[order]
    sent = spark.sparkContext.broadcast((gram_cache(*frequent(logs_by_gram, "m", "log10p", GRAM_SLOTS)), common, times))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        cache, keys_of, times_of = sent.value
        logs_of = np.log10((times_of + 0.5) / norm)
        end_log = np.log10((ends + 0.5) / norm)

        def lists_of(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
            cuts = np.r_[0, np.cumsum(np.bincount(owner, minlength=n))]
            return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.view(np.int64)))
        for batch in batches:
            out, begin, upto, size = [[] for _ in range(7)], 0, 0, 0
            for b, edges in text_chunks(batch.column(2)):
                n = len(edges) - 1
                found, at, starts, stops = word_hashes(b, edges)
                owner = np.repeat(np.arange(n), np.diff(at))
                place = np.minimum(np.searchsorted(keys_of, found), max(len(keys_of) - 1, 0))
                known = keys_of[place] == found if len(keys_of) else np.zeros(len(found), bool)
                base = np.bincount(owner[known], logs_of[place[known]], n) + end_log
                keys, whose = byte_keys(b, edges, at, starts, stops, depth)
                logs, hit = cached_logs(keys, cache)
                out[0].append(np.diff(at) + 1)
                out[1].append(np.bincount(owner[known], minlength=n) + (1 if ends else 0))
                out[2].append(base)
                out[3].append(np.bincount(whose, logs, n))
                out[4].append(np.bincount(whose, minlength=n))
                out[5].append(lists_of(found[~known], owner[~known], n))
                out[6].append(lists_of(keys[~hit], whose[~hit], n))
                upto, size = upto + n, size + len(b)
                if size >= HELD or upto == batch.num_rows:  # the lists of rare grams are longer than the texts
                    flat = [np.concatenate(x) for x in out[:5]]
                    some = batch.slice(begin, upto - begin)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0), some.column(1), pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.int64)),
                         pa.array(flat[2]), pa.array(flat[3]), pa.array(flat[4].astype(np.int64)),
                         pa.concat_arrays(out[5]), pa.concat_arrays(out[6])],
                        names=["row", "id", "n_tokens", "known", "base", "logs", "bytes", "rare", "grams"])
                    out, begin, size = [[] for _ in range(7)], upto, 0
    scored = written(rows.mapInArrow(
        run, f"row long, id {kind}, n_tokens long, known long, base double, logs double, bytes long, "
        "rare array<long>, grams array<long>"), "scored")
    rare = scored.select("row", F.explode("rare").alias("key")).join(words.select("key", "n"), "key", "left")
    more = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("__k"),
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / norm)).alias("__b"))
    deep = (scored.select("row", F.explode("grams").alias("key")).join(logs_by_gram.select("key", "log10p"), "key")
            .groupBy("row").agg(F.sum("log10p").alias("__s")))
    total_log = F.col("logs") + F.coalesce("__s", F.lit(0.0))
    return scored.drop("rare", "grams").join(more, "row", "left").join(deep, "row", "left").select(
        "id", "n_tokens", (F.col("known") + F.coalesce("__k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("__b", F.lit(0.0))).alias("base_score"),
        total_log.alias("score"), "bytes", (-total_log / F.col("bytes") * float(np.log2(10))).alias("bits_per_byte"))


by_value(__name__)

"""Variable-capacity best-fit packing of documents into training sequences.

Documents are dealt to shards of about ``shard_words`` words, and each shard is packed by itself. The
shard follows from a hash of id, text and how many equal rows the task has read before, so rows
that repeat are spread over all shards too: a shard is a bounded group however large the corpus is and
whatever it repeats (only one document longer than a shard makes its shard longer). In a shard:

1. a document longer than the largest permitted length is split into pieces of
   that length and a rest;
2. pieces are placed longest first, each in the open bin with the least room
   that still holds it (best fit);
3. a piece that fits nowhere opens a bin of the least-cost permitted length. A
   length's cost per useful word is (length + overhead) / (piece + what shorter
   pieces still to come can add), so all lengths are weighed jointly: a long bin
   where there are pieces left to fill it, a short one otherwise;
4. at the end each bin is downsized to the shortest permitted length that holds
   its contents.

Edge cases: null or wordless texts have nothing to place and give no piece; null
ids and repeated rows are placed like any other; an empty table gives no bin.
Extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, by_value, n_words

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16          # words' worth of cost for each sequence
SHARD_WORDS = 1_000_000
_WORD = re.compile(WORD)


def split_pieces(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of every piece."""
    parts = -(-sizes // longest)
    row = np.repeat(np.arange(len(sizes)), parts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = at * longest
    return row, start, np.minimum(longest, sizes[row] - start)


def best_fit(lengths: np.ndarray, permitted: tuple[int, ...] = LENGTHS,
             overhead: int = OVERHEAD) -> tuple[np.ndarray, list[int]]:
    """Bin of each piece (``lengths`` must fall), and each bin's contents."""
    caps = sorted(permitted)
    rest_mass = np.r_[np.cumsum(lengths[::-1])[::-1], 0]  # words of pieces i, i+1, ...
    falling = -lengths
    room: dict[int, list[int]] = {}
    open_mask = 0          # bit r: there is a bin with r words of room
    used: list[int] = []
    bins = np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = open_mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_mask &= ~(1 << r)
        else:
            best = None
            for c in caps:
                if c < n:
                    continue
                first = max(i + 1, int(np.searchsorted(falling, -(c - n), "left")))  # pieces of c - n words at most
                useful = n + min(c - n, int(rest_mass[min(first, len(lengths))]))
                cost = (c + overhead) / useful
                if best is None or cost <= best[0]:
                    best = (cost, c)
            r, b = best[1], len(used)
            used.append(0)
        used[b] += n
        left = r - n
        if left:
            room.setdefault(left, []).append(b)
            open_mask |= 1 << left
        bins[i] = b
    return bins, used


def downsized(used: list[int], permitted: tuple[int, ...] = LENGTHS) -> np.ndarray:
    caps = np.array(sorted(permitted))
    return caps[np.searchsorted(caps, np.array(used, np.int64), "left")]


def pack_shard(pdf: pd.DataFrame, permitted: tuple[int, ...], overhead: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["id", "hash"], na_position="first", kind="stable").reset_index(drop=True)
    row, start, n = split_pieces(pdf["size"].to_numpy(np.int64), max(permitted))
    order = np.argsort(-n, kind="stable")
    row, start, n = row[order], start[order], n[order]
    bins, used = best_fit(n, permitted, overhead)
    caps = downsized(used, permitted)
    out = pd.DataFrame({
        "bin_id": (int(pdf["shard"].iloc[0]) << 32) + bins, "capacity": caps[bins].astype(np.int64),
        "used": np.array(used, np.int64)[bins], "slot": pd.Series(bins).groupby(bins).cumcount().to_numpy(np.int64),
        "id": pdf["id"].to_numpy(object)[row] if pdf["id"].isna().any() else pdf["id"].to_numpy()[row],
        "start": start, "n_words": n})
    if "text" in pdf:
        texts, sizes = pdf["text"].tolist(), pdf["size"].tolist()
        cut = {}

        def piece(r, s, k):
            if k == sizes[r]:
                return texts[r]
            if r not in cut:
                cut[r] = _WORD.findall(texts[r])
            return " ".join(cut[r][s:s + k])
        out["text"] = [piece(*x) for x in zip(row.tolist(), start.tolist(), n.tolist())]
    return out


def _sharded(docs: DataFrame, id_col: str, text: str, shard_words: int, with_text: bool) -> DataFrame:
    """``id``, ``hash``, ``text`` (if asked for), ``size`` and ``shard`` of every document with a word."""
    total = docs.agg(F.sum(n_words(text))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    out = T.StructType([*rows.schema.fields[:3 if with_text else 2], T.StructField("size", T.LongType()),
                        T.StructField("copy", T.LongType())])

    def run(batches):
        before: Counter = Counter()
        for b in batches:
            copies = []
            for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                copies.append(before[key])
                before[key] += 1
            sizes = [len((t.as_py() or "").encode().split()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3 if with_text else 2], pa.array(sizes, pa.int64()),
                                              pa.array(copies, pa.int64())], names=out.names)
    return (rows.mapInArrow(run, out).filter("size > 0")
            .withColumn("shard", F.pmod(F.xxhash64("id", "hash", "copy"), F.lit(shards))).drop("copy"))


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", permitted: tuple[int, ...] = LENGTHS,
         overhead: int = OVERHEAD, shard_words: int = SHARD_WORDS, with_text: bool = False) -> DataFrame:
    """One row per placed piece: ``bin_id``, ``capacity``, ``used``, ``slot``, the id,
    ``start`` and ``n_words`` of the piece in its document, and its ``text`` if asked for."""
    rows = _sharded(docs, id_col, text, shard_words, with_text)
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("bin_id", "capacity", "used", "slot")]
                       + [T.StructField("id", kind)] + [T.StructField(c, T.LongType()) for c in ("start", "n_words")]
                       + ([T.StructField("text", T.StringType())] if with_text else []))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(pdf, permitted, overhead)
    return rows.groupBy("shard").applyInPandas(run, out).withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", permitted: tuple[int, ...] = LENGTHS,
              overhead: int = OVERHEAD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per sequence: ``bin_id``, ``capacity``, ``n_words``, ``doc_ids`` and ``texts`` in slot order.
    A bin lies within its shard, so the texts are shuffled once."""
    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("bin_id", "capacity", "n_words")]
                       + [T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("texts", T.ArrayType(T.StringType()))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = pack_shard(pdf, permitted, overhead).sort_values(["bin_id", "slot"])
        pieces["id"] = [None if pd.isna(x) else x for x in pieces["id"].astype(object)]
        groups = pieces.groupby("bin_id", sort=True)
        first = groups[["capacity", "used"]].first().reset_index()
        return pd.DataFrame({"bin_id": first["bin_id"], "capacity": first["capacity"], "n_words": first["used"],
                             "doc_ids": groups["id"].apply(list).to_numpy(object),
                             "texts": groups["text"].apply(list).to_numpy(object)})
    return _sharded(docs, id_col, text, shard_words, True).groupBy("shard").applyInPandas(run, out)


by_value(__name__)

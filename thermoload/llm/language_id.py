"""Language identification by error-correcting output codes.

Every language has a codeword of -1 and +1. For each bit a binary n-gram
classifier tells the languages with +1 from those with -1: the mean, over the
hashed byte bigrams and trigrams of the lower-cased text, of the log-odds of a
gram on either side. Its counts come from all training documents; each
language counts equally within its side.

Decoding is loss-weighted: a language's loss is the sum over the bits of
weight * exp(-codeword bit * margin), the nearest codeword wins, and the score is
the softmax of the negative losses. A bit's weight is log((1-e)/e) of its error
rate e, measured on a training sample: about ``CALIBRATION`` documents (all, if there are fewer), each chosen
by a hash of its id, text and place in the input, so that copies are chosen one by one (the one bounded sample here; margins are scaled on it
too). A prediction is ambiguous where the second codeword is nearly as near.

Up to five languages the code is exhaustive (every split of the languages once);
beyond, it has ``BITS_PER_LANGUAGE_BIT`` random bits per bit of log2(languages), the
draw with the largest smallest distance of a fixed number of seeded draws.

Scale: the counts are a table of (language, gram bucket), at most
languages * 2^16 rows whatever the corpus, made by partial sums; the broadcast
weights are 2^16 times the number of bits. Prediction needs no shuffle.

Edge cases: a null text or one without a letter is ``und`` with score 0; a null
``lang`` is not learned from; with one language that one is predicted with score
1, with none every text is ``und``. A null id counts as the empty text for the
split. Repeated rows are rows like any other; extra columns are not looked at.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value

BUCKETS = 1 << 16
CALIBRATION = 20_000
BITS_PER_LANGUAGE_BIT = 10
EXHAUSTIVE = 5
AMBIGUOUS = 0.1        # relative distance of the two smallest losses
CLIP = 4.0
_LETTER = re.compile(r"[^\W\d_]")
_SPACES = re.compile(rb"[\x09-\x0D\x20]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """Codewords (rows) of n languages, each column a split of the languages."""
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        cols = [c for k in range(1, n) for c in combinations(range(1, n), k)]
        out = np.full((n, len(cols)), -1.0)  # the first language is always -1: no split appears twice
        for j, c in enumerate(cols):
            out[list(c), j] = 1.0
        return out
    bits = math.ceil(BITS_PER_LANGUAGE_BIT * math.log2(n))
    best, found = -1, None
    for k in range(64):
        m = np.random.default_rng([seed, k]).choice([-1.0, 1.0], (n, bits))
        m[0, np.abs(m.sum(0)) == n] *= -1
        apart = (bits - m @ m.T) / 2
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > best:
            best, found = least, m
    return found


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed grams of all texts on end, each gram's text, and the number of grams per text."""
    raw = [b" " + _SPACES.sub(b" ", (t or "").lower().encode("utf-8")) + b" " for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
    two = (b[:-1] * np.uint32(0x9E3779B1)) ^ (b[1:] * np.uint32(0x85EBCA77))
    three = two[:-1] ^ (b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    in2, in3 = owner[:-1] == owner[1:], owner[:-2] == owner[2:]

    def bucket(h):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return (h >> np.uint32(16)).astype(np.int32)
    h = np.concatenate([bucket(two)[in2], bucket(three + np.uint32(1))[in3]])
    own = np.concatenate([owner[:-1][in2], owner[:-2][in3]])
    return h, own, np.bincount(own, minlength=len(raw))


def batches_of(column, most: int = 4 << 20):
    """Slices of a text column of about ``most`` characters: (first row, texts)."""
    first, held, texts = 0, 0, []
    for i, v in enumerate(column):
        t = v.as_py()
        texts.append(t)
        held += len(t or "")
        if held >= most:
            yield first, texts
            first, held, texts = i + 1, 0, []
    if texts:
        yield first, texts


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def gram_counts(train: DataFrame) -> DataFrame:
    """``lang``, ``gram``, ``n`` from columns ``text``, ``lang``."""
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for first, texts in batches_of(b.column(0)):
                h, own, _ = grams(texts)
                names = sorted(set(langs[first:first + len(texts)]))
                code = np.array([names.index(x) for x in langs[first:first + len(texts)]])
                counted = np.bincount(code[own] * BUCKETS + h, minlength=len(names) * BUCKETS)
                for k, name in enumerate(names):
                    part = counted[k * BUCKETS:(k + 1) * BUCKETS]
                    total[name] = total[name] + part if name in total else part
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(c[at], pa.int64())], names=["lang", "gram", "n"])
    parts = train.select("text", "lang").mapInArrow(run, "lang string, gram int, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def bit_weights(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log-odds of every gram for every bit, from counts by (language, gram)."""
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * counts.shape[1])
    plus, minus = (code > 0).astype(float), (code < 0).astype(float)
    up = plus.T @ share / np.maximum(plus.sum(0), 1)[:, None]
    down = minus.T @ share / np.maximum(minus.sum(0), 1)[:, None]
    with np.errstate(divide="ignore"):  # one language: no other side
        return np.log(up / down).T.astype(np.float32)


def margins(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    """Mean log-odds of each text's grams, by bit."""
    h, own, n = grams(texts)
    out = np.empty((len(texts), weights.shape[1]))
    for k in range(weights.shape[1]):
        out[:, k] = np.bincount(own, weights[:, k][h], len(texts))
    return out / np.maximum(n, 1)[:, None]


def decode(margin: np.ndarray, code: np.ndarray, bit_weight: np.ndarray, scale: np.ndarray):
    """(language number, score, ambiguous) of each row of margins."""
    z = np.clip(margin / scale, -CLIP, CLIP)
    loss = np.stack([np.exp(-z * word) @ bit_weight for word in code], 1) / bit_weight.sum()
    order = np.argsort(loss, 1, kind="stable")
    low = np.take_along_axis(loss, order[:, :1], 1)
    p = np.exp(low - loss)
    score = 1 / p.sum(1)
    if loss.shape[1] == 1:
        return order[:, 0], np.ones(len(loss)), np.zeros(len(loss), bool)
    second = np.take_along_axis(loss, order[:, 1:2], 1)
    return order[:, 0], score, ((second - low) <= AMBIGUOUS * second)[:, 0]


def calibration_sample(rows: DataFrame, n: int) -> DataFrame:
    """About ``CALIBRATION`` of the ``n`` rows (all, if there are fewer): those whose hash is in the lowest part of
    its range, a part that is never empty however large n is."""
    share = min(1.0, CALIBRATION / max(n, 1))
    unit = F.xxhash64("id", "text", F.monotonically_increasing_id()).cast("double") / F.lit(2.0 ** 64) + 0.5
    return rows.filter(unit <= share)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> dict | None:
    """The model: languages, code, gram weights, bit weights and scales; None without languages."""
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(F.col("text").isNotNull())
    counted = gram_counts(rows).toPandas()  # at most languages * 2^16 rows
    langs = sorted(counted["lang"].unique().tolist())
    if not langs:
        return None
    counts = np.zeros((len(langs), BUCKETS))
    counts[np.searchsorted(np.array(langs, object), counted["lang"].to_numpy(object)), counted["gram"]] = counted["n"]
    code = code_matrix(len(langs))
    model = {"langs": langs, "code": code, "weights": bit_weights(counts, code),
             "bit_weight": np.ones(code.shape[1]), "scale": np.ones(code.shape[1])}
    if len(langs) == 1:
        return model
    sample = calibration_sample(rows, rows.count()).select("text", "lang")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            names = b.column(1).to_pylist()
            for first, texts in batches_of(b.column(0)):
                margin = margins(texts, m["weights"])
                want = m["code"][[m["langs"].index(x) for x in names[first:first + len(texts)]]]
                for k in range(margin.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([len(texts)], pa.int64()),
                         pa.array([int((margin[:, k] * want[:, k] <= 0).sum())], pa.int64()),
                         pa.array([float(np.abs(margin[:, k]).sum())])], names=["bit", "n", "wrong", "size"])
    errors = sample.mapInArrow(run, "bit int, n long, wrong long, size double").groupBy("bit").agg(
        F.sum("n").alias("n"), F.sum("wrong").alias("wrong"), F.sum("size").alias("size")).collect()  # a row per bit
    for r in errors:
        e = (r["wrong"] + 1) / (r["n"] + 2)
        model["bit_weight"][r["bit"]] = max(0.05, math.log((1 - e) / e)) if e < 0.5 else 0.05
        model["scale"][r["bit"]] = max(r["size"] / r["n"] / 2, 1e-6)
    return model


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``lang_pred``, ``score``, ``ambiguous`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        m = sent.value
        for b in batches:
            langs, scores, unsure = [], [], []
            for _, texts in batches_of(b.column(1)):
                lettered = [has_letter(t) for t in texts]
                if m is None:
                    best, score, close = [0] * len(texts), [0.0] * len(texts), [False] * len(texts)
                    lettered = [False] * len(texts)
                else:
                    best, score, close = decode(margins(texts, m["weights"]), m["code"], m["bit_weight"], m["scale"])
                for i, ok in enumerate(lettered):
                    langs.append(m["langs"][best[i]] if ok else "und")
                    scores.append(float(score[i]) if ok else 0.0)
                    unsure.append(bool(close[i]) if ok else True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(unsure, pa.bool_())],
                                             names=["id", "lang_pred", "score", "ambiguous"])
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, ambiguous boolean")


by_value(__name__)

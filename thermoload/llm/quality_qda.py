"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a short vector (``statistics``): arcsine-root transformed shares of
character classes, repeated lines and repeated words, and logarithms of lengths. Shares that
differ between languages but not between good and bad text (lower case, non-ASCII) only
count as letters, so a new script is not an outlier by itself.

For both labels the mean and covariance of these vectors are learned. A class's covariance
is shrunk towards the pooled one (``TO_POOLED``) and towards the identity in units of the
overall standard deviations (``TO_IDENTITY``); its Cholesky factor is computed once, and the model keeps
the factor's inverse and log determinant. The score of a text is the logistic function of
log-density difference / ``TEMPERATURE``: one product with each triangular inverse gives the Mahalanobis distances.

Scale: texts are read once, their statistics (17 numbers a row) are written and serve
learning and scoring. Learning sums in two passes (means, then centred products), each a
partial sum per task and a grouped sum of at most 2 * 17 * 18 rows, whatever the corpus. Labels
are counted per id before they meet the documents, so the join adds no rows; a hot id splits
like any skewed join.

Edge cases: a null or empty text has statistics of zero and gets a score like any other. A null
id has no label and is held out or not as the empty text is. Repeated documents count and are
scored each; an id with several labels counts once for each. Labels other than 0 and 1 are not
learned from. If only one label was learned every score is that label, if none was, 0.5.
An empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import math
import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, written

TO_POOLED, TO_IDENTITY = 0.5, 0.1
TEMPERATURE = 8.0
GOOD_FROM = 0.3
STATISTICS = ["n_words", "upper", "letters", "digits", "spaces", "symbols", "marks", "points", "others", "word_length",
              "word_spread", "distinct_words", "top_word", "repeated_lines", "repeated_words", "line_words", "punctuated"]
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789",
            "spaces": b" \t\n\x0b\x0c\r", "symbols": b"#*$%&|<>", "marks": b"!?", "points": b".,;:"}
_BYTES = {name: list(chars) for name, chars in _CLASSES.items()}


def _root(share: float) -> float:
    return math.asin(math.sqrt(min(max(share, 0.0), 1.0)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of ``STATISTICS``."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = {name: int(count[at].sum()) for name, at in _BYTES.items()}
    letters = n["upper"] + n["lower"] + int(count[128:].sum())
    others = len(raw) - letters - sum(n[k] for k in ("digits", "spaces", "symbols", "marks", "points"))
    words = raw.split()
    k = max(len(words), 1)
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = sum(map(operator.eq, words, words[1:]))
    ends = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    share = lambda x: _root(x / len(raw))
    return [math.log1p(len(words)), share(n["upper"]), share(letters), share(n["digits"]), share(n["spaces"]),
            share(n["symbols"]), share(n["marks"]), share(n["points"]), share(others),
            math.log1p(lengths.mean()), math.log1p(lengths.std()), math.log(len(seen) + 1) / math.log(k + 1),
            _root(max(seen.values(), default=0) / k), _root(1 - len(set(lines)) / max(len(lines), 1)) if lines else 0.0,
            _root(again / k), math.log1p(len(words) / max(len(lines), 1)), _root(ends / k)]


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``stats`` (array of doubles) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            stats = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stats, pa.list_(pa.float64()))], names=["id", "stats"])
    return rows.mapInArrow(run, f"id {kind}, stats array<double>")


def label_counts(labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> DataFrame:
    """``id``, ``bad``, ``good``: how often an id is labelled 0 and 1."""
    tally = lambda v: F.count(F.when(F.col(label) == v, True))
    return (labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
            .agg(tally(0).alias("bad"), tally(1).alias("good")))


def _matrix(column) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _summed(rows: DataFrame, fn) -> np.ndarray:
    """Sum over all rows of ``fn(stats, weights)`` (an array), weights by class in columns."""
    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                part = fn(x, np.stack([np.asarray(b.column(1)), np.asarray(b.column(2))]).astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())],
                                             names=["pos", "value"])
    parts = rows.select("stats", "bad", "good").mapInArrow(run, "pos int, value double")
    return np.array([r["value"] for r in parts.groupBy("pos").agg(F.sum("value").alias("value")).sort("pos").collect()])


def train(rows: DataFrame) -> dict:
    """The model from ``stats``, ``bad``, ``good`` (weights of a row in each class). The driver
    gets sums only, of a size fixed by the number of statistics."""
    d = len(STATISTICS)
    first = _summed(rows, lambda x, w: np.concatenate([w.sum(1)[:, None], w @ x, w @ (x * x)], 1))
    if not first.size:
        return {"prior": [0.0, 0.0]}
    first = first.reshape(2, 1 + 2 * d)
    n = first[:, 0]
    if min(n) == 0:
        return {"prior": n.tolist()}
    means = first[:, 1:1 + d] / n[:, None]
    centre = first[:, 1:1 + d].sum(0) / n.sum()
    unit = np.sqrt(np.maximum(first[:, 1 + d:].sum(0) / n.sum() - centre ** 2, 0)) + 1e-6

    def products(x, w):
        return np.stack([((x - means[c]) / unit).T @ ((x - means[c]) / unit * w[c][:, None]) for c in (0, 1)])
    scatter = _summed(rows, products).reshape(2, d, d)
    pooled = scatter.sum(0) / n.sum()
    model = {"prior": n.tolist(), "unit": unit, "means": means, "factors": [], "offsets": []}
    for c in (0, 1):
        cov = (1 - TO_POOLED) * scatter[c] / n[c] + TO_POOLED * pooled
        cov = (1 - TO_IDENTITY) * cov + TO_IDENTITY * np.eye(d)
        factor = np.linalg.cholesky(cov)
        model["factors"].append(np.linalg.inv(factor))  # lower triangular: one product per text
        model["offsets"].append(math.log(n[c] / n.sum()) - float(np.log(np.diag(factor)).sum()))
    return model


def differences(stats: np.ndarray, model: dict) -> np.ndarray:
    """Log density of label 1 less that of label 0, priors included."""
    out = []
    for c in (0, 1):
        z = (stats - model["means"][c]) / model["unit"] @ model["factors"][c].T
        out.append(model["offsets"][c] - (z * z).sum(1) / 2)
    return out[1] - out[0]


def scores(stats: np.ndarray, model: dict) -> np.ndarray:
    bad, good = model["prior"]
    if not bad or not good:
        return np.full(len(stats), 0.5 if bad == good else float(good > 0))
    return 1 / (1 + np.exp(-np.clip(differences(stats, model) / TEMPERATURE, -700, 700)))


def score(rows: DataFrame, model: dict) -> DataFrame:
    """``id``, ``score`` (0 to 1) and ``predicted`` of rows with ``id`` and ``stats``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if b.num_rows:
                s = scores(_matrix(b.column(1)), sent.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= GOOD_FROM).astype(np.int32))],
                                                 names=["id", "score", "predicted"])
    return rows.select("id", "stats").mapInArrow(run, f"id {kind}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """Learn from the labels of the documents where ``learn`` (over ``id``) holds, score all documents."""
    rows = written(with_statistics(docs), "doc-statistics")
    labelled = rows.filter(learn).join(label_counts(labels), "id")
    return score(rows, train(labelled))


by_value(__name__)

"""Secret scanning with an incremental blob ledger.

Every text is a blob named by its SHA-256. The ledger, a Parquet table, has one
row per blob and scan: the rules (name and version) it was scanned with and the
spans found. An update

1. names every version of every document where it is read, and notes which rules' hints (fixed byte
   strings, or a shorter pattern) it holds; a text without any is not moved,
2. reduces these to distinct blobs: first in each task, then across tasks, so a blob that a third of all
   paths share arrives once per task,
3. leaves out the (blob, rule version) pairs that the ledger has,
4. scans the rest and appends the findings; where no hint was found there is nothing to find.

The report joins the ledger's findings, of the rules' current versions, back to
every document (path) by digest, and says which rules' current version a document's blob was not scanned
with. A new version of one rule scans every blob
for that rule only; unchanged texts cost one digest and the hints.

Rules work on UTF-8 bytes with ASCII classes; spans are code points, end
exclusive, leftmost and without overlap within a rule.

Edge cases: null text: the empty blob, no finding; null ids and repeated rows are
reported like any other; an empty table adds nothing to the ledger and gives an
empty report; a document that came after the last update has no span and every rule in ``unscanned``.
Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value

SPAN = T.StructType([T.StructField("rule", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType())])
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("scanned", T.ArrayType(T.StringType())),
                       T.StructField("spans", T.ArrayType(SPAN))])


@dataclass(frozen=True)
class Rule:
    """``hints``: lower-case byte strings one of which every match holds (in any case); none: any text may match."""

    name: str
    version: int
    pattern: bytes
    hints: tuple[bytes, ...] = ()
    group: int = 0
    least: int = 0
    any_case: bool = False
    shorter: bytes = b""  # a pattern that every text with a match holds, instead of hints

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def may_match(self, raw: bytes, low: bytes) -> bool:
        if self.shorter:
            return re.search(self.shorter, raw) is not None
        return not self.hints or any(h in low for h in self.hints)


RULES = (
    Rule("assign", 1, rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         (b"passw", b"secret", b"token", b"api"), group=2, least=8, any_case=True),
    Rule("access", 1, rb"AKIA[A-Z0-9]+", (b"akia",), least=16),
    Rule("hex", 1, rb"[0-9a-f]{32,}", shorter=rb"[0-9a-f]{32}"),  # the same spans as [0-9a-f]+ of 32 or more
    Rule("private_key", 1, rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", (b"-----begin",)),
    Rule("code_host", 1, rb"gh[pousr]_[A-Za-z0-9]{36,}", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
    Rule("web_token", 1, rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", (b"eyj",)),
)


def find(text: str, rules) -> list[tuple[str, int, int]]:
    """(rule, start, end) in code points, by start, then in the rules' order."""
    raw = text.encode("utf-8", "surrogatepass")
    low, plain, out = raw.lower(), text.isascii(), []
    for n, rule in enumerate(rules):
        if not rule.may_match(raw, low):
            continue
        for m in re.finditer(rule.pattern, raw, re.IGNORECASE if rule.any_case else 0):
            a, b = m.span()
            x, y = m.span(rule.group)
            if y - x >= rule.least:
                if not plain:
                    a = len(raw[:a].decode("utf-8", "surrogatepass"))
                    b = a + len(raw[m.start():m.end()].decode("utf-8", "surrogatepass"))
                out.append((a, n, b))
    return [(rules[n].name, a, b) for a, n, b in sorted(out)]


def _blob(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def ledger_exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException
    try:
        spark.read.schema(LEDGER).parquet(path).limit(0).count()
        return True
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition()):
            return False
        raise


def update(docs: DataFrame, path: str, text: str = "text", rules=RULES) -> None:
    """Scan what the ledger at ``path`` has not seen, and append it."""
    spark, keys = docs.sparkSession, [r.key for r in rules]
    by_key = dict(zip(keys, rules))
    by_name = {r.name: r.key for r in rules}

    def named(batches):
        seen: set[bytes] = set()  # of this task
        for b in batches:
            blobs, texts, hints = [], [], []
            for value in b.column(0):
                t = value.as_py() or ""
                raw = t.encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(raw)
                if digest.digest() in seen:
                    continue
                seen.add(digest.digest())
                low = raw.lower()
                may = [k for k, r in by_key.items() if r.may_match(raw, low)]
                blobs.append(digest.hexdigest())
                texts.append(t if may else None)
                hints.append(may)
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(texts, pa.string()),
                                              pa.array(hints, pa.list_(pa.string()))], names=["blob", "text", "may"])
    blobs = (docs.select(F.col(text).alias("text")).mapInArrow(named, "blob string, text string, may array<string>")
             .groupBy("blob").agg(F.first("text").alias("text"), F.first("may").alias("may")))  # equal in all rows of a blob
    every = F.array(*map(F.lit, keys))
    if ledger_exists(spark, path):
        seen = (spark.read.schema(LEDGER).parquet(path).select("blob", F.explode("scanned").alias("k"))
                .groupBy("blob").agg(F.collect_set("k").alias("done")))  # at most all rule versions ever used
        blobs = blobs.join(seen, "blob", "left").withColumn(
            "todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>")))).filter("size(todo) > 0")
    else:
        blobs = blobs.withColumn("todo", every)

    def run(batches):
        span = pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            found = []
            for t, todo, may in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                hits = find(t, [by_key[k] for k in todo if k in may]) if t is not None else []
                found.append([{"rule": by_name[n], "start": s, "end": e} for n, s, e in hits])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(span))],
                                             names=["blob", "scanned", "spans"])
    blobs.select("blob", "text", "todo", "may").mapInArrow(run, LEDGER).write.mode("append").parquet(path)


def report(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """One row per document: id, ``blob``, ``spans`` (rule, start, end; by start, then in the rules'
    order) of the rules' current versions, and ``unscanned``, the names of the rules whose current
    version its blob was not scanned with."""
    spark = docs.sparkSession
    keys, names = F.array(*[F.lit(r.key) for r in rules]), F.array(*[F.lit(r.name) for r in rules])
    order = lambda s: F.array_position(keys, s["rule"])
    rows = spark.read.schema(LEDGER).parquet(path)
    # a blob's rows: one for each scan that added rule versions
    found = (rows.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("all"),
                                      F.flatten(F.collect_list("scanned")).alias("scanned"))
             .select("blob", "scanned", F.array_sort(F.transform(
                 F.filter("all", lambda s: order(s) > 0),
                 lambda s: F.struct(s["start"].alias("start"), order(s).alias("n"), s["end"].alias("end")))).alias("all")))
    found = found.select("blob", F.transform("all", lambda s: F.struct(
        F.element_at(names, s["n"].cast("int")).alias("rule"), s["start"], s["end"])).alias("spans"),
        F.transform(F.array_except(keys, "scanned"), lambda k: F.element_at(names, F.array_position(keys, k).cast("int"))).alias("unscanned"))
    none = F.array().cast(T.ArrayType(SPAN))
    return (docs.select(F.col(id_col), _blob(text).alias("blob")).join(found, "blob", "left")
            .select(id_col, "blob", F.coalesce("spans", none).alias("spans"), F.coalesce("unscanned", names).alias("unscanned")))


by_value(__name__)

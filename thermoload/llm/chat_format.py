"""Chat formatting that is checked by a grammar round trip.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. The grammar is
deterministic: a turn begins with the start mark, its role ends at the first
line feed, its text at the first end mark; any other ``<|`` is an error.

Each turn is rendered as it is and parsed again. Where the recovered turn is not
the source's, the content is escaped and rendered anew, until it is identical:
in texts ``<|``, ``<\\|``, ``<\\\\|``, ... get one more backslash; in roles ``%``, line
feeds and ``<`` become ``%25``, ``%0A``, ``%3C`` (a null role is ``%00``). The parser
always undoes both, so the output alone gives back the source.

Formatting is row by row. Reading back streams each conversation's turns in
order through one task with a constant-size state (running digests and
counters); the rows come sorted from Spark's external sort, so a conversation
that holds a third of all rows is never gathered in memory.

Edge cases: null text: empty; null role: a role of its own, never under the loss
mask; null conversation ids form one conversation; equal turns are ordered by
role, then text (nulls first); repeated rows are turns like any other. An empty
table gives no row. Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escape_text(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape_text(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")


def unescape_role(role: str) -> str | None:
    if role == "%00":
        return None
    return role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


def parse(text: str) -> list[tuple[str | None, str, int, int]] | None:
    """Turns (role, text, start, end of the raw text) of a formatted string; None if it is
    not in the grammar."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            return None
        at += len(START)
        line = text.find("\n", at)
        if line < 0 or "<|" in text[at:line]:
            return None
        body, mark = line + 1, text.find("<|", line + 1)
        if mark < 0 or not text.startswith(END + "\n", mark):
            return None
        turns.append((unescape_role(text[at:line]), unescape_text(text[body:mark]), body, mark))
        at = mark + len(END) + 1
    return turns


def render(role: str | None, text: str) -> tuple[str, int, int]:
    """(rendered turn, start and end of its text), escaped as far as its round trip needs."""
    plain = "%00" if role is None else role
    coded = "%00" if role is None else escape_role(role)
    for r, t in ((plain, text), (plain, escape_text(text)), (coded, text), (coded, escape_text(text))):
        out = f"{START}{r}\n{t}{END}\n"
        turns = parse(out)
        if turns is not None and len(turns) == 1 and turns[0][:2] == (role, text):
            return out, turns[0][2], turns[0][3]
    raise ValueError("no rendering of this turn can be read back")


def format_turns(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row per turn: ``conv``, ``turn``, ``role``, ``source`` (the text), ``formatted``, and the span
    ``loss_start``, ``loss_end`` of an assistant's text in it (null for other roles)."""
    rows = convs.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("source"))
    schema = T.StructType([*rows.schema.fields, T.StructField("formatted", T.StringType()),
                           T.StructField("loss_start", T.IntegerType()), T.StructField("loss_end", T.IntegerType())])

    def run(batches):
        for b in batches:
            out, lo, hi = [], [], []
            for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                f, s, e = render(r, t)
                out.append(f)
                lo.append(s if r == "assistant" else None)
                hi.append(e if r == "assistant" else None)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(out, pa.string()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                names=[*b.schema.names, "formatted", "loss_start", "loss_end"])
    return rows.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation: ``conv``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``,
    ``formatted_chars``. All of it is read from the formatted turns; the columns ``turn``, ``role`` and ``source``
    only put the turns in order (by turn, then, where turns repeat a number, by role and text)."""
    rows = (formatted.repartition("conv").sortWithinPartitions("conv", "turn", "role", "source")
            .select("conv", "formatted", "loss_start", "loss_end"))
    schema = T.StructType([T.StructField("conv", formatted.schema["conv"].dataType),
                           T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                           T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
                           T.StructField("formatted_chars", T.LongType())])

    def run(batches):
        kind, names = None, [f.name for f in schema.fields]
        state = None
        for b in batches:
            kind = b.schema.field(0).type
            done = []
            for c, text, lo, hi in zip(*(x.to_pylist() for x in b.columns)):
                if state is None or state[0] != c:
                    if state is not None:
                        done.append(closed(state))
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in parse(text):
                    state[1] += 1
                    state[2].update(f"{'' if role is None else role}\n{said}\n".encode())
                if lo is not None:
                    learnt = unescape_text(text[lo:hi])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(text)
            if done:
                yield table(done, kind, names)
        if state is not None:
            yield table([closed(state)], kind, names)

    def closed(s):
        return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

    def table(done, kind, names):
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
    return rows.mapInArrow(run, schema)


by_value(__name__)

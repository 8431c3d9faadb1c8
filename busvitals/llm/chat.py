r"""Chat formatting in budgeted windows.

Template: each turn is ``### role: text</turn>`` and a line feed. Inside texts and roles a backslash goes before every
backslash and before the first character of ``###`` and ``</turn>`` (in roles also before a colon), so the formatted text
reads back to exactly the turns that went in, whatever they say.

Windows: the prefix sums of the turns' tokens choose spans of whole turns. A span ends where the next turn would pass the
budget together with what is repeated before it: the conversation's first system turn, and as many of the last turns
before the span as fit the history budget. A turn that passes the budget by itself stands alone in its span. Loss spans
cover the assistants' texts of the span, not its markup, and nothing of what is repeated, so each target counts once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busvitals.llm.arrow import batched
from busvitals.llm.tokens import VOCABULARY, ids

BUDGET = 1024
HISTORY = 256
TARGET_ROLE = "assistant"
SYSTEM_ROLE = "system"

_ESCAPE = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPE_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")
_MARK = r"\\\g<0>"
_READ = re.compile(r"\\(.)|(### )|(</turn>\n)|(: )", re.S)

WINDOWS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("window", T.LongType()),
    T.StructField("n_repeated", T.IntegerType()), T.StructField("n_turns", T.IntegerType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("loss_start", T.ArrayType(T.LongType())), T.StructField("loss_end", T.ArrayType(T.LongType())),
])
DIGEST = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
    T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    T.StructField("n_windows", T.LongType()), T.StructField("most_tokens", T.LongType()),
])


def escaped(text: str) -> str:
    return _ESCAPE.sub(_MARK, text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turn_parts(role: str | None, text: str | None) -> tuple[str, str, str]:
    """What stands before the text, the text, and what stands after it."""
    return f"### {_ESCAPE_ROLE.sub(_MARK, role or '')}: ", escaped(text or ""), "</turn>\n"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, unescaped: the inverse of the template."""
    turns: list[tuple[str, str]] = []
    role: str | None = None
    at, opened = 0, False
    for m in _READ.finditer(formatted):
        if m[1] is not None:
            continue
        if m[2] and not opened:
            opened, role, at = True, None, m.end()
        elif m[4] and opened and role is None:
            role, at = unescaped(formatted[at:m.start()]), m.end()
        elif m[3] and opened and role is not None:
            turns.append((role, unescaped(formatted[at:m.start()])))
            opened = False
    return turns


@dataclass
class _Turn:
    role: str
    parts: tuple[str, str, str]
    tokens: int


@dataclass
class _Conversation:
    """What is held of a conversation while its turns stream by: never more than a window and what is repeated."""

    conv_id: int | None
    budget: int
    history: int
    window: int = 0
    system: _Turn | None = None  # the first system turn, once a window holds it
    system_here: _Turn | None = None
    past: list[_Turn] = field(default_factory=list)
    span: list[_Turn] = field(default_factory=list)
    used: int = 0

    def repeated(self) -> list[_Turn]:
        head = [self.system] if self.system else []
        return head + [t for t in self.past if t is not self.system]

    def add(self, turn: _Turn) -> Iterator[tuple]:
        ahead = sum(t.tokens for t in self.repeated())
        if self.span and ahead + self.used + turn.tokens > self.budget:
            yield self.close()
            ahead = sum(t.tokens for t in self.repeated())
        while self.past and not self.span and ahead + turn.tokens > self.budget:
            ahead -= self.past.pop(0).tokens  # the oldest history gives way
        if self.system is None and self.system_here is None and turn.role == SYSTEM_ROLE:
            self.system_here = turn
        self.span.append(turn)
        self.used += turn.tokens

    def close(self) -> tuple:
        before = self.repeated()
        text, at, starts, ends = [], 0, [], []
        for k, turn in enumerate(before + self.span):
            head, body, tail = turn.parts
            if k >= len(before) and turn.role == TARGET_ROLE and body:
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            text += turn.parts
            at += len(head) + len(body) + len(tail)
        row = (self.conv_id, self.window, len(before), len(self.span),
               sum(t.tokens for t in before) + self.used, "".join(text), starts, ends)
        kept, room = [], self.history
        for turn in reversed([*self.past, *self.span]):
            if turn.tokens > room:
                break
            room -= turn.tokens
            kept.insert(0, turn)
        self.system = self.system or self.system_here
        self.past, self.span, self.used, self.window = kept, [], 0, self.window + 1
        return row


def format_conversations(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str = VOCABULARY,
    id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per window: ``conv_id``, ``window`` (from 0), ``n_repeated`` leading turns that earlier windows hold already,
    ``n_turns`` new ones, ``n_tokens``, ``text``, and the loss spans as code points [``loss_start``, ``loss_end``).

    Null texts and roles are empty; a null conversation id is a conversation of its own; turns come in the order of
    ``turn`` (null first), equal ones in that of role and text; repeated rows are turns each; other columns are not read; an empty
    table has no windows. Turns are formatted and counted where they lie; only then do they meet by conversation, in order,
    and stream by with bounded memory however long the conversation is.
    """

    @F.pandas_udf("long")
    def tokens(roles: pd.Series, texts: pd.Series) -> pd.Series:
        encoder = ids(vocabulary)
        return pd.Series([len(encoder.encode("".join(turn_parts(r, t)))) for r, t in zip(roles, texts)], dtype="int64")

    slim = turns.select(
        F.col(id_col).cast("bigint").alias("c"), F.col(turn_col).alias("n"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"),
    )
    counted = slim.withColumn("k", tokens("r", "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now: _Conversation | None = None
            for batch in batches:
                cols = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("c", "r", "t", "k")]
                for conv, role, text, size in zip(*cols):
                    if now is None or now.conv_id != conv:
                        if now is not None:
                            yield now.close()
                        now = _Conversation(conv, budget, history)
                    yield from now.add(_Turn(role, turn_parts(role, text), size))
            if now is not None:
                yield now.close()

        yield from batched(rows(), WINDOWS, lambda r: len(r[5]))

    return counted.repartition("c").sortWithinPartitions("c", "n", "r", "t").mapInArrow(run, WINDOWS)


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from its windows alone: turns, texts under the loss spans, sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, begun = None, False
            for batch in batches:
                for w in batch.to_pylist():
                    if not begun or w["conv_id"] != now:
                        if begun:
                            yield now, n, said.hexdigest(), chars, loss.hexdigest(), total, count, most
                        now, begun = w["conv_id"], True
                        n = chars = total = count = most = 0
                        said, loss = hashlib.sha256(), hashlib.sha256()
                    for role, text in read_turns(w["text"])[w["n_repeated"]:]:
                        n += 1
                        said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    for a, b in zip(w["loss_start"], w["loss_end"]):
                        text = unescaped(w["text"][a:b])
                        chars += len(text)
                        loss.update(text.encode("utf-8", "surrogatepass"))
                    total, count, most = total + len(w["text"]), count + 1, max(most, w["n_tokens"])
            if begun:
                yield now, n, said.hexdigest(), chars, loss.hexdigest(), total, count, most

        yield from batched(rows(), DIGEST)

    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(run, DIGEST)

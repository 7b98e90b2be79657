"""Chat formatting by rendering successive prefixes of a conversation through a black-box template.

A template is any function from turns to text. The prefix of i turns is rendered for every i; where
the output only grows, the growth is turn i's span, and rendering the same turn with two probe texts
shows where its text lies in it. Where an output does not begin with the one before, the template
rewrites history, and the turn is marked so. No number of equal spans shows that a template will never
look further back, so every prefix is rendered whole, in time that grows with the square of a
conversation's length. Only for a template that the caller declares ``local`` (as the default is: a turn's
span depends on the few turns before it, and any turn may be the first rendered) long conversations are
rendered from a later turn on, in time in proportion to their length and memory for a bounded number of
turns.

The output is one row per turn, in order: the formatted conversation is its segments in a row.

Defined cases: null text and null role are empty; turns are ordered by (turn, role, text), nulls first,
so repeated rows and ties are turns of their own in a fixed order; rows with a null conversation form
one conversation; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

Turns = list[tuple[str, str]]
WINDOW = 32
TURNS = StructType([
    StructField("conv_id", LongType()), StructField("position", LongType()),
    StructField("role", StringType()), StructField("segment", StringType()),
    StructField("start", LongType()), StructField("text_start", LongType()),
    StructField("text_end", LongType()), StructField("loss", BooleanType()),
    StructField("rewrites", BooleanType()),
])
DIGEST = StructType([
    StructField("conv_id", LongType()), StructField("n_turns", LongType()),
    StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()),
    StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType()),
    StructField("rewrites", BooleanType()),
])
BEGIN, END = "<s>", "</s>\n"
ESCAPED = re.compile(r"[\\<\[|]")
TURN = re.compile(
    r"(?:<s>)?<\|([^\\|]*+(?:\\.[^\\|]*+)*+)\|>\n([^\\<]*+(?:\\.[^\\<]*+)*+)</s>\n", re.S)


def escape(text: str) -> str:
    """Backslash before every character that begins a control string, and before backslashes."""
    return ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def marked(turns: Turns) -> str:
    """The default template: ``<s>``, then ``<|role|>``, text and ``</s>`` per turn."""
    return BEGIN + "".join(f"<|{escape(r)}|>\n{escape(t)}{END}" for r, t in turns)


def parse(formatted: str) -> Turns:
    """The turns of text in the default template; an error when something is left over."""
    turns, at = [], len(BEGIN) if formatted.startswith(BEGIN) else 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Incremental:
    """Spans of one conversation's turns, one turn at a time."""

    def __init__(self, template: Callable[[Turns], str], window: int = WINDOW, local: bool = False):
        self.template, self.window = template, window
        self.turns: Turns = []
        self.output, self.end, self.keep_all = "", 0, not local

    def add(self, role: str, text: str) -> tuple[str, int, int, int, bool]:
        """Segment, its start, start and end of the text in it, and whether history was rewritten."""
        before, self.output = self.output, self.template([*self.turns, (role, text)])
        rewrites = not self.output.startswith(before)
        cut = _common(before, self.output) if rewrites else len(before)
        segment = self.output[cut:]
        # Two probe texts differ where the text begins and, from the end, where it stops.
        probes = [self.template([*self.turns, (role, p)]) for p in ("a", "bb")]
        head = _common(*probes) - cut
        tail = _common(probes[0][::-1], probes[1][::-1])
        self.turns.append((role, text))
        start, self.end = self.end, self.end + len(segment)
        text_end = max(len(segment) - tail, 0)
        text_start = min(max(head, 0), text_end)
        if len(self.turns) >= 2 * self.window and not self.keep_all:
            self._shorten(segment)
        return segment, start, start + text_start, start + text_end, rewrites

    def _shorten(self, segment: str) -> None:
        """Go on from a later turn, if the newest turn has the same span from there."""
        later = self.turns[-self.window:]
        before, now = self.template(later[:-1]), self.template(later)
        if now.startswith(before) and now[len(before):] == segment:
            self.turns, self.output = later, now
        else:
            self.keep_all = True


def _format(template: Callable[[Turns], str], learn: tuple[str, ...], local: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, position = object(), None, 0
        for batch in batches:
            out, held = [], 0
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                        batch.column(2)):
                if conv != key:
                    key, state, position = conv, Incremental(template, local=local), 0
                role, text = role or "", text.as_py() or ""
                segment, start, a, b, rewrites = state.add(role, text)
                out.append((conv, position, role, segment, start, a, b, role in learn, rewrites))
                position += 1
                held += len(segment)
                if held > 4 << 20:
                    yield _rows(out, TURNS)
                    out, held = [], 0
            if out:
                yield _rows(out, TURNS)

    return run


def _rows(rows: list[tuple], schema: StructType) -> pa.RecordBatch:
    types = {LongType(): pa.int64(), StringType(): pa.string(), BooleanType(): pa.bool_()}
    return pa.RecordBatch.from_arrays(
        [pa.array(c, types[f.dataType]) for c, f in zip(zip(*rows), schema)], schema.names)


def formatted(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
              role: str = "role", text: str = "text", template: Callable[[Turns], str] = marked,
              learn: tuple[str, ...] = ("assistant",), local: bool | None = None) -> DataFrame:
    """One row per turn with its segment and offsets (code points) in the formatted conversation.

    ``local`` declares that the template looks back a few turns only; unless given, the default template
    alone is taken so. ``loss`` marks the turns to learn from; their text lies between text_start and text_end. Rows of
    a conversation lie in one partition, in order.
    """
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(role).cast("string").alias("role"),
        F.col(text).cast("string").alias("text"), F.col(turn).alias("_turn"))
    return (
        rows.repartition("conv_id").sortWithinPartitions("conv_id", "_turn", "role", "text")
        .select("conv_id", "role", "text").mapInArrow(_format(template, learn, template is marked if local is None else local), TURNS)
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = object(), None
    for batch in batches:
        out = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            conv, _, _, segment, start, a, b, loss, rewrites = row
            if conv != key:
                if state is not None:
                    out.append(_closed(key, state))
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
            for role, text in parse(segment):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if loss:
                learned = unescape(segment[a - start:b - start])
                state[2] += len(learned)
                state[3].update(learned.encode())
            state[4] += len(segment)
            state[5] |= rewrites
        if out:
            yield _rows(out, DIGEST)
    if state is not None:
        yield _rows([_closed(key, state)], DIGEST)


def _closed(key, state) -> tuple:
    n, turns, chars, learned, total, rewrites = state
    return key, n, turns.hexdigest(), chars, learned.hexdigest(), total, rewrites


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, what is read back from its segments (default template)."""
    return turns.mapInArrow(_digest, DIGEST)


PROBE = "</s>[INST] ok [/INST]"


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        f"select * from values (-1L, 0L, 'user', '{PROBE}'), (-1L, 1L, 'assistant', '{PROBE}') "
        "as t(conv_id, turn, role, text)")
    return digests(formatted(rows.unionByName(probe)))


def _escaped_sql(column: str) -> str:
    out = column
    for char in "\\<[|":
        out = f"replace({out}, '{char}', '\\{char}')"
    return out


ORACLE = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), ''))
    as loss_sha256,
  (3 + sum(10 + length({_escaped_sql('role')}) + length({_escaped_sql('text')})))::bigint as formatted_chars,
  false as rewrites
from t group by conv_id
"""

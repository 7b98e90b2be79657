"""Conversation structure repair by a lightest derivation (Knuth's generalisation of Dijkstra's algorithm).

A repair keeps, re-roles or deletes every row and inserts empty rows, so that the initials of the roles
read ``(s?(ua)+)?``. It is a derivation in a weighted deduction system, whose hyperedges are

    row i may be edited by e      (axioms: Keep, Rerole, Delete, with their cost and letter)
    i rows read, state q  +  row i edited by e  ->  i + 1 rows read, state q'
    i rows read, state q                        ->  i rows read, state q''      (Insert)
    all rows read, a final state                ->  goal

A conclusion weighs the sum of its antecedents' costs and their letters in a row. Weights are compared as
(cost, audit), audits in ASCII order. The functions are superior, for a longer audit with the same
beginning is larger, and monotone, since two audits of the same rows and the same cost are never one the
beginning of the other (what is left would be Inserts, which cost something). So the agenda pops every item
at its lightest weight, and ends when the goal is popped.

A conversation longer than ``BLOCK`` rows is read in blocks: the end states of one block, with their cost
and the order of their audits, are the axioms of the next. So memory holds one block of rows, and per
state a digest of the repaired rows so far, whatever a conversation's length. Its audit is one string, and
its repaired text one digest over rows in order, so its rows pass through one task, sorted by Spark. Which
rows repeat earlier ones is found by a sum per (conversation, role, text) before, in Spark.

Defined cases: null role and text count as one space, a null turn comes first and takes no part in gaps;
rows of a turn are ordered by role and text, so ties and repeated rows have a fixed order; rows with a null
conversation form one; texts of any length are hashed; an empty table gives an empty result; columns that
are not named are never read and may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from turnloom.llm.merkle import crc32_sql

BLOCK, BLOCK_CHARS = 1024, 16 << 20
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACES = "\x20\x09\x0A\x0B\x0C\x0D"
START, SYSTEM, PAIRED, ASKED = range(4)  # nothing yet; after the system row; after a pair; after a user row
EXPECTED = {START: "user", SYSTEM: "user", PAIRED: "user", ASKED: "assistant"}
NEXT = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (PAIRED, "u"): ASKED,
        (ASKED, "a"): PAIRED}
FINAL = (START, PAIRED)
LEGAL = ("su", "ua", "au")
REPAIRED = StructType([
    StructField("conv_id", LongType()),
    *[StructField(c, LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    StructField("audit", StringType()), StructField("repaired_sha256", StringType()),
])
Weight = tuple[int, str]
Item = tuple
Row = tuple[str, str, str]  # role, text, fault


def lightest(rows: Sequence[tuple[str, str]], starts: dict[int, Weight], last: bool) -> dict[int, Weight]:
    """The lightest weight of every end state after rows of (initial of the role, fault).

    ``last``: the rows end the conversation, and only the lightest final state is returned.
    """
    agenda: list[tuple[int, str, Item]] = [(*w, ("read", 0, q)) for q, w in starts.items()]
    for i, (initial, fault) in enumerate(rows):
        more = TRUNCATED if fault == "truncated" else 0
        agenda.append((DELETE, "D", ("edit", i, None)))
        if fault not in ("blank", "duplicate"):
            agenda.append((more, "K", ("edit", i, initial)))
            agenda.extend((REROLE + more, "R", ("edit", i, x)) for x in "ua" if x != initial)
    heapq.heapify(agenda)
    done: set[Item] = set()
    edits: list[list[tuple[int, str, str | None]]] = [[] for _ in rows]
    reads: list[list[tuple[int, str, int]]] = [[] for _ in range(len(rows) + 1)]
    ends: dict[int, Weight] = {}

    def apply(cost: int, audit: str, q: int, i: int, edit: tuple[int, str, str | None]) -> None:
        more, letter, initial = edit
        to = q if initial is None else NEXT.get((q, initial))
        if to is not None and ("read", i + 1, to) not in done:
            heapq.heappush(agenda, (cost + more, audit + letter, ("read", i + 1, to)))

    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        kind, i, q = item
        if (item, audit) in done if kind == "edit" else item in done:
            continue
        done.add((item, audit) if kind == "edit" else item)
        if kind == "edit":
            edits[i].append((cost, audit, q))
            for at_cost, before, state in reads[i]:
                apply(at_cost, before, state, i, edits[i][-1])
        elif kind == "goal":
            return {q: (cost, audit)}
        else:
            reads[i].append((cost, audit, q))
            if i < len(rows):
                for edit in edits[i]:
                    apply(cost, audit, q, i, edit)
            elif last and q in FINAL:
                heapq.heappush(agenda, (cost, audit, ("goal", i, q)))
            else:
                ends[q] = (cost, audit)
                if not last and len(ends) == len(EXPECTED):
                    return ends
            if last or i < len(rows):  # before a row or at the very end, so each insert has one place
                to = NEXT[q, EXPECTED[q][0]]
                if ("read", i, to) not in done:
                    heapq.heappush(agenda, (cost + INSERT, audit + "I", ("read", i, to)))
    return ends


def edited(rows: Sequence[Row], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """Role and text of the rows that an audit leaves, from a state on."""
    at = 0
    for letter in audit:
        role, text = (EXPECTED[state], "") if letter == "I" else rows[at][:2]
        at += letter != "I"
        if letter == "D":
            continue
        role = EXPECTED[state] if letter == "R" else role
        state = NEXT[state, role[:1]]
        yield role, text


class Repair:
    """The repair of one conversation, block by block.

    Per end state it holds cost, pieces of the audit, and a digest of the repaired rows; ranks of audits
    stand for the audits themselves when the next block compares weights.
    """

    def __init__(self, block: int = BLOCK):
        self.block, self.rows, self.chars = block, [], 0
        self.states = {START: (0, None, hashlib.sha256(), False)}
        self.ranks = {START: 0}
        self.turns, self.least, self.most, self.turn = 0, None, None, None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.before, self.last_row = 0, None, None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        """The next row; ``seen``: role and text occur in an earlier turn."""
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        repeats = self.last_row == (turn, role, text)
        self.turn, self.last_row = turn, (turn, role, text)
        stripped = text.strip(SPACES)
        fault = ("blank" if not stripped else "duplicate" if seen or repeats
                 else "truncated" if stripped[-1] not in ".!?" else "")
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if len(self.rows) >= self.block or self.chars > BLOCK_CHARS:
            self._advance(last=False)
        self.rows.append((role, text, fault))
        self.chars += len(text)

    def _advance(self, last: bool) -> None:
        starts = {q: (s[0], chr(self.ranks[q])) for q, s in self.states.items()}
        ends = lightest([(r[:1], fault) for r, _, fault in self.rows], starts, last)
        origin = {rank: q for q, rank in self.ranks.items()}
        states = {}
        for q, (cost, audit) in ends.items():
            came = origin[ord(audit[0])]
            _, pieces, digest, begun = self.states[came]
            digest = digest.copy()
            for role, text in edited(self.rows, audit[1:], came):
                digest.update((f"\n{role}:{text}" if begun else f"{role}:{text}").encode())
                begun = True
            states[q] = cost, (pieces, audit[1:]), digest, begun
        order = sorted(ends, key=lambda q: ends[q][1])
        self.states, self.ranks = states, {q: i for i, q in enumerate(order)}
        self.rows, self.chars = [], 0

    def result(self) -> tuple:
        self._advance(last=True)
        ((cost, pieces, digest, _),) = self.states.values()
        audit = []
        while pieces is not None:
            pieces, piece = pieces
            audit.append(piece)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (min(gaps, (1 << 63) - 1), *self.counts.values(), self.illegal, cost,
                "".join(reversed(audit)), digest.hexdigest())


def _repairs(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for conv, there, turn, role, text, seen in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or conv != key:
                    if state is not None:
                        out.append((key, *state.result()))
                    key, state = conv, Repair(block)
                if there:
                    state.add(turn, role, text, seen)
            if len(out) > 5000:
                yield _batch(out)
                out = []
        if state is not None:
            out.append((key, *state.result()))
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], REPAIRED.names)


def repaired(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text", there: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: counts of faults, cost, audit and digest of its cheapest repair.

    Rows whose column ``there`` is false only name their conversation.
    """
    space = F.lit(" ")
    facts = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        (F.lit(True) if there is None else F.col(there)).alias("there"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"),
    ).withColumn("said", F.sha2(F.col("text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = facts.where("there").groupBy("conv_id", "role", "said").agg(
        F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    same = F.lit(True)
    for c in ("conv_id", "role", "said"):
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"e.{c}"))
    marked = facts.alias("f").join(first.alias("e"), same, "left").select(
        "f.conv_id", "f.there", "f.turn", "f.role", "f.text",
        F.coalesce(F.struct(F.col("f.turn").isNotNull().alias("known"), F.col("f.turn")) > F.col("e.first"),
                   F.lit(False)).alias("seen"))
    return (
        marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(_repairs(block), REPAIRED)
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with one row in four spoilt, by the CRC-32 of conversation and turn."""
    text = F.coalesce("text", F.lit(" "))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    spoilt = rows.select("conv_id", "turn", "role", text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_d"))
    return spoilt.select(
        "conv_id", "turn",
        F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        (F.col("_d") != 0).alias("there"),
        F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), there="there")


# Dynamic programming over rows and states, not an agenda: states are s(tart), y (after system), p(aired), a(sked).
ORACLE = f"""
with recursive d as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc32_sql("concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' '))")} % 20 as d
  from conversations),
r as (
  select conv_id, turn, case when d = 4 then 'user' else role end as role,
    case d when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from d, unnest(case when d = 3 then [0, 1] else [0] end) where d <> 0),
n as (
  select *, row_number() over w as i, left(role, 1) as initial, lag(left(role, 1)) over w as before, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as said
  from r window w as (partition by conv_id order by turn nulls first, role, text)),
f as (
  select *, case when said = '' then 'blank'
    when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
    when right(said, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from n),
ins(q, cost, letters, rows, q2) as (values
  ('s', 0, '', '', 's'), ('y', 0, '', '', 'y'), ('p', 0, '', '', 'p'), ('a', 0, '', '', 'a'),
  ('s', 3, 'I', 'user:' || chr(10), 'a'), ('y', 3, 'I', 'user:' || chr(10), 'a'), ('p', 3, 'I', 'user:' || chr(10), 'a'),
  ('a', 3, 'I', 'assistant:' || chr(10), 'p'),
  ('s', 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 'p'),
  ('y', 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 'p'),
  ('p', 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10), 'p'),
  ('a', 6, 'II', 'assistant:' || chr(10) || 'user:' || chr(10), 'a')),
moves(q, initial, letter, q2) as (values
  ('s', 's', 'K', 'y'), ('s', 'u', 'K', 'a'), ('y', 'u', 'K', 'a'), ('p', 'u', 'K', 'a'), ('a', 'a', 'K', 'p'),
  ('s', null, 'R', 'a'), ('y', null, 'R', 'a'), ('p', null, 'R', 'a'), ('a', null, 'R', 'p'),
  ('s', null, 'D', 's'), ('y', null, 'D', 'y'), ('p', null, 'D', 'p'), ('a', null, 'D', 'a')),
dp as (
  select distinct conv_id, 0::bigint as i, 's' as q, {{'cost': 0, 'audit': '', 'kept': ''}} as w from conversations
  union all
  select dp.conv_id, dp.i + 1, m.q2, min({{
    'cost': w.cost + ins.cost + case m.letter when 'D' then 4 when 'R' then 3 else 0 end
      + case when fault = 'truncated' and m.letter <> 'D' then 3 else 0 end,
    'audit': w.audit || ins.letters || m.letter,
    'kept': w.kept || ins.rows || case m.letter when 'D' then '' when 'K' then role || ':' || text || chr(10)
      else case m.q when 'a' then 'assistant' else 'user' end || ':' || text || chr(10) end}})
  from dp join f on f.conv_id is not distinct from dp.conv_id and f.i = dp.i + 1
  join ins on ins.q = dp.q
  join moves m on m.q = ins.q2 and (m.initial is null or m.initial = f.initial)
    and (m.letter = 'D' or f.fault not in ('blank', 'duplicate'))
  group by dp.conv_id, dp.i + 1, m.q2),
facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
    count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated,
    count(*) filter (where i > 1 and before || initial not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from f group by conv_id),
best as (
  select dp.conv_id, min({{'cost': w.cost + ins.cost, 'audit': w.audit || ins.letters, 'kept': w.kept || ins.rows}}) as w
  from dp join ins on ins.q = dp.q left join facts on facts.conv_id is not distinct from dp.conv_id
  where dp.i = coalesce(facts.n, 0) and ins.q2 in ('s', 'p') group by dp.conv_id)
select best.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, w.cost::bigint as cost, w.audit as audit,
  sha256(left(w.kept, greatest(length(w.kept) - 1, 0))) as repaired_sha256
from best left join facts on facts.conv_id is not distinct from best.conv_id
"""

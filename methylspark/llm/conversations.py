"""Conversation structure repair by iterative-deepening A* over edits (operator 12)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_sql, named, partitions, table

#: What an edit costs, what a truncated row that is not deleted adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
#: States after a role was put out: nothing yet, system, user, assistant. A repaired conversation ends in nothing or assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: The role that may be put in after each state.
PUT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: The heuristic knows the rest of a row's block exactly and takes each later block at its cheapest; there are so many blocks at any length.
BLOCKS = 8

_INK = re.compile(r"[^\x20\x09-\x0D]")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def fault(text: str, seen: bool) -> str | None:
    """A row's first fault; ``seen`` tells whether its role and text stood in an earlier row."""
    inked = text.rstrip(_SPACE)
    if not inked:
        return BLANK
    return DUPLICATE if seen else None if inked[-1] in ".!?" else CUT


def edits(rows: list[tuple[str, str | None]], at: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, cost, next row, next state) of each edit possible before row ``at``, in ASCII order."""
    if at < len(rows):
        yield "D", DELETE, at + 1, state
    yield "I", INSERT, at, PUT[state]
    if at < len(rows):
        initial, wrong = rows[at]
        if wrong not in (BLANK, DUPLICATE):
            more = TRUNCATED if wrong == CUT else 0
            if (state, initial) in NEXT:
                yield "K", more, at + 1, NEXT[state, initial]
            yield "R", REROLE + more, at + 1, PUT[state]


def lower_bounds(rows: list[tuple[str, str | None]]) -> list[int]:
    """For each (row, state), as 4 * row + state, a cost that no way to an accepted end goes below.

    Rows are cut into BLOCKS blocks. Inside a block costs are exact; at its end any state is let pass, and each later
    block costs what it costs from its best state.
    """
    n = len(rows)
    size = -(-n // BLOCKS) or 1
    # what is left after the last row: a user needs an assistant, a system message both
    ahead = [0, 2 * INSERT, INSERT, 0]
    out = [0] * (4 * n) + ahead
    for at in range(n - 1, -1, -1):
        if (at + 1) % size == 0 and at + 1 < n:
            ahead = [min(ahead)] * 4
        own = [min(c + ahead[s] for e, c, i, s in edits(rows, at, state) if e != "I") for state in range(4)]
        # one assistant put in leads from user to assistant, one user from any other state to user
        user, assistant = min(own[USER], INSERT + own[ASSISTANT]), min(own[ASSISTANT], INSERT + own[USER])
        ahead = [min(own[START], INSERT + user), min(own[SYSTEM], INSERT + user), user, assistant]
        out[4 * at : 4 * at + 4] = ahead
    return out


def repair(rows: list[tuple[str, str | None]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of (role initial, first fault) rows, the ASCII-least of equal cost.

    Depth-first search takes edits in ASCII order, an end before any edit, and follows them as far as the bound on
    cost allows, so the first accepting path is the answer. Failed states stay in a table with the cost that they are
    now known to need, at every bound; the root's entry is the next bound.
    """
    need, n = lower_bounds(rows), len(rows)
    bound = need[START]
    while True:
        # frames: row, state, what may still be spent, edits not tried yet, initial that led here
        stack = [(0, START, bound, edits(rows, 0, START), "")]
        while stack:
            at, state, left, todo, _ = stack[-1]
            if at == n and state in (START, ASSISTANT):
                return bound - left, "".join(f[4] for f in stack)
            for initial, cost, i, s in todo:
                if cost + need[4 * i + s] <= left:
                    stack.append((i, s, left - cost, edits(rows, i, s), initial))
                    break
            else:
                need[4 * at + state] = max(need[4 * at + state], min(c + need[4 * i + s] for _, c, i, s in edits(rows, at, state)))
                stack.pop()
        bound = need[START]


def apply(rows: list[tuple[str, str]], initials: list[str], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation."""
    at, state = 0, START
    for edit in audit:
        if edit == "K":
            state = NEXT[state, initials[at]]
            yield rows[at]
        elif edit in "IR":
            state = PUT[state]
            yield ROLE[state], "" if edit == "I" else rows[at][1]
        at += edit != "I"


def reviewed(rows: list[tuple[str, str]]) -> dict:
    """Faults, edits and the repaired rows of one conversation, given in order."""
    seen, facts = set(), []
    for role, text in rows:
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        facts.append((role[:1], fault(text, mark in seen)))
        seen.add(mark)
    cost, audit = repair(facts)
    initials = [f[0] for f in facts]
    kinds = [f[1] for f in facts]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    counts = {k: kinds.count(k) for k in (BLANK, DUPLICATE, CUT)}
    return counts | {"illegal": illegal, "cost": cost, "audit": audit, "repaired": apply(rows, initials, audit)}


def _digest(lines: Iterable[tuple[str, str]]) -> str:
    out = hashlib.sha256()
    for k, (role, text) in enumerate(lines):
        out.update(("\n" * (k > 0) + f"{role}:{text}").encode())
    return out.hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``conversations`` with one row of five damaged in a way that its id and turn decide.

    crc32 of "conv_id:turn" mod 20: 0 drops the row, 1 empties its text, 2 removes its full stops, question and
    exclamation marks, 3 gives it twice, 4 makes its role user. A null in any column counts as one space.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.encode(F.concat(told("conv_id"), F.lit(":"), told("turn")), "utf-8")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    copies = F.array_repeat(F.lit(0), F.when(way == 3, 2).otherwise(1))
    d = conversations.filter(way != 0).select("conv_id", "turn", F.when(way == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy"))
    return d.drop("_copy")


def _by_conversation(batches, ids: list[str]):
    """(values of ``ids``, rows) of each conversation from batches in which its rows stand together."""
    now, held = None, []
    for b in batches:
        columns = [named(b, c).to_pylist() for c in (*ids, "turn", "role", "text")]
        for *key, turn, role, text in zip(*columns):
            if key != now:
                if now is not None:
                    yield now, held
                now, held = key, []
            held.append((turn, role, text))
    if now is not None:
        yield now, held


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows of a conversation together in one task, by turn (nulls first), then role and text."""
    c = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return c.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row a conversation.

    ``rows`` has conv_id, turn, role and text; null roles and texts count as one space, null ids are one
    conversation, and rows of one turn are taken by role and text. Blank rows have no sign but white space, duplicates
    have role and text of an earlier row, truncated ones end otherwise than in a full stop, question or exclamation
    mark. An empty role has no initial and is never kept. One shuffle by conv_id, sorted on disk; a task holds one
    conversation at a time, because one row has its audit and its digest.
    """

    def run(batches):
        for (conv,), held in _by_conversation(batches, ["conv_id"]):
            r = reviewed([(role, text) for _, role, text in held])
            own = [r[k] for k in (BLANK, DUPLICATE, CUT, "illegal", "cost")]
            yield conv, *own, r["audit"], _digest(r["repaired"])

    shape = f"conv_id {_kind(rows, 'conv_id')}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _sorted(rows).mapInArrow(lambda batches: _batches(run(batches), batches_schema(shape)), shape)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the repaired conversations themselves, rows counted from 0. Input as above."""

    def run(batches):
        for (conv,), held in _by_conversation(batches, ["conv_id"]):
            for k, (role, text) in enumerate(reviewed([(role, text) for _, role, text in held])["repaired"]):
                yield conv, k, role, text

    shape = f"conv_id {_kind(rows, 'conv_id')}, place long, role string, text string"
    return _sorted(rows).mapInArrow(lambda batches: _batches(run(batches), batches_schema(shape)), shape)


def batches_schema(shape: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in shape.split(", ")])


def _batches(rows, schema: pa.Schema, size: int = 2000):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each conv_id of ``conversations``, damaged and repaired: gaps, faults, cost, audit and the digest of the result.

    gaps are the turns missing between the first and the last after damage. Conversations that lost all rows have
    zeros, an empty audit and the digest of empty text. Nulls as in ``damage``, null conv_ids are one conversation;
    an empty table gives no rows.
    """
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damage(given)
    # counted before the shuffle as far as a task's rows go: turns of one conversation may repeat
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("_one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    every = given.select("conv_id").distinct()
    fixed = repair_conversations(rows)
    same = lambda df, k: df.withColumnRenamed("conv_id", k)
    out = every.join(same(turns, "_t"), F.col("conv_id").eqNullSafe(F.col("_t")), "left").join(same(fixed, "_f"), F.col("conv_id").eqNullSafe(F.col("_f")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _sql() -> str:
    """Cheapest repairs from each row's end on, by recursion over rows from the last to the first.

    A state's value is {cost, audit, lines}; the least of such structs is the answer of the state.
    """
    names = {START: "st", SYSTEM: "sy", USER: "us", ASSISTANT: "an"}
    value = lambda c, a, t: f"{{'c': ({c})::bigint, 'a': {a}, 't': {t}}}"
    line = lambda role, text: f"chr(10) || {role} || ':' || {text}"
    none = value(10**9, "'~'", "''")

    def own(state):
        """The best of deleting, keeping and turning a row; v has the states after it."""
        here, put = f"v.{names[state]}", PUT[state]
        drop = value(f"{here}.c + {DELETE}", f"'D' || {here}.a", f"{here}.t")
        kept = [(c, f"v.{names[to]}") for (s, c), to in NEXT.items() if s == state]
        keep = "case " + " ".join(f"when can and ini = '{c}' then {value(f'{to}.c + more', f"'K' || {to}.a", line('role', f'text || {to}.t'))}" for c, to in kept) + f" else {none} end"
        to, role = f"v.{names[put]}", f"'{ROLE[put]}'"
        turn = f"case when can then {value(f'{to}.c + {REROLE} + more', f"'R' || {to}.a", line(role, f'text || {to}.t'))} else {none} end"
        return f"least({drop}, {keep}, {turn}) as o{names[state]}"

    def put_in(state, after):
        role = ROLE[PUT[state]]
        return f"least(o{names[state]}, {value(f'{after}.c + {INSERT}', f"'I' || {after}.a", line(f"'{role}'", f'{after}.t'))}) as {names[state]}"

    start = {"st": value(0, "''", "''"), "sy": value(6, "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'"), "us": value(3, "'I'", "chr(10) || 'assistant:'"), "an": value(0, "''", "''")}
    first = ", ".join(f"{start[n]} as {n}" for n in names.values())
    white = "[\\x20\\x09-\\x0D]"
    return f"""with recursive
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as way from conversations),
d as (select conv_id, turn, case when way = 4 then 'user' else role end as role, case way when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from k, range(2) x(copy) where way <> 0 and (copy = 0 or way = 3)),
f as (select *, row_number() over (partition by conv_id, role, text order by i) as again, regexp_replace(text, '{white}+$', '') as ink,
    role[1] as ini, lag(role[1]) over (partition by conv_id order by i) as was from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d)),
g as (select *, case when ink = '' then 'blank' when again > 1 then 'duplicate' when right(ink, 1) not in ('.', '!', '?') then 'truncated' else '' end as wrong from f),
r as (select *, wrong not in ('blank', 'duplicate') as can, case when wrong = 'truncated' then {TRUNCATED} else 0 end as more from g),
n as (select conv_id, count(*) as rows, count(*) filter (wrong = 'blank') as blank, count(*) filter (wrong = 'duplicate') as duplicate, count(*) filter (wrong = 'truncated') as truncated,
  count(*) filter (was is not null and was || ini not in ('su', 'ua', 'au')) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from r group by conv_id),
v as (select conv_id, rows as i, {first} from n
  union all select conv_id, i, {put_in(START, 'us')}, {put_in(SYSTEM, 'us')}, us, an from (select *, {put_in(USER, 'oan')}, {put_in(ASSISTANT, 'ous')}
    from (select r.conv_id, r.i - 1 as i, {', '.join(map(own, names))} from v join r on r.conv_id is not distinct from v.conv_id and r.i = v.i)))
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(v.st.c, 0)::bigint as cost, coalesce(v.st.a, '') as audit, sha256(coalesce(substr(v.st.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) e left join n on n.conv_id is not distinct from e.conv_id left join v on v.conv_id is not distinct from e.conv_id and v.i = 0"""


OP12_SQL = _sql()

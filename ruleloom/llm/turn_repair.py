"""Conversations put back into a legal order of turns at least cost, however long they are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import repair_tables
from .common import session, stored
from .repair_tables import GONE, INSERT, NOTHING, ROLE, symbol

WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
# A piece of a conversation ends after so many turns or characters.
PIECE_TURNS, PIECE_CHARS = 1024, 1 << 16
# Turns of one number are ordered by so many characters of role and text, then by a hash.
PREFIX = 32
LEGAL = {"su", "ua", "au"}
MOST = (1 << 63) - 1

PIECE = (
    "part int, seq long, whole boolean, role array<string>, text array<string>, fault array<int>, key array<binary>, "
    "low long, high long, turns long"
)
REPAIRED = (
    "part int, seq long, whole boolean, size long, low long, high long, turns long, blank long, duplicate long, truncated long, "
    "illegal long, first_initial string, last_initial string, cost long, audit string, repaired array<struct<role: string, text: string>>"
)


def damaged(conversations: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """The turns after the damage that the CRC of their id and number decides on: ``conv_id, turn, role, text, copies``."""
    def given(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(given(id_column), F.lit(":"), given(turn_column))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(given(text_column), ENDS, "")).otherwise(given(text_column))
    return conversations.select(
        F.col(id_column).alias("conv_id"),
        F.col(turn_column).cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(given(role_column)).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def fault_of(text: str) -> int:
    body = text.rstrip(WHITE)
    return BLANK if not body else SOUND if body[-1] in ENDS else TRUNCATED


def key_of(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode(), usedforsecurity=False).digest()


class Piece:
    """Turns of one conversation that follow each other."""

    def __init__(self, conv, opened: bool):
        self.conv, self.opened, self.cut = conv, opened, False
        self.role, self.text, self.chars = [], [], 0
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, role: str, text: str) -> None:
        self.role.append(role)
        self.text.append(text)
        self.chars += len(text)
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1

    def row(self, whole: bool) -> tuple:
        faults = [fault_of(x) for x in self.text]
        if whole:
            seen = set()
            for n, (pair, fault) in enumerate(zip(zip(self.role, self.text, strict=True), faults, strict=True)):
                if fault != BLANK and pair in seen:
                    faults[n] = DUPLICATE
                seen.add(pair)
            keys = None
        else:
            keys = [None if f == BLANK else key_of(r, t) for r, t, f in zip(self.role, self.text, faults, strict=True)]
        return whole, self.role, self.text, faults, keys, self.low, self.high, self.turns


def cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema, piece_turns: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns as pieces.  Whether a conversation goes on in a neighbouring task is not known at either end of this one."""
    part = TaskContext.get().partitionId()
    held: Piece | None = None
    rows, size, seq = [], 0, 0

    def close(whole: bool) -> None:
        nonlocal size, seq
        rows.append((held.conv, part, seq, *held.row(whole)))
        size += held.chars
        seq += 1

    def flushed() -> pa.RecordBatch:
        nonlocal rows, size
        columns = [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)]
        rows, size = [], 0
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    first = True
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("conv_id", "turn", "role", "text", "copies"))
        for conv, turn, role, text, copies in zip(*columns, strict=True):
            if held is None or held.conv != conv:
                if held is not None:
                    close(whole=not held.opened and not held.cut)
                held = Piece(conv, opened=first)
                first = False
            for _ in range(copies):
                if len(held.role) >= piece_turns or held.chars >= PIECE_CHARS:
                    close(whole=False)
                    held, before = Piece(conv, held.opened), held
                    held.cut = True
                    if before.high == turn and turn is not None:
                        held.high = turn  # counted there
                held.add(turn, role, text)
            if len(rows) >= 256 or size >= 4 * PIECE_CHARS:
                yield flushed()
    if held is not None:
        close(whole=False)
    if rows:
        yield flushed()


def symbols_of(roles: list[str], faults: list[int]) -> np.ndarray:
    return np.array(
        [GONE if f in (BLANK, DUPLICATE) else symbol(r[:1], f == TRUNCATED) for r, f in zip(roles, faults, strict=True)], dtype=np.int64)


def repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces whose neighbours are known: ``behind``, the cost vector behind them, and ``state``, that in front of them."""
    tables = repair_tables.tables()
    for batch in batches:
        rows = []
        for p in batch.to_pylist():
            faults = p["fault"]
            for n in p["again"] or ():
                faults[n] = DUPLICATE
            done, state, cost = tables.trace(symbols_of(p["role"], faults), p["behind"], p["state"])
            now, kept = p["state"], []
            for edits, role, text in zip(done, p["role"], p["text"], strict=True):
                for edit in edits:
                    if edit == "D":
                        continue
                    follows = repair_tables.AFTER[now]
                    if edit == "I":
                        kept.append({"role": ROLE[follows], "text": ""})
                    else:
                        kept.append({"role": role if edit == "K" else ROLE[follows], "text": text})
                        follows = repair_tables.SYSTEM if edit == "K" and now == NOTHING and role[:1] == "s" else follows
                    now = follows
            ending = tables.ending(state) if p["last"] else ""
            for _ in ending:
                now = repair_tables.AFTER[now]
                kept.append({"role": ROLE[now], "text": ""})
            initials = [r[:1] for r in p["role"]]
            rows.append({
                **{name: p[name] for name in ("conv_id", "part", "seq", "whole", "low", "high", "turns")},
                "size": len(faults), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
                "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
                "first_initial": initials[0] if initials else None, "last_initial": initials[-1] if initials else None,
                "cost": cost + INSERT * len(ending), "audit": "".join(done) + ending, "repaired": kept,
            })
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = repair_tables.tables()
    for batch in batches:
        fronts, states = [], []
        for p in batch.select(["role", "fault", "again"]).to_pylist():
            for n in p["again"] or ():
                p["fault"][n] = DUPLICATE
            front, state = tables.summary(symbols_of(p["role"], p["fault"]))
            fronts.append(front.tobytes())
            states.append(state.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("part"), batch.column("seq"), pa.array(fronts, pa.binary()), pa.array(states, pa.binary())],
            names=["conv_id", "part", "seq", "front", "after"],
        )


def linked(pieces: pd.DataFrame) -> pd.DataFrame:
    """From the summaries of one conversation's pieces: the vector behind each, from the last to the first, then the state in
    front of each, from the first to the last."""
    pieces = pieces.sort_values(["part", "seq"])
    fronts = [np.frombuffer(x, dtype=np.int16) for x in pieces["front"]]
    afters = [np.frombuffer(x, dtype=np.int8).reshape(-1, 4) for x in pieces["after"]]
    behind = [0] * len(pieces)
    for n in range(len(pieces) - 1, 0, -1):
        behind[n - 1] = int(fronts[n][behind[n]])
    state = [NOTHING] * len(pieces)
    for n in range(1, len(pieces)):
        state[n] = int(afters[n - 1][behind[n - 1], state[n - 1]])
    last = [False] * (len(pieces) - 1) + [True]
    return pd.DataFrame({"part": pieces["part"], "seq": pieces["seq"], "behind": behind, "state": state, "last": last})


def _type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def repair_pieces(
    conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
    piece_turns: int = PIECE_TURNS,
) -> DataFrame:
    """Damaged conversations and their cheapest repair, in pieces of at most 1,024 turns: columns ``conv_id`` and ``REPAIRED``.

    Turns are dealt and sorted by conversation and place, so that a long conversation lies in several tasks, and cut into pieces.
    A conversation that is one piece is repaired at once.  For the others, each piece tells what it makes of every possible
    cost vector behind it and every state in front of it; these few numbers are linked per conversation, after which all
    pieces are repaired in parallel.  Repeated turns across pieces are found by hash and joined from stored tables.
    One task links a conversation, at some 250 bytes per 1,024 turns.

    Null roles and texts, and null ids and numbers where the damage is decided, are one space.  Rows without an id are
    one conversation.  Turns without a number come first; turns of the same number are ordered by role and text
    (32 characters, then a hash).  A role that does not begin with s, u or a (also an empty one) cannot be kept.  An empty table
    gives no rows.  Other columns are not read.
    """
    session(conversations.sparkSession)
    turns = damaged(conversations, id_column, turn_column, role_column, text_column)
    kind = _type_of(turns, "conv_id")
    role, text = F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX)
    place = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), role.asc(), text.asc(), F.xxhash64("role", "text").asc()]
    numbered = turns.withColumn("input_place", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(*place, "input_place").sortWithinPartitions(*place, "input_place")
    def arrow(fields: str) -> tuple[str, pa.Schema]:
        text = f"conv_id {kind}, {fields}"
        return text, to_arrow_schema(StructType.fromDDL(text))

    piece_text, piece_schema = arrow(PIECE)
    repaired_text, repaired_schema = arrow(REPAIRED)
    pieces = stored(dealt.mapInArrow(lambda batches: cut(batches, piece_schema, piece_turns), piece_text), "turn-pieces")

    alone = pieces.filter("whole").select(
        "*", F.lit(None).cast("array<int>").alias("again"), F.lit(0).alias("behind"), F.lit(NOTHING).alias("state"), F.lit(True).alias("last"))

    parted = pieces.filter("NOT whole")
    turn = stored(parted.select("conv_id", "part", "seq", F.posexplode("key").alias("n", "key")).filter("key IS NOT NULL"), "turn-keys")
    first = turn.groupBy("conv_id", "key").agg(F.min(F.struct("part", "seq", "n")).alias("first"), F.count(F.lit(1)).alias("times"))
    first = stored(first.filter("times > 1").select(F.col("conv_id").alias("of"), F.col("key").alias("same"), "first"), "turn-firsts")
    later = turn.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("same"))).filter(
        F.struct("part", "seq", "n") != F.col("first"))
    again = later.groupBy("part", "seq").agg(F.collect_list("n").alias("again"))
    marked = stored(parted.join(again, ["part", "seq"], "left").select("conv_id", *(c for c in pieces.columns if c != "conv_id"), "again"), "turn-marked")
    summed = marked.mapInArrow(summaries, f"conv_id {kind}, part int, seq long, front binary, after binary")
    links = stored(
        summed.groupBy("conv_id").applyInPandas(linked, "part int, seq long, behind int, state int, last boolean"), "turn-links")
    together = alone.unionByName(marked.join(links, ["part", "seq"]))
    return together.mapInArrow(lambda batches: repaired(batches, repaired_schema), repaired_text)


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """The repaired conversations turn by turn: ``conv_id, part, seq, at, role, text``, in order of ``part, seq, at``."""
    return pieces.select("conv_id", "part", "seq", F.posexplode("repaired").alias("at", "turn")).select(
        "conv_id", "part", "seq", "at", "turn.role", "turn.text")


class Digest:
    """What the contract asks of one conversation, from its pieces in order."""

    COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")

    def __init__(self, conv):
        self.conv, self.hash, self.audit, self.begun = conv, hashlib.sha256(), [], False
        self.count = dict.fromkeys(self.COUNTS, 0)
        self.low = self.high = self.initial = None
        self.turns = 0

    def add(self, p: dict) -> None:
        for name in self.COUNTS:
            self.count[name] += p[name]
        if p["size"]:
            if self.initial is not None and self.initial + p["first_initial"] not in LEGAL:
                self.count["illegal"] += 1
            self.initial = p["last_initial"]
        if p["low"] is not None:
            self.turns += p["turns"] - (self.high == p["low"] and p["turns"] > 0)
            self.low = p["low"] if self.low is None else self.low
            self.high = p["high"]
        self.audit.append(p["audit"])
        for turn in p["repaired"]:
            self.hash.update(f"{chr(10) if self.begun else ''}{turn['role']}:{turn['text']}".encode())
            self.begun = True

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv, "gaps": min(gaps, MOST), **self.count, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def folded(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: Digest | None = None
    for batch in batches:
        rows = []
        for p in batch.to_pylist():
            if held is None or held.conv != p["conv_id"]:
                if held is not None:
                    rows.append(held.row())
                held = Digest(p["conv_id"])
            held.add(p)
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_pylist([held.row()], schema=schema)


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Whole conversations are folded where they are; the pieces of the others meet in order.  A hash of a whole conversation is
    made from its first turn to its last, so one task streams a conversation's repaired text, holding its audit.  Gaps stop at
    2^63 - 1.
    """
    kept = stored(pieces, "turn-repaired")
    text = (
        f"conv_id {_type_of(pieces, 'conv_id')}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
        "audit string, repaired_sha256 string"
    )
    schema = to_arrow_schema(StructType.fromDDL(text))
    met = kept.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return kept.filter("whole").mapInArrow(lambda batches: folded(batches, schema), text).unionByName(
        met.mapInArrow(lambda batches: folded(batches, schema), text))


def _sql_edit(struct: str, cost: str, initial: str, turn: str) -> str:
    return f"{{'c': {struct}.c + {cost}, 'a': '{initial}' || {struct}.a, 'r': {turn} || {struct}.r}}"


def _sql_state(state: str, follows: str, role: str, keeps: dict[str, str]) -> str:
    """The cheapest edit of a turn in a state and all that follows, before insertions."""
    kept = " ".join(f"WHEN initial = '{i}' THEN {_sql_edit(to, 'more', 'K', 'kept')}" for i, to in keeps.items())
    none = "{'c': 1000000000, 'a': '', 'r': ''}"
    return (
        f"least({_sql_edit(state, '2', 'D', chr(39) * 2)}, CASE WHEN gone THEN {none} {kept} ELSE {none} END, "
        f"CASE WHEN gone THEN {none} ELSE {_sql_edit(follows, '1 + more', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} END)"
    )


def _sql_insert(own: str, other: str, role: str) -> str:
    return f"least({own}, {_sql_edit(other, '5', 'I', f'chr(10) || {chr(39)}{role}:{chr(39)}')})"


# For each state n(othing), s, u, a the least (cost, initials, text) of all repairs of the turns from a place on, from the
# last place to the first.
SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), crc AS (
  SELECT *, xor(list_reduce(range(8 * length(k)), lambda c, i:
    xor((CASE WHEN i % 8 = 0 THEN xor(c, CAST(ord(substr(k, i // 8 + 1, 1)) AS BIGINT)) ELSE c END) >> 1,
      ((CASE WHEN i % 8 = 0 THEN xor(c, CAST(ord(substr(k, i // 8 + 1, 1)) AS BIGINT)) ELSE c END) & 1) * 3988292384),
    CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS h FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM crc
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt
), marked AS (
  SELECT *, left(role, 1) AS initial, body = '' AS blank,
    body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS duplicate,
    lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS following FROM numbered
), faults AS (
  SELECT *, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM marked
), turns AS (
  SELECT *, CASE WHEN truncated THEN 5 ELSE 0 END AS more, chr(10) || role || ':' || text AS kept FROM faults
), ends AS (
  SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id
), walk AS (
  SELECT conv_id, n, {{'c': 0, 'a': '', 'r': ''}} AS n_, {{'c': 10, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s_,
    {{'c': 5, 'a': 'I', 'r': chr(10) || 'assistant:'}} AS u_, {{'c': 0, 'a': '', 'r': ''}} AS a_ FROM ends
  UNION ALL
  SELECT conv_id, n, {_sql_insert('hn', 'iu', 'user')}, {_sql_insert('hs', 'iu', 'user')}, iu, {_sql_insert('ha', 'hu', 'user')} FROM (
    SELECT *, {_sql_insert('hu', 'ha', 'assistant')} AS iu FROM (
      SELECT t.conv_id, w.n - 1 AS n, {_sql_state('n_', 'u_', 'user', {'s': 's_', 'u': 'u_'})} AS hn,
        {_sql_state('s_', 'u_', 'user', {'u': 'u_'})} AS hs, {_sql_state('u_', 'a_', 'assistant', {'a': 'a_'})} AS hu,
        {_sql_state('a_', 'u_', 'user', {'u': 'u_'})} AS ha
      FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.n WHERE w.n > 0
    )
  )
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
    count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
    count_if(following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id
)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.n_.c, 0) AS BIGINT) AS cost, coalesce(w.n_.a, '') AS audit,
  sha256(substr(coalesce(w.n_.r, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN walk w ON w.conv_id IS NOT DISTINCT FROM i.conv_id AND w.n = 0
"""

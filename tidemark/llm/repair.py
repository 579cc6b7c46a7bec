"""Conversation structure repair: cheapest edits by a state machine over roles, streamed over turns in both directions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, names_apart, stored, table

#: Costs of edits. Rows that are kept or get another role cost UNFINISHED more if their text breaks off.
REROLE, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. The first and the last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that leads on from each state, and the state after it. Only START also takes a system turn.
NEXT = ("u", "u", "a", "u")
AFTER = (USER, USER, ASSISTANT, USER)
ROLES = {"u": "user", "a": "assistant"}
#: Edits in ASCII order of their initials, which is the order among edits of equal cost.
D, I, K, R = range(4)
INITIALS = "DIKR"
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", ""
MUST_GO = (BLANK, DUPLICATE)
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with damage by crc32 of ``conv_id:turn`` modulo 20, and whether a row is present.

    0: the row is lost, 1: its text is empty, 2: its text loses ``.!?``, 3: it comes twice, 4: its role is user. Nulls are one space, but a
    turn stays null as well. Rows that are lost stay with present false, so that their conversation is known.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(kind == 4, "user").otherwise(shown("role"))
    made = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("present"), kind.alias("kind"))
    return made.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def faults(turns: DataFrame) -> DataFrame:
    """turns with fault: blank, duplicate (an earlier row of the conversation has its role and text), truncated or empty.

    Rows of a conversation are in order of turn, nulls first, then role and text, then _id, by which equal rows are told apart. First
    rows by conversation, role and text are aggregated before they are shuffled, and the join may split a hot key.
    """
    order = F.struct(F.col("turn").isNotNull(), "turn", "_id")
    told = turns.withColumns({"_h1": F.xxhash64("role", "text"), "_h2": F.xxhash64(F.lit("second"), "role", "text"), "_order": order})
    told = told.withColumn("_end", F.substring(F.btrim("text", F.lit(SPACE_CHARS)), -1, 1))
    keys = [F.col("conv_id").alias("_c"), F.col("_h1").alias("_a"), F.col("_h2").alias("_b")]
    first = told.filter("present").groupBy(*keys).agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b"))
    met = told.join(first, same, "left")
    earlier = F.coalesce(F.col("_first") < F.col("_order"), F.lit(False))
    fault = F.when(F.col("_end") == "", BLANK).when(earlier, DUPLICATE).when(~F.col("_end").rlike("[.!?]"), TRUNCATED).otherwise(SOUND)
    return met.select(*turns.columns, fault.alias("fault"))


class Costs:
    """Cheapest costs of what is left of a conversation from each state, built from its last row to its first."""

    def __init__(self):
        self.least = [CLOSING[s] * INSERT for s in range(4)]

    def step(self, initial: str, fault: str) -> int:
        """Take the row before; the best next edit of each state, two bits a state.

        Edits of equal cost are told by their initials: the least is the smallest next edit from which the least cost can be reached.
        """
        after, more = self.least, UNFINISHED if fault == TRUNCATED else 0
        by_state = []
        for s in range(4):
            costs = {D: DELETE + after[s]}
            if fault not in MUST_GO:
                if initial == NEXT[s]:
                    costs[K] = more + after[AFTER[s]]
                elif s == START and initial == "s":
                    costs[K] = more + after[SYSTEM]
                costs[R] = REROLE + more + after[AFTER[s]]
            by_state.append(costs)
        own = [min(costs.values()) for costs in by_state]
        made = [min(own[s], INSERT + own[AFTER[s]], 2 * INSERT + own[AFTER[AFTER[s]]]) for s in range(4)]
        packed = 0
        for s in range(4):
            by_state[s][I] = INSERT + made[AFTER[s]]
            packed |= min(e for e, c in by_state[s].items() if c == made[s]) << 2 * s
        self.least = made
        return packed


def backward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of conversations, each from its last to its first, with edits: the packed best next edits. Only costs are carried from batch to batch."""
    costs, now = Costs(), None
    for f in frames:
        made = []
        for known, conv, present, role, fault in zip(f["known"], f["conv"], f["present"], f["role"], f["fault"], strict=True):
            if (known, conv) != now:
                costs, now = Costs(), (known, conv)
            made.append(costs.step(role[:1], fault) if present else 0)
        yield f.assign(edits=made)


class Walk:
    """The edits of a conversation, from its first row to its last."""

    def __init__(self, known: bool, conv: str):
        self.known, self.conv, self.state, self.place = known, conv, START, 0

    def row(self, edit: int, turn: tuple, was: str, role: str, text: str, fault: str) -> tuple:
        self.place += 1
        return self.known, self.conv, self.place - 1, INITIALS[edit], *turn, was, role, text, fault

    def lead(self) -> str:
        """The role that leads on, which also is that of the next state."""
        role = ROLES[NEXT[self.state]]
        self.state = AFTER[self.state]
        return role

    def take(self, edits: int, turn: tuple, role: str, text: str, fault: str) -> Iterator[tuple]:
        while (edit := edits >> 2 * self.state & 3) == I:
            yield self.row(I, (False, 0), "", self.lead(), "", SOUND)
        if edit == D:
            yield self.row(D, turn, role, "", "", fault)
        elif edit == R:
            yield self.row(R, turn, role, self.lead(), text, fault)
        else:
            self.state = SYSTEM if self.state == START and role[:1] == "s" else AFTER[self.state]
            yield self.row(K, turn, role, role, text, fault)

    def close(self) -> Iterator[tuple]:
        for _ in range(CLOSING[self.state]):
            yield self.row(I, (False, 0), "", self.lead(), "", SOUND)
        if not self.place:
            yield self.known, self.conv, 0, "", False, 0, "", "", "", SOUND


EDIT_COLUMNS = ("known", "conv", "place", "edit", "given", "turn", "was", "role", "text", "fault")


def forward(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of conversations, each from its first row to its last. Only a state is carried from batch to batch."""
    walk = None
    for f in frames:
        made: list[tuple] = []
        for known, conv, present, given, turn, role, text, fault, edits in zip(*(f[c].tolist() for c in (*ROW, "edits")), strict=True):
            if walk is None or (walk.known, walk.conv) != (known, conv):
                if walk is not None:
                    made += walk.close()
                walk = Walk(known, conv)
            if present:
                made += walk.take(edits, (given, turn), role, text, fault)
        yield pd.DataFrame(made, columns=EDIT_COLUMNS)
    if walk is not None:
        yield pd.DataFrame(list(walk.close()), columns=EDIT_COLUMNS)


ROW = ("known", "conv", "present", "given", "at", "role", "text", "fault")
ROW_SCHEMA = "known boolean, conv string, present boolean, given boolean, at long, role string, text string, fault string, _id long"
EDIT_SCHEMA = "known boolean, conv string, place long, edit string, given boolean, turn long, was string, role string, text string, fault string"


def edited(turns: DataFrame) -> DataFrame:
    """Edits of each conversation in EDIT_SCHEMA, those of one side by side and in order within a partition; see repair()."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    present = F.coalesce(F.col("present"), F.lit(False)) if "present" in turns.columns else F.lit(True)
    own = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), present.alias("present"))
    own = stored(own.withColumn("_id", F.monotonically_increasing_id()), "turns")
    rows = faults(own).select(
        F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "present",
        F.col("turn").isNotNull().alias("given"), F.coalesce("turn", F.lit(0)).cast("long").alias("at"), "role", "text", "fault", "_id",
    )
    order = ("given", "at", "role", "text", "_id")
    down = rows.repartition("known", "conv").sortWithinPartitions("known", "conv", *(F.col(c).desc() for c in order))
    led = down.mapInPandas(backward, f"{ROW_SCHEMA}, edits int")
    # the codes of the edits leave Python with their rows; Spark's sort, which spills, turns them around
    return led.sortWithinPartitions("known", "conv", *order).mapInPandas(forward, EDIT_SCHEMA)


def named(found: DataFrame, turns: DataFrame) -> DataFrame:
    kind = turns.schema["conv_id"].dataType
    return found.select(F.when(F.col("known"), F.col("conv").cast(kind)).alias("conv_id"), *(c for c in found.columns if c not in ("known", "conv")))


@names_apart
def repair(turns: DataFrame) -> DataFrame:
    """The cheapest edits that give conversations the roles ``(s?(ua)+)?``: conv_id, place, edit, turn, was, role, text, fault.

    turns: conv_id, turn, role, text; also present, if some rows only tell of a conversation. Rows are in order of turn, nulls first, ties by role and
    text. A row's first fault counts: blank (no character but white space), duplicate (role and text as in an
    earlier row), truncated (its last such character isn't one of ``.!?``). Edits: K keeps a row, at no cost, R gives it the role user or
    assistant (3), D deletes it (4; blank and duplicate rows must go), I inserts an empty turn of user or assistant (3); kept or
    rerolled rows that are truncated cost 3 more. Among edits of equal cost those whose initials come first in ASCII are taken.

    One row per edit, place counting from 0 in each conversation: was is the role before, role and text are those after (empty for D);
    turn is null for I. A conversation of which no row is present gives one row, with an empty edit.

    Rows are dealt by conversation and sorted. They stream through a task from the last to the first, which finds each row's best
    edit for each of four states, two bits each, with nothing carried but four costs; then, sorted again, from the first to the
    last, which follows those codes with nothing carried but a state. So memory does not grow with a conversation's
    length, though one conversation is one task's work, as the method has it. Duplicates are found by an aggregate and a join,
    without a list of a conversation's texts. Null roles and texts are one space, a null conv_id is a conversation of its own, repeated
    rows are duplicates; other columns are not looked at; an empty table gives an empty one.
    """
    made = named(edited(turns), turns)
    return made.withColumn("turn", F.when(F.col("given"), F.col("turn"))).drop("given")


def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Figures of each conversation from its edits, which come side by side and in order."""
    names = [c for c, _ in DIGEST]
    now = None
    for f in frames:
        made = []
        for known, conv, _, edit, given, turn, was, role, text, fault in zip(*(f[c].tolist() for c in EDIT_COLUMNS), strict=True):
            if now is None or now.key != (known, conv):
                if now is not None:
                    made.append(now.row())
                now = Figures((known, conv))
            now.add(edit, given, turn, was, role, text, fault)
        yield pd.DataFrame(made, columns=names)
    if now is not None:
        yield pd.DataFrame([now.row()], columns=names)


DIGEST = (("known", "boolean"), ("conv", "string"), *((c, "long") for c in ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")), ("audit", "string"), ("repaired_sha256", "string"))
LEGAL = ("su", "ua", "au")


class Figures:
    def __init__(self, key: tuple):
        self.key, self.counts, self.illegal, self.cost = key, dict.fromkeys((BLANK, DUPLICATE, TRUNCATED, SOUND), 0), 0, 0
        self.initial: str | None = None
        self.first = self.last = None
        self.turns = 0
        self.audit: list[str] = []
        self.sha, self.lines = hashlib.sha256(), 0

    def add(self, edit: str, given: bool, turn: int, was: str, role: str, text: str, fault: str) -> None:
        if not edit:
            return
        self.audit.append(edit)
        if edit != "I":
            self.counts[fault] += 1
            if self.initial is not None and self.initial + was[:1] not in LEGAL:
                self.illegal += 1
            self.initial = was[:1]
            if given:
                self.first = turn if self.first is None else self.first
                self.turns += turn != self.last
                self.last = turn
        self.cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit] + (UNFINISHED if fault == TRUNCATED and edit != "D" else 0)
        if edit != "D":
            self.sha.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return *self.key, gaps, *(self.counts[c] for c in (BLANK, DUPLICATE, TRUNCATED)), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def summaries(turns: DataFrame) -> DataFrame:
    """Per conversation, from the edits of repair(): gaps among its turns, rows by fault, illegal neighbours, cost, audit (the edits' initials), repaired_sha256.

    gaps: numbers missing between the least and the largest turn, nulls apart. illegal: neighbouring rows, before any edit, whose roles'
    initials are none of su, ua, au. repaired_sha256 is of the repaired turns as ``role:text``, joined by line feeds.
    """
    return named(edited(turns).mapInPandas(digest, ", ".join(f"{c} {k}" for c, k in DIGEST)), turns)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(damaged(table(spark, sf_dir, "conversations")))


OP13_SQL = r"""
WITH RECURSIVE named AS (
  SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
bytes AS (
  SELECT *, list_reduce([4294967295]::BIGINT[] || flatten(list_transform(string_split(key, ''), lambda c: [1000 + ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x - 1000) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS left_over FROM named),
kinds AS (SELECT *, xor(left_over, 4294967295) % 20 AS kind FROM bytes),
present AS (
  SELECT r, conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, r, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    regexp_extract(text, '([^ 	-
])[ 	-
]*\z', 1) AS solid FROM present),
told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
rows_of AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN solid NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM told),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_of GROUP BY conv_id),
best AS (
  SELECT conv_id, n + 1 AS i, {'c': 0, 'a': '', 'r': []::VARCHAR[]} AS s0, {'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']} AS s1,
    {'c': 3, 'a': 'I', 'r': ['assistant:']} AS s2, {'c': 0, 'a': '', 'r': []::VARCHAR[]} AS s3
  FROM (SELECT DISTINCT conv_id, n FROM rows_of)
  UNION ALL
  SELECT conv_id, i,
    list_min([o0, {'c': 3 + o2.c, 'a': 'I' || o2.a, 'r': ['user:'] || o2.r}, {'c': 6 + o3.c, 'a': 'II' || o3.a, 'r': ['user:', 'assistant:'] || o3.r}]),
    list_min([o1, {'c': 3 + o2.c, 'a': 'I' || o2.a, 'r': ['user:'] || o2.r}, {'c': 6 + o3.c, 'a': 'II' || o3.a, 'r': ['user:', 'assistant:'] || o3.r}]),
    list_min([o2, {'c': 3 + o3.c, 'a': 'I' || o3.a, 'r': ['assistant:'] || o3.r}]),
    list_min([o3, {'c': 3 + o2.c, 'a': 'I' || o2.a, 'r': ['user:'] || o2.r}])
  FROM (
    SELECT conv_id, i,
      list_min([{'c': 4 + s0.c, 'a': 'D' || s0.a, 'r': s0.r}, {'c': keep + more + if(initial = 'u', 0, 999) + s2.c, 'a': 'K' || s2.a, 'r': [line] || s2.r},
        {'c': keep + more + if(initial = 's', 0, 999) + s1.c, 'a': 'K' || s1.a, 'r': [line] || s1.r}, {'c': keep + more + 3 + s2.c, 'a': 'R' || s2.a, 'r': ['user:' || text] || s2.r}]) AS o0,
      list_min([{'c': 4 + s1.c, 'a': 'D' || s1.a, 'r': s1.r}, {'c': keep + more + if(initial = 'u', 0, 999) + s2.c, 'a': 'K' || s2.a, 'r': [line] || s2.r},
        {'c': keep + more + 3 + s2.c, 'a': 'R' || s2.a, 'r': ['user:' || text] || s2.r}]) AS o1,
      list_min([{'c': 4 + s2.c, 'a': 'D' || s2.a, 'r': s2.r}, {'c': keep + more + if(initial = 'a', 0, 999) + s3.c, 'a': 'K' || s3.a, 'r': [line] || s3.r},
        {'c': keep + more + 3 + s3.c, 'a': 'R' || s3.a, 'r': ['assistant:' || text] || s3.r}]) AS o2,
      list_min([{'c': 4 + s3.c, 'a': 'D' || s3.a, 'r': s3.r}, {'c': keep + more + if(initial = 'u', 0, 999) + s2.c, 'a': 'K' || s2.a, 'r': [line] || s2.r},
        {'c': keep + more + 3 + s2.c, 'a': 'R' || s2.a, 'r': ['user:' || text] || s2.r}]) AS o3
    FROM (
      SELECT b.conv_id, x.i, x.initial, x.text, x.role || ':' || x.text AS line, if(x.fault IN ('blank', 'duplicate'), 999, 0) AS keep, if(x.fault = 'truncated', 3, 0) AS more,
        b.s0, b.s1, b.s2, b.s3
      FROM best b JOIN rows_of x ON b.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = b.i - 1)))
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN figures f ON k.conv_id IS NOT DISTINCT FROM f.conv_id
LEFT JOIN (SELECT * FROM best WHERE i = 1) b ON k.conv_id IS NOT DISTINCT FROM b.conv_id
"""

"""Repair of the structure of conversations: cheapest edits that make the roles alternate, as a stream over sorted turns.

Rows are dealt by conversation, faults that need the whole conversation (repeated turns) are marked by a window on the same
deal, and the rows are sorted by turn. A task then reads them as a stream of Arrow batches: for each of four states (nothing
yet, after system, after user, after assistant) it carries the cost of the cheapest edits so far, their order among the
states' and a running hash of the repaired text, across batches and whatever the length of the conversation. What leads back to
the edits is one number a row, which goes to a file of the task's own when there are many, and is read from the end
when the conversation is over.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SYSTEM, USER, ASSISTANT = range(4)
#: Number of the role expected next, and the state after it; no role follows without one.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Costs of inserts at the end that make the sequence whole.
ENDINGS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: BEATEN[s][t]: at most so much more it costs to go on from s than from t. If t costs more than s and that, no cheapest edits lead over t.
BEATEN = {
    START: {SYSTEM: 0, ASSISTANT: 0, USER: INSERT},
    SYSTEM: {},
    USER: {START: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {START: DELETE, SYSTEM: 0, USER: INSERT},
}
LEGAL = ("su", "ua", "au")
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Steps of a conversation that are kept in memory.
IN_MEMORY = 1 << 18
_COLUMNS = "conv_id long, no_id boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; null texts and roles are one space) with planted faults by crc32 of ``conv_id:turn`` modulo 20.

    Adds ``lost`` (dropped rows stay, so that their conversation does) and ``copy`` (1 for a repeated row). Null ids and
    turns are one space in the hash.
    """
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat(name[0], F.lit(":"), name[1])), F.lit(20))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), (kind == 0).alias("lost"), F.explode(copies).alias("copy"))


def _fault(nth: Column) -> Column:
    """The row's first fault: blank, seen before, or cut short."""
    return F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(nth > 1, DUPLICATE).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(0)


class Steps:
    """Numbers of a conversation's steps, read from the end; many go to a file of their own."""

    def __init__(self):
        self._new, self._file, self._stored = array("H"), None, 0

    def add(self, step: int) -> None:
        self._new.append(step)
        if len(self._new) >= IN_MEMORY:
            self._file = self._file or tempfile.TemporaryFile()
            self._new.tofile(self._file)
            self._stored, self._new = self._stored + len(self._new), array("H")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self._new)
        for lo in range(self._stored - IN_MEMORY, -1, -IN_MEMORY):
            self._file.seek(2 * lo)
            part = array("H")
            part.fromfile(self._file, IN_MEMORY)
            yield from reversed(part)
        if self._file:
            self._file.close()


class Automaton:
    """Steps of the dynamic program: from the states' costs and order, and a row's kind, to the next ones.

    Costs are relative to the least and states that another beats are left out, so there are few different situations; each
    is worked out once. A situation is a tuple of (state, cost, rank), in the order of the states' edits so far: all have used
    as many rows, so none is the beginning of another, and comparing the order and then the next edits compares the whole.
    """

    def __init__(self):
        self.first = ((START, 0, 0),)
        self.steps: list[tuple] = []
        self._known: dict[tuple, int] = {}

    def step(self, situation: tuple, kind: tuple[str, bool, bool]) -> int:
        """Number of the step from ``situation`` over a row of ``kind``: role initial, must be deleted, is cut short."""
        key = situation, kind
        if key not in self._known:
            self._known[key] = len(self.steps)
            self.steps.append(self._made(situation, kind))
        return self._known[key]

    @staticmethod
    def _made(situation: tuple, kind: tuple[str, bool, bool]) -> tuple:
        """(next situation, cost added to all, {state: (state before, edits, lines as (new role or none, with the row's text))})."""
        initial, gone, cut = kind
        found: dict[int, tuple] = {}

        def offer(cost: int, rank: int, edits: str, state: int, before: int, lines: tuple) -> None:
            one = (cost, rank, edits, before, lines)
            if state not in found or one[:3] < found[state][:3]:
                found[state] = one

        for before, cost, rank in situation:
            for edits, spent, state, lines in (("", 0, before, ()), ("I", INSERT, NEXT[before], ((ROLES[NEXT[before]], False),))):
                spent, role = cost + spent, NEXT[state]
                offer(spent + DELETE, rank, edits + "D", state, before, lines)
                if gone:
                    continue
                spent += TRUNCATED * cut
                offer(spent + REROLE, rank, edits + "R", role, before, (*lines, (ROLES[role], True)))
                if initial == ROLES[role][0]:
                    offer(spent, rank, edits + "K", role, before, (*lines, (None, True)))
                elif initial == "s" and state == START:
                    offer(spent, rank, edits + "K", SYSTEM, before, (*lines, (None, True)))
        kept = {t: x for t, x in found.items() if not any(found[s][0] + more < x[0] for s in found for u, more in BEATEN[s].items() if u == t)}
        least = min(x[0] for x in kept.values())
        order = sorted(kept, key=lambda t: kept[t][1:3])
        places = {t: n for n, t in enumerate(order)}
        back = {t: (x[3], x[2], x[4]) for t, x in kept.items()}
        return tuple(sorted((t, kept[t][0] - least, places[t]) for t in kept)), least, back


class Repair:
    """The stream of one conversation's rows."""

    def __init__(self, conv_id, automaton: Automaton):
        self.conv_id, self.automaton = conv_id, automaton
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = self.cost = 0
        self.low = self.high = self.last = None
        self.before: str | None = None
        self.situation = automaton.first
        self.hashes = {START: (hashlib.sha256(), True)}
        self.steps = Steps()

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
            self.turns += 1
        if self.before is not None:
            self.illegal += self.before + role[:1] not in LEGAL
        self.before = role[:1]
        kind = role[:1] if role[:1] in ("s", "u", "a") else "", fault in (BLANK, DUPLICATE), fault == CUT
        number = self.automaton.step(self.situation, kind)
        self.situation, cost, back = self.automaton.steps[number]
        self.cost += cost
        self.steps.add(number)
        self.hashes = {state: self._written(before, lines, role, text) for state, (before, _, lines) in back.items()}

    def _written(self, before: int, lines: tuple, role: str, text: str) -> tuple:
        whole, empty = self.hashes[before]
        if lines:
            whole = whole.copy()
            for name, own in lines:
                line = f"{name or role}:{text}" if own else f"{name}:"
                whole.update((line if empty else "\n" + line).encode())
                empty = False
        return whole, empty

    def result(self) -> tuple:
        cost, _, state = min((cost + INSERT * len(ENDINGS[s]), rank, s) for s, cost, rank in self.situation)
        whole, empty = self.hashes[state]
        edits, at = [ENDINGS[state]], state
        for _ in ENDINGS[state]:
            at = NEXT[at]
            whole.update((f"{ROLES[at]}:" if empty else f"\n{ROLES[at]}:").encode())
            empty = False
        for number in self.steps.backwards():
            state, edit, _ = self.automaton.steps[number][2][state]
            edits.append(edit)
        edits.reverse()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return *self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost + cost, "".join(edits), whole.hexdigest()


def _repairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows to one row a conversation; the open conversation goes on in the next batch."""
    automaton, open_ = Automaton(), None
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    for batch in batches:
        done = []
        for conv_id, no_id, turn, no_turn, role, text, lost, fault in zip(*(batch[c].tolist() for c in batch.columns)):
            if open_ is None or open_.conv_id != (conv_id, no_id):
                if open_:
                    done.append(open_.result())
                open_ = Repair((conv_id, no_id), automaton)
            if not lost:
                open_.add(None if no_turn else turn, role, text, fault)
        yield pd.DataFrame(done, columns=names)
    if open_:
        yield pd.DataFrame([open_.result()], columns=names)


def repaired(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of each conversation.

    ``rows`` has ``conv_id, turn, role, text`` and may have ``lost`` (rows that are not there, which keep their conversation) and
    ``copy`` (order of rows of one turn that are alike); others are not read. Rows go by turn, null first, rows of one turn by role
    and text. Null roles and texts are one space, and null ids one conversation. A row is blank, else a duplicate if its role
    and text came before, else truncated if it does not end in ``.!?``. Returns one row per conversation: ``conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256``; of an empty table none.

    A conversation is read by one task, as its hash has to be, in memory that does not grow with it but for the string of its edits.
    """
    known = set(rows.columns)
    text, role = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("text", "role"))
    lost = (F.col("lost") if "lost" in known else F.lit(False)).alias("lost")
    copy = (F.col("copy") if "copy" in known else F.lit(0)).alias("copy")
    rows = rows.select("conv_id", "turn", role, text, lost, copy).repartition("conv_id")
    same = Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.asc_nulls_first("turn"), "copy")
    rows = rows.withColumn("nth", F.row_number().over(same)).withColumn("fault", _fault(F.col("nth")))
    rows = rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "nth")
    filled = [x for c, flag in (("conv_id", "no_id"), ("turn", "no_turn")) for x in (F.coalesce(c, F.lit(0)).cast("long").alias(c), F.isnull(c).alias(flag))]
    found = rows.select(*filled, "role", "text", "lost", "fault").mapInPandas(_repairs, _COLUMNS)
    return found.withColumn("conv_id", F.when(~F.col("no_id"), F.col("conv_id"))).drop("no_id")

"""Conversation structure repair by depth-first branch and bound.

``damage`` spoils rows in a known way (a test bed), ``faults`` finds blank,
duplicate and truncated rows, and ``repair`` finds each conversation's cheapest
edits to roles of the form ``(s?(ua)+)?``: keep 0, rerole 1, delete 2 (a must
for blank and duplicate rows), insert an empty turn 5, and 5 more for a
truncated row that is not deleted. Of equally cheap edits the ASCII-least
string of initials (D, I, K, R) is taken.

``Search`` works on a block of at most ``BLOCK`` rows. A node is (rows read,
state of the role pattern); a prefix is a node with the cost and the audit of
the edits that led to it. An explicit stack is worked depth first, the cheapest
and ASCII-least edit on top; a prefix is cut if its node's dominance table
holds a (cost, audit) that is as good, or if its cost plus the lower bound of
the rows that remain (the sum of their cheapest edits, whatever their roles)
is above every incumbent it could still replace. When the stack is empty, the
incumbents are proved optimal. Two prefixes of one node and cost are never one
the beginning of the other (further inserts cost), so the lesser stays the
lesser whatever follows.

A longer conversation is a chain of blocks. Between two blocks the prefixes
that survive are at most one for each state; each carries the SHA-256 of its
repaired rows so far, so rows are read once, in order, and no text is kept.
What the surviving audits share at their start is moved out of the search.

Scale: one shuffle by conversation. Duplicates are numbered by a window that
reuses it, then each partition is sorted by turn and streamed through
``mapInArrow``: a conversation of any length takes the memory of one batch and
a byte a row for its audit, which the result holds as one string. The digest
of a whole conversation reads its text in order, so one conversation is one
task's stream, spilled by Spark's sort where it must be; other conversations
are spread by hash.

Defined cases: a null conversation, turn, role or text counts as one space in
texts and keys (null conversations are one conversation, returned as null);
rows of one turn are ordered by role and text; empty texts are blank; an empty
role has no initial and no pattern takes it; repeated rows are duplicates;
empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.frames import small_batches

BLOCK = 64
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5  # costs
SPACE = "[^\\x20\\x09-\\x0D]"
OTHER, SYSTEM, USER, ASSISTANT = range(4)  # a row's initial, and the state after it (0: nothing yet)
FINE, BLANK, DUPLICATE, TRUNCATED, GONE = range(5)
NAMES = {USER: "user", ASSISTANT: "assistant"}


def spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with known damage, by crc32 of ``conv_id:turn`` mod 20.

    0 drops the row (its conversation stays, as a row with ``_gone``), 1 empties its text, 2 removes its marks
    ``[.!?]``, 3 repeats it, 4 sets its role to user. Nulls become one space, but for conv_id and turn themselves;
    a turn that is no integer is null.
    """
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    told = rows.select("conv_id", F.col("turn").try_cast("long").alias("turn"), kind.alias("_kind"), spaced("role").alias("role"), spaced("text").alias("text"))
    text = (F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    role = F.when(F.col("_kind") == 0, "").when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    spoilt = told.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("_gone"),
                         F.when(F.col("_kind") == 3, 2).otherwise(1).alias("_times"))
    return spoilt.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, _gone) with ``_initial`` and their first ``_fault``, partitioned by conversation and in order."""
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    end = F.right(F.expr("rtrim(' \\t\\n\\u000b\\f\\r', text)"), F.lit(1))
    seen = F.row_number().over(Window.partitionBy("conv_id", "_gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    told = rows.repartition("conv_id").withColumn("_seen", seen)
    fault = (F.when(F.col("_gone"), GONE).when(~F.col("text").rlike(SPACE), BLANK).when(F.col("_seen") > 1, DUPLICATE)
             .when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(FINE))
    return (told.select("conv_id", "turn", "role", "text", "_seen", kind.alias("_initial"), fault.alias("_fault"))
            .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_seen").drop("_seen"))


def step(state: int, initial: int) -> int:
    """The state after a row that is kept; 0: it does not fit."""
    fits = initial == SYSTEM and state == 0 or initial == USER and state != USER or initial == ASSISTANT and state == USER
    return initial if fits else 0


def turn_due(state: int) -> int:
    """The state after a user or assistant row that fits."""
    return ASSISTANT if state == USER else USER


class Search:
    """The best prefixes through one block of rows, from one prefix for each state before it."""

    def __init__(self, rows: list[tuple[int, int]], last: bool):
        """``rows``: (initial, fault); ``last``: the conversation ends here, so the pattern must be complete."""
        self.rows, self.last, self.n = rows, last, len(rows)
        self.bound = [0] * (self.n + 1)  # of the rows from each on
        for i in range(self.n - 1, -1, -1):
            initial, fault = rows[i]
            cheapest = DELETE if fault in (BLANK, DUPLICATE, TRUNCATED) else KEEP if initial else REROLE
            self.bound[i] = self.bound[i + 1] + cheapest

    def exits(self, state: int) -> bool:
        return not self.last or state in (0, ASSISTANT)

    def edits(self, i: int, state: int) -> list[tuple[int, str, int, int]]:
        """(cost, initial of the edit, next row, next state) of a prefix's possible edits."""
        out = [(INSERT, "I", i, turn_due(state))]
        if i < self.n:
            initial, fault = self.rows[i]
            out.append((DELETE, "D", i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                more = CUT_OFF if fault == TRUNCATED else 0
                kept = step(state, initial)
                if kept:
                    out.append((KEEP + more, "K", i + 1, kept))
                if kept != turn_due(state):
                    out.append((REROLE + more, "R", i + 1, turn_due(state)))
        return out

    def run(self, entries: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str, int]]:
        """Per state at the end: (cost, audit, state at entry) of its best prefix."""
        best: list[dict[int, tuple[int, str]]] = [{} for _ in range(self.n + 1)]
        incumbents: dict[int, tuple[int, str, int]] = {}
        wanted = [s for s in range(4) if self.exits(s) and (s or 0 in entries) and (s != SYSTEM or entries.keys() & {0, SYSTEM})]
        stack = [(cost, audit, 0, state, state) for state, (cost, audit) in entries.items()]
        stack.sort(reverse=True)
        limit = None  # (cost, audit) of the worst incumbent, once each wanted state has one
        while stack:
            cost, audit, i, state, entry = stack.pop()
            if limit is not None and cost + self.bound[i] > limit:
                continue
            held = best[i].get(state)
            if held is not None and held <= (cost, audit):
                continue
            best[i][state] = (cost, audit)
            if i == self.n and self.exits(state):
                incumbents[state] = (cost, audit, entry)
                if self.last:
                    limit = min(c for c, _, _ in incumbents.values())
                elif len(incumbents) == len(wanted):
                    limit = max(c for c, _, _ in incumbents.values())
            stack += sorted(((cost + c, audit + edit, j, s, entry) for c, edit, j, s in self.edits(i, state)), reverse=True)
        if self.last:  # the cheapest, then ASCII-least, whatever its state
            state, found = min(incumbents.items(), key=lambda kv: kv[1][:2])
            return {state: found}
        return incumbents


class Conversation:
    """A conversation's rows in order, repaired as they come."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, str, str]] = []  # of the open block
        self.live: dict[int, tuple[int, str]] = {0: (0, "")}
        self.digests = {0: (hashlib.sha256(), False)}  # of the live prefixes, and whether they have a row
        self.settled: list[str] = []
        self.counts = [0] * 5
        self.illegal = 0
        self.before: int | None = None
        self.turns = 0
        self.first_turn = self.last_turn = None

    def add(self, turn, role: str, text: str, initial: int, fault: int) -> None:
        self.counts[fault] += 1
        if fault == GONE:
            return
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        if self.before is not None and not (initial == USER and self.before in (SYSTEM, ASSISTANT) or initial == ASSISTANT and self.before == USER):
            self.illegal += 1
        self.before = initial
        if len(self.rows) == BLOCK:
            self.close(last=False)
        self.rows.append((initial, fault, role, text))

    def close(self, last: bool) -> None:
        """Search the open block; what lives on carries its digest."""
        found = Search([r[:2] for r in self.rows], last).run(self.live)
        digests = {}
        for state, (_, audit, entry) in found.items():
            digest, some = self.digests[entry]
            digests[state] = self.write(digest.copy(), some, entry, audit[len(self.live[entry][1]):])
        shared = len(os.path.commonprefix([audit for _, audit, _ in found.values()]))
        self.settled.append(next(iter(found.values()))[1][:shared])
        self.live = {s: (cost, audit[shared:]) for s, (cost, audit, _) in found.items()}
        self.digests = digests
        self.rows = []

    def write(self, digest, some: bool, state: int, edits: str):
        rows = iter(self.rows)
        for edit in edits:
            initial, _, role, text = (0, 0, "", "") if edit == "I" else next(rows)
            if edit == "D":
                continue
            state = initial if edit == "K" else turn_due(state)
            digest.update((("\n" if some else "") + (role if edit == "K" else NAMES[state]) + ":" + text).encode("utf-8"))
            some = True
        return digest, some

    def result(self) -> tuple:
        self.close(last=True)
        (state, (cost, audit)), = self.live.items()
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, cost,
                "".join(self.settled) + audit, self.digests[state][0].hexdigest())


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(ordered: DataFrame) -> DataFrame:
    """Per conversation of ``faults``' rows: its counts of faults, cheapest edits and the digest of the repaired rows."""
    id_type = dict(ordered.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6 + [pa.string()] * 2
        current, open_, id_arrow = None, None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_arrow), *(pa.array(c, t) for c, t in zip(columns[1:], types))],
                                              names=["conv_id", *RESULT])
        for batch in batches:
            done: list[tuple] = []
            id_arrow = batch.column("conv_id").type
            for conv, turn, role, text, initial, fault in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if open_ is None or conv != current:
                    if open_ is not None:
                        done.append((current, *open_.result()))
                    current, open_ = conv, Conversation()
                open_.add(turn, role, text, initial, fault)
            if done:
                yield out(done)
        if open_ is not None:
            yield out([(current, *open_.result())])
    small_batches(ordered.sparkSession)
    return ordered.mapInArrow(run, f"conv_id {id_type}, " + ", ".join(f"{c} {'long' if k < 6 else 'string'}" for k, c in enumerate(RESULT)))


def report(conversations: DataFrame) -> DataFrame:
    """Every conversation, damaged, with its faults and its repair."""
    return repair(faults(damage(conversations)))

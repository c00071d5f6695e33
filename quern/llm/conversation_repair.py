"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by secondary-sorted streaming."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of the edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What may stand after what: nothing yet, a system row only, a user row last, an assistant row last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Edits in the order of their initials, as in the audit.
DELETED, KEPT, REROLED = range(3)
LETTERS = "DKR"
#: Rows whose backpointers (four bytes each) stay in memory; those before go to a file of the task's.
POINTER_ROWS = 1 << 20
ROLES = {"u": "user", "a": "assistant"}
BLANK = re.compile(r"[^ \t-\r]")
ENDS = re.compile(r"[.!?][ \t-\r]*\Z")
OUT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TOP = (1 << 63) - 1


def inserted(start: int) -> list[tuple[int, str]]:
    """What a few inserted rows lead to: (state after, their initials), the shortest way to each state; none is one too."""
    found, todo = {start: ""}, [start]
    for state in todo:
        for role in "ua":
            after = NEXT.get((state, role))
            if after is not None and after not in found:
                found[after] = found[state] + role
                todo.append(after)
    return list(found.items())


INSERTED = [inserted(state) for state in range(4)]


def steps(must_delete: bool, initial: str) -> list[tuple[int, int, int, str, int, str | None]]:
    """All ways over one row: (state before, state after, edits' cost, inserted initials, edit, new role's initial)."""
    out = []
    for before in range(4):
        for middle, more in INSERTED[before]:
            cost = INSERT * len(more)
            out.append((before, middle, cost + DELETE, more, DELETED, None))
            if not must_delete:
                if (middle, initial) in NEXT:
                    out.append((before, NEXT[middle, initial], cost, more, KEPT, None))
                out += [(before, NEXT[middle, r], cost + REROLE, more, REROLED, r) for r in "ua" if (middle, r) in NEXT]
    return sorted(out, key=lambda s: "I" * len(s[3]) + LETTERS[s[4]])


#: The same for each kind of row, in the order of the edits' initials, so that the first of equals is the ASCII-least.
STEPS = {(must, initial): steps(must, initial) for must in (False, True) for initial in ("s", "u", "a", "")}


def add(state: "hashlib._Hash | None", line: str) -> "hashlib._Hash":
    """The digest of the lines so far with one more."""
    out = state.copy() if state else hashlib.sha256()
    out.update(("\n" if state else "").encode() + line.encode("utf-8", "surrogatepass"))
    return out


@dataclass
class Repair:
    """One conversation on its way: for each state the cheapest cost, its rank among equal costs, and the digest of its rows.

    Two cheapest ways that end in different states never begin with each other (each ends in an edit of the same row), so
    their order stays what it is whatever follows: ranks are enough to find the ASCII-least audit. The digests of the four
    ways are carried along, so that no text is read twice. Only backpointers are kept: a byte for each state and row.
    """

    conv: str | None
    cost: dict[int, int] = field(default_factory=lambda: {NOTHING: 0})
    rank: dict[int, int] = field(default_factory=lambda: {NOTHING: 0})
    digest: dict = field(default_factory=lambda: {NOTHING: None})
    pointers: bytearray = field(default_factory=bytearray)
    spilled: object = None
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
    last: tuple | None = None
    turn: int | None = None
    first_turn: int | None = None
    turns: int = 0

    def row(self, turn: int | None, role: str, text: str, first: tuple) -> None:
        """The next row; ``first`` is the (turn, ...) of the first row with this role and text."""
        if turn is not None and (self.turns == 0 or turn != self.turn):
            self.first_turn = turn if self.turns == 0 else self.first_turn
            self.turn, self.turns = turn, self.turns + 1
        fault = None
        if not BLANK.search(text):
            fault = "blank"
        elif first != (turn is None, turn) or (self.last and self.last[1:] == (turn, role, text)):
            fault = "duplicate"
        elif not ENDS.search(text):
            fault = "truncated"
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.last and self.last[0] + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.last = (initial, turn, role, text)
        self.edit(fault in ("blank", "duplicate"), fault == "truncated", initial if initial in ("s", "u", "a") else "", role, text)

    def edit(self, must_delete: bool, truncated: bool, initial: str, role: str, text: str) -> None:
        best = {}
        for n, step in enumerate(STEPS[must_delete, initial]):
            before, after, more = step[:3]
            if before in self.cost:
                key = (self.cost[before] + more + TRUNCATED * (truncated and step[4] != DELETED), self.rank[before], n)
                if after not in best or key < best[after][0]:
                    best[after] = key, step
        order = sorted(best, key=lambda after: best[after][0][1:])
        digest, bytes_ = {}, bytearray(4)
        for after, (_, (before, _, _, inserts, edit, new)) in best.items():
            bytes_[after] = before | len(inserts) << 2 | edit << 4
            state = self.digest[before]
            for r in inserts:
                state = add(state, f"{ROLES[r]}:")
            digest[after] = state if edit == DELETED else add(state, f"{ROLES[new] if new else role}:{text}")
        self.cost = {after: key[0] for after, (key, _) in best.items()}
        self.rank = {after: n for n, after in enumerate(order)}
        self.digest = digest
        self.pointers += bytes_
        if len(self.pointers) >= 4 * POINTER_ROWS:
            self.spilled = self.spilled or tempfile.TemporaryFile()
            self.spilled.write(self.pointers)
            self.pointers = bytearray()

    def pages(self) -> Iterator[bytes]:
        """The backpointers from the last page to the first."""
        yield bytes(self.pointers)
        if self.spilled:
            at = self.spilled.seek(0, os.SEEK_END)
            while at:
                at -= 4 * POINTER_ROWS
                self.spilled.seek(at)
                yield self.spilled.read(4 * POINTER_ROWS)
            self.spilled.close()

    def result(self) -> tuple:
        ends = [(self.cost[state] + INSERT * len(more), self.rank[state], len(more), state, more) for state in self.cost for after, more in INSERTED[state] if after in (NOTHING, ASSISTANT)]
        cost, _, _, state, more = min(ends)
        digest = self.digest[state]
        for r in more:
            digest = add(digest, f"{ROLES[r]}:")
        audit = bytearray(b"I" * len(more))
        for page in self.pages():
            for at in range(len(page) - 4, -1, -4):
                pointer = page[at + state]
                audit += LETTERS[pointer >> 4].encode() + b"I" * (pointer >> 2 & 3)
                state = pointer & 3
        audit.reverse()
        gaps = min(self.turn - self.first_turn + 1 - self.turns, TOP) if self.turns else 0
        return (self.conv, gaps, *self.counts.values(), cost, audit.decode(), (digest or hashlib.sha256()).hexdigest())


def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by conversation and turn in, a row for each conversation out; a conversation may span any number of batches."""
    own, done = None, []
    names = [c.split()[0] for c in OUT.split(", ")]
    for batch in batches:
        columns = (batch[c].tolist() for c in ("conv", "turn", "no_turn", "role", "text", "first_turn", "first_no_turn", "gone"))
        for conv, turn, no_turn, role, text, first_turn, first_no_turn, gone in zip(*columns, strict=True):
            if own is None or conv != own.conv:
                done += [own.result()] if own else []
                own = Repair(conv)
            if not gone:
                own.row(None if no_turn else turn, role, text, (first_no_turn, None if first_no_turn else first_turn))
        if done:
            yield pd.DataFrame(done, columns=names)
            done = []
    if own:
        yield pd.DataFrame([own.result()], columns=names)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """One row per conversation: gaps, faults by kind, illegal neighbours, cost and audit of the cheapest edits, the repaired digest.

    Rows go to their conversation's task and are sorted by turn there (null turns first, equal turns by role and text, so
    that equal rows are neighbours); the task keeps the state of one conversation, whatever its length. Which row is the first with a role
    and text is known before, from an aggregate and a join. Rows where ``gone`` holds only name their conversation. Null roles and
    texts are one space. A null conversation is one of its own; one without rows left has zeros, an empty audit and the digest of nothing.
    A role without one of the initials s, u, a (an empty one too) can't be kept. turn is a long; gaps end at the largest long.
    Other columns don't matter. An empty table gives an empty one.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = dict(rows.dtypes)[conv]
    gone = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
    flat = rows.select(F.col(conv).cast("string").alias("conv"), F.col(turn).cast("long").alias("turn"), gone.alias("gone"), F.when(gone, "").otherwise(blank(role)).alias("role"), F.when(gone, "").otherwise(blank(text)).alias("text"))
    flat = flat.withColumn("key", F.unhex(F.sha2(F.concat_ws("\0", F.octet_length("role").cast("string"), "role", "text").cast("binary"), 256)))
    at = F.struct(F.col("turn").isNotNull().alias("dated"), F.col("turn").alias("t"))
    first = flat.where("not gone").groupBy(F.col("conv").alias("c"), F.col("key").alias("k")).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    told = flat.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left").withColumn("first", F.coalesce("first", at))
    told = told.select("conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "role", "text", F.coalesce("first.t", F.lit(0)).alias("first_turn"), (~F.col("first.dated")).alias("first_no_turn"), "gone")
    placed = told.repartition(F.col("conv")).sortWithinPartitions("conv", F.desc("no_turn"), "turn", "role", "text")
    out = placed.mapInPandas(stream, OUT)
    return out.select(F.col("conv").cast(kind).alias(conv), *[c.split()[0] for c in OUT.split(", ")[1:]])


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults chosen by crc32 of ``conv:turn`` modulo 20: 0 marks the row ``gone``, 1 empties the text, 2 removes its
    ``[.!?]``, 3 repeats the row, 4 sets the role user. Nulls are one space (the ids stay what they are)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", blank(conv), blank(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv), F.col(turn), blank(role).alias(role), blank(text).alias(text), fault.alias("_fault"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1))))
    body = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text))
    return rows.select(conv, turn, F.when(F.col("_fault") == 4, "user").otherwise(F.col(role)).alias(role), body.alias(text), (F.col("_fault") == 0).alias("gone"))

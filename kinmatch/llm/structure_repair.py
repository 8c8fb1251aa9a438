"""Repair of the structure of conversations: the cheapest edits that make turns alternate.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles: nothing, or pairs of
user and assistant, after a system turn or not. Turns are aligned to the alternating string of
every feasible length by the Wagner-Fischer recurrence, counted from the end: all targets share
their endings, so one table over (turn, symbols left) holds the costs for every length. The cost
of a plain walk over the turns bounds what the best alignment can cost, and only the band of
cells that can stay below it is filled (Ukkonen). The audits of all alignments of least cost are
traced together, letter by letter, and compared; the least in ASCII order stays.

The cost depends on the role's initial and the fault of each turn alone, a byte a turn, and few
such strings occur, so a task remembers their audits. A conversation comes as its bytes first
and as its texts after them, both in order, so texts stream by and are never held together. One
of any length is aligned in stretches of ``STRETCH`` turns, from the last to the first: what
follows a stretch enters as the cost of going on from each symbol, which gives the same audit.
A conversation is put in order in one task, as its digest demands; the sort spills, and memory
is a few bytes a turn.

Defined cases: null roles, texts and ids are taken as the caller sets them (``damaged`` makes
them one space); turns are ordered by number, nulls first, then role, then text; a null
conversation is one of its own; an empty role fits nowhere and is given a new one or deleted;
gaps beyond a long stay at its bound; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Turns that are aligned in one table.
STRETCH = 256
#: Beyond any cost of a stretch and what follows it.
NEVER = 1 << 60
#: Symbols to come: the other half of a pair follows each half.
USER, ASSISTANT = 0, 1
#: How a turn enters: its role's initial, and the fault that counts.
INITIALS = {"u": 0, "a": 1, "s": 2}
OTHER = 3
BLANK, DUPLICATE, TRUNCATED = 4, 8, 16
DROPPED = 255
WHITE = r"\x20\x09-\x0D"
EMPTY = hashlib.sha256().hexdigest()


class Stretch:
    """Costs of a stretch of turns from each turn on, and from each count of symbols left in it.

    ``after`` has the cost of what follows: with a system turn still to come, with a pair still
    due, and with a user or an assistant turn expected.
    """

    def __init__(self, codes: bytes, after: tuple[int, int, int, int], last: bool):
        self.codes, self.last = codes, last
        self.n = n = len(codes)
        first = [c & 3 for c in codes]
        self.forced = [bool(c & (BLANK | DUPLICATE)) for c in codes]
        self.cut = [CUT if c & TRUNCATED else 0 for c in codes]
        free = np.cumsum([0] + [not f for f in self.forced[::-1]])[::-1]
        # A plain walk: mend every break by an insertion or a new role. No stretch of a cheapest
        # alignment costs more beyond its forced deletions, but for what joins it to others.
        expected, walk = first[0] if n and first[0] < 2 else USER, 0
        for symbol, gone, cut in zip(first, self.forced, self.cut):
            if not gone:
                walk += cut + (REROLE if symbol != expected else KEEP)
                expected = 1 - (symbol if symbol < 2 else expected)
        bound = walk + 4 * INSERT
        self.low = np.maximum(0, free - bound // DELETE)
        self.high = free + bound // INSERT
        width = int(self.high.max()) + 1
        pending, due, *go_on = after
        left = np.arange(width)
        self.left = [np.full((n + 1, width), NEVER) for _ in (USER, ASSISTANT)]
        for end in (USER, ASSISTANT):
            table = self.left[end]
            table[n, 0] = go_on[end]
            if last and end == USER:
                table[n] = INSERT * left
            symbol = (end + left) % 2  # what the cell expects
            for i in range(n - 1, -1, -1):
                below, row = table[i + 1], table[i]
                row[:] = below + DELETE
                if not self.forced[i]:
                    fits = np.where(symbol == first[i], KEEP, REROLE) + self.cut[i]
                    np.minimum(row[1:], below[:-1] + fits[1:], out=row[1:])
                row[:] = np.minimum.accumulate(row - INSERT * left) + INSERT * left
                row[: self.low[i]] = NEVER
                row[self.high[i] + 1 :] = NEVER
        self.none = due + DELETE * np.arange(n, -1, -1)
        self.due = np.minimum(self.none, [self.least(i, USER, 1) for i in range(n + 1)])
        self.pending = np.full(n + 1, pending)
        for i in range(n - 1, -1, -1):
            self.pending[i] = min(NEVER, self.pending[i + 1] + DELETE)
            if first[i] == INITIALS["s"] and not self.forced[i]:
                self.pending[i] = min(self.pending[i], self.cut[i] + self.due[i + 1])
        self.first = first

    def least(self, i: int, symbol: int, shortest: int = 0) -> int:
        """Cost from turn i on, of the best length, where the symbol comes next."""
        return min(
            int(self.left[end][i, shortest:][(np.arange(shortest, self.left[end].shape[1]) + end) % 2 == symbol].min(initial=NEVER))
            for end in (USER, ASSISTANT)
        )

    def before(self) -> tuple[int, int, int, int]:
        return int(self.pending[0]), int(self.due[0]), self.least(0, USER), self.least(0, ASSISTANT)

    def entered(self, i: int, symbol: int, cost: int, shortest: int = 0) -> set:
        """Cells at turn i of every length that costs so much, where the symbol comes next."""
        return {
            (end, int(k))
            for end in (USER, ASSISTANT)
            for k in np.flatnonzero(self.left[end][i] == cost)
            if k >= shortest and (end + k) % 2 == symbol
        }

    def after_system(self, i: int, cost: int) -> set:
        return self.entered(i, USER, cost, 1) | ({"due"} if self.none[i] == cost else set())

    def value(self, i: int, cell) -> int:
        if isinstance(cell, tuple):
            return int(self.left[cell[0]][i, cell[1]])
        return int(self.pending[i] if cell == "pending" else self.none[i])

    def trace(self, cells: set, cost: int) -> tuple[list[tuple[str, int]], set, int]:
        """Edits with the symbol they leave, the cells at the stretch's end, and the cost left."""
        i, edits = 0, []
        while i < self.n or (self.last and cost):
            for letter in "DIKR":
                following, spent, symbol = self.step(i, cells, cost, letter)
                if following:
                    break
            edits.append((letter, symbol))
            cells, cost = following, cost - spent
            i += letter != "I"
        return edits, cells, cost

    def step(self, i: int, cells: set, cost: int, letter: str) -> tuple[set, int, int]:
        """Where an edit leads from cells that share what is left to pay, if that stays least."""
        pairs = [c for c in cells if isinstance(c, tuple)]
        symbol = (pairs[0][0] + pairs[0][1]) % 2 if pairs else USER
        if letter == "I":
            return {(e, k - 1) for e, k in pairs if k and self.value(i, (e, k - 1)) == cost - INSERT}, INSERT, symbol
        if i == self.n:
            return set(), 0, symbol
        if letter == "D":
            return {c for c in cells if self.value(i + 1, c) == cost - DELETE}, DELETE, symbol
        if self.forced[i]:
            return set(), 0, symbol
        spent = self.cut[i] + (KEEP if letter == "K" else REROLE)
        following = set()
        if letter == "R" or self.first[i] == symbol:
            following = {(e, k - 1) for e, k in pairs if k and self.value(i + 1, (e, k - 1)) == cost - spent}
        if letter == "K" and "pending" in cells and self.first[i] == INITIALS["s"] and self.due[i + 1] == cost - spent:
            following = self.after_system(i + 1, cost - spent)
        return following, spent, symbol


def align(codes: bytes, stretch: int = STRETCH) -> tuple[int, list[tuple[str, int]]]:
    """The least cost, and its least audit as (letter, symbol left) edits.

    Only what enters each stretch is kept on the way back; its table is made again on the way
    forth, so memory holds one table.
    """
    parts = [codes[i : i + stretch] for i in range(0, len(codes), stretch)] or [b""]
    entries = [(NEVER, NEVER, 0, NEVER)]
    one = None
    for k in range(len(parts) - 1, -1, -1):
        one = Stretch(parts[k], entries[-1], k == len(parts) - 1)
        entries.append(one.before())
    entries.reverse()
    pending, _, user, _ = entries[0]
    cost = least = min(pending, user)
    edits, cells = [], set()
    for k, part in enumerate(parts):
        one = one if k == 0 else Stretch(part, entries[k + 1], k == len(parts) - 1)
        if k == 0:
            inside = one.entered(0, USER, cost) | ({"pending"} if pending == cost else set())
        else:
            inside = {"pending"} & cells
            for cell in cells - {"pending"}:
                inside |= one.after_system(0, cost) if cell == "due" else one.entered(0, cell[0], cost)
        found, cells, cost = one.trace(inside, cost)
        edits += found
    return least, edits


@lru_cache(maxsize=1 << 14)
def short_align(codes: bytes) -> tuple[int, list[tuple[str, int]]]:
    return align(codes)


def damaged(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """``(conv, turn, role, text, dropped)``: turns lost, emptied, cut, doubled or given to the user.

    Which of them is said by crc32 of ``conv:turn`` modulo 20; nulls are one space. A lost turn
    stays as a row that is marked, so that its conversation is not forgotten.
    """
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), filled(role_col).alias("role"),
        filled(text_col).alias("text"), (F.crc32(F.concat(filled(conv_col), F.lit(":"), filled(turn_col))) % 20).alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def code(again: Column) -> Column:
    """A turn's byte; ``again`` says that its role and text were seen before."""
    initial = F.substring("role", 1, 1)
    first = F.when(initial == "u", INITIALS["u"]).when(initial == "a", INITIALS["a"]).when(initial == "s", INITIALS["s"]).otherwise(OTHER)
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    cut = ~F.col("text").rlike(f"[.!?][{WHITE}]*\\z")
    fault = F.when(blank, BLANK).when(again, DUPLICATE).when(cut, TRUNCATED).otherwise(0)
    return F.when(F.col("dropped"), DROPPED).otherwise(first + fault).cast("int")


class Conversation:
    """What a task holds of the conversation that streams by."""

    def __init__(self, key):
        self.key, self.codes, self.turns = key, bytearray(), [None, None, 0]
        self.edits: list[tuple[str, int]] | None = None
        self.cost, self.at, self.written, self.digest = 0, 0, 0, hashlib.sha256()

    def head(self, turn: int | None, byte: int) -> None:
        """A turn's number and byte."""
        if byte == DROPPED:
            return
        self.codes.append(byte)
        if turn is not None:
            low, high, count = self.turns
            self.turns = [turn if low is None else low, turn, count + (turn != high)]

    def say(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode())
        self.written += 1

    def settle(self) -> None:
        if self.edits is None:
            codes = bytes(self.codes)
            self.cost, self.edits = (short_align if len(codes) <= 64 else align)(codes)

    def insertions(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at][0] == "I":
            self.say(("user", "assistant")[self.edits[self.at][1]], "")
            self.at += 1

    def body(self, role: str, text: str) -> None:
        """A turn's role and text, after all bytes."""
        self.settle()
        self.insertions()
        letter, symbol = self.edits[self.at]
        self.at += 1
        if letter != "D":
            self.say(role if letter == "K" else ("user", "assistant")[symbol], text)

    def row(self) -> tuple:
        self.settle()
        self.insertions()
        codes = np.frombuffer(bytes(self.codes), np.uint8)
        first = codes & 3
        pairs = 4 * first[:-1] + first[1:]
        legal = np.isin(pairs, [4 * INITIALS[a] + INITIALS[b] for a, b in ("su", "ua", "au")])
        low, high, count = self.turns
        gaps = 0 if low is None else min(high - low + 1 - count, np.iinfo(np.int64).max)
        return (
            self.key, gaps, *(int(np.count_nonzero(codes & f)) for f in (BLANK, DUPLICATE, TRUNCATED)),
            int(np.count_nonzero(~legal)), int(self.cost), "".join(e for e, _ in self.edits), self.digest.hexdigest(),
        )


def repaired(turns: DataFrame, id_col="conv_id") -> DataFrame:
    """One row per conversation: gaps, faults, cost, audit and digest of the repaired turns.

    ``turns`` is ``(conv, turn, role, text, dropped)``, as ``damaged`` gives it. ``audit`` has a
    letter an edit: K keep, R new role, D delete, I insert.
    """
    kind = turns.schema["conv"].dataType.simpleString()
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    # All three windows and the stream need the same distribution, which is set once.
    rows = turns.withColumn("at", F.row_number().over(Window.partitionBy("conv").orderBy("dropped", *order)))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    again = F.row_number().over(Window.partitionBy("conv", "dropped", "role", "digest").orderBy("at")) > 1
    rows = rows.withColumn("byte", code(again)).drop("digest")
    head = F.struct(F.lit(0).alias("part"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    body = F.struct(F.lit(1).alias("part"), F.col("role"), F.col("text"))
    lines = rows.select("conv", "turn", "at", "byte", F.explode(F.when(F.col("dropped"), F.array(head)).otherwise(F.array(head, body))).alias("p"))
    lines = lines.select("conv", "at", "turn", "byte", "p.part", "p.role", "p.text").sortWithinPartitions("conv", "part", "at")
    names = [id_col, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, conv_type = None, None
        for batch in batches:
            conv_type, done = batch.schema.field("conv").type, []
            columns = (batch.column(n).to_pylist() for n in ("conv", "turn", "byte", "part", "role", "text"))
            for conv, turn, byte, part, role, text in zip(*columns):
                if one is None or conv != one.key:
                    if one is not None:
                        done.append(one.row())
                    one = Conversation(conv)
                if part == 0:
                    one.head(turn, byte)
                else:
                    one.body(role, text)
            if done:
                yield answer(done, conv_type)
        if one is not None:
            yield answer([one.row()], conv_type)

    def answer(done: list[tuple], conv_type) -> pa.RecordBatch:
        columns = list(zip(*done))
        return pa.record_batch([pa.array(columns[0], conv_type), *map(pa.array, columns[1:])], names)

    return lines.mapInArrow(
        stream,
        f"{id_col} {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string",
    )

"""Repair of the structure of conversations by an auction for the cheapest path.

A sound conversation has the roles ``system? (user assistant)+``, or no rows. Rows may be kept, given another role, deleted, and
rows without text may be inserted. The edits of one conversation are the arcs of a lattice: a node is the number of rows read and the
last role written (nothing, system, user, assistant), and every arc has an integer cost.

The cheapest edits come from the auction algorithm for shortest paths (Bertsekas). Every node has a price, at first a lower bound of
what is left to pay. A path grows from its origin: its last node is extended along the arc with the least cost plus price while the
price is that sum; otherwise the price rises to the sum and the path contracts by a node. When the path reaches a node
of known distance, the prices on it are the distances to the end. Arcs whose cost plus price equals the price of their origin
are tight; the least audit follows, node by node, the tight arc with the smallest letter, after an auction from its head has made sure of
the price there. Long conversations are priced in blocks from the end, so the work grows with the number of rows.

Spark deals the rows by conversation and sorts them. Each row is sent twice, first all of a conversation's rows without text, then all with
text, so a task reads what it needs for the edits and then applies them as the texts pass by: of one conversation it
holds a letter, a digest and a few prices per row, and no text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import WORD, column_names

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5  # what an edit costs; the last adds up for a row that ends early and stays
SPACE = " \t\n\x0b\f\r"
ENDS = (".", "!", "?")
BLOCK = 32
# last role written: nothing, system, user, assistant; the role that may follow by insertion or change
_FOLLOWS = (2, 2, 3, 2)
_ROLES = ("", "system", "user", "assistant")
_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}


class Lattice:
    """Prices over the edits of one conversation.

    ``codes`` has a letter for each row: ``s``, ``u``, ``a`` for the role's initial, ``o`` for another, upper case if the text ends early,
    ``x`` if the row has to go. Node ``4 * rows read + last role``; the node after all of them is the end.
    """

    def __init__(self, codes: str):
        self.codes, self.rows = codes, len(codes)
        self.end = 4 * (self.rows + 1)
        self.price = [0] * (self.end + 1)
        self.known = bytearray(self.end + 1)
        self.known[self.end] = 1
        for cut in range(self.rows, -1, -BLOCK):
            self._settle(cut)
        self.origin = 0
        self._auction(self.origin)

    def _settle(self, cut: int) -> None:
        """Exact prices after ``cut`` rows; the rows before start from the least of them, a lower bound of what is left."""
        least = min(self._auction(4 * cut + role) for role in range(4))
        for node in range(max(0, 4 * (cut - BLOCK)), 4 * cut):
            self.price[node] = least

    def arcs(self, node: int):
        """(letter, cost, head) in the order of the letters; the arc to the end has none."""
        row, role = divmod(node, 4)
        if row == self.rows:
            if role in (0, 3):
                yield "", 0, self.end
            yield "I", INSERT, 4 * row + _FOLLOWS[role]
            return
        code = self.codes[row]
        yield "D", DELETE, node + 4
        yield "I", INSERT, 4 * row + _FOLLOWS[role]
        if code != "x":
            more = CUT_OFF if code.isupper() else 0
            kept = _KEPT.get(code.lower())
            if kept and kept[role] is not None:
                yield "K", KEEP + more, 4 * row + 4 + kept[role]
            yield "R", REROLE + more, 4 * row + 4 + _FOLLOWS[role]

    def _auction(self, origin: int) -> int:
        """Distance from ``origin`` to the end."""
        price, path = self.price, [origin]
        while not self.known[path[-1]]:
            node = path[-1]
            best, head = min((cost + price[to], to) for _, cost, to in self.arcs(node))
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        for node in path:
            self.known[node] = 1
        return price[origin]

    def cheapest(self) -> tuple[int, str]:
        """Cost, and of the cheapest audits the least."""
        node, letters = self.origin, []
        while node != self.end:
            for letter, cost, head in self.arcs(node):
                if self.price[node] == cost + self.price[head] and self.price[node] == cost + self._auction(head):
                    letters.append(letter)
                    node = head
                    break
        return self.price[self.origin], "".join(letters)


@lru_cache(maxsize=1 << 15)
def _short(codes: str) -> tuple[int, str]:
    return Lattice(codes).cheapest()


def cheapest_edits(codes: str) -> tuple[int, str]:
    """(cost, audit) of a conversation given by its letters; short ones are remembered."""
    return _short(codes) if len(codes) <= BLOCK else Lattice(codes).cheapest()


class _Conversation:
    """Counts of the rows read so far, then the edits applied to the rows that follow."""

    def __init__(self, conv, turns: bool):
        self.conv, self.turns, self.solved = conv, turns, False
        self.codes, self.seen, self.last = [], set(), None
        self.least = self.most = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.cost, self.audit, self.at, self.role, self.written = 0, "", 0, 0, 0
        self.sha = hashlib.sha256()

    def read(self, turn, initial, digest, blank, ends) -> None:
        if turn is not None and turn != self.most:
            self.distinct += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        again = digest in self.seen
        self.seen.add(digest)
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += not (again or blank or ends)
        code = initial if initial in ("s", "u", "a") else "o"
        self.codes.append("x" if again or blank else code if ends else code.upper())

    def solve(self) -> None:
        self.cost, self.audit = cheapest_edits("".join(self.codes))
        self.codes, self.seen, self.solved = [], set(), True

    def _write(self, letter, turn, role, text):
        self.role = {"s": 1, "u": 2, "a": 3}[role[0]]
        self.sha.update(f"{chr(10) if self.written else ''}{role}:{text}".encode())
        self.written += 1
        return [(self.conv, self.written, letter, turn, role, text)] if self.turns else []

    def _inserted(self):
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            out += self._write("I", None, _ROLES[_FOLLOWS[self.role]], "")
        return out

    def apply(self, turn, role, text):
        out = self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            out += self._write(letter, turn, role if letter == "K" else _ROLES[_FOLLOWS[self.role]], text)
        return out

    def close(self):
        """Rows inserted at the end, and the report."""
        if not self.solved:
            self.solve()
        out = self._inserted()
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.distinct
        return out, (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.sha.hexdigest())


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
    *[(n, pa.int64()) for n in _REPORT[:6]], *[(n, pa.string()) for n in _REPORT[6:]],
])
_DDL = "conv_id long, place long, edit string, turn long, role string, text string, gaps long, blank long, duplicate long, truncated long, " \
       "illegal long, cost long, audit string, repaired_sha256 string"


def _batch(turns: list[tuple], reports: list[tuple]) -> pa.RecordBatch:
    """Rows with a place are turns, the others reports."""
    rows = [t + (None,) * 8 for t in turns] + [(r[0],) + (None,) * 5 + r[1:] for r in reports]
    columns = list(zip(*rows)) or [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _repairing(turns: bool):
    names = ("conv_id", "present", "whole", "turn", "role", "initial", "digest", "blank", "ends", "text")

    def repair(batches):
        now, started = None, False
        for batch in batches:
            out, reports = [], []
            for conv, present, whole, turn, role, initial, digest, blank, ends, text in zip(*(batch.column(n).to_pylist() for n in names)):
                if not started or conv != now.conv:
                    if started:
                        more, report = now.close()
                        out += more
                        reports.append(report)
                    now, started = _Conversation(conv, turns), True
                if whole:
                    if not now.solved:
                        now.solve()
                    out += now.apply(turn, role, text)
                elif present:
                    now.read(turn, initial, digest, blank, ends)
            if out or reports:
                yield _batch(out, reports)
        if started:
            more, report = now.close()
            yield _batch(more, [report])

    return repair


def _spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str = "present",
) -> DataFrame:
    """``conversations`` with faults put in by ``crc32("conv_id:turn") % 20``; nulls count as one space.

    0 drops the row (it stays here with ``present`` false, so that its conversation is still known), 1 empties the text, 2 takes
    its ends of sentences, 3 repeats it, 4 makes its role ``user``.
    """
    case, = column_names(conversations, "case")
    copies = F.when(F.col(case) == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.col(case) != 0))
    own = _spaced(text)
    return (
        conversations.withColumn(case, F.crc32(F.concat(_spaced(conv_id), F.lit(":"), _spaced(turn))) % 20)
        .withColumn(role, F.when(F.col(case) == 4, "user").otherwise(_spaced(role)))
        .withColumn(text, F.when(F.col(case) == 1, "").when(F.col(case) == 2, F.regexp_replace(own, "[.!?]", "")).otherwise(own))
        .withColumn(present, F.explode(copies))
        .drop(case)
    )


def _repair(conversations: DataFrame, turns: bool, conv_id: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    own_role, own_text = _spaced(role), _spaced(text)
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), own_role.alias("role"), own_text.alias("text"),
        (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"),
        F.substring(own_role, 1, 1).alias("initial"), F.unhex(F.sha2(F.concat(F.length(own_role).cast("string"), F.lit(":"), own_role, own_text), 256)).alias("digest"),
        (~own_text.rlike(WORD)).alias("blank"), F.right(F.rtrim(own_text, F.lit(SPACE)), F.lit(1)).isin(*ENDS).alias("ends"),
    )
    # a row without its text, and if it is there once more with it
    twice = rows.withColumn("whole", F.explode(F.when(F.col("present"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    sent = twice.withColumn("text", F.when(F.col("whole"), F.col("text")))
    order = [F.col("conv_id").asc_nulls_first(), "whole", F.col("turn").asc_nulls_first(), "role", "digest"]
    return sent.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_repairing(turns), _DDL)


def reports(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None,
) -> DataFrame:
    """One row for each conversation: ``conv_id``, ``gaps`` (turn numbers missing), ``blank``, ``duplicate``, ``truncated`` (rows by their first fault),
    ``illegal`` (neighbours whose roles may not follow each other), ``cost``, ``audit`` (letters of the edits), ``repaired_sha256``.

    Rows stand in the order of their turns, null turns first, equal turns by role and then by a digest of role and text. Null roles and texts count as one space, rows
    whose conversation is null are one conversation. Rows with ``present`` false only name their conversation. Repeated rows are
    duplicates. An empty table has no conversations.
    """
    return _repair(conversations, False, conv_id, turn, role, text, present).select("conv_id", *_REPORT)


def repaired(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None,
) -> DataFrame:
    """The repaired conversations, a row for each turn: ``conv_id``, ``place`` (from 1), ``edit`` (K, R or I), ``turn`` (null if inserted), ``role``, ``text``."""
    rows = _repair(conversations, True, conv_id, turn, role, text, present)
    return rows.filter(F.col("place").isNotNull()).select("conv_id", "place", "edit", "turn", "role", "text")

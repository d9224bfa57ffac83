"""Best-fit packing of documents into sequences, after a Martello-Toth reduction.

The plan needs only the number of pieces of each length, a histogram of at most ``capacity``
rows however many documents there are. Sets of pieces that dominate every alternative for the
longest piece are fixed first; best-fit decreasing places the rest. Both work on (length,
count) classes, and the pieces then find their places by their rank within their length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import slices, text_or_empty
from harrow.runtime import stabilise

# Parts a worker's table holds before it starts anew: a bound of memory only.
TABLE_ENTRIES = 800_000
# Pieces of one length that one task ranks, about
RANKED_PER_TASK = 2000
# Texts that normalisation only puts into lower case (no apostrophe, which may join what follows), and their parts
PLAIN_TEXT = re.compile("[\\t-\\r -&(-~À-ÖØ-öø-ÿ]*")
PART = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@[-`{-~]+")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of whole texts from a table of distinct parts.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its words in turn. In a text
    of plain letters, digits and punctuation its parts are also known - runs of letters in lower case, single digits, runs
    of punctuation - and new parts are encoded many in a call, told apart by the tokens that end a part.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, own in self.tokenizer.get_vocab().items():
            self.ends[own] = token.endswith("</w>")
        self.parts: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(some):
                raw = ids.tobytes()
                self.parts.update((part, raw[a:b]) for part, a, b in zip(some, [0, *cuts], cuts))
            else:
                self.parts.update(zip(some, self._encode(some)))

    def of(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [bool(PLAIN_TEXT.fullmatch(t)) and "<|" not in t for t in texts]
        cut = [PART.findall(t.lower()) for t, p in zip(texts, plain) if p]
        distinct = set().union(*cut)
        if len(self.parts) > TABLE_ENTRIES:
            self.parts = {}
        self._learn(list(distinct.difference(self.parts)))
        parts = self.parts
        coded = iter([b"".join([parts[x] for x in own]) for own in cut])
        other = [t.encode().split() for t, p in zip(texts, plain) if not p]
        words = list(set().union(*other))
        table = dict(zip(words, self._encode([w.decode() for w in words])))
        rest = iter([b"".join([table[w] for w in own]) for own in other])
        return [next(coded if p else rest) for p in plain]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One table for all tasks of a Python worker."""
    return WordIds(path)


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``): each text's ids and a separator, cut only beyond ``capacity``."""
    end = np.array([separator], "<u4").tobytes()

    def cut(batches):
        words = word_ids(tokenizer)
        for part in slices(batches):
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(words.of(part.column("text").to_pylist())):
                ids += end
                total = len(ids) // 4
                for k in range(0, total, capacity):
                    own = ids[4 * k : 4 * (k + capacity)]
                    rows.append(row)
                    piece.append(k // capacity)
                    start.append(k)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Lengths:
    """Counts by length, and the longest length left that is no more than a given one."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: n for k, n in counts.items() if n > 0}
        self.keys = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            del self.keys[bisect_right(self.keys, length) - 1]

    def fitting(self, room: int, but: int | None = None) -> int | None:
        """Longest length of at most ``room``; one piece of length ``but`` is in use already."""
        k = bisect_right(self.keys, room) - 1
        if k >= 0 and self.keys[k] == but and self.count[but] < 2:
            k -= 1
        return self.keys[k] if k >= 0 else None

    def smallest(self, n: int, but: int) -> list[int]:
        """The ``n`` smallest pieces without one of length ``but``."""
        out: list[int] = []
        for key in self.keys:
            out += [key] * min(n - len(out), self.count[key] - (key == but))
            if len(out) == n:
                break
        return out


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix the sets that dominate all alternatives for a piece, longest first, as often as that holds.

    For a piece j, let r be the room beside it and k the longest other piece that fits there. Nothing fits: {j}.
    j + k fills the sequence, or no two others fit in r, or any two that do are together no
    longer than k and no three fit: {j, k}. What stands beside j in any packing could change places with
    k, so some best packing holds the set (Martello and Toth 1990, criterion of dominance).
    Returns (set, how often) and the counts that no rule covers.
    """
    left, fixed = _Lengths(counts), []
    for j in reversed(left.keys.copy()):
        room = capacity - j
        while j in left.count:
            k = left.fitting(room, but=j)
            if k is None:
                n = left.count[j] if left.keys[0] > room else 1
                fixed.append(((j,), n))
                left.take(j, n)
                continue
            three = left.smallest(3, but=j)
            alone = len(three) < 2 or three[0] + three[1] > room
            no_three = len(three) < 3 or sum(three) > room
            if j + k != capacity and not alone and not (no_three and _best_pair(left, room, j) <= k):
                break
            # each round uses up j or k; until then fewer pieces only leave fewer alternatives
            n = left.count[j] // 2 if j == k else min(left.count[j], left.count[k])
            fixed.append(((j, k), n))
            left.take(k, n)
            left.take(j, n)
    return fixed, left.count


def _best_pair(left: _Lengths, room: int, but: int) -> int:
    """Largest sum of two pieces within ``room``."""
    own = lambda key: left.count[key] - (key == but)
    keys = [key for key in left.keys if key <= room and own(key)]
    lo, hi, best = 0, len(keys) - 1, 0
    while lo <= hi:
        a, b = keys[lo], keys[hi]
        if a + b > room:
            hi -= 1
            continue
        if lo < hi or own(a) > 1:
            best = max(best, a + b)
        lo += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over length classes: ((length, how many), ...) of a sequence, and the number of such sequences."""
    rooms: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    order: list[int] = []  # rooms that have sequences, ascending

    def add(room: int, content: tuple, n: int) -> None:
        if n:
            if not rooms[room]:
                order.insert(bisect_right(order, room), room)
            rooms[room].append((content, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_right(order, length - 1)
            room = order[at] if at < len(order) else None
            content, open_ = rooms[room].pop() if room is not None else ((), -(-n // (capacity // length)))
            if room is not None and not rooms[room]:
                del order[at]
            room = capacity if room is None else room
            each = room // length
            full, rest = divmod(min(n, each * open_), each)
            add(room - each * length, (*content, (length, each)), full)
            if rest:
                add(room - rest * length, (*content, (length, rest)), 1)
            if content:
                add(room, content, open_ - full - bool(rest))
            n -= full * each + rest
    return [(content, n) for own in rooms.values() for content, n in own]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places by length: (length, first rank, number of ranks, copies per sequence, first sequence, offset)."""
    fixed, rest = reduce_dominated(counts, capacity)
    filled = [(tuple((x, 1) for x in pieces), n) for pieces, n in fixed if n] + best_fit(rest, capacity)
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for content, n in filled:
        offset = 0
        for length, copies in content:
            out.append((length, used[length], n * copies, copies, sequence, offset))
            used[length] += n * copies
            offset += length * copies
        sequence += n
    return out


def pack(pieces: DataFrame, capacity: int = 2048, ids: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) and their ``sequence_id`` and ``offset``.

    Offsets of a sequence are gapless from 0. Ranks run within a length over slices of about
    ``RANKED_PER_TASK`` pieces, so a length that a third of all pieces share is no task of its own.
    ``pieces`` is read more than once and has to be a stored table. Null ids and repeated rows are placed like any other.
    """
    spark = pieces.sparkSession
    total = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    counts = {row["length"]: row["n"] for row in total}
    slots = spark.createDataFrame(
        plan(counts, capacity) or [(0, 0, 0, 1, 0, 0)],
        "at_length long, first_rank long, ranks long, copies long, first_sequence long, first_offset long",
    )
    shards = max(1, max(counts.values(), default=0) // RANKED_PER_TASK)
    rows = pieces.withColumn("shard", F.pmod(F.xxhash64(*ids, "length"), F.lit(shards)))
    before = (
        rows.groupBy("length", "shard").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n"))
        .select(F.col("length").alias("l"), F.col("shard").alias("s"), "before")
    )
    in_shard = Window.partitionBy("length", "shard").orderBy(*ids)
    ranked = rows.withColumn("row", F.row_number().over(in_shard)).join(
        before, (F.col("length") == F.col("l")) & (F.col("shard") == F.col("s"))
    ).withColumn("rank", F.col("before") + F.col("row") - 1)
    beyond = F.col("rank") - F.col("first_rank")
    # the plan depends on lengths alone: a few entries for each of at most ``capacity`` lengths
    placed = ranked.join(
        F.broadcast(slots), (F.col("length") == F.col("at_length")) & (beyond >= 0) & (beyond < F.col("ranks"))
    )
    return placed.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(beyond / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(beyond, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece of each document with its place; null and empty texts are one separator long."""
    return pack(stabilise(token_pieces(docs, tokenizer, capacity, separator, doc_id, text)), capacity)

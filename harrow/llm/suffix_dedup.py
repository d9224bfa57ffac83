"""Removal of repeated byte strings by sorted suffixes.

A byte goes if a string of ``size`` bytes that covers it also starts in a document with a smaller id. All such strings are the first
``size`` bytes of suffixes, so equal ones stand side by side in a suffix array. The array is sharded by a number that
depends on those bytes alone, the least hash of the 16-byte strings in them: equal strings meet in one shard, and a run of
starts with one number travels as one piece of text.

1. Every task lists the numbers of its texts, and a shard tells which of them occur in more than one document.
2. Only those runs are sent, with their bytes. A shard sorts their suffixes: first by eight bytes, then by a mergesort
   that finds the common extension of two suffixes by binary search over prefix polynomial hashes. Neighbours
   with the same hash of ``size`` bytes are compared byte by byte before they count as equal.
3. The repeated stretches go back to their documents.

Documents are dealt to groups. The texts are sent to their groups once, compressed; steps 2 and 3 both read that exchange. Whole copies are
recognised by digest and send no runs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.llm.common import SLICE_CHARS, give_back, slices, text_key, text_or_empty
from harrow.llm.jaccard_join import mixed
from harrow.runtime import stabilise

GRAM = 16
# Bytes of text in a group of documents, of texts whose numbers make up a shard, and bytes handled at once inside a group
GROUP_BYTES = 32 << 20
SHARD_BYTES = 4 << 20
STEP_BYTES = 1 << 19
# Numbers a task holds before it hands them on
HELD = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTES = mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))
_shrinker, _grower = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each position on, by doubling."""
    h = _BYTES[data]
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(0xD1342543DE82EF95) + h[step:] * np.uint64(0xAF251AF3B0F025B5)
        step *= 2
    return mixed(h)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def runs(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int):
    """Runs of starts with one number inside each text of ``data``: first start, last start, text, number."""
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none, none, none, none.astype(np.uint64)
    number = _sliding_min(_grams(data), size - GRAM + 1)
    n = len(number)
    inside = np.zeros(n + 1, np.int64)
    whole = ends - begins >= size
    np.add.at(inside, begins[whole], 1)
    np.add.at(inside, np.minimum(ends[whole] - size + 1, n), -1)
    inside = np.cumsum(inside[:n]) > 0
    opening = inside.copy()
    opening[1:] &= (number[1:] != number[:-1]) | ~inside[:-1]
    opening[begins[whole]] = True
    first = np.flatnonzero(opening)
    closing = inside.copy()
    closing[:-1] &= opening[1:] | ~inside[1:]
    last = np.flatnonzero(closing)
    return first, last, np.searchsorted(begins, first, side="right") - 1, mixed(number[first] + np.uint64(size))


class Hashes:
    """Prefix polynomial hashes (modulo 2**64) of a byte string; equal strings have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.ones(len(data) + 1, np.uint64)
            power[1:] = np.cumprod(np.full(len(data), _BASE))
            back = np.ones(len(data) + 1, np.uint64)
            back[1:] = np.cumprod(np.full(len(data), np.uint64(pow(int(_BASE), -1, 1 << 64))))
            self.prefix = np.zeros(len(data) + 1, np.uint64)
            self.prefix[1:] = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])
        self.back, self.eight = back, _words8(data)

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return (self.prefix[at + length] - self.prefix[at]) * self.back[at]

    def common(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Length of the common extension of the suffixes at ``a`` and ``b``, up to ``size``."""
        whole = self.of(a, size) == self.of(b, size)
        low, high = np.where(whole, size, 0), np.where(whole, size, size - 1)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) // 2
            same = self.of(a, mid) == self.of(b, mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)


def _words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number in byte order."""
    return np.ndarray(max(0, len(data) - 7), ">u8", data.tobytes(), strides=(1,))


def sort_suffixes(data: np.ndarray, at: np.ndarray, shard: np.ndarray, size: int, hashes: Hashes | None = None) -> np.ndarray:
    """Order of the suffixes ``at`` by ``shard``, then by their first ``size`` bytes (stable).

    Of the suffixes with one hash the first is sorted, the others follow it.
    """
    hashes = hashes or Hashes(data)
    whole = hashes.of(at, size)
    alike = np.lexsort((whole, shard))
    start = np.flatnonzero(np.concatenate(([True], (np.diff(shard[alike]) != 0) | (whole[alike[1:]] != whole[alike[:-1]]))))
    first = alike[start]
    order = _sort_different(data, at[first], shard[first], size, hashes)
    return alike[_spans(start[order], np.diff(np.append(start, len(alike)))[order])]


def _sort_different(data: np.ndarray, at: np.ndarray, shard: np.ndarray, size: int, hashes: Hashes) -> np.ndarray:
    eight = hashes.eight[at].astype(np.uint64)
    order = np.lexsort((eight, shard))
    split = np.flatnonzero((np.diff(shard[order]) != 0) | (np.diff(eight[order].view(np.int64)) != 0)) + 1
    begin = np.concatenate(([0], split))
    length = np.diff(np.append(begin, len(order)))
    width = 1
    while width < length.max(initial=0):
        # merge neighbouring sorted stretches of ``width`` inside each bucket that is longer
        long = length > width
        rows = _spans(begin[long], length[long])
        offset = rows - np.repeat(begin[long], length[long])
        end = np.repeat(begin[long] + length[long], length[long])
        left = (offset // width) % 2 == 0
        other = np.where(left, rows - offset % width + width, rows - offset % width - width)
        other_end = np.minimum(other + width, end)
        lo, hi = np.minimum(other, end), np.where(left, other_end, rows - offset % width)
        base = lo.copy()
        while True:
            active = np.flatnonzero(lo < hi)
            if not len(active):
                break
            mid = (lo[active] + hi[active]) // 2
            mine, theirs = at[order[rows[active]]], at[order[mid]]
            common = hashes.common(mine, theirs, size)
            short = common < size
            x = data[np.minimum(mine + common, len(data) - 1)]
            y = data[np.minimum(theirs + common, len(data) - 1)]
            # equal suffixes of the left stretch come first
            after = np.where(short, x > y, ~left[active])
            lo[active] = np.where(after, mid + 1, lo[active])
            hi[active] = np.where(after, hi[active], mid)
        target = np.where(left, rows + (lo - base), rows - width + (lo - base))
        merged = order.copy()
        merged[target] = order[rows]
        order = merged
        width *= 2
    return order


def _spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of the stretches."""
    total = int(length.sum())
    return np.arange(total) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)


def least_document(data: np.ndarray, at: np.ndarray, shard: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """For each suffix the smallest document that has one with the same ``size`` first bytes.

    Equal strings have equal hashes, so only suffixes whose hash another document has too, in whatever shard, are sorted.
    """
    hashes, out = Hashes(data), doc.copy()
    whole = hashes.of(at, size)
    order = np.argsort(whole)
    start = np.flatnonzero(np.concatenate(([True], whole[order[1:]] != whole[order[:-1]])))
    several = np.minimum.reduceat(doc[order], start) != np.maximum.reduceat(doc[order], start)
    some = np.sort(order[np.repeat(several, np.diff(np.append(start, len(order))))])
    if len(some):
        out[some] = _least_of_sorted(data, at[some], shard[some], doc[some], size, hashes)
    return out


def _least_of_sorted(data: np.ndarray, at: np.ndarray, shard: np.ndarray, doc: np.ndarray, size: int, hashes: Hashes) -> np.ndarray:
    order = sort_suffixes(data, at, shard, size, hashes)
    a, b = at[order[:-1]], at[order[1:]]
    near = shard[order[:-1]] == shard[order[1:]]
    claimed = near & (hashes.of(a, size) == hashes.of(b, size))
    eight = hashes.eight
    same = claimed.copy()
    for k in [*range(0, size - 8, 8), size - 8]:
        same &= eight[a + k] == eight[b + k]
    if (claimed != same).any():  # two strings with one hash: order by the bytes themselves
        columns = [eight[at + k].astype(np.uint64) for k in [size - 8, *range((size - 9) // 8 * 8, -1, -8)]]
        order = np.lexsort((*columns, shard))
        same = shard[order[:-1]] == shard[order[1:]]
        for column in columns:
            same &= column[order[:-1]] == column[order[1:]]
    start = np.flatnonzero(np.concatenate(([True], ~same)))
    least = np.minimum.reduceat(doc[order], start)
    out = np.empty_like(doc)
    out[order] = np.repeat(least, np.diff(np.append(start, len(order))))
    return out


def _joined(texts: list[bytes]):
    ends = np.cumsum([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], ends[:-1])).astype(np.int64), ends.astype(np.int64)


def _steps(sizes: list[int]):
    """Slices of rows of about ``STEP_BYTES``."""
    start = total = 0
    for row, size in enumerate(sizes):
        if row > start and total + size > STEP_BYTES:
            yield start, row
            start, total = row, 0
        total += size
    if sizes:
        yield start, len(sizes)


def _pack(raw: bytes) -> bytes:
    return _shrinker.compress(raw)


def _unpack(raw: bytes) -> bytes:
    return _grower.decompress(raw)


def _place(number: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and the 32 bits kept of a number."""
    return ((number >> np.uint64(32)) % np.uint64(shards)).astype(np.int64), (number & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _pack_numbers(numbers: np.ndarray) -> bytes:
    """Ascending numbers: steps by byte place, compressed."""
    steps = np.diff(numbers, prepend=np.uint32(0)).astype("<u4")
    return _pack(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack_numbers(raw: bytes) -> np.ndarray:
    places = np.frombuffer(_unpack(raw), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(places.T).view("<u4").ravel(), dtype=np.uint32)


_LISTED = pa.schema([("shard", pa.int32()), ("grp", pa.int64()), ("numbers", pa.binary()), ("several", pa.binary())])


def _list_numbers(size: int, shards: int):
    """Packs of the numbers by shard and group, ascending, with a bit for those that several documents of the pack have.

    A document is in one pack of a shard, so a number in two packs is in two documents.
    """

    def rows(held):
        shard, grp, number, text = (np.concatenate(x) for x in zip(*held))
        pack = grp * shards + shard
        order = np.lexsort((number, pack))
        pack, number, text = pack[order], number[order], text[order]
        begin = np.flatnonzero(np.concatenate(([True], (np.diff(pack) != 0) | (number[1:] != number[:-1]))))
        several = np.minimum.reduceat(text, begin) != np.maximum.reduceat(text, begin)
        pack, number = pack[begin], number[begin]
        grp, shard = pack // shards, pack % shards
        cut = np.concatenate(([0], np.flatnonzero(np.diff(pack)) + 1)).astype(np.int64)
        end = np.append(cut[1:], len(pack))
        for at in range(0, len(cut), 4096):
            some = [slice(a, b) for a, b in zip(cut[at : at + 4096], end[at : at + 4096])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard[cut[at : at + 4096]], pa.int32()), pa.array(grp[cut[at : at + 4096]], pa.int64()),
                    pa.array([_pack_numbers(number[k]) for k in some], pa.binary()),
                    pa.array([np.packbits(several[k]).tobytes() for k in some], pa.binary()),
                ],
                schema=_LISTED,
            )

    def listed(batches):
        held, count, seen = [], 0, 0
        for part in slices(batches, chars=STEP_BYTES):
            texts = [t.encode() for t in part.column("text").to_pylist()]
            data, begins, ends = _joined(texts)
            first, _, text, number = runs(data, begins, ends, size)
            if len(first):
                shard, kept = _place(number, shards)
                held.append((shard, part.column("grp").to_numpy()[text], kept, text + seen))
                count += len(first)
            seen += len(texts)
            if count > HELD:
                yield from rows(held)
                held, count = [], 0
        if held:
            yield from rows(held)
        del held
        give_back()

    return listed


def _tell_shared(table: pa.Table) -> pa.Table:
    """Of each pack's numbers those that more than one document has."""
    numbers = [_unpack_numbers(x) for x in table.column("numbers").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)).astype(bool) for x, n in zip(table.column("several").to_pylist(), numbers)]
    flat = np.concatenate(numbers)
    order = np.argsort(flat, kind="stable")
    start = np.flatnonzero(np.concatenate(([True], np.diff(flat[order].astype(np.int64)) != 0)))
    times = np.diff(np.append(start, len(flat)))
    told = np.zeros(len(flat), bool)
    told[order] = np.repeat((times > 1) | np.logical_or.reduceat(np.concatenate(several)[order], start), times)
    out = {"grp": [], "shard": [], "numbers": []}
    end = 0
    for shard, grp, own in zip(table.column("shard").to_pylist(), table.column("grp").to_pylist(), numbers):
        end += len(own)
        mine = own[told[end - len(own) : end]]
        if len(mine):
            out["grp"].append(grp)
            out["shard"].append(shard)
            out["numbers"].append(_pack_numbers(mine))
    return pa.table({"grp": pa.array(out["grp"], pa.int64()), "shard": pa.array(out["shard"], pa.int32()), "numbers": pa.array(out["numbers"], pa.binary())})


# rows with numbers (a) are runs for a shard; rows without are stretches known already, compressed (e)
_SENT = "shard int, grp long, a binary, b binary, c binary, d binary, e binary"


def _in_order(docs: pa.Table) -> list[int]:
    """Rows of a group in an order that does not depend on how they arrived; rows of one id and text are alike."""
    ids, digests = docs.column("doc_id").to_pylist(), docs.column("digest").to_pylist()
    return sorted(range(docs.num_rows), key=lambda r: (ids[r] is None, ids[r] or 0, digests[r]))


def _send_runs(size: int, shards: int):
    """The runs of a group's documents that may be repeated, by shard, and the stretches that are repeated in any case."""

    def send(key, docs: pa.Table, told: pa.Table) -> pa.Table:
        give_back()
        masks, copies = [np.zeros(0, np.uint64)], set()
        for shard, numbers, doc, digest in zip(*(told.column(c).to_pylist() for c in ("shard", "numbers", "doc_id", "digest"))):
            if digest is not None:
                copies.add((doc, digest))
            else:
                masks.append(_unpack_numbers(numbers).astype(np.uint64) | np.uint64(shard << 32))
        mask = np.unique(np.concatenate(masks))
        ids, raws, digests, sizes = (docs.column(c).to_pylist() for c in ("doc_id", "z", "digest", "n_bytes"))
        ranked = _in_order(docs)
        pending, known, texts = [], [], []
        for first, last in _steps([sizes[r] for r in ranked]):
            live = []
            for place in range(first, last):
                row = ranked[place]
                if sizes[row] >= size and (ids[row], digests[row]) in copies:
                    known.append((place, 0, sizes[row]))
                elif sizes[row] >= size and len(mask):
                    live.append((place, row, _unpack(raws[row])))
            if not live:
                continue
            data, begins, ends = _joined([t for _, _, t in live])
            lo, hi, text, number = runs(data, begins, ends, size)
            shard, kept = _place(number, shards)
            code = kept.astype(np.uint64) | (shard.astype(np.uint64) << np.uint64(32))
            hit = mask[np.minimum(np.searchsorted(mask, code), len(mask) - 1)] == code
            lo, hi, text = lo[hit], hi[hit], text[hit]
            place_of = np.array([p for p, _, _ in live], np.int64)[text]
            # a null id is larger than every id
            rank = np.array([_BIGGEST if ids[r] is None else ids[r] for _, r, _ in live], np.int64)[text]
            pending.append((code[hit], rank, place_of, lo - begins[text]))
            blob = data.tobytes()
            texts += [blob[a:b] for a, b in zip(lo.tolist(), (hi + size).tolist())]
        grp, out = key[0].as_py(), []
        if texts:
            code, rank, place, start = (np.concatenate(x) for x in zip(*pending))
            order = np.lexsort((rank, code))
            # of runs with the same bytes only those of the smallest document ask; the others are repeated in any case
            asks, least, last = np.zeros(len(code), bool), {}, None
            for k, own, number in zip(order.tolist(), rank[order].tolist(), code[order].tolist()):
                if number != last:
                    least, last = {}, number
                asks[k] = own == least.setdefault(texts[k], own)
            copied = np.flatnonzero(~asks)
            length = np.fromiter(map(len, texts), np.int64, len(texts))
            known += zip(place[copied].tolist(), start[copied].tolist(), (start + length)[copied].tolist())
            order = order[asks[order]]
            for own in np.split(order, np.flatnonzero(np.diff((code[order] >> np.uint64(32)).astype(np.int64))) + 1):
                out.append((
                    int(code[own[0]] >> np.uint64(32)), grp, (code[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), rank[own].tobytes(),
                    np.stack([place[own], start[own]], axis=1).astype(np.int32).tobytes(), length[own].astype(np.int32).tobytes(),
                    _pack(b"".join(map(texts.__getitem__, own.tolist()))),
                ))
        if known:
            out.append((grp % shards, grp, None, None, None, None, _pack(np.array(known, np.int32).tobytes())))
        columns = list(zip(*out)) or [()] * 7
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("shard", "grp", "a", "b", "c", "d", "e"), columns, kinds)})

    return send


_BIGGEST = (1 << 63) - 1


def _find_repeats(size: int):
    """Stretches of each group's documents that the shard's suffixes repeat from a smaller document."""

    def find(sent: pa.Table) -> pa.Table:
        give_back()
        ready = sent.filter(pc.is_null(sent.column("a")))
        passed = pa.table({"grp": ready.column("grp"), "a": ready.column("e")})
        table = sent.filter(pc.is_valid(sent.column("a")))
        if not table.num_rows:
            return passed
        columns = {c: table.column(c).to_pylist() for c in ("grp", "a", "b", "c", "d", "e")}
        parts = range(table.num_rows)
        number = np.concatenate([np.frombuffer(x, np.uint32) for x in columns["a"]])
        rank = np.concatenate([np.frombuffer(x, np.int64) for x in columns["b"]])
        place = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in columns["c"]])
        length = np.concatenate([np.frombuffer(x, np.int32) for x in columns["d"]]).astype(np.int64)
        source = np.repeat(np.array(list(parts)), [len(x) // 4 for x in columns["a"]])
        blob = b"".join(_unpack(x) for x in columns["e"])
        text = np.frombuffer(blob, np.uint8)
        begin = np.cumsum(length) - length
        found: dict[int, list[np.ndarray]] = {}

        def keep(run: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
            """Note stretches of runs, from ``first`` to ``last`` in their texts, for the groups the runs came from."""
            stretch = np.stack([place[run, 0], first, last], axis=1).astype(np.int32)
            order = np.argsort(source[run], kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(source[run][order])) + 1):
                if len(rows):
                    found.setdefault(int(source[run[rows[0]]]), []).append(stretch[rows])

        # runs with the same bytes are repeated as a whole but for those of the smallest document; most runs end here
        runs_of = [(n, blob[b : b + w]) for n, b, w in zip(number.tolist(), begin.tolist(), length.tolist())]
        least: dict[tuple[int, bytes], int] = {}
        ranks = rank.tolist()
        for run, own in zip(runs_of, ranks):
            if own < least.get(run, _BIGGEST + 1):
                least[run] = own
        copied = np.array([own > least[run] for run, own in zip(runs_of, ranks)], bool)
        del runs_of, least, ranks
        again = np.flatnonzero(copied)
        keep(again, place[again, 1], place[again, 1] + length[again])
        # numbers that came from one document alone have nothing to be compared with
        order = np.flatnonzero(~copied)
        order = order[np.argsort(number[order], kind="stable")]
        start = np.flatnonzero(np.concatenate(([True], np.diff(number[order].astype(np.int64)) != 0)))
        spread = np.minimum.reduceat(rank[order], start) != np.maximum.reduceat(rank[order], start)
        open_ = np.zeros(len(number), bool)
        open_[order] = np.repeat(spread, np.diff(np.append(start, len(order))))
        chosen = order[open_[order]]
        for some in _number_steps(number[chosen], (length - size + 1)[chosen]):
            run = chosen[some]
            data = text[_spans(begin[run], length[run])]
            local = np.cumsum(length[run]) - length[run]
            count = length[run] - size + 1
            at, owner = _spans(local, count), np.repeat(np.arange(len(run)), count)
            least = least_document(data, at, number[run].astype(np.int64)[owner], rank[run][owner], size)
            repeated = least < rank[run][owner]
            at, owner = at[repeated], owner[repeated]
            if not len(at):
                continue
            split = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner) != 0)) + 1
            first, last = np.concatenate(([0], split)), np.append(split, len(at)) - 1
            own = owner[first]
            who = run[own]
            shift = place[who, 1] - local[own]
            keep(who, shift + at[first], shift + at[last] + size)
        groups = sorted(found)
        mine = pa.table({
            "grp": pa.array([columns["grp"][g] for g in groups], pa.int64()),
            "a": pa.array([_pack(np.concatenate(found[g]).tobytes()) for g in groups], pa.binary()),
        })
        return pa.concat_tables([passed, mine])

    return find


def _number_steps(number: np.ndarray, starts: np.ndarray, most: int = 1 << 19):
    """Slices of runs, whole numbers each, of about ``most`` starts."""
    if not len(number):
        return
    ends = np.append(np.flatnonzero(np.diff(number.astype(np.int64)) != 0) + 1, len(number))
    total = np.cumsum(starts)
    first = 0
    while first < len(number):
        reach = (total[first - 1] if first else 0) + most
        k = max(np.searchsorted(total[ends - 1], reach, side="right") - 1, np.searchsorted(ends, first, side="right"))
        yield slice(first, int(ends[k]))
        first = int(ends[k])


def _cut(docs: pa.Table, stretches: pa.Table):
    """(row, bytes removed, maximal removed runs, bytes kept) of a group's documents; None for the bytes of a text that stays whole."""
    own = [np.frombuffer(_unpack(x), np.int32).reshape(-1, 3) for x in stretches.column("a").to_pylist()]
    spans = np.concatenate(own) if own else np.zeros((0, 3), np.int32)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    raws = docs.column("z").to_pylist()
    for place, row in enumerate(_in_order(docs)):
        lo, hi = np.searchsorted(spans[:, 0], [place, place + 1])
        if lo == hi:
            yield row, 0, 0, None
            continue
        data = np.frombuffer(_unpack(raws[row]), np.uint8)
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, spans[lo:hi, 1], 1)
        np.add.at(edge, spans[lo:hi, 2], -1)
        gone = np.cumsum(edge[:-1]) > 0
        rise = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        yield row, int(gone.sum()), rise, data[~gone].tobytes()


def _remove(key, docs: pa.Table, stretches: pa.Table) -> pa.Table:
    """Cut the stretches out of a group's documents."""
    ids, digests, sizes = (docs.column(c).to_pylist() for c in ("doc_id", "digest", "n_bytes"))
    out = []
    for row, removed, rise, kept in _cut(docs, stretches):
        sha = digests[row].hex() if kept is None else hashlib.sha256(kept).hexdigest()
        out.append((ids[row], digests[row], sizes[row], removed, rise, sha, _pack(kept) if kept else None))
    columns = list(zip(*out)) or [()] * 7
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "digest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"), columns, kinds)})


def _keep(text: str):
    """Of a group's documents those that keep something, or had nothing, with what they keep and their other columns, in slices."""

    def keep(key, docs: pa.Table, stretches: pa.Table) -> pa.Table:
        give_back()
        raws, known = docs.column("z").to_pylist(), docs.column("rest").combine_chunks().field("known").to_pylist()
        parts, rows, left, size = [], [], [], 0

        def part() -> pa.Table:
            rest = docs.column("rest").take(pa.array(rows, pa.int64())).combine_chunks()
            fields = [rest.field(k) for k in range(1, rest.type.num_fields)]
            return pa.table([*fields, pa.array(left, pa.string())], names=[*(f.name for f in list(rest.type)[1:]), text])

        for row, _, _, kept in _cut(docs, stretches):
            if kept is None or kept:
                kept = _unpack(raws[row]) if kept is None else kept
                rows.append(row)
                left.append(kept.decode("utf-8", "ignore") if known[row] else None)
                size += len(kept)
                if size > SLICE_CHARS:
                    parts.append(part())
                    rows, left, size = [], [], 0
        return pa.concat_tables([*parts, part()])

    return keep


def _sent_and_found(docs: DataFrame, size: int, doc_id: str, text: str, rest: Column) -> tuple[DataFrame, DataFrame]:
    """The texts packed by group, with ``rest`` of their rows beside them, and the stretches to remove by group."""
    if size < GRAM + 8:
        raise ValueError(f"size is {GRAM + 8} at least")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), rest.alias("rest"))
    check = F.crc32("text").alias("check")
    keys = stabilise(rows.select("doc_id", check, text_key(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes")))
    total = keys.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    groups, shards = max(1, math.ceil(total / GROUP_BYTES)), max(1, math.ceil(total / SHARD_BYTES))

    # null ids are spread by their texts
    grp = F.pmod(F.xxhash64("doc_id", "check"), F.lit(groups)).alias("grp")
    firsts = keys.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter(F.col("n") > 1)
    copies = (
        keys.filter(F.col("n_bytes") >= size).join(firsts, "digest")
        .filter(F.col("doc_id").isNull() & F.col("first_doc").isNotNull() | (F.col("doc_id") > F.col("first_doc")))
        .select(grp, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("numbers"), "doc_id", "digest").distinct()
    )
    dealt = rows.select("doc_id", "text", "rest", check).select(grp, "doc_id", "text", "rest")
    listed = dealt.select("grp", "text").mapInArrow(_list_numbers(size, shards), "shard int, grp long, numbers binary, several binary")
    told = listed.groupBy("shard").applyInArrow(_tell_shared, "grp long, shard int, numbers binary").select(
        "grp", "shard", "numbers", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("digest")
    )

    def shrink(batches):
        for part in slices(batches):
            raw = [t.encode() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("grp"), part.column("doc_id"), pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary()),
                    pa.array(map(len, raw), pa.int64()), pa.array([_pack(t) for t in raw], pa.binary()), part.column("rest"),
                ],
                ["grp", "doc_id", "digest", "n_bytes", "z", "rest"],
            )

    schema = T.StructType().add("grp", "long").add("doc_id", "long").add("digest", "binary").add("n_bytes", "long").add("z", "binary")
    packed = dealt.mapInArrow(shrink, schema.add(rows.schema["rest"]))
    sent = packed.groupBy("grp").cogroup(told.unionByName(copies).groupBy("grp")).applyInArrow(_send_runs(size, shards), _SENT)
    return packed, sent.groupBy("shard").applyInArrow(_find_repeats(size), "grp long, a binary")


def remove_repeats(docs: DataFrame, size: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``digest`` of the text, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and ``kept``: what is left of a text
    that lost a part of its bytes (zstd; null for a text that stays or goes whole).

    A null text counts as empty. A null id is larger than every other. Rows of one id never remove anything from each other, a
    copy with a larger id goes whole, and texts shorter than ``size`` stay. ``size`` is 24 at least.
    """
    packed, stretches = _sent_and_found(docs, size, doc_id, text, F.lit(True))
    return packed.groupBy("grp").cogroup(stretches.groupBy("grp")).applyInArrow(
        _remove, "doc_id long, digest binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )


def without_repeats(docs: DataFrame, size: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the repeated bytes; a text that loses all of them goes, one that was empty before stays.

    What a cut leaves of a character goes too. Repeated rows are cut alike and stay. A row's other columns travel with its text.
    """
    others = [c for c in docs.columns if c != text]
    rest = F.struct(F.col(text).isNotNull().alias("known"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(others)])
    packed, stretches = _sent_and_found(docs, size, doc_id, text, rest)
    schema, names = T.StructType(), {c: f"c{k}" for k, c in enumerate(others)} | {text: "left"}
    for c in [*others, text]:
        schema.add(names[c], docs.schema[c].dataType)
    kept = packed.groupBy("grp").cogroup(stretches.groupBy("grp")).applyInArrow(_keep("left"), schema)
    return kept.select(*[F.col(names[c]).alias(c) for c in docs.columns])

"""Exact Jaccard join of word n-gram sets: size bands, hashed bitmaps, sorted intersections.

Two sets of sizes x <= y at least ``percent`` similar have y <= x * 100 / percent and differ in few elements, at most
(x + y) * (100 - percent) / (100 + percent). Sizes fall into bands of that ratio; the sets of a band and the one below form a tile of
candidates. In a tile that allows d differences the elements are dealt into d + 1 parts by hash: similar sets agree
in one whole part, so only sets with an equal part are compared. The parity bitmap of a set's hashes comes first: each
bit in which two bitmaps differ is an element that only one set has, which bounds the overlap from above. What passes is intersected exactly.

Tiles have parts to spare, so that every set passes over its most common ones. A part that many sets share is not expanded into pairs: its sets are compared with its smallest member, and after the
links found so far are joined into components only members of different components meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import column_names, give_back, slices, text_key, text_or_empty
from harrow.llm.graph import components
from harrow.runtime import stabilise

BITMAP_BYTES = 128
# Elements of the sets that one verification task holds, about
TASK_ELEMENTS = 500_000
# Buckets of keys in a task, whose shared keys are one file
TASK_BUCKETS = 16
# Keys a task holds before it hands them on
HELD = 2_000_000
_WORDS_KEPT = 1 << 16
# Marks the set that stands for others of its task
_STANDS_FOR_OTHERS = 1 << 30
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = value
        return value


_words = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``n``-word runs, A-Z in lower case; the whole sequence if it has fewer words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        factor = _MULTIPLIERS[k % len(_MULTIPLIERS)] ** np.uint64(1 + k // len(_MULTIPLIERS))
        out = mixed(out * np.uint64(3) + hashes[k : len(words) - size + 1 + k] * factor)
    return np.unique(out)


def bitmap(elements: np.ndarray) -> np.ndarray:
    """Bit i is set if an odd number of elements hash to it."""
    bits = np.bincount((elements % np.uint64(8 * BITMAP_BYTES)).astype(np.int64), minlength=8 * BITMAP_BYTES) & 1
    return np.packbits(bits.astype(np.uint8))


def differences(x: int, percent: int) -> int:
    """Elements in only one of two sets of ``x`` elements at most that are similar."""
    return 2 * x * (100 - percent) // (100 + percent)


def band_of(size: int, percent: int) -> int:
    """Bands whose sizes lie within the ratio of each other: similar sets are in one band or in neighbours."""
    return int(math.log(size) / math.log(100 / percent) + 1e-9)


def band_top(band: int, percent: int) -> int:
    return math.ceil((100 / percent) ** (band + 1) * (1 + 1e-9))


def part_keys(elements: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A key for each part of the set in the tile of its band and in the tile of the band above, and what may be skipped there.

    With ``spare`` parts more than differences plus one, similar sets agree in ``spare + 1`` parts. Each may then pass over the
    ``spare`` keys that most sets have: the least common key of those they share is among the kept ones of both. The second number of
    a key is twice ``spare``, plus one in the tile above.
    """
    band = band_of(len(elements), percent)
    place, value = mixed(elements ^ np.uint64(0x5851F42D4C957F2D)), mixed(elements + np.uint64(1))
    keys, skips = [], []
    for above in (0, 1):
        apart = differences(band_top(band + above, percent), percent)
        spare = 1 + apart // 3
        parts = apart + 1 + spare
        part = (place % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part, value)
        keys.append(mixed(mixed(np.arange(parts, dtype=np.uint64) + np.uint64((band + above + 1) << 32)) + sums))
        skips.append(np.full(parts, 2 * spare + above, np.int32))
    return np.concatenate(keys), np.concatenate(skips)


def _sketch(n: int, percent: int):
    def sketch(batches):
        for part in slices(batches):
            sets = [shingles(text, n) for text in part.column("text").to_pylist()]
            maps = np.concatenate([bitmap(x) for x in sets]).view(np.int64)
            width = BITMAP_BYTES // 8
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("tid"), part.column("first_doc"), part.column("text"), pa.array([len(x) for x in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * width, pa.int32()), pa.array(maps)),
                ],
                ["tid", "first_doc", "text", "size", "bits"],
            )
        give_back()

    return sketch


def _list_keys(n: int, percent: int, buckets: int):
    """Keys of the texts by bucket. Of the sets that share a key inside the task only the smallest goes to the key's bucket (``sub`` 0), with a mark;
    the others go to one of many other groups, so a key that a third of all sets have is spread. Every set and key is listed once."""

    def rows(keys, tids, skips):
        code = ((keys >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
        order = np.lexsort((tids, code))
        code, tids, skips = code[order], tids[order], skips[order]
        first = np.concatenate(([True], code[1:] != code[:-1]))
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(code)))
        skips[start] |= np.where(length > 1, np.int32(_STANDS_FOR_OTHERS), np.int32(0))
        many = ~first
        sub = 1 + int(mixed(tids[:1].view(np.uint64))[0] % np.uint64(1 << 30))
        for chosen, own_sub in ((first, 0), (many, sub)):
            c, t, m = code[chosen], tids[chosen], skips[chosen]
            bucket = (c >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate(([True], np.diff(bucket) != 0))) if len(c) else np.zeros(0, np.int64)
            end = np.append(cut[1:], len(c))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[cut], pa.int64()), pa.array(np.full(len(cut), own_sub), pa.int64()),
                    pa.array([(c[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for i, j in zip(cut, end)], pa.binary()),
                    pa.array([t[i:j].tobytes() for i, j in zip(cut, end)], pa.binary()),
                    pa.array([m[i:j].tobytes() for i, j in zip(cut, end)], pa.binary()),
                ],
                ["bucket", "sub", "keys", "tids", "skips"],
            )

    def listed(batches):
        held, count = [], 0
        for part in slices(batches):
            for tid, text in zip(part.column("tid").to_pylist(), part.column("text").to_pylist()):
                own = shingles(text, n)
                if len(own):
                    keys, skips = part_keys(own, percent)
                    held.append((keys, np.full(len(keys), tid, np.int64), skips))
                    count += len(keys)
            if count > HELD:
                yield from rows(*map(np.concatenate, zip(*held)))
                held, count = [], 0
        if held:
            yield from rows(*map(np.concatenate, zip(*held)))
        del held
        give_back()

    return listed


def _share(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """(``code`` of a key, ``tid``, ``skip``) of the sets that share a key with another."""
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]).astype(np.int64)
    tids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("tids").to_pylist()])
    skips = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("skips").to_pylist()])
    code = keys | (key[0].as_py() << 32)
    if not key[1].as_py():
        order = np.argsort(code, kind="stable")
        code, tids, skips = code[order], tids[order], skips[order]
        start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        length = np.diff(np.append(start, len(code)))
        many = np.repeat(length > 1, length) | (skips >= _STANDS_FOR_OTHERS)
        code, tids, skips = code[many], tids[many], skips[many]
    skips = skips & (_STANDS_FOR_OTHERS - 1)
    return pa.table({"code": pa.array(code, pa.int64()), "tid": pa.array(tids, pa.int64()), "skip": pa.array(skips, pa.int32())})


def _verify(n: int, percent: int):
    """Links between each tile's centre and its members."""

    def verify(table: pa.Table) -> pa.Table:
        rows = table.select(["center", "member", "text"]).to_pylist()
        sets = {}
        for row in rows:
            if row["center"] == row["member"]:
                own = shingles(row["text"], n)
                sets[row["center"]] = own, bitmap(own)
        a, b = [], []
        for row in rows:
            if row["center"] == row["member"]:
                continue
            x, x_bits = sets[row["center"]]
            y = shingles(row["text"], n)
            apart = int(np.bitwise_count(x_bits ^ bitmap(y)).sum())
            most = (len(x) + len(y) - apart) // 2
            if 100 * most < percent * (len(x) + len(y) - most):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                a.append(row["center"])
                b.append(row["member"])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return verify


def _links(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (``center``, ``member``) that are links. A centre with many members is many tiles."""
    per_center = pairs.groupBy("center").agg(F.count("*").alias("members"))
    tiles = pairs.join(per_center, "center").select(
        "center", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("members") / 256)).alias("tile")
    )
    rows = tiles.unionByName(tiles.select("center", F.col("center").alias("member"), "tile").distinct())
    rows = stabilise(rows.join(sizes.select(F.col("tid").alias("member"), "size"), "member"))
    load = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(1, math.ceil(load / TASK_ELEMENTS))
    return (
        rows.join(texts.select(F.col("tid").alias("member"), "text"), "member")
        .select(F.pmod(F.xxhash64("center", "tile"), F.lit(tasks)).alias("task"), "center", "member", "text")
        .groupBy("task").applyInArrow(_verify(n, percent), "a long, b long")
    )


def similar(x: str, y: str, percent: int):
    """Sizes that can be similar."""
    return (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))


def plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (``size``, ``bits``, ``size_2``, ``bits_2``) that sizes, half of the bitmaps and the whole bitmaps leave open."""
    both = F.col("size") + F.col("size_2")

    def overlap(words: int):
        differ = sum(F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits_2")[k])) for k in range(words))
        return 100 * (both - differ) >= percent * (both + differ)

    return pairs.filter(similar("size", "size_2", percent)).filter(overlap(BITMAP_BYTES // 16)).filter(overlap(BITMAP_BYTES // 8))


def link_texts(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(``tid``, ``root``) of every set with a link: the smallest set that links reach."""
    sketches = texts.select("tid", "size", "bits")
    total = sketches.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(1, math.ceil(total / TASK_ELEMENTS))
    listed = texts.select("tid", "text").mapInArrow(_list_keys(n, percent, buckets), "bucket long, sub long, keys binary, tids binary, skips binary")
    shared = listed.groupBy("bucket", "sub").applyInArrow(_share, "code long, tid long, skip int")
    shared = stabilise(shared.coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, math.ceil(buckets / TASK_BUCKETS))))
    # each set passes over its most common keys, as many as its tile spares
    common = shared.groupBy("code").agg(F.count("*").alias("sets"))
    mine = Window.partitionBy("tid", "skip").orderBy(F.desc("sets"), F.desc("code"))
    kept = shared.join(common, "code").withColumn("place", F.row_number().over(mine)).filter(F.col("place") > F.shiftright("skip", 1))
    kept = stabilise(kept.select("code", "tid"))
    centers = kept.groupBy("code").agg(F.min("tid").alias("center"), F.max("tid").alias("last")).filter(F.col("center") < F.col("last"))
    crowded = stabilise(kept.join(centers.select("code", "center"), "code"))
    members = sketches.select(F.col("tid").alias("member"), "size", "bits")
    centers = sketches.select(F.col("tid").alias("center"), F.col("size").alias("size_2"), F.col("bits").alias("bits_2"))
    met = crowded.filter(F.col("tid") != F.col("center")).select("center", F.col("tid").alias("member")).distinct()
    pairs = stabilise(plausible(met.join(members, "member").join(centers, "center"), percent).select("center", "member"))
    first = stabilise(_links(pairs, texts, sketches, n, percent))
    # parts whose sets are not all connected yet: the rest of their pairs
    roots = components(first).withColumnRenamed("node", "tid")
    labelled = crowded.select("code", "tid").distinct().join(roots, "tid", "left").select("code", "tid", F.coalesce("root", "tid").alias("root"))
    apart = labelled.groupBy("code").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter(F.col("r0") < F.col("r1"))
    apart = stabilise(apart)
    if apart.isEmpty():
        return roots
    left = labelled.join(apart.select("code"), "code").join(sketches.select("tid", "size", "bits"), "tid")
    left = stabilise(left.select("code", "root", "tid", "size", "bits"))
    right = left.select("code", *[F.col(c).alias(f"{c}_2") for c in ("root", "tid", "size", "bits")])
    rest = (
        plausible(left.join(right, "code").filter(F.col("root") < F.col("root_2")), percent)
        .select(F.least("tid", "tid_2").alias("center"), F.greatest("tid", "tid_2").alias("member")).distinct()
        .join(pairs, ["center", "member"], "left_anti")
    )
    return components(first.unionByName(_links(stabilise(rest), texts, sketches, n, percent))).withColumnRenamed("node", "tid")


def cluster(
    docs: DataFrame, n: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(``doc_id``, ``text_hash``, ``n_shingles``, ``component_id``, ``first``), one row per row of ``docs``.

    ``component_id`` is the smallest id that links reach. A null text or one without words has no shingle and no link, and its own id;
    equal texts with words are linked. ``first`` marks the row with the smallest id of each component (and its repeats). Null ids keep their rows and are never the smallest. Elements are compared as 64-bit hashes.
    """
    key = text_key(F.col("text"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    # each text is written once, with the size and the bitmap of its set
    texts = stabilise(
        rows.groupBy(key.alias("key")).agg(F.min("doc_id").alias("first_doc"), F.first("text").alias("text"))
        .select(F.xxhash64("key").alias("tid"), "first_doc", "text")
        .mapInArrow(_sketch(n, percent), "tid long, first_doc long, text string, size long, bits array<long>")
    )
    roots = link_texts(texts, n, percent)
    known = texts.select("tid", "first_doc", "size").join(roots, "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    order = F.struct(F.col("first_doc").isNull(), "first_doc", "tid")
    smallest = known.groupBy("root").agg(F.min("first_doc").alias("component"), F.min_by("tid", order).alias("first_tid"))
    of_text = known.join(smallest, "root").select("tid", "size", "component", "first_tid")
    return (
        rows.select("doc_id", F.xxhash64(key).alias("tid")).join(of_text, "tid")
        .select(
            "doc_id", F.col("tid").alias("text_hash"), F.col("size").alias("n_shingles"),
            F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
            ((F.col("size") == 0) | ((F.col("tid") == F.col("first_tid")) & F.col("doc_id").eqNullSafe(F.col("component")))).alias("first"),
        )
    )


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id; texts without words all stay, repeated rows once."""
    found, tid, first = column_names(docs, "found", "tid", "first")
    keep = cluster(docs, n, percent, doc_id, text).filter("first").select(
        F.col("doc_id").alias(found), F.col("text_hash").alias(tid), F.col("n_shingles").alias(first)
    ).distinct()
    mine = column_names(docs, "mine")[0]
    rows = docs.withColumn(mine, F.xxhash64(text_key(text_or_empty(text))))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(found)) & (F.col(mine) == F.col(tid))
    return rows.join(keep, same).dropDuplicates([doc_id, mine]).select(*docs.columns)


# The same join as SQL text: sets that share a shingle are compared, and components grow along the links.
CLUSTER_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, case when len(words) = 0 then []::varchar[] when len(words) < 3 then [array_to_string(words, ' ')]
  else list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i+2], ' '))) end as grams from w),
g as (select doc_id, len(grams) as n, unnest(grams) as gram from s),
c as (select x.doc_id as a, y.doc_id as b, any_value(x.n) as m, any_value(y.n) as n, count(*) as inter from g x join g y on x.gram = y.gram and x.doc_id < y.doc_id
  and 100 * x.n >= 90 * y.n and 100 * y.n >= 90 * x.n group by 1, 2),
l as (select a, b from c where 100 * inter >= 90 * (m + n - inter)),
e as (select a, b from l union all select b, a from l),
r(doc_id, reached) as (select doc_id, doc_id from s union select r.doc_id, e.b from r join e on r.reached = e.a)
select s.doc_id, len(grams)::bigint as n_shingles, min(reached) as component_id from s join r on s.doc_id = r.doc_id group by s.doc_id, grams
"""

"""Phrases that occur together: counts of all orders from the longest windows alone.

Every word opens one window: itself and the words that lead it, padded where its piece ends. Only these longest windows are counted;
a phrase of fewer words is a prefix of windows, so Spark's ROLLUP over the window's columns sums them to the counts of all shorter phrases, of the
words and of the language, and no n-grams of other orders are ever listed.

Most windows are rare, so they do not travel as rows. A task counts the windows of a block of texts and packs them by shard, coded by a word list
of the pack. A shard adds its packs up and shortens each window to its longest prefix that is frequent enough to matter: what is cut off becomes padding,
and the counts of shorter prefixes stay exact. What is left, a small part of the windows, goes through the ROLLUP.

Shards follow the first word. A word that holds more than a shard's share is dealt by its second word too, and such a pair by its third; those words
and pairs (at most as many as there are shards, each) are found in a pass before, and their prefixes are never shortened away inside one shard.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import slices, text_or_empty
from harrow.llm.jaccard_join import mixed
from harrow.operators.lookup import lookup_join
from harrow.runtime import stabilise

# Characters of text a task counts at once at most (a quarter of them where only frequent words are looked for), and bytes of text whose windows make up a shard
BLOCK_CHARS = 4 << 20
SHARD_BYTES = 16 << 20
# Parts of a shard that are added up one after the other
PARTS = 8
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Block:
    """Words of some texts: ``words`` (the different ones), ``codes``, ``langs`` (names) and ``lang`` of each word, ``piece`` of each word."""

    def __init__(self, texts: list[str], langs: list[str]):
        raw = [t.encode() for t in texts]
        data = _LOWER[np.frombuffer(b"\n".join(raw), np.uint8)]
        kind = _KIND[data]
        inside = kind == 0
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        begin, end = (np.flatnonzero(edge == side).astype(np.int32) for side in (1, -1))
        offsets = np.zeros(len(begin) + 1, np.int32)
        np.cumsum(end - begin, out=offsets[1:])
        del edge, end
        coded = pa.BinaryArray.from_buffers(
            pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]
        ).dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[begin] if len(begin) else np.zeros(0, np.int32)
        starts = np.cumsum([0, *[len(t) + 1 for t in raw[:-1]]])
        names = {name: k for k, name in enumerate(dict.fromkeys(langs))}
        of_text = np.array([names[x] for x in langs], np.int32)
        self.langs = list(names)
        self.lang = of_text[np.searchsorted(starts, begin, side="right") - 1] if len(begin) else np.zeros(0, np.int32)

    def windows(self, order: int) -> list[np.ndarray]:
        """The lead columns: codes plus one of the words from each word on, 0 past the end of its piece."""
        columns = [self.codes + 1]
        for ahead in range(1, order):
            column = np.zeros_like(self.codes)
            near = self.piece[ahead:] == self.piece[:-ahead] if ahead < len(self.codes) else np.zeros(0, bool)
            column[: len(near)] = np.where(near, self.codes[ahead:] + 1, 0)
            columns.append(column)
        return columns


def _blocks(batches, most: int, text: str = "text", lang: str = "lang"):
    """Blocks of ``most`` characters at most, half of them at least; a longer text is a block of its own."""
    texts, langs, size = [], [], 0
    for part in slices(batches, text, most):
        own = part.column(text).to_pylist()
        texts += own
        langs += part.column(lang).to_pylist()
        size += sum(map(len, own))
        if 2 * size >= most:
            yield Block(texts, langs)
            texts, langs, size = [], [], 0
    if texts:
        yield Block(texts, langs)


def _frequent(shards: int):
    """Words and pairs that hold at least a shard's share of a block; the row without words counts all."""
    schema = pa.schema([("lang", pa.string()), ("w1", pa.binary()), ("w2", pa.binary()), ("n", pa.int64())])

    def find(batches):
        for block in _blocks(batches, BLOCK_CHARS // 4):
            total, size = len(block.codes), len(block.words) + 1
            first, second = block.windows(2)
            rows = [(None, None, None, total)]
            opening = block.lang.astype(np.int64) * size + first
            word, n = np.unique(opening, return_counts=True)
            often = word[n * shards >= total]
            for key, count in zip(often.tolist(), n[n * shards >= total].tolist()):
                rows.append((block.langs[key // size], block.words[key % size - 1].as_py(), None, count))
            # a frequent pair starts with a frequent word and ends with one of them, if it stands for a shard's share
            both = np.isin(opening, often) & np.isin(block.lang.astype(np.int64) * size + second, often)
            keys, n = np.unique(np.searchsorted(often, opening[both]) * size + second[both], return_counts=True)
            for key, count in zip(keys[n * shards >= total].tolist(), n[n * shards >= total].tolist()):
                opens = int(often[key // size])
                rows.append((block.langs[opens // size], block.words[opens % size - 1].as_py(), block.words[key % size - 1].as_py(), count))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return find


def _order(columns: list[np.ndarray]) -> np.ndarray:
    """Order of the rows by the columns of small non-negative numbers: one number per row where 64 bits hold it."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 64:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), np.uint64)
    for column, width in zip(columns, bits):
        key = (key << np.uint64(width)) | column.astype(np.uint64)
    return np.argsort(key)


def _prefix_starts(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Of sorted rows: for each number of leading columns, where their values change."""
    change, out = np.zeros(len(columns[0]), bool), []
    change[:1] = True
    for column in columns:
        change = change.copy()
        change[1:] |= column[1:] != column[:-1]
        out.append(change)
    return out


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(raw: bytes, kind=np.int32) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


_DEALT = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("windows", pa.list_(pa.binary()))])


def _hot_keys(hot: list[tuple[str, bytes, bytes | None]], langs: list[str], words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the hot words, ``lang * size + code``, and of the hot pairs, ``(lang * size + code) * size + code``; codes count from 1."""
    size, places = len(words) + 1, {name: k for k, name in enumerate(langs)}

    def codes(own: list[bytes]) -> np.ndarray:
        at = pc.index_in(pa.array(own, words.type), value_set=words)
        return pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    lang = np.array([places.get(a, -1) for a, _, _ in hot], np.int64)
    first, second = codes([w for _, w, _ in hot]), codes([v or b"" for _, _, v in hot])
    single = np.array([v is None for _, _, v in hot], bool)
    found = (lang >= 0) & (first > 0)
    one, two = found & single, found & ~single & (second > 0)
    return (lang * size + first)[one], ((lang * size + first) * size + second)[two]


def _deal(order: int, shards: int, hot: list[tuple[str, bytes, bytes | None]]):
    """Counted windows of each block by shard and language."""
    def shards_of(block: Block, size: int, lang: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        hashes = np.array([0, *[xxhash.xxh3_64_intdigest(w) for w in block.words.to_pylist()]], np.uint64)
        names = np.array([xxhash.xxh3_64_intdigest(x) for x in block.langs], np.uint64)
        number = mixed(hashes[columns[0]] + names[lang] * _STEPS[0])
        one, two = _hot_keys(hot, block.langs, block.words)
        opening = lang.astype(np.int64) * size + columns[0]
        split = np.isin(opening, one)
        number[split] = mixed(number[split] + hashes[columns[1][split]] * _STEPS[1])
        if order > 2 and len(two):
            again = split & np.isin(opening * size + columns[1], two)
            number[again] = mixed(number[again] + hashes[columns[2][again]] * _STEPS[0])
        # the parts of a shard follow one another
        return (number % np.uint64(shards * PARTS)).astype(np.int64)

    def deal(batches):
        for block in _blocks(batches, BLOCK_CHARS):
            if not len(block.codes):
                continue
            size = len(block.words) + 1
            columns = block.windows(order)
            by = _order([block.lang, *columns])
            lang, *columns = (c[by] for c in (block.lang, *columns))
            first = np.flatnonzero(_prefix_starts([lang, *columns])[-1])
            counts = np.diff(np.append(first, len(by))).astype(np.int32)
            lang, *columns = (c[first] for c in (lang, *columns))
            part = shards_of(block, size, lang, columns)
            pack = part // PARTS * len(block.langs) + lang
            kept = np.lexsort((part, pack))
            cut = np.flatnonzero(np.diff(pack[kept], prepend=-1))
            out = []
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(kept)]):
                mine = kept[lo:hi]
                used = np.zeros(size, bool)
                for column in columns:
                    used[column[mine]] = True
                used[0] = False
                number = np.cumsum(used, dtype=np.int32)
                number[0] = 0
                body = np.stack([*[number[c[mine]] for c in columns], counts[mine]])
                edges = np.searchsorted(part[mine] % PARTS, np.arange(PARTS + 1))
                own = block.words.take(pa.array(np.flatnonzero(used) - 1))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), b" ")[0].as_py()
                out.append((
                    int(part[mine[0]]) // PARTS, block.langs[lang[mine[0]]], zstandard.ZstdCompressor(level=1).compress(joined),
                    [_pack(body[:, a:b]) for a, b in zip(edges[:-1], edges[1:])],
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DEALT)], schema=_DEALT)

    return deal


def _shorten(order: int, least: int, hot: list[tuple[str, bytes, bytes | None]]):
    """Add up a shard's packs; windows shrink to their longest prefix with ``least`` occurrences or of a hot word or pair."""
    fields = [("lang", pa.string()), *[(f"w{k + 1}", pa.string()) for k in range(order)], ("n", pa.int64())]

    def shortened(rows: np.ndarray, langs: list[str], told: tuple[np.ndarray, np.ndarray], texts: pa.Array) -> list[pa.Table]:
        """Tables of shortened windows by their depth; ``rows`` are the language, the codes and the number of each window."""
        rows = rows[:, _order(list(rows[: order + 1]))]
        changes = _prefix_starts(list(rows[: order + 1]))
        first = np.flatnonzero(changes[-1])
        n = np.add.reduceat(rows[order + 1].astype(np.int64), first)
        kept, changes = rows[: order + 1, first], [c[first] for c in changes]
        out = []
        depth, alive = np.zeros(len(first), np.int64), np.ones(len(first), bool)
        groups = [np.cumsum(c) - 1 for c in changes]
        for level in range(1, order + 1):
            starts = np.flatnonzero(changes[level])
            enough = np.add.reduceat(n, starts) >= least
            if level < 3:
                prefix = kept[0, starts].astype(np.int64)
                for column in kept[1 : level + 1]:
                    prefix = prefix * len(texts) + column[starts]
                enough |= np.isin(prefix, told[level - 1])
            alive &= enough[groups[level]] & (kept[level] > 0)
            depth[alive] = level
        for level in range(order + 1):
            mine = np.flatnonzero(depth == level)
            if not len(mine):
                continue
            group = groups[level][mine]
            begin = np.flatnonzero(np.diff(group, prepend=-1))
            some = kept[:, mine[begin]].copy()
            some[level + 1 :] = 0
            out.append(pa.table(
                [pa.array([langs[k] for k in some[0].tolist()], pa.string()), *[texts.take(pa.array(some[k])) for k in range(1, order + 1)],
                 pa.array(np.add.reduceat(n[mine], begin))], schema=pa.schema(fields),
            ))
        return out

    def shorten(packs: pa.Table) -> pa.Table:
        names = {name: k for k, name in enumerate(dict.fromkeys(packs.column("lang").to_pylist()))}
        langs = list(names)
        blobs = pa.array([zstandard.ZstdDecompressor().decompress(w) for w in packs.column("words").to_pylist()], pa.large_binary())
        lists = pc.split_pattern(blobs, pattern=b" ")
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        tables = [
            np.concatenate(([0], codes[lo:hi] + 1)).astype(np.int32) for lo, hi in zip(lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:])
        ]
        told = _hot_keys(hot, langs, words)
        texts = pa.concat_arrays([pa.array([""]), words.cast(pa.large_string()).cast(pa.string())])
        of_pack = [names[name] for name in packs.column("lang").to_pylist()]
        out = []
        for part in range(PARTS):
            rows = []
            for table, lang, windows in zip(tables, of_pack, packs.column("windows")):
                body = _unpack(windows[part].as_py()).reshape(order + 1, -1)
                rows.append(np.concatenate([np.full((1, body.shape[1]), lang, np.int32), table[body[:order]], body[order:]]))
            rows = np.concatenate(rows, axis=1)
            if rows.shape[1]:
                out += shortened(rows, langs, told, texts)
        return pa.concat_tables(out)

    return shorten


def phrase_counts(docs: DataFrame, order: int = 3, least: int = 10, lang: str = "lang", text: str = "text") -> DataFrame:
    """(``lang``, ``w1`` .. ``w<order>``, ``words``, ``n``): phrases of up to ``order`` words with ``least`` occurrences, written to the shared folder.

    ``words`` is the number of words, 0 for the count of all words of a language, which is there whatever it is; columns past the phrase are null.
    """
    if order < 2:
        raise ValueError("order is 2 at least")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, math.ceil(size / SHARD_BYTES))
    found = rows.mapInArrow(_frequent(shards), "lang string, w1 binary, w2 binary, n long").groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n"))
    found = stabilise(found)
    total = found.filter("w1 is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most as many words, and as many pairs, as there are shards
    hot = [(r.lang, bytes(r.w1), r.w2 and bytes(r.w2)) for r in found.filter(F.col("w1").isNotNull() & (F.col("n") * shards >= total)).collect()] if shards > 1 else []
    columns = ["lang", *[f"w{k + 1}" for k in range(order)]]
    windows = (
        rows.mapInArrow(_deal(order, shards, hot), "shard int, lang string, words binary, windows array<binary>")
        .repartition(shards, "shard").groupBy("shard")
        .applyInArrow(_shorten(order, least, hot), ", ".join(f"{c} string" for c in columns) + ", n long")
    )
    rolled = windows.rollup(*columns).agg(F.sum("n").alias("n"), F.grouping_id().alias("rolled"))
    # the grouping id has a bit for each column summed over: 0, 1, 3, 7 ... for all columns, all but one ...
    depth = F.lit(order) - F.bit_count(F.col("rolled")).cast("int")
    last = F.element_at(F.array(F.lit("="), *columns[1:]), depth + 1)
    counted = rolled.withColumn("words", depth).filter("words >= 0").filter((last != "") & ((F.col("words") == 0) | (F.col("n") >= least)))
    return stabilise(counted.select(*columns, "words", "n"))


def _joined(names: list[str]) -> Column:
    return F.concat_ws(" ", *names)


def collocations(
    docs: DataFrame, order: int = 3, least: int = 10, cover_percent: int = 50, top: int | None = 2000, lang: str = "lang", text: str = "text",
) -> DataFrame:
    """The phrases of each language that hold together best: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase of 2 to ``order`` words with ``a`` >= ``least`` occurrences scores floor(1000000 a a / (l r)) at the cut into two parts, with ``l`` and ``r`` occurrences, that scores least (ties: the
    shortest first part). A phrase inside a longer one with at least ``cover_percent`` of its occurrences goes. Order: score and ``a`` descending,
    then the phrase by bytes; ``top`` of them per language, all if None. A null language is ``und``, a null text has no words. Repeated rows count each. An empty table has no phrases.
    """
    counts = phrase_counts(docs, order, least, lang, text)
    names = [f"w{k + 1}" for k in range(order)]
    grams = counts.filter("words > 0").select("lang", _joined(names).alias("part"), F.col("n").alias("of"))
    cuts = []
    for length in range(2, order + 1):
        own = counts.filter(F.col("words") == length)
        for k in range(1, length):
            cuts.append(own.select(
                "lang", _joined(names[:length]).alias("phrase"), F.col("n").alias("a"), F.lit(k).alias("k"),
                _joined(names[:k]).alias("left_part"), _joined(names[k:length]).alias("right_part"),
            ))
    table = stabilise(reduce(DataFrame.unionByName, cuts))
    table = lookup_join(table, grams.select("lang", F.col("part").alias("left_part"), F.col("of").alias("l")), ["lang", "left_part"], "inner")
    table = lookup_join(table, grams.select("lang", F.col("part").alias("right_part"), F.col("of").alias("r")), ["lang", "right_part"], "inner")
    # decimals of 19 digits have products of 38: exact up to 3e15 occurrences
    wide = {c: F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r")}
    exact = table.withColumn("top_part", (wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")).withColumn(
        "low_part", (wide["l"] * wide["r"]).cast("decimal(38,0)")
    ).withColumn("score", F.expr("cast(top_part div low_part as bigint)"))
    best = exact.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    covers = []
    for length in range(3, order + 1):
        own = counts.filter(F.col("words") == length)
        for short in range(2, length):
            for start in range(length - short + 1):
                covers.append(own.select("lang", _joined(names[start : start + short]).alias("phrase"), F.col("n").alias("longer")))
    if covers:
        longest = reduce(DataFrame.unionByName, covers).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        best = best.join(longest, ["lang", "phrase"], "left").filter(
            F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a"))
        )
    best = lookup_join(best, counts.filter("words = 0").select("lang", F.col("n").alias("all_words")), "lang", "inner")
    flat = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("all_words").alias("n"), F.col("cut.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    # Spark limits each language inside the tasks before it deals the rows by language
    ranked = flat.withColumn("rank", rank)
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATION_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
g1 as (select lang, unnest(ws) as phrase from w),
n as (select lang, count(*) as n from g1 group by 1),
g2 as (select lang, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as phrase from w where len(ws) > 1),
g3 as (select lang, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as phrase from w where len(ws) > 2),
f as materialized (select lang, phrase, count(*) as f, len(string_split(phrase, ' ')) as k from (select * from g1 union all select * from g2 union all select * from g3) group by 1, 2),
c as materialized (select lang, phrase, f as a, string_split(phrase, ' ') as ws, k as words from f where k > 1 and f >= {least}),
u as materialized (select lang, phrase, a, words, cut, lang || chr(10) || array_to_string(ws[:cut], ' ') as left_key, lang || chr(10) || array_to_string(ws[cut + 1:], ' ') as right_key
  from (select *, unnest(range(1, words)) as cut from c)),
k as materialized (select lang || chr(10) || phrase as key, f from f),
v as materialized (select u.*, k.f as l from u join k on k.key = left_key),
s as (select v.lang, v.phrase, a, words, cut, l, k.f as r, (1000000::hugeint * a * a // (l::hugeint * k.f)) as score from v join k on k.key = right_key),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
o as (select lang, part as phrase, max(a) as longer from (select lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) as part from c where words = 3) group by 1, 2),
t as (select b.lang, b.phrase, a, l, r, n, score::bigint as score from b join n on n.lang = b.lang left join o on o.lang = b.lang and o.phrase = b.phrase
  where longer is null or 100 * longer < {cover_percent} * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from t
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= {top}
"""


def collocation_sql(least: int = 10, cover_percent: int = 50, top: int = 2000) -> str:
    return COLLOCATION_SQL.replace("{least}", str(least)).replace("{cover_percent}", str(cover_percent)).replace("{top}", str(top))

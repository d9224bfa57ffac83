"""Quality by perplexity: an interpolated modified Kneser-Ney model of character 4-grams of trusted text.

Counts of the trusted texts are summed over shards of n-grams; continuation counts, context totals and discounts are aggregates
of them, and each order's probabilities come from joins of n-grams with their contexts and with the next lower
order (Chen and Goodman 1998). To score, every block of documents (dealt by hash) lists its distinct n-grams, these are joined with the
model's counts once, and the block's documents add up the logarithms. The threshold is a quantile of each language's documents.

An n-gram is two columns: ``ctx``, the code points of up to three characters with 21 bits each, and ``sym``, the code point that follows. So no two
characters are alike, however many there are. Inside a task they have numbers of 16 bits, in the order in which the task meets them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import slices, text_or_empty
from harrow.llm.language import merge
from harrow.runtime import stabilise

ORDER = 4
# Bits of a code point, and code points there are
BITS, POINTS = 21, 0x110000
# Characters of text in a block
BLOCK_CHARS = 24 << 20
HELD = 1 << 21
# Compression of a block's texts
LEVEL = 6
# Trusted ids (8 bytes each) that are broadcast; beyond that trusted texts are found by one join
BROADCAST_IDS = 1_000_000


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(" ".join(text.split()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def stretch(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, white space as one blank and three blanks before each; and where their 4-grams begin."""
    parts, begins, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for text in texts:
        own = np.concatenate((np.full(ORDER - 1, 32, np.int64), _codes(text)))
        parts.append(own)
        begins.append(np.arange(at, at + len(own) - ORDER + 1))
        at += len(own)
    return np.concatenate(parts), np.concatenate(begins)


def windows(code: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ctx`` and ``sym`` of the 4-grams."""
    ctx = np.zeros(len(begins), np.int64)
    for k in range(ORDER - 1):
        ctx = (ctx << BITS) | code[begins + k]
    return ctx, code[begins + ORDER - 1]


class Letters:
    """Numbers of 16 bits for the characters a task has met; a 4-gram of them is one number of 64 bits."""

    def __init__(self):
        self.table, self.chars = np.full(POINTS, -1, np.int64), np.zeros(0, np.int64)

    def add(self, code: np.ndarray) -> bool:
        """Whether there are numbers for all of them."""
        new = np.zeros(POINTS, bool)
        new[code] = True
        new = np.flatnonzero(new & (self.table < 0))
        if len(self.chars) + len(new) > 1 << 16:
            return False
        self.table[new] = np.arange(len(self.chars), len(self.chars) + len(new))
        self.chars = np.concatenate((self.chars, new))
        return True

    def pack(self, columns: Iterable[np.ndarray]) -> np.ndarray:
        out = np.uint64(0)
        for column in columns:
            out = (out << np.uint64(16)) | self.table[column].astype(np.uint64)
        return out

    def unpack(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = [self.chars[((grams >> np.uint64(16 * (ORDER - 1 - k))) & np.uint64(0xFFFF)).astype(np.int64)] for k in range(ORDER)]
        ctx = each[0]
        for column in each[1:-1]:
            ctx = (ctx << BITS) | column
        return ctx, each[-1]


def _characters(ctx: np.ndarray, sym: np.ndarray) -> list[np.ndarray]:
    return [*[(ctx >> (BITS * (ORDER - 2 - k))) & ((1 << BITS) - 1) for k in range(ORDER - 1)], sym]


def _tallies(parts: Iterable[tuple[int, list[str]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, ``ctx``, ``sym``, number) of the distinct 4-grams of the texts of each key, as far as they were held together; keys come one after the other."""
    letters, held = Letters(), {}

    def out():
        for key, (grams, n) in held.items():
            yield key, *letters.unpack(grams), n
        held.clear()

    for key, texts in parts:
        if key not in held:
            yield from out()
        code, begins = stretch(texts)
        if not letters.add(code):
            yield from out()
            letters = Letters()
            if not letters.add(code):  # more characters than 16 bits number: count the pairs themselves
                ctx, sym = windows(code, begins)
                pairs, n = np.unique(np.stack([ctx, sym]), axis=1, return_counts=True)
                yield key, pairs[0], pairs[1], n
                letters = Letters()
                continue
        own = np.unique(letters.pack(code[begins + k] for k in range(ORDER)), return_counts=True)
        held[key] = merge([held[key], own]) if key in held else own
        if sum(len(g) for g, _ in held.values()) > HELD:
            yield from out()
    yield from out()


def _zipped(*names: str):
    """Rows whose ``text`` becomes ``z``, compressed."""

    def shrink(batches):
        for part in slices(batches):
            packed = [zstandard.ZstdCompressor(level=3).compress(t.encode()) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(packed, pa.binary())], [*names, "z"])

    return shrink


def trusted_texts(docs: DataFrame, trusted: DataFrame, most_ids: int = BROADCAST_IDS) -> DataFrame:
    """(``text``) of every document whose id is in ``trusted``, a row for each.

    Up to ``most_ids`` different ids are broadcast; more of them meet the compressed texts in one join, which is written.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ids = stabilise(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct())
    if ids.count() <= most_ids:
        return rows.join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    small = rows.where("doc_id is not null").mapInArrow(_zipped("doc_id"), "doc_id long, z binary")
    found = stabilise(small.join(ids.hint("shuffle_merge"), "doc_id", "left_semi").select("z"))

    def restore(batches):
        for batch in batches:
            texts = [zstandard.ZstdDecompressor().decompress(z).decode() for z in batch.column("z").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])

    return found.mapInArrow(restore, "text string")


def count_trusted(docs: DataFrame, trusted: DataFrame, most_ids: int = BROADCAST_IDS) -> DataFrame:
    """(``ctx``, ``sym``, ``n``) over all trusted documents."""

    def count(batches):
        for _, ctx, sym, n in _tallies((0, part.column("text").to_pylist()) for part in slices(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(ctx, pa.int64()), pa.array(sym, pa.int32()), pa.array(n, pa.int64())], ["ctx", "sym", "n"])

    texts = trusted_texts(docs, trusted, most_ids)
    return texts.mapInArrow(count, "ctx long, sym int, n long").groupBy("ctx", "sym").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Discounts of grams seen once, twice, and more often, from how many grams occur one to four times."""
    row = counts.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{k}"] for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.1), k - 0.05 if k == 1 else float(k)) for k, d in zip((1, 2, 3), raw))


class Model:
    """Tables of each order: ``direct`` (``ctx``, ``sym``, p without the lower order) and ``back`` (``ctx``, weight of the lower order)."""

    def __init__(self, counts: DataFrame):
        self.direct, self.back = {}, {}
        table = counts
        for order in range(ORDER, 0, -1):
            table = stabilise(table)
            d1, d2, d3 = _discounts(table)
            off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
            back = table.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum(off).alias("given")).select(
                "ctx", "total", (F.col("given") / F.col("total")).alias("back")
            )
            self.back[order] = stabilise(back)
            self.direct[order] = stabilise(
                table.join(self.back[order], "ctx").select("ctx", "sym", (F.greatest(F.col("n") - off, F.lit(0.0)) / F.col("total")).alias("p"))
            )
            if order == 1:  # the characters counted, and one for all others
                self.base = 1.0 / (table.count() + 1)
            else:  # each distinct longer gram counts its ending once
                table = table.groupBy(self._shorter(order - 1).alias("ctx"), "sym").agg(F.count("*").alias("n"))

    @staticmethod
    def _shorter(order: int):
        """The context of the gram's last ``order`` characters."""
        return F.col("ctx").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))

    def log_probability(self, asked: DataFrame) -> DataFrame:
        """(``ctx``, ``sym``, ``logp``) of distinct grams: per order the discounted share plus the freed weight times the order below."""
        out = asked.select("ctx", "sym").withColumn("p", F.lit(self.base))
        for order in range(1, ORDER + 1):
            direct = self.direct[order].select(F.col("ctx").alias("own"), "sym", F.col("p").alias("share"))
            back = self.back[order].select(F.col("ctx").alias("own"), "back")
            back = F.broadcast(back) if order == 1 else back  # one row
            out = out.withColumn("own", self._shorter(order)).join(direct, ["own", "sym"], "left").join(back, "own", "left").select(
                "ctx", "sym", (F.coalesce("share", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("p")).alias("p")
            )
        return out.select("ctx", "sym", F.log("p").alias("logp"))


def _scores(texts: list[str], ctx: np.ndarray, sym: np.ndarray, logp: np.ndarray) -> Iterator[float | None]:
    """Perplexity of each text, from the logarithms of all its grams."""
    letters, known = Letters(), _characters(ctx, sym)
    if not letters.add(np.concatenate(known)):
        table = dict(zip(zip(ctx.tolist(), sym.tolist()), logp.tolist()))
        for text in texts:
            own = [table[pair] for pair in zip(*(x.tolist() for x in windows(*stretch([text]))))]
            yield math.exp(-sum(own) / len(own)) if own else None
        return
    gram = letters.pack(known)
    order = np.argsort(gram)
    gram, logp = gram[order], logp[order]
    for text in texts:
        code, begins = stretch([text])
        own = letters.pack(code[begins + k] for k in range(ORDER))
        yield float(np.exp(-logp[np.searchsorted(gram, own)].mean())) if len(begins) else None


def _texts(row: dict) -> list[str]:
    """The texts of one row of ``_packed``."""
    raw, ends = zstandard.ZstdDecompressor().decompress(row["z"]), np.cumsum([0, *row["sizes"]]).tolist()
    return [raw[a:b].decode() for a, b in zip(ends, ends[1:])]


def _packed(batches):
    """Of each slice the texts of a block as one row, compressed together, which takes less room than one by one."""
    for part in slices(batches):
        rows = part.to_pydict()
        blocks: dict[int, list[int]] = {}
        for row, grp in enumerate(rows["grp"]):
            blocks.setdefault(grp, []).append(row)
        raw = [t.encode() for t in rows["text"]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(blocks), pa.int64()),
                *[pa.array([[rows[c][k] for k in own] for own in blocks.values()], pa.list_(kind)) for c, kind in (("doc_id", pa.int64()), ("lang", pa.string()))],
                pa.array([[len(raw[k]) for k in own] for own in blocks.values()], pa.list_(pa.int64())),
                pa.array([zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(raw[k] for k in own)) for own in blocks.values()], pa.binary()),
            ],
            ["grp", "doc_ids", "langs", "sizes", "z"],
        )


def perplexities(docs: DataFrame, model: Model, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(``doc_id``, ``lang``, ``n_grams``, ``perplexity``) of every whole text; null without a character.

    Documents are dealt to blocks of about ``block_chars`` by id and text. The texts are sent to their blocks twice, to list the n-grams and to add
    up the answers, but what was sent first is gone by then: they take room once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    total = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    grp = F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(max(1, math.ceil(total / block_chars)))).alias("grp")
    packed = rows.select(grp, "doc_id", "lang", "text").mapInArrow(_packed, "grp long, doc_ids array<long>, langs array<string>, sizes array<long>, z binary")

    def listed(key: tuple[pa.Scalar, ...], texts: pa.Table) -> pa.Table:
        """The distinct 4-grams of a block."""
        found = list(_tallies((0, _texts(row)) for row in texts.select(["sizes", "z"]).to_pylist()))
        ctx, sym = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (1, 2))
        return pa.table({"block": pa.array(np.full(len(ctx), key[0].as_py())), "ctx": pa.array(ctx, pa.int64()), "sym": pa.array(sym, pa.int32())})

    asked = stabilise(packed.groupBy("grp").applyInArrow(listed, "block long, ctx long, sym int"))
    known = model.log_probability(asked.select("ctx", "sym").distinct())
    answers = asked.join(known, ["ctx", "sym"]).select("block", "ctx", "sym", "logp")

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        rows = texts.to_pylist()
        ids, langs, whole = ([x for own in each for x in own] for each in ([r["doc_ids"] for r in rows], [r["langs"] for r in rows], map(_texts, rows)))
        value = list(_scores(whole, known.column("ctx").to_numpy(), known.column("sym").to_numpy().astype(np.int64), known.column("logp").to_numpy()))
        n = [len(_codes(t)) for t in whole]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "n_grams": pa.array(n, pa.int64()), "perplexity": pa.array(value, pa.float64())})

    return packed.groupBy("grp").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, lang string, n_grams long, perplexity double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.95) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``lang``, ``n_grams``, ``perplexity``, ``threshold`` of its language, ``kept``.

    Trusted are documents with a label of quality 1; repeated labels count once, repeated rows each, null ids are never trusted. A null language
    is a language of its own. A text without a character has no perplexity and is not kept. Without trusted text every
    n-gram is as likely as any other and all texts with characters are kept. The threshold is Spark's approximate quantile, a ten-thousandth of the rows off at most.
    """
    model = Model(count_trusted(docs, labels.filter("quality = 1")))
    scored = stabilise(perplexities(docs, model))
    limits = stabilise(scored.groupBy(F.col("lang").alias("of")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")))
    few = limits.count() <= 10_000
    return scored.join(F.broadcast(limits) if few else limits, F.col("lang").eqNullSafe(F.col("of"))).select(
        "doc_id", "lang", "n_grams", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept")
    )

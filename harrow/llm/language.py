"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent 1- to 3-grams of letters, by falling count.
A text gets the language whose profile is nearest by the out-of-place distance: the sum over
the text's most frequent n-grams of how far their ranks lie apart, with the
profile's length for an n-gram that the profile does not have (Cavnar and Trenkle 1994).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import column_names, slices, text_or_empty

# n-grams in a profile, and of a text that are compared
PROFILE_SIZE = 400
UNKNOWN = "und"

_BITS = 21
_EDGE = 0x1FFFFF  # stands for the gap between words; no character has this code
_STEP = 1 << 20  # characters counted at once
_HELD = 1 << 21  # n-grams a task holds before it hands counts on
_LANGUAGES = 10_000  # profiles a task can hold; more is an error, never a cut


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code of every letter, ``_EDGE`` for any other character."""
    table = np.full(0x110000, _EDGE, np.int64)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def symbols(text: str) -> np.ndarray:
    """Letters of ``text`` in lower case with one edge before, between and after words; empty if it has no letter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = _letters()[codes]
    low = np.concatenate(([_EDGE], low, [_EDGE]))
    edge = low == _EDGE
    low = low[~(edge & np.concatenate(([False], edge[:-1])))]
    return low if len(low) > 1 else low[:0]


def _tally(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (as one number) and their counts; ``columns`` are their first, second, third symbols."""
    first, size = columns[0], len(columns)
    alphabet = np.unique(np.concatenate((first[:1], *[c for c in columns]))) if size > 1 else np.unique(first)
    k = len(alphabet)
    if k**size <= 1 << 16 or k**size <= 4 * len(first):
        small = np.zeros(len(first), np.int64)
        for column in columns:
            small = small * k + np.searchsorted(alphabet, column)
        counts = np.bincount(small, minlength=k**size)
        found = np.flatnonzero(counts)
        grams = np.zeros(len(found), np.int64)
        for place in range(size - 1, -1, -1):
            grams = (grams << _BITS) | alphabet[found // k**place % k]
        return grams, counts[found]
    grams = np.zeros(len(first), np.int64)
    for column in columns:
        grams = (grams << _BITS) | column
    return np.unique(grams, return_counts=True)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    counts = np.zeros(len(grams), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in parts]))
    return grams, counts


def count_grams(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams within words (edges count as their first or last symbol), ascending, and their counts."""
    parts = []
    for at in range(0, len(low), _STEP):
        a, b, c = low[at : at + _STEP], low[at + 1 : at + 1 + _STEP], low[at + 2 : at + 2 + _STEP]
        one = a[a != _EDGE]
        inner = b[: len(c)] != _EDGE
        own = [[one]] if len(one) else []
        own += [[a[: len(b)], b]] if len(b) else []
        own += [[a[: len(c)][inner], b[: len(c)][inner], c[inner]]] if inner.any() else []
        # numbers of longer n-grams are larger, so the three lists follow each other in order
        tallies = [_tally(x) for x in own]
        if tallies:
            parts.append((np.concatenate([g for g, _ in tallies]), np.concatenate([n for _, n in tallies])))
    return merge(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def most_frequent(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` n-grams of highest count, ties by n-gram; ``grams`` ascend."""
    top = -counts
    order = np.argsort(top.astype(np.int16) if len(top) and -top.min() < 32768 else top, kind="stable")
    return grams[order[:size]]


def learn_profiles(
    docs: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE_SIZE
) -> DataFrame:
    """(``lang``, ``rank`` from 1, ``gram``, ``n``) from all rows with a language and a text.

    Tasks count n-grams by language before the shuffle, and cut to ``size`` per language before the last one.
    """

    def count(batches):
        held: dict[str, list] = {}

        def rows():
            for name, parts in held.items():
                grams, counts = merge(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(counts, pa.int64())],
                    ["lang", "gram", "n"],
                )
            held.clear()

        for part in slices(batches):
            by: dict[str, list[np.ndarray]] = {}
            for name, own in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                by.setdefault(name, []).append(symbols(own))
            for name, own in by.items():
                # the edge at the end of a text and the one before the next are one edge
                joined = np.concatenate([x[1:] if k else x for k, x in enumerate(x for x in own if len(x))] or [np.zeros(0, np.int64)])
                if len(joined):
                    held[name] = [merge([*held.get(name, []), count_grams(joined)])]
            if sum(len(p[0][0]) for p in held.values()) > _HELD:
                yield from rows()
        yield from rows()

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).dropna()
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


class Profiles:
    """Ranks of all profiles' n-grams, one row for each language in order of name."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.names = size, sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([gram for _, _, gram in rows], np.int64))
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        place = {name: k for k, name in enumerate(self.names)}
        for lang, rank, gram in rows:
            self.ranks[place[lang], np.searchsorted(self.grams, gram)] = rank

    def nearest(self, text: str | None) -> tuple[str, float]:
        """Language and closeness: 1 for the profile's own order, 0 for nothing in common. Ties go to the first name."""
        low = symbols(text or "")
        if not len(low) or not self.names:
            return UNKNOWN, 0.0
        own = most_frequent(*count_grams(low), self.size)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[:, at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(1, len(own) + 1)))
        total = np.minimum(apart, self.size).sum(axis=1)
        best = int(total.argmin())
        return self.names[best], float(1 - total[best] / (self.size * len(own)))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE_SIZE) -> Profiles:
    """Profiles of the labelled rows: ``size`` n-grams for each language, so their size does not grow with the rows."""
    ranked = learn_profiles(docs, lang, text, size).select("lang", "rank", "gram").limit(_LANGUAGES * size + 1).collect()
    if len(ranked) > _LANGUAGES * size:
        raise ValueError(f"more than {_LANGUAGES} languages")
    return Profiles([tuple(r) for r in ranked], size)


def predict(
    docs: DataFrame, profiles: Profiles, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Columns ``keep`` with the predicted language and its score of every whole text.

    A null text, a text without a letter, and every text when nothing was learned are ``und`` with score 0.
    Repeated rows and null ids stay.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    shape = docs.select(*keep).schema
    fields = [*shape.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]
    whole = column_names(docs, "whole")[0]

    def name(batches):
        for part in slices(batches, whole):
            found = [profiles.nearest(t) for t in part.column(whole).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(i) for i in range(part.num_columns - 1)],
                    pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64()),
                ],
                [f.name for f in fields],
            )

    return docs.select(*keep, text_or_empty(text).alias(whole)).mapInArrow(name, StructType(fields))


def held_out(doc_id: str = "doc_id"):
    """Rows whose id's checksum leaves 2 when divided by 4 are never learned from (a null id is learned from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """(``doc_id``, ``held_out``, ``lang_pred``, ``score``): profiles from the rows that are not held out, applied to all."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    profiles = fit(rows.filter(~held_out()))
    return predict(rows, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float = 0.3, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` without the texts that are like no language learned from them; a null ``lang`` gets the predicted one.

    Rejected are texts without a letter and texts closer than ``min_score`` to no profile. Without any labelled text nothing is rejected.
    """
    profiles = fit(docs.filter(~held_out(doc_id)), lang, text)
    if not profiles.names:
        return docs
    pred, score = column_names(docs, "lang_pred", "score")
    found = predict(docs, profiles, text, tuple(docs.columns), (pred, score))
    return (
        found.filter((F.col(pred) != UNKNOWN) & (F.col(score) >= min_score))
        .withColumn(lang, F.coalesce(F.col(lang), F.col(pred))).select(*docs.columns)
    )

"""Helpers the operators share: slices of Arrow batches, bounded word tables, one row per distinct text."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# word characters of the contracts: everything but space, tab, newline, vertical tab, form feed, return
WORD = r"[^\x20\x09-\x0D]+"

# A slice of an Arrow batch that a task turns into Python objects at once; a longer text forms a slice of its own.
SLICE_CHARS = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice have about ``chars`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for row, size in enumerate(sizes):
            if row > start and total + size > chars:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += int(size)
        yield batch.slice(start)


@lru_cache(maxsize=1)
def _trim():
    # only glibc has it
    return getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)


def give_back() -> None:
    """Return the memory that a Python worker no longer needs: it stays for later tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """32 bytes that stand for the whole text."""
    return F.unhex(F.sha2(text, 256))


def column_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names that no column of ``df`` has, for intermediate columns beside the caller's own."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while f"__{name}" in have:
            name = f"_{name}"
        out.append(f"__{name}")
    return out


def distinct_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``text_id``, ``text``): every different text once, under the smallest id that holds it.

    Copies collapse inside each task before the shuffle, so a text that a third of the rows
    hold travels once per task. Null texts count as empty, null ids as the largest of all.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("text_id"), text_or_empty(text).alias("text"))
    return (
        rows.groupBy(text_key(F.col("text")).alias("key"))
        .agg(F.min("text_id").alias("text_id"), F.first("text").alias("text"))
        .select("text_id", "text")
    )

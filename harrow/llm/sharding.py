"""Shards that match the mixture of sources: proportional stratified interleaving.

The rows of each source (the stratum) are ranked in a seeded random order; rank ``r`` of ``n`` rows gets the fraction
``(r + u) / n`` with a start ``u`` in [0, 1) that depends on the seed and the source alone. Sorted by fraction, every source is spread
evenly over the whole order: between two fractions it has its share to within a row. Cutting the order into equal runs gives each shard every
source's share; a cut lies off its fraction by the odd rows of the sources, one each at most.
The starts keep sources of a single row from meeting at one fraction.

No source and no stretch of the order is sorted by one task. With ``N`` rows, the random order is cut into about sqrt(N) cells by the
leading bits of its hash; a row's rank is its place in the cell of its source plus the rows in earlier cells. The order of
fractions is ranked the same way. Equal rows are counted before the first shuffle and unfolded after the ranking.
Everything is a DataFrame expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import column_names, text_or_empty
from harrow.runtime import stabilise

SEED = 20
# Copies that one step unfolds
UNFOLDED = 4096
_WORD = 1 << 32


def _draw(seed: int, *names: str) -> Column:
    """32 hexadecimal digits that depend on the seed and the columns; nulls are left out."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(n).cast("string") for n in names]))


def _leading(digits: Column) -> Column:
    """The first 32 bits as a long."""
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")


def place(
    docs: DataFrame, shards: int = 16, seed: int = SEED, source: str = "source", doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``stratum``, ``row_key``, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``, ``shard``, ``slot``.

    Shards differ by one row at most (the law ``rows``); slots are gapless from 0 in each. The order does not depend on how the table is partitioned.
    A null text has size 1, a null source is a stratum of its own beside the empty name. Repeated rows take places of their own. ``row_key``
    hashes all columns (maps cannot be hashed), to find the whole row again. An empty table gives no rows.
    """
    body = text_or_empty(text)
    size = F.when(F.col(text).isNull(), 1).otherwise(F.octet_length(body) + 1).cast("long")
    units = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("stratum"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_key"), size.alias("size"), F.crc32(body).alias("text_crc32"),
    )
    units = stabilise(units.groupBy(*units.columns).agg(F.count("*").alias("copies")))
    total = units.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    cells = max(1, math.isqrt(total))

    drawn = units.withColumn("draw", _draw(seed, "doc_id", "size", "text_crc32")).withColumn(
        "cell", (_leading(F.col("draw")) * cells / _WORD).cast("long")
    )
    by_cell = drawn.groupBy("stratum", "cell").agg(F.sum("copies").alias("in_cell"))
    of_stratum = Window.partitionBy("stratum")
    starts = by_cell.select(
        "stratum", "cell", F.sum("in_cell").over(of_stratum).alias("rows"),
        (F.sum("in_cell").over(of_stratum.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_cell")).alias("start"),
    )
    earlier = Window.partitionBy("stratum", "cell").orderBy("draw", "doc_id", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        drawn.withColumn("before", F.coalesce(F.sum("copies").over(earlier), F.lit(0)))
        .join(starts, ["stratum", "cell"])
        .withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(UNFOLDED).cast("long"))))
        .withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + (UNFOLDED - 1), F.col("copies") - 1))))
        .withColumn("place", F.col("start") + F.col("before") + F.col("copy"))
    )
    start_of = _leading(_draw(seed, "stratum")) / F.lit(float(_WORD))
    spread = stabilise(ranked.select(
        "doc_id", "stratum", "row_key", "size", "text_crc32", "place", ((F.col("place") + start_of) / F.col("rows")).alias("fraction"),
    ))
    stretch = spread.withColumn("cell", F.floor(F.col("fraction") * cells))
    # about sqrt(N) rows: one task adds them up and they are broadcast
    counted = stretch.groupBy("cell").agg(F.count("*").alias("in_cell"))
    offsets = counted.select(
        "cell", (F.sum("in_cell").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_cell")).alias("start")
    )
    order = Window.partitionBy("cell").orderBy("fraction", "stratum", "place")
    ordered = stretch.withColumn("nth", F.row_number().over(order)).join(F.broadcast(offsets), "cell").withColumn("at", F.col("start") + F.col("nth") - 1)
    shard = F.expr(f"at * {shards} div {max(1, total)}")
    return ordered.withColumn("shard", shard.cast("int")).select(
        "doc_id", "stratum", "row_key", "size", "text_crc32", "shard",
        (F.col("at") - F.expr(f"(shard * cast({total} as bigint) + {shards - 1}) div {shards}")).alias("slot"),
    )


def with_shards(
    docs: DataFrame, shards: int = 16, seed: int = SEED, source: str = "source", doc_id: str = "doc_id", text: str = "text",
    shard: str = "shard", slot: str = "slot",
) -> DataFrame:
    """``docs`` with the columns ``shard`` and ``slot``; the names must be free. Texts travel once, to meet their places."""
    key, at, nth = column_names(docs, "key", "at", "nth")
    places = place(docs, shards, seed, source, doc_id, text).select(F.col("row_key").alias(key), F.col("shard").alias(at), F.col("slot").alias(nth))
    whole = docs.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).dropDuplicates([key])
    return whole.join(places, key).select(*docs.columns, F.col(at).alias(shard), F.col(nth).alias(slot))


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Parquet folders ``shard=K`` under ``path``, each in the order of its slots.

    A range partitioning by shard and slot cuts large shards into several files; names follow the order.
    """
    placed = with_shards(docs, shards, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


# The same placement as SQL text: whole windows instead of cells, and a check sum by table over the bytes of the text.
SHARD_SQL = r"""
with recursive steps(i, k, v) as (select range::bigint, 0, range::bigint from range(256) union all
  select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from steps where k < 8),
tab as (select list(v order by i) as t from steps where k = 8),
bytes as (select doc_id, source, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint) as b from documents),
d as (select doc_id, case when source is null then '' else '=' || source end as stratum, len(b)::bigint + 1 as size,
  xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) as text_crc32 from bytes, tab),
r as (select *, row_number() over (partition by stratum order by md5(concat_ws(':', '{seed}', doc_id, size, text_crc32)), doc_id) - 1 as place,
  count(*) over (partition by stratum) as n from d),
f as (select *, (place + ('0x' || substr(md5(concat_ws(':', '{seed}', stratum)), 1, 8))::bigint / 4294967296e0) / n as fraction from r),
o as (select *, row_number() over (order by fraction, stratum, place) - 1 as pos, count(*) over () as total from f)
select doc_id, size, text_crc32, 'rows' as law, (pos * {shards} // total)::int as shard,
  pos - ((pos * {shards} // total) * total + {shards} - 1) // {shards} as slot, null::int as grown_shard from o
"""


def shard_sql(shards: int = 16, seed: int = SEED) -> str:
    return SHARD_SQL.replace("{shards}", str(shards)).replace("{seed}", str(seed))

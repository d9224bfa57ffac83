"""Exact percentiles of whole columns without gathering a column anywhere.

The columns are written once, so what they come from is read once. A table of at most ``DIRECT_ROWS`` rows is read off with Spark's own ``percentile``
(its buffer holds the distinct values, so the row count bounds it). Otherwise:

1. one aggregate counts the values, finds their extremes and brackets every wanted rank with an approximate sketch,
2. one aggregate counts the values below and inside each bracket, and about how
   many different ones are inside (copies of one value cost nothing),
3. brackets with too many different values are narrowed by a 256-bin histogram,
4. the distinct values inside the brackets (a bounded number) come back with
   their counts, and the rank is read off.

Counting makes the result exact whatever the sketch's error is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.runtime import release, stabilise

ACCURACY = 10_000
MAX_VALUES = 20_000
DIRECT_ROWS = 1_000_000
BINS = 256


@dataclass
class _Target:
    column: str
    probability: float
    rank: float
    low: float
    high: float
    below: int = 0
    inside: int = 0
    distinct: int = 0

    def holds(self) -> bool:
        return self.below <= math.floor(self.rank) and self.below + self.inside >= math.ceil(self.rank) + 1

    def mask(self) -> Column:
        return F.col(self.column).between(F.lit(self.low), F.lit(self.high))


def _count(df: DataFrame, targets: list[_Target]) -> None:
    aggs = []
    for i, t in enumerate(targets):
        aggs += [
            F.count_if(F.col(t.column) < F.lit(t.low)).alias(f"b{i}"), F.count_if(t.mask()).alias(f"i{i}"),
            F.approx_count_distinct(F.when(t.mask(), F.col(t.column))).alias(f"d{i}"),
        ]
    row = df.agg(*aggs).first()
    for i, t in enumerate(targets):
        t.below, t.inside, t.distinct = row[f"b{i}"], row[f"i{i}"], row[f"d{i}"]


def _narrow(df: DataFrame, targets: list[_Target]) -> None:
    """Replace each bracket by the histogram bins that hold its ranks."""
    entries = [
        F.when(
            t.mask(),
            F.struct(
                F.lit(i).alias("k"),
                F.least(
                    F.floor((F.col(t.column) - F.lit(t.low)) / F.lit(t.high - t.low) * BINS), F.lit(BINS - 1)
                ).cast("int").alias("bin"),
            ),
        )
        for i, t in enumerate(targets)
    ]
    rows = (
        df.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy("e.k", "e.bin")
        .count()
        .collect()  # at most BINS rows per target
    )
    for i, t in enumerate(targets):
        bins = sorted((r["bin"], r["count"]) for r in rows if r["k"] == i)
        seen, first, last = t.below, None, None
        for b, n in bins:
            if first is None and seen + n > math.floor(t.rank):
                first = b
            if last is None and seen + n > math.ceil(t.rank):
                last = b
            seen += n
        # one spare bin on both sides absorbs rounding of the bin edges
        width = (t.high - t.low) / BINS
        t.low, t.high = max(t.low, t.low + (first - 1) * width), min(t.high, t.low + (last + 2) * width)


def exact_percentiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    accuracy: int = ACCURACY,
    max_values: int = MAX_VALUES,
    direct_rows: int = DIRECT_ROWS,
    stored: bool = False,
) -> dict[str, list[float | None]]:
    """Linearly interpolated percentiles per column, missing values skipped.

    ``stored`` says that ``df`` is a written table of these columns; otherwise they are written here and deleted at the end.
    """
    if not columns:
        return {}
    if stored:
        return _percentiles(df, columns, probabilities, accuracy, max_values, direct_rows)
    table = stabilise(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    try:
        return _percentiles(table, columns, probabilities, accuracy, max_values, direct_rows)
    finally:
        release(table)


def _percentiles(
    df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int, max_values: int, direct_rows: int
) -> dict[str, list[float | None]]:
    df = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    margin = 2.0 / accuracy
    around = [max(0.0, p - margin) for p in probabilities] + [min(1.0, p + margin) for p in probabilities]
    aggs = [f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("min", F.min), ("max", F.max))]
    sketches = [F.percentile_approx(c, F.array(*map(F.lit, around)), accuracy).alias(f"s{i}") for i, c in enumerate(columns)]
    if df.count() <= direct_rows:
        wanted = F.array(*map(F.lit, probabilities))
        exact = df.agg(*[F.percentile(c, wanted).alias(f"p{i}") for i, c in enumerate(columns)]).first()
        return {c: list(exact[f"p{i}"] or [None] * len(probabilities)) for i, c in enumerate(columns)}
    row = sketched = df.agg(*aggs, *sketches).first()

    targets: list[_Target] = []
    for i, c in enumerate(columns):
        for j, p in enumerate(probabilities):
            if row[f"n{i}"]:
                low, high = sketched[f"s{i}"][j], sketched[f"s{i}"][j + len(probabilities)]
                targets.append(_Target(c, p, p * (row[f"n{i}"] - 1), low, high))

    _count(df, targets)
    loose = [t for t in targets if not t.holds()]
    if loose:
        limits = {c: (row[f"min{i}"], row[f"max{i}"]) for i, c in enumerate(columns)}
        for t in loose:
            t.low, t.high = limits[t.column]
        _count(df, loose)
    while wide := [t for t in targets if t.distinct > max_values and t.low < t.high]:
        before = [(t.low, t.high) for t in wide]
        _narrow(df, wide)
        _count(df, wide)
        if before == [(t.low, t.high) for t in wide]:
            break  # the bracket is down to neighbouring floats

    entries = [
        F.when(t.mask(), F.struct(F.lit(i).alias("k"), F.col(t.column).alias("v"))) for i, t in enumerate(targets)
    ]
    found = (
        df.select(F.explode(F.array_compact(F.array(*entries))).alias("e"))
        .groupBy("e.k", "e.v")
        .count()
        .toArrow()  # about max_values distinct values per bracket at most
        .to_pandas()
        .sort_values(["k", "v"])
    )
    out: dict[str, list[float | None]] = {c: [] for c in columns}
    per_target = dict(tuple(found.groupby("k")))
    by_key = {(t.column, t.probability): i for i, t in enumerate(targets)}
    for c in columns:
        for p in probabilities:
            if (c, p) not in by_key:
                out[c].append(None)
                continue
            k = by_key[(c, p)]
            t, part = targets[k], per_target[by_key[(c, p)]]
            ends = t.below + part["count"].cumsum()
            values = part["v"].to_numpy()
            lower = float(values[(ends > math.floor(t.rank)).to_numpy().argmax()])
            upper = float(values[(ends > math.ceil(t.rank)).to_numpy().argmax()])
            share = t.rank - math.floor(t.rank)
            out[c].append(lower if share == 0 else (1 - share) * lower + share * upper)
    return out


def exact_medians(df: DataFrame, columns: list[str], **options) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_percentiles(df, columns, [0.5], **options).items()}

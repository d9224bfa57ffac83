"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.runtime import stabilise


def _print(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a checksum that does not depend on their order."""
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``) of every node of ``links`` (``a``, ``b``): the smallest node that it reaches.

    Large-star and small-star rounds (Kiveris et al. 2014) turn each component into a star; every round is two
    shuffles over the edges, written to the shared folder, and the edges never grow in number. Loops are ignored.
    """
    edges = stabilise(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") < F.col("b")).distinct()
    )
    mark = _print(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        near = large.join(low, F.col("b") == F.col("u")).select("a", "b", "m")
        small = near.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter(F.col("a") < F.col("b")).distinct()
        edges = stabilise(small)
        last, mark = mark, _print(edges)
        if mark == last:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )

"""Exact top-k inner products by a dual-tree search over cover trees.

Queries and data are dealt into blocks around common pivots; every block becomes a cover tree. A pair of nodes with
centres a, b and covering radii r, s holds no product above <a,b> + |a|s + |b|r + rs, so it is passed over
when that is below the worst kth score of the queries in its query node. Each query group first
searches the data of its own pivot; the scores found there pass over whole blocks before any data is sent.
Equal vectors are one point that carries its ``k + 1`` smallest ids: no larger id can be in a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.runtime import stabilise

DATA_BLOCK = 4096
QUERY_BLOCK = 2048
# Vectors drawn (by hash of the id) to choose pivots from, and the number of pivots; they steer speed alone.
PIVOT_SAMPLE = 2000
PIVOTS = 16
LEAF = 128


def grid_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(``id``, ``v`` array<bigint>): floor(scale * x) of each component; rows with a null or non-finite one (or null id) take no part."""
    own = F.col(embedding).cast("array<double>")
    whole = F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & whole).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(own, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")
    )


class Node:
    __slots__ = ("center", "radius", "rows", "children", "length")

    def __init__(self, points: np.ndarray, rows: np.ndarray, center: np.ndarray):
        self.center, self.rows, self.children = center, rows, []
        self.radius = float(np.sqrt(((points[rows] - center) ** 2).sum(axis=1).max())) * (1 + 1e-12)
        self.length = float(np.linalg.norm(center))


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, center: np.ndarray | None = None) -> Node:
    """Each level covers a node's points with balls of half its radius around points over that apart."""
    rows = np.arange(len(points)) if rows is None else rows
    node = Node(points, rows, points[rows[0]] if center is None else center)
    if len(rows) <= LEAF or not node.radius:
        return node
    left, balls = rows, []
    while len(left):
        apart = ((points[left] - points[left[0]]) ** 2).sum(axis=1)
        near = apart <= (node.radius / 2) ** 2
        balls.append(left[near])
        left = left[~near]
    loose: list[np.ndarray] = []

    def gather() -> None:
        if loose:
            own = np.concatenate(loose)
            node.children.append(Node(points, own, points[own].mean(axis=0)))
            loose.clear()

    for ball in balls:
        if 4 * len(ball) > LEAF and len(ball) < len(rows):
            node.children.append(cover_tree(points, ball, points[ball[0]]))
            continue
        if sum(map(len, loose)) + len(ball) > LEAF:
            gather()
        loose.append(ball)
    gather()
    return node


def bound(a: Node, b: Node) -> float:
    return float(a.center @ b.center) + a.length * b.radius + b.length * a.radius + a.radius * b.radius


class DualSearch:
    """Best ``k`` points of each query so far, ordered by score, then by smallest id."""

    def __init__(self, queries: np.ndarray, points: np.ndarray, first_ids: np.ndarray, k: int, worst: np.ndarray):
        self.queries, self.points, self.first_ids, self.k, self.worst = queries, points, first_ids, k, worst
        self.row = self.at = np.zeros(0, np.int64)
        self.score = np.zeros(0)

    def run(self) -> None:
        """Nearest pairs first; ``worst`` holds a score that k points of each query are known to reach."""
        stack = [(cover_tree(self.queries), cover_tree(self.points))]
        while stack:
            a, b = stack.pop()
            most = bound(a, b)
            if most + 1e-6 * abs(most) + 1e-6 < self.worst[a.rows].min():
                continue
            if not a.children and not b.children:
                self.compare(a.rows, b.rows)
            elif not b.children or (a.children and a.radius > b.radius):
                stack += sorted(((x, b) for x in a.children), key=lambda p: p[0].center @ b.center)
            else:
                stack += sorted(((a, x) for x in b.children), key=lambda p: a.center @ p[1].center)

    def compare(self, rows: np.ndarray, points: np.ndarray) -> None:
        scores = self.queries[rows] @ self.points[points].T
        r, c = np.nonzero(scores >= self.worst[rows][:, None])
        if not len(r):
            return
        mine = np.isin(self.row, rows[r])
        row = np.concatenate((self.row[mine], rows[r]))
        at = np.concatenate((self.at[mine], points[c]))
        score = np.concatenate((self.score[mine], scores[r, c]))
        order = np.lexsort((self.first_ids[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
        kth = place == self.k - 1
        self.worst[row[kth]] = np.maximum(self.worst[row[kth]], score[kth])
        best = place < self.k
        self.row = np.concatenate((self.row[~mine], row[best]))
        self.at = np.concatenate((self.at[~mine], at[best]))
        self.score = np.concatenate((self.score[~mine], score[best]))


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    """Whole numbers; as doubles when every product of two rows stays exact in them, else as Python integers."""
    values = table.column(column).combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    wide = int(np.abs(flat).max()) if len(flat) else 0
    exact = wide < 2**62 and wide * wide * max(1, len(flat) // max(1, len(values))) < 2**52
    return flat.astype(np.float64 if exact else object).reshape(len(values), -1)


def _search(k: int):
    def search(key, queries: pa.Table, data: pa.Table) -> pa.Table:
        out = pa.schema([("rep", pa.int64()), ("score", pa.int64()), ("first_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
        if not queries.num_rows or not data.num_rows:
            return out.empty_table()
        q, x = _matrix(queries, "v"), _matrix(data, "v")
        ids, reps = data.column("first_id").to_numpy(), queries.column("rep").to_numpy()
        if q.dtype == object or x.dtype == object or float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] >= 2**52:
            q, x = q.astype(object), x.astype(object)
            scores = q.dot(x.T)
            pairs = [(i, j) for i in range(len(q)) for j in sorted(range(len(x)), key=lambda j: (-scores[i, j], ids[j]))[:k]]
            row, at = (np.array(c, np.int64) for c in zip(*pairs))
            score = [int(scores[i, j]) for i, j in pairs]
        else:
            worst = queries.column("worst").to_numpy(zero_copy_only=False).astype(np.float64).copy()
            worst[np.isnan(worst)] = -np.inf
            found = DualSearch(q, x, ids, k, worst)
            found.run()
            row, at, score = found.row, found.at, found.score.astype(np.int64)
        return pa.Table.from_arrays(
            [pa.array(reps[row]), pa.array(score, pa.int64()), pa.array(ids[at]), data.column("ids").combine_chunks().take(pa.array(at))], schema=out
        )

    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best points of each query group member."""
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "first_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")


def _pivots(vectors: DataFrame) -> list[list[int]]:
    """Points far apart out of a bounded draw; the first is the draw's first by hash."""
    drawn = [
        row["v"] for row in vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").collect()
    ]
    if not drawn:
        return []
    drawn = [v for v in drawn if len(v) == len(drawn[0])]
    x = np.array(drawn, np.float64)
    chosen, apart = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(PIVOTS, len(x)) and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return [drawn[c] for c in chosen]


def _with_cell(points: DataFrame, pivots: list[list[int]]) -> DataFrame:
    """``cell`` of the nearest pivot and the distance ``apart`` from it; another length of vector has its own cell and zero as pivot."""
    p = np.array(pivots, np.float64)

    def assign(batches):
        for batch in batches:
            cells, apart = [], []
            for v in batch.column(batch.schema.get_field_index("v")).to_pylist():
                x = np.array(v, np.float64)
                d = np.sqrt(((p - x) ** 2).sum(axis=1)) if len(x) == p.shape[1] else np.zeros(0)
                cells.append(int(d.argmin()) if len(d) else -1 - len(x))
                apart.append(float(d.min()) if len(d) else float(np.linalg.norm(x)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.int32()), pa.array(apart, pa.float64())], [*batch.schema.names, "cell", "apart"]
            )

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    return points.mapInArrow(assign, StructType([*points.schema.fields, StructField("cell", IntegerType()), StructField("apart", DoubleType())]))


def _with_block(points: DataFrame, key: str, size: int) -> DataFrame:
    """``block`` within the cell, of about ``size`` points each: a crowded cell is many blocks."""
    sizes = points.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("blocks"))
    return points.join(sizes, "cell").withColumn(
        "block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")
    ).drop("blocks")


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the ``k`` highest inner products of each row of ``vectors`` for which ``is_query``.

    The query's own id is no candidate, other copies of its vector are; ties go to the smaller id. Vectors of another
    length are no candidates. Rows of one id count once (the first vector by value). An empty table has no result.
    """
    vectors = stabilise(vectors.groupBy("id").agg(F.min("v").alias("v")))
    pivots = _pivots(vectors)
    if not pivots:
        return vectors.selectExpr("id as query_id", "1 as rank", "id as vec_id", "id as score").limit(0)
    asked = vectors.filter(is_query)
    # about one cell for each block's worth of rows; query cells are the first of the data's
    pivots = pivots[: max(1, vectors.count() // DATA_BLOCK)]
    q_pivots = pivots[: max(1, asked.count() // QUERY_BLOCK)]
    salted = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("id")
    few = vectors.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= k + 1)
    points = few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids")).withColumn("first_id", F.col("ids")[0])
    data = stabilise(_with_block(_with_cell(points, pivots), "first_id", DATA_BLOCK))
    reps = stabilise(
        _with_block(_with_cell(asked.groupBy("v").agg(F.min("id").alias("rep")), q_pivots), "rep", QUERY_BLOCK)
    )
    # the data around a group's own pivot first
    own_blocks = data.groupBy("cell").agg((F.max("block") + 1).alias("n"))
    home = reps.join(own_blocks, "cell").select(
        "rep", "v", F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), F.lit(None).cast("double").alias("worst"),
        "cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"),
    )
    groups = reps.groupBy("cell", "block").agg(F.max("apart").alias("radius"))
    pairs = groups.join(own_blocks, "cell").select(
        F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), "cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block")
    )
    first = stabilise(_best(_visit(home, data, pairs, k + 1), k + 1))
    # then every other block that the scores so far cannot pass over
    kth = first.groupBy("rep").agg(F.count("*").alias("n"), F.min("score").alias("score")).select(
        "rep", F.when(F.col("n") > k, F.col("score")).cast("double").alias("worst")
    )
    known = stabilise(reps.join(kth, "rep", "left"))
    floor = known.groupBy("cell", "block").agg(
        F.max("apart").alias("q_radius"), F.when(F.count("worst") == F.count("*"), F.min("worst")).alias("floor")
    )
    blocks = data.groupBy("cell", "block").agg(F.max("apart").alias("radius"))
    open_ = _open_pairs(floor, blocks, q_pivots, pivots)
    more = known.select("rep", "v", F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), "worst").join(
        open_, ["q_cell", "q_block"]
    )
    second = _visit(more, data, open_, k + 1)
    best = _best(first.unionByName(second), k + 1).select("rep", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1).select("rep", "score", "vec_id")
    members = asked.join(reps.select("v", "rep"), "v").select(F.col("id").alias("query_id"), "rep")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        members.join(best, "rep").filter(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _visit(queries: DataFrame, data: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Search each (query block, data block) pair in a task of its own."""
    keys = ["q_cell", "q_block", "cell", "block"]
    sent = data.select("cell", "block", "v", "first_id", "ids").join(pairs.select(*keys), ["cell", "block"])
    queries, sent = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (queries, sent))  # both come from ``data``
    return queries.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(
        _search(k), "rep long, score long, first_id long, ids array<long>"
    )


def _open_pairs(floor: DataFrame, blocks: DataFrame, q_pivots: list[list[int]], pivots: list[list[int]]) -> DataFrame:
    """Pairs of blocks in different cells whose bound reaches the worst kth score of the query block."""
    q, p = np.array(q_pivots, np.float64), np.array(pivots, np.float64)
    near, far = np.linalg.norm(q, axis=1), np.linalg.norm(p, axis=1)
    cells = [
        (i, j, float(q[i] @ p[j]), float(near[i]), float(far[j])) for i in range(len(q)) for j in range(len(p)) if i != j
    ]
    met = floor.sparkSession.createDataFrame(
        cells or [(-1, -2, 0.0, 0.0, 0.0)], "q_cell int, cell int, product double, q_length double, length double"
    )
    most = (
        F.col("product") + F.col("q_length") * F.col("radius") + F.col("length") * F.col("q_radius") + F.col("radius") * F.col("q_radius")
    )
    groups = floor.select(F.col("cell").alias("q_cell"), F.col("block").alias("q_block"), "q_radius", "floor")
    return (
        groups.join(F.broadcast(met), "q_cell").join(blocks, "cell")
        .filter(F.col("floor").isNull() | (most * (1 + 1e-9) + 1e-6 >= F.col("floor")))
        .select("q_cell", "q_block", "cell", "block")
    )


# The same search as SQL text: every query against every row.
SEARCH_SQL = """
with e as (select vec_id, min(list_transform(embedding, lambda x: floor(64 * x::double)::bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 group by vec_id),
p as (select q.vec_id as query_id, e.vec_id, list_dot_product(q.v::double[], e.v::double[])::bigint as score from e q join e on q.vec_id <> e.vec_id and len(q.v) = len(e.v)
  where q.vec_id % 20 = 0)
select query_id, rank::integer as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p) where rank <= 20
"""

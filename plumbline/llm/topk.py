"""Exact top-k by inner product, with candidates ruled out by pivot tables.

Components become floor(scale * x). A vector x is lifted by one coordinate sqrt(M^2 - |x|^2), M the largest norm, and a
query by 0: the squared distance is then |q|^2 + M^2 - 2 <q, x>, so the nearest vectors have the highest scores. The
pivot table holds the distances of each lifted vector to the pivots, ``pivots`` rows in the order of a digest of their
id. By the triangle inequality no distance is smaller than the largest difference of two table rows, which bounds the
score from above.

Vectors go to the cell of their nearest pivot, and cells of more than ``block`` vectors to several blocks, cut by the
distance to that pivot, so that the blocks of a cell differ in their ranges; where more than ``block`` lie at about one
distance they are dealt out evenly. A query first
searches the block it lies in; its k-th score there rules out every block whose ranges of pivot distances can't reach
it. In a block, candidates lie in groups of neighbours by pivot distance; every query takes the groups in the order of
their bounds and stops when the next bound is below its k-th score. Nothing is approximate: bounds are widened by more
than the rounding error, and ties go to the smaller id. (Where all vectors are about as far from each other, as random
ones are in many dimensions, bounds rule out little, and nearly all pairs are evaluated, in matrix products.)

Queries meet a block in chunks of about ``chunk`` queries, so no task holds more than one block and one chunk. The
ranges of all blocks, 2 * pivots numbers for each, are sent to the executors in parts of at most ``part`` blocks.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Vectors of
different lengths are compared as if the shorter ended in zeros. Repeated ids are separate candidates and separate
queries' ids are merged: a query id stands for one query (of rows that share it, the one with the least components). A
query is never compared to rows of its own id. An empty vector scores 0 with all. Scores are exact while they are below
2^53. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

FOUND = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and v, the array of floor(scale * x), of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("double"))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def distances(norms: np.ndarray, lift: np.ndarray, x: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Distances of lifted rows to lifted pivots."""
    own = np.einsum("ij,ij->i", pivots, pivots)
    pivot_lift = np.sqrt(np.maximum(top * top - own, 0))
    squared = (norms + lift * lift)[:, None] + (own + pivot_lift * pivot_lift)[None, :] - 2 * (x @ pivots.T + np.outer(lift, pivot_lift))
    return np.sqrt(np.maximum(squared, 0))


class Best:
    """The k-th scores of some queries so far, and all (query, candidate, score) that may be among the k best."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor.copy()
        self.top = np.full((n, k), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        better = scores.max(axis=1) >= self.floor[rows]
        if not better.any():
            return
        rows, scores = rows[better], scores[better]
        self.top[rows] = np.partition(np.concatenate([self.top[rows], scores], axis=1), -self.k, axis=1)[:, -self.k :]
        self.floor[rows] = np.maximum(self.floor[rows], self.top[rows].min(axis=1))
        q, c = np.nonzero(scores >= np.maximum(self.floor[rows], -1e300)[:, None])
        self.found.append((rows[q], ids[c], scores[q, c]))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of every query, ties to the smaller id."""
        if not self.found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        q, ids, scores = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keep = scores >= self.floor[q]
        q, ids, scores = q[keep], ids[keep], scores[keep]
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank < self.k], ids[rank < self.k], scores[rank < self.k]


def reach(q_norms: np.ndarray, q_table: np.ndarray, low: np.ndarray, high: np.ndarray, top: float) -> np.ndarray:
    """The highest score that each query can have with any member of groups with these ranges of pivot distances."""
    bound = np.zeros((len(q_table), len(low)))
    for p in range(low.shape[1]):
        d = q_table[:, p][:, None]
        np.maximum(bound, np.maximum(low[:, p][None, :] - d, d - high[:, p][None, :]), out=bound)
    return (q_norms[:, None] + top * top - bound * bound) / 2 + 1e-6 * (top * top + 1)


def search(q_ids, q, c_ids, c, floor, points, top, k, group=256):
    """Best of the candidates for every query, among those that reach its floor, in order of the groups' bounds."""
    best = Best(len(q_ids), k, floor)
    q_norms = np.einsum("ij,ij->i", q, q)
    q_table = distances(q_norms, np.zeros(len(q)), q, points, top)
    norms = np.einsum("ij,ij->i", c, c)
    table = distances(norms, np.sqrt(np.maximum(top * top - norms, 0)), c, points, top)
    order = np.lexsort((c_ids, table.min(axis=1)))
    c, c_ids, table = c[order], c_ids[order], table[order]
    starts = np.arange(0, len(c), group)
    low = np.minimum.reduceat(table, starts, axis=0)
    high = np.maximum.reduceat(table, starts, axis=0)
    can = reach(q_norms, q_table, low, high, top)
    turn = np.argsort(-can, axis=1, kind="stable")
    for step in range(len(starts)):
        at = turn[:, step]
        live = can[np.arange(len(q)), at] >= best.floor
        if not live.any():
            break
        for g in np.unique(at[live]):
            rows = np.flatnonzero(live & (at == g))
            ids = c_ids[starts[g] : starts[g] + group]
            scores = q[rows] @ c[starts[g] : starts[g] + group].T
            scores[q_ids[rows][:, None] == ids[None, :]] = -np.inf
            best.add(rows, ids, scores)
    return best


def dealt(table: DataFrame, block: int) -> DataFrame:
    """``table`` with blk, the block of each row: ranges of the distance to the nearest pivot, the full ones dealt out by turn."""
    near = F.array_min("table")
    sizes = table.groupBy("cell").agg(F.count("*").alias("n")).collect()  # a row for each pivot
    ranges = max((-(-r["n"] // block) for r in sizes), default=1)
    # Quantiles of each cell, a number for each range; a value that fills several of them stays in one.
    cuts = table.groupBy("cell").agg(F.percentile_approx(near, [i / ranges for i in range(1, ranges)] or [0.5], 10_000).alias("cuts"))
    ranged = table.join(F.broadcast(cuts), "cell").withColumn("slice", F.size(F.filter("cuts", lambda c: c < near)) if ranges > 1 else F.lit(0))
    full = ranged.groupBy("cell", "slice").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    known = full.select(F.col("cell").alias("of_cell"), F.col("slice").alias("of_slice"), "parts")
    one = ranged.join(F.broadcast(known), (F.col("cell") == F.col("of_cell")) & (F.col("slice") == F.col("of_slice")))
    blk = (F.col("cell").cast("long") * (1 << 20) + F.col("slice")) * (1 << 20) + F.pmod(F.hash("vec_id", "turn"), F.col("parts"))
    return one.select(*table.columns, blk.alias("blk"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, pivots: int = 16, block: int = 16000, chunk: int = 2000, part: int = 50_000) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of every vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    held = integers(vectors, scale)
    one = held.agg(
        F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)).alias("top"), F.max(F.size("v")).alias("width")
    ).first()
    if one["top"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top, width = float(np.sqrt(one["top"])), max(1, one["width"])
    points = matrix(
        [r["v"] for r in held.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "vec_id", "v").limit(pivots).collect()], width
    )

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1).to_pylist(), width)
                norms = np.einsum("ij,ij->i", x, x)
                table = distances(norms, np.sqrt(np.maximum(top * top - norms, 0)), x, points, top)
                cell = table.argmin(axis=1).astype(np.int32)
                turn = np.arange(len(cell), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(list(table)), pa.array(cell), pa.array(turn)], names=["vec_id", "v", "table", "cell", "turn"]
                )

    table = written(held.mapInArrow(tabled, "vec_id long, v array<double>, table array<double>, cell int, turn int"), "pivot-table")
    placed = dealt(table, block)

    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    homes = pa.schema([*found, ("floor", pa.float64()), ("v", pa.list_(pa.float64())), ("blk", pa.int64())])

    def best_rows(q_ids: np.ndarray, best: Best) -> list[pa.Array]:
        q, ids, scores = best.rows()
        return [pa.array(q_ids[q]), pa.array(ids), pa.array(scores.astype(np.int64))]

    def at_home(rows: pa.Table) -> pa.Table:
        """The queries of a block against the block; each query comes along with its vector in a row of its own."""
        ids, held = rows.column("vec_id").to_numpy(), rows.column("v").to_pylist()
        own: dict[int, list[float]] = {}
        for i in np.flatnonzero(ids % every == 0).tolist():
            own[int(ids[i])] = min(own.get(int(ids[i]), held[i]), held[i])
        c, q_ids = matrix(held, width), np.array(sorted(own), dtype=np.int64)
        out = [homes.empty_table()]
        for at in range(0, len(q_ids), chunk):
            some = q_ids[at : at + chunk]
            vectors = [own[int(i)] for i in some]
            best = search(some, matrix(vectors, width), ids, c, np.full(len(some), -np.inf), points, top, k)
            got = best_rows(some, best)
            none = [pa.nulls(len(got[0]), homes.field(n).type) for n in (3, 4, 5)]
            out.append(pa.Table.from_arrays([*got, *none], schema=homes))
            blank = pa.nulls(len(some), pa.int64())
            blk = pa.array(np.full(len(some), rows.column("blk")[0].as_py(), dtype=np.int64))
            out.append(pa.Table.from_arrays([pa.array(some), blank, blank, pa.array(best.floor), pa.array(vectors, pa.list_(pa.float64())), blk], schema=homes))
        return pa.concat_tables(out)

    home = written(
        placed.select("vec_id", "v", "blk").groupBy("blk").applyInArrow(at_home, FOUND + ", floor double, v array<double>, blk long"), "home"
    )
    ranges = [f(F.get("table", F.lit(p))) for p in range(len(points)) for f in (F.min, F.max)]
    summary = placed.groupBy("blk").agg(F.array(*ranges).alias("ranges"))
    # Rows that share an id may lie in several blocks; one of them is the query.
    first = Window.partitionBy("query_id").orderBy("v", "blk")
    queries = home.filter("vec_id is null").withColumn("n", F.row_number().over(first)).filter("n = 1").select("query_id", "floor", "v", "blk")
    chunks = max(1, -(-queries.count() // chunk))
    sent = _sent(queries, summary, points, width, top, part)
    sent = written(sent.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")), "sent")
    meets = sent.select(F.col("blk").alias("to_blk"), F.col("chunk").alias("to_chunk")).distinct()
    offered = placed.select("vec_id", "v", "blk").join(meets, F.col("blk") == F.col("to_blk")).drop("blk")

    def away(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return found.empty_table()
        q_ids, floor = queries.column("query_id").to_numpy(), queries.column("floor").to_numpy()
        q, c = matrix(queries.column("v").to_pylist(), width), matrix(rows.column("v").to_pylist(), width)
        best = search(q_ids, q, rows.column("vec_id").to_numpy(), c, floor, points, top, k)
        return pa.Table.from_arrays(best_rows(q_ids, best), schema=found)

    elsewhere = sent.groupBy("blk", "chunk").cogroup(offered.groupBy("to_blk", "to_chunk")).applyInArrow(away, FOUND)
    same = home.filter("vec_id is not null").select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        same.unionByName(elsewhere)
        .withColumn("rank", F.row_number().over(order).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _sent(queries: DataFrame, summary: DataFrame, points: np.ndarray, width: int, top: float, part: int) -> DataFrame:
    """query_id, floor, v and blk for every block but its own that a query can't rule out."""
    spark = queries.sparkSession
    out = None
    rows = summary.toLocalIterator()
    while True:
        held = [(r["blk"], r["ranges"]) for r in islice(rows, part)]
        if not held and out is not None:
            return out
        blocks = np.array([b for b, _ in held], dtype=np.int64)
        ranges = np.array([r for _, r in held]).reshape(len(held), -1)
        shared = spark.sparkContext.broadcast((blocks, ranges[:, 0::2], ranges[:, 1::2]))

        def route(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            blocks, low, high = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    q = matrix(batch.column(2).to_pylist(), width)
                    norms = np.einsum("ij,ij->i", q, q)
                    can = reach(norms, distances(norms, np.zeros(len(q)), q, points, top), low, high, top)
                    floor = batch.column(1).to_numpy(zero_copy_only=False)
                    i, j = np.nonzero((can >= floor[:, None]) & (blocks[None, :] != batch.column(3).to_numpy(zero_copy_only=False)[:, None]))
                    taken = batch.select([0, 1, 2]).take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(blocks[j])], names=["query_id", "floor", "v", "blk"])

        some = queries.mapInArrow(route, "query_id long, floor double, v array<double>, blk long")
        out = some if out is None else out.unionByName(some)
        if len(held) < part:
            return out

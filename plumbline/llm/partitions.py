"""Approximate nearest neighbours by learned partitions.

Nearness is the inner product. On a sample of at most ``sample`` vectors (the first by a digest of their id) the
neighbour graph is built and cut into balanced parts: halves by the second eigenvector of the graph's walk, evened out by
exchanges that keep the halves equal, and so on down. Vectors are lifted by one coordinate, sqrt(M^2 - |x|^2) with M the
largest norm of the table, so that neighbours in the graph are neighbours by inner product. A small classifier (one hidden
layer beside a linear one) learns the parts from the graph and places every vector of the table. A second one learns how
the neighbours of a direction are spread over the parts as they were placed; its probabilities, added up from the most
probable part on, are the share of neighbours that a query finds there. A query goes to as few parts as reach ``cover``.
``cover`` is the smallest of a fixed list with which queries of the sample that the router has not seen find the share
``target`` of their neighbours, less two standard errors of that mean. All candidates of those parts are ranked by their
exact inner products.

A part is cut into blocks of about ``block`` vectors by a hash, so that many like vectors don't meet in one task, and
queries meet a block in chunks of about ``chunk``. A task holds one block and one chunk; the classifiers (some thousand
numbers) are all that is sent to the executors, and the sample is all that the driver holds. Where vectors have no
clusters, as random ones in many dimensions, most parts must be visited to find most neighbours.

Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows without an id. Shorter
vectors are as if they ended in zeros. Rows that share an id are separate candidates; a query id stands for one query (of
rows that share it, the one with the least components) and is never compared to rows of its own id. Equal scores go to
the smaller id. Scores are sums in double precision from the first component on. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: Sample vectors for a part, at least.
PER_PART = 64
#: Shares of neighbours that a router may aim at.
COVERS = (0.8, 0.84, 0.87, 0.9, 0.92, 0.94, 0.955, 0.97, 0.98, 0.99, 0.995, 1.0)
FOUND = "query_id long, vec_id long, score double"


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id and v of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of a column of lists, ended with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(-1, width).astype(float)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Unit vectors whose distances order as the inner products of ``x`` with a query."""
    own = x / top
    return np.column_stack([own, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", own, own)))])


def directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


# --- balanced parts of a graph ---


def halves(i: np.ndarray, j: np.ndarray, n: int, rounds: int = 60) -> np.ndarray:
    """Two halves of the vertices with few of the edges i-j between them: true for the second half."""
    degree = np.sqrt(np.bincount(i, minlength=n) + np.bincount(j, minlength=n) + 1e-9)
    first = degree / np.linalg.norm(degree)
    x = np.random.default_rng(n).standard_normal(n)

    def pull(x: np.ndarray) -> np.ndarray:
        return np.bincount(i, weights=x[j], minlength=n) + np.bincount(j, weights=x[i], minlength=n)

    for _ in range(rounds):
        x = pull(x / degree) / degree + x
        x -= first * (first @ x)
        x /= np.linalg.norm(x) or 1
    order = np.argsort(x / degree, kind="stable")
    for _ in range(rounds):
        side = np.zeros(n, dtype=bool)
        side[order[n // 2 :]] = True
        sign = np.where(side, 1.0, -1.0)
        after = np.argsort(pull(sign) + sign / 2, kind="stable")
        if (side[after[n // 2 :]]).all():
            break
        order = after
    return side


def balanced_parts(neighbours: np.ndarray, parts: int) -> np.ndarray:
    """The part of every vertex of a neighbour graph; sizes differ by as little as halving allows."""
    out = np.zeros(len(neighbours), dtype=np.int64)
    todo = [(np.arange(len(neighbours)), 0, parts)]
    while todo:
        ids, first, n = todo.pop()
        if n == 1:
            out[ids] = first
            continue
        place = np.full(len(neighbours), -1)
        place[ids] = np.arange(len(ids))
        i, j = np.repeat(np.arange(len(ids)), neighbours.shape[1]), place[neighbours[ids].ravel()]
        side = halves(i[j >= 0], j[j >= 0], len(ids))
        todo += [(ids[~side], first, n // 2), (ids[side], first + n // 2, n // 2)]
    return out


# --- classifiers ---


@dataclass
class Classifier:
    """Probabilities of parts: a linear layer beside one hidden layer."""

    weights: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        into, bias, out, base, straight = self.weights
        return softmax(np.maximum(x @ into + bias, 0) @ out + base + x @ straight)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def learned(x: np.ndarray, shares: np.ndarray, hidden: int = 64, epochs: int = 20, rate: float = 2e-3, batch: int = 256) -> Classifier:
    """A classifier whose probabilities follow ``shares``, by Adam on the cross entropy."""
    rng = np.random.default_rng(0)
    width, parts = x.shape[1], shares.shape[1]
    scale = np.sqrt(width)
    weights = [rng.standard_normal((width, hidden)) * np.sqrt(2 / width), np.zeros(hidden), rng.standard_normal((hidden, parts)) * 0.1, np.zeros(parts), np.zeros((width, parts))]
    mean, square, steps = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            into, bias, out, base, straight = weights
            some = x[rows] * scale
            held = np.maximum(some @ into + bias, 0)
            wrong = (softmax(held @ out + base + some @ straight) - shares[rows]) / len(rows)
            back = (wrong @ out.T) * (held > 0)
            slopes = [some.T @ back + 1e-4 * into, back.sum(0), held.T @ wrong + 1e-4 * out, wrong.sum(0), some.T @ wrong + 1e-4 * straight]
            steps += 1
            for w, g, m, s in zip(weights, slopes, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.999**steps)) + 1e-8)
    into, bias, out, base, straight = weights
    return Classifier([into * scale, bias, out, base, straight * scale])


def spread(neighbours: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """The share of each row's neighbours in every part."""
    out = np.zeros((len(neighbours), parts))
    np.add.at(out, (np.repeat(np.arange(len(neighbours)), neighbours.shape[1]), part[neighbours].ravel()), 1 / max(1, neighbours.shape[1]))
    return out


def chosen(shares: np.ndarray, cover: float) -> np.ndarray:
    """Which parts each query visits: the most probable ones, until they reach ``cover``."""
    order = np.argsort(-shares, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(shares, order, 1), axis=1) - np.take_along_axis(shares, order, 1)
    out = np.zeros(shares.shape, dtype=bool)
    np.put_along_axis(out, order, before < cover - 1e-12, axis=1)
    return out


@dataclass
class Partitions:
    """What places vectors and routes queries."""

    place: Classifier | None
    route: Classifier | None
    cover: float
    top: float
    width: int

    def part_of(self, x: np.ndarray) -> np.ndarray:
        return self.place(lifted(x, self.top)).argmax(axis=1) if self.place else np.zeros(len(x), dtype=np.int64)

    def visits(self, q: np.ndarray) -> np.ndarray:
        return chosen(self.route(directions(q)), self.cover) if self.route else np.ones((len(q), 1), dtype=bool)


def graph_of(sample: DataFrame, x: np.ndarray, top: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of the sample, its k nearest others as lifted vectors, and its k largest inner products."""
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(x)
    rows = spark.range(0, len(x), 1, max(1, min(64, len(x) // 256)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        up = lifted(x, top)
        for batch in batches:
            whole = batch.column(0).to_numpy()
            for at in range(0, len(whole), 512):
                ids = whole[at : at + 512]
                out = []
                for scores in (up[ids] @ up.T, x[ids] @ x.T):
                    scores[np.arange(len(ids)), ids] = -np.inf
                    out.append(pa.array(list(np.argpartition(-scores, k - 1, axis=1)[:, :k])))
                yield pa.RecordBatch.from_arrays([pa.array(ids), *out], names=["id", "close", "best"])

    got = rows.mapInArrow(near, "id long, close array<long>, best array<long>").collect()  # a row for each of the sample
    got.sort(key=lambda r: r["id"])
    return np.array([r["close"] for r in got]), np.array([r["best"] for r in got])


def fitted(vectors: DataFrame, k: int, parts: int, sample: int, target: float) -> Partitions | None:
    """The classifiers, from vec_id and v of all vectors; nothing if there are none."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))
    one = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.max(F.size("v")).alias("width")).first()
    if not one["n"]:
        return None
    top, width = float(one["top"]), one["width"]
    # So many low digests that the sample is nearly always full, and no task gathers more.
    digest = F.xxhash64("vec_id")
    limit = min(2**63 - 1, int((1.2 * sample + 1000) / one["n"] * 2**64) - 2**63)
    some = vectors.filter(digest <= limit).withColumn("turn", digest).orderBy("turn", "vec_id", "v").limit(sample)
    rows = [r["v"] for r in some.select("v").collect()]
    x = matrix(pa.array(rows, pa.list_(pa.float64())), width)
    parts = 1 << max(0, min(parts, len(x) // PER_PART).bit_length() - 1)
    if parts == 1:
        return Partitions(None, None, 1.0, top, width)
    near = min(k, len(x) - 1)
    close, best = graph_of(some, x, top, near)
    cut = balanced_parts(close, parts)
    own = np.eye(parts)[cut]
    place = learned(lifted(x, top), 0.3 * own + 0.7 * spread(close, cut, parts))
    placed = place(lifted(x, top)).argmax(axis=1)
    shares = spread(best, placed, parts)
    unseen = np.arange(len(x)) % 8 == 7
    route = learned(directions(x[~unseen]), shares[~unseen])
    guess = route(directions(x[unseen]))
    for cover in COVERS:
        found = (chosen(guess, cover) * shares[unseen]).sum(axis=1)
        if found.mean() - 2 * found.std() / np.sqrt(len(found)) >= target:
            break
    return Partitions(place, route, cover, top, width)


# --- search ---


def best_of(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and exact scores of each query's k best, ties to the smaller id."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    size = np.sqrt(np.einsum("ij,ij->i", c, c).max())
    out = []
    for at in range(0, len(q_ids), rows):
        some, ids = q[at : at + rows], q_ids[at : at + rows]
        rough = some @ c.T
        rough[ids[:, None] == c_ids[None, :]] = -np.inf
        edge = np.partition(rough, -min(k, len(c)), axis=1)[:, -min(k, len(c))]
        # A matrix product may add in another order; what is near the edge is decided by the plain sums.
        slack = 1e-11 * size * np.sqrt(np.einsum("ij,ij->i", some, some))
        i, j = np.nonzero((rough >= (edge - slack)[:, None]) & (rough > -np.inf))
        score = np.zeros(len(i))
        for d in range(q.shape[1]):
            score += some[i, d] * c[j, d]
        order = np.lexsort((j, -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((ids[i[keep]], c_ids[j[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, parts: int = 64, sample: int = 8192, target: float = 0.93, block: int = 16_000, chunk: int = 4000
) -> DataFrame:
    """query_id, rank, vec_id and score: about the k nearest of every vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    held = taking_part(vectors)
    model = fitted(held, k, parts, sample, target)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = shared.value.part_of(matrix(batch.column(1), shared.value.width)).astype(np.int32)
                turn = np.arange(len(part), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(turn)], names=["vec_id", "v", "part", "turn"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                i, part = np.nonzero(shared.value.visits(matrix(batch.column(1), shared.value.width)))
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(i)).columns, pa.array(part.astype(np.int32))], names=["query_id", "q", "to_part"])

    placed = written(held.mapInArrow(place, "vec_id long, v array<double>, part int, turn int"), "placed")
    sizes = placed.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # a row for each part
    known = {r["part"]: r["blocks"] for r in sizes.collect()}
    blocks = F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), F.col("part"))
    queries = held.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    queries = written(queries.mapInArrow(route, "query_id long, q array<double>, to_part int"), "routed").filter(F.col("to_part").isin(list(known)))
    chunks = max(1, -(-held.filter(F.col("vec_id") % every == 0).select("vec_id").distinct().count() // chunk))
    of_part = F.element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), F.col("to_part"))
    sent = queries.select("query_id", "q", "to_part", F.explode(F.sequence(F.lit(0), of_part - 1)).alias("to_block"), F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int").alias("to_chunk"))
    offered = placed.select(
        "vec_id", "v", "part", F.pmod(F.hash("vec_id", "turn"), blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    )
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def rank(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return schema.empty_table()
        q, c = matrix(asked.column("q"), model_width), matrix(rows.column("v"), model_width)
        got = best_of(asked.column("query_id").to_numpy(), q, rows.column("vec_id").to_numpy(), c, k)
        return pa.Table.from_arrays([pa.array(x) for x in got], schema=schema)

    model_width = model.width
    found = sent.groupBy("to_part", "to_block", "to_chunk").cogroup(offered.groupBy("part", "block", "chunk")).applyInArrow(rank, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

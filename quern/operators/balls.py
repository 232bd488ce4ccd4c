"""Exact k nearest neighbours past what can be broadcast: blocks as balls, and the triangle inequality between them.

Training vectors and queries are dealt by their nearest pivot (PIVOTS training vectors, by a hash) and their distance from it, so
a block of BLOCK_ROWS holds neighbours of each other; a block knows its centre and its radius. Pairs of blocks are looked at by
centres only: no vector of one is nearer to one of the other than the centres' distance less both radii. Each query block
first meets the training block whose centre is nearest, which gives every query a k-th distance that the true one cannot exceed;
then it meets those blocks that may hold anything nearer, and in such a meeting only the queries that the block's ball may serve
are computed. Clustered vectors meet a small part of the blocks; where vectors have no clusters, all pairs of blocks meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import matrix
from quern.session import shared_dir, stored

PIVOTS = 256
BLOCK_ROWS = 4096
SPARE = 8
#: Vectors whose distances to one query are computed at a time.
NEAR_ROWS = 1024
#: Queries of a matrix product: a batch's size, or a block's, decides no memory.
NEAR_QUERIES = 256
#: Tasks among which a query's candidates are dealt.
SALTS = 64
#: What rounding may take from a lower bound, as a share of the numbers that it comes from.
SLACK = 1e-9
BALLS = "block long, centre binary, radius double, ids binary, labels binary, vectors binary"


def distances(query: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Squared distances of all training vectors to one query."""
    out, apart = np.empty(len(train)), np.empty((min(NEAR_ROWS, len(train)), train.shape[-1]))
    for at in range(0, len(train), NEAR_ROWS):
        part = train[at : at + NEAR_ROWS]
        d = np.subtract(query, part, out=apart[: len(part)])
        np.sum(np.multiply(d, d, out=d), axis=1, out=out[at : at + NEAR_ROWS])
    return out


def nearest(queries: np.ndarray, ids: np.ndarray, train: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, rows) of the k training vectors nearest to each query, by distance and then by id; NEAR_QUERIES queries at a time."""
    squares = (train * train).sum(1)
    parts = [nearest_of(queries[at : at + NEAR_QUERIES], ids, train, squares, k) for at in range(0, max(1, len(queries)), NEAR_QUERIES)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def nearest_of(queries: np.ndarray, ids: np.ndarray, train: np.ndarray, squares: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rough = squares[None, :] - 2 * (queries @ train.T)
    m = min(len(train), k + SPARE)
    some = np.argpartition(rough, m - 1, axis=1)[:, :m] if m < len(train) else np.tile(np.arange(len(train)), (len(queries), 1))
    exact = ((queries[:, None, :] - train[some]) ** 2).sum(2)
    order = np.lexsort((ids[some], exact), axis=1)[:, :k]
    d, at = np.take_along_axis(exact, order, 1), np.take_along_axis(some, order, 1)
    if m < len(train):
        # all that rounding may place among the k best; where they are more than m, as copies are, each is computed
        error = 8 * (train.shape[1] + 4) * np.finfo(np.float64).eps * ((queries * queries).sum(1) + squares.max())
        within = rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + error)[:, None]
        for i in np.flatnonzero(within.sum(1) > m):
            more = np.flatnonzero(within[i])
            far = distances(queries[i], train[more])
            first = np.lexsort((ids[more], far))[:k]
            d[i], at[i] = far[first], more[first]
    return d, at


def unpack(ids: bytes, labels: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(labels, np.int64), np.frombuffer(vectors, np.float64).reshape(len(i), -1)


def blocks_of(rows: DataFrame, pivots: np.ndarray, path: str) -> DataFrame:
    """Rows (id, l, v) as balls: dealt by pivot and distance from it, packed in that order, and written."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors
    names = ["i", "l", "v", "pivot", "far"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares = (shared.value**2).sum(1)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(2))
                rough = squares[None, :] - 2 * (x @ shared.value.T)
                best = rough.argmin(1)
                far = rough[np.arange(len(x)), best] + (x * x).sum(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32)), pa.array(far)], names=names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        now, n = None, 0

        def ball() -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(c) for c in zip(*held, strict=True))
            centre = x.mean(0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
            data = [np.ascontiguousarray(c).tobytes() for c in (centre, ids, labels, x)]
            columns = [pa.array([data[0]], pa.binary()), pa.array([radius]), *(pa.array([d], pa.binary()) for d in data[1:])]
            return pa.RecordBatch.from_arrays(columns, names=["centre", "radius", "ids", "labels", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x, pivot = matrix(batch.column(2)), np.asarray(batch.column(3))
            ids, labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            at = 0
            while at < len(x):
                end = min(at + BLOCK_ROWS - (n if pivot[at] == now else 0), at + int(np.argmax(np.append(pivot[at:] != pivot[at], True))))
                if held and (pivot[at] != now or n >= BLOCK_ROWS):
                    yield ball()
                    held, n = [], 0
                    end = min(at + BLOCK_ROWS, at + int(np.argmax(np.append(pivot[at:] != pivot[at], True))))
                now = pivot[at]
                held.append((ids[at:end], labels[at:end], x[at:end]))
                n += end - at
                at = end
        if held:
            yield ball()

    dealt = rows.mapInArrow(placed, "i long, l long, v array<double>, pivot int, far double").repartitionByRange("pivot", "far", "i").sortWithinPartitions("pivot", "far")
    balls = dealt.mapInArrow(packed, "centre binary, radius double, ids binary, labels binary, vectors binary")
    return stored(balls.select(F.monotonically_increasing_id().alias("block"), "*"), path)


def bounded_pairs(queries: DataFrame, train: DataFrame) -> DataFrame:
    """(q_block, block, low, between): for each pair of blocks, the least distance of their vectors and that of their centres."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.stack([np.frombuffer(x.as_buffer()) for x in batch.column(c)]) for c in (1, 4))
                between = np.sqrt(((a - b) ** 2).sum(1))
                radii = np.asarray(batch.column(2)) + np.asarray(batch.column(5))
                low = between - radii - SLACK * (between + radii)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(low), pa.array(between)], names=["q_block", "block", "low", "between"])

    # a row a pair of blocks, without their vectors
    met = queries.select(F.col("block").alias("q_block"), F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius")).crossJoin(train.select("block", "centre", "radius"))
    return met.mapInArrow(apply, "q_block long, block long, low double, between double")


def met(pairs: DataFrame, queries: DataFrame, train: DataFrame, k: int, limits: DataFrame | None) -> DataFrame:
    """(q_block, q, t, l, d): the k nearest of each query in each block that it meets; queries beyond whose limit the block lies are left out."""
    named = queries.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    if limits is None:
        named = named.withColumn("limits", F.lit(None).cast("binary"))
    else:
        named = named.join(limits.select("q_block", "limits"), "q_block")
    rows = pairs.select("q_block", "block").join(named, "q_block").join(train, "block").select("q_block", "q_ids", "q_vectors", "limits", "centre", "radius", "ids", "labels", "vectors")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, q_ids, q_vectors, limits, centre, radius, *data = (c[i] for c in batch.columns)
                q_ids = np.frombuffer(q_ids.as_buffer(), np.int64)
                q = np.frombuffer(q_vectors.as_buffer()).reshape(len(q_ids), -1)
                if limits.is_valid:
                    away = np.sqrt(((q - np.frombuffer(centre.as_buffer())) ** 2).sum(1))
                    may = away - radius.as_py() - SLACK * (away + radius.as_py()) <= np.frombuffer(limits.as_buffer())
                    q_ids, q = q_ids[may], q[may]
                    if not len(q):
                        continue
                ids, labels, vectors = unpack(*(d.as_buffer() for d in data))
                d, at = nearest(q, ids, vectors, k)
                columns = [np.full(d.size, block.as_py()), np.repeat(q_ids, d.shape[1]), ids[at].ravel(), labels[at].ravel(), d.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q_block", "q", "t", "l", "d"])

    return rows.mapInArrow(apply, "q_block long, q long, t long, l long, d double")


def limits_of(first: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q_block, limit, limits): each query's k-th distance so far in the block's order, infinite for those with fewer, and the largest."""
    reached = first.groupBy("q_block", "q").agg(F.max("d").alias("d"), F.count("*").alias("n"))
    reached = reached.groupBy("q_block").agg(F.collect_list(F.struct("q", "d", "n")).alias("reached"))  # a block's queries

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known = {r["q"]: r["d"] for r in batch.column(2)[i].as_py() or [] if r["n"] >= k}
                ids = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
                far = np.sqrt([known.get(x, np.inf) for x in ids.tolist()]) * (1 + SLACK)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([float(far.max())]), pa.array([far.tobytes()], pa.binary())], names=["q_block", "limit", "limits"])

    own = queries.select(F.col("block").alias("q_block"), "ids").join(reached, "q_block", "left")
    return own.select("q_block", "ids", "reached").mapInArrow(apply, "q_block long, limit double, limits binary")


def meetings(q: DataFrame, t: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates (q, t, l, d), pairs of blocks that meet, all pairs of blocks)."""
    path = shared_dir(q.sparkSession, "balls")
    starts = t.orderBy(F.xxhash64("v"), "t").limit(PIVOTS).select("v").collect()
    pivots = np.array([r["v"] for r in starts], np.float64).reshape(len(starts), -1)
    train = blocks_of(t.select("t", "l", "v"), pivots, f"{path}/train")
    queries = blocks_of(q.select("q", F.lit(0).cast("long").alias("l"), "v"), pivots, f"{path}/queries")
    pairs = stored(bounded_pairs(queries, train), f"{path}/pairs")
    nearest_block = pairs.groupBy("q_block").agg(F.min(F.struct("between", "block")).alias("b")).select("q_block", F.col("b.block").alias("block"))
    first = stored(met(nearest_block, queries, train, k, None), f"{path}/first")
    limits = stored(limits_of(first, queries, k), f"{path}/limits")
    rest = pairs.join(limits.select("q_block", "limit"), "q_block").filter("low <= limit").join(nearest_block, ["q_block", "block"], "left_anti").select("q_block", "block")
    rest = stored(rest, f"{path}/rest")
    return first.unionByName(met(rest, queries, train, k, limits)).drop("q_block"), nearest_block.unionByName(rest), pairs


def nearest_of_all(q: DataFrame, t: DataFrame, k: int) -> DataFrame:
    """(q, t, l, d): the k nearest of each query (q, v) among all rows (t, l, v)."""
    if t.isEmpty():
        return t.select(F.col("t").alias("q"), "t", "l", F.lit(0.0).alias("d"))
    found = meetings(q, t, k)[0]
    for by in (["q", F.pmod(F.xxhash64("t"), F.lit(SALTS)).alias("salt")], ["q"]):
        best = found.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "t", "l"))), 1, k).alias("best"))
        found = best.select("q", F.inline("best")).select("q", "t", "l", "d")
    return found

"""Exact k-nearest-neighbour classification.

The training vectors are packed into blocks of bounded size. A batch of queries meets a block as one matrix product, which
picks a few more candidates than k; those are computed again without cancellation, and the k best of a block remain. Where
more vectors than these are as near as the k-th within rounding, as copies are, all of them are computed again.

If the blocks together are under BROADCAST_BYTES, which is counted, they are broadcast and nothing is shuffled. Otherwise
(balls.py) blocks are balls of vectors near a pivot, a block's nearest neighbour gives each query a first k-th distance, and only
pairs of blocks that the triangle inequality does not rule out meet as rows; their k best are merged in two steps, so that no list
grows with the table.
Ties of distance go to the smaller training id, ties of votes to the smaller label.

places() ranks all training vectors of each query, without a limit, and returns the places of those that share its label or id.
Blocks are written in order of their labels. A task has a group of queries and reads the blocks in place: first, one at a time,
those of its labels, whose distances it keeps in order (HELD of them at most, or one query's), then all, some of them together (MEET_BYTES), as
matrix products. A query's products are sorted with its kept distances, which shows how many rows of other labels come before each.
Products that rounding leaves open are computed again without cancellation.
Only vectors are shuffled, never a row for each pair; places_of() hands a query's places to a function in the task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import matrix
from quern.operators import balls, ranges
from quern.operators.balls import distances, nearest, unpack
from quern.session import shared_dir
from quern.sources.tile_source import place

K = 5
BLOCK_ROWS = 4096
BROADCAST_BYTES = 64 << 20
#: Distances that a task keeps when rows are ranked, and queries that it takes at a time: at most, and at least where there are fewer than TASKS groups.
HELD = 1 << 23
GROUP, LEAST_GROUP, TASKS = 256, 32, 64
#: Queries of a matrix product, and bytes of vectors that meet a group of queries together.
QUERIES, MEET_BYTES = 32, 64 << 20


def packed(train: DataFrame) -> DataFrame:
    """(low, high, ids, labels, vectors): BLOCK_ROWS training rows as one row, where a partition has as many, with the least and the largest label."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                labels = np.asarray(part.column(1))
                data = [np.asarray(part.column(0)).tobytes(), labels.tobytes(), matrix(part.column(2)).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([labels.min()]), pa.array([labels.max()]), *(pa.array([x], pa.binary()) for x in data)], names=["low", "high", "ids", "labels", "vectors"])

    return train.mapInArrow(apply, "low long, high long, ids binary, labels binary, vectors binary")


def neighbours(queries: DataFrame, train: DataFrame, query_id: str, train_id: str, vector: str, label: str, k: int = K) -> DataFrame:
    """(query_id, train_id, label, distance2): the k nearest of each query. Rows with a null id, label or vector take no part."""
    q = queries.select(F.col(query_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).dropna()
    t = train.select(F.col(train_id).cast("long").alias("t"), F.col(label).cast("long").alias("l"), F.col(vector).cast("array<double>").alias("v")).dropna()
    n, most = t.agg(F.count("*"), F.max(F.size("v"))).first()
    names = ["q", "t", "l", "d"]
    ddl = "q long, t long, l long, d double"

    def rows(q_ids: np.ndarray, q: np.ndarray, blocks: list) -> pa.RecordBatch:
        found = []
        for ids, labels, train in blocks:
            d, at = nearest(q, ids, train, k)
            found.append((d, ids[at], labels[at]))
        d, ids, labels = (np.concatenate([f[i] for f in found], 1) for i in range(3))
        order = np.lexsort((ids, d), axis=1)[:, :k]
        d, ids, labels = (np.take_along_axis(x, order, 1) for x in (d, ids, labels))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, d.shape[1])), *(pa.array(x.ravel()) for x in (ids, labels, d))], names=names)

    if n * ((most or 0) + 2) * 8 <= BROADCAST_BYTES:
        shared = q.sparkSession.sparkContext.broadcast([(bytes(r.ids), bytes(r.labels), bytes(r.vectors)) for r in packed(t).collect()])

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [unpack(*b) for b in shared.value]
            for batch in batches:
                if batch.num_rows and blocks:
                    yield rows(np.asarray(batch.column(0)), matrix(batch.column(1)), blocks)

        found = q.mapInArrow(apply, ddl)
    else:
        found = balls.nearest_of_all(q, t, k)
    return found.select(F.col("q").alias(query_id), F.col("t").alias("train_id"), F.col("l").alias("label"), F.col("d").alias("distance2"))


def places(queries: DataFrame, train: DataFrame, query_id: str, train_id: str, vector: str, label: str) -> DataFrame:
    """(query_id, train_id, place): where each training row of the query's label or id stands among all rows, from 0, by distance and then by id.

    Rows with a null id or vector take no part; a row with a null label is ranked, and its label equals no other.
    """

    def of(q_id: int, ids: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        return [np.full(len(ids), q_id), ids, place]

    return places_of(queries, train, query_id, train_id, vector, label, of, f"{query_id} long, train_id long, place long")


def places_of(queries: DataFrame, train: DataFrame, query_id: str, train_id: str, vector: str, label: str, of: Callable, ddl: str) -> DataFrame:
    """What `of(query id, ids, places)` makes of each query's rows of places(): a list of columns, as ddl names them; nothing else leaves the task."""
    none = -(1 << 63)

    def columns(df: DataFrame, key: str, absent: int) -> DataFrame:
        own = F.coalesce(F.col(label).cast("long"), F.lit(absent))
        return df.select(F.col(key).cast("long").alias("i"), own.alias("l"), F.col(vector).cast("array<double>").alias("v")).dropna()

    return counted(columns(queries, query_id, none), columns(train, train_id, none + 1), of, ddl)


def own_places(train: DataFrame, asked: Column | str, train_id: str, vector: str) -> DataFrame:
    """(query_id, train_id, place): where each training row that is asked for stands in its own ranking, without the other rows' distances.

    Nothing is nearer to a vector than its copies, at distance zero, so that its place is that among the copies, by id. (Components must
    not differ by less than 1e-154, whose square is zero; single precision has no such numbers.) Rows are put in order of vector and
    id by ranges, however many copies a vector has. Vectors with NaN or infinite components, which have no distance to themselves, are ranked by places_of().
    """
    rows = train.withColumn("i", F.col(train_id).cast("long")).withColumn("v", F.transform(F.col(vector).cast("array<double>"), lambda x: x + 0.0)).dropna(subset=["i", "v"])
    rows = rows.withColumn("asked", asked if isinstance(asked, Column) else F.expr(asked)).select("i", "v", "asked")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    near = ranges.numbered(rows.filter(~odd), ["v", "i"], "at")
    copies = near.groupBy("v").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1")
    found = near.filter("asked").join(copies, "v", "left").select(F.col("i").alias("query_id"), F.col("i").alias("train_id"), (F.col("at") - F.coalesce("first", "at")).cast("long").alias("place"))
    strange = rows.filter("asked").filter(odd)
    if strange.isEmpty():
        return found

    def of(q_id: int, ids: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
        own = ids == q_id
        return [np.full(own.sum(), q_id), ids[own], places[own]]

    unlabelled = rows.withColumn("l", F.lit(None).cast("long"))
    return found.unionByName(places_of(unlabelled.filter("asked").filter(odd), unlabelled, "i", "i", "v", "l", of, "query_id long, train_id long, place long"))


def counted(q: DataFrame, t: DataFrame, of: Callable, ddl: str) -> DataFrame:
    """places_of() for rows (i, l, v), by counting the rows of other labels before each row of a query's label."""
    path = shared_dir(q.sparkSession, "places")
    dealt = t.repartitionByRange("l", "i").sortWithinPartitions("l")
    # small row groups, as a task reads a few blocks at a time
    packed(dealt).write.option("compression", "none").option("parquet.block.size", 8 << 20).parquet(path)
    most = t.groupBy("l").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    n = q.count()
    size = max(1, min(HELD // most, GROUP, max(LEAST_GROUP, n // TASKS)))
    # a query's rows of its own id, few, for those of another label
    own = t.join(q.select("i").distinct(), "i", "left_semi").groupBy("i").agg(F.collect_list(F.struct("l", "v")).alias("own"))
    groups = q.join(own, "i", "left").select("i", "l", "v", "own").repartitionByRange(max(1, math.ceil(n / size)), "l", "i").sortWithinPartitions("l", "i")
    names = [f.split()[0] for f in ddl.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                for columns in ranked(Group(*(np.asarray(part.column(c)) for c in range(2)), matrix(part.column(2)), part.column(3)), path):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in of(*columns)], names=names)

    return groups.mapInArrow(apply, ddl)


def blocks_at(path: str, low: int | None = None, high: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The blocks that packed() has made, one at a time; those only whose labels meet a range, if it is given."""
    files, root = place(path)
    found = sorted(f.path for f in files.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))
    within = None if low is None else (ds.field("low") <= int(high)) & (ds.field("high") >= int(low))
    rows = ds.dataset(found, filesystem=files, format="parquet")
    for batch in rows.to_batches(columns=["ids", "labels", "vectors"], filter=within, batch_size=4, batch_readahead=1, fragment_readahead=1, use_threads=False):
        for i in range(batch.num_rows):
            yield unpack(*(c[i].as_buffer() for c in batch.columns))


class Group(NamedTuple):
    """Queries that meet the blocks together, in order of their labels; own holds the training rows of each one's id."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    own: pa.Array


class Wanted:
    """The rows of one label: by query, their distances in order, and how many other rows come before each of them."""

    def __init__(self, first: int, ids: list[np.ndarray], far: list[np.ndarray]):
        ids, far = np.concatenate(ids), np.concatenate(far, 1)
        by_id = np.argsort(ids, kind="stable")
        self.first, self.ids = first, ids[by_id]
        self.order, self.ahead, self.far = np.empty(far.shape, np.int32), np.zeros(far.shape, np.int32), far
        #: how many distances of a query are finite; the others come last
        self.finite = np.isfinite(far).sum(1).tolist()
        for i in range(len(far)):
            d = far[i, by_id]
            order = np.argsort(d) if self.finite[i] == len(d) else np.argsort(d, kind="stable")
            new = d[order][1:] != d[order][:-1]
            if self.finite[i] == len(d) and not new.all():  # equal distances go by id
                order = np.sort(np.append(0, np.cumsum(new)) * len(d) + order) % len(d)
            self.order[i], far[i] = order, d[order]

    def count(self, i: int, query: np.ndarray, rough: np.ndarray, error: float, rows: Callable) -> None:
        """Counts rows whose distances are within error/2 of rough; rows(mask) are the ids and vectors of some of them."""
        far = self.far[i, : self.finite[i]]
        before, open_ = merged(far, rough, error)
        if open_ is not None:
            # rows that rounding may place on either side of a wanted one are computed again, as copies are
            self.decide(i, query, *rows(open_))
            rough = rough[~open_]
            before, _ = merged(far, rough, -1.0)
        self.ahead[i, : len(far)] += before
        self.ahead[i, len(far) :] += np.isfinite(rough).sum()

    def decide(self, i: int, query: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        far, d = self.far[i], distances(query, vectors)
        low, high = np.searchsorted(far, d, "left"), np.searchsorted(far, d, "right")
        tied = high > low
        if tied.any():  # complex numbers are in order of two keys: the distance, and the id's place among the wanted ids
            start, end = int(low[tied].min()), int(high[tied].max())
            keys = far[start:end] + 1j * self.order[i, start:end]
            low[tied] = start + np.searchsorted(keys, d[tied] + 1j * (np.searchsorted(self.ids, ids[tied], "right") - 0.5))
        self.ahead[i] += np.cumsum(np.bincount(low, minlength=len(far) + 1)[:-1])


def merged(far: np.ndarray, rough: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray | None]:
    """How many of `rough` come before each of `far`, which is in order and finite, and a mask of those of `rough` that are within error of one, if any is.

    All are sorted together, with those of `far` marked by the last bit, which changes less than rounding does.
    """
    n = len(rough)
    both = np.empty(n + len(far) + 2)
    bits = both.view(np.int64)
    both[:n], both[n:-2], both[-2:] = rough, far, (-np.inf, np.inf)
    bits[:n] &= -2
    bits[n:-2] |= 1
    both.sort()
    marked = (bits & 1).astype(bool)
    before = np.flatnonzero(marked) - np.arange(1, len(far) + 1)
    tight = (both[1:] - both[:-1] <= error) & (marked[1:] != marked[:-1])
    if not tight.any():
        return before, None
    at = np.flatnonzero(tight)
    ends = np.append(np.unique(np.where(marked[at], both[at], both[at + 1])), np.nan)
    return before, ends[np.searchsorted(ends, rough - 2 * error)] <= rough + 2 * error


def together(blocks: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    """Blocks in lists of at most `most` bytes of vectors, or of one block."""
    held, size = [], 0
    for block in blocks:
        if held and size + block[2].nbytes > most:
            yield held
            held, size = [], 0
        held.append(block)
        size += block[2].nbytes
    if held:
        yield held


def meet(group: Group, wanted: dict[int, Wanted], blocks: list[tuple]) -> None:
    """Counts the rows of some blocks for the wanted rows of every query, but those of the query's own label."""
    if len(wanted) == 1:
        blocks = [b for b in blocks if (b[1] != next(iter(wanted))).any()]
    if not blocks or not wanted:
        return
    labels = np.concatenate([b[1] for b in blocks])
    ends = np.cumsum([len(b[0]) for b in blocks]).tolist()

    def rows(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [(b[0][m], b[2][m]) for b, m in zip(blocks, np.split(some, ends[:-1]), strict=True) if m.any()]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    with np.errstate(invalid="ignore", over="ignore"):
        squares = np.concatenate([np.einsum("ij,ij->i", b[2], b[2]) for b in blocks])
        lengths = (group.vectors * group.vectors).sum(1)
        # vectors without a length, and a few that are much longer than others, would leave all open
        apart = odd = ~np.isfinite(squares)
        long = ~(squares <= 100 * np.median(squares))
        apart = long if long.sum() * 64 <= len(long) else apart
        most = 4 * (lengths + squares[~apart].max(initial=0.0))
        error = 4 * (group.vectors.shape[1] + 4) * np.finfo(np.float64).eps * most + np.finfo(np.float64).tiny
        products = np.empty((min(QUERIES, len(lengths)), len(squares)))
        label = None
        for at in range(0, len(lengths), QUERIES):
            part = -2 * group.vectors[at : at + QUERIES]
            for block, end in zip(blocks, ends, strict=True):
                np.matmul(part, block[2].T, out=products[: len(part), end - len(block[0]) : end])
            for i, rough in enumerate(products[: len(part)], at):
                if group.labels[i] not in wanted:
                    continue
                if label != group.labels[i]:
                    label = group.labels[i]
                    kept = wanted[int(label)]
                    other = labels != label
                    # what is infinite comes before no wanted row
                    added = np.where(other & ~apart, squares, np.inf)
                own = i - kept.first
                exact = other if not np.isfinite(most[i]) else other & apart
                if exact.any():
                    kept.decide(own, group.vectors[i], *rows(exact))
                if np.isfinite(most[i]):
                    rough += added
                    rough += lengths[i]
                    if odd.any():
                        rough[odd] = np.inf
                    kept.count(own, group.vectors[i], rough, error[i], rows)


def ranked(group: Group, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, ids, places) of each query. The blocks are read twice: those with the queries' labels, and then all."""
    ids: dict[int, list] = {}
    far: dict[int, list] = {}
    starts = np.append(np.flatnonzero(np.append(True, np.diff(group.labels) != 0)), len(group.labels))
    span = {int(group.labels[a]): slice(int(a), int(b)) for a, b in itertools.pairwise(starts)}
    for block_ids, labels, vectors in blocks_at(path, group.labels.min(), group.labels.max()):
        for label in set(np.unique(labels).tolist()) & set(span):
            rows = labels == label
            same = vectors if rows.all() else vectors[rows]
            ids.setdefault(label, []).append(block_ids[rows])
            far.setdefault(label, []).append(np.stack([distances(q, same) for q in group.vectors[span[label]]]))
    wanted = {label: Wanted(span[label].start, ids.pop(label), far.pop(label)) for label in list(ids)}

    others = {}
    for i, own in enumerate(group.own.to_pylist()):
        apart = np.array([r["v"] for r in own or [] if r["l"] != group.labels[i]], np.float64)
        if len(apart):
            others[i] = np.sort(distances(group.vectors[i], apart))
    ahead = {i: np.arange(len(d)) - np.searchsorted(d, d) for i, d in others.items()}
    for blocks in together(blocks_at(path), MEET_BYTES):
        meet(group, wanted, blocks)
        for (i, far_own), (block_ids, labels, vectors) in itertools.product(others.items(), blocks):
            d = distances(group.vectors[i], vectors)
            earlier = (block_ids < group.ids[i]) | ((block_ids == group.ids[i]) & (labels == group.labels[i]))
            for at, x in enumerate(far_own):  # what is not a number comes last
                less, same = (~np.isnan(d), np.isnan(d)) if np.isnan(x) else (d < x, d == x)
                ahead[i][at] += int((less | (same & earlier)).sum())
        del blocks  # before the next ones are read

    for i, (q_id, label) in enumerate(zip(group.ids.tolist(), group.labels.tolist(), strict=True)):
        found, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if label in wanted:
            rows, own = wanted[label], i - wanted[label].first
            found = rows.ids[rows.order[own]]
            at = np.arange(len(found)) + rows.ahead[own]
        if i in others:
            found, at = np.append(found, np.full(len(ahead[i]), q_id)), np.append(at, ahead[i])
        yield q_id, found, at


def vote(found: DataFrame, query_id: str) -> DataFrame:
    """(query_id, prediction): the most frequent label, the smallest of several."""
    votes = found.groupBy(query_id, "label").agg(F.count("*").alias("votes"))
    best = votes.groupBy(query_id).agg(F.min(F.struct((-F.col("votes")).alias("less"), "label")).alias("best"))
    return best.select(query_id, F.col("best.label").alias("prediction"))


def classify(queries: DataFrame, train: DataFrame, query_id: str, train_id: str, vector: str, label: str, k: int = K) -> DataFrame:
    """(query_id, prediction) by majority vote of the k nearest, uniformly weighted."""
    missing = {train_id, vector, label} - set(train.columns)
    if missing:
        raise KeyError(f"the training table lacks {sorted(missing)}")
    return vote(neighbours(queries, train, query_id, train_id, vector, label, k), query_id)

"""Covariance, PCA whitening, multi-scale means, gradient clipping and layer-wise adaptive steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.vectors import doubles, l2_norm, matrix, mean_of

FLOOR = 1e-5
#: Components up to which the whole matrix of moments is decomposed, and components of a band of partial sums.
FULL, BAND = 2048, 4096


def covariance(rows: DataFrame, vector: str) -> DataFrame:
    """(i, j, value): the second moments of the components, without centring; dim * dim sums, added per batch first."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                total = x.T @ x if total is None else total + x.T @ x
                n += len(x)
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel()), pa.array(np.full(total.size, n, np.int64))], names=["i", "j", "s", "n"])

    sums = rows.select(doubles(vector).alias("v")).dropna().mapInArrow(apply, "i int, j int, s double, n long")
    return sums.groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("value"))


def products(rows: DataFrame, vector: str, directions: np.ndarray) -> np.ndarray:
    """The second moments times a thin matrix (components x few): its partial sums are added in bands of BAND components."""
    shared = rows.sparkSession.sparkContext.broadcast(directions)
    blocks = "band int, data binary, n long"

    def packed(bands: dict[int, np.ndarray], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(bands), pa.int32()), pa.array([x.tobytes() for x in bands.values()], pa.binary()), pa.array([n] * len(bands), pa.int64())], names=["band", "data", "n"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thin, total, n = shared.value, None, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                part = x.T @ (x @ thin)
                total, n = part if total is None else np.add(total, part, out=total), n + len(x)
        if total is not None:
            yield packed({i: total[at : at + BAND] for i, at in enumerate(range(0, len(total), BAND))}, n)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            for band, data, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(data.as_buffer()).reshape(-1, directions.shape[1])
                sums[band] = sums[band] + x if band in sums else x
                counts[band] = counts.get(band, 0) + n
        for band, x in sums.items():
            yield packed({band: x}, counts[band])

    parts = rows.select(doubles(vector).alias("v")).dropna().mapInArrow(partial, blocks)
    bands = parts.repartition("band").mapInArrow(added, blocks).collect()  # components x few numbers
    shared.destroy()
    return np.concatenate([np.frombuffer(b.data).reshape(-1, directions.shape[1]) / b.n for b in sorted(bands, key=lambda b: b.band)])


def top_directions(rows: DataFrame, vector: str, dim: int, spare: int = 8, most_rounds: int = 40, close: float = 1e-10, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(the `dim` largest eigenvalues of the second moments, their unit vectors as columns) by randomised subspace iteration.

    A random subspace of dim + spare directions is multiplied by the moments, a pass over the rows each time, and made
    orthogonal, until its eigenvalues change by less than `close` of the largest. The driver holds components x (dim + spare)
    numbers, never components x components.
    """
    size = rows.agg(F.max(F.size(vector))).first()[0] or 0
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(size, dim + spare))))[0]
    before = np.zeros(q.shape[1])
    for _ in range(most_rounds):
        y = products(rows, vector, q)
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        settled = np.abs(values - before)[:dim].max(initial=0) <= close * max(values[0], 1e-300)
        before = values
        if settled:
            break
        q = np.linalg.qr(y @ turn)[0]
    return values[:dim], vectors[:, :dim]


class Whitening:
    """Principal directions of the second moments; eigenvalues under FLOOR of the largest count as that.

    Up to FULL components the driver decomposes the whole matrix. Beyond it, top_directions() finds those asked for, and the
    energy of the others is the rest of the trace, without the floor.
    """

    def __init__(self, cov: np.ndarray, dim: int, whiten: float = 0.5, mean: np.ndarray | None = None):
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)[:dim]
        floor = FLOOR * values.max()
        self._take(values[order], vectors[:, order], float(np.maximum(values, floor).sum()), whiten, mean)

    def _take(self, values: np.ndarray, vectors: np.ndarray, total: float, whiten: float, mean: np.ndarray | None) -> None:
        values = np.maximum(values, FLOOR * values.max())
        self.energy = float(100 * values.sum() / total)
        self.values = values
        self.directions = (vectors / values**whiten).T
        self.mean = mean

    @classmethod
    def fit(cls, rows: DataFrame, vector: str, dim: int, whiten: float = 0.5, full: int = FULL) -> Whitening:
        n, size, trace = rows.filter(F.col(vector).isNotNull()).agg(F.count("*"), F.max(F.size(vector)), F.avg(F.pow(l2_norm(doubles(vector)), 2))).first()
        if n and size > full:
            out = cls.__new__(cls)
            out._take(*top_directions(rows, vector, dim), trace, whiten, None)
            return out
        cells = covariance(rows, vector).collect()  # at most full * full numbers
        size = max((c.i for c in cells), default=-1) + 1
        cov = np.zeros((size, size))
        for c in cells:
            cov[c.i, c.j] = c.value
        return cls(cov, dim, whiten)

    def apply(self, rows: DataFrame, keep: list[str], vector: str) -> DataFrame:
        """keep and `projected`."""
        shared = rows.sparkSession.sparkContext.broadcast((self.directions, self.mean))
        schema = rows.select(*keep, doubles(vector).alias("projected")).schema

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            directions, mean = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column(batch.num_columns - 1))
                y = (x if mean is None else x - mean) @ directions.T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=schema.names)

        return rows.filter(F.col(vector).isNotNull()).select(*keep, doubles(vector).alias("projected")).mapInArrow(project, schema)


def multi_scale(rows: DataFrame, keep: list[str], scales: list[str]) -> DataFrame:
    """keep and `feature`: the mean over the scales' vectors, divided by the norm of all rows' means together."""
    mean = rows.select(*keep, mean_of(*[doubles(s) for s in scales]).alias("feature"))
    total = mean.agg(F.sqrt(F.sum(F.pow(l2_norm(F.col("feature")), 2))).alias("norm"))  # one row
    return mean.crossJoin(F.broadcast(total)).select(*keep, F.transform("feature", lambda x: x / F.col("norm")).alias("feature"))


def clip_gradients(gradients: DataFrame, name: str, values: str, clip: float) -> DataFrame:
    """Adds norm (before clipping) and clipped: each tensor scaled to norm `clip` at most."""
    v = doubles(values)
    share = clip / (F.col("norm") + 1e-6)
    return gradients.withColumn("norm", l2_norm(v)).withColumn("clipped", F.transform(v, lambda x: F.when(share < 1, x * share).otherwise(x)))


def adaptive_step(p: Column, g: Column, mu: Column, shape: Column, rate: float, decay: float, eta: float, momentum: float = 0.9) -> Column:
    """(mu, p) after a layer-wise adaptive step with momentum: only tensors of two dimensions or more decay and take a trust ratio."""
    decayed = F.when(F.size(shape) > 1, F.zip_with(g, p, lambda x, y: x + decay * y)).otherwise(g)
    pn, gn = l2_norm(p), l2_norm(decayed)
    trust = F.when((F.size(shape) > 1) & (pn > 0) & (gn > 0), eta * pn / gn).otherwise(1.0)
    moved = F.zip_with(mu, decayed, lambda x, y: momentum * x + trust * y)
    return F.struct(moved.alias("mu"), F.zip_with(p, moved, lambda x, y: x - rate * y).alias("p"))

"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

Each unit vector is turned by a random rotation; the signs of its turned components, one bit each, are its code, and the
inner product of the vector with its code's unit vector is its correction factor. For two vectors, the inner product of one,
turned, with the other's code vector over that factor is an unbiased estimate of theirs; its error is bounded with high
confidence by BOUND * sqrt((1 - f*f) / f / f / (dim - 1)). A pair whose upper bound is under the threshold is dropped; every
other pair is computed exactly, in double precision, so no pair below it links. The estimates of a block are one product in
single precision, a third of the cost of the exact one.

Candidates: the first bits of the code of one rotation are a bucket, with the label; there are enough rotations ("tables")
that a pair at the threshold meets in one with probability RECALL, and closer pairs with more. The number of bits grows with
the largest label, so buckets hold about 2**WIDER unlike vectors, whose pairs the codes' bounds decide. A pair that meets in several tables counts in the first.

Vectors with equal components and label (by two 64-bit hashes) are one class, joined by definition: their copies meet as one
row that carries their number. Buckets above BLOCK classes are cut into blocks, and pairs of blocks are tasks of their own, so that no
bucket is collected into one; links leave a task as counts and a spanning forest.

Defined results: vectors that are null, of another length than their partner, zero, or hold null or non-finite components,
and rows without a label, link with nothing; rows that share an id are vectors of their own; null ids name no component;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import shared_dir, stored
from quern.llm.components import components, salted_join

THRESHOLD = 0.98
RECALL = 0.998
BOUND = 4.0
#: What single precision may add to an estimate.
ROUNDING = 1e-4
BLOCK = 256
#: Bits by which a bucket's key is shorter than the logarithm of the vectors: fewer tables, and pairs that codes decide.
WIDER = 3
SEED = 20240501


@functools.cache
def rotation(dim: int, turn: int) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, turn]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(largest: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a bucket, number of tables) for this many vectors of one label."""
    same = 1 - math.acos(threshold) / math.pi
    bits = max(4, min(40, math.ceil(math.log2(max(2, largest))) - WIDER))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same**bits)))


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signs of the turned vectors, their correction factors)."""
    turned = unit @ rotation(unit.shape[1], 0)
    return turned >= 0, np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def estimates(unit: np.ndarray, signs: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimates of all inner products of rows with rows, by the codes of the second; margin of each second)."""
    dim = unit.shape[1]
    turned = unit.astype(np.float32) @ rotation(dim, 0).astype(np.float32)
    code = signs.astype(np.float32) * np.float32(2) - np.float32(1)
    margin = BOUND * np.sqrt((1 - np.minimum(factors, 1) ** 2) / factors**2 / max(1, dim - 1)) + ROUNDING
    return turned @ (code / (factors * math.sqrt(dim))[:, None].astype(np.float32)).T, margin


def buckets(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The bucket of each vector in each table: the first bits of a rotation's code, of as many rotations as that takes."""
    n, dim = unit.shape
    out = np.zeros((n, tables), np.int64)
    got = 0
    signs = np.zeros((n, 0), bool)
    for table in range(tables):
        while signs.shape[1] < bits:
            signs = np.concatenate([signs, unit @ rotation(dim, 1000 + got) >= 0], 1)
            got += 1
        out[:, table] = signs[:, :bits] @ (1 << np.arange(bits, dtype=np.int64))
        signs = signs[:, bits:]
    return out


def find(raw: np.ndarray, signs: np.ndarray, factors: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs i < j that the bound leaves to exact recomputation, whether their cosine is at the threshold or above)."""
    norm = np.linalg.norm(raw, axis=1)
    estimate, margin = estimates(raw / norm[:, None], signs, factors)
    i, j = np.nonzero(estimate >= (threshold - margin)[None, :].astype(np.float32))
    i, j = i[i < j], j[i < j]
    cosine = (raw[i] * raw[j]).sum(1) / (norm[i] * norm[j])
    return i, j, cosine >= threshold


def coded(rows: DataFrame, bits: int, tables: int, kind: str) -> DataFrame:
    """One row per class and table: label, table, bucket, node, copies, all buckets, code, correction factor, vector."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "table", "bucket", "node", "copies", "keys", "code", "factor", "vector"]
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(3)
            sizes = np.diff(np.asarray(vectors.offsets))
            flat = np.asarray(vectors.flatten()).astype(np.float64)
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                part = batch.take(pa.array(at))
                raw = flat.reshape(-1, dim) if len(at) == batch.num_rows else np.stack([np.asarray(vectors[int(i)].values).astype(np.float64) for i in at])
                unit = raw / np.linalg.norm(raw, axis=1)[:, None]
                keys = buckets(unit, bits, tables)
                signs, factors = codes(unit)
                n = len(at)
                code = pa.array([x.tobytes() for x in np.packbits(signs, axis=1)], pa.binary())
                every = np.repeat(np.arange(n), tables)
                out = part.take(pa.array(every))
                # vectors of other lengths never meet
                bucket = keys.ravel() + (np.int64(dim) << 40)
                keys_column = pa.ListArray.from_arrays(pa.array(np.arange(0, n * tables + 1, tables, dtype=np.int32)), pa.array(keys.ravel())).take(pa.array(every))
                yield pa.RecordBatch.from_arrays([out.column(0), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(bucket), out.column(1), out.column(2), keys_column, code.take(pa.array(every)), pa.array(factors[every]), out.column(3)], names=names)

    return rows.mapInArrow(apply, f"label string, table int, bucket long, node binary, copies long, keys array<long>, code binary, factor double, vector {kind}")


def links(dealt: DataFrame, threshold: float) -> DataFrame:
    """From rows sorted by (label, table, bucket, block_a, block_b): (a, b, n, exact) with b null for counts of links, and forest edges.

    Without a and b, n is how many pairs of a task were estimated and exact how many of them were computed exactly.
    """

    seen = Counter()

    def linked(nodes: list[bytes], copies: np.ndarray, keys: np.ndarray, code: np.ndarray, factors: np.ndarray, raw: np.ndarray, block: np.ndarray, table: int, a: int, b: int) -> Iterator[tuple[bytes | None, bytes | None, int]]:
        dim = raw.shape[1]
        i, j, ok = find(raw, np.unpackbits(code, axis=1)[:, :dim], factors, threshold)
        seen["estimated"] += len(raw) * (len(raw) - 1) // 2
        seen["exact"] += len(i)
        i, j = i[ok], j[ok]
        if a != b:  # pairs inside a block belong to the block's own task
            across = block[i] != block[j]
            i, j = i[across], j[across]
        earlier = (keys[i, :table] == keys[j, :table]).any(1) if table else np.zeros(len(i), bool)
        i, j = i[~earlier], j[~earlier]
        if not len(i):
            return
        counts = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
        for k in np.flatnonzero(counts).tolist():
            yield nodes[k], None, int(counts[k])
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                yield nodes[x], nodes[y], 0

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        seen.clear()

        def done() -> list:
            n = sum(h.num_rows for h in held)
            if n < 2:
                return []
            column = lambda c: np.concatenate([np.asarray(h.column(c)) for h in held])
            lists = lambda c: np.concatenate([np.asarray(h.column(c).flatten()) for h in held]).reshape(n, -1)
            code = np.stack([np.frombuffer(x.as_buffer(), np.uint8) for h in held for x in h.column(8)])
            nodes = [x for h in held for x in h.column(5).to_pylist()]
            return list(linked(nodes, column(6), lists(7), code, column(9), lists(10).astype(np.float64), column(11), now[1], now[3], now[4]))

        out: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True))
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    if keys[at] != now:
                        out += done()
                        held, now = [], keys[at]
                    held.append(batch.slice(at, i - at))
                    at = i
            if len(out) > 10_000:
                yield rows(out)
                out = []
        if now is not None:
            out += done()
        yield rows(out)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([seen["estimated"]]), pa.array([seen["exact"]])], names=["a", "b", "n", "exact"])

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))), pa.nulls(len(out), pa.int64())], names=["a", "b", "n", "exact"])

    return dealt.mapInArrow(apply, "a binary, b binary, n long, exact long")


@dataclass
class Found:
    """members: (vec_id, node); nodes: (label, node, copies, least, vector); links: see links()."""

    members: DataFrame
    nodes: DataFrame
    links: DataFrame

    def decided(self) -> tuple[int, int]:
        """(pairs that were estimated, pairs among them that were computed exactly); the bound dropped the others."""
        sums = self.links.filter("a IS NULL").agg(F.sum("n"), F.sum("exact")).first()
        return sums[0] or 0, sums[1] or 0


def find_links(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> Found:
    """Classes of equal vectors, and the links between them."""
    spark = df.sparkSession
    path = shared_dir(spark, "vectors")
    kind = dict(df.dtypes)[vector]
    kind = kind if kind == "array<float>" else "array<double>"  # single precision travels as it is
    values = F.col(vector).cast(kind)
    fine = F.col("vector").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), values.alias("vector"))
    digest = F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64("label", "vector"), F.xxhash64(F.lit("node"), "vector", "label"))]))
    rows = rows.withColumn("node", F.when(F.coalesce(fine, F.lit(False)), digest))
    members = rows.select("vec_id", "node")
    nodes = rows.filter("node IS NOT NULL").groupBy("label", "node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    nodes = stored(nodes, f"{path}/nodes")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(largest, threshold, recall)
    dim = nodes.select(F.max(F.size("vector"))).first()[0] or 1
    table = coded(nodes.select("label", "node", "copies", "vector"), bits, tables, kind) if dim else None
    sizes = table.select("label", "table", "bucket").groupBy("label", "table", "bucket").agg(F.count("*").alias("size")).filter("size > 1")
    table = table.join(sizes, ["label", "table", "bucket"])
    blocks = F.ceil(F.col("size") / block).cast("int")
    table = table.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    table = table.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = table.select("label", "table", "bucket", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), "node", "copies", "keys", "code", "factor", "vector", "block")
    by = ["label", "table", "bucket", "block_a", "block_b"]
    return Found(members, nodes, stored(links(dealt.repartition(*by).sortWithinPartitions(*by), threshold), f"{path}/links"))


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    done = find_links(df, key, vector, label, threshold, recall, block)
    members, nodes, found = done.members, done.nodes, done.links.filter("a IS NOT NULL")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    parents = components(found.filter("b IS NOT NULL").select("a", "b"))
    least = parents.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("smallest"))
    placed = salted_join(parents, least, "component", "node").select("node", "smallest")
    per_node = nodes.select("node", "copies", "least").join(counts, "node", "left").join(placed, "node", "left")
    out = salted_join(members, per_node, "node", "vec_id", "left")
    component = F.coalesce("smallest", "least", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("others", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

"""Exact k-means over integer vectors by balls: only centroids that may be nearer than a vector's own are compared with it.

A cluster's members in a block of rows are a ball around its new centroid, with the farthest member's distance as radius. A
centroid is a neighbour of the ball if half its distance from the ball's centre is within the radius; no other centroid can
take a member away. Members nearer than half the distance to the nearest neighbour are the stable core and stay without a
comparison. The rest lie in annuli between one half neighbour distance and the next, and a member of an annulus is compared
with the neighbours up to there only. All of it is done with squared integers, so nothing is lost to rounding: a vector is
compared with a centroid whenever 4 * (its own distance) >= (the centres' distance).

Each round is one map over the rows, written as a table that holds vectors and clusters, and one aggregation that returns as
many rows as there are clusters; the table of the round before is deleted. Tasks get the centroids (some thousand numbers) as
they are; no row is shuffled.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part and have no
row; components beyond +-LIMIT after scaling count as LIMIT, which keeps distances in 64 bits; fewer vectors than clusters
give as many clusters as vectors; an empty table gives an empty result; a null id is hashed as the empty string; rows with
equal ids are vectors of their own, ordered by their components where their hashes tie; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import release, remove, shared_dir, stored

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
LIMIT = 1 << 20


def quantised(df: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """key and v, the vector's components as integers floor(scale * x), of the rows that have such a vector."""
    x = F.col(vector).cast("array<double>")
    whole = F.coalesce((F.size(x) == dimensions) & F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))), F.lit(False))
    bounded = F.transform(x, lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c * scale, F.lit(-2.0 * LIMIT)), F.lit(2.0 * LIMIT))), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return df.filter(whole).select(F.col(key).alias("key"), bounded.alias("v"))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row, all centroids compared; the smaller number of equally near ones."""
    far = np.stack([squared(rows, c) for c in centroids], 1)
    best = far.argmin(1)
    return best, far[np.arange(len(rows)), best]


def moved(rows: np.ndarray, own: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances computed) of each row that was in cluster `own`, after the centroids have moved."""
    between = squared(centroids[:, None], centroids[None])
    home = squared(rows, centroids[own])
    cluster, distance, computed = own.copy(), home.copy(), len(rows)
    for i in np.unique(own):
        at = np.flatnonzero(own == i)
        neighbours = np.flatnonzero(between[i] <= 4 * home[at].max())
        for j in sorted(neighbours[neighbours != i], key=lambda j: between[i, j]):
            at = at[4 * home[at] >= between[i, j]]  # outside the core, in this annulus or a farther one
            if not len(at):
                break
            to = squared(rows[at], centroids[j])
            computed += len(at)
            nearer = (to < distance[at]) | ((to == distance[at]) & (j < cluster[at]))
            cluster[at[nearer]], distance[at[nearer]] = j, to[nearer]
    return cluster, distance, computed


def assigned(state: DataFrame, centroids: np.ndarray, first: bool) -> DataFrame:
    """key, v, cluster and distance; `first` rows have no cluster yet."""
    schema = state.select("key", "v").schema.add("cluster", "integer", False).add("distance", "long", False)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            if first:
                cluster, distance = nearest(rows, centroids)
            else:
                cluster, distance, _ = moved(rows, batch.column("cluster").to_numpy().astype(np.int64), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=schema.names)
        release()

    return state.mapInArrow(apply, schema)


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; clusters without members keep their centroid."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])])
    out = centroids.copy()
    for row in sums.collect():  # one row a cluster
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
    return out


def fit(df: DataFrame, key: str, vector: str, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(key, v, cluster, distance of every vector; final centroids). The first centroids are the vectors with the least hashes of 1:<key>."""
    spark = df.sparkSession
    path = shared_dir(spark, "clustering")
    rows = quantised(df, key, vector, dimensions, scale)
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    starts = rows.orderBy(name, "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in starts], np.int64).reshape(len(starts), dimensions)
    if not len(starts):
        return rows.selectExpr("key", "v", "0 AS cluster", "0L AS distance").limit(0), centroids
    state = stored(assigned(rows, centroids, True), f"{path}/0")
    for i in range(1, rounds + 1):
        centroids = means(state, centroids)
        state = stored(assigned(state, centroids, False), f"{path}/{i}")
        remove(spark, f"{path}/{i - 1}")
    return state, centroids


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", **settings: int) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    state, centroids = fit(df, key, vector, **settings)
    inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a cluster
    spark = df.sparkSession
    facts = [(i, inertia.get(i, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = state.join(F.broadcast(known), "cluster")  # a row a cluster
    return rows.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

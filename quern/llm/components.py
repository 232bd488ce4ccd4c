"""Connected components of a distributed edge list, and joins that a hot key does not hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import shared_dir, stored

SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """left join right on key, where right has one row a key; left's rows of a key are dealt by `spread` to `salts` tasks."""
    right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return salted_join(both, least, "u", "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    least = _least(down)
    own = least.select("u", F.col("m").alias("v"))
    rest = salted_join(down, least, "u", "v").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge (a, b). Alternating large and small stars.

    Each round is a written table, so lineage does not grow. It ends when a round changes nothing.
    """
    spark = edges.sparkSession
    path = shared_dir(spark, "components")
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    now = stored(now, f"{path}/0")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    for i in range(1, most_rounds + 1):
        if not before[0]:
            break
        now = stored(_small_star(_large_star(now)), f"{path}/{i}")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

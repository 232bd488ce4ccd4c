"""Order over a whole table without one task that sees it: ranges of keys as partitions, and offsets from their counts.

Rows are dealt by ranges of the order, so that even a key with a third of them, or a run of equal ones, is cut at the borders of
partitions; `part` is the partition's number. The dealt table is written, as ranges come from a sample and must not change when
a lost task is done again. What is known of a part (counts, ends) is a row, as many as there are partitions for a key that spans
all of them, and only those rows meet in a window over the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import shared_dir, stored

TIE, PART = "__tie", "part"


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `part`: parts follow each other in the order; equal rows may lie in several."""
    rows = df.withColumn(TIE, F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*[F.col(c).asc() for c in order], F.col(TIE).asc()).withColumn(PART, F.spark_partition_id())
    return stored(dealt, f"{shared_dir(df.sparkSession, 'ranges')}/rows")


def numbered(df: DataFrame, order: list[str], index: str) -> DataFrame:
    """df with each row's place in the order, from 0; equal rows in any order, nulls first."""
    rows = ranged(df, order)
    counts = rows.groupBy(PART).agg(F.count("*").alias("__n"))
    # a row a partition
    offsets = counts.select(PART, (F.coalesce(F.sum("__n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
    within = F.row_number().over(Window.partitionBy(PART).orderBy(*order, TIE)) - 1
    placed = rows.withColumn("__within", within).join(F.broadcast(offsets), PART)
    return placed.withColumn(index, F.col("__before") + F.col("__within")).drop("__before", "__within", PART, TIE)


def runs(series: DataFrame, order: list[str], value: str, by: list[str]) -> DataFrame:
    """(by, run, value, length, until): runs of equal consecutive values, and how many rows end with each.

    Each part of a series finds its own runs; parts then learn how many runs and rows come before them, where a part's first run
    goes on with the last one's value it takes that run's number, and pieces of a run are added up. Nulls in `by` are a series.
    """
    rows = ranged(series.select(*by, *order, value), [*by, *order])
    w = Window.partitionBy(*by, PART).orderBy(*order, TIE)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = rows.withColumn("__change", change).withColumn("own", F.sum("__change").over(w))
    pieces = marked.groupBy(*by, PART, "own").agg(F.first(value).alias(value), F.count("*").alias("length"))
    ends = pieces.groupBy(*by, PART).agg(
        F.max("own").alias("n"), F.sum("length").alias("rows"), F.min_by(F.struct(F.col(value).alias("v")), "own").alias("first"), F.max_by(F.struct(F.col(value).alias("v")), "own").alias("last")
    )
    parts = Window.partitionBy(*by).orderBy(PART)  # a row a partition that the series spans
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    joins = F.coalesce((F.lag("last").over(parts)["v"].eqNullSafe(F.col("first")["v"]) & F.lag("last").over(parts).isNotNull()).cast("int"), F.lit(0))
    ends = ends.withColumn("joins", joins)
    ends = ends.withColumn("runs_before", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.sum("joins").over(parts)).withColumn("rows_before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    right = ends.select(*[F.col(c).alias(f"__{c}") for c in by], F.col(PART).alias("__part"), "runs_before", "rows_before")
    same = F.col(PART) == F.col("__part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    own = Window.partitionBy(*by, PART).orderBy("own")
    numbered_pieces = pieces.withColumn("until", F.sum("length").over(own)).join(right, same)
    whole = numbered_pieces.withColumn("run", F.col("runs_before") + F.col("own")).withColumn("until", F.col("rows_before") + F.col("until"))
    return whole.groupBy(*by, "run").agg(F.first(value).alias(value), F.sum("length").alias("length"), F.max("until").alias("until"))

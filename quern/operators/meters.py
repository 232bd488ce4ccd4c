"""Meters over a series, reductions over workers, runs and static ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 20


#: Rows of a chunk of series, about, and chunks at most.
CHUNK_ROWS, MOST_CHUNKS = 1 << 20, 4096


def meter(series: DataFrame, order: list[str], value: str, by: list[str], weight: Column | None = None, size: int = WINDOW, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds value_last, median (the lower of two), avg, max of the last `size` values, and the weighted global_avg so far.

    A long table is cut into ranges of the first column of `order`, so that one long series is no single task: a chunk begins
    with the last rows of the chunks before it, and with their sums.
    """
    names = series.columns
    rows = series.withColumn("__n", weight if weight is not None else F.lit(1))
    n_chunks = min(MOST_CHUNKS, -(-rows.count() // chunk_rows))
    if n_chunks <= 1:
        return metered(rows, order, value, by, size).select(*names, *METER)
    bounds = rows.agg(F.percentile_approx(order[0], [i / n_chunks for i in range(1, n_chunks)], 100 * n_chunks)).first()[0] or []
    kind = rows.schema[order[0]].dataType
    cuts = F.array(*[F.lit(b).cast(kind) for b in sorted(set(bounds))])
    rows = rows.withColumn("__chunk", F.coalesce(F.size(F.filter(cuts, lambda b: b < F.col(order[0]))), F.lit(0)))
    chunk = [*by, "__chunk"]

    # per chunk: how many of its rows the next ones may need, and its sums, with those of all chunks before it
    sums = rows.groupBy(*chunk).agg(F.count("*").alias("__rows"), F.sum(F.col(value) * F.col("__n")).alias("__total"), F.sum("__n").alias("__weight"))
    earlier = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*chunk, *(F.sum(c).over(earlier).alias(a) for c, a in (("__total", "__total"), ("__weight", "__weight"), (F.least("__rows", F.lit(size - 1)), "__before"))))
    last = tail(rows, order, chunk, size - 1).withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy("__chunk", *order)).cast("long"))
    wanted = sums.filter("__before > 0").select(*by, F.col("__chunk").alias("__next"), F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("__before") - (size - 2)), F.col("__before"))).alias("__rank"))
    carried = join_null_safe(last, wanted, [*by, "__rank"]).withColumn("__chunk", F.col("__next"))
    own = [*names, "__n", "__chunk"]
    both = rows.select(*own, F.lit(False).alias("__carried")).unionByName(carried.select(*own, F.lit(True).alias("__carried")))
    out = join_null_safe(metered(both, order, value, chunk, size), sums.drop("__before"), chunk)
    total, many = (F.coalesce(c, F.lit(0)) + F.coalesce(a, F.lit(0)) for c, a in (("__total", "__sum_so_far"), ("__weight", "__weight_so_far")))
    return out.filter(~F.col("__carried")).withColumn("global_avg", F.when(many != 0, total / many)).select(*names, *METER)


METER = ("value_last", "median", "avg", "max", "global_avg")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left join right where the keys are equal or both null, without right's keys."""
    right = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(right, on).drop(*(f"__right_{k}" for k in keys))


def metered(rows: DataFrame, order: list[str], value: str, by: list[str], size: int) -> DataFrame:
    """rows with what their own series shows; rows that are __carried do not count for the sums."""
    series_window = Window.partitionBy(*by).orderBy(*order)
    w = series_window.rowsBetween(-(size - 1), 0)
    so_far = series_window.rowsBetween(Window.unboundedPreceding, 0)
    counts = ~F.col("__carried") if "__carried" in rows.columns else F.lit(True)
    held = F.array_sort(F.collect_list(value).over(w))
    rows = rows.select(
        "*",
        F.col(value).alias("value_last"),
        F.get(held, ((F.size(held) - 1) / 2).cast("int")).alias("median"),
        F.avg(value).over(w).alias("avg"),
        F.max(value).over(w).alias("max"),
        F.sum(F.when(counts, F.col(value) * F.col("__n"))).over(so_far).alias("__sum_so_far"),
        F.sum(F.when(counts, F.col("__n"))).over(so_far).alias("__weight_so_far"),
    )
    return rows.withColumn("global_avg", F.col("__sum_so_far") / F.col("__weight_so_far"))


def tail(series: DataFrame, order: list[str], by: list[str], size: int = WINDOW) -> DataFrame:
    """The last `size` rows of each series: tasks keep that many of each before anything is shuffled."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))
    return series.withColumn("__place", place).filter(F.col("__place") <= size).drop("__place")


def global_average(series: DataFrame, value: str, weight: str, by: list[str]) -> DataFrame:
    return series.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("global_avg"))


def reduce_metrics(metrics: DataFrame, n_workers: int, average: bool = True) -> DataFrame:
    """(name, value) of (worker, name, value): the sum over workers, by the number of workers if averaged. One worker: unchanged."""
    if n_workers < 2:
        return metrics.select("name", "value")
    total = metrics.groupBy("name").agg(F.sum("value").alias("value"))
    return total.withColumn("value", F.col("value") / n_workers) if average else total


def synchronized(meters: DataFrame) -> DataFrame:
    """(name, count, total): workers' counts and totals added; their windows are not merged."""
    return meters.groupBy("name").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))


def static_worker(index: Column, n_rows: Column, n_workers: int) -> Column:
    """The worker of row `index` under equal ranges whose remainder goes to the last; with fewer rows than workers, the last."""
    size = F.floor(n_rows / n_workers)
    return F.when(size == 0, n_workers - 1).otherwise(F.least(F.floor(index / size), F.lit(n_workers - 1))).cast("int")

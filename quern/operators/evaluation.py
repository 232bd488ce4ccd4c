"""Evaluation: top-k accuracy, average precision, and mean average precision with junk."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_scores(scores: DataFrame, row: str, values: str, k: int) -> DataFrame:
    """(row, class, score, rank) of the k largest scores; ties go to the smaller class. Reads one row's array at a time."""
    pairs = F.transform(F.col(values).cast("array<double>"), lambda x, i: F.struct((-x).alias("less"), i.alias("class")))
    ranked = F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p, i: F.struct(p["class"].alias("class"), (-p["less"]).alias("score"), (i + 1).alias("rank")))
    return scores.select(row, F.inline(ranked))


def top_k_accuracy(scores: DataFrame, values: str, target: str, ks: list[int]) -> DataFrame:
    """(k, accuracy): the percentage of rows whose target is among the k best scores."""
    v = F.col(values).cast("array<double>")
    own = F.get(v, F.col(target).cast("int"))
    ahead = F.size(F.filter(v, lambda x, i: (x > own) | ((x == own) & (i < F.col(target))))) + 1
    sums = scores.select(ahead.alias("rank")).agg(*[(100 * F.avg((F.col("rank") <= k).cast("double"))).alias(f"a{k}") for k in ks])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"a{k}").alias("accuracy")) for k in ks])))


def precision_terms(place: Column, j: Column, n_relevant: Column) -> Column:
    """The trapezoid of a relevant item at 0-based `place`, the j-th (from 0) of n_relevant."""
    before = F.when(place == 0, 1.0).otherwise(j / place)
    return (before + (j + 1) / (place + 1)) / (2 * n_relevant)


def average_precision(ranked: DataFrame, query: str, place: str, relevant: DataFrame) -> DataFrame:
    """(query, ap) from the 0-based places of relevant items; `relevant` is (query, n_relevant)."""
    w = Window.partitionBy(query).orderBy(place)
    rows = ranked.withColumn("j", F.row_number().over(w) - 1).join(relevant, query)
    return rows.groupBy(query).agg(F.sum(precision_terms(F.col(place), F.col("j"), F.col("n_relevant"))).alias("ap"))


def evaluate_ranking(ranks: DataFrame, positive: DataFrame, junk: DataFrame, ks: list[int]) -> DataFrame:
    """(query_id, ap, p_<k> ...) for each query with positives.

    ranks is (query_id, place, db_id) from place 0; positive and junk are (query_id, db_id). Junk is taken out of the
    ranking; positives that are not ranked count in the denominator; precision at k is taken at the last positive's place
    if that comes before k. A query without positives has no row, as it counts in no mean.
    """
    key = ["query_id", "db_id"]
    n_relevant = positive.distinct().groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    marked = ranks.join(positive.distinct().withColumn("ok", F.lit(True)), key, "left").join(junk.distinct().withColumn("bad", F.lit(True)), key, "left")
    w = Window.partitionBy("query_id").orderBy("place")
    marked = marked.withColumn("junk_before", F.coalesce(F.sum(F.when(F.col("bad"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hits = marked.filter("ok").select("query_id", (F.col("place") - F.col("junk_before")).alias("place"))
    hits = hits.withColumn("j", F.row_number().over(Window.partitionBy("query_id").orderBy("place")) - 1)
    hits = hits.withColumn("last", F.max("place").over(Window.partitionBy("query_id")) + 1).join(n_relevant, "query_id")
    cut = {k: F.least(F.col("last"), F.lit(k)) for k in ks}
    per_query = hits.groupBy("query_id").agg(
        F.sum(precision_terms(F.col("place"), F.col("j"), F.col("n_relevant"))).alias("ap"),
        *[(F.sum((F.col("place") + 1 <= cut[k]).cast("int")) / F.max(cut[k])).alias(f"p_{k}") for k in ks],
    )
    out = n_relevant.join(per_query, "query_id", "left")
    return out.select("query_id", F.coalesce("ap", F.lit(0.0)).alias("ap"), *[F.coalesce(f"p_{k}", F.lit(0.0)).alias(f"p_{k}") for k in ks])


def sums_ddl(query: str, ks: list[int]) -> str:
    """The columns of ranking_sums(), after the query's id."""
    return ", ".join([f"{query} long", "terms double", *[f"p_{k} double" for k in ks]])


def ranking_sums(positive: np.ndarray, junk: np.ndarray, ks: list[int]) -> list[float | None]:
    """A query's sum of precision_terms() before they are divided by n_relevant, and its precisions, from 0-based places of positive and of junk rows.

    The metrics of evaluate_ranking(), for places that one task has at hand; all are None without positives.
    """
    if not len(positive):
        return [None] * (1 + len(ks))
    at = np.sort(positive)
    at = at - np.searchsorted(np.sort(junk), at)
    j = np.arange(len(at))
    terms = np.where(at == 0, 1.0, j / np.maximum(at, 1)) + (j + 1) / (at + 1)
    cut = [min(int(at[-1]) + 1, k) for k in ks]
    return [float(terms.sum() / 2), *(float((at + 1 <= c).sum() / c) for c in cut)]


def from_sums(sums: DataFrame, query: str, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """(query, n_relevant, ap, p_<k> ...) from ranking_sums() of each query; `relevant` is (query, n_relevant), and only its queries have a row."""
    rows = relevant.join(sums, query, "left")
    return rows.select(query, "n_relevant", (F.col("terms") / F.col("n_relevant")).alias("ap"), *[f"p_{k}" for k in ks])


def mean_average_precision(per_query: DataFrame) -> DataFrame:
    """One row: map and the mean of every precision; null where no query has positives."""
    return per_query.agg(F.avg("ap").alias("map"), *[F.avg(c).alias(c) for c in per_query.columns if c.startswith("p_")])

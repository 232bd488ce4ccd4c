"""Vector algebra on array columns, as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(a: Column, least: float = 1e-12) -> Column:
    """Each component over the vector's norm, which counts as `least` at least."""
    return F.transform(a, lambda x: x / F.greatest(l2_norm(a), F.lit(least)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def mean_of(*vectors: Column) -> Column:
    """Component-wise mean."""
    total = vectors[0]
    for v in vectors[1:]:
        total = F.zip_with(total, v, lambda x, y: x + y)
    return F.transform(total, lambda x: x / len(vectors))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of an array; lists of different lengths are an error that says so."""
    if not len(column):
        return np.zeros((0, 0))
    sizes = pc.min_max(pc.list_value_length(column)).as_py()
    if sizes["min"] != sizes["max"]:
        raise ValueError(f"vectors of {sizes['min']} and of {sizes['max']} components in one column")
    return np.asarray(column.flatten()).reshape(len(column), -1)

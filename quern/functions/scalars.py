"""Scalar helpers: paths, flags, parameter names, normal distribution, learning-rate schedule."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The layer types that are batch normalization.
BATCH_NORMS = ("BatchNorm1d", "BatchNorm2d", "BatchNorm3d", "SyncBatchNorm")
#: The spellings of a flag.
OFF, ON = ("off", "false", "0"), ("on", "true", "1")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_join(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def has_suffix(name: Column, suffix: str) -> Column:
    """Whatever the case of letters."""
    return F.lower(name).endswith(suffix.lower())


def bool_flag(value: Column) -> Column:
    """True or false for the known spellings in any case; anything else is an error. Null stays null."""
    low = F.lower(value)
    return F.when(low.isin(*OFF), False).when(low.isin(*ON), True).when(value.isNotNull(), F.raise_error(F.concat(F.lit("invalid value for a boolean flag: "), value)).cast("boolean"))


def renamed_key(name: Column) -> Column:
    """A checkpoint's tensor name without the wrappers' prefixes, wherever they stand."""
    return F.replace(F.replace(name, F.lit("module."), F.lit("")), F.lit("backbone."), F.lit(""))


def is_batchnorm(layer: Column) -> Column:
    """Whether a layer's type is one of batch normalization."""
    return layer.isin(*BATCH_NORMS)


def decay_group(name: Column, shape: Column) -> Column:
    """Biases and vectors take no weight decay."""
    return F.when(name.endswith(".bias") | (F.size(shape) == 1), "not_regularized").otherwise("regularized")


def frozen_gradient(gradient: Column, name: Column, epoch: Column, freeze_last_layer: int) -> Column:
    """Null for the last layer in the first epochs."""
    return F.when((epoch < freeze_last_layer) & name.contains("last_layer"), None).otherwise(gradient)


def scheduled(step: Column, base: float, final: float, epochs: int, per_epoch: int, warmup_epochs: int = 0, start: float = 0.0) -> Column:
    """The schedule's value at a step, counted from 0: a linear warm-up that ends at base, then half a cosine towards final."""
    warm, total = warmup_epochs * per_epoch, epochs * per_epoch
    if total < warm:
        raise ValueError("the warm-up is longer than the schedule")
    up = F.lit(start) + step * ((base - start) / (warm - 1) if warm > 1 else 0.0)
    down = F.lit(final) + 0.5 * (base - final) * (1 + F.cos(math.pi * (step - warm) / max(1, total - warm)))
    return F.when(step < warm, up).otherwise(down)


def cosine_schedule(spark: SparkSession, base: float, final: float, epochs: int, per_epoch: int, warmup_epochs: int = 0, start: float = 0.0) -> DataFrame:
    """(step, value) of the whole schedule."""
    value = scheduled(F.col("step"), base, final, epochs, per_epoch, warmup_epochs, start)
    return spark.range(epochs * per_epoch).select(F.col("id").alias("step")).withColumn("value", value)


def seeded_uniform(key: Column, seed: int = 31) -> Column:
    """A number in [0, 1) for each key, the same for the same seed however rows are dealt: 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def norm_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([(1 + math.erf(v / math.sqrt(2))) / 2 for v in np.ravel(x)])


def with_norm_cdf(df: DataFrame, x: str, name: str) -> DataFrame:
    """df with the normal distribution function of a column; null stays null."""
    schema = df.withColumn(name, F.lit(None).cast("double")).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(x)).cast(pa.float64())
            known = norm_cdf(values.fill_null(0.0).to_numpy())
            p = pa.array(known, mask=values.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, p], names=schema.names)

    return df.mapInArrow(apply, schema)


def with_truncated_normal(df: DataFrame, u: str, name: str, mean: float = 0.0, std: float = 1.0, low: float = -2.0, high: float = 2.0) -> DataFrame:
    """df with draws of a normal variable given that it lies in [low, high], by the inverse distribution function of a uniform column; null stays null."""
    from statistics import NormalDist

    lo, hi = norm_cdf(np.array([(low - mean) / std, (high - mean) / std]))
    schema = df.withColumn(name, F.lit(None).cast("double")).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverse = NormalDist().inv_cdf
        for batch in batches:
            uniform = batch.column(batch.schema.get_field_index(u)).cast(pa.float64())
            p = np.clip(lo + uniform.fill_null(0.5).to_numpy() * (hi - lo), 1e-16, 1 - 1e-16)
            values = [min(high, max(low, mean + std * inverse(x))) for x in p.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64(), mask=uniform.is_null().to_numpy(zero_copy_only=False))], names=schema.names)

    return df.mapInArrow(apply, schema)


def truncated_normal(spark: SparkSession, n: int, mean: float = 0.0, std: float = 1.0, low: float = -2.0, high: float = 2.0, seed: int = 31) -> DataFrame:
    """(id, value): n draws of a normal variable given that it lies in [low, high]."""
    return with_truncated_normal(spark.range(n).withColumn("u", F.rand(seed)), "u", "value", mean, std, low, high).drop("u")

"""Embedding a large set of tiles in ranges, with a commit log, so that a run that was ended goes on where it stopped.

Tiles are dealt to ranges by a hash of their name. A range is one Spark job that replaces its own part of the result; after it,
a row of the log is written: range, tiles, unreadable and failed ones, seconds, and the identity of the run (directories,
ranges, transform, and a digest of the weights). A later call with the same identity embeds the ranges that the log lacks, and
no others; one with another identity is an error, as its rows would not belong together. What an ended job has left of a range
without a log row is replaced, so each tile is in the result once.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark import Accumulator, Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import vision
from quern.sources import images
from quern.sources.tile_source import contents

LOG = "range int, tiles long, unreadable long, failed long, seconds double, identity string"
RANGES = 64


def identity(directories: list[str], model: vision.Transformer, ranges: int, side: int, crop: int) -> str:
    """A digest of all that a run's rows depend on besides the tiles."""
    digest = hashlib.sha256(repr((sorted(directories), model.shape, ranges, side, crop)).encode())
    for name in sorted(model.w):
        digest.update(name.encode() + model.w[name].tobytes())
    return digest.hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a run's log, a range each; none if there is no log yet."""
    return spark.read.schema(LOG).parquet(f"{path}/log/*") if exists(spark, f"{path}/log") else spark.createDataFrame([], LOG)


def in_ranges(spark: SparkSession, path: str, own: str, ranges: int, rows_of: Callable[[int], DataFrame], most: int | None = None, unreadable: str = "false", failed: str = "false") -> bool:
    """Writes rows_of(i) to path for each range that the log lacks, with a log row after it, `most` of them in this call at most; whether all are done.

    own names the run: a log with another name is an error. unreadable and failed are conditions whose rows the log counts.
    """
    done = {r["range"]: r["identity"] for r in log(spark, path).collect()}  # a row a range
    if set(done.values()) - {own}:
        raise ValueError(f"{path} holds a run of another model, transform, number of ranges or set of directories")
    left = [i for i in range(ranges) if i not in done]
    for i in left[:most]:
        began = time.monotonic()
        rows = rows_of(i)
        rows.write.mode("overwrite").parquet(f"{path}/data/range={i}")
        written = spark.read.schema(rows.schema).parquet(f"{path}/data/range={i}")
        sums = written.agg(F.count("*").alias("tiles"), F.count_if(F.expr(unreadable)).alias("unreadable"), F.count_if(F.expr(failed)).alias("failed")).first()
        entry = (i, sums["tiles"], sums["unreadable"], sums["failed"], time.monotonic() - began, own)
        spark.createDataFrame([entry], LOG).coalesce(1).write.mode("overwrite").parquet(f"{path}/log/{i}")
    return most is None or len(left) <= most


def embed_in_ranges(
    spark: SparkSession, directories: list[str], model: vision.Transformer | Broadcast, path: str, ranges: int = RANGES, side: int = images.RESIZE, crop: int | None = None, counter: Accumulator | None = None
) -> DataFrame:
    """(folder, file_name, decode_ok, embedding, error) of all tiles, from path, after the ranges that were not done yet."""
    net = model if isinstance(model, Broadcast) else vision.shared(spark, model)
    crop = crop or net.value.shape.side

    def rows_of(i: int) -> DataFrame:
        tiles = images.decoded_contents(contents(spark, directories, part=(i, ranges)))
        return vision.embed(tiles, ["folder", "file_name", "decode_ok"], images.Prepared(side, crop), net, errors=True, counter=counter)

    in_ranges(spark, path, identity(directories, net.value, ranges, side, crop), ranges, rows_of, unreadable="NOT decode_ok", failed="error IS NOT NULL")
    return spark.read.schema("folder string, file_name string, decode_ok boolean, embedding array<float>, error string, range int").parquet(f"{path}/data").drop("range")

"""Tiles and metrics as they arrive.

A directory of tiles is a stream of files; images.decoded_contents() turns it into a stream of decoded tiles, which the
transforms and the model take as they take those at rest. Files whose names begin with _ or . do not appear in a stream, as
Spark's file stream leaves them out. Metrics of workers are added up in event-time windows with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TILES = "path string, modificationTime timestamp, length long, content binary"


def tile_stream(spark: SparkSession, directory: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, file_name, length, content) of .tif files as they appear."""
    files = spark.readStream.format("binaryFile").schema(TILES).option("pathGlobFilter", "*.[tT][iI][fF]").option("maxFilesPerTrigger", files_per_batch).load(directory)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "content")


def classified(stream: DataFrame, classify: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available: bool = True) -> StreamingQuery:
    """Writes classify(batch) of every micro-batch under path/batch=<id>; a batch that runs again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        classify(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer).start()


def windowed_metrics(events: DataFrame, time: str, name: str, value: str, width: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """(window, name, n, total, average) per event-time window; rows later than the watermark are dropped."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("window"), F.col(name).alias("name")).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("average"))

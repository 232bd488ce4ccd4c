"""Progress as rows: how much of a job or stream is done, at what rate, and when it is expected to end.

A batch that is worked through in steps reports after each step; the measures of a step come from an Observation, so they are
counted in the pass that does the work. A stream reports its micro-batches through a listener. Rows are appended to a Parquet
table that other sessions can read while the work goes on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

PROGRESS = "header string, step long, steps long, rows long, seconds double, rows_per_second double, average_seconds double, seconds_left double, measures map<string, double>"


@dataclass
class Log:
    """Rows of progress, kept for the caller and, if a path is given, appended to a table there."""

    spark: SparkSession
    header: str = ""
    path: str | None = None
    rows: list[tuple] = field(default_factory=list)

    def add(self, step: int, steps: int | None, n: int, seconds: float, average: float, measures: dict[str, float]) -> None:
        left = average * (steps - step) if steps is not None else None
        row = (self.header, step, steps, n, seconds, n / seconds if seconds > 0 else None, average, left, measures)
        self.rows.append(row)
        if self.path:
            self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, PROGRESS)


def log_every(steps: Collection[Any], every: int, log: Log, measured: Callable[[Any], dict[str, float]] | None = None) -> Iterator[Any]:
    """The steps, one after the other; after each `every`-th and the last, a row with the average time of a step so far, and what it makes for this step and those to come."""
    total = 0.0
    for i, step in enumerate(steps):
        began = time.monotonic()
        yield step
        taken = time.monotonic() - began
        total += taken
        if i % every == 0 or i == len(steps) - 1:
            measures = measured(step) if measured else {}
            log.add(i, len(steps), int(measures.get("rows", 0)), taken, total / (i + 1), {k: float(v) for k, v in measures.items()})


def observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, Callable[[Any], dict[str, float]]]:
    """df whose next action counts its rows and these measures on the way, and how to read them after it."""
    watch = Observation()
    out = df.observe(watch, F.count(F.lit(1)).alias("rows"), *[m.cast("double").alias(n) for n, m in measures.items()])
    return out, lambda _=None: {k: v for k, v in watch.get.items() if v is not None}


class StreamLog(StreamingQueryListener):
    """Adds a row for each micro-batch of the session's streams; register with spark.streams.addListener()."""

    def __init__(self, log: Log, total_rows: int | None = None):
        self.log, self.total_rows = log, total_rows
        self.seen, self.batches, self.seconds = 0, 0, 0.0

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.seen, self.batches, self.seconds = 0, 0, 0.0

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        n, seconds = p.numInputRows, p.batchDuration / 1000
        if not n:
            return
        self.seen, self.batches, self.seconds = self.seen + n, self.batches + 1, self.seconds + seconds
        steps = None
        if self.total_rows is not None:  # as many more batches of the average size as rows are left
            steps = self.batches + -(-max(0, self.total_rows - self.seen) * self.batches // self.seen)
        measures = {name: float(value) for watch in (p.observedMetrics or {}).values() for name, value in watch.asDict().items() if isinstance(value, (int, float))}
        self.log.add(self.batches - 1, steps, n, seconds, self.seconds / self.batches, measures)

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

"""What the operators share: batches of bounded size, block rows, tables of members."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import shared_dir, stored  # noqa: F401 for the operators

#: Bytes of text that an operator turns into arrays at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 250_000


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def parts_for(total: float, per_part: float, least: int = 1) -> int:
    """How many parts hold `total`, at about `per_part` each."""
    return max(least, int(-(-total // per_part)))


def text_column(df: DataFrame, name: str = "text"):
    """The column as a string, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls; offsets start at 0. No copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives freed memory back to the system: a worker lives on between tasks, next to an executor that needs it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: What gives up the memory that a Python worker keeps from one task to the next.
KEPT: list[Callable[[], None]] = []


def forget() -> None:
    """Frees what other operators' tasks keep in this worker."""
    for give_up in KEPT:
        give_up()


def chunked(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column holds about `most` bytes at most, or one row. `keep` is for those who use what is KEPT."""
    if not keep:
        forget()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
    release()


def block_rows(part: np.ndarray, rows: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """One (part, data) row for each part that has rows: `rows` is a structured array, packed as bytes."""
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    cuts = np.flatnonzero(np.diff(part)) + 1 if len(part) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], cuts]).astype(np.int64) if len(part) else cuts
    offsets = np.concatenate([starts, [len(rows)]]) * rows.dtype.itemsize
    data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), data], schema=schema)


BLOCK = pa.schema([("part", pa.int32()), ("data", pa.binary())])
BLOCK_DDL = "part int, data binary"


def by_part(blocks: DataFrame, n: int) -> DataFrame:
    """Block rows with each part in one task, in order of part: bounded, as parts are cut by the hash of what they hold."""
    return blocks.repartition(n, "part").sortWithinPartitions("part")


def parts(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its rows) from block rows sorted by part."""
    now, held = None, []
    for batch in batches:
        ids, data = batch.column(0), batch.column(1)
        for p, d in zip(ids.to_pylist(), data, strict=True):
            if p != now:
                if held:
                    yield now, np.concatenate(held)
                now, held = p, []
            held.append(np.frombuffer(d.as_buffer(), dtype))
    if held:
        yield now, np.concatenate(held)
    held = []
    release()


#: Bits of a table of members, at most, and bits for one of them.
MOST_MEMBER_BITS, BITS_OF_A_MEMBER = 1 << 26, 16


def members(wanted: DataFrame, keys: list[str]) -> Broadcast:
    """A table of bits, 8 MB at most, that tells which rows' keys may be among the wanted ones: all of those, and few others."""
    count, n_bits = wanted.count(), 1 << 12
    while n_bits < min(MOST_MEMBER_BITS, BITS_OF_A_MEMBER * count):
        n_bits *= 2
    place = F.pmod(F.xxhash64(*keys), F.lit(n_bits))
    words = wanted.select(place.alias("place")).selectExpr("int(shiftright(place, 5)) AS word", "shiftleft(1L, int(place & 31)) AS bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # 2**21 rows at most
    table = np.zeros(n_bits // 32, np.uint32)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return wanted.sparkSession.sparkContext.broadcast(table)


def member_place(table: Broadcast, keys: list[str]):
    """The column by which may_be() looks a row up."""
    return F.pmod(F.xxhash64(*keys), F.lit(32 * len(table.value)))


def may_be(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (table[place >> 5] >> (place & 31).astype(np.uint32) & 1) > 0


def small_batches(spark: SparkSession, rows: int = 2000, read: int = 512) -> None:
    """Batches of texts stay small, both those read from Parquet and Arrow's, so that very long texts fill neither an executor nor its Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(read))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

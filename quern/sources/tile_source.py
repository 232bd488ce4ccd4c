"""A data source of tiles: every .tif file of a directory, also those whose names Spark's own file sources hide.

Spark leaves out files whose names begin with `_` or `.`. This source lists a directory itself, deals its files to partitions
by their bytes, and yields path, name, length and content, a file at a time. The file system is the one that the address names
(local, HDFS, or an object store); `directory` may be several, separated by line breaks. `range` is k/n for the k-th of n
shares of the files, by a hash of the name, so that a directory can be worked through in steps.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, file_name string, length long, content binary"
ENDING = ".tif"
#: Bytes of a partition, and what opening a file counts for.
PARTITION_BYTES, OPEN_BYTES = 128 << 20, 1 << 20


def place(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address and the path there; without a scheme, a local path as it is."""
    if "://" in address:
        return pafs.FileSystem.from_uri(address)
    return pafs.LocalFileSystem(), address.removeprefix("file:")


def hidden(name: str) -> bool:
    """Whether Spark's file sources leave a file of this name out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def listed(directory: str, only_hidden: bool = False) -> list[tuple[str, int]]:
    """(path, bytes) of a directory's tiles, by path; a missing directory is an error."""
    fs, path = place(directory)
    files = fs.get_file_info(pafs.FileSelector(path))
    found = [(f.path, f.size) for f in files if f.type == pafs.FileType.File and f.base_name.lower().endswith(ENDING)]
    return sorted(x for x in found if not only_hidden or hidden(posixpath.basename(x[0])))


@dataclass
class Tiles(InputPartition):
    directory: str
    files: tuple[str, ...]

    def __init__(self, directory: str, files: tuple[str, ...]):
        super().__init__(None)
        self.directory, self.files = directory, files


def dealt(directory: str, files: list[tuple[str, int]], most: int = PARTITION_BYTES) -> list[Tiles]:
    """The files in order, cut where a partition's bytes would exceed `most`; a larger file is a partition of its own."""
    out, now, size = [], [], 0
    for path, n in files:
        if now and size + n + OPEN_BYTES > most:
            out.append(Tiles(directory, tuple(now)))
            now, size = [], 0
        now.append(path)
        size += n + OPEN_BYTES
    return out + ([Tiles(directory, tuple(now))] if now else [])


class TileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.directories = options["directory"].split("\n")
        self.only_hidden = options.get("hidden", "all") == "only"
        self.range, self.ranges = map(int, options.get("range", "0/1").split("/"))
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Tiles]:
        own = lambda files: [f for f in files if zlib.crc32(posixpath.basename(f[0]).encode()) % self.ranges == self.range]
        found = [p for d in self.directories for p in dealt(d, own(listed(d, self.only_hidden)), self.most)]
        return found or [Tiles(self.directories[0], ())]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        fs, _ = place(partition.directory)
        schema = pa.schema([("path", pa.string()), ("file_name", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
        for path in partition.files:
            with fs.open_input_stream(path) as file:
                content = file.read()
            row = [[f"{partition.directory.rstrip('/')}/{posixpath.basename(path)}"], [posixpath.basename(path)], [len(content)], [content]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TileReader:
        return TileReader({k.lower(): v for k, v in self.options.items()})


def contents(spark: SparkSession, directories: str | list[str], only_hidden: bool = False, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """(path, file_name, length, content) of the tiles of one or several directories, or of the k-th of n shares of them."""
    spark.dataSource.register(TileSource)
    several = [directories] if isinstance(directories, str) else directories
    return spark.read.format("tiles").option("directory", "\n".join(several)).option("hidden", "only" if only_hidden else "all").option("range", f"{part[0]}/{part[1]}").load()

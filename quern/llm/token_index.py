"""Token ids in binary shard files, with a minimal perfect hash index from document keys to places in them.

Shards hold the ids of documents in ascending order of id, little-endian, two bytes each where the vocabulary allows and
four otherwise, and nothing else. A document's key is (id, occurrence); occurrence counts rows with the same id.

The index is cut into segments by the key's hash. A segment maps its keys to 0 .. n - 1 without gaps: keys are hashed into
a bit array of `GAMMA` bits a key, those that meet no other set their bit, the rest go on to the next level; a key's number
is the rank of its bit. Arrays by number hold a stored fingerprint (a key that is not indexed is found out by it), shard,
place and length. A lookup is a few hashes, a rank and one comparison, whatever the number of documents.

Files are written under a name of the task's attempt; the manifest, a committed table, names those that count.

A hot id (a third of all rows without one) is cut into ranges by its texts, so shards stay near their size; an id that goes
on in the next shard goes on counting there.

Defined results: a null text is empty and has its end id only; null ids come first, as keys of their own; rows that share
an id are numbered by the first PREFIX characters of their texts and then by the texts' hash; an empty table gives an empty
index; other columns are ignored.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import encoders
from quern.llm import hashing as H
from quern.llm.common import chunked, filesystem, parts_for, shared_dir, small_batches, stored, text_column

END = 2
SHARD_TEXT = 32 << 20
SEGMENT_KEYS = 1024
GAMMA = 2
LEVELS = 32
#: Characters of a text that order rows of one id, and ranges into which equal rows may be cut.
PREFIX, SPREAD = 64, 256
MANIFEST = "doc_id long, occurrence long, shard int, file string, at long, n long"


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys, given as two columns of 64 bits."""

    def __init__(self, levels: list[np.ndarray], rest: dict[tuple[int, int], int] | None = None):
        self.levels, self.rest = levels, rest or {}
        self.before = np.concatenate([[0], np.cumsum([int(b.sum()) for b in levels])]).astype(np.int64)
        self.ranks = [np.cumsum(b) - b for b in levels]

    @staticmethod
    def place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (H.mix(a ^ H.mix(b + H.U(level))) % H.U(size)).astype(np.int64)

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels = []
        left = np.arange(len(a))
        while len(left) and len(levels) < LEVELS:
            size = max(8, GAMMA * len(left))
            at = cls.place(a[left], b[left], len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        done = sum(int(x.sum()) for x in levels)
        rest = {(int(a[i]), int(b[i])): done + j for j, i in enumerate(left)}
        if len(rest) != len(left):
            raise ValueError("keys are not distinct")
        return cls(levels, rest)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's number; for a key that was not given, any number, or -1."""
        out = np.full(len(a), -1, np.int64)
        open_ = np.arange(len(a))
        for i, bits in enumerate(self.levels):
            at = self.place(a[open_], b[open_], i, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.before[i] + self.ranks[i][at[hit]]
            open_ = open_[~hit]
        for i in open_.tolist():
            out[i] = self.rest.get((int(a[i]), int(b[i])), -1)
        return out


def fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (H.mix(b ^ H.mix(a ^ H.U(0xA0761D6478BD642F))) >> H.U(32)).astype(np.uint32)


def pack_segment(a: np.ndarray, b: np.ndarray, shard: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    """A segment as bytes."""
    mph = PerfectHash.of(a, b)
    number = mph.number(a, b)
    arrays = {"fingerprint": fingerprint(a, b), "shard": shard.astype(np.int32), "at": at.astype(np.int64), "n": n.astype(np.int64)}
    out = io.BytesIO()
    ordered = {}
    for name, values in arrays.items():
        ordered[name] = np.empty_like(values)
        ordered[name][number] = values
    np.savez(out, sizes=np.array([len(x) for x in mph.levels], np.int64), bits=np.packbits(np.concatenate([*mph.levels, np.zeros(0, bool)])), rest=np.array([[x & (1 << 64) - 1 for x in k] for k in mph.rest], np.uint64).reshape(-1, 2), **ordered)
    return out.getvalue()


def look_up(segment: bytes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(found, shard, at, n) of keys in a segment."""
    with np.load(io.BytesIO(segment)) as file:
        sizes, bits = file["sizes"], file["bits"]
        flat = np.unpackbits(bits)[: int(sizes.sum())].astype(bool)
        levels = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
        done = int(flat.sum())
        mph = PerfectHash(levels, {(int(x), int(y)): done + i for i, (x, y) in enumerate(file["rest"])})
        number = mph.number(a, b)
        prints = file["fingerprint"]
        found = (number >= 0) & (number < len(prints))
        number = np.where(found, number, 0)
        if not len(prints):
            return found, number, number, number
        found &= prints[number] == fingerprint(a, b)
        return found, file["shard"][number], file["at"][number], file["n"][number]


def keyed(df: DataFrame, n_segments: int) -> DataFrame:
    """doc_id and occurrence with their hashes a, b and segment."""
    a, b = F.xxhash64("doc_id", "occurrence"), F.xxhash64("occurrence", "doc_id", F.lit("b"))
    return df.withColumn("a", a).withColumn("b", b).withColumn("segment", F.pmod(F.xxhash64("b", "a"), F.lit(n_segments)).cast("int"))


def write(df: DataFrame, path: str, tokenizer: str, vocabulary: int, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes path/shards/*.ids, the manifest of documents and the index; returns the manifest."""
    small_batches(df.sparkSession)
    body = text_column(df, text)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"))
    total = float(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    # equal rows are as good in any order, so a count of the scan's may cut them
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, PREFIX), F.xxhash64("text"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))]
    docs = docs.select("doc_id", "text", *(x.alias(f"by_{i}") for i, x in enumerate(order[1:])))
    order = [order[0], "by_0", "by_1", "by_2"]
    sorted_docs = docs.repartitionByRange(parts_for(total, SHARD_TEXT), *order).sortWithinPartitions(*order).select("doc_id", "text")
    width = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        encoder = encoders.worker_encoder(tokenizer, end)
        fs, folder = filesystem(f"{path}/shards")
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.ids"
        out, at, last, seen = None, 0, None, 0
        for chunk in chunked(batches, "text", encoders.CHUNK, keep=True):
            if out is None:
                fs.create_dir(folder)
                out = fs.open_output_stream(f"{folder}/{name}", compression=None)
            ids, offsets = encoder.ids(chunk.column(1).to_pylist())
            out.write(ids.astype(width).tobytes())
            keys = chunk.column(0).to_pylist()
            occurrence = []
            for i, k in enumerate(keys):
                seen = seen + 1 if k == last and (i or at) else 0
                last = k
                occurrence.append(seen)
            m = chunk.num_rows
            columns = [chunk.column(0), pa.array(occurrence, pa.int64()), pa.array([task.partitionId()] * m, pa.int32()), pa.array([name] * m), pa.array(at + offsets[:-1]), pa.array(np.diff(offsets))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "occurrence", "shard", "file", "at", "n"])
            at += int(offsets[-1])
        if out is not None:
            out.close()

    written = stored(sorted_docs.mapInArrow(apply, MANIFEST), f"{path}/written")
    manifest = stored(counted_on(written), f"{path}/manifest")
    fs, folder = filesystem(path)
    with fs.open_output_stream(f"{folder}/format.json") as file:
        file.write(json.dumps({"bytes": width.itemsize, "segments": (n_segments := parts_for(manifest.count(), SEGMENT_KEYS))}).encode())

    def build(table: pa.Table) -> pa.Table:
        a, b, shard, at, n = (np.asarray(table.column(c)) for c in ("a", "b", "shard", "at", "n"))
        data = pack_segment(a.view(np.uint64), b.view(np.uint64), shard, at, n)
        return pa.table({"segment": table.column("segment")[:1].combine_chunks(), "data": pa.array([data], pa.binary())})

    keyed(manifest, n_segments).select("segment", "a", "b", "shard", "at", "n").groupBy("segment").applyInArrow(build, "segment int, data binary").write.parquet(f"{path}/index")
    return manifest


def counted_on(written: DataFrame) -> DataFrame:
    """The manifest with occurrences that go on from shard to shard; only a shard's first and last id can stand in two."""
    ends = written.groupBy("shard").agg(F.min(F.struct("at", "doc_id")).alias("low"), F.max(F.struct("at", "doc_id")).alias("high"))
    ends = ends.select("shard", F.explode(F.array_distinct(F.array("low.doc_id", "high.doc_id"))).alias("doc_id"))  # two rows a shard
    same = F.col("doc_id").eqNullSafe(F.col("other")) & (F.col("shard") == F.col("in_shard"))
    counts = written.join(ends.select(F.col("shard").alias("in_shard"), F.col("doc_id").alias("other")), same, "left_semi").groupBy("doc_id", "shard").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("doc_id").orderBy("shard")) - F.col("rows")
    before = counts.select(F.col("doc_id").alias("other"), F.col("shard").alias("in_shard"), before.alias("before")).filter("before > 0")
    rows = written.join(before, same, "left")
    return rows.select("doc_id", (F.col("occurrence") + F.coalesce("before", F.lit(0))).alias("occurrence"), "shard", "file", "at", "n")


def settings(path: str) -> dict:
    fs, folder = filesystem(path)
    with fs.open_input_stream(f"{folder}/format.json") as file:
        return json.loads(file.read())


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, occurrence, shard, at, n) of distinct keys (doc_id, occurrence); keys that are not indexed have no row."""
    index = spark.read.schema("segment int, data binary").parquet(f"{path}/index")
    asked = keyed(keys.select("doc_id", "occurrence").distinct(), settings(path)["segments"])

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "occurrence", "shard", "at", "n"]
        if not left.num_rows or not right.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "occurrence": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "at": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        a, b = (np.asarray(left.column(c)).view(np.uint64) for c in ("a", "b"))
        found, shard, at, n = look_up(right.column("data")[0].as_py(), a, b)
        out = pa.table([left.column("doc_id"), left.column("occurrence"), pa.array(shard.astype(np.int32)), pa.array(at), pa.array(n)], names=names)
        return out.filter(pa.array(found))

    return asked.groupBy("segment").cogroup(index.groupBy("segment")).applyInArrow(find, "doc_id long, occurrence long, shard int, at long, n long")


def read(spark: SparkSession, path: str, keys: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, occurrence, start, n_tokens, ids_crc32[, ids]) of keys, looked up in the index and read from the shards.

    start counts the ids of all documents before the document's.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    shards = manifest.groupBy("shard", "file").agg(F.sum("n").alias("total"))
    # one row a shard, SHARD_TEXT of text each
    shards = shards.select("shard", "file", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    places = lookup(spark, path, keys).repartition(max(1, shards.count()), "shard")  # a task for each shard or two
    width = np.dtype(f"<u{settings(path)['bytes']}")
    dealt = places.join(shards.hint("shuffle_hash"), "shard").sortWithinPartitions("shard", "at").select("doc_id", "occurrence", "file", "base", "at", "n")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(f"{path}/shards")
        source, name = None, None
        for batch in batches:
            crc, ids = [], []
            for file, at, n in zip(*(batch.column(i).to_pylist() for i in (2, 4, 5)), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    source, name = fs.open_input_file(f"{folder}/{file}"), file
                data = np.frombuffer(source.read_at(n * width.itemsize, at * width.itemsize), width).astype("<u4")
                if len(data) != n:
                    raise EOFError(f"{file} ends before {at + n}")
                crc.append(zlib.crc32(data))
                if with_ids:
                    ids.append(data.astype(np.int32))
            start = pc.add(batch.column(3), batch.column(4))
            columns = [batch.column(0), batch.column(1), start, batch.column(5), pa.array(crc, pa.int64())] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "occurrence", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
        if source is not None:
            source.close()

    return dealt.mapInArrow(apply, "doc_id long, occurrence long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def round_trip(df: DataFrame, tokenizer: str, vocabulary: int, end: int = END) -> DataFrame:
    """Writes the table's shards and index to a shared folder and reads every document back by its key."""
    spark = df.sparkSession
    path = shared_dir(spark, "tokens")
    manifest = write(df, path, tokenizer, vocabulary, end)
    return read(spark, path, manifest.select("doc_id", "occurrence"), with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")

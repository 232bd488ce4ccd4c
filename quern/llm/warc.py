"""WARC archives written from, and read back as, a chunked record table.

A payload is never carried whole: it is rows (record, chunk number, bytes) of at most `chunk` bytes, each with the SHA-256
and the length of the payload up to and including its chunk, so the last one of a record carries the digest of the whole.
Writing streams the rows of a record, in order of chunk number, into a gzip member of a WARC file; reading streams a file
and yields such rows again.

Of records with equal payloads of at least `least` bytes, the one with the smallest id is the response, and the others are
revisit records that refer to it; all shorter ones are responses.

A hot payload (a third of all pages) is counted by partial aggregation, its revisits find their response through a salted
join, and a task cuts the payload of equal rows once. Short payloads stay in the record table, and equal records are dealt
to tasks in blocks of EQUAL, so that a third of all pages without an id or a text are no one task's work. Files are written
under a name of the task's attempt; the manifest, a committed table, names those that count, so a task that runs again
leaves at most a file that no manifest names.

Defined results: a null payload is empty; rows with equal ids are records of their own, and of equal rows one is the
response; null ids sort last; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import buffers, chunked, filesystem, small_batches, stored

CHUNK = 64 << 10
LEAST = 100
SALTS = 64
READ = 256 << 10
#: Bytes of chunk rows that leave a task at a time.
OUT = 1 << 20
#: Equal records that a row of the record table stands for.
EQUAL = 4096
CHUNKS = pa.schema([
    ("key", pa.int64()), ("occurrence", pa.int64()), ("type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("chunk", pa.int32()), ("n_chunks", pa.int32()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("data", pa.binary()),
])


def records(df: DataFrame, key: str, payload: str, url: str | None = None, least: int = LEAST) -> DataFrame:
    """The record table: key, url, type, refers_to, payload_bytes, digest, short and, of equal records, the numbers low to high - 1.

    `short` is the payload of fewer than `least` bytes, null for all others. Equal rows of one type are a row for each EQUAL of them.
    """
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    rows = df.select(F.col(key).cast("long").alias("key"), (F.col(url).cast("string") if url else F.lit(None).cast("string")).alias("url"), body.alias("body"))
    small = F.when(F.octet_length("body") < least, F.col("body"))
    rows = rows.select("key", "url", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("payload_bytes"), small.alias("short"))
    # equal rows are counted, and of equal rows only the first can be the response
    rows = rows.groupBy("key", "digest", "payload_bytes", "short").agg(F.count("*").alias("n"), F.min("url").alias("url"))
    first = rows.filter("short IS NULL").groupBy("digest").agg(F.min("key").alias("first"), F.sum("n").alias("copies")).filter("copies > 1")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    # the numbers of the responses among equal rows: all, the first, or none
    responses = F.when(F.col("copies").isNull(), F.col("n")).when(F.col("first").eqNullSafe(F.col("key")), F.lit(1)).otherwise(F.lit(0))
    split = F.array(F.struct(F.lit("response").alias("type"), F.lit(0).cast("long").alias("low"), responses.cast("long").alias("high")), F.struct(F.lit("revisit").alias("type"), responses.cast("long").alias("low"), F.col("n").alias("high")))
    rows = rows.withColumn("part", F.explode(F.filter(split, lambda x: x["low"] < x["high"])))
    rows = rows.withColumn("low", F.explode(F.sequence(F.col("part.low"), F.col("part.high") - 1, F.lit(EQUAL).cast("long"))))
    return rows.select(
        "key", "url", F.col("part.type").alias("type"), F.when(F.col("part.type") == "revisit", F.col("first")).alias("refers_to"),
        "payload_bytes", "digest", "short", "low", F.least(F.col("low") + EQUAL, F.col("part.high")).alias("high"),
    )


def chunk_rows(df: DataFrame, key: str, payload: str, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """(key, digest, chunk, bytes_so_far, digest_so_far, data) of every payload of `least` bytes or more, once a task."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("key"), body.alias("body")).filter(F.octet_length("body") >= least)
    names = ["key", "digest", "chunk", "bytes_so_far", "digest_so_far", "data"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        held: list[tuple] = []
        size = 0
        for batch in chunked(batches, "body", OUT):
            raw, offsets = buffers(batch.column(1))
            view = memoryview(raw)
            for i, k in enumerate(batch.column(0).to_pylist()):
                at, end, sha, own = int(offsets[i]), int(offsets[i + 1]), hashlib.sha256(), []
                for j, low in enumerate(range(at, end, chunk)):
                    part = view[low : min(low + chunk, end)]
                    sha.update(part)
                    own.append((j, low + len(part) - at, sha.hexdigest(), part))
                if (k, sha.digest()) in seen:
                    continue
                seen.add((k, sha.digest()))
                for x in own:
                    held.append((k, sha.hexdigest(), *x))
                    size += len(x[3])
                    if size > OUT:
                        yield rows_of(held)
                        held, size = [], 0
        if held:
            yield rows_of(held)

    def rows_of(held: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(apply, "key long, digest string, chunk int, bytes_so_far long, digest_so_far string, data binary")


def header(kind: str, key, occurrence: int, url, refers_to, n: int, digest: str) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:quern:{key}:{occurrence}>", f"WARC-Target-URI: {url or 'urn:quern:none'}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {n}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:quern:{refers_to}:0>"]
    lines.append(f"Content-Length: {0 if kind == 'revisit' else n}")
    return ("\r\n".join(x.replace("\r", " ").replace("\n", " ") for x in lines) + "\r\n\r\n").encode()


class Member:
    """A record as one gzip member, written piece by piece."""

    def __init__(self, out, head: bytes):
        self.out, self.gzip, self.sha, self.n = out, zlib.compressobj(4, zlib.DEFLATED, 31), hashlib.sha256(), 0
        out.write(self.gzip.compress(head))

    def add(self, data: bytes) -> None:
        self.sha.update(data)
        self.n += len(data)
        self.out.write(self.gzip.compress(data))

    def close(self) -> None:
        self.out.write(self.gzip.compress(b"\r\n\r\n"))
        self.out.write(self.gzip.flush())


def write(df: DataFrame, path: str, key: str, payload: str, url: str | None = None, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """Writes path/*.warc.gz and the manifest (file, records, bytes); returns the manifest, one row per file."""
    small_batches(df.sparkSession)
    table = stored(records(df, key, payload, url, least), f"{path}/records")
    same = F.xxhash64("key", "digest").alias("same")
    names = ["key", "url", "type", "refers_to", "payload_bytes", "digest", "low", "high", "chunk", "digest_so_far", "data"]
    # Of a payload in chunks, one record is the response. The join deals its chunks by the record, so no further shuffle is needed.
    responses = table.filter("type = 'response' AND short IS NULL").select("*", same)
    bodies = chunk_rows(df, key, payload, chunk, least).select(same.alias("other"), F.col("key").alias("k"), F.col("digest").alias("d"), "chunk", "digest_so_far", "data")
    on = (F.col("same") == F.col("other")) & F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d"))
    full = bodies.join(responses.hint("shuffle_hash"), on).select(*names)
    # A revisit has no block, and a short payload is its record's one chunk.
    bare = table.filter("type = 'revisit' OR short IS NOT NULL").select(*names[:-3], F.lit(0).alias("chunk"), F.lit(None).cast("string").alias("digest_so_far"), F.col("short").alias("data"))
    bare = bare.repartition("key", "digest", "low")  # equal records are many rows
    dealt = full.unionByName(bare).sortWithinPartitions("key", "digest", "low", "chunk")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, folder = filesystem(path)
        out, now, member, count, last = None, None, None, 0, -1
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz"
        for batch in batches:
            columns = [batch.column(i) for i in range(10)]
            for i, (k, u, kind, refers, n, digest, low, high, number, so_far) in enumerate(zip(*[c.to_pylist() for c in columns], strict=True)):
                if out is None:
                    fs.create_dir(folder)
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                if now != (k, digest, low):
                    if member:
                        close(member, now)
                    now, member, last = (k, digest, low), None, -1
                    for occurrence in range(low, high):
                        if member:
                            close(member, now)
                        member = Member(out, header(kind, k, occurrence, u, refers, n, digest))
                        member.kind, count = kind, count + 1
                        if kind == "response" and so_far is None:
                            member.add(batch.column(10)[i].as_buffer())
                if so_far is not None and number != last:  # equal rows bring equal chunks, next to each other
                    member.add(batch.column(10)[i].as_buffer())
                    last = number
                    if member.sha.hexdigest() != so_far:
                        raise ValueError(f"chunk {number} of record {k} does not follow the one before")
        if out is not None:
            close(member, now)
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return stored(dealt.mapInArrow(apply, "file string, records long, bytes long"), f"{path}/manifest")


def close(member: Member, now: tuple) -> None:
    """Ends a record; the incremental digest of what was streamed must be the record's."""
    if member.kind == "response" and member.sha.hexdigest() != now[1]:
        raise ValueError(f"the chunks of record {now[0]} do not make its payload")
    member.close()


class Inflated:
    """The bytes of a file of gzip members, a bounded buffer at a time."""

    def __init__(self, source):
        self.source, self.left, self.gzip, self.buffer = source, b"", zlib.decompressobj(31), bytearray()

    def fill(self) -> bool:
        if self.gzip.eof:
            self.left, self.gzip = self.gzip.unused_data, zlib.decompressobj(31)
        data = self.gzip.unconsumed_tail or self.left or self.source.read(READ)
        self.left = b""
        if not data:
            return False
        self.buffer += self.gzip.decompress(data, READ)
        return True

    def line(self) -> bytes:
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self.fill():
                out = bytes(self.buffer)
                self.buffer.clear()
                return out
        out = bytes(self.buffer[:at])
        del self.buffer[: at + 2]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.fill():
                raise EOFError("the archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def ended(self) -> bool:
        while not self.buffer:
            if not self.fill():
                return True
        return False


def read_file(source, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of one archive, in order."""
    data = Inflated(source)
    while not data.ended():
        head = {}
        if (version := data.line()) != b"WARC/1.1":
            raise ValueError(f"no record begins here: {version[:40]!r}")
        while line := data.line():
            name, _, value = line.decode().partition(": ")
            head[name] = value
        _, _, key, occurrence = head["WARC-Record-ID"].strip("<>").split(":")
        refers = head.get("WARC-Refers-To", "").strip("<>").split(":")
        n, sha, so_far = int(head["Content-Length"]), hashlib.sha256(), 0
        number = lambda x: None if x == "None" else int(x)
        digest = head["WARC-Payload-Digest"].partition(":")[2]
        for i in range(chunks := max(1, -(-n // chunk))):
            part = data.exactly(min(chunk, n - so_far))
            sha.update(part)
            so_far += len(part)
            yield {
                "key": number(key), "occurrence": int(occurrence), "type": head["WARC-Type"], "refers_to": number(refers[2]) if len(refers) > 2 else None, "payload_bytes": int(head["WARC-Payload-Length"]),
                "payload_digest": digest, "chunk": i, "n_chunks": chunks, "bytes_so_far": so_far, "digest_so_far": sha.hexdigest() if n or head["WARC-Type"] == "response" else None, "data": part,
            }
        if data.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than it says")


def read(spark: SparkSession, path: str, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table of the archives that the manifest of path names; `data` false leaves the bytes out."""
    manifest = spark.read.schema("file string, records long, bytes long").parquet(f"{path}/manifest")
    names = [n for n in CHUNKS.names if data or n != "data"]
    schema = pa.schema([CHUNKS.field(n) for n in names])
    ddl = ", ".join(f"{n} {'long' if pa.types.is_int64(CHUNKS.field(n).type) else 'int' if pa.types.is_int32(CHUNKS.field(n).type) else 'binary' if n == 'data' else 'string'}" for n in names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as source:
                    rows, held = [], 0
                    for row in read_file(source, chunk):
                        held += len(row["data"]) if data else 100
                        rows.append({n: row[n] for n in names})
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    # a task for each file or two: the manifest is small, the files are not
    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(apply, ddl)


def payload_digests(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk; a revisit's digest is the one its record names."""
    last = chunks.filter("chunk = n_chunks - 1")
    response = F.col("type") == "response"
    return last.select(
        F.col("key").alias("page_id"),
        F.when(response, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )

"""Removal of repeated word passages with a log-structured index of window hashes, batch after batch.

A window is `window` consecutive words. Consecutive windows of a document whose least word-gram hash is the same form a
stretch, and equal windows lie in stretches of equal least hash. The index holds window hashes by stretch: one row (least
hash, hash of the stretch's words, document, place) stands for some eighteen windows. Rows are kept in sorted immutable runs.

A batch is merge-joined with the runs by least hash:
- a stretch whose words stand in the index, or in a smaller document of the batch, goes whole;
- where stretches of one least hash differ, the windows themselves are verified: those of the new stretches and of the
  indexed ones are hashed twice from the texts, and a window that an earlier document has goes.
The batch's own rows become a new run; when `fanout` runs have gathered, the merge writes one run in their stead.

What a batch shuffles does not grow with history: runs are files that the merging tasks read in place, by a table of which
part lies where, and only texts with a contested stretch travel; a bit table of their hashes, of bounded size, drops the
others at the scan.

Windows are judged on the input. "Earlier" is: in the index, or in a smaller document of the same batch; batches taken in
order of id thus give "any smaller document".

Hot passages: of equal stretches that meet in a task, the one of the smallest document goes on; the others' verdict is known
and goes by document. Where a task meets HOT different stretches of one least hash, all its windows are compared: its rows
are dealt by document, and a mark tells the part of the hash. Windows are combined in each task before they travel.

Defined results: words are runs of bytes other than ASCII white space; a null text has none; rows that share an id are
judged each for itself and never by one another; rows without an id are kept whole and remove nothing; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import hashing as H
from quern.llm.common import BLOCK, BLOCK_DDL, block_rows, buffers, by_part, chunked, filesystem, may_be, member_place, members, parts, parts_for, release, shared_dir, small_batches, stored, text_column

WINDOW, GRAM = 50, 16
FANOUT = 3
BATCHES = 4
#: Different stretches of one least hash in a task, from which on all their windows are compared.
HOT = 1024
PART_BYTES = 24 << 20
#: Bytes of text for one index row, about; it sizes the parts only.
TEXT_PER_ROW = 100
OTHER_BASE = 0xD1342543DE82EF95
STRETCH = np.dtype([("least", "<u8"), ("words", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("at", "<i4"), ("n", "<i4"), ("old", "<i4")])
WINDOWS = np.dtype([("hash", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("at", "<i4"), ("old", "<i4")])
GONE, OPEN, SOURCE = 0, 1, 2
#: What the field `old` of a stretch says: of this batch, indexed before, of this batch and decided (GONE), a mark of a hot least hash.
NEW, OLD, KNOWN, MARK = 0, 1, 2, 3
POINTER = "part int, file string, offset long, size long"
SPANS = "doc_id long, tag int, at int, n int, state int"


def identified(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tag, text): the tag tells rows with one id apart."""
    body = text_column(df, text)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.hash(body).alias("tag"), body.alias("text"))


def stretches(chunk: pa.RecordBatch, window: int, gram: int) -> np.ndarray:
    """The index rows of a chunk (doc_id, tag, text)."""
    buf, offsets = buffers(chunk.column(2))
    start, end, first = H.words(buf, offsets)
    if len(start) < window:
        return np.empty(0, STRETCH)
    words = H.Spans(H.Spans(buf).of(start, end))
    least = H.sliding_min(words.every(gram), window - gram + 1)
    doc = np.repeat(np.arange(chunk.num_rows), np.diff(first))
    has_id = ~np.asarray(chunk.column(0).is_null().to_numpy(zero_copy_only=False))
    whole = (doc[: len(least)] == doc[window - 1 :]) & has_id[doc[: len(least)]]
    begins = whole.copy()
    begins[1:] &= ~whole[:-1] | (least[1:] != least[:-1]) | (doc[1 : len(least)] != doc[: len(least) - 1])
    at = np.flatnonzero(begins)
    breaks = np.flatnonzero(begins | ~whole)
    after = np.concatenate([breaks, [len(least)]])[np.searchsorted(breaks, at, "right")]
    rows = np.zeros(len(at), STRETCH)
    rows["least"], rows["words"] = least[at], words.of(at, after - 1 + window)
    rows["doc"] = np.asarray(chunk.column(0).fill_null(0))[doc[at]]
    rows["tag"] = np.asarray(chunk.column(1))[doc[at]]
    rows["at"], rows["n"] = at - first[doc[at]], after - at
    return rows


def combined(rows: np.ndarray, n_parts: int, hot: int) -> pa.RecordBatch:
    """Block rows of a task's stretches by least hash; those that are decided here, and hot ones, under part -1 - p by document."""
    rows = rows[np.lexsort((rows["doc"], rows["words"], rows["least"]))]
    new = firsts(rows["least"], rows["words"])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = rows["doc"] != rows["doc"][head]
    rows["old"] = np.where(gone, KNOWN, NEW)
    new_least = firsts(rows["least"])
    group = np.cumsum(new_least) - 1
    many = (np.bincount(group, new, minlength=1) >= hot)[group]
    marks = rows[many & new_least]
    marks["old"] = MARK
    own = -1 - (H.mix(rows["doc"].astype(np.uint64)) % H.U(n_parts)).astype(np.int32)
    part = np.where(gone | many, own, (rows["least"] % H.U(n_parts)).astype(np.int32))
    return block_rows(np.concatenate([part, (marks["least"] % H.U(n_parts)).astype(np.int32)]), np.concatenate([rows, marks]), BLOCK)


def fingerprints(docs: DataFrame, n_parts: int, window: int, gram: int, hot: int) -> DataFrame:
    """Block rows of the stretches of all documents."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for chunk in chunked(batches, "text"):
            held.append(stretches(chunk, window, gram))
            if sum(map(len, held)) > 300_000:
                rows, held = np.concatenate(held), []
                yield combined(rows, n_parts, hot)
        if held:
            yield combined(np.concatenate(held), n_parts, hot)

    return docs.mapInArrow(apply, BLOCK_DDL)


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Of rows sorted by the columns, whether a row is the first with its values."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def merge(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merge-join of one part: (rows sorted as a run holds them, their states; -1 where nothing is to be done). Marks stay first of their hash."""
    rows = rows[np.lexsort((rows["doc"], rows["old"] != OLD, rows["words"], rows["old"] != MARK, rows["least"]))]
    state = np.full(len(rows), -1, np.int8)
    if not len(rows):
        return rows, state
    mark = rows["old"] == MARK
    new_least, new_words = firsts(rows["least"]), firsts(rows["least"], rows["words"], mark)
    head = np.flatnonzero(new_words)[np.cumsum(new_words) - 1]  # the earliest row with the same words
    fresh = rows["old"] == NEW
    leads = (rows["doc"] == rows["doc"][head]) & (rows["old"] == rows["old"][head])
    state[fresh & ~leads] = GONE
    group = np.cumsum(new_least) - 1
    starts = np.flatnonzero(new_least)
    # rows elsewhere have a marked hash as well, in other documents
    marked = np.add.reduceat(mark.astype(np.int64), starts) > 0
    several = (np.add.reduceat((new_words & ~mark).astype(np.int64), starts) > 1) | marked
    low, high = np.minimum.reduceat(rows["doc"], starts), np.maximum.reduceat(rows["doc"], starts)
    wanted = (np.add.reduceat((fresh & leads).astype(np.int64), starts) > 0) | marked
    contested = (several & wanted & ((low < high) | marked))[group]
    state[contested & fresh & leads] = OPEN
    state[contested & (rows["old"] == OLD) & new_words] = SOURCE
    return rows, state


def apart(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a part by document: (rows, states): known verdicts, and hot rows, all of whose windows are compared."""
    state = np.full(len(rows), OPEN, np.int8)
    state[rows["old"] == KNOWN] = GONE
    state[rows["old"] == OLD] = SOURCE
    return rows, state


def merged(blocks: DataFrame, folder: str, compact: bool) -> DataFrame:
    """By part: the states of stretches (part null), and where the new run's sorted rows lie (doc_id null), from block rows and pointers to runs.

    The run holds the batch's own rows, and under `compact` those of the merged runs as well; of equal words in a part, the earliest.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, place = filesystem(folder)
        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, at = None, 0
        names = ["doc_id", "tag", "at", "n", "state", "part", "file", "offset", "size"]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal out, at
            rows, state = (merge if now >= 0 else apart)(np.concatenate(held))
            told = rows[state >= 0]
            k = len(told)
            if k:
                columns = [pa.array(told[c].copy()) for c in ("doc", "tag", "at", "n")] + [pa.array(state[state >= 0].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns + [pa.nulls(k, t) for t in kinds[5:]], names=names)
            kept = (rows["old"] != KNOWN) & (state != GONE)
            if now >= 0:
                kept &= firsts(rows["least"], rows["words"], rows["old"] == MARK) | (rows["old"] == NEW)
            if not compact:
                kept &= rows["old"] != OLD
            if kept.any():
                if out is None:
                    fs.create_dir(place)
                    out = fs.open_output_stream(filesystem(name)[1], compression=None)
                data = rows[kept].tobytes()
                out.write(data)
                values = (None, None, None, None, None, now, name, at, len(data))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)
                at += len(data)

        now, held = None, []
        for batch in batches:
            for part, data, file, offset, size in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part != now:
                    if held:
                        yield from done()
                    now, held = part, []
                if file is None:
                    held.append(np.frombuffer(data, STRETCH))
                else:
                    with fs.open_input_file(filesystem(file)[1]) as source:
                        rows = np.frombuffer(source.read_at(size, offset), STRETCH).copy()
                    if rows.nbytes != size:
                        raise EOFError(f"{file} ends before {offset + size}")
                    rows["old"][rows["old"] != MARK] = OLD
                    held.append(rows)
        if held:
            yield from done()
        if out is not None:
            out.close()
        release()

    return blocks.mapInArrow(apply, f"{SPANS}, {POINTER}")


def packed(docs: DataFrame, among: Broadcast | None = None) -> DataFrame:
    """(doc_id, tag, text) with the text compressed, as it travels; of a table of members, only the rows that may be in it."""
    place = member_place(among, ["doc_id", "tag"]) if among else F.lit(None).cast("long")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            if among:
                batch = batch.filter(pa.array(may_be(among.value, np.asarray(batch.column(3)))))
            for chunk in chunked([batch], "text"):
                yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(1), pa.array([pack(x) for x in chunk.column(2).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "tag", "text"])

    return docs.select("doc_id", "tag", "text", place.alias("place")).mapInArrow(apply, "doc_id long, tag int, text binary")


def unpacked(chunk: pa.RecordBatch, i: int) -> list[bytes]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) if x is not None else b"" for x in chunk.column(i).to_pylist()]


def by_document(spans: DataFrame) -> DataFrame:
    """(doc_id, tag, spans) with a document's spans together."""
    return spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n", "state")).alias("spans"))


def span_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, at, n, state) of a column of lists of spans."""
    counts = np.asarray(pc.list_value_length(column).fill_null(0)).astype(np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), counts), *(np.asarray(flat.field(i)).astype(np.int64) for i in range(3))


def window_rows(texts: DataFrame, n_parts: int, window: int) -> DataFrame:
    """Block rows of the windows of (doc_id, tag, text, spans); of windows that meet in a task, the earliest. Later ones are block rows of part -1 - k."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            held.clear()
            rows = rows[np.lexsort((rows["doc"], 1 - rows["old"], rows["check"], rows["hash"]))]
            if not len(rows):
                return
            lost = later(rows)
            # one row of a window that has an earlier one, and all that might still be the earliest
            part = (rows["hash"] % H.U(n_parts)).astype(np.int32)
            part[lost] = -1 - part[lost]
            useful = lost | firsts(rows["hash"], rows["check"]) | (rows["old"] == 0)
            yield block_rows(part[useful], rows[useful], BLOCK)

        for chunk in chunked(batches, "text", 1 << 18):
            raw = unpacked(chunk, 2)
            column = pa.array(raw, pa.binary())
            buf, offsets = buffers(column)
            start, end, first = H.words(buf, offsets)
            words = H.Spans(H.Spans(buf).of(start, end))
            others = H.Spans(H.Spans(buf, OTHER_BASE).of(start, end), OTHER_BASE)
            row, at, n, state = span_arrays(chunk.column(3))
            places = H.ranges(first[row] + at, n)
            row, state = np.repeat(row, n), np.repeat(state, n)
            rows = np.zeros(len(places), WINDOWS)
            rows["hash"], rows["check"] = words.of(places, places + window), others.of(places, places + window)
            rows["doc"], rows["tag"] = np.asarray(chunk.column(0))[row], np.asarray(chunk.column(1))[row]
            rows["at"], rows["old"] = places - first[row], state == SOURCE
            held.append(rows)
            if sum(map(len, held)) > 400_000:
                yield from flush()
        if held:
            yield from flush()

    return texts.mapInArrow(apply, BLOCK_DDL)


def later(rows: np.ndarray) -> np.ndarray:
    """Of sorted windows, those that an earlier document has."""
    new = firsts(rows["hash"], rows["check"])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (rows["old"] == 0) & ((rows["old"][head] == 1) | (rows["doc"] > rows["doc"][head]))


def found_spans(rows: np.ndarray) -> pa.RecordBatch:
    """Windows as spans (doc_id, tag, at, n), neighbours joined."""
    rows = rows[np.lexsort((rows["at"], rows["tag"], rows["doc"]))]
    joined = (rows["doc"][1:] == rows["doc"][:-1]) & (rows["tag"][1:] == rows["tag"][:-1]) & (rows["at"][1:] - rows["at"][:-1] <= 1)
    starts = H.runs(joined) if len(rows) else np.zeros(0, np.int64)
    ends = np.concatenate([starts[1:], [len(rows)]]) - 1 if len(rows) else starts
    columns = [rows["doc"][starts], rows["tag"][starts], rows["at"][starts], rows["at"][ends] - rows["at"][starts] + 1]
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(np.zeros(len(starts), np.int32))], names=["doc_id", "tag", "at", "n", "state"])


def compared(blocks: DataFrame) -> DataFrame:
    """The spans of windows that an earlier document has."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in parts(batches, WINDOWS):
            if part >= 0:
                rows = rows[np.lexsort((rows["doc"], 1 - rows["old"], rows["check"], rows["hash"]))]
                rows = rows[later(rows)]
            if len(rows):
                yield found_spans(rows)

    return blocks.mapInArrow(apply, SPANS)


@dataclass
class Index:
    """Sorted immutable runs under `path`, newest last; `add` merges a batch in and tells what of it goes."""

    spark: SparkSession
    path: str
    window: int = WINDOW
    gram: int = GRAM
    fanout: int = FANOUT
    hot: int = HOT
    n_parts: int = 64
    n_tasks: int = 8
    runs: list[str] = field(default_factory=list)
    made: int = 0

    def size_for(self, text_bytes: float) -> None:
        """Parts for this much text; only before the first run."""
        if not self.runs:
            rows = text_bytes / TEXT_PER_ROW * STRETCH.itemsize
            self.n_tasks = parts_for(rows, PART_BYTES, 8)
            self.n_parts = 8 * self.n_tasks

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The index that was kept under path, as its last committed batch left it."""
        fs, folder = filesystem(path)
        names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.startswith("manifest-"))
        with fs.open_input_stream(names[-1]) as file:
            return cls(spark, path, **json.loads(file.read()))

    def commit(self) -> None:
        """Keeps the list of runs: a batch counts from here on, and one that failed before left only files that no list names."""
        fs, folder = filesystem(self.path)
        fs.create_dir(folder)
        kept = {k: getattr(self, k) for k in ("window", "gram", "fanout", "hot", "n_parts", "n_tasks", "runs", "made")}
        with fs.open_output_stream(f"{folder}/manifest-{self.made:08d}.json") as file:
            file.write(json.dumps(kept).encode())

    def read(self, run: str) -> DataFrame:
        """Where the parts of a run lie."""
        return self.spark.read.schema(f"{SPANS}, {POINTER}").parquet(run).filter("part IS NOT NULL").select("part", F.lit(None).cast("binary").alias("data"), "file", "offset", "size")

    def add(self, docs: DataFrame, corpus: DataFrame) -> DataFrame:
        """Spans (doc_id, tag, at, n, state) of windows of `docs` that an earlier document has.

        docs and corpus are (doc_id, tag, text); corpus holds docs and all that was indexed before.
        """
        made = self.made + 1
        name = f"{self.path}/run-{made}-{uuid.uuid4().hex[:8]}"
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("file", "string"), ("offset", "long"), ("size", "long"))]
        blocks = fingerprints(docs, self.n_parts, self.window, self.gram, self.hot).select("part", "data", *nothing)
        for run in self.runs:
            blocks = blocks.unionByName(self.read(run))
        compact = len(self.runs) + 1 >= self.fanout
        out = stored(merged(by_part(blocks, self.n_tasks), f"{name}-rows", compact), name)
        spans = out.filter("part IS NULL").select("doc_id", "tag", "at", "n", "state")
        contested = spans.filter(f"state <> {GONE}")
        texts = packed(corpus, members(contested, ["doc_id", "tag"])).join(by_document(contested).hint("shuffle_hash"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "spans")
        windows = compared(by_part(window_rows(texts, self.n_parts, self.window), self.n_tasks))
        found = stored(spans.filter(f"state = {GONE}").unionByName(windows), f"{name}-spans")
        self.runs, self.made = [name] if compact else [*self.runs, name], made
        self.commit()
        return found


def cut(docs: DataFrame, spans: DataFrame, window: int, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of (doc_id, tag, text) without the windows of the spans."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunked(batches, "text", 1 << 18):
            row, at, n, _ = span_arrays(chunk.column(3))
            cuts = np.searchsorted(row, np.arange(chunk.num_rows + 1))
            count, removed, kept = [], [], []
            for i, raw in enumerate(unpacked(chunk, 2)):
                words = raw.split()
                lo, hi = cuts[i], cuts[i + 1]
                count.append(len(words))
                if lo < hi:
                    gone = H.covered(len(words), at[lo:hi], at[lo:hi] + n[lo:hi] + window - 1)
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            columns = [chunk.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            columns += [pa.array(kept, pa.binary()).cast(pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    rows = packed(docs).join(by_document(spans).hint("shuffle_hash"), ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "spans")
    return rows.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def deduplicate(df: DataFrame, batches: int = BATCHES, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """Every document without the words of windows that start in a smaller document, `batches` ranges of ids one after another."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_dir(spark, "substrings")
    docs = identified(df, key, text)
    index = Index(spark, path, window, gram, fanout, hot)
    index.size_for(float(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / batches)
    bounds = docs.select("doc_id").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.001) if batches > 1 else []
    spans = None
    low = None
    for high in [*sorted({int(b) for b in bounds}), None]:
        below = F.lit(True) if high is None else F.col("doc_id") <= high
        batch = docs.filter(below if low is None else below & (F.col("doc_id") > low)).filter("doc_id IS NOT NULL")
        more = index.add(batch, docs.filter(below & F.col("doc_id").isNotNull()))
        spans = more if spans is None else spans.unionByName(more)
        low = high
    return cut(docs, spans, window, with_text)

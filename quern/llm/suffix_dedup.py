"""Removal of byte strings that also start elsewhere, by sharded suffix arrays.

Every byte covered by a string of `length` bytes that starts at another place too, in the same text or another, goes. Beside
that, bytes covered by a string of `shorter` bytes that also starts in another row are counted: passages of fewer than
`length` bytes that documents share.

1. Equal texts are one class. Per class, the least hash of the byte-grams in a window of `shorter` bytes cuts the window
   starts into stretches; equal strings of either length start in stretches of equal least hash. Only these rows travel.
2. By least hash: stretches with equal bytes (up to the end of their last string of `length`) are repeated whole; two 64-bit
   hashes tell that they are equal. Stretches that differ are sources, if another one has the same bytes around the least
   gram, on the side where equal strings of `shorter` must agree; so are all of a group where one holds its least gram twice.
   The bytes of sources are dealt to shards by least hash, one source for all stretches with the same bytes.
3. A shard concatenates its sources, builds their suffix array by induced sorting and the permuted longest common
   prefixes; a start is repeated if its suffix agrees with a neighbour on `length` bytes, and shared if it agrees with one
   of another class on `shorter`. All occurrences are in one shard, or among the equal stretches of step 2.
4. The spans go back to their texts.

Hot groups: copies collapse in step 1, per task already. Of stretches with equal bytes in several documents, a task sends one
on and the others' verdict to the part of their document. Where a task meets HOT different stretches of one least hash, or
where the sources of one exceed GROUP_BYTES in all, no shard takes them: their strings are compared one by one as two 64-bit
hashes, dealt by hash, and those that meet in a task are combined there. That way finds the same strings and splits any
group.

Defined results: a null text is empty; a text shorter than `length` keeps all its bytes; rows with equal texts are copies
of each other whatever their ids, so all go; bytes are judged on the input; cuts may fall inside a character; null ids
stay null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import hashing as H
from quern.llm.common import BLOCK, BLOCK_DDL, block_rows, buffers, by_part, chunked, parts, parts_for, shared_dir, small_batches, stored, text_column
from quern.llm.components import salted_join
from quern.llm.substring_dedup import SPANS, by_document, firsts, packed, span_arrays, unpacked
from quern.llm.suffix_array import repeats

LENGTH, SHORTER, GRAM = 400, 256, 32
#: Bytes of sources in a shard: a suffix array takes some 100 bytes for each.
SHARD_BYTES = 1 << 20
#: Bytes of sources of one least hash, beyond which their strings are compared by hash, and different stretches in a task.
GROUP_BYTES = 512 << 10
HOT = 256
#: Starts of one long text that are looked at together.
SEGMENT = 4 << 20
PART_BYTES = 24 << 20
#: Low bits of a gram's hash that do not count.
VALUE_BITS = 24
OTHER_BASE = 0xD1342543DE82EF95
STRETCH = np.dtype([("least", "<u8"), ("bytes", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("at", "<i4"), ("n", "<i4"), ("self", "<i2"), ("state", "<i2"), ("left", "<u4"), ("right", "<u4")])
WINDOWS = np.dtype([("hash", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("tag", "<i4"), ("at", "<i4"), ("kind", "<i4"), ("state", "<i4")])
SPAN = np.dtype([("doc", "<i8"), ("tag", "<i4"), ("at", "<i4"), ("n", "<i4"), ("state", "<i4")])
#: What a span says of its starts: repeated strings of `length`, strings of `shorter` in another document, or both; a source
#: of bytes; a source whose strings are compared one by one. A row that is not decided yet is OPEN.
REPEATED, SHARED, SOURCE, SPLIT, OPEN = 1, 2, 4, 8, 0


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, doc_id, tag, text): doc_id and tag are two hashes of the text, its class."""
    body = text_column(df, text)
    return df.select(F.col(key).alias("key"), F.xxhash64(body).alias("doc_id"), F.hash(body).alias("tag"), body.alias("text"))


def stretches(buf: np.ndarray, offsets: np.ndarray, length: int, shorter: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, text of each row) for the texts of a chunk."""
    if len(buf) < shorter:
        return np.empty(0, STRETCH), np.zeros(0, np.int64)
    spans = H.Spans(buf)
    grams = spans.every(gram)
    bits = H.U(max(VALUE_BITS, int(len(grams)).bit_length()))
    # the place stands in the low bits: the least of a window is its leftmost least gram
    least = H.sliding_min((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), shorter - gram + 1)
    place = (least & ((H.U(1) << bits) - H.U(1))).astype(np.int64)
    # the value is the same whatever else the chunk holds
    value = least >> bits if bits == VALUE_BITS else H.sliding_min(grams >> H.U(VALUE_BITS), shorter - gram + 1)
    n = len(least)
    change = np.ones(n, bool)
    change[1:] = value[1:] != value[:-1]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = doc[:n] == doc[shorter - 1 : shorter - 1 + n]
    begins = whole.copy()
    begins[1:] &= change[1:] | ~whole[:-1] | (doc[1:n] != doc[: n - 1])
    at = np.flatnonzero(begins)
    breaks = np.flatnonzero(begins | ~whole)
    after = np.concatenate([breaks, [n]])[np.searchsorted(breaks, at, "right")]
    rows = np.zeros(len(at), STRETCH)
    # the bytes of all strings of `length` that start here, as far as the text goes
    end, many = np.minimum(after - 1 + length, offsets[doc[at] + 1]), (after - at).astype(np.uint64)
    rows["least"], rows["bytes"], rows["check"] = H.mix(value[at]), H.mix(spans.of(at, end) + many), H.Spans(buf, OTHER_BASE).of(at, end)
    rows["at"], rows["n"] = at - offsets[doc[at]], after - at
    rows["self"] = (place[at] != place[after - 1]) | (bits > VALUE_BITS)  # in a very long text, places are those of coarser values
    # equal strings of `shorter` agree on half of what is beside the gram, before or after it; 0 where the text has less
    half, g, d = (shorter - gram) // 2, place[at], doc[at]
    for side, low, high in (("left", g - half, g + gram), ("right", g, g + gram + half)):
        fits = np.flatnonzero((low >= offsets[d]) & (high <= offsets[d + 1]))
        rows[side][fits] = (spans.of(low[fits], high[fits]) >> H.U(32)).astype(np.uint32) | 1
    return rows, doc[at]


def cut_stretches(buf: np.ndarray, offsets: np.ndarray, length: int, shorter: int, gram: int, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """stretches() of a chunk; of one long text, `segment` bytes of starts at a time, so that memory does not grow with it."""
    if len(offsets) > 2 or len(buf) <= segment + length:
        return stretches(buf, offsets, length, shorter, gram)
    out = []
    for low in range(0, len(buf), segment):
        part = buf[low : low + segment + length - 1]
        rows, _ = stretches(part, np.array([0, len(part)]), length, shorter, gram)
        rows = rows[rows["at"] < segment]
        rows["n"] = np.minimum(rows["n"], segment - rows["at"])
        rows["at"] += low
        # cut where the segment ends, a stretch has other bytes than elsewhere, and its least gram's neighbours are not all here
        rows["self"] = 1
        out.append(rows)
    rows = np.concatenate(out)
    return rows, np.zeros(len(rows), np.int64)


def kinds_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows in order of least hash and bytes, whether a row is its kind's first, rows of its kind, whether several documents have it)."""
    rows = rows[np.lexsort((rows["at"], rows["tag"], rows["doc"], rows["check"], rows["bytes"], rows["least"]))]
    same = ("least", "bytes", "check", "doc", "tag")
    rows = rows[firsts(*(rows[c] for c in (*same, "at")))]
    new = firsts(*(rows[c] for c in same[:3]))
    kind = np.cumsum(new) - 1
    documents = np.bincount(kind, firsts(*(rows[c] for c in same)), minlength=1)
    return rows, new, np.bincount(kind, minlength=1)[kind], documents[kind] > 1


def combined(rows: np.ndarray, n_parts: int, hot: int) -> pa.RecordBatch:
    """Block rows of a task's stretches by least hash; those decided here, and those of hot groups, under part -1 - p by document."""
    rows, new, copies, several = kinds_of(rows)
    part = (rows["least"] % H.U(n_parts)).astype(np.int32)
    own = -1 - (H.mix(rows["doc"].astype(np.uint64)) % H.U(n_parts)).astype(np.int32)
    # stretches in several documents are repeated and shared, whatever comes; one of them goes on
    rows["state"][several] = REPEATED | SHARED
    part = np.where(several & ~new, own, part)
    new_least = firsts(rows["least"])
    group = np.cumsum(new_least) - 1
    many = (np.bincount(group, new, minlength=1) >= hot)[group]
    marks = rows[many & new_least]  # a row without starts tells the group's part
    marks["state"], marks["n"] = SPLIT, 0
    at = np.flatnonzero(many)
    rows["state"][at] |= np.where(new[at] | (rows["state"][at] == OPEN), SPLIT, 0).astype(np.int16)
    part = np.where(many, own, part)
    part = np.concatenate([part, (marks["least"] % H.U(n_parts)).astype(np.int32)])
    return block_rows(part, np.concatenate([rows, marks]), BLOCK)


def fingerprints(docs: DataFrame, n_parts: int, length: int, shorter: int, gram: int, hot: int, segment: int) -> DataFrame:
    """Block rows of the stretches of every class, once per task."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        for chunk in chunked(batches, "text"):
            ids, tags = np.asarray(chunk.column(0)), np.asarray(chunk.column(1))
            fresh = np.zeros(chunk.num_rows, bool)
            for i, c in enumerate(zip(ids.tolist(), tags.tolist(), strict=True)):
                if c not in seen:
                    seen.add(c)
                    fresh[i] = True
            buf, offsets = buffers(chunk.column(2))
            rows, doc = cut_stretches(buf, offsets, length, shorter, gram, segment)
            rows["doc"], rows["tag"] = ids[doc], tags[doc]
            held.append(rows[fresh[doc]])
            if sum(map(len, held)) > 300_000:
                rows, held = np.concatenate(held), []
                yield combined(rows, n_parts, hot)
        if held:
            yield combined(np.concatenate(held), n_parts, hot)

    return docs.mapInArrow(apply, BLOCK_DDL)


def kin(rows: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which rows have the bytes on a side of their least gram in common with another kind of its group."""
    out = np.zeros(len(rows), bool)
    for side in ("left", "right"):
        at = np.flatnonzero(rows[side])
        at = at[np.lexsort((rows[side][at], rows["least"][at]))]  # stable: kinds stay together
        group = np.cumsum(firsts(rows["least"][at], rows[side][at])) - 1 if len(at) else at
        kind = (np.cumsum(new) - 1)[at]
        if len(at):
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            out[at] |= (np.minimum.reduceat(kind, starts) < np.maximum.reduceat(kind, starts))[group]
    return out


def decide(rows: np.ndarray, length: int, group_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one part: (rows of which something is to be done, their states)."""
    marked = np.unique(rows["least"][rows["n"] == 0])
    rows, new, copies, several = kinds_of(rows[rows["n"] > 0])
    if not len(rows):
        return rows, np.zeros(0, np.int32)
    new_least = firsts(rows["least"])
    group = np.cumsum(new_least) - 1
    starts = np.flatnonzero(new_least)
    selves = np.maximum.reduceat(rows["self"], starts)[group] > 0
    split = np.isin(rows["least"], marked)
    # other kinds can hold no equal strings; copies in one document may be shared each for itself
    source = (new | ~several) & (kin(rows, new) | selves | split)
    size = np.where(source, rows["n"].astype(np.int64) + length - 1, 0)
    split |= np.add.reduceat(size, starts)[group] > group_bytes
    state = rows["state"].astype(np.int32)
    state[copies > 1] |= REPEATED
    state[several] |= SHARED
    state[source] |= np.where(split[source], SPLIT, SOURCE)
    return rows[state != 0], state[state != 0]


def decided(blocks: DataFrame, length: int, group_bytes: int) -> DataFrame:
    """(doc_id, tag, at, n, state, least)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in parts(batches, STRETCH):
            rows, state = decide(rows, length, group_bytes) if part >= 0 else (rows, rows["state"])
            columns = [pa.array(np.ascontiguousarray(rows[c])) for c in ("doc", "tag", "at", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(state.astype(np.int32)), pa.array(rows["least"].astype(np.int64))], names=["doc_id", "tag", "at", "n", "state", "least"])

    return blocks.mapInArrow(apply, f"{SPANS}, least long")


def met(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows in order of hash, the verdict on each, whether it is the first with its hash): strings of `length` (kind 0) that stand twice, of `shorter` (1) in several classes."""
    rows = rows[np.lexsort((rows["at"], rows["tag"], rows["doc"], rows["check"], rows["hash"], rows["kind"]))]
    same = ("kind", "hash", "check", "doc", "tag")
    new = firsts(*(rows[c] for c in same[:3]))
    group = np.cumsum(new) - 1
    several = (np.bincount(group, firsts(*(rows[c] for c in same)), minlength=1) > 1)[group]
    twice = (np.bincount(group, firsts(*(rows[c] for c in (*same, "at"))), minlength=1) > 1)[group]
    return rows, np.where(rows["kind"] == 0, np.where(twice, REPEATED, 0), np.where(several, SHARED, 0)), new


def windows_of(chunk: pa.RecordBatch, raw: list[bytes], take: np.ndarray, length: int, shorter: int) -> np.ndarray:
    """The strings of both lengths that start in the spans of a chunk that are SPLIT."""
    row, at, n, _ = (x[take] for x in span_arrays(chunk.column(3)))
    buf, offsets = buffers(pa.array(raw, pa.binary()))
    places, of = H.ranges(offsets[row] + at, n), np.repeat(row, n)
    fits = places + length <= offsets[of + 1]
    one, other, out = H.Spans(buf), H.Spans(buf, OTHER_BASE), []
    for kind, size, p, r in ((0, length, places[fits], of[fits]), (1, shorter, places, of)):
        rows = np.zeros(len(p), WINDOWS)
        rows["hash"], rows["check"], rows["kind"] = one.of(p, p + size), other.of(p, p + size), kind
        rows["doc"], rows["tag"], rows["at"] = np.asarray(chunk.column(0))[r], np.asarray(chunk.column(1))[r], p - offsets[r]
        out.append(rows)
    return np.concatenate(out)


PIECES = "part int, doc_id long, tag int, at int, n int, data binary"


def pieces(texts: DataFrame, n_shards: int, n_parts: int, length: int, shorter: int) -> DataFrame:
    """Rows (shard, doc_id, tag, at, n, bytes) of sources, and block rows (part -1 - p, data) of the strings of split groups.

    Strings that meet in a task are decided there, and one of them goes on; the others' verdicts go by document.
    """
    names = ["part", "doc_id", "tag", "at", "n", "data"]

    def dealt(rows: np.ndarray) -> pa.RecordBatch:
        rows, verdict, new = met(rows)
        rows["state"] |= verdict
        part = (rows["hash"] % H.U(n_parts)).astype(np.int32)
        own = (H.mix(rows["doc"].astype(np.uint64)) % H.U(n_parts)).astype(np.int32)
        done = (verdict > 0) & ~new
        block = block_rows(np.where(done, -1 - n_parts - own, -1 - part), rows, BLOCK)
        nulls = [pa.nulls(block.num_rows, t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32())]
        return pa.RecordBatch.from_arrays([block.column(0), *nulls, block.column(1)], names=names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for chunk in chunked(batches, "text", 1 << 18):
            raw = unpacked(chunk, 2)
            column = chunk.column(3)
            row, at, n, state = span_arrays(column)
            least = np.asarray(column.flatten().field(3)).view(np.uint64)
            ids, tags = np.asarray(chunk.column(0)), np.asarray(chunk.column(1))
            take = np.flatnonzero(state & SOURCE)
            if len(take):
                shard = (least[take] % H.U(n_shards)).astype(np.int32)
                data = [raw[r][a : a + m + length - 1] for r, a, m in zip(row[take].tolist(), at[take].tolist(), n[take].tolist(), strict=True)]
                numbers = [pa.array(x[take].astype(np.int32)) for x in (at, n)]
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(ids[row[take]]), pa.array(tags[row[take]]), *numbers, pa.array(data, pa.binary())], names=names)
            take = np.flatnonzero(state & SPLIT)
            if len(take):
                held.append(windows_of(chunk, raw, take, length, shorter))
                if sum(map(len, held)) > 400_000:
                    yield dealt(np.concatenate(held))
                    held = []
        if held:
            yield dealt(np.concatenate(held))

    return texts.mapInArrow(apply, PIECES)


def united(rows: np.ndarray) -> np.ndarray:
    """Spans of starts, with those of a class and state that meet or overlap as one."""
    rows = rows[np.lexsort((rows["at"], rows["state"], rows["tag"], rows["doc"]))]
    if not len(rows):
        return rows
    new = firsts(rows["doc"], rows["tag"], rows["state"])
    text = np.cumsum(new).astype(np.int64) << 32  # places of different classes stay apart
    start, end = text + rows["at"], text + rows["at"] + rows["n"]
    reach = np.maximum.accumulate(end)
    begins = np.ones(len(rows), bool)
    begins[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(begins)
    out = rows[at]
    out["n"] = np.maximum.reduceat(end, at) - start[at]
    return out


def spans_of(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Spans of single starts; one that is repeated and shared is in two of them."""
    out = []
    for flag in (REPEATED, SHARED):
        hit = (state & flag) > 0
        rows = np.ones(int(hit.sum()), SPAN)
        rows["doc"], rows["tag"], rows["at"], rows["state"] = doc[hit], tag[hit], at[hit], flag
        out.append(united(rows))
    return np.concatenate(out)


def shard_spans(ids: np.ndarray, tags: np.ndarray, at: np.ndarray, n: np.ndarray, data: list[np.ndarray], length: int, shorter: int) -> np.ndarray:
    """The spans of repeated and shared strings in one shard."""
    owners = np.unique(np.stack([ids, tags], 1), axis=0, return_inverse=True)[1].ravel()
    place, twice, shared = repeats(data, n, owners, length, shorter)
    return spans_of(np.repeat(ids, n), np.repeat(tags, n), np.repeat(at, n) + place, twice * REPEATED | shared * SHARED)


def window_spans(rows: np.ndarray) -> np.ndarray:
    """The spans of split strings of a part, from what it shows and what was known before."""
    rows, verdict, _ = met(rows)
    return spans_of(rows["doc"], rows["tag"], rows["at"], rows["state"] | verdict)


def sharded(rows: DataFrame, length: int, shorter: int, n_parts: int) -> DataFrame:
    """Block rows of the spans of repeated strings, dealt by class, from the rows of pieces() in order of part."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done() -> None:
            if data:
                if now >= 0:
                    held.append(shard_spans(*(np.array(x, np.int64) for x in (ids, tags, at, n)), data, length, shorter))
                else:
                    held.append(window_spans(np.concatenate([x.view(WINDOWS) for x in data])))

        def flush() -> Iterator[pa.RecordBatch]:
            rows = united(np.concatenate(held))
            held.clear()
            yield block_rows((H.mix(rows["doc"].astype(np.uint64)) % H.U(n_parts)).astype(np.int32), rows, BLOCK)

        now, ids, tags, at, n, data = None, [], [], [], [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for i, (part, doc, tag, place, many) in enumerate(zip(*columns, strict=True)):
                if part != now:
                    done()
                    now, ids, tags, at, n, data = part, [], [], [], [], []
                    if sum(map(len, held)) > 400_000:
                        yield from flush()
                ids.append(doc)
                tags.append(tag)
                at.append(place)
                n.append(many)
                data.append(np.frombuffer(batch.column(5)[i].as_buffer(), np.uint8))
        done()
        if held:
            yield from flush()

    return rows.mapInArrow(apply, BLOCK_DDL)


def joined_spans(blocks: DataFrame) -> DataFrame:
    """(doc_id, tag, at, n, state): the spans of each class, those that meet as one."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in parts(batches, SPAN):
            rows = united(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c])) for c in ("doc", "tag", "at", "n", "state")], names=["doc_id", "tag", "at", "n", "state"])

    return blocks.mapInArrow(apply, SPANS)


def cut(docs: DataFrame, length: int, shorter: int, with_text: bool) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, n_shared[, kept]) of documents with their class's spans and whether it has copies."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"] + ["kept"] * with_text
        for chunk in chunked(batches, "text", 1 << 18):
            row, at, n, state = span_arrays(chunk.column(3))
            cuts = np.searchsorted(row, np.arange(chunk.num_rows + 1))
            out = []
            for i, (raw, copied) in enumerate(zip(unpacked(chunk, 2), chunk.column(4).to_pylist(), strict=True)):
                size, lo, hi = len(raw), cuts[i], cuts[i + 1]
                removed, runs, shared, kept = 0, 0, 0, raw
                if copied:
                    shared = size if size >= shorter else 0
                if copied and size >= length:
                    removed, runs, kept = size, 1, b""
                elif lo < hi:
                    a, m, flags = at[lo:hi], n[lo:hi], state[lo:hi]
                    if not copied:
                        own = (flags & SHARED) > 0
                        shared = int(H.covered(size, a[own], a[own] + m[own] + shorter - 1).sum())
                    # starts too near the end of the text begin no string of `length`
                    m = np.minimum(m, size - length + 1 - a)
                    own = ((flags & REPEATED) > 0) & (m > 0)
                    gone = H.covered(size, a[own], a[own] + m[own] + length - 1)
                    removed, runs = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((size, removed, runs, hashlib.sha256(kept).hexdigest(), shared, kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            columns = [chunk.column(0), *(pa.array([o[j] for o in out], t) for j, t in enumerate(kinds[: 5 + with_text]))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)["key"]
    return docs.mapInArrow(apply, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long" + ", kept binary" * with_text)


def deduplicate(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, shorter: int = SHORTER, gram: int = GRAM,
    group_bytes: int = GROUP_BYTES, hot: int = HOT, shard_bytes: int = SHARD_BYTES, segment: int = SEGMENT, with_text: bool = False,
) -> DataFrame:
    """Every text without the bytes of strings of `length` bytes that also start elsewhere, and how many bytes it shares."""
    if not gram <= shorter <= length:
        raise ValueError("gram <= shorter <= length")
    spark = df.sparkSession
    small_batches(spark)
    path = shared_dir(spark, "suffixes")
    docs = classes(df, key, text)
    copies = docs.groupBy("doc_id", "tag").agg(F.count("*").alias("copies"))
    total = float(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    rows_bytes = total / (shorter - gram + 1) * 2 * STRETCH.itemsize
    n_tasks = parts_for(rows_bytes, PART_BYTES, 8)
    n_parts = 8 * n_tasks
    blocks = fingerprints(docs.select("doc_id", "tag", "text"), n_parts, length, shorter, gram, hot, segment)
    states = stored(decided(by_part(blocks, n_tasks), length, group_bytes), f"{path}/states")

    sources = states.filter(F.col("state").bitwiseAND(SOURCE | SPLIT) > 0)
    is_source = F.col("state").bitwiseAND(SOURCE) > 0
    size, split = sources.agg(F.sum(F.when(is_source, F.col("n") + (length - 1)).otherwise(0)), F.sum(F.when(is_source, 0).otherwise(F.col("n")))).first()
    n_shards = parts_for(float(size or 0), shard_bytes, 8)
    split_bytes = 2 * float(split or 0) * WINDOWS.itemsize
    n_split = parts_for(split_bytes, PART_BYTES / 8, 8)
    wanted = sources.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n", "state", "least")).alias("spans"))
    # one row of text for each class that has sources: of its copies, any is as good
    texts = packed(fresh(docs.select("doc_id", "tag", "text"))).join(wanted.hint("shuffle_hash"), ["doc_id", "tag"]).select("doc_id", "tag", "text", "spans")
    texts = once(texts)
    dealt = pieces(texts, n_shards, n_split, length, shorter).repartition(parts_for(float(size or 0) + split_bytes, 4 * shard_bytes, 8), "part").sortWithinPartitions("part")
    found = stored(joined_spans(by_part(sharded(dealt, length, shorter, n_parts), n_tasks)), f"{path}/spans")

    spans = states.select("doc_id", "tag", "at", "n", F.col("state").bitwiseAND(REPEATED | SHARED).alias("state")).filter("state > 0").unionByName(found)
    per_class = copies.filter("copies > 1").join(by_document(spans), ["doc_id", "tag"], "full").withColumn("same", F.xxhash64("doc_id", "tag")).withColumnsRenamed({"doc_id": "d", "tag": "t"})
    bodies = packed_with_key(docs).withColumn("same", F.xxhash64("doc_id", "tag"))
    joined = salted_join(bodies, per_class, "same", "key", "left")
    joined = joined.select("key", "tag", "text", F.when((F.col("d") == F.col("doc_id")) & (F.col("t") == F.col("tag")), F.col("spans")).alias("spans"), (F.coalesce("copies", F.lit(1)) > 1).alias("copied"))
    return cut(joined, length, shorter, with_text).withColumnRenamed("key", key)


def fresh(docs: DataFrame) -> DataFrame:
    """Of each task's rows (doc_id, tag, text), one a class: copies of one text do not all travel to one task."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keep = []
            for c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(c not in seen)
                seen.add(c)
            if any(keep):
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(apply, docs.schema)


def once(texts: DataFrame) -> DataFrame:
    """Rows sorted by class, one of each: the join has put a class's rows into one task."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            keep = [k != p for k, p in zip(keys, [last, *keys[:-1]], strict=True)] if keys else []
            if any(keep):
                yield batch.filter(pa.array(keep))
            last = keys[-1] if keys else last

    return texts.sortWithinPartitions("doc_id", "tag").mapInArrow(apply, texts.schema)


def packed_with_key(docs: DataFrame) -> DataFrame:
    """(key, doc_id, tag, text) with the text compressed, as it travels."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for chunk in chunked(batches, "text"):
            yield pa.RecordBatch.from_arrays([*(chunk.column(i) for i in range(3)), pa.array([pack(x) for x in chunk.column(3).cast(pa.binary()).to_pylist()], pa.binary())], names=["key", "doc_id", "tag", "text"])

    kind = dict(docs.dtypes)["key"]
    return docs.mapInArrow(apply, f"key {kind}, doc_id long, tag int, text binary")

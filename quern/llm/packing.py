"""Packing into windows by Karmarkar-Karp multiway differencing.

Each document's ids are cut into full windows and a rest; rests are cut once more, so that no piece is longer than
`piece`. The pieces of a block are dealt to k windows: every piece begins as a partial partition of its own, and the two
partial partitions with the largest imbalance are merged again and again, the fullest window of one with the emptiest of
the other, until one partition is left. Full windows take no part: they have no imbalance. k begins at the least number of windows that can hold the block; while any window
exceeds the capacity, the window count rises.

A block is a bounded number of ids in file order, so a task holds one block at a time and nothing is shuffled. Only the
last block of a partition can be small; its last window is the padding that remains.

Defined results: a null or empty text has its end id only; a null id stays null; repeated rows are packed each for
itself; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from quern.llm import encoders
from quern.llm.common import chunked, small_batches, text_column

CAPACITY = 2048
#: Longest piece of a rest: small pieces let differencing level the windows.
PIECE = 512
#: Ids in a block: enough windows to level, few enough to difference quickly.
BLOCK_IDS = 1 << 17
END = 1


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Karmarkar-Karp: k lists of item numbers with near-equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    # A partial partition is its non-empty windows (sum, items), fullest first; the others are empty. Sums count from the emptiest.
    heap = [(-int(s), i, [(int(s), (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            c = [*a, *b]
        else:  # the fullest of one meet the emptiest of the other
            a, b = [*a, *[(0, ())] * (k - len(a))], [*b, *[(0, ())] * (k - len(b))]
            c = [(x + y, (p, q)) for (x, p), (y, q) in zip(a, reversed(b), strict=True)]
        c.sort(key=lambda w: -w[0])
        count += 1
        heapq.heappush(heap, (-(c[0][0] - (c[-1][0] if len(c) == k else 0)), count, c))
    windows = []
    for _, tree in heap[0][2]:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, int):
                items.append(x)
            else:
                todo.extend(x)
        windows.append(items)
    return windows


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Lists of item numbers, none over the capacity: the window count rises until differencing meets it."""
    total = int(sizes.sum())
    if not total:
        return []
    k = -(-total // capacity)
    while True:
        found = difference(sizes, k)
        most = max(int(sizes[x].sum()) for x in found)
        if most <= capacity:
            return [x for x in found if x]
        # the same spread around a mean that is lower by the excess
        k = max(k + 1, -(-total // max(1, capacity - (most - total // k))))


class Packer:
    """Collects documents' ids and gives (document, start, length, sequence, offset) for each piece, a block at a time."""

    def __init__(self, capacity: int = CAPACITY, piece: int = PIECE, block: int = BLOCK_IDS):
        self.capacity, self.piece, self.block, self.sequence = capacity, min(piece, capacity), block, 0
        self.rests: list[tuple[int, int, int]] = []
        self.held = 0

    def add(self, document: int, n: int) -> list[tuple[int, int, int, int, int]]:
        """Full windows of a document at once; its rest waits in the block."""
        out = []
        full = n // self.capacity
        for i in range(full):
            out.append((document, i * self.capacity, self.capacity, self.sequence, 0))
            self.sequence += 1
        for at in range(full * self.capacity, n, self.piece):
            self.rests.append((document, at, min(self.piece, n - at)))
        self.held += n - full * self.capacity
        return out

    def flush(self) -> list[tuple[int, int, int, int, int]]:
        """Packs the block."""
        rests, self.rests, self.held = self.rests, [], 0
        out = []
        for items in windows(np.array([r[2] for r in rests], np.int64), self.capacity):
            offset = 0
            for i in sorted(items):
                out.append((*rests[i], self.sequence, offset))
                offset += rests[i][2]
            self.sequence += 1
        return out


def pack(df: DataFrame, path: str, keep: str = "doc_id", text: str = "text", capacity: int = CAPACITY, piece: int = PIECE, block: int = BLOCK_IDS, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: keep, start, length, ids (int array), ids_crc32, doc_tokens, sequence_id, offset.

    `path` is the tokenizer file. sequence_id is the partition's number times 2**40 plus a count, so that a task that runs
    again gives the same numbers.
    """
    small_batches(df.sparkSession)
    schema = df.select(keep).schema
    for name, kind in (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")):
        schema = schema.add(name, kind, False)
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()), False)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoders.worker_encoder(path, end), Packer(capacity, piece, block)
        first = TaskContext.get().partitionId() << 40
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def rows(pieces: list) -> Iterator[pa.RecordBatch]:
            if not pieces:
                return
            keys = pa.concat_arrays([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            base = np.concatenate([[0], np.cumsum([len(h[1]) for h in held])])
            offsets = np.concatenate([h[2][:-1] + b for h, b in zip(held, base, strict=False)] + [base[-1:]])
            doc, start, length, sequence, offset = np.array(pieces, np.int64).T
            at = offsets[doc] + start
            crc = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(at))
            columns = [keys.take(pa.array(doc)), start, length, crc, np.diff(offsets)[doc], sequence + first, offset]
            columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
            if with_ids:
                cuts = np.concatenate([[0], np.cumsum(length)])
                columns.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids[np.concatenate([np.arange(a, a + n) for a, n in zip(at.tolist(), length.tolist(), strict=True)])].astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        pieces: list = []
        n = 0
        for chunk in chunked(batches, "__text", encoders.CHUNK, keep=True):
            ids, offsets = encoder.ids(chunk.column("__text").to_pylist())
            held.append((chunk.column(0), ids, offsets))
            for length in np.diff(offsets).tolist():
                pieces += packer.add(n, length)
                n += 1
            if packer.held >= packer.block:
                yield from rows(pieces + packer.flush())
                held, pieces, n = [], [], 0
        yield from rows(pieces + packer.flush())

    return df.select(keep, text_column(df, text).alias("__text")).mapInArrow(apply, schema)

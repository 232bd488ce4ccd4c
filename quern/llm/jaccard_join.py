"""Near-duplicate documents by the Jaccard similarity of their word n-gram sets: a prefix-filtered similarity join.

1. One pass counts every n-gram into a table of fixed size (a cell per hash), and gives each document the digest of its
   set (128 bits). Documents with equal sets are one class, a node; only classes are joined. A node's name is one half of its
   digest; where two classes have that half in common, which the other half tells, one is named anew.
2. A second pass orders each class's n-grams rare first (by the count of their cell, then by hash) and deals the prefix
   that any sufficiently similar set must meet to parts by hash.
3. In each part, classes that share a prefix n-gram are candidates, under the length and positional filters. First each
   class is paired with the least class of its group (a star) and verified; then, exhaustively, those pairs of a group
   that stars have not put into one component. A pair is verified once; a link inside a component cannot change it.
4. Verification meets the two texts, applies the suffix filter (their n-grams in ranges of hash bound the overlap), and
   counts the common n-grams.

A star's centre is the member with the fewest rarer n-grams before the shared one: of edited copies, whose edits are rare,
that is the one nearest to the original, so its star joins most of them, and few pairs are left to the exhaustive step.

Hot groups: copies collapse to a class before anything is paired, per task already; the members of one class's star are
salted over tasks; a group that stars have not joined is cut by size, as only sizes within the threshold can link, and into
blocks of BLOCK classes, and pairs of blocks are dealt to tasks; components come from salted joins. The count table only
orders n-grams; its size is bounded.

Defined results: words are runs of bytes other than ASCII white space, ASCII letters lower-cased; a text of fewer words
than n has its whole word sequence as its one n-gram; a text without words (or null) has an empty set and links with
nothing; repeated rows are documents of their own; a row with a null id links others as any row does, but its component has no
name of its own and is null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import hashing as H
from quern.llm.common import BLOCK, BLOCK_DDL, block_rows, buffers, by_part, chunked, parts, parts_for, shared_dir, small_batches, stored, text_column
from quern.llm.components import components, salted_join

WORDS = 5
#: The threshold as a fraction, so that whole numbers decide it.
NUMERATOR, DENOMINATOR = 80, 100
#: The count table has a cell for so many n-grams, about, and 2**MOST_CELL_BITS cells (bytes, as it travels) at most.
PER_CELL = 64
LEAST_CELL_BITS, MOST_CELL_BITS = 12, 24
BAND_BITS = 12
#: Bytes of prefix rows in a part.
PART_BYTES = 24 << 20
STAR_SALTS = 64
#: Classes of a block of a group.
BLOCK_CLASSES = 512
PREFIX = np.dtype([("hash", "<u8"), ("node", "<i8"), ("size", "<i4"), ("pos", "<i4")])


def sets(chunk: pa.RecordBatch, column: str, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the distinct n-grams of each text of a chunk, ascending within a text."""
    buf, offsets = buffers(chunk.column(column))
    buf = H.LOWER[buf]
    start, end, first = H.words(buf, offsets)
    words = H.Spans(H.Spans(buf).of(start, end))
    counts = np.diff(first)
    grams = words.every(n)
    many = np.maximum(counts - n + 1, 0)
    at = H.ranges(first[:-1], many)
    owner = np.repeat(np.arange(len(counts)), many)
    short = np.flatnonzero((counts > 0) & (counts < n))
    hashes = np.concatenate([grams[at], words.of(first[:-1][short], first[1:][short])])
    owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def set_digests(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two halves of a digest of each set, whatever the order of its members; 0 for the empty one."""
    size = np.diff(first)
    out = np.empty((len(size), 2), np.int64)
    for i, seed in enumerate((0x5DEECE66D, 0xB5297A4D3F84D5B5)):
        sums = np.concatenate([np.zeros(1, H.U), np.cumsum(H.mix(hashes ^ H.U(seed)), dtype=H.U)])
        out[:, i] = np.where(size > 0, H.mix((sums[first[1:]] - sums[first[:-1]]) ^ size.astype(H.U)).view(np.int64), 0)
    return out


Twins = dict[tuple[int, int], int]


def named(digests: np.ndarray, twins: Twins) -> np.ndarray:
    """The nodes of sets: the first half of their digests, but for twins."""
    out = digests[:, 0].copy()
    if twins:
        for i in np.flatnonzero(np.isin(out, [a for a, _ in twins])).tolist():
            out[i] = twins.get((int(digests[i, 0]), int(digests[i, 1])), out[i])
    return out


def twins_of(rows: DataFrame) -> Twins:
    """New names for classes whose first half another class has as well, all but one of each: by chance, some of 10**10 classes."""
    twins: Twins = {}
    several = rows.filter("size > 0").groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high")).filter("low < high").select("node")
    found = rows.join(several, "node").select("node", "other").distinct().orderBy("node", "other").collect()
    taken = {r.node for r in found}
    for (a, b), before in zip(found, [None, *found], strict=False):
        if before is None or before[0] != a:
            continue
        name = b
        while name in taken or name == 0 or not rows.filter(F.col("node") == name).isEmpty():
            name = int(H.mix(np.array([name], np.int64).view(np.uint64)).view(np.int64)[0])
        taken.add(name)
        twins[a, b] = name
    return twins


def renamed(rows: DataFrame, twins: Twins) -> DataFrame:
    """(doc_id, node, size) with the names of twins."""
    node = F.col("node")
    for (a, b), name in twins.items():
        node = F.when((F.col("node") == a) & (F.col("other") == b), name).otherwise(node)
    return rows.select("doc_id", node.alias("node"), "size")


def least_overlap(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least intersection with which sets of sizes a and b link: den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


def cell_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> H.U(64 - bits)).astype(np.int64)


def profile(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Rows (doc_id, node, other, size) of all documents, with both halves of the digests, and rows (band, counts) of the n-gram counts."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counts = np.zeros(1 << bits, np.uint32)
        names = ["doc_id", "node", "other", "size", "band", "counts"]
        for chunk in chunked(batches, "text"):
            hashes, first = sets(chunk, "text", n)
            cells, many = np.unique(cell_of(hashes, bits), return_counts=True)
            counts[cells] += many.astype(np.uint32)
            k = chunk.num_rows
            digests = set_digests(hashes, first)
            columns = [chunk.column(0), *(pa.array(np.ascontiguousarray(digests[:, i])) for i in range(2)), pa.array(np.diff(first).astype(np.int32)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        bands = counts.reshape(-1, 1 << BAND_BITS)
        used = np.flatnonzero(bands.any(1))
        pack = zstandard.ZstdCompressor(level=1).compress
        for at in range(0, len(used), 64):
            some = used[at : at + 64]
            k = len(some)
            data = [pack(bands[b].tobytes()) for b in some]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(k, pa.int64()) for _ in range(3)), pa.nulls(k, pa.int32()), pa.array(some.astype(np.int32)), pa.array(data, pa.binary())], names=names)

    return docs.mapInArrow(apply, "doc_id long, node long, other long, size int, band int, counts binary")


def cell_ranks(profiled: DataFrame, bits: int) -> np.ndarray:
    """For each cell, the logarithm of its count in eighths, a byte; counts are added by band on the executors."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for band, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                add = np.frombuffer(unpack(data), np.uint32).astype(np.int64)
                sums[band] = sums[band] + add if band in sums else add
        coded = [np.minimum(255, 8 * np.log2(x + 1.0)).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(coded, pa.binary())], names=["band", "ranks"])

    bands = profiled.filter("band IS NOT NULL").select("band", "counts")
    ranks = np.zeros((1 << bits >> BAND_BITS, 1 << BAND_BITS), np.uint8)
    for band, data in bands.repartition("band").mapInArrow(apply, "band int, ranks binary").toLocalIterator():
        ranks[band] = np.frombuffer(data, np.uint8)
    return ranks.ravel()


def prefixes(docs: DataFrame, ranks: np.ndarray, twins: Twins, bits: int, n: int, n_parts: int, num: int, den: int) -> DataFrame:
    """Block rows of the prefix n-grams of every class, once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # 2**MOST_CELL_BITS bytes at most

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        seen: set[int] = set()
        held: list[np.ndarray] = []
        for chunk in chunked(batches, "text"):
            hashes, first = sets(chunk, "text", n)
            size = np.diff(first)
            nodes = named(set_digests(hashes, first), twins)
            fresh = np.zeros(len(size), bool)
            for i, node in enumerate(nodes.tolist()):
                if size[i] and node not in seen:
                    seen.add(node)
                    fresh[i] = True
            owner = np.repeat(np.arange(len(size)), size)
            kept = fresh[owner]
            hashes, owner = hashes[kept], owner[kept]
            rank = cells[cell_of(hashes, bits)]
            order = np.lexsort((hashes, rank, owner))
            hashes, owner = hashes[order], owner[order]
            pos = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(size)))[owner]
            # a set that links shares at least ceil(num * size / den) of its members
            short = (size + 1 + (-num * size) // den)[owner]
            kept = pos < short
            rows = np.empty(int(kept.sum()), PREFIX)
            rows["hash"], rows["pos"], rows["node"], rows["size"] = hashes[kept], pos[kept], nodes[owner[kept]], size[owner[kept]]
            held.append(rows)
            if sum(map(len, held)) > 400_000:
                rows, held = np.concatenate(held), []
                yield block_rows((rows["hash"] % H.U(n_parts)).astype(np.int32), rows, BLOCK)
        if held:
            rows = np.concatenate(held)
            yield block_rows((rows["hash"] % H.U(n_parts)).astype(np.int32), rows, BLOCK)

    return docs.mapInArrow(apply, BLOCK_DDL)


def grouped(rows: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one part: star pairs (a, b) under the filters, and (signature, rows) of its groups of three or more, a signature once.

    Groups with the same members differ in the places of the shared n-gram only; each member keeps its first.
    """
    rows = rows[np.lexsort((rows["node"], rows["pos"], rows["hash"]))]  # copies of a class stand together, as their places agree
    new = np.ones(len(rows), bool)
    new[1:] = (rows["hash"][1:] != rows["hash"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
    rows = rows[new]
    starts = H.runs(rows["hash"][1:] == rows["hash"][:-1]) if len(rows) else np.zeros(0, np.int64)
    lengths = np.diff(np.concatenate([starts, [len(rows)]]))
    keep = lengths > 1
    starts, lengths = starts[keep], lengths[keep]
    leader = np.repeat(starts, lengths - 1)
    member = H.ranges(starts + 1, lengths - 1)
    a, b = rows[leader], rows[member]
    sa, sb = a["size"].astype(np.int64), b["size"].astype(np.int64)
    need = least_overlap(sa, sb, num, den)
    ok = den * np.minimum(sa, sb) >= num * np.maximum(sa, sb)
    ok &= 1 + np.minimum(sa - a["pos"], sb - b["pos"]) - 1 >= need
    pairs = np.unique(np.stack([a["node"][ok], b["node"][ok]], 1), axis=0) if ok.any() else np.zeros((0, 2), np.int64)
    big = lengths > 2
    starts, lengths = starts[big], lengths[big]
    at = H.ranges(starts, lengths)
    sums = np.concatenate([np.zeros(1, H.U), np.cumsum(H.mix(rows["node"][at].view(np.uint64)), dtype=H.U)])
    cuts = np.concatenate([[0], np.cumsum(lengths)])
    sign = H.mix((sums[cuts[1:]] - sums[cuts[:-1]]) ^ lengths.astype(H.U)).view(np.int64)
    sign = np.repeat(sign, lengths)
    members = rows[at]
    order = np.lexsort((members["pos"], members["node"], sign))
    sign, members = sign[order], members[order]
    new = np.ones(len(sign), bool)
    new[1:] = (sign[1:] != sign[:-1]) | (members["node"][1:] != members["node"][:-1])
    return pairs[:, 0], pairs[:, 1], sign[new], members[new]


def candidates(blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Star pairs as (sign null, a, b), and members of groups as (sign, a: node, size, pos)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in parts(batches, PREFIX):
            a, b, sign, members = grouped(rows, num, den)
            k, m = len(a), len(sign)
            columns = [pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(sign)]), pa.array(np.concatenate([a, members["node"]])), pa.concat_arrays([pa.array(np.ascontiguousarray(b)), pa.nulls(m, pa.int64())])]
            columns += [pa.concat_arrays([pa.nulls(k, pa.int32()), pa.array(np.ascontiguousarray(members[c]))]) for c in ("size", "pos")]
            yield pa.RecordBatch.from_arrays(columns, names=["sign", "a", "b", "size", "pos"])

    return blocks.mapInArrow(apply, "sign long, a long, b long, size int, pos int")


def common(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Size of the intersection of two ascending arrays, or -1 where the suffix filter shows it is under `need`."""
    edges = np.arange(1, 16, dtype=np.uint64) << H.U(60)
    in_a, in_b = (np.diff(np.concatenate([[0], np.searchsorted(x, edges), [len(x)]])) for x in (a, b))
    if np.minimum(in_a, in_b).sum() < need:
        return -1
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


def verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by their texts (node, text): once each. Members of a's star are dealt to STAR_SALTS tasks."""
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(STAR_SALTS)).cast("int").alias("salt"))
    members = pairs.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    heads = pairs.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    dealt = members.unionByName(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for chunk in chunked(batches, "text", 1 << 18):
            raw = chunk.column("text").cast(pa.binary()).to_pylist()
            import zstandard

            unpack = zstandard.ZstdDecompressor().decompress
            plain = pa.RecordBatch.from_arrays([pa.array([unpack(x) for x in raw], pa.binary())], names=["text"])
            hashes, first = sets(plain, "text", n)
            out = []
            for i, (a, b) in enumerate(zip(chunk.column(0).to_pylist(), chunk.column(2).to_pylist(), strict=True)):
                own = hashes[first[i] : first[i + 1]]
                if b is None:
                    head = own
                    continue
                need = int(least_overlap(np.int64(len(head)), np.int64(len(own)), num, den))
                both = common(head, own, need)
                if both >= need and den * both >= num * (len(head) + len(own) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(apply, "a long, b long")


def pairs_of_groups(placed: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(lo, hi): pairs of a group's members (sign, node, size, pos, component) in different components, under the filters.

    Members meet by size, in steps of the threshold, as a pair's sizes lie in one step or in neighbouring ones, and by pairs
    of blocks: a row is sent once for each block of its group.
    """
    counts = placed.groupBy("sign").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cut = salted_join(placed, counts, "sign", "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int"))
    step = F.floor(F.log(F.col("size").cast("double")) / math.log(1.0001 * den / num)).cast("int")
    cut = cut.withColumn("step", step).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    named = lambda df, side, *keys: df.select("sign", *keys, *(F.col(c).alias(f"{c}_{side}") for c in ("node", "size", "pos", "component")))
    smaller = named(cut, "a", "step", F.col("block").alias("block_a"), F.col("other").alias("block_b"))
    larger = cut.withColumn("step", F.explode(F.array(F.col("step"), F.col("step") - 1)))
    larger = named(larger, "b", "step", F.col("other").alias("block_a"), F.col("block").alias("block_b"))
    left = F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")
    once = F.struct("size_a", "node_a") < F.struct("size_b", "node_b")
    similar = F.lit(den) * F.col("size_a") >= F.lit(num) * F.col("size_b")
    enough = (num + den) * F.least(*left) >= num * (F.col("size_a") + F.col("size_b"))  # the positional filter, as for stars
    met = smaller.join(larger, ["sign", "step", "block_a", "block_b"]).filter(once & similar & enough & (F.col("component_a") != F.col("component_b")))
    return met.select(F.least("node_a", "node_b").alias("lo"), F.greatest("node_a", "node_b").alias("hi")).distinct()


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the text compressed, as it travels."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for chunk in chunked(batches, "text"):
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array([pack(x) for x in chunk.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "text"])

    return docs.mapInArrow(apply, "doc_id long, text binary")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR, block: int = BLOCK_CLASSES) -> DataFrame:
    """(doc_id, n_shingles, node, component_id): node names the classes of equal sets; component_id is the smallest id reachable."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_dir(spark, "jaccard")
    docs = df.select(F.col(key).cast("long").alias("doc_id"), text_column(df, text).alias("text"))
    grams = float(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    bits = min(MOST_CELL_BITS, max(LEAST_CELL_BITS, math.ceil(math.log2(grams / PER_CELL + 1))))
    profiled = stored(profile(docs, n, bits), f"{path}/profile")
    rows = profiled.filter("band IS NULL").select("doc_id", "node", "other", "size")
    twins = twins_of(rows)
    rows = renamed(rows, twins)
    ranks = cell_ranks(profiled, bits)
    total = grams * (1 - num / den) * PREFIX.itemsize
    n_tasks = parts_for(total, PART_BYTES, 8)
    blocks = prefixes(docs, ranks, twins, bits, n, 8 * n_tasks, num, den)
    found = stored(candidates(by_part(blocks, n_tasks), num, den), f"{path}/candidates")
    # a pair that is in a star both ways is verified once, from one of its centres
    ends = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    stars = found.filter("sign IS NULL").select(*ends, "a").groupBy("lo", "hi").agg(F.min("a").alias("a"))
    stars = stored(stars.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")), f"{path}/stars")
    groups = found.filter("sign IS NOT NULL").groupBy("sign", F.col("a").alias("node"), "size").agg(F.min("pos").alias("pos"))

    # one document's text for each class that is a candidate
    nodes = stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).unionByName(groups.select("node")).distinct()
    first = rows.filter("size > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = nodes.join(first, "node")
    texts = packed_texts(docs).join(wanted.hint("shuffle_hash"), "doc_id").select("node", "text")
    # rows that repeat a doc_id may bring other texts than the class's: each class keeps one text of its own
    # a class of rows without an id, which may link others, takes the text of any of them
    nameless = own_texts(packed_texts(docs.filter("doc_id IS NULL")).selectExpr("CAST(NULL AS LONG) AS node", "text"), twins, n)
    nameless = nameless.join(nodes.join(first, "node", "left_anti"), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    texts = stored(own_texts(texts, twins, n).unionByName(nameless), f"{path}/texts")

    links = stored(verified(stars, texts, n, num, den), f"{path}/links")
    parents = components(links)
    at = F.coalesce("component", "node")
    placed = salted_join(groups, parents, "node", "sign", "left").select("sign", "node", "size", "pos", at.alias("component"))
    mixed = placed.groupBy("sign").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("sign")
    placed = stored(salted_join(placed, mixed, "sign", "node"), f"{path}/placed")
    rest = pairs_of_groups(placed, num, den, block)
    rest = rest.join(stars.select(*ends), ["lo", "hi"], "left_anti").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    more = stored(verified(stored(rest, f"{path}/rest"), texts, n, num, den), f"{path}/more")
    if more.isEmpty():
        final = parents
    else:
        final = components(links.unionByName(more))

    least = final.join(first, "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    linked = salted_join(final, least, "component", "node").select("node", "least")
    alone = first.join(linked, "node", "left").select("node", F.coalesce("least", "doc_id").alias("least"))
    out = salted_join(rows, alone, "node", "doc_id", "left")
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "node", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def own_texts(texts: DataFrame, twins: Twins, n: int) -> DataFrame:
    """Of (node, text) rows, those whose n-gram set is the node's; where the node is null, all with the node of their set."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for chunk in chunked(batches, "text", 1 << 18):
            plain = pa.RecordBatch.from_arrays([pa.array([unpack(x) for x in chunk.column(1).to_pylist()], pa.binary())], names=["text"])
            same = pa.array(named(set_digests(*sets(plain, "text", n)), twins))
            unnamed = pc.is_null(chunk.column(0))
            out = pa.RecordBatch.from_arrays([pc.if_else(unnamed, same, chunk.column(0)), chunk.column(1)], names=["node", "text"])
            yield out.filter(pc.equal(same, out.column(0)))

    return texts.mapInArrow(apply, "node long, text binary")

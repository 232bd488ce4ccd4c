"""Toxicity by compression distance: windows of a text are compressed with a dictionary of toxic and one of ordinary text.

Both zstandard dictionaries start with the same content, which zstandard's trainer picks from ordinary text, and end with a
part of their own: the words that mark toxic texts (by a likelihood ratio over documents) in one, as many bytes of ordinary
text in the other. So a window's gain, its length under the ordinary dictionary less that under the toxic one, is zero unless
the own parts matter. A text is cut into overlapping windows of lower-case bytes; windows are flagged whose gains reach
thresholds, each the least one that at most a share in FLAGGED of the ordinary windows reach. A logistic curve over a text's
flagged windows beyond those that an ordinary text of its length has, and its mean gain, gives the score. Dictionaries are trained on one half of the sample, threshold and curve
on the other half, as a text that a dictionary was trained on compresses too well.

The model is fitted on a bounded sample: at most about PER_LABEL different texts of each label, chosen by their hash, and
BYTES_OF_A_TEXT bytes of each, cut out by the executors. It is some 200 KB, whatever the corpus. Scoring reads whole texts, in
a map without a shuffle.

Defined results: a null or empty text has no windows and no gains, so its score is the curve's value there; without rows of
both labels every score is the share of label 1 (0 without labels); rows without a label or a matching key are not learned
from; repeated rows are scored alike and learned once; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunked, shared_dir, small_batches, stored

#: Bound of the training sample: texts of each label, about, and bytes of each.
PER_LABEL = 4000
BYTES_OF_A_TEXT = 8000
#: Bytes of a window, and from one to the next: words of up to 12 bytes are whole in one of them.
WINDOW, STEP = 64, 52
#: Bytes that the dictionaries share, and that each may have of its own.
SHARED, OWN = 60_000, 4000
#: Twice the logarithm of the likelihood ratio from which a word marks a class, above that of the luckiest of all words.
MARKS = 4.0
#: Shares of ordinary windows that may reach the thresholds.
FLAGGED = (0.03, 0.005, 0.0005)
CUTOFF = 0.3
#: Bytes of text that are compressed at a time.
CHUNK = 1 << 20
WORD = re.compile(rb"[^\x00-\x60\x7b-\x7f]+")


@dataclass
class Model:
    """Two dictionaries, the thresholds of a window's gain, the shares of ordinary windows that reach them, and the curve's weights."""

    toxic: bytes = b""
    ordinary: bytes = b""
    thresholds: tuple[int, ...] = ()
    shares: tuple[float, ...] = ()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.0


def windows(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, start, length and text of every window); an empty text has none."""
    size = np.array([len(t) for t in texts], np.int64)
    count = np.where(size > 0, np.maximum(1, -(-(size - (WINDOW - STEP)) // STEP)), 0)
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(texts)), count)
    start = first[of] + (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * STEP
    return b"".join(texts), start, np.minimum(WINDOW, first[of] + size[of] - start), of


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Frames without header fields, so that a window's length is what its content takes; the dictionary is digested once."""
    settings = zstandard.ZstdCompressionParameters(
        window_log=10, hash_log=14, chain_log=14, search_log=6, min_match=3, target_length=32, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=settings)


def lengths(by: zstandard.ZstdCompressor, data: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Compressed length of each window."""
    if not len(start):
        return np.zeros(0, np.int64)
    places = np.stack([start, length], 1).astype(np.uint64)
    out = by.multi_compress_to_buffer(zstandard.BufferWithSegments(data, places.tobytes()), threads=1)
    return np.fromiter(map(len, out), np.int64, len(out))


class Scorer:
    """The dictionaries of a model, digested."""

    def __init__(self, model: Model):
        self.model = model
        if model.toxic:
            self.toxic, self.ordinary = compressor(model.toxic), compressor(model.ordinary)

    def gains(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(gain, text) of every window."""
        data, start, length, of = windows(texts)
        return lengths(self.ordinary, data, start, length) - lengths(self.toxic, data, start, length), of

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.model.weights):
            return np.full(len(texts), self.model.prior)
        gain, of = self.gains([(t or "").lower().encode() for t in texts])
        return curve(features(gain, of, len(texts), self.model), self.model.weights)


def features(gain: np.ndarray, of: np.ndarray, n: int, model: Model) -> np.ndarray:
    """A row per text: 1, mean gain, and for each threshold the flagged windows' share (its root) and their number beyond the expected one, in deviations (their root)."""
    count = np.bincount(of, minlength=n)
    out = [np.ones(n), np.bincount(of, gain, n) / np.maximum(1, count)]
    for least, share in zip(model.thresholds, model.shares, strict=True):
        flagged = np.bincount(of[gain >= least], minlength=n)
        beyond = (flagged - share * count) / np.sqrt(share * count + 0.25)
        out += [10 * np.sqrt(flagged / np.maximum(1, count)), np.sign(beyond) * np.sqrt(np.abs(beyond))]
    return np.stack(out, 1)


def curve(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))


def logistic(rows: np.ndarray, labels: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic curve by Newton's method, with a penalty on all but the first."""
    weights = np.zeros(rows.shape[1])
    ridge = np.full(rows.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = curve(rows, weights)
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + np.diag(ridge), rows.T @ (labels - p) - ridge * weights)
        weights = weights + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return weights


def marking_words(here: list[bytes], there: list[bytes]) -> list[bytes]:
    """Words that documents here have more often than those there, the clearest first, by the likelihood ratio of their counts."""
    a, b = Counter(), Counter()
    for counts, texts in ((a, here), (b, there)):
        for t in texts:
            counts.update(set(WORD.findall(t)))
    n, m = len(here), len(there)

    def part(k: float, of: float, share: float) -> float:
        return (k * math.log(k / (of * share)) if k else 0.0) + ((of - k) * math.log((of - k) / (of * (1 - share))) if of > k else 0.0)

    found, least = {}, MARKS + 2 * math.log(1 + len(a.keys() | b.keys()))
    for w, k in a.items():
        j, share = b[w], (k + b[w]) / (n + m)
        if share < 1 and k * m > j * n and (ratio := 2 * (part(k, n, share) + part(j, m, share))) >= least:
            found[w] = ratio
    return sorted(found, key=lambda w: (-found[w], w))


def own_part(words: list[bytes]) -> bytes:
    """The words, the clearest last, where it costs least to refer to them."""
    out = b" "
    for w in words:
        if len(out) + len(w) + 1 <= OWN:
            out = b" " + w + out
    return out


def pieces(texts: list[bytes]) -> list[bytes]:
    data, start, length, _ = windows(texts)
    return [data[a : a + n] for a, n in zip(start.tolist(), length.tolist(), strict=True) if n >= 8]


def picked(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer picks from the samples, the last `size` bytes at most; all of them if they are too few for it."""
    whole = b" ".join(samples)
    if len(whole) > 4 * size:
        return zstandard.train_dictionary(size + 2048, samples, k=64, d=8).as_bytes()[-size:]
    return whole[-size:]


def fit(texts: list[str], labels: list[int]) -> Model:
    """Dictionaries from one half of the texts, threshold and curve from the other, by a hash of the text."""
    rows = [(t.lower().encode(), y) for t, y in zip(texts, labels, strict=True)]
    half = [zlib.crc32(t) >> 7 & 1 for t, _ in rows]
    side = lambda h, y: [t for (t, label), of in zip(rows, half, strict=True) if of == h and label == y]
    prior = sum(labels) / max(1, len(labels))
    toxic, ordinary = side(0, 1), side(0, 0)
    if not (toxic and ordinary and side(1, 1) and side(1, 0)):
        return Model(prior=prior)
    own = own_part(marking_words(toxic, ordinary))
    samples = pieces(ordinary)
    shared = picked(samples, SHARED)
    other = picked(samples[::2], len(own))[-len(own) :].rjust(len(own))
    model = Model(shared + own, shared + other, prior=prior)
    held = [r for r, of in zip(rows, half, strict=True) if of]
    gain, of = Scorer(model).gains([t for t, _ in held])
    truth = np.array([y for _, y in held])
    clean = np.sort(gain[truth[of] == 0])
    if len(clean):
        model.thresholds = tuple(max(1, int(clean[int((1 - share) * (len(clean) - 1))]) + 1) for share in FLAGGED)
        model.shares = tuple(float((clean >= least).mean()) for least in model.thresholds)
    model.weights = logistic(features(gain, of, len(held), model), truth)
    return model


def sample(df: DataFrame, known: DataFrame, per_label: int) -> tuple[list[str], list[int]]:
    """About per_label different texts of each label, by a hash of the text, of df (k, t) and known (k, y); the counts cover all rows.

    Only keys and hashes are shuffled; the chosen ones, one row a text, meet the texts where these lie.
    """
    spark = df.sparkSession
    code = F.xxhash64("t", F.lit(13))
    labelled = stored(df.select("k", code.alias("h")).join(known, "k"), f"{shared_dir(spark, 'toxicity')}/labelled")
    counts = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[x for y, n in counts.items() for x in (F.lit(y), F.lit(min(1.0, per_label / max(1, n))))])
    place = F.pmod("h", F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = labelled.filter(place < share[F.col("y")]).groupBy("h", "y").agg(F.min("k").alias("k"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                raw = t.encode()
                at = zlib.crc32(raw) % max(1, len(raw) - BYTES_OF_A_TEXT)
                out.append(raw[at : at + BYTES_OF_A_TEXT].decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1)], names=["t", "y"])

    texts = df.withColumn("h", code).join(F.broadcast(chosen), ["k", "h"])  # about per_label rows a label
    rows = texts.select("t", "y").mapInArrow(cut, "t string, y int").distinct().collect()
    rows.sort(key=lambda r: (r["t"], r["y"]))
    return [r["t"] for r in rows], [r["y"] for r in rows]


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """The model of the labelled texts: rows of df with a row of labels, whose column `label` is 0 or 1."""
    small_batches(df.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).distinct()
    texts = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return fit(*sample(texts, known, per_label))


def predict(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """keep and score for every row, from its text alone."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select(*keep).schema.add("score", "double", False)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for chunk in chunked(batches, "__text", CHUNK):
            scores = scorer.score(chunk.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(chunk.column(i) for i in range(len(keep))), pa.array(scores, pa.float64())], names=schema.names)

    return df.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text")).mapInArrow(apply, schema)


def held_out(key: str = "doc_id"):
    """Whether a document takes no part in training."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """key, held_out, score, predicted: learned from the documents that are not held out."""
    model = train(df.filter(~held_out(key)), labels, key, text, label)
    scored = predict(df, model, [key], text)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))

"""Language identification with a linear-chain conditional random field over words.

A word's features are its character n-grams, its affixes (n-grams that hold a word edge, up to four characters) and, for
words of the training lexicon, the word itself; each has a weight per language. Transition weights between the languages of
neighbouring words are learned with them, from documents and from code-switched sequences made of pieces of documents of
different languages. Forward-backward gives every word its marginal probabilities; a document's language is the one with
the largest sum, its score that sum's share.

The model is fitted on a bounded sample: about PER_LANGUAGE different texts, chosen by their hash, of each of the LANGUAGES
most frequent labels, and WORDS_OF_A_DOCUMENT words of each, which the executors cut out; fewer texts of each where the labels
are so many that all would have more than WORDS_OF_THE_SAMPLE words. It is some hundred thousand weights for each label,
whatever the corpus. Gradients are added over batches of sequences and of words, so the driver holds the weights, their sums
and a row for each different word. Prediction reads whole texts, many at a time, without a shuffle; the chain of a long text
is cut into segments that run side by side, each from the message that a product of its matrices passes on, which is exact.

Defined results: a null text, or one without a letter (Unicode category L; a fraction or a Roman numeral sign is none), is
`und` with score 0; a table without a labelled row gives `und` for all; repeated rows give repeated results and count once
for the sample; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import hashing as H
from quern.llm.common import chunked, small_batches

#: Bound of the training sample: labels, documents of each, about, words of a document, and words of all.
LANGUAGES = 500
PER_LANGUAGE = 150
WORDS_OF_A_DOCUMENT = 400
WORDS_OF_THE_SAMPLE = 250_000
#: Labels beyond which weights are kept in single precision, and numbers of an array that fitting makes at a time.
DOUBLE, CELLS = 32, 4 << 20
#: Words of a text from which its chain is worked through in segments side by side, up to so many labels.
LONG, SEGMENTED = 2048, 32
BUCKETS = 1 << 16
ROUNDS = 30
RATE = 0.5
PENALTY = 1e-5
#: Words of one piece in a code-switched training sequence.
SWITCH = 12
UND = "und"
REMEMBERED = 120_000
#: Words whose features are made at a time.
NEW_WORDS = 1 << 14
CHUNK = 1 << 20


def numerals() -> str:
    """The ranges of characters that regular expressions take for word characters, but are neither letters nor decimal digits."""
    codes = [c for c in range(sys.maxunicode + 1) if (x := chr(c)).isalnum() and not x.isalpha() and not x.isdecimal()]
    cuts = [0, *(i for i in range(1, len(codes)) if codes[i] != codes[i - 1] + 1), len(codes)]
    return "".join(f"{chr(codes[a])}-{chr(codes[b - 1])}" for a, b in zip(cuts, cuts[1:], strict=False))


#: A word is a run of letters.
WORD = re.compile(rf"[^\W\d_{numerals()}]+")
#: Texts without a numeral that is beyond the decimal digits, as most are, and their words by a shorter pattern.
LATIN, PLAIN = re.compile(r"[\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u02af]*"), re.compile(r"[^\W\d_]+")


def words_in(text: str) -> list[str]:
    return (PLAIN if LATIN.fullmatch(text) else WORD).findall(text)


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all words, first of each): hashed n-grams of 1 to 3, edges of 4, then the lexicon's number."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.flatnonzero(codes == 2)
    size = np.diff(np.concatenate([first, [len(codes)]]))
    owner = np.repeat(np.arange(len(words)), size)
    out, of = [], []
    spans = H.Spans(codes)
    for n in (1, 2, 3, 4):
        grams = spans.every(n)
        m = len(grams)
        inside = owner[:m] == owner[n - 1 :]
        if n == 4:  # affixes only
            inside &= (codes[:m] == 2) | (codes[n - 1 :] == 3)
        at = np.flatnonzero(inside)
        out.append((H.mix(grams[at] + H.U(n)) % H.U(BUCKETS)).astype(np.int64))
        of.append(owner[at])
    if len(lexicon):
        whole = spans.of(first, first + size)
        at = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[at] == whole)
        out.append(BUCKETS + at[known])
        of.append(known)
    out, of = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return out[order], np.searchsorted(of[order], np.arange(len(words)))


def word_hashes(words: list[str]) -> np.ndarray:
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.flatnonzero(codes == 2)
    return H.Spans(codes).of(first, np.concatenate([first[1:], [len(codes)]])) if len(words) else np.zeros(0, H.U)


def emissions(flat: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of scores per word: the sum of its features' weights, by the root of their number."""
    counts = np.diff(np.concatenate([first, [len(flat)]]))
    return np.add.reduceat(weights[flat], first, axis=0) / np.sqrt(counts)[:, None]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, initial: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(marginals, log partition, expected transitions) of sequences laid one after another; none is empty."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    top = scores.max(1)
    emit = np.exp(scores - top[:, None])
    step = np.exp(transitions)
    alpha, beta, norm = np.empty_like(emit), np.ones_like(emit), np.empty(len(emit))
    live = np.searchsorted(-size, -np.arange(size[0]), "left") if len(size) else np.zeros(0, np.int64)
    now = emit[begin] * np.exp(initial)
    for t in range(len(live)):
        k = live[t]
        at = begin[:k] + t
        if t:
            now = (now[:k] @ step) * emit[at]
        total = now.sum(1)
        now /= total[:, None]
        alpha[at], norm[at] = now, total
    for t in range(len(live) - 2, -1, -1):
        k = live[t + 1]
        at = begin[:k] + t
        after = at + 1
        beta[at] = ((beta[after] * emit[after]) @ step.T) / norm[after][:, None]
    marginals = alpha * beta
    inner = np.ones(len(emit), bool)
    inner[starts + lengths - 1] = False
    at = np.flatnonzero(inner)
    right = beta[at + 1] * emit[at + 1] / norm[at + 1][:, None]
    expected = step * (alpha[at].T @ right)
    return marginals, float(np.log(norm).sum() + top.sum()), expected


def long_marginals(scores: np.ndarray, transitions: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """The marginals of one long sequence: segments of equal length side by side, after a rest that goes before them."""
    n, k = scores.shape
    size = math.isqrt(n)
    count = n // size
    rest = n - count * size
    step = np.exp(transitions)
    emit = np.exp(scores - scores.max(1)[:, None])
    scaled = lambda x: x / x.sum(-1, keepdims=True)
    alpha, beta = np.empty_like(emit), np.empty_like(emit)
    # the segments' words by place: (place, segment, label)
    inside = np.ascontiguousarray(emit[rest:].reshape(count, size, k).transpose(1, 0, 2))
    through = np.broadcast_to(np.eye(k), (count, k, k)).copy()
    for t in range(size):
        through = (through @ step) * inside[t][:, None, :]
        through /= through.max((1, 2), keepdims=True)
    now = None
    for t in range(rest):
        now = alpha[t] = scaled((np.exp(initial) if now is None else now @ step) * emit[t])
    enter = np.empty((count, k))
    first = alpha[rest:].reshape(count, size, k)
    for s in range(count):  # what comes into a segment; the first one of all begins with the initial weights
        enter[s] = 0 if now is None else now
        if now is None:
            now = np.exp(initial - initial.max()) * inside[0, 0]
            for t in range(1, size):
                now = scaled((now @ step) * inside[t, 0])
        else:
            now = scaled(now @ through[s])
    before = enter
    for t in range(size):
        after = before @ step
        if t == 0 and not rest:
            after[0] = np.exp(initial - initial.max())
        before = scaled(after * inside[t])
        first[:, t] = before
    leave = np.empty((count, k))
    back = np.ones(k)
    for s in range(count - 1, -1, -1):
        leave[s] = back
        back = scaled(through[s] @ back)
    last = beta[rest:].reshape(count, size, k)
    for t in range(size - 1, -1, -1):
        last[:, t] = leave
        leave = scaled((leave * inside[t]) @ step.T)
    for t in range(rest - 1, -1, -1):
        beta[t] = back
        back = scaled((back * emit[t]) @ step.T)
    return scaled(alpha * beta)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    transitions: np.ndarray
    initial: np.ndarray


def switched(sequences: list[tuple[list[str], int]], rng: np.random.Generator) -> tuple[list[list[str]], list[np.ndarray]]:
    """The sequences, and as many that change language every SWITCH words or so."""
    words = [s for s, _ in sequences]
    labels = [np.full(len(s), y) for s, y in sequences]
    for _ in range(len(sequences)):
        ws, ys = [], []
        for i in rng.integers(0, len(sequences), 4):
            s, y = sequences[i]
            n = int(rng.integers(3, 2 * SWITCH))
            at = int(rng.integers(0, max(1, len(s) - n)))
            ws += s[at : at + n]
            ys += [y] * len(s[at : at + n])
        if ws:
            words.append(ws)
            labels.append(np.array(ys))
    return words, labels


def pieces(sizes: np.ndarray, most: int = 0) -> list[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to `most` at most (CELLS if none is given), or of one."""
    total, out, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (most or CELLS), "right")))
        out.append((at, end))
        at = end
    return out


def fit(texts: list[str], langs: list[str], rounds: int = ROUNDS, seed: int = 0) -> Model:
    """Maximum likelihood by adaptive gradient steps over the whole sample."""
    languages = sorted(set(langs))
    number = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    sequences = []
    for text, lang in zip(texts, langs, strict=True):
        words = [w.lower() for w in words_in(text)]
        at = int(rng.integers(0, max(1, len(words) - WORDS_OF_A_DOCUMENT)))
        if words:
            sequences.append((words[at : at + WORDS_OF_A_DOCUMENT], number[lang]))
    k = len(languages)
    if not sequences:
        return Model([], np.zeros((BUCKETS, 1)), np.zeros(0, np.uint64), np.zeros((1, 1)), np.zeros(1))
    counts = Counter(w for s, _ in sequences for w in s)
    lexicon = np.unique(word_hashes([w for w, n in counts.items() if n >= 3]))
    words, labels = switched(sequences, rng)
    lengths = np.array([len(s) for s in words], np.int64)
    gold = np.concatenate(labels)
    unique = {w: i for i, w in enumerate(counts)}
    of = np.array([unique[w] for s in words for w in s], np.int64)
    flat, first = features(list(unique), lexicon)
    sizes = np.diff(np.concatenate([first, [len(flat)]]))
    owner = np.repeat(np.arange(len(unique)), sizes)
    scale = 1 / np.sqrt(sizes)
    n = BUCKETS + len(lexicon)
    kind = np.float64 if k <= DOUBLE else np.float32
    weights, transitions, initial = np.zeros((n, k), kind), np.zeros((k, k)), np.zeros(k)
    sums = [np.full_like(x, 1e-8) for x in (weights, transitions, initial)]
    ends = np.cumsum(lengths)
    inner = np.ones(len(of), bool)
    inner[ends - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[at], gold[at + 1]), 1)
    starts = ends - lengths
    batches, by_size = pieces(lengths * k), pieces(sizes * k)
    for _ in range(rounds):
        scores = np.empty((len(unique), k), kind)
        for a, b in by_size:
            scores[a:b] = emissions(flat[first[a] : first[a] + sizes[a:b].sum()], first[a:b] - first[a], weights)
        by_word, expected, begun = np.zeros((len(unique), k), kind), np.zeros((k, k)), np.zeros(k)
        for a, b in batches:
            lo, hi = starts[a], ends[b - 1]
            marginals, _, some = forward_backward(scores[of[lo:hi]].astype(np.float64, copy=False), lengths[a:b], transitions, initial)
            error = np.eye(k)[gold[lo:hi]] - marginals
            for j in range(k):
                by_word[:, j] += np.bincount(of[lo:hi], error[:, j], len(unique))
            expected += some
            begun += error[starts[a:b] - lo].sum(0)
        by_word *= scale[:, None].astype(kind)
        for j in range(k):
            g = np.bincount(flat, by_word[owner, j], n) / len(of) - PENALTY * weights[:, j]
            sums[0][:, j] += g * g
            weights[:, j] += RATE * g / np.sqrt(sums[0][:, j])
        steps = [(seen - expected) / len(of) - PENALTY * transitions, begun / len(of) - PENALTY * initial]
        for x, s, g in zip((transitions, initial), sums[1:], steps, strict=True):
            s += g * g
            x += RATE * g / np.sqrt(s)
    return Model(languages, weights.astype(np.float32), lexicon, transitions, initial)


def sample(df: DataFrame, text: str, lang: str, per_language: int) -> tuple[list[str], list[str]]:
    """About per_language labelled texts of each language, by a hash of the text, as their words; the counts cover all rows."""
    body = F.col(text).cast("string")
    labelled = df.filter(F.col(lang).isNotNull() & body.isNotNull()).select(body.alias("t"), F.col(lang).cast("string").alias("l"))
    by_label = labelled.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("t")).alias("n"))
    counts = {r["l"]: r["n"] for r in by_label.orderBy(F.desc("n"), "l").limit(LANGUAGES).collect()}
    if not counts:
        return [], []
    per_language = max(1, min(per_language, WORDS_OF_THE_SAMPLE // (WORDS_OF_A_DOCUMENT * len(counts))))
    share = F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, per_language / max(1, n))))])
    place = F.pmod(F.xxhash64("t", F.lit(7)), F.lit(1 << 30)) / F.lit(1 << 30)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = []
            for t in batch.column(0).to_pylist():
                words = words_in(t.lower())
                at = zlib.crc32(t.encode()) % max(1, len(words) - WORDS_OF_A_DOCUMENT)
                cut.append(" ".join(words[at : at + WORDS_OF_A_DOCUMENT]))
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()), batch.column(1)], names=["t", "l"])

    rows = labelled.filter(place < share[F.col("l")]).mapInArrow(apply, "t string, l string").distinct().collect()
    rows.sort(key=lambda r: (r["t"], r["l"]))
    return [r["t"] for r in rows], [r["l"] for r in rows]


def train(df: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    small_batches(df.sparkSession)
    return fit(*sample(df, text, lang, per_language))


class Labeller:
    """Marginals of words for many texts, remembering the scores of words."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, max(1, len(self.model.languages))))

    def score(self, words: list[list[str]]) -> np.ndarray:
        if len(self.number) > REMEMBERED:
            self.forget()
        had = len(self.number)
        number = self.number
        flat = [number.setdefault(w, len(number)) for ws in words for w in ws]
        if len(number) > had:
            new = list(number)[had:] if had == 0 else [w for w, _ in zip(reversed(number), range(len(number) - had), strict=False)][::-1]
            while len(self.scores) < len(number):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            for at in range(0, len(new), NEW_WORDS):
                part = new[at : at + NEW_WORDS]
                self.scores[had + at : had + at + len(part)] = emissions(*features(part, self.model.lexicon), self.model.weights)
        return self.scores[np.array(flat, np.int64)]

    def label(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[list[str]]]:
        """(marginals of the words of each text, its words)."""
        words = [words_in(t.lower()) if t else [] for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        if not lengths.sum() or not self.model.languages:
            return [np.zeros((0, 1))] * len(texts), words
        scores = self.score(words)
        far = (lengths >= LONG) & (len(self.model.languages) <= SEGMENTED)
        ends = np.cumsum(lengths)
        short = np.repeat(~far, lengths)
        marginals = np.empty_like(scores)
        if short.any():
            marginals[short] = forward_backward(scores[short], lengths[~far & (lengths > 0)], self.model.transitions, self.model.initial)[0]
        for i in np.flatnonzero(far):
            marginals[ends[i] - lengths[i] : ends[i]] = long_marginals(scores[ends[i] - lengths[i] : ends[i]], self.model.transitions, self.model.initial)
        return np.split(marginals, ends[:-1]), words

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        languages, scores = [], []
        for m in self.label(texts)[0]:
            if len(m):
                share = m.sum(0) / m.sum()
                best = int(share.argmax())
                languages.append(self.model.languages[best])
                scores.append(float(min(1.0, share[best])))
            else:
                languages.append(UND)
                scores.append(0.0)
        return languages, scores


def predict(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """keep, lang_pred and score for every row, from its text alone."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select(*keep).schema.add("lang_pred", "string", False).add("score", "double", False)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        rows = (pa.RecordBatch.from_arrays([*b.columns, b.column(b.num_columns - 1).fill_null("")], names=[*b.schema.names, "__filled"]) for b in batches)
        for chunk in chunked(rows, "__filled", CHUNK):
            languages, scores = labeller.predict(chunk.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(chunk.column(i) for i in range(len(keep))), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(apply, schema)


def held_out(key: str = "doc_id"):
    """Whether a document takes no part in training."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score: learned from the documents that are not held out."""
    model = train(df.filter(~held_out(key)), text, lang)
    return predict(df, model, [key], text).select(key, held_out(key).alias("held_out"), "lang_pred", "score")

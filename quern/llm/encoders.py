"""Token ids of whole texts with a public tokenizer file, by the tokenizers library.

Each word-like piece of a text is encoded on its own by these byte-pair models, so a worker encodes a piece once, by the
library, and looks it up after that. Only texts of characters on which every regular-expression engine agrees are split
here (ASCII, and the letters from U+00C0 to U+00FF); any other text goes to the library whole, and so does one that holds
the string of an added token, which by the library's defaults becomes that token's id. The ids are the same.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np

from quern.llm.common import KEPT
from quern.llm.hashing import ranges

SAFE = re.compile(r"[\x20-\x7e\t\n\rÀ-ÿ]*")
LETTER = r"A-Za-zÀ-ÖØ-öø-ÿ"
SUFFIX = r"'s|'t|'re|'ve|'m|'ll|'d"
#: The files' own splitting patterns, over the characters of SAFE; letters stand first, as no suffix begins with one.
BYTE_LEVEL = re.compile(rf" ?[{LETTER}]+|{SUFFIX}| ?[0-9]+| ?[^ \t\n\r0-9{LETTER}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
WORD_LEVEL = re.compile(rf"[{LETTER}]+|{SUFFIX}|[0-9]|[^ \t\n\r0-9{LETTER}]+")
#: Pieces that a worker remembers; beyond that it forgets those met once, and the rarer half of the others.
REMEMBERED = 300_000
#: Bytes of text encoded at a time.
CHUNK = 1 << 20


class Pieces(dict):
    """Numbers pieces in order of first sight."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


@functools.cache
def worker_encoder(path: str, end: int) -> Encoder:
    """The encoder of this Python worker, which its tasks share until another operator's task runs there."""
    return Encoder(path, end)


KEPT.append(lambda: worker_encoder.cache_clear())


class Encoder:
    """ids(texts) for one tokenizer file; `lower` for a file that lower-cases and drops white space."""

    def __init__(self, path: str, end: int, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lower = self.tokenizer.normalizer is not None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: A text is split here only if none of these stands in it, in any case for a file that lower-cases.
        self.added = [t.lower() if self.lower else t for t in added]
        self.pattern = WORD_LEVEL if self.lower else BYTE_LEVEL
        self.end, self.remembered = end, remembered
        tokens = sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.edge = np.zeros(tokens[-1][1] + 1, bool)
        self.edge[[i for t, i in tokens if (t.endswith("</w>") if self.lower else t.startswith("Ġ"))]] = True
        self.forget()

    def forget(self) -> None:
        self.pieces, self.flat, self.starts = Pieces(), np.zeros(1 << 16, np.uint32), np.zeros((1 << 14) + 1, np.int64)
        self.met = np.zeros(0, np.int64)

    def forget_rare(self) -> None:
        """Keeps the pieces met most often, under new numbers."""
        most = self.remembered // 2
        often = np.flatnonzero(self.met > 1)
        if len(often) > most:
            often = np.sort(often[np.argpartition(-self.met[often], most)[:most]])
        names, lengths = list(self.pieces), self.starts[often + 1] - self.starts[often]
        flat, met = self.flat[ranges(self.starts[often], lengths)], self.met[often] // 2
        self.forget()
        for i in often.tolist():
            self.pieces[names[i]]
        self.pieces.new = []
        self.hold(0, flat, lengths)
        self.met = met

    def hold(self, had: int, ids: np.ndarray, counts: np.ndarray) -> None:
        """The ids of the pieces from number `had` on."""
        used, n = int(self.starts[had]), len(ids)
        while len(self.flat) < used + n:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) < had + len(counts) + 1:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[used : used + n] = ids
        self.starts[had + 1 : had + len(counts) + 1] = used + np.cumsum(counts)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counted(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids in each). Pieces of letters are encoded many at a time; a token shows where a piece begins or ends."""
        plain = [i for i, p in enumerate(new) if (p.isalpha() if self.lower else p[0] == " " and p[1:].isalpha())]
        others = sorted(set(range(len(new))).difference(plain))
        counts = np.zeros(len(new), np.int64)
        joint = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        ids = [np.array(x, np.uint32) for x in self.whole([(" " if self.lower else "").join(new[i] for i in x) for x in joint])]
        for x, got in zip(joint, ids, strict=True):
            edges = np.flatnonzero(self.edge[got])
            if len(edges) != len(x):
                raise ValueError("the tokenizer does not mark its pieces")
            counts[x] = np.diff(edges, prepend=-1) if self.lower else np.diff(edges, append=len(got))
        alone = self.whole([new[i] for i in others])
        counts[others] = [len(x) for x in alone]
        flat = np.concatenate([*ids, np.fromiter(itertools.chain.from_iterable(alone), np.uint32)])
        order = np.concatenate([plain, others]).astype(np.int64)
        starts = np.empty(len(new), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return flat[ranges(starts, counts)], counts

    def learn(self) -> None:
        """Encodes the pieces seen for the first time."""
        new, self.pieces.new = self.pieces.new, []
        if not new:
            return
        self.hold(len(self.pieces) - len(new), *self.counted(new))

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text); each text ends with the end id; null is the empty text."""
        if len(self.pieces) > self.remembered:
            self.forget_rare()
        numbers: list[list[int]] = []
        others: dict[int, list[int]] = {}
        look = self.pieces.__getitem__
        for i, text in enumerate(texts):
            text = text or ""
            plain = text.lower() if self.lower else text
            if SAFE.fullmatch(text) and not any(t in plain for t in self.added):
                numbers.append(list(map(look, self.pattern.findall(plain))))
            else:
                others[i] = self.whole([text])[0]
                numbers.append([])
        self.learn()
        counts = np.fromiter(map(len, numbers), np.int64, len(numbers))
        of = np.fromiter(itertools.chain.from_iterable(numbers), np.int64, int(counts.sum()))
        met = np.bincount(of, minlength=len(self.pieces))
        met[: len(self.met)] += self.met
        self.met = met
        lengths = self.starts[of + 1] - self.starts[of]
        flat = self.flat[ranges(self.starts[of], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        out, offsets = [], [0]
        for i in range(len(texts)):
            own = np.array(others[i], np.uint32) if i in others else flat[ends[i] : ends[i + 1]]
            out += [own, np.array([self.end], np.uint32)]
            offsets.append(offsets[-1] + len(own) + 1)
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.array(offsets, np.int64)

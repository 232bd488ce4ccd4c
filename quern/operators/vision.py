"""A vision transformer's forward pass in NumPy, run over image columns in Arrow batches.

Weights are a dict of arrays, seeded or loaded; there are none in the repository. Names follow this module. Computation is in
the weights' precision; embed() takes single precision.

Attention never holds a score for every pair of tokens: blocks of queries meet blocks of keys one after the other, and a
running maximum and sum of each query's weights rescale what has been added up. The perceptron takes TOKENS tokens at a time.
embed() takes as many images at a time as their activations fit ACTIVATION_BYTES, which follows from the model's shape.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

EPS = 1e-6
#: Queries and keys that meet at a time, and tokens of the perceptron.
QUERIES, KEYS, TOKENS = 256, 256, 1024
#: Bytes of activations that the images of one forward pass may take, and of weights that may be broadcast.
ACTIVATION_BYTES, MODEL_BYTES = 160 << 20, 2 << 30
#: Width, depth and heads of the model sizes.
SIZES = {"vit_tiny": (192, 12, 3), "vit_small": (384, 12, 6), "vit_base": (768, 12, 12), "vit_large": (1024, 24, 16)}


def erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, good to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + EPS) * scale + shift


def drop_path(x: np.ndarray, rate: float, rng: np.random.Generator | None = None) -> np.ndarray:
    """Drops whole rows in training, when a generator is given, and scales the others up; identity otherwise."""
    if rng is None or rate == 0:
        return x
    kept = (rng.random(len(x)) >= rate).reshape(-1, *[1] * (x.ndim - 1))
    return x * kept / (1 - rate)


@dataclass(frozen=True)
class Shape:
    dim: int
    depth: int
    heads: int
    patch: int
    side: int
    channels: int = 3
    mlp: float = 4.0
    #: What attention scores are multiplied by; the inverse root of a head's width if none is given.
    scale: float | None = None

    @classmethod
    def named(cls, name: str, patch: int = 16, side: int = 224) -> Shape:
        if name not in SIZES:
            raise ValueError(f"unknown model {name!r}")
        return cls(*SIZES[name], patch, side)

    @property
    def tokens(self) -> int:
        return (self.side // self.patch) ** 2 + 1

    def images_at_a_time(self, itemsize: int = 4) -> int:
        """How many images' activations fit: tokens, their queries, keys and values and copies of them, scores, pixels."""
        scores = 4 * self.heads * min(QUERIES, self.tokens) * min(KEYS, self.tokens)
        one = itemsize * (14 * self.tokens * self.dim + scores + 3 * self.channels * self.side**2)
        return max(1, ACTIVATION_BYTES // one)


def truncated_normal(rng: np.random.Generator, size: tuple[int, ...], std: float, low: float = -2.0, high: float = 2.0) -> np.ndarray:
    """Normal draws given that they lie in [low, high]: those outside are drawn again."""
    out = rng.normal(0, std, size)
    while (outside := (out < low) | (out > high)).any():
        out[outside] = rng.normal(0, std, int(outside.sum()))
    return out


def seeded_weights(shape: Shape, seed: int = 31, std: float = 0.02) -> dict[str, np.ndarray]:
    """Truncated normal weights, zero biases."""
    rng = np.random.default_rng(seed)
    draw = lambda *size: truncated_normal(rng, size, std)
    d, hidden = shape.dim, int(shape.dim * shape.mlp)
    w = {"patch.w": draw(shape.patch * shape.patch * shape.channels, d), "patch.b": np.zeros(d), "cls": draw(d), "pos": draw(shape.tokens, d), "norm.scale": np.ones(d), "norm.shift": np.zeros(d)}
    for i in range(shape.depth):
        w |= {
            f"{i}.n1.scale": np.ones(d), f"{i}.n1.shift": np.zeros(d), f"{i}.n2.scale": np.ones(d), f"{i}.n2.shift": np.zeros(d),
            f"{i}.qkv.w": draw(d, 3 * d), f"{i}.qkv.b": np.zeros(3 * d), f"{i}.proj.w": draw(d, d), f"{i}.proj.b": np.zeros(d),
            f"{i}.fc1.w": draw(d, hidden), f"{i}.fc1.b": np.zeros(hidden), f"{i}.fc2.w": draw(hidden, d), f"{i}.fc2.b": np.zeros(d),
        }
    return w


#: Added to the number of positions when the scale of their interpolation is taken.
GUARD = 0.1


def resize_grid(grid: np.ndarray, rows: int, cols: int, guard: float = 0.0) -> np.ndarray:
    """Bicubic interpolation of a (h, w, d) grid to (rows, cols, d)."""
    return np.einsum("rh,hwd,cw->rcd", cubic_matrix(grid.shape[0], rows, guard=guard), grid, cubic_matrix(grid.shape[1], cols, guard=guard))


def cubic_matrix(n: int, m: int, a: float = -0.75, antialias: bool = False, guard: float = 0.0) -> np.ndarray:
    """(m, n) weights of bicubic resampling with pixel centres at halves; under `antialias` the kernel widens when shrinking.

    `guard` is added to m where the step from one centre to the next is taken.
    """
    scale = n / (m + guard)
    stretch = max(scale, 1.0) if antialias else 1.0
    centre = (np.arange(m) + 0.5) * scale - 0.5
    reach = int(math.ceil(2 * stretch))
    at = np.floor(centre)[:, None] + np.arange(-reach + 1, reach + 1)
    x = np.abs(at - centre[:, None]) / stretch
    k = np.where(x <= 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, ((a * x - 5 * a) * x + 8 * a) * x - 4 * a, 0.0))
    out = np.zeros((m, n))
    if antialias:
        k = np.where((at >= 0) & (at < n), k, 0)
        k /= k.sum(1, keepdims=True)
    np.add.at(out, (np.repeat(np.arange(m), k.shape[1]), np.clip(at, 0, n - 1).astype(int).ravel()), k.ravel())
    return out


def attended(q: np.ndarray, k: np.ndarray, v: np.ndarray) -> np.ndarray:
    """softmax(q k) v for scaled queries, a block of keys at a time: sums so far are rescaled when a larger score comes."""
    top = np.full((*q.shape[:-1], 1), -np.inf, q.dtype)
    total, out = np.zeros_like(top), np.zeros_like(q)
    for at in range(0, k.shape[2], KEYS):
        weights = q @ k[:, :, at : at + KEYS].swapaxes(-1, -2)
        new = np.maximum(top, weights.max(-1, keepdims=True))
        np.exp(np.subtract(weights, new, out=weights), out=weights)
        shrink = np.exp(top - new)
        total = total * shrink + weights.sum(-1, keepdims=True)
        out = out * shrink + weights @ v[:, :, at : at + KEYS]
        top = new
    return out / total


class Transformer:
    def __init__(self, shape: Shape, weights: dict[str, np.ndarray]):
        self.shape, self.w = shape, weights

    def patches(self, images: np.ndarray) -> np.ndarray:
        """(n, channels, h, w) to (n, patches, dim)."""
        n, c, h, w = images.shape
        p = self.shape.patch
        cut = images[:, :, : h // p * p, : w // p * p].reshape(n, c, h // p, p, w // p, p).transpose(0, 2, 4, 1, 3, 5)
        return cut.reshape(n, (h // p) * (w // p), c * p * p) @ self.w["patch.w"] + self.w["patch.b"]

    def positions(self, rows: int, cols: int) -> np.ndarray:
        """Position embeddings for a grid; the trained ones as they are where the grid is theirs."""
        side = self.shape.side // self.shape.patch
        if (rows, cols) == (side, side):
            return self.w["pos"]
        grid = self.w["pos"][1:].reshape(side, side, -1)
        return np.concatenate([self.w["pos"][:1], resize_grid(grid, rows, cols, GUARD).reshape(rows * cols, -1)]).astype(self.w["pos"].dtype)

    def prepare(self, images: np.ndarray) -> np.ndarray:
        x = self.patches(images)
        first = np.broadcast_to(self.w["cls"], (len(x), 1, self.shape.dim))
        p = self.shape.patch
        return np.concatenate([first, x], 1) + self.positions(images.shape[2] // p, images.shape[3] // p)

    def parts(self, x: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Block i's scaled queries, keys and values, (image, head, token, width) each."""
        n, t, d = x.shape
        h = self.shape.heads
        q, k, v = (x @ self.w[f"{i}.qkv.w"] + self.w[f"{i}.qkv.b"]).reshape(n, t, 3, h, d // h).transpose(2, 0, 3, 1, 4)
        return q * ((d // h) ** -0.5 if self.shape.scale is None else self.shape.scale), k, v

    def attention(self, x: np.ndarray, i: int) -> np.ndarray:
        """Block i's attention of all tokens to all, a block of queries at a time."""
        q, k, v = self.parts(x, i)
        out = np.empty(x.shape, x.dtype)
        for at in range(0, x.shape[1], QUERIES):
            some = attended(q[:, :, at : at + QUERIES], k, v)
            out[:, at : at + QUERIES] = some.transpose(0, 2, 1, 3).reshape(len(x), -1, x.shape[2])
        return out @ self.w[f"{i}.proj.w"] + self.w[f"{i}.proj.b"]

    def perceptron(self, x: np.ndarray, i: int) -> np.ndarray:
        flat = x.reshape(-1, x.shape[-1])
        out = np.empty_like(flat)
        for at in range(0, len(flat), TOKENS):
            out[at : at + TOKENS] = gelu(flat[at : at + TOKENS] @ self.w[f"{i}.fc1.w"] + self.w[f"{i}.fc1.b"]) @ self.w[f"{i}.fc2.w"] + self.w[f"{i}.fc2.b"]
        return out.reshape(x.shape)

    def block(self, x: np.ndarray, i: int) -> np.ndarray:
        """Tokens after block i."""
        x = x + self.attention(layer_norm(x, self.w[f"{i}.n1.scale"], self.w[f"{i}.n1.shift"]), i)
        return x + self.perceptron(layer_norm(x, self.w[f"{i}.n2.scale"], self.w[f"{i}.n2.shift"]), i)

    def norm(self, x: np.ndarray) -> np.ndarray:
        return layer_norm(x, self.w["norm.scale"], self.w["norm.shift"])

    def layers(self, images: np.ndarray, n: int = 1) -> list[np.ndarray]:
        """The normed tokens after each of the last n blocks."""
        x, out = self.prepare(images), []
        for i in range(self.shape.depth):
            x = self.block(x, i)
            if i >= self.shape.depth - n:
                out.append(self.norm(x))
        return out

    def features(self, images: np.ndarray) -> np.ndarray:
        """The class token of every image."""
        return self.layers(images)[0][:, 0]

    def last_attention(self, images: np.ndarray) -> np.ndarray:
        """The last block's weights of every token for every other, which is what is asked for: heads x tokens x tokens an image."""
        x = self.prepare(images)
        last = self.shape.depth - 1
        for i in range(last):
            x = self.block(x, i)
        q, k, _ = self.parts(layer_norm(x, self.w[f"{last}.n1.scale"], self.w[f"{last}.n1.shift"]), last)
        out = np.empty((*q.shape[:3], q.shape[2]), x.dtype)
        for at in range(0, q.shape[2], QUERIES):
            out[:, :, at : at + QUERIES] = softmax(q[:, :, at : at + QUERIES] @ k.swapaxes(-1, -2))
        return out

    def cast(self, kind: type = np.float32) -> Transformer:
        """The model with weights of this precision."""
        return Transformer(self.shape, {n: np.asarray(w, kind) for n, w in self.w.items()})

    def crops(self, images: list[np.ndarray], head: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """Features of crops of several sizes: each run of equal widths is one forward pass; a head sees all of them at once."""
        out, at = [], 0
        for i in range(1, len(images) + 1):
            if i == len(images) or images[i].shape[-1] != images[at].shape[-1]:
                out.append(self.features(np.concatenate(images[at:i])))
                at = i
        features = np.concatenate(out)
        return head(features) if head else features


@dataclass(frozen=True)
class BatchNorm:
    """Batch normalization as it is in use: by the running mean and variance."""

    mean: np.ndarray
    variance: np.ndarray
    scale: np.ndarray
    shift: np.ndarray
    eps: float = 1e-5

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / np.sqrt(self.variance + self.eps) * self.scale + self.shift


def projection_head(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], last: np.ndarray, norms: list[BatchNorm] | None = None) -> np.ndarray:
    """A multi-layer perceptron, unit vectors, and a linear layer whose rows are unit vectors; `norms` stand before the activations."""
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1:
            x = gelu(norms[i](x) if norms else x)
    x = x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    return x @ (last / np.linalg.norm(last, axis=-1, keepdims=True)).T


class Flat:
    """A column of flat (channel, row, column) arrays as images of the model's side."""

    def __init__(self, column: str, shape: Shape):
        self.columns, self.size = (column,), (-1, shape.channels, shape.side, shape.side)

    def __call__(self, rows: pa.RecordBatch) -> np.ndarray:
        return np.asarray(rows.column(0).flatten(), np.float32).reshape(self.size)


def shared(spark: SparkSession, model: Transformer) -> Broadcast:
    """The model in single precision, once for all embed() calls that take it; a model beyond MODEL_BYTES is an error."""
    small = model.cast()
    if (size := sum(w.nbytes for w in small.w.values())) > MODEL_BYTES:
        raise ValueError(f"a model of {size} bytes is not broadcast; the most is {MODEL_BYTES}")
    return spark.sparkContext.broadcast(small)


def embed(
    images: DataFrame, keep: list[str], pixels: str | Callable[[pa.RecordBatch], np.ndarray], model: Transformer | Broadcast, batch: int | None = None, errors: bool = False, counter: Accumulator | None = None
) -> DataFrame:
    """keep and `embedding` of every image.

    pixels is a column of flat (channel, row, column) arrays of the model's side, or a callable with `columns` that turns a
    batch of these columns into images, so that decoded tiles are transformed where they are embedded. Under `errors`, an image
    that fails alone has a null embedding and its message in `error`. `counter` counts the images that the model has seen.
    """
    net = model if isinstance(model, Broadcast) else shared(images.sparkSession, model)
    shape = net.value.shape
    prepare = Flat(pixels, shape) if isinstance(pixels, str) else pixels
    most = batch or shape.images_at_a_time()
    schema = images.select(*keep).schema.add("embedding", ArrayType(FloatType()))
    if errors:
        schema = schema.add("error", "string")

    def embedded(rows: pa.RecordBatch) -> pa.Array:
        x = prepare(rows)
        if counter is not None:
            counter.add(len(x))
        y = net.value.features(x.astype(np.float32, copy=False))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))

    def one_by_one(rows: pa.RecordBatch) -> Iterator[tuple[pa.Array, str | None]]:
        for i in range(rows.num_rows):
            try:
                yield embedded(rows.slice(i, 1)), None
            except Exception as error:  # noqa: BLE001 the image's failure is its row's result
                yield pa.nulls(1, pa.list_(pa.float32())), f"{type(error).__name__}: {error}"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, most):
                part = rows.slice(at, most)
                own, inputs = part.columns[: len(keep)], part.select(list(range(len(keep), part.num_columns)))
                inputs = inputs.rename_columns(list(prepare.columns))
                try:
                    yield pa.RecordBatch.from_arrays([*own, embedded(inputs), *([pa.nulls(part.num_rows, pa.string())] if errors else [])], names=schema.names)
                except Exception:
                    if not errors:
                        raise
                    for i, (vector, error) in enumerate(one_by_one(inputs)):
                        yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in own), vector, pa.array([error], pa.string())], names=schema.names)

    inputs = [F.col(c).alias(f"__in{i}") for i, c in enumerate(prepare.columns)]
    if isinstance(pixels, str):
        inputs = [F.col(pixels).cast("array<float>").alias("__in0")]
    return images.select(*keep, *inputs).mapInArrow(apply, schema)

"""Weight files and training tables for the nearest-neighbour step, checked when they are read."""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.vision import Shape, Transformer, seeded_weights
from quern.sources import tensors

#: What wrappers put before or into tensor names.
WRAPPERS = ("module.", "backbone.")
#: A published model's names of tensors and layers, and those of Transformer.
NAMES = {"cls_token": "cls", "pos_embed": "pos", "norm": "norm", "norm1": "n1", "norm2": "n2", "attn.qkv": "qkv", "attn.proj": "proj", "mlp.fc1": "fc1", "mlp.fc2": "fc2"}


def short_name(name: str) -> str:
    for wrapper in WRAPPERS:
        name = name.replace(wrapper, "")
    return name


def read_weights(path: str, key: str | None = None) -> dict[str, np.ndarray]:
    """Arrays by name, without wrappers' prefixes, of a tensor archive or an .npz file.

    `key` picks the part of that name, if there is one: names under key/ in an .npz file. A missing file is an error: there is
    no fallback to other or random weights.
    """
    if tensors.is_archive(path):
        tree = tensors.read_archive(path)
        tree = tree[key] if key in tree else tree
        return {short_name(n): x for n, x in tree.items() if isinstance(x, np.ndarray)}
    with np.load(path) as file:
        nested = [n for n in file.files if key and n.startswith(f"{key}/")]
        return {short_name(n.removeprefix(f"{key}/") if nested else n): file[n] for n in nested or file.files}


def own_names(weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A vision transformer's tensors under the names and in the layout of Transformer; any others as they are."""
    out = {}
    for name, x in weights.items():
        parts = name.split(".")
        if name in ("cls_token", "pos_embed"):
            out[NAMES[name]] = x.reshape(-1) if name == "cls_token" else x.reshape(x.shape[-2:])
        elif name.startswith("patch_embed.proj."):
            out["patch.w" if parts[-1] == "weight" else "patch.b"] = x.reshape(len(x), -1).T if parts[-1] == "weight" else x
        elif parts[0] in ("blocks", "norm") and ".".join(parts[2:-1] or parts[:1]) in NAMES:
            layer, prefix = NAMES[".".join(parts[2:-1] or parts[:1])], f"{parts[1]}." if parts[0] == "blocks" else ""
            if "norm" in name:
                out[f"{prefix}{layer}.{'scale' if parts[-1] == 'weight' else 'shift'}"] = x
            else:
                out[f"{prefix}{layer}.{parts[-1][0]}"] = x.T if parts[-1] == "weight" else x
        else:
            out[name] = x
    return out


def compare(weights: dict[str, np.ndarray], shape: Shape) -> tuple[list[str], list[str]]:
    """(missing, unexpected) names for a model of this shape; a wrong size counts as missing."""
    wanted = {n: w.shape for n, w in seeded_weights(shape).items()}
    missing = [n for n, size in wanted.items() if n not in weights or weights[n].shape != size]
    return missing, [n for n in weights if n not in wanted]


def load_model(path: str, name: str = "vit_base", patch: int = 16, key: str = "teacher", side: int = 224) -> Transformer:
    """A named model with the file's weights; an unknown name or a missing weight is an error."""
    shape = Shape.named(name, patch, side)
    weights = own_names(read_weights(path, key))
    missing, _ = compare(weights, shape)
    if missing:
        raise KeyError(f"the weight file lacks {missing[:5]}")
    return Transformer(shape, weights)


@dataclass
class Restart:
    """States and scalars after a restart, and (key, status) of what was asked for: loaded, not found, or how names differ."""

    states: dict[str, dict[str, np.ndarray]]
    variables: dict[str, Any]
    found: list[tuple[str, str]]


def restarted(path: str, states: dict[str, dict[str, np.ndarray] | None], variables: dict[str, Any] | None = None) -> Restart:
    """States by key, and variables by name, as a checkpoint archive has them.

    A missing file changes nothing and reports nothing. Of a state, tensors of the same name and size are taken and the others
    stay, which the report says; a key that the file lacks, or whose state is None, stays as it is. Variables that the file
    lacks keep their values.
    """
    out, values, found = dict(states), dict(variables or {}), []
    if not os.path.isfile(path):
        return Restart(out, values, found)
    tree = tensors.read_archive(path)
    for key, state in states.items():
        if state is None or key not in tree:
            found.append((key, "not found"))
            continue
        theirs = {n: x for n, x in tree[key].items() if isinstance(x, np.ndarray)}
        fitting = {n: x for n, x in theirs.items() if n in state and x.shape == state[n].shape}
        out[key] = {**state, **fitting}
        missing, unexpected = sorted(set(state) - set(fitting)), sorted(set(theirs) - set(state))
        found.append((key, f"loaded; missing {missing}, unexpected {unexpected}" if missing or unexpected else "loaded"))
    return Restart(out, values | {n: tree[n] for n in values if n in tree}, found)


def load_linear(path: str, name: str = "linear") -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) of a linear classifier; any other content is an error."""
    weights = read_weights(path, "state_dict")
    if set(weights) == {f"{name}.weight", f"{name}.bias"}:
        return weights[f"{name}.weight"].T, weights[f"{name}.bias"]
    if set(weights) != {f"{name}.w", f"{name}.b"}:
        raise KeyError(f"expected {name}.w and {name}.b, found {sorted(weights)}")
    return weights[f"{name}.w"], weights[f"{name}.b"]


def training_table(spark: SparkSession, path: str, vector: str = "embedding", label: str = "label") -> DataFrame:
    """(train_id, embedding, label) of a Parquet table that has these columns, or of a tensor archive of features and labels.

    A missing column or tensor is an error. Rows of an archive are numbered.
    """
    if os.path.isfile(path) and tensors.is_archive(path):
        tree = tensors.read_archive(path)
        if missing := {"train_features", "train_labels"} - set(tree):
            raise KeyError(f"the training file lacks {sorted(missing)}")
        x, labels = np.asarray(tree["train_features"], np.float32), np.asarray(tree["train_labels"]).ravel().astype(np.int64)
        if x.ndim != 2 or len(x) != len(labels):
            raise ValueError(f"{x.shape} features for {len(labels)} labels")
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        return spark.createDataFrame(pa.table({"train_id": pa.array(np.arange(len(x))), "embedding": lists, "label": pa.array(labels)}))
    rows = spark.read.parquet(path)
    if missing := {"train_id", vector, label} - set(rows.columns):
        raise KeyError(f"the training table lacks {sorted(missing)}")
    return rows.select(F.col("train_id").cast("long").alias("train_id"), F.col(vector).alias("embedding"), F.col(label).cast("long").alias("label"))

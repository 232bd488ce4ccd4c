"""Tensor archives as NumPy arrays: ZIP files with a pickled tree and one raw file for each storage. No code of theirs runs."""

from __future__ import annotations

import pickle
import sys
import zipfile
from collections import OrderedDict
from typing import Any

import numpy as np

#: Names of storage types in such archives, and what they hold.
STORAGES = {
    "DoubleStorage": "f8", "FloatStorage": "f4", "HalfStorage": "f2", "LongStorage": "i8", "IntStorage": "i4", "ShortStorage": "i2",
    "CharStorage": "i1", "ByteStorage": "u1", "BoolStorage": "?", "BFloat16Storage": "bf16",
}


class Ignored:
    """Stands for any object that is not a tensor, a plain value or a container."""

    def __init__(self, *args: Any, **kwargs: Any):
        pass

    def __setstate__(self, state: Any) -> None:
        pass

    def __setitem__(self, key: Any, value: Any) -> None:
        pass

    def append(self, value: Any) -> None:
        pass

    def extend(self, values: Any) -> None:
        pass


def strided(storage: np.ndarray, offset: int, size: tuple[int, ...], stride: tuple[int, ...], *rest: Any) -> np.ndarray:
    """The tensor of a storage: `offset`, `size` and `stride` count elements."""
    last = offset + sum((n - 1) * step for n, step in zip(size, stride, strict=True)) if all(size) else offset - 1
    if offset < 0 or last >= len(storage) or any(s < 0 for s in stride):
        raise ValueError("a tensor reaches beyond its storage")
    view = np.lib.stride_tricks.as_strided(storage[offset:], size, [s * storage.itemsize for s in stride], writeable=False)
    return np.array(view)


class Reader(pickle.Unpickler):
    """Builds containers, plain values and tensors only."""

    def __init__(self, file: Any, archive: zipfile.ZipFile, folder: str, order: str):
        super().__init__(file, encoding="utf-8")
        self.archive, self.folder, self.order = archive, folder, order
        self.storages: dict[str, np.ndarray] = {}

    def find_class(self, module: str, name: str) -> Any:
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        if module.startswith("torch") and name in STORAGES:
            return name
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return strided
        if (module, name) == ("torch._utils", "_rebuild_parameter"):
            return lambda tensor, *rest: tensor
        return Ignored

    def persistent_load(self, pid: Any) -> np.ndarray:
        kind, storage, key, _, n = pid
        if kind != "storage" or storage not in STORAGES:
            raise pickle.UnpicklingError(f"an unknown storage: {storage!r}")
        if key not in self.storages:
            raw, held = self.archive.read(f"{self.folder}/data/{key}"), STORAGES[storage]
            if held == "bf16":  # the upper half of a single
                values = (np.frombuffer(raw, f"{self.order}u2").astype(np.uint32) << 16).view(np.float32)
            else:
                values = np.frombuffer(raw, np.dtype(held).newbyteorder(self.order))
            if len(values) < n:
                raise EOFError(f"storage {key} is shorter than it says")
            self.storages[key] = values
        return self.storages[key]


def is_archive(path: str) -> bool:
    if not zipfile.is_zipfile(path):
        return False
    with zipfile.ZipFile(path) as archive:
        return any(n.endswith("/data.pkl") for n in archive.namelist())


def read_archive(path: str) -> Any:
    """The tree of dicts, lists, plain values and arrays of an archive."""
    with zipfile.ZipFile(path) as archive:
        tree = next(n for n in archive.namelist() if n.endswith("/data.pkl"))
        folder = tree.rpartition("/")[0]
        name = f"{folder}/byteorder"
        little = archive.read(name) == b"little" if name in archive.namelist() else sys.byteorder == "little"
        with archive.open(tree) as file:
            return Reader(file, archive, folder, "<" if little else ">").load()

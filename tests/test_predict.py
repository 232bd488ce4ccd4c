"""The whole path from tiles to predictions, at rest and as a stream; weight files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import vision
from quern.plans import predict
from quern.sources import checkpoints, images
from quern.streaming import tiles as streaming
from tests.test_sources import tiff

SHAPE = vision.Shape(8, 1, 2, 8, 16, 3)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    rng = np.random.default_rng(3)
    root = tmp_path_factory.mktemp("tiles")
    for country, n in (("Mali", 3), ("Côte d'Ivoire", 2)):
        (root / country).mkdir()
        for i in range(n):
            (root / country / f"{i}.tif").write_bytes(tiff(rng.integers(0, 256, (12, 12, 3)).astype(np.uint8)))
    (root / "Mali" / "broken.tif").write_bytes(b"?")
    (root / "Empty").mkdir()
    return {p.name: str(p) for p in root.iterdir()}


@pytest.fixture(scope="module")
def model():
    return vision.Transformer(SHAPE, vision.seeded_weights(SHAPE))


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], i % 2) for i in range(20)], "train_id long, embedding array<double>, label long")


def test_predictions_by_country(spark, folders, model, train, tmp_path):
    got, failed = predict.predictions_by_country(spark, folders, model, train, side=8)
    rows = got.collect()
    assert list(failed) == ["Empty"] and "no .tif files" in failed["Empty"]
    assert sorted((r.country, r.file_name, r.decode_ok) for r in rows) == sorted([("Mali", f"{i}.tif", True) for i in range(3)] + [("Mali", "broken.tif", False)] + [("Côte d'Ivoire", f"{i}.tif", True) for i in range(2)])
    assert {r.prediction for r in rows} <= {0, 1}
    images.write_by_country(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("country").count().count() == 2


def test_weight_files(spark, tmp_path, train):
    weights = vision.seeded_weights(SHAPE)
    np.savez(tmp_path / "w.npz", **{f"teacher/module.backbone.{n}": w for n, w in weights.items()}, other=np.zeros(2))
    got = checkpoints.read_weights(str(tmp_path / "w.npz"), "teacher")
    assert checkpoints.compare(got, SHAPE) == ([], [])
    assert checkpoints.compare({"cls": np.zeros(3), "x": np.zeros(1)}, SHAPE)[1] == ["x"]
    with pytest.raises(KeyError, match="lacks"):
        checkpoints.load_model(str(tmp_path / "w.npz"), "vit_tiny")
    with pytest.raises(ValueError):
        checkpoints.load_model(str(tmp_path / "w.npz"), "resnet50")
    with pytest.raises(FileNotFoundError):
        checkpoints.read_weights(str(tmp_path / "none.npz"))
    np.savez(tmp_path / "l.npz", **{"linear.w": np.eye(2), "linear.b": np.zeros(2)})
    assert checkpoints.load_linear(str(tmp_path / "l.npz"))[0].shape == (2, 2)
    with pytest.raises(KeyError):
        checkpoints.load_linear(str(tmp_path / "w.npz"))
    train.write.parquet(str(tmp_path / "t"))
    assert checkpoints.training_table(spark, str(tmp_path / "t")).count() == 20
    train.drop("label").write.parquet(str(tmp_path / "u"))
    with pytest.raises(KeyError):
        checkpoints.training_table(spark, str(tmp_path / "u"))


def test_tiles_as_a_stream(spark, folders, tmp_path):
    stream = streaming.tile_stream(spark, folders["Mali"], 2)
    assert stream.isStreaming
    streaming.classified(stream, lambda b: b.select("file_name", F.length("content").alias("n")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.file_name for r in out.collect()) == ["0.tif", "1.tif", "2.tif", "broken.tif"]
    assert out.select("batch").distinct().count() == 2


def test_windowed_metrics(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 4, 0) AS ts, 'loss' AS name, CAST(id AS DOUBLE) AS value FROM range(6)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streaming.windowed_metrics(stream, "ts", "name", "value").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.n, r.total, r.average) for r in spark.table("windowed").collect()) == [(1, 5.0, 5.0), (2, 7.0, 3.5), (3, 3.0, 1.0)]


class Storage:
    """What a test's archive refers to as a storage."""

    def __init__(self, kind, key, n):
        self.kind, self.key, self.n = kind, key, n


def archive(path, tree):
    """A tensor archive as it is found in the wild, written without the library that usually does."""
    import io
    import pickle
    import sys
    import types
    import zipfile
    from collections import OrderedDict

    kinds = {"f4": "FloatStorage", "f8": "DoubleStorage", "i8": "LongStorage"}
    module, utils, args = types.ModuleType("torch"), types.ModuleType("torch._utils"), types.ModuleType("run")
    for name in kinds.values():
        setattr(module, name, type(name, (), {"__module__": "torch"}))

    def rebuild(*a):
        return a

    rebuild.__module__, rebuild.__qualname__, rebuild.__name__ = "torch._utils", "_rebuild_tensor_v2", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = rebuild
    args.Options = type("Options", (), {"__module__": "run"})
    held = []

    class Tensor:
        def __init__(self, x):
            self.x = x

        def __reduce__(self):
            held.append(np.ascontiguousarray(self.x).ravel())
            steps = [s // self.x.itemsize for s in np.ascontiguousarray(self.x).strides]
            return rebuild, (Storage(kinds[self.x.dtype.str[1:]], str(len(held) - 1), self.x.size), 0, self.x.shape, tuple(steps), False, OrderedDict())

    class Writer(pickle.Pickler):
        def persistent_id(self, x):
            return ("storage", getattr(module, x.kind), x.key, "cpu", x.n) if isinstance(x, Storage) else None

    def wrapped(x):
        return OrderedDict((k, wrapped(v)) for k, v in x.items()) if isinstance(x, dict) else Tensor(x) if isinstance(x, np.ndarray) else x

    with pytest.MonkeyPatch.context() as patch:
        for name, m in (("torch", module), ("torch._utils", utils), ("run", args)):
            patch.setitem(sys.modules, name, m)
        out = io.BytesIO()
        Writer(out, 2).dump({**wrapped(tree), "args": args.Options()})
    with zipfile.ZipFile(path, "w") as file:
        file.writestr("weights/data.pkl", out.getvalue())
        file.writestr("weights/byteorder", "little")
        for i, x in enumerate(held):
            file.writestr(f"weights/data/{i}", x.tobytes())


def test_tensor_archives(spark, tmp_path, model):
    w = {k: np.asarray(x, np.float32) for k, x in vision.seeded_weights(SHAPE).items()}
    p, d = SHAPE.patch, SHAPE.dim
    named = {"cls_token": w["cls"].reshape(1, 1, d), "pos_embed": w["pos"][None], "patch_embed.proj.weight": w["patch.w"].T.reshape(d, 3, p, p), "patch_embed.proj.bias": w["patch.b"], "norm.weight": w["norm.scale"], "norm.bias": w["norm.shift"]}
    for theirs, ours in (("norm1", "n1"), ("norm2", "n2")):
        named |= {f"blocks.0.{theirs}.weight": w[f"0.{ours}.scale"], f"blocks.0.{theirs}.bias": w[f"0.{ours}.shift"]}
    for theirs, ours in (("attn.qkv", "qkv"), ("attn.proj", "proj"), ("mlp.fc1", "fc1"), ("mlp.fc2", "fc2")):
        named |= {f"blocks.0.{theirs}.weight": w[f"0.{ours}.w"].T, f"blocks.0.{theirs}.bias": w[f"0.{ours}.b"]}
    archive(tmp_path / "model.pth", {"teacher": {f"module.backbone.{k}": x for k, x in named.items()}, "epoch": 3})
    got = checkpoints.own_names(checkpoints.read_weights(str(tmp_path / "model.pth"), "teacher"))
    assert checkpoints.compare(got, SHAPE) == ([], [])
    x = np.random.default_rng(0).normal(size=(2, 3, 16, 16))
    assert np.allclose(vision.Transformer(SHAPE, got).features(x), vision.Transformer(SHAPE, w).features(x))
    features = np.arange(12, dtype=np.float32).reshape(4, 3)
    archive(tmp_path / "knn.pth", {"train_features": features, "train_labels": np.array([1, 0, 1, 2])})
    rows = sorted(checkpoints.training_table(spark, str(tmp_path / "knn.pth")).collect())
    assert [(r.train_id, list(r.embedding), r.label) for r in rows] == [(i, features[i].tolist(), [1, 0, 1, 2][i]) for i in range(4)]
    archive(tmp_path / "none.pth", {"train_labels": np.array([1])})
    with pytest.raises(KeyError, match="train_features"):
        checkpoints.training_table(spark, str(tmp_path / "none.pth"))


def test_a_tensor_stays_in_its_storage():
    from quern.sources import tensors

    assert tensors.strided(np.arange(6), 1, (2, 2), (1, 2)).tolist() == [[1, 3], [2, 4]]
    for offset, size, stride in ((5, (2,), (1,)), (0, (2, 4), (4, 1)), (0, (2,), (-1,))):
        with pytest.raises(ValueError, match="beyond"):
            tensors.strided(np.arange(6), offset, size, stride)


def test_tiles_are_embedded_once(spark, folders, model, train):
    plan = predict.predictions(spark, folders["Mali"], model, train, 8)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "FileScan image" not in plan and "FileScan binaryFile" not in plan

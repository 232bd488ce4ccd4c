"""Tiles that Spark's file sources hide, files that the JVM writes, restart by ranges, progress, and one plan for all countries."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import vision
from quern.plans import catalog_tiles, predict, restart
from quern.sources import checkpoints, images, rasters, tile_source
from quern.streaming import progress
from quern.streaming import tiles as streaming
from tests.test_predict import SHAPE, archive
from tests.test_sources import tiff


@pytest.fixture(scope="module")
def model():
    return vision.Transformer(SHAPE, vision.seeded_weights(SHAPE))


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], i % 2) for i in range(20)], "train_id long, embedding array<double>, label long")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(1)
    root = tmp_path_factory.mktemp("many")
    for name in ("a.tif", "_b.tif", ".c.tif", "D.TIF", "x y+1%.tif"):
        (root / name).write_bytes(tiff(rng.integers(0, 256, (9, 11, 3)).astype(np.uint8)))
    (root / "_broken.tif").write_bytes(b"II*\0nothing")
    (root / "_note.txt").write_text("no tile")
    return root


def test_hidden_names_are_listed_and_decoded(spark, folder):
    names = ["_b.tif", ".c.tif", "D.TIF", "_broken.tif", "a.tif", "x y+1%.tif"]
    assert sorted(r.file_name for r in images.tiles(spark, str(folder)).collect()) == sorted(names)
    got = {r.file_name: r for r in images.decoded(spark, str(folder)).collect()}
    assert sorted(got) == sorted(names) and [n for n, r in got.items() if not r.decode_ok] == ["_broken.tif"]
    for name in names:
        if name != "_broken.tif":
            want = rasters.decode((folder / name).read_bytes())
            assert (np.frombuffer(got[name].pixels, np.uint8).reshape(want.shape) == want).all()
    assert {r.folder.rsplit("/", 1)[1] for r in got.values()} == {folder.name}


def test_partitions_by_bytes():
    files = [(f"{i}", n) for i, n in enumerate([10, 5 << 20, 1 << 20, 900 << 20, 7])]
    parts = tile_source.dealt("d", files, 8 << 20)
    assert [p.files for p in parts] == [("0", "1"), ("2",), ("3",), ("4",)]
    assert [tile_source.hidden(n) for n in ("_a", ".a", "a", "_k=1", "a._COPYING_")] == [True, True, False, False, True]


@pytest.mark.parametrize("compression", [None, "LZW", "Deflate", "PackBits", "ZLib"])
@pytest.mark.parametrize("kind", ["rgb", "grey"])
def test_files_that_the_jvm_writes(spark, tmp_path, compression, kind):
    """Written by the JVM's own codec, read by the library's decoder."""
    jvm = spark.sparkContext._jvm
    rng = np.random.default_rng(2)
    h, w = 40, 70
    x = np.repeat(rng.integers(0, 256, (h, w // 5, 3)), 5, 1).astype(np.uint8)
    if kind == "grey":
        x = np.repeat(x[:, :, :1], 3, 2)
    image = jvm.java.awt.image.BufferedImage(w, h, 5 if kind == "rgb" else 10)
    raster = image.getRaster()
    for i in range(h):
        for j in range(w):
            for c in range(3 if kind == "rgb" else 1):
                raster.setSample(j, i, c, int(x[i, j, c]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    settings = writer.getDefaultWriteParam()
    if compression:
        settings.setCompressionMode(2)
        settings.setCompressionType(compression)
    path = tmp_path / "x.tif"
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), settings)
    out.close()
    assert (rasters.decode(path.read_bytes()) == x).all()


def test_what_is_no_tile():
    good = tiff(np.zeros((4, 4, 3), np.uint8))
    for bad in (b"", b"II*\0", b"II*\0\xff\xff\xff\xff", good[:30], b"MM\0*" + good[4:], b"\x89PNG" + bytes(40)):
        with pytest.raises(ValueError):
            rasters.decode(bad)
    assert next(rasters.substituted([None], 5))[1].shape == (5, 5, 3)


def test_streamed_tiles_are_decoded_and_embedded(spark, folder, model, tmp_path):
    seen = images.decoded_contents(streaming.tile_stream(spark, str(folder), 2))

    def embedded(batch):
        return vision.embed(batch, ["file_name", "decode_ok"], images.Prepared(8, 16), model)

    streaming.classified(seen, embedded, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {r.file_name: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.file_name: r for r in vision.embed(images.decoded(spark, str(folder)), ["file_name"], images.Prepared(8, 16), model).collect()}
    assert sorted(got) == ["D.TIF", "a.tif", "x y+1%.tif"] and all(np.allclose(r.embedding, want[n].embedding) for n, r in got.items())


def test_streamed_tiles_are_classified_as_those_at_rest(spark, folder, model, train, tmp_path):
    streaming.classified(streaming.tile_stream(spark, str(folder), 2), predict.classifier(spark, model, train, 8), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(180)
    got = {r.file_name: (r.decode_ok, r.prediction) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.file_name: (r.decode_ok, r.prediction) for r in predict.predictions(spark, str(folder), model, train, 8).collect()}
    assert sorted(got) == ["D.TIF", "a.tif", "x y+1%.tif"] and all(want[n] == v for n, v in got.items())


@pytest.mark.parametrize("compression", [rasters.NONE, rasters.DEFLATE, rasters.PACKBITS])
def test_files_that_are_written_are_read(spark, tmp_path, compression):
    x = np.random.default_rng(3).integers(0, 256, (7, 31, 3)).astype(np.uint8)
    content = rasters.encode(x, compression)
    assert (rasters.decode(content) == x).all()
    (tmp_path / "a.tif").write_bytes(content)  # the JVM's decoder reads it as well
    got = images.decoded(spark, str(tmp_path)).first()
    assert got.decode_ok and (np.frombuffer(got.pixels, np.uint8).reshape(x.shape) == x).all()


# --- the model


def plain_attention(net, x, i):
    """Every score at once, in loops over images, heads and tokens."""
    n, t, d = x.shape
    h = net.shape.heads
    e = d // h
    out = np.zeros_like(x)
    for a in range(n):
        y = x[a] @ net.w[f"{i}.qkv.w"] + net.w[f"{i}.qkv.b"]
        for b in range(h):
            q, k, v = (y[:, j * d + b * e : j * d + b * e + e] for j in range(3))
            for at in range(t):
                s = np.exp(k @ q[at] * e**-0.5 - (k @ q[at] * e**-0.5).max())
                out[a, at, b * e : b * e + e] = s @ v / s.sum()
    return out @ net.w[f"{i}.proj.w"] + net.w[f"{i}.proj.b"]


@pytest.mark.parametrize("queries, keys", [(256, 256), (3, 4), (1, 1), (7, 2)])
def test_attention_by_blocks(monkeypatch, queries, keys):
    monkeypatch.setattr(vision, "QUERIES", queries)
    monkeypatch.setattr(vision, "KEYS", keys)
    monkeypatch.setattr(vision, "TOKENS", queries)
    shape = vision.Shape(12, 2, 3, 4, 16, 3)
    net = vision.Transformer(shape, vision.seeded_weights(shape, std=1.0))
    x = np.random.default_rng(0).normal(size=(2, shape.tokens, 12)) * 30
    assert np.allclose(net.attention(x, 1), plain_attention(net, x, 1))
    small = net.cast()
    assert small.attention(x.astype(np.float32), 1).dtype == np.float32
    images_ = np.random.default_rng(1).normal(size=(3, 3, 16, 16))
    assert np.allclose(small.features(images_.astype(np.float32)), net.features(images_), atol=1e-4)
    last = net.last_attention(images_)
    assert last.shape == (3, 3, 17, 17) and np.allclose(last.sum(-1), 1)


def test_images_of_a_forward_pass_fit_their_bytes(spark, monkeypatch):
    base = vision.Shape.named("vit_base", 8)
    assert 1 <= base.images_at_a_time() < vision.Shape.named("vit_tiny", 16).images_at_a_time()
    monkeypatch.setattr(vision, "MODEL_BYTES", 10)
    with pytest.raises(ValueError, match="broadcast"):
        vision.shared(spark, vision.Transformer(SHAPE, vision.seeded_weights(SHAPE)))


# --- restart


def test_a_run_goes_on_where_it_ended(spark, folder, model, tmp_path, monkeypatch):
    context = spark.sparkContext
    whole, counter = str(tmp_path / "whole"), context.accumulator(0)
    want = sorted((r.file_name, r.decode_ok, r.embedding) for r in restart.embed_in_ranges(spark, [str(folder)], model, whole, 5, 8, 16, counter).collect())
    assert len(want) == 6 == counter.value and restart.log(spark, whole).agg(F.sum("tiles"), F.sum("unreadable"), F.sum("failed")).first() == (6, 1, 0)
    path, real, calls = str(tmp_path / "ended"), restart.images.decoded_contents, []

    def ending(files):
        if len(calls) == 3:
            raise KeyboardInterrupt
        calls.append(1)
        return real(files)

    first, second, third = (context.accumulator(0) for _ in range(3))
    with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
        patch.setattr(restart.images, "decoded_contents", ending)
        restart.embed_in_ranges(spark, [str(folder)], model, path, 5, 8, 16, first)
    assert restart.log(spark, path).count() == 3
    spark.createDataFrame([("left", "left.tif", True, [0.0], None)], "folder string, file_name string, decode_ok boolean, embedding array<float>, error string").write.parquet(f"{path}/data/range=3")
    got = restart.embed_in_ranges(spark, [str(folder)], model, path, 5, 8, 16, second)
    assert sorted((r.file_name, r.decode_ok, r.embedding) for r in got.collect()) == want and first.value + second.value == 6 and first.value
    restart.embed_in_ranges(spark, [str(folder)], model, path, 5, 8, 16, third)
    assert third.value == 0
    with pytest.raises(ValueError, match="another model"):
        restart.embed_in_ranges(spark, [str(folder)], model, path, 6, 8, 16)


def test_states_and_scalars_after_a_restart(tmp_path):
    own = {"model": {"w": np.zeros((2, 2), np.float32), "b": np.zeros(2, np.float32), "own": np.ones(1)}, "none": None, "optimizer": {"m": np.zeros(1)}}
    nothing = checkpoints.restarted(str(tmp_path / "none.pth"), own, {"epoch": 0})
    assert nothing.states == own and nothing.variables == {"epoch": 0} and nothing.found == []
    archive(tmp_path / "run.pth", {"model": {"w": np.full((2, 2), 3, np.float32), "b": np.zeros(3, np.float32), "more": np.ones(1, np.float32)}, "epoch": 7, "none": {}})
    got = checkpoints.restarted(str(tmp_path / "run.pth"), own, {"epoch": 0, "loss": 1.5})
    assert got.variables == {"epoch": 7, "loss": 1.5} and (got.states["model"]["w"] == 3).all() and len(got.states["model"]["b"]) == 2 and got.states["optimizer"] is own["optimizer"]
    assert got.found == [("model", "loaded; missing ['b', 'own'], unexpected ['more']"), ("none", "not found"), ("optimizer", "not found")]


# --- one plan for all countries


class Failing(images.Prepared):
    """A transform that fails for images of eleven columns."""

    def __call__(self, rows):
        if 11 in rows.column(1).to_pylist():
            raise ValueError("eleven columns")
        return super().__call__(rows)


def test_one_plan_for_many_countries(spark, model, train, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    folders = {}
    for i in range(12):
        folders[f"C {i}"] = tmp_path / f"c {i}"
        folders[f"C {i}"].mkdir()
        for name in ("a.tif", "_b.tif"):
            (folders[f"C {i}"] / name).write_bytes(tiff(rng.integers(0, 256, (9, 11 if i == 3 and name == "a.tif" else 10, 3)).astype(np.uint8)))
    folders["Empty"], folders["None"] = tmp_path / "empty", tmp_path / "none"
    folders["Empty"].mkdir()
    monkeypatch.setattr(images, "Prepared", Failing)
    models, real = [], vision.shared
    monkeypatch.setattr(vision, "shared", lambda *a: models.append(1) or real(*a))
    got, failed = predict.predictions_by_country(spark, {c: str(p) for c, p in folders.items()}, model, train, side=8)
    rows = got.collect()
    assert sorted(failed) == ["C 3", "Empty", "None"] and "eleven columns" in failed["C 3"] and "a.tif" in failed["C 3"]
    assert sorted((r.country, r.file_name) for r in rows) == sorted((c, n) for c in folders for n in ("a.tif", "_b.tif") if c.startswith("C") and (c, n) != ("C 3", "a.tif"))
    assert len(models) == 1 and {r.prediction for r in rows} <= {0, 1}
    alone = {r.file_name: r.prediction for r in predict.predictions(spark, str(folders["C 5"]), model, train, 8).collect()}
    assert alone == {r.file_name: r.prediction for r in rows if r.country == "C 5"}
    assert predict.predictions_by_country(spark, {"Empty": str(folders["Empty"])}, model, train)[0] is None


# --- progress


def test_progress_of_a_batch(spark, tmp_path):
    log = progress.Log(spark, "ranges", str(tmp_path / "log"))
    seen, read = [], {}
    for i in progress.log_every(range(7), 3, log, lambda step: read[step]()):
        df, read[i] = progress.observed(spark.range(10 * (i + 1)), total=F.sum("id"))
        seen.append(df.agg(F.count("*")).first()[0])
    rows = sorted(log.table().collect(), key=lambda r: r.step)
    assert seen == [10 * (i + 1) for i in range(7)] and [(r.header, r.step, r.steps, r.rows) for r in rows] == [("ranges", 0, 7, 10), ("ranges", 3, 7, 40), ("ranges", 6, 7, 70)]
    assert [r.measures["total"] for r in rows] == [45, 780, 2415] and all(r.rows_per_second > 0 and r.seconds_left == pytest.approx(r.average_seconds * (7 - r.step)) for r in rows)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_progress_of_a_stream(spark, tmp_path):
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    log = progress.Log(spark, "stream")
    listener = progress.StreamLog(log, total_rows=40)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).observe("watch", F.max("id").alias("most"))
        stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        for _ in range(100):
            if len(log.rows) == 4:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    rows = log.table().collect()
    assert [(r.step, r.steps, r.rows) for r in rows] == [(0, 4, 10), (1, 4, 10), (2, 4, 10), (3, 4, 10)] and json.dumps(sorted(int(r.measures["most"]) for r in rows)) == "[9, 19, 29, 39]"
    assert all(r.seconds_left == pytest.approx(r.average_seconds * (4 - r.step)) for r in rows)


def test_tiles_of_the_queries_pass_one_python_worker(spark):
    """Making, decoding and summing tiles in a stage each of Python workers would hold three of them, and batches of images, for every core."""
    for query in ("s2_decoded", "p5_resized", "p6_center_crop", "p9_blurred"):
        plan = catalog_tiles.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1

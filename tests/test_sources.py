"""Image directories, transforms and result tables, on tiles that the tests write."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.sources import countries, images


def tiff(rgb):
    """An uncompressed 8-bit RGB file."""
    h, w, _ = rgb.shape
    entries = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 3, 8 + h * w * 3), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 8), (277, 3, 1, 3), (278, 3, 1, h), (279, 4, 1, h * w * 3), (284, 3, 1, 1)]
    at = 8 + h * w * 3 + 6
    at += at % 2
    body = rgb.tobytes() + struct.pack("<3H", 8, 8, 8)
    body += b"\0" * (at - 8 - len(body))
    out = struct.pack("<2sHI", b"II", 42, at) + body + struct.pack("<H", len(entries))
    for tag, kind, n, value in entries:
        out += struct.pack("<HHI", tag, kind, n) + (struct.pack("<HH", value, 0) if kind == 3 and n == 1 else struct.pack("<I", value))
    return out + struct.pack("<I", 0)


@pytest.fixture(scope="module")
def tiles(tmp_path_factory):
    folder = tmp_path_factory.mktemp("Côte d'Ivoire")
    rng = np.random.default_rng(0)
    made = {"a.tif": rng.integers(0, 256, (40, 60, 3)), "B.TIF": rng.integers(0, 256, (64, 64, 3)), "x y+1%.tif": rng.integers(0, 256, (8, 8, 3))}
    for name, x in made.items():
        (folder / name).write_bytes(tiff(x.astype(np.uint8)))
    (folder / "bad.tif").write_bytes(b"not an image")
    (folder / "c.tiff").write_bytes(tiff(made["a.tif"].astype(np.uint8)))
    return str(folder), {k: v.astype(np.uint8) for k, v in made.items()}


def test_listing(spark, tiles, tmp_path):
    assert sorted(r.file_name for r in images.tiles(spark, tiles[0]).collect()) == ["B.TIF", "a.tif", "bad.tif", "x y+1%.tif"]
    with pytest.raises(ValueError):
        images.tiles(spark, str(tmp_path))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        images.tiles(spark, str(tmp_path / "none"))


def test_decoding_and_the_black_substitute(spark, tiles):
    got = {r.file_name: r for r in images.decoded(spark, tiles[0]).collect()}
    assert sorted(got) == ["B.TIF", "a.tif", "bad.tif", "x y+1%.tif"]
    for name, x in tiles[1].items():
        assert got[name].decode_ok and (np.frombuffer(got[name].pixels, np.uint8).reshape(x.shape) == x).all()
    assert not got["bad.tif"].decode_ok and not any(got["bad.tif"].pixels) and got["bad.tif"].height == 224


def test_transform(spark, tiles):
    got = {r.file_name: np.array(r.pixels).reshape(3, 224, 224) for r in images.transformed(images.decoded(spark, tiles[0])).collect()}
    border = [-m / s for m, s in zip(images.MEAN, images.STD)]
    for x in got.values():
        assert np.allclose(x[:, 0, 0], border, atol=1e-6)
    square = got["B.TIF"]
    want = images.normalized(tiles[1]["B.TIF"])
    assert np.allclose(square[:, 80:144, 80:144], want, atol=1e-6)  # 64 x 64 stays, with 80 pixels around
    assert np.allclose(got["bad.tif"][:, 112, 112], border, atol=1e-6)


def test_pixel_functions():
    flat = np.full((50, 30, 3), 77, np.uint8)
    assert images.resize(flat, 20).shape == (33, 20, 3) and (images.resize(flat, 20) == 77).all()
    assert images.center_crop(flat, 10).shape == (10, 10, 3) and (images.center_crop(flat, 10) == 77).all()
    assert (images.blurred(flat, 1.5) == 77).all()
    assert images.solarized(np.array([0, 127, 128, 255])).tolist() == [0, 127, 127, 0]
    rng = np.random.default_rng(0)
    noisy = rng.integers(0, 256, (20, 20, 3)).astype(np.uint8)
    assert images.augmented(noisy, rng, 1.0).std() < noisy.std()
    assert (images.augmented(noisy, rng, -1.0, 1.0) == images.solarized(noisy)).all()


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a.tif", 1), ("b,c.tif", 0)], "file_name string, prediction long")
    images.write_results(rows, str(tmp_path / "w0"), one_file=True)
    assert sorted(map(tuple, images.read_worker_results(spark, [str(tmp_path / "w0")]).collect())) == [("a.tif", 1), ("b,c.tif", 0)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        images.read_worker_results(spark, [str(tmp_path / "w0"), str(tmp_path / "w1")])
    images.write_by_country(rows.withColumn("country", F.lit("Côte d'Ivoire")), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).filter("country = \"Côte d'Ivoire\"").count() == 2
    assert countries.countries(spark, "/r").filter("country = 'Mali'").first().directory == "/r/Mali" and len(set(countries.COUNTRIES)) == 51


def test_missing_worker_results(spark, tmp_path):
    rows = spark.createDataFrame([("a.tif", 1)], "file_name string, prediction long")
    images.write_results(rows, str(tmp_path / "w0"))
    paths = [str(tmp_path / "w0"), str(tmp_path / "w1")]
    with pytest.warns(UserWarning, match="w1"):
        assert images.read_worker_results(spark, paths, skip_missing=True).count() == 1
    with pytest.warns(UserWarning, match="w1"):
        assert images.read_worker_results(spark, paths[1:], skip_missing=True).count() == 0
    with pytest.raises(Exception, match="w1"):
        images.read_worker_results(spark, paths).count()

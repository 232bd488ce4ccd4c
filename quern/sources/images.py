"""Directories of image tiles as DataFrames, their transforms, and result tables."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalars import basename
from quern.operators.vision import cubic_matrix
from quern.sources import rasters
from quern.sources.tile_source import contents

#: Channel means and deviations of the training images, and the transform's sizes.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
RESIZE, CROP = 64, 224


PATTERN = "*.[tT][iI][fF]"
DECODED = "folder string, file_name string, decode_ok boolean, height int, width int, pixels binary"


def tiles(spark: SparkSession, directory: str) -> DataFrame:
    """(path, file_name) of the .tif files of a directory, whatever the case; a missing directory and an empty one are errors.

    Names that Spark's file sources hide (with a leading _ or .) are among them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).load(directory)
    names = files.select("path", basename(F.col("path")).alias("file_name")).unionByName(contents(spark, directory, only_hidden=True).select("path", "file_name"))
    if names.isEmpty():
        raise ValueError(f"no .tif files in {directory}")
    return names


def decoded(spark: SparkSession, directories: str | list[str]) -> DataFrame:
    """(folder, file_name, decode_ok, height, width, pixels): RGB bytes row by row; an unreadable file is a black 224 x 224 image.

    Files are read once, by the JVM's decoder, which gives a row for what it cannot read, and percent-encodes the path; those
    that Spark's sources hide come from the tile source, through the library's own decoder. One plan for all directories.
    """
    several = [directories] if isinstance(directories, str) else list(directories)
    images = spark.read.format("image").option("pathGlobFilter", PATTERN).load(several).select("image.*")
    path = F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))
    rows = images.select(F.regexp_replace(path, "/[^/]*$", "").alias("folder"), basename(path).alias("file_name"), "height", "width", "nChannels", "mode", "data")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, w, c, mode, data = (batch.column(j)[i].as_py() for j in range(2, 7))
                ok = mode is not None and mode >= 0 and data is not None and h * w * c == len(data)
                rgb = to_rgb(np.frombuffer(data, np.uint8).reshape(h, w, c)) if ok else np.zeros((CROP, CROP, 3), np.uint8)
                yield tile_row(batch.slice(i, 1).columns[:2], ok, rgb)

    return rows.mapInArrow(apply, DECODED).unionByName(decoded_contents(contents(spark, several, only_hidden=True)))


def decoded_contents(files: DataFrame) -> DataFrame:
    """The same columns from files' bytes (path, file_name, content), at rest or in a stream."""
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "file_name", "content").mapInArrow(decode, DECODED)


def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of DECODED at a time from batches of (folder, file_name, content): for a task that makes or reduces the images itself."""
    for batch in batches:
        for i in range(batch.num_rows):
            for ok, rgb in rasters.substituted([batch.column(2)[i].as_py()], CROP):
                yield tile_row(batch.slice(i, 1).columns[:2], ok, rgb)


def tile_row(names: list[pa.Array], ok: bool, rgb: np.ndarray) -> pa.RecordBatch:
    values = [pa.array([ok]), pa.array([rgb.shape[0]], pa.int32()), pa.array([rgb.shape[1]], pa.int32()), pa.array([rgb.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays([*names, *values], names=["folder", "file_name", "decode_ok", "height", "width", "pixels"])


def to_rgb(bgr: np.ndarray) -> np.ndarray:
    """Three channels from the decoder's one, three (BGR) or four (BGRA)."""
    return np.repeat(bgr, 3, 2) if bgr.shape[2] == 1 else np.ascontiguousarray(bgr[:, :, 2::-1])


def resize(image: np.ndarray, side: int = RESIZE) -> np.ndarray:
    """The shorter side to `side`, bicubic with the kernel widened when shrinking."""
    h, w = image.shape[:2]
    rows, cols = (side, max(1, int(side * w / h))) if h <= w else (max(1, int(side * h / w)), side)
    out = np.einsum("rh,hwc,kw->rkc", cubic_matrix(h, rows, -0.5, True), image.astype(np.float64), cubic_matrix(w, cols, -0.5, True))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def center_crop(image: np.ndarray, side: int = CROP) -> np.ndarray:
    """The middle side x side; a smaller image gets a black border first."""
    h, w = image.shape[:2]
    top, left = max(0, (side - h) // 2), max(0, (side - w) // 2)
    padded = np.zeros((max(h, side), max(w, side), image.shape[2]), image.dtype)
    padded[top : top + h, left : left + w] = image
    y, x = round((padded.shape[0] - side) / 2), round((padded.shape[1] - side) / 2)
    return padded[y : y + side, x : x + side]


def normalized(image: np.ndarray) -> np.ndarray:
    """(channel, row, column) floats over the channel deviations."""
    return ((image.transpose(2, 0, 1) / 255 - np.array(MEAN)[:, None, None]) / np.array(STD)[:, None, None]).astype(np.float32)


def solarized(image: np.ndarray, threshold: int = 128) -> np.ndarray:
    return np.where(image < threshold, image, 255 - image).astype(image.dtype)


def blurred(image: np.ndarray, radius: float) -> np.ndarray:
    """A Gaussian blur of this deviation, edges repeated."""
    reach = max(1, int(np.ceil(3 * radius)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / max(radius, 1e-6)) ** 2)
    kernel /= kernel.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        pad = [(0, 0)] * 3
        pad[axis] = (reach, reach)
        wide = np.pad(out, pad, mode="edge")
        out = sum(k * np.take(wide, np.arange(i, i + out.shape[axis]), axis) for i, k in enumerate(kernel))
    return np.clip(np.rint(out), 0, 255).astype(image.dtype)


def augmented(image: np.ndarray, rng: np.random.Generator, blur: float = 0.5, solarize: float = 0.0) -> np.ndarray:
    """Blurs with probability `blur` and a radius from 0.1 to 2; solarizes with probability `solarize`."""
    if rng.random() <= blur:
        image = blurred(image, rng.uniform(0.1, 2.0))
    return solarized(image) if rng.random() < solarize else image


class Prepared:
    """Decoded images (height, width, pixels) as (image, channel, row, column) floats: resized, cropped and normalized."""

    columns = ("height", "width", "pixels")

    def __init__(self, side: int = RESIZE, crop: int = CROP):
        self.side, self.crop = side, crop

    def __call__(self, rows: pa.RecordBatch) -> np.ndarray:
        values = zip(*(c.to_pylist() for c in rows.columns), strict=True)
        return np.stack([normalized(center_crop(resize(np.frombuffer(p, np.uint8).reshape(h, w, 3), self.side), self.crop)) for h, w, p in values])


def transformed(images: DataFrame, side: int = RESIZE, crop: int = CROP) -> DataFrame:
    """(file_name, decode_ok, pixels): decoded images resized, cropped and normalized to flat float arrays."""
    prepare = Prepared(side, crop)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                pixels = list(prepare(part.select(list(prepare.columns))).reshape(part.num_rows, -1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pixels, pa.list_(pa.float32()))], names=["file_name", "decode_ok", "pixels"])

    return images.select("file_name", "decode_ok", *prepare.columns).mapInArrow(apply, "file_name string, decode_ok boolean, pixels array<float>")


def write_results(results: DataFrame, path: str, one_file: bool = False) -> None:
    """Results as CSV with a header; `one_file` only for results known to be small."""
    (results.coalesce(1) if one_file else results).write.mode("overwrite").option("header", True).csv(path)


def write_by_country(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").partitionBy("country").parquet(path)


def read_worker_results(spark: SparkSession, paths: list[str], label: str = "long", skip_missing: bool = False) -> DataFrame:
    """Workers' CSV files as one table with fixed types; a missing file is an error, or, under skip_missing, a warning."""
    schema = f"file_name string, prediction {label}"
    if skip_missing:
        hadoop, there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, []
        for path in paths:
            place = hadoop(path)
            if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
                there.append(path)
            else:
                warnings.warn(f"no results at {path}", stacklevel=2)
        if not there:
            return spark.createDataFrame([], schema)
        paths = there
    return spark.read.schema(schema).option("header", True).csv(paths)

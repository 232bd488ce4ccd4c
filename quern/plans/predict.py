"""From directories of tiles to predictions: decode, transform, embed, classify, write.

One plan for any number of countries: all directories are one scan, the country is a column that comes from a tile's path, and
model and training vectors are broadcast once. A directory that lacks tiles is named and left out before; a tile that fails in
the model is a row of its country's failures, and the others go on.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import neighbours, vision
from quern.session import shared_dir, stored
from quern.sources import checkpoints, images


def embeddings(spark: SparkSession, directories: str | list[str], model: vision.Transformer | Broadcast, side: int = images.RESIZE, crop: int | None = None) -> DataFrame:
    """(folder, file_name, decode_ok, embedding, error) of the tiles of one or several directories, each transformed where it is embedded."""
    net = model if isinstance(model, Broadcast) else vision.shared(spark, model)
    prepare = images.Prepared(side, crop or net.value.shape.side)
    return vision.embed(images.decoded(spark, directories), ["folder", "file_name", "decode_ok"], prepare, net, errors=True)


def classified(rows: DataFrame, train: DataFrame, keep: list[str]) -> DataFrame:
    """keep and prediction of stored embeddings; a row without one has none."""
    votes = neighbours.classify(rows.select("row", "embedding"), train, "row", "train_id", "embedding", "label")
    return rows.select("row", *keep).join(votes, "row", "left").select(*keep, "prediction")


def predictions(spark: SparkSession, directory: str, model: vision.Transformer | Broadcast, train: DataFrame, side: int = images.RESIZE) -> DataFrame:
    """(file_name, prediction, decode_ok). The model sees every tile once: embeddings are stored, as the classifier and the result read them."""
    images.tiles(spark, directory)  # a missing or empty directory
    rows = embeddings(spark, directory, model, side).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, f"{shared_dir(spark, 'tiles')}/embeddings")
    if failed := rows.filter("error IS NOT NULL").select("file_name", "error").first():
        raise RuntimeError(f"{failed.file_name}: {failed.error}")
    return classified(rows, train, ["file_name", "decode_ok"]).select("file_name", "prediction", "decode_ok")


def classifier(spark: SparkSession, model: vision.Transformer | Broadcast, train: DataFrame, side: int = images.RESIZE, crop: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """What turns a batch of files' bytes (path, file_name, content), such as a micro-batch of a stream of tiles, into (file_name, decode_ok, prediction, error)."""
    net = model if isinstance(model, Broadcast) else vision.shared(spark, model)
    prepare = images.Prepared(side, crop or net.value.shape.side)

    def classify(batch: DataFrame) -> DataFrame:
        rows = vision.embed(images.decoded_contents(batch), ["folder", "file_name", "decode_ok"], prepare, net, errors=True)
        rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), f"{shared_dir(spark, 'tiles')}/embeddings")
        return classified(rows, train, ["file_name", "decode_ok", "error"]).select("file_name", "decode_ok", "prediction", "error")

    return classify


@dataclass
class ByCountry:
    """predictions: (country, file_name, prediction, decode_ok); failures: (country, file_name, error) of tiles; missing: countries without tiles."""

    predictions: DataFrame | None
    failures: DataFrame | None
    missing: dict[str, str]


def by_country(spark: SparkSession, directories: dict[str, str], model: vision.Transformer | Broadcast, train: DataFrame, side: int = images.RESIZE, crop: int | None = None) -> ByCountry:
    """All countries in one job; no tables if none of them has a tile."""
    missing, found = {}, {}
    for country, directory in directories.items():
        try:
            images.tiles(spark, directory)  # looks for one file
            found[country] = directory
        except Exception as error:  # noqa: BLE001 a country's failure is reported and does not stop the others
            missing[country] = str(error).splitlines()[0]
    if not found:
        return ByCountry(None, None, missing)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    bare = lambda d: str(path(d).toUri().getPath()).rstrip("/")
    names = F.create_map(*[x for country, d in found.items() for x in (F.lit(bare(d)), F.lit(country))])  # a country each
    folder = F.regexp_replace("folder", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    rows = embeddings(spark, list(found.values()), model, side, crop).withColumn("country", names[folder]).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, f"{shared_dir(spark, 'tiles')}/embeddings")
    good = rows.filter("error IS NULL")
    return ByCountry(
        classified(good, train, ["country", "file_name", "decode_ok"]).select("country", "file_name", "prediction", "decode_ok"),
        rows.filter("error IS NOT NULL").select("country", "file_name", "error"),
        missing,
    )


def predictions_by_country(spark: SparkSession, directories: dict[str, str], model: vision.Transformer | Broadcast, train: DataFrame, side: int = images.RESIZE, crop: int | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """(country, file_name, prediction, decode_ok) of all tiles that have one, and the countries that lack tiles or have failed ones, with the reason."""
    done = by_country(spark, directories, model, train, side, crop)
    if done.predictions is None:
        return None, done.missing
    counted = done.failures.groupBy("country").agg(F.count("*").alias("n"), F.min(F.struct("file_name", "error")).alias("first")).collect()  # a row a country
    return done.predictions, done.missing | {r["country"]: f"{r['n']} tiles failed, {r['first']['file_name']} with {r['first']['error']}" for r in counted}


def main(args: list[str] | None = None) -> None:
    from quern.session import session

    parser = argparse.ArgumentParser(description="Classify a directory of image tiles.")
    for name in ("checkpoint_path", "knn_classifier_path", "csv_path", "directory"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--model", default="vit_base")
    parser.add_argument("--patch", type=int, default=8)
    options = parser.parse_args(args)
    spark = session()
    model = checkpoints.load_model(options.checkpoint_path, options.model, options.patch)
    train = checkpoints.training_table(spark, options.knn_classifier_path)
    images.write_results(predictions(spark, options.directory, model, train).select("file_name", "prediction"), options.csv_path)


if __name__ == "__main__":
    main()

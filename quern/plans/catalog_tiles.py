"""Queries of tiles, the model's parts, results, restart and progress, over tables: tiles are made of the embeddings, as 8 x 8 images.

"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.vectors import doubles, matrix
from quern.operators import balls, linear, meters, neighbours, ranges, vision
from quern.plans import restart
from quern.session import shared_dir
from quern.sources import checkpoints, images, rasters
from quern.streaming import progress

SIDE = 8
WORKERS = 5
#: Rows whose tile is cut short, so that it cannot be read: those whose number leaves no rest.
BROKEN = 97
#: Files that are made, and rows of sums that are sent on, at a time.
FILES = 512
COMPRESSIONS = (rasters.NONE, rasters.DEFLATE, rasters.PACKBITS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column, digits: int = 6):
    return F.round(column, digits) + F.lit(0.0)


def weights(rows: int, columns: int, a: int, b: int, n: int, over: float) -> np.ndarray:
    """((a * i + b * j) mod n - n div 2) / over: weights that SQL can state as well."""
    i, j = np.indices((rows, columns))
    return ((a * i + b * j) % n - n // 2) / over


def grey(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, q): the components as whole numbers from 0 to 255, a row of the image after the other."""
    q = F.transform(doubles("embedding"), lambda x: F.least(F.greatest(F.floor((x + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", q.alias("q"))


def tile_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(folder, file_name, content) from (vec_id, q): a TIFF file of each vector; red is q, green its complement, blue q reversed."""
    for batch in batches:
        for at in range(0, batch.num_rows, FILES):
            part = batch.slice(at, FILES)
            q, numbers = matrix(part.column(1)).astype(np.uint8), part.column(0).to_pylist()
            rgb = np.stack([q, 255 - q, q[:, ::-1]], 2).reshape(-1, SIDE, SIDE, 3)
            files = [rasters.encode(x, COMPRESSIONS[i % 3]) for x, i in zip(rgb, numbers, strict=True)]
            cut = [f[:40] if i % BROKEN == 0 else f for f, i in zip(files, numbers, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(["tiles"] * len(cut)), pa.array([f"{i}.tif" for i in numbers]), pa.array(cut, pa.binary())], names=["folder", "file_name", "content"])


def sums(spark: SparkSession, d: str, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """vec_id, decode_ok, height, width, and of each channel of the changed image the sum and the sum by place.

    Files are made, decoded and summed one after the other in one Python worker of a task, so that no images stand in batches between three.
    """
    names = ["vec_id", "decode_ok", "height", "width", *(f"{c}_{k}" for c in "rgb" for k in ("sum", "placed"))]
    types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), *[pa.int64()] * 6]

    def row(tile: pa.RecordBatch) -> tuple:
        name, ok, h, w, data = (tile.column(c)[0].as_py() for c in range(1, 6))
        x = change(np.frombuffer(data, np.uint8).reshape(h, w, 3))
        flat = x.reshape(-1, 3).astype(np.int64)
        placed = (flat * np.arange(1, len(flat) + 1)[:, None]).sum(0)
        return int(name.removesuffix(".tif")), ok, *x.shape[:2], *(v for c in range(3) for v in (int(flat[:, c].sum()), int(placed[c])))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row(tile) for tile in images.decode(tile_files(batches)))
        while part := list(itertools.islice(rows, FILES)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)

    ddl = "vec_id long, decode_ok boolean, height int, width int, " + ", ".join(f"{n} long" for n in names[4:])
    return grey(spark, d).filter(F.size("q") == SIDE * SIDE).mapInArrow(apply, ddl)


def s2_decoded(spark, d):
    """Every tile decoded; those that cannot be read are black."""
    return sums(spark, d, lambda x: x)


def p5_resized(spark, d):
    return sums(spark, d, lambda x: images.resize(x, 4))


def p6_center_crop(spark, d):
    return sums(spark, d, lambda x: images.center_crop(x, 5))


def p9_blurred(spark, d):
    return sums(spark, d, lambda x: images.blurred(x, 1.0))


def through(spark: SparkSession, d: str, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(vec_id, pos, v): what a function makes of the vectors, flat."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = change(matrix(batch.column(1))).reshape(batch.num_rows, -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["vec_id", "y"])

    rows = table(spark, d, "embeddings").select("vec_id", doubles("embedding").alias("x")).mapInArrow(apply, "vec_id long, y array<double>")
    return rows.select("vec_id", F.posexplode("y").alias("pos", "v")).select("vec_id", "pos", rounded(F.col("v")).alias("v"))


#: A model over tokens of 4 numbers, two heads, trained for 16 x 16 images: four by four patches.
PART = vision.Shape(4, 1, 2, 4, 16, 1)
PART_WEIGHTS = {
    "patch.w": weights(16, 4, 7, 3, 5, 4.0), "patch.b": weights(1, 4, 0, 1, 3, 8.0)[0],
    "0.qkv.w": np.concatenate([weights(4, 4, 3, 2, 5, 1.0), weights(4, 4, 1, 3, 5, 1.0), np.eye(4)], 1), "0.qkv.b": np.zeros(12), "0.proj.w": np.eye(4), "0.proj.b": np.zeros(4),
    "0.fc1.w": weights(4, 8, 7, 3, 5, 2.0), "0.fc1.b": weights(1, 8, 0, 1, 3, 8.0)[0], "0.fc2.w": weights(8, 4, 3, 5, 7, 8.0), "0.fc2.b": np.zeros(4),
    "0.n1.scale": np.ones(4), "0.n1.shift": np.zeros(4), "0.n2.scale": np.ones(4), "0.n2.shift": np.zeros(4), "norm.scale": np.ones(4), "norm.shift": np.zeros(4),
    "cls": weights(1, 4, 0, 3, 5, 4.0)[0], "pos": weights(17, 4, 5, 2, 7, 8.0),
}


def m2_patches(spark, d):
    """The vectors as 8 x 8 images: four patches, projected to four numbers each."""
    net = vision.Transformer(PART, PART_WEIGHTS)
    return through(spark, d, lambda x: net.patches(x.reshape(-1, 1, SIDE, SIDE)))


def m3_attention(spark, d):
    """The vectors as 16 tokens: attention of all to all, in blocks of queries and keys."""
    net = vision.Transformer(PART, PART_WEIGHTS)
    return through(spark, d, lambda x: net.attention(x.reshape(-1, 16, 4), 0))


def m4_perceptron(spark, d):
    net = vision.Transformer(PART, PART_WEIGHTS)
    return through(spark, d, lambda x: net.perceptron(x.reshape(-1, 16, 4), 0))


def m5_block(spark, d):
    """The vectors as 16 tokens through a whole block."""
    net = vision.Transformer(PART, PART_WEIGHTS)
    return through(spark, d, lambda x: net.block(x.reshape(-1, 16, 4), 0))


def m8_tokens(spark, d):
    """Class token, patches and interpolated positions of the vectors as 8 x 8 images, half the side that the positions are for."""
    net = vision.Transformer(PART, PART_WEIGHTS)
    return through(spark, d, lambda x: net.prepare(x.reshape(-1, 1, SIDE, SIDE)))


def m7_features(spark, d):
    """The class token after the whole model."""
    net = vision.Transformer(PART, PART_WEIGHTS)
    return through(spark, d, lambda x: net.features(x.reshape(-1, 1, SIDE, SIDE)))


def m10_last_attention(spark, d):
    """The last block's weights: head, token, token."""
    net = vision.Transformer(PART, PART_WEIGHTS)
    return through(spark, d, lambda x: net.last_attention(x.reshape(-1, 1, SIDE, SIDE)))


#: Shares of the mean eigenvalue, above which eigenvalues are counted.
LEVELS = (0.2, 0.5, 0.8, 1.0, 1.3, 2.0)


def w8_spectrum(spark, d):
    """How many eigenvalues of the embeddings' moments lie above levels of their mean; those above the highest by subspace iteration too."""
    rows = table(spark, d, "embeddings")
    values = linear.Whitening.fit(rows, "embedding", 64, 0.0).values
    top, _ = linear.top_directions(rows, "embedding", 8, close=1e-6)
    found = [(float(x), int((values > x * values.mean()).sum()), min(8, int((top > x * values.mean()).sum()))) for x in LEVELS]
    return spark.createDataFrame(found, "level double, above int, of_the_first_eight int")


def s3_training_table(spark, d):
    """The embeddings kept as a training table, and what is read of it."""
    path = shared_dir(spark, "training")
    table(spark, d, "embeddings").select(F.col("vec_id").alias("train_id"), "embedding", "label").write.parquet(path)
    rows = checkpoints.training_table(spark, path)
    return rows.select("train_id", "label", rounded(F.aggregate(doubles("embedding"), F.lit(0.0), lambda s, x: s + x)).alias("total"))


def m13_projection_head(spark, d):
    layers = [(weights(64, 8, 7, 3, 5, 4.0), weights(1, 8, 0, 1, 3, 8.0)[0]), (weights(8, 4, 3, 5, 7, 8.0), weights(1, 4, 0, 2, 5, 8.0)[0])]
    return through(spark, d, lambda x: vision.projection_head(x, layers, weights(3, 4, 2, 3, 5, 1.0) + 0.5))


def j1_knn_balls(spark, d):
    """The five nearest of every hundredth vector among all, by balls, the way beyond what is broadcast."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", doubles("embedding").alias("v"))
    found = balls.nearest_of_all(rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), "v"), rows.select(F.col("vec_id").alias("t"), F.col("label").cast("long").alias("l"), "v"), 5)
    return found.select(F.col("q").alias("query_id"), F.col("t").alias("train_id"), F.col("l").alias("label"), rounded(F.col("d")).alias("distance2"))


def j2_counted_places(spark, d):
    """The places of the rows of a query's label among all, by counting."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("long").alias("l"), doubles("embedding").alias("v")).dropna()
    of = lambda q, ids, places: [np.full(len(ids), q), ids, places]
    return neighbours.counted(rows.filter("i % 100 = 0"), rows, of, "query_id long, db_id long, place long")


def s6_restarted(spark, d):
    """The vectors' squared lengths in four ranges: a call that ends after two, and one that goes on; each row once, with the log's count of its range."""
    path = shared_dir(spark, "restart")
    rows = table(spark, d, "embeddings").select("vec_id", rounded(F.aggregate(doubles("embedding"), F.lit(0.0), lambda s, x: s + x * x)).alias("length2"))
    share = lambda i: rows.filter(F.pmod("vec_id", F.lit(4)) == i)
    for most in (2, None):
        restart.in_ranges(spark, path, "lengths", 4, share, most)
    out = spark.read.schema("vec_id long, length2 double, range int").parquet(f"{path}/data")
    return out.join(restart.log(spark, path).select("range", F.col("tiles").alias("of_range")), "range").select("vec_id", "length2", "range", "of_range")


def w6_log_every(spark, d):
    """Eight steps over the events, with a row of progress after each third one and the last; measures are observed in the pass that writes a step."""
    path, log, read = shared_dir(spark, "progress"), progress.Log(spark, "events"), {}
    events = table(spark, d, "events")
    for i in progress.log_every(range(8), 3, log, lambda step: read[step]()):
        rows, read[i] = progress.observed(events.filter(F.pmod("event_id", F.lit(8)) == i), total=F.sum(F.col("value").cast("decimal(20,6)")))
        rows.write.parquet(f"{path}/step={i}")
    return log.table().select("header", "step", "steps", "rows", rounded(F.col("measures")["total"], 3).alias("total"))


def s7_worker_results(spark, d):
    """Results of five workers, a CSV file each, read as one table."""
    path = shared_dir(spark, "workers")
    rows = ranges.numbered(table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("prediction")), ["k"], "i")
    n = rows.count()
    rows = rows.select(F.concat("k", F.lit(".tif")).alias("file_name"), "prediction", meters.static_worker(F.col("i"), F.lit(n), WORKERS).alias("worker"))
    rows.write.partitionBy("worker").option("header", True).csv(path)
    paths = [f"{path}/worker={w}" for w in range(WORKERS)]
    return images.read_worker_results(spark, [*paths, f"{path}/worker={WORKERS}"], skip_missing=True)


def k1_result_csv(spark, d):
    """Predictions written as CSV with a header, and what is read back."""
    path = shared_dir(spark, "results")
    rows = table(spark, d, "customer").select(F.concat(F.lit("tile, \""), "c_custkey", F.lit("\".tif")).alias("file_name"), F.col("c_nationkey").cast("long").alias("prediction"))
    images.write_results(rows, path)
    return images.read_worker_results(spark, [path])


def k2_by_country(spark, d):
    """Results kept by country: tiles and mean prediction of each, read from its own folder."""
    path = shared_dir(spark, "countries")
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    images.write_by_country(table(spark, d, "customer").join(nation, "c_nationkey").select("country", "c_custkey"), path)
    rows = spark.read.parquet(path)
    return rows.groupBy("country").agg(F.count("*").alias("tiles"), F.sum("c_custkey").cast("long").alias("keys"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and name.split("_")[0][:1] in "psjkwm" and name.split("_")[0][1:].isdigit()}

#: Grey values by place, tiles that can be read, channels of a pixel.
GREY = f"""
    g AS (SELECT vec_id, pos // {SIDE} AS y, pos % {SIDE} AS x, greatest(0, least(255, CAST(floor((CAST(embedding[pos + 1] AS DOUBLE) + 1) * 127.5) AS INTEGER))) AS q
          FROM embeddings, (SELECT unnest(range(0, {SIDE * SIDE})) AS pos) WHERE len(embedding) = {SIDE * SIDE}),
    good AS (SELECT * FROM g WHERE vec_id % {BROKEN} <> 0),
    px AS (SELECT a.vec_id, a.y, a.x, a.q AS r, 255 - a.q AS g, b.q AS b FROM good a JOIN good b ON a.vec_id = b.vec_id AND b.y = {SIDE - 1} - a.y AND b.x = {SIDE - 1} - a.x)
"""


def summed(pixels: str, side: str, black: int) -> str:
    """Sums of the channels of `pixels` (vec_id, y, x, r, g, b), and rows of zeros for tiles that are black squares of side `black`."""
    channels = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_sum, CAST(sum({c} * (y * {side} + x + 1)) AS BIGINT) AS {c}_placed" for c in "rgb")
    text = f"SELECT vec_id, true AS decode_ok, CAST({side} AS INTEGER) AS height, CAST({side} AS INTEGER) AS width, {channels} FROM {pixels} GROUP BY vec_id"
    return text + f" UNION ALL SELECT vec_id, false, {black}, {black}, 0, 0, 0, 0, 0, 0 FROM embeddings WHERE vec_id % {BROKEN} = 0"


#: Both resampling kernels are sums over all pairs of rows and columns with weights by distance.
CUBIC = """
    k AS (SELECT r, h, CASE WHEN t <= 1 THEN 1.5 * t * t * t - 2.5 * t * t + 1 WHEN t < 2 THEN -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2 ELSE 0 END AS w
          FROM (SELECT r, h, abs(h - ((r + 0.5) * 2 - 0.5)) / 2.0::DOUBLE AS t FROM (SELECT unnest(range(0, 4)) AS r), (SELECT unnest(range(0, 8)) AS h))),
    n AS (SELECT r, h, w / sum(w) OVER (PARTITION BY r) AS w FROM k)
"""
GAUSS = """
    k AS (SELECT o, exp(-0.5 * o * o) / sum(exp(-0.5 * o * o)) OVER () AS w FROM (SELECT unnest(range(-3, 4)) AS o)),
    n AS (SELECT r, greatest(0, least(7, r + o)) AS h, sum(w) AS w FROM k, (SELECT unnest(range(0, 8)) AS r) GROUP BY ALL)
"""
RESAMPLED = "s AS (SELECT vec_id, a.r AS y, b.r AS x, " + ", ".join(f"greatest(0, least(255, round_even(sum(a.w * b.w * px.{c}), 0))) AS {c}" for c in "rgb") + " FROM px JOIN n a ON a.h = px.y JOIN n b ON b.h = px.x GROUP BY vec_id, a.r, b.r)"


def cell(a: int, b: int, n: int, over: float, i: str, j: str) -> str:
    return f"((({a} * {i} + {b} * {j}) % {n} - {n // 2}) / {over}::DOUBLE)"


def erf_half(x: str) -> str:
    """gelu of a column by the same polynomial."""
    z = f"(abs({x}) / sqrt(2.0))"
    t = f"(1 / (1 + 0.3275911 * {z}))"
    poly = f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))"
    return f"0.5 * {x} * (1 + sign({x}) * (1 - {poly} * exp(-{z} * {z})))"


def normed(name: str, source: str) -> str:
    return f"{name} AS (SELECT vec_id, t, i, (v - avg(v) OVER g) / sqrt(var_pop(v) OVER g + 1e-6) AS v FROM {source} WINDOW g AS (PARTITION BY vec_id, t))"


def attention(name: str, source: str) -> str:
    """Tables name_w of weights (vec_id, t, u, h, w) and name of tokens (vec_id, t, i, v)."""
    return f"""
        {name}_qk AS (SELECT vec_id, t, j, sum(v * {cell(3, 2, 5, 1.0, "i", "j")}) AS q, sum(v * {cell(1, 3, 5, 1.0, "i", "j")}) AS k FROM {source}, (SELECT unnest(range(0, 4)) AS j) GROUP BY vec_id, t, j),
        {name}_s AS (SELECT a.vec_id, a.t, b.t AS u, a.j // 2 AS h, sum(a.q * b.k) / sqrt(2.0::DOUBLE) AS s FROM {name}_qk a JOIN {name}_qk b ON a.vec_id = b.vec_id AND a.j = b.j GROUP BY ALL),
        {name}_w AS (SELECT vec_id, t, u, h, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY vec_id, t, h) AS w FROM (SELECT *, max(s) OVER (PARTITION BY vec_id, t, h) AS m FROM {name}_s)),
        {name} AS (SELECT w.vec_id, w.t, x.i, sum(w * v) AS v FROM {name}_w w JOIN {source} x ON w.vec_id = x.vec_id AND w.u = x.t AND w.h = x.i // 2 GROUP BY w.vec_id, w.t, x.i)"""


def perceptron(name: str, source: str) -> str:
    return f"""
        {name}_a AS (SELECT vec_id, t, j, sum(v * {cell(7, 3, 5, 2.0, "i", "j")}) + (j % 3 - 1) / 8.0::DOUBLE AS a FROM {source}, (SELECT unnest(range(0, 8)) AS j) GROUP BY vec_id, t, j),
        {name} AS (SELECT vec_id, t, o AS i, sum({erf_half("a")} * {cell(3, 5, 7, 8.0, "j", "o")}) AS v FROM {name}_a, (SELECT unnest(range(0, 4)) AS o) GROUP BY vec_id, t, o)"""


def added(name: str, a: str, b: str) -> str:
    return f"{name} AS (SELECT vec_id, t, i, {a}.v + {b}.v AS v FROM {a} JOIN {b} USING (vec_id, t, i))"


def block(name: str, source: str) -> str:
    steps = [normed(f"{name}_n1", source), attention(f"{name}_y", f"{name}_n1"), added(f"{name}_x", source, f"{name}_y"), normed(f"{name}_n2", f"{name}_x"), perceptron(f"{name}_m", f"{name}_n2"), added(name, f"{name}_x", f"{name}_m")]
    return ",\n".join(steps)


TOKEN_ROWS = "SELECT vec_id, CAST(t * 4 + i AS INTEGER) AS pos, round(v, 6) + 0.0 AS v FROM "
COMPONENTS = "c AS (SELECT vec_id, pos, CAST(embedding[pos + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS pos))"
TOKENS = f"{COMPONENTS}, tok AS (SELECT vec_id, pos // 4 AS t, pos % 4 AS i, v FROM c)"
#: The class token, and patches with positions: a cubic kernel of -0.75 over the four by four grid, two by two centres.
PREPARED = f"""
    {COMPONENTS}, pt AS (SELECT vec_id, pos // 8 // 4 AS r, pos % 8 // 4 AS s, pos // 8 % 4 * 4 + pos % 4 AS i, v FROM c),
    pa AS (SELECT vec_id, r, s, j AS i, sum(v * {cell(7, 3, 5, 4.0, "i", "j")}) + (j % 3 - 1) / 8.0::DOUBLE AS v FROM pt, (SELECT unnest(range(0, 4)) AS j) GROUP BY vec_id, r, s, j),
    ce AS (SELECT r, (r + 0.5) * (4 / 2.1::DOUBLE) - 0.5 AS m, floor((r + 0.5) * (4 / 2.1::DOUBLE) - 0.5) + o AS p FROM (SELECT unnest(range(0, 2)) AS r), (SELECT unnest(range(-1, 3)) AS o)),
    ku AS (SELECT r, CAST(greatest(0, least(3, p)) AS INTEGER) AS h, abs(p - m) AS x FROM ce),
    kw AS (SELECT r, h, sum(CASE WHEN x <= 1 THEN (1.25 * x - 2.25) * x * x + 1 WHEN x < 2 THEN ((-0.75 * x + 3.75) * x - 6) * x + 3 ELSE 0 END) AS w FROM ku GROUP BY r, h),
    po AS (SELECT a.r, b.r AS s, i, sum(a.w * b.w * {cell(5, 2, 7, 8.0, "(1 + a.h * 4 + b.h)", "i")}) AS v FROM kw a, kw b, (SELECT unnest(range(0, 4)) AS i) GROUP BY a.r, b.r, i),
    tok AS (SELECT vec_id, 1 + r * 2 + s AS t, i, pa.v + po.v AS v FROM pa JOIN po USING (r, s, i)
            UNION ALL SELECT vec_id, 0, i, (3 * i % 5 - 2) / 4.0::DOUBLE + {cell(5, 2, 7, 8.0, "0", "i")} FROM embeddings, (SELECT unnest(range(0, 4)) AS i))
"""
FAR = "list_sum(list_transform(list_zip(q.v, t.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
VECTORS = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"

ORACLES = {
    "s2_decoded": f"WITH {GREY} " + summed("px", str(SIDE), images.CROP),
    "p5_resized": f"WITH {GREY}, {CUBIC}, {RESAMPLED} " + summed("s", "4", 4),
    "p6_center_crop": f"WITH {GREY}, s AS (SELECT vec_id, y - 2 AS y, x - 2 AS x, r, g, b FROM px WHERE y BETWEEN 2 AND 6 AND x BETWEEN 2 AND 6) " + summed("s", "5", 5),
    "p9_blurred": f"WITH {GREY}, {GAUSS}, {RESAMPLED} " + summed("s", str(SIDE), images.CROP),
    "m2_patches": f"""
        WITH {COMPONENTS}, p AS (SELECT vec_id, pos // 8 // 4 * 2 + pos % 8 // 4 AS patch, pos // 8 % 4 * 4 + pos % 4 AS i, v FROM c)
        SELECT vec_id, CAST(patch * 4 + j AS INTEGER) AS pos, round(sum(v * {cell(7, 3, 5, 4.0, "i", "j")}) + (j % 3 - 1) / 8.0::DOUBLE, 6) + 0.0 AS v FROM p, (SELECT unnest(range(0, 4)) AS j) GROUP BY vec_id, patch, j
    """,
    "m3_attention": f"WITH {TOKENS}, {attention('y', 'tok')} {TOKEN_ROWS} y",
    "m4_perceptron": f"WITH {TOKENS}, {perceptron('y', 'tok')} {TOKEN_ROWS} y",
    "m5_block": f"WITH {TOKENS}, {block('y', 'tok')} {TOKEN_ROWS} y",
    "m8_tokens": f"WITH {PREPARED} {TOKEN_ROWS} tok",
    "m7_features": f"WITH {PREPARED}, {block('y', 'tok')}, {normed('z', 'y')} {TOKEN_ROWS} z WHERE t = 0",
    "m10_last_attention": f"WITH {PREPARED}, {normed('n', 'tok')}, {attention('y', 'n')} SELECT vec_id, CAST((h * 5 + t) * 5 + u AS INTEGER) AS pos, round(w, 6) + 0.0 AS v FROM y_w",
    # the signs of the pivots of a symmetric elimination tell how many eigenvalues lie on each side
    "w8_spectrum": f"""
        WITH RECURSIVE v AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        m AS (SELECT list(s ORDER BY i, j) AS m FROM (SELECT i, j, avg(v[i] * v[j]) AS s FROM v, (SELECT unnest(range(1, 65)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY i, j)),
        t AS (SELECT m, list_sum(list_transform(range(64), lambda i: m[i * 65 + 1])) / 64 AS mean FROM m),
        e AS (
            SELECT level, 0 AS k, 0 AS above, list_transform(range(4096), lambda p: m[p + 1] - CASE WHEN p % 65 = 0 THEN level * mean ELSE 0 END) AS m FROM t, (VALUES {", ".join(f"({x}::DOUBLE)" for x in LEVELS)}) l(level)
            UNION ALL
            SELECT level, k + 1, above + CASE WHEN m[k * 65 + 1] > 0 THEN 1 ELSE 0 END,
                   list_transform(range(4096), lambda p: CASE WHEN p // 64 > k AND p % 64 > k THEN m[p + 1] - m[p // 64 * 64 + k + 1] * m[k * 64 + p % 64 + 1] / m[k * 65 + 1] ELSE m[p + 1] END) FROM e WHERE k < 64
        )
        SELECT level, CAST(above AS INTEGER) AS above, CAST(least(8, above) AS INTEGER) AS of_the_first_eight FROM e WHERE k = 64
    """,
    "s3_training_table": "SELECT vec_id AS train_id, CAST(label AS BIGINT) AS label, round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS total FROM embeddings",
    "m13_projection_head": f"""
        WITH {COMPONENTS}, a AS (SELECT vec_id, j, sum(v * {cell(7, 3, 5, 4.0, "pos", "j")}) + (j % 3 - 1) / 8.0::DOUBLE AS a FROM c, (SELECT unnest(range(0, 8)) AS j) GROUP BY vec_id, j),
        b AS (SELECT vec_id, o, sum({erf_half("a")} * {cell(3, 5, 7, 8.0, "j", "o")}) + (2 * o % 5 - 2) / 8.0::DOUBLE AS b FROM a, (SELECT unnest(range(0, 4)) AS o) GROUP BY vec_id, o),
        u AS (SELECT vec_id, o, b / greatest(sqrt(sum(b * b) OVER (PARTITION BY vec_id)), 1e-12) AS b FROM b),
        l AS (SELECT r, o, w / sqrt(sum(w * w) OVER (PARTITION BY r)) AS w FROM (SELECT r, o, {cell(2, 3, 5, 1.0, "r", "o")} + 0.5 AS w FROM (SELECT unnest(range(0, 3)) AS r), (SELECT unnest(range(0, 4)) AS o)))
        SELECT vec_id, CAST(r AS INTEGER) AS pos, round(sum(b * w), 6) + 0.0 AS v FROM u JOIN l USING (o) GROUP BY vec_id, r
    """,
    "j1_knn_balls": f"""
        WITH {VECTORS}, f AS (SELECT q.vec_id AS query_id, t.vec_id AS train_id, CAST(t.label AS BIGINT) AS label, {FAR} AS far FROM e q, e t WHERE q.vec_id % 100 = 0)
        SELECT query_id, train_id, label, round(far, 6) + 0.0 AS distance2 FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY far, train_id) <= 5
    """,
    "j2_counted_places": f"""
        WITH {VECTORS}, f AS (SELECT q.vec_id AS query_id, t.vec_id AS db_id, q.label = t.label AS same, row_number() OVER (PARTITION BY q.vec_id ORDER BY {FAR}, t.vec_id) - 1 AS place FROM e q, e t WHERE q.vec_id % 100 = 0)
        SELECT query_id, db_id, place FROM f WHERE same OR query_id = db_id
    """,
    "s6_restarted": "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) + 0.0 AS length2, CAST(vec_id % 4 AS INTEGER) AS range, count(*) OVER (PARTITION BY vec_id % 4) AS of_range FROM embeddings",
    "w6_log_every": """
        SELECT 'events' AS header, event_id % 8 AS step, CAST(8 AS BIGINT) AS steps, count(*) AS rows, round(CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE), 3) + 0.0 AS total FROM events
        WHERE event_id % 8 IN (0, 3, 6, 7) GROUP BY event_id % 8
    """,
    "s7_worker_results": "SELECT p_partkey || '.tif' AS file_name, CAST(p_size AS BIGINT) AS prediction FROM part",
    "k1_result_csv": "SELECT 'tile, \"' || c_custkey || '\".tif' AS file_name, CAST(c_nationkey AS BIGINT) AS prediction FROM customer",
    "k2_by_country": "SELECT n_name AS country, count(*) AS tiles, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
}

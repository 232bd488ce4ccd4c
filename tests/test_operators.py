"""Hand-computed cases for the library's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import scalars, vectors
from quern.operators import evaluation, linear, meters, neighbours, ranges, vision
from quern.plans import catalog

POINTS = [(1, 0, 0, 0), (2, 2, 0, 0), (3, 0, 2, 1), (4, -3, 0, 1), (5, 0, -4, 2), (6, 4, 0, 2), (7, 30, 1, 0), (8, 1, 30, 1)]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, [float(x), float(y)], lab) for i, x, y, lab in POINTS], "id long, v array<double>, label int")


@pytest.mark.parametrize("limit", [neighbours.BROADCAST_BYTES, 0])
def test_nearest_neighbours_ties_and_metric(spark, points, monkeypatch, limit):
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", limit)
    queries = spark.createDataFrame([(0, [0.0, 0.0]), (9, [25.0, 1.0]), (10, None)], "q long, v array<double>")
    found = neighbours.neighbours(queries, points.repartition(3), "q", "id", "v", "label", 5)
    near = {}
    for r in found.collect():
        near.setdefault(r.q, []).append((r.distance2, r.train_id))
    assert sorted(near) == [0, 9]
    assert sorted(near[0]) == [(0, 1), (4, 2), (4, 3), (9, 4), (16, 5)]  # 6 is as near as 5: the smaller id stays
    assert sorted(near[9])[0][1] == 7
    got = dict(neighbours.classify(queries, points, "q", "id", "v", "label").collect())
    assert got[0] == 0  # two votes each for 0 and 1, one for 2


def test_few_training_rows_and_missing_columns(spark, points):
    queries = spark.createDataFrame([(0, [0.0, 0.0])], "q long, v array<double>")
    assert neighbours.neighbours(queries, points.limit(2), "q", "id", "v", "label").count() == 2
    assert neighbours.neighbours(queries, points.limit(0), "q", "id", "v", "label").count() == 0
    with pytest.raises(KeyError):
        neighbours.classify(queries, points.drop("label"), "q", "id", "v", "label")


def ranking(spark):
    """Query 1 is plain, 2 has junk, 3 has no positives, 4 lacks a positive in its ranking, 5 has no positive ranked."""
    ranks = [(q, p, d) for q in (1, 2, 3, 4, 5) for p, d in enumerate((10, 11, 12, 13, 14))]
    positive = [(1, 10), (1, 12), (2, 11), (2, 13), (4, 11), (4, 99), (5, 77)]
    junk = [(2, 10), (2, 12), (4, 14)]
    return spark.createDataFrame(ranks, "query_id long, place int, db_id long"), spark.createDataFrame(positive, "query_id long, db_id long"), spark.createDataFrame(junk, "query_id long, db_id long")


def test_ranking_with_junk_and_missing_positives(spark):
    got = {r.query_id: r for r in evaluation.evaluate_ranking(*ranking(spark), [1, 3]).collect()}
    assert sorted(got) == [1, 2, 4, 5]
    assert got[1].ap == pytest.approx((1 + 1) / 4 + (1 / 2 + 2 / 3) / 4)
    assert got[2].ap == pytest.approx((1 + 1) / 4 + (1 / 1 + 2 / 2) / 4)  # without junk: places 0 and 1
    assert got[4].ap == pytest.approx((0 + 1 / 2) / 4)
    assert (got[1].p_1, got[1].p_3) == (1, pytest.approx(2 / 3))
    assert (got[2].p_1, got[2].p_3) == (1, 1)  # the last positive is at 2, which cuts 3
    assert (got[4].p_1, got[4].p_3) == (0, 0.5)
    assert got[5].ap == 0
    total = evaluation.mean_average_precision(evaluation.evaluate_ranking(*ranking(spark), [1])).first()
    assert total.map == pytest.approx(sum(r.ap for r in got.values()) / 4)
    assert evaluation.mean_average_precision(evaluation.evaluate_ranking(*(x.limit(0) for x in ranking(spark)), [1])).first().map is None


def test_average_precision_agrees_without_junk(spark):
    ranks, positive, junk = ranking(spark)
    hits = ranks.join(positive, ["query_id", "db_id"], "left_semi")
    n = positive.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    plain = dict(evaluation.average_precision(hits, "query_id", "place", n).collect())
    full = {r.query_id: r.ap for r in evaluation.evaluate_ranking(ranks, positive, junk.limit(0), []).collect()}
    assert all(full[q] == pytest.approx(ap) for q, ap in plain.items())


def test_top_k(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.5, 0.5, 0.2], 2), (2, [0.9, 0.0, 0.0, 0.0], 0), (3, [0.4, 0.3, 0.2, 0.1], 3)], "id long, s array<double>, target int")
    assert [(r.k, round(r.accuracy, 4)) for r in evaluation.top_k_accuracy(rows, "s", "target", [1, 2, 4]).collect()] == [(1, 33.3333), (2, 66.6667), (4, 100.0)]
    assert sorted((r["id"], r["class"], r["rank"]) for r in evaluation.top_scores(rows, "id", "s", 2).collect())[:2] == [(1, 1, 1), (1, 2, 2)]


def test_meter_windows(spark):
    rows = spark.createDataFrame([("m", i, float(i), 2 if i == 25 else 1) for i in range(1, 26)], "name string, at int, v double, n int")
    got = {r["at"]: r for r in meters.meter(rows, ["at"], "v", ["name"], F.col("n")).collect()}
    assert (got[1]["median"], got[4]["median"], got[5]["median"]) == (1, 2, 3)  # the lower of two
    assert (got[25]["median"], got[25]["avg"], got[25]["max"], got[25]["value_last"]) == (15, 15.5, 25, 25)
    assert got[25]["global_avg"] == pytest.approx((sum(range(1, 26)) + 25) / 26)


def test_reductions(spark):
    rows = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (0, "b", 4.0)], "worker int, name string, value double")
    assert dict(meters.reduce_metrics(rows, 2).collect()) == {"a": 2.0, "b": 2.0}
    assert dict(meters.reduce_metrics(rows, 2, average=False).collect()) == {"a": 4.0, "b": 4.0}
    assert meters.reduce_metrics(rows.filter("worker = 0"), 1).count() == 2


def test_runs(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(["x", "x", None, None, "y", "x"])], "k int, at int, v string")
    assert [(r.v, r.length, r.until) for r in ranges.runs(rows, ["at"], "v", ["k"]).orderBy("run").collect()] == [("x", 2, 2), (None, 2, 4), ("y", 1, 5), ("x", 1, 6)]


@pytest.mark.parametrize(("n", "w", "want"), [(10, 3, [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]), (3, 4, [3, 3, 3]), (8, 4, [0, 0, 1, 1, 2, 2, 3, 3])])
def test_static_ranges(spark, n, w, want):
    assert [r.w for r in spark.range(n).select("id", meters.static_worker(F.col("id"), F.lit(n), w).alias("w")).orderBy("id").collect()] == want


def test_flags(spark):
    rows = spark.createDataFrame([("on",), ("OFF",), ("True",), ("0",), ("1",), ("false",), (None,)], "s string")
    assert [r.f for r in rows.select(scalars.bool_flag(F.col("s")).alias("f")).collect()] == [True, False, True, False, True, False, None]
    for bad in ("yes", ""):
        with pytest.raises(Exception, match="invalid value"):
            spark.createDataFrame([(bad,)], "s string").select(scalars.bool_flag(F.col("s")).alias("f")).collect()


def test_parameter_rules(spark):
    rows = spark.createDataFrame([("module.a.bias", [3, 4]), ("backbone.b.weight", [4]), ("c.module.last_layer.weight", [3, 4])], "name string, shape array<int>")
    got = rows.select(scalars.decay_group(F.col("name"), F.col("shape")).alias("g"), scalars.renamed_key(F.col("name")).alias("n"), scalars.frozen_gradient(F.lit(1.0), F.col("name"), F.lit(0), 1).alias("f")).collect()
    assert [r.g for r in got] == ["not_regularized", "not_regularized", "regularized"]
    assert [r.n for r in got] == ["a.bias", "b.weight", "c.last_layer.weight"]
    assert [r.f for r in got] == [1.0, 1.0, None]


def test_schedule_and_normal(spark):
    got = [r.value for r in scalars.cosine_schedule(spark, 1.0, 0.1, 4, 5, 1, 0.0).orderBy("step").collect()]
    assert len(got) == 20 and got[0] == 0 and got[4] == 1 and got[5] == 1 and got[-1] == pytest.approx(0.1 + 0.45 * (1 + math.cos(math.pi * 14 / 15)))
    assert len(scalars.cosine_schedule(spark, 1.0, 0.1, 2, 5).collect()) == 10
    with pytest.raises(ValueError):
        scalars.cosine_schedule(spark, 1.0, 0.1, 1, 5, 2)
    values = np.array([r.value for r in scalars.truncated_normal(spark, 4000, 1.0, 2.0, -1.0, 2.0).collect()])
    assert values.min() >= -1 and values.max() <= 2 and abs(values.mean() - 0.62) < 0.06
    assert scalars.norm_cdf(np.array([0.0, 1.96])) == pytest.approx([0.5, 0.975], abs=1e-4)


def test_vectors_and_clipping(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    got = row.select(vectors.l2_norm(F.col("a")).alias("n"), vectors.dot(F.col("a"), F.col("a")).alias("d"), vectors.l2_distance(F.col("a"), F.col("b")).alias("x"), vectors.l2_normalize(F.col("a")).alias("u"), vectors.l2_normalize(F.col("b")).alias("z"), vectors.mean_of(F.col("a"), F.col("b")).alias("m")).first()
    assert (got.n, got.d, got.x, got.u, got.z, got.m) == (5, 25, 5, [0.6, 0.8], [0, 0], [1.5, 2])
    clipped = {r.k: r for r in linear.clip_gradients(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.3, 0.4])], "k int, g array<double>"), "k", "g", 1.0).collect()}
    assert clipped[1].norm == 5 and clipped[1].clipped == pytest.approx([0.6, 0.8], abs=1e-6) and clipped[2].clipped == [0.3, 0.4]


def test_whitening(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>").repartition(3)
    w = linear.Whitening.fit(rows, "v", 3)
    y = np.array([r.projected for r in w.apply(rows, ["id"], "v").collect()])
    assert np.allclose(y.T @ y / len(y), np.eye(3), atol=1e-8)
    assert w.energy == pytest.approx(100 * np.sort(np.linalg.eigvalsh(x.T @ x))[::-1][:3].sum() / np.linalg.eigvalsh(x.T @ x).sum(), rel=1e-3)
    assert linear.Whitening(np.diag([1.0, 0.0]), 2).directions.max() <= 1 / math.sqrt(linear.FLOOR) + 1e-6


def test_multi_scale_divides_by_the_norm_of_all_rows(spark):
    rows = spark.createDataFrame([(1, [3.0, 0.0], [3.0, 0.0]), (2, [0.0, 4.0], [0.0, 4.0])], "id long, a array<double>, b array<double>")
    assert {r.id: r.feature for r in linear.multi_scale(rows, ["id"], ["a", "b"]).collect()} == {1: [0.6, 0.0], 2: [0.0, 0.8]}


def test_transformer_shapes_and_determinism(spark):
    shape = vision.Shape(12, 3, 2, 4, 8, 3)
    net = vision.Transformer(shape, vision.seeded_weights(shape))
    images = np.random.default_rng(1).normal(size=(5, 3, 8, 8))
    assert shape.tokens == 5 and net.prepare(images).shape == (5, 5, 12)
    assert np.allclose(net.features(images)[2], net.features(images[2:3])[0])
    assert [x.shape for x in net.layers(images, 2)] == [(5, 5, 12)] * 2
    attention = net.last_attention(images)
    assert attention.shape == (5, 2, 5, 5) and np.allclose(attention.sum(-1), 1)
    assert net.positions(3, 3).shape == (10, 12) and net.positions(2, 2) is net.w["pos"]
    crops = [images[:2], images[2:], np.zeros((1, 3, 4, 4))]
    assert np.allclose(net.crops(crops)[:5], net.features(images)) and net.crops(crops).shape == (6, 12)
    assert vision.Shape.named("vit_base", 8).tokens == 785
    with pytest.raises(ValueError):
        vision.Shape.named("resnet")
    rows = spark.createDataFrame([(i, [float(v) for v in x.ravel()]) for i, x in enumerate(images)], "id long, p array<float>")
    got = {r.id: r.embedding for r in vision.embed(rows, ["id"], "p", net, batch=2).collect()}
    assert np.allclose(got[3], net.features(images[3:4].astype(np.float32))[0], atol=1e-5)
    head = vision.projection_head(np.abs(images.reshape(5, -1)), [(np.ones((192, 4)), np.zeros(4)), (np.eye(4), np.zeros(4))], np.eye(4) * 7)
    assert np.allclose(np.linalg.norm(head, axis=1), 1)


def test_drop_path():
    x = np.ones((400, 2, 3))
    assert vision.drop_path(x, 0.5) is x
    y = vision.drop_path(x, 0.25, np.random.default_rng(0))
    assert set(np.unique(y)) == {0, 1 / 0.75} and abs(y.mean() - 1) < 0.1 and ((y == 0).all((1, 2)) | (y > 0).all((1, 2))).all()


@pytest.mark.parametrize("limit", [neighbours.BROADCAST_BYTES, 0])
def test_rankings_reach_every_row(spark, tmp_path, monkeypatch, limit):
    """300 rows of three labels, some of them copies: about 100 positives a query, at places up to 299."""
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    x[100:150] = x[7]
    label = rng.integers(0, 3, 300)
    rows = [(i, [float(v) for v in r], None if i == 33 else int(k)) for i, (r, k) in enumerate(zip(x, label, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, ap, n_hits = {}, {}, {}
    for q in range(0, 300, 10):
        order = np.lexsort((np.arange(300), ((x - x[q]) ** 2).sum(1))).tolist()
        good = [i for i in range(300) if i not in (q, 33) and label[i] == label[q]]
        want |= {(q, i): order.index(i) for i in good}
        at = sorted(order.index(i) - (order.index(q) < order.index(i)) for i in good)
        ap[q] = sum((j / p if p else 1.0) + (j + 1) / (p + 1) for j, p in enumerate(at)) / (2 * len(at))
        n_hits[q] = [sum(p < k for p in at) / k for k in catalog.KS]
    got = {(r.query_id, r.db_id): r.place for r in catalog.j2_ranked_positives(spark, str(tmp_path)).collect()}
    assert got == want and max(got.values()) > 250
    for r in catalog.a6_ranking(spark, str(tmp_path)).collect():
        assert r.ap == pytest.approx(ap.pop(r.query_id), abs=1e-8)
        assert [r.p_1, r.p_5, r.p_10] == pytest.approx(n_hits[r.query_id])
    assert not ap


@pytest.mark.parametrize("limit", [neighbours.BROADCAST_BYTES, 0])
def test_many_copies_of_differing_labels(spark, monkeypatch, limit):
    """300 of 500 vectors are copies, whose ids fall: the five smallest ids are the neighbours, and their labels decide."""
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 8)) + 3
    x[rng.permutation(500)[:300]] = 0.1
    ids = np.arange(500)[::-1]
    copies = np.sort(ids[(x == 0.1).all(1)])
    rows = [(int(i), [float(v) for v in r], 1 if i in copies[:5] else 2) for i, r in zip(ids, x, strict=True)]
    train = spark.createDataFrame(rows, "id long, v array<double>, label int").coalesce(1)
    queries = spark.createDataFrame([(q, [0.1 + q] * 8) for q in (0, -1)], "q long, v array<double>")
    found = neighbours.neighbours(queries, train, "q", "id", "v", "label").collect()
    for q in (0, -1):
        assert sorted(r.train_id for r in found if r.q == q) == copies[:5].tolist()
    assert dict(neighbours.classify(queries, train, "q", "id", "v", "label").collect()) == {0: 1, -1: 1}


def test_static_ranges_go_by_place_where_keys_have_gaps(spark, tmp_path):
    keys = [10 * i * i + 3 for i in range(70)]
    spark.createDataFrame([(k,) for k in keys[::-1]], "o_orderkey long").repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    got = dict(catalog.w7_static_ranges(spark, str(tmp_path)).collect())
    assert got == {k: i // 10 for i, k in enumerate(keys)}


def test_interpolated_positions_take_the_guarded_scale():
    grid = np.random.default_rng(0).normal(size=(4, 4, 2))
    got = vision.resize_grid(grid, 6, 5, vision.GUARD)

    def cubic(x, a=-0.75):
        x = abs(x)
        return (a + 2) * x**3 - (a + 3) * x**2 + 1 if x <= 1 else a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a if x < 2 else 0.0

    def sample(values, at):
        low = int(np.floor(at))
        return sum(cubic(at - k) * values[min(max(k, 0), len(values) - 1)] for k in range(low - 1, low + 3))

    for i in range(6):
        for j in range(5):
            y, x = (i + 0.5) * 4 / 6.1 - 0.5, (j + 0.5) * 4 / 5.1 - 0.5
            assert np.allclose(got[i, j], sample([sample(list(row), x) for row in grid], y))
    shape = vision.Shape(8, 1, 2, 4, 16)
    net = vision.Transformer(shape, vision.seeded_weights(shape))
    assert np.allclose(net.positions(6, 5)[1:], vision.resize_grid(net.w["pos"][1:].reshape(4, 4, 8), 6, 5, 0.1).reshape(30, 8))


def test_heads_and_scales():
    rng = np.random.default_rng(1)
    x, layers, last = rng.normal(size=(3, 4)), [(rng.normal(size=(4, 5)), rng.normal(size=5)), (rng.normal(size=(5, 2)), rng.normal(size=2))], rng.normal(size=(6, 2))
    norm = vision.BatchNorm(rng.normal(size=5), rng.random(5) + 0.5, rng.normal(size=5), rng.normal(size=5))
    hidden = vision.gelu((x @ layers[0][0] + layers[0][1] - norm.mean) / np.sqrt(norm.variance + 1e-5) * norm.scale + norm.shift) @ layers[1][0] + layers[1][1]
    want = hidden / np.linalg.norm(hidden, axis=1)[:, None] @ (last / np.linalg.norm(last, axis=1)[:, None]).T
    assert np.allclose(vision.projection_head(x, layers, last, [norm]), want)
    shape = vision.Shape(8, 1, 2, 4, 16)
    net = vision.Transformer(shape, vision.seeded_weights(shape))
    crops = [rng.normal(size=(2, 3, 16, 16)), rng.normal(size=(2, 3, 8, 8))]
    assert np.allclose(net.crops(crops, lambda f: f * 2), net.crops(crops) * 2)
    same = vision.Transformer(vision.Shape(8, 1, 2, 4, 16, scale=0.5), net.w)  # a head is four wide
    assert np.allclose(same.features(crops[0]), net.features(crops[0]))
    other = vision.Transformer(vision.Shape(8, 1, 2, 4, 16, scale=0.0), net.w)
    assert np.allclose(other.last_attention(crops[0]), 1 / 17)


def test_truncated_weights():
    draws = vision.truncated_normal(np.random.default_rng(2), (20_000,), 1.5, -2, 2)
    assert np.abs(draws).max() <= 2 and (np.abs(draws) > 1.99).mean() < 0.01  # nothing gathers at the ends
    inside = np.random.default_rng(3).normal(0, 1.5, 200_000)
    assert abs(draws.std() - inside[np.abs(inside) <= 2].std()) < 0.02


def test_steps_with_momentum(spark):
    from quern.operators import linear, ranges

    rows = spark.createDataFrame([(1, [3.0, 4.0], [0.0, 1.0], [1.0, 2.0])], "id int, p array<double>, g array<double>, mu array<double>")
    got = rows.select(linear.adaptive_step(F.col("p"), F.col("g"), F.col("mu"), F.array(F.lit(1), F.lit(2)), 0.1, 0.5, 0.01).alias("s")).first().s
    decayed = np.array([1.5, 3.0])
    mu = 0.9 * np.array([1.0, 2.0]) + 0.01 * 5 / np.linalg.norm(decayed) * decayed
    assert np.allclose(got.mu, mu) and np.allclose(got.p, np.array([3.0, 4.0]) - 0.1 * mu)
    flat = rows.select(linear.adaptive_step(F.col("p"), F.col("g"), F.col("mu"), F.array(F.lit(2)), 0.1, 0.5, 0.01).alias("s")).first().s
    assert np.allclose(flat.mu, [0.9, 2.8])


@pytest.mark.parametrize("chunk_rows", [7, 40, 150])
def test_meters_of_long_series_are_cut(spark, chunk_rows):
    rng = np.random.default_rng(5)
    rows = [(i, int(t), kind, float(np.round(v, 3)), int(n)) for i, (t, kind, v, n) in enumerate(zip(rng.integers(0, 60, 300), rng.choice(["a", "b", "c", None], 300, p=[0.8, 0.1, 0.02, 0.08]), rng.normal(size=300), rng.integers(1, 4, 300)))]
    series = spark.createDataFrame(rows, "id long, ts long, kind string, v double, n int").repartition(3)
    whole, cut = (meters.meter(series, ["ts", "id"], "v", ["kind"], F.col("n"), 5, size) for size in (10_000, chunk_rows))
    names = ["id", "value_last", "median", "avg", "max", "global_avg"]
    a, b = (sorted(tuple(r[n] for n in names) for r in x.collect()) for x in (whole, cut))
    assert len(a) == len(rows) and cut.columns == whole.columns and np.allclose(a, b, atol=1e-12)
    for i, last, median, *_ in a:
        own = [r[3] for r in sorted((r for r in rows if r[2] == rows[i][2] and (r[1], r[0]) <= (rows[i][1], i)), key=lambda r: r[1::-1])][-5:]
        assert (last, median) == (own[-1], sorted(own)[(len(own) - 1) // 2])


def test_transformer_against_plain_loops():
    """Two blocks on a 4 x 4 image of two channels, every sum written out."""
    shape = vision.Shape(4, 2, 2, 2, 4, 2)
    rng = np.random.default_rng(8)
    w = {k: np.asarray(x) + rng.normal(scale=0.3, size=np.shape(x)) for k, x in vision.seeded_weights(shape).items()}
    image = rng.normal(size=(2, 4, 4))

    def linear(x, m, b):
        return [sum(x[i] * m[i][j] for i in range(len(x))) + b[j] for j in range(len(b))]

    def norm(x, scale, shift):
        mean = sum(x) / len(x)
        deviation = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x) + 1e-6)
        return [(v - mean) / deviation * s + t for v, s, t in zip(x, scale, shift)]

    tokens = [[c + p for c, p in zip(w["cls"], w["pos"][0])]]
    for r in range(2):
        for c in range(2):
            flat = [image[ch][2 * r + y][2 * c + x] for ch in range(2) for y in range(2) for x in range(2)]
            tokens.append([v + p for v, p in zip(linear(flat, w["patch.w"], w["patch.b"]), w["pos"][1 + 2 * r + c])])
    for i in range(2):
        qkv = [linear(norm(t, w[f"{i}.n1.scale"], w[f"{i}.n1.shift"]), w[f"{i}.qkv.w"], w[f"{i}.qkv.b"]) for t in tokens]
        mixed = [[0.0] * 4 for _ in tokens]
        for h in range(2):
            part = lambda t, which: qkv[t][4 * which + 2 * h : 4 * which + 2 * h + 2]  # noqa: E731, B023
            for a in range(5):
                scores = [math.exp(sum(x * y for x, y in zip(part(a, 0), part(b, 1))) / math.sqrt(2)) for b in range(5)]
                for k in range(2):
                    mixed[a][2 * h + k] = sum(s * part(b, 2)[k] for b, s in enumerate(scores)) / sum(scores)
        tokens = [[x + y for x, y in zip(t, linear(m, w[f"{i}.proj.w"], w[f"{i}.proj.b"]))] for t, m in zip(tokens, mixed)]
        for t in tokens:
            hidden = linear(norm(t, w[f"{i}.n2.scale"], w[f"{i}.n2.shift"]), w[f"{i}.fc1.w"], w[f"{i}.fc1.b"])
            hidden = [v * (1 + math.erf(v / math.sqrt(2))) / 2 for v in hidden]
            t[:] = [x + y for x, y in zip(t, linear(hidden, w[f"{i}.fc2.w"], w[f"{i}.fc2.b"]))]
    want = norm(tokens[0], w["norm.scale"], w["norm.shift"])
    assert np.allclose(vision.Transformer(shape, w).features(image[None])[0], want, atol=1e-5)


def test_whitening_against_power_iteration(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 6)) * np.array([5, 4, 3, 2, 1, 0.5])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    fitted = linear.Whitening.fit(rows, "v", 3)
    cov, values = x.T @ x / len(x), []
    left = cov.copy()
    for k in range(3):  # deflation: the largest direction of what is left
        v = np.ones(6)
        for _ in range(2000):
            v = left @ v
            v /= np.linalg.norm(v)
        values.append(v @ left @ v)
        left -= values[-1] * np.outer(v, v)
        got = fitted.directions[k]
        assert np.isclose(abs(got @ v), 1 / np.sqrt(values[-1]), rtol=1e-6) and np.isclose((got**2).sum(), 1 / values[-1], rtol=1e-6)
    assert np.isclose(fitted.energy, 100 * sum(values) / np.trace(cov), rtol=1e-6)

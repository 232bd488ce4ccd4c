"""Plans that hold at scale, against plain versions: counted places, runs and ordinals over ranges, top directions of many components."""

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import vectors
from quern.operators import balls, evaluation, linear, neighbours, ranges
from quern.plans import catalog, catalog_tiles


@pytest.fixture
def wide(spark):
    """Many partitions, none of them joined again, so that keys are cut."""
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", had)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- neighbours


def test_memory_of_nearest_does_not_go_by_the_batch():
    """4000 queries against 4096 vectors: a matrix of all of them would be 131 MB."""
    rng = np.random.default_rng(2)
    train, queries = rng.normal(size=(4096, 4)), rng.normal(size=(4000, 4))
    tracemalloc.start()
    d, at = balls.nearest(queries, np.arange(4096), train, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    for i in range(0, 4000, 401):
        want = np.argsort(((train - queries[i]) ** 2).sum(1), kind="stable")[:5]
        assert at[i].tolist() == want.tolist()


# --- places


def plain_places(queries, train):
    out = []
    for q, ql, qv in queries:
        order = sorted((sum((a - b) ** 2 for a, b in zip(qv, v, strict=True)), t, label) for t, label, v in train)
        out += [(q, t, i) for i, (_, t, label) in enumerate(order) if t == q or (ql is not None and label == ql)]
    return sorted(out)


@pytest.mark.parametrize("limit", [neighbours.BROADCAST_BYTES, 0])
@pytest.mark.parametrize("block", [4096, 16])
def test_places_are_counted(spark, monkeypatch, limit, block):
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (120, 3)).astype(float).tolist()  # many equal distances
    train = [(i, None if i % 11 == 0 else int(rng.integers(3)), v) for i, v in enumerate(x)]
    train += [(5, 1, x[9]), train[7], train[7]]  # an id with another vector, and rows that repeat
    queries = [r for r in train[:120] if r[0] % 9 == 0]
    ddl = "id long, label int, v array<double>"
    q, t = spark.createDataFrame(queries, ddl).repartition(3), spark.createDataFrame([*train, (999, 1, None)], ddl).repartition(4)
    got = neighbours.places(q, t.withColumnRenamed("id", "t_id"), "id", "t_id", "v", "label")
    assert sorted(tuple(r) for r in got.collect()) == plain_places(queries, train)


def test_no_row_for_each_pair_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", 0)
    rows = spark.range(400).select("id", (F.col("id") % 40).cast("int").alias("label"), F.array(F.rand(1), F.rand(2)).alias("v"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    got = neighbours.places(rows, rows.withColumnRenamed("id", "t_id"), "id", "t_id", "v", "label")
    assert got.count() == 400 * 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert " Window [" not in plan and "WindowGroupLimit" not in plan
    # what the exchanges carry: keys, counts and the wanted rows, never a distance for each pair
    shuffled = [line for line in plan.splitlines() if " Exchange hashpartitioning" in line]
    assert shuffled and all("own#" not in line for line in shuffled)


def test_counted_places_meet_no_rows_in_pairs(spark, monkeypatch, tmp_path):
    """Copies in all labels, and distances that products round: places as a plain version has them, and no plan that pairs rows or blocks."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "HELD", 500, raising=False)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6)) + 50
    x[rng.permutation(600)[:250]] = x[1]
    x[rng.permutation(600)[:150]] += 1e-7
    label = rng.integers(0, 4, 600)
    rows = [(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), label, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalog_tiles.j2_counted_places(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = []
    for q in range(0, 600, 100):
        order = np.lexsort((np.arange(600), ((x - x[q]) ** 2).sum(1))).tolist()
        want += [(q, int(t), order.index(t)) for t in np.flatnonzero(label == label[q])]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def group_of(rows, labels, path, monkeypatch, size=None):
    """A group of the first queries over blocks of three rows each that a list stands for, and the blocks."""
    order = np.argsort(labels, kind="stable")
    blocks = [(order[at : at + 3], labels[order[at : at + 3]], rows[order[at : at + 3]]) for at in range(0, len(rows), 3)]
    monkeypatch.setattr(neighbours, "blocks_at", lambda path, low=None, high=None: iter([b for b in blocks if low is None or (b[1].max() >= low and b[1].min() <= high)]))
    q = np.arange(size or len(rows))
    q = q[np.argsort(labels[q], kind="stable")]
    return neighbours.Group(q, labels[q], rows[q], pa.array([[]] * len(q), pa.list_(pa.int64())))


def test_products_are_sorted_and_not_searched_one_block_at_a_time(monkeypatch):
    """The rows of many blocks meet a query in one sort; only what rounding leaves open is searched for."""
    rng = np.random.default_rng(9)
    x, labels = rng.normal(size=(300, 5)), rng.integers(0, 3, 300)
    group = group_of(x, labels, None, monkeypatch, 60)
    searched, plain = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *args, **kw: searched.append(np.size(v)) or plain(a, v, *args, **kw))
    found = {q: dict(zip(ids.tolist(), at.tolist(), strict=True)) for q, ids, at in neighbours.ranked(group, None)}
    assert sum(searched) < 60 * 200 / 10  # 200 rows of other labels for each query
    for q in range(60):
        order = np.lexsort((np.arange(300), ((x - x[q]) ** 2).sum(1))).tolist()
        assert found[q] == {int(t): order.index(t) for t in np.flatnonzero(labels == labels[q])}


@pytest.mark.parametrize("most", [neighbours.HELD, 1])
@pytest.mark.parametrize("kind", ["copies", "tiny", "zeros", "long", "odd"])
def test_places_of_vectors_that_rounding_leaves_open(monkeypatch, kind, most):
    monkeypatch.setattr(neighbours, "MEET_BYTES", most, raising=False)
    rng = np.random.default_rng(10)
    x, labels = rng.normal(size=(240, 4)), rng.integers(0, 4, 240)
    x[rng.permutation(240)[:90]] = x[3]
    x[rng.permutation(240)[:60]] *= 1 + 1e-15
    if kind == "tiny":
        x *= 1e-161
    if kind == "zeros":
        x[rng.permutation(240)[:200]] = 0
    if kind == "long":
        x[rng.permutation(240)[:3]] *= 1e9
    if kind == "odd":
        x[rng.permutation(240)[:9], 1] = np.repeat([np.nan, np.inf, 1e200], 3)
    with np.errstate(all="ignore"):
        for q, ids, at in neighbours.ranked(group_of(x, labels, None, monkeypatch), None):
            order = np.lexsort((np.arange(240), ((x - x[q]) ** 2).sum(1))).tolist()
            assert dict(zip(ids.tolist(), at.tolist(), strict=True)) == {int(t): order.index(t) for t in np.flatnonzero(labels == labels[q])}


@pytest.mark.parametrize("query", ["a6_mean_average_precision", "a6_ranking", "j2_ranked_positives", "a5_average_precision"])
def test_no_row_for_each_positive_is_shuffled(spark, query):
    """A query's places become metrics, or rows of the result, in the task that counted them."""
    plan = catalog.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert not [line for line in plan.splitlines() if "Exchange" in line and "db_id" in line]


@pytest.mark.parametrize("query", ["j2_ranked_positives", "a5_average_precision"])
def test_rankings_of_copies_with_tiny_components(spark, tmp_path, query):
    """Squares that lose their last bits leave copies in all labels open, which are then computed again."""
    rng = np.random.default_rng(11)
    x, labels = rng.normal(size=(240, 4)), rng.integers(0, 4, 240)
    x[rng.permutation(240)[:90]] = x[3]
    x *= 1e-161
    rows = [(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), labels, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted(tuple(r) for r in catalog.QUERIES[query](spark, str(tmp_path)).collect())
    want = []
    for q in range(0, 240, 10):
        order = np.lexsort((np.arange(240), ((x - x[q]) ** 2).sum(1))).tolist()
        at = {int(t): order.index(t) for t in np.flatnonzero(labels == labels[q]) if t != q}
        if query == "j2_ranked_positives":
            want += [(q, t, i) for t, i in at.items()]
        else:
            terms = [((j / i if i else 1) + (j + 1) / (i + 1)) / 2 for j, i in enumerate(sorted(at.values()))]
            want.append((q, round(sum(terms) / len(terms), 9)))
    assert found == sorted(want) if query == "j2_ranked_positives" else np.allclose(found, want, rtol=0, atol=2e-9)


def test_own_places_need_no_other_rows_distances(wide, monkeypatch, tmp_path):
    """Copies across borders of partitions, zeros of both signs, and vectors without a distance to themselves."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3))
    x[rng.permutation(300)[:180]] = x[5]
    x[rng.permutation(300)[:40]] = [0.0, -0.0, 1.0]
    x[290:295] = [-0.0, 0.0, 1.0]

    def found(values):
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        rows = [(i, v, i % 3) for i, v in enumerate(values.tolist())]
        wide.createDataFrame(rows[::-1], "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
        out = [tuple(r) for r in catalog.j3_ranked_junk(wide, path).collect()]
        assert all(q == t for q, t, _ in out) and len(out) == 30
        if np.isnan(values).any():  # no vector has a distance to it, so that ids decide
            assert {r.db_id: r.place for r in catalog.j2_ranked_positives(wide, path).filter("query_id = 20").collect()} == {i: i for i in range(2, 300, 3) if i != 20}
        return {q: place for q, _, place in out}

    want = {q: int(((x[:q] == x[q]).all(1)).sum()) for q in range(0, 300, 10)}
    assert max(want.values()) > 50
    with monkeypatch.context() as m:
        m.setattr(neighbours, "places", None)  # not asked: its work is that of all pairs
        m.setattr(neighbours, "places_of", None, raising=False)
        assert found(x) == want
    x[20] = np.nan
    assert found(x) == want | {20: 20, **{q: int(((x[:q] == x[q]).all(1)).sum()) for q in want if q != 20}}


def test_sums_of_a_ranking_are_its_metrics(spark):
    rng = np.random.default_rng(6)
    ranks = [(q, p, int(t)) for q in range(4) for p, t in enumerate(rng.permutation(40))]
    good = {(q, int(t)) for q in range(3) for t in rng.permutation(40)[:9]}
    junk = {(q, int(t)) for q in range(4) for t in rng.permutation(40)[:5]} - good
    key = "query_id long, db_id long"
    out = evaluation.evaluate_ranking(spark.createDataFrame(ranks, "query_id long, place long, db_id long"), spark.createDataFrame(sorted(good), key), spark.createDataFrame(sorted(junk), key), [1, 5])
    want = {r.query_id: (r.ap, r.p_1, r.p_5) for r in out.collect()}
    assert sorted(want) == [0, 1, 2]
    for q in want:
        at, bad = (np.array([p for x, p, t in ranks if x == q and (q, t) in some]) for some in (good, junk))
        terms, *found = evaluation.ranking_sums(at, bad, [1, 5])
        assert [terms / 9, *found] == pytest.approx(want[q])
    assert evaluation.ranking_sums(np.zeros(0), np.zeros(1), [1, 5]) == [None] * 3


def test_vectors_of_different_lengths_are_named(spark):
    rows = spark.createDataFrame([(1, 1, [1.0]), (2, 1, [1.0, 2.0])], "id long, label int, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="vectors of 1 and of 2 components"):
        linear.covariance(rows, "v").collect()
    with pytest.raises(Exception, match="vectors of 1 and of 2 components"):
        neighbours.classify(rows, rows.withColumnRenamed("id", "t"), "id", "t", "v", "label").collect()
    assert vectors.matrix.__doc__


# --- balls


@pytest.mark.parametrize("rows", [64, 7])
@pytest.mark.parametrize("pivots", [16, 1])
def test_balls_find_the_nearest(spark, monkeypatch, rows, pivots):
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(balls, "BLOCK_ROWS", rows)
    monkeypatch.setattr(balls, "PIVOTS", pivots)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)).round(1)
    x[50:90] = x[3]  # copies, more than a block
    train = [(i, int(i % 4), v.tolist()) for i, v in enumerate(x)]
    queries = [(1000 + i, v) for i, (_, _, v) in enumerate(train[::5])] + [(2000, [50.0] * 5)]
    q, t = spark.createDataFrame(queries, "id long, v array<double>").repartition(3), spark.createDataFrame(train, "t long, label int, v array<double>").repartition(4)
    got = sorted((r.id, r.train_id, r.label, r.distance2) for r in neighbours.neighbours(q, t, "id", "t", "v", "label", 6).collect())
    want = []
    for i, v in queries:
        far = ((np.array(v) - x) ** 2).sum(1)
        want += [(i, int(j), int(j % 4), far[j]) for j in np.lexsort((np.arange(400), far))[:6]]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])
    few = neighbours.neighbours(q, t.limit(3), "id", "t", "v", "label", 6)
    assert few.count() == 3 * len(queries) and neighbours.neighbours(q, t.limit(0), "id", "t", "v", "label", 6).count() == 0


def test_few_blocks_of_clusters_meet(spark, monkeypatch):
    monkeypatch.setattr(balls, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(20, 8)) * 10)[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 8))
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "t long, l long, v array<double>").repartition(4)
    found, computed, pairs = balls.meetings(rows.filter("t % 3 = 0").select(F.col("t").alias("q"), "v"), rows, 5)
    assert computed.count() < pairs.count() / 2 and computed.distinct().count() == computed.count()
    assert found.filter("q = t").count() == 1000


# --- ranges


def plain_runs(rows):
    out = []
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), lambda r: r[0]):
        until = 0
        for run, (value, items) in enumerate(itertools.groupby(group, lambda r: r[2]), 1):
            n = len(list(items))
            until += n
            out.append((key, run, value, n, until))
    return sorted(out, key=repr)


@pytest.mark.parametrize("values", ["xy", "x"])
def test_runs_of_a_key_with_most_rows(wide, values):
    rng = np.random.default_rng(6)
    rows = [(1, i, str(rng.choice([*values])) if i < 900 or len(values) > 1 else None) for i in range(1200)]
    rows += [(2, i, "x") for i in range(5)] + [(None, 0, "x"), (None, 1, None), (None, 2, None), (3, 0, None)]
    df = wide.createDataFrame(rows, "k int, at int, v string").repartition(5)
    got = ranges.runs(df, ["at"], "v", ["k"])
    assert sorted(((r.k, r.run, r.v, r.length, r.until) for r in got.collect()), key=repr) == plain_runs(rows)
    spread = ranges.ranged(df, ["k", "at"]).filter("k = 1").groupBy("part").count().collect()
    assert len(spread) > 4 and max(r["count"] for r in spread) < 600


def test_ordinals_of_equal_keys(wide):
    rows = [(7,)] * 500 + [(i,) for i in range(100)] + [(None,)] * 3
    got = ranges.numbered(wide.createDataFrame(rows, "k int").repartition(4), ["k"], "i").collect()
    assert sorted(r.i for r in got) == list(range(603))
    assert [r.k for r in sorted(got, key=lambda r: r.i)] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k or 0))
    assert ranges.numbered(wide.createDataFrame([], "k int"), ["k"], "i").collect() == []


# --- directions


def test_top_directions_agree_with_the_full_solver(spark, monkeypatch):
    monkeypatch.setattr(linear, "BAND", 16)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 60)) @ np.diag(np.linspace(3, 0.2, 60)) @ np.linalg.qr(rng.normal(size=(60, 60)))[0]
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(5)
    exact = np.linalg.eigh(x.T @ x / len(x))
    values, found = linear.top_directions(rows, "v", 6, close=1e-13)
    assert np.allclose(values, exact[0][::-1][:6], rtol=1e-8) and np.allclose(np.abs((found * exact[1][:, ::-1][:, :6]).sum(0)), 1, atol=1e-6)
    whole, thin = linear.Whitening.fit(rows, "v", 6), linear.Whitening.fit(rows, "v", 6, full=10)
    assert thin.energy == pytest.approx(whole.energy, rel=1e-6)
    y = np.array([r.projected for r in thin.apply(rows, ["id"], "v").collect()])
    assert np.allclose(y.T @ y / len(y), np.eye(6), atol=1e-6)


def test_directions_of_50000_components(spark):
    def made(batches):
        import pyarrow as pa

        u = np.random.default_rng(1).normal(size=(3, 50_000))
        u = np.linalg.qr(u.T)[0].T
        for batch in batches:
            for i in batch.column(0).to_pylist():
                row = np.random.default_rng(i).normal(size=3) * [9, 4, 1] @ u
                yield pa.RecordBatch.from_arrays([pa.array([row.tolist()])], names=["v"])

    rows = spark.range(60).repartition(4).mapInArrow(made, "v array<double>")
    values, found = linear.top_directions(rows, "v", 2)
    x = np.array([np.random.default_rng(i).normal(size=3) * [9, 4, 1] for i in range(60)])
    assert found.shape == (50_000, 2) and np.allclose(values, np.linalg.eigvalsh(x.T @ x / 60)[::-1][:2])

"""Ball queries, exact neighbours and affinities against brute force, with hot tiles and copies."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from flowlens.operators import knn, landmarks
from flowlens.operators import neighbours as near
from flowlens.session import work_path

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frames(spark, queries, train):
    q = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(queries)],
                              "flow_id long, x double, y double")
    t = spark.createDataFrame([(float(x), float(y), int(c)) for x, y, c in train], "x double, y double, label int")
    return q, t


def brute(queries, train, eps):
    out = {}
    for i, (x, y) in enumerate(queries):
        for tx, ty, c in train:
            if (tx - x) * (tx - x) + (ty - y) * (ty - y) <= eps * eps:
                out[i, int(c)] = out.get((i, int(c)), 0) + 1
    return out


def counted(df):
    return {(r.flow_id, r.label): r.n for r in df.collect()}


@SLOW
@given(seed=st.integers(0, 10_000), eps=st.sampled_from([0.003, 0.05, 0.3, 2.0]))
def test_ball_counts_equal_brute_force(spark, seed, eps):
    rng = np.random.default_rng(seed)
    queries = rng.random((40, 2))
    train = np.column_stack([rng.random((300, 2)), rng.integers(0, 3, 300)])
    q, t = frames(spark, queries, train)
    assert counted(near.eps_label_counts(q, t, eps)) == brute(queries, train, eps)


def test_hot_tile_and_copies(spark, monkeypatch):
    """A third of all rows in one tile, many of them copies, and tiles split over several keys."""
    monkeypatch.setattr(near, "_POINTS_PER_KEY", 8)
    rng = np.random.default_rng(1)
    hot = np.column_stack([0.5 + rng.random((150, 2)) * 0.01, rng.integers(0, 2, 150)])
    copies = np.tile([[0.505, 0.505, 1]], (100, 1))
    train = np.vstack([hot, copies, np.column_stack([rng.random((200, 2)), rng.integers(0, 2, 200)])])
    queries = np.vstack([hot[:60, :2], np.tile([[0.505, 0.505]], (20, 1)), rng.random((20, 2))])
    q, t = frames(spark, queries, train)
    for eps in (0.004, 0.05):
        assert counted(near.eps_label_counts(q, t, eps)) == brute(queries, train, eps)


def test_closed_ball_zero_radius_and_empty_ball(spark):
    queries, train = [(0.0, 0.0), (1.0, 1.0), (-0.0, 0.0)], [(0.25, 0.0, 4), (0.0, 0.0, 2), (-0.0, 0.0, 2), (0.0, 0.25, 7)]
    q, t = frames(spark, queries, train)
    assert counted(near.eps_label_counts(q, t, 0.25)) == {(i, c): n for i in (0, 2) for c, n in ((2, 2), (4, 1), (7, 1))}
    assert counted(near.eps_label_counts(q, t, 0.0)) == {(0, 2): 2, (2, 2): 2}
    with pytest.raises(ValueError):
        near.eps_label_counts(q, t, -1.0)


def test_ties_go_to_the_smaller_label_and_empty_predicts_minus_one(spark):
    q, t = frames(spark, [(0.0, 0.0), (5.0, 5.0)], [(0.1, 0.0, 6), (0.0, 0.1, 3)])
    model = near.EpsNeighbourClassifier(label="label").fit(t)
    out = {r.flow_id: r for r in model.explain(q, 0.2, [3, 6]).collect()}
    assert (out[0].predicted, out[0].p_3, out[0].p_6, out[0].neighbours) == (3, 0.5, 0.5, 2)
    assert out[0].density == pytest.approx(10) and out[0].outlierness == pytest.approx(0.1)
    assert (out[1].predicted, out[1].neighbours, out[1].density, out[1].outlierness) == (-1, 0, 0.0, None)
    assert [r.probability for r in model.predict_proba(q, 0.2).collect()] == [0.5, 0.5]
    assert {r.density for r in model.explain(q, 0.0).collect()} == {None}


def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")


def brute_knn(x, k):
    out = {}
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(1)
        order = sorted((d[j], j) for j in range(len(x)) if j != i)[:k]
        out[i] = [j for _, j in order]
    return out


@pytest.mark.parametrize("pivots,block", [(1, 4096), (6, 16)])
def test_exact_knn_with_copies(spark, pivots, block):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (80, 3)), np.tile(rng.normal(0, 1, (1, 3)), (40, 1)),
                   np.round(rng.normal(0, 1, (60, 3)))])
    x = x[rng.permutation(len(x))]
    rows = knn.exact_knn(vectors(spark, x), 7, pivots=pivots, block=block).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.row_id, r["rank"])):
        got.setdefault(r.row_id, []).append(r.neighbour)
    assert got == brute_knn(x, 7)


def test_exact_knn_copies_no_rows(spark, monkeypatch):
    """Several slices, blocks far away, more copies than neighbours: no step has more rows than the table has."""
    monkeypatch.setattr(knn.passes, "SLICE_BYTES", 400)
    steps = []
    for module in (knn, knn.passes):
        monkeypatch.setattr(module, "written", lambda df, *a, f=module.written, **b: steps.append(f(df, *a, **b)) or steps[-1])
    counts = []
    for module in (knn, knn.passes):
        monkeypatch.setattr(module, "drop_written", lambda *t, f=module.drop_written: counts.extend(x.count() for x in t) or f(*t))
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.1, (30, 2)) for c in (0, 50, 1e6)] + [np.full((20, 2), 3.25), np.full((9, 2), 1e6)])
    rows = knn.exact_knn(vectors(spark, x), 4, pivots=5, block=16)
    plan = rows._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and len(steps) > 6 and max(counts) <= len(x)
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.row_id, r["rank"])):
        got.setdefault(r.row_id, []).append((r.neighbour, r.d2))
    want = brute_knn(x, 4)
    assert {i: [b for b, _ in f] for i, f in got.items()} == want
    assert all(d2 == np.square(x[i] - x[b]).sum() for i, f in got.items() for b, d2 in f)


def test_exact_knn_of_ids_that_repeat(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 0.0]), (3, [4.0, 0.0])], "row_id int, features array<float>")
    found = knn.exact_knn(df, 2)
    assert dict(found.dtypes)["row_id"] == "int"
    assert sorted((r.row_id, r["rank"], r.neighbour) for r in found.collect()) == [
        (1, 0, 2), (1, 0, 2), (2, 0, 3), (2, 1, 1), (3, 0, 2), (3, 1, 1)]


def test_knn_of_small_tables(spark):
    assert knn.exact_knn(vectors(spark, np.zeros((0, 2))), 3).count() == 0
    rows = knn.exact_knn(vectors(spark, np.array([[0.0, 0], [1, 0], [1, 0]])), 5).collect()
    assert sorted((r.row_id, r["rank"], r.neighbour) for r in rows) == [
        (0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 0), (2, 0, 1), (2, 1, 0)]


def test_affinities_hit_the_perplexity():
    rng = np.random.default_rng(0)
    for scale in (1e-6, 1.0, 1e6):
        shares, _ = landmarks.affinities(rng.random((20, 40)) * scale, 12.0)
        entropy = -(shares * np.log(np.maximum(shares, 1e-300))).sum(axis=1)
        assert shares.sum(axis=1) == pytest.approx(np.ones(20))
        assert np.exp(entropy) == pytest.approx(np.full(20, 12.0), rel=1e-6)


def test_affinity_graph_is_symmetric_and_sums_to_one(spark):
    x = np.random.default_rng(2).normal(0, 1, (60, 4))
    p = {(r.a, r.b): r.p for r in knn.knn_affinity(vectors(spark, x), 5.0).collect()}
    assert sum(p.values()) == pytest.approx(1.0)
    assert all(p[b, a] == pytest.approx(v) for (a, b), v in p.items())


def test_affinities_search_the_neighbours_once(spark):
    """Both directions read shares that are written; the search is not in the plan twice."""
    x = np.random.default_rng(2).normal(0, 1, (40, 3))
    graph = knn.knn_affinity(vectors(spark, x), 5.0)
    assert "ArrowEvalPython" not in graph._jdf.queryExecution().toString() and graph.count() > 0


def test_landmark_bound(spark):
    with pytest.raises(ValueError):
        landmarks.choose_landmarks(spark.range(5), "id", landmarks.MAX_LANDMARKS + 1)


def test_sample_does_not_depend_on_size_shortcuts(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    few = [r.k for r in landmarks.hash_sample(df, "k", 50).collect()]
    assert few == [r.k for r in landmarks.hash_sample(df.repartition(3), "k", 2000).collect()][:50]


@pytest.fixture(scope="module")
def stored(spark):
    """Points in cells of all sizes, one spot with many copies, one cell with many spots; the index built and stored."""
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.random((3000, 2)) * 3 - 1, 0.5 + rng.random((6000, 2)) * 0.004, np.full((500, 2), 0.25)])
    rows = [(i, float(x), float(y), int(i % 4)) for i, (x, y) in enumerate(at)]
    points = spark.createDataFrame(rows, "flow_id long, x double, y double, category int").repartition(4)
    built = near.EpsNeighbourClassifier().fit(points).prepare(0.05)
    return points, built, built.store(0.05, work_path(spark, "t-index"))


@pytest.mark.parametrize("few", [1000, 100_000, 0])
def test_stored_index_answers_like_the_built_one(spark, stored, few, monkeypatch):
    points, built, model = stored
    monkeypatch.setattr(near, "FEW_SPOTS", few)
    odd = spark.createDataFrame([(-1, None, 0.1, 0), (-2, float("nan"), 0.1, 0), (-3, 90.0, -90.0, 0), (-4, -0.0, 0.0, 0)], points.schema)
    asked = points.where("flow_id % 9 = 0 OR flow_id > 9400").unionByName(odd).unionByName(points.where("flow_id = 9"))
    names = ["flow_id", "neighbours", "predicted", "density", "p_0", "p_3"]
    want = built.explain(asked, 0.05, [0, 1, 2, 3]).select(names).orderBy("flow_id").collect()
    assert model.explain(asked, 0.05, [0, 1, 2, 3]).select(names).orderBy("flow_id").collect() == want
    assert len(want) == asked.count() and [r.neighbours for r in want if -4 < r.flow_id < 0] == [0, 0, 0]


def test_few_flows_read_their_regions_and_move_nothing_stored(spark, stored):
    points, _, model = stored
    counts = model._index(0.05).spot_counts(points.where("flow_id = 7"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert scans and all("region" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)
    # the only exchanges are broadcasts of the query side and the final sum
    assert "Exchange hashpartitioning(cx" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_stored_radius_and_empty_tables(spark, stored):
    points, built, model = stored
    with pytest.raises(ValueError, match="radius"):
        model.explain(points, 0.1)
    with pytest.raises(ValueError, match="radius of 0"):
        near.EpsNeighbourClassifier().fit(points).store(0.0, work_path(spark, "t-index"))
    assert model.explain(points.limit(0), 0.05).count() == 0
    nothing = near.EpsNeighbourClassifier().fit(points.limit(0)).store(0.05, work_path(spark, "t-index"))
    assert {r.predicted for r in nothing.explain(points.limit(3), 0.05).collect()} == {-1}

import numpy as np
import pytest

from granary.operators import neighbours as nb


def table(spark, frame, points, **columns):
    df = frame("id long", id=range(len(points)))
    from granary.session import local_frame

    rows = [(i, [float(v) for v in p], *[c[i] for c in columns.values()]) for i, p in enumerate(points)]
    extra = "".join(f", {c} double" for c in columns)
    return local_frame(df.sparkSession, rows, f"id long, features array<double>{extra}")


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(21)
    clumps = [rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (3, 3), (0, 4))]
    same = np.full((60, 2), 1.5)
    return np.round(np.vstack([*clumps, same, rng.uniform(-2, 6, (40, 2))]), 1)


def brute_dbscan(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = d <= eps
    core = near.sum(1) >= m
    far = 10**9
    label = np.where(core, np.arange(len(x)), far)
    while True:
        lowest = np.where(near & core[None, :], label[None, :], far).min(1)
        new = np.where(core, lowest, far)
        if (new == label).all():
            break
        label = new
    out = np.where(core, label, lowest)
    return np.where(out == far, -1, out), core


@pytest.mark.parametrize("block, most", [(2000, 4), (23, 4), (23, 0)])
def test_density_clusters_equal_brute_force(spark, frame, points, monkeypatch, block, most):
    monkeypatch.setattr(nb, "BLOCK", block)
    monkeypatch.setattr(nb.density, "BLOCK", block)
    monkeypatch.setattr(nb.density, "MAX_DIMENSIONS", most)
    df = table(spark, frame, points)
    got = nb.dbscan(df, "features", 0.35, 5, "id").toPandas().sort_values("id")
    label, core = brute_dbscan(points, 0.35, 5)
    assert (got.cluster.to_numpy() == label).all()
    assert (got.is_core.to_numpy() == core).all()
    assert len(set(label)) > 3


@pytest.mark.parametrize("d", [1, 3])
def test_density_clusters_on_a_grid_of_other_dimensions(spark, frame, d):
    rng = np.random.default_rng(d)
    x = np.round(np.vstack([rng.normal(c, 0.4, (70, d)) for c in (0, 2.2, -3)] + [rng.uniform(-4, 4, (60, d))]), 2)
    got = nb.dbscan(table(spark, frame, x), "features", 0.3, 4, "id").toPandas().sort_values("id")
    label, core = brute_dbscan(x, 0.3, 4)
    assert (got.cluster.to_numpy() == label).all() and (got.is_core.to_numpy() == core).all()


def test_cells_that_only_some_points_link(spark, frame, monkeypatch):
    """Two rings of points whose outermost ones are far apart, but some inner ones are close."""
    monkeypatch.setattr(nb.density, "BLOCK", 7)
    rng = np.random.default_rng(8)
    x = np.vstack([rng.uniform((0, 0), (0.7, 0.7), (40, 2)), rng.uniform((1.35, 0), (2.0, 0.7), (40, 2)), [[0.69, 0.3], [1.4, 0.3]]])
    for eps in (0.7, 0.8, 1.0):
        got = nb.dbscan(table(spark, frame, x), "features", eps, 3, "id").toPandas().sort_values("id")
        label, _ = brute_dbscan(x, eps, 3)
        assert (got.cluster.to_numpy() == label).all()


def test_density_of_odd_vectors(spark):
    rows = [(i, [0.1 * i, 0.0]) for i in range(5)] + [(7, None), (8, [float("nan"), 0.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in nb.dbscan(df, "features", 0.15, 3, "id").collect()}
    assert got == {0: (1, False), 1: (1, True), 2: (1, True), 3: (1, True), 4: (1, False), 7: (-1, False), 8: (-1, False), 9: (-1, False)}
    assert nb.dbscan(df.limit(0), "features", 0.15, 3, "id").count() == 0


def test_density_clusters_without_ids(spark, frame, points):
    got = nb.dbscan(table(spark, frame, points).drop("id"), "features", 0.35)
    label, _ = brute_dbscan(points, 0.35, 5)
    want = sorted(np.unique(label[label >= 0], return_counts=True)[1])
    sizes = got.where("cluster >= 0").groupBy("cluster").count().toPandas()["count"]
    assert sorted(sizes) == want
    assert got.where("cluster = -1").count() == (label == -1).sum()


@pytest.mark.parametrize("block", [2000, 31])
@pytest.mark.parametrize("task", ["classification", "regression"])
def test_neighbours_equal_brute_force(spark, frame, points, monkeypatch, block, task):
    monkeypatch.setattr(nb, "BLOCK", block)
    y = np.random.default_rng(22).integers(0, 3, len(points)).astype(float)
    train = table(spark, frame, points[:200], label=y[:200])
    test = table(spark, frame, points[200:])
    got = nb.knn_predict(train, test, 5, task).toPandas().sort_values("id").prediction.to_numpy()
    d = np.sqrt(((points[200:, None] - points[None, :200]) ** 2).sum(2))
    want = []
    for row in d:
        near = y[:200][np.lexsort((y[:200], row))[:5]]
        want.append(np.bincount(near.astype(int)).argmax() if task == "classification" else near.mean())
    assert got == pytest.approx(want)


def test_fewer_training_rows_than_k(spark, frame):
    train = table(spark, frame, [[0.0], [10.0]], label=[1.0, 3.0])
    test = table(spark, frame, [[1.0]])
    assert nb.knn_predict(train, test, 5, "regression").first()["prediction"] == 2.0


@pytest.mark.parametrize("small", [100_000, 0])
def test_components_of_chains_hubs_and_nothing(spark, small):
    from granary.operators.components import components

    rng = np.random.default_rng(2)
    pairs = [(i, i + 1) for i in range(200, 260)] + [(1, i) for i in range(2, 80)]
    pairs += [tuple(map(int, p)) for p in rng.integers(300, 600, (150, 2))] + [(7, 7)]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    links = spark.createDataFrame([*pairs, (None, 5)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links, small).collect()}
    assert found == {n: r for n, r in root.items() if n != r}
    assert components(links.where("a < 0"), small).count() == 0


@pytest.fixture(scope="module")
def clumps():
    rng = np.random.default_rng(31)
    centres = rng.normal(0, 4, (40, 24))
    return np.vstack([c + rng.normal(0, 0.4, (60, 24)) for c in centres])


def keyed(spark, x, name):
    from granary.session import local_frame

    rows = [(f"{name}{i}", [float(v) for v in p], float(i), 1) for i, p in enumerate(x)]
    return local_frame(spark, rows, "key string, vec array<double>, label double, weight long")


@pytest.mark.parametrize("block", [2000, 9])
def test_hashed_neighbours_find_most_with_few_distances(spark, clumps, monkeypatch, block):
    monkeypatch.setattr(nb.hashed, "BLOCK", block)
    asked = clumps[::20] if block > 100 else clumps[::200]
    train, queries = keyed(spark, clumps, "t"), keyed(spark, asked, "q").select("key", "vec")
    tables = nb.hashed.fit_tables(train, tables=2, bits=20, probes=32)
    sizes = nb.hashed.met_buckets(train.withColumnRenamed("key", "tkey"), queries, tables)[2]
    assert nb.hashed.compared_pairs(sizes) < 0.1 * len(asked) * len(clumps)
    d = np.sqrt(((asked[:, None] - clumps[None]) ** 2).sum(2))
    want = {(f"q{i}", float(j)) for i, row in enumerate(d) for j in np.argsort(row, kind="stable")[:5]}
    got = {(r["key"], r["label"]) for r in nb.nearest_approximately(train, queries, 5, tables=2, bits=20, probes=32).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_hashed_neighbours_with_all_probes_are_exact(spark, frame, points):
    y = np.random.default_rng(22).integers(0, 3, len(points)).astype(float)
    train, test = table(spark, frame, points[:200], label=y[:200]), table(spark, frame, points[200:])
    exact = nb.knn_predict(train, test, 5).select("id", "prediction")
    found = nb.knn_predict(train, test, 5, method="hashed", tables=1, bits=3, probes=8).select("id", "prediction")
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, found.collect()))
    # too few in a bucket: these queries go through the exact search
    few = nb.knn_predict(train, test, 5, method="hashed", tables=1, bits=12, probes=1).select("id", "prediction")
    assert few.count() == len(points) - 200
    none = nb.knn_predict(train.limit(0), test, 5, method="hashed")
    assert none.count() == 0


def test_a_vector_travels_once_to_a_bundle_of_cells(spark, frame, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 300)
    monkeypatch.setattr(nb, "_SLAB", 2_000)  # a few visits a batch
    x = np.random.default_rng(5).normal(size=(900, 16))
    rows = table(spark, frame, x).selectExpr("cast(id as string) as key", "features as vec")
    points, cells = nb._cell_points(rows)
    visits = nb._visits(points, cells, lambda pdf, d: np.ones(d.shape, bool))
    assert cells.bundles <= 5 and len(cells.pivots) == 30
    assert visits.count() == visits.distinct().count() == 900 * cells.bundles
    found = nb.knn_predict(table(spark, frame, x, label=np.arange(900.0)), table(spark, frame, x), 1)
    assert found.where("prediction = id").count() == 900


def test_first_places_as_a_full_sort_gives_them():
    rng = np.random.default_rng(6)
    d, labels = rng.integers(0, 6, (50, 40)).astype(float), rng.integers(0, 3, 40).astype(float)
    for take in (1, 5, 40):
        order = np.lexsort((np.broadcast_to(labels, d.shape), d), axis=1)[:, :take]
        found = nb._first(d, labels, take)
        assert (np.take_along_axis(d, found, 1) == np.take_along_axis(d, order, 1)).all()
        assert (labels[found] == labels[order]).all()


def found_rows(df):
    return sorted((r["key"], r["place"], r["distance"], r["label"], r["weight"]) for r in df.collect())


@pytest.mark.parametrize("block, width", [(2000, 2), (17, 2), (300, 40)])
def test_nearest_by_files_as_by_visits(spark, points, monkeypatch, block, width):
    monkeypatch.setattr(nb, "BLOCK", block)
    if width == 2:  # many ties, every other vector one that single precision holds
        x = np.vstack([points, np.round(points[:50] * 4) / 4 + 7])
    else:
        x = np.random.default_rng(9).normal(size=(700, width)).astype("f4").astype(float)
    x = np.unique(x, axis=0)
    train, queries = keyed(spark, x, "t"), keyed(spark, x[::3] + 0.01, "q").select("key", "vec")
    want = found_rows(nb._nearest_by_visits(train, queries, 4))

    def refused(*_):
        raise AssertionError("vectors were moved to bundles")

    monkeypatch.setattr(nb, "_visits", refused)
    found = found_rows(nb.nearest(train, queries, 4))
    assert found == want  # to the last bit
    assert len(found) == 4 * len(x[::3])


def test_best_of_odd_vectors():
    rng = np.random.default_rng(10)
    asked = np.vstack([rng.normal(size=(6, 3)), [[1e200, 0, 0], [np.inf, 1, 1], [np.nan, 0, 0], [1e9, 1e9, 1e9]]])
    held = np.vstack([rng.normal(size=(30, 3)), rng.normal(size=(9, 3)) * 1e-9 + 1e9, [[1e200, 1, 1], [np.nan, 1, 1], [-1e200, 0, 0]]])
    label = rng.integers(0, 3, len(held)).astype(float)
    weight = np.arange(1, len(held) + 1)
    with np.errstate(all="ignore"):
        best = nb._Best(asked, 5)
        for i in range(0, len(held), 4):
            best.offer(np.arange(len(asked)), held[i : i + 4], label[i : i + 4], weight[i : i + 4])
        d = nb.distances(asked, held)
    order = np.lexsort((np.broadcast_to(label, d.shape), d), axis=1)[:, :5]
    assert np.array_equal(best.distance, np.take_along_axis(d, order, 1), equal_nan=True)
    finite = np.isfinite(best.distance)
    assert (best.label[finite] == label[order][finite]).all() and not best.empty.any()


def test_points_in_files_take_no_more_than_the_points(spark, tmp_path):
    x = np.random.default_rng(11).normal(size=(3000, 8)).astype("f4").astype(float)
    pieces, cells = nb._written(keyed(spark, x, "t"), str(tmp_path))
    assert cells.counts.sum() == 3000 and (cells.radii[cells.counts > 0] >= 0).all()
    assert sum(f.stat().st_size for f in tmp_path.iterdir()) == 3000 * (8 * 4 + 16)
    read = [np.column_stack(p.read(8)) for bundle in pieces for p in bundle]
    want = np.column_stack([x, np.arange(3000.0), np.ones(3000)])
    assert (np.vstack(read)[np.argsort(np.vstack(read)[:, 8])] == want).all()

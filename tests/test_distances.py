"""Neighbours and clusterings against brute force, with copies of rows and tiny block sizes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayglass.operators import centres, dbscan, neighbours


def _cloud(n, axes, seed, copies=True):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, axes)), 2)
    if copies:
        x[: n // 3] = x[0]  # a third of the rows are copies
    return x


def _frame(spark, x, first=0, label=None):
    rows = [(first + i, *map(float, r), int((i * 7) % 3 == 0) if label is None else int(label[i])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, " + ", ".join(f"a{i} double" for i in range(x.shape[1])) + ", y int")


def _distances(a, b, metric):
    if metric == "manhattan":
        return np.abs(a[:, None] - b[None]).sum(-1)
    if metric == "cosine":
        return 1 - (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None])
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_knn_is_exact(spark, monkeypatch, metric, weights):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    train, asked, k = _cloud(300, 3, 1) + 3, _cloud(60, 3, 2) + 3, 7
    asked[:5] = train[:5]
    y = np.array([int((i * 7) % 3 == 0) for i in range(len(train))])
    got = neighbours.knn_regress(
        _frame(spark, train), _frame(spark, asked, first=1000), "row_id", ["a0", "a1", "a2"], "y", k, weights, metric
    ).toPandas().set_index("row_id").prediction
    d = np.round(_distances(asked, train, metric), 9)
    assert len(got) == len(asked)
    for i in range(len(asked)):
        best = np.lexsort((np.arange(len(train)), d[i]))[:k]
        near = d[i][best]
        if weights == "uniform":
            expected = y[best].mean()
        elif (near <= 0).any():
            expected = y[best][near <= 0].mean()
        else:
            expected = (y[best] / near).sum() / (1 / near).sum()
        assert abs(got[1000 + i] - expected) < 1e-5, (metric, weights, i)


def test_knn_with_more_neighbours_than_rows(spark):
    train, asked = _cloud(6, 2, 3), _cloud(4, 2, 4)
    got = neighbours.nearest_rows(_frame(spark, train), _frame(spark, asked, 100), "row_id", ["a0", "a1"], 10)
    assert got.count() == 24


def test_copies_of_a_query_are_asked_once(spark, monkeypatch):
    seen, compared = [], neighbours._compared

    def counted(visits, pieced, *more):
        seen.append((visits.select("id").distinct().count(), pieced.count()))
        return compared(visits, pieced, *more)

    monkeypatch.setattr(neighbours, "_compared", counted)
    train, asked = _cloud(40, 2, 6).repeat(4, axis=0), _cloud(3, 2, 7).repeat(70, axis=0)
    got = neighbours.nearest_rows(_frame(spark, train), _frame(spark, asked, 1000), "row_id", ["a0", "a1"], 6).toPandas()
    assert max(n for n, _ in seen) <= 3 and max(n for _, n in seen) <= 40
    d = np.round(_distances(asked, train, "euclidean"), 9)
    for i in range(len(asked)):
        best = np.lexsort((np.arange(len(train)), d[i]))[:6]
        assert got[got["query"] == 1000 + i].sort_values("position")["neighbour"].tolist() == best.tolist()


def _brute_dbscan(x, eps, m, metric):
    near = _distances(x, x, metric) <= eps
    core = near.sum(1) >= m
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = label.copy()
        for i in np.flatnonzero(core):
            new[i] = label[near[i] & core].min()
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(~core):
        around = near[i] & core
        label[i] = label[around].min() if around.any() else -1
    return label


@pytest.mark.parametrize(
    "metric, axes, eps, m, pairs",
    [("euclidean", 2, 0.31, 4, 4096), ("euclidean", 2, 0.9, 6, 4), ("manhattan", 2, 0.43, 5, 9), ("euclidean", 3, 0.57, 5, 4), ("euclidean", 5, 1.37, 4, 16), ("manhattan", 6, 2.5, 4, 64)],
)
def test_dbscan_against_brute_force(spark, monkeypatch, metric, axes, eps, m, pairs):
    monkeypatch.setattr(dbscan, "PAIRS", pairs)
    monkeypatch.setattr(dbscan, "BLOCK", 5)
    monkeypatch.setattr(dbscan, "HOMES", 6)
    monkeypatch.setattr(dbscan, "PIVOTS", 3)
    x = _cloud(160, axes, 5)
    x[80:100] = x[80] + np.round(np.random.default_rng(0).normal(size=(20, axes)) * 0.05, 3)
    order = np.random.default_rng(9).permutation(len(x))
    frame = _frame(spark, x).withColumnRenamed("y", "unused")
    shuffled = spark.createDataFrame([frame.collect()[i] for i in order], frame.schema)
    got = dbscan.dbscan(shuffled, "row_id", [f"a{i}" for i in range(axes)], eps, m, metric).toPandas().sort_values("row_id")
    assert got.cluster.tolist() == _brute_dbscan(x, eps, m, metric).tolist()


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_dbscan_on_crowded_cells_compares_few_pairs(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(0, 2, (300, 2)), rng.uniform(4, 5, (80, 2)), rng.uniform(-3, 8, (20, 2)), np.full((9, 2), 4.5)])
    asked = []
    links = dbscan._links

    def counted(core, core_cells, near, grid):
        asked.append(near.count())
        return links(core, core_cells, near, grid)

    monkeypatch.setattr(dbscan, "_links", counted)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "row_id long, a0 double, a1 double")
    got = dbscan.dbscan(df, "row_id", ["a0", "a1"], 0.3, 5, metric).toPandas().sort_values("row_id")
    assert got.cluster.tolist() == _brute_dbscan(x, 0.3, 5, metric).tolist()
    # Only pairs of cells that may join clusters are left to be halved and compared.
    assert sum(asked) <= 20


@pytest.mark.parametrize("metric,most_open", [("euclidean", 1 << 17), ("manhattan", 1 << 17), ("euclidean", 0)])
def test_dbscan_above_three_axes_compares_open_cells_only(spark, monkeypatch, metric, most_open):
    monkeypatch.setattr(dbscan, "CROWD", 40)
    monkeypatch.setattr(dbscan, "STRIP", 7)
    monkeypatch.setattr(dbscan, "MOST_OPEN", most_open)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.1, (260, 4)), rng.normal(2, 0.1, (30, 4)), rng.uniform(-1, 3, (20, 4)), np.full((6, 4), 0.5)])
    eps = 0.3 if metric == "manhattan" else 0.17
    asked = []
    pairs = dbscan._open_pairs

    def counted(cells, home, grid):
        asked.append((home.count(), cells.count()))
        return pairs(cells, home, grid)

    monkeypatch.setattr(dbscan, "_open_pairs", counted)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "row_id long, a0 double, a1 double, a2 double, a3 double")
    got = dbscan.dbscan(df, "row_id", ["a0", "a1", "a2", "a3"], eps, 4, metric).toPandas().sort_values("row_id")
    assert got.cluster.tolist() == _brute_dbscan(x, eps, 4, metric).tolist()
    assert len(set(got.cluster)) > 2 and asked[0][0] < asked[0][1] / 2


def test_cover_has_all_pairs_within_reach_and_few_others(spark):
    def compared(n):
        rng = np.random.default_rng(3)
        x = rng.random((n // 20, 6)).repeat(20, axis=0) * 9 + rng.normal(size=(n // 20 * 20, 6)) * 0.05
        grid = dbscan._Grid(6, 0.2, "euclidean")
        rows = [(f"c{i}", *map(float, p), *map(float, p)) for i, p in enumerate(x)]
        cells = spark.createDataFrame(rows, "cell string, " + ", ".join(f"{c}{i} double" for c in ("lo", "hi") for i in range(6)))
        pairs = dbscan._cover_pairs(cells, grid).select("a", "b")
        near = {(f"c{a}", f"c{b}") for a, b in np.argwhere(_distances(x, x, "euclidean") <= 0.2)}
        found = [tuple(r) for r in pairs.collect()]
        assert near <= set(found) and len(found) == len(set(found))
        return len(found) / n

    few, many = compared(500), compared(2000)
    assert many < 400 and many < 1.5 * few


def test_visits_do_not_grow_with_the_rows():
    def visits(n):
        x = np.random.default_rng(n).random((n, 3))
        pieces = neighbours.Pieces.of(x[: int(n**0.5)], "euclidean")
        home, radius = pieces.nearest(x)
        table = pd.DataFrame({"home": home, "radius": radius}).groupby("home").radius.agg(["count", "min", "max"]).reindex(range(len(pieces.pivots)))
        pieces.sizes, pieces.low, pieces.high = table["count"].fillna(0).to_numpy(int), table["min"].to_numpy(), table["max"].to_numpy()
        asked = np.random.default_rng(1).random((200, 3))
        d = _distances(asked, x, "euclidean")
        found = pieces.within(asked, np.sort(d, axis=1)[:, 4])
        for i, got in enumerate(found):
            assert set(home[d[i].argsort()[:5]]) <= set(got)
        assert all(pieces.sizes[g].sum() >= 5 for g in pieces.around(asked, 5))
        return np.mean([len(f) for f in found])

    assert visits(40_000) < 1.3 * visits(4_000)


def test_rows_with_missing_coordinates_have_no_neighbours(spark):
    rows = [(i, float(i) if i % 3 else None, float("nan") if i % 5 == 0 else 1.0) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    got = neighbours.nearest_rows(df, df, "row_id", ["a", "b"], 2).toPandas()
    sound = {i for i in range(1, 40) if i % 3 and i % 5}
    assert set(got["query"]) == sound and set(got["neighbour"]) <= sound and len(got) == 2 * len(sound)


def test_components_of_a_long_chain(spark):
    n = 300
    order = np.random.default_rng(2).permutation(n)
    nodes = spark.createDataFrame([(f"n{i}", int(order[i])) for i in range(n)], "node string, seed long")
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(n - 1) if i != 150], "a string, b string")
    got = dbscan.connected(nodes, links).toPandas()
    got["i"] = got.node.str[1:].astype(int)
    left, right = got[got.i <= 150], got[got.i > 150]
    assert set(left.label) == {order[:151].min()} and set(right.label) == {order[151:].min()}


def test_seeding_finds_the_groups(spark):
    rng = np.random.default_rng(12)
    groups = rng.normal(size=(9, 4)) * 100
    sizes = [700, *[20] * 8]  # a large group does not hide the others
    x = np.concatenate([g + rng.normal(size=(n, 4)) for g, n in zip(groups, sizes)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, v array<double>")
    found = np.array(centres.seed_centres(df.repartition(9), "row_id", "v", 9))
    assert found.shape == (9, 4)
    # A draw may fall into the large group twice; the first rows would all lie in it.
    assert len(set(_distances(found, groups, "euclidean").argmin(axis=1))) >= 8
    again = centres.seed_centres(df.repartition(2), "row_id", "v", 9)
    assert np.allclose(found, again)
    assert centres.seed_centres(df.limit(0), "row_id", "v", 3) == []
    same = df.where("row_id < 5").withColumn("v", F.array(F.lit(1.0)))
    assert centres.seed_centres(same, "row_id", "v", 3) == [[1.0]]


def test_kmeans_never_gets_worse_and_keeps_empty_centres(spark):
    x = _cloud(120, 2, 6)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, x array<double>")
    spent = []
    for rounds in range(4):
        found, _ = centres.kmeans(df, "row_id", "x", 3, rounds)
        spent.append((found.toPandas().distance ** 2).sum())
    assert all(b <= a + 1e-9 for a, b in zip(spent, spent[1:]))
    far = [[0.0, 0.0], [99.0, 99.0]]
    assert centres.kmeans_step(df, "x", far)[1] == [99.0, 99.0]


def test_kmodes_handles_missing_values(spark):
    rows = [(0, "a", 1), (1, "b", None), (2, "a", 1), (3, "b", None), (4, None, 2), (5, "b", 2)]
    df = spark.createDataFrame(rows, "row_id long, c string, k int")
    got = centres.kmodes(df, "row_id", ["c", "k"], 2, 3)[0].toPandas().set_index("row_id").sort_index()
    assert got.cluster.tolist()[:4] == [0, 1, 0, 1] and got.cost.tolist()[:4] == [0, 0, 0, 0]


def test_cluster_indices_over_several_blocks(spark, monkeypatch):
    from dayglass.operators import metrics

    monkeypatch.setattr(metrics, "CLUSTER_BLOCK", 3)
    rng = np.random.default_rng(7)
    x, c = rng.normal(size=(200, 3)), rng.integers(0, 10, 200)
    df = spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(c, x)], "c int, x array<double>")
    got = metrics.cluster_indices(df, "c", "x").first()
    means = np.array([x[c == k].mean(0) for k in range(10)])
    spread = np.array([np.linalg.norm(x[c == k] - means[k], axis=1).mean() for k in range(10)])
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(means[i] - means[j]) for j in range(10) if j != i) for i in range(10)]
    within = sum(((x[c == k] - means[k]) ** 2).sum() for k in range(10))
    between = sum((c == k).sum() * ((means[k] - x.mean(0)) ** 2).sum() for k in range(10))
    assert got["clusters"] == 10
    assert abs(got["davies_bouldin"] - np.mean(worst)) < 1e-9
    assert abs(got["calinski_harabasz"] - (between / 9) / (within / 190)) < 1e-9


def test_many_modes_on_many_columns(spark):
    rng = np.random.default_rng(21)
    kinds = rng.integers(0, 4, (100, 40))
    rows = np.concatenate([kinds, kinds[rng.integers(0, 100, 400)]])
    flip = rng.random(rows.shape) < 0.05
    flip[:100] = False
    rows = np.where(flip, 9, rows)
    made = [(i, *[None if v == 3 else f"v{v}" for v in r]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(made, "row_id long, " + ", ".join(f"c{j} string" for j in range(40)))
    got, found = centres.kmodes(df, "row_id", [f"c{j}" for j in range(40)], 100, 1)
    table = got.toPandas().set_index("row_id").sort_index()
    modes = np.array([[m.modes[f"c{j}"] or "" for j in range(40)] for m in found])
    plain = np.array([["" if v == 3 else f"v{v}" for v in r] for r in rows])
    costs = (plain[:, None, :] != modes[None]).sum(-1)
    assert (table.cost.to_numpy() == costs.min(axis=1)).all() and (table.cluster.to_numpy() == costs.argmin(axis=1)).all()


def test_rows_without_a_number_belong_to_no_prototype(spark):
    df = spark.createDataFrame([(0, "a", 0.0), (1, "b", 5.0), (2, None, 5.0), (3, "a", None)], "row_id long, c string, x double")
    got, _ = centres.kprototypes(df, "row_id", ["c"], ["x"], 2, 1, gamma=0.5)
    assert {r["row_id"]: r["cluster"] for r in got.collect()} == {0: 0, 1: 1, 2: 1, 3: None}


@pytest.mark.parametrize("take", [1, 5, 40])
def test_nearest_of_a_block_without_sorting_it(take, monkeypatch):
    rng = np.random.default_rng(9)
    d = rng.random((30, 40)) * 3
    d[:, 20:] = d[:, :20] + rng.choice([0.0, 4e-10, -4e-10, 1e-9, 6e-10], (30, 20))
    d[3], d[4, 5:] = 1.25, np.inf
    rounded = np.round(d, neighbours.DIGITS)
    want = rounded.argsort(axis=1, kind="stable")[:, :take]
    row, column, near = neighbours._first(d, take)
    assert (row == np.repeat(np.arange(30), take)).all() and (column == want.ravel()).all()
    assert (near == np.take_along_axis(rounded, want, axis=1).ravel()).all()

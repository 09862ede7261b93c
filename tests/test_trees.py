"""Leaf-wise trees against trees grown by hand, and sketches against sorted values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayglass.operators import boosting
from dayglass.operators import trees as T
from dayglass.operators.sketches import KEPT, Sketch, quantile_borders, sketched_quantiles
from dayglass.plans import models as J

FEATURES = ["x", "c", "empty"]


def by_hand(bins, y, train, settings, weight):
    """Raw scores of all rows after best-first boosting, every split tried in turn."""
    w = np.where(y == 1, weight, 1.0)
    ones, zeros = (train & (y == 1)).sum() * weight, (train & (y == 0)).sum()
    raw = np.full(len(y), np.log(ones / zeros))
    for _ in range(settings.rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p)
        node, depth, live, number = np.zeros(len(y), int), {0: 0}, [0], 1
        while len(live) < settings.leaves:
            best = None
            for at in live:
                if settings.depth is not None and depth[at] >= settings.depth:
                    continue
                rows = train & (node == at)
                for f in range(bins.shape[1]):
                    for cut in range(256):
                        left = rows & (bins[:, f] <= cut)
                        right = rows & ~left
                        if min(left.sum(), right.sum()) < max(1, settings.min_rows):
                            continue
                        part = [g[x].sum() ** 2 / (h[x].sum() + settings.l2) for x in (left, right, rows)]
                        gain = round(part[0] + part[1] - part[2], 9)
                        if gain > settings.min_gain and (best is None or (-gain, at, f, cut) < best):
                            best = (-gain, at, f, cut)
            if best is None:
                break
            _, at, f, cut = best
            here = node == at
            node[here] = number + (bins[here, f] > cut)
            live.remove(at)
            live += [number, number + 1]
            depth[number] = depth[number + 1] = depth[at] + 1
            number += 2
        for at in live:
            rows = node == at
            raw[rows] -= settings.rate * g[rows & train].sum() / (h[rows & train].sum() + settings.l2)
    return raw


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n = 500
    x, c, day = rng.normal(size=n), rng.integers(0, 4, n), 50 + rng.integers(0, 5, n)
    y = (x + 0.5 * (c == 2) + rng.normal(size=n) > 0.4).astype(int)
    made = [
        (i, int(day[i]), None if day[i] == 54 else bool(y[i]), None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(x[i]), int(c[i]), None)
        for i in range(n)
    ]
    return spark.createDataFrame(made, "row_id long, day int, y boolean, x double, c int, empty double")


BORDERS = {"x": [-1.0, -0.25, 0.0, 0.3, 1.1], "c": [0.0, 1.0, 2.0], "empty": []}


@pytest.mark.parametrize(
    "settings",
    [T.LeafwiseSettings(2, 5, 0.3, 10), T.LeafwiseSettings(1, 40, 0.5, 1, depth=3), T.LeafwiseSettings(1, 6, 0.1, 30, 5.0, min_gain=1.0), T.LeafwiseSettings(2, 1)],
)
def test_trees_are_those_grown_by_hand(rows, settings, monkeypatch):
    monkeypatch.setattr(T, "PASS_BYTES", 2000 if settings.depth else 64 << 20)
    days = [50, 51, 52, 53]
    models = [T.Model(tuple(d for d in days if d != out)) for out in days] + [T.Model(tuple(days), 3.0), T.Model((50, 51))]
    grown = T.grow(rows, "row_id", "day", "y", FEATURES, BORDERS, models, settings)
    found = grown.scores.toPandas().sort_values("row_id")
    bins = np.stack([np.frombuffer(b, np.uint8) for b in found["bins"]])
    y, day, raw = found["y"].fillna(-1).to_numpy(int), found["day"].to_numpy(), np.stack(found["raw"].to_list())
    plain = rows.toPandas().sort_values("row_id")["x"].to_numpy(float)
    assert (bins[:, 0] == np.where(np.isnan(plain), 0, 1 + (np.array(BORDERS["x"])[None, :] < plain[:, None]).sum(axis=1))).all()
    assert set(bins[:, 2]) == {0}
    for k, model in enumerate(models):
        want = by_hand(bins, y, np.isin(day, model.days) & (y >= 0), settings, model.positive_weight)
        assert np.abs(raw[:, k] - want).max() < 1e-9
    later = T.predict(rows, "row_id", FEATURES, BORDERS, grown, 4, keep=["day"]).toPandas().sort_values("row_id")
    assert np.abs(later["score"].to_numpy() - 1 / (1 + np.exp(-raw[:, 4]))).max() < 1e-12


def test_passes_do_not_grow_with_the_models(rows):
    settings = T.LeafwiseSettings(2, 5, 0.3, 10)
    few, many = (T.grow(rows, "row_id", "day", "y", FEATURES, BORDERS, [T.Model((50, 51, 52, 53))] * n, settings) for n in (1, 12))
    assert few.passes == many.passes


def test_three_hundred_leaves(spark):
    bits = [F.pmod(F.shiftright(F.col("id"), i), F.lit(2)).cast("double").alias(f"b{i}") for i in range(9)]
    rows = spark.range(40_000).select("id", F.lit(1).alias("day"), *bits)
    raw = sum((F.col(f"b{i}") * (0.3 + 0.1 * i) for i in range(9)), F.lit(-3.0))
    rows = rows.withColumn("y", F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0 < 1 / (1 + F.exp(-raw)))
    names = [f"b{i}" for i in range(9)]
    grown = T.grow(rows, "id", "day", "y", names, {c: [0.5] for c in names}, [T.Model((1,))], T.LeafwiseSettings(1, 300, 0.5, 1))
    tree = grown.trees[0][0]
    assert sum(f < 0 for f in tree.feature) == 300 and grown.passes <= 20


def test_one_label_no_rows_and_too_many_bins(spark, rows):
    same = rows.where("y")
    settings = T.LeafwiseSettings(1, 4)
    for some in (same, rows.limit(0)):
        got = T.grow(some, "row_id", "day", "y", FEATURES, BORDERS, [T.Model((50,)), T.Model((99,))], settings)
        assert got.scores.count() == some.count() and all(np.isfinite(r["raw"]).all() for r in got.scores.collect())
    with pytest.raises(ValueError):
        T.bin_table(rows, "row_id", "day", "y", ["x"], {"x": [float(i) for i in range(255)]}, [0.0])


def test_day_out_models_leave_their_day_out(rows):
    settings = J.TreeSettings(1, 9, 0.3, 8, 10, leaves=4)
    got = J.day_out_model_scores(rows, ["x", "c"], "row_id", "day", [50, 51, 52, 53], settings, "y", test_day=54)
    assert got.count() == rows.count()
    flipped = rows.withColumn("y", F.when(F.col("day") == 51, ~F.col("y")).otherwise(F.col("y")))
    again = J.day_out_model_scores(flipped, ["x", "c"], "row_id", "day", [50, 51, 52, 53], settings, "y", test_day=54)
    both = got.join(again.withColumnRenamed("score", "other"), ["row_id", "day"])
    assert both.where("day = 51 and abs(score - other) > 1e-12").isEmpty()
    assert both.where("day = 50 and abs(score - other) > 1e-6").count() > 0


@pytest.mark.parametrize("n", [0, 1, KEPT - 1, KEPT, 60_000])
def test_sketch_ranks(n):
    values = np.random.default_rng(n).permutation(np.r_[np.arange(n // 2), np.full(n - n // 2, 7.0)])
    parts = []
    for piece in np.array_split(values, 7):
        sketch = Sketch()
        sketch.take(piece)
        parts.append(sketch)
    merged = Sketch()
    for sketch in parts:
        merged.taken += sketch.taken
        for level, kept in enumerate(sketch.levels):
            merged.add(np.concatenate(kept), level)
    shares = [i / 20 for i in range(21)]
    ordered, cuts = np.sort(values), merged.cuts(shares)
    assert merged.taken == n and len(cuts) == (21 if n else 0)
    for q, v in zip(shares, cuts):
        below, upto = np.searchsorted(ordered, v, "left"), np.searchsorted(ordered, v, "right")
        assert below - merged.error * n <= np.ceil(q * n) <= upto + merged.error * n
    assert merged.error == 0 if n < KEPT else merged.error < 0.01


def test_sketches_in_spark(spark):
    rng = np.random.default_rng(5)
    table = pd.DataFrame({"a": rng.normal(size=50_000), "b": np.where(rng.random(50_000) < 0.3, np.nan, rng.integers(0, 9, 50_000))})
    df = spark.createDataFrame(table).repartition(13).withColumn("none", F.lit(None).cast("double"))
    shares = [i / 40 for i in range(1, 40)]
    rows = sketched_quantiles(df, ["a", "b", "none"], shares).collect()
    assert {r["column"] for r in rows} == {"a", "b"} and len(rows) == 78
    for r in rows:
        ordered = np.sort(table[r["column"]].dropna().to_numpy())
        n = len(ordered)
        below, upto = np.searchsorted(ordered, r["value"], "left"), np.searchsorted(ordered, r["value"], "right")
        assert below - r["error"] * n <= np.ceil(r["share"] * n) <= upto + r["error"] * n and r["error"] < 0.01
    borders = quantile_borders(df, ["a", "b", "none"], 64)
    assert len(borders["a"]) == 63 and borders["b"] == sorted(set(borders["b"])) and len(borders["b"]) <= 9 and borders["none"] == []


def test_bins_between_borders(rows):
    state = boosting.start_state(rows.select("row_id", "y", "x", "c"), "row_id", ["x", "c"], "y", boosting.BoostParams(), 0.0, BORDERS)
    same = T.bin_table(rows, "row_id", "day", "y", ["x", "c"], BORDERS, [0.0])
    both = state.join(same.select("row_id", F.hex("bins").alias("bins")), "row_id")
    want = F.concat(*[F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in ("bin_x", "bin_c")])
    assert both.where(F.col("bins") != want).isEmpty() and both.count() == 500


def test_sketches_of_empty_partitions(spark):
    df = spark.range(0, 3, 1, 8).selectExpr("double(id) AS a", "double(NULL) AS b")
    rows = sketched_quantiles(df, ["a", "b"], [0.5, 1.0]).collect()
    assert sorted((r["column"], r["share"], r["value"]) for r in rows) == [("a", 0.5, 1.0), ("a", 1.0, 2.0)]
    assert not sketched_quantiles(df.where("a > 5"), ["a"], [0.5]).collect()


def test_rows_go_down_to_wanted_nodes_only():
    tree = T.Flat([0, 1, -1, -1, -1], [2, 1, 0, 0, 0], [1, 3, -1, -1, -1], [2, 4, -1, -1, -1], [0.0, 0.0, 1.0, 2.0, 3.0])
    bins = np.array([[1, 3, 2, 1, 4], [1, 0, 2, 0, 1]], np.uint8)
    rows = np.array([0, 1, 2, 4])
    assert {n: r.tolist() for n, r in tree.rows_at(bins, rows)} == {2: [1, 4], 3: [0], 4: [2]}
    assert [(n, r.tolist()) for n, r in tree.rows_at(bins, rows, {3})] == [(3, [0])]
    assert [(n, r.tolist()) for n, r in tree.rows_at(bins, rows, {0})] == [(0, [0, 1, 2, 4])]


def test_scores_between_rounds_are_bytes_and_the_last_ones_are_not_written(spark, monkeypatch):
    written = []
    cut = T.cut_lineage

    def noted(df, *by):
        if "raw" in df.columns:
            written.append(df.schema["raw"].dataType.typeName())
        return cut(df, *by)

    monkeypatch.setattr(T, "cut_lineage", noted)
    rows = spark.createDataFrame([(i, i % 3, int(i % 5 < 2), float(i % 7)) for i in range(90)], "row_id long, day int, y int, x double")
    grown = T.grow(rows, "row_id", "day", "y", ["x"], {"x": [1.0, 3.0, 5.0]}, [T.Model((0, 1)), T.Model((1, 2))], T.LeafwiseSettings(3, 3, 0.1, 1))
    assert written == ["binary"] * 3
    found = {r["row_id"]: r["score"] for r in T.predict(rows, "row_id", ["x"], {"x": [1.0, 3.0, 5.0]}, grown, 1).collect()}
    for r in grown.scores.collect():
        assert abs(1 / (1 + np.exp(-r["raw"][1])) - found[r["row_id"]]) < 1e-12

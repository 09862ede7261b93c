"""Training jobs: finite probabilities, one row per id, better than the constant on a separable frame."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayglass.operators import boosting
from dayglass.operators import metrics as I
from dayglass.plans import models as J
from dayglass.plans.prediction_run import predict_next_day
from dayglass.roles import Roles

ROLES = Roles("row_id", "day", categorical=("c",), binary=("b",), numeric=("x",), label=("is_installed",))
SMALL = J.TreeSettings(3, 3, 0.3, 32)


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1200):
        x = float(rng.normal())
        y = bool(x + 0.3 * rng.normal() > 0.5)
        rows.append((i, 50 + i % 18, f"c{int(x > 0)}{i % 3}", bool(rng.integers(0, 2)), x if i % 20 else None, y))
    return spark.createDataFrame(rows, "row_id long, day int, c string, b boolean, x double, is_installed boolean")


@pytest.fixture(scope="module")
def table(log):
    return J.model_table(log, ROLES)


def _beats_constant(scored, label="is_installed"):
    rate = scored.agg(F.avg(F.col(label).cast("double"))).first()[0]
    constant = -(rate * math.log(rate) + (1 - rate) * math.log(1 - rate))
    row = I.log_loss(scored, label, "p").first()
    low, high = scored.agg(F.min("p"), F.max("p")).first()
    assert 0 <= low <= high <= 1
    assert row["log_loss"] < constant


def test_walk_forward(table):
    rows, features = table
    got = J.walk_forward_scores(rows, features, "row_id", "day", SMALL, first_fold=64, last_fold=66)
    assert got.count() == rows.where("day between 64 and 66").count() == got.select("row_id").distinct().count()
    _beats_constant(got)


def test_weighted_walk_forward_raises_the_scores(table):
    rows, features = table
    plain, weighted = (
        J.walk_forward_scores(rows, features, "row_id", "day", SMALL, 66, 66, weighted=w).agg(F.avg("p")).first()[0] for w in (False, True)
    )
    assert weighted > plain


def test_day_out_models(table):
    rows, features = table
    got = J.day_out_model_scores(rows, features, "row_id", "day", [60, 61], SMALL)
    assert got.count() == rows.where("day in (60, 61)").count()


def test_cat_then_num(table):
    rows, _ = table
    _beats_constant(J.cat_then_num_scores(rows, ["c"], ["b", "x"], "row_id", "day", 63, SMALL))


def test_network(table):
    rows, features = table
    _beats_constant(J.network_scores(rows.where("day < 63"), rows.where("day >= 63"), features, "row_id", [4], rounds=60))


def test_per_feature_models_find_the_signal(log):
    train, val = log.where("day < 63"), log.where("day >= 63")
    rates = {r["feature"]: r["accuracy"] for r in J.per_feature_rates(train, val, ["c", "b"]).collect()}
    assert rates["c"] > 60 and rates["c"] > rates["b"]
    assert J.per_feature_logistic(train, val, ["x"]).first()["accuracy"] > 75


def test_full_run_is_the_real_run(log, monkeypatch):
    fits, grown, stacked = [], [], []
    fit, grow, stack = J.fit_trees, J.grow_leafwise, J.stacked_scores
    monkeypatch.setattr(J, "fit_trees", lambda *a, **k: fits.append(a[1]) or fit(*a, **k))
    monkeypatch.setattr(J, "grow_leafwise", lambda *a, **k: grown.append((a[1], a[5])) or grow(*a, **k))
    monkeypatch.setattr(J, "stacked_scores", lambda *a, **k: stacked.append(a) or stack(*a, **k))
    preparation = J.Preparation("c", {"x": "x", "y": "y"}, {"cat": ("c",)})
    wide = log.withColumn("y", F.col("x") + 1)
    roles = Roles("row_id", "day", categorical=("c",), binary=("b",), numeric=("x", "y"), label=("is_installed",))
    settings = J.smaller(J.BASE_MODELS, 1, 2, 3)
    assert [s.leaves for s in settings.values()] == [None, 3, 3]
    rows = predict_next_day(wide, roles, 67, settings, preparation=preparation).collect()
    assert len(rows) == log.where("day = 67").count() == len({r["RowId"] for r in rows})
    assert all(0 <= r["is_installed"] <= 1 and r["is_clicked"] == 0.33 for r in rows)
    days = sorted(r[0] for r in log.where("day < 67").select("day").distinct().collect())
    assert len(fits) == 1 and "c" not in fits[0] and "f_newx-y" in fits[0]
    # Two base models, two sets of one model per day, two stacked models; the test day teaches none.
    assert sorted(len(models) for _, models in grown) == [1, 1, 1, 1, len(days), len(days)]
    assert all("c" in f for f, _ in grown) and all({"light", "hist"} <= set(f) for f, _ in grown[-2:])
    assert all(67 not in m.days for _, models in grown for m in models)
    folds = [models for _, models in grown if len(models) > 1]
    assert all([set(days) - set(m.days) for m in models] == [{d} for d in days] for models in folds)
    scores = stacked[0][5]
    assert scores.count() == log.count()
    test_rows = scores.join(log.where("day = 67"), "row_id")
    assert test_rows.select("light").distinct().count() <= test_rows.count() and test_rows.where("light is null or hist is null").isEmpty()


def test_walk_forward_scores_the_test_day(table):
    rows, features = table
    got = J.walk_forward_scores(rows, features, "row_id", "day", SMALL, 66, 66, test_day=67)
    assert {r[0] for r in got.select("fold").distinct().collect()} == {66, 67}
    assert got.where("fold = 67").count() == rows.where("day = 67").count()


def test_components_are_orthogonal_and_rebuild_the_rows(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 5)) + 3 + rng.normal(size=(200, 5)) * 1e-3
    df = spark.createDataFrame([(i, i % 2, [float(v) for v in r]) for i, r in enumerate(base)], "row_id long, y int, v array<double>")
    fitted = J.fit_components(df, "v")
    assert fitted.vectors.shape == (5, 2) or fitted.vectors.shape == (5, 1)
    assert np.allclose(fitted.vectors.T @ fitted.vectors, np.eye(fitted.vectors.shape[1]), atol=1e-8)
    assert sum(fitted.shares[: fitted.vectors.shape[1]]) >= 0.95
    assert all(r["mean_similarity"] > 0.95 for r in J.reconstruction_similarity(df, "v", "y").collect())


def test_boosting_rounds_lower_the_loss(log):
    df = log.select("row_id", "is_installed", "x", F.col("b").cast("int").alias("b"))
    params = boosting.BoostParams(bins=16, depth=2, learning_rate=0.5, min_rows=5)
    before = I.log_loss(boosting.boost(df, "row_id", ["x", "b"], "is_installed", params, 0.0, 1), "is_installed", "p").first()[1]
    after = I.log_loss(boosting.boost(df, "row_id", ["x", "b"], "is_installed", params, 0.0, 4), "is_installed", "p").first()[1]
    assert after < before < math.log(2)


def test_focal_boosting_runs(log):
    df = log.select("row_id", "is_installed", "x")
    params = boosting.BoostParams(bins=8, depth=1, gamma=2.0, alpha=0.25, min_rows=5)
    got = boosting.boost(df, "row_id", ["x"], "is_installed", params, -0.5, 1)
    assert got.where("p is null or p <= 0 or p >= 1").count() == 0


def test_sweep_draws_with_a_seed():
    settings = {"k": [1, 2, 3], "w": [0.5, 1.0]}
    a, b = (J.sweep(lambda g: {"loss": g["k"] * g["w"]}, settings, trials=3) for _ in range(2))
    assert a == b and len(a) == 3
    assert len(J.sweep(lambda g: {}, settings)) == 6


def test_walk_forward_counts_labels_once_and_fits_side_by_side(table, monkeypatch):
    import threading

    rows, features = table
    both, fit = threading.Barrier(2, timeout=60), J.fit_trees

    def together(train, *more):
        # Breaks unless another fit is under way.
        both.wait()
        ratio = train.where(F.col("is_installed") == 1).agg(F.max("__weight")).first()[0]
        known = train.where(~F.col("__stop")) if "__stop" in train.columns else train
        assert ratio == I.class_ratio(known, "is_installed").first()[0]
        return fit(train, *more)

    monkeypatch.setattr(J, "fit_trees", together)
    got = J.walk_forward_scores(rows, features, "row_id", "day", SMALL, 65, 66, weighted=True)
    assert got.select("fold").distinct().count() == 2


def test_trials_that_differ_in_their_pull_share_a_fit(table, monkeypatch):
    rows, features = table
    fitted, kmeans = [], J.KMeans

    def counted(**settings):
        fitted.append(settings["k"])
        return kmeans(**settings)

    monkeypatch.setattr(J, "KMeans", counted)
    trial = J.cluster_rate_trial(rows.where("day < 63"), rows.where("day >= 63"), features, "row_id")
    found = J.sweep(trial, {"k": [2, 3], "pull": [0.0, 0.5, 1.0]})
    assert sorted(fitted) == [2, 3]
    assert [(r["trial"], r["k"], r["pull"]) for r in found] == [(i, k, p) for i, (k, p) in enumerate((k, p) for k in (2, 3) for p in (0.0, 0.5, 1.0))]
    # Without a pull all is the constant, whatever the clusters.
    assert found[0]["log_loss"] == found[3]["log_loss"] and len({r["log_loss"] for r in found[:3]}) == 3


def test_trees_are_fitted_on_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(J, "PART_ROWS", 50)
    rows = spark.range(1000, numPartitions=2).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    assert max(J.in_small_parts(rows).rdd.glom().map(len).collect()) <= 100
    taken = []
    fit = J.GBTClassifier.fit
    monkeypatch.setattr(J.GBTClassifier, "fit", lambda self, data: taken.append(data.rdd.getNumPartitions()) or fit(self, data))
    model = J.fit_trees(rows, ["x"], "y", J.TreeSettings(1, 2, 0.1, 8))
    assert taken == [20] and model.getNumTrees == 1
    assert J.in_small_parts(rows.limit(40)).rdd.getNumPartitions() <= 2


def test_model_table_works_out_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(v):
        seen.add(1)
        return v

    log = spark.createDataFrame([(i, 45 + i % 4, f"c{i % 3}", i % 2 == 0, float(i)) for i in range(40)], "row_id long, day int, c string, y boolean, v double")
    log = log.withColumn("n", F.udf(noted, "double")("v"))
    table, features = J.model_table(log, Roles(row_id="row_id", day="day", categorical=("c",), binary=(), counter=(), numeric=("n",), label=("y",)), "y")
    assert table.count() == 40 and features == ["c", "n"]
    assert seen.value == 40

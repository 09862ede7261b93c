"""Ties, NULLs, constants, unseen categories and argument checks on small frames."""

import math

import pytest
from pyspark.sql import functions as F

from dayglass.functions import losses, scalar
from dayglass.operators import cleaning as B
from dayglass.operators import encoders as D
from dayglass.operators import metrics as I
from dayglass.operators import profiling as P
from dayglass.operators import scaling as S
from dayglass.operators import scoring as H
from dayglass.operators import splits as C
from dayglass.roles import impression_roles, impression_schema


def test_roles_of_the_raw_log():
    roles = impression_roles()
    assert (len(roles.categorical), len(roles.binary), len(roles.counter), len(roles.numeric)) == (31, 9, 27, 11)
    assert len(impression_schema().fields) == 82
    assert len(impression_schema(labelled=False).fields) == 80
    assert "f_7" not in roles.without(["f_7"]).categorical


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert B.nulls_for_nan(df, ["x"]).agg(F.count("x"), F.avg("x")).first() == (1, 1.0)


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (1.0,), (3.0,), (None,)], "x double")
    assert B.column_modes(df, ["x"]) == {"x": 1.0}


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    for fit in (S.fit_minmax, S.fit_standard):
        assert [r[0] for r in S.apply_spread(df, ["x"], fit(df, ["x"])).collect()] == [0.0, 0.0]


def test_counter_with_one_value_is_an_error(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    with pytest.raises(ValueError):
        S.fit_counters(df, ["x"])


def test_counter_steps_ignore_nulls(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (3.0,), (None,)], "x double")
    spread = S.fit_counters(df, ["x"])
    assert spread.center == {"x": 1.0} and spread.width == {"x": 0.5}


def test_outlier_ties_by_row_id(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(98)] + [(98, 10.0), (99, 10.0)], "row_id long, x double")
    spread = S.Spread({"x": 0.0}, {"x": 1.0})
    got = dict(S.remove_outliers(df, ["x"], 4, spread, "row_id", percentage=0.01).where("row_id > 97").collect())
    assert got == {98: 0.2, 99: 10.0}
    assert S.remove_outliers(df, ["x"], 4, spread, "row_id", percentage=0.001).agg(F.max("x")).first()[0] == 10.0


def test_threshold_day_is_checked(spark):
    df = spark.createDataFrame([(45,), (50,)], "day int")
    for day in (45, 50, 60):
        with pytest.raises(ValueError):
            C.tag_split(df, "day", day)
    assert C.tag_split(df, "day", None).where("split = 'train'").count() == 2
    assert C.tag_split(df, "day", 46, inclusive=True).where("split = 'val'").count() == 1


def test_label_codes_follow_numbers_and_read_unseen_as_mode(spark):
    train = spark.createDataFrame([(1, 10), (2, 9), (3, 100), (4, 9), (5, None)], "row_id long, c int")
    test = spark.createDataFrame([(6, 100), (7, 55)], "row_id long, c int")
    a, b = D.label_encode_train(train, test, ["c"], "row_id")
    assert dict(a.collect()) == {1: 1, 2: 0, 3: 2, 4: 0, 5: 3}
    assert dict(b.collect()) == {6: 2, 7: 0}


def test_label_codes_of_texts_with_many_values(spark):
    values = [f"v{i % 701}" for i in range(2000)]
    train = spark.createDataFrame(list(enumerate(values)), "row_id long, c string")
    got = dict(D.fit_label_codes(train, ["c"]).select("value", "code").collect())
    assert got == {v: i for i, v in enumerate(sorted(set(values)))}


def test_align_without_shared_values(spark):
    train = spark.createDataFrame([(1, 1), (2, 2)], "row_id long, c int")
    val = spark.createDataFrame([(3, 5), (4, None)], "row_id long, c int")
    a, b = D.align_categories(train, val, ["c"], "row_id")
    assert {r["c"] for r in a.collect()} == {-1} and {r["c"] for r in b.collect()} == {-1}


def test_ordered_stats_of_a_hot_category(spark):
    """A third of the rows in one category and day; the first row of each category gets the prior."""
    rows = [(i, 45 + (0 if i % 3 == 0 else i % 5), "hot" if i % 3 == 0 else None if i % 7 == 0 else f"c{i % 4}", i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, day int, c string, y int")
    got = dict(D.ordered_target_stats(df, ["c"], "y", "day", "row_id", 0.25).select("row_id", "c").collect())
    seen: dict = {}
    for i, _, c, y in sorted(rows, key=lambda r: (r[1], r[0])):
        n, s = seen.get(c, (0, 0))
        assert math.isclose(got[i], (s + 0.25) / (n + 1))
        seen[c] = (n + 1, s + y)


def test_target_stats_fall_back_to_the_prior(spark):
    train = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "once", 1)], "row_id long, c string, y int")
    rows = spark.createDataFrame([(4, "a"), (5, "once"), (6, "new"), (7, None)], "row_id long, c string")
    stats = D.fit_target_stats(train, ["c"], "y")
    got = dict(D.apply_target_stats(rows, stats, ["c"], 0.5, "row_id").collect())
    assert got == {4: 0.5, 5: 0.5, 6: 0.5, 7: 0.5}
    assert round(dict(D.apply_smoothed_stats(rows, stats, ["c"], 0.1, "row_id").collect())[7], 9) == 0.1


def test_day_out_scores_ignore_their_own_day(spark):
    rows = [(i, 45 + i % 3, "a", int(i % 3 == 0)) for i in range(30)]
    flipped = [(i, d, c, 1 - y if d == 45 else y) for i, d, c, y in rows]
    got = [
        dict(D.day_out_scores(spark.createDataFrame(r, "row_id long, day int, c string, y int"), {"s": "c"}, "y", "day", "row_id").where("day = 45").select("row_id", "s").collect())
        for r in (rows, flipped)
    ]
    assert got[0] == got[1]


def test_earlier_day_stats_ignore_the_day_itself(spark):
    rows = [(1, 45, "a", 1), (2, 45, "a", 1), (3, 46, "a", 0), (4, 47, "b", None), (5, 47, "a", None)]
    df = spark.createDataFrame(rows, "row_id long, day int, c string, y int")
    got = dict(D.earlier_day_stats(df, ["c"], "y", "day", "row_id", base_rate=0.1).select("row_id", "c").collect())
    rate = 2 / 3
    assert got[1] == got[2] == 0.1
    assert got[3] == 1.0
    assert math.isclose(got[4], rate) and math.isclose(got[5], (2 + rate) / 4)


def test_weekday_code_outside_the_known_days(spark):
    df = spark.createDataFrame([(45, "x"), (67, "x"), (70, "x")], "day int, c string")
    code = scalar.weekday_code(F.col("day"), F.col("c"), scalar.WEEKDAY_CODES_RAW)
    assert [r[0] for r in df.select(code).collect()] == ["6675", "14659", "x"]


def test_log_shift_is_guarded(spark):
    df = spark.createDataFrame([(-0.5,), (0.5,), (None,)], "x double")
    assert [r[0] for r in df.select(scalar.log_shift(F.col("x"))).collect()] == [None, 0.0, None]


def test_blend_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        scalar.blend({"a": 0.5, "b": 0.6})


def test_rerank_is_a_permutation_that_keeps_the_order(spark):
    scored = spark.createDataFrame([(i, float((i * 7) % 13)) for i in range(50)], "row_id long, score double")
    reference = spark.createDataFrame([(i, i / 100) for i in range(50)], "row_id long, score double")
    got = H.rerank(scored, reference, "row_id", "score").join(scored, "row_id").orderBy("score", "row_id").collect()
    values = [r["is_installed"] for r in got]
    assert values == sorted(values) and sorted(values) == [i / 100 for i in range(50)]
    assert {r["is_clicked"] for r in got} == {0.33}


def test_class_weights(spark):
    kinds = spark.createDataFrame([("p",)] * 6 + [("q",)] * 3 + [("r",)], "f string")
    got = {k: round(v, 6) for k, v in I.class_weights(kinds, "f").collect()}
    assert got == {"p": 0.555556, "q": 1.111111, "r": 3.333333}
    tags = spark.createDataFrame([(["p", "q"],), (["p"],), (["p", "r"],), (["q"],), (["p"],)], "t array<string>")
    got = I.multi_label_weights(tags, "t").collect()
    assert {k for k, _ in got} == {"p", "q", "r"}
    assert dict(got)["p"] < dict(got)["q"] < dict(got)["r"]


def test_focal_without_focus_is_log_loss(spark):
    df = spark.createDataFrame([(1, 0.3), (0, 0.3), (1, 0.9)], "y int, p double")
    y, p = F.col("y"), F.col("p")
    for r in df.select(
        "y", "p", losses.focal_loss(y, p, 0.0), losses.log_loss(y, p), losses.focal_gradient(y, p, 0.0), losses.focal_hessian(y, p, 0.0)
    ).collect():
        assert math.isclose(r[2], r[3])
        assert math.isclose(r[4], r["p"] - r["y"])
        assert math.isclose(r[5], r["p"] * (1 - r["p"]))


def test_focal_start_without_focus_is_the_log_odds(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] * 7, "y int")
    assert math.isclose(I.focal_init_score(df, "y", 0.0).first()["init_score"], math.log(0.3 / 0.7))


def test_positive_rate_is_checked():
    for rate in (0, 1, 3):
        with pytest.raises(ValueError):
            losses.entropy(rate)


def test_one_cluster_gives_the_sentinels(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (0, [1.0, 0.0])], "c int, x array<double>")
    assert tuple(I.cluster_indices(df, "c", "x").first()) == (1, 0.0, 1000.0)


def test_unknown_cluster_gets_the_constant(spark):
    train = spark.createDataFrame([(0, 1), (0, 1)], "cluster int, y int")
    rates = H.cluster_rates(train, "cluster", "y")
    got = dict(H.cluster_rate_predict(spark.createDataFrame([(0,), (9,)], "cluster int"), rates, "cluster", 1.0).collect())
    assert got == {0: 1.0, 9: 0.145}


def test_pure_combination_is_found(spark):
    rows = [(a, b, int(a and b)) for a in (True, False) for b in (True, False) for _ in range(2)] + [(False, False, 1)]
    df = spark.createDataFrame(rows, "a boolean, b boolean, y int")
    got = {(r["a"], r["b"]): r["pure"] for r in P.pure_combinations(df, ["a", "b"], "y").collect()}
    assert got == {(0, 0): False, (0, 1): True, (1, 0): True, (1, 1): True}


def test_density_integrates_to_one_and_skips_flat_days(spark):
    rows = [(45, float(i)) for i in range(20)] + [(46, 3.0), (46, 3.0)]
    got = P.density_per_day(spark.createDataFrame(rows, "day int, x double"), "day", "x", points=200).toPandas()
    assert set(got.day) == {45}
    got = got.sort_values("point")
    assert abs((got.density * got["at"].diff().fillna(0)).sum() - 1) < 0.01


def test_walk_forward_folds(spark):
    df = spark.createDataFrame([(d,) for d in range(45, 68)], "day int")
    folds = C.walk_forward(df, "day", start=48)
    assert folds.where("part = 'train' and day >= fold").count() == 0
    assert folds.where("part = 'val'").count() == 15
    assert folds.agg(F.min("day"), F.max("day")).first() == (48, 66)

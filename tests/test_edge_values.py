"""NULLs, tiny tables, booleans and numbers beyond 2^53."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayglass.functions import losses, scalar
from dayglass.operators import centres, metrics
from dayglass.operators.dbscan import dbscan
from dayglass.operators.ordering import exact_quantiles


def test_quantiles_of_small_tables_are_exact(spark):
    shares = [0.0, 0.25, 0.5, 0.75, 1.0]
    sizes = [*range(1, 16), 40, 59, 98, 102]
    rows = [tuple(float(i * i) if i <= n else None for n in sizes) for i in range(1, 103)]
    df = spark.createDataFrame(rows, ", ".join(f"c{n} double" for n in sizes))
    got = exact_quantiles(df, df.columns, shares)
    for n in sizes:
        assert np.allclose(got[f"c{n}"], np.quantile([float(i * i) for i in range(1, n + 1)], shares))


def test_quantiles_with_ties_and_only_nulls(spark):
    values = [1.0, 1.0, 1.0, 1.0, 5.0, 5.0, 9.0, None, None]
    df = spark.createDataFrame([(v, None) for v in values], "x double, none double")
    got = exact_quantiles(df, ["x", "none"], [0.25, 0.5, 0.75])
    assert np.allclose(got["x"], np.quantile([v for v in values if v is not None], [0.25, 0.5, 0.75]))
    assert got["none"] == [None, None, None]


def test_losses_of_missing_values_are_missing(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (None, 0.9), (1, None), (None, None)], "y int, p double")
    y, p = F.col("y"), F.col("p")
    made = [losses.log_loss(y, p), losses.focal_loss(y, p, 2.0, 0.25), losses.focal_gradient(y, p, 2.0), losses.focal_hessian(y, p, 2.0)]
    rows = df.select(*made).collect()
    assert all(v is not None for r in rows[:2] for v in r) and all(v is None for r in rows[2:] for v in r)
    row = metrics.log_loss(df, "y", "p").first()
    assert row["rows"] == 2 and math.isclose(row["log_loss"], -(math.log(0.9) + math.log(0.8)) / 2)
    assert metrics.focal_loss(df, "y", "p", 2.0, None).first()["rows"] == 2


@pytest.mark.parametrize("gamma", [0.0, 0.5, 1.0, 2.0])
def test_focal_derivatives_are_those_of_the_loss(spark, gamma):
    step = 1e-4
    df = spark.createDataFrame([(y, raw) for y in (0, 1) for raw in (-3.0, -0.7, 0.0, 0.4, 2.5)], "y int, raw double")
    loss = lambda shift: losses.focal_loss(F.col("y"), 1 / (1 + F.exp(-(F.col("raw") + shift))), gamma, 0.3)
    p = 1 / (1 + F.exp(-F.col("raw")))
    rows = df.select(
        losses.focal_gradient(F.col("y"), p, gamma, 0.3), losses.focal_hessian(F.col("y"), p, gamma, 0.3), loss(-step), loss(0.0), loss(step)
    ).collect()
    for grad, hess, low, middle, high in rows:
        assert grad == pytest.approx((high - low) / (2 * step), abs=1e-7)
        assert hess == pytest.approx((high - 2 * middle + low) / step**2, abs=1e-6)


def test_codes_out_of_range(spark):
    df = spark.createDataFrame([("1.0",), ("99999999999",), ("x",), (None,), ("-7",)], "c string")
    assert [r[0] for r in df.select(scalar.canonical_code(F.col("c"))).collect()] == [1, -2, -2, -2, -7]


def test_points_with_missing_coordinates_are_noise_once(spark):
    rows = [(1, 1.0, None), (2, None, 1.0), (3, 2.0, 2.0), (4, 2.0, 2.1), (5, 2.1, 2.0), (6, float("nan"), 2.0), (7, None, None)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r["id"]: r["cluster"] for r in dbscan(df, "id", ["x", "y"], 0.5, 3).collect()}
    assert got == {1: -1, 2: -1, 3: 3, 4: 3, 5: 3, 6: -1, 7: -1}


def test_modes_keep_their_types(spark):
    big = 9007199254740992
    rows = [(i, i % 2 == 0, big + i % 2, None if i == 5 else "t") for i in range(8)]
    df = spark.createDataFrame(rows, "id long, b boolean, n long, t string")
    found, _ = centres.kmodes(df, "id", ["b", "n", "t"], 2, 2)
    got = {r["id"]: (r["cluster"], r["cost"]) for r in found.collect()}
    assert all(got[i][0] == i % 2 for i in range(8))
    assert all(got[i][1] == (1.0 if i == 5 else 0.0) for i in range(8))

"""Global ranks, quantiles and row numbers against pandas, with hot values and NULLs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayglass.operators import ordering
from dayglass.operators.joins import largest_keys, lookup_join, rank_pairs
from dayglass.operators.profiling import series_per_day
from dayglass.operators.trials import pareto_front


def _skewed(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    score = np.round(rng.normal(size=n), 2)
    score[: n // 3] = 0.5  # a third of the rows share one score
    frame = pd.DataFrame({"row_id": rng.permutation(n), "score": score, "part": rng.integers(0, 3, n)})
    frame.loc[frame.row_id % 11 == 0, "score"] = None
    return frame


def _frame(spark, pdf):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, "row_id long, score double, part long")


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_rank_is_the_same_for_any_partitioning(spark, partitions):
    pdf = _skewed()
    expected = pdf.sort_values(["score", "row_id"], na_position="last").row_id.tolist()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = ordering.global_rank(_frame(spark, pdf).repartition(5), "score", "row_id").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = got.sort_values("rank")
    assert got["rank"].tolist() == list(range(1, len(pdf) + 1))
    assert got.row_id.tolist() == expected


def test_no_piece_holds_the_hot_value(spark):
    """The window pieces of a value that fills a third of the rows stay small."""
    pdf = _skewed()
    ranked = ordering.global_rank(_frame(spark, pdf), "score", "row_id")
    plan = ranked._jdf.queryExecution().analyzed().toString()
    assert "__sub" in plan
    cuts = ordering.cut_points(_frame(spark, pdf), ["score"], 8)["score"]
    assert cuts.count(0.5) >= 2  # recognised as hot


def test_rank_within_groups_descending(spark):
    pdf = _skewed()
    got = ordering.global_rank(_frame(spark, pdf), "score", "row_id", within=("part",), descending=True).toPandas()
    for _, group in got.groupby("part"):
        group = group.sort_values("rank")
        expected = group.sort_values(["score", "row_id"], ascending=[False, True], na_position="last")
        assert group.row_id.tolist() == expected.row_id.tolist()
        assert group["rank"].tolist() == list(range(1, len(group) + 1))


def test_exact_quantiles(spark):
    pdf = _skewed()
    shares = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = ordering.exact_quantiles(_frame(spark, pdf), ["score", "row_id"], shares)
    assert np.allclose(got["score"], pdf.score.dropna().quantile(shares))
    assert np.allclose(got["row_id"], pdf.row_id.quantile(shares))


def test_quantiles_of_a_missing_column(spark):
    df = spark.range(5).select(F.lit(None).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    got = ordering.exact_quantiles(df, ["x", "y"], [0.5])
    assert got == {"x": [None], "y": [2.0]}


def test_series_per_day(spark):
    pdf = _skewed()
    got = series_per_day(_frame(spark, pdf), "part", "row_id", "score").toPandas()
    expected = pdf.assign(position=pdf.groupby("part").row_id.rank().astype(int))
    merged = got.merge(expected, on="row_id", suffixes=("", "_e"))
    assert (merged.position == merged.position_e).all()


def test_rank_pairs_keeps_the_left_rows(spark):
    left = spark.createDataFrame([(1, 0.3), (2, 0.1), (3, 0.1)], "row_id long, score double")
    right = spark.createDataFrame([(9, 5.0), (8, 4.0)], "row_id long, score double")
    got = {r["row_id"]: r["v"] for r in rank_pairs(left, right, "row_id", "score", "v").collect()}
    assert got == {2: 4.0, 3: 5.0, 1: None}


def test_lookup_join_with_a_hot_key(spark):
    rows = spark.range(300).select(F.col("id"), F.when(F.col("id") < 100, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = rows.groupBy("k").agg(F.count("*").alias("n"))
    hot = largest_keys({"t": table}, "k", "n")["t"]
    assert hot[0] == "hot"
    for keys in (hot, []):
        got = lookup_join(rows, table, "k", keys, "id")
        assert got.count() == 300
        assert got.agg(F.sum("n")).first()[0] == 100 * 100 + 200


def test_pareto_front_against_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 30, (400, 2)))]
    got = {r["t"] for r in pareto_front(spark.createDataFrame(rows, "t long, low double, high double"), "low", "high").collect()}
    expected = {
        t for t, a, b in rows if not any(x <= a and y >= b and (x < a or y > b) for _, x, y in rows)
    }
    assert got == expected


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["bigint", "decimal(20,0)"])
def test_large_numbers_keep_their_order(spark, kind, descending):
    base = 2**53
    values = [base + k for k in (0, 1, 2, 3, 5, 4, 7)] + [base + 1] * 300 + [None, 5, -base - 1, -base - 2, -base - 3]
    rows = spark.createDataFrame([(base + 2 * i + i % 2, v) for i, v in enumerate(values)], "row_id bigint, v bigint")
    got = ordering.global_rank(rows.withColumn("v", F.col("v").cast(kind)).repartition(7), "v", "row_id", descending=descending)
    ranks = {r["row_id"]: r["rank"] for r in got.collect()}
    sign = -1 if descending else 1
    order = sorted(((v is None, sign * (v or 0), base + 2 * i + i % 2) for i, v in enumerate(values)))
    assert ranks == {name: k for k, (_, _, name) in enumerate(order, 1)}


def test_large_row_ids_are_numbered_in_order(spark):
    ids = [2**53 + k for k in (0, 1, 2, 3, 5, 6, 7, 9)] + [2**60 + k for k in range(50)]
    rows = spark.createDataFrame([(i, 50, 0.5) for i in ids], "row_id bigint, day int, x double").repartition(5)
    got = {r["row_id"]: r["position"] for r in series_per_day(rows, "day", "row_id", "x").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids), 1)}

"""Joins with single tables where nine rows of ten have one key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayglass.operators import joins as G
from dayglass.operators import metrics as I
from dayglass.operators import scoring as H


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    keys = np.where(rng.random(2000) < 0.9, 7, rng.integers(0, 6, 2000))
    made = [(i, None if i % 97 == 0 else int(k), bool(i % 3 == 0), [float(k) + float(x) for x in rng.normal(size=2) * 0.1]) for i, k in enumerate(keys)]
    return spark.createDataFrame(made, "row_id long, k int, y boolean, v array<double>")


@pytest.fixture
def shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    yield
    spark.conf.set("spark.sql.adaptive.enabled", True)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_of_the_large_key_are_spread(spark, rows, shuffled):
    table = spark.createDataFrame([(7, "seven"), (1, "one")], "k int, name string")
    joined = G.hot_lookup_join(rows, table, "k")
    # The rows of the large key lie in several partitions after the shuffle.
    parts = joined.where("k = 7").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 0.5 * sum(r["count"] for r in parts)
    want = {7: "seven", 1: "one"}
    assert all(r["name"] == want.get(r["k"]) for r in joined.collect()) and joined.count() == rows.count()


def test_seen_and_unseen_rows_and_lookups(spark, rows, shuffled):
    other = spark.createDataFrame([(7,), (7,), (2,), (None,)], "k int")
    seen, unseen = (G.unseen_rows(rows, other, "k", seen=s) for s in (True, False))
    assert seen.columns == rows.columns
    plain = [(r["row_id"], r["k"]) for r in rows.select("row_id", "k").collect()]
    assert {r["row_id"] for r in seen.collect()} == {i for i, k in plain if k in (7, 2)}
    assert sorted(r["row_id"] for r in unseen.collect()) == [i for i, k in plain if k not in (7, 2)]
    table = spark.createDataFrame([(7, 0.5)], "k int, share double")
    mapped = {r["row_id"]: r["m"] for r in G.lookup_map(rows, table, "k", "share", "m", F.lit(-1.0)).collect()}
    assert mapped == {i: 0.5 if k == 7 else -1.0 for i, k in plain}


def test_cluster_figures(spark, rows, shuffled):
    rates = H.cluster_rates(rows.where("k IS NOT NULL"), "k", "y")
    table = {r["k"]: (r["rows"], r["rate"]) for r in rates.collect()}
    largest = max(n for n, _ in table.values())
    for r in H.cluster_rate_predict(rows, rates, "k", 0.8).collect():
        n, rate = table.get(r["k"], (0, 0.0))
        assert abs(r["prediction"] - min(1.0, max(0.0, 0.145 + (rate - 0.145) * 0.8 * n / largest))) < 1e-12
    known = rows.where("k IS NOT NULL")
    x, k = np.array([r["v"] for r in known.collect()]), np.array([r["k"] for r in known.collect()])
    names = sorted(set(k))
    centre = np.array([x[k == c].mean(axis=0) for c in names])
    between = sum((k == c).sum() * ((centre[i] - x.mean(axis=0)) ** 2).sum() for i, c in enumerate(names))
    within = sum(((x[k == c] - centre[i]) ** 2).sum() for i, c in enumerate(names))
    spread = [np.sqrt(((x[k == c] - centre[i]) ** 2).sum(axis=1)).mean() for i, c in enumerate(names)]
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(centre[i] - centre[j]) for j in range(len(names)) if j != i) for i in range(len(names))]
    got = I.cluster_indices(rows, "k", "v").first()
    assert got["clusters"] == len(names)
    assert abs(got["calinski_harabasz"] / (between / (len(names) - 1) / (within / (len(x) - len(names)))) - 1) < 1e-9
    assert abs(got["davies_bouldin"] - np.mean(worst)) < 1e-9

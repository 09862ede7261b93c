"""Registered queries: file round trips, and training jobs with small settings.

SQL cannot train these models, so the queries of training jobs give their rows with ``sound``, which tells whether what
was learned has the properties it must have, and SQL states the rows that there must be.
"""

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import functions as F

from dayglass.functions import scalar
from dayglass.operators import centres
from dayglass.operators import joins as G
from dayglass.operators import metrics as I
from dayglass.operators import scaling as S
from dayglass.operators import scoring as H
from dayglass.plans import models as J
from dayglass.plans.prediction_run import predict_next_day
from dayglass.session import scratch_path
from dayglass.sources import files as A
from dayglass.sources.fixtures import IMP, LAST_DAY, MODELS, SPLIT_DAY, imp, ord_, scores, table, with_views
from dayglass.checks.helpers import per_column_sql, rounded

QUERIES, SQL = {}, {}

# File round trips


def _impressions(s, d):
    rows, folder = imp(s, d), scratch_path(s, "impressions")
    A.write_impressions_tsv(rows.where(F.col("day") < SPLIT_DAY), f"{folder}/all/early")
    A.write_impressions_tsv(rows.where(F.col("day") >= SPLIT_DAY), f"{folder}/all/late")
    return A.read_impressions(s, f"{folder}/all", rows.schema)


QUERIES["read_impressions"] = _impressions
SQL["read_impressions"] = with_views("imp", "SELECT * FROM imp")


def _parquet(s, d):
    rows, path = imp(s, d), scratch_path(s, "log")
    A.write_log(rows, path, "day")
    return A.read_log(s, path, rows.schema).select(*rows.columns)


QUERIES["parquet_roundtrip"] = _parquet
SQL["parquet_roundtrip"] = with_views("imp", "SELECT * FROM imp")


def _scores_file(s, d):
    path = scratch_path(s, "scores")
    A.write_scores(H.submission(imp(s, d), scores(s, d), "row_id", "cat", 0.33), path)
    return rounded(A.read_scores(s, path), 9)


QUERIES["write_scores_tsv"] = _scores_file
SQL["write_scores_tsv"] = with_views(
    "scores", "SELECT row_id AS RowId, CAST(0.33 AS DOUBLE) AS is_clicked, round(cat, 9) AS is_installed FROM scores"
)


def _metrics_file(s, d):
    path = scratch_path(s, "metrics")
    long = I.long_scores(scores(s, d), list(MODELS), ["is_installed"]).withColumn("predicted", scalar.threshold_class(F.col("p"), 0.2))
    A.write_metrics(I.accuracy_f1(I.confusion_matrix(long, "is_installed", "predicted", ["model"])).withColumnRenamed("model", "feature"), path)
    return rounded(A.read_metrics(s, path), 9)


QUERIES["read_metrics_file"] = _metrics_file
SQL["read_metrics_file"] = with_views(
    "scores",
    "c AS ("
    + per_column_sql(
        list(MODELS),
        "SELECT '{c}' AS feature, count(*) FILTER (NOT is_installed AND {c} <= 0.2) AS tn, count(*) FILTER (NOT is_installed AND {c} > 0.2) AS fp, "
        "count(*) FILTER (is_installed AND {c} <= 0.2) AS fn, count(*) FILTER (is_installed AND {c} > 0.2) AS tp FROM scores",
    )
    + """) SELECT feature, round(100.0 * (tn + tp) / (tn + fp + fn + tp), 9) AS accuracy,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1, tn, fp, fn, tp FROM c""",
)


def _cluster_file(s, d):
    path = scratch_path(s, "clusters")
    found, _ = centres.kmeans(table(s, d, "embeddings"), "vec_id", "embedding", 3, 1)
    A.write_cluster_scores(found, path, "vec_id", "kmeans", as_tsv=True)
    schema = "vec_id LONG, kmeans INT, kmeans_distance DOUBLE"
    return rounded(s.read.schema(schema).options(sep="\t", header=True).csv(path), 6)


QUERIES["write_cluster_scores"] = _cluster_file
SQL["write_cluster_scores"] = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c0 AS (SELECT dense_rank() OVER (ORDER BY vec_id) - 1 AS k, i, x AS m FROM e WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 3)),
a0 AS (SELECT vec_id, k FROM (SELECT vec_id, k, sum((x - m) ** 2) AS q FROM e JOIN c0 USING (i) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY q, k) = 1),
c1 AS (SELECT k, i, avg(x) AS m FROM e JOIN a0 USING (vec_id) GROUP BY ALL)
SELECT vec_id, CAST(k AS INTEGER) AS kmeans, round(sqrt(q), 6) AS kmeans_distance
FROM (SELECT vec_id, k, sum((x - m) ** 2) AS q FROM e JOIN c1 USING (i) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY q, k) = 1"""

# Closed-form per-feature models


def _per_feature(s, d):
    rows = imp(s, d)
    train, val = rows.where(F.col("day") < SPLIT_DAY), rows.where(F.col("day") >= SPLIT_DAY)
    return rounded(J.per_feature_rates(train, val, ["c_user", "c_hour", "c_k", "b_pm"]), 9)


QUERIES["per_feature_models"] = _per_feature
SQL["per_feature_models"] = with_views(
    "imp",
    "l AS ("
    + per_column_sql(
        ["c_user", "c_hour", "c_k", "b_pm"],
        "SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS v, CAST(is_installed AS INTEGER) AS y, day FROM imp",
    )
    + """), w AS (SELECT count(*) / (2.0 * count(*) FILTER (is_installed)) AS w1, count(*) / (2.0 * count(*) FILTER (NOT is_installed)) AS w0 FROM imp WHERE day < 63),
t AS (SELECT feature, v, w1 * sum(y) / (w1 * sum(y) + w0 * sum(1 - y)) > 0.5 AS yes FROM l, w WHERE day < 63 GROUP BY feature, v, w1, w0),
c AS (SELECT l.feature, count(*) FILTER (NOT coalesce(yes, false) AND y = 0) AS tn, count(*) FILTER (coalesce(yes, false) AND y = 0) AS fp,
  count(*) FILTER (NOT coalesce(yes, false) AND y = 1) AS fn, count(*) FILTER (coalesce(yes, false) AND y = 1) AS tp
  FROM l LEFT JOIN t ON t.feature = l.feature AND t.v = l.v WHERE day >= 63 GROUP BY l.feature)
SELECT feature, tn, fp, fn, tp, round(100.0 * (tn + tp) / (tn + fp + fn + tp), 9) AS accuracy,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1 FROM c""",
)

# Training jobs: the base models in full, the others with few, shallow trees

_SMALL = J.TreeSettings(2, 3, 0.1, 32)


def _table(s, d):
    return J.model_table(imp(s, d), IMP)


def _sound(df, scores, *keep):
    """The kept columns, and whether all scores lie between 0 and 1."""
    inside = reduce(and_, [F.coalesce(F.col(c).between(0, 1) & ~F.isnan(c), F.lit(False)) for c in scores])
    return df.select(*keep, inside.alias("sound"))


def _sound_sql(columns, condition):
    return with_views("imp", f"SELECT {columns}, true AS sound FROM imp WHERE {condition}")


_LABEL = "CAST(is_installed AS INTEGER) AS is_installed"


def _base_models(s, d):
    rows, features = _table(s, d)
    found = J.base_model_scores(rows, features, "row_id", "day", LAST_DAY)
    return _sound(G.join_scores(found, "row_id"), list(found), "row_id")


QUERIES["gbt_base_models"] = _base_models
SQL["gbt_base_models"] = _sound_sql("row_id", "day = 67")


def _walk_forward(s, d):
    rows, features = _table(s, d)
    found = J.walk_forward_scores(rows, features, "row_id", "day", J.TreeSettings(1, 2, 0.1, 32), weighted=True, test_day=LAST_DAY)
    return _sound(found, ["p"], "row_id", "fold", "is_installed")


QUERIES["walk_forward_model"] = _walk_forward
SQL["walk_forward_model"] = _sound_sql(f"row_id, day AS fold, {_LABEL}", "day BETWEEN 52 AND 67")


def _cat_then_num(s, d):
    rows, _ = _table(s, d)
    others = [*IMP.binary, *IMP.counter, *IMP.numeric]
    found = J.cat_then_num_scores(rows, list(IMP.categorical), others, "row_id", "day", SPLIT_DAY, _SMALL)
    return _sound(found, ["p"], "row_id", "is_installed")


QUERIES["cat_then_num_stack"] = _cat_then_num
SQL["cat_then_num_stack"] = _sound_sql(f"row_id, {_LABEL}", f"day >= {SPLIT_DAY}")


def _logistic(s, d):
    """Rows and positives of the later days per feature; sound: cells that add up, and the figures made of them."""
    rows = imp(s, d)
    found = J.per_feature_logistic(rows.where(F.col("day") < SPLIT_DAY), rows.where(F.col("day") >= SPLIT_DAY), ["n_cnt", "n_val"], rounds=5)
    n, right = F.expr("tn + fp + fn + tp"), F.expr("tn + tp")
    f1 = F.expr("CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END")
    sound = (F.abs(F.col("accuracy") - 100 * right / n) < 1e-9) & (F.abs(F.col("f1") - f1) < 1e-9) & (F.least("tn", "fp", "fn", "tp") >= 0)
    return found.select("feature", n.alias("n"), F.expr("fn + tp").alias("positives"), sound.alias("sound"))


QUERIES["per_feature_logistic"] = _logistic
SQL["per_feature_logistic"] = with_views(
    "imp",
    per_column_sql(["n_cnt", "n_val"], f"SELECT '{{c}}' AS feature, count(*) AS n, count(*) FILTER (is_installed) AS positives, true AS sound FROM imp WHERE day >= {SPLIT_DAY}"),
)


def _network(s, d):
    rows, features = _table(s, d)
    spread = S.fit_minmax(rows.where(F.col("day") < SPLIT_DAY), features)
    rows = S.apply_spread(rows, features, spread)
    found = J.network_scores(rows.where(F.col("day") < SPLIT_DAY), rows.where(F.col("day") >= SPLIT_DAY), features, "row_id", [6, 4], rounds=5)
    return _sound(found, ["p"], "row_id", "is_installed")


QUERIES["mlp_classifier"] = _network
SQL["mlp_classifier"] = _sound_sql(f"row_id, {_LABEL}", f"day >= {SPLIT_DAY}")


def _pca(s, d):
    """Per row: no projection is longer than its row. For all: fewest components for 95 % of the variance, at right angles,
    whose summed energy is that share of the variance that SQL finds."""
    rows = table(s, d, "embeddings")
    fitted = J.fit_components(rows, "embedding")
    kept = fitted.vectors.shape[1]
    shares = np.cumsum(fitted.shares)
    fewest = shares[kept - 1] >= 0.95 and (kept == 1 or shares[kept - 2] < 0.95)
    right_angles = np.abs(fitted.vectors.T @ fitted.vectors - np.eye(kept)).max() < 1e-8
    means = F.array(*[F.lit(m) for m in fitted.means])
    squares = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x)
    centred = F.zip_with("embedding", means, lambda x, m: x.cast("double") - m)
    each = J.project(rows, "embedding", fitted).select("vec_id", squares(F.col("scores")).alias("energy"), squares(centred).alias("length"))
    sums = each.select((F.sum("energy") / (F.count("*") - 1) / F.lit(float(shares[kept - 1]))).alias("variance"))
    sound = (F.col("energy") <= F.col("length") * (1 + 1e-9) + 1e-12) & F.lit(bool(fewest and right_angles))
    return each.select("vec_id", F.round(sums.scalar(), 6).alias("variance"), sound.alias("sound"))


QUERIES["pca_95"] = _pca
SQL["pca_95"] = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
v AS (SELECT sum(s) AS variance FROM (SELECT var_samp(x) AS s FROM e GROUP BY i))
SELECT vec_id, round(variance, 6) AS variance, true AS sound FROM embeddings, v"""


def _anomaly(s, d):
    rows = table(s, d, "embeddings")
    found = J.reconstruction_similarity(rows, "embedding", "label", 0.8)
    # A row is at least as near to its reconstruction as to the mean of all rows.
    return found.select("label", (F.col("mean_similarity").between(0.5, 1) & (F.col("std_similarity") >= 0)).alias("sound"))


QUERIES["reconstruction_anomaly"] = _anomaly
SQL["reconstruction_anomaly"] = "SELECT DISTINCT label, true AS sound FROM embeddings"

_GRID = {"k": [2, 8], "positive_weight": [1.0, 3.0], "pull": [0.5, 1.0]}


def _sweep(s, d):
    rows, features = _table(s, d)
    spread = S.fit_minmax(rows.where(F.col("day") < SPLIT_DAY), features)
    rows = S.apply_spread(rows, features, spread)
    trial = J.cluster_rate_trial(rows.where(F.col("day") < SPLIT_DAY), rows.where(F.col("day") >= SPLIT_DAY), features, "row_id")
    found = s.createDataFrame(J.sweep(trial, _GRID), "trial long, k long, positive_weight double, pull double, log_loss double")
    # No pulled rate is near 0 or 1, so a loss is of the order of the labels' entropy.
    return found.select("trial", "k", "positive_weight", "pull", F.col("log_loss").between(0.1, 1).alias("sound"))


QUERIES["param_sweep"] = _sweep
SQL["param_sweep"] = """SELECT row_number() OVER (ORDER BY k, w, p) - 1 AS trial, k, w AS positive_weight, p AS pull, true AS sound
FROM (SELECT unnest([2, 8])::BIGINT AS k), (SELECT unnest([1.0, 3.0])::DOUBLE AS w), (SELECT unnest([0.5, 1.0])::DOUBLE AS p)"""


def _run(s, d):
    preparation = J.Preparation(factors={"cnt": "n_cnt", "val": "n_val"}, weak={"cat": ("c_k",)})
    return _sound(predict_next_day(imp(s, d), IMP, LAST_DAY, preparation=preparation), ["is_installed"], "RowId", "is_clicked")


QUERIES["prediction_run"] = _run
SQL["prediction_run"] = _sound_sql("row_id AS RowId, CAST(0.33 AS DOUBLE) AS is_clicked", "day = 67")

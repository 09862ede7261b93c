"""Evaluation metrics as aggregations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.functions import losses, scalar
from dayglass.operators.joins import hot_lookup_join
from dayglass.session import cut_lineage


def _y(label: str) -> Column:
    return F.col(label).cast("int")


def long_scores(df: DataFrame, models: list[str], keep: list[str]) -> DataFrame:
    """(kept columns, model, p): one row per model."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in models])
    return df.select(*keep, F.explode(pairs).alias("s")).select(*keep, "s.model", "s.p")


def log_loss(df: DataFrame, label: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Mean loss and number of the rows that have both a label and a score."""
    loss = losses.log_loss(_y(label), F.col(p))
    return df.groupBy(*(by or [])).agg(F.count(loss).alias("rows"), F.avg(loss).alias("log_loss"))


def normalized_cross_entropy(
    df: DataFrame, label: str, p: str, positive_rate: float, by: list[str] | None = None
) -> DataFrame:
    """Log loss divided by the entropy of the positive rate."""
    scale = losses.entropy(positive_rate)
    return log_loss(df, label, p, by).withColumn("nce", F.col("log_loss") / F.lit(scale))


def focal_loss(df: DataFrame, label: str, p: str, gamma: float, alpha: float | None, by: list[str] | None = None) -> DataFrame:
    loss = losses.focal_loss(_y(label), F.col(p), gamma, alpha)
    return df.groupBy(*(by or [])).agg(F.count(loss).alias("rows"), F.avg(loss).alias("focal_loss"))


def focal_grad_hess(df: DataFrame, label: str, p: str, gamma: float, alpha: float | None) -> DataFrame:
    return df.withColumns(
        {
            "grad": losses.focal_gradient(_y(label), F.col(p), gamma, alpha),
            "hess": losses.focal_hessian(_y(label), F.col(p), gamma, alpha),
        }
    )


def focal_init_score(df: DataFrame, label: str, gamma: float, alpha: float | None = None) -> DataFrame:
    """Log-odds of the constant probability with the smallest total focal loss, on a grid of thousandths.

    Only the two class counts leave the data; the grid hangs on that single row.
    """
    counts = df.agg(
        F.count_if(_y(label) == 1).alias("n1"), F.count_if(_y(label) == 0).alias("n0")
    )
    grid = counts.withColumn("p", F.explode(F.transform(F.sequence(F.lit(1), F.lit(999)), lambda i: i / 1000)))
    total = F.col("n1") * losses.focal_loss(F.lit(1), F.col("p"), gamma, alpha) + F.col("n0") * losses.focal_loss(
        F.lit(0), F.col("p"), gamma, alpha
    )
    best = grid.agg(F.min_by("p", F.struct(total.alias("a"), F.col("p").alias("b"))).alias("p"))
    return best.select("p", F.ln(F.col("p") / (1 - F.col("p"))).alias("init_score"))


def confusion_matrix(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    y, q = _y(label), F.col(predicted).cast("int")
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return df.groupBy(*(by or [])).agg(*[F.count_if((y == a) & (q == b)).alias(n) for n, (a, b) in cells.items()])


def accuracy_f1(confusion: DataFrame) -> DataFrame:
    """Accuracy in percent, precision, recall and F1 from the four cells; 0 where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return confusion.withColumns(
        {
            "accuracy": ratio(100.0 * (tn + tp), tn + fp + fn + tp),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight) with weight n / (classes * n_class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.select(label, (totals["n"] / (totals["k"] * F.col("n"))).alias("weight"))


def multi_label_weights(df: DataFrame, labels: str, known: list | None = None) -> DataFrame:
    """Weights for an array column of labels: n / (labels * rows with the label); 1 for a label never seen."""
    rows = df.select(F.count("*")).scalar()
    counts = df.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    if known is not None:
        names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in known])).alias("label"))
        counts = names.join(counts, "label", "left")
    k = counts.select(F.count("*")).scalar()
    return counts.select("label", F.coalesce(rows / (k * F.col("n")), F.lit(1.0)).alias("weight"))


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive."""
    return df.agg((F.count_if(_y(label) == 0) / F.count_if(_y(label) == 1)).alias("ratio"))


def _centres(df: DataFrame, cluster: str, features: str) -> DataFrame:
    vector = array_to_vector(F.transform(features, lambda x: x.cast("double")))
    return df.groupBy(cluster).agg(
        F.count("*").alias("size"), vector_to_array(Summarizer.mean(vector)).alias("centre")
    )


def squared_distance(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def _scatter(df: DataFrame, cluster: str, features: str) -> DataFrame:
    """(cluster, size, centre, squares, spread): one row per cluster."""
    centres = cut_lineage(_centres(df, cluster, features))
    sq = squared_distance(F.col(features), F.col("centre"))
    sizes = centres.select(cluster, "size")
    inner = hot_lookup_join(df, centres, cluster, sizes, "size").where(F.col("centre").isNotNull()).groupBy(cluster).agg(F.sum(sq).alias("squares"), F.avg(F.sqrt(sq)).alias("spread"))
    return centres.join(inner, cluster)


CLUSTER_BLOCK = 1024


def _worst_overlap(per_cluster: DataFrame, cluster: str, blocks: int) -> DataFrame:
    """(cluster, overlap): the largest (spread_i + spread_j) / distance over the other clusters j.

    Clusters are cut into blocks; a task compares two blocks and gives back one maximum per cluster.
    """
    block = F.pmod(F.xxhash64(cluster), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    names = per_cluster.select(F.col(cluster).cast("string").alias("name"), "centre", "spread", block.alias("own"))
    left = names.withColumnRenamed("own", "a").withColumn("b", every)
    right = names.withColumnRenamed("own", "b").withColumn("a", every)

    def compare(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(others):
            return pd.DataFrame({"name": [], "overlap": []})
        x, z = np.array(mine["centre"].tolist()), np.array(others["centre"].tolist())
        distance = np.stack([np.sqrt(((z - row) ** 2).sum(axis=1)) for row in x])
        spread = mine["spread"].to_numpy()[:, None] + others["spread"].to_numpy()[None, :]
        same = mine["name"].to_numpy()[:, None] == others["name"].to_numpy()[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            overlap = np.where(same, -np.inf, spread / distance)
        return pd.DataFrame({"name": mine["name"], "overlap": overlap.max(axis=1)})

    pairs = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(compare, "name string, overlap double")
    return pairs.groupBy("name").agg(F.max("overlap").alias("overlap"))


def cluster_indices(df: DataFrame, cluster: str, features: str) -> DataFrame:
    """(clusters, calinski_harabasz, davies_bouldin); (1, 0.0, 1000.0) when there is one cluster."""
    per_cluster = cut_lineage(_scatter(df, cluster, features))
    k = per_cluster.count()
    if k < 2:
        return df.sparkSession.range(1).select(
            F.lit(k).cast("long").alias("clusters"), F.lit(0.0).alias("calinski_harabasz"), F.lit(1000.0).alias("davies_bouldin")
        )
    weighted = Summarizer.mean(array_to_vector("centre"), F.col("size").cast("double"))
    mean = per_cluster.agg(vector_to_array(weighted)).scalar()
    sums = per_cluster.withColumn("mean", mean).agg(
        F.sum("size").alias("n"),
        F.sum("squares").alias("within"),
        F.sum(F.col("size") * squared_distance(F.col("centre"), F.col("mean"))).alias("between"),
    )
    overlap = _worst_overlap(per_cluster, cluster, -(-k // CLUSTER_BLOCK)).agg(F.avg("overlap")).scalar()
    return sums.select(
        F.lit(k).cast("long").alias("clusters"),
        ((F.col("between") / (k - 1)) / (F.col("within") / (F.col("n") - k))).alias("calinski_harabasz"),
        overlap.alias("davies_bouldin"),
    )


def cosine_by_label(df: DataFrame, original: str, rebuilt: str, label: str) -> DataFrame:
    similarity = scalar.cosine(F.col(original), F.col(rebuilt))
    return df.groupBy(label).agg(
        F.avg(similarity).alias("mean_similarity"), F.stddev_pop(similarity).alias("std_similarity")
    )


def baseline_beaten(metrics: DataFrame, metric: str, baseline: float = 0.9607) -> DataFrame:
    return metrics.agg(
        F.count_if(F.col(metric) < baseline).alias("below"), F.count_if(F.col(metric) > baseline).alias("above")
    )

"""Scoring and post-processing of score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.functions import scalar
from dayglass.operators.joins import hot_lookup_join, rank_pairs

RERANK_CLICKED = 0.33


def weighted_blend(df: DataFrame, weights: dict[str, float] = scalar.BLEND_WEIGHTS, out: str = "score") -> DataFrame:
    return df.withColumn(out, scalar.blend(weights))


def rerank(scored: DataFrame, reference: DataFrame, row_id: str, score: str) -> DataFrame:
    """Keep the order of ``scored`` but take the values of ``reference``, smallest to smallest."""
    paired = rank_pairs(scored, reference, row_id, score, "__value")
    return paired.select(
        row_id, F.lit(RERANK_CLICKED).alias("is_clicked"), F.col("__value").alias("is_installed")
    )


def submission(ids: DataFrame, scored: DataFrame, row_id: str, score: str, clicked: float = 0.0) -> DataFrame:
    """(RowId, is_clicked, is_installed): one row per id, whether scored or not."""
    return ids.select(row_id).join(scored.select(row_id, score), row_id, "left").select(
        F.col(row_id).alias("RowId"), F.lit(clicked).alias("is_clicked"), F.col(score).alias("is_installed")
    )


def cluster_rates(train: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, rows, rate) over the training rows."""
    return train.groupBy(cluster).agg(F.count("*").alias("rows"), F.avg(F.col(label).cast("double")).alias("rate"))


def cluster_rate_predict(
    rows: DataFrame, rates: DataFrame, cluster: str, weight: float, constant: float = 0.145
) -> DataFrame:
    """Pull the cluster's rate towards a constant, less so for large clusters; unknown clusters get the constant."""
    largest = rates.select(F.max("rows")).scalar()
    table = rates.select(
        cluster, (constant + (F.col("rate") - constant) * (weight * F.col("rows") / largest)).alias("__p")
    )
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__p")))
    return (
        hot_lookup_join(rows, table, cluster, rates.select(cluster, "rows"), "rows")
        .withColumn("prediction", F.when(F.col("__p").isNull(), F.lit(constant)).otherwise(clipped))
        .drop("__p")
    )

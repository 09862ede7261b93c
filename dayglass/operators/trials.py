"""Tables of parameter trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayglass.operators.ordering import add_range, cut_points
from dayglass.session import chunk_count


def best_trial(trials: DataFrame, metric: str, trial: str, minimise: bool = True) -> DataFrame:
    """The single best row, ties to the smallest trial id."""
    value = F.col(metric) if minimise else -F.col(metric)
    order = F.struct(value.alias("a"), F.col(trial).alias("b"))
    row = F.struct(*trials.columns)
    return trials.where(F.col(metric).isNotNull()).agg(F.min_by(row, order).alias("best")).select("best.*")


def pareto_front(trials: DataFrame, low: str, high: str) -> DataFrame:
    """Rows that no other row beats on both objectives (smaller ``low``, larger ``high``).

    A row is beaten when a row with a smaller ``low`` reaches its ``high``, or an equal ``low`` exceeds it. So
    only the running maximum of ``high`` along ``low`` is needed: inside value ranges, plus the maximum of the
    earlier ranges. There is no self join.
    """
    cuts = cut_points(trials, [low], chunk_count(trials.sparkSession))[low]
    best = add_range(trials.groupBy(low).agg(F.max(high).alias("__best")), low, cuts, "__range")
    tops = best.groupBy("__range").agg(F.max("__best").alias("__top"))
    # One row per range.
    before = Window.partitionBy().orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = tops.select("__range", F.max("__top").over(before).alias("__earlier"))
    inside = Window.partitionBy("__range").orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    limits = (
        best.withColumn("__inside", F.max("__best").over(inside))
        .join(earlier, "__range")
        .select(low, "__best", F.greatest("__inside", "__earlier").alias("__limit"))
    )
    unbeaten = F.col("__limit").isNull() | (F.col("__limit") < F.col(high))
    return trials.join(limits, low).where(unbeaten & (F.col(high) == F.col("__best"))).select(*trials.columns)

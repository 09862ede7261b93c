"""Temporal splits, folds and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_split(
    df: DataFrame, day: str, threshold: int | None, first_day: int = 45, inclusive: bool = False, out: str = "split"
) -> DataFrame:
    """Mark rows as train (before the threshold day) or val. With ``inclusive`` the day itself is train."""
    if threshold is None:
        return df.withColumn(out, F.lit("train"))
    last = df.agg(F.max(day)).first()[0]
    if threshold <= first_day or last is None or threshold >= last:
        raise ValueError(f"threshold day {threshold} must lie between {first_day} and {last}")
    is_train = F.col(day) <= threshold if inclusive else F.col(day) < threshold
    return df.withColumn(out, F.when(is_train, "train").otherwise("val"))


def split_by_day(df: DataFrame, day: str, threshold: int, **options) -> tuple[DataFrame, DataFrame]:
    tagged = tag_split(df, day, threshold, out="__split", **options)
    return tuple(tagged.where(F.col("__split") == part).drop("__split") for part in ("train", "val"))


def walk_forward(df: DataFrame, day: str, first_fold: int = 52, last_fold: int = 66, start: int = 0) -> DataFrame:
    """One row per fold the row takes part in: train in folds after its day, val in the fold of its day."""
    folds = F.sequence(F.greatest(F.col(day), F.lit(first_fold)), F.lit(last_fold))
    used = df.where((F.col(day) >= start) & (F.col(day) <= last_fold))
    part = F.when(F.col("fold") > F.col(day), "train").otherwise("val")
    return used.withColumn("fold", F.explode(folds)).withColumn("part", part)


def other_days(df: DataFrame, day: str, aggregates: dict[str, Column]) -> DataFrame:
    """Per fold (= day): additive aggregates over the rows of all other days, as total minus own."""
    own = df.groupBy(day).agg(*[a.alias(name) for name, a in aggregates.items()])
    total = own.agg(*[F.sum(name).alias(name) for name in aggregates])
    return own.select(
        F.col(day).alias("fold"),
        *[F.col(name).alias(f"own_{name}") for name in aggregates],
        *[(total.select(name).scalar() - F.col(name)).alias(f"other_{name}") for name in aggregates],
    )


def exclude_days(df: DataFrame, day: str, days: tuple[int, ...] = (48, 50, 52)) -> DataFrame:
    return df.where(~F.col(day).isin(*days))


def boolean_pattern(pattern: dict[str, bool]) -> Column:
    """True where every named binary has the given value."""
    return reduce(lambda a, b: a & b, [F.col(c) if value else ~F.col(c) for c, value in pattern.items()])

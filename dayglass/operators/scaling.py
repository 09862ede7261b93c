"""Numeric transforms. Fitted statistics are small dicts by column, taken from train and applied everywhere."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass.operators.cleaning import _replace
from dayglass.operators.ordering import global_rank
from dayglass.session import chunk_count


@dataclass(frozen=True)
class Spread:
    center: dict[str, float]
    width: dict[str, float]


def _fit(df: DataFrame, columns: list[str], center, width) -> Spread:
    values = [F.col(c).cast("double") for c in columns]
    row = df.agg(
        *[center(v).alias(f"a_{c}") for c, v in zip(columns, values)],
        *[width(v).alias(f"b_{c}") for c, v in zip(columns, values)],
    ).first()
    return Spread({c: row[f"a_{c}"] for c in columns}, {c: row[f"b_{c}"] for c in columns})


def fit_zscore(df: DataFrame, columns: list[str]) -> Spread:
    """Mean and sample standard deviation."""
    return _fit(df, columns, F.avg, F.stddev_samp)


def fit_standard(df: DataFrame, columns: list[str]) -> Spread:
    """Mean and population standard deviation."""
    return _fit(df, columns, F.avg, F.stddev_pop)


def fit_minmax(df: DataFrame, columns: list[str]) -> Spread:
    return _fit(df, columns, F.min, lambda v: F.max(v) - F.min(v))


def scaled(c: str, spread: Spread) -> Column:
    """(x - center) / width; a column without spread becomes 0 on its constant value."""
    width = spread.width[c] or 1.0
    return (F.col(c).cast("double") - F.lit(spread.center[c])) / F.lit(width)


def apply_spread(df: DataFrame, columns: list[str], spread: Spread) -> DataFrame:
    return _replace(df, {c: scaled(c, spread) for c in columns})


def remove_outliers(
    df: DataFrame,
    columns: list[str],
    coefficient: float,
    spread: Spread,
    row_id: str,
    percentage: float = 0.001,
    by: str | None = None,
) -> DataFrame:
    """Replace the furthest outliers by the column mean of this table (of its ``by`` part, such as a split).

    An outlier is further than ``coefficient`` standard deviations (of train) from the (train) mean; at most
    ``floor(rows * percentage)`` of them per column are replaced, furthest first, ties by row id. Only the last
    replaced candidate of each column is brought to the driver; the replacement is then a comparison, without a
    join.
    """
    columns = [c for c in columns if spread.width[c]]
    part = F.lit("") if by is None else F.col(by)
    df = df.withColumn("__part", part)
    distance = {c: F.abs(scaled(c, spread)) for c in columns}
    # One row per part.
    own = df.groupBy("__part").agg(
        F.count("*").alias("__rows"),
        *[F.avg(F.col(c).cast("double")).alias(c) for c in columns],
        *[F.count_if(distance[c] > coefficient).alias(f"__n_{c}") for c in columns],
    )
    parts = {r["__part"]: r for r in own.collect()}
    limits = {name: int(r["__rows"] * percentage) for name, r in parts.items()}
    # Where there are no more candidates than may be replaced, all of them are, and nothing has to be ranked.
    crowded = [
        (name, c) for name, r in parts.items() for c in columns if limits[name] and r[f"__n_{c}"] > limits[name]
    ]
    edges: dict[tuple, tuple] = {}
    if crowded:
        pairs = F.array(
            *[
                F.when(
                    F.col("__part").isin([name for name, x in crowded if x == c]) & (distance[c] > coefficient),
                    F.struct(F.lit(c).alias("column"), distance[c].alias("distance")),
                )
                for c in sorted({c for _, c in crowded})
            ]
        )
        candidates = df.select(row_id, "__part", F.explode(F.array_compact(pairs)).alias("pair")).select(
            row_id, "__part", "pair.*"
        )
        ranked = global_rank(candidates, "distance", row_id, within=("__part", "column"), descending=True)
        allowed = F.create_map(*[F.lit(x) for item in limits.items() for x in item])[F.col("__part")]
        last = (
            ranked.where(F.col("rank") <= allowed)
            .groupBy("__part", "column")
            .agg(F.max_by(F.struct("distance", row_id), "rank").alias("last"))
            .collect()
        )
        edges = {(r["__part"], r["column"]): (r["last"]["distance"], r["last"][row_id]) for r in last}
    new = {}
    for c in columns:
        value = F.col(c).cast("double")
        for name, row in parts.items():
            if not limits[name] or not row[f"__n_{c}"]:
                continue
            far = distance[c] > coefficient
            if (name, c) in edges:
                edge, edge_id = edges[name, c]
                far = (distance[c] > edge) | ((distance[c] == edge) & (F.col(row_id) <= edge_id))
            value = F.when((F.col("__part") == name) & far, F.lit(row[c])).otherwise(value)
        new[c] = value
    return _replace(df, new).drop("__part")


def fit_counters(df: DataFrame, columns: list[str], digits: int = 9) -> Spread:
    """Minimum and step (smallest gap between distinct values) per counter.

    Distinct values are compared inside value ranges and over the limits between ranges, so a column with very
    many values is not sorted in one task. A column with one value has no step.
    """
    parts = chunk_count(df.sparkSession)
    shares = [i / parts for i in range(1, parts)]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.round(F.col(c).cast("double"), digits).alias("value")) for c in columns]
    )
    values = df.select(F.explode(pairs).alias("pair")).select("pair.*").where(F.col("value").isNotNull()).distinct()
    wide = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10000).alias(c) for c in columns]).first()
    cuts = F.create_map(
        *[
            x
            for c in columns
            for x in (F.lit(c), F.array(*[F.lit(v) for v in sorted(set(wide[c] or []))]).cast("array<double>"))
        ]
    )
    ranged = values.withColumn("range", F.size(F.filter(cuts[F.col("column")], lambda e: e <= F.col("value"))))
    gaps = ranged.withColumn(
        "gap", F.col("value") - F.lag("value").over(Window.partitionBy("column", "range").orderBy("value"))
    )
    ranges = gaps.groupBy("column", "range").agg(
        F.min("gap").alias("gap"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    between = F.col("low") - F.lag("high").over(Window.partitionBy("column").orderBy("range"))
    fitted = (
        ranges.withColumn("between", between)
        .groupBy("column")
        .agg(F.min("low").alias("low"), F.least(F.min("gap"), F.min("between")).alias("step"))
        .collect()
    )
    found = {r["column"]: r for r in fitted}
    for c in columns:
        if c not in found or found[c]["step"] is None:
            raise ValueError(f"counter {c} has fewer than two distinct values")
    return Spread({c: found[c]["low"] for c in columns}, {c: found[c]["step"] for c in columns})


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, cov) of the upper triangle, sample covariance over the rows without NULLs.

    Spark ML sums the d x d products inside the tasks; only matrices of that size reach the driver.
    """
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(complete).select("features")
    correlation = Correlation.corr(vectors, "features").first()[0].toArray()
    stds = vectors.select(Summarizer.std(F.col("features")).alias("std")).first()["std"].toArray()
    rows = [
        (i, j, float(stds[i] * stds[j] * (1.0 if i == j else correlation[i, j])) if stds[i] * stds[j] else 0.0)
        for i in range(len(columns))
        for j in range(i, len(columns))
    ]
    return df.sparkSession.createDataFrame(rows, "i int, j int, cov double")

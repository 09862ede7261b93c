"""Profiling aggregations: one pass over all columns wherever possible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass.operators.encoders import to_long, value_counts
from dayglass.operators.ordering import exact_quantiles, global_rank


def _per_column(df: DataFrame, columns: list[str], figures: dict) -> DataFrame:
    """One wide aggregation, turned into one row per column. ``figures`` maps a name to Column -> Column."""
    wide = df.agg(*[F.struct(*[f(F.col(c)).alias(n) for n, f in figures.items()]).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("f")) for c in columns])
    return wide.select(F.explode(rows).alias("r")).select("r.column", "r.f.*")


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    return _per_column(
        df,
        columns,
        {"non_null": F.count, "nulls": lambda c: F.count(F.when(c.isNull(), 1))},
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per numeric column."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    base = _per_column(
        df,
        columns,
        {
            "count": F.count,
            "mean": F.avg,
            "std": F.stddev_samp,
            "min": lambda c: F.min(c).cast("double"),
            "max": lambda c: F.max(c).cast("double"),
        },
    )
    table = F.create_map(
        *[
            x
            for c, q in quartiles.items()
            for x in (F.lit(c), F.array(*[F.lit(v).cast("double") for v in q]))
        ]
    )
    q = table[F.col("column")]
    return base.select(
        "column", "count", "mean", "std", "min", q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), "max"
    )


def cardinality_profile(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct non-NULL values per column, counted over the distinct (column, value) pairs."""
    if approximate:
        return _per_column(df, columns, {"distinct": F.approx_count_distinct})
    return to_long(df, columns, []).distinct().groupBy("column").agg(F.count("value").alias("distinct"))


def top_categories(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """The ``n`` most frequent values per column with the column's cardinality; ties by value as text."""
    counts = value_counts(df, columns).where(F.col("value").isNotNull())
    # Bounded state per column: the best n of each part, merged; no sort of all values of a column.
    slot = F.pmod(F.xxhash64("value"), F.lit(64))
    order = (F.col("n").desc(), F.col("value"))
    local = counts.withColumn("slot", slot).withColumn(
        "local", F.row_number().over(Window.partitionBy("column", "slot").orderBy(*order))
    )
    best = local.where(F.col("local") <= n).withColumn(
        "position", F.row_number().over(Window.partitionBy("column").orderBy(*order))
    )
    sizes = counts.groupBy("column").agg(F.count("*").alias("cardinality"))
    return best.where(F.col("position") <= n).join(sizes, "column").select(
        "column", "position", "value", F.col("n").alias("count"), "cardinality"
    )


def rows_per_day(df: DataFrame, day: str) -> DataFrame:
    return df.groupBy(day).agg(F.count("*").alias("rows")).orderBy(day)


def melt_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, value, count) over the named columns."""
    return df.unpivot([], columns, "variable", "value").groupBy("variable", "value").agg(F.count("*").alias("count"))


def day_category_coverage(df: DataFrame, day: str, column: str) -> DataFrame:
    """Days on which not every category occurs."""
    pairs = df.select(day, column).distinct()
    total = df.select(F.count_distinct(column)).scalar()
    per_day = pairs.groupBy(day).agg(F.count(column).alias("day_categories")).withColumn("all_categories", total)
    return per_day.where(F.col("day_categories") != F.col("all_categories"))


def zero_share_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of zeros (of False), largest value and mean per column."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return _per_column(
        numbers,
        columns,
        {"zero_share": lambda c: F.sum((c == 0).cast("long")) / F.count("*"), "max": F.max, "mean": F.avg},
    )


def value_histogram(df: DataFrame, column: str, unit: float | None = None, digits: int = 6) -> DataFrame:
    value = F.col(column).cast("double")
    scaled = value if unit is None else F.round(value / F.lit(unit), digits)
    return df.groupBy(scaled.alias("value")).agg(F.count("*").alias("count"))


def step_detection(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Distinct values divided by the smallest positive one, with the share of whole multiples per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    values = df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()
    units = values.groupBy("column").agg(F.min(F.when(F.col("value") > 0, F.col("value"))).alias("unit"))
    multiples = values.join(F.broadcast(units), "column").withColumn(  # one row per column
        "multiple", F.round(F.col("value") / F.col("unit"), digits)
    )
    whole = (F.col("multiple") == F.floor("multiple")).cast("double")
    shares = multiples.groupBy("column").agg(F.avg(whole).alias("whole_share"))
    return multiples.join(F.broadcast(shares), "column")


def frequent_combinations(df: DataFrame, columns: list[str], min_share: float = 0.1) -> DataFrame:
    total = df.select(F.count("*")).scalar()
    counts = df.groupBy(*columns).agg(F.count("*").alias("count"))
    return counts.withColumn("share", F.col("count") / total).where(F.col("share") > min_share)


def conditional_label_rate(df: DataFrame, condition: Column, labels: list[str]) -> DataFrame:
    return df.where(condition).agg(
        F.count("*").alias("rows"),
        *[F.sum(F.col(y).cast("long")).alias(f"{y}_count") for y in labels],
        *[F.avg(F.col(y).cast("double")).alias(f"{y}_rate") for y in labels],
    )


def label_counts(df: DataFrame, condition: Column, label: str) -> DataFrame:
    return df.where(condition).groupBy(label).agg(F.count("*").alias("count"))


def pure_combinations(df: DataFrame, binaries: list[str], label: str) -> DataFrame:
    """Every combination of the binaries with its row count, label range and whether all labels agree."""
    y = F.col(label).cast("int")
    grouped = df.groupBy(*[F.col(c).cast("int").alias(c) for c in binaries]).agg(
        F.count("*").alias("rows"), F.min(y).alias("low"), F.max(y).alias("high")
    )
    width = len(binaries)
    grid = df.sparkSession.range(2**width).select(
        *[F.shiftright("id", width - 1 - i).bitwiseAND(F.lit(1).cast("long")).cast("int").alias(c) for i, c in enumerate(binaries)]
    )
    return grid.join(grouped, binaries, "left").select(
        *binaries,
        F.coalesce("rows", F.lit(0)).alias("rows"),
        "low",
        "high",
        F.coalesce(F.col("low") == F.col("high"), F.lit(False)).alias("pure"),
    )


def all_true_all_false(df: DataFrame, binaries: list[str]) -> DataFrame:
    every = reduce(lambda a, b: a & b, [F.col(c) for c in binaries])
    none = reduce(lambda a, b: a & b, [~F.col(c) for c in binaries])
    return df.agg(F.count_if(every).alias("all_true"), F.count_if(none).alias("all_false"))


def category_counts_per_day(df: DataFrame, day: str, column: str) -> DataFrame:
    return df.groupBy(day, column).agg(F.count("*").alias("count"))


def density_per_day(df: DataFrame, day: str, column: str, points: int = 1000, skip_zeros: bool = False) -> DataFrame:
    """Gaussian kernel density of a numeric on an even grid, per day.

    Equal values are counted first; each (day, value) is then weighed at every grid point and summed before the
    shuffle, so only (day, point) sums are moved.
    """
    x = F.col(column).cast("double")
    kept = df.where(x.isNotNull() & (x != 0) if skip_zeros else x.isNotNull())
    weighted = kept.groupBy(day, x.alias("x")).agg(F.count("*").alias("w"))
    moments = weighted.groupBy(day).agg(
        F.sum("w").alias("n"),
        F.count("*").alias("values"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
    )
    # The deviation comes from the rows themselves, in one stable aggregation.
    spread = kept.groupBy(day).agg(F.stddev_samp(x).alias("std"))
    grid = moments.where("values > 1").join(spread, day).select(
        day,
        "n",
        (F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"),
        (F.col("low") - (F.col("high") - F.col("low")) / 2).alias("start"),
        (2 * (F.col("high") - F.col("low")) / (points - 1)).alias("gap"),
    )
    at = F.col("start") + F.col("point") * F.col("gap")
    kernel = F.col("w") * F.exp(-F.pow(at - F.col("x"), F.lit(2.0)) / (2 * F.col("h") * F.col("h")))
    scale = F.col("n") * F.col("h") * F.sqrt(2 * F.pi())
    return (
        weighted.join(grid, day)
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .groupBy(day, "point", "n", "h", "start", "gap")
        .agg(F.sum(kernel).alias("total"))
        .select(day, "point", at.alias("at"), (F.col("total") / scale).alias("density"))
    )


def series_per_day(df: DataFrame, day: str, row_id: str, column: str) -> DataFrame:
    """The values of a feature numbered in row order inside each day."""
    return global_rank(df.select(day, row_id, column), row_id, row_id, within=(day,), out="position")

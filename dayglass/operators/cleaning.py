"""Projection, cleaning and derived columns."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.functions import scalar
from dayglass.roles import Roles


def _replace(df: DataFrame, new: dict) -> DataFrame:
    return df.withColumns(new) if new else df


def drop_useless(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def select_by_role(df: DataFrame, roles: Roles, *names: str) -> DataFrame:
    return df.select(*[c for c in roles.columns(*names) if c in df.columns])


def bools_to_int(df: DataFrame, columns: list[str]) -> DataFrame:
    return _replace(df, {c: scalar.bool_to_int(F.col(c)) for c in columns})


def nulls_for_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN becomes NULL and floats become doubles, so that aggregates skip missing values."""
    return _replace(df, {c: scalar.nan_to_null(F.col(c).cast("double")) for c in columns})


def add_trig_date(df: DataFrame, day: str) -> DataFrame:
    return df.withColumns({"sin_date": scalar.sin_date(F.col(day)), "cos_date": scalar.cos_date(F.col(day))})


def collapse_binary(df: DataFrame, groups: dict[str, list[str]], drop: bool = True) -> DataFrame:
    """Each group of binaries becomes one category."""
    wide = df.withColumns({name: scalar.bits(columns) for name, columns in groups.items()})
    gone = {c for columns in groups.values() for c in columns}
    return wide.drop(*gone) if drop else wide


def column_means(df: DataFrame, columns: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Most frequent value per numeric column, ties to the smallest; None for a column of NULLs.

    All columns are counted in one scan and one shuffle, by column and value.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    counts = df.select(F.explode(pairs).alias("x")).where(F.col("x.value").isNotNull()).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))
    top = counts.groupBy("column").agg(F.min_by("value", F.struct((-F.col("n")).alias("a"), F.col("value").alias("b"))).alias("top"))
    found = {r["column"]: r["top"] for r in top.collect()}
    return {c: found.get(c) for c in columns}


def fill(df: DataFrame, values: dict[str, float]) -> DataFrame:
    known = {c: v for c, v in values.items() if v is not None}
    return _replace(df, {c: F.coalesce(F.col(c), F.lit(v)) for c, v in known.items()})


def fill_const(df: DataFrame, columns: list[str], value: int = -100) -> DataFrame:
    return _replace(df, {c: F.coalesce(F.col(c), F.lit(value).cast(df.schema[c].dataType)) for c in columns})


def zero_shares(df: DataFrame, columns: list[str]) -> dict[str, float]:
    row = df.agg(
        *[(F.sum((F.col(c) == 0).cast("long")) / F.count("*")).alias(c) for c in columns]
    ).first()
    return {c: row[c] or 0.0 for c in columns}


def log_or_binarise(df: DataFrame, shares: dict[str, float], limit: float = 0.95) -> DataFrame:
    """Counters that are nearly always zero in train become "not zero" flags, the others ln(x + 0.5)."""
    return _replace(
        df,
        {
            c: (F.col(c) != 0).cast("double") if share > limit else scalar.log_shift(F.col(c).cast("double"))
            for c, share in shares.items()
        },
    )


def rescale_units(df: DataFrame, units: dict[str, float]) -> DataFrame:
    return _replace(df, {c: F.col(c).cast("double") / F.lit(u) for c, u in units.items()})


def sample_rows(df: DataFrame, row_id: str, seed: int, n: int | None = None, fraction: float | None = None) -> DataFrame:
    """A repeatable random choice: the ``n`` rows with the smallest hashes, or a fraction of the hash space.

    Only rows whose hash is below a bound, about twice as many as are wanted, are sorted; should there be fewer than
    ``n`` of them, all are.
    """
    key = scalar.sample_key(F.col(row_id), seed)
    space = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    if n is not None:
        bound = math.ceil(2**32 * (2 * n + 1000) / max(1, df.count()))
        near = df.where(space < bound)
        if bound >= 2**32 or near.count() < n:
            near = df
        return near.withColumn("__key", key).orderBy("__key", row_id).limit(n).drop("__key")
    return df.where(space < int(fraction * 2**32))


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    """Dense vector of the feature columns; a NULL is an error."""
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(df)


def head_sorted(df: DataFrame, day: str, row_id: str, n: int | None = None) -> DataFrame:
    ordered = df.orderBy(day, row_id)
    return ordered if n is None else ordered.limit(n)

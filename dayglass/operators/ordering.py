"""Global ranks and row numbers without a window that puts one group into one task.

Rows are first put into value ranges whose limits come from approximate quantiles. A value that fills whole
ranges by itself is cut further by row id. Windows then run inside a range, and the sizes of the earlier
ranges are added. The result does not depend on how Spark happens to partition the rows.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayglass.session import chunk_count


def cut_points(df: DataFrame, columns: list[str], parts: int) -> dict[str, list[float]]:
    """About ``parts - 1`` quantiles per column, repeats kept, from one aggregation."""
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(
        *[F.percentile_approx(F.col(c).cast("double"), shares, 10000).alias(c) for c in columns]
    ).first()
    return {c: sorted(row[c] or []) for c in columns}


def add_range(df: DataFrame, column: str, cuts: list[float], out: str) -> DataFrame:
    """Number of the value range of ``column``: limits belong to the upper range, NULL to the last one."""
    inner = sorted({c for c in cuts if float("-inf") < c < float("inf")})
    if not inner:
        return df.withColumn(out, F.lit(0))
    shadow = f"{out}__value"
    value = F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(float("inf"))), F.lit(float("inf")))
    ranges = Bucketizer(
        splits=[float("-inf"), *inner, float("inf")], inputCol=shadow, outputCol=out
    ).transform(df.withColumn(shadow, value))
    return ranges.withColumn(out, F.col(out).cast("int")).drop(shadow)


def global_rank(
    df: DataFrame,
    order: str,
    row_id: str,
    within: tuple[str, ...] = (),
    out: str = "rank",
    descending: bool = False,
) -> DataFrame:
    """1-based rank by (``order``, ``row_id``) inside each ``within`` group; NULLs rank last.

    Ranges come from ``order`` as a double, which can be the same for different large numbers of an exact type; the rows
    of a range are ordered by the value itself.
    """
    parts = chunk_count(df.sparkSession)
    sign = -1.0 if descending else 1.0
    exact = isinstance(df.schema[order].dataType, (T.IntegralType, T.DecimalType))
    keyed = df.withColumns({"__order": F.col(order).cast("double") * sign, "__own": F.col(order) if exact else F.col(order).cast("double") * sign})
    names = ["__order"] if order == row_id else ["__order", row_id]
    cuts = cut_points(keyed, names, parts)
    repeated = sorted({a for a, b in zip(cuts["__order"], cuts["__order"][1:]) if a == b})
    ranged = add_range(keyed, "__order", cuts["__order"], "__range")
    if order != row_id:
        ranged = add_range(ranged, row_id, cuts[row_id], "__id_range")
        # A repeated limit is the smallest value of its range, so its rows come before the others, after those whose
        # double is the same though they are before it. NULLs close the last range and are cut by row id as well.
        kind = ranged.schema["__own"].dataType
        hot, early = F.lit(False), F.lit(False)
        for limit in repeated:
            value = F.lit(limit * sign if exact else limit).cast(kind)
            same = F.col("__order") == limit
            hot = hot | (same & (F.col("__own") == value))
            early = early | (same & ((F.col("__own") > value) if exact and descending else (F.col("__own") < value)))
        step = F.when(F.col("__order").isNull(), 3).when(hot, 1).when(early, 0).otherwise(2)
        sub = F.when(F.col("__order").isNull() | hot, F.col("__id_range")).otherwise(0)
    else:
        step, sub = F.lit(0), F.lit(0)
    ranged = ranged.withColumn("__step", step).withColumn("__sub", sub).drop("__id_range")

    piece = [*within, "__range", "__step", "__sub"]
    pieces = ranged.groupBy(*piece).agg(F.count("*").alias("__n"))
    # Runs over pieces only: at most a few rows per range.
    before = Window.partitionBy(*within).orderBy("__range", "__step", "__sub").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = pieces.select(*piece, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.col("__own").desc_nulls_last() if exact and descending else F.col("__own").asc_nulls_last()
    inside = Window.partitionBy(*piece).orderBy(own, row_id)
    return (
        ranged.withColumn("__local", F.row_number().over(inside))
        .join(offsets, piece)
        .withColumn(out, (F.col("__local") + F.col("__before")).cast("long"))
        .drop("__order", "__own", "__range", "__step", "__sub", "__local", "__before")
    )


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of several columns, exact and without a full sort; None for a column of NULLs.

    Approximate quantiles bracket each wanted rank by some ranks more than their error on both sides; one aggregation
    counts the rows below every bracket, and only values inside are grouped and numbered. Columns whose ranks turn
    out to lie outside a bracket are done again with wider ones.
    """
    wide = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    sizes = wide.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    result: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    open_columns, slack = [c for c in columns if sizes[c]], 2.0 / 10000
    while open_columns:
        found = _bracketed(wide, open_columns, sizes, shares, slack)
        result.update(found)
        open_columns, slack = [c for c in open_columns if c not in found], slack * 8
    return result


def _bracketed(wide: DataFrame, columns: list[str], sizes: dict[str, int], shares: list[float], slack: float) -> dict[str, list[float]]:
    """The quantiles of those columns all of whose wanted ranks lie inside their brackets."""
    reach = {c: slack + 2.0 / sizes[c] for c in columns}
    stats = wide.agg(
        *[F.percentile_approx(c, [max(0.0, p - reach[c]) for p in shares], 10000).alias(f"{c}__low") for c in columns],
        *[F.percentile_approx(c, [min(1.0, p + reach[c]) for p in shares], 10000).alias(f"{c}__high") for c in columns],
    ).first()
    brackets = {(c, i): (stats[f"{c}__low"][i], stats[f"{c}__high"][i]) for c in columns for i in range(len(shares))}
    below = wide.agg(*[F.count(F.when(F.col(c) < lo, 1)).alias(f"{c}__{i}") for (c, i), (lo, _) in brackets.items()]).first()

    def tagged(c: str) -> Column:
        hits = [
            F.when(F.col(c).between(*brackets[c, i]), F.struct(F.lit(c).alias("name"), F.lit(i).alias("i"), F.col(c).alias("value")))
            for i in range(len(shares))
        ]
        return F.array(*hits)

    near = wide.select(F.explode(F.array_compact(F.concat(*[tagged(c) for c in columns]))).alias("hit")).select("hit.*")
    counted = near.groupBy("name", "i", "value").agg(F.count("*").alias("n"))
    running = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("name", "i").orderBy("value")))
    wanted: list[Column] = []
    inside: dict[tuple[str, int], tuple[float, int, int]] = {}
    for c, i in brackets:
        rank = shares[i] * (sizes[c] - 1) + 1
        ranks = int(rank), min(int(rank) + 1, sizes[c])
        inside[c, i] = (rank - int(rank), *(k - below[f"{c}__{i}"] for k in ranks))
        for k, name in zip(inside[c, i][1:], ("lower", "upper")):
            here = (F.col("name") == c) & (F.col("i") == i) & (F.col("upto") >= k)
            wanted.append(F.min(F.when(here, F.col("value"))).alias(f"{c}__{i}__{name}"))
    picked = running.agg(*wanted).first()
    found: dict[str, list[float]] = {}
    for c in columns:
        values = []
        for i in range(len(shares)):
            part, first, _ = inside[c, i]
            a, b = picked[f"{c}__{i}__lower"], picked[f"{c}__{i}__upper"]
            if first < 1 or a is None or b is None:
                break
            values.append(a + (b - a) * part)
        else:
            found[c] = values
    return found

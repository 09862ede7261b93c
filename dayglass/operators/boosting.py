"""One histogram boosting round as aggregations: bins, gradient sums, best splits, leaf values."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass.functions import losses, scalar
from dayglass.session import cut_lineage


@dataclass(frozen=True)
class BoostParams:
    bins: int = 32
    depth: int = 2
    learning_rate: float = 0.1
    l2: float = 1.0
    min_rows: int = 20
    gamma: float = 0.0
    alpha: float | None = None


def fit_bins(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """(min, max) per feature."""
    row = df.agg(
        *[F.struct(F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double"))).alias(c) for c in features]
    ).first()
    return {c: tuple(row[c]) for c in features}


def bin_of(c: str, limits: tuple[float, float], bins: int) -> Column:
    """Equal-width bin 1..bins; NULL is bin 0, which every split sends left."""
    low, high = limits
    if low is None:
        return F.lit(0)
    x = F.col(c).cast("double")
    inside = F.lit(1) if high == low else 1 + F.floor((x - low) / (high - low) * bins)
    return F.when(x.isNull(), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(bins), inside))).cast("int")


def bin_by_borders(c: str, borders: list[float]) -> Column:
    """1 plus the number of ascending ``borders`` below the value; NULL and NaN are bin 0."""
    x = F.col(c).cast("double")
    below = F.size(F.filter(F.array(*[F.lit(float(b)) for b in borders]), lambda b: b < x)) if borders else F.lit(0)
    return F.when(x.isNull() | F.isnan(x), 0).otherwise(1 + below).cast("int")


def add_gradients(df: DataFrame, label: str, params: BoostParams) -> DataFrame:
    """Gradient and hessian of the (focal) log loss at the current raw score."""
    p, y = scalar.sigmoid(F.col("raw")), F.col(label).cast("int")
    return df.withColumns(
        {
            "g": losses.focal_gradient(y, p, params.gamma, params.alpha),
            "h": losses.focal_hessian(y, p, params.gamma, params.alpha),
        }
    )


def best_splits(df: DataFrame, features: list[str], params: BoostParams) -> DataFrame:
    """(node, feature, bin, gain): rows with a bin up to ``bin`` go left.

    Rows are summed per (node, feature, bin) before the shuffle; prefix sums run over at most ``bins + 1`` rows.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"bin_{c}").alias("bin")) for c in features])
    sums = (
        df.select("node", "g", "h", F.explode(pairs).alias("b"))
        .groupBy("node", "b.feature", "b.bin")
        .agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))
    )
    upto = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "feature")
    sides = sums.select(
        "node",
        "feature",
        "bin",
        *[F.sum(c).over(upto).alias(f"{c}_left") for c in ("g", "h", "n")],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("g", "h", "n")],
    )
    g_right, h_right = F.col("g_all") - F.col("g_left"), F.col("h_all") - F.col("h_left")

    def strength(g: Column, h: Column) -> Column:
        return g * g / (h + params.l2)

    gain = strength(F.col("g_left"), F.col("h_left")) + strength(g_right, h_right) - strength(F.col("g_all"), F.col("h_all"))
    enough = (F.col("n_left") >= params.min_rows) & (F.col("n_all") - F.col("n_left") >= params.min_rows)
    order = F.struct((-F.round("gain", 9)).alias("a"), F.col("feature").alias("b"), F.col("bin").alias("c"))
    best = F.min_by(F.struct("feature", "bin", "gain"), order)
    return sides.withColumn("gain", gain).where(enough).groupBy("node").agg(best.alias("s")).select("node", "s.*")


def grow_level(df: DataFrame, features: list[str], params: BoostParams) -> tuple[DataFrame, list]:
    """Split every node once; children of node i are 2i (left) and 2i + 1. Splits are at most one per node."""
    splits = best_splits(df, features, params).collect()
    node = F.col("node")
    new = node * 2
    for s in splits:
        new = F.when(node == s["node"], node * 2 + (F.col(f"bin_{s['feature']}") > s["bin"]).cast("int")).otherwise(new)
    return df.withColumn("node", new), splits


def leaf_values(df: DataFrame, params: BoostParams) -> DataFrame:
    value = -params.learning_rate * F.sum("g") / (F.sum("h") + params.l2)
    return df.groupBy("node").agg(F.count("*").alias("rows"), value.alias("value"))


def start_state(
    df: DataFrame, row_id: str, features: list[str], label: str, params: BoostParams, start: float, borders: dict[str, list[float]] | None = None
) -> DataFrame:
    """Bins of equal width, or between ``borders`` of a feature where these are given (equal shares: ``quantile_borders``)."""
    if borders is None:
        limits = fit_bins(df, features)
        bins = [bin_of(c, limits[c], params.bins) for c in features]
    else:
        bins = [bin_by_borders(c, borders[c]) for c in features]
    return df.select(row_id, label, F.lit(start).alias("raw"), *[b.alias(f"bin_{c}") for b, c in zip(bins, features)])


def boosting_round(state: DataFrame, features: list[str], label: str, params: BoostParams) -> tuple[DataFrame, list, list]:
    """One tree: (state with new raw scores and leaf nodes, splits per level, leaves)."""
    df = add_gradients(state.drop("node"), label, params).withColumn("node", F.lit(1))
    levels = []
    for _ in range(params.depth):
        df, splits = grow_level(df, features, params)
        levels.append(splits)
    leaves = leaf_values(df, params).collect()
    table = F.create_map(*chain.from_iterable((F.lit(r["node"]), F.lit(r["value"])) for r in leaves))
    return df.withColumn("raw", F.col("raw") + table[F.col("node")]).drop("g", "h"), levels, leaves


def boost(df: DataFrame, row_id: str, features: list[str], label: str, params: BoostParams, start: float, rounds: int) -> DataFrame:
    """Several rounds; the raw scores are written between rounds so that the plan does not grow."""
    state = start_state(df, row_id, features, label, params, start)
    for _ in range(rounds):
        state = cut_lineage(boosting_round(state, features, label, params)[0])
    return state.select(row_id, F.col(label), "raw", scalar.sigmoid(F.col("raw")).alias("p"))

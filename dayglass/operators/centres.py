"""Clusterings around k centres: weighted k-means, k-modes and k-prototypes.

The state of a round is the table of centres: k rows, a parameter of the model, kept in the driver and sent to
the tasks as literals. Rows are assigned in place and only per-centre sums and counts are shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.functions import scalar
from dayglass.operators.encoders import _is_text, _sort_key, to_long
from dayglass.session import cut_lineage


def first_rows(df: DataFrame, row_id: str, k: int) -> list:
    """The k rows with the smallest ids, as first centres."""
    return df.orderBy(row_id).limit(k).collect()


def _nearest(centres: np.ndarray):
    """A vectorised column function: (cluster, distance) of the nearest centre, ties to the smallest cluster."""

    @F.pandas_udf("cluster int, distance double")
    def nearest(features: pd.Series) -> pd.DataFrame:
        x = np.array(features.tolist(), dtype=float).reshape(len(features), -1)
        best = np.zeros(len(x), dtype=np.int32)
        least = np.full(len(x), np.inf)
        for j, centre in enumerate(centres):
            squares = ((x - centre) ** 2).sum(axis=1)
            closer = squares < least
            best[closer], least[closer] = j, squares[closer]
        return pd.DataFrame({"cluster": best, "distance": np.sqrt(least)})

    return nearest


def assign_kmeans(df: DataFrame, features: str, centres: list[list[float]]) -> DataFrame:
    found = _nearest(np.array(centres, dtype=float))(F.transform(features, lambda v: v.cast("double")))
    return df.withColumn("__found", found).select(*df.columns, "__found.cluster", "__found.distance")


def _draw(row_id: Column, seed: int) -> Column:
    """A number between 0 and 1 from a hash of the id, which other engines can take too."""
    return (F.conv(F.substring(scalar.sample_key(row_id, seed), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def seed_centres(
    df: DataFrame,
    row_id: str,
    features: str,
    k: int,
    label: str | None = None,
    positive_weight: float = 1.0,
    rounds: int = 5,
    oversampling: float | None = None,
    seed: int = 1,
) -> list[list[float]]:
    """First centres far from each other: oversampling rounds over all rows, then one draw among the few rows found.

    The row with the smallest hash comes first. In each round a row joins the candidates with probability
    ``oversampling`` (2 k unless given) times its share of the weighted squared distances to the candidates so far; so
    about ``rounds * oversampling`` candidates are found in as many passes, however many rows there are. Each candidate
    then weighs as much as the rows nearest to it, and k of them are drawn one by one, in proportion to that weight and
    the squared distance to those drawn before. Draws are hashes of ids, so the result does not depend on partitions.
    Rows that share an id, and candidates at the same place, are drawn once. Fewer different rows than k give as many centres.
    """
    wanted = 2.0 * k if oversampling is None else oversampling
    weight = F.lit(1.0) if label is None else F.when(F.col(label).cast("int") == 1, float(positive_weight)).otherwise(1.0)
    rows = df.select(F.col(row_id).alias("id"), F.transform(features, lambda v: v.cast("double")).alias("x"), weight.alias("w"))
    first = rows.orderBy(_draw(F.col("id"), seed), "id").limit(1).collect()
    if not first:
        return []
    found = {first[0]["id"]: list(first[0]["x"])}
    for i in range(1, rounds + 1):
        near = rows.withColumn("d", _nearest(np.array(list(found.values())))("x")["distance"]).withColumn("cost", F.col("w") * F.col("d") * F.col("d"))
        total = near.agg(F.sum("cost")).first()[0]
        if not total:
            break
        drawn = near.where(_draw(F.col("id"), seed + i) * total < wanted * F.col("cost")).select("id", "x").collect()
        found.update({r["id"]: list(r["x"]) for r in drawn})
    names = sorted(found)
    points = np.array([found[n] for n in names])
    near = rows.withColumn("at", _nearest(points)("x")["cluster"])
    sizes = np.zeros(len(names))
    for r in near.groupBy("at").agg(F.sum("w").alias("w")).collect():
        sizes[r["at"]] = r["w"]
    # Exponential races: the smallest -ln(u) / weight is a draw in proportion to the weights. ``u`` comes from the id and the turn.
    least, chosen = np.full(len(names), np.inf), []
    for turn in range(k):
        chance = sizes * (1.0 if not chosen else least)
        u = np.array([(int(hashlib.md5(f"{n}|{seed + rounds + 1 + turn}".encode()).hexdigest()[:8], 16) + 0.5) / (1 << 32) for n in names])
        with np.errstate(divide="ignore"):
            race = np.where(chance > 0, -np.log(u) / chance, np.inf)
        if not np.isfinite(race).any():
            break
        chosen.append(int(race.argmin()))
        least = np.minimum(least, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen].tolist()


def kmeans_step(df: DataFrame, features: str, centres: list[list[float]], weight: Column | None = None) -> list[list[float]]:
    """New centres: the weighted mean of each cluster's rows; an empty cluster keeps its centre."""
    assigned = assign_kmeans(df, features, centres)
    vector = array_to_vector(F.transform(features, lambda v: v.cast("double")))
    mean = Summarizer.mean(vector) if weight is None else Summarizer.mean(vector, weight.cast("double"))
    new = list(centres)
    for row in assigned.groupBy("cluster").agg(vector_to_array(mean).alias("centre")).collect():
        new[row["cluster"]] = list(row["centre"])
    return new


def kmeans(
    df: DataFrame,
    row_id: str,
    features: str,
    k: int,
    rounds: int,
    label: str | None = None,
    positive_weight: float = 1.0,
    centres: list[list[float]] | None = None,
) -> tuple[DataFrame, list[list[float]]]:
    """Lloyd rounds from fixed first centres; rows with a positive label weigh ``positive_weight``."""
    if centres is None:
        centres = [[float(v) for v in r[features]] for r in first_rows(df, row_id, k)]
    weight = None if label is None else F.when(F.col(label).cast("int") == 1, positive_weight).otherwise(1.0)
    for _ in range(rounds):
        centres = kmeans_step(df, features, centres, weight)
    return assign_kmeans(df, features, centres).select(row_id, "cluster", "distance"), centres


@dataclass
class MixedCentre:
    """One centre of k-modes (no numbers) or k-prototypes. Modes are written as texts, so every type keeps its values."""

    modes: dict[str, str | None]
    means: dict[str, float] = field(default_factory=dict)
    frequency: dict[str, float] = field(default_factory=dict)


def assign_mixed(df: DataFrame, centres: list[MixedCentre], gamma: float = 1.0, by_frequency: bool = False) -> DataFrame:
    """Adds ``cluster`` and ``cost`` of the cheapest centre, ties to the first; NULL where a number is missing.

    Within a batch the values of a column become the numbers of the centres' modes, so that rows are compared with all
    centres by whole numbers, however many centres and columns there are.
    """
    cats, nums, k = list(centres[0].modes), list(centres[0].means), len(centres)
    names = {c: pd.Index(sorted({m.modes[c] for m in centres if m.modes[c] is not None})) for c in cats}
    modes = {c: np.array([-2 if m.modes[c] is None else names[c].get_loc(m.modes[c]) for m in centres]) for c in cats}
    match = {c: gamma * np.array([1.0 - m.frequency.get(c, 1.0) if by_frequency else 0.0 for m in centres]) for c in cats}
    means = {c: np.array([m.means[c] for m in centres], float) for c in nums}

    @F.pandas_udf("cluster int, cost double")
    def cheapest(rows: pd.DataFrame) -> pd.DataFrame:
        cluster, cost = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        step = max(1, (1 << 20) // k)
        codes = {c: np.where(rows[c].isna(), -2, names[c].get_indexer(rows[c])) for c in cats}
        values = {c: rows[c].to_numpy(float) for c in nums}
        for low in range(0, len(rows), step):
            part = slice(low, low + step)
            total = np.zeros((len(cluster[part]), k))
            for c in cats:
                total += np.where(codes[c][part, None] == modes[c], match[c], gamma)
            for c in nums:
                total += (values[c][part, None] - means[c]) ** 2
            total = np.round(total, 9)
            cluster[part] = total.argmin(axis=1)
            cost[part] = total[np.arange(len(total)), cluster[part]]
        missing = np.isnan(cost)
        return pd.DataFrame({"cluster": pd.Series(cluster, dtype="Int32").mask(missing), "cost": pd.Series(cost, dtype="Float64").mask(missing)})

    columns = [F.col(c).cast("string").alias(c) for c in cats] + [F.col(c).cast("double").alias(c) for c in nums]
    return df.withColumn("__found", cheapest(F.struct(*columns))).select(*df.columns, "__found.cluster", "__found.cost")


def _mixed_step(df: DataFrame, centres: list[MixedCentre], cats: list[str], nums: list[str], gamma: float, by_frequency: bool) -> list[MixedCentre]:
    assigned = assign_mixed(df, centres, gamma, by_frequency).where(F.col("cluster").isNotNull())
    texts = [c for c in cats if _is_text(df, c)]
    counts = to_long(assigned, cats, ["cluster"]).groupBy("cluster", "column", "value").agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n")).alias("a"), F.col("value").isNull().alias("b"), _sort_key(texts).alias("c"), F.col("value").alias("d"))
    tops = counts.groupBy("cluster", "column").agg(
        F.min_by(F.struct("value", "n"), order).alias("top"), F.sum("n").alias("size")
    )
    new = [MixedCentre(dict(c.modes), dict(c.means), dict(c.frequency)) for c in centres]
    for row in tops.collect():
        value, centre = row["top"]["value"], new[row["cluster"]]
        centre.modes[row["column"]] = value
        centre.frequency[row["column"]] = row["top"]["n"] / row["size"]
    if nums:
        means = assigned.groupBy("cluster").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in nums])
        for row in means.collect():
            new[row["cluster"]].means = {c: row[c] for c in nums}
    return new


def _first_mixed(df: DataFrame, row_id: str, cats: list[str], nums: list[str], k: int) -> list[MixedCentre]:
    written = df.select(row_id, *[F.col(c).cast("string").alias(c) for c in cats], *nums)
    return [MixedCentre({c: r[c] for c in cats}, {c: float(r[c]) for c in nums}) for r in first_rows(written, row_id, k)]


def kmodes(
    df: DataFrame, row_id: str, columns: list[str], k: int, rounds: int, by_frequency: bool = False
) -> tuple[DataFrame, list[MixedCentre]]:
    """Mismatch counts to per-column modes. With ``by_frequency`` a match still costs one minus the share the
    mode has in its cluster (known from the second round on)."""
    df = cut_lineage(df.select(row_id, *columns))
    centres = _first_mixed(df, row_id, columns, [], k)
    for _ in range(rounds):
        centres = _mixed_step(df, centres, columns, [], 1.0, by_frequency)
    return assign_mixed(df, centres, 1.0, by_frequency).select(row_id, "cluster", "cost"), centres


def kprototypes(
    df: DataFrame, row_id: str, cats: list[str], nums: list[str], k: int, rounds: int, gamma: float | None = None
) -> tuple[DataFrame, list[MixedCentre]]:
    """Squared distance on the numerics plus ``gamma`` per mismatch; half the mean deviation when not given."""
    df = cut_lineage(df.select(row_id, *cats, *nums))
    if gamma is None:
        row = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in nums]).first()
        gamma = 0.5 * sum(row[c] for c in nums) / len(nums)
    centres = _first_mixed(df, row_id, cats, nums, k)
    for _ in range(rounds):
        centres = _mixed_step(df, centres, cats, nums, gamma, False)
    return assign_mixed(df, centres, gamma).select(row_id, "cluster", "cost"), centres

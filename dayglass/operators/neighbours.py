"""Exact k nearest neighbours without comparing every query with every training row.

Training rows go to the nearest of about as many pivots as the root of their number; pivots belong to coarse ones, as many
as the root of theirs, so that nothing is compared with all pivots. A query first meets the rows of the pieces around it,
which gives a real k-th distance; by the triangle inequality only pieces that can hold a nearer row are visited then.
Pieces and their visitors are split into blocks of bounded size, each block pair is compared with numpy and gives back only
its k best rows per query. Equal rows are one point: a point is asked for once, whatever the number of its queries, and
compared once, whatever the number of its training rows, of which only the k first can be neighbours.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass.operators.joins import largest_keys, lookup_join
from dayglass.session import cut_lineage

BLOCK = 4096
DIGITS = 9
#: Distances of a block that are looked at together.
STEP = 1 << 18
#: Coarse pivots around a row's own one whose pivots are tried for it.
AROUND = 4


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances between the rows of a and b, one dimension at a time."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        gap = a[:, i, None] - b[None, :, i]
        total += np.abs(gap) if metric == "manhattan" else gap * gap
    return total if metric == "manhattan" else np.sqrt(total)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


def _vectors(df: DataFrame, row_id: str, features: list[str], metric: str, extra: list, zero_axis: int) -> DataFrame:
    """(id, x, extra). For cosine the vectors get unit length, so that plain distance has the same order; a zero
    vector gets an axis of its own and is equally far from everything."""
    # Written first, so that a coordinate is worked out once, however often the vector's expression names it.
    values = [f"x{i}" for i in range(len(features))]
    df = cut_lineage(df.select(F.col(row_id).cast("long").alias("id"), *extra, *[F.col(c).cast("double").alias(v) for c, v in zip(features, values)]))
    x = F.array(*values)
    if metric == "cosine":
        size = F.sqrt(sum((F.col(v) * F.col(v) for v in values), F.lit(0.0)))
        axes = [F.when(size == 0, 1.0).otherwise(0.0) if i == zero_axis else F.lit(0.0) for i in range(2)]
        x = F.array(*[F.when(size > 0, F.col(v) / size).otherwise(0.0) for v in values], *axes)
    return df.select(*df.columns[: -len(values)], x.alias("x"))


def _spot(x: str) -> Column:
    """The coordinates as a text, which tells all doubles apart."""
    return F.concat_ws("|", F.transform(x, lambda v: v.cast("string")))


@dataclass
class Pieces:
    """Pivots, the coarse pivot of each, and the rows of each pivot's piece: number, least and greatest distance."""

    pivots: np.ndarray
    metric: str
    coarse: np.ndarray
    owner: np.ndarray
    sizes: np.ndarray | None = None
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @classmethod
    def of(cls, pivots: np.ndarray, metric: str) -> "Pieces":
        coarse = pivots[: math.isqrt(len(pivots) - 1) + 1]
        return cls(pivots, metric, coarse, _distances(pivots, coarse, metric).argmin(axis=1))

    def _groups(self) -> tuple[list[np.ndarray], np.ndarray]:
        """The pivots of each coarse pivot, and the coarse pivots in the order of their distance from each."""
        own = [np.flatnonzero(self.owner == c) for c in range(len(self.coarse))]
        return own, _distances(self.coarse, self.coarse, self.metric).argsort(axis=1, kind="stable")

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A near pivot of each point (the nearest of those tried) and its distance."""
        own, order = self._groups()
        best, distance = np.zeros(len(points), np.int64), np.full(len(points), np.inf)
        home = np.concatenate([_distances(points[i : i + 1024], self.coarse, self.metric).argmin(axis=1) for i in range(0, len(points), 1024)] or [best])
        for c in np.unique(home):
            rows = np.flatnonzero(home == c)
            tried = np.concatenate([own[o] for o in order[c][:AROUND]])
            for low in range(0, len(rows), 1024):
                some = rows[low : low + 1024]
                d = _distances(points[some], self.pivots[tried], self.metric)
                at = d.argmin(axis=1)
                best[some], distance[some] = tried[at], d[np.arange(len(some)), at]
        return best, distance

    def around(self, points: np.ndarray, k: int) -> list[np.ndarray]:
        """For each point the pieces of pivots near it, nearest first, until they hold ``k`` rows (or all rows)."""
        own, order = self._groups()
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(points)
        for low in range(0, len(points), 1024):
            home = _distances(points[low : low + 1024], self.coarse, self.metric).argmin(axis=1)
            for c in np.unique(home):
                rows, reach, tried = np.flatnonzero(home == c), AROUND, np.zeros(0, np.int64)
                while not len(tried) or (self.sizes[tried].sum() < k and reach < 2 * len(order)):
                    tried = np.concatenate([own[o] for o in order[c][:reach]])
                    reach *= 2
                near = _distances(points[low + rows], self.pivots[tried], self.metric).argsort(axis=1, kind="stable")
                held = self.sizes[tried][near].cumsum(axis=1)
                for row, n, upto in zip(rows, near, held):
                    taken = tried[n[: int((upto < k).sum()) + 1]]
                    found[low + row] = taken[self.sizes[taken] > 0]
        return found

    def within(self, points: np.ndarray, limits: np.ndarray) -> list[np.ndarray]:
        """For each point the pieces that may have a row within its limit."""
        own, _ = self._groups()
        parts: list[list[np.ndarray]] = [[] for _ in points]
        limits = limits + 1e-6 * (1 + limits)
        for c, members in enumerate(own):
            members = members[self.sizes[members] > 0]
            if not len(members):
                continue
            reach = (_distances(self.pivots[members], self.coarse[c : c + 1], self.metric)[:, 0] + self.high[members]).max()
            close = np.flatnonzero(_distances(points, self.coarse[c : c + 1], self.metric)[:, 0] - reach <= limits)
            for low in range(0, len(close), 1024):
                rows = close[low : low + 1024]
                d = _distances(points[rows], self.pivots[members], self.metric)
                least = np.maximum(np.maximum(d - self.high[members], self.low[members] - d), 0.0)
                for row, mask in zip(rows, least <= limits[rows, None]):
                    if mask.any():
                        parts[row].append(members[mask])
        return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def _first(d: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded distance) of the ``take`` smallest of each row by rounded distance, then by column.

    The real ``take``-th distance is found without sorting; only columns that may be as near when rounded are put in order.
    """
    kth = np.partition(d, take - 1, axis=1)[:, take - 1]
    row, column = np.nonzero(d <= (kth * (1 + 1e-12) + 2 * 10.0**-DIGITS)[:, None])
    near = np.round(d[row, column], DIGITS)
    order = np.lexsort((column, near, row))
    begin = np.searchsorted(row, np.arange(len(d)))
    # Rows are in order already, so a place in the order belongs to the row that was there.
    order = order[np.arange(len(order)) - begin[row] < take]
    return row[order], column[order], near[order]


def _blocks(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def _compared(visits: DataFrame, pieced: DataFrame, stats: DataFrame, k: int, metric: str) -> DataFrame:
    """(query, neighbour, distance): per visit (id, x, piece) and block of points the k nearest points of the piece, ties by id."""
    plain = "manhattan" if metric == "manhattan" else "euclidean"
    visitors = visits.groupBy("piece").agg(F.count("*").alias("visitors"))
    # One row per pivot, about the root of the number of training rows.
    both = F.broadcast(cut_lineage(stats.select("piece", "n").join(visitors, "piece")))
    own = F.xxhash64("id")
    left = visits.join(both, "piece").withColumns(
        {"vb": F.pmod(own, _blocks("visitors")).cast("int"), "rb": F.explode(F.sequence(F.lit(0), _blocks("n") - 1))}
    )
    right = pieced.join(both, "piece").withColumns(
        {"rb": F.pmod(own, _blocks("n")).cast("int"), "vb": F.explode(F.sequence(F.lit(0), _blocks("visitors") - 1))}
    )

    def compare(asked_rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        columns = {"query": [], "neighbour": [], "distance": []}
        if len(asked_rows) and len(known):
            known = known.sort_values("id")
            points, rows = _matrix(asked_rows["x"]), _matrix(known["x"])
            ids, take, step = known["id"].to_numpy(), min(k, len(known)), max(1, STEP // len(known))
            for start in range(0, len(points), step):
                d = _distances(points[start : start + step], rows, plain)
                query, best, distance = _first(d * d / 2 if metric == "cosine" else d, take)
                columns["query"].append(asked_rows["id"].to_numpy()[start + query])
                columns["neighbour"].append(ids[best])
                columns["distance"].append(distance)
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in columns.items()})

    key = ["piece", "rb", "vb"]
    sides = (left.select("id", "x", *key).groupBy(*key), right.select("id", "x", *key).groupBy(*key))
    return sides[0].cogroup(sides[1]).applyInPandas(compare, "query long, neighbour long, distance double")


@dataclass
class _Near:
    """``rows`` (query, neighbour, distance, y, position) of one query per point, whose id is the smallest of its queries."""

    rows: DataFrame
    members: DataFrame  # id, point: every query, and the one that was asked for it
    sizes: DataFrame  # point, n

    def of_all(self, found: DataFrame) -> DataFrame:
        """(id, columns of ``found``): what was ``found`` per ``query`` asked, for every query of its point."""
        hot = largest_keys({"points": self.sizes}, "point", "n")["points"]
        return lookup_join(self.members, found.withColumnRenamed("query", "point"), "point", hot, "id").drop("point")


def _nearest(
    train: DataFrame, queries: DataFrame, row_id: str, features: list[str], k: int, metric: str, label: str | None, pivots: int | None
) -> _Near:
    plain = "manhattan" if metric == "manhattan" else "euclidean"
    y = F.lit(None).cast("double") if label is None else F.col(label).cast("double")
    placed = ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    spotted = cut_lineage(_vectors(queries, row_id, features, metric, [], 1).where(placed).withColumn("spot", _spot("x")))
    asked = cut_lineage(spotted.groupBy("spot").agg(F.min("id").alias("id"), F.first("x").alias("x"), F.count("*").alias("n")))
    hot = largest_keys({"spots": asked.where(F.col("n") > 1)}, "spot", "n")["spots"]
    members = cut_lineage(
        lookup_join(spotted.select("id", "spot"), asked.select("spot", F.col("id").alias("point")), "spot", hot, "id").select("id", "point")
    )
    base = _vectors(train, row_id, features, metric, [y.alias("y")], 0).where(placed).withColumn("spot", _spot("x"))
    # Spark limits the rows of a group before it shuffles them.
    first = F.row_number().over(Window.partitionBy("spot").orderBy("id"))
    copies = base.withColumn("copy", first).where(F.col("copy") <= k)
    base = cut_lineage(
        copies.groupBy("spot").agg(F.min("id").alias("id"), F.first("x").alias("x"), F.collect_list(F.struct(F.col("id").alias("neighbour"), "y")).alias("copies"))
    )
    n = base.count()
    if not n:
        raise ValueError("no training rows")
    wanted = max(1, min(n, pivots or math.isqrt(n - 1) + 1))
    # Evenly hashed pivots; the bound on the hash keeps all but about twice as many rows from being sorted.
    scale = 1 << 30
    bound = min(scale, math.ceil(scale * (2.0 * wanted + 100) / n))
    drawn = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(scale))
    chosen = base.where(drawn < bound).orderBy(drawn, "id").limit(wanted).select("x").collect()
    pieces = Pieces.of(np.array([r["x"] for r in chosen], dtype=float), plain)

    @F.pandas_udf("piece int, radius double")
    def locate(x: pd.Series) -> pd.DataFrame:
        nearest, radius = pieces.nearest(_matrix(x))
        return pd.DataFrame({"piece": nearest.astype("int32"), "radius": radius})

    pieced = cut_lineage(base.withColumn("at", locate("x")).select("id", "x", "at.*"))
    stats = cut_lineage(pieced.groupBy("piece").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")))
    pieces.sizes, pieces.low, pieces.high = (np.zeros(len(chosen), kind) for kind in (np.int64, float, float))
    for r in stats.collect():
        pieces.sizes[r["piece"]], pieces.low[r["piece"]], pieces.high[r["piece"]] = r["n"], r["low"], r["high"]

    @F.pandas_udf("array<int>")
    def own(x: pd.Series) -> pd.Series:
        return pd.Series(pieces.around(_matrix(x), k))

    order = Window.partitionBy("query").orderBy("distance", "neighbour")

    def compared(visits: DataFrame) -> DataFrame:
        """(query, neighbour, distance, y): the training rows of the k nearest points visited, which hold the k nearest rows."""
        found = _compared(visits, pieced, stats, k, metric)
        nearest = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
        of_point = base.select(F.col("id").alias("neighbour"), "copies")
        return nearest.join(of_point, "neighbour").select("query", "distance", F.inline("copies")).select("query", "neighbour", "distance", "y")

    at_home = cut_lineage(asked.select("id", "x", own("x").alias("home")))
    first_found = cut_lineage(compared(at_home.select("id", "x", F.explode("home").alias("piece"))))

    @F.pandas_udf("array<int>")
    def others(x: pd.Series, limit: pd.Series) -> pd.Series:
        return pd.Series(pieces.within(_matrix(x), limit.to_numpy(dtype=float)))

    best = cut_lineage(first_found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k))
    # A rounded distance may be short of the real one by half a unit of its last digit; cosine is half the square.
    kth = F.col("distance") + 10.0**-DIGITS
    limits = best.where(F.col("position") == k).select(F.col("query").alias("id"), (F.sqrt(2 * kth) if metric == "cosine" else kth).alias("limit"))
    rest = at_home.join(limits, "id").withColumn("piece", F.explode(F.array_except(others("x", "limit"), F.col("home"))))
    both = best.drop("position").unionByName(compared(cut_lineage(rest.select("id", "x", "piece"))))
    rows = both.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    return _Near(rows, members, asked.select(F.col("id").alias("point"), "n").where(F.col("n") > 1))


def nearest_rows(
    train: DataFrame,
    queries: DataFrame,
    row_id: str,
    features: list[str],
    k: int,
    metric: str = "euclidean",
    label: str | None = None,
    pivots: int | None = None,
) -> DataFrame:
    """(query, neighbour, distance, y, position): the k nearest training rows per query, ties by training id.

    A row with a missing coordinate is near to nothing and has no neighbours. ``pivots`` is the root of the number of
    training points unless given.
    """
    near = _nearest(train, queries, row_id, features, k, metric, label, pivots)
    each = near.rows.groupBy("query").agg(F.collect_list(F.struct("neighbour", "distance", "y", "position")).alias("near"))
    return near.of_all(each).select(F.col("id").alias("query"), F.inline("near"))


def knn_regress(
    train: DataFrame,
    queries: DataFrame,
    row_id: str,
    features: list[str],
    label: str,
    k: int,
    weights: str = "uniform",
    metric: str = "euclidean",
) -> DataFrame:
    """Mean label of the k nearest rows; with ``distance`` weights 1/d, or only the exact matches if any."""
    near = _nearest(train, queries, row_id, features, k, metric, label, None)
    if weights == "uniform":
        value = F.avg("y")
    else:
        inverse = F.when(F.col("distance") > 0, 1 / F.col("distance"))
        value = F.coalesce(F.avg(F.when(F.col("distance") == 0, F.col("y"))), F.sum(F.col("y") * inverse) / F.sum(inverse))
    return near.of_all(near.rows.groupBy("query").agg(value.alias("prediction"))).select(F.col("id").alias(row_id), "prediction")

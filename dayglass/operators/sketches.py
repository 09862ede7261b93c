"""Quantiles of many columns in one pass, by sketches that can be merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values kept in one level of a sketch.
KEPT = 2048
#: Parts that the sketches of a column are merged in before they meet in one task.
PARTS = 64
_FIELDS = "name int, level int, n bigint, kept binary"


class Sketch:
    """Sorted values of weight 2 ** level per level; a full level gives every other value to the next.

    ``taken`` counts the values taken in. A thinned level moves the rank of any value by at most its weight, and level i
    is thinned once per ``KEPT * 2 ** i`` values, so ranks are off by at most ``(levels - 1) / KEPT`` of all values, and by
    nothing while there are fewer than KEPT.
    """

    def __init__(self):
        self.taken = 0
        self.levels: list[list[np.ndarray]] = []
        self.thinned: list[int] = []

    def add(self, values: np.ndarray, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
            self.thinned.append(0)
        self.levels[level].append(values)
        while level < len(self.levels) and sum(map(len, self.levels[level])) >= KEPT:
            whole = np.sort(np.concatenate(self.levels[level]))
            even = len(whole) // 2 * 2
            # The odd value out stays; the first and the second of each pair take turns.
            self.levels[level] = [whole[even:]]
            up = whole[self.thinned[level] % 2 : even : 2]
            self.thinned[level] += 1
            level += 1
            if level == len(self.levels):
                self.levels.append([])
                self.thinned.append(0)
            self.levels[level].append(up)

    def take(self, values: np.ndarray) -> None:
        self.taken += len(values)
        for low in range(0, len(values), KEPT):
            self.add(values[low : low + KEPT])

    def rows(self, name: int) -> list[tuple]:
        kept = [np.concatenate(parts) if parts else np.zeros(0) for parts in self.levels]
        return [(name, i, self.taken if i == 0 else 0, v.tobytes()) for i, v in enumerate(kept) if len(v) or i == 0]

    def cuts(self, shares: list[float]) -> list[float]:
        """For each share the smallest kept value whose rank reaches that share of all values."""
        values = np.concatenate([v for parts in self.levels for v in parts] or [np.zeros(0)])
        if not len(values):
            return []
        weights = np.concatenate([np.full(len(v), 1 << i) for i, parts in enumerate(self.levels) for v in parts])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        at = np.searchsorted(upto, np.ceil(np.array(shares) * upto[-1]), "left")
        return values[order][np.minimum(at, len(values) - 1)].tolist()

    @property
    def error(self) -> float:
        """Bound of the error of ranks, as a share of all values."""
        return max(0, len(self.levels) - 1) / KEPT


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    # A task without values has no rows.
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["name", "level", "n", "kept"])


def sketches(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, level, n, kept): one sketch per column, by its number; NULL and NaN are left out. One pass over ``df``."""
    wide = df.select(*[F.col(c).cast("double") for c in columns])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Sketch() for _ in columns]
        for batch in batches:
            for sketch, column in zip(own, batch.columns):
                values = column.drop_null().to_numpy(zero_copy_only=False)
                sketch.take(values[~np.isnan(values)])
        yield _batch([r for i, s in enumerate(own) for r in s.rows(i)])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Sketch] = {}
        for batch in batches:
            for name, level, n, kept in zip(*[batch.column(c).to_pylist() for c in ("name", "level", "n", "kept")]):
                sketch = own.setdefault(name, Sketch())
                sketch.taken += n
                sketch.add(np.frombuffer(kept), level)
        if own:
            yield _batch([r for i, s in own.items() for r in s.rows(i)])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % PARTS
        for batch in first(batches):
            yield batch.append_column("part", pa.array([part] * batch.num_rows, pa.int32()))

    partial = wide.mapInArrow(numbered, f"{_FIELDS}, part int")
    # The order of arrival must not matter, so rows are sorted before they are merged.
    some = partial.repartition("name", "part").sortWithinPartitions("name", "part", "level", "n", "kept").drop("part")
    return some.mapInArrow(merged, _FIELDS).repartition("name").sortWithinPartitions("name", "level", "n", "kept").mapInArrow(merged, _FIELDS)


def sketched_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(column, share, value, error): approximate quantiles with the bound of their error in ranks, as a share of all rows.

    The value is one of the column's own; a column without values has none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Sketch] = {}
        for batch in batches:
            for name, level, n, kept in zip(*[c.to_pylist() for c in batch.columns]):
                sketch = own.setdefault(name, Sketch())
                while len(sketch.levels) <= level:
                    sketch.levels.append([])
                sketch.levels[level].append(np.frombuffer(kept))
        rows = [(columns[i], q, v, s.error) for i, s in own.items() for q, v in zip(shares, s.cuts(shares))]
        if rows:
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["column", "share", "value", "error"])

    return sketches(df, columns).mapInArrow(cut, "column string, share double, value double, error double")


def quantile_borders(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """At most ``bins`` - 1 different ascending borders per column, at equal shares of its values.

    The driver gets at most columns x bins numbers.
    """
    borders: dict[str, set[float]] = {c: set() for c in columns}
    for row in sketched_quantiles(df, columns, [i / bins for i in range(1, bins)]).collect():
        borders[row["column"]].add(row["value"])
    return {c: sorted(v) for c, v in borders.items()}

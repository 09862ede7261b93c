"""Boosted trees grown leaf by leaf, many models at once, from histograms that Spark sums.

A table holds one row per example: its bins (one byte per feature), its label, its day and one raw score per model. A
model learns from the days it is given, so a fold per day is one model per day. A pass over the table gives the
histograms of all nodes that any model waits for; of two children the smaller is counted and the other is the parent
less that one. In the first round all scores of a model are equal, so counts of labels per day serve every model whose
tree has come the same way: each takes the total less the days it leaves out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayglass.session import cut_lineage

#: Most borders of a feature plus one; bin 0 is for missing values, and a bin is one byte.
MOST_BINS = 255
#: Bytes of histograms that a task holds in a pass; nodes beyond wait for the next pass.
PASS_BYTES = 64 << 20
#: Rows that are counted together.
STEP = 1 << 16


@dataclass(frozen=True)
class LeafwiseSettings:
    rounds: int = 100
    leaves: int = 31
    rate: float = 0.1
    min_rows: int = 20
    l2: float = 1.0
    depth: int | None = None
    #: Smallest gain of a split.
    min_gain: float = 0.0


@dataclass(frozen=True)
class Model:
    """Days to learn from, and the weight of rows with label 1."""

    days: tuple[int, ...]
    positive_weight: float = 1.0


@dataclass
class Node:
    """``key`` names the splits from the root; nodes of several models share it while their histograms do."""

    key: tuple
    depth: int
    rows: float
    gradient: float
    hessian: float
    feature: int = -1
    bin: int = -1
    gain: float = -math.inf
    rows_left: float = 0.0
    #: Number and side of its histogram.
    place: tuple[int, int] = (0, 0)
    #: In the order in which a tree gets its nodes.
    number: int = 0
    #: Children are known once they are counted, which may be before the node is split.
    left: "Node | None" = None
    right: "Node | None" = None
    split: bool = False


@dataclass
class Flat:
    """A tree as arrays, for looking up the node of many rows."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(empty)
        return len(self.feature) - 1

    def rows_at(self, bins: np.ndarray, rows: np.ndarray, wanted: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(node, its rows in their order) for each of ``wanted`` nodes, or each leaf, that some of ``rows`` come to.

        ``bins`` holds one run of bytes per feature. Rows go down only where a wanted node may be.
        """
        on_way = None
        if wanted is not None:
            on_way = [False] * len(self.feature)

            def mark(node: int) -> bool:
                below = self.feature[node] >= 0 and any([mark(self.left[node]), mark(self.right[node])])
                on_way[node] = below or node in wanted
                return on_way[node]

            mark(0)
        waiting = [(0, rows)]
        while waiting:
            node, own = waiting.pop()
            if not len(own) or (on_way is not None and not on_way[node]):
                continue
            if node in wanted if wanted is not None else self.feature[node] < 0:
                yield node, own
            if self.feature[node] >= 0:
                left = bins[self.feature[node]][own] <= self.bin[node]
                waiting += [(self.left[node], own[left]), (self.right[node], own[~left])]


def bin_table(
    df: DataFrame, row_id: str, day: str, label: str, features: list[str], borders: dict[str, list[float]], starts: list[float]
) -> DataFrame:
    """(row id, day, label, bins, raw), bins and raw scores packed as bytes: a value's bin is 1 plus the number of borders below it; NULL and NaN are bin 0.

    Labels are 0 or 1, and NULL where there is none.
    """
    cuts = [np.array(borders[c], float) for c in features]
    if any(len(c) >= MOST_BINS for c in cuts):
        raise ValueError(f"a feature has more than {MOST_BINS} bins")
    start = np.array(starts, float)
    wide = df.select(row_id, F.col(day).cast("int").alias(day), F.col(label).cast("int").alias(label), *[F.col(c).cast("double").alias(c) for c in features])
    schema = wide.select(row_id, day, label).schema.add("bins", T.BinaryType()).add("raw", T.BinaryType())
    width = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            bins = np.zeros((n, width), np.uint8)
            for f in range(width):
                x = batch.column(3 + f).to_numpy(zero_copy_only=False)
                bins[:, f] = np.where(np.isnan(x), 0, np.searchsorted(cuts[f], x, "left") + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _packed(bins), _packed(np.tile(start, (n, 1)))], names=schema.names)

    return wide.mapInArrow(run, schema)


def _packed(values: np.ndarray) -> pa.Array:
    """Each row of an array as bytes."""
    n, width = values.shape
    offsets = pa.array(np.arange(n + 1) * (width * values.itemsize), pa.int32())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(values.tobytes())])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """The bytes of rows that each have ``width`` of them."""
    n = len(column)
    if not width or not n:
        return np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.uint8)[first : first + n * width]


def _numbers(batches: Iterator[pa.RecordBatch], width: int, models: int) -> Iterator[tuple]:
    """(day, label, bins by feature, raw) of about STEP rows at a time; a missing label is -1."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= STEP:
            yield _unpacked(waiting, width, models)
            waiting = []
    if waiting:
        yield _unpacked(waiting, width, models)


def _unpacked(batches: list[pa.RecordBatch], width: int, models: int) -> tuple:
    rows = pa.Table.from_batches(batches).combine_chunks()
    day, label, bins, raw = (rows.column(i).combine_chunks() for i in range(4))
    n = len(rows)
    return (
        day.fill_null(-(1 << 31)).to_numpy(zero_copy_only=False),
        label.fill_null(-1).to_numpy(zero_copy_only=False),
        np.ascontiguousarray(_bytes(bins, width).reshape(n, width).T),
        _bytes(raw, 8 * models).view(np.float64).reshape(n, models),
    )


@dataclass
class Unit:
    """A histogram to be counted: the node ``node`` of tree ``tree``, for the models that share it."""

    number: int
    tree: int
    node: int
    models: tuple[int, ...]
    parent: tuple[int, int] | None  # number and side of the parent's histogram


class Grower:
    """Grows the trees of one round for all models."""

    def __init__(self, table: DataFrame, features: list[str], row_id: str, day: str, label: str, models: list[Model], settings: LeafwiseSettings, bins: int):
        self.table, self.features, self.row_id, self.day, self.label = table, features, row_id, day, label
        self.models, self.settings, self.bins = models, settings, bins
        self.passes = 0
        self.days = sorted({d for m in models for d in m.days})

    def trees(self, constant: list[float] | None) -> list[Flat]:
        """One tree per model. ``constant`` holds the scores of the models while they are the same for all rows."""
        self.constant = constant
        self.stored: list[tuple[set[int], DataFrame]] = []
        self.made = 0
        #: Unit of a split node's children, and whether the left one was counted, by (key and split, model).
        self.known: dict[tuple, tuple[int, bool]] = {}
        self.found: dict[tuple[int, int, int], dict] = {}
        roots = [() if constant is not None else (k,) for k in range(len(self.models))]
        self._count_roots(roots)
        tops = [self._node(key, 0, self.known[key, k][0], 0, k) for k, key in enumerate(roots)]
        leaves: list[list[Node]] = [[t] for t in tops]
        while True:
            waiting = []
            for k, own in enumerate(leaves):
                while len(own) < self.settings.leaves:
                    best = min((x for x in own if self._splits(x)), key=lambda x: (-x.gain, x.number), default=None)
                    if best is None:
                        break
                    if not self._counted(best, k):
                        waiting.append(k)
                        break
                    best.split = True
                    # A tree of n leaves has 2 n - 1 nodes.
                    best.left.number, best.right.number = 2 * len(own) - 1, 2 * len(own)
                    own.remove(best)
                    own += [best.left, best.right]
            if not waiting:
                return [self._flat(t) for t in tops]
            self._count(waiting, tops, leaves)

    def _counted(self, node: Node, k: int) -> bool:
        """Whether the children of a node of model ``k`` are known; they are made when asked for."""
        if node.left is None:
            found = self.known.get((self._expansion(node), k))
            if found is None:
                return False
            unit, left_counted = found
            for side in ("left", "right"):
                which = int((side == "left") != left_counted)
                setattr(node, side, self._node((*node.key, (node.feature, node.bin, side)), node.depth + 1, unit, which, k))
        return True

    def _splits(self, node: Node) -> bool:
        return node.gain > self.settings.min_gain and (self.settings.depth is None or node.depth < self.settings.depth)

    @staticmethod
    def _expansion(node: Node) -> tuple:
        return (*node.key, (node.feature, node.bin))

    def _node(self, key: tuple, depth: int, unit: int, side: int, k: int) -> Node:
        s = self.found[unit, side, k]
        return Node(key, depth, s["n"], s["g"], s["h"], s["feature"], s["bin"], s["gain"], s["n_left"], (unit, side))

    def _flat(self, top: Node, known: dict[int, int] | None = None) -> Flat:
        """The tree. With ``known`` it goes down to all known nodes, and the place of each in it is noted there by its identity."""
        tree = Flat()

        def put(node: Node) -> int:
            at = tree.add()
            tree.value[at] = -self.settings.rate * node.gradient / (node.hessian + self.settings.l2) if node.rows else 0.0
            if node.split or (known is not None and node.left is not None):
                tree.feature[at], tree.bin[at] = node.feature, node.bin
                tree.left[at] = put(node.left)
                tree.right[at] = put(node.right)
            if known is not None:
                known[id(node)] = at
            return at

        put(top)
        return tree

    def _count_roots(self, roots: list[tuple]) -> None:
        tree = Flat()
        tree.add()
        shared: dict[tuple, list[int]] = {}
        for k, key in enumerate(roots):
            shared.setdefault(key, []).append(k)
        units = []
        for key, models in shared.items():
            units.append(Unit(self.made, 0 if self.constant is not None else models[0], 0, tuple(models), None))
            self.known.update({(key, k): (self.made, True) for k in models})
            self.made += 1
        trees = [tree] if self.constant is not None else [tree] * len(self.models)
        for low in range(0, len(units), self._at_once()):
            self._pass(trees, units[low : low + self._at_once()])

    def _at_once(self) -> int:
        """How many histograms a pass may count."""
        cells = len(self.features) * (self.bins + 1) * (2 * len(self.days) if self.constant is not None else 3)
        return max(1, PASS_BYTES // (8 * cells))

    def _below(self, leaves: list[Node], k: int) -> list[tuple[float, Node]]:
        """Nodes that may be split next, or after splits that are known: each with the least gain on its way."""
        found, open_nodes = [], [(x.gain, x) for x in leaves if self._splits(x)]
        while open_nodes:
            least, node = open_nodes.pop()
            if self._counted(node, k):
                open_nodes += [(min(least, x.gain), x) for x in (node.left, node.right) if self._splits(x)]
            else:
                found.append((least, node))
        return found

    def _count(self, waiting: list[int], tops: list[Node], leaves: list[list[Node]]) -> None:
        """One pass for the nodes that come next in some model: at most as many of each as it may still split, by their gain."""
        wanted: dict[tuple, tuple[int, int, Node, list[int]]] = {}
        for k in waiting:
            room = self.settings.leaves - len(leaves[k])
            for rank, (_, node) in enumerate(heapq.nsmallest(room, self._below(leaves[k], k), key=lambda x: (-x[0], -x[1].gain, x[1].key))):
                name = self._expansion(node)
                old = wanted.get(name, (rank, k, node, []))
                wanted[name] = (min(old[0], rank), old[1], old[2], [*old[3], k])
        chosen = sorted(wanted.items(), key=lambda x: x[1][0])[: self._at_once()]
        trees: dict[int, tuple[Flat, dict[int, int]]] = {}
        units = []
        for name, (_, k, node, models) in chosen:
            if k not in trees:
                at_node: dict[int, int] = {}
                trees[k] = (self._flat(tops[k], at_node), at_node)
            tree, at_node = trees[k]
            at = at_node[id(node)]
            tree.feature[at], tree.bin[at] = node.feature, node.bin
            tree.left[at], tree.right[at] = tree.add(), tree.add()
            left_counted = 2 * node.rows_left <= node.rows
            counted = tree.left[at] if left_counted else tree.right[at]
            units.append(Unit(self.made, k, counted, tuple(sorted(models)), node.place))
            self.known.update({(name, m): (self.made, left_counted) for m in models})
            self.made += 1
        self._pass({k: t for k, (t, _) in trees.items()}, units)

    def _pass(self, trees, units: list[Unit]) -> None:
        """Counts the units and finds the best split of each and of its sibling, for every model that shares it."""
        self.passes += 1
        used = {u.tree for u in units}
        flat = {k: trees[k] for k in used}
        partial = _partial_sums(self.table, self.day, self.label, flat, units, self.models, self.days, len(self.features), self.bins, self.constant)
        children: dict[int, list[int]] = {}
        for u in units:
            if u.parent is not None:
                children.setdefault(2 * u.parent[0] + u.parent[1], []).append(u.number)
        for numbers, stored in self.stored:
            wanted = {p: c for p, c in children.items() if p // 2 in numbers}
            if wanted:
                # Of a few parents' histograms, a copy for each unit of this pass that lies below.
                table = F.create_map(*[x for p, c in wanted.items() for x in (F.lit(p), F.array(*map(F.lit, c)))])
                below = stored.withColumn("child", F.explode(table[2 * F.col("unit") + F.col("side")]))
                partial = partial.unionByName(below.select(F.col("child").alias("unit"), "feature", F.lit(1).alias("kind"), "stats"))
        settings, shape = self.settings, (units, self.models, self.days, self.bins, self.constant)
        found = partial.repartition("unit", "feature").sortWithinPartitions("unit", "feature", "kind").mapInArrow(
            lambda batches: _best_splits(batches, shape, settings), _FOUND
        )
        found = cut_lineage(found)
        self.stored.append(({u.number for u in units}, found))
        each = found.select("unit", "side", "feature", F.explode("splits").alias("s")).select("unit", "side", "feature", "s.*")
        order = F.struct((-F.col("gain")).alias("a"), F.col("feature").alias("b"))
        best = each.groupBy("unit", "side", "model").agg(F.min_by(F.struct("feature", "bin", "gain", "n", "g", "h", "n_left"), order).alias("s"))
        for row in best.select("unit", "side", "model", "s.*").collect():
            self.found[row["unit"], row["side"], row["model"]] = row.asDict()


_PARTIAL = "unit int, feature int, kind int, stats binary"
_SPLIT = "struct<model:int,bin:int,gain:double,n:double,g:double,h:double,n_left:double>"
_FOUND = f"unit int, side int, feature int, stats binary, splits array<{_SPLIT}>"


def _partial_sums(
    table: DataFrame, day: str, label: str, trees: dict[int, Flat], units: list[Unit], models: list[Model], days: list[int], width: int, bins: int, constant: list[float] | None
) -> DataFrame:
    """Per task the histogram of each unit and feature: rows by day, bin and label while scores are constant, else sums by bin."""
    shared, cells = constant is not None, bins + 1
    # Scores are not read while they are the same for all rows.
    scores, n_models = (F.lit(b"").alias("raw"), 0) if shared else (F.col("raw"), len(models))
    by_tree: dict[int, list[Unit]] = {}
    for u in units:
        by_tree.setdefault(u.tree, []).append(u)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth = len(days) if shared else 1
        stats = 2 if shared else 3
        sums = {k: np.zeros((width, stats, len(own) * depth * cells)) for k, own in by_tree.items()}
        known_days = np.array(days)
        slots = {k: {u.node: i for i, u in enumerate(own)} for k, own in by_tree.items()}
        learned = {k: np.isin(known_days, models[k].days) for k in by_tree}
        for row_day, y, bin_of, raw in _numbers(batches, width, n_models):
            at_day = np.minimum(np.searchsorted(known_days, row_day), len(days) - 1)
            usable = (known_days[at_day] == row_day) & (y >= 0)
            for k, own in by_tree.items():
                taken = np.flatnonzero(usable if shared else usable & learned[k][at_day])
                met = list(trees[k].rows_at(bin_of, taken, set(slots[k])))
                if not met:
                    continue
                rows = np.concatenate([r for _, r in met])
                slot = np.repeat([slots[k][node] for node, _ in met], [len(r) for _, r in met])
                target, size = y[rows], sums[k].shape[2]
                if shared:
                    base = (slot * depth + at_day[rows]) * cells
                    parts = [(np.flatnonzero(target == v), None) for v in (0, 1)]
                else:
                    base = slot * cells
                    p = 1 / (1 + np.exp(-raw[rows, k]))
                    weight = np.where(target == 1, models[k].positive_weight, 1.0)
                    parts = [(None, None), (None, weight * (p - target)), (None, weight * p * (1 - p))]
                for f in range(width):
                    cell = base + bin_of[f][rows]
                    for s, (some, weights) in enumerate(parts):
                        sums[k][f, s] += np.bincount(cell if some is None else cell[some], weights, size)
        out = []
        for k, own in by_tree.items():
            for i, u in enumerate(own):
                piece = sums[k][:, :, i * depth * cells : (i + 1) * depth * cells]
                out += [(u.number, f, 0, piece[f].tobytes()) for f in range(width)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["unit", "feature", "kind", "stats"])

    return table.select(day, label, "bins", scores).mapInArrow(run, _PARTIAL)


def _best_splits(batches: Iterator[pa.RecordBatch], shape: tuple, settings: LeafwiseSettings) -> Iterator[pa.RecordBatch]:
    """Adds up the histogram of each unit and feature, takes the sibling from the parent, and finds the best splits."""
    units, models, days, bins, constant = shape
    of = {u.number: u for u in units}
    shared, cells = constant is not None, bins + 1
    dims = (2, len(days), cells) if shared else (3, cells)

    def of_models(stats: np.ndarray, unit: Unit) -> np.ndarray:
        """(rows, gradients, hessians) by bin for each model of the unit."""
        if not shared:
            return stats[:, None, :]
        total = stats.sum(axis=1)
        out = np.array([[d not in models[k].days for d in days] for k in unit.models], float)
        n0, n1 = (total[i] - out @ stats[i] for i in (0, 1))
        p = 1 / (1 + np.exp(-np.array([constant[k] for k in unit.models])))[:, None]
        w = np.array([models[k].positive_weight for k in unit.models])[:, None]
        return np.stack([n0 + n1, n0 * p + w * n1 * (p - 1), (n0 + w * n1) * p * (1 - p)])

    def splits(stats: np.ndarray, unit: Unit) -> list[dict]:
        n, g, h = of_models(stats, unit)
        (nl, gl, hl), (na, ga, ha) = (np.cumsum(x, axis=1) for x in (n, g, h)), (x.sum(axis=1, keepdims=True) for x in (n, g, h))
        gain = gl**2 / (hl + settings.l2) + (ga - gl) ** 2 / (ha - hl + settings.l2) - ga**2 / (ha + settings.l2)
        enough = (nl >= max(1, settings.min_rows)) & (na - nl >= max(1, settings.min_rows))
        gain = np.where(enough, np.round(gain, 9), -np.inf)
        best = gain.argmax(axis=1)
        made = []
        for i, k in enumerate(unit.models):
            b = int(best[i])
            made.append({"model": k, "bin": b, "gain": gain[i, b], "n": na[i, 0], "g": ga[i, 0], "h": ha[i, 0], "n_left": nl[i, b]})
        return made

    def closed(key: tuple[int, int], counted: np.ndarray, parent: np.ndarray | None) -> list[tuple]:
        unit = of[key[0]]
        sides = [counted] if parent is None else [counted, parent - counted]
        return [(unit.number, side, key[1], stats.tobytes(), splits(stats.reshape(dims), unit)) for side, stats in enumerate(sides)]

    schema = pa.schema(
        [("unit", pa.int32()), ("side", pa.int32()), ("feature", pa.int32()), ("stats", pa.binary())]
        + [("splits", pa.list_(pa.struct([("model", pa.int32()), ("bin", pa.int32()), *[(c, pa.float64()) for c in ("gain", "n", "g", "h", "n_left")]])))]
    )
    key, counted, parent = None, None, None
    for batch in batches:
        done = []
        for unit, feature, kind, stats in zip(*[c.to_pylist() for c in batch.columns]):
            if (unit, feature) != key:
                if key is not None:
                    done += closed(key, counted, parent)
                key, counted, parent = (unit, feature), np.zeros(int(np.prod(dims))), None
            if kind:
                parent = np.frombuffer(stats)
            else:
                counted = counted + np.frombuffer(stats)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
    if key is not None:
        done = closed(key, counted, parent)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)


def _with_scores(table: DataFrame, trees: list[Flat], width: int, listed: bool = False) -> DataFrame:
    """Raw scores with the values of one more tree per model; ``listed`` as arrays instead of bytes."""
    schema = T.StructType([*table.schema.fields[:-1], T.StructField("raw", T.ArrayType(T.DoubleType()) if listed else T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, bin_of, raw = _unpacked([batch.select(batch.schema.names[1:])], width, len(trees))
            raw, every = raw.copy(), np.arange(batch.num_rows)
            for k, tree in enumerate(trees):
                for node, rows in tree.rows_at(bin_of, every):
                    raw[rows, k] += tree.value[node]
            if listed:
                column = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(trees), pa.int32()), pa.array(raw.ravel()))
            else:
                column = _packed(raw)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], column], names=schema.names)

    return table.mapInArrow(run, schema)


@dataclass
class Grown:
    scores: DataFrame  # row id, day, label, bins, raw; worked out from the scores before the last round when it is read
    starts: list[float]
    trees: list[list[Flat]]  # by round, then by model
    passes: int


def first_scores(df: DataFrame, day: str, label: str, models: list[Model]) -> list[float]:
    """The log-odds of the (weighted) label in each model's rows, from which its scores start."""
    y = F.col(label).cast("int")
    counts = {r[day]: (r["n"], r["y"]) for r in df.where(y.isNotNull()).groupBy(F.col(day).cast("int").alias(day)).agg(F.count("*").alias("n"), F.sum(y).alias("y")).collect()}
    starts = []
    for m in models:
        n, ones = (sum(counts.get(d, (0, 0))[i] for d in m.days) for i in (0, 1))
        # Odds of rows of one label alone are taken as if half a row had the other.
        starts.append(math.log(max(ones, 0.5) * m.positive_weight / max(n - ones, 0.5)))
    return starts


def grow(
    df: DataFrame, row_id: str, day: str, label: str, features: list[str], borders: dict[str, list[float]], models: list[Model], settings: LeafwiseSettings
) -> Grown:
    """Boosts all ``models`` side by side over the rows of ``df``; every row gets the raw score of every model.

    A model starts at the log-odds of its (weighted) label and learns from the rows of its days that have a label.
    Splits are chosen best first, by gain rounded to nine digits, then feature, then bin, until a tree has ``leaves``;
    a missing value goes left. Each round but the last writes the table with its new scores, so a lost executor costs a re-read.
    The number of passes over the table depends on the shape of the trees and on what a task may hold, not on the
    number of models. A model without rows, or with rows of one label only, keeps a constant score near its odds.
    """
    starts = first_scores(df, day, label, models)
    bins = max([len(b) + 1 for b in borders.values()], default=1)
    table = cut_lineage(bin_table(df, row_id, day, label, features, borders, starts))
    passes, rounds = 0, []
    for i in range(settings.rounds):
        grower = Grower(table, features, row_id, day, label, models, settings, bins)
        rounds.append(grower.trees(starts if i == 0 else None))
        passes += grower.passes
        if i + 1 < settings.rounds:
            table = cut_lineage(_with_scores(table, rounds[-1], len(features)))
    last = rounds[-1] if rounds else [Flat([-1], [0], [-1], [-1], [0.0])] * len(models)
    return Grown(_with_scores(table, last, len(features), listed=True), starts, rounds, passes)


def predict(df: DataFrame, row_id: str, features: list[str], borders: dict[str, list[float]], grown: Grown, model: int = 0, out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """(row id, kept columns, score between 0 and 1) of rows that need not have been there when the trees grew."""
    cuts = [np.array(borders[c], float) for c in features]
    trees, start, first = [r[model] for r in grown.trees], grown.starts[model], len(keep or []) + 1
    wide = df.select(row_id, *(keep or []), *[F.col(c).cast("double") for c in features])
    schema = wide.select(row_id, *(keep or [])).schema.add(out, T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.zeros((len(cuts), batch.num_rows), np.uint8)
            for f, cut in enumerate(cuts):
                x = batch.column(first + f).to_numpy(zero_copy_only=False)
                bins[f] = np.where(np.isnan(x), 0, np.searchsorted(cut, x, "left") + 1)
            raw = np.full(batch.num_rows, start)
            every = np.arange(batch.num_rows)
            for tree in trees:
                for node, rows in tree.rows_at(bins, every):
                    raw[rows] += tree.value[node]
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], pa.array(1 / (1 + np.exp(-raw)))], names=schema.names)

    return wide.mapInArrow(run, schema)

"""DBSCAN as joins on a grid.

Cells are so small that all points of a cell are neighbours of each other, so a cell with enough points needs no
point comparison at all, and the core points of a cell always share a cluster. Copies of a point are one weighted
point. Two core cells are linked by comparing boxes around their points: boxes entirely within reach link, boxes
out of reach do not, small boxes are compared point by point and large ones are halved. Clusters are the connected
cells. No step emits all pairs of a crowded cell. Up to three axes the outermost points of the cells are compared first; pairs of
cells that the links found so lead to each other need no further comparison, which leaves few pairs where points are crowded.
Rows of a cell with enough points take their cluster from the cell, only the others from their point.

Above three axes a grid has too many neighbouring cells. There, core points and links are first sought in overlapping
blocks of bounded size. What is found is right, so cells of the largest group found, all of whose points are core, need
not be compared with each other. The other cells ("open") meet all cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass.operators.joins import largest_keys, lookup_join
from dayglass.session import chunk_count, cut_lineage

PAIRS = 4096  # point pairs that two boxes may have before they are halved
BLOCK = 4096  # points of a cell that one join key may hold
GRID_AXES = 3  # with more axes most links are found in blocks first, and neighbouring cells without a grid
HOMES = 64  # cells that a ball of the cover may hold
PIVOTS = 16  # balls that a ball is split into
MOST_OPEN = 1 << 17  # open cells that meet all cells as arrays; of more, a cover finds the pairs
CROWD = 2048  # points of a block, or cells of a part, that are compared at once
SHIFTS = 3  # blocks that a point lies in
STRIP = 256  # rows of a block whose distances are held at once


def _length(gaps: list[Column], metric: str) -> Column:
    if metric == "manhattan":
        return sum(gaps, F.lit(0.0))
    return F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))


class _Grid:
    def __init__(self, axes: int, eps: float, metric: str):
        self.axes, self.eps, self.metric = range(axes), eps, metric
        parts = axes if metric == "manhattan" else math.sqrt(axes)
        self.side = eps / parts * (1 - 1e-9)

    def points(self, a: str, b: str) -> Column:
        """Distance between two points with coordinate columns a0.. and b0.."""
        return _length([F.abs(F.col(f"{a}{i}") - F.col(f"{b}{i}")) for i in self.axes], self.metric)

    def gap(self, a: tuple[str, str], b: tuple[str, str]) -> Column:
        """Smallest possible distance between two boxes, each given by the prefixes of its low and high corner."""
        sides = [
            F.greatest(F.lit(0.0), F.col(f"{b[0]}{i}") - F.col(f"{a[1]}{i}"), F.col(f"{a[0]}{i}") - F.col(f"{b[1]}{i}"))
            for i in self.axes
        ]
        return _length(sides, self.metric)

    def far(self, a: tuple[str, str], b: tuple[str, str]) -> Column:
        """Largest possible distance between two boxes."""
        sides = [
            F.greatest(F.col(f"{b[1]}{i}") - F.col(f"{a[0]}{i}"), F.col(f"{a[1]}{i}") - F.col(f"{b[0]}{i}"))
            for i in self.axes
        ]
        return _length(sides, self.metric)

    def box(self) -> list[Column]:
        return [F.min(f"x{i}").alias(f"lo{i}") for i in self.axes] + [F.max(f"x{i}").alias(f"hi{i}") for i in self.axes]

    def corners(self, prefix: str) -> list[Column]:
        return [F.col(f"{c}{i}").alias(f"{prefix}{c}{i}") for c in ("lo", "hi") for i in self.axes]

    def subcell(self, level: int) -> Column:
        size = self.side / 2**level
        return F.concat_ws("_", *[F.floor(F.col(f"x{i}") / size).cast("string") for i in self.axes])


def _neighbour_cells(cells: DataFrame, grid: _Grid) -> DataFrame:
    """(a, b): pairs of different cells whose boxes are within reach, in both directions."""
    near = _cover_pairs(cells, grid) if len(grid.axes) > GRID_AXES else _grid_pairs(cells, grid)
    near = near.where(F.col("a") != F.col("b"))
    return near.where(grid.gap(("alo", "ahi"), ("blo", "bhi")) <= grid.eps).select("a", "b")


def _grid_pairs(cells: DataFrame, grid: _Grid) -> DataFrame:
    ratio = grid.eps / grid.side + 1
    coarse = [F.floor(F.col(f"c{i}") / ratio).cast("long").alias(f"g{i}") for i in grid.axes]
    right = cells.select(F.col("cell").alias("b"), *grid.corners("b"), *coarse)
    offsets = F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in zip(grid.axes, o)]) for o in product((-1, 0, 1), repeat=len(grid.axes))])
    left = cells.select(F.col("cell").alias("a"), *grid.corners("a"), *coarse, F.explode(offsets).alias("o"))
    left = left.withColumns({f"g{i}": F.col(f"g{i}") + F.col(f"o.o{i}") for i in grid.axes}).drop("o")
    return left.join(right, [f"g{i}" for i in grid.axes])


def _cover_pairs(cells: DataFrame, grid: _Grid) -> DataFrame:
    """Pairs of cells that share a ball of a cover, with the corners of both; each ordered pair at most once.

    A ball is a pivot cell, the cells that are nearer to it than to the other pivots of the ball it was split from (its
    home cells), and as guests all cells not further from the pivot than the furthest home cell plus the reach (of centres). So every
    cell within reach of a home cell is a guest. Balls with many home cells are split again; a ball has at most HOMES
    home cells, or few pairs, in the end. Splitting ends since a pivot leaves its ball with what is nearest to it.
    """
    half = _length([(F.col(f"hi{i}") - F.col(f"lo{i}")) / 2 for i in grid.axes], grid.metric)
    widest = cells.agg(F.max(half)).first()[0] or 0.0
    reach = (grid.eps + 2 * widest) * (1 + 1e-9)
    boxes = [f"{c}{i}" for c in ("lo", "hi") for i in grid.axes]
    centre = F.array(*[(F.col(f"lo{i}") + F.col(f"hi{i}")) / 2 for i in grid.axes])
    home = guest = cut_lineage(cells.select(F.lit("0").alias("ball"), "cell", centre.alias("m"), *boxes))
    pairs: list[DataFrame] = []

    def distance(p: Column) -> Column:
        return _length([F.abs(F.col("m")[i] - p["m"][i]) for i in grid.axes], grid.metric)

    def side(rows: DataFrame, s: str) -> DataFrame:
        return rows.select("ball", F.col("cell").alias(s), *grid.corners(s))

    level = 0
    while True:
        level += 1
        count = F.count("*")
        sizes = home.groupBy("ball").agg(count.alias("homes")).join(guest.groupBy("ball").agg(count.alias("guests")), "ball")
        sizes = cut_lineage(sizes.select("ball", ((F.col("homes") > HOMES) & (F.col("homes") * F.col("guests") > PAIRS)).alias("split")))
        kept, split = sizes.where(~F.col("split")).select("ball"), sizes.where("split").select("ball")
        whole = [rows.join(kept, "ball", "left_semi") for rows in (home, guest)]
        pairs.append(side(whole[0], "a").join(side(whole[1], "b"), "ball"))
        if split.isEmpty():
            return reduce(DataFrame.unionByName, pairs)
        home, guest = (rows.join(split, "ball", "left_semi") for rows in (home, guest))
        # Spark limits the rows of a ball before it shuffles them.
        turn = F.row_number().over(Window.partitionBy("ball").orderBy(F.xxhash64("cell", F.lit(level)), "cell"))
        drawn = home.select("ball", "cell", "m", turn.alias("turn")).where(F.col("turn") <= PIVOTS)
        pivots = cut_lineage(drawn.groupBy("ball").agg(F.sort_array(F.collect_list(F.struct("turn", "m"))).alias("pivots")))
        nearest = F.array_min(F.transform("pivots", lambda p: F.struct(distance(p).alias("d"), p["turn"].alias("turn"))))
        home = home.join(pivots, "ball").withColumn("at", nearest).drop("pivots")
        home = cut_lineage(home.select(F.concat_ws("/", "ball", F.col("at.turn").cast("string")).alias("inner"), "ball", "cell", "m", *boxes, F.col("at.d").alias("d"), F.col("at.turn").alias("turn")))
        radii = home.groupBy("ball", "turn").agg(F.max("d").alias("radius"))
        with_radii = drawn.drop("cell").join(radii, ["ball", "turn"])
        balls = cut_lineage(with_radii.groupBy("ball").agg(F.collect_list(F.struct("turn", "m", "radius")).alias("pivots")))
        inside = F.filter("pivots", lambda p: distance(p) <= p["radius"] + reach)
        guests = guest.join(balls, "ball").withColumn("turn", F.explode(F.transform(inside, lambda p: p["turn"])))
        guest = cut_lineage(guests.select(F.concat_ws("/", "ball", F.col("turn").cast("string")).alias("ball"), "cell", "m", *boxes))
        home = home.select(F.col("inner").alias("ball"), "cell", "m", *boxes)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of equal values in the first ``keys`` columns; a run may span batches."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        bounds = np.concatenate(([0], np.flatnonzero(new), [batch.num_rows]))
        for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            name = tuple(c[low] for c in columns[:keys])
            if held and name != last:
                yield [np.concatenate(parts) for parts in zip(*held)]
                held = []
            last = name
            held.append([c[low:high] for c in columns])
    if held:
        yield [np.concatenate(parts) for parts in zip(*held)]


def _block_groups(x: np.ndarray, w: np.ndarray, eps: float, min_samples: int, metric: str) -> np.ndarray:
    """For each point the first point of its group of linked core points, counting the given points alone; -1 for no core point.

    Distances a rounding short of eps do not count, so whatever is found here holds for all points.
    """
    n = len(x)
    near = np.empty((n, n), bool)
    most = eps * (1 - 1e-9) if metric == "manhattan" else (eps * (1 - 1e-9)) ** 2
    for low in range(0, n, STRIP):
        length = np.zeros((min(STRIP, n - low), n))
        for i in range(x.shape[1]):
            gap = x[low : low + STRIP, i, None] - x[None, :, i]
            length += np.abs(gap) if metric == "manhattan" else gap * gap
        near[low : low + STRIP] = length <= most
    counted = np.array([w[row].sum() for row in near])
    free = counted >= min_samples
    group = np.full(n, -1)
    for first in range(n):
        if not free[first]:
            continue
        front = np.array([first])
        free[first] = False
        while len(front):
            group[front] = first
            front = np.flatnonzero(near[front].any(axis=0) & free)
            free[front] = False
    return group


def _first_groups(points: DataFrame, grid: _Grid, min_samples: int) -> DataFrame:
    """(pid, cell, of): core points that are found by looking at blocks of bounded size, linked to the cell ``of``.

    A block is a box of twice eps a side, cut by a hash of its points where it has more than CROWD. SHIFTS boxes hold each point, so
    blocks overlap. Not all core points and links are found, but all that are found are right.
    """
    side, axes = 2 * grid.eps, [f"x{i}" for i in grid.axes]
    names = [F.concat_ws("_", F.lit(str(k)), *[F.floor(F.col(x) / side + k / SHIFTS).cast("string") for x in axes]) for k in range(SHIFTS)]
    rows = cut_lineage(points.select("pid", "w", "cell", *axes, F.explode(F.array(*names)).alias("block")))
    sizes = rows.groupBy("block").agg(F.count("*").alias("n"))
    sized = _with_sizes(rows, cut_lineage(sizes), "block", "pid")
    part = F.pmod(F.xxhash64("pid"), F.ceil(F.col("n") / CROWD)).cast("int")
    dealt = sized.select("block", part.alias("part"), "pid", "cell", F.col("w").cast("double").alias("w"), *axes)
    dealt = dealt.repartition("block", "part").sortWithinPartitions("block", "part", "pid")
    eps, metric = grid.eps, grid.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, pid, cell, w, *x in _groups(batches, 2):
            if w.sum() < min_samples:
                continue
            group = _block_groups(np.stack(x, axis=1), w, eps, min_samples, metric)
            core = np.flatnonzero(group >= 0)
            columns = [pa.array(pid[core], pa.int64()), pa.array(cell[core], pa.string()), pa.array(cell[group[core]], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["pid", "cell", "of"])

    return dealt.mapInArrow(run, "pid bigint, cell string, of string")


def _open_pairs(cells: DataFrame, home: DataFrame, grid: _Grid) -> DataFrame:
    """(a, b): pairs of different cells whose boxes are within reach (or a rounding further), for each cell a of ``home``.

    The cells of ``home`` are dealt into parts of about CROWD, all cells into blocks; each part meets each block in one task, as arrays.
    """
    asked = home.count()
    if asked > MOST_OPEN:
        return _neighbour_cells(cells, grid).join(home.select(F.col("cell").alias("a")), "a", "left_semi")
    parts = max(1, -(-asked // CROWD))
    blocks = max(chunk_count(cells.sparkSession), -(-cells.count() // (8 * CROWD)))
    corners = [f"{c}{i}" for c in ("lo", "hi") for i in grid.axes]

    def dealt(rows: DataFrame, side: int, own: str, n: int, other: str, m: int) -> DataFrame:
        at = F.pmod(F.xxhash64("cell", F.lit(side)), F.lit(n)).cast("int")
        return rows.withColumn(own, at).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select("part", "block", F.lit(side).alias("side"), "cell", *corners)

    rows = dealt(cells.join(home, "cell", "left_semi"), 0, "part", parts, "block", blocks)
    rows = rows.unionByName(dealt(cells, 1, "block", blocks, "part", parts))
    rows = rows.repartition("part", "block").sortWithinPartitions("part", "block", "side")
    axes, eps, metric = len(grid.axes), grid.eps * (1 + 1e-9), grid.metric

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, side, cell, *box in _groups(batches, 2):
            low, high = np.stack(box[:axes], axis=1), np.stack(box[axes:], axis=1)
            a, every = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for start in range(0, len(every) if len(a) else 0, STRIP):
                b = every[start : start + STRIP]
                length = np.zeros((len(b), len(a)))
                for i in range(axes):
                    gap = np.maximum(low[b, None, i] - high[None, a, i], low[None, a, i] - high[b, None, i])
                    np.maximum(gap, 0, out=gap)
                    length += gap if metric == "manhattan" else gap * gap
                j, k = np.nonzero(length <= (eps if metric == "manhattan" else eps**2))
                names = [cell[a[k]], cell[b[j]]]
                other = names[0] != names[1]
                yield pa.RecordBatch.from_arrays([pa.array(n[other], pa.string()) for n in names], names=["a", "b"])

    return rows.mapInArrow(run, "a string, b string")


def _blocks(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def _within_reach(asked: DataFrame, cells: DataFrame, points: DataFrame, near: DataFrame, grid: _Grid, value: str) -> DataFrame:
    """For points of thin cells: (pid, value) of each neighbouring cell entirely within reach, and of each single
    point within reach of the cells that are only partly so. ``cells`` and ``points`` carry ``value``, and points
    the size of their cell, by which a crowded cell is cut into blocks."""
    sides = cells.select(F.col("cell").alias("b"), *grid.corners("b"), F.col("n").alias("bn"), F.col(value).alias("cell_value"))
    visits = (
        asked.select("pid", F.col("cell").alias("a"), *[F.col(f"x{i}").alias(f"q{i}") for i in grid.axes])
        .join(near, "a")
        .join(sides, "b")
        .where(grid.gap(("q", "q"), ("blo", "bhi")) <= grid.eps)
        .withColumn("whole", grid.far(("q", "q"), ("blo", "bhi")) <= grid.eps)
    )
    entire = visits.where("whole").select("pid", F.col("cell_value").alias("value"))
    blocked = points.withColumn("block", F.pmod(F.xxhash64("pid"), _blocks("cell_n")).cast("int"))
    partly = (
        visits.where(~F.col("whole"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), _blocks("bn") - 1)))
        .select("pid", "block", F.col("b").alias("cell"), *[f"q{i}" for i in grid.axes])
        .join(blocked.select("cell", "block", value, *[f"x{i}" for i in grid.axes]), ["cell", "block"])
        .where(grid.points("q", "x") <= grid.eps)
        .select("pid", F.col(value).alias("value"))
    )
    return entire.unionByName(partly)


def _with_sizes(rows: DataFrame, table: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Attach the figures of cells or boxes to their points; ``table.n`` tells the crowded ones."""
    return lookup_join(rows, table, key, largest_keys({"t": table}, key, "n")["t"], spread_by)


def _links(core: DataFrame, core_cells: DataFrame, near: DataFrame, grid: _Grid) -> DataFrame:
    """(a, b), a < b: neighbouring cells with a pair of core points within reach.

    A round decides pairs of boxes by their corners, compares small pairs point by point and leaves large
    undecided pairs, with their boxes halved, to the next round.
    """
    axes = [f"x{i}" for i in grid.axes]

    def side(boxes: DataFrame, s: str) -> DataFrame:
        return boxes.select(F.col("cell").alias(s), F.col("box").alias(f"{s}box"), F.col("n").alias(f"{s}n"), *grid.corners(s))

    def singles(points: DataFrame, s: str) -> DataFrame:
        small = points.where(F.col("n") <= PAIRS)
        return small.select(F.col("box").alias(f"{s}box"), *[F.col(x).alias(s + x[1:]) for x in axes])

    # A box is named by its cell and its place in it; at first it is the whole cell.
    boxes = core_cells.select("cell", F.col("cell").alias("box"), "n", *[f"{c}{i}" for c in ("lo", "hi") for i in grid.axes])
    points = core.select("pid", "cell", F.col("cell").alias("box"), F.col("core_n").alias("n"), *axes)
    open_pairs = near.where(F.col("a") < F.col("b")).join(side(boxes, "a"), "a").join(side(boxes, "b"), "b")
    found: list[DataFrame] = []
    level = 0
    while True:
        within = cut_lineage(
            open_pairs.where(grid.gap(("alo", "ahi"), ("blo", "bhi")) <= grid.eps).withColumn(
                "sure", grid.far(("alo", "ahi"), ("blo", "bhi")) <= grid.eps
            )
        )
        found.append(within.where("sure").select("a", "b").distinct())
        unsure = within.where(~F.col("sure")).join(found[-1], ["a", "b"], "left_anti")
        few = F.col("an") * F.col("bn") <= PAIRS
        compared = (
            unsure.where(few)
            .select("a", "abox", "b", "bbox")
            .join(singles(points, "a"), "abox")
            .join(singles(points, "b"), "bbox")
            .where(grid.points("a", "b") <= grid.eps)
        )
        found.append(cut_lineage(compared.select("a", "b").distinct()))
        rest = cut_lineage(unsure.where(~few).join(found[-1], ["a", "b"], "left_anti").select("a", "abox", "b", "bbox"))
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()
        level += 1
        split = rest.select(F.col("abox").alias("parent")).union(rest.select("bbox")).distinct()
        halved = (
            points.drop("n")
            .withColumnRenamed("box", "parent")
            .join(split, "parent", "left_semi")
            .withColumn("box", F.concat_ws("/", "cell", grid.subcell(level)))
        )
        boxes = cut_lineage(halved.groupBy("cell", "parent", "box").agg(F.count("*").alias("n"), *grid.box()))
        points = cut_lineage(_with_sizes(halved.drop("parent"), boxes.select("box", "n"), "box", "pid"))
        open_pairs = rest
        for s in ("a", "b"):
            children = boxes.select("parent", "cell", "box", "n", *[f"{c}{i}" for c in ("lo", "hi") for i in grid.axes])
            inner = side(children, s).join(children.select(F.col("box").alias(f"{s}box"), F.col("parent").alias(f"{s}parent")), f"{s}box")
            open_pairs = open_pairs.withColumnRenamed(f"{s}box", f"{s}parent").join(inner.drop(s), f"{s}parent")


def _outermost(core: DataFrame, grid: _Grid) -> DataFrame:
    """(cell, ends): the core points of a cell that are first and last on each axis."""
    point = F.array(*[F.col(f"x{i}") for i in grid.axes])
    ends = [end(point, F.struct(f"x{i}", "pid")) for i in grid.axes for end in (F.min_by, F.max_by)]
    return core.groupBy("cell").agg(F.array(*ends).alias("ends"))


def _first_links(core: DataFrame, pairs: DataFrame, grid: _Grid) -> DataFrame:
    """(a, b): those of the pairs of cells that have outermost core points within reach of each other. Not all links are found."""
    ends = cut_lineage(_outermost(core, grid))
    for s in ("a", "b"):
        pairs = pairs.join(ends.select(F.col("cell").alias(s), F.col("ends").alias(f"{s}_ends")), s)

    def near(p: Column) -> Column:
        return F.exists("b_ends", lambda q: _length([F.abs(p[i] - q[i]) for i in grid.axes], grid.metric) <= grid.eps)

    return pairs.where(F.exists("a_ends", near)).select("a", "b")


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the smallest seed of each node's component. ``nodes`` has a unique seed per node.

    In a round every node takes the smallest label around it, passes it on to the owner of its old label, and
    then takes the label of its new label's owner. So labels travel over whole merged regions at once and few
    rounds are needed even for long chains.
    """
    edges = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    state = cut_lineage(nodes.select("node", "seed", F.col("seed").alias("label")))
    while True:
        around = (
            edges.join(state.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("around"))
        )
        seen = state.join(around, "node", "left").withColumn("around", F.least("label", "around"))
        passed = seen.groupBy(F.col("label").alias("seed")).agg(F.min("around").alias("passed"))
        lower = cut_lineage(
            seen.join(passed, "seed", "left").select(
                "node", "seed", F.col("label").alias("old"), F.least("around", "passed").alias("next")
            )
        )
        owners = lower.select(F.col("seed").alias("next"), F.col("next").alias("owner_label"))
        state = cut_lineage(
            lower.join(owners, "next", "left").select("node", "seed", F.least("next", "owner_label").alias("label"), "old")
        )
        if state.where(F.col("label") != F.col("old")).isEmpty():
            return state.select("node", "label")


def _parts(core: DataFrame, sure: DataFrame) -> DataFrame:
    """(cell, part): cells with core points, and a name for those that the links found in blocks lead to each other."""
    nodes = core.groupBy(F.col("cell").alias("node")).agg(F.min("pid").alias("seed"))
    found = sure.where("cell != of").select(F.col("cell").alias("a"), F.col("of").alias("b")).distinct()
    return connected(nodes, found).select(F.col("node").alias("cell"), F.concat(F.lit("of "), F.col("label").cast("string")).alias("part"))


def _settled(core: DataFrame, cells: DataFrame, parts: DataFrame) -> DataFrame:
    """Cells of the largest part that have no points but core points."""
    largest = parts.groupBy("part").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "part").limit(1).select("part")
    inside = parts.join(F.broadcast(largest), "part", "left_semi").select("cell")
    whole = core.groupBy("cell").agg(F.count("*").alias("found")).join(cells.select("cell", "n"), "cell").where("found = n")
    return whole.join(inside, "cell", "left_semi").select("cell")


def dbscan(
    df: DataFrame, row_id: str, features: list[str], eps: float, min_samples: int, metric: str = "euclidean"
) -> DataFrame:
    """(row id, cluster): the smallest core row id of the cluster, -1 for noise.

    A row with a NULL or NaN coordinate has no distance to any other and is noise.
    """
    grid = _Grid(len(features), eps, metric)
    named = cut_lineage(
        df.select(F.col(row_id).cast("long").alias("id"), *[(F.col(c).cast("double") + 0.0).alias(f"x{i}") for i, c in enumerate(features)])
    )
    placed = reduce(lambda a, b: a & b, [F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}") for i in range(len(features))])
    lost = named.where(~placed).select(F.col("id").alias(row_id), F.lit(-1).cast("long").alias("cluster"))
    named = named.where(placed)
    spots, keys = [f"x{i}" for i in grid.axes], [f"c{i}" for i in grid.axes]
    coordinates = [F.floor(F.col(x) / grid.side).cast("long").alias(c) for x, c in zip(spots, keys)]
    points = (
        named.groupBy(*spots)
        .agg(F.min("id").alias("pid"), F.count("*").alias("w"))
        .select("*", *coordinates)
        .withColumn("cell", F.concat_ws("_", *[F.col(c).cast("string") for c in keys]))
    )
    points = cut_lineage(points)
    cells = cut_lineage(
        points.groupBy("cell", *keys).agg(F.sum("w").alias("w"), F.count("*").alias("n"), *grid.box())
    )
    sized = _with_sizes(points.drop(*keys), cells.select("cell", F.col("w").alias("cell_w"), "n"), "cell", "pid")
    points = cut_lineage(sized.withColumnRenamed("n", "cell_n"))

    thin = points.where(F.col("cell_w") < min_samples)
    columns = ["pid", "cell", *[f"x{i}" for i in grid.axes]]
    core = points.where(F.col("cell_w") >= min_samples).select(*columns)
    if len(grid.axes) > GRID_AXES:
        sure = cut_lineage(_first_groups(points, grid, min_samples))
        known = sure.select("pid").distinct()
        core = cut_lineage(core.unionByName(thin.join(known, "pid", "left_semi").select(*columns)))
        thin = thin.join(known, "pid", "left_anti")
        parts = cut_lineage(_parts(core, sure))
        home = cut_lineage(cells.join(_settled(core, cells, parts), "cell", "left_anti").select("cell"))
        near = cut_lineage(_open_pairs(cells, home, grid))
    else:
        parts = core.select("cell", F.col("cell").alias("part")).distinct()
        near = cut_lineage(_neighbour_cells(cells, grid))
    around = _within_reach(thin, cells, points, near, grid, "w").groupBy("pid").agg(F.sum("value").alias("others"))
    enough = F.col("cell_w") + F.coalesce("others", F.lit(0)) >= min_samples
    judged = cut_lineage(thin.join(around, "pid", "left").withColumn("core", enough))
    core = core.unionByName(judged.where("core").select(*columns))
    core_cells = cut_lineage(core.groupBy("cell").agg(F.min("pid").alias("seed"), F.count("*").alias("n"), *grid.box()))
    core = cut_lineage(_with_sizes(core, core_cells.select("cell", "n"), "cell", "pid").withColumnRenamed("n", "core_n"))
    placed_cells = core_cells.join(parts, "cell", "left").select("cell", "seed", F.coalesce("part", "cell").alias("part"))

    def parts_apart(pairs: DataFrame, placed: DataFrame) -> DataFrame:
        for s in ("a", "b"):
            pairs = pairs.join(placed.select(F.col("cell").alias(s), F.col("part").alias(f"part_{s}")), s)
        return pairs.where("part_a != part_b")

    def together(placed: DataFrame, links: DataFrame) -> DataFrame:
        """``placed`` with the parts that links lead to each other as one, by its smallest seed."""
        nodes = placed.groupBy(F.col("part").alias("node")).agg(F.min("seed").alias("seed"))
        linked = parts_apart(links, placed).select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct()
        joined = connected(nodes, linked).withColumnRenamed("node", "part")
        return cut_lineage(placed.join(joined, "part").select("cell", "seed", F.col("label").alias("part")))

    both_core = parts_apart(near, placed_cells).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    both_core = cut_lineage(both_core.distinct())
    if len(grid.axes) <= GRID_AXES:
        placed_cells = together(placed_cells, cut_lineage(_first_links(core, both_core, grid)))
        both_core = cut_lineage(parts_apart(both_core, placed_cells).select("a", "b"))
    if len(grid.axes) > GRID_AXES or not both_core.isEmpty():
        placed_cells = together(placed_cells, _links(core, core_cells, both_core, grid))
    labelled_cells = cut_lineage(core_cells.join(placed_cells.select("cell", F.col("part").alias("label")), "cell"))
    labelled_core = _with_sizes(core, labelled_cells.select("cell", "label", "n"), "cell", "pid").withColumnRenamed("n", "cell_n")

    rest = judged.where(~F.col("core"))
    touched = _within_reach(rest, labelled_cells, labelled_core, near, grid, "label")
    at_home = rest.join(labelled_cells.select("cell", F.col("label").alias("value")), "cell").select("pid", "value")
    border = touched.unionByName(at_home).groupBy("pid").agg(F.min("value").alias("label"))
    found = labelled_core.select("pid", "label").unionByName(border.select("pid", "label"))
    crowded = cells.where(F.col("w") >= min_samples)
    by_cell = crowded.select("cell", *keys, "w").join(labelled_cells.select("cell", F.col("label").alias("cluster")), "cell").drop("cell")
    in_thin = points.where(F.col("cell_w") < min_samples).select("pid", *spots, "w")
    by_spot = in_thin.join(found, "pid", "left").withColumn("cluster", F.coalesce("label", F.lit(-1)).cast("long")).drop("pid", "label")
    rows = named.select("*", *coordinates)
    return reduce(
        DataFrame.unionByName,
        [_of_place(rows, cut_lineage(table), on).select(F.col("id").alias(row_id), "cluster") for table, on in ((by_cell, keys), (by_spot, spots))],
        lost,
    )


def _of_place(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` whose columns ``on`` are in ``table``, with its cluster; ``w`` is the number of rows behind an entry."""
    keyed = table.withColumn("place", F.xxhash64(*on))
    hot = largest_keys({"place": keyed.where(F.col("w") > 1)}, "place", "w")["place"]
    joined = lookup_join(rows.withColumn("place", F.xxhash64(*on)), keyed.drop("w"), "place", hot, "id", tuple(on))
    return joined.where(F.col("cluster").isNotNull())

"""The prefix trie of conversations: burst heads, sorted containers below them, a sweep that gives the nodes.

A conversation is a path: the ids of its turns, TURN bytes each, one after the other. A prefix of turns is a prefix of
bytes, so paths that share a beginning stand next to each other when sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayglass.llm.frames import quoted
from dayglass.session import cut_lineage

#: Bytes of a turn's id: 16 of the digest of role and text, 4 of the number of code points of the text.
TURN = 20
#: Different paths in a container; a fuller one is burst by the next turn.
CONTAINER = 512
#: Ids that agree but for so many low bits share a row while the ids of equal conversations are gathered.
SPAN_BITS = 8
#: Rounds of bursting between two writings of the paths.
ROUNDS = 4

_NONE = 1 << 63


def turn_ids(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, id): NULL roles and texts count as empty. Texts go no further than this."""
    who, what = (F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in (role, text))
    digest = F.substring(F.sha2(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, what), 256), 1, 32)
    chars = F.lpad(F.hex(F.char_length(what)), 8, "0")
    number = F.col(quoted(turn)).alias("turn")
    return conversations.select(F.col(quoted(conv_id)).cast("long").alias("conv_id"), number, F.unhex(F.concat(digest, chars)).alias("id"))


def _path(ids: Column) -> Column:
    return F.unhex(F.array_join(F.transform(ids, F.hex), ""))


def conversation_paths(turns: DataFrame, group: int | None = None, most: int = 6) -> DataFrame:
    """(conv_id, path) per conversation, its turns ordered by number (NULL first), equal numbers by the id of the turn.

    With ``group`` conversation c is rebuilt: the first h turns of conversation c - c % group (all if it has fewer, none
    if it is not there), then its own after its first h, where h is crc32 of the decimal c, modulo ``most``. NULL ids
    are one conversation of its own with an empty decimal. One shuffle deals whole groups of conversations; a
    conversation is one row.
    """
    c = F.col("conv_id")
    block = c if group is None else c - c % group
    dealt = turns.withColumn("__block", block).repartition("__block")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "id"))), lambda t: t["id"])
    rows = dealt.groupBy("__block", "conv_id").agg(ordered.alias("ids"))
    if group is None:
        return rows.select("conv_id", _path(F.col("ids")).alias("path"))
    first = F.max(F.when(c == F.col("__block"), F.slice("ids", 1, most - 1))).over(Window.partitionBy("__block"))
    h = (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % most).cast("int")
    rows = rows.withColumns({"first": F.coalesce(first, F.array().cast("array<binary>")), "h": h})
    own = F.slice("ids", F.col("h") + 1, F.greatest(F.size("ids") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", _path(F.concat(F.slice("first", F.lit(1), F.col("h")), own)).alias("path"))


def distinct_paths(paths: DataFrame) -> DataFrame:
    """(path, n_convs, conv_id, ends_sha256): different paths, with number, smallest id and digest of all ids.

    The digest is of the decimal ids in ascending order, comma-joined. Ids of one path are first joined in rows of
    2 ** SPAN_BITS neighbouring numbers at most, so that many equal conversations are not gathered in a task; the digest then runs
    over these rows in order, holding none.
    """
    c = F.col("conv_id")
    near = paths.groupBy("path", F.shiftright(c, SPAN_BITS).alias("__near")).agg(F.sort_array(F.collect_list(F.struct("conv_id"))).alias("ids"))
    joined = F.array_join(F.transform("ids", lambda i: F.coalesce(i["conv_id"].cast("string"), F.lit(""))), ",")
    rows = near.select("path", "__near", F.size("ids").cast("long").alias("n"), F.col("ids")[0]["conv_id"].alias("first"), joined.alias("text"))
    dealt = rows.repartition("path").sortWithinPartitions("path", F.col("__near").asc_nulls_last()).drop("__near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, first, digest = None, 0, None, None

        def closed(done: list) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done), kinds)], names=["path", "n_convs", "conv_id", "ends_sha256"])

        for batch in batches:
            done = []
            for next_path, count, smallest, text in zip(*[x.to_pylist() for x in batch.columns]):
                if digest is not None and next_path == path:
                    digest.update(b"," + text.encode())
                    n += count
                    continue
                if digest is not None:
                    done.append((path, n, first, digest.hexdigest()))
                path, n, first, digest = next_path, count, smallest, hashlib.sha256(text.encode())
            if done:
                yield closed(done)
        if digest is not None:
            yield closed([(path, n, first, digest.hexdigest())])

    return dealt.mapInArrow(run, "path binary, n_convs bigint, conv_id bigint, ends_sha256 string")


def _prefix(path: str, turns: int | Column) -> Column:
    length = F.lit(TURN * turns) if isinstance(turns, int) else (turns * TURN).cast("int")
    return F.substring(F.col(path), F.lit(1), length)


def burst(paths: DataFrame, container: int = CONTAINER) -> tuple[DataFrame, DataFrame]:
    """(heads, paths with ``burst`` and ``head_conv``): bursts containers of more than ``container`` paths by their next turn.

    The root is always burst. A head is a prefix whose container was burst: head, depth, n_convs, conv_id. ``burst`` is
    the depth of the deepest head that a path runs through, ``head_conv`` that head's smallest conversation. A round
    counts one more turn of the paths below the heads of the last one and ends when no container is too full; there is
    at most one head for ``container`` paths at a depth, and Spark joins them as their written size allows.
    """
    root = paths.agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    heads = cut_lineage(root.select(F.lit(b"").alias("head"), F.lit(0).alias("depth"), "n_convs", "conv_id"))
    found = heads.first()
    state = paths.withColumns({"burst": F.lit(0), "head_conv": F.lit(found["conv_id"] if found else None).cast("long")})
    depth = 0
    while True:
        depth += 1
        below = (F.col("burst") == depth - 1) & (F.octet_length("path") >= TURN * depth)
        full = state.where(below).groupBy(_prefix("path", depth).alias("head"))
        full = full.agg(F.count("*").alias("__paths"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
        full = cut_lineage(full.where(F.col("__paths") > container).select("head", F.lit(depth).alias("depth"), "n_convs", "conv_id"))
        if full.isEmpty():
            return heads, state
        heads = heads.unionByName(full)
        # No head has the length of the other key, which keeps paths that are not below a head apart in a shuffle.
        key = F.when(below, _prefix("path", depth)).otherwise(F.concat("path", F.lit(b"\0")))
        joined = state.withColumn("head", key).join(full.select("head", F.lit(True).alias("__hit"), F.col("conv_id").alias("__conv")), "head", "left")
        hit = F.col("__hit").isNotNull()
        state = joined.withColumns({"burst": F.when(hit, depth).otherwise(F.col("burst")), "head_conv": F.when(hit, F.col("__conv")).otherwise(F.col("head_conv"))})
        state = state.select(*paths.columns, "burst", "head_conv")
        if depth % ROUNDS == 0:
            state, heads = cut_lineage(state), cut_lineage(heads)


_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_EMPTY = hashlib.sha256(b"").hexdigest()
_FLUSH = 1 << 14


class _Node:
    __slots__ = ("conv", "n", "children", "leaves", "saved", "chars", "ends", "done")

    def __init__(self, chars: int):
        self.conv, self.n, self.children, self.leaves, self.saved, self.chars, self.ends, self.done = _NONE, 0, 0, 0, 0, chars, _EMPTY, []


class Sweep:
    """Sorted paths in, nodes out. Open are the nodes of the last path; a node's finished children wait for its smallest id."""

    def __init__(self):
        self.open: list[_Node] = []
        self.path, self.top, self.head_conv = b"", 0, None
        self.rows: list[tuple] = []

    def close(self, until: int) -> None:
        """Close nodes until ``until`` of them are open."""
        while len(self.open) > until:
            node = self.open.pop()
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.chars
            depth = self.top + len(self.open) + 1
            conv = None if node.conv == _NONE else node.conv
            self.rows += [(r[0], r[1], conv, *r[2:], None) for r in node.done]
            row = (conv, depth, node.n, node.children, leaves, saved, node.ends)
            if self.open:
                above = self.open[-1]
                above.conv, above.n, above.children = min(above.conv, node.conv), above.n + node.n, above.children + 1
                above.leaves, above.saved = above.leaves + leaves, above.saved + saved
                above.done.append(row)
            else:
                self.rows.append((row[0], row[1], self.head_conv, *row[2:], self.path[: TURN * self.top]))

    def add(self, path: bytes, n: int, conv: int | None, ends: str, top: int, head_conv: int | None) -> None:
        """``path`` lies below a head of depth ``top``; the first node below that head begins a container."""
        turns = len(path) // TURN
        shared = top
        if self.open and top == self.top:
            while shared < turns and path[TURN * shared : TURN * (shared + 1)] == self.path[TURN * shared : TURN * (shared + 1)]:
                shared += 1
            shared = shared if path.startswith(self.path[: TURN * top]) else top
        self.close(shared - top if top == self.top else 0)
        self.path, self.top, self.head_conv = path, top, head_conv
        for at in range(shared, turns):
            self.open.append(_Node(int.from_bytes(path[TURN * at + 16 : TURN * at + TURN], "big")))
        node = self.open[-1]
        node.n, node.conv, node.ends = n, _NONE if conv is None else conv, ends


def sweep_containers(paths: DataFrame) -> DataFrame:
    """Nodes below the heads, and ``head`` with the nodes directly below one.

    Containers are dealt whole, so a task sees all paths of a node; it holds the nodes of one container at most.
    """
    inside = paths.where(F.octet_length("path") > TURN * F.col("burst"))
    dealt = inside.repartition(_prefix("path", F.col("burst") + 1)).sortWithinPartitions("path")
    fields = [f.split()[0] for f in _NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep()

        def swept() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*sweep.rows), kinds)], names=[*fields, "head"])
            sweep.rows = []
            return made

        for batch in batches:
            for row in zip(*[x.to_pylist() for x in batch.columns]):
                sweep.add(*row)
                if len(sweep.rows) > _FLUSH:
                    yield swept()
        sweep.close(0)
        if sweep.rows:
            yield swept()

    return dealt.select("path", "n_convs", "conv_id", "ends_sha256", "burst", "head_conv").mapInArrow(run, f"{_NODE}, head binary")


def prefix_nodes(paths: DataFrame, container: int = CONTAINER) -> DataFrame:
    """One row per node of the trie of (conv_id, path).

    conv_id: smallest member; depth; parent_conv_id: that of the parent (root: NULL); n_convs: members; n_children;
    n_leaves: nodes without children in the subtree, itself included; saved_tokens: over the subtree, members less one
    times code points of the last text; ends_sha256: digest of the decimal ids of the members that end here, ascending,
    comma-joined. A NULL id counts as a member, is no smallest one while there are others, and comes last with an empty
    decimal. No conversations give no nodes.
    """
    heads, placed = burst(cut_lineage(distinct_paths(paths)), container)
    placed = cut_lineage(placed)
    nodes = cut_lineage(sweep_containers(placed))
    chars = F.when(F.col("depth") == 0, 0).otherwise(F.conv(F.hex(F.substring("head", -4, 4)), 16, 10).cast("long"))
    heads = cut_lineage(heads.withColumn("own", (F.col("n_convs") - 1) * chars))

    def with_ancestors(rows: DataFrame, own_depth: Column, *columns: Column) -> DataFrame:
        """Each row once for its head and every prefix of it."""
        above = rows.select("*", F.explode(F.sequence(F.lit(0), own_depth.cast("int"))).alias("__turns"))
        return above.select(_prefix("head", F.col("__turns")).alias("head"), *columns)

    tops = nodes.where(F.col("head").isNotNull())
    # The depth of a node directly below a head is one more than the head's.
    parts = with_ancestors(tops, F.col("depth") - 1, "n_leaves", "saved_tokens", (F.col("__turns") == F.col("depth") - 1).cast("long").alias("child"))
    more = with_ancestors(
        heads, F.col("depth"), F.lit(0).cast("long").alias("n_leaves"), F.col("own").alias("saved_tokens"), (F.col("__turns") == F.col("depth") - 1).cast("long").alias("child")
    )
    sums = parts.unionByName(more).groupBy("head").agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "child")])
    ends = placed.where(F.octet_length("path") == TURN * F.col("burst")).select(F.col("path").alias("head"), "ends_sha256")
    above = heads.select(F.col("head").alias("__above"), F.col("conv_id").alias("parent_conv_id"))
    parent = F.when(F.col("depth") > 0, _prefix("head", F.col("depth") - 1))
    whole = heads.withColumn("__above", parent).join(above, "__above", "left").join(sums, "head").join(ends, "head", "left")
    top_rows = whole.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.col("child").alias("n_children"),
        F.when(F.col("child") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
    return nodes.drop("head").unionByName(top_rows)

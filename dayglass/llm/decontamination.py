"""Benchmark passages in documents by Wu-Manber search over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.llm.frames import quoted, with_text_columns
from dayglass.llm.textkit import ALPHANUMERIC, Words, blocks, mix, split_words, word_hashes
from dayglass.session import cut_lineage

#: Words of a window.
WIDTH = 10
#: Most bytes of benchmark text that are searched for in one pass; larger benchmarks take several passes.
PASS_BYTES = 16 << 20
#: Words of a lane; the lanes of a block are searched side by side.
LANE = 256


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9FB21C651E98DF25) + b)


class Patterns:
    """Search tables for word patterns of one length.

    ``shift`` gives for a block of two words (one, if patterns have one word) how far the search may move on; a
    block in no pattern moves it by the whole pattern but one. Patterns that end in the same block and start with the
    same block share a bucket; all words of a text's window are compared with those of each pattern in its bucket,
    first by their hashes and then by their bytes.
    """

    def __init__(self, spelled: dict[tuple[bytes, ...], set[int]]):
        self.words = list(spelled)
        self.items = [np.array(sorted(spelled[p]), np.int64) for p in self.words]
        self.size = len(self.words[0])
        flat = pa.array([w.decode("utf-8") for p in self.words for w in p], pa.string())
        hashes = []
        for block in blocks(flat):
            hashes.append(word_hashes(split_words(block, ALPHANUMERIC)))
        table = np.concatenate(hashes).reshape(len(self.words), self.size)
        self.block = min(2, self.size)
        self.most = self.size - self.block + 1
        keys = self._keys(table)
        order = np.argsort(keys, kind="stable")
        self.keys, self.order, self.table = keys[order], order, table
        slots = 1 << max(10, int(np.ceil(np.log2(8 * table.size))))
        self.mask = np.uint64(slots - 1)
        self.shift = np.full(slots, self.most, np.int32)
        for end in range(self.block - 1, self.size):
            at = (self._blocks(table[:, end - self.block + 1], table[:, end]) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, at, self.size - 1 - end)

    def _blocks(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _pair(before, last) if self.block == 2 else mix(last)

    def _keys(self, windows: np.ndarray) -> np.ndarray:
        head = self._blocks(windows[:, 0], windows[:, self.block - 1])
        return _pair(head, self._blocks(windows[:, -self.block], windows[:, -1]))

    def find(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word positions at which patterns start, and the patterns."""
        counts = np.diff(words.first)
        lanes = np.where(counts >= self.size, -(-counts // LANE), 0)
        text = np.repeat(np.arange(len(counts)), lanes)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = words.first[text] + inside * LANE
        # A lane finds the windows that start in it; the last word it looks at may lie in the next lane.
        stop = np.minimum(start + LANE + self.size - 1, words.first[text + 1])
        at = start + self.size - 1
        live = at < stop
        at, stop = at[live], stop[live]
        while len(at):
            step = self.shift[(self._blocks(hashes[at - self.block + 1], hashes[at]) & self.mask).astype(np.int64)]
            stopped = at[step == 0] - self.size + 1
            if len(stopped):
                windows = hashes[stopped[:, None] + np.arange(self.size)]
                keys = self._keys(windows)
                low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
                number = high - low
                if number.any():
                    which = np.repeat(np.arange(len(keys)), number)
                    slot = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number) + low[which]
                    pattern = self.order[slot]
                    same = (windows[which] == self.table[pattern]).all(axis=1)
                    yield stopped[which[same]], pattern[same]
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]

    def confirmed(self, words: Words, raw: bytes, at: int, pattern: int) -> bool:
        begin, end = words.begin[at : at + self.size], words.end[at : at + self.size]
        return all(raw[a:b] == w for a, b, w in zip(begin.tolist(), end.tolist(), self.words[pattern]))


def build_patterns(items: list[tuple[int, str | None]], width: int = WIDTH) -> list[Patterns]:
    """Tables per pattern length: all runs of ``width`` words, or all words of an item that has fewer but not none."""
    spelled: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
    for item, text in items:
        for block in blocks(pa.array([text], pa.string())):
            words = split_words(block, ALPHANUMERIC)
            raw = words.data.tobytes()
            found = [raw[a:b] for a, b in zip(words.begin.tolist(), words.end.tolist())]
            size = min(width, len(found))
            for i in range(len(found) - size + 1 if size else 0):
                spelled.setdefault(size, {}).setdefault(tuple(found[i : i + size]), set()).add(int(item))
    return [Patterns(p) for _, p in sorted(spelled.items())]


def _item_passes(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str | None]]]:
    """The items in lists of at most PASS_BYTES of text (a longer text alone), one list on the driver at a time."""
    rows = items.where(F.col(quoted(item_id)).isNotNull() & F.col(quoted(text)).isNotNull())
    part: list[tuple[int, str | None]] = []
    size = 0
    for row in rows.select(F.col(quoted(item_id)).cast("long"), F.col(quoted(text)).cast("string")).toLocalIterator():
        if part and size + len(row[1]) > PASS_BYTES:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += len(row[1])
    yield part


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` and ``items``: which words lie in passages of which items.

    A passage is a run of ``width`` consecutive words of an item (all its words, if it has fewer but not none) that
    occurs in the document. ``hits`` lists (first, last) word numbers from 0 of the longest runs of hit words,
    ``items`` the sorted ids of the items with passages. NULL texts have no words; items without id or text are not
    searched for; repeated rows are judged each; a document without passage has empty lists.

    One narrow pass over the documents: the items' tables are broadcast, at most PASS_BYTES of item text at a time. A
    larger benchmark is searched for in several passes, each adding to what the pass before found; between them
    the rows are written to the shared folder.
    """
    spark = docs.sparkSession
    fields = "n_words bigint, hits array<struct<first:bigint,last:bigint>>, items array<bigint>"
    found = docs
    for number, part in enumerate(_item_passes(items, item_id, item_text)):
        tables = spark.sparkContext.broadcast(build_patterns(part, width))
        if number:
            found = cut_lineage(found.withColumnsRenamed({"hits": "__hits", "items": "__items"}))
        found = with_text_columns(found, text, fields, lambda t=tables: lambda column: _search(column, t.value), _kept(docs, keep, text, number))
        if number:
            both = F.array_sort(F.array_distinct(F.concat("__items", "items")))
            found = found.withColumn("items", both).withColumn("hits", _joined_runs(F.concat("__hits", "hits"))).drop("__hits", "__items")
    return found if keep is None else found.select(*[F.col(quoted(c)) for c in keep], "n_words", "hits", "items")


def _kept(docs: DataFrame, keep: list[str] | None, text: str, number: int) -> list[str]:
    names = list(docs.columns if keep is None else dict.fromkeys([*keep, text]))
    return names + ["__hits", "__items"] * bool(number)


def _joined_runs(runs):
    """Runs of words, sorted and with overlapping or touching ones joined."""
    kind = "array<struct<first:bigint,last:bigint>>"
    return F.aggregate(
        F.array_sort(runs),
        F.array().cast(kind),
        lambda done, run: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["last"] + 1 >= run["first"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], run["last"]).alias("last"))),
            ),
        ).otherwise(F.concat(done, F.array(run))),
    )


def _search(column: pa.Array, tables: list[Patterns]) -> list:
    n_words: list[int] = []
    hits: list[list[dict]] = []
    items: list[list[int]] = []
    for block in blocks(column):
        words = split_words(block, ALPHANUMERIC)
        hashes = word_hashes(words)
        raw = words.data.tobytes()
        edges = np.zeros(len(words.begin) + 1, np.int64)
        seen: dict[int, set[int]] = {}
        for table in tables:
            for at, pattern in table.find(words, hashes):
                for a, p in zip(at.tolist(), pattern.tolist()):
                    if table.confirmed(words, raw, a, p):
                        edges[a] += 1
                        edges[a + table.size] -= 1
                        seen.setdefault(int(np.searchsorted(words.first, a, "right")) - 1, set()).update(table.items[p].tolist())
        hit = np.cumsum(edges)[:-1] > 0
        first = words.first.tolist()
        for i in range(block.high - block.low):
            n_words.append(first[i + 1] - first[i])
            if i in seen:
                own = np.concatenate(([False], hit[first[i] : first[i + 1]], [False]))
                turn = np.flatnonzero(own[1:] != own[:-1])
                hits.append([{"first": a, "last": b - 1} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist())])
                items.append(sorted(seen[i]))
            else:
                hits.append([])
                items.append([])
    return [n_words, hits, items]


def passage_digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and a digest of the items per document, from :func:`find_passages`."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, run: n + run["last"] - run["first"] + 1)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        F.col(quoted(doc_id)).alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )

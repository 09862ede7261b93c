"""Words, shingles and their hashes over the UTF-8 bytes of an Arrow column, in numpy.

Tasks call these on one block of texts at a time. No Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


class Block(NamedTuple):
    """Texts ``low`` to ``high`` of a batch as one byte array; text i takes bytes ``starts[i]`` to ``starts[i + 1]``."""

    low: int
    high: int
    data: np.ndarray
    starts: np.ndarray


class Words(NamedTuple):
    """Words of a block: bytes ``begin`` to ``end`` of ``data``; text i has words ``first[i]`` to ``first[i + 1]``."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> str:
        return self.data[self.begin[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def strings(self) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self.begin.tolist(), self.end.tolist())]


def _table(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Everything but blank, tab, line feed, vertical tab, form feed and carriage return.
NOT_BLANK = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ASCII letters and digits and every byte of a character beyond ASCII.
ALPHANUMERIC = _table(lambda b: b >= 0x80 or chr(b).isalnum())
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES, most: int = 1 << 20) -> Iterator[Block]:
    """Cut a column of texts into blocks of about ``limit`` bytes and at most ``most`` texts.

    NULL counts as an empty text; a text stays whole.
    """
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(filled):
        return
    _, offsets, values = filled.buffers()
    offsets = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    low = 0
    while low < len(filled):
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), len(filled), low + most)
        yield Block(low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


def split_words(block: Block, inside: np.ndarray = NOT_BLANK, lower: bool = True) -> Words:
    """Words as longest runs of the bytes marked in ``inside``; A-Z lower-cased; a word never spans two texts."""
    data = LOWER[block.data] if lower else block.data
    mark = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[block.starts] = True
    before = np.concatenate(([False], mark[:-1])) if len(mark) else mark
    after = np.concatenate((mark[1:], [False])) if len(mark) else mark
    begin = np.flatnonzero(mark & (~before | edge[:-1]))
    end = np.flatnonzero(mark & (~after | edge[1:])) + 1
    return Words(data, begin, end, np.searchsorted(begin, block.starts))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        steps = np.full(n + 1, base % (1 << 64), np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


class Rolling:
    """Hashes of any byte range of a block, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        size = BLOCK_BYTES
        while size < len(data):
            size *= 2
        up, self.down = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        terms = self.sums[1:]
        terms[:] = data
        terms += np.uint64(1)
        terms *= up[: len(data)]
        np.cumsum(terms, out=terms)

    def of(self, begin: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        raw = (self.sums[end] - self.sums[begin]) * self.down[begin]
        return mix(raw + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(salt))


def word_hashes(words: Words, salt: int = 0) -> np.ndarray:
    return Rolling(words.data).of(words.begin, words.end, salt)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each text, in order, and where each text's runs begin.

    A text of fewer words, but not none, has its whole sequence as one run.
    """
    step = np.uint64(0x9FB21C651E98DF25)
    counts = np.diff(first)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_first = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(out_first[-1], np.uint64)
    for n in range(1, width + 1):
        texts = np.flatnonzero(counts >= width) if n == width else np.flatnonzero(counts == n)
        if not len(texts):
            continue
        number = sizes[texts]
        inside = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        at = np.repeat(first[texts], number) + inside
        value = np.full(len(at), n, np.uint64)
        for i in range(n):
            value = mix(value * step + hashes[at + i])
        out[np.repeat(out_first[texts], number) + inside] = value
    return out, out_first


def distinct_per_text(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text."""
    parts = [np.unique(values[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    joined = np.concatenate(parts) if parts else values[:0]
    return joined, np.concatenate(([0], np.cumsum(sizes)))

"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.frames import quoted, with_text_columns
from dayglass.llm.textkit import blocks, mix, shingle_hashes, split_words, word_hashes
from dayglass.operators.ordering import add_range, cut_points
from dayglass.session import chunk_count

#: Bins of a fingerprint, low-order bits stored per bin, and words of a shingle.
BINS, BITS, WIDTH = 512, 4, 5
#: Texts with fewer filled bins than this choose donors from a table of ranks, the others by probing.
FEW = 16


@lru_cache(maxsize=1)
def _donors() -> tuple[np.ndarray, np.ndarray]:
    """For each bin an order in which it looks for a filled bin, and the rank of each bin in that order."""
    grid = np.arange(BINS, dtype=np.uint64)
    order = mix(grid[:, None] * np.uint64(0xA0761D6478BD642F) + grid + np.uint64(1)).argsort(axis=1).astype(np.int16)
    return order, order.argsort(axis=1).astype(np.int16)


def _filled(values: np.ndarray) -> np.ndarray:
    """Empty bins (all ones) take the value of the first filled bin in their own order of bins."""
    order, rank = _donors()
    empty = values == np.uint64(0xFFFFFFFFFFFFFFFF)
    full = BINS - empty.sum(axis=1)
    for i in np.flatnonzero((full > 0) & (full < FEW)):
        here = np.flatnonzero(~empty[i])
        donor = here[rank[:, here].argmin(axis=1)]
        values[i] = np.where(empty[i], values[i, donor], values[i])
    row, column = np.nonzero(empty & (full >= FEW)[:, None])
    source = values.copy()
    step = 0
    while len(row):
        donor = order[column, step]
        found = ~empty[row, donor]
        values[row[found], column[found]] = source[row[found], donor[found]]
        row, column = row[~found], column[~found]
        step += 1
    return values


def packed_fingerprints(column: pa.Array) -> list[bytes]:
    """One packed fingerprint per text, empty for a text without words. Equal sets of shingles give equal ones."""
    out: list[bytes] = []
    shift = np.uint64(64 - (BINS - 1).bit_length())
    for block in blocks(column, most=1024):
        words = split_words(block)
        shingles, first = shingle_hashes(word_hashes(words), words.first, WIDTH)
        texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
        values = np.full((len(first) - 1) * BINS, 0xFFFFFFFFFFFFFFFF, np.uint64)
        np.minimum.at(values, texts * BINS + (shingles >> shift).astype(np.int64), shingles)
        values = _filled(values.reshape(-1, BINS))
        # Mixed with the number of the bin, so that a donated value does not agree or differ in all bins at once.
        low = (mix(values + np.arange(BINS, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) & np.uint64(15)).astype(np.uint8)
        packed = low[:, ::2] | (low[:, 1::2] << 4)
        out += [packed[i].tobytes() if first[i + 1] > first[i] else b"" for i in range(len(packed))]
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity: share of equal bins, less the share that agrees by chance in BITS bits."""
    if not a or not b:
        return float(a == b)
    differ = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    equal = (np.count_nonzero(differ & 15 == 0) + np.count_nonzero(differ >> 4 == 0)) / BINS
    chance = 1 / (1 << BITS)
    return min(1.0, max(0.0, (equal - chance) / (1 - chance)))


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the fingerprint of each whole text as hexadecimal digits.

    NULL and texts without words have an empty fingerprint; a text of fewer than WIDTH words is one shingle. Narrow.
    """
    return with_text_columns(docs, text, f"`{out}` string", lambda: lambda c: [[f.hex() for f in packed_fingerprints(c)]], keep)


def likeness_column(a: Column, b: Column) -> Column:
    """:func:`likeness` of two columns of hexadecimal fingerprints; NULL counts as empty."""
    @F.pandas_udf("double")
    def compare(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(bytes.fromhex(i or ""), bytes.fromhex(j or "")) for i, j in zip(x, y)], dtype=float)

    return compare(a, b)


def pieces_with_next(docs: DataFrame, order: str, text: str) -> DataFrame:
    """Rows (piece, guest, id, text) in which each piece is followed by the first row of the next piece as a guest.

    Pieces are ranges of ``order`` (NULL last); each is sorted by (order, text) inside one partition of the result, and
    the last piece is followed by the first row of all. Only limits of ranges and one smallest id per
    range reach the driver. One shuffle of the texts.
    """
    rows = docs.select(F.col(quoted(order)).cast("long").alias("id"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    parts = 8 * chunk_count(docs.sparkSession)
    cuts = cut_points(rows.select("id"), ["id"], parts)["id"]
    ranged = add_range(rows, "id", cuts, "range").withColumn("piece", F.when(F.col("id").isNull(), len(cuts) + 1).otherwise(F.col("range"))).drop("range")
    first = {r["piece"]: r["first"] for r in ranged.groupBy("piece").agg(F.min("id").alias("first")).collect()}
    known = sorted(first)
    if not known:
        return rows.select(F.lit(0).alias("piece"), F.lit(False).alias("guest"), "id", "text")
    before = {p: known[i - 1] for i, p in enumerate(known)}
    at = F.col("piece") + 1
    starts = F.element_at(F.array(*[F.lit(first.get(p)).cast("long") for p in range(known[-1] + 1)]), at)
    host = F.element_at(F.array(*[F.lit(before.get(p, 0)) for p in range(known[-1] + 1)]), at)
    home = F.struct(F.col("piece").alias("piece"), F.lit(False).alias("guest"))
    away = F.when(F.col("id").eqNullSafe(starts), F.struct(host.alias("piece"), F.lit(True).alias("guest")))
    placed = ranged.withColumn("place", F.explode(F.array_compact(F.array(home, away))))
    dealt = placed.select("place.piece", "place.guest", "id", "text").repartition("piece")
    return dealt.sortWithinPartitions("piece", "guest", F.col("id").asc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many, or all, of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_by_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of how both and the next text are alike.

    Edited: the second half is replaced by the beginning of the next text in the order of ``doc_id`` (NULL ids last,
    equal ids in the order of their texts, the last row followed by the first). One row per row of ``docs``: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    fields = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None  # the last own row, until the one after it comes
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                prints = packed_fingerprints(part.column(3))
                rows = list(zip(*[part.column(i).to_pylist() for i in range(4)], prints))
                rows = rows if kept is None else [kept, *rows]
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
                kept = rows[-1]
                if not pairs:
                    continue
                texts = [edited(a[3], b[3]) for a, b in pairs]
                changed = packed_fingerprints(pa.array(texts, pa.string()))
                columns = [
                    pa.array([a[2] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    pa.array([a[4].hex() for a, _ in pairs], pa.string()),
                    pa.array([c.hex() for c in changed], pa.string()),
                    pa.array([likeness(a[4], c) for (a, _), c in zip(pairs, changed)], pa.float64()),
                    pa.array([likeness(a[4], b[4]) for a, b in pairs], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return pieces_with_next(docs, doc_id, text).mapInArrow(run, fields)

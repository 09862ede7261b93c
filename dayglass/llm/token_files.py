"""Token files: concatenated ids with Elias-Fano coded document boundaries, written and read through Spark.

A data set is a Parquet folder of segments. A row holds one segment: ``piece`` and ``part`` (its place in the order
of documents), ``doc_ids``, ``n_ids``, ``ids`` (little-endian unsigned, 2 bytes each where the vocabulary allows, else
4), and the boundaries of its documents: ``low`` (packed low-order bits), ``high`` (unary coded high-order bits) and
``samples`` (bit positions of every 64th document). Spark's writer commits it on any file system.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayglass.llm.frames import quoted
from dayglass.operators.ordering import add_range, cut_points
from dayglass.session import chunk_count

#: Ids and documents after which a segment is closed; one document is never cut.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 16, 1 << 12
SAMPLE = 64
#: Bytes of a row group, so that a reader's batch of whole segments stays small.
ROW_GROUP = 8 << 20
#: Words that a Python worker keeps in its table, from task to task (a fuller table starts anew, which changes no
#: result), and texts per step.
TABLE_WORDS, STEP = 1_600_000, 64


class EliasFano:
    """A non-decreasing sequence of numbers up to ``top``, in about 2 + log2(top / n) bits each."""

    def __init__(self, n: int, top: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.top = n, top
        self.width = self.low_bits(n, top)
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint64)
        self.samples = np.frombuffer(samples, np.uint32)

    @staticmethod
    def low_bits(n: int, top: int) -> int:
        return max(0, (top // max(n, 1)).bit_length() - 1)

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> EliasFano:
        n, width = len(values), cls.low_bits(len(values), top)
        values = values.astype(np.uint64)
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        marks = np.zeros(-(-(n + (top >> width) + 1) // 64) * 64, np.uint8)
        marks[places] = 1
        high = np.packbits(marks, bitorder="little")
        return cls(n, top, low.tobytes(), high.tobytes(), places[::SAMPLE].astype(np.uint32).tobytes())

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        at = np.asarray(i)[:, None] * self.width + np.arange(self.width)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)

    def select(self, i: int) -> int:
        """Value number ``i`` from 0: the sampled position before it, then whole words by their bit counts."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        word = place >> 6
        bits = int(self.high[word]) & ~((1 << (place & 63)) - 1)
        while (n := bits.bit_count()) <= left:
            left -= n
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        place = (word << 6) + (bits & -bits).bit_length() - 1
        return ((place - i) << self.width) + int(self._low(np.array([i]))[0])

    def values(self) -> np.ndarray:
        """All values, from one pass over the bits."""
        places = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        return ((places - np.arange(self.n)) << self.width) + self._low(np.arange(self.n))


class Segment:
    """One segment in memory; documents by their place without decoding the others."""

    def __init__(self, doc_ids: list[int | None], n_ids: int, id_bytes: int, ids: bytes, low: bytes, high: bytes, samples: bytes):
        self.doc_ids = doc_ids
        self.ends = EliasFano(len(doc_ids), n_ids, low, high, samples)
        self.ids = np.frombuffer(ids, f"<u{id_bytes}")

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(start inside the segment, ids) of every document, by the ends that :meth:`EliasFano.select` returns."""
        a = 0
        for i in range(len(self.doc_ids)):
            b = self.ends.select(i)
            yield a, self.ids[a:b]
            a = b


class WordIds:
    """Ids of texts from a table of distinct words with the blank before them, each tokenized once.

    The byte-level splitter ends a token before a blank that stands between two visible characters, and between a
    letter and a mark such as a comma. So a text may be cut there; other texts are tokenized whole. New words are
    tokenized together: the first id of each is one whose bytes begin with a blank, and no other id is.
    """

    _MARKS = ",.;:!?"

    def __init__(self, path: str, end_id: int | None, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = kind
        self.end = b"" if end_id is None else np.array([end_id], kind).tobytes()
        names = self.tokenizer.get_vocab(True)
        self.opens = np.zeros(max(names.values()) + 1, bool)
        self.opens[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        self.table: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        marks, table, cut, cores = self._MARKS, self.table, [], set()
        for word in words:
            core = word.rstrip(marks) if word[-1] in marks else word
            if core is word or not core or not core[-1].isalpha():
                cores.add(word)
            else:
                cut.append((word, core))
                cores.add(core)
        new = [c for c in cores if c not in table]
        if new:
            ids = self._encoded([" " + " ".join(new)])[0]
            first = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)]
            if len(first) != len(new) + 1:
                raise ValueError("the tokenizer joins words")
            raw, width = ids.tobytes(), ids.itemsize
            for core, a, b in zip(new, first, first[1:]):
                table[core] = raw[a * width : b * width]
        tails = list({word[len(core) :] for word, core in cut})
        tail_ids = {t: i.tobytes() for t, i in zip(tails, self._encoded(tails))}
        for word, core in cut:
            table[word] = table[core] + tail_ids[word[len(core) :]]

    def of(self, texts: list[str]) -> list[bytes]:
        if len(self.table) > TABLE_WORDS:
            self.table = {}
        split = []
        for text in texts:
            head, blank, rest = text.partition(" ")
            cut = blank and head and not head[-1].isspace() and not any(s in text for s in self.special)
            split.append((head, rest.split(" ")) if cut else (text, []))
        new = set().union(*(words for _, words in split)).difference(self.table)
        loose = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
        if loose:
            split = [s if loose.isdisjoint(s[1]) else (t, []) for s, t in zip(split, texts)]
            new = set().union(*(words for _, words in split)).difference(self.table)
        if new:
            self._learn(new)
        heads = self._encoded([head for head, _ in split])
        found = self.table.__getitem__
        return [b"".join([h.tobytes(), *map(found, words), self.end]) for h, (_, words) in zip(heads, split)]


@lru_cache(maxsize=1)
def word_ids(path: str, end_id: int | None, kind: str) -> WordIds:
    """The table of this worker."""
    return WordIds(path, end_id, kind)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int | None = 2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Tokenize whole texts (NULL: empty) and write them at ``path`` in the order of ``doc_id``.

    Every document is followed by ``end_id`` unless that is None. NULL ids come last, equal ids in the order of their
    texts. One shuffle deals the texts into ranges of ids; each range is sorted, tokenized and written as segments.
    Special tokens in a text count as the tokenizer file says. An empty table gives an empty data set.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    top = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(True) - 1, end_id or 0)
    id_bytes = 2 if top < 1 << 16 else 4
    kind = f"<u{id_bytes}"
    rows = docs.select(F.col(quoted(doc_id)).cast("long").alias("id"), F.coalesce(F.col(quoted(text)).cast("string"), F.lit("")).alias("text"))
    cuts = cut_points(rows.select("id"), ["id"], 8 * chunk_count(spark))["id"]
    ranged = add_range(rows, "id", cuts, "piece")
    ranged = ranged.withColumn("piece", F.when(F.col("id").isNull(), len(cuts) + 1).otherwise(F.col("piece")))
    dealt = ranged.repartition("piece").sortWithinPartitions("piece", F.col("id").asc_nulls_last(), "text")
    fields = "piece int, part int, before bigint, doc_ids array<bigint>, n_ids bigint, id_bytes int, ids binary, low binary, high binary, samples binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path, end_id, kind)
        piece, part, before, names, parts, size = None, 0, 0, [], [], 0

        def closed() -> pa.RecordBatch:
            ends = np.cumsum([len(p) // id_bytes for p in parts])
            coded = EliasFano.encode(ends, int(ends[-1]))
            columns = [[piece], [part], [before], [names], [int(ends[-1])], [id_bytes], [b"".join(parts)], [coded.low.tobytes()], [coded.high.tobytes()], [coded.samples.tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in fields.split(", ")])

        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                rows = batch.slice(low, STEP)
                for p, name, ids in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), words.of(rows.column(2).to_pylist())):
                    if names and (p != piece or size >= SEGMENT_IDS or len(names) >= SEGMENT_DOCS):
                        yield closed()
                        part, before = (part + 1, before + size) if p == piece else (0, 0)
                        names, parts, size = [], [], 0
                    piece = p
                    names.append(name)
                    parts.append(ids)
                    size += len(ids) // id_bytes
        if names:
            yield closed()

    dealt.select("piece", "id", "text").mapInArrow(run, fields).write.option("parquet.block.size", ROW_GROUP).parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments at ``path`` with ``start``, the number of ids in all segments before.

    A segment knows the ids before it in its piece; those of earlier pieces come from one total per piece, and only
    these totals (eight per shuffle partition of the writing session) meet in one task and are broadcast.
    """
    segments = spark.read.parquet(path)
    across = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = segments.groupBy("piece").agg(F.sum("n_ids").alias("n"))
    earlier = totals.select("piece", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("earlier"))
    return segments.join(F.broadcast(earlier), "piece").withColumn("start", F.col("before") + F.col("earlier")).drop("before", "earlier")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32.

    ``start`` is the number of ids of all documents before it, ``ids_crc32`` the unsigned crc32 of its ids as
    little-endian unsigned 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                value = [c[row].as_py() for c in batch.columns]
                segment = Segment(*value[1:])
                found = [(value[0] + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for a, ids in segment.documents()]
                columns = [segment.doc_ids, *map(list, zip(*found))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    wanted = read_segments(spark, path).select("start", "doc_ids", "n_ids", "id_bytes", "ids", "low", "high", "samples")
    return wanted.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files at ``path``: doc_id and its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(*[c[row].as_py() for c in batch.columns])
                columns = [pa.array(segment.doc_ids, pa.int64()), pa.array([i.tolist() for _, i in segment.documents()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids"])

    wanted = spark.read.parquet(path).select("doc_ids", "n_ids", "id_bytes", "ids", "low", "high", "samples")
    return wanted.mapInArrow(run, "doc_id bigint, ids array<bigint>")

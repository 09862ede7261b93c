"""SentencePiece ids and decoded texts by a table of distinct marked words."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.llm.frames import quoted, with_text_columns

MARK = "▁"
#: Characters of marked words that a task keeps in its table; a fuller table starts anew, which changes no result.
TABLE_CHARS = 16 << 20

_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class MarkedWords:
    """Ids of marked words (white-space marks and what follows up to the next mark), each segmented once.

    The model writes a blank as a mark, puts one mark before the text, and has no piece with a mark after another
    character. So no piece crosses the start of a marked word, and the ids of a text are those of its marked words
    in order. :meth:`check` verifies these properties of a model.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.check()
        self.alone = self._bytes([self.model.piece_to_id(MARK)])
        self.table: dict[str, bytes] = {}
        self.size = 0

    def check(self) -> None:
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces) or self.model.encode("a  b ", out_type=str)[-1][-1:] != MARK:
            raise ValueError("pieces of this model cross white-space marks, or it changes blanks")

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, np.int32).tobytes()

    def _words(self, text: str) -> list[str]:
        """Marked words without their first mark."""
        if MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ") if text else []
        return [c[1:] for c in _CHUNK.findall(MARK + text.replace(" ", MARK))] if text else []

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if self.size > TABLE_CHARS:
            self.table, self.size = {}, 0
        words = [self._words(t) for t in texts]
        new = list(set().union(*words) - self.table.keys())
        for word, ids in zip(new, self.model.encode([w.replace(MARK, " ") for w in new], num_threads=1)):
            self.table[word] = self._bytes(ids) if word else self.alone
            self.size += len(word) + 8
        found = self.table.__getitem__
        return [np.frombuffer(b"".join(map(found, w)), np.int32) for w in words]

    def decode(self, ids: np.ndarray) -> str:
        return self.model.decode(ids.tolist()) if len(ids) else ""


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int, no begin or end ids) and ``decoded`` (their text by the model).

    Whole texts; NULL counts as empty; an empty text has no ids and decodes to an empty text. Repeated rows are
    encoded each. One narrow pass: every task keeps a bounded table of the marked words it has met. The model
    file must be at ``model_path`` on every executor.
    """

    def start() -> Callable[[pa.Array], list]:
        table = MarkedWords(model_path)

        def work(column: pa.Array) -> list:
            texts = [t or "" for t in column.to_pylist()]
            ids: list[np.ndarray] = []
            decoded: list[str] = []
            for low in range(0, len(texts), 256):
                part = table.ids(texts[low : low + 256])
                ids += part
                decoded += map(table.decode, part)
            offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded]

        return work

    return with_text_columns(docs, text, "ids array<int>, decoded string", start, keep)


def decode_pieces(docs: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text that the model makes of an array of ids (NULL: empty)."""
    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        return column.map(lambda x: "" if x is None or not len(x) else model.decode([int(i) for i in x]))

    return docs.withColumn(out, decoded(F.col(quoted(ids))))


def piece_digest(encoded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return encoded.select(
        F.col(quoted(doc_id)).alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )

import os

import pytest
import public_tokenizers
from odd_rows import ODD

from dayglass.llm.pieces import decode_pieces, encode_pieces, piece_digest

sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "   ", "a", " a", "a ", "  a   b  ", "▁", "a▁b", "▁▁ x ▁", "\t\n x\r\n", "x\x00y", "Ünï çödé 漢字 🙂", "a b　c", "<s> </s> <unk> <0x41>", "word " * 3000, "x" * 20000, "12345 3.14"]


def test_ids_and_text_are_the_library_s(spark, frame):
    assert os.path.isfile(PATH)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [*enumerate(TEXTS), *ODD]
    made = encode_pieces(frame(rows), PATH)
    assert made.columns.count("ids") == 1
    got = sorted(str((r.doc_id, list(r.ids), r.decoded)) for r in made.collect())
    want = []
    for name, text in rows:
        ids = model.encode(text or "", num_threads=1)
        want.append(str((name, ids, model.decode(ids) if ids else "")))
    assert got == sorted(want)
    again = decode_pieces(made, PATH, out="text").select("decoded", "text").collect()
    assert all(r.decoded == r.text for r in again)
    assert piece_digest(made).count() == len(rows)


def test_empty_table(spark, frame):
    assert piece_digest(encode_pieces(frame([]), PATH)).count() == 0

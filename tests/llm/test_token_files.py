import zlib

import numpy as np
import pytest
import public_tokenizers
from odd_rows import ODD

from dayglass.llm import token_files as tf
from dayglass.session import scratch_path

tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["one two", " two  spaces ", "tab\tand\nline", "a, b. c! it's don't", "<|endoftext|> x <|endoftext|>", "Ünï, 漢字; 🙂.", "x" * 5000, "a \n b", "12, 3.5: ok", "a  b", "...", "é, f"]


@pytest.mark.parametrize(("n", "top"), [(1, 0), (1, 9), (100, 100), (1000, 1), (3000, 10**6), (3, 2**31)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    made = tf.EliasFano.encode(values, top)
    coded = tf.EliasFano(n, top, made.low.tobytes(), made.high.tobytes(), made.samples.tobytes())
    assert coded.values().tolist() == values.tolist()
    assert [coded.select(i) for i in range(n)] == values.tolist()
    if n >= 100:
        assert 8 * (len(made.low) + 8 * len(made.high) + 4 * len(made.samples)) / n < 4 + np.log2(max(2, top / n))


@pytest.mark.parametrize("ids", [1 << 16, 8])
def test_round_trip(spark, frame, monkeypatch, ids):
    monkeypatch.setattr(tf, "SEGMENT_IDS", ids)
    rows = [*((i * 7 % 13 + 20, t) for i, t in enumerate(TEXTS)), *ODD]
    path = scratch_path(spark, "tokens")
    tf.write_token_files(frame(rows), path, PATH)
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    start, want = 0, []
    for name, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        own = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((name, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), own))
        start += len(own)
    got = tf.read_documents(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in got] == [w[:4] for w in want]
    assert sorted(str((r.doc_id, r.ids)) for r in tf.read_ids(spark, path).collect()) == sorted(str((w[0], w[4])) for w in want)
    one = spark.read.parquet(path).orderBy("piece", "part").first()
    segment = tf.Segment(one.doc_ids, one.n_ids, one.id_bytes, bytes(one.ids), bytes(one.low), bytes(one.high), bytes(one.samples))
    assert [segment.document(i).tolist() for i in range(len(one.doc_ids))] == [d.tolist() for _, d in segment.documents()]


def test_empty_table(spark, frame):
    path = scratch_path(spark, "tokens")
    tf.write_token_files(frame([]), path, PATH)
    assert tf.read_documents(spark, path).count() == 0

import hashlib
import re

import pyarrow as pa
import pytest

from dayglass.llm import fingerprints as fp
from odd_rows import ODD


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("size", [1, 3, 40, 700, 5000])
def test_likeness_is_near_jaccard(size):
    a = " ".join(f"w{i}" for i in range(size))
    for cut in (0.0, 0.3, 0.8):
        keep = int(size * (1 - cut))
        b = " ".join([f"w{i}" for i in range(keep)] + [f"v{i}" for i in range(size - keep)])
        x, y = fp.packed_fingerprints(pa.array([a, b]))
        s, t = shingles(a), shingles(b)
        assert fp.likeness(x, y) == pytest.approx(len(s & t) / len(s | t), abs=0.12)
        assert (x == y) == (s == t)


def test_texts_without_words_and_equal_sets():
    prints = fp.packed_fingerprints(pa.array([None, "", " \n", "A b", "a  B", "c"]))
    assert prints[0] == prints[1] == prints[2] == b""
    assert prints[3] == prints[4] != prints[5]
    assert fp.likeness(b"", b"") == 1 and fp.likeness(b"", prints[3]) == 0


def test_edited_by_next(spark, frame):
    rows = [(10, "abcdef gh"), (3, "Ä b c d e f g"), (7, None), (40, "z"), (12, "one two three four five six")]
    ordered = sorted(rows)
    got = {r.doc_id: r for r in fp.edited_by_next(frame(rows)).collect()}
    for (i, t), (_, following) in zip(ordered, [*ordered[1:], ordered[0]]):
        t, following = t or "", following or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (got[i].fingerprint == "") == (not t)
        x, y = (bytes.fromhex(f) for f in (got[i].fingerprint, got[i].edited_fingerprint))
        assert got[i].near_edited == fp.likeness(x, y)


def test_odd_rows(spark, frame):
    assert fp.edited_by_next(frame([])).count() == 0
    rows = fp.edited_by_next(frame(ODD)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ODD)
    assert len({r.fingerprint for r in rows if r.n_chars == 11}) == 1
    one = fp.edited_by_next(frame([(5, "a b c d")])).first()
    assert one.near_next == 1.0
    out = fp.with_fingerprints(frame(ODD), out="run")
    assert out.columns.count("run") == 1 and out.count() == len(ODD)
    alike = out.select(fp.likeness_column(out.run, out.run).alias("x")).collect()
    assert all(r.x == 1.0 for r in alike)

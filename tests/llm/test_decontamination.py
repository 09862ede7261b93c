import hashlib
import random
import re

import pytest
from odd_rows import ODD

from dayglass.llm import decontamination as dc


def words_of(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def judged(rows, items):
    out = []
    for name, text in rows:
        w, hit, found = words_of(text), set(), set()
        for item, passage in items:
            p = words_of(passage)
            if item is None or passage is None or not p:
                continue
            n = min(10, len(p))
            windows = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append(str((name, len(w), len(hit), len(found), digest, bool(hit))))
    return sorted(out)


def case():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "ß9"]
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, draw(30)), (2, draw(12)), (10, draw(10)), (3, "w1 W2, w3"), (4, "É"), (5, ""), (6, None), (None, draw(11)), (2, draw(14)), (7, "..."), (8, draw(10))]
    rows = [(i, draw(rng.randint(0, 40))) for i in range(40)]
    for i, (_, passage) in enumerate(items):
        rows.append((100 + i, f"{draw(300)}, {passage or ''}! {draw(600)}"))
    return [*rows, *ODD], items


@pytest.mark.parametrize("most", [16 << 20, 60])
def test_against_direct_search(spark, frame, monkeypatch, most):
    rows, items = case()
    monkeypatch.setattr(dc, "PASS_BYTES", most)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = dc.find_passages(frame(rows), table)
    assert set(frame([]).columns) <= set(found.columns)
    assert sorted(str(tuple(r)) for r in dc.passage_digest(found).collect()) == judged(rows, items)


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.find_passages(frame([]), none).count() == 0
    assert not any(r.hits for r in dc.find_passages(frame(ODD), none, keep=["doc_id"]).collect())


def test_words_across_lanes(spark, frame):
    passage = [f"p{i}" for i in range(10)]
    rows = [(n, " ".join([f"x{i}" for i in range(n)] + passage + ["end"])) for n in range(dc.LANE - 12, dc.LANE + 3)]
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id bigint, text string")
    for r in dc.find_passages(frame(rows), items).collect():
        assert [tuple(h) for h in r.hits] == [(r.doc_id, r.doc_id + 9)] and r["items"] == [1]

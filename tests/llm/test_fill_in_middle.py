import hashlib
import re

import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from dayglass.llm.fill_in_middle import fill_digest, fill_in_middle, restored_text

TEXTS = ["\n", "\n\n\n", "a", "a\nb", "a\r\nb c\n", "é\n🙂z\n\n\nend", "<P>", "x <M> y\n", "a<S\n>b<\nM>\n<", "$1\\2\n{3}\n(4)", "l\n" * 5000, "x" * 1_200_000, "y\n" * 600_000]


def cut(doc_id, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return n, form, len(p), len(m), out


@pytest.mark.parametrize("percent, spm", [(100, 50), (40, 50), (100, 0), (100, 100), (0, 50)])
def test_against_cutting_by_hand(frame, percent, spm):
    rows = [*ODD, *((10 * i + k, t) for i, t in enumerate(TEXTS, 1) for k in range(1 if len(t) > 10_000 else 4))]
    docs = frame(rows)
    made = fill_in_middle(docs, percent=percent, spm_percent=spm)
    assert made.columns == ["doc_id", "text", "score", "ids", "run", "n", "form", "output", "prefix_chars", "middle_chars"]
    got = sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in made.collect())
    assert got == sorted(repr((i, *cut(i, t, percent, spm))) for i, t in rows)
    assert made.where(restored_text() != F.coalesce("text", F.lit(""))).count() == 0


def test_digest_and_other_units(frame):
    rows = [(i, f"one two  three {i} ") for i in range(30)]
    assert fill_digest(frame(rows)).where("length(output_sha256) = 64").count() == 30
    words = fill_in_middle(frame(rows), unit=r" *[^ ]+| +", marks=("$a", "\\b", "[c]"))
    again = words.withColumn("again", restored_text(marks=("$a", "\\b", "[c]")))
    assert again.where("again = text and form <> 'plain' and n = 5").count() == 30


def test_no_rows_and_bad_marks(frame):
    assert fill_digest(frame([])).count() == 0
    for marks in [("a", "a", "b"), ("", "a", "b"), ("aba", "x", "y"), ("ab", "bc", "d")]:
        with pytest.raises(ValueError):
            fill_in_middle(frame([]), marks=marks)


def test_no_python_in_the_plan(frame):
    plan = fill_digest(frame([(1, "a\nb")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

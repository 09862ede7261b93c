import math
import re
from collections import Counter

import numpy as np
import pytest
from odd_rows import ODD
from pyspark.sql import functions as F

from dayglass.llm import language_model as lm


def tokens(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


ROWS = [(i, " ".join(f"w{(i * j * j + j) % 37}" for j in range(i % 23))) for i in range(80)] + [(100, "Once rare rare"), (100, "Once rare rare"), (101, "never seen before w1")]


@pytest.mark.parametrize("frequent", [4096, 5])
def test_counts_and_base_score(spark, frame, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = [*ROWS, *ODD]
    seen = Counter(t for i, text in rows if i is not None and i != 101 for t in tokens(text))
    n, v = sum(seen.values()), len(seen)
    got = lm.score_texts(frame(rows), F.coalesce(F.col("doc_id"), F.lit(101)) != 101).collect()
    want = []
    for i, text in rows:
        t = tokens(text)
        want.append((str(i), len(t), sum(seen[x] > 0 for x in t), n, sum(math.log10((seen[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)))
    found = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])
    assert all(r.score <= 0 for r in got)


def test_probabilities_are_normalised_and_learned():
    rng = np.random.default_rng(2)
    words = np.sort(rng.integers(1, 2**63, 6, dtype=np.uint64))
    counts = lm.Counts(6000, 6, words, np.full(6, 1000), np.arange(6))
    text = np.tile(words, 500)
    trainer = lm.Trainer(lm.first_parameters(counts), lm.class_shares(counts), 1, 0.3)
    for _ in range(30):
        trainer.text_block(counts, text, np.array([0, len(text)]))
    classes = np.arange(6)
    context = np.tile([2, 1, 0, 5], (lm.CLASSES, 1))
    every = lm.class_log_probabilities(trainer.p, np.arange(lm.CLASSES), context)
    assert np.exp(every).sum() == pytest.approx(1)
    assert every[classes].argmax() == 3 and np.exp(every[3]) > 0.5


def test_sums_over_classes_are_made_once_per_context():
    rng = np.random.default_rng(4)
    p = lm.Parameters.of(rng.normal(0, 1, (2 * lm.CLASSES + 1 + lm.CONTEXT) * lm.SIZE + lm.CLASSES))
    context = rng.integers(0, lm.CLASSES + 1, (7, lm.CONTEXT))[rng.integers(0, 7, 500)]
    classes = rng.integers(0, lm.CLASSES, 500)
    sums, number = lm.log_sums(p, context, 3)
    assert len(sums) == len({tuple(c) for c in context.tolist()}) and len(number) == 500
    hidden = sum(p.context[context[:, k]].astype(float) * p.place[k] for k in range(lm.CONTEXT))
    logits = hidden @ p.target.T.astype(float) + p.bias
    want = logits[np.arange(500), classes] - np.log(np.exp(logits - logits.max(axis=1)[:, None]).sum(axis=1)) - logits.max(axis=1)
    assert np.allclose(lm.class_log_probabilities(p, classes, context), want, atol=1e-3)


def test_without_training_rows(spark, frame):
    rows = lm.score_texts(frame(ODD), F.lit(False)).collect()
    assert len(rows) == len(ODD) and all(r.base_score == 0 and r.score == 0 and r.n_known == 0 for r in rows)
    assert lm.score_texts(frame([]), F.lit(True)).count() == 0


def _many_words(n=3000, frequent=400):
    rng = np.random.default_rng(6)
    words = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
    every = np.sort(rng.integers(1, 40, len(words)))[::-1]
    word = words[:frequent][order := np.argsort(words[:frequent])]
    known = lm.Counts(int(every.sum()), len(words), word, every[:frequent][order], np.arange(frequent)[order])
    return words, every, known


def test_every_word_is_learned_and_all_sum_to_one(spark):
    words, every, known = _many_words()
    table = spark.createDataFrame([(int(w), int(c)) for w, c in zip(words.view(np.int64), every)], "word long, c long")
    slots = lm.word_slots(table, known)
    assert slots.side == 55 and slots.own == 400 - (lm.CLASSES - 1)
    rng = np.random.default_rng(7)
    p = lm.Parameters.of(rng.normal(0, 0.5, (2 * lm.CLASSES + 1 + lm.CONTEXT) * lm.SIZE + lm.CLASSES))
    learned = lm.Words(*[rng.normal(0, 0.5, x.shape).astype(np.float32) for x in lm.first_words(slots)])
    place = lm._look_up(known, words)
    classes, slot = lm._classes(known, place), lm._slots(known, slots, words, place)
    assert ((slot < 0) == (classes < lm.CLASSES - 1)).all() and (slot < 0).sum() == lm.CLASSES - 1
    # No two words with slots of their own share one, and the others fill the rest.
    single = (slot >= 0) & (slot < slots.own)
    assert len(set(slot[single].tolist())) == single.sum() == slots.own and len(set(slot.tolist())) > 1500
    context = np.tile(lm._units(classes, slot)[[700, 5, 2900, 260]], (len(words), 1))
    wide = lm._with_words(p, learned)
    logs = lm.class_log_probabilities(wide, classes, context)
    rest = np.flatnonzero(slot >= 0)
    logs[rest] += lm.slot_log_probabilities(wide, learned, context[rest], slot[rest], 64)
    hashed = slot >= slots.own
    logs[hashed] += np.log((every + 0.1)[hashed] / slots.totals[slot[hashed]])
    # What is left is for the unseen words of each slot.
    empty = np.arange(slots.own, slots.side**2)
    unseen = lm.class_log_probabilities(wide, np.full(len(empty), lm.CLASSES - 1), context[: len(empty)])
    unseen += lm.slot_log_probabilities(wide, learned, context[: len(empty)], empty) + np.log(0.1 / slots.totals[empty])
    assert np.exp(logs).sum() + np.exp(unseen).sum() == pytest.approx(1, abs=1e-4)


def test_rare_words_are_learned_from_rare_words(spark):
    words, every, known = _many_words()
    table = spark.createDataFrame([(int(w), int(c)) for w, c in zip(words.view(np.int64), every)], "word long, c long")
    slots = lm.word_slots(table, known)
    a, b, c, d = words[[1000, 2000, 1500, 2500]]
    text = np.tile(np.array([a, b, lm.END, c, d, lm.END], np.uint64), 40)
    first = np.arange(0, len(text) + 1, 3)
    trainer = lm.Trainer(lm.first_parameters(known), lm.class_shares(known), 1, 0.3, lm.first_words(slots), slots)
    for _ in range(150):
        trainer.text_block(known, text, first)
    p, learned = trainer.learned()
    wide, place = lm._with_words(p, learned), lm._look_up(known, text[:6])
    slot = lm._slots(known, slots, text[:6], place)
    context = lm._contexts(lm._units(lm._classes(known, place), slot), first[:3])
    after_a = [lm.slot_log_probabilities(wide, learned, context[1:2], slot[[k]])[0] for k in (1, 4)]
    after_c = [lm.slot_log_probabilities(wide, learned, context[4:5], slot[[k]])[0] for k in (1, 4)]
    assert after_a[0] > after_a[1] + 1 and after_c[1] > after_c[0] + 1

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import ODD

from dayglass.llm import quality, toxicity


def test_marginals_are_those_of_all_label_sequences():
    rng = np.random.default_rng(4)
    logits, steps, opening = rng.normal(0, 2, 6), np.exp(rng.normal(0, 1, (2, 2))), 0.4
    total = np.zeros((6, 2))
    for labels in itertools.product((0, 1), repeat=6):
        weight = (opening if labels[0] else 1.0) * np.exp(sum(e for e, y in zip(logits, labels) if y))
        weight *= np.prod([steps[a, b] for a, b in zip(labels, labels[1:])])
        total[np.arange(6), labels] += weight
    _, _, marginal = toxicity.forward_backward(logits, np.array([0, 6]), steps, opening)
    assert marginal == pytest.approx(np.log(total[:, 1] / total[:, 0]))


def test_long_sequences_in_lanes():
    rng = np.random.default_rng(5)
    first = np.array([0, 3, 3, 400, 465])
    logits, steps = rng.normal(0, 1, 465), np.array([[1.0, 0.2], [0.7, 1.1]])
    _, _, together = toxicity.forward_backward(logits, first, steps, 0.5)
    alone = [toxicity.forward_backward(logits[a:b], np.array([0, b - a]), steps, 0.5)[2] for a, b in zip(first, first[1:])]
    assert together == pytest.approx(np.concatenate(alone))


def corpus(n=400):
    """Texts of random words; every fourth is toxic by one of the marks, every third poor by repetition."""
    rng = random.Random(8)
    rows = []
    for i in range(n):
        w = ["".join(rng.choices("aeioustnr", k=rng.randint(2, 6))) for _ in range(rng.randint(5, 60))]
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        if not good:
            w = [x for x in w for _ in range(6)]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["Vilewort", "grumbleé"]) + rng.choice(["", "s", "ing"])
        rows.append((i, " ".join(w), toxic, good))
    return rows


def test_held_out_accuracy_and_spans(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "other") for i, t, _, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y, q) for i, _, y, q in rows], "doc_id bigint, toxic int, quality int")
    learn = "doc_id % 5 != 0"
    model = toxicity.fit_toxicity(docs, labels, labels.doc_id % 5 != 0)
    scored = toxicity.score_toxicity(docs, model)
    assert scored.columns == ["doc_id", "text", "score", "spans"]
    wrong = 0
    for r in scored.where(f"not ({learn})").collect():
        toxic = rows[r.doc_id][2]
        wrong += (r.score >= 0.5) != bool(toxic)
        marked = [rows[r.doc_id][1][s.start : s.end].lower() for s in r.spans]
        assert not toxic or any(m.startswith(("vilewort", "grumble")) for m in marked)
    assert wrong <= 2
    good = quality.score_quality(docs, quality.fit_quality(docs, labels, labels.doc_id % 5 != 0)).where(f"not ({learn})").collect()
    assert sum((r.score >= 0.5) != bool(rows[r.doc_id][3]) for r in good) <= 4


@pytest.mark.parametrize("clean, toxic, insults", [(60, 10, 8), (60, 60, 30)])
def test_rare_toxic_words_are_learned(clean, toxic, insults):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(4, 7)))
    bad, common = [word("bcdfgklm") for _ in range(insults)], [word("aeioustnr") for _ in range(300)]

    def texts(n, is_toxic):
        out = []
        for _ in range(n):
            w = [rng.choice(common) if rng.random() < 0.8 else word("aeioustnr") for _ in range(40)]
            for b in rng.sample(bad, 3) if is_toxic else []:
                w.insert(rng.randrange(len(w)), b)
            out.append(" ".join(w))
        return out

    model = toxicity.fit([*texts(clean, False), *texts(toxic, True)], [0] * clean + [1] * toxic)
    for label in (0, 1):
        found = []
        for block in toxicity.blocks(pa.array(texts(40, label))):
            words = toxicity.split_words(block, toxicity.ALPHANUMERIC)
            found += (toxicity.document_signals(toxicity._infer(words, model), words.first) @ model.score >= 0).tolist()
        assert np.mean(found) >= 0.9 if label else np.mean(found) <= 0.1


def test_fitting_holds_the_words_of_one_block(monkeypatch):
    rng = np.random.default_rng(3)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefghij"), (3000, 5))])
    texts = [" ".join(rng.choice(words, 1500)) for _ in range(900)]
    kept = (np.zeros(toxicity.BUCKETS), np.array([[1.0, 0.5], [0.5, 1.0]]), 1.0)
    monkeypatch.setattr(toxicity, "_fit_weights", lambda x, y, first, rng: kept)
    tracemalloc.start()
    try:
        toxicity.fit(texts, [int(i % 2 == 0) for i in range(len(texts))])
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held < 22 * sum(map(len, texts))


def test_no_toxic_text_gives_a_warning():
    with pytest.warns(UserWarning, match="no toxic text"):
        toxicity.fit(["a b c", "d e f"], [0, 0])


def test_quality_learns_from_all_features_of_a_text():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(400)) for _ in range(2)]
    start = np.random.default_rng(11).uniform(-1 / quality.SIZE, 1 / quality.SIZE, (quality.BUCKETS, quality.SIZE)).astype(np.float32)
    model = quality.fit(texts, [0, 1], epochs=1)
    (block,) = quality.blocks(pa.array(texts))
    used = np.unique(quality.features(block)[0])
    assert len(used) > 3000 and (model.vectors[used] != start[used]).any(axis=1).all()


def test_odd_rows_and_no_labels(spark, frame):
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    one_class = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (5, None, None), (None, 1, 0)], "doc_id bigint, toxic int, quality int")
    for labels in (none, one_class):
        for docs in (frame(ODD), frame([])):
            a = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
            b = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
            assert len(a) == len(b) == docs.count()
            assert all(0 <= r.score <= 1 for r in [*a, *b])
            assert all(r.score < 0.5 and not r.spans for r in a)
            assert len({r.score for r in a if r.text == "a b c d e f"}) <= 1

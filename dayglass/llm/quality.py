"""Quality scores by supervised subword embeddings: averaged hashed word and n-gram vectors and a softmax."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.frames import give_back, with_text_columns
from dayglass.llm.samples import labelled_sample
from dayglass.llm.textkit import Block, Rolling, blocks, split_words

#: Labelled texts of each class that are used for fitting.
PER_CLASS = 2000
#: Buckets of hashed features, numbers of a vector, and lengths of character n-grams.
BUCKETS, SIZE, NGRAMS = 1 << 17, 8, (2, 3, 4)


class Model(NamedTuple):
    vectors: np.ndarray  # bucket x SIZE
    output: np.ndarray  # class x SIZE
    bias: np.ndarray  # per class
    empty: float  # score of a text without features


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of the texts of a block in order of kinds, and the text of each.

    Words as they are written, pairs of neighbouring words (a word that is said again and again makes one pair), and
    character n-grams of the words with the blank before and after.
    """
    words = split_words(block, lower=False)
    if not len(words.begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolling = Rolling(words.data)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    own = rolling.of(words.begin, words.end, 1)
    found, owner = [own], [text]
    after = np.flatnonzero(text[1:] == text[:-1])
    same = own[after] == own[after + 1]
    found.append(np.where(same, np.uint64(1), own[after] * np.uint64(3) + own[after + 1] * np.uint64(5)))
    owner.append(text[after])
    starts = np.flatnonzero((words.data & 0xC0) != 0x80)
    ends = np.append(starts[1:], len(words.data))
    inside = np.zeros(len(words.data) + 1, np.int64)
    np.add.at(inside, words.begin, np.arange(1, len(words.begin) + 1) - np.arange(0, len(words.begin)))
    word = np.cumsum(inside)[:-1][starts] - 1
    here = (word >= 0) & (starts < words.end[np.maximum(word, 0)])
    starts, ends, word = starts[here], ends[here], word[here]
    first = np.concatenate(([True], word[1:] != word[:-1]))
    last = np.concatenate((word[1:] != word[:-1], [True]))
    for n in NGRAMS:
        if len(starts) < n:
            continue
        k = np.flatnonzero(word[n - 1 :] == word[: len(word) - n + 1])
        edge = first[k].astype(np.uint64) + np.uint64(2) * last[k + n - 1].astype(np.uint64)
        found.append(rolling.of(starts[k], ends[k + n - 1], 10 + n) + edge * np.uint64(0x9FB21C651E98DF25))
        owner.append(text[word[k]])
    return (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owner)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(texts: list[str], labels: list[int], epochs: int = 12, rate: float = 0.5, seed: int = 11) -> Model:
    """Stochastic gradient descent over texts; the rate falls linearly. A step sees all features of a text, as scoring does."""
    rng = np.random.default_rng(seed)
    rows = []
    for block in blocks(pa.array(texts, pa.string())):
        bucket, owner = features(block)
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(block.high - block.low + 1))
        for i in range(block.high - block.low):
            at, count = np.unique(bucket[order[bounds[i] : bounds[i + 1]]], return_counts=True)
            rows.append((at.astype(np.int32), (count / max(1, count.sum())).astype(np.float32), labels[block.low + i]))
    share = sum(labels) / max(1, len(labels))
    vectors = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    output, bias = rng.normal(0, 0.5, (2, SIZE)).astype(np.float32), np.zeros(2, np.float32)
    if not 0 < share < 1:
        return Model(vectors * 0, output * 0, np.array([-10.0, 10.0]) * (share - 0.5), share)
    steps, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)).tolist():
            at, weight, label = rows[r]
            now = rate * (1 - steps / total)
            steps += 1
            if not len(at):
                continue
            own = vectors[at]
            hidden = weight @ own
            error = -_softmax(output @ hidden + bias)
            error[label] += 1
            back = error @ output
            output += now * np.outer(error, hidden)
            bias += now * 0.1 * error
            # The average passes its gradient on to each vector by its weight; scaled up as texts have many features.
            vectors[at] += (now * 50) * weight[:, None] * back
    known = [label for at, _, label in rows if not len(at)]
    return Model(vectors, output, bias, float(np.mean(known)) if known else float(_softmax(bias)[1]))


def score_quality(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the probability of label 1 of each whole text; one narrow pass.

    NULL and texts without words get one score, the share of label 1 among such texts of the sample (or by the bias).
    """
    lean = (model.vectors @ (model.output[1] - model.output[0])).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((lean, float(model.bias[1] - model.bias[0]), model.empty))

    def work(column: pa.Array) -> list:
        lean, bias, empty = shared.value
        scores = []
        for block in blocks(column):
            bucket, owner = features(block)
            n = np.bincount(owner, minlength=block.high - block.low)
            sums = np.bincount(owner, lean[bucket], block.high - block.low)
            logit = np.clip(sums / np.maximum(n, 1) + bias, -40, 40)
            scores.append(np.where(n > 0, 1 / (1 + np.exp(-logit)), empty))
        return [np.concatenate(scores) if scores else []]

    return with_text_columns(docs, text, f"`{out}` double", lambda: work, keep)


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality", per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``per_class`` labelled texts of each class, drawn by a hash of their ids from rows with ``learn``.

    The log-odds are then moved from the shares of the sample to those of all labels.
    """
    texts, good, shift = labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, per_class, doc_id, text)
    give_back()
    model = fit(texts, good)
    give_back()
    return model._replace(bias=model.bias + np.array([0, shift]))

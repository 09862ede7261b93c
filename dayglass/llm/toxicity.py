"""Toxic spans and scores by a linear-chain conditional random field over words."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.frames import give_back, with_text_columns
from dayglass.llm.samples import labelled_sample
from dayglass.llm.textkit import ALPHANUMERIC, BLOCK_BYTES, Rolling, Words, blocks, mix, split_words

#: Labelled texts of each class that are used for fitting, and windows taken from each of them.
PER_CLASS, WINDOWS = 2000, 4
#: Buckets of hashed features, and words on each side of a window's middle.
BUCKETS, REACH = 1 << 17, 12
#: Rounds in which marks share out the toxic texts; clean texts that each mark counts for besides its own in the first
#: round, none in the last; and the share of toxic texts that no word need explain (wrong labels).
ROUNDS, DOUBT, LEAK = 40, 1.0, 0.1
#: Slices of the pairs of a mark and the word before it that are sorted one by one; a power of two.
SLICES = 8
#: Words that are looked at side by side in the recursions.
LANE = 64


class Model(NamedTuple):
    weights: np.ndarray  # log-odds of a toxic token per feature bucket
    steps: np.ndarray  # factors of going from label i to label j
    opening: float  # odds of a toxic first token before its features
    score: np.ndarray  # intercept and weights of the document score


def affixes(words: Words, rolling: Rolling) -> list[np.ndarray]:
    """Hashes of each whole word and of its first 3, 4 and 5 and last 3 characters."""
    starts = np.flatnonzero((words.data & 0xC0) != 0x80)
    starts = np.append(starts, len(words.data))
    head = np.searchsorted(starts, words.begin)
    tail = np.searchsorted(starts, words.end)
    found = [rolling.of(words.begin, words.end, 1)]
    for n in (3, 4, 5):
        found.append(rolling.of(words.begin, starts[np.minimum(head + n, tail)], 1 + n))
    found.append(rolling.of(starts[np.maximum(tail - 3, head)], words.end, 9))
    return found


def features(words: Words) -> np.ndarray:
    """Feature buckets (word x feature): the word, its affixes, and the words before and after it in the text."""
    own = affixes(words, Rolling(words.data)) if len(words.begin) else [np.zeros(0, np.uint64)] * 5
    first = np.zeros(len(words.begin) + 1, bool)
    first[words.first] = True
    before = np.roll(own[0], 1) * np.uint64(3) + np.uint64(17)
    after = np.roll(own[0], -1) * np.uint64(5) + np.uint64(29)
    before[first[:-1]] = 7
    after[first[1:]] = 11
    return (np.stack([*own, before, after], axis=1) % np.uint64(BUCKETS)).astype(np.uint32)


def _ratios(emission: np.ndarray, first: np.ndarray, steps: np.ndarray, opening: float) -> np.ndarray:
    """Odds of label 1 given the tokens up to each token, for sequences that begin at ``first``.

    The first token has e * opening; every other maps the odds r to e * (s01 + s11 r) / (s00 + s10 r). Sequences are cut into lanes; the maps of a lane
    are multiplied up, which gives the odds at which each lane starts, and then all lanes run side by side.
    """
    counts = np.diff(first)
    lanes = -(-counts // LANE)
    text = np.repeat(np.arange(len(counts)), lanes)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = first[:-1][text] + rank * LANE
    size = np.minimum(LANE, first[1:][text] - start)
    maps = np.tile(np.eye(2), (len(text), 1, 1))
    for i in range(LANE):
        live = np.flatnonzero(size > i)
        if not len(live):
            break
        e, m = emission[start[live] + i], maps[live]
        top = e[:, None] * (steps[1, 1] * m[:, 0] + steps[0, 1] * m[:, 1])
        low = steps[1, 0] * m[:, 0] + steps[0, 0] * m[:, 1]
        if not i:
            opens = rank[live] == 0
            top[opens], low[opens] = np.stack([np.zeros(opens.sum()), e[opens] * opening], axis=1), (0.0, 1.0)
        maps[live] = np.stack([top, low], axis=1) / np.maximum(top, low).max(axis=1)[:, None, None]
    entry = np.empty(len(text))
    now = np.ones(len(counts))
    order = np.argsort(rank, kind="stable")
    bounds = np.searchsorted(rank[order], np.arange(rank.max() + 2)) if len(rank) else [0]
    for i in range(len(bounds) - 1):
        here = order[bounds[i] : bounds[i + 1]]
        r = now[text[here]]
        entry[here] = r
        m = maps[here]
        now[text[here]] = (m[:, 0, 0] * r + m[:, 0, 1]) / (m[:, 1, 0] * r + m[:, 1, 1])
    out = np.empty(len(emission))
    r = entry
    for i in range(LANE):
        live = np.flatnonzero(size > i)
        if not len(live):
            break
        r = r.copy()
        r[live] = emission[start[live] + i] * (steps[0, 1] + steps[1, 1] * r[live]) / (steps[0, 0] + steps[1, 0] * r[live])
        if not i:
            r[rank == 0] = emission[start[rank == 0]] * opening
        out[start[live] + i] = r[live]
    return out


def forward_backward(logits: np.ndarray, first: np.ndarray, steps: np.ndarray, opening: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward odds, backward odds with the token's own emission, and log-odds of the marginals."""
    emission = np.exp(np.clip(logits, -30, 30))
    ahead = _ratios(emission, first, steps, opening)
    last = len(logits) - first[::-1]
    back = _ratios(emission[::-1], last, steps.T, 1.0)[::-1]
    tiny = 1e-300
    return ahead, back, np.log(np.maximum(ahead, tiny)) + np.log(np.maximum(back, tiny)) - np.clip(logits, -30, 30)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _marks(words: Words) -> np.ndarray:
    """Hashes of each word and of its first 4 and 5 characters."""
    own = affixes(words, Rolling(words.data)) if len(words.begin) else [np.zeros(0, np.uint64)] * 5
    return np.stack([own[0], own[2], own[3]], axis=1)


def _each_once(hashes: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash and unit mixed, hash) of all different pairs."""
    mixed, at = np.unique(mix(hashes + unit * np.uint64(0x9FB21C651E98DF25)), return_index=True)
    return mixed, hashes[at]


def _positions(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each hash stands in the sorted ``marks``; -1 where it does not."""
    if not len(marks):
        return np.full(len(hashes), -1, np.int32)
    at = np.minimum(np.searchsorted(marks, hashes), len(marks) - 1)
    return np.where(marks[at] == hashes, at, -1).astype(np.int32)


def _distinct_times(mixed: list[np.ndarray], mark: list[np.ndarray], count: int) -> np.ndarray:
    """How many different values ``mixed`` each mark has, in slices of the values."""
    total = np.zeros(count, np.int64)
    for part in range(SLICES):
        rows = [np.flatnonzero(m & np.uint64(SLICES - 1) == part) for m in mixed]
        _, at = np.unique(np.concatenate([m[r] for m, r in zip(mixed, rows)]), return_index=True)
        total += np.bincount(np.concatenate([m[r] for m, r in zip(mark, rows)])[at], minlength=count)
    return total


def label_tokens(parts: Iterable[Words], toxic: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Probabilities of toxic tokens from document labels, by expectation maximisation; 0 in texts that are not toxic.

    A text is toxic if one of its tokens is, and a token if one of its marks (the word, its stems of 4 and 5 characters) is:
    a noisy or. In each round the toxic texts are shared out over their marks, which gives the marks' shares for the next
    one. So no number of texts is asked for: a rare word counts where no other word explains a text. In toxic texts
    a mark counts at most as often as it is after different words, so that a passage or a text that is there in many
    copies counts once. ``parts`` is gone through three times; what is held are the different marks of the toxic texts.
    """
    none = np.zeros(0, np.uint64)
    texts = sum(map(len, toxic))

    def words_of(label: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By block: marks of each token, the rows of texts with the label, the text of each of their marks, the first row of each mark and text."""
        for words, labels in zip(parts, toxic):
            kept, text = _marks(words), np.repeat(np.arange(len(labels)), np.diff(words.first))
            rows = np.flatnonzero(labels[text] == label)
            at = np.repeat(text[rows], 3)
            _, one = np.unique(mix(kept[rows].ravel() + at.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), return_index=True)
            yield kept, rows, at, one

    every, owner, low = [none], [np.zeros(0, np.int32)], 0
    for (kept, rows, at, one), labels in zip(words_of(1), toxic):
        every.append(kept[rows].ravel()[one])
        owner.append((at[one] + low).astype(np.int32))
        low += len(labels)
    marks = np.unique(np.concatenate(every))
    for i, hashes in enumerate(every):
        every[i] = _positions(marks, hashes)
    mark, owner = np.concatenate(every), np.concatenate(owner)
    del every
    give_back()
    in_toxic = np.bincount(mark, minlength=len(marks))
    in_clean = np.zeros(len(marks), np.int64)
    mixed, after = [none], [np.zeros(0, np.int32)]
    for kept, rows, _, one in words_of(0):
        found = _positions(marks, kept[rows].ravel()[one])
        in_clean += np.bincount(found[found >= 0], minlength=len(marks))
        rows = np.setdiff1d(np.arange(len(kept)), rows, assume_unique=True)
        pairs, hashes = _each_once(kept[rows].ravel(), np.repeat(np.roll(kept[:, 0], 1)[rows], 3))
        mixed.append(pairs)
        after.append(_positions(marks, hashes))
    weight = np.minimum(1.0, _distinct_times(mixed, after, len(marks)) / np.maximum(in_toxic, 1))
    del mixed, after
    give_back()
    tokens = weight * in_toxic + in_clean
    share = weight * in_toxic / (tokens + DOUBT)
    for i in range(ROUNDS):
        logs = np.log1p(-np.minimum(share, 0.999))
        explained = -np.expm1(np.bincount(owner, logs[mark], texts) + np.log1p(-LEAK))
        part = share[mark]
        part /= np.maximum(explained, 1e-12)[owner]
        np.minimum(part, 1.0, out=part)
        share = weight * np.bincount(mark, part, len(marks)) / (tokens + DOUBT * (1 - (i + 1) / ROUNDS))
    del mark, owner
    every_log = np.log1p(-np.minimum(share, 0.999))
    for words, labels in zip(parts, toxic):
        kept, text = _marks(words), np.repeat(np.arange(len(labels)), np.diff(words.first))
        own = np.zeros(len(text))
        rows = np.flatnonzero(labels[text] == 1)
        if len(rows):
            logs = every_log[np.searchsorted(marks, kept[rows])].sum(axis=1)
            explained = -np.expm1(np.bincount(text[rows], logs, len(labels)) + np.log1p(-LEAK))
            own[rows] = np.minimum(1.0, -np.expm1(logs) / np.maximum(explained[text[rows]], 1e-12))
        yield own


def _windows(words: Words, labels: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Word numbers of windows: around tokens drawn by their labels from each text, and around any tokens of it."""
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if a == b:
            continue
        hit = a + np.flatnonzero(labels[a:b])
        n = min(WINDOWS, len(hit), int(np.ceil(labels[a:b].sum())))
        middle = rng.choice(hit, n, replace=False, p=labels[hit] / labels[hit].sum()) if n else hit
        for m in [*middle.tolist(), *rng.integers(a, b, 2 if len(hit) else WINDOWS).tolist()]:
            out.append(np.arange(max(a, m - REACH), min(b, m + REACH + 1)))
    return out


def _fit_weights(x: np.ndarray, y: np.ndarray, first: np.ndarray, rng: np.random.Generator, epochs: int = 8, least: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights whose field is closest to the probabilities y of the labels given features x, by AdaGrad over batches of windows.

    A small sample is gone through more often, so that there are at least ``least`` steps.
    """
    weights, moved = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    log_steps, steps_moved = np.array([[0.0, -2.0], [-1.0, 0.0]]), np.full((2, 2), 1e-2)
    opening, opening_moved = -2.0, 1e-2
    counts = np.diff(first)
    batches = max(1, len(counts) // 256)
    for _ in range(max(epochs, -(-least // batches))):
        order = rng.permutation(len(counts))
        for chosen in np.array_split(order, batches):
            n = counts[chosen]
            f = np.concatenate(([0], np.cumsum(n)))
            at = np.arange(f[-1]) - np.repeat(f[:-1], n) + np.repeat(first[chosen], n)
            xs, ys = x[at], y[at].astype(float)
            steps = np.exp(log_steps)
            ahead, back, marginal = forward_backward(weights[xs].sum(axis=1), f, steps, np.exp(opening))
            rest = ys - _sigmoid(marginal)
            grad = np.bincount(xs.ravel(), np.repeat(rest, x.shape[1]), BUCKETS) / len(chosen) - 1e-5 * weights
            moved += grad**2
            weights += 0.3 * grad / np.sqrt(moved)
            inner = np.ones(f[-1], bool)
            inner[f[:-1]] = False
            t = np.flatnonzero(inner)
            left, right = np.stack([np.ones(len(t)), ahead[t - 1]], 1), np.stack([np.ones(len(t)), back[t]], 1)
            joint = left[:, :, None] * steps * right[:, None, :]
            expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            seen = np.stack([1 - ys[t - 1], ys[t - 1]]) @ np.stack([1 - ys[t], ys[t]], axis=1)
            grad_steps = (seen - expected) / len(chosen)
            steps_moved += grad_steps**2
            log_steps += 0.1 * grad_steps / np.sqrt(steps_moved)
            grad_open = rest[f[:-1]].mean()
            opening_moved += grad_open**2
            opening += 0.1 * grad_open / np.sqrt(opening_moved)
    return weights, np.exp(log_steps), float(np.exp(opening))


def document_signals(marginal: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: one, the largest log-odds of a token (clipped), and the log of the summed marginals of tagged tokens.

    Tokens below one half do not add up, so that the length of a text alone says nothing.
    """
    out = np.zeros((len(first) - 1, 3))
    out[:, 0], out[:, 1] = 1, -8
    full = np.flatnonzero(np.diff(first))
    if len(full):
        clipped = np.clip(marginal, -8, 8)
        out[full, 1] = np.maximum.reduceat(clipped, first[full])
        out[full, 2] = np.log1p(np.add.reduceat(np.where(marginal >= 0, _sigmoid(marginal), 0.0), first[full]))
    return out


def _fit_score(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w)
    return w


def _infer(words: Words, model: Model) -> np.ndarray:
    if not len(words.begin):
        return np.zeros(0)
    logits = model.weights[features(words)].sum(axis=1)
    return forward_backward(logits, words.first, model.steps, model.opening)[2]


class _Parts:
    """Words of a column of texts, block by block. Every pass splits them anew, so that the words of one block are held."""

    def __init__(self, column: pa.Array, limit: int = BLOCK_BYTES):
        self.column, self.limit = column, limit

    def __iter__(self) -> Iterator[Words]:
        return (split_words(block, ALPHANUMERIC) for block in blocks(self.column, self.limit))


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """Fit the field on tokens labelled from the texts' labels, then the document score on their marginals.

    Memory grows with the windows and the different marks of toxic texts, not with all tokens; freed memory goes back between the steps.
    """
    rng = np.random.default_rng(seed)
    column = pa.array(texts, pa.large_string())
    parts = _Parts(column)
    labels = [np.array(toxic[block.low : block.high], int) for block in blocks(column)]
    xs, ys, sizes = [np.zeros((0, 7), np.uint32)], [np.zeros(0)], []
    for words, y in zip(parts, label_tokens(parts, labels)):
        windows = _windows(words, y, rng)
        if windows:
            rows = np.concatenate(windows)
            xs.append(features(words)[rows])
            ys.append(y[rows])
            sizes += map(len, windows)
    first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    x, y = np.concatenate(xs), np.concatenate(ys)
    del xs, ys
    give_back()
    if not y.any():
        warnings.warn("no toxic text with words to learn from: every text gets a score near 0", stacklevel=2)
        return Model(np.zeros(BUCKETS), np.array([[1.0, 1e-6], [1.0, 1e-6]]), 1e-6, np.array([-20.0, 0.0, 0.0]))
    model = Model(*_fit_weights(x, y, first, rng), np.zeros(3))
    del x, y
    give_back()
    signals = np.concatenate([document_signals(_infer(words, model), words.first) for words in _Parts(column, BLOCK_BYTES // 4)])
    return model._replace(score=_fit_score(signals, np.concatenate(labels).astype(float)))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``spans``, the toxic runs of words as (start, end) in code points.

    Whole texts, one narrow pass. NULL and texts without words get the score of no toxic token and no spans. A span
    joins neighbouring words whose marginal is at least one half; ``end`` is exclusive. The model's size is fixed by BUCKETS.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(column: pa.Array) -> list:
        model = shared.value
        scores, spans = [], []
        for block in blocks(column):
            words = split_words(block, ALPHANUMERIC)
            marginal = _infer(words, model)
            scores.append(_sigmoid(document_signals(marginal, words.first) @ model.score))
            characters = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
            hit = np.flatnonzero(marginal >= 0)
            own = np.searchsorted(words.first, hit, "right") - 1
            found: list[list[dict]] = [[] for _ in range(block.high - block.low)]
            previous = -2
            for w, i in zip(hit.tolist(), own.tolist()):
                base = characters[block.starts[i]]
                start, end = int(characters[words.begin[w]] - base), int(characters[words.end[w]] - base)
                if w == previous + 1 and found[i]:
                    found[i][-1]["end"] = end
                else:
                    found[i].append({"start": start, "end": end})
                previous = w
            spans += found
        return [np.concatenate(scores) if scores else [], spans]

    return with_text_columns(docs, text, "score double, spans array<struct<start:bigint,end:bigint>>", lambda: work, keep)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic", per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``per_class`` labelled texts of each class, drawn by a hash of their ids from rows with ``learn``.

    The log-odds are then moved from the shares of the sample to those of all labels. Without toxic examples every text gets a score near 0.
    """
    texts, toxic, shift = labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, per_class, doc_id, text)
    give_back()
    model = fit(texts, toxic)
    give_back()
    return model._replace(score=model.score + np.array([shift, 0, 0]))

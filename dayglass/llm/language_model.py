"""Log-bilinear language model: corpus counts, noise-contrastive training in numpy, normalised scores of whole texts.

The model predicts the next token from the four before it, in three steps. The most frequent words of the training texts
and the end of a text are classes of their own, all other words are one class. Inside it each word has a slot, and slots lie
in groups: classes, groups and the slots of a group are normalised by themselves. The next most frequent words have slots of
their own; all others are dealt over slots by their hash, as many as the words ask for, and follow their smoothed counts in a
slot. Every word has learned numbers as a context and as a target, and the probabilities of all words, with one for the
unseen ones of each slot, sum up to 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.frames import quoted
from dayglass.llm.samples import LONGEST
from dayglass.llm.textkit import Block, Rolling, blocks, mix, split_words
from dayglass.session import cut_lineage

#: Classes of the model (the last one is for all other words), numbers of a vector, and words of context.
CLASSES, SIZE, CONTEXT = 256, 16, 4
#: Most groups of slots, and most slots of a group; a slot has SIZE numbers as a context, SIZE as a target, and a bias.
GROUPS = 128
#: Noise groups drawn for a batch, and noise slots drawn for a word from its group.
GROUP_NOISE, SLOT_NOISE = 32, 2
#: Numbers of a part in which tasks give out what they learned.
PART = 1 << 13
#: Frequent words whose counts every task knows, so that they need no join.
FREQUENT = 4096
#: Texts from which the start of the training is learned, on the driver.
FIRST_TEXTS = 400
BATCH, NOISE = 2048, 64
#: Words that a task counts before it gives the counts out.
COUNTED = 1 << 23
#: The end of a text, as a hash among those of words.
END = np.uint64(0x5851F42D4C957F2D)


class Counts(NamedTuple):
    tokens: int
    distinct: int
    words: np.ndarray  # hashes of frequent words, sorted
    counts: np.ndarray
    rank: np.ndarray  # 0 for the most frequent


class Parameters(NamedTuple):
    context: np.ndarray  # class (and one for a missing word) x SIZE
    place: np.ndarray  # place before the token x SIZE
    target: np.ndarray  # class x SIZE
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self])

    @staticmethod
    def of(flat: np.ndarray) -> Parameters:
        sizes = [(CLASSES + 1) * SIZE, CONTEXT * SIZE, CLASSES * SIZE]
        a, b, c, d = np.split(np.asarray(flat, np.float32), np.cumsum(sizes))
        return Parameters(a.reshape(-1, SIZE), b.reshape(-1, SIZE), c.reshape(-1, SIZE), d)


class Slots(NamedTuple):
    """How the words of the last class are dealt: ``side`` groups of ``side`` slots, of which the first ``own`` hold a word each."""

    side: int
    own: int
    totals: np.ndarray  # smoothed count of all words of a slot and one unseen word

    @property
    def hashed(self) -> int:
        return self.side * self.side - self.own

    def shares(self) -> np.ndarray:
        return self.totals / self.totals.sum()


class Words(NamedTuple):
    """Learned numbers of the slots, and of their groups."""

    context: np.ndarray  # slot x SIZE
    slot: np.ndarray  # slot x SIZE
    slot_bias: np.ndarray
    group: np.ndarray  # group x SIZE
    group_bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self])

    @staticmethod
    def of(flat: np.ndarray, side: int) -> Words:
        n = side * side
        a, b, c, d, e = np.split(np.asarray(flat, np.float32), np.cumsum([n * SIZE, n * SIZE, n, side * SIZE]))
        return Words(a.reshape(-1, SIZE), b.reshape(-1, SIZE), c, d.reshape(-1, SIZE), e)


def tokens_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text (its words, A-Z lower-cased, and one END) and where each text begins."""
    words = split_words(block)
    first = words.first + np.arange(len(words.first))
    out = np.full(first[-1], END, np.uint64)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    out[np.arange(len(words.begin)) + text] = Rolling(words.data).of(words.begin, words.end)
    return out, first


def corpus_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c): tokens of all texts by their hashes. Counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def made() -> pa.RecordBatch:
            word, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count, pa.int64())], names=["word", "c"])

        for batch in batches:
            for block in blocks(batch.column(0)):
                held.append(tokens_of(block)[0])
                if sum(map(len, held)) > COUNTED:
                    yield made()
        if held:
            yield made()

    counted = docs.select(F.col(quoted(text)).cast("string").alias("text")).mapInArrow(run, "word bigint, c bigint")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def frequent_counts(counts: DataFrame) -> Counts:
    """Sums of the counts and the FREQUENT most frequent words (by count, then by hash)."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.col("c").desc(), "word").limit(FREQUENT).collect()
    word = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(word)
    return Counts(total["n"], total["v"], word[order], np.array([r["c"] for r in top], np.int64)[order], np.arange(len(word))[order])


def _look_up(counts: Counts, tokens: np.ndarray) -> np.ndarray:
    """Place of each token among the frequent words, -1 for others."""
    if not len(counts.words):
        return np.full(len(tokens), -1)
    at = np.minimum(np.searchsorted(counts.words, tokens), len(counts.words) - 1)
    return np.where(counts.words[at] == tokens, at, -1)


def _classes(counts: Counts, place: np.ndarray) -> np.ndarray:
    """Model classes of tokens by their place: the rank of a frequent word, or the class of all others."""
    if not len(counts.words):
        return np.full(len(place), CLASSES - 1)
    return np.where(place >= 0, np.minimum(counts.rank[place], CLASSES - 1), CLASSES - 1)


def slot_shape(counts: Counts) -> tuple[int, int]:
    """Groups (and slots of a group) for so many different words, and how many slots hold one word."""
    side = max(2, min(GROUPS, math.isqrt(max(0, counts.distinct - 1)) + 1))
    return side, max(0, min(len(counts.words) - (CLASSES - 1), side * side // 2))


def word_slots(counts: DataFrame, known: Counts) -> Slots:
    """The slots with the sums of their words' counts, which the driver gets."""
    side, own = slot_shape(known)
    hashed = side * side - own
    tokens, distinct = np.zeros(hashed), np.zeros(hashed)
    for r in counts.groupBy(F.pmod("word", F.lit(hashed)).alias("at")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        tokens[r["at"]], distinct[r["at"]] = r["c"], r["n"]
    # Classes and slots of single words are not among them.
    single = known.rank < CLASSES - 1 + own
    at = np.mod(known.words.view(np.int64), hashed)[single]
    np.subtract.at(tokens, at, known.counts[single])
    np.subtract.at(distinct, at, 1)
    totals = np.zeros(side * side)
    held = (known.rank >= CLASSES - 1) & single
    totals[known.rank[held] - (CLASSES - 1)] = known.counts[held] + 0.1
    totals[own:] = tokens + 0.1 * (distinct + 1)
    return Slots(side, own, totals)


def _slots(counts: Counts, slots: Slots, tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Slot of each token of the last class, -1 for tokens that are classes."""
    hashed = slots.own + np.mod(tokens.view(np.int64), slots.hashed)
    if not len(counts.words):
        return hashed
    rank = np.where(place >= 0, counts.rank[place], CLASSES - 1 + slots.own) - (CLASSES - 1)
    return np.where(rank < 0, -1, np.where(rank < slots.own, rank, hashed))


def _units(classes: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """What a token is as a context: its class, or CLASSES + 1 and its slot."""
    return np.where(slot < 0, classes, CLASSES + 1 + slot)


def _with_words(p: Parameters, words: Words) -> Parameters:
    """Parameters whose contexts go on with those of the slots."""
    return p._replace(context=np.concatenate([p.context, words.context]))


def first_words(slots: Slots, seed: int = 4) -> Words:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    n, share = slots.side * slots.side, slots.shares()
    groups = share.reshape(slots.side, slots.side).sum(axis=1)
    return Words(draw(n, SIZE), draw(n, SIZE), np.log(share).astype(np.float32), draw(slots.side, SIZE), np.log(groups).astype(np.float32))


def _contexts(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes of the CONTEXT tokens before each token; CLASSES stands for none."""
    inside = np.arange(len(classes)) - np.repeat(first[:-1], np.diff(first))
    out = np.full((len(classes), CONTEXT), CLASSES)
    for k in range(CONTEXT):
        at = np.flatnonzero(inside > k)
        out[at, k] = classes[at - k - 1]
    return out


def _predicted(p: Parameters, context: np.ndarray) -> np.ndarray:
    out = p.context[context[:, 0]] * p.place[0]
    for k in range(1, CONTEXT):
        out += p.context[context[:, k]] * p.place[k]
    return out


def class_shares(counts: Counts) -> np.ndarray:
    """Smoothed shares of the classes among the training tokens."""
    share = np.zeros(CLASSES)
    kept = counts.rank < CLASSES - 1
    share[counts.rank[kept]] = counts.counts[kept]
    share[CLASSES - 1] = counts.tokens - share.sum()
    return (share + 0.1) / (share + 0.1).sum()


def first_parameters(counts: Counts, seed: int = 3) -> Parameters:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    bias = np.log(class_shares(counts)).astype(np.float32)
    return Parameters(draw(CLASSES + 1, SIZE), 1 + draw(CONTEXT, SIZE), draw(CLASSES, SIZE), bias)


class Trainer:
    """Noise-contrastive estimation: tell each token from NOISE draws of the unigram distribution, shared by a batch."""

    def __init__(self, start: Parameters, shares: np.ndarray, seed: int, rate: float, words: Words | None = None, slots: Slots | None = None):
        self.p = Parameters(*[x.copy() for x in start])
        self.words, self.slots = words and Words(*[x.copy() for x in words]), slots
        if words:
            # Contexts of classes and slots are one table while the model learns.
            self.p = _with_words(self.p, words)
            self.words_moved = [np.full(x.shape, 1.0, np.float32) for x in (self.p.context, *words[1:])]
            self.slot_shares = slots.shares()
            self.group_shares = self.slot_shares.reshape(slots.side, slots.side).sum(axis=1)
            self.upto = np.concatenate([[0.0], self.slot_shares.cumsum()])
            self.log_slot_noise = np.log(SLOT_NOISE * self.slot_shares / np.repeat(self.group_shares, slots.side)).astype(np.float32)
        self.moved = [np.full(x.shape, 1.0, np.float32) for x in self.p]
        self.shares, self.rate = shares, rate
        self.log_noise = np.log(NOISE * shares).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.seen = 0

    @staticmethod
    def _scatter(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
        width = rows.shape[1]
        cell = (at[:, None] * width + np.arange(width)).ravel()
        return np.bincount(cell, rows.ravel(), size * width).reshape(size, width)

    def _step(self, k: int, at: np.ndarray, rows: np.ndarray) -> None:
        """Moves a few contexts (k is 0), slots or groups, or their biases, by the sums of ``rows``."""
        x, moved = self.words[k] if k else self.p.context, self.words_moved[k]
        some, number = np.unique(at, return_inverse=True)
        grad = np.bincount(number, rows, len(some)) if x.ndim == 1 else self._scatter(number, rows, len(some))
        grad = grad.astype(np.float32)
        kept = moved[some] + grad**2
        moved[some] = kept
        x[some] += self.rate * grad / np.sqrt(kept)

    def _word_batch(self, hidden: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Tells the group of each word from other groups, and its slot from others of the group; gives what goes back to ``hidden``."""
        w, side = self.words, self.slots.side
        own = slot // side
        noise = self.rng.choice(side, GROUP_NOISE, p=self.group_shares)
        log_noise = np.log(GROUP_NOISE * self.group_shares).astype(np.float32)
        pull = 1 / (1 + np.exp(np.clip((hidden * w.group[own]).sum(axis=1) + w.group_bias[own] - log_noise[own], -30, 30)))
        push = -1 / (1 + np.exp(-np.clip(hidden @ w.group[noise].T + (w.group_bias[noise] - log_noise[noise]), -30, 30)))
        back = pull[:, None] * w.group[own] + push @ w.group[noise]
        self._step(3, np.append(own, noise), np.concatenate([pull[:, None] * hidden, push.T @ hidden]))
        self._step(4, np.append(own, noise), np.append(pull, push.sum(axis=0)))
        low, high = self.upto[own * side, None], self.upto[(own + 1) * side, None]
        among = np.searchsorted(self.upto, low + self.rng.random((len(slot), SLOT_NOISE)) * (high - low), "right") - 1
        at = np.concatenate([slot[:, None], np.clip(among, own[:, None] * side, own[:, None] * side + side - 1)], axis=1)
        vectors = w.slot[at]
        logit = np.einsum("ij,ikj->ik", hidden, vectors) + w.slot_bias[at] - self.log_slot_noise[at]
        pull = -1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        pull[:, 0] += 1
        back += np.einsum("ik,ikj->ij", pull, vectors)
        self._step(1, at.ravel(), (pull[:, :, None] * hidden[:, None, :]).reshape(-1, SIZE))
        self._step(2, at.ravel(), pull.ravel())
        return back

    def batch(self, context: np.ndarray, target: np.ndarray, slot: np.ndarray | None = None) -> None:
        p = self.p
        hidden = _predicted(p, context)
        noise = self.rng.choice(CLASSES, NOISE, p=self.shares)
        own = (hidden * p.target[target]).sum(axis=1) + p.bias[target] - self.log_noise[target]
        other = hidden @ p.target[noise].T + (p.bias[noise] - self.log_noise[noise])
        pull = 1 / (1 + np.exp(np.clip(own, -30, 30)))
        push = -1 / (1 + np.exp(-np.clip(other, -30, 30)))
        back = pull[:, None] * p.target[target] + push @ p.target[noise]
        if self.words:
            rest = np.flatnonzero(slot >= 0)
            back[rest] += self._word_batch(hidden[rest], slot[rest])
        to_target = self._scatter(target, pull[:, None] * hidden, CLASSES)
        np.add.at(to_target, noise, push.T @ hidden)
        to_bias = np.bincount(target, pull, CLASSES)
        np.add.at(to_bias, noise, push.sum(axis=0))
        to_context, to_place = None if self.words else np.zeros(p.context.shape), np.zeros(p.place.shape)
        for k in range(CONTEXT):
            if not self.words:
                to_context += self._scatter(context[:, k], back * p.place[k], CLASSES + 1)
            to_place[k] = (back * p.context[context[:, k]]).sum(axis=0)
        if self.words:
            self._step(0, context.ravel(), (back[:, None, :] * p.place).reshape(-1, SIZE))
        for x, moved, grad in zip(p, self.moved, (to_context, to_place, to_target, to_bias)):
            if grad is None:
                continue
            grad = (grad / len(target) * 32).astype(np.float32)
            moved += grad**2
            x += self.rate * grad / np.sqrt(moved)

    def learned(self) -> tuple[Parameters, Words | None]:
        if not self.words:
            return self.p, None
        return self.p._replace(context=self.p.context[: CLASSES + 1]), self.words._replace(context=self.p.context[CLASSES + 1 :])

    def text_block(self, counts: Counts, tokens: np.ndarray, first: np.ndarray) -> None:
        place = _look_up(counts, tokens)
        classes, slot = _classes(counts, place), None
        if self.words:
            slot = _slots(counts, self.slots, tokens, place)
        context = _contexts(classes if slot is None else _units(classes, slot), first)
        order = self.rng.permutation(len(classes))
        for low in range(0, len(order), BATCH):
            part = order[low : low + BATCH]
            self.batch(context[part], classes[part], None if slot is None else slot[part])
        self.seen += len(classes)


def train(docs: DataFrame, counts: Counts, slots: Slots, doc_id: str = "doc_id", text: str = "text") -> tuple[Parameters, Words]:
    """Learn from all texts of ``docs``.

    The start is learned from FIRST_TEXTS texts on the driver. Then each task goes on from there over its whole texts,
    and the tasks' parameters are averaged, weighted by their tokens. The driver gets one set of parameters.
    """
    shares = class_shares(counts)
    trainer = Trainer(first_parameters(counts), shares, 5, 0.2, first_words(slots), slots)
    few = docs.where(F.length(F.col(quoted(text))) <= LONGEST).select(F.xxhash64(F.col(quoted(doc_id))).alias("order"), F.col(quoted(text)).alias("text"))
    # First the hashes alone, so that no task sends texts which are not needed.
    last = few.select("order").orderBy("order").limit(FIRST_TEXTS).agg(F.max("order")).first()[0]
    texts = [r["text"] for r in few.where(F.col("order") <= F.lit(last)).orderBy("order", "text").limit(FIRST_TEXTS).collect()]
    for _ in range(3):
        for block in blocks(pa.array(texts, pa.string())):
            trainer.text_block(counts, *tokens_of(block))
    shared = docs.sparkSession.sparkContext.broadcast((counts, shares, slots, *trainer.learned()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shares, slots, start, words = shared.value
        own = Trainer(start, shares, 9, 0.1, words, slots)
        for batch in batches:
            for block in blocks(batch.column(0)):
                own.text_block(counts, *tokens_of(block))
        if own.seen:
            values = np.concatenate([x.flat() for x in own.learned()]).astype(float) * own.seen
            parts = [values[low : low + PART].tobytes() for low in range(0, len(values), PART)]
            columns = [pa.array(np.arange(len(parts)), pa.int32()), pa.array([own.seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "sums"])

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in rows["sums"]) / rows["n"].sum()
        return pd.DataFrame({"i": rows["i"].iloc[:1], "values": [total.astype(np.float32).tobytes()]})

    learned = docs.select(F.col(quoted(text)).cast("string").alias("text")).mapInArrow(run, "i int, n bigint, sums binary")
    each = learned.groupBy("i").applyInPandas(mean, "i int, values binary").collect()
    if not each:
        return trainer.learned()
    values = np.frombuffer(b"".join(r["values"] for r in sorted(each, key=lambda r: r["i"])), np.float32)
    size = len(trainer.learned()[0].flat())
    return Parameters.of(values[:size]), Words.of(values[size:], slots.side)


def log_sums(p: Parameters, context: np.ndarray, most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Natural logs of the sums over all classes, one for each different context, and the number of each token's context."""
    packed = context @ len(p.context) ** np.arange(CONTEXT)
    _, at, number = np.unique(packed, return_index=True, return_inverse=True)
    sums = np.empty(len(at))
    for low in range(0, len(at), most):
        part = slice(low, low + most)
        logits = _predicted(p, context[at[part]]) @ p.target.T
        logits += p.bias
        top = logits.max(axis=1)
        logits -= top[:, None]
        np.exp(logits, out=logits)
        sums[part] = top + np.log(logits.sum(axis=1))
    return sums, number


def class_log_probabilities(p: Parameters, classes: np.ndarray, context: np.ndarray, most: int = 4096) -> np.ndarray:
    """Natural logs of the normalised probabilities of the tokens' classes, by products of whole batches."""
    sums, number = log_sums(p, context, most)
    out = np.empty(len(classes))
    for low in range(0, len(classes), most):
        part = slice(low, low + most)
        own = np.einsum("ij,ij->i", _predicted(p, context[part]), p.target[classes[part]])
        out[part] = own + p.bias[classes[part]] - sums[number[part]]
    return out


def _normalised(hidden: np.ndarray, vectors: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    logits = hidden @ vectors.T + bias
    top = logits.max(axis=1)
    return logits[np.arange(len(at)), at] - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))


def slot_log_probabilities(p: Parameters, words: Words, context: np.ndarray, slot: np.ndarray, most: int = 4096) -> np.ndarray:
    """Natural logs of the probabilities of slots inside the last class; ``p`` has the contexts of slots."""
    side, out = len(words.group), np.empty(len(slot))
    order = np.argsort(slot // side, kind="stable")
    for low in range(0, len(order), most):
        part = order[low : low + most]
        hidden, group = _predicted(p, context[part]), slot[part] // side
        out[part] = _normalised(hidden, words.group, words.group_bias, group)
        for g in np.unique(group):
            rows, own = group == g, slice(g * side, (g + 1) * side)
            out[part[rows]] += _normalised(hidden[rows], words.slot[own], words.slot_bias[own], slot[part[rows]] - g * side)
    return out


def _row_keys(batch_ids: pa.Array, block: Block) -> np.ndarray:
    """64-bit keys of (id, text); equal rows have equal keys."""
    ids = batch_ids.slice(block.low, block.high - block.low)
    known = np.array([hash_id(i) for i in ids.to_pylist()], np.uint64)
    text = Rolling(block.data).of(block.starts[:-1], block.starts[1:], 77)
    return mix(known + text * np.uint64(3)).view(np.int64)


def hash_id(value) -> int:
    return 1 if value is None else (int(value) * 0x9E3779B97F4A7C15 + 2) % (1 << 64)


def score_texts(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Counts and the model are learned from the rows with ``learn``. NULL texts are empty: they have one token, the end.
    base_score is that of smoothed counts, ``score`` the model's; without training texts both are 0. Repeated
    rows are scored each. Ids are whole numbers or NULL.

    The counts of all but the FREQUENT words come by a join on their hashes, from one row per document and word,
    so no word but a few thousandths of the rows meets in one task.
    """
    training = docs.where(learn)
    table = cut_lineage(corpus_counts(training, text))
    counts = frequent_counts(table)
    slots = word_slots(table, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, slots, *train(training, counts, slots, doc_id, text)))
    source = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).cast("string").alias("text"))

    def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, first[:-1])  # every text has its end

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, slots, parameters, words = shared.value
        wide = _with_words(parameters, words)
        for batch in batches:
            for block in blocks(batch.column(1)):
                tokens, first = tokens_of(block)
                place = _look_up(counts, tokens)
                classes = _classes(counts, place)
                slot = _slots(counts, slots, tokens, place)
                context = _contexts(_units(classes, slot), first)
                inside = class_log_probabilities(wide, classes, context)
                rest = np.flatnonzero(slot >= 0)
                inside[rest] += slot_log_probabilities(wide, words, context[rest], slot[rest])
                dealt = slot >= slots.own
                inside[dealt] -= np.log(slots.totals[slot[dealt]])
                inside /= math.log(10)
                c = counts.counts[place] if len(counts.words) else np.zeros(len(tokens))
                logs = np.where(place >= 0, np.log10(c + 0.1), 0.0)
                columns = [
                    batch.column(0).slice(block.low, block.high - block.low),
                    pa.array(_row_keys(batch.column(0), block)),
                    pa.array(np.diff(first)),
                    pa.array(per_text((place >= 0).astype(np.int64), first)),
                    pa.array(per_text(logs, first)),
                    pa.array(per_text(inside, first)),
                    pa.array(per_text(np.where(dealt, logs, 0.0), first)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields.split(", ")])

    fields = "doc_id bigint, row bigint, n_tokens bigint, n_frequent bigint, frequent_logs double, inside double, rest_logs double"
    scored = cut_lineage(source.mapInArrow(score, fields))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value[0]
        for batch in batches:
            for block in blocks(batch.column(1)):
                tokens, first = tokens_of(block)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                rare = _look_up(counts, tokens) < 0
                tokens, owner = tokens[rare], owner[rare]
                order = np.lexsort((tokens, owner))
                tokens, owner = tokens[order], owner[order]
                new = np.ones(len(tokens), bool)
                new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(tokens)))
                items = pa.StructArray.from_arrays([pa.array(tokens[at].view(np.int64)), pa.array(times, pa.int32())], names=["word", "times"])
                offsets = np.searchsorted(owner[at], np.arange(len(first))).astype(np.int32)
                columns = [pa.array(_row_keys(batch.column(0), block)), pa.ListArray.from_arrays(pa.array(offsets), items)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "items"])

    lists = source.mapInArrow(others, "row bigint, items array<struct<word:bigint,times:int>>")
    each = lists.select("row", F.explode("items").alias("x")).select("row", "x.word", "x.times")
    found = each.join(table, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = found.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("other_logs"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("other_known"),
    )
    copies = scored.groupBy("row").agg(F.count("*").alias("copies"))
    # Equal rows have added up their sums; each of them gets its part.
    part = sums.join(copies, "row").select("row", (F.col("other_logs") / F.col("copies")).alias("other_logs"), (F.col("other_known") / F.col("copies")).cast("long").alias("other_known"))
    wide = scored.join(part, "row", "left").fillna({"other_logs": 0.0, "other_known": 0})
    every = math.log10(counts.tokens + 0.1 * (counts.distinct + 1))
    logs = F.col("frequent_logs") + F.col("other_logs")
    model = F.col("inside") + F.col("rest_logs") + F.col("other_logs")
    return wide.select(
        "doc_id",
        "n_tokens",
        (F.col("n_frequent") + F.col("other_known")).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * every).alias("base_score"),
        (model if counts.tokens else F.lit(0.0)).alias("score"),
    )

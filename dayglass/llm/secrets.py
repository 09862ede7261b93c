"""Secret scans: candidates in texts, and a random forest that removes the false positives among them."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayglass.llm.frames import quoted, with_text_columns
from dayglass.llm.textkit import Block, blocks, split_words, word_hashes

#: Shortest run that is a candidate by itself; labelled findings of each class that the forest is fitted on; its trees and their depth.
SHORTEST, PER_CLASS, TREES, DEPTH = 16, 3000, 25, 8
#: Share of all places of words, and places in all texts, that a word of the dictionary has at least; different words that
#: a task counts before it gives the counts out.
SHARE, SEEN, COUNTED = 5e-6, 3, 1 << 18
#: Buckets of the words before a candidate, cuts per feature, and characters on either side that are looked at.
NEIGHBOURS, CUTS, AROUND = 16, 32, 48

_INSIDE = np.array([chr(b).isalnum() and b < 128 or chr(b) in "+/_-" for b in range(256)])
_LETTERS = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_NAME = re.compile(rb"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credential)s?[\"']?\Z")
_ANY_NAME = re.compile(rb"[A-Za-z][\"']?\Z")
_VALUE = re.compile(rb"(?::=|=>|=|:)\s*(?:\"((?:\\.|[^\"\\\r\n])+)\"|'((?:\\.|[^'\\\r\n])+)'|[\"']?([^\s\"']+))")
_BLANK = b" \t\r\n\v\f"
_ACCESS_KEY = re.compile(r"A(KI|SI)A[0-9A-Z]{16}$")
_WORD = re.compile(r"[A-Za-z]{2,}")


class Language(NamedTuple):
    """What ordinary words look like: log-probabilities of byte pairs, and frequent words."""

    pairs: np.ndarray
    words: frozenset[str]


class Candidate(NamedTuple):
    text: int
    begin: int  # bytes from the start of the text
    end: int
    value: str
    before: str
    after: str
    given: int  # 1 for the whole value given to a telling name, 2 for a part of one, -1 for that of another name, else 0


class Forest(NamedTuple):
    cuts: np.ndarray  # feature x CUTS
    feature: np.ndarray  # tree x node, -1 in leaves
    bin: np.ndarray
    share: np.ndarray


def _given(block: Block, raw: bytes, others: bool) -> dict[tuple[int, int], int]:
    """(begin, end) in the block of all values after a name and a separator: 1 for telling names, -1 for others if asked for.

    A value goes up to its closing quote, or without quotes up to a quote or blank.
    """
    found = {}
    at = np.flatnonzero((block.data == ord("=")) | (block.data == ord(":")))
    text = np.searchsorted(block.starts, at, "right") - 1
    for i, low, high in zip(at.tolist(), block.starts[text].tolist(), block.starts[text + 1].tolist()):
        j = i
        while j > low and raw[j - 1] in _BLANK:
            j -= 1
        kind = 1 if _NAME.search(raw, max(low, j - 16), j) else -1
        if kind < 0 and not (others and _ANY_NAME.search(raw, max(low, j - 2), j)):
            continue
        value = _VALUE.match(raw, i, high)
        if value:
            found[value.span(value.lastindex)] = kind
    return found


def candidates(block: Block, others: bool = False) -> list[Candidate]:
    """Values given to telling names, whatever their length and signs, and long runs, each span once; they may overlap.

    Runs are the longest of ASCII letters, digits, plus, slash, underscore and minus of at least SHORTEST characters.
    With ``others`` short values given to other names come as well.
    """
    runs = split_words(block, _INSIDE, lower=False)
    raw = block.data.tobytes()
    spans = _given(block, raw, others)
    whole = sorted(k for k, kind in spans.items() if kind == 1)
    spans = {(a, b): kind for (a, b), kind in spans.items() if kind == 1 or b - a < SHORTEST}
    reach = np.maximum.accumulate([b for _, b in whole]) if whole else np.zeros(0, np.int64)
    begins = np.array([a for a, _ in whole], np.int64)
    for i in np.flatnonzero(runs.end - runs.begin >= SHORTEST).tolist():
        a, b = int(runs.begin[i]), int(runs.end[i])
        k = int(np.searchsorted(begins, a, "right")) - 1
        spans.setdefault((a, b), 2 if k >= 0 and reach[k] > a else 0)
    found = []
    for (a, b), given in sorted(spans.items()):
        t = int(np.searchsorted(block.starts, a, "right")) - 1
        low, high = int(block.starts[t]), int(block.starts[t + 1])
        around = [raw[max(low, a - AROUND) : a], raw[b : min(high, b + AROUND)]]
        before, after = (x.decode("utf-8", "ignore") for x in around)
        found.append(Candidate(t, a - low, b - low, raw[a:b].decode("utf-8"), before, after, given))
    return found


def rule_label(c: Candidate) -> int | None:
    """1 for findings of known forms or given to a name that says so, 0 for plain words and numbers, else None.

    Values of one kind that are given to a telling name, and parts of values, have no label; 2 is for plain short values of other names.
    """
    if _ACCESS_KEY.match(c.value):
        return 1
    digits, letters = any(x.isdigit() for x in c.value), any(x.isalpha() for x in c.value)
    if c.given > 0:
        return 1 if c.given == 1 and digits and letters else None
    if digits and letters:
        return None
    return 2 if c.given < 0 else 0


def _coverage(value: str, words: frozenset[str]) -> float:
    """Share of the characters in dictionary words of 3 to 12 letters, the longest at each place first."""
    text, at, covered = value.lower(), 0, 0
    while at < len(text):
        step = next((n for n in range(min(12, len(text) - at), 2, -1) if text[at : at + n] in words), 0)
        covered += step
        at += max(1, step)
    return covered / len(text)


def feature_row(c: Candidate, language: Language) -> list[float]:
    """Length, character transitions, dictionary coverage, path and neighbouring words of a candidate."""
    v, n = c.value, len(c.value)
    kinds = [0 if x.isdigit() else 1 if x.isupper() else 2 if x.islower() else 3 for x in v]
    shares = [kinds.count(k) / n for k in range(4)]
    counts = np.unique(list(v), return_counts=True)[1] / n
    codes = np.frombuffer(v.lower().encode(), np.uint8).astype(np.int64)
    pairs = language.pairs[codes[:-1], codes[1:]] if len(codes) > 1 else np.zeros(1)
    run = re.split(r"\s", c.before)[-1]
    words = _WORD.findall(c.before)[-2:]
    near = [0.0] * NEIGHBOURS
    for w in words:
        near[int.from_bytes(hashlib.md5(w.lower().encode()).digest()[:2], "big") % NEIGHBOURS] = 1.0
    return [
        math.log(n),
        *shares,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        float(pairs.mean()),
        float(pairs.min()),
        _coverage(v, language.words),
        len(counts) / n,
        float(-(counts * np.log2(counts)).sum()),
        float(all(x in "0123456789abcdefABCDEF" for x in v)),
        float(v.count("/")),
        float("/" in run or "." in run or "@" in run),
        float(run[-1:] in ("=", ":", '"', "'")),
        float(c.after[:1] in ('"', "'")),
        float(bool(words) and words[-1].lower() in ("password", "passwd", "pwd", "secret", "token", "key", "credential")),
        *near,
    ]


def learn_language(docs: DataFrame, text: str = "text") -> Language:
    """Byte pairs of all words (A-Z lower-cased) and the frequent words of 3 to 12 ASCII letters.

    Counted in each task over whole texts, then summed before words are chosen, so that the partitions of the table make no
    difference. A word is frequent by its share of the places of all such words. The driver gets at most 65,536 pair
    sums and 1 / SHARE words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(1 << 16, np.int64)
        seen: dict[int, list] = {}

        def made() -> pa.RecordBatch:
            kept = [(w, n) for w, n in seen.values() if w.isascii() and w.isalpha()]
            used = np.flatnonzero(pairs)
            names = [None] * len(used) + [w for w, _ in kept]
            codes = used.tolist() + [None] * len(kept)
            numbers = pairs[used].tolist() + [n for _, n in kept]
            seen.clear()
            pairs[:] = 0
            return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(names, pa.string()), pa.array(numbers, pa.int64())], names=["pair", "word", "n"])

        for batch in batches:
            for block in blocks(batch.column(0)):
                words = split_words(block, _LETTERS)
                data = words.data.astype(np.int64)
                inside = np.zeros(len(data) + 1, np.int64)
                np.add.at(inside, words.begin, 1)
                np.add.at(inside, words.end, -1)
                edge = np.zeros(len(data) + 1, bool)
                edge[words.begin] = True
                on = np.cumsum(inside)[:-1] > 0
                k = np.flatnonzero(on[1:] & on[:-1] & ~edge[1:-1])
                pairs += np.bincount(data[k] * 256 + data[k + 1], minlength=1 << 16)
                size = words.end - words.begin
                short = np.flatnonzero((size >= 3) & (size <= 12))
                value, at, count = np.unique(word_hashes(words)[short], return_index=True, return_counts=True)
                for h, i, n in zip(value.tolist(), short[at].tolist(), count.tolist()):
                    if h in seen:
                        seen[h][1] += n
                    else:
                        seen[h] = [words.text(i), n]
                if len(seen) > COUNTED:
                    yield made()
        yield made()

    found = docs.select(F.col(quoted(text)).cast("string").alias("text")).mapInArrow(run, "pair bigint, word string, n bigint")
    sums = found.groupBy("pair", "word").agg(F.sum("n").alias("n")).persist()
    grid = np.full((256, 256), 0.1)
    for r in sums.where("pair IS NOT NULL").collect():
        grid[r["pair"] >> 8, r["pair"] & 255] += r["n"]
    known = sums.where("word IS NOT NULL")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    words = known.where(F.col("n") >= max(SEEN, SHARE * total)).collect()
    sums.unpersist()
    return Language(np.log(grid / grid.sum(axis=1, keepdims=True)).astype(np.float32), frozenset(r["word"] for r in words))


def fit_forest(x: np.ndarray, y: np.ndarray, seed: int = 13) -> Forest:
    """Trees on bootstrap samples; each split is the best of a few features drawn for it, by the Gini index."""
    rng = np.random.default_rng(seed)
    cuts = np.quantile(x, np.arange(1, CUTS) / CUTS, axis=0).T
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
    nodes, tries = (1 << (DEPTH + 1)) - 1, max(1, int(math.sqrt(x.shape[1])))
    feature, place, share = np.full((TREES, nodes), -1), np.zeros((TREES, nodes), int), np.zeros((TREES, nodes))
    for t in range(TREES):
        rows = {0: rng.integers(0, len(y), len(y))}
        for node in range(nodes):
            if node not in rows:
                continue
            own = rows.pop(node)
            share[t, node] = y[own].mean()
            if 2 * node + 2 >= nodes or share[t, node] in (0.0, 1.0) or len(own) < 4:
                continue
            best = (share[t, node] * (1 - share[t, node]) * len(own) - 1e-9, -1, 0)
            for f in rng.choice(x.shape[1], tries, replace=False).tolist():
                n, ones = (np.cumsum(np.bincount(binned[own, f], w, CUTS)) for w in (None, y[own]))
                left, right = n[:-1], n[-1] - n[:-1]
                impure = ones[:-1] * (1 - ones[:-1] / np.maximum(left, 1)) + (ones[-1] - ones[:-1]) * (1 - (ones[-1] - ones[:-1]) / np.maximum(right, 1))
                impure[(left == 0) | (right == 0)] = np.inf
                if impure.min() < best[0]:
                    best = (impure.min(), f, int(impure.argmin()))
            if best[1] >= 0:
                feature[t, node], place[t, node] = best[1], best[2]
                low = binned[own, best[1]] <= best[2]
                rows[2 * node + 1], rows[2 * node + 2] = own[low], own[~low]
    return Forest(cuts, feature, place, share)


def forest_scores(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Mean share of secrets in the leaves that each row comes to."""
    binned = np.stack([np.searchsorted(forest.cuts[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
    total = np.zeros(len(x))
    for feature, place, share in zip(forest.feature, forest.bin, forest.share):
        node = np.zeros(len(x), int)
        for _ in range(DEPTH):
            f = feature[node]
            right = binned[np.arange(len(x)), np.maximum(f, 0)] > place[node]
            node = np.where(f < 0, node, 2 * node + 1 + right)
        total += share[node]
    return total / len(forest.feature)


class Scanner(NamedTuple):
    language: Language
    forest: Forest | None

    def scores(self, found: list[Candidate]) -> np.ndarray:
        """Probability of a secret; without a forest the rule's label (0 where it has none)."""
        if not found:
            return np.zeros(0)
        if self.forest is None:
            return np.array([float(rule_label(c) == 1) for c in found])
        return forest_scores(self.forest, np.array([feature_row(c, self.language) for c in found]))


def labelled_findings(docs: DataFrame, language: Language, text: str = "text") -> DataFrame:
    """(label, order, features) of all candidates that the rules can label; ``order`` is a hash of the finding.

    Label 2 is for plain short values of other names, which teach as label 0 does but are drawn apart from it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                rows = [(rule_label(c), c) for c in candidates(block, others=True)]
                rows = [(y, c) for y, c in rows if y is not None]
                order = [int.from_bytes(hashlib.md5(f"{c.value}|{c.before}".encode()).digest()[:7], "big") for _, c in rows]
                columns = [pa.array([y for y, _ in rows], pa.int32()), pa.array(order, pa.int64()), pa.array([feature_row(c, shared.value) for _, c in rows], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "order", "features"])

    return docs.select(F.col(quoted(text)).cast("string").alias("text")).mapInArrow(run, "label int, order bigint, features array<double>")


def fit_scanner(docs: DataFrame, text: str = "text", learn: Column | None = None, findings: DataFrame | None = None, per_class: int = PER_CLASS) -> Scanner:
    """Learn ordinary words from all texts and the forest from at most ``per_class`` labelled findings of each class.

    ``findings`` (label, order, features) may come from reviewers; by default the rules label the findings of the rows
    with ``learn``. Different findings are drawn in the order of their hashes. With one class only there is no forest.
    """
    language = learn_language(docs, text)
    rows = findings if findings is not None else labelled_findings(docs if learn is None else docs.where(learn), language, text)
    drawn = [rows.where(F.col("label") == k).groupBy("order").agg(F.min("features").alias("features")).orderBy("order").limit(per_class).collect() for k in (0, 2, 1)]
    if not (drawn[0] or drawn[1]) or not drawn[2]:
        return Scanner(language, None)
    x = np.array([r["features"] for part in drawn for r in part])
    return Scanner(language, fit_forest(x, np.repeat([0, 0, 1], [len(part) for part in drawn])))


def scan_secrets(docs: DataFrame, scanner: Scanner, text: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``findings``, all candidates of the whole text, and ``redacted``, the text without its secrets.

    A finding has ``start`` and ``end`` in code points, the forest's ``score``, ``secret`` (score at least ``threshold``)
    and the ``sha256`` of its value. In ``redacted`` each secret is replaced by ``[secret]``, overlapping ones by one. NULL texts have
    no findings and stay NULL; repeated rows are scanned each. One narrow pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    fields = "findings array<struct<start:bigint,end:bigint,score:double,secret:boolean,sha256:string>>, redacted string"

    def start() -> Callable[[pa.Array], list]:
        def work(column: pa.Array) -> list:
            texts = column.to_pylist()
            found: list[list[dict]] = [[] for _ in texts]
            for block in blocks(column):
                hits = candidates(block)
                for c, score in zip(hits, shared.value.scores(hits).tolist()):
                    raw = texts[block.low + c.text].encode()
                    a, b = len(raw[: c.begin].decode()), len(c.value)
                    found[block.low + c.text].append({"start": a, "end": a + b, "score": score, "secret": score >= threshold, "sha256": hashlib.sha256(c.value.encode()).hexdigest()})
            redacted = []
            for t, own in zip(texts, found):
                spans: list[list[int]] = []
                for f in own:
                    if f["secret"]:
                        if spans and f["start"] < spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], f["end"])
                        else:
                            spans.append([f["start"], f["end"]])
                for a, b in reversed(spans):
                    t = t[:a] + "[secret]" + t[b:]
                redacted.append(t)
            return [found, redacted]

        return work

    return with_text_columns(docs, text, fields, start, keep)


def finding_rows(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per candidate of :func:`scan_secrets`."""
    each = scanned.select(F.col(quoted(doc_id)).alias("doc_id"), F.explode("findings").alias("f"))
    return each.select("doc_id", F.col("f.start").alias("start_char"), F.col("f.end").alias("end_char"), "f.score", F.col("f.secret").alias("is_secret"), "f.sha256")

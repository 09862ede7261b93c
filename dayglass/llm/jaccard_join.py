"""Exact similarity join of documents on word shingles with PartEnum signatures.

A set of shingles is a vertex, named by a 64-bit hash of the set, so that copies are one vertex. Sets meet when
their sizes lie in the same or in neighbouring bands. For a pair of bands the features (shingle hashes) are dealt into
groups and each group into a few parts; a signature names a group, leaves out one part of it, and hashes what the set
has in the others. Two sets of enough similarity differ in few features. A group in which a set has features in two
parts is lost to two differences only, one with features in a single part to one difference. So if these losses sum
up to more than the differences that similar sets may have, one signature with a feature in it is shared.

What keeps signatures from being shared by chance: features that many documents have do not count as features
in that sum, and signatures made of them alone are left out. A set for which the sum is then too small ("poor")
goes on to a second level, which counts every feature, and if it is poor there too, to a third that leaves out nothing.
A pair of similar sets meets on the first level on which one of the two is not poor, or on the third. Which features
are frequent changes the work and never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.llm.frames import give_back, quoted
from dayglass.llm.textkit import blocks, distinct_per_text, mix, shingle_hashes, split_words, word_hashes
from dayglass.operators.joins import HOT_KEYS, lookup_join
from dayglass.session import cut_lineage

WIDTH, PERCENT = 5, 75
#: Features per group at the upper end of a band; up to this size a group has three parts, beyond it two.
GROUP, SMALL = 5.2, 64
#: Share of the documents from which a feature is frequent, and most features that are held to be so.
FREQUENT, MOST_FREQUENT = 0.002, 1 << 19
#: Features that a task holds before it counts them.
HELD = 1 << 22
#: Vertices in one row of a run; longer runs take several rows. Runs of up to SHORT_RUN give all their pairs.
RUN_ROW, SHORT_RUN = 4096, 16
#: Of the long runs of a vertex, how many it names so that a pair is given out in one run only.
NAMED_RUNS = 16
#: Links that one task draws together.
LINKS = 1 << 18
#: Bits of the filter that spares documents outside all candidates the way to the comparison.
FILTER_BITS = 1 << 24


def band_limits(percent: int = PERCENT) -> list[int]:
    """Smallest sizes of the bands; sets of enough similarity lie in the same or in neighbouring bands."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // percent + 1)
    return low


def most_differences(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT):
    """Most features in which sets of sizes ``a`` and ``b`` differ when 100 * common >= percent * union."""
    return (100 - percent) * (a + b) // (100 + percent)


class ShingleSets:
    """Sorted distinct shingle hashes of the texts of one block: text i has ``values[first[i]:first[i + 1]]``."""

    def __init__(self, block, width: int):
        words = split_words(block)
        self.values, self.first = distinct_per_text(*shingle_hashes(word_hashes(words), words.first, width))
        self.sizes = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.keys = self._sums(mix(self.values + np.uint64(0x632BE59BD9B4E019)))

    def _sums(self, x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64)))
        return mix(total[self.first[1:]] - total[self.first[:-1]] + self.sizes.astype(np.uint64)).view(np.int64)


def parity_bits(values: np.ndarray) -> bytes:
    """About two bits per feature; each feature flips one. Two sets differ in no fewer features than bits."""
    size = 64
    while size < 2 * len(values):
        size *= 2
    return _fold(np.bincount((values >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1)


def _fold(bits: np.ndarray) -> bytes:
    return np.packbits(bits.astype(np.uint8)).tobytes()


def least_differences(a: bytes, b: bytes) -> int:
    """A lower limit of the differences of two sets, from their parity bits; the longer is folded to the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def set_signatures(sets: ShingleSets, frequent: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) rows of a block, all levels."""
    low = np.array(band_limits(percent))
    band = np.searchsorted(low, np.maximum(sets.sizes, 1), "right") - 1
    at = np.minimum(np.searchsorted(frequent, sets.values), max(len(frequent) - 1, 0))
    rare = frequent[at] != sets.values if len(frequent) else np.ones(len(sets.values), bool)
    texts, signatures = [], []
    # As the smaller set of a pair of bands, and as a set of the upper band.
    for instance in (band, band - 1):
        here = np.flatnonzero((sets.sizes > 0) & (instance >= 0))
        for level in range(3):
            if not len(here):
                break
            text, signature, poor = _one_level(sets, here, instance, low, level, rare, percent)
            texts.append(text)
            signatures.append(signature)
            here = np.flatnonzero(poor)
    return np.concatenate(texts or [np.zeros(0, np.int64)]), np.concatenate(signatures or [np.zeros(0, np.uint64)])


def _one_level(sets, here, instance, low, level, rare, percent):
    top = low[instance[here] + 1] - 1
    sizes = sets.sizes[here]
    # In its own band a set may meet larger ones; in the band below its partners have at most the size ``top``.
    partner = np.where(sizes <= top, sizes * 100 // percent, top)
    allowed = most_differences(sizes, partner, percent)
    here, sizes, top, allowed = (x[allowed > 0] for x in (here, sizes, top, allowed))  # equal sets are one vertex
    if not len(here):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(sets.sizes), bool)
    parts = np.where(top <= SMALL, 3, 2)
    groups = np.maximum(1, np.ceil(top / GROUP).astype(np.int64))
    base = np.concatenate(([0], np.cumsum(groups)))
    number = np.full(len(sets.sizes), -1)
    number[here] = np.arange(len(here))
    own = number[sets.owner]
    inside = np.flatnonzero(own >= 0)
    own, values = own[inside], sets.values[inside]
    spread = mix(values + (instance[here] * 8 + level + 1).astype(np.uint64)[own] * np.uint64(0xC2B2AE3D27D4EB4F))
    group = (spread >> np.uint64(32)) % groups.astype(np.uint64)[own]
    part = (spread & np.uint64(0xFFFFFFFF)) % parts.astype(np.uint64)[own]
    cell = (base[own] + group.astype(np.int64)) * 3 + part.astype(np.int64)
    sums = np.zeros(base[-1] * 3, np.uint64)
    np.add.at(sums, cell, mix(spread))
    counted = cell if level else cell[rare[inside]]
    filled = (np.bincount(counted, minlength=len(sums)) > 0).reshape(-1, 3)
    sums = sums.reshape(-1, 3)
    losses = np.add.reduceat(np.minimum(filled.sum(axis=1), 2), base[:-1])
    poor_here = losses <= allowed
    owner = np.repeat(np.arange(len(here)), groups)
    texts, signatures = [], []
    order = np.arange(base[-1]) - base[:-1][owner]
    for left_out in range(3):
        chosen = left_out < parts[owner]
        if level < 2:
            chosen = chosen & (np.delete(filled, left_out, axis=1).any(axis=1))
        rows = np.flatnonzero(chosen)
        rest = sums[rows].sum(axis=1, dtype=np.uint64) - sums[rows, left_out]
        name = ((instance[here][owner[rows]] * 8 + level) * 4 + left_out).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD) + order[rows].astype(np.uint64)
        texts.append(here[owner[rows]])
        signatures.append(mix(rest + mix(name)))
    poor = np.zeros(len(sets.sizes), bool)
    poor[here[poor_here]] = True
    return np.concatenate(texts), np.concatenate(signatures), poor


def _keyed(text: str) -> list:
    """A 64-bit key of the text and the text."""
    return [F.xxhash64(F.col(quoted(text)).cast("string")).alias("text_key"), F.col(quoted(text)).cast("string").alias("text")]


def _vertices(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, text_key, vertex, n, bits) per document; and per task, and per HELD features of it, one row without n that lists its frequent features."""
    source = docs.select(F.col(quoted(doc_id)).alias("doc_id"), *_keyed(text))
    fields = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_key bigint, vertex bigint, n bigint, bits binary, frequent array<bigint>, counts array<bigint>, seen bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        features: list[np.ndarray] = []
        kind, held = None, 0

        def counted() -> pa.RecordBatch:
            nonlocal held
            every = np.concatenate(features)
            every.sort()
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            count = np.diff(np.append(first, len(every)))
            often = count >= max(3, FREQUENT * len(met))
            value = every[first[often]]
            one = [pa.nulls(1, kind), *(pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (value.view(np.int64), count[often])]
            made = pa.RecordBatch.from_arrays([*one, *lists, pa.array([len(met)], pa.int64())], names=_VERTEX_NAMES)
            features.clear()
            met.clear()
            held = 0
            return made

        for batch in batches:
            kind = batch.column(0).type
            for block in blocks(batch.column(2)):
                sets = ShingleSets(block, width)
                own = [sets.values[a:b] for a, b in zip(sets.first[:-1].tolist(), sets.first[1:].tolist())]
                for key, values in zip(sets.keys.tolist(), own):
                    if len(values) and key not in met:
                        met.add(key)
                        features.append(values)
                        held += len(values)
                rows = block.high - block.low
                none = pa.nulls(rows, pa.list_(pa.int64()))
                columns = [
                    batch.column(0).slice(block.low, rows),
                    batch.column(1).slice(block.low, rows),
                    pa.array(sets.keys, pa.int64(), mask=sets.sizes == 0),
                    pa.array(sets.sizes, pa.int64()),
                    pa.array([parity_bits(v) for v in own], pa.binary()),
                    none,
                    none,
                    pa.nulls(rows, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_VERTEX_NAMES)
                if held > HELD:
                    yield counted()
        if features:
            yield counted()
        give_back()

    return source.mapInArrow(run, fields)


_VERTEX_NAMES = ["doc_id", "text_key", "vertex", "n", "bits", "frequent", "counts", "seen"]


def _frequent_features(stored: DataFrame) -> np.ndarray:
    """Features that the tasks found often, by their summed counts; at most MOST_FREQUENT."""
    lists = stored.where("n IS NULL")
    seen = lists.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    each = lists.select(F.explode(F.arrays_zip("frequent", "counts")).alias("x"))
    sums = each.groupBy(F.col("x.frequent").alias("feature")).agg(F.sum("x.counts").alias("n"))
    often = sums.where(F.col("n") >= max(3, FREQUENT * seen / 2)).orderBy(F.col("n").desc(), "feature").limit(MOST_FREQUENT)
    return np.sort(often.select("feature").toArrow()["feature"].to_numpy().view(np.uint64))


def _runs(docs: DataFrame, text: str, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(run, chunk, vertices): vertices that share a signature, for each signature of several vertices.

    Runs of the same vertices are kept once. A long run takes several rows. One shuffle of the signatures.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent)

    def enumerate_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for block in blocks(batch.column(0)):
                sets = ShingleSets(block, width)
                owner, signature = set_signatures(sets, known.value, percent)
                order = np.argsort(owner, kind="stable")
                owner, signature = owner[order], signature[order].view(np.int64)
                first = np.searchsorted(owner, np.arange(len(sets.sizes) + 1))
                fresh = [i for i, k in enumerate(sets.keys.tolist()) if first[i] < first[i + 1] and not (k in met or met.add(k))]
                lists = [signature[first[i] : first[i + 1]] for i in fresh]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
                columns = [pa.array(sets.keys[fresh], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(columns, names=["vertex", "signatures"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        rows: list[tuple[int, int, np.ndarray]] = []
        signature, chunk, held = None, 0, np.zeros(0, np.int64)

        def close(last: bool) -> None:
            """Give out what is held of the current signature."""
            nonlocal chunk
            if last and not chunk:
                if len(held) > 1:
                    name = int(mix(np.array([np.bitwise_xor.reduce(mix(held.view(np.uint64)))]) + np.uint64(len(held))).view(np.int64)[0])
                    if name not in met:
                        met.add(name)
                        rows.append((name, 0, held))
            elif len(held):
                rows.append((signature, chunk, held))
                chunk += 1

        def made() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["run", "chunk", "vertices"])

        for batch in batches:
            s, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(s):
                continue
            new = np.concatenate(([True], s[1:] != s[:-1]))
            begin = np.flatnonzero(new)
            # Only runs of several rows, and those at the ends of the batch, are looked at one by one.
            size = np.diff(np.concatenate((begin, [len(s)])))
            edge = (begin == 0) | (begin + size == len(s))
            two = begin[(size == 2) & ~edge]
            two = two[v[two] != v[two + 1]]
            names = mix((mix(v[two].view(np.uint64)) ^ mix(v[two + 1].view(np.uint64))) + np.uint64(2)).view(np.int64)
            for name, a in zip(names.tolist(), two.tolist()):
                if name not in met:
                    met.add(name)
                    rows.append((name, 0, v[a : a + 2]))
            look = np.flatnonzero((size > 2) | edge)
            for a, n in zip(begin[look].tolist(), size[look].tolist()):
                part = v[a : a + n]
                part = part[np.concatenate(([True], part[1:] != part[:-1]))]
                if s[a] != signature:
                    close(True)
                    signature, chunk, held = s[a], 0, part
                else:
                    held = np.concatenate((held, part if part[0] != held[-1] else part[1:])) if len(held) else part
                while len(held) > RUN_ROW:
                    whole, held = held, held[:RUN_ROW]
                    close(False)
                    held = whole[RUN_ROW:]
            if len(rows) > 1000:
                yield made()
        close(True)
        if rows:
            yield made()

    each = docs.select(F.col(quoted(text)).cast("string").alias("text")).mapInArrow(enumerate_sets, "vertex bigint, signatures array<bigint>")
    pairs = each.select(F.explode("signatures").alias("signature"), "vertex")
    dealt = pairs.repartition("signature").sortWithinPartitions("signature", "vertex")
    return dealt.mapInArrow(gather, "run bigint, chunk int, vertices array<bigint>").dropDuplicates(["run", "chunk"])


def _near_enough(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that sizes and parity bits do not rule out, with the differences that the bits show."""
    a = info.select(F.col("vertex").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    b = info.select(F.col("vertex").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, na, nb, bits_a, bits_b = (c.to_pylist() for c in batch.columns)
            rows = []
            for i in range(len(x)):
                if 100 * min(na[i], nb[i]) >= percent * max(na[i], nb[i]):
                    least = least_differences(bits_a[i], bits_b[i])
                    if least <= most_differences(na[i], nb[i], percent):
                        rows.append((x[i], y[i], least))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["a", "b", "least"])

    wide = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "bits_a", "bits_b")
    return wide.mapInArrow(run, "a bigint, b bigint, least bigint")


def _key_filter(keys: DataFrame) -> np.ndarray:
    """A bit map of FILTER_BITS bits, whatever the number of keys, with a bit set for each."""
    slot = F.pmod(F.col("text_key"), F.lit(FILTER_BITS))
    words = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for word, value in found:
        bits[word] = value
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def _linked(pairs: DataFrame, docs: DataFrame, vertices: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by comparing whole sets.

    Sets are made again, from one text of each vertex. A bit map of fixed size over the keys of these texts spares most
    others the work; the join that follows is exact.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().join(vertices.select("vertex", "text_key"), "vertex")
    wanted = cut_lineage(wanted)
    marks = docs.sparkSession.sparkContext.broadcast(_key_filter(wanted))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            _, first = np.unique(keys, return_index=True)
            hit = first[marks.value[keys[first] % FILTER_BITS]]
            for block in blocks(batch.column(1).take(pa.array(np.sort(hit)))):
                sets = ShingleSets(block, width)
                keys = sets.keys.tolist()
                fresh = [i for i in range(len(keys)) if sets.sizes[i] and not (keys[i] in met or met.add(keys[i]))]
                columns = [pa.array([keys[i] for i in fresh], pa.int64()), pa.array([sets.values[sets.first[i] : sets.first[i + 1]].tobytes() for i in fresh], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["vertex", "features"])
        give_back()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in (2, 3))
                both = len(x) + len(y) - len(np.union1d(x, y))
                kept.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in range(2)], names=["a", "b"])

    made = docs.select(*_keyed(text)).mapInArrow(sets_of, "vertex bigint, features binary")
    sets = cut_lineage(made.join(wanted, "vertex", "left_semi").dropDuplicates(["vertex"]))
    wide = pairs.join(sets.withColumnsRenamed({"vertex": "a", "features": "fa"}), "a").join(sets.withColumnsRenamed({"vertex": "b", "features": "fb"}), "b")
    return wide.select("a", "b", "fa", "fb").mapInArrow(compare, "a bigint, b bigint")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex that these links lead to) for all others than the smallest ones."""
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(names))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            lower = np.flatnonzero(label != np.arange(len(names)))
            return names[lower], names[label[lower]]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def components(links: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex that the links (a, b) lead to, for every vertex that has a link.

    The links are dealt into parts of LINKS and each part is drawn together to stars, which one task holds; with several parts, rounds
    follow. Each round takes the smallest label among the neighbours and then the label of that label; one written table a round.
    """
    links = cut_lineage(links)
    parts = max(1, -(-links.count() // LINKS))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if held:
            vertex, component = _stars(*(np.concatenate(c) for c in zip(*held)))
            if parts == 1:
                tops = np.unique(component)
                vertex, component = np.concatenate((vertex, tops)), np.concatenate((component, tops))
            yield pa.RecordBatch.from_arrays([pa.array(vertex), pa.array(component)], names=["a", "b"])

    stars = links.where("a != b").select("a", "b").repartition(parts).mapInArrow(draw, "a bigint, b bigint")
    if parts == 1:
        return cut_lineage(stars.withColumnsRenamed({"a": "vertex", "b": "component"}))
    both = cut_lineage(stars.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.col("vertex"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("vertex", "b"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("component").alias("nearby"))
        lower = labels.join(near, "vertex").select("vertex", F.col("component").alias("old"), F.least("component", "nearby").alias("label"))
        jump = labels.select(F.col("vertex").alias("label"), F.col("component").alias("further"))
        moved = lower.join(jump, "label").select("vertex", F.least("label", "further").alias("component"), "old")
        labels = cut_lineage(moved)
        if labels.where("old != component").isEmpty():
            return labels.select("vertex", "component")


def _short_run_pairs(runs: DataFrame) -> DataFrame:
    """All pairs (a, b) of runs of at most SHORT_RUN vertices: at most SHORT_RUN / 2 for each of their vertices."""
    each = F.transform(
        "vertices",
        lambda x, i: F.transform(F.slice("vertices", i + 2, SHORT_RUN), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))),
    )
    return runs.where((F.col("chunk") == 0) & (F.size("vertices") <= SHORT_RUN)).select(F.explode(F.flatten(each)).alias("p")).select("p.*").distinct()


class _Block:
    """Vertices of one block (rows of :func:`_block_pairs`), in the order of their sizes."""

    def __init__(self, rows: list[tuple], percent: int):
        self.rows, self.percent = sorted(rows, key=lambda r: r[6]), percent
        self.chunk, self.vertex, self.component, self.n = (np.array([r[k] for r in self.rows]) for k in (3, 4, 5, 6))
        self.crossing = self.rows[0][1] != self.rows[0][2]
        bits = [np.frombuffer(r[7], np.uint8) for r in self.rows]
        self.width = np.array([len(b) for b in bits])
        #: By width: the vertices whose bits are at least as long, and their bits folded to it.
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in np.unique(self.width).tolist():
            there = np.flatnonzero(self.width >= width)
            self.folded[width] = there, np.stack([np.bitwise_xor.reduce(bits[t].reshape(-1, width), axis=0) for t in there]).view(np.uint64)

    def near(self, a: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the vertices with ``wanted``, those of other components that may be similar to ``a``, and their least differences."""
        able = wanted & (self.component != self.component[a]) & (100 * np.minimum(self.n, self.n[a]) >= self.percent * np.maximum(self.n, self.n[a]))
        if self.crossing:
            able &= self.chunk != self.chunk[a]
        ends, least = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width, (there, folded) in self.folded.items():
            # The longer bits are folded to the shorter: all that are as long as those of a or longer, or those of one shorter width.
            if width <= self.width[a]:
                k = np.flatnonzero(able[there] & ((self.width[there] == width) | (width == self.width[a])))
                if len(k):
                    ends.append(there[k])
                    least.append(np.bitwise_count(folded[k] ^ folded[np.searchsorted(there, a)]).sum(axis=1).astype(np.int64))
        b, d = np.concatenate(ends), np.concatenate(least)
        close = d <= most_differences(self.n[a], self.n[b], self.percent)
        return b[close], d[close]


def _nearest_tree(block: _Block) -> Iterator[list[tuple[int, int, int]]]:
    """The pairs (a, b, least differences) of a smallest spanning forest of the block's components (Prim's method).

    So one comparison of whole sets may link all of a block, where the nearest pair of each vertex would link a part.
    """
    total, far = len(block.rows), np.iinfo(np.int64).max
    best, partner, free = np.full(total, far), np.full(total, -1), np.ones(total, bool)
    found = []
    for _ in range(total):
        a = int(np.where(free, best, far).argmin())
        if not free[a]:
            a = int(free.argmax())
        free[a] = False
        if 0 <= best[a] < far:
            x, y = int(block.vertex[a]), int(block.vertex[partner[a]])
            found.append((min(x, y), max(x, y), int(best[a])))
        # The rest of its component comes next, without a pair.
        best[free & (block.component == block.component[a])] = -1
        b, least = block.near(a, free)
        closer = least < best[b]
        best[b[closer]], partner[b[closer]] = least[closer], a
    yield found


def _all_pairs(block: _Block) -> Iterator[list[tuple[int, int, int]]]:
    """All pairs (a, b, least differences) of the block whose vertices lie in different components and may be similar."""
    rows, later = block.rows, np.ones(len(block.rows), bool)
    named = [frozenset(r[8]) for r in rows]
    found: list[tuple[int, int, int]] = []
    for a in range(len(rows)):
        later[a] = False
        for j, d in zip(*(x.tolist() for x in block.near(a, later))):
            # The first run that both name; without one the pair comes out in each of its runs.
            shared = named[a] & named[j]
            if not shared or min(shared) == rows[a][0]:
                found.append((min(rows[a][4], rows[j][4]), max(rows[a][4], rows[j][4]), d))
        if len(found) > 1 << 16:
            yield found
            found = []
    yield found


def _long_runs(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the runs of more than SHORT_RUN vertices, and (run, chunk, vertex) of their members."""
    long = runs.where((F.col("chunk") > 0) | (F.size("vertices") > SHORT_RUN))
    return long, long.select("run", "chunk", F.explode("vertices").alias("vertex"))


def _longest_runs(runs: DataFrame, info: DataFrame) -> DataFrame:
    """(run, chunk, vertex, n, bits): each vertex in the longest of its long runs."""
    long, members = _long_runs(runs)
    sizes = long.groupBy("run").agg(F.sum(F.size("vertices")).alias("size"))
    own = members.join(sizes, "run").groupBy("vertex").agg(F.max(F.struct("size", "run", "chunk")).alias("own"))
    return own.select("vertex", "own.run", "own.chunk").join(info.select("vertex", "n", "bits"), "vertex").select("run", "chunk", "vertex", "n", "bits")


def _mixed(members: DataFrame, label: DataFrame | None) -> DataFrame:
    """The members of runs that hold several components, with ``component`` and ``last``, the last row of the run."""
    if label is None:
        members = members.withColumn("component", F.col("vertex"))
    else:
        members = members.join(label, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    mixed = members.groupBy("run").agg(F.max("chunk").alias("last"), F.min("component").alias("low"), F.max("component").alias("high"))
    return members.join(mixed.where("low != high").select("run", "last"), "run")


def _nearest_pairs(longest: DataFrame, label: DataFrame | None, percent: int) -> DataFrame:
    """Pairs (a, b) of a spanning forest by nearest pairs of the components in each block of the runs of :func:`_longest_runs`.

    Without ``label`` every vertex is a component.
    """
    return _block_pairs(_mixed(longest, label).withColumn("named", F.array().cast("array<bigint>")), percent, _nearest_tree)


def _long_run_pairs(runs: DataFrame, label: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of runs of more than SHORT_RUN vertices between different components that may be similar."""
    members = cut_lineage(_mixed(_long_runs(runs)[1], label))
    named = members.groupBy("vertex").agg(F.slice(F.array_sort(F.collect_set("run")), 1, NAMED_RUNS).alias("named"))
    return _block_pairs(members.join(info.select("vertex", "n", "bits").join(named, "vertex"), "vertex"), percent, _all_pairs)


def _block_pairs(members: DataFrame, percent: int, pairs_of: Callable) -> DataFrame:
    """The pairs (a, b) that ``pairs_of`` finds in the blocks of runs. A block has two rows of a run and is looked at in one task."""
    placed = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = placed.select("run", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "vertex", "component", "n", "bits", "named")
    dealt = rows.repartition("run", "i", "j").sortWithinPartitions("run", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        held: list[tuple] = []

        def made() -> Iterator[pa.RecordBatch]:
            for found in pairs_of(_Block(held, percent)) if len(held) > 1 else ():
                fresh = list({p[:2] for p in found} - met)
                if len(met) > 1 << 20:
                    met.clear()
                met.update(fresh)
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in fresh], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    yield from made()
                    held = []
                held.append(row)
        if held:
            yield from made()

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, least) the one of each vertex with the fewest differences."""
    ends = F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))
    each = pairs.select("least", F.explode(ends).alias("x")).groupBy("x.v").agg(F.min(F.struct("least", "x.w")).alias("best"))
    return each.select(F.least("v", "best.w").alias("a"), F.greatest("v", "best.w").alias("b")).distinct()


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) whose vertices are not yet in one component."""
    for side in ("a", "b"):
        own = label.select(F.col("vertex").alias(side), F.col("component").alias(f"component_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"component_{side}", F.coalesce(f"component_{side}", side))
    return pairs.where("component_a != component_b").select("a", "b")


def _as_links(label: DataFrame) -> DataFrame:
    return label.select(F.col("vertex").alias("a"), F.col("component").alias("b"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest id that links lead to (itself included).

    A document's set has its distinct runs of ``width`` words (A-Z lower-cased); of fewer words the whole sequence is
    one; NULL and texts without words have an empty set, no links and their own id. Two documents link when
    100 * common >= percent * union. Repeated rows and copies are one vertex; NULL ids do not count as smallest
    unless nothing else is there. Sets and shingles are told apart by 64-bit hashes.

    Order of work: copies fall together; signatures give runs of vertices; parity bits, which can only rule out, thin
    their pairs; each vertex is compared by whole sets with the nearest of its pairs, then again and again with the nearest of
    another component while that finds links, so that large groups of near copies fall together first; then all pairs whose
    vertices are still in different components are. No link between different components is left out.
    """
    stored = cut_lineage(_vertices(docs, doc_id, text, width))
    info = stored.where("n IS NOT NULL").select("doc_id", "text_key", "vertex", "n", "bits")
    vertices = cut_lineage(info.where("n > 0").groupBy("vertex").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("text_key").alias("text_key"), F.min("n").alias("n"), F.min("bits").alias("bits")))
    runs = cut_lineage(_runs(docs, text, width, percent, _frequent_features(stored)))

    short = cut_lineage(_near_enough(_short_run_pairs(runs), vertices, percent))
    longest = cut_lineage(_longest_runs(runs, vertices))
    tried = cut_lineage(_nearest(short).union(_nearest_pairs(longest, None, percent)).distinct())
    label = components(_linked(tried, docs, vertices, text, width, percent))
    while True:
        near = cut_lineage(_nearest_pairs(longest, label, percent).join(tried, ["a", "b"], "left_anti"))
        if near.isEmpty():
            break
        found = cut_lineage(_linked(near, docs, vertices, text, width, percent))
        tried = cut_lineage(tried.union(near))
        if found.isEmpty():
            break
        label = components(_as_links(label).union(found))
    # What blocks give lies in different components.
    rest = _apart(short, label).union(_long_run_pairs(runs, label, vertices, percent))
    rest = cut_lineage(rest.distinct().join(tried, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        label = components(_as_links(label).union(_linked(rest, docs, vertices, text, width, percent)))

    named = label.join(vertices.select("vertex", "first"), "vertex")
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    moved = label.join(smallest, "component").select("vertex", "smallest")
    final = vertices.join(moved, "vertex", "left").select("vertex", F.coalesce("smallest", "first").alias("component_id"))
    hot = [r[0] for r in vertices.orderBy(F.col("copies").desc()).limit(HOT_KEYS).select("vertex").collect()]
    rows = info.select("doc_id", "vertex", "n")
    joined = lookup_join(rows, final, "vertex", hot, "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))

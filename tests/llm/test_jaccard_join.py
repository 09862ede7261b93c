import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from dayglass.llm import jaccard_join as jj
from dayglass.llm.textkit import blocks
from odd_rows import ODD


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def set_of(text):
    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows):
    sets = [set_of(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            group[find(i)] = find(j)
    smallest = {}
    for i, (name, _) in enumerate(rows):
        if sets[i] and name is not None:
            smallest[find(i)] = min(name, smallest.get(find(i), name))
    return sorted(str((name, len(sets[i]), smallest.get(find(i)) if sets[i] else name)) for i, (name, _) in enumerate(rows))


def varied(seed, n, length, changes):
    """Texts around a few bases, with about ``changes`` of the words replaced."""
    rng = random.Random(seed)
    bases = [[f"b{b}w{i}" for i in range(length)] for b in range(4)]
    shared = [f"s{i}" for i in range(12)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append((i * 3 % 1009, " ".join(w[: rng.randint(max(1, length - 4), length)] + shared * rng.randint(0, 1))))
    return out


@pytest.mark.parametrize(("length", "changes"), [(1, 0), (4, 1), (9, 1), (14, 2), (60, 4), (300, 12)])
def test_against_all_pairs(spark, frame, length, changes):
    rows = varied(length, 120, length, changes)
    got = sorted(str(tuple(r)) for r in jj.jaccard_components(frame(rows)).collect())
    assert got == expected(rows)


def test_long_runs_in_several_rows(spark, frame, monkeypatch):
    monkeypatch.setattr(jj, "RUN_ROW", 7)
    monkeypatch.setattr(jj, "SHORT_RUN", 3)
    rows = varied(5, 90, 60, 4)
    got = sorted(str(tuple(r)) for r in jj.jaccard_components(frame(rows)).collect())
    assert got == expected(rows)


@pytest.mark.parametrize(("links", "tables"), [(1 << 18, 2), (40, 99)])
def test_long_chains_fall_together_in_few_written_tables(spark, monkeypatch, links, tables):
    written = []
    cut = jj.cut_lineage
    monkeypatch.setattr(jj, "cut_lineage", lambda df: written.append(1) or cut(df))
    monkeypatch.setattr(jj, "LINKS", links, raising=False)
    names = list(range(10, 170))
    random.Random(3).shuffle(names)
    chains = [names[:100], names[100:150], names[150:]]
    pairs = [(a, b) for chain in chains for a, b in zip(chain, chain[1:])] + [(5, 5)]
    random.Random(4).shuffle(pairs)
    got = {r[0]: r[1] for r in jj.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    got.pop(5, None)
    assert got == {v: min(chain) for chain in chains for v in chain}
    assert len(written) <= tables


def test_odd_rows(spark, frame):
    got = sorted(str(tuple(r)) for r in jj.jaccard_components(frame(ODD)).collect())
    assert got == expected(ODD)
    assert jj.jaccard_components(frame([])).count() == 0
    assert jj.jaccard_components(frame([(1, None), (2, "")])).count() == 2


@pytest.mark.parametrize("size", [3, 4, 5, 9, 20, 64, 65, 300])
@pytest.mark.parametrize("share_frequent", [0.0, 0.5, 1.0])
def test_similar_sets_share_a_signature(size, share_frequent):
    rng = random.Random(size)
    base = [f"w{i}" for i in range(size + 4)]
    texts = [" ".join(base)]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, max(1, size // 30))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(w[: rng.randint(len(w) - max(1, size // 6), len(w))]))
    block = next(iter(blocks(pa.array(texts))))
    sets = jj.ShingleSets(block, 5)
    common = np.unique(sets.values[: sets.first[1]])
    frequent = common[: int(len(common) * share_frequent)]
    text, signature = jj.set_signatures(sets, frequent)
    own = [set(signature[text == i].tolist()) for i in range(len(texts))]
    whole = [set(sets.values[a:b].tolist()) for a, b in zip(sets.first[:-1], sets.first[1:])]
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(whole[i] & whole[j])
        if whole[i] != whole[j] and 100 * both >= 75 * len(whole[i] | whole[j]):
            assert own[i] & own[j]


def test_parity_bits_only_rule_out():
    rng = np.random.default_rng(1)
    for n, m in ((5, 5), (40, 300), (1000, 900)):
        common = rng.integers(0, 2**63, min(n, m) // 2, dtype=np.uint64)
        a = np.unique(np.concatenate((common, rng.integers(0, 2**63, n, dtype=np.uint64))))
        b = np.unique(np.concatenate((common, rng.integers(0, 2**63, m, dtype=np.uint64))))
        assert jj.least_differences(jj.parity_bits(a), jj.parity_bits(b)) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("crossing", [False, True])
def test_a_block_of_near_copies_gives_pairs_that_lead_to_all(crossing):
    rng = np.random.default_rng(6)
    base = rng.integers(1, 2**63, 300, dtype=np.uint64)
    rows = []
    for v in range(60):
        own = np.concatenate((base[: 300 - v % 7], rng.integers(1, 2**63, 3 + v % 5, dtype=np.uint64)))
        rows.append((7, 0, int(crossing), v % 2 if crossing else 0, v, v // 2 * 2 if v < 20 else v, len(own), jj.parity_bits(own), [7]))
    block = jj._Block(rows, 75)
    found = [p for part in jj._nearest_tree(block) for p in part]
    of = {r[4]: r[5] for r in rows}
    group = {c: c for c in of.values()}
    for a, b, least in found:
        x, y = group[of[a]], group[of[b]]
        assert x != y and least == jj.least_differences(rows[a][7], rows[b][7])
        group = {c: x if g == y else g for c, g in group.items()}
    assert len(set(group.values())) == 1 and len(found) == 49
    every = [p for part in jj._all_pairs(block) for p in part]
    want = {(a, b) for a in of for b in of if a < b and of[a] != of[b] and (not crossing or a % 2 != b % 2)}
    assert {p[:2] for p in every} == want and len(every) == len(want)

import hashlib
import random
import zlib

import pytest

from dayglass.llm.prefix_trie import conversation_paths, prefix_nodes, turn_ids

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, head string, burst int"


def conversations_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def turn_key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32] + f"{len(text):08x}"


def expected(rows, spliced=True):
    own = {}
    for c, turn, role, text in rows:
        own.setdefault(c, []).append(((turn is not None, turn or 0), turn_key(role, text), role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(("" if c is None else str(c)).encode()) % 6 if spliced else 0
        base = [] if c is None else own.get(c - int(abs(c) % 100 * (1 if c > 0 else -1)), [])
        rebuilt[c] = base[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)

    def least(convs):
        return min((c for c in convs if c is not None), default=None)

    total = {p: [0, 0, 0] for p in members}  # children, leaves, saved
    parents = {p[:-1] for p in members if p}
    for p, convs in members.items():
        for d in range(len(p) + 1):
            total[p[:d]][1] += p not in parents
            total[p[:d]][2] += (len(convs) - 1) * (len(p[-1][1]) if p else 0)
        if p:
            total[p[:-1]][0] += 1
    made = []
    for p, convs in members.items():
        ends = sorted((c for c in convs if rebuilt[c] == list(p)), key=lambda c: (c is None, c or 0))
        digest = hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()
        made.append((least(convs), len(p), least(members[p[:-1]]) if p else None, len(convs), *total[p], digest))
    return sorted(map(repr, made))


def got(spark, rows, container, spliced=True):
    paths = conversation_paths(turn_ids(conversations_of(spark, rows)), 100 if spliced else None)
    return sorted(repr(tuple(r)) for r in prefix_nodes(paths, container).collect())


def drawn(seed, convs, words, longest):
    draw = random.Random(seed)
    rows = []
    for c in convs:
        rows += [(c, t, draw.choice(["user", "bot", None]), draw.choice(words)) for t in range(draw.randint(1, longest))]
    return rows


def odd_rows():
    rows = drawn(1, range(0, 700, 3), ["a", "bé", None, "", "c🙂" * 9], 7)
    rows += [(c, t, "user", "same") for c in range(1000, 1400) for t in range(7)]
    rows += [(None, 1, "u", "x"), (None, 0, None, None), (-5, 0, "u", "x"), (-105, None, "u", "y"), (-105, 3, "u", "z"), (-100, 0, "u", "w")]
    rows += [(50, None, "n", "null first"), (51, 0, "u", "tie"), (51, 0, "a", "tie"), (51, 0, "u", "tie"), (2 ** 40 + 7, 2, "u", "far")]
    rows += [(5000, t, "u", str(t)) for t in range(400)] + [(5001, t, "u", str(t % 399)) for t in range(400)]
    rows += [(9000, 0, "u", "12:ab"), (9100, 0, "u1", "2:ab"), (9200, 0, "", "u"), (9300, 0, "u", "")]
    return rows


@pytest.mark.parametrize("container", [2, 40, 100_000])
def test_against_all_prefixes(spark, container):
    rows = odd_rows() if container > 2 else [r for r in odd_rows() if r[0] not in (5000, 5001)]
    assert got(spark, rows, container) == expected(rows)


def test_unspliced_and_small_tables(spark):
    rows = drawn(2, range(300), ["a", "b"], 6)
    assert got(spark, rows, 4, False) == expected(rows, False)
    for rows in ([], [(7, 0, "u", "t")], [(102, 0, "u", "t")], [(c, 0, "u", "t") for c in range(500)]):
        assert got(spark, rows, 3) == expected(rows)


def test_a_very_long_text(spark):
    rows = [(c, t, "user", "é" * 1_200_000 if t == 1 else "q") for c in range(3) for t in range(3)]
    assert got(spark, rows, 512) == expected(rows)

import hashlib
import random

from odd_rows import ODD

from dayglass.llm import secrets


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("aeioustnr", k=rng.randint(3, 9)))
    rows, planted = [], {}
    for i in range(150):
        w = [word() for _ in range(60)]
        w.insert(20, word() + word() + word() + "aeiounaeioun")
        w.insert(30, "".join(rng.choices("0123456789", k=16)))
        if i % 3 == 0:
            value = "".join(rng.choices("0123456789abcdef", k=40))
            w.insert(rng.randrange(60), f'token = "{value}"')
            planted[i] = value
        elif i % 3 == 1:
            value = "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOP234567", k=16))
            w.insert(rng.randrange(60), value)
            planted[i] = value
        rows.append((i, "é " + " ".join(w)))
    return rows, planted


def test_planted_secrets(spark, frame):
    rows, planted = corpus()
    docs = frame(rows)
    scanner = secrets.fit_scanner(docs, learn=docs.doc_id % 2 == 0)
    scanned = secrets.scan_secrets(docs, scanner).collect()
    for r in scanned:
        own = [f for f in r.findings if f.secret]
        assert [r.text[f.start : f.end] for f in own] == ([planted[r.doc_id]] if r.doc_id in planted else [])
        assert all(f.sha256 == hashlib.sha256(r.text[f.start : f.end].encode()).hexdigest() for f in r.findings)
        assert len(r.findings) >= 2
        assert r.redacted == r.text.replace(planted.get(r.doc_id, "\0"), "[secret]")


def test_short_and_signed_values(spark, frame):
    rows, _ = corpus()
    values = ["Tr0ub4dor&3", "hunter2!Q", "a1", "pässw0rd.mit=zeichen$und!mehr.als.sechzehn"]
    rng = random.Random(5)
    for i in range(150):
        rows.append((1000 + i, f"note: word and pwd: '{''.join(rng.choices('abcdef', k=4))}{i}!x' then text"))
    texts = [f"é {name}{v} end" for v, name in zip(values, ("password=", "pwd: ", "token := ", "secret = "))]
    texts[1] = texts[1].replace(values[1], f"'{values[1]}'")
    docs = frame([*rows, *enumerate(texts, 5000)])
    scanned = secrets.scan_secrets(docs, secrets.fit_scanner(docs)).where("doc_id >= 5000").orderBy("doc_id").collect()
    for r, v in zip(scanned, values, strict=True):
        assert v in [r.text[f.start : f.end] for f in r.findings if f.secret]
        assert r.redacted == r.text.replace(v, "[secret]")


def test_values_of_one_kind_have_no_label():
    text = "password=abcdefghijklmnopqrst pwd=12345678901234567890 abcdefghijklmnopqrst"
    (block,) = secrets.blocks(secrets.pa.array([text]))
    assert [secrets.rule_label(c) for c in secrets.candidates(block)] == [None, None, 0]


def test_dictionary_is_that_of_all_texts_however_they_are_dealt(spark, frame):
    docs = frame([(i, f"each text has rare{'abcdefghij'[i % 10]} words") for i in range(40)])
    one, many = (secrets.learn_language(docs.repartition(n)) for n in (1, 40))
    assert one.words == many.words == {"each", "text", "has", "words", *(f"rare{x}" for x in "abcdefghij")}
    assert (one.pairs == many.pairs).all()


def test_odd_rows_and_one_class(spark, frame):
    for rows in (ODD, [], [(1, "password=0123456789abcdef01"), (2, "longlonglonglongword"), (2, None)]):
        docs = frame(rows)
        got = secrets.scan_secrets(docs, secrets.fit_scanner(docs)).collect()
        assert len(got) == len(rows)
        assert sorted(str(r.text) for r in got) == sorted(str(t) for _, t in rows)
        assert all(r.text is not None or r.redacted is None for r in got)
    assert secrets.finding_rows(secrets.scan_secrets(frame([]), secrets.Scanner(secrets.learn_language(frame([])), None))).count() == 0

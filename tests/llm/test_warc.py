import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dayglass.llm.warc import archive_digest, chunked, http_payload, read_archives, read_records, unchunked, walk_archive, with_payloads, write_archives
from dayglass.session import scratch_path

SCHEMA = "page_id bigint, url string, html string, digest string, payload string, __n bigint"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 1) for i, u, h in rows], SCHEMA)


def expected(rows):
    first = {}
    for i, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    made = []
    for i, _, h in rows:
        data = (h or "").encode()
        refers = first.get(h or "")
        refers = None if refers == i else refers
        made.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(map(str, made))


def odd_pages():
    draw = random.Random(3)
    base = [None, "", "x" * 99, "y" * 100, "é" * 50, "WARC/1.1\r\n\r\nContent-Length: 7\r\n\r\n" * 9, "\r\n\r\nWARC/1.1\r\n" * 40, "0\r\n\r\n", "🙂" * 3000, "z" * 1_500_000]
    base += ["".join(draw.choice("ab\r\n0é") for _ in range(n)) for n in (1, 300, 1999, 2000, 2001, 8000, 8192, 30_000)]
    rows = [(k, f"http://h/{k}\r\nX: y", h) for k, h in enumerate(base)]
    rows += [(100 + k, None, base[3 + k % 3]) for k in range(60)]
    rows += [(None, "u", base[4]), (None, None, None), (None, "u", "only nulls " * 20), (None, "u", "only nulls " * 20), (3, "again", base[3]), (7, "v", base[7]), (-5, "w", base[8])]
    return rows


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, compression):
    rows = odd_pages()
    path = scratch_path(spark, "warc")
    write_archives(pages_of(spark, rows), path, segment_bytes=2000, chunk_bytes=700, archive_records=64, compression=compression)
    records = read_archives(spark, path)
    assert sorted(str(tuple(r)) for r in archive_digest(records).collect()) == expected(rows)
    assert sorted(r.payload for r in with_payloads(records).collect()) == sorted((h or "").encode() for _, _, h in rows)
    raw = read_records(spark, path)
    longest = raw.agg(F.max(F.octet_length("block"))).first()[0]
    assert longest <= 2000 and raw.where("record_type = 'continuation'").count() > 750


def test_no_pages(spark):
    path = scratch_path(spark, "warc")
    write_archives(pages_of(spark, []), path)
    assert archive_digest(read_archives(spark, path)).count() == 0


def test_framing():
    for data in (b"", b"a", b"\r\n0\r\n\r\n" * 9, bytes(range(256)) * 20):
        for size in (1, 7, 256, 10_000):
            assert unchunked(chunked(data, size)) == data
    assert unchunked(b"3;name=v\r\nabc\r\n0\r\nField: x\r\n\r\n") == b"abc"
    assert http_payload(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n3\r\nplain") == b"3\r\nplain"
    assert http_payload(b"no head") == b""
    with pytest.raises(ValueError):
        unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def _record(kind, name, block, **more):
    fields = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Page-ID": "1", **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": len(block)}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Records in members of their own, folded fields, segments out of order, repeated, lacking, or of a wrong length."""
    block = b"HTTP/1.0 200 OK\r\n\r\n" + b"abcdefgh" * 4
    parts = [block[:20], block[20:25], block[25:]]

    def segments(name, total):
        made = [_record("response", name, parts[0], WARC_Segment_Number=1)]
        made.append(_record("continuation", name + "b", parts[1], WARC_Segment_Origin_ID=name, WARC_Segment_Number=2))
        made.append(_record("continuation", name + "c", parts[2], WARC_Segment_Origin_ID=name, WARC_Segment_Number=3, WARC_Segment_Total_Length=total))
        return made

    good, short, lack = segments("g", len(block)), segments("s", len(block) + 1), segments("l", len(block))
    bad_digest = _record("response", "d", block, WARC_Payload_Digest="sha256:00")
    bad_chunks = _record("response", "f", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz")
    info = _record("warcinfo", "i", b"software: x")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, [good[2], info, short[0], lack[0], bad_digest])))
    (tmp_path / "b.warc").write_bytes(b"".join([good[1], good[0], good[1], *short[1:], lack[2], bad_chunks]))
    got = {r.record_id: (r.fault, r.payload) for r in read_archives(spark, str(tmp_path)).collect()}
    assert got == {"g": (None, b"abcdefgh" * 4), "s": ("length", None), "l": ("segments", None), "d": ("digest", None), "f": ("framing", None)}
    with pytest.raises(Exception, match="faulty record"):
        archive_digest(read_archives(spark, str(tmp_path))).collect()
    folded = list(walk_archive(b"WARC/1.0\r\nA: b\r\n  c\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"))
    assert folded == [({"a": "b c", "content-length": "1"}, b"x")]
    for broken in (b"junk", b"WARC/1.0\r\nContent-Length: 9\r\n\r\nx", gzip.compress(b"WARC/1.0")[:-3]):
        with pytest.raises(ValueError):
            list(walk_archive(broken))

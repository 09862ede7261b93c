"""Web archives: segmented records with chunked transfer framing, written by Spark and put together again by origin."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayglass.llm.frames import quoted
from dayglass.operators.joins import largest_keys, lookup_join
from dayglass.session import cut_lineage

#: Bytes of content in one record; a longer block goes on in continuation records.
SEGMENT_BYTES = 8 << 10
#: Bytes of payload in one chunk of the transfer framing.
CHUNK_BYTES = 2 << 10
#: Records in one archive file, so that a file has at most about 16 MB.
ARCHIVE_RECORDS = 1 << 11
#: Payloads of fewer bytes are never replaced by a reference.
SHORTEST = 100
DATE = "2026-01-01T00:00:00Z"

# Fixed values of the WARC format.
VERSION = b"WARC/1.1"
END = b"\r\n"
GZIP = b"\x1f\x8b"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def first_of_each_payload(pages: DataFrame, page_id: str = "page_id", shortest: int = SHORTEST) -> DataFrame:
    """``pages`` (with ``payload`` and ``digest``) and ``refers_to``: the smallest id with an equal payload, NULL for its own.

    Payloads under ``shortest`` bytes refer to none. Rows that share the smallest id all count as the first; NULL ids
    come last, and a payload that only has NULL ids has no reference. Ids are summed up by digest before the shuffle,
    and the digests with the most rows are spread over salts, so copies of one page stay apart.
    """
    long_enough = pages.where(F.octet_length("payload") >= shortest)
    firsts = long_enough.groupBy("digest").agg(F.min(F.col(quoted(page_id))).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    firsts = cut_lineage(firsts)
    hot = largest_keys({"pages": firsts}, "digest", "__n")["pages"]
    joined = lookup_join(pages, firsts.select("digest", "__first"), "digest", hot, quoted(page_id))
    other = ~F.col("__first").eqNullSafe(F.col(quoted(page_id))) & (F.octet_length("payload") >= shortest)
    return joined.withColumn("refers_to", F.when(other, F.col("__first"))).drop("__first")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in the chunks of HTTP transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x" % len(part), END, part, END]
    return b"".join([*parts, b"0", END, END])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunks; chunk extensions and trailer fields are passed over."""
    parts, at = [], 0
    while True:
        line_end = body.index(END, at)
        size = int(body[at:line_end].split(b";", 1)[0], 16)
        at = line_end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != END:
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(f"{name}: {value}\r\n".encode() for name, value in [*fields, ("Content-Length", str(len(block)))])
    return b"".join([VERSION, END, head, END, block])


def _one_line(value: str) -> str:
    """A value that cannot end its header line."""
    return " ".join(value.replace("\0", " ").split())


def page_records(
    page_id: str | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: str | None, place: str, segment: int, chunk: int
) -> list[bytes]:
    """The records of one page: a response in as many segments as its block needs, or a revisit without payload."""
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place} {page_id} {digest}')}>"
    fields = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(length))]
    if url:
        fields.append(("WARC-Target-URI", _one_line(url)))
    if page_id is not None:
        fields.append(("WARC-Page-ID", quote(page_id)))
    fields.append(("Content-Type", "application/http;msgtype=response"))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers_to is not None:
        fields += [("WARC-Type", "revisit"), ("WARC-Profile", IDENTICAL_PAYLOAD), ("WARC-Refers-To-Page-ID", quote(refers_to))]
        return [_record(fields, head)]
    block = head + chunked(payload, chunk)
    fields.append(("WARC-Type", "response"))
    if len(block) <= segment:
        return [_record(fields, block)]
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    made = [_record([*fields, ("WARC-Segment-Number", "1")], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {number}')}>"
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE)]
        more += [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(number))]
        if number == len(parts):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        made.append(_record(more, part))
    return made


def write_archives(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    archive_records: int = ARCHIVE_RECORDS,
    compression: str = "none",
) -> None:
    """One response or revisit record per row of ``pages`` at ``path``, as WARC files.

    The payload is the html in UTF-8 (NULL: empty), in chunks, cut into segments where it is long; segments of one page
    may lie in different files. Repeated rows get records of their own. Spark's text writer puts the bytes down, with
    the empty lines that end a record as its line end, so files appear whole or not at all on every store. An empty
    table gives a folder without records. ``compression`` may be gzip.
    """
    payload = F.coalesce(F.col(quoted(html)).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(quoted(page_id)).alias("page_id"), F.col(quoted(url)).cast("string").alias("url"), payload.alias("payload"))
    rows = first_of_each_payload(rows.withColumn("digest", F.sha2("payload", 256)))
    sent = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload")
    names = {c: F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")}
    rows = rows.select(names["page_id"], "url", sent, "digest", F.octet_length("payload").alias("length"), names["refers_to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_id, row = f"{path} {TaskContext.get().partitionId()}", 0
        for batch in batches:
            records: list[bytes] = []
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                records += page_records(*values, f"{run_id} {row}", segment_bytes, chunk_bytes)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    lines = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.options(lineSep="\r\n\r\n", maxRecordsPerFile=archive_records, compression=compression).text(path)


def unpacked(data: bytes) -> bytes:
    """The content of gzip members one after the other."""
    view, at, parts = memoryview(data), 0, []
    while data[at : at + 2] == GZIP:
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(data):
                raise ValueError("an archive ends inside a gzip member")
            piece = view[at : at + (1 << 16)]
            parts.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
    return b"".join(parts)


def walk_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive, plain or gzip in any members."""
    if data[:2] == GZIP:
        data = unpacked(data)
    at = 0
    while at < len(data):
        if data.startswith(END, at):
            at += 2
            continue
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record begins at byte {at} of an archive")
        end = data.index(END + END, at)
        fields: dict[str, str] = {}
        last = ""
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t"):
                fields[last] += " " + line.strip()
                continue
            last, _, value = line.partition(":")
            last = last.strip().lower()
            fields[last] = value.strip()
        begin = end + 4
        at = begin + int(fields["content-length"])
        if at > len(data):
            raise ValueError("an archive ends inside a record")
        yield fields, data[begin:at]


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response, out of its transfer framing."""
    head, found, body = block.partition(END + END)
    if not found:
        return b""
    fields = {name.strip().lower(): value.strip().lower() for name, _, value in (line.partition(b":") for line in head.split(END)[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding", b"").endswith(b"chunked") else body


_FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "url": "warc-target-uri",
    "page_id": "warc-page-id",
    "refers_to": "warc-refers-to-page-id",
    "payload_digest": "warc-payload-digest",
}
_NUMBERS = {"payload_length": "warc-payload-length", "number": "warc-segment-number", "total": "warc-segment-total-length"}
_SCHEMA = ", ".join([*[f"{c} string" for c in _FIELDS], *[f"{c} bigint" for c in _NUMBERS], "origin string", "block binary"])
#: Bytes of blocks that leave a task in one batch.
_BATCH_BYTES = 8 << 20


def read_records(spark: SparkSession, path: str, segmented: bool | None = None) -> DataFrame:
    """All records at ``path``: header fields, ``origin`` (of a segment: the id of its first one) and ``block``.

    With ``segmented`` only segments of longer records, or only whole records. A task has one archive file in memory.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            kinds = [pa.string()] * len(_FIELDS) + [pa.int64()] * len(_NUMBERS) + [pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=[*_FIELDS, *_NUMBERS, "origin", "block"])

        for batch in batches:
            for content in batch.column(0):
                for fields, block in walk_archive(content.as_py()):
                    number = fields.get("warc-segment-number")
                    if segmented is not None and segmented != (number is not None):
                        continue
                    for k in ("warc-page-id", "warc-refers-to-page-id"):
                        if k in fields:
                            fields[k] = unquote(fields[k])
                    values = [fields.get(k) for k in _FIELDS.values()] + [int(fields[k]) if k in fields else None for k in _NUMBERS.values()]
                    origin = None if number is None else fields.get("warc-segment-origin-id", fields.get("warc-record-id"))
                    rows.append((*values, origin, block))
                    size += len(block) + 500
                    if size > _BATCH_BYTES:
                        yield made()
                        rows, size = [], 0
        if rows:
            yield made()

    return files.mapInArrow(run, _SCHEMA)


def _decoded(rows: DataFrame) -> DataFrame:
    """Records with ``blocks``, their segments in order, to records with ``payload``."""
    kept = ["record_id", "record_type", "url", "page_id", "refers_to", "payload_digest", "payload_length", "fault"]
    schema = rows.select(*kept).schema.add("payload", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                columns = {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}
                payloads = []
                for i, (kind, blocks) in enumerate(zip(columns["record_type"], columns["blocks"])):
                    payload = None
                    if kind == "response" and columns["fault"][i] is None:
                        try:
                            payload = http_payload(b"".join(blocks))
                        except ValueError:
                            columns["fault"][i] = "framing"
                        else:
                            want = columns["payload_digest"][i]
                            if want and want.startswith("sha256:") and want[7:] != hashlib.sha256(payload).hexdigest():
                                payload, columns["fault"][i] = None, "digest"
                            else:
                                columns["payload_length"][i] = len(payload)
                    payloads.append(payload)
                made = [pa.array(columns[c], t.type) for c, t in zip(kept, [part.schema.field(c) for c in kept])]
                yield pa.RecordBatch.from_arrays([*made, pa.array(payloads, pa.binary())], names=[*kept, "payload"])

    return rows.select(*kept, "blocks").mapInArrow(run, schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit at ``path``, its segments put together and its transfer framing taken off.

    Columns: record_id, record_type, url, page_id, refers_to, payload_digest, payload_length, fault, payload. Segments
    are grouped by the id of their origin and ordered by their number; only they are shuffled, and a group is no more
    than one page. ``fault`` tells why a record has no payload: ``segments`` (numbers lack or repeat), ``length`` (the
    sum differs from the stated total), ``framing``, ``digest``. The same segment twice counts once. A revisit has no
    payload, but the length and digest of the one it refers to. A folder without records gives no rows.
    """
    whole = read_records(spark, path, False).where(F.col("record_type").isin("response", "revisit"))
    whole = whole.withColumns({"fault": F.lit(None).cast("string"), "blocks": F.array("block")})
    head = ["record_id", "record_type", "url", "page_id", "refers_to", "payload_digest", "payload_length"]
    segments = read_records(spark, path, True).select("origin", F.struct("number", "block", "total", *head).alias("s"))
    groups = segments.groupBy("origin").agg(F.sort_array(F.collect_set("s")).alias("s"))
    first = F.col("s")[0]
    numbers = F.col("s.number") == F.sequence(F.lit(1).cast("long"), F.size("s").cast("long"))
    length = F.aggregate("s", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s["block"]))
    fault = F.when(~numbers, "segments").when(~length.eqNullSafe(F.element_at("s", -1)["total"]), "length")
    joined = groups.select(*[first[c].alias(c) for c in head], fault.alias("fault"), F.col("s.block").alias("blocks"))
    return _decoded(whole.select(*joined.columns).unionByName(joined))


def with_payloads(records: DataFrame) -> DataFrame:
    """Records with the payloads of the responses that revisits refer to, found by digest."""
    full = records.where(F.col("payload").isNotNull()).groupBy("payload_digest").agg(F.first("payload").alias("__full"))
    known = records.groupBy("payload_digest").agg(F.count("*").alias("n")).where("n > 1")
    hot = largest_keys({"records": known}, "payload_digest", "n")["records"]
    joined = lookup_join(records, full, "payload_digest", hot, "record_id")
    return joined.withColumn("payload", F.coalesce("payload", "__full")).drop("__full")


def archive_digest(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to; a faulty record fails the query."""
    sound = F.when(F.col("fault").isNull(), F.col("payload_length")).otherwise(F.raise_error(F.concat(F.lit("faulty record: "), F.col("fault"))).cast("long"))
    return records.select(
        F.col("page_id").cast("long").alias("page_id"),
        sound.alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )

"""WARC archives written with Spark's text sink and read back with segment reassembly.

Writing: one record per page. The block is an HTTP response whose body is chunked; blocks longer than a segment are cut into a
first record and continuation records (WARC-Segment-Number, -Origin-ID, and -Total-Length on the last). Of equal
payloads of at least ``least_revisit`` bytes the largest page_id's record is the response and the others are revisits of it.
Records are text (UTF-8), separated by CR LF CR LF, so the text sink writes archives to any store, with its commit protocol.

Reading: files are parsed record by record by Content-Length; continuation records, which may lie in other files, are grouped by
origin, ordered by number, checked against the total length, and the chunked framing is decoded.

NULL html is an empty payload, NULL url an empty target; a page with NULL page_id is written and read back as NULL; rows
equal in page_id and payload are all responses when theirs is the largest page_id; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.llm import shared

CRLF = "\r\n"
_RECORD = "page_id long, record_id string, type string, refers_to_id string, digest string, number int, origin string, total long, block binary"
_PAYLOAD = "page_id long, record_id string, type string, refers_to_id string, digest string, payload binary, intact boolean"


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a NULL value leaves its line out."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)) for name, value in pairs])


def _cut(text: Column, size: int) -> Column:
    """Pieces of ``size`` code points; an empty text has none."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substr(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunked(text: Column, size: int) -> Column:
    """The text in chunked transfer framing (sizes in bytes, whole characters in each chunk)."""
    framed = F.transform(_cut(text, size), lambda p: F.concat(F.lower(F.hex(F.octet_length(p))), F.lit(CRLF), p, F.lit(CRLF)))
    return F.concat(F.array_join(framed, ""), F.lit("0" + CRLF + CRLF))


def with_last(pages: DataFrame, least_revisit: int) -> DataFrame:
    """The pages with their digest; ``last`` is the largest page_id where payloads of at least ``least_revisit`` bytes repeat."""
    sha = lambda c: F.sha1(c.cast("binary"))
    long_ = pages.filter(F.octet_length("html") >= least_revisit).select("page_id", sha(F.col("html")).alias("sha"))
    last = long_.groupBy("sha").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("sha").alias("same"), "last")
    # the repeated digests are looked up by hash: pages need no sort, which would move every text once more
    return pages.withColumn("sha", sha(F.col("html"))).join(last.hint("shuffle_hash"), F.col("sha") == F.col("same"), "left")


def write_archives(
    pages: DataFrame, folder: str, least_revisit: int = 1000, segment: int = 1 << 13, chunk: int = 1 << 12, per_file: int = 1000,
    date: str = "2020-01-01T00:00:00Z",
) -> None:
    """Write gzip-compressed archives. A file holds at most ``per_file`` records of a segment (in code points) each."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), shared.whole_text("html").alias("html"))
    told = with_last(p, least_revisit)
    revisit = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id"))
    # the record id is a function of page and payload, so that a repeated task writes the same record
    name = lambda page: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("-")), F.col("sha")).cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}")
    told = told.select("page_id", "url", "sha", revisit.alias("revisit"), name(F.col("page_id")).alias("id"), F.when(revisit, name(F.col("last"))).alias("refers"),
                       F.when(revisit, http).otherwise(F.concat(http, chunked(F.col("html"), chunk))).alias("block"))
    parts = told.select("*", F.posexplode(_cut(F.col("block"), segment)).alias("k", "part"), F.ceil(F.length("block") / segment).alias("of"), F.octet_length("block").alias("whole"))
    first, many = F.col("k") == 0, F.col("of") > 1
    only = lambda when, value: F.when(when, value)
    head = _lines(
        ("WARC-Type", F.when(~first, F.lit("continuation")).when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", F.when(first, F.col("id")).otherwise(F.regexp_replace("id", "^<urn:uuid:.{8}", F.concat(F.lit("<urn:uuid:"), F.lpad(F.lower(F.hex(F.col("k"))), 8, "0"))))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "%0A")),
        ("X-Page-ID", only(first, F.col("page_id"))),
        ("Content-Type", only(first, F.lit("application/http;msgtype=response"))),
        ("WARC-Payload-Digest", only(first, F.concat(F.lit("sha1:"), F.col("sha")))),
        ("WARC-Profile", only(first & F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", only(first, F.col("refers"))),
        ("WARC-Segment-Number", only(many, F.col("k") + 1)),
        ("WARC-Segment-Origin-ID", only(many & ~first, F.col("id"))),
        ("WARC-Segment-Total-Length", only(many & (F.col("k") == F.col("of") - 1), F.col("whole"))),
        ("Content-Length", F.octet_length("part")),
    )
    records = parts.select(F.concat(F.lit("WARC/1.1" + CRLF), head, F.lit(CRLF), F.col("part")).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a plain or gzip archive, one gzip member or many."""
    if data[:2] == b"\x1f\x8b":
        plain = []
        while data:
            member = zlib.decompressobj(31)
            plain.append(member.decompress(data))
            if not member.eof:
                raise ValueError("the archive ends inside a gzip member")
            data = member.unused_data
        data = b"".join(plain)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode().split(CRLF)[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, size = end + 4, int(head["content-length"])
        if start + size > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        yield head, data[start : start + size]
        at = start + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of record at byte {at}")
        at += 4


def dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message, its chunked framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of a folder's archives, continuation records among them."""
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("refers_to_id", pa.string()), ("digest", pa.string()),
                        ("number", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("block", pa.binary())])

    def row(head: dict[str, str], block: bytes) -> dict:
        whole = lambda name: int(head[name]) if name in head else None
        return {"page_id": whole("x-page-id"), "record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "refers_to_id": head.get("warc-refers-to"),
                "digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "number": whole("warc-segment-number"),
                "origin": head.get("warc-segment-origin-id"), "total": whole("warc-segment-total-length"), "block": block}

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for head, block in parse_archive(data.as_py()):
                    rows.append(row(head, block))
                    size += len(block)
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(run, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """page_id, record_id, type, refers_to_id, digest, payload, intact of each page; a group is the segments of one record."""
    import hashlib

    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("refers_to_id", pa.string()), ("digest", pa.string()),
                        ("payload", pa.binary()), ("intact", pa.bool_())])

    def finished(r: dict, block: bytes) -> dict:
        payload = None if r["type"] == "revisit" else payload_of(block)
        ok = payload is None or r["digest"] is None or hashlib.sha1(payload).hexdigest() == r["digest"]
        return {k: r[k] for k in ("page_id", "record_id", "type", "refers_to_id", "digest")} | {"payload": payload, "intact": ok}

    def single(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256).to_pylist()
                yield pa.RecordBatch.from_pylist([finished(r, r["block"]) for r in part], schema)

    def joined(table: pa.Table) -> pa.Table:
        # repeated pages have equal records: one of each number is needed, and the page comes as often as its first record
        rows = sorted(table.to_pylist(), key=lambda r: r["number"])
        firsts = [r for r in rows if r["number"] == 1]
        by = {r["number"]: r for r in rows}
        block = b"".join(by[k]["block"] for k in sorted(by))
        if sorted(by) != list(range(1, len(by) + 1)) or by[len(by)]["total"] != len(block):
            raise ValueError(f"segments of {rows[0]['origin'] or rows[0]['record_id']} are missing or do not add up")
        return pa.Table.from_pylist([finished(r, block) for r in firsts], schema)

    whole = records.filter("number IS NULL").mapInArrow(single, _PAYLOAD)
    parts = records.filter("number IS NOT NULL").withColumn("of", F.coalesce("origin", "record_id"))
    return whole.union(parts.groupBy("of").applyInArrow(lambda t: joined(t), _PAYLOAD))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, revisits resolved to their response."""
    pages = reassemble(read_records(spark, folder)).select(
        "page_id", "record_id", "type", "refers_to_id", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha"), "digest", "intact")
    pages = shared.written(pages, "pages")
    if pages.filter("NOT intact").limit(1).count():
        raise ValueError("a payload does not match its digest")
    answers = pages.filter("type = 'response'").groupBy(F.col("record_id").alias("of")).agg(F.first("page_id").alias("of_page"), F.first("n").alias("of_n"), F.first("sha").alias("of_sha"))
    out = pages.join(answers, (F.col("refers_to_id") == F.col("of")) & (F.col("type") == "revisit"), "left")
    return out.select("page_id", F.coalesce("n", "of_n").alias("payload_bytes"), F.coalesce("sha", "of_sha").alias("payload_digest"), F.col("type").alias("record_type"), F.col("of_page").alias("refers_to"))

"""WARC: a converter of legacy ARC archives.

An ARC file starts with a version block, `filedesc://name ip date text/plain length`, which declares its version and
header line: version 1 has `URL IP-address Archive-date Content-type Archive-length`, version 2 puts result code, checksum,
location, offset and filename before the length. `read_arc` walks the records by these lines and their declared lengths.
`to_warc` gives each a WARC identifier (a UUID of what the record is and where it stood), timestamp, type (response for HTTP, resource for the
rest) and digest, and turns repeats of a payload of at least `least` bytes into revisits of the one that `order` puts last. Only payloads
whose digest repeats, which a filter of bounded size tells, are shuffled to meet the decision; all others stay where they were parsed.
`write_warc` writes WARC/1.1 files with Spark's text writer, records being separated by their closing CRLF CRLF; `read_warc`
reads them by declared length.

Payloads are any bytes, empty ones too. A header line of too few fields is skipped up to the next line; a length that
runs past the end keeps what is there and marks the record truncated; dates of 8 or 12 digits are filled up, others become the
version block's. Rows repeating key and payload all stay responses. Empty tables make archives without records. Columns that an
operator doesn't name aren't read. A file is parsed in one task, so writers bound its bytes: `FILE_ROWS` rows of `SEGMENT` bytes, or of one longer record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

#: The fields of header lines by version.
ARC_FIELDS = {1: ("url", "ip", "date", "mime", "length"), 2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length")}
ARC_NAMES = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
CRLF2 = b"\r\n\r\n"
SEGMENT, FILE_ROWS = 4 << 20, 16
#: Bits of the filter that tells repeated digests: 1 MB; digests beyond share bits, which only costs.
MARKS = 1 << 23


def _date14(text: bytes, otherwise: str) -> str:
    """An ARC date as a WARC date."""
    t = text.decode("latin-1")
    if not t.isdigit() or len(t) not in (8, 12, 14):
        return otherwise
    t = t.ljust(14, "0")
    return f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:]}Z"


def parse_arc(b: bytes) -> Iterator[tuple[int, str, str, str, str, str, int, bool, bytes]]:
    """(version, kind, url, ip, WARC date, content type, offset, truncated, document) of each record, the version block first."""
    at, version, basic = 0, 1, "1970-01-01T00:00:00Z"
    while at < len(b):
        if b[at] in b"\r\n":
            at += 1
            continue
        end = b.find(b"\n", at)
        line = b[at : end if end >= 0 else len(b)].rstrip(b"\r")
        body = (end if end >= 0 else len(b)) + 1
        fields = ARC_FIELDS[version]
        first = line.startswith(b"filedesc://")
        parts = line.rsplit(b" ", 4 if first else len(fields) - 1)  # a URL may hold spaces, the other fields don't
        if len(parts) != (5 if first else len(fields)) or not parts[-1].isdigit():
            at = body
            continue
        size = int(parts[-1])
        document = b[body : body + size]
        if first:
            declared = document.split(b"\n")
            version = 2 if declared[0].split(b" ")[0] == b"2" else 1
            if len(declared) > 1 and declared[1].strip() in ARC_NAMES.values():
                version = next(k for k, v in ARC_NAMES.items() if v == declared[1].strip())
            basic = _date14(parts[2], basic)
        url, ip, date, mime = (p.decode("utf-8", "replace") for p in parts[:4])
        yield version, "filedesc" if first else "record", url, ip, _date14(parts[2], basic), mime, at, body + size > len(b), document
        at = body + size


def arc_segment(name: str, version: int, records: list[tuple[str, str, str, str, int, bytes]]) -> bytes:
    """An ARC file of (url, ip, 14-digit date, content type, status, document)."""
    block = b"%d 0 terrabrook\n%s\n\n" % (version, ARC_NAMES[version])
    out = [b"filedesc://%s 0.0.0.0 19960101000000 text/plain %d\n" % (name.encode(), len(block)), block, b"\n"]
    at = sum(map(len, out))
    for url, ip, date, mime, status, document in records:
        extra = b"" if version == 1 else b" %d %s - %d %s" % (status, hashlib.md5(document).hexdigest().encode(), at, name.encode())
        head = f"{url} {ip} {date} {mime}".encode() + extra + b" %d\n" % len(document)
        out += [head, document, b"\n"]
        at += len(head) + len(document) + 1
    return b"".join(out)


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """(path, content): the pages (page_id, url, html) as ARC archives of a few megabytes, as a crawler of old would have left them; both versions occur."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def segment() -> pa.RecordBatch:
            key = "none" if held[0][0] is None else str(held[0][0])
            version = 1 + (held[0][0] or 0) % 2
            rows = []
            for page, url, html in held:
                body = (html or "").encode("utf-8", "replace")
                name = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{name}Content-Length: {len(body)}\r\n\r\n".encode()
                place = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page}"
                day = (page or 0) % 10_000_000
                date = f"1997{1 + day // 86400 % 12:02d}{1 + day // 1036800 % 28:02d}{day // 3600 % 24:02d}{day // 60 % 60:02d}{day % 60:02d}"
                rows.append((place, "0.0.0.0", date, "text/html", 200, head + body))
            content = arc_segment(f"pages-{key}.arc", version, rows)
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{key}.arc"]), pa.array([content], pa.binary())], ["path", "content"])

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                for row in zip(*(batch.column(i).slice(a, 500).to_pylist() for i in range(3)), strict=True):
                    held.append(row)
                    size += len(row[2] or "") + 300
                    if size >= SEGMENT:
                        yield segment()
                        held, size = [], 0
        if held:
            yield segment()

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(write, "path string, content binary")


RECORDS = "url string, ip string, warc_date string, mime string, record_id string, record_type string, truncated boolean, http binary, payload binary, payload_bytes long, payload_digest string"


def read_arc(archives: DataFrame) -> DataFrame:
    """The records of archives (path, content; gzip or plain), as RECORDS. Spark's binaryFile source gives such rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.string()] * 6 + [pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.string()]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                place, raw = path.as_py() or "", content.as_py() or b""
                raw = b"".join(_plain(raw))
                rows, size = [], 0
                for _, kind, url, ip, date, mime, offset, short, document in parse_arc(raw):
                    if kind == "filedesc":
                        continue
                    web = document.startswith(b"HTTP/")
                    head, gap, body = document.partition(CRLF2) if web else (b"", b"", document)
                    digest = hashlib.sha1(body).hexdigest()
                    what = hashlib.sha1("\0".join((url, date, digest, place, str(offset))).encode() + b"\0" + head).digest()
                    rows.append((url, ip, date, mime, str(uuid.UUID(bytes=what[:16], version=5)), "response" if web else "resource", short, head + gap, body, len(body), digest))
                    size += len(document)
                    if size > SEGMENT:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    return archives.select("path", "content").mapInArrow(read, RECORDS)


def http_key(name: str, http: str = "http") -> Column:
    """A whole number from an HTTP header."""
    return F.regexp_extract(F.col(http).cast("string"), rf"(?m)^{name}: (-?\d+)", 1).try_cast("long")


def _repeats(digests: DataFrame) -> Column:
    """A condition on payload_digest that holds for all of digests, and for others only where they share a bit of a filter of fixed size."""
    slot = F.pmod(F.xxhash64("payload_digest"), F.lit(MARKS))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    words = digests.select(F.floor(slot / 64).alias("k"), bit(slot).alias("w")).unionByName(digests.sparkSession.range(MARKS // 64).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("w")))
    table = words.groupBy("k").agg(F.bit_or("w").alias("w")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]).alias("words"))
    return F.element_at(table.scalar(), (F.floor(slot / 64) + 1).cast("int")).bitwiseAND(bit(slot)) != 0


def to_warc(records: DataFrame, order: Column, least: int = 1000) -> DataFrame:
    """records with repeats as revisits: record_type, refers_to (identifier), refers_url and refers_date. order: the largest of equal payloads is the one kept.

    Digests are gathered in a first pass over records without payloads; the second pass carries payloads."""
    keyed = records.withColumn("_order", order)
    long_ = keyed.where(F.col("payload_bytes") >= least)
    kept = long_.groupBy("payload_digest", "payload_bytes").agg(F.max_by(F.struct("record_id", "url", "warc_date", "_order"), F.struct("_order", "record_id")).alias("_kept"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    kept = saved(kept, "kept")
    may = (F.col("payload_bytes") >= least) & _repeats(kept.select("payload_digest"))
    met = keyed.where(may).join(kept, ["payload_digest", "payload_bytes"], "left")
    alone = keyed.where(~may).withColumn("_kept", F.lit(None).cast(kept.schema["_kept"].dataType))
    again = F.col("_kept").isNotNull() & ~F.col("_order").eqNullSafe(F.col("_kept._order"))
    refers = {c: F.when(again, F.col(f"_kept.{f}")) for c, f in (("refers_to", "record_id"), ("refers_url", "url"), ("refers_date", "warc_date"))}
    return met.unionByName(alone).select("url", "ip", "warc_date", "mime", "record_id", F.when(again, "revisit").otherwise(F.col("record_type")).alias("record_type"), "truncated", "http", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", *(c.alias(k) for k, c in refers.items()))


def write_warc(records: DataFrame, path: str) -> None:
    """Writes to_warc's records as gzipped WARC/1.1 files under path."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: terrabrook\r\nformat: WARC File Format 1.1\r\n"
        yield pa.RecordBatch.from_arrays([pa.array([b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: 1997-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:%s>\r\nContent-Type: application/warc-fields\r\nContent-Length: %d" % (str(uuid.uuid5(uuid.NAMESPACE_URL, "terrabrook")).encode(), len(info)) + CRLF2 + info], pa.binary())], ["value"])
        for batch in batches:
            out, size = [], 0
            for a in range(0, batch.num_rows, 100):
                for r in batch.slice(a, 100).to_pylist():
                    block = r["http"] + (b"" if r["record_type"] == "revisit" else r["payload"])
                    digest = base64.b32encode(bytes.fromhex(r["payload_digest"])).decode()
                    head = [f"WARC-Type: {r['record_type']}", f"WARC-Target-URI: {r['url']}", f"WARC-Date: {r['warc_date']}", f"WARC-Record-ID: <urn:uuid:{r['record_id']}>", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha1:{digest}"]
                    if r["record_type"] == "revisit":
                        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{r['refers_to']}>", f"WARC-Refers-To-Target-URI: {r['refers_url']}", f"WARC-Refers-To-Date: {r['refers_date']}"]
                    else:
                        head.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")
                    if r["truncated"]:
                        head.append("WARC-Truncated: length")
                    head += [f"Content-Type: {r['mime'] if r['record_type'] == 'resource' else 'application/http;msgtype=response'}", f"Content-Length: {len(block)}"]
                    out.append("\r\n".join(["WARC/1.1", *head]).encode() + CRLF2 + block)
                    size += len(block)
                    if size >= SEGMENT:
                        yield pa.RecordBatch.from_arrays([pa.array([CRLF2.join(out)], pa.binary())], ["value"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([CRLF2.join(out)], pa.binary())], ["value"])

    text = records.mapInArrow(render, "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", CRLF2.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


def parse_warc(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields with names in lower case, block) of each record, by declared length; chunks: the plain bytes."""
    b = b""
    while True:
        while (end := b.find(CRLF2)) < 0 and (more := next(chunks, None)) is not None:
            b += more
        if end < 0:
            return
        lines = b[:end].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        parts, have = [b[end + 4 :]], len(b) - end - 4
        while have < size + 4 and (more := next(chunks, None)) is not None:
            parts.append(more)
            have += len(more)
        b = b"".join(parts)
        yield head, b[:size]
        b = b[size + 4 :]


def _plain(raw: bytes) -> Iterator[bytes]:
    """The bytes of a plain or gzipped file of any number of members, piece by piece."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        member = zlib.decompressobj(47)
        yield member.decompress(raw, 1 << 20)
        while not member.eof and member.unconsumed_tail:
            yield member.decompress(member.unconsumed_tail, 1 << 20)
        raw = member.unused_data


READ = "url string, warc_date string, record_id string, record_type string, refers_to string, http binary, payload binary, payload_bytes long, payload_digest string, intact boolean"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records under path, warcinfo left out. Digest and size are of the full payload: computed, for revisits as recorded. intact: the digests agree; null for revisits, whose payload is elsewhere."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ.split(", ")]
        kinds = [pa.string()] * 5 + [pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for head, block in parse_warc(_plain(content.as_py() or b"")):
                    kind = head["warc-type"]
                    if kind == "warcinfo":
                        continue
                    web = block.startswith(b"HTTP/")
                    first, gap, body = block.partition(CRLF2) if web else (b"", b"", block)
                    listed = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if kind == "revisit":
                        length = re.search(rb"(?im)^content-length: *(\d+)", first)
                        n, digest, ok = int(length[1]) if length else None, listed, None
                    else:
                        n, digest = len(body), hashlib.sha1(body).hexdigest()
                        ok = digest == listed
                    rows.append((head.get("warc-target-uri"), head["warc-date"], head["warc-record-id"][10:-1], kind, head["warc-refers-to"][10:-1] if "warc-refers-to" in head else None, first + gap, body if payloads and kind != "revisit" else None, n, digest, ok))
                    size += len(block)
                    if size > SEGMENT:
                        yield made(rows)
                        rows, size = [], 0
                yield made(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(read, READ)

"""Conversion of legacy ARC archives to WARC.

An ARC file starts with a version block that names its header fields; every record after it has one
header line, split at spaces, whose last field is the declared length of what follows. The converter
reads header lines by the fields of the file's own version block, takes the declared number of bytes,
and writes WARC records with identifiers, dates, types and digests made from them. Records with the
payload of an earlier one become revisits.

Archives travel as rows (archive, content) of a written table, content being gzip members as in .arc.gz
and .warc.gz files, so they live in any store that the engine can write to.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, keep

# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122

#: Payloads shorter than this are never written as revisits.
LEAST_SHARED = 100
#: Records and bytes of payload in an archive.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 256, 1 << 20
#: Records behind a salt, about, and salts at least.
SALT_RECORDS, SALTS = 1 << 20, 16


@dataclass
class ArcRecord:
    """A record of an ARC file: its header fields by name, and its content (fewer bytes than declared: truncated)."""

    fields: dict[str, str]
    content: bytes
    truncated: bool = False

    @property
    def url(self) -> str:
        return self.fields.get("URL", "")

    def http(self) -> tuple[bytes, bytes]:
        """Header block (with its blank line) and payload; all is payload if there is no HTTP header."""
        if self.content.startswith(b"HTTP/"):
            at = self.content.find(b"\r\n\r\n")
            if at >= 0:
                return self.content[: at + 4], self.content[at + 4 :]
        return b"", self.content

    def warc_date(self) -> str:
        d = (self.fields.get("Archive-date", "") + "00000101000000"[len(self.fields.get("Archive-date", "")) :])[:14]
        return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


@dataclass
class WarcRecord:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in {**self.headers, "Content-Length": str(len(self.block))}.items())
        return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + self.block + b"\r\n\r\n"


def zipped(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def unzipped(data: bytes) -> bytes:
    """All gzip members of data; data that isn't gzip as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out)


def _token(text: str) -> str:
    """text as one field of a header line: white space and control characters percent-encoded, '-' if empty."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text) or "-"


def arc_file(name: str, version: int, records: list[tuple[dict[str, str], bytes]]) -> bytes:
    """An ARC file (gzip members) of the given version with records (header fields, content)."""
    block = f"{version} {1 if version == 1 else 0} inkstone\n{ARC_FIELDS[version]}\n".encode()
    tail = " text/plain" if version == 1 else " text/plain 200 - - 0 -"
    out = [zipped(f"filedesc://{_token(name)} 0.0.0.0 19960101000000{tail} {len(block)}\n".encode() + block + b"\n")]
    for fields, content in records:
        known = {**fields, "Archive-length": str(len(content))}
        line = " ".join(_token(known.get(f, "")) for f in ARC_FIELDS[version].split(" "))
        out.append(zipped(line.encode() + b"\n" + content + b"\n"))
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, without its version block; fields are named by that block.

    ValueError if there is no version block or a header line has no length. A content that ends before
    its declared length is returned as truncated. An empty file has no records.
    """
    data = unzipped(data)
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"an ARC header line without a length at byte {at}")
        length = int(parts[-1])
        content = data[end + 1 : end + 1 + length]
        at = end + 1 + length
        if names is None:
            lines = content.decode("utf-8", "replace").split("\n")
            if not parts[0].startswith("filedesc:") or len(lines) < 2:
                raise ValueError("an ARC file without a version block")
            names = lines[1].strip().split(" ")
            continue
        if len(parts) > len(names):  # blanks inside the URL, as old writers left them
            parts = ["%20".join(parts[: len(parts) - len(names) + 1]), *parts[len(parts) - len(names) + 1 :]]
        yield ArcRecord(dict(zip(names, parts, strict=False)), content, len(content) < length)


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of a WARC file, plain or in gzip members."""
    data = unzipped(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        length = int(headers["Content-Length"])
        yield WarcRecord(headers, data[end + 4 : end + 4 + length])
        at = end + 4 + length + 4


def record_id(url: str, date: str, digest: str, page: str, where: str = "") -> str:
    """The identifier of a record, the same whenever it is converted; where (its archive and place in it) tells repeated records apart."""
    return uuid.uuid5(NAMESPACE, f"{url} {date} {digest} {page} {where}").urn


def _header(head: bytes, name: str) -> str:
    for line in head.split(b"\r\n"):
        if line.lower().startswith(name.lower().encode() + b":"):
            return line.split(b":", 1)[1].strip().decode()
    return ""


def converted(record: ArcRecord, refers: dict | None = None, where: str = "") -> WarcRecord:
    """The WARC record for an ARC record: a response (resource without HTTP header), or a revisit of refers (id, page)."""
    head, payload = record.http()
    digest = hashlib.sha256(payload).hexdigest()
    page, date = _header(head, "X-Page-Id"), record.warc_date()
    h = {"WARC-Type": "revisit" if refers else "response" if head else "resource", "WARC-Record-ID": f"<{record_id(record.url, date, digest, page, where)}>", "WARC-Date": date, "WARC-Target-URI": record.url}
    ip = record.fields.get("IP-address", "-")
    if ip not in ("-", "0.0.0.0"):
        h["WARC-IP-Address"] = ip
    h["WARC-Payload-Digest"] = f"sha256:{digest}"
    h["X-Payload-Length"] = str(len(payload))
    if record.truncated:
        h["WARC-Truncated"] = "length"
    if refers:
        h |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<{refers['id']}>", "X-Refers-To-Page-Id": refers["page"]}
    h["Content-Type"] = "application/http; msgtype=response" if head else record.fields.get("Content-type", "application/octet-stream")
    block = head if refers else head + payload
    h["WARC-Block-Digest"] = f"sha256:{hashlib.sha256(block).hexdigest()}"
    return WarcRecord(h, block)


ARCHIVE = "archive string, content binary"
_ARCHIVE = pa.schema([("archive", pa.string()), ("content", pa.binary())])


def _write_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    records, size = [], 0

    def full() -> pa.RecordBatch:
        name = uuid.uuid4().hex
        out = arc_file(f"{name}.arc.gz", 1 + int(name, 16) % 2, records)
        return pa.RecordBatch.from_pydict({"archive": [name], "content": [out]}, schema=_ARCHIVE)

    for batch in batches:
        for page, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
            page, url, payload = page.as_py(), url.as_py(), (html.as_py() or "").encode()
            head = "HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + ("" if page is None else f"X-Page-Id: {page}\r\n") + f"Content-Length: {len(payload)}\r\n\r\n"
            day, second = divmod((page or 0) % (27 * 86400), 86400)
            date = f"199601{day + 1:02d}{second // 3600:02d}{second // 60 % 60:02d}{second % 60:02d}"
            records.append(({"URL": url or "", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200"}, head.encode() + payload))
            size += len(payload)
            if len(records) >= ARCHIVE_RECORDS or size >= ARCHIVE_BYTES:
                yield full()
                records, size = [], 0
    if records:
        yield full()


def write_arcs(pages: DataFrame) -> DataFrame:
    """Legacy archives (archive, content) of pages (page_id, url, html), in versions 1 and 2; a null html has an empty payload."""
    return keep(pages.select("page_id", "url", "html").mapInArrow(_write_arcs, ARCHIVE), "arc")


_FACTS = "archive string, place int, page long, id string, bytes long, digest string"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FACTS.split(", ")]
    kinds = pa.schema(list(zip(names, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)))
    for batch in batches:
        for archive, content in zip(batch.column("archive"), batch.column("content"), strict=True):
            rows = []
            for place, r in enumerate(read_arc(content.as_py())):
                head, payload = r.http()
                digest, page = hashlib.sha256(payload).hexdigest(), _header(head, "X-Page-Id")
                rows.append((archive.as_py(), place, int(page) if page else None, record_id(r.url, r.warc_date(), digest, page, f"{archive.as_py()} {place}"), len(payload), digest))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kinds.field(i).type) for i in range(len(names))], schema=kinds)


def revisits(arcs: DataFrame) -> DataFrame:
    """archive, place, id, page for every record to be written as a revisit, with the record that it repeats.

    Records with equal payloads of LEAST_SHARED bytes or more: the one with the smallest page (no page:
    last) is the original. A payload that a third of all records share is dealt over as many keys as the records need.
    """
    facts = keep(arcs.mapInArrow(_facts, _FACTS), "arc-facts").filter(F.col("bytes") >= LEAST_SHARED)
    salts = max(SALTS, -(-facts.count() // SALT_RECORDS))
    facts = facts.withColumn("salt", F.pmod(F.xxhash64("archive", "place"), F.lit(salts)))
    first = F.min(F.struct(F.col("page").isNull().alias("none"), "page", "archive", "place", "id")).alias("first")
    part = facts.groupBy("digest", "salt").agg(first, F.count("*").alias("n"))
    whole = part.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))  # at most all salts
    shared = whole.filter("n > 1").select("digest", "first", F.explode("salts").alias("salt"))
    both = facts.drop("id", "page").join(shared, ["digest", "salt"])
    return both.filter((F.col("archive") != F.col("first.archive")) | (F.col("place") != F.col("first.place"))).select("archive", "place", F.col("first.id").alias("id"), F.col("first.page").cast("string").alias("page"))


def _write_warcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, content, known in zip(*(batch.column(c) for c in ("archive", "content", "known")), strict=True):
            refers = {x["place"]: {"id": x["id"], "page": x["page"] or ""} for x in known.as_py() or []}
            info = WarcRecord({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{uuid.uuid5(NAMESPACE, archive.as_py()).urn}>", "WARC-Date": "1996-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, b"software: inkstone\r\nformat: WARC File Format 1.0\r\n")
            out = [zipped(info.to_bytes())]
            out += [zipped(converted(r, refers.get(place), f"{archive.as_py()} {place}").to_bytes()) for place, r in enumerate(read_arc(content.as_py()))]
            yield pa.RecordBatch.from_pydict({"archive": [archive.as_py()], "content": [b"".join(out)]}, schema=_ARCHIVE)


def arc_to_warc(arcs: DataFrame) -> DataFrame:
    """WARC archives (archive, content) for ARC archives (archive, content); same names, one record for each."""
    known = revisits(arcs).groupBy("archive").agg(F.collect_list(F.struct("place", "id", "page")).alias("known"))  # at most the records of an archive
    return keep(arcs.join(known, "archive", "left").select("archive", "content", "known").mapInArrow(_write_warcs, ARCHIVE), "warc")


_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, record_date string, url string"


def _read_warcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([(x.split()[0], pa.int64() if x.endswith(" long") else pa.string()) for x in _PAGES.split(", ")])
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for r in read_warc(content.as_py()):
                kind, h = r.headers["WARC-Type"], r.headers
                if kind == "warcinfo":
                    continue
                head, _, payload = r.block.partition(b"\r\n\r\n") if r.block.startswith(b"HTTP/") else (b"", b"", r.block)
                if kind == "revisit":
                    size, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:")
                else:
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if h["WARC-Payload-Digest"] != f"sha256:{digest}":
                        raise ValueError(f"{h['WARC-Record-ID']}: the payload differs from its digest")
                page, refers = _header(head, "X-Page-Id"), h.get("X-Refers-To-Page-Id", "")
                rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None, h["WARC-Record-ID"], h["WARC-Date"], h["WARC-Target-URI"]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kinds.field(i).type) for i in range(len(kinds))], schema=kinds)


def read_warcs(warcs: DataFrame) -> DataFrame:
    """A row per WARC record with its page, payload length and digest (checked against the payload), type and what it refers to."""
    return warcs.mapInArrow(_read_warcs, _PAGES)


def pages_through_archives(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as legacy archives, converted to WARC and read back: a row per page.

    Of records with equal payloads of at least 100 bytes the one with the smallest page_id is the response
    (null page_id: last; repeated page_id: one of them), the others revisit it. A null or empty html has an
    empty payload, one of any length is written whole; a null url is written as '-'; repeated rows have records with identifiers of
    their own; no pages give no archives and no rows.
    """
    arcs = write_arcs(pages)
    warcs = arc_to_warc(arcs)
    drop(arcs)
    return read_warcs(warcs)

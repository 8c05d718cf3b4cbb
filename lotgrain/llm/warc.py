"""Legacy ARC archives turned into WARC archives, and WARC archives read back.

An ARC file begins with a version block; its version says which fields the header line of every
following record has (version 1: URL, IP address, date, content type, length; version 2 puts
result code, checksum, location, offset and file name before the length). The length declared
there, not any mark in the text, ends a record. The converter gives each record what WARC asks
for and ARC lacks: an identifier, an ISO date, a type, digests of block and payload. Records of
equal payloads are told apart first: one stays a response, the others become revisits of it
that hold their HTTP head only.

Archives are files of gzip members, one for each record, of about ``ARCHIVE_BYTES``. Spark's
text writer puts down one archive a row; the zero byte it ends a file with is padding that gzip
readers skip. Spark's binary reader gives them back whole, so a task holds one archive, or one
record that is larger, at a time.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha1
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotgrain.llm.rows import arrow_schema, slices, written
from lotgrain.session import shared_folder

ARCHIVE_BYTES = 16 << 20
#: Fields of the header lines by version, beside the URL at the beginning, which may hold spaces.
ARC_FIELDS = {
    b"1": (b"IP-address", b"Archive-date", b"Content-type", b"Archive-length"),
    b"2": (b"IP-address", b"Archive-date", b"Content-type", b"Result-code", b"Checksum", b"Location", b"Offset", b"Filename", b"Archive-length"),
}
PAGE_HEADER = b"X-Page-Id"
#: When pages were fetched is not known; archives need a date.
FETCHED = b"20000101000000"


class Record(NamedTuple):
    """A record of an archive: where it begins, its fields and its content."""

    offset: int
    fields: dict[bytes, bytes]
    content: bytes


def digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member; data that isn't gzip is one. Zero bytes between members are skipped."""
    if data[:2] != b"\x1f\x8b":
        yield 0, data.rstrip(b"\x00")
        return
    view, begin = memoryview(data), 0
    while begin < len(data):
        if data[begin] == 0:
            begin += 1
            continue
        unpacker, parts, at = zlib.decompressobj(31), [], begin
        while not unpacker.eof and at < len(data):
            parts.append(unpacker.decompress(view[at : at + 65536]))
            at += 65536
        if not unpacker.eof:
            raise ValueError(f"member at {begin} is cut off")
        yield begin, b"".join(parts)
        begin = min(at, len(data)) - len(unpacker.unused_data)


def arc_record(url: bytes, content: bytes, version: bytes, offset: int, name: bytes) -> bytes:
    """A record as it stands in an ARC file of the version."""
    kind, length = b"text/html", str(len(content)).encode()
    if version == b"1":
        line = [url, b"0.0.0.0", FETCHED, kind, length]
    else:
        line = [url, b"0.0.0.0", FETCHED, kind, b"200", digest(content).encode(), b"-", str(offset).encode(), name, length]
    return b" ".join(line) + b"\n" + content + b"\n"


def arc_start(version: bytes, name: bytes) -> bytes:
    """The version block that opens an ARC file: its own header line always has the fields of version 1."""
    says = version + b" 0 lotgrain\nURL " + b" ".join(ARC_FIELDS[version]) + b"\n\n"
    return b"filedesc://" + name + b" 0.0.0.0 " + FETCHED + b" text/plain " + str(len(says)).encode() + b"\n" + says + b"\n"


def read_arc(data: bytes) -> Iterator[Record]:
    """The records of an ARC file behind its version block, by the fields its version declares.

    A header line without the fields, a length that is no number or beyond the member, and an
    unknown version are errors that name the offset.
    """
    fields = None
    for offset, part in members(data):
        at = 0
        while at < len(part):
            if part[at : at + 1] in (b"\n", b"\r", b"\x00"):
                at += 1
                continue
            end = part.find(b"\n", at)
            names = fields or ARC_FIELDS[b"1"]
            line = part[at:end].rstrip(b"\r").rsplit(b" ", len(names)) if end >= 0 else []
            if len(line) <= len(names) or not line[-1].isdigit() or end + 1 + int(line[-1]) > len(part):
                raise ValueError(f"no ARC record at {offset} + {at}")
            content = part[end + 1 : end + 1 + int(line[-1])]
            if fields is None:
                version = content.split(b" ", 1)[0]
                if not line[0].startswith(b"filedesc:") or version not in ARC_FIELDS:
                    raise ValueError(f"no ARC version block at {offset}")
                fields = ARC_FIELDS[version]
            else:
                yield Record(offset + at, {b"URL": line[0], **dict(zip(names, line[1:], strict=True))}, content)
            at = end + 1 + len(content)


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with the blank line behind it, and payload; content that doesn't begin as a response has no head."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    gap = re.search(rb"\r?\n\r?\n", content)
    return (content[: gap.end()], content[gap.end() :]) if gap else (content, b"")


def http_header(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?mi)^" + re.escape(name) + rb":[ \t]*([^\r\n]*?)[ \t]*\r?$", head)
    return found[1] if found else None


def warc_date(date: bytes) -> bytes:
    """ISO form of an ARC date, which may end behind any of its parts."""
    digits = (re.sub(rb"\D", b"", date) + b"00000101000000"[len(date) :])[:14]
    return b"%s-%s-%sT%s:%s:%sZ" % (digits[:4], digits[4:6], digits[6:8], digits[8:10], digits[10:12], digits[12:14])


def record_id(archive: str, offset: int) -> str:
    """A WARC identifier that only depends on where the ARC record stands."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def warc_record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = b"".join(k + b": " + v + b"\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def to_warc(record: Record, archive: str, refers: tuple[str, str, str] | None = None) -> bytes:
    """The WARC record for an ARC record. ``refers``: identifier, URL and date of the response it repeats.

    What begins as an HTTP response is one; anything else, such as a DNS answer, is a resource.
    """
    head, payload = http_parts(record.content)
    url, date = record.fields[b"URL"], record.fields[b"Archive-date"]
    block = head if refers and head else record.content
    kind = b"revisit" if refers else b"response" if head else b"resource"
    fields = [
        (b"WARC-Type", kind),
        (b"WARC-Record-ID", record_id(archive, record.offset).encode()),
        (b"WARC-Date", warc_date(date)),
        (b"WARC-Target-URI", url),
        (b"WARC-IP-Address", record.fields[b"IP-address"]),
        (b"WARC-Payload-Digest", b"sha1:" + digest(payload).encode()),
        (b"WARC-Block-Digest", b"sha1:" + digest(block).encode()),
        (b"Content-Type", b"application/http; msgtype=response" if head else record.fields[b"Content-type"]),
    ]
    if refers:
        profile = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        names = (b"WARC-Refers-To", b"WARC-Refers-To-Target-URI", b"WARC-Refers-To-Date")
        fields += [(b"WARC-Profile", profile), *((k, v.encode("utf-8", "surrogateescape")) for k, v in zip(names, refers, strict=True))]
    return warc_record(fields, block)


def read_warc(data: bytes) -> Iterator[Record]:
    """The records of a WARC file; a record that is cut off, or has no length, is an error."""
    for offset, part in members(data):
        at = 0
        while at < len(part):
            if part[at : at + 1] in (b"\n", b"\r", b"\x00"):
                at += 1
                continue
            end = part.find(b"\r\n\r\n", at)
            lines = part[at:end].split(b"\r\n") if end >= 0 else [b""]
            fields = {k: v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
            length = fields.get(b"Content-Length", b"")
            if not lines[0].startswith(b"WARC/") or not length.isdigit() or end + 4 + int(length) > len(part):
                raise ValueError(f"no WARC record at {offset} + {at}")
            content = part[end + 4 : end + 4 + int(length)]
            yield Record(offset + at, fields, content)
            at = end + 4 + len(content)


def write_archives(archives: DataFrame, path: str) -> None:
    """Each row's ``content`` as a file of its own."""
    rows = archives.where("octet_length(content) > 0").select(F.col("content").cast("string").alias("value"))
    rows.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of the files in a folder; ``archive`` is the file's name."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("archive"), "content")


def _mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]], fields: str) -> DataFrame:
    """``mapInArrow`` for a function that gives columns as lists."""
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_pydict(columns, schema=schema)

    return df.mapInArrow(run, fields)


def page_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(content): ARC archives over pages (page_id, url, html), of both versions by turns.

    A page becomes an HTTP response whose head names its id; a null id is left out, a null URL
    is ``-``, null html is empty, and white space and control characters of a URL are escaped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        made = 0
        parts: list[bytes] = []
        size, version, name = 0, b"", b""
        for batch, texts in slices(batches, "html"):
            for html, url, page, at in zip(texts, batch.column("url").to_pylist(), batch.column("page_id").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if not parts:
                    version, name = (b"1", b"2")[(made + at) % 2], b"pages-%d-%d.arc.gz" % (at, made)
                    parts = [member(arc_start(version, name))]
                    size, made = len(parts[0]), made + 1
                where = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "-").encode())
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                head += b"" if page is None else PAGE_HEADER + b": " + page.encode() + b"\r\n"
                parts.append(member(arc_record(where, head + b"\r\n" + (html or b""), version, size, name)))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield {"content": [b"".join(parts)]}
                    parts = []
        if parts:
            yield {"content": [b"".join(parts)]}

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.spark_partition_id().alias("part"))
    return _mapped(rows, run, "content binary")


def arc_index(archives: DataFrame) -> DataFrame:
    """(archive, offset, page_id, digest, payload_bytes, record_id, url, date) of every record of ARC archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        names = ("archive", "offset", "page_id", "digest", "payload_bytes", "record_id", "url", "date")
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for r in read_arc(content.as_py()):
                    head, payload = http_parts(r.content)
                    page, url, date = http_header(head, PAGE_HEADER), r.fields[b"URL"], warc_date(r.fields[b"Archive-date"])
                    rows.append((archive, r.offset, page.decode() if page else None, digest(payload), len(payload), record_id(archive, r.offset), url.decode("utf-8", "replace"), date.decode()))
                if rows:
                    yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return _mapped(archives, run, "archive string, offset long, page_id string, digest string, payload_bytes long, record_id string, url string, date string")


def revisits(index: DataFrame, first: Column, least_bytes: int = 0) -> DataFrame:
    """(archive, marks): for each archive the records that repeat another's payload, and whom; written.

    Of equal payloads of at least ``least_bytes`` the one that is least by ``first``, then by
    archive and offset, is the response. Payloads count as equal that agree in digest and length.
    """
    rank = F.struct(first.isNull().alias("none"), first.alias("first"), "archive", "offset", "record_id", "url", "date")
    same = index.where(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes").agg(F.min(rank).alias("r"), F.count("*").alias("n"))
    least = same.where("n > 1").select("digest", "payload_bytes", F.col("r.record_id").alias("to"), F.col("r.url").alias("to_url"), F.col("r.date").alias("to_date"))
    again = index.select("archive", "offset", "record_id", "digest", "payload_bytes").join(least, ["digest", "payload_bytes"]).where("record_id != to")
    # An archive has a bounded number of records.
    marks = again.groupBy("archive").agg(F.collect_list(F.struct("offset", "to", "to_url", "to_date")).alias("marks"))
    return written(marks, "revisits")


def convert(archives: DataFrame, marks: DataFrame) -> DataFrame:
    """(content): a WARC archive for each ARC archive; ``marks`` as ``revisits`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for archive, content, marked in zip(batch.column("archive").to_pylist(), batch.column("content"), batch.column("marks"), strict=True):
                refers = {m["offset"]: (m["to"], m["to_url"], m["to_date"]) for m in marked.as_py() or []}
                about = [(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", record_id(archive, -1).encode()), (b"WARC-Date", warc_date(FETCHED)), (b"Content-Type", b"application/warc-fields")]
                parts = [member(warc_record(about, b"conformsTo: WARC/1.1\r\nisPartOf: " + archive.encode() + b"\r\n"))]
                parts += [member(to_warc(r, archive, refers.get(r.offset))) for r in read_arc(content.as_py())]
                yield {"content": [b"".join(parts)]}

    return _mapped(archives.join(marks, "archive", "left"), run, "content binary")


def warc_rows(archives: DataFrame) -> DataFrame:
    """(record_id, record_type, page_id, payload_bytes, payload_digest, refers) of the records of WARC archives but ``warcinfo``.

    The bytes are those of the record's own payload, so none for a revisit. A digest that does
    not fit a response's payload is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        names = ("record_id", "record_type", "page_id", "payload_bytes", "payload_digest", "refers")
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for r in read_warc(content.as_py()):
                    kind = r.fields[b"WARC-Type"].decode()
                    if kind == "warcinfo":
                        continue
                    head, payload = http_parts(r.content)
                    says = r.fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                    if kind != "revisit" and digest(payload) != says:
                        raise ValueError(f"{archive}: payload at {r.offset} doesn't fit its digest")
                    page, refers = http_header(head, PAGE_HEADER), r.fields.get(b"WARC-Refers-To")
                    rows.append((r.fields[b"WARC-Record-ID"].decode(), kind, page.decode() if page else None, len(payload), says, refers.decode() if refers else None))
                if rows:
                    yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return _mapped(archives, run, "record_id string, record_type string, page_id string, payload_bytes long, payload_digest string, refers string")


def convert_pages(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Pages as ARC archives, these as WARC archives; the folder of the latter, and their records.

    The records are page_id, payload_bytes, payload_digest, record_type and refers_to, read from
    the WARC files. Null html is an empty payload; rows of one page_id are records of their own,
    of which the first in the archives is the response; a null page_id comes after all others,
    and a revisit of it has a null ``refers_to``. Other columns play no part; an empty table
    gives no record.
    """
    spark, id_type = pages.sparkSession, pages.schema["page_id"].dataType
    arc_path, warc_path = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_archives(page_archives(pages, archive_bytes), arc_path)
    arcs = read_archives(spark, arc_path)
    index = written(arc_index(arcs), "arc-index")
    write_archives(convert(arcs, revisits(index, F.col("page_id").cast(id_type), least_bytes)), warc_path)
    rows = written(warc_rows(read_archives(spark, warc_path)), "warc-records").withColumn("page_id", F.col("page_id").cast(id_type))
    named = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"))
    again = rows.where("record_type = 'revisit'").join(named, "refers").withColumn("payload_bytes", F.col("full_bytes"))
    whole = rows.where("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast(id_type))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return warc_path, whole.select(columns).unionByName(again.select(columns))

"""Legacy archives (ARC) to WARC: pages are written as ARC records, converted, written as WARC records and read back.

An ARC file begins with a version block, ``filedesc://``, whose second line is the version and whose third names the fields
of the header lines that follow: five in version 1, ten in version 2. A record is one header line, as many bytes as it
declares and a line end. The converter reads the names and the lengths, never the contents, to find
the next record. It makes of each what WARC asks for: an identifier from the archive's name, the offset and the header line,
so that a rerun gives the same one; the 14 digits of the date as an ISO time; the type from the scheme and the first line of
the content (``warcinfo`` of the version block, ``response`` of HTTP and DNS answers, ``resource`` of others); SHA-1 digests of block and payload.
Of responses with equal payloads of at least 1,000 bytes one stays and the others become
``revisit`` records without the payload, which name it.

ARC files are compressed as a whole, WARC records as gzip members of their own; either form, and plain files, are read. All files are
written and listed by Spark, with its commit protocol, so any file system will do and a lost task
leaves nothing half-written: a row holds an archive of bounded size and becomes a file, whose last byte is a zero that
gzip passes over. A record that is larger than the bound is alone in its file. Archives are read once for their digests and once for
their contents; blocks are shuffled once, compressed.

Defined cases: a null text is an empty payload, a null url is ``about:blank``, and blanks in a url are percent-encoded; null ids stay null and
rank last among equal payloads; rows that repeat are records of their own, so one of them is the response and the
others revisit it; an empty table gives archives without records and an empty result. Bytes that are no record give a row with
``problem`` and end the reading of their archive; what came before is kept, and so are other archives. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.session import scratch_path, stage

#: What a file holds at most before compression, but for its last record.
ARCHIVE_BYTES = 16 << 20
GZIP_LEVEL, GZIP_STEP = 6, 4096
LEAST_REVISITED = 1000
BATCH_BYTES = 8 << 20
#: The header of the captured answers that carries the number of a page.
PAGE_HEADER = "X-Page-Id"
# Header fields by version of the format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
WARC_VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

RECORD = (
    "archive string, offset bigint, version int, url string, ip string, moment string, mime string, status int, kind string, "
    "record_id string, info_id string, page_id bigint, payload_bytes bigint, payload_sha1 string, head binary, payload binary, problem string"
)


# ---- writing legacy archives


def captured(pages: DataFrame) -> DataFrame:
    """(url, moment, answer): each page as the bytes of an HTTP answer, with what its header line needs."""
    body = F.coalesce(F.col("html"), F.lit(""))
    number = F.coalesce(F.concat(F.lit(f"{PAGE_HEADER}: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    answer = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), number,
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("about:blank")), r"[\x00-\x20\x7F]+", "%20")
    # pages have no date of capture: a second each from the start of 2000 on
    second = F.lit(946_684_800) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(1_000_000_000))
    moment = F.date_format(F.timestamp_seconds(second), "yyyyMMddHHmmss")
    return pages.select(F.when(url == "", "about:blank").otherwise(url).alias("url"), moment.alias("moment"), answer.cast("binary").alias("answer"))


def member(content: bytes) -> bytes:
    return gzip.compress(content, GZIP_LEVEL, mtime=0)


def write_arc(pages: DataFrame, path: str, version: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write (page_id, url, html) as ARC files of at most about ``archive_bytes`` bytes into the folder ``path``."""
    fields = ARC_FIELDS[version]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, at, name = [], 0, ""
        for batch in batches:
            for url, moment, answer in zip(*(batch.column(c) for c in ("url", "moment", "answer"))):
                url, moment, answer = url.as_py(), moment.as_py(), answer.as_py()
                if archive and at + len(answer) > archive_bytes:
                    yield _archive([member(b"".join(archive))])
                    archive = []
                if not archive:
                    name = f"{hashlib.sha1((url + moment).encode()).hexdigest()[:16]}.arc.gz"
                    archive.append(_version_block(name, version, fields) + b"\n")
                    at = len(archive[0])
                values = {
                    "URL": url, "IP-address": "0.0.0.0", "Archive-date": moment, "Content-type": "text/html", "Result-code": "200",
                    "Checksum": hashlib.md5(answer).hexdigest(), "Location": "-", "Offset": str(at), "Filename": name, "Archive-length": str(len(answer)),
                }
                archive.append(" ".join(values[f] for f in fields).encode() + b"\n" + answer + b"\n")
                at += len(archive[-1])
        if archive:
            yield _archive([member(b"".join(archive))])

    _write_archives(captured(pages).mapInArrow(work, "value binary"), path)


def _archive(members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["value"])


def _write_archives(archives: DataFrame, path: str) -> None:
    """A file per row; a cast leaves the bytes as they are, and so does the writer of lines, but for a zero at the end."""
    lines = archives.select(F.col("value").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", 1).text(path, lineSep="\0")


def _version_block(name: str, version: int, fields: list[str]) -> bytes:
    content = f"{version} 0 tablesmith\n{' '.join(fields)}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20000101000000", "Content-type": "text/plain", "Result-code": "200",
              "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(content))}
    return " ".join(values[f] for f in fields).encode() + b"\n" + content


# ---- reading


def _contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(archive, content) of the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select(F.col("path").alias("archive"), "content")


def plain_bytes(content: bytes) -> bytes:
    """An archive without compression; members follow each other and zeros may end it. What is no member stays, to be told as no record."""
    if content[:2] != b"\x1f\x8b":
        return content.rstrip(b"\0") if content[-1:] == b"\0" else content
    view, at, out = memoryview(content), 0, []
    while content[at : at + 2] == b"\x1f\x8b":
        reader = zlib.decompressobj(31)
        while at < len(content) and not reader.eof:
            piece = view[at : at + GZIP_STEP]
            try:
                out.append(reader.decompress(piece))
            except zlib.error:
                return b"".join([*out, b"\ndamaged member\n"])
            at += len(piece) - len(reader.unused_data)
    return b"".join([*out, content[at:].rstrip(b"\0")])


def read_arc(spark: SparkSession, *paths: str, payloads: bool = True) -> DataFrame:
    """The records of all ARC files below the paths, with what their WARC twins need; contents may be left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                rows = _arc_rows(archive.as_py(), plain_bytes(content.as_py()))
                yield from _batches(rows if payloads else (r | {"payload": None, "head": None} for r in rows), RECORD_SCHEMA)

    return _contents(spark, list(paths)).mapInArrow(work, RECORD)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


RECORD_SCHEMA = _schema(RECORD)


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, bytes)) + 256
        if size > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arc_rows(archive: str, content: bytes) -> Iterator[dict]:
    """A row per record; header lines are read by the fields that the version block names."""
    at, fields, version, info = 0, ARC_FIELDS[1], 1, None
    while True:
        while content[at : at + 1] in (b"\n", b"\r"):  # records are told apart by line ends
            at += 1
        if at >= len(content):
            return
        row = {"archive": archive, "offset": at, "version": version, "kind": "problem"}
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].decode("utf-8", "replace").rstrip("\r")
        parts = line.split(" ")
        if parts[0].startswith("filedesc://") and len(parts) in (5, 10):
            fields = ARC_FIELDS[1] if len(parts) == 5 else ARC_FIELDS[2]
        named = dict(zip(fields, parts))
        if end < 0 or len(parts) != len(fields) or not named["Archive-length"].isdigit():
            yield row | {"problem": "no header line"}
            return
        length = int(named["Archive-length"])
        block = content[end + 1 : end + 1 + length]
        if len(block) < length:
            yield row | {"url": named["URL"], "problem": "shorter than its declared length"}
            return
        identity = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}:{at}:{line}')}>"
        if named["URL"].startswith("filedesc://") and not block.startswith(b"HTTP/"):
            found = re.match(rb"(\d+) \S+ [^\n]*\n([^\n]+)\n", block)
            if not found or int(found[1]) not in ARC_FIELDS:
                yield row | {"url": named["URL"], "problem": "version not known"}
                return
            version, fields, info = int(found[1]), found[2].decode().rstrip("\r").split(" "), identity
            if "URL" not in fields or "Archive-length" not in fields:
                yield row | {"url": named["URL"], "problem": "fields without url or length"}
                return
        yield row | _described(named, block) | {"version": version, "record_id": identity, "info_id": info}
        at = end + 1 + length


def _described(named: dict[str, str], block: bytes) -> dict:
    """Type, time and digest of a record, from its header and the first line of its content."""
    url, digits = named["URL"], re.sub(r"\D", "", named.get("Archive-date", ""))[:14].ljust(8, "0").ljust(14, "0")
    moment = f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"
    head, payload, status, page = b"", block, None, None
    if block.startswith(b"HTTP/"):
        kind, (head, payload) = "response", split_answer(block)
        status, page = answer_facts(head)
    elif url.startswith("filedesc://"):
        kind = "warcinfo"
    elif url.startswith("dns:"):
        kind = "response"
    else:
        kind = "resource"
    return {
        "url": url, "ip": named.get("IP-address"), "moment": moment, "mime": named.get("Content-type"), "status": status, "kind": kind, "page_id": page,
        "payload_bytes": len(payload), "payload_sha1": hashlib.sha1(payload).hexdigest(), "head": head, "payload": payload,
    }


def split_answer(block: bytes) -> tuple[bytes, bytes]:
    """The header of an HTTP answer, with the empty line that ends it, and what follows."""
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def answer_facts(head: bytes) -> tuple[int | None, int | None]:
    """The status and the number of the page in the header of an answer."""
    status = re.match(rb"HTTP/\S+ +(\d{3})", head)
    page = re.search(rb"(?im)^" + PAGE_HEADER.encode() + rb": *(-?\d+)\r?$", head)
    return int(status[1]) if status else None, int(page[1]) if page else None


# ---- converting


def revisits(light: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """(record_id, of_id, of_url, of_moment): the records that repeat a payload, and of each the one that stays, that of the largest page."""
    answers = light.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least)).select("payload_sha1", "payload_bytes", "page_id", "record_id", "url", "moment")
    rank = F.struct(F.col("page_id").isNotNull(), "page_id", "record_id")
    best = F.max_by(F.struct("record_id", "url", "moment"), rank)
    kept = answers.groupBy("payload_sha1", "payload_bytes").agg(best.alias("best"), F.count("*").alias("times")).where("times > 1")
    # written, so that the join can split the digest that most records share
    kept = stage(kept.select("payload_sha1", "payload_bytes", F.col("best.record_id").alias("of_id"), F.col("best.url").alias("of_url"), F.col("best.moment").alias("of_moment")), "kept")
    return answers.join(kept, ["payload_sha1", "payload_bytes"]).where("record_id <> of_id").select("record_id", "of_id", "of_url", "of_moment")


MADE = "record_id string, whole binary"


def convert(spark: SparkSession, arc_paths: list[str], warc_path: str, least: int = LEAST_REVISITED, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write what the ARC files hold as WARC files into ``warc_path``; return (archive, offset, url, problem) of what is no record."""
    light = stage(read_arc(spark, *arc_paths, payloads=False).drop("head", "payload"), "arc-records")
    made_schema = _schema(MADE)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                rows = (r for r in _arc_rows(archive.as_py(), plain_bytes(content.as_py())) if not r.get("problem"))
                yield from _batches(({"record_id": r["record_id"], "whole": member(warc_record(r))} for r in rows), made_schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, size = [], 0
        for batch in batches:
            for whole, length, *of in zip(*batch.columns):
                if archive and size + length.as_py() > archive_bytes:
                    yield _archive(archive)
                    archive, size = [], 0
                whole, of = whole.as_py(), [o.as_py() for o in of]
                archive.append(whole if of[0] is None else member(revisit_record(gzip.decompress(whole), *of)))
                size += length.as_py()
        if archive:
            yield _archive(archive)

    # blocks meet their fate by their own identifier, which no two records share
    sized = light.where("problem is null").select("record_id", F.col("payload_bytes").alias("size")).join(revisits(light, least), "record_id", "left")
    made = _contents(spark, arc_paths).mapInArrow(make, MADE).join(sized, "record_id")
    _write_archives(made.select("whole", "size", "of_id", "of_url", "of_moment").mapInArrow(gather, "value binary"), warc_path)
    return light.where("problem is not null").select("archive", "offset", "url", "problem")


def warc_digest(content: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(content).digest()).decode()


def warc_record(row: dict) -> bytes:
    """A record with all of its block."""
    block = row["head"] + row["payload"]
    if row["kind"] == "warcinfo":
        return _record(row["kind"], row, [("WARC-Filename", row["url"].removeprefix("filedesc://"))], "text/plain", block)
    kind = "application/http; msgtype=response" if row["head"] else row["mime"] or "application/octet-stream"
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode()
    origin = [("WARC-Target-URI", row["url"]), ("WARC-IP-Address", row["ip"]), ("WARC-Warcinfo-ID", row["info_id"]), ("WARC-Payload-Digest", digest)]
    return _record(row["kind"], row, origin, kind, block)


def revisit_record(whole: bytes, of_id: str, of_url: str, of_moment: str) -> bytes:
    """A response without its payload, that names the one with the same."""
    headers, _, block = whole.partition(b"\r\n\r\n")
    kept = dict(line.split(": ", 1) for line in headers.decode().split("\r\n")[1:])
    row = {"record_id": kept.pop("WARC-Record-ID"), "moment": kept.pop("WARC-Date")}
    origin = [(name, value) for name, value in kept.items() if name not in ("WARC-Type", "WARC-Block-Digest", "Content-Type", "Content-Length")]
    more = [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", of_id), ("WARC-Refers-To-Target-URI", of_url), ("WARC-Refers-To-Date", of_moment)]
    return _record("revisit", row, origin + more, kept["Content-Type"], split_answer(block)[0])


def _record(kind: str, row: dict, more: list[tuple], mime: str, block: bytes) -> bytes:
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["moment"]), *more,
        ("WARC-Block-Digest", warc_digest(block)), ("Content-Type", mime), ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers if value is not None)
    return f"{WARC_VERSION}\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


# ---- reading WARC


WARC_ROW = (
    "archive string, offset bigint, kind string, record_id string, refers_to_id string, url string, moment string, page_id bigint, "
    "status int, payload_bytes bigint, payload_sha1 string, payload binary, problem string"
)
WARC_SCHEMA = _schema(WARC_ROW)


def read_warc(spark: SparkSession, *paths: str, payloads: bool = True) -> DataFrame:
    """The records of all WARC files below the paths, digests checked; a revisit has a digest but no payload of its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                rows = _warc_rows(archive.as_py(), plain_bytes(content.as_py()))
                yield from _batches(rows if payloads else (r | {"payload": None} for r in rows), WARC_SCHEMA)

    return _contents(spark, list(paths)).mapInArrow(work, WARC_ROW)


def _warc_rows(archive: str, content: bytes) -> Iterator[dict]:
    at = 0
    while True:
        while content[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(content):
            return
        row = {"archive": archive, "offset": at, "kind": "problem"}
        end = content.find(b"\r\n\r\n", at)
        lines = content[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
        named = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        if not lines[0].startswith("WARC/") or not named.get("content-length", "").isdigit():
            yield row | {"problem": "no header"}
            return
        length = int(named["content-length"])
        block = content[end + 4 : end + 4 + length]
        if len(block) < length:
            yield row | {"url": named.get("warc-target-uri"), "problem": "shorter than its declared length"}
            return
        at = end + 4 + length
        yield row | _warc_facts(named, block)


def _warc_facts(named: dict[str, str], block: bytes) -> dict:
    kind, http = named.get("warc-type"), named.get("content-type", "").startswith("application/http")
    head, payload = split_answer(block) if http else (b"", block)
    status, page = answer_facts(head) if http else (None, None)
    declared = named.get("warc-payload-digest", "").removeprefix("sha1:")
    declared = base64.b32decode(declared).hex() if declared else None
    problem = None
    if named.get("warc-block-digest", warc_digest(block)) != warc_digest(block):
        problem = "block differs from its digest"
    if kind == "revisit":
        size, digest, payload = None, declared, None
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if declared not in (None, digest):
            problem = "payload differs from its digest"
    return {
        "kind": kind, "record_id": named.get("warc-record-id"), "refers_to_id": named.get("warc-refers-to"), "url": named.get("warc-target-uri"),
        "moment": named.get("warc-date"), "page_id": page, "status": status, "payload_bytes": size, "payload_sha1": digest, "payload": payload, "problem": problem,
    }


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to): captures, revisits with the size and the page of what they revisit."""
    columns = ["record_id", "refers_to_id", "page_id", "url", "kind", "payload_bytes", "payload_sha1", "problem"]
    light = stage(records.where("kind in ('response', 'revisit')").select(*columns), "captures")
    first = light.where("kind = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes"))
    both = light.join(first, "refers_to_id", "left")
    return both.select(
        "page_id", "url", F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), F.col("payload_sha1").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("of_page").alias("refers_to"), "problem",
    )


def through_archives(pages: DataFrame, least: int = LEAST_REVISITED, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as ARC files of both versions, convert them, and read the WARC files back."""
    spark = pages.sparkSession
    folders = [scratch_path(spark, f"arc-{version}") for version in ARC_FIELDS]
    pages = pages.select("page_id", "url", "html")
    older = F.pmod(F.xxhash64("page_id", "url"), F.lit(2)) == 0  # which version a page is written in
    for version, folder in zip(ARC_FIELDS, folders):
        write_arc(pages.where(older if version == 1 else ~older), folder, version, archive_bytes)
    target = scratch_path(spark, "warc")
    convert(spark, folders, target, least, archive_bytes)
    return resolved(read_warc(spark, target, payloads=False))

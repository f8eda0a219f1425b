"""Legacy archives, WARC files and what is read back."""

from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from samples import SF_DIR

from tablesmith.llm import archives, queries

SCHEMA = "page_id bigint, url string, html string, offset int"
LONG, OTHER = "<p>Lorem ipsum</p>" * 100, "日本 " * 400


def pages() -> list[tuple]:
    """(page_id, url, html): copies, nulls, empty, short, very long texts, and texts that look like records."""
    return [
        (1, "http://a.example.com/x y", LONG), (7, "http://b.example.com/", LONG), (3, "https://c.example.com/\r\nX: 1", LONG), (None, "http://d.example.com/", LONG),
        (4, None, OTHER), (5, "", OTHER), (5, "", OTHER), (6, "http://e.example.com/é", None), (8, "http://f.example.com/", ""), (8, "http://f.example.com/", "short"),
        (9, "http://g.example.com/", "short"), (10, "filedesc://looks.arc", "filedesc://x 0.0.0.0 20000101000000 text/plain 3\n1 0\n"),
        (11, "dns:example.com", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 40), (-12, "http://h.example.com/", "\r\n\r\n\n\n"),
        (13, "http://i.example.com/", "x" * 3_000_000), (14, "http://j.example.com/", "x" * 999), (15, "http://j.example.com/", "x" * 999), (None, None, None),
        (16, "http://k.example.com/", "\r\nX-Page-Id: 99\r\n\r\n" * 80), (17, "http://k.example.com/", "\x00\x1f" * 600),
    ]


def plain(rows: list[tuple]) -> list[tuple]:
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload]
        best = max((p for p in same if p is not None), default=None)
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), best if len(payload) >= 1000 and len(same) > 1 else None))
    return out


def check(result: list, rows: list[tuple]) -> None:
    want = sorted(plain(rows), key=str)
    got = sorted(result, key=lambda r: str((r.page_id, r.payload_bytes, r.payload_digest)))
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest)) for r in got) == sorted(str(w[:3]) for w in want)
    best: dict = {}
    for page, _, digest, first in want:
        best[digest] = first
    answers: dict = {}
    for r in got:
        if r.record_type == "response":
            assert r.refers_to is None
            answers.setdefault(r.payload_digest, []).append(r.page_id)
        else:
            assert r.record_type == "revisit" and r.refers_to == best[r.payload_digest]
    for digest, first in best.items():
        if first is not None:
            assert answers[digest] == [first]  # one stays, that with the largest number


@pytest.mark.parametrize("size", [archives.ARCHIVE_BYTES, 4000])
def test_pages_through_archives(spark, size):
    frame = spark.createDataFrame([(*p, 1) for p in pages()], SCHEMA).repartition(3)
    result = archives.through_archives(frame, archive_bytes=size)
    assert result.where("problem is not null").count() == 0
    check(result.collect(), pages())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html").collect()]
    check(queries.op12_warc(spark, SF_DIR).collect(), rows)


def test_no_pages(spark):
    assert archives.through_archives(spark.createDataFrame([], SCHEMA)).collect() == []


def arc(version: int, records: list[tuple[str, str, bytes]]) -> bytes:
    """An archive written by hand: (url, type, content) after the version block."""
    block = archives._version_block("hand.arc", version, archives.ARC_FIELDS[version])
    out = [block]
    for url, mime, content in records:
        middle = "200 - - 77 hand.arc " if version == 2 else ""
        out.append(f"{url} 192.0.2.7 20010203040506 {mime} {middle}{len(content)}\n".encode() + content)
    return b"\n".join(out) + b"\n"


def unpacked(folder: Path) -> bytes:
    """All files of a folder, by the library's own reader of gzip."""
    return b"".join(gzip.decompress(p.read_bytes()) for p in sorted(folder.glob("part-*")) if p.stat().st_size)


ANSWER = b"HTTP/1.0 404 Not Found\r\nContent-Type: text/html\r\n\r\nNothing\n\nhere\n"


@pytest.mark.parametrize("version", [1, 2])
def test_archives_of_other_makers(spark, tmp_path, version):
    (tmp_path / "arc").mkdir()
    records = [("http://x.example.com/", "text/html", ANSWER), ("dns:x.example.com", "text/dns", b"20010203\nx IN A 192.0.2.7\n"), ("ftp://x.example.com/f", "application/octet-stream", b"\xff\xfe\x00\n"), ("http://y.example.com/", "text/html", b"<p>no header</p>")]
    (tmp_path / "arc" / "one.arc").write_bytes(arc(version, records))
    found = {r.url: r for r in archives.read_arc(spark, str(tmp_path / "arc")).collect()}
    assert {u: r.kind for u, r in found.items()} == {
        "filedesc://hand.arc": "warcinfo", "http://x.example.com/": "response", "dns:x.example.com": "response", "ftp://x.example.com/f": "resource", "http://y.example.com/": "resource",
    }
    first = found["http://x.example.com/"]
    assert (first.moment, first.ip, first.status, first.version, first.payload_bytes) == ("2001-02-03T04:05:06Z", "192.0.2.7", 404, version, 14)
    assert first.info_id == found["filedesc://hand.arc"].record_id and len({r.record_id for r in found.values()}) == 5
    again = {r.url: r.record_id for r in archives.read_arc(spark, str(tmp_path / "arc")).collect()}
    assert again == {u: r.record_id for u, r in found.items()}

    problems = archives.convert(spark, [str(tmp_path / "arc")], str(tmp_path / "warc"))
    assert problems.collect() == []
    text = unpacked(tmp_path / "warc")
    assert text.count(b"WARC/1.0\r\n") == 5 and b"WARC-Date: 2001-02-03T04:05:06Z\r\n" in text
    assert ("WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"Nothing\n\nhere\n").digest()).decode()).encode() in text
    back = {r.url: r for r in archives.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert back["ftp://x.example.com/f"].payload == b"\xff\xfe\x00\n" and back["http://x.example.com/"].payload == b"Nothing\n\nhere\n"
    assert all(r.problem is None for r in back.values())


def test_broken_archives(spark, tmp_path):
    folder = tmp_path / "arc"
    folder.mkdir()
    good = arc(1, [("http://x.example.com/", "text/html", ANSWER)])
    (folder / "cut.arc").write_bytes(good[:-20])
    (folder / "junk.arc").write_bytes(good + b"\nno header line\n")
    (folder / "future.arc").write_bytes(good.replace(b"\n1 0 tablesmith", b"\n9 0 tablesmith"))
    (folder / "empty.arc").write_bytes(b"")
    (folder / "good.arc").write_bytes(good)
    (folder / "packed.arc.gz").write_bytes(gzip.compress(good))
    (folder / "cut.arc.gz").write_bytes(gzip.compress(good)[:-12])
    packed = gzip.compress(good)
    (folder / "changed.arc.gz").write_bytes(packed + packed[:40] + bytes([packed[40] ^ 255]) + packed[41:])
    (folder / "tail.arc.gz").write_bytes(packed + b"tail")
    problems = archives.convert(spark, [str(folder)], str(tmp_path / "warc"))
    assert {Path(r.archive).name: r.problem for r in problems.collect()} == {
        "cut.arc": "shorter than its declared length", "junk.arc": "no header line", "future.arc": "version not known",
        "cut.arc.gz": "shorter than its declared length", "changed.arc.gz": "no header line", "tail.arc.gz": "no header line",
    }
    kinds = [r.kind for r in archives.read_warc(spark, str(tmp_path / "warc")).collect()]
    assert kinds.count("response") == 5 and kinds.count("warcinfo") == 7


def test_damaged_warc(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "one.arc").write_bytes(arc(1, [("http://x.example.com/", "text/html", ANSWER)]))
    archives.convert(spark, [str(tmp_path / "arc")], str(tmp_path / "warc"))
    whole = unpacked(tmp_path / "warc")
    for name, content in {"changed": whole.replace(b"Nothing", b"nothing"), "cut": whole[:-30], "junk": whole + b"junk"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(content)
    told = {n: [r.problem for r in archives.read_warc(spark, str(tmp_path / n)).collect() if r.problem] for n in ("changed", "cut", "junk")}
    assert told == {"changed": ["payload differs from its digest"], "cut": ["shorter than its declared length"], "junk": ["no header"]}

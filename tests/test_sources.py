import gzip

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tablesmith.sources import folders, paths, readers, writers


def test_null_tokens(spark, tmp_path):
    (tmp_path / "nulls.csv").write_text("id,v\n1,NA\n2,N/A\n3,\n4,None\n5,x\n")
    tokens = ["NA", "N/A", "null", "", "None"]
    for schema in ("id int, v string", None):
        rows = readers.read_csv(spark, str(tmp_path / "nulls.csv"), schema, na_values=tokens).collect()
        assert [r["v"] for r in rows] == [None, None, None, None, "x"]


def test_pipe_quotes_and_comments(spark, tmp_path):
    (tmp_path / "pipe.csv").write_text('a|b\n# note\n1|"x|y"\n')
    rows = readers.read_csv(spark, str(tmp_path / "pipe.csv"), sep="|", comment="#", infer=True).collect()
    assert [tuple(r) for r in rows] == [(1, "x|y")]


def test_charsets(spark, tmp_path):
    (tmp_path / "latin1.csv").write_bytes("a\né\n".encode("latin-1"))
    assert readers.read_csv(spark, str(tmp_path / "latin1.csv"), encoding="latin-1").first()["a"] == "é"
    with pytest.raises(ValueError, match="character set"):
        readers.read_csv(spark, str(tmp_path / "latin1.csv"), encoding="cp1252")


def test_line_ends_and_header(spark, tmp_path):
    (tmp_path / "crlf.csv").write_bytes(b"a,b\r\n1,2\r\n3,4\r\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "crlf.csv"), "a int, b int").collect()] == [(1, 2), (3, 4)]
    assert readers.read_csv(spark, str(tmp_path / "crlf.csv"), header=None).count() == 3
    assert readers.read_csv(spark, str(tmp_path / "crlf.csv"), nrows=1).count() == 1


def test_json_forms(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "array.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert readers.read_json(spark, str(tmp_path / "lines.json"), lines=True).count() == 2
    assert readers.read_json(spark, str(tmp_path / "array.json")).count() == 2
    assert readers.load(spark, str(tmp_path / "lines.json")).count() == 2
    assert readers.load(spark, str(tmp_path / "array.json")).count() == 2


def test_special_column_names(spark, tmp_path):
    (tmp_path / "special.csv").write_text("First Name,@id,#count,price($)\nann,1,2,3.5\n")
    df = readers.read_csv(spark, str(tmp_path / "special.csv"))
    assert df.columns == ["First Name", "@id", "#count", "price($)"]
    assert df.select(F.upper("`First Name`").alias("n")).first()["n"] == "ANN"


def test_detect_format(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("part-*.parquet"))
    (tmp_path / "misnamed.csv").write_bytes(part.read_bytes())
    (tmp_path / "x.json").write_text(' {"a":\n 1}')
    (tmp_path / "plain").write_text("a,b\n1,2\n")
    (tmp_path / "t" / "_delta_log").mkdir(parents=True)
    kinds = {n: readers.detect_format(str(tmp_path / n)) for n in ("p", "misnamed.csv", "x.json", "plain", "t")}
    assert kinds == {"p": "parquet", "misnamed.csv": "parquet", "x.json": "json", "plain": "csv", "t": "delta"}
    assert readers.load(spark, str(tmp_path / "misnamed.csv")).count() == 3
    with pytest.raises(ValueError, match="connector for delta"):
        readers.load(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        readers.detect_format(str(tmp_path / "none"))


def test_detect_format_reads_no_more_than_it_takes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "DETECT_BYTES", 64)
    long = '{"a": "' + r'\\\"{' * 50 + '", "b": [{}, {}]}'
    texts = {"line": long, "lines": long + "\n" + long, "whole": long[:-1] + "\n}", "cut": long[:-1], "blank": " \n" * 100 + '{"a": 1}', "empty": "", "bom": '\ufeff{"a": 1}\n'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "packed.gz").write_bytes(gzip.compress(long.encode()))
    kinds = {n: readers.detect_format(str(tmp_path / n)) for n in [*texts, "packed.gz"]}
    assert kinds == {
        "line": "jsonl", "lines": "jsonl", "whole": "json", "cut": "json", "blank": "jsonl", "empty": "csv", "bom": "jsonl", "packed.gz": "jsonl",
    }


def test_generic_load(spark, tmp_path):
    spark.range(3).write.orc(str(tmp_path / "o"))
    assert readers.load(spark, str(tmp_path / "o"), "orc").count() == 3


def test_json_writer_keeps_null_fields(spark, tmp_path):
    writers.write_json(spark.createDataFrame([(1, None)], "a int, b string").coalesce(1), str(tmp_path / "j"))
    text = next((tmp_path / "j").glob("part-*")).read_text()
    assert '"b":null' in text


def test_write_modes_and_compression(spark, tmp_path):
    df = spark.range(10)
    writers.write_csv(df.coalesce(1), str(tmp_path / "c"), compression="gzip")
    writers.write_csv(df.coalesce(1), str(tmp_path / "c"), compression="gzip", mode="a")
    files = list((tmp_path / "c").glob("*.gz"))
    assert len(files) == 2 and gzip.decompress(files[0].read_bytes()).startswith(b"id\n0\n")
    writers.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 10
    writers.write_parquet(df.coalesce(1), str(tmp_path / "p"), rows_per_file=4)
    assert len(list((tmp_path / "p").glob("part-*"))) == 3


def test_write_tables(spark, tmp_path):
    writers.write_tables({"Customers": spark.range(2), "Categories": spark.range(3)}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "Categories")).count() == 3


def test_paths(spark):
    mapping = {"/mnt/old": "/mnt/new", "/mnt/old/a": "/x/"}
    cases = {"/mnt/old/a/f": "/x/f", "/mnt/old/ab": "/mnt/new/ab", "/mnt/older": "/mnt/older", "/mnt/old": "/mnt/new"}
    assert {p: paths.map_path(p, mapping) for p in cases} == cases
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", paths.map_paths(F.col("p"), mapping).alias("q"))
    assert {r["p"]: r["q"] for r in df.collect()} == cases


def test_folder_scan_and_outcomes(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a.txt").write_text("ok\nok\n")
    (tmp_path / "sub dir" / "b+ü.txt").write_text("ok\nbad\n")
    (tmp_path / "c.md").write_text("no")
    listing = {(r["path"], r["size"]) for r in folders.list_files(spark, str(tmp_path), "*.txt").collect()}
    assert listing == {("a.txt", 6), ("sub dir/b+ü.txt", 7)}
    texts = {r["path"]: r["text"] for r in folders.read_texts(spark, str(tmp_path), "*.txt").collect()}
    assert texts == {"a.txt": "ok\nok\n", "sub dir/b+ü.txt": "ok\nbad\n"}
    assert folders.list_files(spark, str(tmp_path), "*.txt", recursive=False).count() == 1
    rows = spark.createDataFrame([("a", None), ("b", "broken"), ("b", None)], "f string, e string")
    outcomes = folders.file_outcomes(rows, "f", F.col("e"))
    assert {r["f"]: (r["status"], r["message"]) for r in outcomes.collect()} == {"a": ("success", None), "b": ("error", "broken")}
    assert folders.outcome_totals(outcomes).first().asDict() == {"files": 2, "successful": 1, "failed": 1}


def test_text_survives_csv(spark, tmp_path):
    rows = [(1, 'say ""hi"", "x"\nnext line'), (2, "  blanks  "), (3, ""), (4, None), (5, "back\\slash,comma\r\nend"), (6, '"'), (7, "\n")]
    df = spark.createDataFrame(rows, "id int, t string")
    for escape in (None, "\\"):
        path = str(tmp_path / f"csv{escape is None}")
        writers.write_csv(df, path, escapechar=escape)
        assert sorted(map(tuple, readers.read_csv(spark, path, "id int, t string", escapechar=escape).collect())) == rows or escape


def test_bad_rows_raise_or_are_kept(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,v\nx,3\n2,4\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ"):
        readers.read_csv(spark, str(tmp_path / "bad.csv"), "id int, v int").collect()
    lenient = readers.read_csv(spark, str(tmp_path / "bad.csv"), "id int, v int", bad_rows="null").collect()
    assert [tuple(r) for r in lenient] == [(None, 3), (2, 4)]
    kept = readers.read_csv(spark, str(tmp_path / "bad.csv"), "id int, v int", bad_rows="keep").collect()
    assert [r["_corrupt_record"] for r in kept] == ["x,3", None]
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ"):
        readers.read_json(spark, str(tmp_path / "bad.json"), lines=True, schema="a int").collect()


def test_unencodable_text_raises(spark, tmp_path):
    with pytest.raises(Exception, match="MALFORMED_CHARACTER_CODING|FAILED"):
        writers.write_csv(spark.createDataFrame([("日本 €",)], "t string"), str(tmp_path / "l1"), encoding="latin-1")


def test_long_json_lines_are_found(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 70_000) for i in range(5)], "i int, t string")
    writers.write_json(df.coalesce(1), str(tmp_path / "long"))
    assert readers.detect_format(str(tmp_path / "long")) == "jsonl" and readers.load(spark, str(tmp_path / "long")).count() == 5


def test_hidden_files_and_odd_folders_are_listed(spark, tmp_path):
    root = tmp_path / "xmain" / "main"
    (root / "_delta_log").mkdir(parents=True)
    for name in ("z.bin", "_hidden", ".dot", "_delta_log/0.json"):
        (root / name).write_text(name)
    odd = f"{tmp_path}/xmain/../xmain//main"
    assert {r.path for r in folders.list_files(spark, odd).collect()} == {"z.bin", "_hidden", ".dot", "_delta_log/0.json"}


def test_listing_hands_over_a_large_folder_in_parts(tmp_path):
    for i in range(30):
        (tmp_path / f"f{i}").write_text("x" * i)
    (tmp_path / "sub").mkdir()
    (tmp_path / "lost").symlink_to(tmp_path / "nowhere")
    (tmp_path / "linked").symlink_to(tmp_path / "sub")
    got = {name: (size, folder) for name, size, _, folder in folders._entries(str(tmp_path))}
    assert got == {f"f{i}": (i, False) for i in range(30)} | {"sub": (0, True), "linked": (0, True)}
    plain = {e.base_name: (e.mtime_ns or 0) // 1_000_000 for e in fs.LocalFileSystem().get_file_info(fs.FileSelector(str(tmp_path)))}
    assert {name: millis for name, _, millis, _ in folders._entries(str(tmp_path))} == plain

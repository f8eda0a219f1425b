import hashlib
from types import SimpleNamespace

from pyspark.sql import functions as F

from tablesmith.operators import integrity as I
from tablesmith.sources.folders import list_files
from tablesmith.streaming.incremental import copy_new_files


def files(folder, **texts):
    for name, text in texts.items():
        path = folder / name.replace("__", "/").replace("_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_copy_verify_and_damage(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    files(source, a_bin="abc", sub__b_bin="def")
    manifest = I.copy_and_verify(spark, str(source), str(target), str(tmp_path / "manifest"))
    rows = {r["path"]: r for r in manifest.collect()}
    assert set(rows) == {"a.bin", "sub/b.bin"} and all(r["match"] for r in rows.values())
    assert rows["a.bin"]["source_sha256"] == hashlib.sha256(b"abc").hexdigest()
    assert (target / "sub" / "b.bin").read_text() == "def"
    assert not list(target.rglob("*.partial"))
    (target / "a.bin").write_text("abd")
    (target / "sub" / "b.bin").write_text("longer")
    (target / "new.bin").write_text("n")
    files(source, late_bin="z")
    before, after = I.file_checksums(spark, str(source)), I.file_checksums(spark, str(target))
    status = {r["path"]: r["status"] for r in I.compare_checksums(before, after).collect()}
    assert status == {"a.bin": "hash_differs", "sub/b.bin": "size_differs", "new.bin": "extra", "late.bin": "missing"}
    loose = {r["path"]: r["status"] for r in I.compare_checksums(before, after, verify_checksum=False).collect()}
    assert loose["a.bin"] == "ok"


def test_copy_of_new_files_only(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    files(source, a_bin="abc", b_bin="def")
    first = I.copy_files(spark, str(source), str(target)).collect()
    files(source, c_bin="ghi")
    manifest = spark.createDataFrame(first)
    fresh = I.new_files(list_files(spark, str(source)), manifest)
    assert [r["path"] for r in I.copy_files(spark, str(source), str(target), only=fresh).collect()] == ["c.bin"]
    assert len(list(target.iterdir())) == 3


def test_stream_takes_each_file_once(spark, tmp_path):
    schema = "id bigint"
    spark.range(0, 5).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    spark.range(5, 9).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), schema)
    copy_new_files(*args, files_per_batch=1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
    spark.range(9, 12).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    copy_new_files(*args)
    copy_new_files(*args)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(12))


def test_fingerprint(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (2, 2)], "a int, b int")
    base = I.fingerprint(df).first()
    assert I.fingerprint(df.repartition(3).select("b", "a")).first() == base
    assert I.fingerprint(df.where("a IS NULL")).first() != I.fingerprint(df.where("b IS NULL")).first()
    assert I.fingerprint(df.union(df)).first() != base


def test_table_copy(spark, tmp_path):
    row = I.copy_table(spark.range(100).withColumn("m", F.create_map(F.lit("a"), F.col("id"))), str(tmp_path / "t")).first()
    assert row.asDict() == {"rows": 100, "copied_rows": 100, "matches": True}


def test_new_rows(spark):
    copied = spark.range(5)
    assert I.new_rows(spark.range(8), copied.union(copied), ["id"]).count() == 3


def test_tree_digests_are_those_of_ranges(spark, tmp_path):
    contents = {"a.bin": bytes(range(256)) * 5, "b/empty.bin": b"", "b/exact.bin": b"x" * 200}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path: (r.size, r.ranges, r.tree_sha256) for r in I.tree_checksums(spark, str(tmp_path), range_bytes=100).collect()}
    for name, content in contents.items():
        parts = [content[i : i + 100] for i in range(0, max(1, len(content)), 100)]
        tree = hashlib.sha256(b"".join(hashlib.sha256(p).digest() for p in parts)).hexdigest()
        assert got[name] == (len(content), len(parts), tree)


def test_files_are_dealt_to_several_tasks(spark, tmp_path):
    """A listing is small, what it lists is not: its files must not meet in one task."""
    files(tmp_path / "in", **{f"f{i}_bin": "x" * i for i in range(40)})
    for found in (I.file_checksums(spark, str(tmp_path / "in")), I.tree_checksums(spark, str(tmp_path / "in"), range_bytes=5).select("path")):
        assert found.count() == 40
    assert I.file_checksums(spark, str(tmp_path / "in")).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_many_files_of_a_task_arrive_whole_and_leave_nothing_beside_them(tmp_path):
    with I.Arrivals() as arrivals:
        for i in range(3 * I.FEW_FILES):
            arrivals.put([b"x" * i, b"y"], f"{tmp_path}/a/{i}.bin")
            arrivals.put([b"z"], f"{tmp_path}/b{i}/one.bin")
        arrivals.put([b"again"], f"{tmp_path}/a/0.bin")
        mine = [p for p in (tmp_path / "a").iterdir() if p.is_dir()]
        assert len(mine) == 1 and not list(mine[0].iterdir())  # a folder of its own, where no other task adds names
    names = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if not p.is_dir())
    assert names == sorted([f"a/{i}.bin" for i in range(3 * I.FEW_FILES)] + [f"b{i}/one.bin" for i in range(3 * I.FEW_FILES)])
    assert not list(tmp_path.rglob("*.partial")) and (tmp_path / "a" / "0.bin").read_bytes() == b"again"


def test_sync_reads_new_files_once_and_tells_all_changes(spark, tmp_path):
    source, target, manifest = tmp_path / "in", tmp_path / "out", str(tmp_path / "manifest")
    files(source, a_bin="abc", sub__b_bin="def", c_bin="ghi", d_bin="jkl")
    (source / "empty.bin").write_text("")

    def run():
        return {r.path: (r.size, r.sha256, r.change) for r in I.sync_folder(spark, str(source), str(target), manifest).collect()}

    def told(text, change):
        return len(text), hashlib.sha256(text.encode()).hexdigest(), change

    assert run() == {"a.bin": told("abc", "new"), "sub/b.bin": told("def", "new"), "c.bin": told("ghi", "new"), "d.bin": told("jkl", "new"), "empty.bin": told("", "new")}
    files(source, a_bin="abd", sub__b_bin="longer", late_bin="z")
    (source / "d.bin").unlink()
    want = {"a.bin": told("abd", "changed"), "sub/b.bin": told("longer", "changed"), "c.bin": told("ghi", "same"), "late.bin": told("z", "new"), "d.bin": told("jkl", "gone"), "empty.bin": told("", "same")}
    assert run() == want
    assert (target / "a.bin").read_text() == "abd" and (target / "sub" / "b.bin").read_text() == "longer" and (target / "d.bin").read_text() == "jkl"
    del want["d.bin"]
    assert run() == {path: (size, digest, "same") for path, (size, digest, _) in want.items()}
    assert not (tmp_path / "manifest" / "version=3").exists()


def test_a_file_is_read_as_often_as_it_must(tmp_path, monkeypatch):
    (tmp_path / "f").write_text("abc")
    stream, reads = I._stream, []
    monkeypatch.setattr(I, "_stream", lambda uri, *rest: reads.append(uri) or stream(uri, *rest))
    digest = hashlib.sha256(b"abc").hexdigest()

    def settled(uri, size, old_size, old_sha256):
        reads.clear()
        with I.Arrivals() as arrivals:
            found = I._settle(SimpleNamespace(path="f", uri=uri, size=size, old_size=old_size, old_sha256=old_sha256), str(tmp_path / "out"), arrivals)
        return (*found, len(reads))

    uri, nan = str(tmp_path / "f"), float("nan")
    assert settled(uri, 3.0, nan, None) == ("f", 3, digest, "new", 1)
    assert settled(uri, 3, 4, "0") == ("f", 3, digest, "changed", 1)
    assert settled(uri, 3, 3, "0") == ("f", 3, digest, "changed", 2)
    assert settled(uri, 3, 3, digest) == ("f", 3, digest, "same", 1)
    assert settled(None, nan, 3.0, digest) == ("f", 3, digest, "gone", 0)

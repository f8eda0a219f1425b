"""Copies that can be proven: checksums, manifests and content fingerprints."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions.columns import comparable
from tablesmith.session import stage
from tablesmith.sources.folders import list_by_tasks, system_of
from tablesmith.sources.readers import hadoop
from tablesmith.sources.writers import write_json

CHUNK = 4 * 1024 * 1024
CHECKSUM = "path string, size bigint, sha256 string"


def file_checksums(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Relative path, size and SHA-256 of every file below a folder.

    The listing is dealt to tasks by name. A task streams its files in
    chunks, so a file may be larger than any cell or executor.
    """

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.path, r.size, _stream(r.uri, None)) for r in frame.itertuples()]
            yield pd.DataFrame(rows, columns=["path", "size", "sha256"])

    return _dealt(list_by_tasks(spark, folder, pattern, recursive)).mapInPandas(digests, CHECKSUM)


def _dealt(files: DataFrame, *keys: str) -> DataFrame:
    """A listing spread over tasks by name, so that no task has all files.

    The number of tasks is given, as a listing is so small that adaptive execution would put it into one task, however many bytes its files have.
    """
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.repartition(tasks, *(keys or ["path"]))


RANGE_BYTES = 64 << 20


def tree_checksums(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Relative path, size, number of ranges and tree digest of every file below a folder; a large file is hashed by many tasks.

    A file is cut into ranges of ``range_bytes``; the tree digest is the SHA-256 of the SHA-256 digests, as bytes, of its ranges in
    order. An empty file has one empty range. Only digests meet, 32 bytes for each range.
    """

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["digest"] = [_range_digest(r.uri, r.start, min(r.size, r.start + range_bytes)) for r in frame.itertuples()]
            yield frame[["path", "size", "start", "digest"]]

    last = F.greatest(F.floor((F.col("size") - 1) / range_bytes), F.lit(0)).cast("int")
    ranges = list_by_tasks(spark, folder, pattern, recursive).select("path", "size", "uri", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: i.cast("bigint") * range_bytes)).alias("start"))
    hashed = _dealt(ranges, "path", "start").mapInPandas(digests, "path string, size bigint, start bigint, digest binary")
    inner = F.transform(F.array_sort(F.collect_list(F.struct("start", F.hex("digest").alias("digest")))), lambda r: r["digest"])
    return hashed.groupBy("path", "size").agg(F.count("*").alias("ranges"), F.sha2(F.unhex(F.array_join(inner, "")), 256).alias("tree_sha256"))


def _range_digest(uri: str, start: int, stop: int) -> bytes:
    digest = hashlib.sha256()
    system, path = system_of(uri)
    with system.open_input_file(path) as data:
        data.seek(start)
        while start < stop:
            chunk = data.read(min(CHUNK, stop - start))
            if not chunk:
                raise EOFError(f"{uri} is shorter than when it was listed")
            digest.update(chunk)
            start += len(chunk)
    return digest.digest()


def copy_files(spark: SparkSession, source: str, target: str, pattern: str = "*", only: DataFrame | None = None) -> DataFrame:
    """Copy files by tasks; returns path, size and hash of what was read.

    ``only`` limits the copy to the paths it lists. A file appears under its name
    when it is whole, so a task that is lost and run again does no harm. The result
    is lazy: use :func:`copy_and_verify` for the whole work.
    """

    def copies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Arrivals() as arrivals:
            for frame in frames:
                rows = [(r.path, r.size, _stream(r.uri, f"{target}/{r.path}", arrivals)) for r in frame.itertuples()]
                yield pd.DataFrame(rows, columns=["path", "size", "sha256"])

    target = hadoop(spark, target)[1].toString()
    files = list_by_tasks(spark, source, pattern)
    if only is not None:
        files = files.join(only.select("path"), "path", "left_semi").select(*files.columns)
    return _dealt(files).mapInPandas(copies, CHECKSUM)


def _stream(uri: str, target: str | None, arrivals: Arrivals | None = None) -> str:
    """Hash a file in chunks, writing them to the target if there is one."""
    digest = hashlib.sha256()
    system, path = system_of(uri)
    with system.open_input_stream(path) as data:

        def chunks() -> Iterator[bytes]:
            while chunk := data.read(CHUNK):
                digest.update(chunk)
                yield chunk

        if target is None:
            for _ in chunks():
                pass
        else:
            arrivals.put(chunks(), target)
    return digest.hexdigest()


def write_files(files: DataFrame, target: str) -> None:
    """A file for each row of (path, content), written by tasks under its name when it is whole."""
    root = hadoop(files.sparkSession, target)[1].toString()

    def puts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Arrivals() as arrivals:
            for frame in frames:
                for r in frame.itertuples():
                    arrivals.put([r.content or b""], f"{root}/{r.path}")
                yield frame[["path"]]

    files.select("path", "content").mapInPandas(puts, "path string").write.format("noop").mode("overwrite").save()


#: Files that a task writes beside their final place before it takes a folder of its own below that.
FEW_FILES = 8


class Arrivals:
    """Files of one task, each under its name when it is whole.

    A file is written under another name and moved. As a folder takes new names from one task at a time, a task that writes many files to a
    folder writes them in one of its own below it, so that tasks wait for each other only to move. These folders are removed at the end.
    """

    def __init__(self) -> None:
        self.written: dict[str, int] = {}
        self.own: dict[str, tuple] = {}

    def __enter__(self) -> Arrivals:
        return self

    def __exit__(self, *_: object) -> None:
        for there, place in self.own.values():
            there.delete_dir(place)

    def put(self, chunks: Iterable[bytes], target: str) -> None:
        there, final = system_of(target)
        folder = final.rsplit("/", 1)[0]
        address = target.rsplit("/", 1)[0]
        count = self.written.get(address, 0)
        if not count:
            there.create_dir(folder, recursive=True)
        self.written[address] = count + 1
        if count == FEW_FILES:
            place = f"{folder}/.{uuid.uuid4().hex}.partial"
            there.create_dir(place)
            self.own[address] = there, place
        partial = f"{self.own[address][1]}/{count}" if address in self.own else f"{folder}/.{uuid.uuid4().hex}.partial"
        with there.open_output_stream(partial) as out:
            for chunk in chunks:
                out.write(chunk)
        there.move(partial, final)


def compare_checksums(
    source: DataFrame, target: DataFrame, key: Sequence[str] = ("path",), verify_checksum: bool = True
) -> DataFrame:
    """Status per key: ok, missing, extra, size_differs or hash_differs."""
    left = source.select(*key, F.col("size").alias("source_size"), F.col("sha256").alias("source_sha256"))
    right = target.select(*key, F.col("size").alias("target_size"), F.col("sha256").alias("target_sha256"))
    status = (
        F.when(F.col("target_size").isNull(), "missing")
        .when(F.col("source_size").isNull(), "extra")
        .when(F.col("source_size") != F.col("target_size"), "size_differs")
    )
    if verify_checksum:
        status = status.when(F.col("source_sha256") != F.col("target_sha256"), "hash_differs")
    return left.join(right, list(key), "full").withColumn("status", status.otherwise("ok"))


def copy_and_verify(
    spark: SparkSession, source: str, target: str, manifest: str, pattern: str = "*", verify_checksum: bool = True
) -> DataFrame:
    """Copy a folder, hash what arrived, write the manifest as JSON and return it."""
    copied = f"{manifest}/copied"
    write_json(copy_files(spark, source, target, pattern), copied)
    read = spark.read.schema(CHECKSUM).json(copied)
    arrived = file_checksums(spark, target, pattern)
    checked = compare_checksums(read, arrived, verify_checksum=verify_checksum).select(
        F.lit(source).alias("source"), F.lit(target).alias("destination"), "*",
        (F.col("status") == "ok").alias("match"), F.current_timestamp().alias("copied_at"),
    )
    write_json(checked, f"{manifest}/verified")
    return spark.read.schema(checked.schema).json(f"{manifest}/verified")


def new_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the last manifest does not know."""
    return listing.join(manifest.select("path"), "path", "left_anti")


def sync_folder(spark: SparkSession, source: str, target: str, manifest: str, pattern: str = "*") -> DataFrame:
    """Copy the files that are new or have changed since the last run; returns (path, size, sha256, change) of all.

    The manifest is a folder of versions, each a whole list of path, size and digest. ``change`` is new, changed, same or gone; files that are
    gone stay in the target and leave the list. A file is read once, and once more to be copied if only its digest tells that it has changed;
    what is told of a copied file is what was copied. A version is written after its copies and only if something
    changed, so a run that is cut short is done again, and a run that is done again changes nothing.
    """

    def settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with Arrivals() as arrivals:
            for frame in frames:
                yield pd.DataFrame([_settle(r, target, arrivals) for r in frame.itertuples()], columns=["path", "size", "sha256", "change"])

    number, known = _last_version(spark, manifest)
    target = hadoop(spark, target)[1].toString()
    before = known.select("path", F.col("size").alias("old_size"), F.col("sha256").alias("old_sha256"))
    both = list_by_tasks(spark, source, pattern).select("path", "size", "uri").join(before, "path", "full")
    told = stage(_dealt(both).mapInPandas(settled, f"{CHECKSUM}, change string"), "told")
    if not told.where("change <> 'same'").isEmpty():
        told.where("change <> 'gone'").drop("change").write.parquet(f"{manifest}/version={number + 1}")
    return told


def _settle(file: Any, target: str, arrivals: Arrivals) -> tuple[str, int, str, str]:
    """Path, size, digest and change of a file of the source or of the last version, copied if it is new or has changed."""
    new, gone = not isinstance(file.old_sha256, str), not isinstance(file.uri, str)  # what is missing may be None or NaN
    if gone:
        return file.path, int(file.old_size), file.old_sha256, "gone"
    size = int(file.size)
    if not new and size == int(file.old_size) and _stream(file.uri, None) == file.old_sha256:
        return file.path, size, file.old_sha256, "same"
    return file.path, size, _stream(file.uri, f"{target}/{file.path}", arrivals), "new" if new else "changed"


def _last_version(spark: SparkSession, manifest: str) -> tuple[int, DataFrame]:
    """Number and rows of the last whole version of a manifest; 0 and none at first."""
    system, root = hadoop(spark, manifest)
    names = [e.getPath() for e in system.listStatus(root)] if system.exists(root) else []
    whole = [int(p.getName().removeprefix("version=")) for p in names if p.getName().startswith("version=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    for p in names:  # what a run that was cut short has left
        if p.getName().startswith("version=") and int(p.getName().removeprefix("version=")) not in whole:
            system.delete(p, True)
    if not whole:
        return 0, spark.createDataFrame([], CHECKSUM)
    return max(whole), spark.read.schema(CHECKSUM).parquet(f"{manifest}/version={max(whole)}")


def new_rows(source: DataFrame, copied: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key has not been copied yet; repeated keys collapse before the exchange."""
    return source.join(copied.select(*key).distinct(), list(key), "left_anti")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free sum of row digests.

    A row's digest is the first 60 bits of the SHA-256 of its values as text, by column name, so that whole numbers of any width
    agree and other engines can follow. Each value comes after its length in characters, so no two rows read alike, and nulls are told from texts by a mark.
    """
    plain = comparable(df)

    def marked(name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.length(text).cast("string"), F.lit(":"), text))

    digest = F.conv(F.substring(F.sha2(F.concat(*[marked(c) for c in sorted(plain.columns)]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return plain.agg(F.count("*").alias("rows"), F.coalesce(F.sum(digest), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def quick_digest(df: DataFrame) -> list[Column]:
    """Aggregates that tell two tables of the same types apart inside Spark: rows, and sums of two seeded hashes of whole rows."""
    plain = comparable(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    values = [F.col(f"`{c}`") if plain.schema[c].dataType == kinds[c] else _grouped_form(c, kinds[c].typeName()) for c in sorted(plain.columns)]
    marks = [v.isNull() for v in values]  # a hash passes over nulls, so which are null is hashed too
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *marks, *values).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"digest{seed}") for seed in (1, 2)]
    return [F.count(F.lit(1)).alias("rows"), *sums]


def _grouped_form(name: str, kind: str) -> Column:
    return F.array_sort(F.map_entries(F.col(f"`{name}`"))) if kind == "map" else F.to_json(F.col(f"`{name}`"))


def copy_table(df: DataFrame, path: str) -> DataFrame:
    """Write a table, read it back, and say whether the content is the same.

    The source is read once: its digest is taken by the job that writes it. The copy is read once more to be sure of what arrived.
    """
    seen = Observation()
    df.observe(seen, *quick_digest(df)).write.mode("overwrite").parquet(path)
    before = seen.get
    copy = df.sparkSession.read.parquet(path)
    after = copy.agg(*quick_digest(copy))
    same = F.lit(True)
    for name, value in before.items():
        same = same & (F.col(name).cast("string") == str(value))
    return after.select(F.lit(before["rows"]).cast("bigint").alias("rows"), F.col("rows").alias("copied_rows"), same.alias("matches"))

"""Folders of files as tables, and what became of each file."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.session import stage
from tablesmith.sources.readers import hadoop

# How the tasks' file systems name those that Spark names otherwise.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def system_of(uri: str):
    """The file system and the path on it, for an address that Spark has resolved."""
    scheme, _, rest = uri.partition(":") if "://" in uri or uri.startswith(("file:", "dbfs:")) else ("file", "", uri)
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


#: Entries of a folder that a task hands over at once.
ROWS_AT_ONCE = 10_000


def _entries(uri: str) -> Iterator[tuple[str, int, int, bool]]:
    """Name, size, change time in milliseconds and whether it is a folder, of all that a folder holds."""
    there, place = system_of(uri)
    if isinstance(there, fs.LocalFileSystem):  # one by one, as pyarrow gathers all of a folder
        with os.scandir(place) as entries:
            for entry in entries:
                try:
                    found = entry.stat()
                except FileNotFoundError:  # gone, or a link to nothing
                    continue
                folder = stat.S_ISDIR(found.st_mode)
                yield entry.name, 0 if folder else found.st_size, found.st_mtime_ns // 1_000_000, folder
    else:
        for entry in there.get_file_info(fs.FileSelector(place)):
            yield entry.base_name, entry.size or 0, 0 if entry.mtime_ns is None else entry.mtime_ns // 1_000_000, entry.type == fs.FileType.Directory


def list_by_tasks(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """All files below a folder as :func:`list_files` gives them, listed by tasks, a level of folders at a time.

    The folders of a level are a table, dealt by name; what they hold is written to the shared folder, so the driver
    never sees a name. There are as many rounds as levels. More than 1000 levels raise, so that links that lead back end.
    """
    system, root = hadoop(spark, folder)
    if not system.exists(root):
        raise FileNotFoundError(folder)
    address = root.toString().rstrip("/")

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = ((uri, *entry) for uri in frame["uri"] for entry in _entries(uri))
            while part := list(islice(found, ROWS_AT_ONCE)):  # a folder may hold millions
                rows = [(f"{uri}/{name}"[len(address) + 1 :], size, moment, f"{uri}/{name}", folder) for uri, name, size, moment, folder in part]
                yield pd.DataFrame(rows, columns=["path", "size", "millis", "uri", "folder"])

    levels, frontier = [], spark.createDataFrame([(address,)], "uri string")
    for _ in range(1000):
        level = stage(frontier.repartition(F.col("uri")).mapInPandas(entries, "path string, size bigint, millis bigint, uri string, folder boolean"), "listing")
        levels.append(level.where("not folder"))
        frontier = level.where("folder").select("uri")
        if not recursive or frontier.isEmpty():
            break
    else:
        raise RuntimeError(f"more than 1000 levels of folders in {folder}")
    listing = levels[0]
    for level in levels[1:]:
        listing = listing.unionByName(level)
    # what a local file system keeps beside files is no file, as for Spark itself
    name = F.element_at(F.split("path", "/"), -1)
    matches = spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(pattern).pattern()
    listing = listing.where(~name.rlike(r"^\..*\.crc$") & name.rlike(f"^(?:{matches})$"))
    return listing.select("path", "size", F.timestamp_millis("millis").alias("modified"), "uri")


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """All files below a folder, hidden ones too: relative path, size, change time and full address.

    The driver lists the folder, as for any table that Spark reads, on any file system that Spark knows. No file is
    opened. A reader of tables would leave out names that begin with a dot or an underscore.
    """
    system, root = hadoop(spark, folder)
    if not system.exists(root):
        raise FileNotFoundError(folder)
    matches = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern)
    start = len(root.toString().rstrip("/")) + 1
    files, rows = system.listFiles(root, recursive), []
    while files.hasNext():
        status = files.next()
        place = status.getPath()
        if matches.matches(place.getName()):
            address = place.toString()
            rows.append((address[start:], status.getLen(), status.getModificationTime(), address))
    listing = spark.createDataFrame(rows, "path string, size bigint, millis bigint, uri string")
    return listing.select("path", "size", F.timestamp_millis("millis").alias("modified"), "uri")


def read_texts(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """One row per file: relative path and whole text."""
    texts = (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .text(folder, wholetext=True)
    )
    return texts.select(relative_path(spark, folder, F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))


def relative_path(spark: SparkSession, folder: str, address: Column) -> Column:
    """The place of a file below a folder, from the address that a reader gives it."""
    # the reader's addresses have file:/// where the file system says file:/
    root = hadoop(spark, folder)[1].toString().rstrip("/")
    plain = F.regexp_replace(F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    return F.substring(plain, F.lit(len(root) + 2), F.length(plain))


def json_outcomes(spark: SparkSession, folder: str, schema: str, file: Sequence[str] = ()) -> DataFrame:
    """What became of each JSON-lines file below a folder: a broken record makes its file an error, others are unaffected.

    ``file`` names partition columns that stand for the file; without any, its address does.
    """
    rows = spark.read.text(folder)
    name = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), c) for c in file]) if file else F.col("_metadata.file_path")
    parsed = F.from_json("value", f"{schema}, _corrupt_record string")
    broken = F.when(parsed["_corrupt_record"].isNotNull(), F.lit("broken record"))
    return file_outcomes(rows.select(name.alias("file"), broken.alias("error")), "file", F.col("error"))


def file_outcomes(rows: DataFrame, file: str, error: Column) -> DataFrame:
    """One row per file: success, or error with the first message; other files are unaffected."""
    counted = rows.groupBy(file).agg(
        F.count("*").alias("rows"), F.count_if(error.isNotNull()).alias("bad_rows"), F.min(error).alias("message")
    )
    return counted.withColumn("status", F.when(F.col("bad_rows") > 0, "error").otherwise("success"))


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
    )

"""Folders whose broken files don't stop the others: what became of each file, and the rows of the good ones.

Tasks open each file on its own, in ranges where it is large: footers of Parquet, bytes of texts, streams of packed ones. Spark's
scan then reads the whole folder, passing over what it can't, and its rows are counted per file. A file
is good if it opens, if none of its records is broken and if as many rows come out as it says it has. The driver holds neither
names nor outcomes, and the good rows come from the ordinary scan, without the files that aren't good.
"""

from __future__ import annotations

import codecs
import functools
import zlib
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.session import stage
from tablesmith.sources.folders import list_by_tasks, relative_path, system_of
from tablesmith.sources.readers import charset

RANGE_BYTES = 64 << 20
STEP = 1 << 20
#: Names of files by format: fixed values, in the notation of globs that Spark's readers take.
GLOBS = {"parquet": "*.parquet", "csv": "*.{csv,csv.gz}", "json": "*.{json,jsonl,json.gz,jsonl.gz}"}
ENDINGS = {"parquet": r"\.parquet$", "csv": r"\.csv(\.gz)?$", "json": r"\.jsonl?(\.gz)?$"}
OPENED = "path string, uri string, kind string, start bigint, stop bigint, rows bigint, error string"


def opened(files: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """(path, kind, rows, error): whether each file of a listing opens; rows are known of Parquet only. A record is not looked at."""
    kind = functools.reduce(lambda found, item: found.when(F.col("path").rlike(item[1]), item[0]), ENDINGS.items(), F.when(F.lit(False), ""))
    named = files.select("path", "uri", "size", kind.alias("kind"))
    strict = charset(encoding) == "UTF-8"

    def footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [part for r in frame.itertuples() for part in _parts(r.path, r.uri, r.size, r.kind)]
            yield pd.DataFrame(rows, columns=["path", "uri", "kind", "start", "stop", "rows", "error"])

    def ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["error"] = [r.error if r.kind not in ("csv", "json") else _text_error(r.uri, int(r.start), int(r.stop), strict) for r in frame.itertuples()]
            yield frame

    parts = named.repartition(F.col("path")).mapInPandas(footers, OPENED)
    checked = parts.repartition("path", "start").mapInPandas(ranges, OPENED)
    return checked.groupBy("path").agg(F.first("kind").alias("kind"), F.sum("rows").alias("rows"), F.min("error").alias("error"))


def _parts(path: str, uri: str, size: int, kind: str | None) -> list[tuple]:
    """The ranges of a file that are checked apart; of a Parquet file, what its footer says."""
    if kind is None:
        return [(path, uri, None, 0, 0, None, "format not known")]
    if kind == "parquet":
        system, place = system_of(uri)
        try:
            with system.open_input_file(place) as file:
                rows = pq.ParquetFile(file).metadata.num_rows
        except Exception as problem:
            return [(path, uri, kind, 0, 0, None, f"not readable: {type(problem).__name__}")]
        return [(path, uri, kind, 0, 0, rows, None)]
    step = max(size, 1) if path.endswith(".gz") else RANGE_BYTES
    return [(path, uri, kind, start, min(size, start + step), None, None) for start in range(0, max(size, 1), step)]


def _text_error(uri: str, start: int, stop: int, strict: bool) -> str | None:
    """What is wrong with the bytes of a range: they can't be read, unpacked or decoded."""
    system, place = system_of(uri)
    try:
        with system.open_input_file(place) as file:
            pieces = _unpacked(file) if place.endswith(".gz") else _range(file, start, stop)
            decoder = codecs.getincrementaldecoder("utf-8")()
            for piece in pieces:
                if strict:
                    decoder.decode(piece)
            if strict:
                decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        return "invalid UTF-8"
    except Exception as problem:
        return f"not readable: {type(problem).__name__}"
    return None


def _range(file, start: int, stop: int) -> Iterator[bytes]:
    """The bytes of the characters that begin in a range."""
    file.seek(max(0, start - 3))
    before = file.read(start - max(0, start - 3))
    at = start + _owed(before)
    file.seek(at)
    last = b""
    while at < stop:
        piece = file.read(min(STEP, stop - at))
        if not piece:
            raise EOFError
        at, last = at + len(piece), (last + piece)[-3:]
        yield piece
    yield file.read(_owed(last))


def _owed(tail: bytes) -> int:
    """How many bytes of the last character of ``tail`` are still to come."""
    for back, byte in enumerate(reversed(tail), 1):
        if byte >= 0xC0:
            return max(0, (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) - back)
        if byte < 0x80:
            break
    return 0


def _unpacked(file) -> Iterator[bytes]:
    """The contents of the members of a packed file, the last of which must be whole."""
    reader, held, inside = zlib.decompressobj(31), b"", False
    while held or (held := file.read(STEP)):
        yield reader.decompress(held)
        held, inside = reader.unused_data, not reader.eof
        if reader.eof:
            reader = zlib.decompressobj(31)
    if inside:
        raise EOFError


def _scan(spark: SparkSession, folder: str, kind: str, schema: T.StructType, options: Mapping[str, str]) -> DataFrame:
    """All rows of the files of a format that Spark can read, with their file and whether the record is broken."""
    reader = spark.read.options(**options).option("pathGlobFilter", GLOBS[kind]).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    names = [F.col("`" + f.name.replace("`", "``") + "`") for f in schema.fields]
    path = relative_path(spark, folder, F.col("_metadata.file_path")).alias("_file")
    if kind == "parquet":
        return reader.schema(schema).parquet(folder).select(*names, path, F.lit(False).alias("_broken"))
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = reader.schema(kept).option("mode", "PERMISSIVE")
    return (rows.csv(folder) if kind == "csv" else rows.json(folder)).select(*names, path, F.col("_corrupt_record").isNotNull().alias("_broken"))


def read_folder(
    spark: SparkSession, folder: str, schema: T.StructType | str, csv: Mapping[str, str] | None = None, json: Mapping[str, str] | None = None, encoding: str = "utf-8"
) -> tuple[DataFrame, DataFrame]:
    """(rows, outcomes) of the CSV, JSON-lines and Parquet files below a folder.

    Outcomes are (path, kind, rows, bad_rows, message, status), one per file: success or error. Rows are those of the successful
    files, with ``path``. Hidden files don't count. CSV files have a header and may have line ends in quoted cells, unless ``csv`` says otherwise.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    options = {
        "parquet": {}, "json": {"encoding": charset(encoding), "lineSep": "\n"} | dict(json or {}),
        "csv": {"header": "true", "multiLine": "true", "escape": '"', "encoding": charset(encoding)} | dict(csv or {}),
    }
    files = list_by_tasks(spark, folder).where(~F.element_at(F.split("path", "/"), -1).rlike("^[._]"))
    scans = [_scan(spark, folder, kind, wanted, options[kind]) for kind in GLOBS]
    every = functools.reduce(DataFrame.unionByName, scans)
    # all columns are named, so that the readers parse them all
    even = F.xxhash64(*[F.col("`" + f.name.replace("`", "``") + "`") for f in wanted.fields]) % 2 == 0
    counts = every.groupBy(F.col("_file").alias("path")).agg((F.count_if(even) + F.count_if(~even)).alias("read"), F.count_if("_broken").alias("bad_rows"))
    both = opened(files, encoding).join(counts, "path", "left")
    read, bad = F.coalesce("read", F.lit(0)), F.coalesce("bad_rows", F.lit(0))
    message = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(bad > 0, "broken record")
        .when(F.col("rows") != read, F.format_string("%d of %d rows can be read", read, F.col("rows")))
    )
    outcomes = both.select("path", "kind", read.alias("rows"), bad.alias("bad_rows"), message.alias("message"), F.when(message.isNull(), "success").otherwise("error").alias("status"))
    outcomes = stage(outcomes, "outcomes")
    good = every.withColumnRenamed("_file", "path").join(outcomes.where("status = 'success'").select("path"), "path", "left_semi")
    return good.drop("_broken"), outcomes

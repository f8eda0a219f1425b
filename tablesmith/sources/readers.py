"""Readers that take data-frame style arguments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.columns import null_tokens

# Other names of the character sets that Spark reads and writes.
CHARSETS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "utf_8": "UTF-8", "u8": "UTF-8",
    "ascii": "US-ASCII", "us-ascii": "US-ASCII",
    "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "latin": "ISO-8859-1", "l1": "ISO-8859-1",
    "iso-8859-1": "ISO-8859-1", "iso8859-1": "ISO-8859-1", "iso_8859_1": "ISO-8859-1",
    "utf-16": "UTF-16", "utf16": "UTF-16", "utf-16-be": "UTF-16BE", "utf-16be": "UTF-16BE",
    "utf-16-le": "UTF-16LE", "utf-16le": "UTF-16LE", "utf-32": "UTF-32", "utf32": "UTF-32",
}

#: How much of a file is read at a time to tell its format.
DETECT_BYTES = 1 << 20


def charset(name: str) -> str:
    """Spark's name of a character set; an unknown one is an error, not a guess."""
    try:
        return CHARSETS[name.lower()]
    except KeyError:
        raise ValueError(f"Spark cannot read the character set {name}; convert the files to utf-8") from None


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    sep: str = ",",
    header: int | bool | None = 0,
    encoding: str = "utf-8",
    quotechar: str = '"',
    escapechar: str | None = None,
    comment: str | None = None,
    na_values: Sequence[str] = (),
    infer: bool = False,
    nrows: int | None = None,
    multiline: bool = True,
    bad_rows: str = "raise",
) -> DataFrame:
    """Read CSV files. Give a schema: inferring types costs a second pass and is opt-in.

    Quotes inside quoted cells are doubled, unless there is an ``escapechar``, and quoted cells may hold line ends. For
    that a file is read by one task; ``multiline=False`` splits large files that have no such cells.
    Cells that don't fit the schema raise; ``bad_rows="null"`` makes them null, and ``"keep"`` also
    keeps the line in a column ``_corrupt_record``.

    With several ``na_values`` the columns are read as text, the tokens become null and
    the rest is cast to the schema. ``nrows`` is an explicit limit; there is no other.
    """
    options = {
        "sep": sep,
        "header": str(header is not None and header is not False).lower(),
        "encoding": charset(encoding),
        "quote": quotechar,
        "escape": quotechar if escapechar is None else escapechar,
        "multiLine": str(multiline).lower(),
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "mode": _bad_mode(bad_rows),
        "nullValue": "\u0000",  # an empty cell is null, and a quoted empty one is an empty text
    }
    if comment is not None:
        options["comment"] = comment
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if bad_rows == "keep":
        wanted = _with_record(wanted)
    reader = spark.read.options(**options)
    if len(na_values) == 1:
        reader = reader.option("nullValue", na_values[0])
    if len(na_values) > 1 and wanted is not None:
        texts = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
        rows = reader.schema(texts).csv(path)
        df = rows.select(
            *[_cast(null_tokens(F.col(_quoted(f.name)), na_values), f.dataType, bad_rows).alias(f.name) for f in wanted.fields]
        )
    elif len(na_values) > 1:
        rows = reader.csv(path)
        df = rows.select(*[null_tokens(F.col(_quoted(c)), na_values).alias(c) for c in rows.columns])
    elif wanted is not None:
        df = reader.schema(wanted).csv(path)
    else:
        df = reader.option("inferSchema", str(infer).lower()).csv(path)
    return df if nrows is None else df.limit(nrows)


def _bad_mode(bad_rows: str) -> str:
    return {"raise": "FAILFAST", "null": "PERMISSIVE", "keep": "PERMISSIVE"}[bad_rows]


def _with_record(schema: T.StructType | None) -> T.StructType:
    if schema is None:
        raise ValueError("keeping bad rows needs a schema")
    return T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])


def _cast(value: Column, kind: T.DataType, bad_rows: str) -> Column:
    return value.cast(kind) if bad_rows == "raise" else value.try_cast(kind)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Read Parquet files; listed columns are all that is read."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*[_quoted(c) for c in columns])


def read_json(
    spark: SparkSession, path: str, lines: bool = False, schema: T.StructType | str | None = None, bad_rows: str = "raise"
) -> DataFrame:
    """Read JSON: one object per line with ``lines``, else whole documents or arrays.

    A broken record raises; ``bad_rows`` is as for CSV.
    """
    reader = spark.read.option("multiLine", str(not lines).lower()).option("mode", _bad_mode(bad_rows))
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if bad_rows == "keep":
        wanted = _with_record(wanted)
    if wanted is not None:
        reader = reader.schema(wanted)
    return reader.json(path)


def detect_format(path: str, spark: SparkSession | None = None) -> str:
    """``parquet``, ``json``, ``jsonl``, ``csv`` or ``delta``, from the first line with text, else the extension.

    Works on every file system that Spark reads. Of a folder it lists one directory per level and opens the first file,
    which is read ``DETECT_BYTES`` at a time, as far as it takes to find the first text and, of JSON, the end of its first value or line.
    """
    spark = spark or SparkSession.active()
    system, place = hadoop(spark, path)
    if not system.exists(place):
        raise FileNotFoundError(path)
    while system.getFileStatus(place).isDirectory():
        names = sorted(entry.getPath().getName() for entry in system.listStatus(place))
        if "_delta_log" in names:
            return "delta"
        names = [n for n in names if not n.startswith(("_", "."))]
        if not names:
            raise FileNotFoundError(f"no data files in {path}")
        place = spark._jvm.org.apache.hadoop.fs.Path(place, names[0])
    name = place.getName()
    codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(place)
    stream = system.open(place)
    try:
        source = codec.createInputStream(stream) if codec else stream
        parts = iter(lambda: bytes(source.readNBytes(DETECT_BYTES)), b"")
        first = next((t for t in (part.removeprefix(b"\xef\xbb\xbf").lstrip() for part in parts) if t), b"")
        if first.startswith(b"PAR1"):
            return "parquet"
        if first.startswith(b"["):
            return "json"
        if first.startswith(b"{"):
            return "jsonl" if _closes_in_line(chain([first], parts)) else "json"
    finally:
        stream.close()
    extension = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return extension if extension in ("parquet", "json", "jsonl") else "csv"


def hadoop(spark: SparkSession, path: str):
    """The file system of a path and the path in full, as Spark itself resolves them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(place)


def _closes_in_line(parts: Iterable[bytes]) -> bool:
    """Whether the JSON value that the parts begin with ends before its line does."""
    before, depth, in_text, escaped = 0, 0, False, -1
    for part in parts:
        for found in re.finditer(rb'[\\"{}\[\]\r\n]', part):
            mark, at = found[0], before + found.start()
            if mark in b"\r\n":
                return False
            if at == escaped:
                continue
            if mark == b"\\":
                escaped = at + 1
            elif mark == b'"':
                in_text = not in_text
            elif not in_text:
                depth += 1 if mark in b"{[" else -1
                if depth == 0:
                    return True
        before += len(part)
    return False


def load(spark: SparkSession, path: str, file_type: str = "auto", **options) -> DataFrame:
    """Read a table in a named or detected format; other formats go to their connector."""
    kind = detect_format(path, spark) if file_type == "auto" else file_type
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "parquet":
        return read_parquet(spark, path, **options)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, lines=kind == "jsonl" or options.pop("lines", False), **options)
    try:
        return spark.read.format(kind).load(path, **options)
    except Exception as problem:
        if "DATA_SOURCE_NOT_FOUND" in str(problem):
            raise ValueError(f"the connector for {kind} is not on the class path") from problem
        raise


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"

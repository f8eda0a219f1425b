"""Writers that take data-frame style arguments. Every output is a folder of parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.sources.readers import charset


def _mode(mode: str) -> str:
    """``a`` appends, anything else overwrites."""
    return "append" if mode == "a" else "overwrite"


def write_csv(
    df: DataFrame,
    path: str,
    sep: str = ",",
    header: bool = True,
    encoding: str = "utf-8",
    quotechar: str = '"',
    escapechar: str | None = None,
    na_rep: str = "",
    compression: str | None = None,
    lineterminator: str | None = None,
    mode: str = "w",
    rows_per_file: int | None = None,
) -> None:
    """Cells keep their blanks and line ends; quotes in them are doubled unless there is an ``escapechar``.

    An empty text is written as two quotes, a null as ``na_rep``. Text that the character set can't hold raises.
    """
    options = {
        "sep": sep, "header": str(header).lower(), "encoding": charset(encoding), "quote": quotechar, "nullValue": na_rep,
        "escape": quotechar if escapechar is None else escapechar, "emptyValue": quotechar * 2,
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    if not charset(encoding).startswith("UTF"):
        df = _encodable(df, charset(encoding))
    for name, value in (("compression", compression), ("lineSep", lineterminator)):
        if value is not None:
            options[name] = value
    if rows_per_file is not None:
        options["maxRecordsPerFile"] = str(rows_per_file)
    df.write.mode(_mode(mode)).options(**options).csv(path)


def _encodable(df: DataFrame, name: str) -> DataFrame:
    """The same rows; a text that ``name`` can't hold raises when it is written."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    return df.select(*[F.decode(F.encode(c, name), name).alias(n) if n in texts else c for c, n in zip(columns, df.columns)])


def write_parquet(
    df: DataFrame,
    path: str,
    compression: str = "snappy",
    mode: str = "w",
    partition_by: Sequence[str] = (),
    rows_per_file: int | None = None,
) -> None:
    writer = df.write.mode(_mode(mode)).option("compression", compression)
    if rows_per_file is not None:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "w", compression: str | None = None) -> None:
    """One object per line; null fields are kept."""
    writer = df.write.mode(_mode(mode)).option("ignoreNullFields", "false")
    if compression is not None:
        writer = writer.option("compression", compression)
    writer.json(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str, file_format: str = "parquet", mode: str = "w") -> None:
    """Several named tables, one folder each, as the sheets of a workbook would be."""
    writers = {"csv": write_csv, "json": write_json, "parquet": write_parquet}
    for name, df in tables.items():
        writers[file_format](df, f"{folder}/{name}", mode=mode)

"""Incremental copying: each run takes the files that came since the last one."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T


def copy_new_files(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema: T.StructType | str,
    file_format: str = "parquet",
    pattern: str = "*",
    files_per_batch: int | None = None,
    options: dict[str, str] | None = None,
) -> None:
    """Append the rows of new files to the target and stop.

    The checkpoint remembers which files were taken and makes each batch appear in
    the target once, also when a run is cut short. ``files_per_batch`` bounds a
    batch, not the run.
    """
    reader = spark.readStream.format(file_format).schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.options(**(options or {})).load(source)
    run = (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", target)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()

"""Session helpers: a test session, shared scratch folders and staged tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import cache
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablesmith")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets one temporary
    folder per application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"tablesmith-{application}-")


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_dir(spark)}/tablesmith/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the application's folder."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has staged; results that still read it must be written before."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table out to more tasks if its files make fewer tasks than there are cores.

    For heavy work per row on a plain scan of wide rows; for narrow ones see :func:`deal`.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


#: Rows of heavy work that one task takes at most.
TASK_ROWS = 25_000


def deal(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Deal the rows of a table evenly to tasks of at most about ``rows``, at least one for each core.

    For heavy work per row on a plain scan of narrow rows: a row group is read by one task, however many splits its file
    makes. The rows are counted when this is called, for Parquet by the footers.
    """
    tasks = -(-df.count() // rows)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism))


#: Where staged tables lie, for as long as they are in use.
_STAGED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a table that outlives any executor. Unlike
    ``checkpoint()`` the plan runs once and the result stays columnar. It stays until :func:`discard` or :func:`clear_scratch`.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _STAGED[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete staged tables, by what :func:`stage` returned, that nothing will read any more, and files of shuffles whose plans are out of use.

    Spark deletes those once the driver's JVM has collected their plans, which may not be before the disks are full.
    """
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop(table))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()  # plans that Python still names stay in use
    spark._jvm.System.gc()

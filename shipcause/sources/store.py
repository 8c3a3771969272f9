"""Tables written to and read from the shared folder."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

SCRATCH = uuid.uuid4().hex[:12]


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Without that setting a local session uses Spark's own scratch place, and what it wrote there goes when
    Python ends. Any other session, also one that does not tell its master, is refused: a folder of one
    machine would be lost to the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", None) or ""
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    scratch = f"{spark.conf.get('spark.local.dir', '/tmp').split(',')[0]}/shipcause-{SCRATCH}"
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    return scratch


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Replace the Parquet table at ``path`` by ``df`` and return it as read back.

    With ``partition_by`` rows are first brought together by that column. The rebalance hint lets Spark
    split a value that holds much of the table and merge small ones, so files keep a sensible size.
    """
    if partition_by:
        df.hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(path)
        return df.sparkSession.read.parquet(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_tables(tables: Mapping[str, DataFrame], at_once: int = 4) -> dict[str, DataFrame]:
    """:func:`write_table` for several paths, some at a time, so that the last tasks of one do not hold up the next."""
    with ThreadPoolExecutor(at_once) as jobs:
        return dict(zip(tables, jobs.map(write_table, tables.values(), tables)))


def save_as_table(df: DataFrame, name: str) -> DataFrame:
    """Replace the catalog table ``name`` by ``df``."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def write_csv(df: DataFrame, path: str, compression: str = "none", rows_per_file: int = 0) -> str:
    """Replace the CSV at ``path`` (a folder of part files with header) by ``df``; white space in cells stays.

    Compressed files are read whole by one task each: ``rows_per_file`` bounds them, 0 does not. ``gzip`` is fast rather
    than small.
    """
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    files = {"compression": compression, "maxRecordsPerFile": rows_per_file, "zlib.compress.level": "BEST_SPEED"}
    df.write.mode("overwrite").options(header=True, escape='"', **keep, **files).csv(path)
    return path

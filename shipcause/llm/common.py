"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcause.sources.store import new_folder, write_table

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later plans start from the files."""
    return write_table(df, new_folder(df.sparkSession, name))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, also where it is not installed: Spark hands out a zip, once."""
    context = spark.sparkContext
    if getattr(context, "_shipcause_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="shipcause-code-")  # the driver's alone: workers get a copy from Spark
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    top = Path(__file__).resolve().parents[2]
    context.addPyFile(shutil.make_archive(f"{folder}/shipcause_code", "zip", top, "shipcause"))
    context._shipcause_shipped = True


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns that the operator is about to add, so that names do not clash."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 that depends on ``parts`` alone."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def labelled_sample(spark: SparkSession, sf_dir: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents to learn from: ``doc_id``, ``text``, ``y``.

    Documents whose crc32(doc_id as text) mod 5 is 0 are held out. Of the others the ``rows`` labelled ones
    with the smallest hash of their id are taken, so reruns take the same. Rows without label or id are left
    out; a label that repeats counts as the largest one given.
    """
    labels = (
        table(spark, sf_dir, "labels")
        .filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(labels), "doc_id")  # at most `rows` narrow rows


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))

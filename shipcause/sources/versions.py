"""Versions of a folder's contents, of which readers see one at a time.

Every build writes a version folder of its own. It counts once a pointer to it has been put beside the others: an
empty file whose name holds a rising number and the version, created in one step. Readers take the pointer with the
largest number, so they see the version before until the next one is whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

VERSIONS, POINTERS = "versions", "pointers"


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system for ``path``, and the path in its terms; Spark writes no empty files of its own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def published(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, version) of all pointers, oldest first."""
    files, at = _file_system(spark, f"{folder}/{POINTERS}")
    if not files.exists(at):
        return []
    names = [status.getPath().getName() for status in files.listStatus(at)]
    found = [name.partition("-") for name in names if not name.startswith((".", "_"))]
    return sorted((int(number), version) for number, _, version in found if number.isdecimal())


def current(spark: SparkSession, folder: str) -> str:
    """The version folder that readers should open."""
    found = published(spark, folder)
    if not found:
        raise FileNotFoundError(f"nothing has been published in {folder}")
    return f"{folder}/{VERSIONS}/{found[-1][1]}"


def new_version(folder: str) -> str:
    return f"{folder}/{VERSIONS}/{uuid.uuid4().hex}"


def publish(spark: SparkSession, folder: str, version: str) -> None:
    """Switch readers to ``version``, a folder that :func:`new_version` named and that is written whole."""
    found = published(spark, folder)
    number = found[-1][0] + 1 if found else 1
    files, at = _file_system(spark, f"{folder}/{POINTERS}/{number:012d}-{version.rsplit('/', 1)[-1]}")
    if not files.createNewFile(at):
        raise FileExistsError(f"published already: {at}")


def discard(spark: SparkSession, version: str) -> None:
    """Remove a version that has not been published."""
    files, at = _file_system(spark, version)
    files.delete(at, True)


def prune(spark: SparkSession, folder: str, keep: int) -> None:
    """Remove all published versions but the newest ``keep`` (at least one): first the pointer, then the version."""
    for number, version in published(spark, folder)[: -max(1, keep)]:
        files, pointer = _file_system(spark, f"{folder}/{POINTERS}/{number:012d}-{version}")
        files.delete(pointer, False)
        discard(spark, f"{folder}/{VERSIONS}/{version}")

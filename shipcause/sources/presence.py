"""Are the sources there?"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from shipcause.fixed import TABLE_FILES

FILE_NAME = r"^/([^/]+\.csv)(?:/[^/]*)?$"  # right below the folder, a file or a folder of parts


def source_report(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, file_name, present) for the eight expected CSV files of a folder."""
    try:
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    except AnalysisException as e:
        raise FileNotFoundError(f"data folder not found: {folder}") from e
    top = F.length(F.regexp_replace(F.lit(folder.rstrip("/")), "^[a-z0-9]+:/*", "/"))
    below = F.substring(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?/*", "/"), top + 1, F.length("path"))
    names = listing.select(F.regexp_extract(below, FILE_NAME, 1).alias("file_name")).distinct()
    expected = spark.createDataFrame(list(TABLE_FILES.items()), "table_name string, file_name string")
    found = expected.join(names, "file_name", "left_semi").withColumn("present", F.lit(True))
    missing = expected.join(names, "file_name", "left_anti").withColumn("present", F.lit(False))
    return found.unionByName(missing).select("table_name", "file_name", "present")


def require_sources(spark: SparkSession, folder: str) -> None:
    """Raise with the names of all files that are missing."""
    missing = [r.file_name for r in source_report(spark, folder).where("not present").orderBy("file_name").collect()]
    if missing:
        raise FileNotFoundError(f"missing in {folder}: {', '.join(missing)}")


def require_tables(spark: SparkSession, names: Iterable[str]) -> None:
    """Raise with the names of all tables or views that the catalog does not know."""
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise FileNotFoundError(f"tables not built: {', '.join(missing)}")

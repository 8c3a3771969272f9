"""Loading the eight input tables from CSV or Parquet."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from shipcause.fixed import DATE_COLUMNS, TABLE_FILES
from shipcause.functions.dates import date_texts, normalize_dates, try_timestamp
from shipcause.functions.values import normalize_missing
from shipcause.schemas import SEQ, TABLE_SCHEMAS
from shipcause.sources.records import cell_count, csv_records, joined, open_records
from shipcause.sources.store import new_folder, write_tables

INTEGER_COLUMNS = {"order_id", "client_id", "warehouse_id", "driver_id"}
#: An integer as it is written: a text with leading zeros or a plus sign names something else.
INTEGER = r"^(0|-?[1-9][0-9]{0,17})$"

#: The mark that may begin a file.
BOM, MAX_INT = "\ufeff", (1 << 31) - 1

REJECTS = "file string, position long, reason string, cells int, record string"


@dataclass(frozen=True)
class CsvLoad:
    """``rows``: the records as columns of text, and their position; ``rejects``: file, position, reason, cells, record
    of those that do not fit the header."""

    rows: DataFrame
    rejects: DataFrame


def load_csv(spark: SparkSession, path: str, short_rows: str = "fill", delimiter: str = ",") -> CsvLoad:
    """A CSV with header (one file, or a folder of parts), every column as text, and what does not fit in.

    ``load_seq`` is the position of a record over all files, by file name and place. Empty cells are NULL.
    Rejected are: records with more cells than the header (``surplus cells``); with ``short_rows="reject"`` also
    those with fewer (``missing cells``), which otherwise end with NULLs; a quoted cell that is never closed
    (``open quote``, one row per split that it covers); a part whose first line differs from the first one's
    (``header``). Blank lines are skipped. Files are read in splits whatever their cells hold.
    """
    return load_csvs(spark, {"": path}, short_rows, delimiter)[""]


def load_csvs(
    spark: SparkSession, paths: Mapping[str, str], short_rows: str = "fill", delimiter: str = ","
) -> dict[str, CsvLoad]:
    """:func:`load_csv` for several CSVs, which are read together."""
    if short_rows not in ("fill", "reject"):
        raise ValueError(f"unknown short_rows {short_rows!r}")
    reader = spark.read.option("header", True).option("escape", '"').option("sep", delimiter)
    names = {table: reader.csv(path).columns for table, path in paths.items()}
    filled = [table for table, columns in names.items() if columns]
    none = CsvLoad(spark.createDataFrame([], f"{SEQ} long"), spark.createDataFrame([], REJECTS))
    if not filled:
        return dict.fromkeys(paths, none)
    records = csv_records(spark, [paths[table] for table in filled], delimiter)

    def parsed(rows: DataFrame, width: int) -> DataFrame:
        """``cells`` and, where these fit the header, ``row``; the record only where they do not."""
        shape = ", ".join(f"c{i} string" for i in range(width))
        options = {"escape": '"', "sep": delimiter, "maxColumns": str(max(512, 2 * width))}
        rows = rows.withColumn("cells", F.when(F.col("whole"), cell_count(F.col("record"), delimiter)))
        rows = rows.filter(~F.col("whole") | (F.trim("record") != ""))
        rows = rows.withColumn("row", F.when(F.col("whole") & fits(width), F.from_csv("record", shape, options)))
        return rows.withColumn("record", F.when(F.col("row").isNull(), F.col("record")))

    def split(rows: DataFrame, width: int) -> DataFrame:
        """:func:`parsed` for records without a quote, all in generated code."""
        text = F.when(F.col("header") & F.startswith(F.col("record"), F.lit(BOM)), F.substring("record", 2, MAX_INT)).otherwise(F.col("record"))
        rows = rows.filter(F.trim("record") != "").withColumn("parts", F.split(text, literal(delimiter), -1))
        rows = rows.withColumn("cells", F.size("parts"))
        cell = [F.get("parts", F.lit(i)) for i in range(width)]
        row = F.struct(*[F.when(c != "", c).alias(f"c{i}") for i, c in enumerate(cell)])
        rows = rows.withColumn("row", F.when(fits(width), row)).drop("parts")
        return rows.withColumn("record", F.when(F.col("row").isNull(), F.col("record")))

    def fits(width: int) -> Column:
        return F.col("cells") <= width if short_rows == "fill" else F.col("cells") == width

    # a table each, so that what reads one of them deals out its files alone
    folder, plain = new_folder(spark, "csv-rows"), set(range(len(filled))) - records.quoted if len(delimiter) == 1 else set()
    cuts = {f"{folder}/{i}": (split if i in plain else parsed)(rows, len(names[filled[i]])) for i, rows in enumerate(records.cuts)}
    cuts = list(write_tables(cuts).values())

    def one(source: int, columns: list[str]) -> CsvLoad:
        width, rows = len(columns), cuts[source]
        pieces = rows.filter("not whole")
        rows = rows.filter("whole").drop("block")
        if source in records.quoted and not pieces.isEmpty():
            rows = rows.unionByName(parsed(joined(pieces, records.files).withColumn("whole", F.lit(True)), width))
        heads = rows.filter("header").withColumn("head", F.coalesce(F.to_json("row"), "record"))
        first_heads = heads.groupBy("source").agg(F.min_by("head", "number").alias("first_head"))
        bad = [
            rows.filter("row is null and not header").withColumn("reason", F.when(F.col("cells") > width, "surplus cells").otherwise("missing cells")),
            heads.join(first_heads, "source").filter("head <> first_head").drop("record").withColumnRenamed("head", "record").withColumn("reason", F.lit("header")),
        ]
        if source in records.quoted:
            bad.append(pieces.join(open_records(records.files), ["source", "number"], "left_semi").withColumn("reason", F.lit("open quote")))
        found = ["source", "file", "number", "reason", "cells", "record"]
        rejects = reduce(DataFrame.unionByName, [df.select(*found) for df in bad]).join(records.files.select("source", "file", "name"), ["source", "file"])
        rejects = rejects.select(F.col("name").alias("file"), F.col("number").alias("position"), "reason", "cells", "record")
        cells = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)]
        return CsvLoad(rows.filter("row is not null and not header").select(*cells, F.col("number").alias(SEQ)), rejects)

    return dict.fromkeys(paths, none) | {table: one(i, names[table]) for i, table in enumerate(filled)}


def literal(delimiter: str) -> str:
    """A pattern for one character, which Java cuts at without a regular expression."""
    return "\\" + delimiter if delimiter in ".$|()[{^?*+\\" else delimiter


class RejectedRows(ValueError):
    """Some records of a CSV do not fit its header."""


def refuse(rejects: DataFrame, shown: int = 5) -> None:
    """Raise with the first of ``rejects``, if there are any."""
    some = rejects.orderBy("position").limit(shown + 1).collect()
    if some:
        lines = [f"{r.file} record {r.position}: {r.reason}" for r in some[:shown]]
        raise RejectedRows("; ".join(lines) + ("; and more" if len(some) > shown else ""))


def read_csv(spark: SparkSession, path: str, on_reject: str = "fail", short_rows: str = "fill", delimiter: str = ",") -> DataFrame:
    """The rows of :func:`load_csv`. Rejected records make it fail; ``on_reject="skip"`` leaves them out."""
    loaded = load_csv(spark, path, short_rows, delimiter)
    if on_reject == "fail":
        refuse(loaded.rejects)
    elif on_reject != "skip":
        raise ValueError(f"unknown on_reject {on_reject!r}")
    return loaded.rows


def id_columns(df: DataFrame, table: str) -> list[str]:
    return [c for c in df.columns if c in INTEGER_COLUMNS and c in TABLE_SCHEMAS[table]]


#: Rows in which a date column is looked at first; where none of them parses, all rows are.
FIRST_ROWS = 1_000


def profiles(tables: Mapping[str, DataFrame], formats: Sequence[str] = ()) -> dict[str, Row]:
    """What decides types, per table: ``dates``, per date column of text whether some value parses, and ``texts``, per id
    column how many are no integers. All tables are read in one job."""

    def counted(name: str, df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
        found = F.map_from_arrays(F.array(*[F.lit(c) for c in values]), F.array(*values.values()))
        return df.agg(F.lit(name).alias("table_name"), found.alias("found"))

    def collected(counts: list[DataFrame]) -> dict[str, dict[str, int]]:
        return {r.table_name: r.found for r in reduce(DataFrame.unionByName, counts).collect()} if counts else {}

    def parsing(df: DataFrame, names: Iterable[str]) -> dict[str, Column]:
        return {f"date {c}": F.count(try_timestamp(c, tuple(formats))) for c in names}

    texts = {t: date_texts(df, DATE_COLUMNS[t]) for t, df in tables.items()}
    first = collected([counted(t, tables[t].limit(FIRST_ROWS), parsing(tables[t], names)) for t, names in texts.items() if names])
    seen = {t: {c for c in names if first[t][f"date {c}"]} for t, names in texts.items()}
    values = {t: parsing(df, [c for c in texts[t] if c not in seen[t]]) for t, df in tables.items()}
    for t, df in tables.items():
        values[t] |= {f"id {c}": F.count_if(~F.col(c).cast("string").rlike(INTEGER)) for c in id_columns(df, t)}
    whole = collected([counted(t, df, values[t]) for t, df in tables.items() if values[t]])

    def row(t: str) -> Row:
        found = whole.get(t, {})
        dates = {c: c in seen[t] or found[f"date {c}"] > 0 for c in texts[t]}
        return Row(dates=dates, texts={c: found[f"id {c}"] for c in id_columns(tables[t], t)})

    return {t: row(t) for t in tables}


def text_ids(found: Iterable[Row]) -> set[str]:
    """Id columns that hold a text somewhere. They stay text in all tables, so that they still join."""
    return {c for p in found for c, n in p.texts.items() if n}


def typed(df: DataFrame, table: str, found: Row, formats: Sequence[str] = (), texts: Iterable[str] = ()) -> DataFrame:
    """Dates as timestamps and ids as integers, or as text where named in ``texts``, as ``found`` says."""
    df = normalize_dates(df, DATE_COLUMNS[table], tuple(formats), found.dates)
    return df.withColumns({c: F.col(c).cast("string" if c in texts else "bigint") for c in id_columns(df, table)})


def normalize(df: DataFrame, table: str, formats: Sequence[str] = ()) -> DataFrame:
    """Missing-value texts to NULL, date columns to timestamps, id columns to integers where all are."""
    df = normalize_missing(df)
    found = profiles({table: df}, formats)[table]
    return typed(df, table, found, formats, text_ids([found]))


@dataclass(frozen=True)
class Loaded:
    """``tables`` by name, and the ``rejects`` of all of them with their table_name."""

    tables: dict[str, DataFrame]
    rejects: DataFrame


def load_csv_folder(
    spark: SparkSession, folder: str, formats: Sequence[str] = (), short_rows: str = "fill", files: Mapping[str, str] = TABLE_FILES
) -> Loaded:
    """The tables of a folder of CSV files, typed and normalised, and the records that do not fit.

    An id column is an integer in all tables if it is in every one, else text in all of them.
    """
    loads = load_csvs(spark, {table: f"{folder}/{file}" for table, file in files.items()}, short_rows)
    raw = {table: normalize_missing(load.rows) for table, load in loads.items()}
    found = profiles(raw, formats)
    texts = text_ids(found.values())
    rejects = [load.rejects.withColumn("table_name", F.lit(table)) for table, load in loads.items()]
    return Loaded(
        {table: typed(df, table, found[table], formats, texts) for table, df in raw.items()},
        reduce(DataFrame.unionByName, rejects),
    )


def load_csv_tables(
    spark: SparkSession, folder: str, formats: Sequence[str] = (), on_reject: str = "fail", short_rows: str = "fill"
) -> dict[str, DataFrame]:
    """The eight tables of a folder of CSV files. Rejected records make it fail; ``on_reject="skip"`` leaves them out."""
    loaded = load_csv_folder(spark, folder, formats, short_rows)
    if on_reject == "fail":
        refuse(loaded.rejects)
    elif on_reject != "skip":
        raise ValueError(f"unknown on_reject {on_reject!r}")
    return loaded.tables


def load_parquet_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The eight tables from ``<folder>/<table>`` Parquet folders."""
    return {table: spark.read.parquet(f"{folder}/{table}") for table in TABLE_FILES}


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows) for all tables, in one job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)

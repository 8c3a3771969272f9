"""Records of CSV files, read in splits whatever their cells hold.

Where a split begins, nobody knows yet whether that is inside a quoted cell. So each split first tells, for both
possibilities, how it would end and how many records would start in it. These answers are chained along a file
(functions of two states compose by a running sum), which gives every split its true state and the number of its
first record. In a second pass each split cuts its own records; only records that run over a split's end leave
pieces, one per split, which are joined by record number. No file is ever read in one piece.

A quote opens a cell only at the cell's beginning and counts as a character in any other place; a doubled quote
inside a quoted cell is one quote; text after a closing quote belongs to the cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from shipcause.sources.store import new_folder, write_table

Batches = Iterator[pa.RecordBatch]

#: Up to so many splits their table (some 100 bytes a row) is broadcast; beyond, lines are sorted beside it.
BROADCAST_SPLITS = 200_000

SPLITS = "source int, file string, block long, ends_if_out boolean, ends_if_in boolean, starts_if_out long, starts_if_in long"
CUT = "source int, number long, file long, block long, whole boolean, header boolean, record binary"

# States within a line: at a cell's beginning, in a plain cell, in a quoted cell, after a quote in a quoted cell.
START, PLAIN, QUOTED, AFTER = range(4)
ON_QUOTE = (QUOTED, PLAIN, AFTER, QUOTED)


def scanners(delimiter: str) -> tuple[Callable[[Batches], Batches], Callable[[Batches], Batches]]:
    """The two passes over lines. They hold all they need, so workers need not have this package."""
    comma, key = delimiter.encode(), ("source", "file", "block")
    start, plain, quoted, on_quote = START, PLAIN, QUOTED, ON_QUOTE

    def ends_inside(line: bytes, inside: bool) -> bool:
        state = quoted if inside else start
        for i, piece in enumerate(line.split(b'"')):
            if i:
                state = on_quote[state]
            if piece and state != quoted:
                state = start if piece.endswith(comma) else plain
        return state == quoted

    def states(lines: pa.Array, inside: bool) -> tuple[np.ndarray, bool]:
        """Whether each line begins inside a quoted cell, and whether the last one ends there."""
        begins = np.empty(len(lines), bool)
        at = 0
        for i in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)):
            begins[at : i + 1] = inside  # lines without quotes leave it as it is
            inside = ends_inside(lines[int(i)].as_py(), inside)
            at = i + 1
        begins[at:] = inside
        return begins, inside

    def by_split(batches: Batches) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            n = batch.num_rows
            if n:
                same = [pc.equal(batch[c].slice(1), batch[c].slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in key]
                changes = [int(i) + 1 for i in np.flatnonzero(~np.logical_and.reduce(same))]
                for a, b in zip([0, *changes], [*changes, n]):
                    yield tuple(batch[c][a].as_py() for c in key), batch.slice(a, b - a)

    def summarise(batches: Batches) -> Batches:
        def row() -> pa.RecordBatch:
            values = [*now, ends[0], ends[1], starts[0], starts[1]]
            types = [pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            names = [*key, "ends_if_out", "ends_if_in", "starts_if_out", "starts_if_in"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        now, ends, starts = None, [False, True], [0, 0]
        for split, lines in by_split(batches):
            if split != now:
                if now is not None:
                    yield row()
                now, ends, starts = split, [False, True], [0, 0]
            for s in (0, 1):
                begins, ends[s] = states(lines["line"], ends[s])
                starts[s] += len(begins) - int(begins.sum())
        if now is not None:
            yield row()

    def cut(batches: Batches) -> Batches:
        def out(numbers: list | np.ndarray, whole: list | np.ndarray, records: pa.Array) -> pa.RecordBatch:
            numbers = np.asarray(numbers, np.int64)
            source, file, block = (pa.array(np.full(len(numbers), v)) for v in now)
            columns = [source.cast(pa.int32()), pa.array(numbers), file, block, pa.array(whole, pa.bool_()), pa.array(numbers == begin), records]
            return pa.RecordBatch.from_arrays(columns, ["source", "number", "file", "block", "whole", "header", "record"])

        def left_open() -> Batches:
            if pieces:
                yield out([number], [False], pa.array([b"\n".join(pieces)], pa.binary()))

        now, begin, inside, number, pieces, own = None, -1, False, -1, [], False
        for split, lines in by_split(batches):
            if split != now:
                yield from left_open()
                # a record that goes on from the split before bears the number before this one's first
                now, inside, number = split, lines["inside"][0].as_py(), lines["first"][0].as_py() - 1
                begin, pieces, own = lines["begin"][0].as_py(), [], False
            begins, inside = states(lines["line"], inside)
            ends = np.append(begins[1:], inside)
            numbers = number + np.cumsum(~begins)
            number = int(numbers[-1])
            alone = ~begins & ~ends
            joined, done, complete = [], [], []
            for i in np.flatnonzero(~alone):
                line = lines["line"][int(i)].as_py()
                if begins[i]:
                    pieces.append(line)
                else:
                    pieces, own = [line], True
                if not ends[i]:
                    joined.append(b"\n".join(pieces))
                    done.append(int(numbers[i]))
                    complete.append(own)
                    pieces, own = [], True
            whole = lines["line"].filter(pa.array(alone))
            if len(whole):
                yield out(numbers[alone], np.ones(len(whole), bool), whole)
            if joined:
                yield out(done, complete, pa.array(joined, pa.binary()))
        yield from left_open()

    return summarise, cut


def cell_count(record: Column, delimiter: str = ",") -> Column:
    """Cells of a record: one more than the delimiters outside quotes, by the same states as above."""
    commas = lambda t: F.length(t) - F.length(F.replace(t, F.lit(delimiter), F.lit("")))
    state, n = lambda acc: acc["state"], lambda acc: acc["n"]

    def piece(acc: Column, text: Column) -> Column:
        after = F.when((text == "") | (state(acc) == QUOTED), state(acc)).when(F.endswith(text, F.lit(delimiter)), START).otherwise(PLAIN)
        return F.struct(after.alias("state"), (n(acc) + F.when(state(acc) == QUOTED, 0).otherwise(commas(text))).alias("n"))

    def quote(acc: Column) -> Column:
        return F.struct(F.element_at(F.array(*[F.lit(s) for s in ON_QUOTE]), state(acc) + 1).alias("state"), n(acc).alias("n"))

    pieces = F.split(record, '"', -1)
    first = piece(F.struct(F.lit(START).alias("state"), F.lit(0).alias("n")), pieces[0])
    counted = F.aggregate(F.slice(pieces, 2, F.size(pieces)), first, lambda acc, text: piece(quote(acc), text))
    return F.when(F.instr(record, '"') == 0, commas(record)).otherwise(n(counted)) + 1


def split_states(splits: DataFrame) -> DataFrame:
    """Every split with its true state and first number, and where its file begins and in what it ends.

    A split maps "inside a quoted cell or not" to the same at its end. It keeps the state, turns it round, or gives a
    fixed one: the state here is that of the last fixed one before, turned as often as was turned since.
    """
    along = Window.partitionBy("source", "file").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("ends_if_out") & ~F.col("ends_if_in")).cast("long")
    rows = splits.withColumn("turned", F.sum(turns).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("ends_if_out") == F.col("ends_if_in"), F.struct(F.col("ends_if_out").cast("long").alias("to"), "turned"))
    rows = rows.select("*", F.last(fixed, True).over(before).alias("last"), F.coalesce(F.lag("turned").over(along), F.lit(0)).alias("so_far"))
    inside = (F.coalesce("last.to", F.lit(0)) + F.col("so_far") - F.coalesce("last.turned", F.lit(0))) % 2 == 1
    rows = rows.withColumn("inside", inside)
    rows = rows.withColumn("starts", F.when(F.col("inside"), F.col("starts_if_in")).otherwise(F.col("starts_if_out")))
    ends = F.when(F.col("inside"), F.col("ends_if_in")).otherwise(F.col("ends_if_out"))
    files = rows.groupBy("source", "file").agg(F.sum("starts").alias("n"), F.max_by(ends, "block").alias("open"))
    in_order = Window.partitionBy("source").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.withColumn("begin", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
    first = F.col("begin") + F.coalesce(F.sum("starts").over(before), F.lit(0))
    return rows.join(files, ["source", "file"]).select("source", "file", "block", "inside", first.alias("first"), "begin", "n", "open")


def beside(lines: DataFrame, splits: DataFrame, n: int) -> DataFrame:
    """``lines`` with what is known of their split; lines of a split stay together and in order."""
    lines = lines.withColumn("file", F.xxhash64("file"))  # the name is long beside a line
    names = {"source": "from", "file": "of", "block": "at", "place": "first_place"}
    known = splits.withColumn("file", F.xxhash64("file")).select("source", "file", "block", "place", "lines", "inside", "first", "begin")
    known = known.withColumnsRenamed(names)
    match = (F.col("source") == F.col("from")) & (F.col("file") == F.col("of")) & (F.col("block") == F.col("at"))
    if n <= BROADCAST_SPLITS:
        rows = lines.join(F.broadcast(known), match, "left")
    else:
        rows = lines.withColumn("line_no", F.monotonically_increasing_id()).join(known.hint("merge"), match, "left")
        rows = rows.sortWithinPartitions("source", "file", "block", "line_no")
    first = F.coalesce("first", changed()).alias("first")
    return rows.select("source", "line", "file", "block", "inside", first, "begin", "place", "first_place", "lines")


def changed() -> Column:
    """Spark deals files into splits by the size of the cluster, which may have changed since the first pass."""
    return F.raise_error(F.lit("the files or their splits changed while they were read; load again")).cast("long")


@dataclass(frozen=True)
class Records:
    """``cuts``, one per source: source, number (position over the files of a source, rising), file (hash of its name),
    block (begin of its split), whole, header (the first of its file), record; a record that is not whole has a row per
    split, its piece. Reading it reads the text: write what is made of it. ``quoted``: the sources that hold a quote; all
    records of the others are whole. ``files``: source, file, name, begin and n (its numbers), open (its last quote is
    never closed)."""

    cuts: list[DataFrame]
    quoted: set[int]
    files: DataFrame

    @property
    def cut(self) -> DataFrame:
        """All of ``cuts``."""
        return reduce(DataFrame.unionByName, self.cuts)


def csv_records(spark: SparkSession, paths: Sequence[str], delimiter: str = ",") -> Records:
    """The records of CSV files; each of ``paths``, a source, is a file or a folder of parts.

    Records are numbered in the order of file names and lines. Lines end with a line feed, before which one carriage
    return is left out. Empty lines are numbered, too. Sources are read in splits: all together once
    to count lines, those with quotes once more to tell states, and each once to cut records.
    """
    def lines_of(source: int, path: str) -> DataFrame:
        file, block = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
        text = spark.read.option("lineSep", "\n").text(path)
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")  # within its task
        return text.select(F.lit(source).alias("source"), F.col("value").cast("binary").alias("line"), file, block, place)

    each = [lines_of(i, path) for i, path in enumerate(paths)]
    summarise, cut = scanners(delimiter)
    counts = reduce(DataFrame.unionByName, each).groupBy("source", "file", "block").agg(
        F.count(F.lit(1)).alias("lines"), F.min("place").alias("place"), F.max(F.contains("line", F.lit(b'"'))).alias("quotes")
    )
    counts = write_table(counts, new_folder(spark, "csv-counts"))
    quoted = {r["source"] for r in counts.filter("quotes").select("source").distinct().collect()}
    # without quotes a split leaves the state as it is, and each line is a record; other sources are told line by line
    splits = counts.filter(~F.col("source").isin(*quoted)).selectExpr(
        "source", "file", "block", "false as ends_if_out", "true as ends_if_in", "lines as starts_if_out", "0L as starts_if_in"
    )
    if quoted:
        told = reduce(DataFrame.unionByName, [each[i].drop("place") for i in sorted(quoted)]).mapInArrow(summarise, SPLITS)
        splits = splits.unionByName(write_table(told, new_folder(spark, "csv-splits")))
    known = write_table(split_states(splits).join(counts.drop("quotes"), ["source", "file", "block"]), new_folder(spark, "csv-states"))
    n = known.count()

    def cut_of(i: int) -> DataFrame:
        rows = beside(each[i], known.filter(F.col("source") == i), n)
        if i in quoted:
            rows = rows.drop("place", "first_place", "lines").mapInArrow(cut, CUT)
        else:
            at = F.col("place") - F.col("first_place")
            # a split's lines follow one another: dealt otherwise than in the first pass, the first or last one falls out of its count
            number = F.col("first") + F.when(at.between(0, F.col("lines") - 1), at).otherwise(changed())
            rows = rows.withColumn("number", number)
            rows = rows.select("source", "number", "file", "block", F.lit(True).alias("whole"), (F.col("number") == F.col("begin")).alias("header"), F.col("line").alias("record"))
        rows = rows.withColumn("record", F.col("record").cast("string"))
        return rows.withColumn("record", F.when(F.col("whole"), without_return("record")).otherwise(F.col("record")))

    files = known.groupBy("source", "file").agg(*[F.first(c).alias(c) for c in ("begin", "n", "open")])
    files = files.select("source", F.xxhash64("file").alias("file"), F.col("file").alias("name"), "begin", "n", "open")
    return Records([cut_of(i) for i in range(len(each))], quoted, files)


def without_return(record: str) -> Column:
    return F.when(F.endswith(F.col(record), F.lit("\r")), F.regexp_replace(record, r"\r\z", "")).otherwise(F.col(record))


def open_records(files: DataFrame) -> DataFrame:
    """The record of each file whose quote is never closed: source, number."""
    return files.filter("open").select("source", (F.col("begin") + F.col("n") - 1).alias("number"))


def joined(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """The records that ``pieces`` of ``cut`` make, but for those left open: source, number, file, header, record."""
    closed = pieces.join(open_records(files), ["source", "number"], "left_anti")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block", "record"))), lambda p: p["record"])
    rows = closed.groupBy("source", "number", "file", "header").agg(F.array_join(parts, "\n").alias("record"))
    return rows.withColumn("record", without_return("record"))

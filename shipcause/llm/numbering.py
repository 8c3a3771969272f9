"""Places of rows within their groups, whatever the size of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shipcause.llm.common import kept, without

ROW_BITS = 33  # of monotonically_increasing_id, below the partition number


def numbered(rows: DataFrame, group: str, order: Sequence[str], name: str = "index") -> DataFrame:
    """``rows`` with ``name``, counting from 0 within ``group`` (not NULL) by ``order`` (ascending, NULL first).

    Rows are ranged over tasks by group and order, sorted and numbered there, and written; a group that spans
    several tasks goes on where the task before ended, by a running sum over one row per group and task. Rows
    equal in group and order stay in one task, so callers add a column that tells them apart where many may be.
    """
    plain = without(rows, [name, "__at", "__task", "__shift"])
    ranged = plain.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = kept(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranged")
    task, row = F.shiftright("__at", ROW_BITS).alias("__task"), F.col("__at").bitwiseAND((1 << ROW_BITS) - 1)
    runs = placed.groupBy(group, task).agg(F.min(row).alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")
    shifts = runs.select(group, "__task", shift.alias("__shift"))
    return (
        placed.select("*", task).join(shifts, [group, "__task"])
        .select(*plain.columns, (row + F.col("__shift")).alias(name))
    )

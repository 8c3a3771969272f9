"""Column expressions for missing values and forgiving casts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from shipcause.fixed import NA_TOKENS

# Leading number of a text, with optional exponent.
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_missing(c: str | Column, tokens=tuple(NA_TOKENS)) -> Column:
    """NULL for a text that means "no value"; the match is exact, so ``none`` or ``' NA'`` stay."""
    c = column(c)
    return F.when(~c.isin(*tokens), c)


def normalize_missing(df: DataFrame, tokens=tuple(NA_TOKENS)) -> DataFrame:
    """:func:`null_if_missing` for every string column of a table, in one projection."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    # one set lookup a cell: a comparison per token, as DataFrame.replace makes them, outgrows generated code
    return df.withColumns({c: null_if_missing(F.col("`" + c.replace("`", "``") + "`"), tokens) for c in texts}) if texts else df


def try_double(c: str | Column) -> Column:
    """Number in the text, or NULL when the text is not a number."""
    return column(c).try_cast("double")


def leading_double(c: str | Column) -> Column:
    """Number at the start of the text, 0.0 when there is none, NULL only for NULL."""
    c = column(c)
    number = F.regexp_extract(c, NUMBER_PREFIX, 1).try_cast("double")
    return F.when(c.isNotNull(), F.coalesce(number, F.lit(0.0)))


def as_double(df: DataFrame, name: str, forgiving: bool = True) -> Column:
    """``name`` as double: texts by :func:`leading_double` (or a strict cast), numbers by a plain cast."""
    if forgiving and isinstance(df.schema[name].dataType, StringType):
        return leading_double(name)
    return F.col(name).cast("double")


def round_half_up(c: str | Column, digits: int = 2) -> Column:
    return F.round(column(c), digits)


def round_half_even(c: str | Column, digits: int = 2) -> Column:
    return F.bround(column(c), digits)


def labels_where(conditions: Mapping[str, Column]) -> Column:
    """Array of the labels whose condition is met, in the given order; a NULL condition is not met.

    ``array_remove`` keeps the projection inside generated code, which the lambda behind
    ``array_compact`` would not.
    """
    labels = [F.when(met, F.lit(label)).otherwise(F.lit("")) for label, met in conditions.items()]
    return F.array_remove(F.array(*labels), "")

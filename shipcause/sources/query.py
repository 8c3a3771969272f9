"""SQL over the registered views."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession


def run_query(spark: SparkSession, sql: str, params: Sequence[object] = ()) -> DataFrame:
    """A SQL text with ``?`` markers bound to ``params`` in order."""
    return spark.sql(sql, args=list(params)) if params else spark.sql(sql)


@dataclass(frozen=True)
class SelectResult:
    rows: DataFrame | None = None
    error: str | None = None


#: What an ad-hoc SELECT may be made of, by the names of Spark's plan nodes; anything else is refused.
NODES = {
    "Aggregate", "AsOfJoin", "CTERelationDef", "CTERelationRef", "Deduplicate", "Distinct", "Except", "Expand", "Filter",
    "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation",
    "Pivot", "Project", "Range", "RebalancePartitions", "Repartition", "RepartitionByExpression", "ResolvedHint", "Sample",
    "Sort", "Subquery", "SubqueryAlias", "Union", "UnresolvedHint", "Unpivot", "Window", "WithCTE",
}
#: Expressions that call into the JVM.
REFLECTIVE = {"CallMethodViaReflection", "TryReflect"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _has_name(relation) -> bool:
    """Whether a leaf is a table of the catalog; a path in place of a table has no entry there."""
    kind = relation.getClass().getSimpleName()
    if kind == "LogicalRelation":
        return relation.catalogTable().isDefined()
    if kind == "DataSourceV2Relation":
        return relation.catalog().isDefined() and relation.identifier().isDefined() and "/" not in relation.identifier().get().name()
    return kind == "HiveTableRelation"


def outside_reach(df: DataFrame) -> str | None:
    """What in the analysed plan is neither a query operator nor a registered view or table; None if nothing is.

    Views end the walk: what they read was settled when they were registered. Subqueries are walked as well.
    """
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "View":
            continue
        if kind not in NODES and not _has_name(node):
            return kind
        todo += _items(node.children())
        expressions = _items(node.expressions())
        while expressions:
            e = expressions.pop()
            kind = e.getClass().getSimpleName()
            if kind in REFLECTIVE:
                return kind
            if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                todo.append(e.plan())
            expressions += _items(e.children())
    return None


def run_select(spark: SparkSession, sql: str) -> SelectResult:
    """An ad-hoc text that starts with SELECT; anything else is refused, and errors are reported.

    The plan that Spark makes of the text may read registered tables and views only: files named by their path,
    scripts and calls into the JVM are refused wherever they stand.
    """
    if not sql.strip().lower().startswith("select"):
        return SelectResult(error="Only SELECT queries are allowed.")
    try:
        rows = spark.sql(sql)
    except PySparkException as e:
        return SelectResult(error=f"Query failed: {e}")
    if found := outside_reach(rows):
        return SelectResult(error=f"Query failed: only registered tables can be read ({found}).")
    return SelectResult(rows=rows)


@dataclass(frozen=True)
class Preview:
    """The first ``rows`` of a result, whether there are ``more``, and the error, also one that shows only when it runs."""

    rows: list[Row] = field(default_factory=list)
    more: bool = False
    error: str | None = None


def preview_select(spark: SparkSession, sql: str, limit: int = 1000) -> Preview:
    """At most ``limit`` rows of an ad-hoc text, for showing."""
    result = run_select(spark, sql)
    if result.rows is None:
        return Preview(error=result.error)
    try:
        rows = result.rows.limit(limit + 1).collect()
    except PySparkException as e:
        return Preview(error=f"Query failed: {e}")
    return Preview(rows[:limit], len(rows) > limit)


def iterate_select(spark: SparkSession, sql: str) -> Iterator[Row]:
    """All rows of an ad-hoc text, one partition at a time in the driver; a refusal or an error is raised."""
    result = run_select(spark, sql)
    if result.rows is None:
        raise ValueError(result.error)
    return result.rows.toLocalIterator(prefetchPartitions=True)

"""A physical plan as rows: one for each node, by a walk over Spark's own plan objects.

Wrappers that do no work of their own (code generation, adaptive stages, reused exchanges) are passed through. A plan that has
run tells how many rows each node gave.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields
from itertools import count

from pyspark.sql import DataFrame

from larkspur.plans.lineage import _each

#: Rows from which a scan of a whole table is worth a warning.
MANY_ROWS = 1_000
SCHEMA = "id int, parent int, depth int, kind string, table string, filter string, estimate long, rows long"
_PASSED = {"WholeStageCodegenExec": "child", "InputAdapter": "child", "AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan", "ResultQueryStageExec": "plan",
    "TableCacheQueryStageExec": "plan", "ReusedExchangeExec": "child", "AQEShuffleReadExec": "child", "ReusedSubqueryExec": "child", "ColumnarToRowExec": "child", "CollectLimitExec": "child"}


@dataclass(frozen=True)
class Node:
    """A node of a plan: what it is, the table and filter of a scan or filter, rows as estimated and as counted."""

    id: int
    parent: int | None
    depth: int
    kind: str
    table: str | None
    filter: str | None
    estimate: int | None
    rows: int | None


def _option(value):
    return value.get() if value.isDefined() else None


def _table(node, kind: str) -> str | None:
    if kind != "FileSourceScanExec":
        return None
    named = _option(node.tableIdentifier())
    if named is not None:
        return named.table()
    paths = list(_each(node.relation().location().rootPaths()))
    return paths[0].getName().removesuffix(".parquet") if paths else None


def _filter(node, kind: str) -> str | None:
    if kind == "FilterExec":
        return node.condition().sql()
    if kind == "FileSourceScanExec":
        return " AND ".join(f.sql() for part in (node.partitionFilters(), node.dataFilters()) for f in _each(part)) or None
    return None


def nodes(df: DataFrame, ran: bool = True) -> Iterator[Node]:
    """The nodes of df's physical plan, parents first; subqueries hang below the node that asks for them. A plan that has not run has no counts."""
    number = count()
    waiting = [(df._jdf.queryExecution().executedPlan(), None, 0)]
    while waiting:
        node, parent, depth = waiting.pop()
        kind = node.getClass().getSimpleName()
        if kind in _PASSED:
            waiting.append((getattr(node, _PASSED[kind])(), parent, depth))
            continue
        counted = _option(node.metrics().get("numOutputRows")) if ran else None
        link = _option(node.logicalLink())
        estimate = _option(link.stats().rowCount()) if link is not None else None
        me = next(number)
        yield Node(me, parent, depth, kind.removesuffix("Exec"), _table(node, kind), _filter(node, kind), None if estimate is None else int(str(estimate)), None if counted is None else counted.value())
        below = [*_each(node.children()), *_each(node.subqueries())]
        waiting += [(child, me, depth + 1) for child in reversed(below)]


def run(df: DataFrame) -> None:
    """Compute all rows of df where they lie and drop them, so that its plan has counts."""
    df._jdf.queryExecution().toRdd().count()


def node_table(df: DataFrame) -> DataFrame:
    """The nodes of df's plan as a frame."""
    return df.sparkSession.createDataFrame([astuple(n) for n in nodes(df)], SCHEMA)


def warnings(found: list[Node]) -> list[str]:
    """What is dear in a plan: whole scans of many rows (or of an unknown number), sorts and exchanges of rows, comparisons of all pairs."""
    filtered = {n.parent for n in found if n.filter} | {n.id for n in found if n.filter}
    out = []
    for n in found:
        if "Scan" in n.kind and n.id not in filtered and (n.rows is None or n.rows > MANY_ROWS):
            out.append(f"{n.kind} {n.table or ''}".strip() + f": full scan{'' if n.rows is None else f' ({n.rows} rows)'}")
        elif n.kind in ("Sort", "ShuffleExchange", "SortMergeJoin"):
            out.append(f"{n.kind}: shuffles or sorts the rows")
        elif n.kind in ("BroadcastNestedLoopJoin", "CartesianProduct"):
            out.append(f"{n.kind}: compares all pairs")
    return list(dict.fromkeys(out))


assert [f.name for f in fields(Node)] == [c.split()[0] for c in SCHEMA.split(", ")]

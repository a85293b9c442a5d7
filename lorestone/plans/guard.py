"""Text of queries that others send: what writes, is a command or reads more than the given tables is refused by its parsed plan."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical"
#: Nodes that only read; any other is refused.
_READING = frozenset(
    "Project Aggregate Filter Sort GlobalLimit LocalLimit Offset Union Except Intersect Distinct UnresolvedWith UnresolvedHaving UnresolvedRelation UnresolvedInlineTable UnresolvedSubqueryColumnAliases SubqueryAlias "
    "OneRowRelation Join LateralJoin Generate Sample UnresolvedPivot Pivot Unpivot UnresolvedUnpivot WithWindowDefinition Window UnresolvedTableValuedFunction UnresolvedTVFAliases LocalRelation UnresolvedHint Deduplicate PipeOperator".split()
)
#: Functions that call code by name.
_CALLING = ("java_method", "reflect", "try_reflect")


class Refused(ValueError):
    """A text that may not run."""


def _seq(found: JavaObject) -> Iterator[JavaObject]:
    return (found.apply(i) for i in range(found.length()))


def _nodes(plan: JavaObject) -> Iterator[JavaObject]:
    """All nodes, with those of named parts and of subqueries."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(_seq(node.children()))
        todo.extend(_seq(node.innerChildren()))
        todo.extend(_seq(node.subqueries()))


def _expressions(node: JavaObject) -> Iterator[JavaObject]:
    todo = list(_seq(node.expressions()))
    while todo:
        e = todo.pop()
        yield e
        todo.extend(_seq(e.children()))


def check(spark: SparkSession, text: str, tables: list[str]) -> None:
    """An error unless the text is one query over the tables alone."""
    gateway, logical = spark.sparkContext._gateway, spark._jsparkSession.sessionState().sqlParser()
    try:
        plan = logical.parsePlan(text)
    except Exception as e:  # noqa: BLE001  py4j gives the parser's error as its own
        raise Refused("not a query") from (e if isinstance(e, ParseException) else None)
    nodes = list(_nodes(plan))
    named = {alias.alias().lower() for n in nodes if is_instance_of(gateway, n, f"{_LOGICAL}.UnresolvedWith") for alias in _seq(n.innerChildren())}
    for n in nodes:
        kind = n.getClass().getName()
        if kind.rpartition(".")[2] not in _READING:
            raise Refused(f"{kind.rpartition('.')[2]} is not a read")
        if kind.endswith(".UnresolvedRelation"):
            parts = [str(p) for p in _seq(n.multipartIdentifier())]
            if len(parts) > 1 or parts[0].lower() not in {*named, *(t.lower() for t in tables)}:
                raise Refused(f"unknown table {'.'.join(parts)}")
        for e in _expressions(n):
            if e.getClass().getName().endswith(".UnresolvedFunction") and str(e.nameParts().last()).lower() in _CALLING:
                raise Refused(f"function {e.nameParts().last()} is not allowed")


def run(spark: SparkSession, text: str, args: dict[str, Any] | None = None, **tables: DataFrame) -> DataFrame:
    """The rows of a query over ``tables``, which it names in braces, with its parameters."""
    plain = text
    for name in tables:
        plain = plain.replace(f"{{{name}}}", name)
    check(spark, plain, list(tables))
    return spark.sql(text, args=args, **tables)

"""Queries whose inputs are listed case by case: each row of the part table takes the case that its id falls on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.plans.registry import query
from lotwise.plans.standins import PARTS, parts

_SQL = {"string": "varchar", "int": "integer", "bigint": "bigint", "double": "double", "boolean": "boolean", "timestamp": "timestamp"}


def literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def picked(values: list, kind: str) -> Column:
    """The value that a row's id falls on."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col("id") % len(values)).cast("int"))


def picked_sql(values: list, kind: str) -> str:
    items = ", ".join(f"timestamp {literal(v)}" if kind == "timestamp" and v is not None else literal(v) for v in values)
    return f"cast([{items}] as {_SQL[kind]}[])[cast(id % {len(values)} as integer) + 1]"


def golden(name: str, inputs: dict[str, str], outputs: dict[str, str], cases: list[tuple], f: Callable[..., dict[str, Column]]) -> None:
    """Register a query: ``cases`` are rows of inputs and then expected outputs; ``f`` makes the outputs from the input columns."""
    columns = [list(c) for c in zip(*cases, strict=True)]
    given, wanted = columns[: len(inputs)], columns[len(inputs) :]
    sql = ", ".join(f'{picked_sql(v, k)} "{n}"' for (n, k), v in zip(outputs.items(), wanted, strict=True))

    def run(spark, d):
        rows = parts(spark, d).select("id", *[picked(v, k).alias(n) for (n, k), v in zip(inputs.items(), given, strict=True)])
        made = f(*[F.col(n) for n in inputs])
        return rows.select("id", *[made[n].cast(k).alias(n) for n, k in outputs.items()])

    run.__qualname__ = name
    query(name, f"select id, {sql} from {PARTS}")(run)

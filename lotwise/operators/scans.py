"""Smoothed means over long histories: a scan of affine maps, so that one key's rows may span many tasks.

A step m -> (1 - alpha) m + alpha x is affine, and so is any run of steps. Rows are partitioned by ranges of (key, order). A
first pass folds the run with which each partition begins and the one with which it ends; composing these in the order of
partitions tells with which mean each partition begins. A second pass then applies the steps to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.operators.graph import shared_checkpoint


def step(m: float | None, x: float | None, alpha: float) -> float | None:
    """The mean after a value; the first value is the first mean, and a missing one changes nothing."""
    if x is None or x != x:
        return m
    return x if m is None else (1 - alpha) * m + alpha * x


def fold(values: list[float], alpha: float) -> tuple[float | None, float, float]:
    """(mean without a start, a, b): from a mean m before, the mean after is a * m + b."""
    m, a, b = None, 1.0, 0.0
    for x in values:
        m = step(m, x, alpha)
        if x is not None and x == x:
            a, b = a * (1 - alpha), (1 - alpha) * b + alpha * x
    return m, a, b


def compose(start: float | None, run: tuple[float | None, float, float]) -> float | None:
    m, a, b = run
    return m if start is None else a * start + b


def smoothed(df: DataFrame, keys: list[str], order: list[str], values: list[str], alpha: float = 0.2) -> DataFrame:
    """Adds ``<value>_before`` and ``<value>_after``: the smoothed mean of a key's rows before and up to each row, by ``order``.

    Null values leave the mean as it is; a mean before any value is null. Null keys are a key of their own. What reaches
    the driver are two rows for each partition.
    """
    names = df.columns
    ranged = shared_checkpoint(df.withColumn("__key", F.to_json(F.struct(*keys))).repartitionByRange("__key", *order).sortWithinPartitions("__key", *order))

    def runs(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame]]:
        for part in parts:
            if len(part):
                new = (part["__key"] != part["__key"].shift()).cumsum()
                for _, run in part.groupby(new, sort=False):
                    yield run["__key"].iloc[0], run

    def edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ends: list[list] = []  # of the first and the last key: key, and (mean, a, b) of each value
        for key, run in runs(parts):
            own = [fold(run[v].tolist(), alpha) for v in values]
            if ends and ends[-1][0] == key:
                before = ends[-1][1]
                ends[-1][1] = [(compose(p[0], o), p[1] * o[1], o[1] * p[2] + o[2]) for p, o in zip(before, own, strict=True)]
            else:
                ends[1:] = [[key, own]] if ends else []
                ends = ends or [[key, own]]
        pid = TaskContext.get().partitionId()
        rows = [(pid, i, key, v, *map(float, (m if m is not None else float("nan"), a, b))) for i, (key, own) in enumerate(ends) for v, (m, a, b) in enumerate(own)]
        yield pd.DataFrame(rows, columns=["pid", "at", "key", "value", "m", "a", "b"])

    found: dict[int, list[tuple[str, list]]] = {}
    for r in ranged.mapInPandas(edges, "pid int, at int, key string, value int, m double, a double, b double").orderBy("pid", "at", "value").collect():
        ends = found.setdefault(r["pid"], [])
        if len(ends) <= r["at"]:
            ends.append((r["key"], []))
        ends[r["at"]][1].append((r["m"] if r["m"] == r["m"] else None, r["a"], r["b"]))
    starts: dict[int, list] = {}
    last_key, last = None, None
    for pid in sorted(found):
        ends = found[pid]
        start = last if ends[0][0] == last_key else [None] * len(values)
        if ends[0][0] == last_key:
            starts[pid] = start
        after = [compose(s, run) for s, run in zip(start, ends[0][1], strict=True)]
        last_key, last = (ends[0][0], after) if len(ends) == 1 else (ends[1][0], [run[0] for run in ends[1][1]])

    added = [f"{v}_{side}" for v in values for side in ("before", "after")]

    def apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, means = None, starts.get(TaskContext.get().partitionId())
        begun = False
        for own, run in runs(parts):
            if own != key:
                means = list(means) if not begun and means is not None else [None] * len(values)
                key, begun = own, True
            out = run[names].copy()
            for i, v in enumerate(values):
                before, after = [], []
                for x in run[v].tolist():
                    before.append(means[i])
                    means[i] = step(means[i], x, alpha)
                    after.append(means[i])
                out[f"{v}_before"], out[f"{v}_after"] = (pd.array(pd.Series(c, dtype="float64"), dtype="Float64") for c in (before, after))
            yield out

    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in added]])
    return ranged.mapInPandas(apply, schema)

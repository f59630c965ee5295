"""Exact percentiles against Spark's own, with brackets so small that every group is split often."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import quantiles
from lotwise.operators.quantiles import exact_percentiles

NAMES = {"p0": 0.0, "p10": 0.1, "p33": 1 / 3, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def own(df, by):
    return sorted(map(tuple, df.groupBy(*by).agg(F.count("v").alias("n"), *[F.percentile("v", q).alias(n) for n, q in NAMES.items()]).collect()), key=repr)


def rows(spark, kind):
    rng = np.random.default_rng(4)
    n = 3000
    g = [None if x == 0 else f"g{x}" for x in rng.integers(0, 4, n).tolist()]
    if kind == "bigint":
        v = rng.integers(-(1 << 62), 1 << 62, n).tolist()[: n // 2] + rng.integers(0, 40, n - n // 2).tolist()
        v[:4] = [(1 << 63) - 1, -(1 << 63), (1 << 63) - 2, None]
    elif kind == "double":
        v = (rng.normal(size=n) * 10.0 ** rng.integers(-5, 5, n)).tolist()
        v[:5] = [float("inf"), float("-inf"), 1e308, -1e308, None]
    else:
        v = [7.5] * (n - 3) + [None, 1e300, 7.25]
    return spark.createDataFrame([*zip(g, v, strict=True), ("empty", None), ("one", v[-1])], f"g string, v {'bigint' if kind == 'bigint' else 'double'}").repartition(5)


@pytest.mark.parametrize("kind", ["bigint", "double", "ties"])
@pytest.mark.parametrize(("bracket", "cells"), [(1 << 20, 1024), (20, 8), (3, 2)])
def test_percentiles_equal_sparks(spark, monkeypatch, kind, bracket, cells):
    monkeypatch.setattr(quantiles, "CELLS", cells)
    df = rows(spark, kind)
    if cells == 2:
        df = df.where("g is null or g in ('g1', 'empty', 'one')")
    close = lambda got, want: [r[:2] for r in got] == [r[:2] for r in want] and all(a == b or abs(a - b) <= 1e-12 * max(abs(a), abs(b)) for x, y in zip(got, want, strict=True) for a, b in zip(x[2:], y[2:], strict=True))
    assert close(sorted(map(tuple, exact_percentiles(df, ["g"], "v", NAMES, bracket).collect()), key=repr), own(df, ["g"]))
    if cells == 8:
        whole = [tuple(r) for r in exact_percentiles(df, [], "v", NAMES, bracket).collect()]
        assert close([("", *r) for r in whole], [("", *r) for r in own(df, [])])


def test_nothing_and_nan(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 2.0), (2, None)], "g int, v double")
    assert sorted(map(tuple, exact_percentiles(df, ["g"], "v", {"p50": 0.5}).collect())) == [(1, 1, 2.0), (2, 0, None)]
    assert exact_percentiles(df.limit(0), ["g"], "v", {"p50": 0.5}).collect() == []
    assert [tuple(r) for r in exact_percentiles(df.limit(0), [], "v", {"p50": 0.5}).collect()] == [(0, None)]


def test_no_task_gets_a_whole_group(spark):
    df = spark.range(60_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 60_000).alias("v"))
    out = exact_percentiles(df, ["g"], "v", {"p50": 0.5}, bracket=500)
    assert [tuple(r) for r in out.collect()] == [("hot", 60_000, 29_999.5)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan

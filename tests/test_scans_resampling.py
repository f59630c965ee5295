"""Smoothed means over keys that span many partitions, and the bootstrap, against plain loops."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lotwise.operators import merge, projections, quality, resampling
from lotwise.operators.scans import smoothed


def by_loop(rows, alpha):
    """(key, at) -> (before, after)."""
    out, means = {}, {}
    for key, at, x in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        m = means.get(key)
        n = m if x is None else x if m is None else (1 - alpha) * m + alpha * x
        out[key, at], means[key] = (m, n), n
    return out


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_smoothed_means_span_partitions(spark, parts):
    rng = random.Random(parts)
    rows = [("hot", i, rng.random() * 100) for i in range(600)] + [(f"k{i % 20}", i, rng.random()) for i in range(200)]
    rows += [(None, i, float(i)) for i in range(5)] + [("late", 0, None), ("late", 1, None), ("late", 2, 4.0), ("late", 3, None), ("late", 4, 8.0), ("none", 0, None)]
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "kept") for r in rows], "key string, at int, x double, x_note string").repartition(3)
        got = {(r["key"], r["at"]): (r["x_before"], r["x_after"]) for r in smoothed(df, ["key"], ["at"], ["x"], 0.3).collect()}
        none = smoothed(df.limit(0), ["key"], ["at"], ["x"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = by_loop(rows, 0.3)
    assert none == [] and got.keys() == want.keys()
    for k, pair in want.items():
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9)) for a, b in zip(got[k], pair, strict=True)), k


def test_drift_is_strictly_above_the_threshold(spark):
    rows = [("s", 1, 0.5), ("s", 2, 0.75), ("s", 3, 0.5), ("t", 1, 0.0), ("t", 2, 0.25)]
    got = {(r["source"], r["run"]): (r["rate_baseline"], r["drifted"]) for r in quality.drift(spark.createDataFrame(rows, "source string, run int, rate double"), "source", "run", ["rate"], 0.5, 0.25).collect()}
    assert got == {("s", 1): (None, False), ("s", 2): (0.5, False), ("s", 3): (0.625, False), ("t", 1): (None, False), ("t", 2): (0.0, False)}


def test_bootstrap_equals_loops_and_brackets_the_mean(spark):
    rng = random.Random(1)
    rows = [(f"r{i}", rng.gauss(5, 2), rng.gauss(4, 2)) for i in range(60)] + [("x", None, 1.0), ("y", 1.0, None), (None, 9e9, 1.0)]
    df = spark.createDataFrame(rows, "key string, a double, b double")
    one = resampling.bootstrap(df.repartition(5), "key", "a", "b", 500, seed=7).first()
    two = resampling.bootstrap(df.coalesce(1), "key", "a", "b", 500, seed=7).first()
    pairs = [(k, a - b) for k, a, b in rows if k and a is not None and b is not None]
    means = []
    for i in range(500):
        w = [sum(int(hashlib.md5(f"7:{i}:{k}".encode()).hexdigest()[:8], 16) >= t for t in resampling.WEIGHTS) for k, _ in pairs]
        means.append(sum(x * d for x, (_, d) in zip(w, pairs, strict=True)) / sum(w))
    low, high = (sorted(means)[i] for i in resampling.interval_ranks(500))
    assert all(math.isclose(one[c], two[c], rel_tol=1e-9) for c in ("mean", "low", "high")) and one["replicates"] == 500
    assert math.isclose(one["low"], low, rel_tol=1e-9) and math.isclose(one["high"], high, rel_tol=1e-9)
    assert one["low"] < one["mean"] < one["high"] and one["low"] < 1 < one["high"]
    assert resampling.bootstrap(df.where("key = 'x'"), "key", "a", "b", 10).first()["replicates"] == 0
    assert resampling.interval_ranks(10_000) == (250, 9_749)
    weights = resampling.WEIGHTS
    assert abs(sum(2**32 - w for w in weights) / 2**32 - 1) < 1e-5  # a mean weight of one


def test_settings_of_texts(spark):
    rows = [(None,), ("7",), (" 99999 ",), ("-3",), ("1.5",), ("x",), ("99999999999999999999",)]
    got = [r["s"]["poll_batch"] for r in spark.createDataFrame(rows, "c string").select(projections.settings({"poll_batch": F.col("c")}).alias("s")).collect()]
    assert got == [500, 7, 5000, 1, 500, 500, 500]


def test_folding_keeps_the_least_id_of_each_name(spark):
    rows = [(3, "A"), (1, "a"), (2, None), (5, None), (4, "b")]
    got = sorted(map(tuple, merge.fold_duplicates(spark.createDataFrame(rows, "id int, name string"), F.lower("name"), "id").collect()))
    assert got == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 2)]

"""Pairs within blocks: spread over as many tasks as they need, and the same pairs however they are dealt."""

import random

import pytest

from lotwise.operators import joins


@pytest.mark.parametrize("near", [("v", 5.0), None])
def test_blocked_pairs_equal_all_pairs_however_dealt(spark, monkeypatch, near):
    rng = random.Random(3)
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([rng.uniform(-20, 20), 3.0, None])) for i in range(300)]
    want = {(i, j) for i, a, v in rows for j, b, w in rows if i < j and a is not None and a == b and (near is None or (v is not None and w is not None and abs(v - w) <= 5.0))}
    df = spark.createDataFrame(rows, "id long, block string, v double")
    for each in (4_000_000, 100):
        monkeypatch.setattr(joins, "PAIRS_A_TASK", each)
        found = joins.blocked_pairs(df, ["block"], "id", near=near)
        assert found.columns == ["a_id", "a_block", "a_v", "b_id", "b_block", "b_v"]
        got = [(r["a_id"], r["b_id"]) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_one_cell_with_many_pairs_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIRS_A_TASK", 20_000)
    pairs = joins.blocked_pairs(spark.createDataFrame([(i, "x") for i in range(1000)], "id long, block string"), ["block"], "id")
    sizes = pairs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 499_500 and max(sizes) < 100_000


def _blocks(rng, values, n=250):
    return [(i, rng.choice(["x", "y", None]), rng.choice([rng.choice(values), None] if i % 20 == 0 else values)) for i in range(n)]


@pytest.mark.parametrize("values", [[round(0.37 * i, 2) for i in range(300)], [1.0, 1.01, 3.5, 6.0, 6.01], [2.0], [0.0, 5.0, 10.0]])
def test_widest_pairs_equal_all_pairs_in_order(spark, values):
    rows = _blocks(random.Random(len(values)), values)
    pairs = [(i, j, abs(v - w)) for i, a, v in rows for j, b, w in rows if i < j and a is not None and a == b and v is not None and w is not None and abs(v - w) <= 5.0]
    want = [(i, j) for i, j, g in sorted(pairs, key=lambda p: (-round(p[2], 2), p[0], p[1]))[:20]]
    found = joins.widest_pairs(spark.createDataFrame(rows, "id long, block string, v double"), ["block"], "id", ("v", 5.0), 20)
    assert [(r["a"], r["b"]) for r in found.collect()] == want


def test_links_join_what_all_pairs_join_and_are_no_more_than_rows(spark):
    from lotwise.operators.graph import connected

    rng = random.Random(8)
    rows = _blocks(rng, [rng.uniform(0, 400) for _ in range(150)] + [10.0, 15.0, 20.0], 400)
    df = spark.createDataFrame(rows, "id long, block string, v double")
    links = joins.near_links(df, ["block"], "id", ("v", 5.0))
    assert links.count() < 2 * len(rows)
    pairs = joins.blocked_pairs(df, ["block"], "id", near=("v", 5.0)).select("a_id", "b_id")
    got, want = (sorted(map(tuple, connected(x, *x.columns).collect())) for x in (links, pairs))
    assert got == want and len({c for _, c in want}) > 5


def test_rows_of_scored_pairs_are_dealt_once_and_signals_are_not_listed_for_a_score(spark):
    from lotwise.plans.registry import queries

    plan = queries()["dom08_pair_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "lambda" not in plan

"""Values on an edge, halves and repeated line numbers: queries against their SQL on hand-made tables."""

import datetime
import random

import duckdb
import pytest

from lotwise.plans.registry import oracle_sql, queries


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables given as (columns, rows)."""
    con = duckdb.connect()
    for table, (columns, rows) in tables.items():
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got = queries()[name](spark, str(folder))
    want = con.execute(f"select {', '.join(got.columns)} from ({oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect())), sorted(want)


CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
#: 150 apart: products of these differ by more than 1500, or the product of the difference does.
EDGES = [(1539.54, 1689.54), (4055.64, 4205.64), (-937.19, -787.19), (1525.66, 1675.66)]


def _customers():
    return CUSTOMER, [(2 * i + j, "c", i, v, "s") for i, pair in enumerate(EDGES) for j, v in enumerate(pair)]


def test_scores_of_balances_on_the_edge(spark, tmp_path):
    got, want = both(spark, tmp_path, "dom08_pair_score", customer=_customers())
    assert len(want) == 4 and got == want


def test_rollup_of_balances_on_the_edge(spark, tmp_path):
    # the same dealer, so that the edge decides between 52 and 32
    rows = [(7 * k, n, i, v, s) for k, n, i, v, s in _customers()[1]]
    got, want = both(spark, tmp_path, "agg30_pair_rollup", customer=(CUSTOMER, rows))
    assert len(want) == 2 and got == want


@pytest.mark.parametrize("name", ["agg30_pair_rollup", "dom09_components"])
def test_pairs_of_balances_without_bounds(spark, tmp_path, name):
    inf, nan = float("inf"), float("nan")
    values = [inf, inf, -inf, -inf, nan, nan, None, 1.0, 2.0, -0.0, 500.0] + ([1e300, 1e300, 1e17, 1e17 + 16] if name.startswith("agg30") else [])
    got, want = both(spark, tmp_path, name, customer=(CUSTOMER, [(7 * i, "c", 0, v, "s") for i, v in enumerate(values)]))
    assert want and got == want


def test_tolerance_of_prices_with_half_a_unit(spark, tmp_path):
    # 2 100.5 is 2100 (within 5 % of 2000), 2 099.5 is 2100 as well, 1904.5 is 1904 and 1905.5 is 1906
    rows = [(1, i, p, 1.0) for i, p in enumerate((2100.5, 2099.5, 1904.5, 1905.5, 2101.5, 2100.0))]
    got, want = both(spark, tmp_path, "mth09_tolerance_of_sales", lineitem=("l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double", rows))
    assert got == want and {w[2] for w in want} == {True, False}


def test_first_and_last_price_of_repeated_line_numbers(spark, tmp_path):
    day = datetime.datetime(1997, 1, 1)
    lines = []
    for order in range(40):
        prices = [5.0, 9.0, 7.0, 4.0] if order % 2 else [5.0, 4.0, 1.0, 8.0]
        lines += [(order, 1, day, prices[0]), (order, 1, day, prices[1]), (order, 2, day, prices[2]), (order, 2, day, prices[3])]
    got, want = both(
        spark, tmp_path, "dom17_pricing",
        customer=(CUSTOMER, [(i, "c", 0, 1.0, "s") for i in range(40)]), region=("r_regionkey int, r_name string", [(0, "r")]), nation=("n_nationkey int, n_name string, n_regionkey int", [(0, "n", 0)]),
        orders=("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double, o_orderstatus string, o_orderpriority string", [(i, i, day, 10.0, "O", "1") for i in range(40)]),
        lineitem=("l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz, l_extendedprice double", lines),
    )
    assert want[0][-2] == 20 and got == want


@pytest.mark.parametrize("odd", ["plain", "unpriced listings", "ids of two vehicles", "unpriced lines"])
def test_pricing_of_odd_rows(spark, tmp_path, odd):
    rng = random.Random(1)
    day = lambda: datetime.datetime(1997, 1, 1) + datetime.timedelta(days=rng.randrange(40))
    price = lambda gap: None if odd == gap and rng.random() < 0.3 else round(rng.uniform(1, 1000), 2)
    orders = [(i // 2 if odd == "ids of two vehicles" else i, rng.randrange(30), day(), price("unpriced listings"), "O", "1") for i in range(60)]
    lines = [(rng.randrange(60), i, day(), price("unpriced lines")) for i in range(300)]
    got, want = both(
        spark, tmp_path, "dom17_pricing",
        customer=(CUSTOMER, [(i, "c", 0, 1.0, "s") for i in range(30)]), region=("r_regionkey int, r_name string", [(0, "r")]), nation=("n_nationkey int, n_name string, n_regionkey int", [(0, "n", 0)]),
        orders=("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double, o_orderstatus string, o_orderpriority string", orders),
        lineitem=("l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz, l_extendedprice double", lines),
    )
    assert got == want

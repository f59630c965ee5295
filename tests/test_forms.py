"""What SQL cannot say, against plain loops: redaction, greedy clusters, resampling, near hashes, and refusals."""

import random

import pytest
from pyspark.sql import functions as F

from lotwise.operators import graph, identity, joins, market, projections, reports
from lotwise.plans.registry import queries
from lotwise.sources import adapters, html, structured

SF = "/root/testdata/sf0.001"


def test_greedy_clusters_equal_a_loop(spark):
    rng = random.Random(5)
    rows, seen = [], []
    for i in range(300):
        h = rng.getrandbits(64) if not seen or rng.random() < 0.3 else rng.choice(seen) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 12)))
        seen.append(h)
        rows.append((i, f"e{i % 100}" if i % 10 == 3 else None, h - (1 << 64) if h >= 1 << 63 else h))
    df = spark.createDataFrame(rows, "id long, exact_hash string, phash long")
    got = {r["id"]: (r["cluster"], r["kind"]) for r in identity.image_clusters(df).collect()}
    exact, want, firsts, members = {}, {}, [], {}
    for i, e, _ in rows:
        if e is not None:
            exact.setdefault(e, []).append(i)
    for each in exact.values():
        if len(each) > 1:
            want.update({i: (each[0], "exact") for i in each})
    for i, _, h in rows:
        if i in want:
            continue
        first = next((f for f, g in firsts if ((g ^ h) & ((1 << 64) - 1)).bit_count() <= 10), None)
        if first is None:
            firsts.append((i, h))
            first = i
        members.setdefault(first, []).append(i)
    want.update({i: (f, "near") for f, each in members.items() if len(each) > 1 for i in each})
    assert got == want


@pytest.mark.parametrize(("most", "parts"), [(10, 1), (10, 2), (10, None), (3, 1), (0, 1), (7, 2), (1, 1)])
def test_near_hashes_equal_all_pairs(spark, most, parts):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(40)]
    hashes = [h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most + 2))) for h in base for _ in range(4)]
    rows = [(i, h - (1 << 64) if h >= 1 << 63 else h) for i, h in enumerate(hashes)] + [(1000, None)]
    found = joins.hamming_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h", most, parts).collect()
    got = {(r["a"], r["b"], r["distance"]) for r in found}
    least = {}
    for i, h in enumerate(hashes):
        least.setdefault(h, i)
    some = sorted(least.items(), key=lambda x: x[1])
    assert len(found) == len(got) and got == {(i, j, (g ^ h).bit_count()) for k, (g, i) in enumerate(some) for h, j in some[k + 1 :] if (g ^ h).bit_count() <= most}


def test_random_hashes_hardly_ever_meet(spark):
    rng = random.Random(1)
    n = 1500
    rows = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(n)]
    both, _ = joins.hamming_candidates(spark.createDataFrame(rows, "id long, h long"), 10, 1)
    assert both.count() * 10_000 < n * (n - 1) / 2
    assert all(any((1 << i) & m for m in joins.covering_masks(10, 1)) for i in range(64))


def test_distances_that_select_nothing_are_refused(spark):
    with pytest.raises(ValueError, match="too large"):
        joins.hamming_pairs(spark.createDataFrame([(1, 2)], "id long, h long"), "id", "h", 40, 4)


def test_clusters_leave_no_task_with_all_rows_of_one_hash(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, "placeholder").alias("exact_hash"), (F.col("id") * 0x9E3779B97F4A7).alias("phash")).where("id % 3 = 0 or id < 300")
    plan = identity.image_clusters(df.withColumn("phash", F.when(F.col("exact_hash").isNull(), F.col("phash"))))
    assert plan.where("kind = 'exact'").groupBy("cluster").count().collect() == [(0, 6667)]
    assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_spans_and_settings():
    assert market.span(None, "2024-06-30")[0].isoformat() == "2024-01-02T00:00:00"
    for first, last in (("2024-07-01", "2024-06-30"), ("2019-06-29", "2024-06-30")):
        with pytest.raises(ValueError, match="span"):
            market.span(first, last)
    assert projections.Settings.of({"poll_batch": 10**9}).poll_batch == 5000


def test_components_and_descendants_of_hot_and_cyclic_graphs(spark):
    star = [(0, i) for i in range(1, 2000)] + [(5000 + i, 5001 + i) for i in range(300)] + [(9000, 9000)]
    got = {r["id"]: r["component"] for r in graph.connected(spark.createDataFrame(star, "a long, b long")).collect()}
    assert {got[i] for i in range(2000)} == {0} and {got[5000 + i] for i in range(301)} == {5000}
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (4, 3), (4, 1), (9, 8)], "child long, parent long")
    walked = {(r["id"], r["depth"]) for r in graph.descendants(edges, spark.createDataFrame([(1,)], "id long")).collect()}
    assert walked == {(1, 0), (2, 1), (4, 1), (3, 2)}


def test_places_are_looked_up_once(spark, tmp_path):
    asked = str(tmp_path / "asked")

    def service(city, state):
        with open(asked, "a") as f:
            f.write(f"{city}|{state}\n")
        return (1.0, 2.0) if city == "austin" else None

    df = spark.createDataFrame([(i, "Austin " if i % 2 else "Nowhere", "tx") for i in range(50)] + [(99, None, "tx")], "id int, city string, state string")
    rows = reports.geocoded(df, "city", "state", service).collect()
    assert sorted(open(asked).read().split()) == ["austin|TX", "nowhere|TX"]
    assert all((r["lat"], r["found"]) == ((1.0, True) if r["city"] == "Austin " else (None, False)) for r in rows) and len(rows) == 51


def test_pages_with_broken_markup(spark):
    pages = spark.createDataFrame([(1, "<a href='x'>a<a href=y>b</a>", "https://h.com/d/p"), (2, None, None), (3, "<div itemscope itemtype='Car'><p></div></p></span>", "u"), (4, "", "")], "page_id int, html string, url string")
    assert html.links(pages).count() >= 1
    assert {(r["page_id"], r["kind"]) for r in structured.date_candidates(pages).collect()} == {(3, "anonymous")}


def test_adapters_read_pages_as_partitions(spark):
    spark.dataSource.register(adapters.ListingPages)
    df = spark.read.format("listing_pages").option("module", "lotwise.sources.adapters").option("adapter", "Numbered").option("pages", 3).load()
    assert df.rdd.getNumPartitions() == 3 and df.where(F.col("page") == 2).count() == 10


def test_near_hashes_send_no_side_to_all_tasks(spark):
    rows = spark.range(2000).select("id", F.xxhash64("id").alias("h"))
    for parts in (1, 2):
        both, _ = joins.hamming_candidates(rows, 10, parts)
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan

"""BM25 against plain loops, and hierarchies by doubled steps."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lotwise.operators import filters, fulltext, graph

DOCS = [
    (1, "red van", "A red van, RED and cheap."), (2, "blue van", "blue blue wagon"), (3, None, "van van van"), (4, "Über-Van", ""), (5, "", None), (6, "red", "nothing of note"), (7, "van", "red " * 200),
]
WEIGHTS = {"title": 3.0, "body": 1.0}


def bm25(docs, query, weights):
    words = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    field = {f: {d[0]: words(d[1 + i]) for d in docs} for i, f in enumerate(weights)}
    out = defaultdict(float)
    for f, w in weights.items():
        has = {d: x for d, x in field[f].items() if x}
        mean = sum(map(len, has.values())) / len(has)
        for term in set(words(query)):
            df = sum(term in x for x in has.values())
            for d, x in has.items():
                if tf := Counter(x)[term]:
                    out[d] += w * math.log(1 + (len(has) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
    return sorted(((d, round(s, 6)) for d, s in out.items()), key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize("saved", [False, True])
def test_bm25_equals_loops(spark, tmp_path, saved):
    docs = spark.createDataFrame(DOCS, "id int, title string, body string")
    index = fulltext.build(docs, "id", ["title", "body"])
    index = index.save(str(tmp_path)) if saved else index
    asked = [(1, "red van"), (2, "RED red red"), (3, "über"), (4, "absent"), (5, None), (6, " .,")]
    got = fulltext.search(index, spark.createDataFrame(asked, "query_id int, text string"), WEIGHTS, k=3).orderBy("query_id", "rank").collect()
    want = [(q, i, d, s) for q, text in asked for i, (d, s) in enumerate(bm25(DOCS, text, WEIGHTS)[:3], 1)]
    assert [(r["query_id"], r["rank"], r["doc"]) for r in got] == [w[:3] for w in want]
    assert all(abs(r["score"] - w[3]) < 2e-6 for r, w in zip(got, want, strict=True))
    assert fulltext.search(fulltext.build(docs.limit(0), "id", ["title"]), spark.createDataFrame(asked, "query_id int, text string"), WEIGHTS).collect() == []


def test_many_queries_and_equal_documents_in_small_groups(spark, monkeypatch):
    """Groups of a few postings and queries, chunks of a document; equal texts and repeated ids; a field that counts for nothing."""
    for name, n in {"POSTINGS": 7, "QUERIES": 2, "WORDS": 3, "CELLS": 1, "SENT": 1}.items():
        monkeypatch.setattr(fulltext, name, n, raising=False)
    docs = [(10 * i + d[0], *d[1:]) for i in range(4) for d in DOCS]
    asked = [(i, t) for i, t in enumerate(["red van", "van", "blue wagon cheap", "nothing of", "über red red"])]
    weights = {"title": 3.0, "body": 0.0}
    index = fulltext.build(spark.createDataFrame(docs, "id int, title string, body string"), "id", ["title", "body"])
    found = fulltext.search(index, spark.createDataFrame(asked, "query_id int, text string"), weights, k=6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    want = [(q, i, d, s) for q, text in asked for i, (d, s) in enumerate(bm25(docs, text, weights)[:6], 1)]
    got = [tuple(r) for r in found.orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))
    assert "Aggregate [query_id" not in plan  # no row for each query and document
    twice = fulltext.build(spark.createDataFrame([(1, "red red van"), (1, "van red red"), (None, "red")], "id int, body string"), "id", ["body"])
    assert {(r["term"], r["doc"], r["tf"]) for r in twice.postings.collect()} == {("red", 1, 4), ("van", 1, 2), ("red", None, 1)}


def test_a_search_page_has_filters_and_the_best_first(spark):
    docs = spark.createDataFrame(DOCS, "id int, title string, body string")
    index = fulltext.build(docs, "id", ["title", "body"])
    s = filters.Search(text="van", ranges={"id": (2, 7)}, per_page=2)
    want = [d for d, _ in bm25(DOCS, "van", WEIGHTS) if d >= 2]
    assert [r["id"] for r in filters.search(docs, s, "id", index, WEIGHTS).collect()] == want[:2]


def test_a_search_reads_the_parts_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(300)], "id int, body string")
    index = fulltext.build(docs, "id", ["body"]).save(str(tmp_path))
    found = fulltext.search(index, spark.createDataFrame([(1, "word7")], "query_id int, text string"), {"body": 1.0})
    assert [r["doc"] for r in found.collect()] == [7]
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString())
    assert sum("part" in s and bool(re.search(r" = \d+| IN \(", s)) for s in scans) >= 2  # of postings and of terms


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    longer = graph._longer
    monkeypatch.setattr(graph, "_longer", lambda j: rounds.append(1) or longer(j))
    edges = spark.range(1, 10_000).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    got = graph.descendants(edges, spark.createDataFrame([(0,), (5000,)], "id long"))
    assert got.groupBy("root").agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.sum((F.col("id") - F.col("root") == F.col("depth")).cast("int")).alias("right")).orderBy("root").collect() == [(0, 10_000, 9_999, 10_000), (5000, 5_000, 4_999, 5_000)]
    assert len(rounds) <= 14


def test_several_parents_and_cycles(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (3, 5), (5, 6), (7, 8), (None, 9), (9, None), (10, 10), (6, 11)]
    edges = spark.createDataFrame(pairs, "parent long, child long")
    below = defaultdict(list)
    for a, b in pairs:
        below[a].append(b)
    want = set()
    for root in (1, 7, 99):
        depth, level = {root: 0}, [root]
        while level:
            level = [c for x in level for c in below[x] if c is not None and c not in depth and not depth.update({c: depth[x] + 1})]
        want |= {(i, root, d) for i, d in depth.items()}
    assert set(map(tuple, graph.descendants(edges, spark.createDataFrame([(1,), (7,), (99,)], "id long")).collect())) == want
    assert sorted(r["id"] for r in graph.endless(edges).collect()) == [1, 2, 3, 10]
    assert graph.endless(edges.limit(0)).collect() == []

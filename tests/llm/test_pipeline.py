"""The corpus pipeline stage by stage."""

import re
from collections import Counter

import corpus_pipeline as p
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = docs
    counts = [docs.count()]
    for _, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == names
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    texts = [r["text"] or "" for r in kept.collect()]
    seen = Counter(b[i : i + 200] for b in (t.encode() for t in texts) for i in range(len(b) - 199))
    assert sum(1 for n in seen.values() if n > 1) <= 0.01 * max(1, len(seen))  # what remains met only when its middle went
    last = p.packed(spark, kept, SF)
    assert last.agg(F.sum("length")).first()[0] == last.groupBy("doc_id", "doc_tokens").count().agg(F.sum("doc_tokens")).first()[0]


def test_stages_take_awkward_rows(spark):
    long = " ".join(f"word{i % 977} and the of" for i in range(4000))
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "The thing of and the other. " * 30, "en", "s", 1), (3, "The thing of and the other. " * 30, "en", "s", 1), (4, long, None, None, None), (5, "123 456", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    near = p.near_dedup(spark, docs, SF).collect()
    assert sum(r["doc_id"] == 3 for r in near) == 1 and len(near) == 6
    left = {r["doc_id"] for r in p.language(spark, docs, SF).collect()}
    assert left == {3, 4}


def test_names():
    assert [n for n, _ in p.STAGES] == ["language_id", "quality", "near_dedup", "suffix_dedup", "packing"] and all(re.fullmatch("[a-z_]+", n) for n, _ in p.STAGES)

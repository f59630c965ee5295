"""Words made to collide, repeated rows, repeated and null ids."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lotwise.llm import common, katz, kdtree, minhash, quality, suffix

SCHEMA = "doc_id bigint, text string"


def thue_morse(log2):
    """A word and its complement; polynomial hashes modulo 2**64 don't tell them apart from 1024 letters."""
    bits = [bin(i).count("1") & 1 for i in range(1 << log2)]
    return tuple("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))


def test_near_duplicates_tell_words_of_equal_polynomials_apart(spark):
    t, u = thue_morse(11)
    rows = [(1, f"x y {t}"), (2, f"x y {u}"), (3, t), (4, u), (5, t)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), k=3, numerator=85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_katz_knows_words_by_96_bits(spark):
    t, u = thue_morse(11)
    df = spark.createDataFrame([(1, f"x y {t}"), (2, f"x y {u}"), (3, "x")], SCHEMA)
    got = {r["doc_id"]: r for r in katz.score(df, F.col("doc_id") != 2).collect()}
    assert got[1]["n_known"] == 4 and got[2]["n_known"] == 3
    base = sum(math.log10((c + 1) / (6 + 4 + 1)) for c in (2, 1, 0, 2))
    assert got[2]["train_tokens"] == 6 and abs(got[2]["base_score"] - base) < 1e-9


def test_near_duplicates_read_null_and_repeated_ids_by_their_text(spark):
    rng = np.random.default_rng(0)
    text = lambda: " ".join(rng.choice([f"w{i}" for i in range(50)], 80))
    a, b = text(), text()
    rows = [(None, a), (None, a + " more"), (None, b), (None, b + " less"), (7, text()), (7, a), (9, b), (None, text())] + [(None, a)] * 40
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), k=3, numerator=85).collect()
    assert Counter(r["component_id"] for r in got) == Counter([7] * 43 + [9] * 3 + [7] + [None])


def test_classes_of_one_number_are_told_apart(spark):
    feats = spark.createDataFrame([(1, 5, 1), (2, 5, 1), (3, 5, 2), (4, 6, 2), (5, None, None)], "id long, cls long, cls2 long")
    got = {r["id"]: r["cls"] for r in minhash.told_apart(feats).collect()}
    assert got[1] == got[2] != got[3] and got[4] == 6 and got[5] is None and got[3] != 6


def test_spans_of_copies_of_a_row_do_not_add_up(spark):
    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.integers(97, 123, 600)))
    sizes = []
    for copies in (3, 60):
        rows = [(1, text)] * copies + [(None, text[100:500])] * copies + [(2, "x" + text[:300])]
        df = spark.createDataFrame(rows, SCHEMA)
        spans = suffix.find_spans(df, "doc_id", "text", 200).collect()
        sizes.append(sorted(len(r["spans"]) for r in spans))
        gone = {(r["row"]["doc_id"], r["n_removed"], len(r["kept"])) for r in suffix.remove_repeats(df).collect()}
        assert gone == {(1, 600, 0), (None, 400, 0), (2, 300, 1)}
    assert sizes[0] == sizes[1]


def test_queries_of_one_id_have_rankings_of_their_own(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 3.0]), (3, [2.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, kdtree.top_k(df, F.col("vec_id") == 50, k=2, scale=1).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted([(50, 1, 1, 3), (50, 2, 3, 2), (50, 1, 2, 3), (50, 2, 3, 2)])


def test_quality_fits_on_bounded_rows_however_ids_and_labels_repeat(spark, monkeypatch):
    seen = []
    learn = quality.learn
    monkeypatch.setattr(quality, "learn", lambda x, y, *a: seen.append(len(y)) or learn(x, y, *a))
    rows = [(i % 3, f"text {i} of words") for i in range(300)] + [(None, "no id"), (1, None)]
    labels = [(0, 1, 0), (0, 0, 0), (1, 1, 0), (1, None, 0), (2, 0, 1), (2, 0, 1), (None, 1, 0)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks, sample=50)
    assert seen == [50]
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())
    assert quality.fit(docs, marks, sample=50) == model


def test_word_hashes_follow_slices(monkeypatch):
    import pyarrow as pa

    texts = [None, "", " \n", "One two  THREE\tfour", "Ünï " * 10, "x" * 30]
    whole = common.word_hashes(pa.array(texts))
    monkeypatch.setattr(common, "SLICE_BYTES", 4)
    parts = common.word_hashes(pa.array(texts))
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist() == [0, 0, 0, 0, 4, 14, 15]

"""The training-data operators against brute force, round trips and held-out accuracy, on small and awkward tables."""

import glob
import hashlib
import json
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark import cloudpickle
from pyspark.sql import functions as F
from test_queries import sorted_rows

from lotwise.llm import bpe, chat, common, katz, kdtree, langid, media, minhash, packing, quality, queries, suffix

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, score string, row string, kept string, cls string"


def docs(spark, rows):
    """Rows (doc_id, text) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", "r", "k", "c") for i, t in rows], SCHEMA)


def awkward(seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "日本", "don't", " "]
    text = lambda n: " ".join(rng.choice(words, n))
    base, passage = text(120), text(60)
    rows = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "one two"), (6, base), (7, base), (8, base + " tail"), (9, base.upper()), (None, base), (10, passage + " " + text(80)), (11, text(50) + " " + passage), (12, passage * 3), (13, text(20_000)), (13, text(40)), (14, "a" * 1500), (15, "ab" * 400), (16, base), (16, base)]
    return rows + [(20 + i, text(int(rng.integers(1, 150)))) for i in range(30)]


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_bpe_round_trip(spark):
    rows = awkward() + [(90, "  x\t\n\n y  ½ ²3 'll 'S don't 　 z \x1c\x1f 日本語 テスト 12三 <|endoftext|>")]
    ranks = {a: b for b, a in bpe.codec(queries.RANKS, queries.PATTERN).token.items()}
    other = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = other.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert table(bpe.round_trip(docs(spark, rows), queries.RANKS, queries.PATTERN)) == sorted(want, key=repr)
    coded = bpe.encode(docs(spark, rows), queries.RANKS, queries.PATTERN)
    assert table(bpe.decode(coded, queries.RANKS, queries.PATTERN)) == sorted([(i, bytearray((t or "").encode())) for i, t in rows], key=repr)
    assert bpe.round_trip(docs(spark, []), queries.RANKS, queries.PATTERN).count() == 0


def test_memo_keeps_no_long_words_and_few_short_ones():
    memo = bpe.Memo(str.encode, 10)
    for i in range(100):
        memo.turn()
        assert memo["y" * 100 + str(i)] and memo[str(i)] == str(i).encode()
    assert len(memo) + len(memo.old) <= 22 and all(len(k) < 5 for k in memo)


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slots) == list(range(5000)) and [h.find(k) for k in keys] == list(range(5000)) and h.find(b"x") == -1


def removed_by_force(rows, length=200):
    """(n_bytes, n_removed, n_spans, kept) of each row."""
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(b), int(gone[:-1].sum()), runs, bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return out


# few or many salted groups, and each way of finding repeated anchors: a bitmap, a join, or all anchors taken as frequent
@pytest.mark.parametrize(("frequent", "bits"), [(4096, 27), (3, 27), (3, 12), (4096, 5)])
def test_suffix_dedup(spark, monkeypatch, frequent, bits):
    monkeypatch.setattr(suffix, "FREQUENT", frequent)
    monkeypatch.setattr(suffix, "FILTER_LOG2", bits)
    rows = awkward(1)
    rng = np.random.default_rng(12)
    base = "".join(rng.choice(list("abcd "), 1500))
    rows += [(100 + i, base[a : a + n] + f"#{i}") for i, (a, n) in enumerate(rng.integers(150, 900, (40, 2)).tolist())]  # passages that overlap in all ways
    got = Counter((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix.remove_repeats(docs(spark, rows)).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, removed_by_force(rows), strict=True))
    assert suffix.remove_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("signs", "length"), [("ab", 8), ("ab", 7), ("abc", 1), ("ab\xff", 6), ("\x00a", 5)])
def test_transforms_merge_into_repeated_intervals(signs, length):
    rng = np.random.default_rng(len(signs) * 10 + length)
    for n in (1, 2, 3, 20):
        texts = ["".join(rng.choice(list(signs), int(rng.integers(length, 60)))).encode("latin-1") for _ in range(n)]
        where = defaultdict(list)
        for t, x in enumerate(texts):
            for p in range(len(x) - length + 1):
                where[x[p : p + length]].append((t, p))
        text, place, interval = suffix.intervals(texts, length)
        found = defaultdict(list)
        for t, p, k in zip(text.tolist(), place.tolist(), interval.tolist(), strict=True):
            found[k].append((t, p))
        assert sorted(map(tuple, found.values())) == sorted(tuple(v) for v in where.values() if len(v) > 1)


def test_transform_is_the_symbol_before_each_suffix():
    texts = [b"banana", b"ban", b"ananas"]
    order, before, earlier = suffix.transform(texts)
    whole = [x + 1 for x in b"banana"] + [0] + [x + 1 for x in b"ban"] + [0] + [x + 1 for x in b"ananas"] + [0]
    assert order.tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])
    assert before.tolist() == [whole[i - 1] for i in order.tolist()]
    assert all(order[earlier[r]] == order[r] - 1 for r in range(len(order)) if before[r])


def test_suffix_copies_and_runs_are_named_once(spark, tmp_path, monkeypatch):
    """Neither 100,000 copies of a text nor a long run of one byte are kept in a task: the texts that resolve() saw."""
    monkeypatch.setattr(suffix, "FREQUENT", 2000)
    found, whole = tmp_path / "sizes", suffix.resolve

    def resolve(salts, texts, length):
        with found.open("a") as f:
            f.write(f"{len(texts)} {sum(map(len, texts))}\n")
        return whole(salts, texts, length)

    copies = " ".join(f"word{i}" for i in range(40))
    many = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(copies).alias("text")).repartition(16)
    docs_ = many.unionByName(spark.createDataFrame([(200_000, "a" * 40_000), (200_001, "b" * 200 + copies[:150])], "doc_id bigint, text string"))
    monkeypatch.setattr(suffix, "resolve", resolve)
    cloudpickle.register_pickle_by_value(suffix)  # so that the workers get the patches too
    try:
        got = suffix.remove_repeats(docs_).groupBy("row.text", "n_removed").count().collect()
    finally:
        cloudpickle.unregister_pickle_by_value(suffix)
    assert {(r["n_removed"], r["count"]) for r in got} == {(len(copies), 100_000), (40_000, 1), (0, 1)}
    sizes = [tuple(map(int, x.split())) for x in found.read_text().splitlines()] if found.exists() else []
    assert sum(n for n, _ in sizes) < 20_000


def test_suffix_text_has_no_broken_characters(spark):
    same = "é" * 150
    rows = [(1, "xaé" + same + "z"), (2, "yé" + same + "w")]
    assert all("�" not in r["kept"] for r in suffix.remove_repeats(docs(spark, rows), as_text=True).collect())


def components_by_force(rows, k, least):
    sets, up = [], list(range(len(rows)))
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= least * len(a | sets[j]):
                up[root(i)] = root(j)
    low = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            low[root(i)] = d if low[root(i)] is None else min(low[root(i)], d)
    return [(d, len(sets[i]), low[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("k", "least", "block"), [(3, 85, 1024), (5, 80, 8)])
def test_near_duplicates(spark, monkeypatch, k, least, block):
    monkeypatch.setattr(minhash, "BLOCK", block)  # also with clusters dealt out in blocks
    rng, rows = np.random.default_rng(5), awkward(2)
    base = [f"v{i}" for i in rng.integers(0, 500, 120)]
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 9))):
            w[at] = f"e{i}-{at}"
        rows.append((200 + i, " ".join(w)))
    got = minhash.near_duplicates(docs(spark, rows), k=k, numerator=least)
    want = [(d, n, c, d == c) for d, n, c in components_by_force(rows, k, least)]
    assert table(got.select("doc_id", "n_shingles", "component_id", "kept")) == sorted(want, key=repr)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.97
    model = langid.fit(d)
    odd = {r["doc_id"]: r for r in langid.identify(docs(spark, [(1, None), (2, ""), (3, "123 -- !"), (4, "a"), (5, "é"), (6, "the and of " * 9000)]), model).collect()}
    assert [odd[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and odd[6]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in odd.values())
    assert odd[4]["lang_pred"] != "und" and odd[5]["lang_pred"] != "und"
    nothing = langid.fit(d.where("false"))
    assert {r["lang_pred"] for r in langid.identify(docs(spark, awkward()), nothing).collect()} == {"und"}
    single = langid.fit(d.where("lang = 'de'"))
    assert {r["lang_pred"] for r in langid.identify(docs(spark, [(1, "abc"), (2, None)]), single).collect()} == {"de", "und"}


def test_codewords_differ():
    for k in (1, 2, 3, 4, 5, 9, 30):
        c = langid.codewords(k)
        assert len(c) == k and len({tuple(r) for r in c}) == k


def test_packing(spark):
    rows = awkward(3)
    library = tokenizers.Tokenizer.from_file(queries.VOCABULARY)
    rows = [*rows, (92, '<|endoftext|>'), (93, 'a <|endoftext|><|endoftext|> b<|endoftext|>\n <|endoftext'), (91, "  x\t\n\n y  ½ ²3 'll 'S don't 　 z \x1c\x1f 日本語 テスト 12三 <|endoftext|> e\u0301 \u2028x")]
    got = packing.pack(docs(spark, rows), queries.VOCABULARY, queries.PATTERN).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 and len(r["ids"]) == 4 * r["length"] for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"], r["doc_tokens"]].append(r)
    for (i, t) in rows:
        ids = [x for x in library.encode(t or "", add_special_tokens=False).ids] + [1]
        at, out = 0, b""
        for start in sorted({r["start"] for r in by[i, len(ids)]}):
            assert start == at
            piece = [bytes(r["ids"]) for r in by[i, len(ids)] if r["start"] == start][0]
            out, at = out + piece, at + len(piece) // 4
        assert np.frombuffer(out, "<u4").tolist() == ids
    assert packing.pack(docs(spark, []), queries.VOCABULARY, queries.PATTERN).count() == 0


def test_katz_sums_to_one_and_matches_force(spark, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(katz, "CONTEXT_PART", 40)  # also with split contexts
    rows = [r for r in awkward(4) if r[0] is not None]
    learned = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    got = katz.score(docs(spark, rows), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).collect()
    tokens = [(i, WORD.findall((t or "").translate(LOWER)) + [0]) for i, t in rows]
    uni, bi = Counter(), defaultdict(Counter)
    for i, ts in tokens:
        if learned(i):
            for a, b in zip([0, *ts], ts, strict=False):
                uni[b] += 1
                bi[a][b] += 1
    n, v = sum(uni.values()), len(uni)
    d1, d2 = katz.discounts(Counter(uni.values())), katz.discounts(Counter(c for f in bi.values() for c in f.values()))
    single = {w: (d1[c] if c <= 5 else 1) * c / n for w, c in uni.items()}
    unknown = 1 - sum(single.values())

    def chance(h, w):
        if h not in bi:
            return single.get(w, unknown)
        f, total = bi[h], sum(bi[h].values())
        freed = sum(c * (1 - d2[c]) for c in f.values() if c <= 5)
        if f[w]:
            return (d2[f[w]] if f[w] <= 5 else 1) * f[w] / total * (1 if freed > 0 else total / (total + 1))
        return (freed / total if freed > 0 else 1 / (total + 1)) / (1 - sum(single[x] for x in f if f[x])) * single.get(w, unknown)

    for h in list(bi)[:20]:
        assert math.isclose(sum(chance(h, w) for w in uni) + chance(h, None), 1, rel_tol=1e-9)
    want = Counter((i, len(ts), sum(uni[w] > 0 for w in ts), n, round(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ts), 5), round(sum(math.log10(chance(a, b)) for a, b in zip([0, *ts], ts, strict=False)), 5)) for i, ts in tokens)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in got) == want
    assert all(r["score"] == 0 for r in katz.score(docs(spark, awkward()), F.lit(False)).collect())
    assert katz.score(docs(spark, []), F.lit(True)).count() == 0


def test_quality(spark):
    out = queries.op9_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.93
    model = quality.fit(docs(spark, awkward()), spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r["score"] for r in quality.score(docs(spark, awkward()), model).collect()} == {0.5}


def test_rules_are_conjunctions_with_few_weights():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.5) & (x[:, 8] < 0.7)).astype(float)
    m = quality.learn(x, y)
    score = m.base + sum(w * quality.holds(r, x) for r, w in zip(m.rules, m.weights, strict=True))
    assert ((score > 0) == (y > 0)).mean() > 0.97 and len(m.rules) < 150


def test_kd_tree(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [0.5, 0.25]), (100, [1.0] * 8), (450, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = kdtree.top_k(df, F.pmod(F.col("vec_id"), F.lit(50)) == 0)
    use = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in [(i, v) for i, v in use if i % 50 == 0]:  # 100 twice, with vectors and rankings of their own
        pairs = sorted((-int(v @ w), j, k) for k, (j, w) in enumerate(use) if j != q)
        want += [(q, r + 1, j, -s) for r, (s, j, _) in enumerate(pairs[:5])]
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)
    assert kdtree.top_k(df.limit(0), F.lit(True)).count() == 0


def top_by_force(rows, k=5):
    use = [(i, [kdtree.whole(x, 256) for x in v]) for i, v in rows]
    want = []
    for q in sorted({i for i, _ in use if i % 50 == 0}):
        pairs = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for i, v in use if i == q for j, w in use if j != q)
        want += [(q, r + 1, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, j) in enumerate(pairs[:k])]
    return sorted(want)


@pytest.mark.parametrize("shard", [1 << 16, 40])
def test_kd_tree_is_exact_for_numbers_of_any_size(spark, monkeypatch, shard):
    monkeypatch.setattr(kdtree, "SHARD", shard)  # also over several cells and shards of a cell
    monkeypatch.setattr(kdtree, "CELLS", 4)
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(0, 30)]) for i in range(300)]
    rows += [(300, [2.0**34, 1.0, 0.0]), (301, [2.0**34, 1.0, 0.0]), (302, [1.0, 1.0, 0.0]), (303, [1e300, -1e300, 1e307]), (350, [1e307, 1.0, 1.0]), (304, [-(2.0**60), 2.0**59, 0.1])]
    rows += [(400 + i, [0.25, -0.5, 0.75]) for i in range(60)]  # ties
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"x": F.lit(1), "cell": F.lit("a"), "score": F.lit(None).cast("int"), "rank": F.lit(2)})
    got = kdtree.top_k(df, F.pmod(F.col("vec_id"), F.lit(50)) == 0)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == top_by_force(rows)
    pair = spark.createDataFrame([(0, [2.0**34, 1.0]), (1, [2.0**34, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert [r["vec_id"] for r in kdtree.top_k(pair, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize("copies", [1, 30])
def test_kd_tree_over_many_cells(spark, monkeypatch, copies):
    monkeypatch.setattr(kdtree, "SHARD", 25)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=4) + (i % 5) * 3]) for i in range(500)] + [(500, [9.0, 9.0, 9.0, 9.0])] * copies
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = kdtree.top_k(df, F.pmod(F.col("vec_id"), F.lit(50)) == 0)
    want = top_by_force(rows if copies == 1 else [*rows[:500], *rows[500:]])
    if copies > 1:  # the repeated row asks once, and is a candidate as often as it stands there
        want = [w for w in want if w[0] != 500] + [w for w in top_by_force(rows[:501]) if w[0] == 500]
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


def test_order_keys_sort_as_integers():
    some = [0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 2**200, -(2**200), 2**200 + 1]
    assert sorted(some) == sorted(some, key=kdtree.order_key)


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, 1, "a", "find", '{"q":"x","n":2}', []), (1, 2, "b", "find", '{"n":"2"}', ["a"]), (1, 3, "c", "find", None, ["b", "zz"]), (1, 4, "a", "find", "{}", []), (1, 5, "x", "nope", "[1]", ["y"]), (1, 6, "y", "find", '{"q":"a","z":{"b":1,"a":[1,2]}}', ["x"]), (None, 7, "n", "find", '{"q":"q"}', None), (2, 1, "a", "find", '{"q": "w\\"\\n"}', None)],
        "conv_id int, turn int, call_id string, name string, arguments string, needs array<string>",
    )
    results = spark.createDataFrame([(1, 2, "a", 'ok "1"'), (1, 9, "a", "again"), (1, 5, "zzz", "lost"), (2, 3, "a", None)], "conv_id int, turn int, call_id string, content string")
    schemas = spark.createDataFrame([("find", "q", "STRING", True), ("find", "n", "BIGINT", False)], "name string, field string, kind string, required boolean")
    got = {(r["conv_id"], r["call_id"], r["turn"]): r for r in chat.link_tool_calls(calls, results, schemas).collect()}
    one = got[1, "a", 1]
    assert (one["status"], one["level"], one["valid"]) == ("linked", 0, True)
    assert one["json"] == '{"arguments":{"n":2,"q":"x"},"call_id":"a","content":"ok \\"1\\"","name":"find","status":"linked"}'
    assert (got[1, "b", 2]["level"], got[1, "b", 2]["errors"]) == (1, "missing q; not bigint: n")
    assert (got[1, "c", 3]["level"], got[1, "c", 3]["status"], got[1, "c", 3]["errors"]) == (2, "unanswered", "not an object")
    assert got[1, "a", 4]["status"] == "duplicate" and got[1, "a", 9]["status"] == "duplicate" and got[1, "zzz", 5]["status"] == "orphan"
    assert got[1, "x", 5]["level"] is None and got[1, "x", 5]["errors"] == "unknown tool; not an object"
    assert got[1, "y", 6]["level"] is None and '"z":{"a":[1,2],"b":1}' in got[1, "y", 6]["json"] and got[1, "y", 6]["errors"] == "unknown field z"
    assert len(got) == 10 and got[None, "n", 7]["status"] == "unidentified" and got[2, "a", 1]["status"] == "linked"
    plan = chat.link_tool_calls(calls, results, schemas)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert "SortMergeJoin" not in plan.split("== Physical Plan ==")[-1]
    assert chat.link_tool_calls(calls.limit(0), results.limit(0), schemas.limit(0)).count() == 0


def test_tool_calls_take_long_texts_null_identifiers_and_clashing_columns(spark):
    long = "w\u00e9 \"q\" " * 40000
    rows = [(1, 1, "a", "find", json.dumps({"q": long}), ["a0"]), (1, 0, "a0", "find", "", None), (1, 0, "a0", "find", "", None), *[(None, i, None, "find", "{}", [None]) for i in range(50)]]
    calls = spark.createDataFrame(rows, "conv_id int, turn int, call_id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([(1, 2, "a", long), (1, 2, "a", long), (None, None, None, None)], "conv_id int, turn int, call_id string, content string")
    schemas = spark.createDataFrame([("find", "q", "STRING", True)], "name string, field string, kind string, required boolean")
    more = {c: F.lit("x") for c in ("first", "level", "known", "errors", "args", "status", "field", "kind", "k")}
    got = chat.link_tool_calls(calls.withColumns(more | {"content": F.lit("x")}), results.withColumns(more | {"name": F.lit("x")}), schemas.withColumns(more | {"kind": F.col("kind"), "field": F.col("field")})).collect()
    by = Counter((r["status"], r["valid"], r["level"]) for r in got)
    assert by == {("linked", True, 1): 1, ("unanswered", False, 0): 1, ("duplicate", None, None): 2, ("unidentified", None, None): 51}
    one = next(r for r in got if r["status"] == "linked")
    assert json.loads(one["json"]) == {"arguments": {"q": long}, "call_id": "a", "content": long, "name": "find", "status": "linked"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.queries()[name](spark, SF)
    got = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in got.description]
    rows = df.collect()
    assert rows and sorted_rows(df.columns, rows) == sorted_rows(names, got.fetchall())
    if name == "op6_tool_calls":
        assert {r["valid"] for r in rows} == {True, False, None} and {r["status"] for r in rows} >= {"linked", "unanswered", "orphan", "duplicate"}


def test_image_copies(spark):
    rng = np.random.default_rng(1)

    def photo():
        a = np.zeros((96, 96))
        for _ in range(40):
            y, x = rng.integers(0, 86, 2)
            h, w = rng.integers(5, 30, 2)
            a[y : y + h, x : x + w] = rng.integers(0, 255)
        return a.astype(np.uint8)

    a, b, c = photo(), photo(), photo()
    pictures = [(1, a), (2, a), (3, a[8:84, 10:90]), (4, (a * 0.7 + 20).astype(np.uint8)), (5, b), (6, np.rot90(b).copy()), (7, c), (8, np.zeros((96, 96), np.uint8))]
    rows = [(i, bytearray(p.tobytes()), p.shape[1], p.shape[0]) for i, p in pictures] + [(9, None, 4, 4), (10, bytearray(b"abc"), 4, 4), (None, bytearray(c.tobytes()), 96, 96)]
    df = spark.createDataFrame(rows, "image_id bigint, pixels binary, width int, height int")
    got = {r["image_id"]: r["class_id"] for r in media.find_copies(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9, 10: 10, None: 7}
    assert media.find_copies(df.limit(0)).count() == 0


def photo(rng, side=96, n=40, most=30):
    a = np.zeros((side, side))
    for _ in range(n):
        y, x = rng.integers(0, side - 10, 2)
        h, w = rng.integers(5, most, 2)
        a[y : y + h, x : x + w] = rng.integers(0, 255)
    return a.astype(np.uint8)


@pytest.mark.parametrize("block", [5000, 7])
def test_copies_among_pictures_with_common_descriptors(spark, monkeypatch, block):
    """Groups of differently edited copies, all pictures with one frame in common, against every pair by force."""
    monkeypatch.setattr(media, "BLOCK", block)
    rng = np.random.default_rng(3)
    pictures = []
    for _ in range(12):
        a = photo(rng)
        a[:14], a[-14:], a[:, :14], a[:, -14:] = 60, 60, 60, 60
        a[3:11:4], a[-11:-3:4] = 200, 200
        pictures += [a, (a * 0.7 + 20).astype(np.uint8), np.rot90(a).copy(), np.clip(a.astype(int) + rng.integers(-6, 7, a.shape), 0, 255).astype(np.uint8), a[6:90, 4:92]]
    pictures += [photo(rng)[: 40 + i, : 50 + i].copy() for i in range(20)]
    points = [media.describe(p) for p in pictures]
    true = [(i, j) for i in range(len(pictures)) for j in range(i) if media.agreeing(points[i], points[j])]
    up = list(range(len(pictures)))
    for _ in pictures:
        for i, j in true:
            up[i] = up[j] = min(up[i], up[j])
    df = spark.createDataFrame([(i, bytearray(p.tobytes()), p.shape[1], p.shape[0]) for i, p in enumerate(pictures)], "image_id bigint, pixels binary, width int, height int")
    got = {r["image_id"]: (r["class_id"], r["links"]) for r in media.find_copies(df).collect()}
    degree = Counter(x for pair in true for x in pair)
    assert {i: c for i, (c, _) in got.items()} == dict(enumerate(up))
    assert sum(n for _, n in got.values()) >= 0.99 * sum(degree.values()) and all(n <= degree[i] for i, (_, n) in got.items())


def test_exact_copies_are_every_verified_pair(spark, monkeypatch):
    """Pairs that share too few rare parts to be candidates count with ``exact``."""
    rng = np.random.default_rng(5)
    pictures = [p for _ in range(4) for a in [photo(rng)] for p in (a, *(np.clip(a + rng.normal(0, s, a.shape), 0, 255).astype(np.uint8) for s in (25, 32)))]
    points = [media.describe(p) for p in pictures]
    true = Counter(x for i in range(len(pictures)) for j in range(i) if media.agreeing(points[i], points[j]) for x in (i, j))
    monkeypatch.setattr(media, "VOTES", 10**6)
    df = spark.createDataFrame([(i, bytearray(p.tobytes()), p.shape[1], p.shape[0]) for i, p in enumerate(pictures)], "image_id bigint, pixels binary, width int, height int")
    got = {r["image_id"]: r["links"] for r in media.find_copies(df, exact=True).collect()}
    assert true and got == {i: true[i] for i in range(len(pictures))}


def warped(p, turn, scale):
    """A picture turned by degrees about its middle and resized, on a grey ground."""
    turn, (h, w) = math.radians(turn), p.shape
    n = round(max(h, w) * scale * (abs(math.cos(turn)) + abs(math.sin(turn))))
    y, x = (np.mgrid[0:n, 0:n] - (n - 1) / 2) / scale
    sx, sy = math.cos(turn) * x + math.sin(turn) * y + (w - 1) / 2, math.cos(turn) * y - math.sin(turn) * x + (h - 1) / 2
    q = media.box(p, 1) / 9 if scale < 0.8 else p.astype(float)
    i, j = np.clip(np.floor(sy).astype(int), 0, h - 2), np.clip(np.floor(sx).astype(int), 0, w - 2)
    fy, fx = sy - i, sx - j
    v = q[i, j] * (1 - fx) * (1 - fy) + q[i, j + 1] * fx * (1 - fy) + q[i + 1, j] * (1 - fx) * fy + q[i + 1, j + 1] * fx * fy
    return np.where((sx >= 0) & (sy >= 0) & (sx < w - 1) & (sy < h - 1), v, 128)


EDITS = {
    **{f"turn {a}": (lambda p, a=a: warped(p, a, 1.0)) for a in (5, 15, 45, 120)}, "turn 180": lambda p: p[::-1, ::-1],
    **{f"size {s}": (lambda p, s=s: warped(p, 0, s)) for s in (0.5, 0.75, 1.25, 1.5)},
    "crop 80": lambda p: p[5:82, 8:88], "crop 50": lambda p: p[10:78, 12:80], "noise": lambda p: p + np.random.default_rng(0).normal(0, 4, p.shape), "light": lambda p: p * 0.8 + 30,
}


@pytest.mark.parametrize("edit", EDITS)
def test_recall_and_precision_of_copies_by_edit(edit):
    rng = np.random.default_rng(3)
    whole = [np.where((p := photo(rng, 96, 60, 32)) > 0, p, 128).astype(np.uint8) for _ in range(24)]
    blocks = [media.Block([media.describe(p).tobytes() for p in some]) for some in (whole, [np.clip(np.round(EDITS[edit](p)), 0, 255).astype(np.uint8) for p in whole])]
    _, _, forest = media.meet(*blocks)
    assert sum(i == j for i, j in forest) >= 0.9 * len(whole) and sum(i != j for i, j in forest) <= 1


def test_crops_of_a_large_detailed_picture(spark):
    rng = np.random.default_rng(8)
    a, b = photo(rng, 400, 1500, 24), photo(rng, 400, 1500, 24)
    pictures = [a, a[:200, :200], a[:200, 200:], a[200:, :200], a[150:350, 130:330], b, b[200:, 200:]]
    assert len(media.describe(a)) > 4 * len(media.describe(a[:100, :100])) > 48
    df = spark.createDataFrame([(i, bytearray(p.tobytes()), p.shape[1], p.shape[0]) for i, p in enumerate(pictures)], "image_id bigint, pixels binary, width int, height int")
    assert {r["image_id"]: r["class_id"] for r in media.find_copies(df).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 5}


def test_drawn_copies_share_a_class(spark):
    df = spark.createDataFrame([(1, [0.1] * 64), (2, [0.1] * 64), (3, None), (4, [float("nan"), 1.0])], "vec_id bigint, embedding array<float>")
    assert {r["image_id"]: r["class_id"] for r in media.find_copies(media.drawn(df)).collect()}[2] == 1


def test_drawn_leaves_out_nan(spark):
    rows = [(i, [0.1] * at + [x] + [0.1] * (63 - at)) for i, (at, x) in enumerate([(5, float("nan")), (63, float("nan")), (5, float("inf")), (5, 0.2)])]
    got = {r["image_id"]: r["pixels"] for r in media.drawn(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    assert {i for i, p in got.items() if p is None} == {0, 1, 2}


def test_every_number_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))
    assert public_tokenizers.PATTERN == queries.PATTERN


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + int(x), 2000 + int(y)) for x, y in rng.integers(0, 80, (60, 2))] + [(5, 5), (7, 6), (1, 0)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in edges:
        up[root(x)] = root(y)
    got = {r["node"]: r["comp"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for x, y in edges if x != y} | {y for x, y in edges if x != y}
    assert set(got) == linked and set(got.values()) <= linked
    assert len({(root(x), c) for x, c in got.items()}) == len({root(x) for x in linked}) == len(set(got.values()))
    assert common.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_the_query_of_copies_leaves_no_pair_out(spark, tmp_path):
    """Pictures of one vector with a component changed, in several blocks: links are those of every pair by force. Candidates leave two out."""
    rng = np.random.default_rng(9)
    vectors = []
    for _ in range(6):
        base = rng.normal(size=64)
        for k in range(4):
            vectors.append([float(x) if i != 10 * k + 3 else float(x) + 0.01 for i, x in enumerate(base)])
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    pixels = {r["image_id"]: np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(64, 64) for r in media.drawn(df).collect()}
    first = {p.tobytes(): i for i, p in sorted(pixels.items(), reverse=True)}  # equal pictures are one class
    points = {i: media.describe(pixels[i]) for i in first.values()}
    true = Counter(x for i in points for j in points if j < i and media.agreeing(points[i], points[j]) for x in (i, j))
    got = {r["image_id"]: r["links"] for r in queries.op8_image_copies(spark, str(tmp_path)).collect()}
    assert sum(true.values()) > 10 and got == {i: true[first[p.tobytes()]] for i, p in pixels.items()}


@pytest.mark.parametrize("same", [True, False])
def test_exact_meeting_equals_each_pair_by_force(same):
    rng = np.random.default_rng(4)
    pictures = [np.kron(rng.integers(0, 255, (8, 8)), np.ones((8, 8))).astype(np.uint8) for _ in range(12)]
    pictures += [np.clip(p.astype(int) + rng.integers(-4, 5, p.shape), 0, 255).astype(np.uint8) for p in pictures[:5]]
    points = [media.describe(p) for p in pictures]
    a = media.Block([p.tobytes() for p in points])
    b = a if same else media.Block([p.tobytes() for p in points[::-1]])
    mine, theirs, _ = media.meet(a, None if same else b, exact=True)
    want = [[media.agreeing(x, y) for y in b.points] for x in a.points]
    if same:
        assert (mine + theirs).tolist() == [sum(want[min(i, j)][max(i, j)] for j in range(len(want)) if j != i) for i in range(len(want))]
    else:
        assert mine.tolist() == [sum(r) for r in want] and theirs.tolist() == [sum(c) for c in zip(*want, strict=True)]
    assert mine.sum() >= 3

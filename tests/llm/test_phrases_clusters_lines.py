"""Phrases, clusters and lines against brute force, on small and awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import cluster, lines, phrases

LOWER = {i: i + 32 for i in range(65, 91)}


def phrases_by_force(rows, least, inside, k):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    out = []
    for (lang, p), a in f.items():
        if a < least or len(p) == 1:
            continue
        if len(p) == 2 and any(100 * b >= inside * a for (g, q), b in f.items() if g == lang and len(q) == 3 and b >= least and p in (q[:2], q[1:])):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:i]] * f[lang, p[i:]]), i) for i in range(1, len(p))]
        s, i = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:i]], f[lang, p[i:]], n[lang], s))
    got = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:k]
        got += [(r[0], i, *r[1:]) for i, r in enumerate(own, 1)]
    return sorted(got)


def talk(seed, n=200):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "of", "cat", "sat", "naïve", "日本", "x\x00y", "a\xa0b", "\x1c", "\x85", "\U0001f600"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x0c", "\r\n", "!?"]
    text = lambda m: "".join(str(rng.choice(words)) + str(rng.choice(ends)) for _ in range(m))
    rows = [("en" if i % 3 else (None, "de", "e n")[i % 9 // 3], text(int(rng.integers(0, 30)))) for i in range(n)]
    return [*rows, ("en", None), (None, ""), ("en", "..,!"), ("de", " \t "), ("only", "never again"), *[("en", "new york city hall")] * 12, *[("", "old new york")] * 11]


@pytest.mark.parametrize(("block", "shard", "step", "k"), [(2 << 20, 1 << 19, 1 << 20, 2000), (50, 3, 7, 5)])
def test_collocations(spark, monkeypatch, block, shard, step, k):
    monkeypatch.setattr(phrases, "BLOCK_TOKENS", block)
    monkeypatch.setattr(phrases, "SHARD_ENTRIES", shard)
    monkeypatch.setattr(phrases, "STEP_BYTES", step)
    rows = talk(1)
    schema = "lang string, text string, word string, f long, a long, b long, n long"
    df = spark.createDataFrame([(lang, t, "w", 1, 2, 3, 4) for lang, t in rows], schema).repartition(3)
    got = sorted(map(tuple, phrases.collocations(df, least=10, k=k).collect()))
    assert got == phrases_by_force(rows, 10, 50, k)
    assert phrases.collocations(df.limit(0)).collect() == []
    assert phrases.collocations(df.where("lang = 'only'")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(200):
        a = int(rng.integers(10, 10**15))
        rows.append((a, a + int(rng.integers(0, 10**14)), a + int(rng.integers(0, 10**14))))
    rows += [(10**15, 10**15, 10**15), (10, 10**15, 10**15)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", F.expr(phrases.SCORE.format(a="a", l="l", r="r")).alias("s")).collect()
    assert all(r["s"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in got)


def test_slot_hash_is_minimal_and_compares_keys():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    a[:10] = 7  # keys that differ in one half only
    h = phrases.SlotHash(a, b)
    slots = h.find(a, b)
    assert sorted(slots.tolist()) == list(range(5000))
    assert (h.a[slots] == a).all() and (h.b[slots] == b).all()
    assert (h.find(b, a) == -1).all() and len(phrases.SlotHash(a[:0], b[:0]).find(a, b)) == 5000


def test_tree_sum_adds_all():
    for n in range(1, 20):
        assert phrases.tree_sum(iter([np.array([i, 1]) for i in range(n)])).tolist() == [n * (n - 1) // 2, n]


def clusters_by_force(rows, k, rounds, d, scale, seed):
    """Integers of Python's only."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), j) for j, p in enumerate(c))
    for _ in range(rounds):
        to = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            if own := [v for (_, v), t in zip(kept, to, strict=True) if t == j]:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    most = (1 << 63) - 1
    total = defaultdict(int)
    for _, dist, j in last:
        total[j] += min(dist, most)
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in c]
    return sorted(((i, j, min(dist, most), min(total[j], most), min(sum(total.values()), most), sha[j]) for i, dist, j in last), key=repr)


VECTORS = "vec_id long, embedding array<double>, cluster int, x string, distance string"


@pytest.mark.parametrize("kind", ["usual", "ties", "huge", "few"])
def test_clusters(spark, monkeypatch, kind):
    monkeypatch.setattr(cluster, "STEP", 16)
    rng, d, k = np.random.default_rng(5), 4, 5
    x = rng.normal(size=(150, d)) * (3 if kind == "usual" else 1)
    if kind == "ties":
        x = np.round(x)  # many equal vectors, distances and norms
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, rows[6][1]), (200, None), (201, [1.0] * 3), (202, [1.0, None, 0.0, 0.0]), (203, [1.0, float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [0.0] * d), (206, [-0.0] * d)]
    if kind == "huge":
        rows += [(300, [1e300, -1e300, 0.0, 1.0]), (301, [1e40, 0.0, 0.0, 5e-324]), (302, [float(2**15 + 1), 0.0, 0.0, 0.0]), (303, [1e18, 1.0, 1.0, 1.0]), (304, [-1e300] * 4)]
    if kind == "few":
        rows = rows[:3]
    df = spark.createDataFrame([(*r, 1, "x", "d") for r in rows], VECTORS).repartition(3)
    got = cluster.with_inertia(*cluster.cluster(df, k, 4, d, 1024, 3))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == clusters_by_force(rows, k, 4, d, 1024, 3)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<double>")
    assert cluster.with_inertia(*cluster.cluster(df)).collect() == []


def test_annulus_leaves_centroids_out():
    rng = np.random.default_rng(1)
    centroids = [(rng.integers(-9, 9, 16) + 1000 * i).tolist() for i in range(32)]
    v = np.array(centroids)[rng.integers(0, 32, 500)] + rng.integers(-20, 20, (500, 16))
    a = cluster.Annulus(centroids)
    number, best = a.nearest(v)
    d = ((v[:, None] - np.array(centroids)[None]) ** 2).sum(2)
    assert (number == d.argmin(1)).all() and (best == d.min(1)).all()
    assert a.compared < 2 * len(v)  # of 32 each


def key(line):
    return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)


def lines_by_force(rows, least, chars):
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    n = Counter(k for _, ls in docs for k in {key(x) for x in ls})
    out = []
    for i, ls in docs:
        kept = [x for x in ls if len(key(x)) < chars or n[key(x)] < least]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def pages(seed=2):
    rng = np.random.default_rng(seed)
    own = lambda: " ".join(rng.choice(["a", "b", "Ü", "日本", "c\xa0"], 3))
    shared = ["Subscribe now", "  subscribe NOW\t", "terms", "terms\r", "", "   ", "é", "É", "日", "\x0bmenu\x0c", "menu"]
    rows = [(i % 50, "\n".join(str(rng.choice(shared)) if rng.random() < 0.5 else own() for _ in range(int(rng.integers(1, 20))))) for i in range(80)]
    rows += [(None, "terms\nx"), (None, "terms\nx"), (None, None), (90, None), (91, ""), (92, "\n"), (93, "terms\n" * 3000), (94, "one only"), (95, "menu")]
    return rows + [(7, "twice\nterms")] * 12 + [(8, "almost")] * 9 + [(9, "once\nalmost\nalmost")] * 1 + [(96, "rare " * 20_000)]


SCHEMA = "doc_id bigint, text string, lang string, id string, d1 string, line string, keep string, row string"


@pytest.mark.parametrize(("least", "chars", "parts"), [(10, 1, 4), (2, 3, 11), (10, 1, 40)])
def test_lines(spark, least, chars, parts):
    rows = pages()
    df = spark.createDataFrame([(*r, "en", "i", "d", "l", "k", "r") for r in rows], SCHEMA).repartition(3)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # a common line spans many of them
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = lines.drop_lines(df, least=least, chars=chars)
        have = sorted(map(tuple, got.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()), key=repr)
        assert lines.drop_lines(df.limit(0)).collect() == []
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert have == lines_by_force(rows, least, chars)
    assert set(got.select("row.*").columns) == set(df.columns)


def test_first_occurrences_stay(spark):
    rows = [(2, "b\na\na"), (1, "a\nc\nA "), (3, "c\nb\nd"), (5, "z\n\nz"), (5, "z\n\nz")]
    got = lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string"), least=1, keep_first=True)
    have = sorted((r["row"]["doc_id"], r["kept"], r["n_dropped"]) for r in got.collect())
    assert have == [(1, "a\nc", 1), (2, "b", 2), (3, "d", 2), (5, "z\n", 1), (5, "z\n", 1)]


def test_bitmaps_are_small(spark):
    text = "\n".join(["same"] * 40_000)
    found = lines.line_bitmaps(spark.createDataFrame([(i, text) for i in range(10)], "doc_id long, text string")).collect()
    assert len(found) == 10 and all(len(r["keep"]) < 100 and len(zlib.decompress(r["keep"])) == 5000 for r in found)

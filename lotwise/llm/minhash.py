"""Near-duplicates by MinHash bands and sequential Bayesian verification.

Documents of equal shingle sets form one class. Bands of a class's signature propose candidates; those
that a chain of shared bands connects are compared batch by batch, a pair leaving as soon as the
posterior chance of its similarity reaching the threshold falls below ``MISS``; survivors are verified
on their full sets. A pair already connected is not verified again, so a cell returns a spanning
forest of true links, never all pairs. Large candidate clusters are dealt out as pairs of blocks.

Defined results: null texts and texts without words have an empty set and are linked with nothing;
copies share one class; ids may repeat or be null (a group's id is its least id that is not null).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.llm.common import components, mix, shared_checkpoint, slices, word_hashes

#: Bands of a signature. Each has as many rows as leave a pair at the threshold without a common band at most once in 10**6.
BANDS = 36
#: Hashes that one step of the verification compares.
BATCH = 28
#: Posterior chance of a link at which a pair is given up.
MISS = 1e-6
#: Classes in a block; two blocks meet in one task.
BLOCK = 1024
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 32, BANDS * 16, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * 16, dtype=np.uint32)
_C = [np.uint64(int(x) | 1) for x in _rng.integers(1 << 40, 1 << 63, 8)]


def shingle_sets(column: pa.Array, k: int = 3) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes; fewer words than k make one shingle."""
    h, first = word_hashes(column)
    with np.errstate(over="ignore"):
        run = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            run += mix(h[j : j + len(run)] * _C[j])
        run = mix(run)
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(run[a : b - k + 1]))
            elif b > a:
                out.append(mix(np.array([sum((int(x) * int(c) for x, c in zip(h[a:b], _C[4:], strict=False)), int(b - a)) & ((1 << 64) - 1)], np.uint64)))
            else:
                out.append(h[:0])
    return out


def band_rows(numerator: int) -> int:
    return max(1, *(r for r in range(1, 17) if (1 - (numerator / 100) ** r) ** BANDS <= 1e-6 or r == 1))


def signature(s: np.ndarray, rows: int) -> np.ndarray:
    a, b = _A[: BANDS * rows, None], _B[: BANDS * rows, None]
    low = np.full(BANDS * rows, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (a * x[None, i : i + 2048] + b).min(1), out=low)
    return low


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    with np.errstate(over="ignore"):
        parts = sig.reshape(len(sig), BANDS, rows).astype(np.uint64)
        key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(sig), 1), np.uint64)
        for r in range(rows):
            key = mix(key * _C[0] + parts[:, :, r])
    return key


def set_class(s: np.ndarray) -> tuple[int, int]:
    """128 bits for equal sets: a class's number, and what tells classes of one number apart."""
    return tuple(np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist())


def features(df: DataFrame, doc_id: str, text: str, k: int, rows: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, what is to be carried, th (the text's hash), n_shingles, cls and cls2 (null for an empty set) and band keys."""
    asked = df.select(doc_id, *carry, F.xxhash64(text).alias("th"), F.col(text).alias("__text"))
    schema = asked.drop("__text").schema.add("n_shingles", "long").add("cls", "long").add("cls2", "long").add("bands", T.ArrayType(T.LongType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            sets = shingle_sets(batch.column(2 + len(carry)), k)
            named = [set_class(s) if len(s) else (None, None) for s in sets]
            full = [len(s) > 0 for s in sets]
            keys = band_keys(np.stack([signature(s, rows) for s in sets]), rows)[full].view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.array(full) * BANDS)]).astype(np.int32)), pa.array(keys.ravel()))
            classes = [pa.array([n[i] for n in named], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: 2 + len(carry)], pa.array([len(s) for s in sets], pa.int64()), *classes, bands], names=schema.names)

    return asked.mapInArrow(task, schema)


def told_apart(feats: DataFrame) -> DataFrame:
    """Gives classes that share a number by chance numbers of their own. There is hardly ever one, so what is joined is next to nothing."""
    twice = feats.where("cls is not null").groupBy("cls").agg(F.min("cls2").alias("least"), F.max("cls2").alias("most")).where("least <> most").select("cls", F.lit(True).alias("__twice"))
    twice = shared_checkpoint(twice)
    if twice.isEmpty():
        return feats
    other = F.when(F.col("__twice"), F.xxhash64("cls", "cls2")).otherwise(F.col("cls"))
    return feats.join(twice, "cls", "left").withColumn("cls", other).drop("__twice")


def fewest(threshold: float, n: int, miss: float) -> int:
    """The least number of n equal hashes with which P(similarity >= threshold) is ``miss`` at least, from a uniform prior."""
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def links(sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray, cross: bool, numerator: int, miss: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= numerator * union; if ``cross``, of pairs from both sides."""
    n = np.array([len(s) for s in sets])
    steps = [(i, min(i + BATCH, sig.shape[1])) for i in range(0, sig.shape[1], BATCH)]
    floor = [fewest(numerator / 100, end, miss) for _, end in steps]
    found = []
    for at in range(0, len(sets), 64):
        rows = np.arange(at, min(at + 64, len(sets)))
        others = np.arange(at, len(sets))
        near = 100 * np.minimum(n[rows, None], n[None, others]) >= numerator * np.maximum(n[rows, None], n[None, others])
        near &= others[None, :] > rows[:, None]
        if cross:
            near &= side[rows, None] != side[None, others]
        a, b = np.nonzero(near)
        a, b = rows[a], others[b]
        same = np.zeros(len(a), np.int64)
        for (i, end), least in zip(steps, floor, strict=True):
            part = [(sig[a[c : c + 65536], i:end] == sig[b[c : c + 65536], i:end]).sum(1) for c in range(0, len(a), 65536)]
            same = same + (np.concatenate(part) if part else 0)
            keep = same >= least
            a, b, same = a[keep], b[keep], same[keep]
        found.append(np.stack([same, a, b], 1))
    pairs = np.concatenate(found) if found else np.zeros((0, 3), int)
    up = list(range(len(sets)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out = []
    for _, a, b in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
        if (x := root(a)) != (y := root(b)):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= numerator * (len(sets[a]) + len(sets[b]) - both):
                up[x] = y
                out.append((a, b))
    return out


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, numerator: int = 80, miss: float = MISS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, n_shingles, component_id, kept: groups connected by similarity of numerator/100 or more (k words a shingle)."""
    width = band_rows(numerator)
    feats = told_apart(shared_checkpoint(features(df, doc_id, text, k, width, carry)))
    # a row of each class, by its id and its text's hash
    classes = feats.where("cls is not null").groupBy("cls").agg(
        F.min(doc_id).alias("rep"), F.coalesce(F.min_by("th", doc_id), F.min("th")).alias("rep_th"), F.first("cls2").alias("cls2"), F.first("bands").alias("bands")
    )
    keys = classes.select("cls", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("cls").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    clusters = components(keys.join(shared, "key").where("cls <> lead").select(F.col("cls").alias("a"), F.col("lead").alias("b")).distinct())

    sized = clusters.join(clusters.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "comp")
    members = sized.join(classes.select(F.col("cls").alias("node"), "rep", "rep_th", "cls2"), "node")
    docs = df.select(F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__th"), F.col(text).alias("__text"))
    wanted = docs.join(members, docs["__id"].eqNullSafe(members["rep"]) & (docs["__th"] == members["rep_th"])).select("node", "comp", "blocks", "cls2", "__text")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # the same row may come often
        for batch in slices(batches, "__text"):
            fresh = [not (n in done or done.add(n)) for n in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            sets = shingle_sets(batch.column(4), k)
            right = np.array([set_class(s)[1] == c for s, c in zip(sets, batch.column(3).to_pylist(), strict=True)], bool)  # another text of the same hash
            kept = [s for s, r in zip(sets, right, strict=True) if r]
            yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(right)) for c in batch.columns[:3]), pa.array([signature(s, width).tobytes() for s in kept], pa.binary()), pa.array([s.tobytes() for s in kept], pa.binary())], names=["node", "comp", "blocks", "sig", "members"])

    cells = (
        wanted.mapInArrow(load, "node long, comp long, blocks long, sig binary, members binary")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("node", "comp", "block", "sig", "members", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    )

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        node, block = table.column("node").to_numpy(), table.column("block").to_numpy()
        order = np.sort(np.unique(node, return_index=True)[1])  # a class once, however many rows bear its id
        sig = np.stack([np.frombuffer(table.column("sig")[int(i)].as_py(), np.uint32) for i in order])
        sets = [np.frombuffer(table.column("members")[int(i)].as_py(), np.uint64) for i in order]
        pairs = links(sig, sets, block[order], key[1].as_py() != key[2].as_py(), numerator, miss)
        node = node[order]
        return pa.table({"a": pa.array([node[a] for a, _ in pairs], pa.int64()), "b": pa.array([node[b] for _, b in pairs], pa.int64())})

    true = shared_checkpoint(cells.groupBy("comp", "b1", "b2").applyInArrow(verify, "a long, b long"))
    label = components(true).select(F.col("node").alias("cls"), "comp")
    rows = feats.select(doc_id, *carry, "n_shingles", "cls").join(label, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = rows.where("comp is not null").groupBy("comp").agg(F.min(doc_id).alias("least"))
    return rows.join(least, "comp", "left").select(
        doc_id, *carry, "n_shingles", F.when(F.col("cls").isNull(), F.col(doc_id)).otherwise(F.col("least")).alias("component_id")
    ).withColumn("kept", F.col(doc_id).eqNullSafe(F.col("component_id")))

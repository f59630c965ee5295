"""Centroid clustering (Lloyd's rounds) with annulus search, in whole numbers.

A round reads all vectors once. Centroids are sorted by norm. A vector is first measured against the centroid
whose norm is nearest to its own; that distance bounds the nearest one, and only centroids whose norms lie
within it of the vector's norm (an annulus, found by binary search and widened by more than doubles may round)
can be as near. Those are compared exactly, ties to the smaller number. Nothing is carried from round to round
but the centroids, so a lost executor costs its partitions of one round.

Tasks send sums and counts by centroid and component; ``k`` x components numbers reach the driver in a round, at
any size of the table. Sums are exact: numbers beyond 60 bits travel in limbs. Vectors beyond the range in which
64-bit arithmetic is exact are compared with Python's integers; a distance beyond a long is returned as the
largest long, and still compared by its true value.

Defined results: vectors that are null, hold null or non-finite components, or have another number of components
take no part; rows of equal id are different vectors, a null id hashes as the empty text; with fewer vectors than
``k`` each starts a centroid; an empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import shared_checkpoint
from lotwise.llm.kdtree import whole

#: Components up to this are compared in 64-bit integers: 64 squares of differences stay below 2**59.
SMALL = 1 << 25
#: Vectors that one numpy step works on.
STEP = 8192
_LIMB, _MOST = 60, (1 << 63) - 1


class Annulus:
    """Exact nearest centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.rows = centroids
        norms = [sum(x * x for x in c) for c in centroids]
        self.order = sorted(range(len(centroids)), key=lambda i: (norms[i], i))
        self.small = bool(centroids) and max(abs(x) for c in centroids for x in c) <= SMALL and len(centroids[0]) <= 64
        if self.small:
            self.points = np.array([centroids[i] for i in self.order], np.int64)
            self.norms = np.sqrt(np.array([norms[i] for i in self.order], np.float64))
        self.compared = 0

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row of small integers."""
        norm = np.sqrt((v * v).sum(1).astype(np.float64))
        right = np.searchsorted(self.norms, norm).clip(0, len(self.norms) - 1)
        left = (right - 1).clip(0)
        guess = np.where(norm - self.norms[left] < self.norms[right] - norm, left, right)
        best = ((v - self.points[guess]) ** 2).sum(1)
        number = np.array(self.order)[guess]
        within = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (norm + within + 1)  # a rounding is 2**-52 of it at most
        low = np.searchsorted(self.norms, norm - within - slack, side="left")
        high = np.searchsorted(self.norms, norm + within + slack, side="right")
        self.compared += len(v)
        for j, own in enumerate(self.order):
            at = np.flatnonzero((low <= j) & (j < high) & (guess != j))
            if len(at):
                d = ((v[at] - self.points[j]) ** 2).sum(1)
                win = (d < best[at]) | ((d == best[at]) & (own < number[at]))
                best[at[win]], number[at[win]] = d[win], own
                self.compared += len(at)
        return number, best

    def nearest_large(self, v: list[int]) -> tuple[int, int]:
        """The same for one vector of any size."""
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(self.rows))[::-1]


def batches_of(batches: Iterator[pa.RecordBatch], d: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, dict[int, list[int]]]]:
    """Batches with their vectors floor(scale * x): an array of small integers, and the other rows' numbers by row."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, d)
            large = np.flatnonzero((np.abs(x) > SMALL / scale).any(1)).tolist()
            others = {i: [whole(c, scale) for c in x[i].tolist()] for i in large}
            x[large] = 0
            yield part, np.floor(x * scale).astype(np.int64), others


def assigned(annulus: Annulus, v: np.ndarray, others: dict[int, list[int]]) -> tuple[list[int] | np.ndarray, list[int] | np.ndarray]:
    if annulus.small and not others:
        return annulus.nearest(v)
    number, best = (x.tolist() for x in annulus.nearest(v)) if annulus.small else ([0] * len(v), [0] * len(v))
    for i in others if annulus.small else range(len(v)):
        number[i], best[i] = annulus.nearest_large(others[i] if i in others else v[i].tolist())
    return number, best


def limbs(x: int) -> Iterator[tuple[int, int]]:
    """(place, value): x as a sum of value << 60 * place, values within a long."""
    place = 0
    while not -(1 << 62) <= x < 1 << 62:
        yield place, x & ((1 << _LIMB) - 1)
        x >>= _LIMB
        place += 1
    yield place, x


def sums(vectors: DataFrame, centroids: list[list[int]], d: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Count and exact component sums of each centroid's vectors."""
    k = len(centroids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annulus = Annulus(centroids)
        count, total = np.zeros(k, np.int64), [[0] * d for _ in range(k)]
        for _, v, others in batches_of(batches, d, scale):
            number = np.asarray(assigned(annulus, v, others)[0])
            count += np.bincount(number, minlength=k)
            for c in np.unique(number).tolist():  # rows of large numbers are zero in v
                total[c] = [a + b for a, b in zip(total[c], v[number == c].sum(0).tolist(), strict=True)]
            for i, x in others.items():
                total[number[i]] = [a + b for a, b in zip(total[number[i]], x, strict=True)]
        rows = [(c, d, 0, int(count[c])) for c in range(k) if count[c]]
        rows += [(c, at, place, x) for c in range(k) if count[c] for at in range(d) for place, x in limbs(total[c][at])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["c", "at", "place", "x"])

    parts = vectors.select("vec_id", "x").mapInArrow(task, "c int, at int, place int, x long")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("c", "at", "place").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect():  # k x (d + 1) rows, and limbs
        n, total = out.get(r["c"], (0, [0] * d))
        if r["at"] == d:
            n = int(r["x"])
        else:
            total[r["at"]] += int(r["x"]) << _LIMB * r["place"]
        out[r["c"]] = (n, total)
    return out


def usable(df: DataFrame, vec_id: str, embedding: str, d: int) -> DataFrame:
    x = F.col(embedding)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)
    return df.where(x.isNotNull() & (F.size(x) == d) & F.forall(x, finite)).select(F.col(vec_id).alias("vec_id"), x.alias("x"))


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, d: int = 64, scale: int = 1024, seed: int = 3, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each vector, and the centroids. They start as the k vectors of least sha256 of ``seed:vec_id``; ``scale`` is a power of two."""
    vectors = shared_checkpoint(usable(df, vec_id, embedding, d))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()
    centroids = [[whole(float(c), scale) for c in r["x"]] for r in first]
    for _ in range(rounds if centroids else 0):
        for c, (n, total) in sums(vectors, centroids, d, scale).items():
            centroids[c] = [x // n for x in total]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annulus = Annulus(centroids)
        for part, v, others in batches_of(batches, d, scale):
            number, best = assigned(annulus, v, others)
            best = best if isinstance(best, np.ndarray) else [min(b, _MOST) for b in best]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(task, f"vec_id {kind}, cluster int, distance long"), centroids


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia (sums of distances, the largest long at most) and centroid_sha256."""
    found = shared_checkpoint(found)
    own = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(c, min(int(n), _MOST), min(int(sum(own.values())), _MOST), digests[c]) for c, n in own.items()]
    known = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Exact top-k search by inner product with a KD-tree in each shard.

1. Cells. Median splits of a bounded sample cut space into a bounded number of cells; each cell's tight
   box is taken over all its vectors. Large cells are dealt to shards of about ``SHARD`` vectors.
2. First visit. A query goes to the cell whose box bounds it highest, and gets a k-th score there.
3. Second visit. With that score it goes to the other cells, but only to those whose bound reaches it.
In a shard a task builds a tree (median splits, tight boxes) and takes blocks of queries through it best
first: a node is opened only by queries whose bound for its box reaches their k-th score so far, which
each query carries from node to node and from visit to visit. Shards' answers meet in one ranking.

Scores are whole numbers of any size. Where doubles may round, bounds are widened by the largest rounding
and what stays in question is computed with Python's integers. A score beyond a long is returned as the
nearest long and still ranked by its true value.

Defined results: vectors that are null or hold null or non-finite components, or whose length differs
from the most common one, take no part; rows of equal vec_id are different candidates, except that a
query never meets a row of its own id; queries of equal vec_id have a ranking for each different vector;
ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import shared_checkpoint

#: Vectors of a shard, queries of a block, and vectors of a leaf.
SHARD, QUERIES, LEAF = 65_536, 1_024, 64
#: Most cells, most bytes of their boxes (each task holds them), and rows of the sample that places the cells' borders.
CELLS, BOX_BYTES, SAMPLE = 1_024, 16 << 20, 32_768
#: Doubles are exact below this.
EXACT = 2.0**53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    return int(x) * scale if abs(x) >= EXACT else math.floor(x * scale)


def under(score: int) -> float:
    """The largest double that is not above an integer."""
    try:
        near = float(score)
    except OverflowError:
        return -np.inf if score < 0 else np.finfo(float).max
    return near if int(near) <= score else float(np.nextafter(near, -np.inf))


def order_key(score: int) -> bytes:
    """Bytes that sort as integers do."""
    raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    n = len(raw).to_bytes(4, "big")
    return b"\x01" + n + raw if score >= 0 else b"\x00" + bytes(255 - b for b in n + raw)


class Tree:
    """Median splits along the widest side, and each node's bounding box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple[int, int, np.ndarray, np.ndarray, int, int]] = []
        self._grow(0, len(points), leaf)

    def _grow(self, lo: int, hi: int, leaf: int) -> int:
        part = self.points[self.order[lo:hi]]
        low, high, at = part.min(0), part.max(0), len(self.nodes)
        self.nodes.append((lo, hi, low, high, -1, -1))
        if hi - lo > leaf and (high > low).any():
            mid = (hi - lo) // 2
            side = np.where(high > low, high - low, -1).argmax()
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(part[:, side], mid)]
            left = self._grow(lo, lo + mid, leaf)
            self.nodes[at] = (lo, hi, low, high, left, self._grow(lo + mid, hi, leaf))
        return at


class Cells:
    """Borders of cells by median splits of a sample, and the cell of any vector."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.cuts = depth, {}
        self._split(sample, 1, depth)

    def _split(self, part: np.ndarray, at: int, depth: int) -> None:
        if depth:
            side = np.where(part.max(0) > part.min(0), part.max(0) - part.min(0), -1).argmax() if len(part) else 0
            cut = float(np.median(part[:, side])) if len(part) else 0.0
            self.cuts[at] = (int(side), cut)
            right = part[:, side] >= cut
            self._split(part[~right], 2 * at, depth - 1)
            self._split(part[right], 2 * at + 1, depth - 1)

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.ones(len(points), np.int64)
        side, cut = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        for node, (s, c) in self.cuts.items():
            side[node], cut[node] = s, c
        for _ in range(self.depth):
            at = 2 * at + (points[np.arange(len(points)), side[at]] >= cut[at])
        return at - (1 << self.depth)


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and box (a row of ``low`` and ``high``) no less than the score of any vector in the box."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        reach = np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T
        # a sum of products of doubles is off by this part of its terms' sizes at most
        wide = bound + np.where(reach < EXACT, 0.0, (queries.shape[1] + 4) * 2.0**-51 * reach)
    return np.where(np.isnan(wide), np.inf, wide)


class Best:
    """The k best (score, id) of each of some queries, scores exact in int64, for vectors whose products doubles hold exactly."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.score, self.name, self.floor = np.full((n, k), _LEAST, np.int64), np.full((n, k), _MOST, np.int64), floor

    def threshold(self) -> np.ndarray:
        worst = self.score[:, -1]
        return np.maximum(self.floor, np.where(worst == _LEAST, -np.inf, worst.astype(np.float64)))

    def add(self, live: np.ndarray, score: np.ndarray, names: np.ndarray, own: np.ndarray) -> None:
        score = score.astype(np.int64)
        score[own] = _LEAST
        names = np.where(own, _MOST, names[None, :])
        score, names = np.concatenate([self.score[live], score], 1), np.concatenate([self.name[live], names], 1)
        top = np.lexsort((names, ~score), axis=1)[:, : self.score.shape[1]]
        self.score[live], self.name[live] = np.take_along_axis(score, top, 1), np.take_along_axis(names, top, 1)

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for r, c in zip(*np.nonzero(self.score != _LEAST), strict=True):
            yield int(r), int(self.name[r, c]), int(self.score[r, c])


def search(x: np.ndarray, ids: np.ndarray, asked: np.ndarray, own: np.ndarray, k: int, scale: int, floor: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query's place, id, exact score) of the k best vectors ``x`` of each of ``asked``, of those that reach ``floor``."""
    with np.errstate(over="ignore", invalid="ignore"):
        points, queries = np.floor(x * scale), np.floor(asked * scale)
        size, spread = np.abs(points).max(1), np.abs(queries).max(1)
        small = float(size.max()) * float(spread.max()) * x.shape[1] < EXACT
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    tree = Tree(points)
    best = Best(len(queries), k, floor) if small else None
    lists: list[list[tuple[int, int]]] = [[] for _ in queries]  # of (-score, id), where doubles may round
    limit = floor.copy()
    bounds, heap = {0: np.full(len(queries), np.inf)}, [(-np.inf, 0)]
    while heap:
        _, node = heapq.heappop(heap)
        lo, hi, _, _, left, right = tree.nodes[node]
        live = np.flatnonzero(bounds.pop(node) >= limit)  # an equal score may have a smaller id
        if not len(live):
            continue
        if left >= 0:
            for child in (left, right):
                bound = np.full(len(queries), -np.inf)
                bound[live] = box_bounds(queries[live], *(tree.nodes[child][i][None, :] for i in (2, 3)))[:, 0]
                if (bound[live] >= limit[live]).any():
                    bounds[child] = bound
                    heapq.heappush(heap, (-float(bound.max()), child))
            continue
        at = tree.order[lo:hi]
        same = own[live, None] == ids[None, at]
        with np.errstate(over="ignore", invalid="ignore"):
            score = queries[live] @ points[at].T
        if best is not None:
            best.add(live, score, ids[at], same)
            limit = best.threshold()
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            most = spread[live, None] * size[None, at] * x.shape[1]
            off = np.where(most < EXACT, 0.0, (x.shape[1] + 4) * 2.0**-51 * most)
            for i, q in enumerate(live.tolist()):
                may = ~(score[i] + off[i] < limit[q]) & ~same[i]
                sure = np.sort(np.where(may & (off[i] < np.inf), score[i] - off[i], -np.inf))[::-1]
                if len(sure) >= k:
                    may &= ~(score[i] + off[i] < sure[k - 1])
                for j in at[may].tolist():
                    value = sum(whole(a, scale) * whole(b, scale) for a, b in zip(asked[q].tolist(), x[j].tolist(), strict=True))
                    lists[q].append((-value, int(ids[j])))
                lists[q] = sorted(lists[q])[:k]
                if len(lists[q]) == k:
                    limit[q] = max(floor[q], under(-lists[q][-1][0]))
    return [*best.rows()] if best is not None else [(q, name, -value) for q, some in enumerate(lists) for value, name in some]


def usable(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and x (doubles) of the vectors that take part, and their length d."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(fine & (F.size("x") > 0)).select("vec_id", "x", F.size("x").alias("d"))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(rows, -1)


def answer(here: DataFrame, asked: DataFrame, k: int, scale: int) -> DataFrame:
    """query_id, q, vec_id, score, key: the best of each shard (cell, sub) for the queries sent there; q tells queries of one id apart."""

    def task(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by shard, its vectors first and then its queries by block
        shard, ids, points, held, block = None, None, None, [], None

        def ask() -> Iterator[pa.RecordBatch]:
            if held and points is not None:
                own, q, floor, which = (np.concatenate([h[i] for h in held]) for i in range(4))
                got = search(points, ids, q, own, k, scale, floor)
                value = [s for _, _, s in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([int(c[i]) for i, _, _ in got], pa.int64()) for c in (own, which)), pa.array([n for _, n, _ in got], pa.int64()),
                        pa.array([min(max(s, _LEAST), _MOST) for s in value], pa.int64()),
                        pa.array([None if _LEAST < s < _MOST else order_key(s) for s in value], pa.binary()),
                    ],
                    names=["query_id", "q", "vec_id", "score", "key"],
                )
            held.clear()

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in tables:
            cell, sub, b, i, f, which = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("cell", "sub", "block", "vec_id", "floor", "q"))
            v = matrix(batch.column(batch.schema.get_field_index("x")), len(i))
            cut = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1]) | (b[1:] != b[:-1]), [True]]))
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                own = (cell[a], sub[a])
                if (own, b[a]) != (shard, block):
                    yield from ask()
                    if own != shard:
                        points, parts = None, []
                    shard, block = own, b[a]
                if b[a] < 0:
                    parts.append((i[a:z], v[a:z]))
                else:
                    if points is None and parts:
                        ids, points, parts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), []
                    held.append((i[a:z], v[a:z], f[a:z], which[a:z]))
        yield from ask()

    both = here.unionByName(asked)
    return both.repartition("cell", "sub").sortWithinPartitions("cell", "sub", "block", "vec_id").mapInArrow(task, "query_id long, q long, vec_id long, score long, key binary")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), F.desc("key"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "q", "rank", "vec_id", "score", "key")


def top_k(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where ``is_query`` (a Column over vec_id) holds, against all rows.

    Components count as floor(scale * x); ``scale`` is a power of two.
    """
    rows = usable(df, vec_id, embedding)
    lengths = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"))
    about = lengths.orderBy(F.desc("n"), "d").first()
    d, n, asking = (about["d"], about["n"], about["q"]) if about else (1, 0, 0)
    rows = rows.where(F.col("d") == d).drop("d")
    depth = max(0, min(CELLS, BOX_BYTES // (16 * d), n // SHARD).bit_length() - 1)
    blocks = -(-asking // QUERIES) or 1
    chosen = rows.orderBy(F.xxhash64("vec_id", "x")).limit(SAMPLE).select("x").toArrow().column("x").combine_chunks() if depth else None  # bounded

    def floored(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.floor(x * scale)

    cells = Cells(floored(matrix(chosen, len(chosen))) if depth else np.zeros((0, d)), depth)

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            v = floored(matrix(batch.column(0), batch.num_rows)) if batch.num_rows else np.zeros((0, d))
            of = cells.of(v)
            for c in np.unique(of).tolist():
                part = v[of == c]
                low, high, many = seen.get(c, (np.inf, -np.inf, 0))
                seen[c] = [np.minimum(low, part.min(0)), np.maximum(high, part.max(0)), many + len(part)]
        for c, (low, high, many) in seen.items():
            names = ["cell", "n", "at", "low", "high"]
            yield pa.RecordBatch.from_arrays([pa.array([c] * d, pa.int64()), pa.array([many] * d, pa.int64()), pa.array(range(d), pa.int64()), pa.array(low), pa.array(high)], names=names)

    each = rows.select("x").mapInArrow(boxes, "cell long, n long, at long, low double, high double")
    box = each.groupBy("cell", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("cell", "at").toArrow()  # BOX_BYTES at most
    known = box.column("cell").to_numpy()[::d]
    low, high = (box.column(c).to_numpy().reshape(-1, d) for c in ("low", "high"))
    subs = dict(zip(known.tolist(), (-(-box.column("n").to_numpy()[::d] // SHARD)).tolist(), strict=True))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                of = cells.of(floored(matrix(batch.column(1), batch.num_rows)))
                many = np.array([subs.get(c, 1) for c in of.tolist()])
                sub = np.abs(batch.column(2).to_numpy()) % many
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(of), pa.array(sub)], names=["vec_id", "x", "cell", "sub"])

    def visits(first: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    bound = box_bounds(floored(matrix(part.column(1), part.num_rows)), low, high)
                    best = bound.argmax(1)
                    floor = part.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    go = np.zeros(bound.shape, bool)
                    if first:
                        go[np.arange(len(best)), best] = True
                    else:
                        go = bound >= floor[:, None]
                        go[np.arange(len(best)), best] = False
                    row, col = np.nonzero(go)
                    many = np.array([subs[c] for c in known.tolist()], np.int64)[col]
                    row, col = np.repeat(row, many), np.repeat(col, many)
                    sub = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                    pick = pa.array(row)
                    sent = [part.column(0).take(pick), part.column(1).take(pick), pa.array(floor[row]), part.column(3).take(pick), pa.array(known[col]), pa.array(sub)]
                    yield pa.RecordBatch.from_arrays(sent, names=["vec_id", "x", "floor", "q", "cell", "sub"])

        return task

    schema = "vec_id long, x array<double>, floor double, q long, cell long, sub long"
    here = rows.select("vec_id", "x", F.xxhash64("vec_id", "x", F.monotonically_increasing_id()).alias("salt")).mapInArrow(place, "vec_id long, x array<double>, cell long, sub long")
    here = here.withColumns({"block": F.lit(-1).cast("long"), "floor": F.lit(None).cast("double"), "q": F.lit(0).cast("long")})
    asked = rows.where(is_query).select("vec_id", "x").distinct().withColumn("q", F.xxhash64("x"))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long")
    nothing = F.lit(None).cast("double").alias("floor")
    found = answer(here, asked.select("vec_id", "x", nothing, "q").mapInArrow(visits(True), schema).withColumn("block", block), k, scale)
    if len(known) > 1:
        found = shared_checkpoint(ranked(found, k).drop("rank"))
        kth = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id", "q"))).where(F.col("n") == k).groupBy(F.col("query_id").alias("vec_id"), "q").agg(F.min("score").alias("least"))
        # a long as a double that is not above it; the least long may stand for less
        floor = F.when(F.col("least") > _LEAST, F.col("least").cast("double") - F.abs("least").cast("double") * 2.0**-52).alias("floor")
        again = asked.join(kth, ["vec_id", "q"], "left").select("vec_id", "x", floor, "q").mapInArrow(visits(False), schema).withColumn("block", block)
        found = found.unionByName(answer(here, again, k, scale))
    return ranked(found, k).drop("key", "q")

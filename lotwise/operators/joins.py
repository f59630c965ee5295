"""Joins beyond equality, rewritten to equality on buckets, and recursive lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.numeric import hamming, haversine
from lotwise.operators.graph import descendants, shared_checkpoint
from lotwise.operators.groups import top_k


def bucket_range(start: Column, end: Column, unit: str, first: Column, last: Column) -> tuple[Column, Column]:
    """First and last bucket that an interval touches within [first, last]; none if the first is later."""
    step = F.expr(f"interval 1 {unit}")
    lo = F.greatest(F.date_trunc(unit, start), F.date_trunc(unit, first))
    # a start exactly at a bucket's end counts in the bucket before as well: the upper bound is inclusive
    edge = (F.date_trunc(unit, start) == start) & (start > F.date_trunc(unit, first))
    lo = F.when(edge, F.date_trunc(unit, start) - step).otherwise(lo)
    return lo, F.least(F.date_trunc(unit, F.coalesce(end, last)), F.date_trunc(unit, last))


def covered_buckets(df: DataFrame, start: Column, end: Column, unit: str, first: Column, last: Column) -> DataFrame:
    """JON04: a row for each bucket that an interval touches (an end on a boundary touches the next one too), within [first, last].

    Instead of joining every bucket with every row, each row names its own buckets.
    """
    lo, hi = bucket_range(start, end, unit, first, last)
    return df.withColumn("bucket", F.explode(F.when(lo <= hi, F.sequence(lo, hi, F.expr(f"interval 1 {unit}")))))


def spine(spark, first: str, last: str, unit: str) -> DataFrame:
    """DAT02: one row per bucket."""
    return spark.range(1).select(F.explode(F.sequence(F.date_trunc(unit, F.lit(first).cast("timestamp")), F.date_trunc(unit, F.lit(last).cast("timestamp")), F.expr(f"interval 1 {unit}"))).alias("bucket"))


#: Hashes up to which two halves of a hash are looked up instead of whole ones: fewer keys a hash, more candidates.
HALVES = 300_000


def spine_of(df: DataFrame, at: str, unit: str) -> DataFrame:
    """DAT02: one row per bucket of the span that a column has; none without a value."""
    trunc = lambda c: F.date_trunc(unit, c)
    ends = df.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo is not null")
    return ends.select(F.explode(F.sequence(trunc("lo"), trunc("hi"), F.expr(f"interval 1 {unit}"))).alias("bucket"))


def covering_masks(most: int, parts: int, bits: int = 64) -> list[int]:
    """Masks such that any two hashes at distance ``most`` or less agree under one of them, and others hardly ever.

    A covering family after Pagh (SODA 2016): each bit has a vector of r + 1 bits, and each other vector v a mask of the
    bits whose vector has an odd product with v. Up to r bits leave a v that is even with all of theirs. With ``parts`` the
    family is made for each part of the bits, of which one differs in ``most // parts`` bits at most.
    """
    import random

    r = most // parts
    if most < 0 or parts * ((2 << r) - 1) > 4096:
        raise ValueError(f"distance {most} is too large for {parts} parts")

    def family(seed: int) -> list[int]:
        rng, out = random.Random(seed), []
        for p in range(parts):
            own = {i: rng.randrange(1, 2 << r) for i in range(p * bits // parts, (p + 1) * bits // parts)}
            out += [sum(1 << i for i, x in own.items() if (x & v).bit_count() & 1) for v in range(1, 2 << r)]
        return out

    # of some families the one under which the fewest random hashes agree
    return min((family(seed) for seed in range(8)), key=lambda f: sum(2.0 ** -m.bit_count() for m in f))


def hamming_candidates(one: DataFrame, most: int, parts: int) -> tuple[DataFrame, Column]:
    """Pairs of rows (id, h) that agree under a mask, with the mask's number and whether an earlier mask has the pair too."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in covering_masks(most, parts)])
    keys = one.select("id", "h", F.posexplode(F.transform(masks, lambda m: F.col("h").bitwiseAND(m))).alias("mask", "part"))
    a, b = (keys.select("mask", "part", F.col("id").alias(x), F.col("h").alias(f"h{x}")) for x in ("a", "b"))
    # keys are many times the rows that Spark sees before the explosion, so that it would send one side to the driver
    both = a.hint("merge").join(b.hint("merge"), ["mask", "part"]).where(F.col("a") < F.col("b"))
    differ = F.col("ha").bitwiseXOR(F.col("hb"))
    return both, F.exists(F.slice(masks, F.lit(1), F.col("mask")), lambda m: differ.bitwiseAND(m) == 0)


def hamming_pairs(df: DataFrame, row_id: str, bits: str, most: int = 10, parts: int | None = None) -> DataFrame:
    """JON23: pairs of 64-bit hashes at distance ``most`` or less, by equality under covering masks.

    Whole hashes have 2047 keys at distance 10, and one of 48,000 pairs of random hashes meets; halves have 126 keys, and one
    of 80 meets. Without ``parts`` the number of hashes decides. A pair counts under its first mask only. Rows of equal
    hashes are joined once, as one hash with its least id; their members follow from the hash. Null hashes have no pairs.
    """
    one = df.where(F.col(bits).isNotNull()).groupBy(F.col(bits).alias("h")).agg(F.min(row_id).alias("id"))
    if parts is None:
        parts = 2 if most > 3 and one.count() <= HALVES else 1
    both, before = hamming_candidates(one, most, parts)
    close = both.where((hamming(F.col("ha"), F.col("hb")) <= most)).where(~before)
    return close.select("a", "b", hamming(F.col("ha"), F.col("hb")).alias("distance"))


def within_radius(df: DataFrame, lat: str, lng: str, at: tuple[float, float], miles: float) -> DataFrame:
    """JON22: rows within a distance; a box of degrees, which the scan can use, goes before the exact test."""
    from math import cos, radians

    dlat = miles / 69.0 + 1e-6
    dlng = dlat / max(0.01, cos(radians(min(89.0, abs(at[0]) + dlat))))
    d = haversine(F.lit(at[0]), F.lit(at[1]), F.col(lat), F.col(lng))
    return df.where(F.col(lat).between(at[0] - dlat, at[0] + dlat) & F.col(lng).between(at[1] - dlng, at[1] + dlng)).withColumn("miles", d).where(F.col("miles") <= miles)


def finite(name: str) -> Column:
    """Whether a value is neither null nor NaN nor infinite: no other is close to any, not even to its like."""
    return F.abs(F.col(name).cast("double")) < F.lit(float("inf"))


#: Candidate pairs that a task meets, about.
PAIRS_A_TASK = 4_000_000


def blocked_pairs(df: DataFrame, block: list[str], row_id: str, condition: Column | None = None, near: tuple[str, float] | None = None) -> DataFrame:
    """JON08: pairs a < b within a block. ``near`` (column, width) narrows a block to rows whose values differ by ``width`` at most.

    Left rows look into their own and the next two cells of the value, so a block is never met with itself whole. Pairs are
    many times the rows, so cells are counted first: tasks are as many as the pairs need, and a cell with more pairs than a
    task should meet is dealt out by its left rows.
    """
    key, looking, rows = block, df, df
    if near:
        # a little wider than ``width``, so that rounding puts no pair two cells apart; beyond 10**12 cells all values share one
        cell = F.floor(F.greatest(F.lit(-1e12), F.least(F.lit(1e12), F.col(near[0]) / (near[1] * 1.000001))))
        df = df.where(finite(near[0]))
        key, rows = [*block, "__cell"], df.withColumn("__cell", cell)
        looking = df.withColumn("__cell", F.explode(F.array(*[cell + i for i in (-1, 0, 1)])))
    right = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__right"))
    left = right.withColumnRenamed("__right", "__left")
    if near:
        left = left.withColumn("__cell", F.explode(F.array(*[F.col("__cell") + i for i in (-1, 0, 1)]))).groupBy(*key).agg(F.sum("__left").alias("__left"))
    work = shared_checkpoint(left.join(right, key).select(*key, (F.col("__left") * F.col("__right")).alias("__pairs")))
    total, most = work.agg(F.sum("__pairs"), F.max("__pairs")).first()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // PAIRS_A_TASK))
    large = work.where(F.col("__pairs") > PAIRS_A_TASK).select(*[F.col(c).alias(f"__of_{c}") for c in key], F.ceil(F.col("__pairs") / PAIRS_A_TASK).cast("int").alias("__shares"))

    # a share that is always the same would fall out of the join's keys, and rows would be dealt again by those left, over fewer tasks
    parted = [*key, "__share"] if (most or 0) > PAIRS_A_TASK else key

    def dealt(side: DataFrame, share: Column) -> DataFrame:
        """With the share of its cell that a row goes to, if any cell has more than one."""
        if parted is not key:
            known = side.join(large, [F.col(c) == F.col(f"__of_{c}") for c in key], "left").withColumn("__shares", F.coalesce("__shares", F.lit(1)))
            side = known.withColumn("__share", share).drop("__shares", *[f"__of_{c}" for c in key])
        return side.repartition(tasks, *parted)

    a = dealt(looking, F.pmod(F.xxhash64(row_id), F.col("__shares")).cast("int"))
    b = dealt(rows, F.explode(F.sequence(F.lit(0), F.col("__shares") - 1)))
    a, b = a.select([F.col(c).alias(f"a_{c}") for c in a.columns]), b.select([F.col(c).alias(f"b_{c}") for c in b.columns])
    on = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in parted]
    if near:
        on.append(F.abs(F.col(f"a_{near[0]}") - F.col(f"b_{near[0]}")) <= near[1])
    pairs = a.hint("merge").join(b.hint("merge"), on).where(F.col(f"a_{row_id}") < F.col(f"b_{row_id}")).drop("a___cell", "b___cell", "a___share", "b___share")
    return pairs.where(condition) if condition is not None else pairs


def widest_pairs(df: DataFrame, block: list[str], row_id: str, near: tuple[str, float], most: int, scale: int = 2) -> DataFrame:
    """SRT09: (a, b, gap): of ``blocked_pairs`` the ``most`` with the largest difference, to ``scale`` digits, ties to the smaller ids.

    Only differences close to the width are met: a band below it is widened until it holds enough pairs of values. Of rows with
    the same value only the ``most + 1`` least ids can be among the answers, since of two rows of that value the smaller id comes first.
    """
    name, width = near
    rows = top_k(df.select(*block, F.col(row_id).alias("id"), F.col(name).cast("double").alias("v")).where(F.abs("v") <= 1e15), [*block, "v"], [F.asc("id")], most + 1)
    rows = shared_checkpoint(rows)
    values = rows.groupBy(*block, "v").agg(F.count(F.lit(1)).alias("n"))
    unit = 10.0**-scale
    band = 2 * unit
    while True:
        band = min(band, float(width))
        cell = max(band, unit)
        first = F.floor((F.col("v") + (width - band)) / cell)
        low = values.select(*block, F.col("v").alias("low"), F.explode(F.array(*[first + i for i in (-1, 0, 1, 2)])).alias("cell"))
        high = values.select(*block, F.col("v").alias("high"), F.floor(F.col("v") / cell).alias("cell"))
        gap = F.abs(F.col("low") - F.col("high"))
        met = low.join(high, [*block, "cell"]).where((F.col("low") <= F.col("high")) & (gap <= width))
        if band == width:
            break
        # what lies outside the band is smaller than these, also when rounded
        if met.where(gap >= width - band + unit).limit(most).count() == most:
            met = met.where(gap >= width - band)
            break
        band *= 4
    low, high = (rows.select(*block, F.col("v").alias(v), F.col("id").alias(f"id_{v}")) for v in ("low", "high"))
    pairs = met.select(*block, "low", "high", gap.cast(f"decimal(12,{scale})").alias("gap")).join(low, [*block, "low"]).join(high, [*block, "high"])
    pairs = pairs.where((F.col("low") < F.col("high")) | (F.col("id_low") < F.col("id_high")))
    return pairs.select(F.least("id_low", "id_high").alias("a"), F.greatest("id_low", "id_high").alias("b"), "gap").orderBy(F.desc("gap"), "a", "b").limit(most)


def near_links(df: DataFrame, block: list[str], row_id: str, near: tuple[str, float]) -> DataFrame:
    """(a, b): links with the same connected components as ``blocked_pairs``, as many as rows at most twice over.

    Rows of a cell of half the width are all close to one another, so each is linked to the cell's least id; cells are linked
    where the greatest value of one and the least of a later one are close. What lies between two close values is close to both.
    """
    name, width = near
    cell = F.floor(F.col(name) / (width / 2 * 0.999999))
    rows = df.where(finite(name)).select(*block, F.col(row_id).alias("id"), F.col(name).alias("v"), cell.alias("cell"))
    cells = shared_checkpoint(rows.groupBy(*block, "cell").agg(F.min("id").alias("head"), F.min("v").alias("least"), F.max("v").alias("most")))
    inside = rows.join(cells.select(*block, "cell", "head"), [*block, "cell"]).where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    before = cells.select(*block, F.explode(F.array(*[F.col("cell") + i for i in (1, 2, 3)])).alias("cell"), F.col("head").alias("a"), F.col("most").alias("up"))
    across = before.join(cells, [*block, "cell"]).where(F.abs(F.col("up") - F.col("least")) <= width).select("a", F.col("head").alias("b"))
    return inside.unionByName(across)


def lineage(edges: DataFrame, roots: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """SET02, DOM23: (id, root, depth) of all descendants; a node reached twice keeps its least depth."""
    return descendants(edges, roots, child, parent)


def prefix_join(df: DataFrame, text: str, bases: DataFrame, base: str) -> DataFrame:
    """JON24: rows with each base that their text begins with, of whatever length: equality on prefixes of the lengths that bases have.

    Lengths are few (a base is a name), so each row has a few prefixes instead of meeting every base.
    """
    sizes = [r[0] for r in bases.select(F.length(base)).where(F.length(base) > 0).distinct().limit(257).collect()]
    if len(sizes) > 256:
        raise ValueError("bases have more than 256 different lengths")
    starts = F.array_distinct(F.filter(F.array(*[F.when(F.length(text) >= n, F.left(F.col(text), F.lit(n))) for n in sizes]), lambda x: x.isNotNull()))
    return df.withColumn("__start", F.explode(starts)).join(bases.select(F.col(base).alias("__start")).distinct(), "__start").withColumnRenamed("__start", base)


def with_fallback(df: DataFrame, table: DataFrame, exact: list[str], loose: list[str], payload: str) -> DataFrame:
    """JON19, JON20: the payload of the exact key, else of the looser key where the rest is null, with the kind of match."""
    rest = [c for c in exact if c not in loose]
    one = table.select(*exact, F.col(payload).alias("exact_hit"))
    two = table.where(" and ".join(f"{c} is null" for c in rest)).groupBy(*loose).agg(F.min(payload).alias("loose_hit"))
    hit = df.join(one, exact, "left").join(two, loose, "left")
    return hit.withColumn("match", F.when(F.col("exact_hit").isNotNull(), "exact").when(F.col("loose_hit").isNotNull(), "fallback").otherwise("none")).withColumn(payload, F.coalesce("exact_hit", "loose_hit")).drop("exact_hit", "loose_hit")

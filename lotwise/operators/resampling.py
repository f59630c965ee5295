"""AGG35: a seeded paired bootstrap as one aggregation.

Instead of drawing rows, each row gets a Poisson weight of mean one for each replicate, from a hash of seed, replicate and the
row's key. So rows need not be gathered, numbered or ordered, and the same rows give the same interval on any cluster.
"""

from __future__ import annotations

from math import ceil, exp, factorial, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Chances, in parts of 2**32, of a weight of at most 0, 1, 2, ...
WEIGHTS = [floor(2**32 * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(10)]


def bootstrap(df: DataFrame, key: str, a: str, b: str, replicates: int = 10_000, seed: int = 466, sure: float = 0.95) -> DataFrame:
    """One row: mean of a - b over rows with both, low and high ends of its interval, and how many replicates it rests on.

    ``key`` (text, unique) tells rows apart. The ends are the replicates' means at the ranks floor(t n) and ceil((1 - t) n) - 1.
    """
    pairs = df.where(F.col(key).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(key).alias("key"), (F.col(a) - F.col(b)).alias("diff"))
    each = pairs.select("key", "diff", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), "key").cast("binary")), 1, 8), 16, 10).cast("long")
    weight = sum(((draw >= w).cast("int") for w in WEIGHTS[1:]), (draw >= WEIGHTS[0]).cast("int"))
    sums = each.select("replicate", "diff", weight.alias("w")).groupBy("replicate").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("diff")).alias("s"))
    means = sums.where("n > 0").select((F.col("s") / F.col("n")).alias("m"))
    tail = (1 - sure) / 2
    # as many rows as replicates
    ranked = means.withColumns({"i": F.row_number().over(Window.orderBy("m")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())})
    low, high = F.floor(F.lit(tail) * F.col("n")), F.least(F.col("n") - 1, F.ceil(F.lit(1 - tail) * F.col("n")) - 1)
    ends = ranked.agg(F.max(F.when(F.col("i") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("i") == high, F.col("m"))).alias("high"), F.count(F.lit(1)).alias("replicates"))
    return pairs.agg(F.avg("diff").alias("mean")).crossJoin(ends)  # one row each


def interval_ranks(n: int, sure: float = 0.95) -> tuple[int, int]:
    """The ranks of the interval's ends among n sorted means."""
    tail = (1 - sure) / 2
    return floor(tail * n), min(n - 1, ceil((1 - tail) * n) - 1)

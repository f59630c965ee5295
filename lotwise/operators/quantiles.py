"""Exact percentiles by distributed selection.

Each wanted rank of a group keeps a bracket of values that holds it. While a bracket has more than ``BRACKET`` rows,
its rows are counted by cells of value (partial sums, no row moves but counts), and the bracket becomes the cell in
which its rank falls, with that cell's own least and greatest value. Then the rows of small brackets are counted by
value, and the two values around each rank are interpolated. So no task sorts more than a bracket, however large a
group is, and most rows are only read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.operators.graph import shared_checkpoint

#: Rows of a bracket that is small enough to be sorted, cells into which a larger one is split, and brackets that are broadcast.
BRACKET, CELLS, FEW = 1 << 20, 1024, 10_000
_TOP = 1.7976931348623157e308
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _cell(v: Column, lo: Column, hi: Column, whole: bool, by_size: bool) -> Column:
    """The cell of a value within [lo, hi]: never lower for a greater value, and not the same for both ends.

    ``by_size`` gives equal shares of the values' orders of magnitude, for brackets with far outliers.
    """
    if whole:
        wide = lambda c: c.cast("decimal(20,0)")
        part, all_ = (wide(v) - wide(lo)).cast("double"), (wide(hi) - wide(lo)).cast("double")
    else:
        near = lambda c: F.greatest(F.least(c.cast("double"), F.lit(_TOP)), F.lit(-_TOP)) / 2
        scaled = (lambda c: F.asinh(near(c))) if by_size else near
        part, all_ = scaled(v) - scaled(lo), scaled(hi) - scaled(lo)
    inner = F.least(F.floor(part / all_ * CELLS), F.lit(CELLS - 1))
    return F.when(v == lo, 0).when(v == hi, CELLS).when(all_ > 0, inner + 1 if whole else F.greatest(inner, F.lit(0))).otherwise(1).cast("int")


def _within(rows: DataFrame, brackets: DataFrame, by: list[str], few: bool) -> DataFrame:
    """Rows with each bracket of their group that holds them."""
    own = brackets.select(*[F.col(c).alias(f"__{c}") for c in by], "lo", "hi", "below", "ranks")
    own = F.broadcast(own) if few else own  # counted: FEW at most
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return rows.join(own, [*same, F.col("__v") >= F.col("lo"), F.col("__v") <= F.col("hi")])


def _holding(df: DataFrame) -> DataFrame:
    """Cells of counts that hold one of their bracket's ranks, with those ranks."""
    first = df.withColumns({"before": F.col("below") + F.col("upto") - F.col("n"), "after": F.col("below") + F.col("upto")})
    inside = first.withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("after")))).where(F.size("ranks") > 0)
    return inside.withColumn("below", F.col("before"))


def exact_percentiles(df: DataFrame, by: list[str], value: str, names: dict[str, float], bracket: int = BRACKET) -> DataFrame:
    """One row for each group: ``by``, ``n`` (its values) and a double for each name's share, interpolated between ranks.

    Nulls and NaN take no part; a group without values has n 0 and nulls. Without ``by`` there is one row.
    Loop state is checkpointed: a round for each thousandfold of ``bracket`` that the largest group has.
    """
    keys = [F.col(c) for c in by]
    kind = df.schema[value].dataType
    whole = isinstance(kind, _WHOLE)
    v = F.col(value)
    fine = v if whole or isinstance(kind, T.DecimalType) else F.when(~F.isnan(v), v)
    rows = shared_checkpoint(df.select(*keys, fine.alias("__v")))
    positions = {name: F.lit(q) * (F.col("n") - 1) for name, q in names.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p).cast("long"), F.ceil(p).cast("long")) for p in positions.values()])))
    groups = shared_checkpoint(rows.groupBy(*by).agg(F.count("__v").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")))
    brackets = groups.where("n > 0").select(*by, "lo", "hi", F.lit(0).cast("long").alias("below"), ranks.alias("ranks"), "n")
    large = (F.col("n") > bracket) & (F.col("lo") < F.col("hi"))
    done, by_size = None, True
    while True:
        about = brackets.agg(F.count(F.lit(1)).alias("all"), F.count_if(large).alias("large")).first()
        if not about["large"]:
            break
        done = brackets.where(~large) if done is None else done.unionByName(brackets.where(~large))
        split = _within(rows.where("__v is not null"), brackets.where(large), by, about["large"] <= FEW)
        cell = _cell(F.col("__v"), F.col("lo"), F.col("hi"), whole, by_size)
        counts = split.groupBy(*by, F.col("lo").alias("from"), "below", "ranks", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*by, "from").orderBy("cell"))  # CELLS + 1 rows at most
        brackets = shared_checkpoint(_holding(counts.withColumn("upto", upto)).select(*by, "lo", "hi", "below", "ranks", "n"))
        by_size = not by_size
    brackets = brackets if done is None else done.unionByName(brackets)
    few = brackets.limit(FEW + 1).count() <= FEW if done is not None else about["all"] <= FEW
    values = _within(rows.where("__v is not null"), brackets, by, few).groupBy(*by, "lo", "below", "ranks", "__v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by, "lo").orderBy("__v"))  # a bracket's different values
    at = _holding(values.withColumn("upto", upto)).select(*by, F.explode("ranks").alias("rank"), F.col("__v").cast("double").alias("__v"))
    found = at.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "__v"))).alias("at"))  # two ranks a name at most
    own = found.select(*[F.col(c).alias(f"__{c}") for c in by], "at")
    out = groups.join(own, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], "left") if by else groups.join(own, F.lit(True), "left")

    def share(p: Column) -> Column:
        low, high = (F.get(F.map_values(F.map_filter("at", lambda k, _: k == f(p).cast("long"))), F.lit(0)) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high)

    return out.select(*by, "n", *[share(p).alias(name) for name, p in positions.items()])

"""Market figures: pricing percentiles, popularity and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.numeric import days_between
from lotwise.operators.graph import shared_checkpoint
from lotwise.operators.groups import first_last, representative
from lotwise.operators.joins import bucket_range
from lotwise.operators.quantiles import exact_percentiles

QUANTILES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def percentiles(df: DataFrame, by: list[str], value: str, names: dict[str, float] = QUANTILES) -> DataFrame:
    """AGG04: ``by``, n and each share: exact, with linear interpolation; nulls are ignored. A group may be larger than any task."""
    return exact_percentiles(df, by, value, names)


def percentiles_of(df: DataFrame, by: list[str], values: dict[str, tuple[Column, float]]) -> DataFrame:
    """AGG05: one percentile each of several columns (null where a row is filtered out), all found in the same passes."""
    each = F.array(*[F.struct(F.lit(name).alias("measure"), v.cast("double").alias("value")) for name, (v, _) in values.items()])
    long = df.select(*by, F.inline(each))
    shares = {f"q{i}": q for i, q in enumerate(dict.fromkeys(q for _, q in values.values()))}
    name_of = {q: n for n, q in shares.items()}
    found = exact_percentiles(long, [*by, "measure"], "value", shares)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("measure") == name, F.col(name_of[q]))).alias(name) for name, (_, q) in values.items()])


def pricing(listings: DataFrame, history: DataFrame, as_of: Column, place: list[str] | None = None) -> DataFrame:
    """DOM17: one row: representatives with a price, their percentiles and ages, and how many prices dropped.

    The price filter holds before the choice of representatives, but not for the drop rate: both choices are
    ranks of one shuffle. ``place`` are columns of the history by which points of the same time and number are told apart.
    """
    vehicle = F.coalesce(F.col("vehicle_id").cast("string"), F.col("id").cast("string"))
    latest = [F.desc("listed_at"), F.asc("id")]
    any_rank = F.row_number().over(Window.partitionBy(vehicle).orderBy(*latest))
    priced_rank = F.row_number().over(Window.partitionBy(vehicle).orderBy(F.col("price_cents").isNull(), *latest))
    reps = listings.select("id", "vehicle_id", "listed_at", "source_listed_at", "price_cents").withColumns({"any": any_rank, "priced": priced_rank})
    reps = reps.where("any = 1 or (priced = 1 and price_cents is not null)")
    use = (F.col("priced") == 1) & F.col("price_cents").isNotNull()
    age = F.when(use, days_between(as_of, F.col("source_listed_at")))
    ends = first_last(history, "listing_id", "price_cents", ["recorded_at", "seq"], place)
    rows = shared_checkpoint(reps.select("id", "any", use.alias("use"), F.when(use, F.col("price_cents")).alias("price_cents"), age.alias("age")))
    rep = F.col("any") == 1
    # an id counts once, also where rows of several vehicles have it
    known = rows.where(rep).select("id").distinct().join(ends, F.col("id") == F.col("listing_id"))
    moved = known.agg(F.count(F.lit(1)).alias("with_history"), F.count_if(F.col("first_value") > F.col("last_value")).alias("dropped"))
    stats = rows.agg(F.count_if("use").alias("total")).crossJoin(F.broadcast(moved))
    shares = {n: (F.col("price_cents"), q) for n, q in QUANTILES.items()} | {"median_age_days": (F.col("age"), 0.5)}
    found = percentiles_of(rows, [], shares)
    rate = F.when(F.col("with_history") > 0, F.round(F.col("dropped") / F.col("with_history"), 2)).alias("drop_rate")
    return stats.crossJoin(F.broadcast(found)).select("total", *QUANTILES, "median_age_days", "with_history", "dropped", rate)  # one row each


def inventory(reps: DataFrame, buckets: DataFrame, unit: str, first: Column, last: Column) -> DataFrame:
    """How many listings each bucket's interval touches: one more at a listing's first bucket, one less after its last, then a running sum over the buckets."""
    lo, hi = bucket_range(F.col("listed_at"), F.col("gone_at"), unit, first, last)
    step = F.expr(f"interval 1 {unit}")
    ends = F.array(F.struct(lo.alias("bucket"), F.lit(1).alias("n")), F.struct((hi + step).alias("bucket"), F.lit(-1).alias("n")))
    change = reps.where(lo <= hi).select(F.inline(ends)).groupBy("bucket").agg(F.sum("n").alias("n"))
    # one row per bucket: as many as the span has weeks or months
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("bucket"))
    return F.broadcast(buckets).join(change, "bucket", "left").select("bucket", running.alias("inventory"))


def trends(listings: DataFrame, history: DataFrame, buckets: DataFrame, unit: str, first: Column, last: Column) -> DataFrame:
    """DOM18: inventory, median recorded price and mean days to gone per bucket; each is aggregated before they meet."""
    reps = representative(listings)
    there = inventory(reps, buckets, unit, first, last)
    recorded = history.join(reps.select(F.col("id").alias("listing_id")), "listing_id").select(F.date_trunc(unit, "recorded_at").alias("bucket"), "price_cents")
    prices = exact_percentiles(recorded, ["bucket"], "price_cents", {"median_price": 0.5}).drop("n")
    left = reps.where("gone_at is not null").groupBy(F.date_trunc(unit, "gone_at").alias("bucket"))
    gone = left.agg(F.avg(days_between(F.col("gone_at"), F.col("source_listed_at"))).alias("days_to_gone"))
    return there.join(prices, "bucket", "left").join(gone, "bucket", "left").select("bucket", "inventory", "median_price", "days_to_gone")


def span(first: str | None, last: str, default_days: int = 180, most_days: int = 1826):
    """DAT09: the span asked for, or the default lookback; a span turned round or too long is refused before any work."""
    import datetime as dt

    to = dt.datetime.fromisoformat(last)
    start = dt.datetime.fromisoformat(first) if first else to - dt.timedelta(days=default_days)
    if start > to:
        raise ValueError("the span's start must be before its end")
    if to - start > dt.timedelta(days=most_days):
        raise ValueError(f"the span cannot exceed {most_days} days")
    return start, to


def spans(first: Column, last: Column, default_days: int = 180, most_days: int = 1826) -> Column:
    """DAT09 for many requests at once: struct of first, last and error; an error leaves no span."""
    start = F.coalesce(first, last - F.make_interval(days=F.lit(default_days)))
    error = F.when(last.isNull(), "the span needs an end").when(start > last, "the span's start must be before its end")
    error = error.when(start < last - F.make_interval(days=F.lit(most_days)), f"the span cannot exceed {most_days} days")
    fine = lambda c: F.when(error.isNull(), c)
    return F.struct(fine(start).alias("first"), fine(last).alias("last"), error.alias("error"))


def popular(listings: DataFrame, key: str, most: int = 10) -> DataFrame:
    """AGG01: the most frequent values among representatives."""
    return representative(listings).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("value")).limit(most)

"""One or a few rows per group: representatives, latest values, top rows and changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list, order: list, k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each group. Spark limits each group before the shuffle, so a large group costs k rows a task."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def representative(df: DataFrame, vehicle: str = "vehicle_id", row_id: str = "id", listed_at: str = "listed_at") -> DataFrame:
    """WIN01: the latest listed row of each vehicle; a row without vehicle stands for itself. Filter first: filters hold before the choice."""
    return top_k(df, [F.coalesce(F.col(vehicle).cast("string"), F.col(row_id).cast("string"))], [F.col(listed_at).desc(), F.col(row_id).asc()])


def completeness(fields: list[str], images: str | None = None) -> Column:
    """WIN07: how many fields are not null, plus the number of images."""
    total = reduce(lambda a, b: a + b, [F.col(f).isNotNull().cast("int") for f in fields], F.lit(0))
    return total + F.coalesce(F.greatest(F.size(images), F.lit(0)), F.lit(0)) if images else total


def scored_representative(df: DataFrame, keys: list, score: Column, scraped_at: str, row_id: str) -> DataFrame:
    """WIN06: by completeness, then the latest scrape, then id."""
    return top_k(df.withColumn("__score", score), keys, [F.desc("__score"), F.col(scraped_at).desc(), F.col(row_id).asc()]).drop("__score")


def latest_live(df: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """WIN05: the latest row per key, and only then without tombstones."""
    return top_k(df, [key], order).where(F.col(value).isNotNull())


def first_last(df: DataFrame, key: str, value: str, at: list[str], place: list[str] | None = None) -> DataFrame:
    """WIN02, JON02: first and last value per key in one aggregation; ties in time go by the further columns of ``at``.

    With ``place`` (where a row lies in its files) rows equal in all of ``at`` count as the first of them, at both ends.
    Rows without a value are counted only.
    """
    there = lambda names: F.when(F.col(value).isNotNull(), F.struct(*names))
    when, n = there(at), F.count(F.lit(1))
    if place:
        # by key alone, so that both aggregations share one shuffle
        df = df.repartition(key).groupBy(key, *at).agg(F.min_by(value, there(place)).alias(value), n.alias("__n"))
        n = F.sum("__n")
    return df.groupBy(key).agg(F.min_by(value, when).alias("first_value"), F.max_by(value, when).alias("last_value"), n.alias("n_points"))


def changed(df: DataFrame, keys: list, order: list, values: list[str]) -> DataFrame:
    """WIN13, STM15: rows that differ from the one before in their slot; null equals null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.lag(v).over(w)) for v in values])
    return df.withColumn("__keep", (F.row_number().over(w) == 1) | ~same).where("__keep").drop("__keep")


def changelog(df: DataFrame, key: str, order: list, status: str, features: str) -> DataFrame:
    """WIN14: snapshots without repeats of the one before (features as a set); nothing for keys with fewer than two."""
    rows = df.withColumn("__set", F.array_sort(F.array_distinct(features)))
    kept = changed(rows, [key], order, [status, "__set"])
    return kept.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("__n > 1").drop("__n", "__set")

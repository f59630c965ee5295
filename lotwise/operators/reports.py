"""Reports: reconciliation of an index with its source, pipeline stages, health and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def divergence(expected: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """JON16: (key, field, expected, actual) of fields that differ; null equals null."""
    pair = expected.select(key, F.struct(*fields).alias("e")).join(actual.select(key, F.struct(*fields).alias("a")), key)
    each = F.array(*[F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")), F.struct(F.lit(f).alias("field"), F.col(f"e.{f}").cast("string").alias("expected"), F.col(f"a.{f}").cast("string").alias("actual"))) for f in fields])
    return pair.select(key, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("d")).select(key, "d.*")


def duplicate_groups(df: DataFrame, group: str, key: str) -> DataFrame:
    """AGG26: groups with several rows, as a count and the least and greatest id."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id")).where("n > 1")


def reconcile(expected: DataFrame, actual: DataFrame, key: str, fields: list[str], group: str) -> DataFrame:
    """DOM13: (kind, n): rows that the index lacks, that it should not have, that differ, and groups with several representatives."""
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    parts = [
        count(expected.join(actual, key, "left_anti"), "missing"),
        count(actual.join(expected, key, "left_anti"), "unexpected"),
        count(divergence(expected, actual, key, fields).select(key).distinct(), "diverged"),
        count(duplicate_groups(actual, group, key), "duplicate_groups"),
    ]
    return reduce(DataFrame.unionByName, parts)


def stages(df: DataFrame, source: str, pending: dict[str, Column], at: str) -> DataFrame:
    """DOM21: per source and stage, how many rows wait and when one was last completed; one pass."""
    aggs = [x for n, c in pending.items() for x in (F.count_if(c).alias(f"p_{n}"), F.max(F.when(~c, F.col(at))).alias(f"l_{n}"))]
    rows = df.groupBy(source).agg(*aggs)
    each = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(f"p_{n}").alias("pending"), F.col(f"l_{n}").alias("last")) for n in pending])
    return rows.select(source, F.explode(each).alias("s")).select(source, "s.*")


def stalled(pending: Column, last: Column, now: Column, hours: int = 6) -> Column:
    """STM16: something waits, and nothing was ever completed, or not for so long."""
    return (pending > 0) & (last.isNull() | (last < now - F.make_interval(hours=F.lit(hours))))


def health(df: DataFrame, key: str, down: Column, slow: Column) -> DataFrame:
    """DOM30, AGG39: the worst of each group."""
    worst = F.max(F.when(down, 2).when(slow, 1).otherwise(0))
    return df.groupBy(key).agg(worst.alias("w")).select(key, F.when(F.col("w") == 2, "down").when(F.col("w") == 1, "degraded").otherwise("ok").alias("health"))


def audit(df: DataFrame, source: str, fields: list[str], unknown: str, stale: Column) -> DataFrame:
    """DOM15, AGG19, AGG20: per source: rows, share of each field that is filled, unknown and stale rows."""
    filled = [F.avg(F.when(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != ""), 1.0).otherwise(0.0)).alias(f"{f}_filled") for f in fields]
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("total"), *filled, F.avg((F.col(unknown) == "unknown").cast("double")).alias("unknown_rate"), F.count_if(stale).alias("stale"))


def changes(df: DataFrame, raw: dict[str, Column], source: str) -> DataFrame:
    """DOM19: per source and field, how many values a new rule changes and how many it rejects."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), (~F.col(f).eqNullSafe(c)).alias("changed"), (F.col(f).isNotNull() & c.isNull()).alias("rejected")) for f, c in raw.items()])
    rows = df.select(source, F.explode(each).alias("x")).select(source, "x.*")
    return rows.groupBy(source, "field").agg(F.count_if("changed").alias("affected"), F.count_if("rejected").alias("rejected"))


def claims_from_columns(df: DataFrame, key: str, confidence: dict[str, float]) -> DataFrame:
    """DOM25: one claim for each filled column, with the confidence of its kind."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.lit(c).alias("confidence")) for f, c in confidence.items()])
    return df.select(key, F.explode(each).alias("c")).select(key, "c.*").where("trim(value) <> ''")


def backfill_totals(claims: DataFrame, done: DataFrame, key: list[str], by: list[str], value: str = "value") -> DataFrame:
    """DOM20: what a backfill of claims would write: known values that are not claimed yet, counted per group."""
    fresh = claims.where(F.col(value).isNotNull()).join(done.select(*key).distinct(), key, "left_anti")
    return fresh.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("n_values"))


#: Severities from least to worst.
SEVERITIES = ["ok", "warning", "critical"]


def overview(df: DataFrame, key: str, severity: str, sums: dict[str, str], failed: Column) -> DataFrame:
    """DOM29: per group and over all: rows, failed rows, sums and the worst severity."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity)).cast("int")
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"), *[F.sum(c).alias(n) for n, c in sums.items()], F.max(rank).alias("rank")]
    out = df.groupingSets([[key], []], key).agg(*aggs, F.grouping(key).alias("g"))
    worst = F.get(F.array(*map(F.lit, SEVERITIES)), F.col("rank") - 1).alias("worst")
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col(key)).alias(key), "total", "failed", *sums, worst)


def geocoded(df: DataFrame, city: str, state: str, look_up) -> DataFrame:
    """DOM27: lat, lng and found for each row; the service ``look_up(city, state)`` is asked once for each distinct place, from Spark's tasks."""
    from lotwise.functions.text import city_state

    rows = df.withColumn("__place", city_state(F.col(city), F.col(state)))
    places = rows.select("__place").where("__place is not null").distinct()

    def ask(batches):
        for batch in batches:
            found = [look_up(*p.split("|")) for p in batch["__place"]]
            batch["lat"], batch["lng"] = ([f[i] if f else None for f in found] for i in (0, 1))
            yield batch

    met = rows.join(places.mapInPandas(ask, "__place string, lat double, lng double"), "__place", "left").drop("__place")
    return met.withColumn("found", F.col("lat").isNotNull())


def wide_series(df: DataFrame, key: str, value: str, own: str, kind: str, kinds: list[str]) -> DataFrame:
    """DOM28: one column for each of own and other rows and each kind of value."""
    cols = [F.when((F.col(kind) == k) & (F.col(own) == (side == "own")), F.col(value)).alias(f"{side}_{k}") for k in kinds for side in ("own", "other")]
    return df.select(key, *cols)


def forest(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """DOM23: (id, root, depth, parent) of all runs below some roots; edges are (child, parent)."""
    from lotwise.operators.graph import descendants

    found = descendants(edges, roots)
    up = edges.select(F.col("child").alias("id"), "parent")
    return found.join(up, "id", "left").select("id", "root", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"))

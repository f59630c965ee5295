"""Facet counts, histograms, coverage and other grouped measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.filters import Search


def stacked(df: DataFrame, fields: list[str], arrays: list[str] = (), extra: list[str] = ()) -> DataFrame:
    """(facet, value) of every row in one pass; an array gives each distinct value once; blank, null and 0 are left out."""
    one = [F.array(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"))) for f in fields]
    def each(a: str) -> Column:
        return F.transform(F.coalesce(F.array_distinct(a), F.array().cast("array<string>")), lambda v: F.struct(F.lit(a).alias("facet"), v.alias("value")))

    many = [each(a) for a in arrays]
    rows = df.select(*extra, F.explode(F.concat(*one, *many)).alias("f")).select(*extra, "f.*")
    return rows.where("value is not null and value <> '' and value <> '0'")


def facet_counts(df: DataFrame, fields: list[str], arrays: list[str] = ()) -> DataFrame:
    """AGG11, AGG12: one row per facet and value."""
    return stacked(df, fields, arrays).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def disjunctive_facets(df: DataFrame, s: Search, fields: list[str]) -> DataFrame:
    """AGG15: each facet counted with every filter but its own, in one pass over the rows."""
    per = F.array(*[F.when(s.conditions(without=f), F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"))) for f in fields])
    rows = df.select(F.explode(F.filter(per, lambda x: x.isNotNull())).alias("f")).select("f.*")
    return rows.where("value is not null and value <> ''").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, fields: dict[str, Column], source: str) -> DataFrame:
    """AGG21, AGG22: share of rows where each field is known, per source and over all (source 'global')."""
    flags = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("known")) for n, c in fields.items()])
    rows = df.select(F.col(source).alias("source"), F.explode(flags).alias("f")).select("source", "f.*")
    out = rows.groupingSets([["field", "source"], ["field"]], "field", "source").agg(F.count(F.lit(1)).alias("total"), F.count_if("known").alias("known"), F.grouping("source").alias("g"))
    return out.select("field", F.when(F.col("g") == 1, "global").otherwise(F.col("source")).alias("source"), "total", "known", F.when(F.col("total") > 0, F.col("known") / F.col("total")).otherwise(0.0).alias("rate"))


def coverage_drops(now: DataFrame, before: DataFrame, least: float = 0.1) -> DataFrame:
    """DOM14: rates that fell by ``least`` or more against a baseline."""
    old = before.select("field", "source", F.col("rate").alias("baseline"))
    return now.join(old, ["field", "source"]).withColumn("drop", F.col("baseline") - F.col("rate")).where(F.col("drop") >= least)


def compare_facets(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """SET04: values that only one side has, and counts that differ."""
    e, a = expected.select("facet", "value", F.col("n").alias("expected")), actual.select("facet", "value", F.col("n").alias("actual"))
    kind = F.when(F.col("actual").isNull(), "only_expected").when(F.col("expected").isNull(), "only_actual").when(F.col("expected") != F.col("actual"), "count_mismatch")
    return e.join(a, ["facet", "value"], "full_outer").withColumn("kind", kind).where("kind is not null")


def ghosts(now: DataFrame, before: DataFrame, most: int = 8) -> DataFrame:
    """SET09: current values, and up to ``most`` formerly shown ones with a count of zero."""
    gone = before.join(now, ["facet", "value"], "left_anti").orderBy("facet", "value").limit(most).select("facet", "value", F.lit(0).cast("long").alias("n"))
    return now.unionByName(gone)


def group_examples(df: DataFrame, key: Column, example: str, order: list, most: int = 3) -> DataFrame:
    """AGG27: count and first examples per group; each task keeps ``most`` rows of a group, not all."""
    from lotwise.operators.groups import top_k

    rows = df.withColumn("grp", key)
    few = top_k(rows, ["grp"], order, most, "rank").groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(example).alias("v")))), lambda x: x["v"]).alias("examples"))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).join(few, "grp")


def histogram_quantile(df: DataFrame, keys: list[str], le: str, cumulative: str, q: float) -> DataFrame:
    """AGG37: a quantile from cumulative buckets, interpolated within its bucket."""
    b = F.array_sort(F.collect_list(F.struct(F.col(le).alias("le"), F.col(cumulative).cast("double").alias("c"))))  # as many as buckets
    rows = df.groupBy(*keys).agg(b.alias("b")).withColumn("target", F.element_at("b", -1)["c"] * q)
    at = F.expr("cast(array_position(transform(b, x -> x.c >= target), true) as int)")
    rows = rows.withColumn("i", at)
    lo_le, lo_c = F.when(F.col("i") > 1, F.expr("b[i - 2].le")).otherwise(0.0), F.when(F.col("i") > 1, F.expr("b[i - 2].c")).otherwise(0.0)
    hi_le, hi_c = F.expr("b[i - 1].le"), F.expr("b[i - 1].c")
    return rows.select(*keys, (lo_le + (hi_le - lo_le) * (F.col("target") - lo_c) / (hi_c - lo_c)).alias("quantile"))


def ordered(counts: DataFrame, buckets: bool = False) -> DataFrame:
    """SRT07, SRT08: each facet's values with their rank: by count, or buckets by their lower end. A facet's values are few beside its rows."""
    from lotwise.functions.numeric import bucket_low

    order = [bucket_low(F.col("value"))] if buckets else [F.desc("n"), F.asc("value")]
    return counts.select("facet", "value", "n", F.row_number().over(Window.partitionBy("facet").orderBy(*order)).cast("bigint").alias("rank"))

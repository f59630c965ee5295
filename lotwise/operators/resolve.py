"""Several sources' claims about a field, resolved into one value and its standing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.operators.filters import credible
from lotwise.operators.groups import top_k


def resolve_fields(claims: DataFrame, keys: tuple[str, ...] = ("listing_id", "field"), tie: str = "claim_id") -> DataFrame:
    """DOM06 over WIN08: the latest credible claim of each slot; one authoritative value, else agreement of two, else one, else conflict.

    Every (listing, field) of ``claims`` gets a row. Equal times in a slot go to the claim seen first (least ``tie``).
    """
    live = claims.where(credible() & (F.col("claimed_value") != "unknown"))
    slots = top_k(live, [*keys, "evidence_kind", F.coalesce("source_ref", F.lit(""))], [F.desc("observed_at"), F.asc(tie)])
    main = F.col("evidence_kind") == "authoritative_source"
    value = F.col("claimed_value")
    agg = slots.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(value).alias("values"), F.min(value).alias("one"),
        F.count_distinct(F.when(main, value)).alias("main_values"), F.min(F.when(main, value)).alias("main_one"),
        F.array_sort(F.collect_set(F.when(main, value))).alias("main_set"), F.array_sort(F.collect_set(value)).alias("all_set"),
    )
    state = (
        F.when(F.col("n").isNull(), "unknown").when(F.col("main_values") == 1, "verified").when(F.col("main_values") > 1, "conflicting")
        .when((F.col("values") == 1) & (F.col("n") >= 2), "verified").when(F.col("values") == 1, "source_reported").otherwise("conflicting")
    )
    out = claims.select(*keys).distinct().join(agg, list(keys), "left").withColumn("state", state)
    shown = F.when(F.col("state").isin("unknown", "conflicting"), "unknown").otherwise(F.coalesce("main_one", "one"))
    against = F.when(F.col("state") == "conflicting", F.when(F.col("main_values") > 1, F.col("main_set")).otherwise(F.col("all_set"))).otherwise(F.array().cast("array<string>"))
    return out.select(*keys, shown.alias("value"), "state", against.alias("competing"))


def source_date(candidates: DataFrame, key: str = "page_id", fields: tuple[str, ...] = ("listed", "updated")) -> DataFrame:
    """DOM26: each date on which all proven candidates that have one agree; without proven ones, those of an anonymous candidate that is alone."""
    proven = F.col("kind") == "proven"
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(proven).alias("proven"), F.count_if(F.col("kind") == "anonymous").alias("anonymous")]
    for f in fields:
        mine = F.when(proven, F.col(f))
        aggs += [F.count_distinct(mine).alias(f"{f}_n"), F.min(mine).alias(f"{f}_one"), F.min(f).alias(f"{f}_any")]
    alone = (F.col("proven") == 0) & (F.col("n") == 1) & (F.col("anonymous") == 1)
    each = [F.when((F.col("proven") > 0) & (F.col(f"{f}_n") == 1), F.col(f"{f}_one")).when(alone, F.col(f"{f}_any")).alias(f) for f in fields]
    return candidates.groupBy(key).agg(*aggs).select(key, *each)

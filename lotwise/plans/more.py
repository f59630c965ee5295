"""Further queries: projections, sinks, backfills and latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import numeric, text
from lotwise.operators import groups, merge, projections, reports
from lotwise.plans.registry import query
from lotwise.plans.standins import EVENTS, HISTORY, LISTINGS, PARTS, events, listings, parts, price_history, t


@query("prj02_mask",
    "select c_custkey, case when c_mktsegment <> 'BUILDING' then c_name end dealer_phone, case"
    " when c_mktsegment = 'BUILDING' then 'For Sale By Owner' else c_name end dealer_name from customer"
)
def prj02(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "private").otherwise("dealer").alias("seller_type"), F.col("c_name").alias("dealer_phone"), F.col("c_name").alias("dealer_name"))
    return projections.masked(c).drop("seller_type")


@query("prj03_conflict", f"select event_id, case when k % 3 = 0 then 'unknown' else event_type end shown from {EVENTS}")
def prj03(spark, d):
    return events(spark, d).select("event_id", projections.settled(F.col("event_type"), F.when(F.col("k") % 3 == 0, "conflicting").otherwise("verified")).alias("shown"))


@query("prj04_nested", f"select id, source || '/' || nation place from {LISTINGS}")
def prj04(spark, d):
    n = projections.nested(listings(spark, d).select("id", "source", "nation", "segment"), {"location": ["source", "nation"]})
    return n.select("id", F.concat_ws("/", "location.source", "location.nation").alias("place"))


@query("prj08_evidence", f"select event_id, event_type || '=' || cast(k as varchar) evidence from {EVENTS} where event_type in ('purchase', 'view') and k / 100.0 >= 0.85")
def prj08(spark, d):
    raw = F.to_json(F.array(F.struct(F.col("event_type").alias("field"), F.col("k").cast("string").alias("value"), (F.col("k") / 100.0).alias("confidence"))))
    rows = events(spark, d).select("event_id", F.explode(projections.public_evidence(raw, ["purchase", "view"])).alias("c"))
    return rows.select("event_id", F.concat_ws("=", "c.field", "c.value").alias("evidence"))


@query("prj09_distinct", f"select distinct source, segment from {LISTINGS}")
def prj09(spark, d):
    return listings(spark, d).select("source", "segment").distinct()


@query("flt01_gate", f"select id from {LISTINGS} where status = 'O' and priority <> '5-LOW' and source <> 'ASIA'")
def flt01(spark, d):
    from lotwise.operators.filters import published

    rows = listings(spark, d).select("id", F.when(F.col("status") == "O", "active").alias("status"), F.when(F.col("priority") != "5-LOW", "eligible").alias("publication_status"), F.when(F.col("source") == "ASIA", "disabled").otherwise("ok").alias("source_status"))
    return rows.where(published()).select("id")


@query("flt07_csv", f"select id, array_to_string(words, '+') words from (select id, words[1:2] words from {PARTS}) where len(list_distinct(words)) = 2")
def flt07(spark, d):
    raw = F.concat_ws(",", F.col("words")[0], F.lit(" "), F.concat(F.lit(" "), F.col("words")[1]), F.col("words")[0])
    rows = parts(spark, d).select("id", text.csv_list(raw).alias("w")).where(F.size("w") == 2)
    return rows.select("id", F.array_join("w", "+").alias("words"))


@query("flt09_year_window", f"select id from {LISTINGS} where year(listed_at) between 1995 - 2 and 1995 + 2")
def flt09(spark, d):
    return listings(spark, d).where(F.year("listed_at").between(1993, 1997)).select("id")


@query("flt17_regex", f"select id from {PARTS} where regexp_matches(model, '(?i)\\b(economy|promo)\\b')")
def flt17(spark, d):
    return parts(spark, d).where(F.col("model").rlike(r"(?i)\b(economy|promo)\b")).select("id")


@query("win09_latest_child", f"select part_id, arg_max(ok, (recorded_at, ok, ln)) ok from {HISTORY} where ln <> 1 group by part_id")
def win09(spark, d):
    return price_history(spark, d).where("ln <> 1").groupBy("part_id").agg(F.max_by("ok", F.struct("recorded_at", "ok", "ln")).alias("ok"))


@query("win12_hero", f"select part_id, ok, ln from {HISTORY} where ok % 5 > 0 qualify row_number() over (partition by part_id order by price_cents desc, ln, ok) = 1")
def win12(spark, d):
    pics = price_history(spark, d).select(F.col("part_id").alias("listing_id"), F.col("ok").alias("id"), F.col("ln").alias("position"), F.col("price_cents").alias("score"), F.lit("vehicle_photo").alias("kind"), (F.col("ok") % 5 == 0).alias("placeholder"), F.lit(None).cast("boolean").alias("cross_vehicle"))
    return projections.hero(pics).select(F.col("listing_id").alias("part_id"), F.col("id").alias("ok"), F.col("position").alias("ln"))


@query("win15_latest_version", f"select make, id from {PARTS} qualify row_number() over (partition by make order by size desc, id) = 1")
def win15(spark, d):
    return groups.top_k(parts(spark, d), ["make"], [F.desc("size"), "id"]).select("make", "id")


@query("win17_latest_and_failed",
    f"select user_id, arg_max(event_id, (ts, event_id)) latest, arg_max(event_id, (ts, event_id)) filter (where event_type = 'error') failed"
    f" from {EVENTS} group by user_id"
)
def win17(spark, d):
    at = F.struct("ts", "event_id")
    return events(spark, d).groupBy("user_id").agg(F.max_by("event_id", at).alias("latest"), F.max_by(F.when(F.col("event_type") == "error", F.col("event_id")), F.when(F.col("event_type") == "error", at)).alias("failed"))


@query("agg23_crawl_window",
    f"select user_id, count(*) runs, count(*) filter (where event_type <> 'error') complete,"
    f" round(count(*) filter (where event_type <> 'error') / count(*), 6) rate, cast(sum(k) as bigint) promoted from {EVENTS}"
    f" where ts >= timestamp '2024-01-10' group by user_id"
)
def agg23(spark, d):
    g = events(spark, d).where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("event_type") != "error").alias("complete"), F.sum("k").alias("promoted"))
    return g.withColumn("rate", F.round(F.col("complete") / F.col("runs"), 6))


@query("agg29_backfill_candidates", f"select source, count(*) n from {LISTINGS} where status = 'P' group by source order by n desc, source")
def agg29(spark, d):
    return listings(spark, d).where("status = 'P'").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@query("agg40_backlog", f"select count(*) filter (where status = 'P') pending, count(*) filter (where status = 'O' and priority like '1%') urgent from {LISTINGS}")
def agg40(spark, d):
    return listings(spark, d).agg(F.count_if(F.col("status") == "P").alias("pending"), F.count_if((F.col("status") == "O") & F.startswith("priority", F.lit("1"))).alias("urgent"))


@query("agg45_delivery_report",
    f"select count(*) filter (where event_type <> 'error') passed, count(*) filter (where event_type = 'error') failed,"
    f" cast(floor(avg(k)) as bigint) mean, avg(k) > 40 slow from {EVENTS} where ts >= timestamp '2024-01-15'"
)
def agg45(spark, d):
    e = events(spark, d).where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return e.agg(F.count_if(F.col("event_type") != "error").alias("passed"), F.count_if(F.col("event_type") == "error").alias("failed"), F.floor(F.avg("k")).alias("mean"), (F.avg("k") > 40).alias("slow"))


@query("dom15_audit",
    f"select source, count(*) total, round(avg(case when priority <> '' then 1.0 else 0.0 end), 6) priority_filled, round(avg(case"
    f" when status = 'P' then 1.0 else 0.0 end), 6) unknown_rate, count(*) filter (where listed_at < timestamp '1995-01-01') stale from {LISTINGS}"
    f" group by source"
)
def dom15(spark, d):
    rows = listings(spark, d).withColumn("known", F.when(F.col("status") == "P", "unknown").otherwise(F.col("status")))
    out = reports.audit(rows, "source", ["priority"], "known", F.col("listed_at") < F.lit("1995-01-01").cast("timestamp_ntz"))
    return out.withColumns({"priority_filled": F.round("priority_filled", 6), "unknown_rate": F.round("unknown_rate", 6)})


@query("dom19_backfill_report", f"select size % 3 source, 'model' field, count(*) filter (where model <> upper(model)) affected, 0::bigint rejected from {PARTS} group by 1")
def dom19(spark, d):
    return reports.changes(parts(spark, d).select((F.col("size") % 3).alias("source"), "model"), {"model": F.upper("model")}, "source")


@query("dom20_claims_backfill", f"""with c as (select id, source, 'status' field, status as value from {LISTINGS} where status <> 'P' union all select id, source, 'segment', segment from {LISTINGS} where segment <> 'BUILDING'),
 done as (select distinct l_orderkey id, case when l_linenumber % 2 = 0 then 'status' else 'segment' end field from lineitem where l_returnflag = 'A')
 select source, field, count(*) n, count(distinct value) n_values from c where (id, field) not in (select (id, field) from done) group by 1, 2""")
def dom20(spark, d):
    """Totals of claims that a backfill would write: known values of each field, less those claimed already."""
    from lotwise.operators.reports import backfill_totals

    known = F.expr("stack(2, 'status', if(status <> 'P', status, null), 'segment', if(segment <> 'BUILDING', segment, null)) as (field, value)")
    claims = listings(spark, d).select("id", "source", known)
    field = F.when(F.col("l_linenumber") % 2 == 0, "status").otherwise("segment")
    done = t(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"), field.alias("field")).distinct()
    return backfill_totals(claims, done, ["id", "field"], ["source", "field"])


@query("dom24_detail_merge", f"select id, case id % 3 when 0 then model when 1 then null else title end as value from {PARTS}")
def dom24(spark, d):
    kind = F.when(F.col("id") % 3 == 0, "missing").when(F.col("id") % 3 == 1, "authoritative_empty").otherwise("value")
    return parts(spark, d).select("id", merge.by_evidence(kind, F.col("model"), F.col("title")).alias("value"))


@query("dom25_claims", f"select id, 'make' field, make as value, 0.9 confidence from {PARTS} union all select id, 'size', cast(size as varchar), 0.6 from {PARTS}")
def dom25(spark, d):
    return reports.claims_from_columns(parts(spark, d), "id", {"make": 0.9, "size": 0.6})


@query("dom29_overview", f"""select source, count(*) total, count(*) filter (where status = 'P') failed, cast(sum(price_cents) as bigint) volume,
 case max(case status when 'P' then 3 when 'O' then 2 else 1 end) when 3 then 'critical' when 2 then 'warning' else 'ok' end worst from {LISTINGS} group by source
 union all select 'all', count(*), count(*) filter (where status = 'P'), cast(sum(price_cents) as bigint), case max(case status when 'P' then 3 when 'O' then 2 else 1 end) when 3 then 'critical' when 2 then 'warning' else 'ok' end from {LISTINGS}""")
def dom29(spark, d):
    from lotwise.operators.reports import overview

    severity = F.when(F.col("status") == "P", "critical").when(F.col("status") == "O", "warning").otherwise("ok")
    rows = listings(spark, d).withColumn("severity", severity)
    return overview(rows, "source", "severity", {"volume": "price_cents"}, F.col("status") == "P")


@query("snk02_history_on_change", "select o_orderkey, 'X' status from orders where o_orderkey % 7 = 0 and o_orderstatus <> 'X'")
def snk02(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = o.withColumn("status", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("status")))
    return merge.upsert(o, new, ["o_orderkey"], ["status"]).where("outcome = 'updated'").select("o_orderkey", "status")


@query("snk11_event_sourced",
    f"select k as key, event_id from {EVENTS} qualify row_number() over (partition by k order by ts desc, event_id desc) = 1"
    f" and event_type <> 'error'"
)
def snk11(spark, d):
    rows = events(spark, d).select(F.col("k").alias("key"), "ts", "event_id", F.when(F.col("event_type") != "error", F.col("event_id")).alias("value"))
    return groups.latest_live(rows, "key", [F.desc("ts"), F.desc("event_id")], "value").select("key", "event_id")


@query("stm07_sticky", f"select id, case when size % 4 = 0 then model else title end kept from {PARTS}")
def stm07(spark, d):
    new = F.when(F.col("size") % 4 == 0, F.get(F.array(F.lit("unknown"), F.lit(" "), F.lit(None).cast("string")), (F.col("id") % 3).cast("int"))).otherwise(F.col("title"))
    return parts(spark, d).select("id", merge.sticky(F.col("model"), new).alias("kept"))


@query("stm16_stalled",
    f"select source, count(*) filter (where status = 'P') > 0"
    f" and max(listed_at) filter (where status <> 'P') < timestamp '1998-08-02 06:00:00' - interval 6 hour stalled from {LISTINGS} group by source"
)
def stm16(spark, d):
    s = reports.stages(listings(spark, d), "source", {"detail": F.col("status") == "P"}, "listed_at")
    return s.select("source", reports.stalled(F.col("pending"), F.col("last"), F.lit("1998-08-02 06:00:00").cast("timestamp_ntz")).alias("stalled"))


@query("str31_normalised", "select c_custkey, nullif(lower(trim(c_name)), '') n from customer")
def str31(spark, d):
    return t(spark, d, "customer").select("c_custkey", text.normalized(F.concat(F.lit(" "), "c_name", F.lit("  "))).alias("n"))


@query("str40_slug_vin", f"select id, '1HGCM82633A' || lpad(cast(id % 1000000 as varchar), 6, '0') vin from {PARTS}")
def str40(spark, d):
    url = F.concat(F.lit("https://x.example/van/1hgcm82633a"), F.lpad((F.col("id") % 1_000_000).cast("string"), 6, "0"), F.lit("/"))
    return parts(spark, d).select("id", numeric.vin_from_slug(url)["vin"].alias("vin"))


@query("str41_condition", f"select id, case size % 4 when 0 then 'certified' when 1 then 'new' when 2 then 'used' end c from {PARTS}")
def str41(spark, d):
    from lotwise.functions.canonical import condition

    raw = F.get(F.array(*map(F.lit, ["Certified Pre-Owned", "Brand New", "Pre-owned", "salvage"])), F.col("size") % 4)
    return parts(spark, d).select("id", condition(raw).alias("c"))


@query("str42_substring_features", f"select id, case size % 2 when 0 then 'has_lift' else 'lowered_floor,power_ramp' end f from {PARTS}")
def str42(spark, d):
    from lotwise.functions.canonical import features_by_substring

    raw = F.when(F.col("size") % 2 == 0, "a forklift").otherwise("Power RAMP and LOWERED FLOOR")
    return parts(spark, d).select("id", F.array_join(features_by_substring(raw), ",").alias("f"))


@query("mth06_rounding", f"select id, round(price_cents / 300.0 + 0.0001, 2) r from {PARTS}")
def mth06(spark, d):
    return parts(spark, d).select("id", F.round(F.col("price_cents") / 300.0 + 0.0001, 2).alias("r"))


@query("dat01_trunc", f"select id, date_trunc('week', listed_at) w, date_trunc('month', listed_at) m from {LISTINGS}")
def dat01(spark, d):
    return listings(spark, d).select("id", F.date_trunc("week", "listed_at").alias("w"), F.date_trunc("month", "listed_at").alias("m"))


@query("dat08_nanos", f"select event_id, date_trunc('millisecond', ts) ms from {EVENTS}")
def dat08(spark, d):
    return events(spark, d).select("event_id", numeric.nanos_to_timestamp(F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ms"))

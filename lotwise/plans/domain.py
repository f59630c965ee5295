"""Queries of several stages: validation, resolution, identity, pictures, reports and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import facets, groups, identity, joins, merge, quality, reports, resolve
from lotwise.plans.registry import query
from lotwise.plans.standins import EVENTS, LISTINGS, PARTS, PICTURES, events, listings, parts, pictures, t

CARD = f"""(select id, size, case when size % 10 = 0 then 'a b' else 'k' || cast(id as varchar) end source_record_key, case when size = 1 then 1800 else 2000 + size % 25 end "year", case when size % 7 = 0 then -5 else price_cents end price_cents,
 case when size % 3 = 0 then 'new' else 'used' end "condition", size * 1000 mileage from {PARTS})"""


def _cards(spark, d):
    """Parts as listings, with faults by size."""
    null = lambda k: F.lit(None).cast(k)
    s = F.col("size")
    return parts(spark, d).select(
        "id", "size", "make", "model", F.when(s % 10 == 0, "a b").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("source_record_key"), F.when(s == 1, 1800).otherwise(2000 + s % 25).alias("year"),
        F.when(s % 7 == 0, F.lit(-5)).otherwise(F.col("price_cents")).alias("price_cents"), F.when(s % 3 == 0, "new").otherwise("used").alias("condition"), (s * 1000).alias("mileage"),
        null("string").alias("external_id"), null("string").alias("stock_number"), null("string").alias("color"), null("string").alias("conversion_manufacturer"), F.lit("Austin").alias("city"), F.lit("TX").alias("state"), F.lit("78701").alias("zip"),
        null("double").alias("floor_lowering_inches"), null("int").alias("wheelchair_capacity"), F.array(F.lit("https://x.example/1.jpg")).alias("images"), F.lit("https://x.example/v").alias("source_url"), null("string").alias("buyer_url"), null("string").alias("vin"),
        F.lit("dealer").alias("seller_type"), F.lit("Dealer").alias("dealer_name"), F.lit("active").alias("sale_status"), null("timestamp").alias("sold_at"), F.lit("").alias("description"),
        F.when(s % 5 == 0, "unknown").otherwise("rear_entry").alias("conversion_type"), F.lit("unknown").alias("ramp_type"), F.array(F.lit("transfer_seat"), F.lit("power_ramp")).alias("wav_features"),
        F.lit("2024-01-02").cast("timestamp").alias("detail_scraped_at"), null("timestamp").alias("detail_stale_at"), F.lit("2024-01-03").cast("timestamp").alias("quality_checked_at"), null("string").alias("vehicle_model_id"),
    )


RULES = f"""(select id, array_to_string(list_filter([case when source_record_key like '% %' then 'contains_space' end, case when "year" not between 1990 and 2028 then 'implausible_year' end,
 case when price_cents < 0 then 'negative_value' end, case when price_cents > 0 and price_cents not between 50000 and 50000000 then 'implausible_value' end,
 case when "condition" = 'new' and mileage > 500 then 'new_with_high_mileage' end, case when size % 5 = 0 then 'unsupported_accessibility_claim' end], lambda x: x is not null), ',') codes from {CARD})"""


@query("dom01_validate", f"select * from {RULES}")
def dom01(spark, d):
    return _cards(spark, d).select("id", F.array_join(F.transform(quality.validate(), lambda i: i["rule"]), ",").alias("codes"))


@query("dom03_decide",
    f"select id, case when regexp_matches(codes, 'contains_space|implausible_year|negative_value|unsupported') then 'quarantined'"
    f" else 'eligible' end status from {RULES}"
)
def dom03(spark, d):
    return _cards(spark, d).select("id", quality.publication(quality.validate())["status"].alias("status"))


@query("dom05_resolve_rows",
    f"select id, not regexp_matches(codes, 'contains_space|implausible_year|negative_value|unsupported') and id not in (select id from {CARD}"
    f" where size % 5 = 0) shown from {RULES}"
)
def dom05(spark, d):
    return quality.resolve_listings(_cards(spark, d)).select("id", "shown")


@query("dom02_mismatch",
    f"select id, case when size % 4 = 0 then 'nhtsa_model_mismatch' else '' end || case when size % 6 = 0 then 'nhtsa_year_mismatch'"
    f" else '' end codes from {PARTS}"
)
def dom02(spark, d):
    s = F.col("size")
    issues = quality.decoded_mismatch((F.col("make"), F.upper("make")), (F.col("model"), F.when(s % 4 == 0, "other").otherwise(F.col("model"))), (s, F.when(s % 6 == 0, s + 2).otherwise(s + 1)))
    return parts(spark, d).select("id", F.array_join(F.transform(issues, lambda i: i["rule"]), "").alias("codes"))


@query("agg18_quality_summary",
    f"select count(*) total, count(*) filter (where codes <> '') with_issues,"
    f" count(*) filter (where regexp_matches(codes, 'contains_space|implausible_year|negative_value')) with_errors from {RULES}"
)
def agg18(spark, d):
    return quality.summary(_cards(spark, d).withColumn("issues", quality.validate())).select("total", "with_issues", "with_errors")


CLAIMS = (
    f"(select event_id claim_id, user_id listing_id, case event_type when 'purchase' then 'authoritative_source' when 'error' then 'generic_text'"
    f" when 'view' then 'photo' else 'specific_text' end kind, 's' || cast(k % 2 as varchar) ref, case k % 3 when 0 then 'side_entry'"
    f" when 1 then 'rear_entry' else 'unknown' end v, ts, k / 100.0 confidence from {EVENTS})"
)


@query("dom06_resolve", f"""with c as (select * from {CLAIMS} where kind <> 'generic_text' and (kind <> 'photo' or confidence >= 0.7) and v <> 'unknown' qualify row_number() over (partition by listing_id, kind, ref order by ts desc, claim_id) = 1),
 g as (select listing_id, count(*) n, count(distinct v) dv, min(v) v, count(distinct v) filter (where kind = 'authoritative_source') da, min(v) filter (where kind = 'authoritative_source') a from c group by 1)
 select i.listing_id, case when n is null then 'unknown' when da = 1 then 'verified' when da > 1 then 'conflicting' when dv = 1 and n >= 2 then 'verified' when dv = 1 then 'source_reported' else 'conflicting' end state,
 case when n is null or da > 1 or (da = 0 and dv > 1) then 'unknown' else coalesce(a, v) end as value from (select distinct listing_id from {CLAIMS}) i left join g using (listing_id)""")
def dom06(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "authoritative_source").when(F.col("event_type") == "error", "generic_text").when(F.col("event_type") == "view", "photo").otherwise("specific_text")
    value = F.when(F.col("k") % 3 == 0, "side_entry").when(F.col("k") % 3 == 1, "rear_entry").otherwise("unknown")
    claims = events(spark, d).select(F.col("event_id").alias("claim_id"), F.col("user_id").alias("listing_id"), F.lit("conversion").alias("field"), kind.alias("evidence_kind"), F.concat(F.lit("s"), (F.col("k") % 2).cast("string")).alias("source_ref"), value.alias("claimed_value"), F.col("ts").alias("observed_at"), (F.col("k") / 100.0).alias("confidence"), F.lit(True).alias("eligible"))
    return resolve.resolve_fields(claims).select("listing_id", "state", "value")


@query("dom08_pair_score", """select a.c_custkey a, b.c_custkey b, cast(15 + 10 + 7 + case when abs(a.c_acctbal - b.c_acctbal) * 10 <= 1500 then 15 else -5 end + case when a.c_custkey % 7 = b.c_custkey % 7 then 15 else 0 end as integer) score
 from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_mktsegment = b.c_mktsegment and a.c_custkey < b.c_custkey and abs(a.c_acctbal - b.c_acctbal) <= 400""")
def dom08(spark, d):
    c = t(spark, d, "customer")
    null = lambda k: F.lit(None).cast(k)
    rows = c.select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("make"), F.lit("m").alias("model"), F.lit(2020).alias("year"), F.lit("LE").alias("trim"), null("string").alias("vin"), (F.col("c_acctbal") * 10).alias("mileage"), null("bigint").alias("price_cents"),
        null("string").alias("zip"), F.col("c_nationkey").cast("string").alias("city"), F.lit("TX").alias("state"), null("string").alias("dealer_profile_id"), null("string").alias("dealer_website"), (F.col("c_custkey") % 7).cast("string").alias("dealer_name"),
        null("string").alias("stock_number"), null("string").alias("source_url"), null("array<string>").alias("image_hashes"), null("boolean").alias("conflicting_image_hash"), "c_nationkey", "c_acctbal", F.col("c_mktsegment").alias("segment"),
    )
    pairs = joins.blocked_pairs(identity.comparable(rows), ["segment", "c_nationkey"], "id", near=("c_acctbal", 400))
    return identity.score_pairs(pairs, F.abs(F.col("a_c_acctbal") - F.col("b_c_acctbal")) * 10).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "score")


@query("agg30_pair_rollup", """select case when s >= 50 then 'candidate' else 'no_match' end decision, count(*) n from (select 15 + 10 + 7 + case when abs(a.c_acctbal - b.c_acctbal) * 10 <= 1500 then 15 else -5 end + case when a.c_custkey % 7 = b.c_custkey % 7 then 15 else 0 end s
 from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_mktsegment = b.c_mktsegment and a.c_custkey < b.c_custkey and abs(a.c_acctbal - b.c_acctbal) <= 400) group by 1""")
def agg30(spark, d):
    return dom08(spark, d).groupBy(F.when(F.col("score") >= 50, "candidate").otherwise("no_match").alias("decision")).agg(F.count(F.lit(1)).alias("n"))


VIN_SUM = "8*1+7*8+6*7+5*3+4*4+3*8+2*2+10*6+0+9*3+8*1+7*0+6*0+5*0+4*(id % 1000 // 100)+3*(id % 100 // 10)+2*(id % 10)"


@query("dom07_vin_dedupe", f"""with v as (select id, size, '1HGCM82633A' || lpad(cast(id % 80 as varchar), 6, '0') vin from (select id % 80 k, * from {PARTS})),
 good as (select '1HGCM82633A' || lpad(cast(id as varchar), 6, '0') g from (select unnest(range(0, 80)) id) where ({VIN_SUM}) % 11 = 3)
 select id, count(*) over (partition by vin) group_size, first_value(id) over (partition by vin order by (case when size > 25 then 1 else 0 end) desc, id) primary_id from v where vin in (select g from good) qualify count(*) over (partition by vin) > 1""")
def dom07(spark, d):
    rows = parts(spark, d).withColumns({"vin": F.concat(F.lit("1HGCM82633A"), F.lpad((F.col("id") % 80).cast("string"), 6, "0")), "big": F.when(F.col("size") > 25, 1)})
    return identity.vin_groups(rows, groups.completeness(["big"])).select("id", F.col("group_size"), "primary_id")


@query("dom09_components",
    "with recursive e as (select a.c_custkey a, b.c_custkey b from customer a join customer b on a.c_nationkey = b.c_nationkey"
    " and a.c_mktsegment = b.c_mktsegment and a.c_custkey <> b.c_custkey and abs(a.c_acctbal - b.c_acctbal) <= 60), r as (select a id, a comp"
    " from e union select e.b, r.comp from r join e on e.a = r.id) select id, min(comp) component from r group by id"
)
def dom09(spark, d):
    from lotwise.operators.graph import connected

    links = joins.near_links(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", ("c_acctbal", 60))
    return connected(links, "a", "b")


@query("dom11_exact_clusters",
    "select min(vec_id) as \"cluster\", count(*) images from (select *, vec_id % 50 h from embeddings where vec_id % 7 > 0) group by h"
    " having count(*) > 1"
)
def dom11(spark, d):
    p = pictures(spark, d).where("id % 7 > 0").select("id", (F.col("id") % 50).cast("string").alias("exact_hash"), F.lit(None).cast("bigint").alias("phash"))
    return identity.image_clusters(p).where("kind = 'exact'").groupBy("cluster").agg(F.count(F.lit(1)).alias("images"))


@query("dom11_near_clusters")
def dom11_near(spark, d):
    """Greedy near-duplicate clusters of pictures and edited copies; they depend on the order of ids, so tests compare them with a loop."""
    from lotwise.plans.joined import _near

    return identity.image_clusters(_near(spark, d).withColumn("exact_hash", F.lit(None).cast("string")))


@query("dom13_reconciliation", f"""with e as (select * from {LISTINGS}), a as (select * replace (case when id % 101 = 0 then 'X' else status end as status) from {LISTINGS} where id % 50 > 0)
 select 'missing' kind, count(*) n from e where id not in (select id from a) union all select 'unexpected', count(*) from a where id not in (select id from e) union all select 'diverged', count(*) from e join a using (id) where e.status <> a.status union all select 'duplicate_groups', count(*) from (select vehicle_id from a group by 1 having count(*) > 1)""")
def dom13(spark, d):
    e = listings(spark, d)
    a = e.where("id % 50 > 0").withColumn("status", F.when(F.col("id") % 101 == 0, "X").otherwise(F.col("status")))
    return reports.reconcile(e, a, "id", ["status", "source", "segment"], "vehicle_id")


@query("dom16_attention",
    f"select 'stale_source' condition, source subject from {LISTINGS} group by source having max(listed_at) < timestamp '1998-08-02' union all"
    f" select 'error_rate', cast(user_id as varchar) from {EVENTS} group by user_id having count(*) >= 5"
    f" and count(*) filter (where event_type = 'error') / count(*) >= 0.2"
)
def dom16(spark, d):
    stale = listings(spark, d).groupBy("source").agg(F.max("listed_at").alias("last")).where(F.col("last") < F.lit("1998-08-02").cast("timestamp_ntz")).select(F.lit("stale_source").alias("condition"), F.col("source").alias("subject"))
    rate = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e")).where(quality.systemic(F.col("e"), F.col("n"))).select(F.lit("error_rate").alias("condition"), F.col("user_id").cast("string").alias("subject"))
    return stale.unionByName(rate)


@query("dom21_stages",
    f"select source, 'detail' stage, count(*) filter (where status = 'O') pending, max(listed_at) filter (where status <> 'O') last from {LISTINGS}"
    f" group by source union all select source, 'validate', count(*) filter (where priority like '1%'),"
    f" max(listed_at) filter (where priority not like '1%') from {LISTINGS} group by source"
)
def dom21(spark, d):
    return reports.stages(listings(spark, d), "source", {"detail": F.col("status") == "O", "validate": F.startswith("priority", F.lit("1"))}, "listed_at")


@query("dom22_conflicts",
    f"with s as (select id, 'status' field, status as value, source ref, listed_at from {LISTINGS} union all select id, 'priority', priority,"
    f" segment, listed_at from {LISTINGS}) select field, ref, count(distinct value) n_values, count(*) n from s group by 1, 2"
    f" having count(distinct value) > 1"
)
def dom22(spark, d):
    long = listings(spark, d).select("id", F.expr("stack(2, 'status', status, source, 'priority', priority, segment) as (field, value, ref)"))
    return long.groupBy("field", "ref").agg(F.count_distinct("value").alias("n_values"), F.count(F.lit(1)).alias("n")).where("n_values > 1")


@query("dom26_source_date", f"""with c as (select user_id * 31 + day(ts) page_id, case event_type when 'purchase' then 'proven' when 'error' then 'anonymous' else 'unmatched' end kind,
 cast(k % 4 as varchar) listed, case when k % 3 > 0 then cast(k % 5 as varchar) end updated from {EVENTS}),
 g as (select page_id, count(*) n, count(*) filter (where kind = 'proven') p, count(*) filter (where kind = 'anonymous') a,
 count(distinct listed) filter (where kind = 'proven') dl, min(listed) filter (where kind = 'proven') l, count(distinct updated) filter (where kind = 'proven') du, min(updated) filter (where kind = 'proven') u,
 min(listed) al, min(updated) au from c group by 1)
 select page_id, case when p > 0 then case when dl = 1 then l end when n = 1 and a = 1 then al end listed, case when p > 0 then case when du = 1 then u end when n = 1 and a = 1 then au end updated from g""")
def dom26(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "proven").when(F.col("event_type") == "error", "anonymous").otherwise("unmatched")
    page = (F.col("user_id") * 31 + F.dayofmonth("ts")).alias("page_id")
    updated = F.when(F.col("k") % 3 > 0, (F.col("k") % 5).cast("string"))
    return resolve.source_date(events(spark, d).select(page, kind.alias("kind"), (F.col("k") % 4).cast("string").alias("listed"), updated.alias("updated")))


@query("dom27_geocode", """select s_suppkey, case when n_nationkey % 6 > 0 then 20.0 + n_nationkey end lat, case when n_nationkey % 6 > 0 then -100.0 + n_nationkey end lng, n_nationkey % 6 > 0 found from supplier join nation on n_nationkey = s_nationkey""")
def dom27(spark, d):
    """One lookup for each distinct place, in batches of a task, fanned out to all its listings; an unknown place has no coordinates."""
    from lotwise.operators.reports import geocoded
    from lotwise.plans.standins import regions

    known = {f"nation_{k}": (20.0 + k, -100.0 + k) for k in range(25) if k % 6}  # stands in for the service
    s = t(spark, d, "supplier").join(F.broadcast(regions(spark, d)), F.col("s_nationkey") == F.col("nation_key"))
    rows = s.select("s_suppkey", F.concat(F.lit(" Nation_"), F.col("nation_key").cast("string")).alias("city"), F.lit("tx").alias("state"))
    return geocoded(rows, "city", "state", lambda city, state: known.get(city)).select("s_suppkey", "lat", "lng", "found")


@query("dom28_wide_series", f"""select event_id, case when user_id % 10 = 1 and event_type <> 'view' then value end own_price, case when user_id % 10 <> 1 and event_type <> 'view' then value end other_price,
 case when user_id % 10 = 1 and event_type = 'view' then value end own_mileage, case when user_id % 10 <> 1 and event_type = 'view' then value end other_mileage from {EVENTS}""")
def dom28(spark, d):
    from lotwise.operators.reports import wide_series

    rows = events(spark, d).select("event_id", "value", (F.col("user_id") % 10 == 1).alias("own"), F.when(F.col("event_type") == "view", "mileage").otherwise("price").alias("kind"))
    return wide_series(rows, "event_id", "value", "own", "kind", ["price", "mileage"])


@query("dom30_health",
    f"select seg, case when max(case when price_cents > 49950000 then 2 when price_cents > 49800000 then 1 else 0 end) = 2 then 'down' when max(case"
    f" when price_cents > 49950000 then 2 when price_cents > 49800000 then 1 else 0 end) = 1 then 'degraded' else 'ok' end health"
    f" from (select source || segment || cast(id % 7 as varchar) seg, price_cents from {LISTINGS}) group by seg"
)
def dom30(spark, d):
    rows = listings(spark, d).withColumn("seg", F.concat("source", "segment", (F.col("id") % 7).cast("string")))
    return reports.health(rows, "seg", F.col("price_cents") > 49_950_000, F.col("price_cents") > 49_800_000)


@query("snk01_upsert",
    "with o as (select o_orderkey k, o_orderstatus s, o_orderpriority p from orders where o_orderkey % 10 <> 3), n as (select o_orderkey k, case"
    " when o_orderkey % 7 = 0 then 'X' else o_orderstatus end s, o_orderpriority p from orders where o_orderkey % 10 <> 5) select coalesce(o.k,"
    " n.k) k, case when o.k is null then 'created' when n.k is null then 'kept' when o.s is distinct from n.s or o.p is distinct"
    " from n.p then 'updated' else 'unchanged' end outcome, case when n.k is not null then n.s else o.s end s from o full join n on o.k = n.k"
)
def snk01(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    new = o.where("k % 10 <> 5").withColumn("s", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("s")))
    return merge.upsert(o.where("k % 10 <> 3"), new, ["k"], ["s", "p"]).select("k", "outcome", "s")


@query("snk06_idempotent",
    f"select k * 1000 + user_id as key, min(event_id) event_id from {EVENTS} where k * 1000 + user_id not in (select k * 1000 + user_id"
    f" from {EVENTS} where event_type = 'purchase') group by 1"
)
def snk06(spark, d):
    e = events(spark, d).withColumn("key", F.col("k") * 1000 + F.col("user_id"))
    return merge.append_new(e.where("event_type = 'purchase'"), e, ["key"], ["event_id"]).select("key", "event_id")


@query("snk07_problem_counts",
    f"select event_type fingerprint, min(ts) first_seen, max(ts) last_seen, count(distinct date_trunc('day', ts)) occurrences from {EVENTS}"
    f" group by 1"
)
def snk07(spark, d):
    seen = events(spark, d).select(F.col("event_type").alias("fingerprint"), F.col("ts").alias("seen_at"), F.date_trunc("day", "ts").alias("batch_id"))
    none = spark.createDataFrame([], "fingerprint string, first_seen timestamp_ntz, last_seen timestamp_ntz, occurrences bigint")
    return merge.count_problems(none, seen)


@query("snk08_fold", f"select id old_id, min(id) over (partition by lower(model)) kept_id from {PARTS}")
def snk08(spark, d):
    return merge.fold_duplicates(parts(spark, d), F.lower("model"), "id")


@query("snk09_retention", f"select event_id from {EVENTS} where ts >= timestamp '2024-01-20' or event_type = 'error'")
def snk09(spark, d):
    return merge.retained(events(spark, d), "ts", F.lit("2024-01-30").cast("timestamp_ntz"), 10, F.col("event_type") == "error").select("event_id")


@query("snk10_anonymise", "select c_custkey, case when c_acctbal >= 0 then c_name end c_name, c_mktsegment from customer")
def snk10(spark, d):
    return merge.anonymised(t(spark, d, "customer"), F.col("c_acctbal") < 0, ["c_name"]).select("c_custkey", "c_name", "c_mktsegment")


@query("mth12_rank_fusion",
    f"with s as (select id, size / 50.0 k from {PARTS}), c as (select l_partkey id, count(*) n from lineitem group by 1), f as (select s.id,"
    f" 0.6 * k + 0.4 * coalesce(n, 0) / (select max(n) from c) score from s left join c using (id)) select id, round(score, 6) score from f"
    f" order by score desc, id limit 100"
)
def mth12(spark, d):
    n = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    top = n.agg(F.max("n").alias("most"))
    rows = parts(spark, d).select("id", (F.col("size") / 50.0).alias("k")).join(n, "id", "left").join(F.broadcast(top), F.lit(True))
    score = 0.6 * F.col("k") + 0.4 * F.coalesce("n", F.lit(0)) / F.col("most")
    return rows.select("id", score.alias("s")).orderBy(F.desc("s"), "id").limit(100).select("id", F.round("s", 6).alias("score"))

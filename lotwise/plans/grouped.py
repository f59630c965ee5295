"""Queries on aggregates, facets, histograms and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions.numeric import bucket, bucket_low, price_band
from lotwise.functions.canonical import color_family
from lotwise.operators import facets, market, resampling
from lotwise.operators.filters import Search
from lotwise.operators.groups import representative, top_k
from lotwise.plans.registry import query
from lotwise.plans.standins import EVENTS, HISTORY, LISTINGS, PARTS, events, listings, parts, price_history, t

REPS = f"(select * from {LISTINGS} qualify row_number() over (partition by vehicle_id order by listed_at desc, id) = 1)"


@query("agg01_popular", f"select source as value, count(*) n from {REPS} group by source order by n desc, source limit 10")
def agg01(spark, d):
    return market.popular(listings(spark, d), "source")


@query("agg02_count_distinct",
    f"select source, count(distinct coalesce(case when vehicle_id % 4 > 0 then vehicle_id end, -id)) vehicles, count(*) n from {LISTINGS}"
    f" group by source"
)
def agg02(spark, d):
    key = F.coalesce(F.when(F.col("vehicle_id") % 4 > 0, F.col("vehicle_id")), -F.col("id"))
    return listings(spark, d).groupBy("source").agg(F.count_distinct(key).alias("vehicles"), F.count(F.lit(1)).alias("n"))


@query("agg03_drop_rate",
    f"with h as (select part_id, arg_min(price_cents, (recorded_at, ok, ln)) f, arg_max(price_cents, (recorded_at, ok, ln)) l from {HISTORY}"
    f" group by part_id) select count(distinct part_id) total, count(distinct case when f > l then part_id end) dropped, round(count(distinct case"
    f" when f > l then part_id end) / count(distinct part_id), 2) rate from h"
)
def agg03(spark, d):
    from lotwise.operators.groups import first_last

    h = first_last(price_history(spark, d), "part_id", "price_cents", ["recorded_at", "ok", "ln"])
    dropped = F.count_distinct(F.when(F.col("first_value") > F.col("last_value"), F.col("part_id")))
    return h.agg(F.count_distinct("part_id").alias("total"), dropped.alias("dropped")).withColumn("rate", F.round(F.col("dropped") / F.col("total"), 2))


@query("agg05_filtered_percentile",
    f"select source, round(quantile_cont(price_cents / 100.0, 0.5) filter (where status = 'O'), 3) open_median,"
    f" round(quantile_cont(price_cents / 100.0, 0.9), 3) p90 from {LISTINGS} group by source"
)
def agg05(spark, d):
    price = F.col("price_cents") / 100.0
    found = market.percentiles_of(listings(spark, d), ["source"], {"open_median": (F.when(F.col("status") == "O", price), 0.5), "p90": (price, 0.9)})
    return found.select("source", F.round("open_median", 3).alias("open_median"), F.round("p90", 3).alias("p90"))


@query("agg06_count_filter", f"select source, count(*) filter (where status = 'F') finished, count(*) n from {LISTINGS} group by source")
def agg06(spark, d):
    return listings(spark, d).groupBy("source").agg(F.count_if(F.col("status") == "F").alias("finished"), F.count(F.lit(1)).alias("n"))


@query("agg07_average_days", f"select source, round(avg(date_diff('second', timestamp '1992-01-01', listed_at) / 86400.0), 4) n_days from {LISTINGS} group by source")
def agg07(spark, d):
    from lotwise.functions.numeric import days_between

    return listings(spark, d).groupBy("source").agg(F.round(F.avg(days_between(F.col("listed_at"), F.lit("1992-01-01").cast("timestamp"))), 4).alias("n_days"))


@query("agg08_max_per_source", f"select source, max(listed_at) newest, max(price_cents) dearest from {LISTINGS} group by source")
def agg08(spark, d):
    return listings(spark, d).groupBy("source").agg(F.max("listed_at").alias("newest"), F.max("price_cents").alias("dearest"))


@query("agg09_triage_having",
    f"select user_id, array_to_string(list_sort(list_distinct(array_agg(event_type))), ',') kinds, max(ts) newest, count(*) n from {EVENTS}"
    f" where event_type in ('error', 'purchase') group by user_id having count(*) >= 3 order by n desc, user_id limit 50"
)
def agg09(spark, d):
    g = events(spark, d).where("event_type in ('error', 'purchase')").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.max("ts").alias("newest"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 3").orderBy(F.desc("n"), "user_id").limit(50)


@query("agg10_count_of_groups", f"select count(*) n from (select user_id from {EVENTS} group by user_id having count(*) >= 60)")
def agg10(spark, d):
    return events(spark, d).groupBy("user_id").count().where("count >= 60").agg(F.count(F.lit(1)).alias("n"))


FACETS = (
    f"select 'source' facet, source as value, count(*) n from {LISTINGS} group by 2 union all select 'segment', segment, count(*) from {LISTINGS}"
    f" group by 2 union all select 'status', status, count(*) from {LISTINGS} group by 2 union all select 'priority', priority, count(*)"
    f" from {LISTINGS} group by 2"
)


@query("agg11_facets", FACETS)
def agg11(spark, d):
    return facets.facet_counts(listings(spark, d), ["source", "segment", "status", "priority"])


@query("agg12_multivalue_facet", f"select 'words' facet, w as value, count(*) n from (select id, unnest(list_distinct(words)) w from {PARTS}) where w <> '' group by w")
def agg12(spark, d):
    return facets.facet_counts(parts(spark, d), [], ["words"])


@query("agg13_price_hist",
    f"select b, cast(string_split(b, '-')[1] as bigint) lo, n"
    f" from (select cast(cast(floor(price_cents / 100.0 / 5000) * 5000 as bigint) as varchar) || '-' ||"
    f" cast(cast(floor(price_cents / 100.0 / 5000) * 5000 as bigint) + 5000 as varchar) b, count(*) n from {LISTINGS} group by 1)"
)
def agg13(spark, d):
    h = listings(spark, d).groupBy(bucket(F.col("price_cents") / 100, 5000).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return h.select("b", bucket_low(F.col("b")).alias("lo"), "n")


@query("agg14_mileage_hist",
    f"select cast(cast(floor(size / 12.0) * 12 as bigint) as varchar) || '-' || cast(cast(floor(size / 12.0) * 12 as bigint) + 12 as varchar) b,"
    f" count(*) n from {PARTS} group by 1"
)
def agg14(spark, d):
    return parts(spark, d).groupBy(bucket(F.col("size"), 12).alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("agg15_disjunctive",
    f"select 'source' facet, source as value, count(*) n from {LISTINGS} where segment in ('BUILDING') and price_cents >= 5000000 group by 2"
    f" union all select 'segment', segment, count(*) from {LISTINGS} where source in ('ASIA') and price_cents >= 5000000 group by 2 union all"
    f" select 'status', status, count(*) from {LISTINGS} where source in ('ASIA') and segment in ('BUILDING') and price_cents >= 5000000 group by 2"
)
def agg15(spark, d):
    s = Search(any_of={"source": ["ASIA"], "segment": ["BUILDING"]}, ranges={"price_cents": (5_000_000, None)})
    return facets.disjunctive_facets(listings(spark, d), s, ["source", "segment", "status"])


@query("agg16_complement",
    f"select count(*) total, count(*) filter (where status in ('O', 'F')) covered, count(*) - count(*) filter (where status in ('O', 'F')) missing"
    f" from {LISTINGS}"
)
def agg16(spark, d):
    a = listings(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin("O", "F")).alias("covered"))
    return a.withColumn("missing", F.when(F.col("covered") <= F.col("total"), F.col("total") - F.col("covered")))


@query("agg17_color_family", f"""select coalesce(f, w) family, cast(sum(n) as bigint) n from (select words[1] w, case when words[1] in ('white', 'ivory', 'snow') then 'white' when words[1] = 'black' then 'black'
 when words[1] in ('blue', 'navy', 'azure') then 'blue' when words[1] in ('red', 'maroon') then 'red' when words[1] in ('green', 'olive', 'forest') then 'green' when words[1] in ('brown', 'chocolate') then 'brown'
 when words[1] in ('beige', 'tan', 'cream') then 'beige' end f, count(*) n from {PARTS} group by 1, 2) group by 1""")
def agg17(spark, d):
    """A colour without a family stays its own item."""
    g = parts(spark, d).groupBy(F.col("words")[0].alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(F.coalesce(color_family(F.col("w")), "w").alias("family")).agg(F.sum("n").alias("n"))


@query("agg19_completeness",
    f"select source, round(avg(case when status <> 'P' then 1.0 else 0.0 end), 6) status_known, round(avg(case"
    f" when priority not like '%NOT SPECIFIED%' then 1.0 else 0.0 end), 6) priority_known, count(*) n from {LISTINGS} group by source"
)
def agg19(spark, d):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return listings(spark, d).groupBy("source").agg(share(F.col("status") != "P").alias("status_known"), share(~F.contains("priority", F.lit("NOT SPECIFIED"))).alias("priority_known"), F.count(F.lit(1)).alias("n"))


@query("agg20_status_samples",
    f"select source, count(*) filter (where status = 'O') open, array_to_string(list_sort(array_agg(id order by id) filter (where r <= 10)),"
    f" ',') samples from (select *, row_number() over (partition by source order by id) r from {LISTINGS}) group by source"
)
def agg20(spark, d):
    rows = listings(spark, d)
    few = top_k(rows, ["source"], ["id"], 10).groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("samples"))
    return rows.groupBy("source").agg(F.count_if(F.col("status") == "O").alias("open")).join(few, "source")


COVERAGE = (
    f"with f as (select 'status' field, source, status <> 'P' known from {LISTINGS} union all select 'priority', source,"
    f" priority not like '%NOT SPECIFIED%' from {LISTINGS}) select field, coalesce(source, 'global') source, count(*) total,"
    f" count(*) filter (where known) known, round(count(*) filter (where known) / count(*), 6) rate from f group by grouping sets ((field, source),"
    f" (field))"
)


def _coverage(spark, d):
    known = {"status": F.col("status") != "P", "priority": ~F.contains("priority", F.lit("NOT SPECIFIED"))}
    return facets.coverage(listings(spark, d), known, "source").withColumn("rate", F.round("rate", 6))


@query("agg21_coverage_sets", COVERAGE)
def agg21(spark, d):
    return _coverage(spark, d)


@query("dom14_coverage_drop",
    f"with c as ({COVERAGE}), b as (select field, source, rate + case when source in ('ASIA', 'global') then 0.1 else 0.0 end baseline from c)"
    f" select c.field, c.source, round(baseline - rate, 6) as \"drop\" from c join b using (field, source) where round(baseline - rate, 6) >= 0.1"
)
def dom14(spark, d):
    now = _coverage(spark, d)
    before = now.withColumn("rate", F.col("rate") + F.when(F.col("source").isin("ASIA", "global"), 0.1).otherwise(0.0))
    return facets.coverage_drops(now, before, 0.1 - 1e-9).select("field", "source", F.round("drop", 6).alias("drop"))


@query("agg25_cluster_counts", "select label, count(*) n, count(*) filter (where vec_id % 2 = 0) even from embeddings group by label")
def agg25(spark, d):
    return t(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % 2 == 0).alias("even"))


@query("agg26_dup_groups", "select doc_id, min(doc_id) over w least_id, count(*) over w n from documents window w as (partition by text) qualify count(*) over w > 1")
def agg26(spark, d):
    """A row per member with its group's least id and size: groups are summed before the shuffle and never listed in one row."""
    docs = t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    g = docs.groupBy("h").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(g, docs["h"].eqNullSafe(g["h"])).select("doc_id", "least_id", "n")


@query("agg27_group_examples",
    f"select grp, count(*) n, array_to_string(array_agg(id order by r) filter (where r <= 3), ',') examples from (select *,"
    f" row_number() over (partition by grp order by id) r from (select *, case when source = 'ASIA' then 'Uncategorized' else source end grp"
    f" from {LISTINGS})) group by grp"
)
def agg27(spark, d):
    out = facets.group_examples(listings(spark, d), F.when(F.col("source") == "ASIA", "Uncategorized").otherwise(F.col("source")), "id", ["id"])
    return out.select("grp", "n", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))


@query("agg28_freshness", f"select greatest((select max(recorded_at) from {HISTORY}), (select max(listed_at) from {LISTINGS}), (select max(ts) from {EVENTS})) newest")
def agg28(spark, d):
    times = price_history(spark, d).agg(F.max("recorded_at").alias("at")).union(listings(spark, d).agg(F.max("listed_at"))).union(events(spark, d).agg(F.max("ts")))
    return times.agg(F.max("at").alias("newest"))


@query("agg31_usage",
    f"select event_type, round(sum(value) / 1000, 4) cost, round(avg(value), 4) mean, round(sum(1.0 / (k + 1)), 4) calls from {EVENTS}"
    f" group by event_type"
)
def agg31(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.round(F.sum("value") / 1000, 4).alias("cost"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.sum(1.0 / (F.col("k") + 1)), 4).alias("calls"))


@query("agg32_fleet_counters",
    f"select user_id, count(*) filter (where event_type = 'purchase') done, count(*) filter (where event_type = 'error') failed,"
    f" count(*) filter (where k > 50) timed from {EVENTS} group by user_id"
)
def agg32(spark, d):
    n = F.count_if
    return events(spark, d).groupBy("user_id").agg(n(F.col("event_type") == "purchase").alias("done"), n(F.col("event_type") == "error").alias("failed"), n(F.col("k") > 50).alias("timed"))


@query("agg33_argmin", f"select make, min(price_cents) price_cents, arg_min(id, (price_cents, id)) id from {PARTS} group by make")
def agg33(spark, d):
    return parts(spark, d).groupBy("make").agg(F.min("price_cents").alias("price_cents"), F.min_by("id", F.struct("price_cents", "id")).alias("id"))


@query("agg34_ranking_quality",
    f"with r as (select vehicle_id, price_cents, row_number() over (partition by vehicle_id order by listed_at, id) r, status from {LISTINGS}),"
    f" f as (select vehicle_id, min(r) filter (where status = 'O') first, count(*) filter (where status = 'O' and r <= 5) hit,"
    f" count(*) filter (where status = 'O') rel from r group by vehicle_id) select round(avg(coalesce(1.0 / first, 0)), 6) mrr, round(avg(case"
    f" when hit > 0 then 1.0 else 0.0 end), 6) hit_rate, round(avg(case when rel > 0 then hit / rel end), 6) recall from f"
)
def agg34(spark, d):
    from pyspark.sql import Window

    r = listings(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("vehicle_id").orderBy("listed_at", "id")))
    good = F.col("status") == "O"
    f = r.groupBy("vehicle_id").agg(F.min(F.when(good, F.col("r"))).alias("first"), F.count_if(good & (F.col("r") <= 5)).alias("hit"), F.count_if(good).alias("rel"))
    return f.agg(F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.when(F.col("hit") > 0, 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg(F.when(F.col("rel") > 0, F.col("hit") / F.col("rel"))), 6).alias("recall"))


BOOTSTRAP = f"""
with r as (
  select strftime(date_trunc('week', listed_at), '%Y-%m-%d') k, avg(price_cents) filter (where segment = 'BUILDING') a, avg(price_cents) filter (where segment = 'MACHINERY') b from {LISTINGS} group by 1),
p as (select k, a - b diff from r where a is not null and b is not null),
x as (select i, diff, cast('0x' || substr(md5('466:' || i || ':' || k), 1, 8) as bigint) u from p, (select unnest(range(10000)) i)),
w as (select i, diff, len(list_filter({resampling.WEIGHTS}, lambda t: u >= t)) w from x),
m as (select sum(w * diff) / sum(w) m from w group by i having sum(w) > 0),
s as (select m, row_number() over (order by m) - 1 i, count(*) over () n from m)
select round((select avg(diff) from p), 4) mean, round(max(case when i = floor(0.025 * n) then m end), 4) low, round(max(case when i = ceil(0.975 * n) - 1 then m end), 4) high, count(*) replicates from s
"""


@query("agg35_bootstrap", BOOTSTRAP)
def agg35(spark, d):
    """The difference in mean price of two segments by week."""
    mean = lambda s: F.avg(F.when(F.col("segment") == s, F.col("price_cents")))
    weeks = listings(spark, d).groupBy(F.date_format(F.date_trunc("week", "listed_at"), "yyyy-MM-dd").alias("week")).agg(mean("BUILDING").alias("a"), mean("MACHINERY").alias("b"))
    out = resampling.bootstrap(weeks, "week", "a", "b")
    return out.select(*[F.round(c, 4).alias(c) for c in ("mean", "low", "high")], "replicates")


HQ = (
    f"with b as (select event_type, le, count(*) filter (where value <= le) c from {EVENTS}, (select unnest([5.0, 10.0, 25.0, 50.0, 100.0,"
    f" 1000000.0]) le) group by 1, 2), w as (select *, lag(le, 1, 0) over (partition by event_type order by le) lo, lag(c, 1,"
    f" 0) over (partition by event_type order by le) lc, max(c) over (partition by event_type) * 0.5 target from b), f as (select *,"
    f" row_number() over (partition by event_type order by le) r from w where c >= target) select event_type,"
    f" round(lo + (le - lo) * (target - lc) / (c - lc), 4) quantile from f where r = 1"
)


@query("agg37_hist_quantile", HQ)
def agg37(spark, d):
    edges = [5.0, 10.0, 25.0, 50.0, 100.0, 1_000_000.0]
    rows = events(spark, d).groupBy("event_type").agg(*[F.count_if(F.col("value") <= e).alias(f"c{i}") for i, e in enumerate(edges)])
    long = rows.select("event_type", F.explode(F.array(*[F.struct(F.lit(e).alias("le"), F.col(f"c{i}").alias("c")) for i, e in enumerate(edges)])).alias("x")).select("event_type", "x.*")
    return facets.histogram_quantile(long, ["event_type"], "le", "c", 0.5).withColumn("quantile", F.round("quantile", 4))


@query("agg38_log_rate", f"select date_trunc('hour', ts) at_hour, event_type, round(count(*) / 3600.0, 8) per_second from {EVENTS} where k % 2 = 1 group by 1, 2")
def agg38(spark, d):
    g = events(spark, d).where("k % 2 = 1").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("at_hour"), "event_type", F.round(F.col("n") / 3600.0, 8).alias("per_second"))


@query("agg39_worst_of", f"select user_id, max(case event_type when 'error' then 3 when 'purchase' then 2 else 1 end) worst, count(*) n from {EVENTS} group by user_id")
def agg39(spark, d):
    rank = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    return events(spark, d).groupBy("user_id").agg(F.max(rank).alias("worst"), F.count(F.lit(1)).alias("n"))


@query("agg41_publication_driving",
    f"select source, count(*) filter (where status = 'O') active, count(*) filter (where status = 'P') possibly_gone from {LISTINGS} group by source"
    f" having count(*) filter (where status = 'O') > 0"
)
def agg41(spark, d):
    g = listings(spark, d).groupBy("source").agg(F.count_if(F.col("status") == "O").alias("active"), F.count_if(F.col("status") == "P").alias("possibly_gone"))
    return g.where("active > 0")


@query("agg42_failures", f"select event_type, count(*) n, arg_min(event_id, (ts, event_id)) example from {EVENTS} where k < 20 group by event_type")
def agg42(spark, d):
    return events(spark, d).where("k < 20").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("example"))


@query("agg43_subrange",
    f"select cast(sum(n) as bigint) n from (select cast(floor(price_cents / 100.0 / 5000) * 5000 as bigint) lo, count(*) n from {LISTINGS}"
    f" group by 1) where lo >= 52000 and lo + 5000 <= 203000"
)
def agg43(spark, d):
    h = listings(spark, d).groupBy(bucket(F.col("price_cents") / 100, 5000).alias("b")).agg(F.count(F.lit(1)).alias("n")).withColumn("lo", bucket_low(F.col("b")))
    return h.where("lo >= 52000 and lo + 5000 <= 203000").agg(F.sum("n").alias("n"))


@query("agg44_axis",
    f"select part_id, round(cast(min(price_cents) - (case when max(price_cents) = min(price_cents) then 1000"
    f" else (max(price_cents) - min(price_cents)) * 0.15 end) as double), 0) lo, round(cast(max(price_cents) + (case"
    f" when max(price_cents) = min(price_cents) then 1000 else (max(price_cents) - min(price_cents)) * 0.15 end) as double), 0) hi from {HISTORY}"
    f" group by part_id"
)
def agg44(spark, d):
    g = price_history(spark, d).groupBy("part_id").agg(F.min("price_cents").alias("a"), F.max("price_cents").alias("b"))
    pad = F.when(F.col("a") == F.col("b"), 1000.0).otherwise((F.col("b") - F.col("a")) * 0.15)
    return g.select("part_id", F.round(F.col("a") - pad, 0).alias("lo"), F.round(F.col("b") + pad, 0).alias("hi"))


@query("mth13_price_band",
    f"with q as (select quantile_cont(price_cents, 0.1) p10, quantile_cont(price_cents, 0.25) p25, quantile_cont(price_cents, 0.5) p50,"
    f" quantile_cont(price_cents, 0.75) p75, quantile_cont(price_cents, 0.9) p90 from {REPS}) select id, case"
    f" when price_cents < p10 then 'below_p10' when price_cents < p25 then 'p10_p25' when price_cents < p50 then 'p25_p50'"
    f" when price_cents <= p75 then 'p50_p75' when price_cents <= p90 then 'p75_p90' else 'above_p90' end band from {REPS}, q"
)
def mth13(spark, d):
    reps = representative(listings(spark, d))
    q = market.percentiles(reps, [], "price_cents").drop("n")
    rows = reps.join(F.broadcast(q), F.lit(True))
    return rows.select("id", price_band(F.col("price_cents"), *[F.col(p) for p in market.QUANTILES])["band"].alias("band"))


@query("set04_facet_diff",
    f"with e as (select segment as value, count(*) n from {LISTINGS} where source = 'ASIA' group by 1), a as (select segment as value, count(*) n"
    f" from {LISTINGS} where source = 'EUROPE' and segment <> 'BUILDING' group by 1) select 'segment' facet, coalesce(e.value, a.value) as value,"
    f" e.n expected, a.n actual, case when a.n is null then 'only_expected' when e.n is null then 'only_actual' else 'count_mismatch' end kind"
    f" from e full join a on e.value = a.value where e.n is distinct from a.n"
)
def set04(spark, d):
    rows = listings(spark, d)
    return facets.compare_facets(facets.facet_counts(rows.where("source = 'ASIA'"), ["segment"]), facets.facet_counts(rows.where("source = 'EUROPE' and segment <> 'BUILDING'"), ["segment"]))


@query("set09_ghosts",
    f"with a as (select 'segment' facet, segment as value, count(*) n from {LISTINGS} where segment <> 'BUILDING' and source = 'ASIA' group by 2),"
    f" b as (select distinct 'segment' facet, segment as value from {LISTINGS}) select * from a union all select facet, value, 0 from b"
    f" where value not in (select value from a)"
)
def set09(spark, d):
    rows = listings(spark, d)
    return facets.ghosts(facets.facet_counts(rows.where("segment <> 'BUILDING' and source = 'ASIA'"), ["segment"]), facets.facet_counts(rows, ["segment"]))


@query("agg36_children", "select n_name, count(c_custkey) n from nation left join customer on c_nationkey = n_nationkey and c_acctbal < 0 group by n_name")
def agg36(spark, d):
    c = t(spark, d, "customer").where("c_acctbal < 0").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    n = t(spark, d, "nation")
    return n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("map01_counters",
    f"select user_id, array_to_string(list_sort(array_agg(event_type || '=' || cast(n as varchar))), ',') counts from (select user_id, event_type,"
    f" count(*) n from {EVENTS} group by 1, 2) group by 1"
)
def map01(spark, d):
    n = events(spark, d).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("counts"))

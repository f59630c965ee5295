"""Queries on representatives, latest rows, paging, changes and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise.operators import filters, fulltext, groups, joins
from lotwise.plans.registry import query
from lotwise.plans.standins import EVENTS, HISTORY, LISTINGS, PARTS, events, listings, parts, price_history, scratch, t


@query("win01_representative",
    f"select id, vehicle_id, listed_at, price_cents from {LISTINGS} qualify row_number() over (partition by vehicle_id order by listed_at desc,"
    f" id) = 1"
)
def win01(spark, d):
    return groups.representative(listings(spark, d)).select("id", "vehicle_id", "listed_at", "price_cents")


@query("win02_first_last",
    f"select part_id, arg_min(price_cents, (recorded_at, ok, ln)) first_value, arg_max(price_cents, (recorded_at, ok, ln)) last_value,"
    f" count(*) n_points from {HISTORY} group by part_id"
)
def win02(spark, d):
    return groups.first_last(price_history(spark, d), "part_id", "price_cents", ["recorded_at", "ok", "ln"])


@query("win03_first_value", f"select event_id, first_value(event_id) over (partition by user_id, event_type order by ts desc nulls last, event_id) newest_id from {EVENTS}")
def win03(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc_nulls_last("ts"), "event_id")
    return events(spark, d).select("event_id", F.first("event_id").over(w).alias("newest_id"))


@query("win04_dedupe_rownum", "select min(doc_id) doc_id, count(*) n from documents group by text")
def win04(spark, d):
    kept = t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h"), F.length("text").alias("n_text")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    return kept.select("doc_id", "n")


@query("win05_latest_tombstone",
    f"select user_id, event_id, k from (select *, case when k % 7 = 0 then null else k end v from {EVENTS}"
    f" qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) where v is not null"
)
def win05(spark, d):
    rows = events(spark, d).withColumn("v", F.when(F.col("k") % 7 != 0, F.col("k")))
    return groups.latest_live(rows, "user_id", [F.desc("ts"), F.desc("event_id")], "v").select("user_id", "event_id", "k")


@query("win06_scored_representative",
    f"select make, id, score from (select *, (case when size % 2 = 0 then 1 else 0 end) + (case when price_cents % 3 = 0 then 1"
    f" else 0 end) + cast(len(words) as integer) score from {PARTS}) qualify row_number() over (partition by make order by score desc, size desc,"
    f" id) = 1"
)
def win06(spark, d):
    rows = parts(spark, d).withColumns({"even": F.when(F.col("size") % 2 == 0, 1), "third": F.when(F.col("price_cents") % 3 == 0, 1)}).withColumn("score", groups.completeness(["even", "third"], "words"))
    return groups.scored_representative(rows, ["make"], F.col("score"), "size", "id").select("make", "id", "score")


@query("win10_topk_per_parent",
    f"select vehicle_id, id, cast(r as integer) r from (select *, row_number() over (partition by vehicle_id order by price_cents desc,"
    f" listed_at desc, id) r from {LISTINGS}) where r <= 5"
)
def win10(spark, d):
    return groups.top_k(listings(spark, d), ["vehicle_id"], [F.desc("price_cents"), F.desc("listed_at"), "id"], 5, "r").select("vehicle_id", "id", "r")


@query("win11_topk_then_limit",
    f"select part_id, ok, ln from (select *, row_number() over (partition by part_id order by recorded_at, ok, ln) r from {HISTORY}) where r <= 3"
    f" order by part_id, r limit 500"
)
def win11(spark, d):
    return groups.top_k(price_history(spark, d), ["part_id"], ["recorded_at", "ok", "ln"], 3, "r").orderBy("part_id", "r").limit(500).select("part_id", "ok", "ln")


@query("win13_change_detect",
    f"select event_id, user_id, k3 from (select event_id, user_id, event_type, ts, k % 3 k3, lag(k % 3) over (partition by user_id, event_type"
    f" order by ts, event_id) p, row_number() over (partition by user_id, event_type order by ts, event_id) r from {EVENTS})"
    f" where r = 1 or k3 is distinct from p"
)
def win13(spark, d):
    return groups.changed(events(spark, d).withColumn("k3", F.col("k") % 3), ["user_id", "event_type"], ["ts", "event_id"], ["k3"]).select("event_id", "user_id", "k3")


@query("win14_changelog", f"""with s as (select part_id, recorded_at, ok, ln, (ok % 2) status, array_to_string(list_sort(list_distinct([ok % 3, ln % 2])), ',') f from {HISTORY}),
 c as (select *, lag(status) over w ps, lag(f) over w pf, row_number() over w r from s window w as (partition by part_id order by recorded_at, ok, ln)),
 k as (select *, count(*) over (partition by part_id) n from c where r = 1 or status is distinct from ps or f is distinct from pf) select part_id, ok, ln, status, f from k where n > 1""")
def win14(spark, d):
    rows = price_history(spark, d).withColumns({"status": F.col("ok") % 2, "features": F.array(F.col("ok") % 3, F.col("ln").cast("bigint") % 2)})
    out = groups.changelog(rows, "part_id", ["recorded_at", "ok", "ln"], "status", "features")
    return out.select("part_id", "ok", "ln", "status", F.array_join(F.array_sort(F.array_distinct("features")).cast("array<string>"), ",").alias("f"))


@query("win16_latest_success", f"select event_type, arg_max(event_id, (ts, event_id)) event_id, max(ts) ts from {EVENTS} where k % 2 = 0 group by event_type")
def win16(spark, d):
    return events(spark, d).where("k % 2 = 0").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("win18_change_points",
    f"select part_id, ok, ln from (select *, lag(ok % 5) over (partition by part_id order by recorded_at, ok, ln) p from {HISTORY})"
    f" where p is not null and p <> ok % 5"
)
def win18(spark, d):
    w = Window.partitionBy("part_id").orderBy("recorded_at", "ok", "ln")
    return price_history(spark, d).withColumn("p", F.lag(F.col("ok") % 5).over(w)).where("p <> ok % 5").select("part_id", "ok", "ln")


@query("win19_best_product", f"""with p as (select *, 8 + case when price_cents % 2 = 0 then 4 else 0 end base from {PARTS}), l as (select id, id % 50 + 1 size, 'Brand#' || cast(vehicle_id % 5 + 1 as varchar) make from {LISTINGS}),
 own as (select size, make, base + 3 score, id product_id from p qualify row_number() over (partition by size, make order by base desc, id) = 1),
 other as (select size, base score, id product_id from p qualify row_number() over (partition by size order by base desc, id) = 1),
 u as (select l.id, product_id, score from l join own on own.size = l.size and own.make = l.make union all select l.id, product_id, score from l join other on other.size = l.size)
 select id, product_id, score from u qualify row_number() over (partition by id order by score desc, product_id) = 1""")
def win19(spark, d):
    """The best product of each listing: products meet listings only as the best of their size, and of their size and brand, never one by one."""
    base = F.lit(8) + F.when(F.col("price_cents") % 2 == 0, 4).otherwise(0)
    products = parts(spark, d).select("size", "make", base.alias("base"), F.col("id").alias("product_id"))
    best = [F.desc("base"), F.asc("product_id")]
    own = groups.top_k(products, ["size", "make"], best).select("size", "make", (F.col("base") + 3).alias("score"), "product_id")
    other = groups.top_k(products, ["size"], best).select("size", F.col("base").alias("score"), "product_id")
    rows = listings(spark, d).select("id", (F.col("id") % 50 + 1).alias("size"), F.concat(F.lit("Brand#"), (F.col("vehicle_id") % 5 + 1).cast("string")).alias("make"))
    two = F.array(F.struct(F.col("own.score").alias("score"), F.col("own.product_id").alias("product_id")), F.struct(F.col("other.score").alias("score"), F.col("other.product_id").alias("product_id")))
    met = rows.alias("l").join(own.alias("own"), ["size", "make"], "left").join(other.alias("other"), "size", "left")
    first = F.array_sort(F.transform(F.filter(two, lambda x: x["score"].isNotNull()), lambda x: F.struct((-x["score"]).alias("low"), x["product_id"].alias("product_id"))))
    return met.select("id", F.get(first, F.lit(0)).alias("b")).where("b is not null").select("id", "b.product_id", (-F.col("b.low")).alias("score"))


@query("flt18_keyset", f"select id, listed_at from {LISTINGS} where (listed_at, id) > (timestamp '1996-01-01 00:00:00', 100) order by listed_at, id limit 500")
def flt18(spark, d):
    import datetime as dt

    return listings(spark, d).where(filters.after(["listed_at", "id"], [dt.datetime(1996, 1, 1), 100])).orderBy("listed_at", "id").limit(500).select("id", "listed_at")


@query("srt03_page",
    f"select id, price_cents from {LISTINGS} where source in ('ASIA', 'EUROPE') and price_cents >= 1000000 order by price_cents desc, id"
    f" limit 20 offset 40"
)
def srt03(spark, d):
    s = filters.Search(any_of={"source": ["ASIA", "EUROPE"], "status": []}, ranges={"price_cents": (1_000_000, None)}, sort="price_cents:desc", page=3)
    return filters.search(listings(spark, d), s, "id").select("id", "price_cents")


@query("flt03_in_filters",
    f"select id, source, segment from {LISTINGS} where source in ('ASIA', 'AFRICA') and segment in ('BUILDING') and price_cents between 5000000"
    f" and 20000000"
)
def flt03(spark, d):
    s = filters.Search(any_of={"source": ["ASIA", "AFRICA"], "segment": ["BUILDING"]}, ranges={"price_cents": (5_000_000, 20_000_000)})
    return listings(spark, d).where(s.conditions()).select("id", "source", "segment")


@query("flt04_any_of_array", f"select id from {PARTS} where list_has_any(words, ['green', 'blue', 'steel'])")
def flt04(spark, d):
    return parts(spark, d).where(filters.Search(any_in_array={"words": ["green", "blue", "steel"]}).conditions()).select("id")


@query("flt05_ranges", f"select id, size from {PARTS} where size >= 10 and size <= 20 and price_cents >= 91000 and id % 13 > 0")
def flt05(spark, d):
    """Bounds with rows on both sides; a part without a price (every 13th) never matches."""
    priced = F.when(F.col("id") % 13 > 0, F.col("price_cents"))
    wanted = filters.Search(ranges={"size": (10, 20), "price_cents": (91_000, None)})
    return parts(spark, d).withColumn("price_cents", priced).where(wanted.conditions()).select("id", "size")


@query("flt11_age_fallback", f"select event_id from {EVENTS} where coalesce(case when k % 2 = 0 then ts end, ts - interval 1 day) <= timestamp '2024-01-10 00:00:00'")
def flt11(spark, d):
    checked = F.when(F.col("k") % 2 == 0, F.col("ts"))
    return events(spark, d).where(F.coalesce(checked, F.col("ts") - F.expr("interval 1 day")) <= F.lit("2024-01-10").cast("timestamp")).select("event_id")


@query("flt12_stale", f"select event_id from {EVENTS} where (case when k % 5 > 0 then ts end) is null or ts < timestamp '2024-01-05 00:00:00' or k % 11 = 0")
def flt12(spark, d):
    return events(spark, d).where(filters.stale(F.when(F.col("k") % 5 > 0, F.col("ts")), F.lit("2024-01-05").cast("timestamp"), F.col("k") % 11 == 0)).select("event_id")


@query("flt13_case_insensitive", f"select id, model from {PARTS} where lower(model) = lower('Standard anodized TIN') or lower(make) in ('brand#13', 'brand#22')")
def flt13(spark, d):
    return parts(spark, d).where((F.lower("model") == "standard anodized tin") | F.lower("make").isin("brand#13", "brand#22")).select("id", "model")


WEIGHTS = {"title": 7, "opening": 6, "lead": 5, "closing": 4, "lang": 3, "source": 2, "text": 1}
BM25 = """
with f as (
  select doc_id doc, unnest([
    {'field': 'title', 'x': split_part(text, chr(10), 1), 'weight': 7}, {'field': 'opening', 'x': split_part(text, '.', 1), 'weight': 6},
    {'field': 'lead', 'x': split_part(text, chr(10), 2), 'weight': 5}, {'field': 'closing', 'x': split_part(text, chr(10), -1), 'weight': 4},
    {'field': 'lang', 'x': lang, 'weight': 3}, {'field': 'source', 'x': source, 'weight': 2}, {'field': 'text', 'x': text, 'weight': 1}], recursive := true)
  from documents),
w as (select doc, field, weight, regexp_extract_all(lower(coalesce(x, '')), '[\\p{L}\\p{N}]+') w from f),
l as (select *, len(w) n from w where len(w) > 0),
a as (select field, any_value(weight) weight, count(*) docs, avg(n) mean from l group by field),
p as (select doc, field, n, term, count(*) tf from (select doc, field, n, unnest(w) term from l) group by all),
d as (select term, field, count(*) df from p group by all),
q as (select distinct item_id query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) term from benchmark),
s as (
  select query_id, p.doc, round(sum(a.weight * ln(1 + (a.docs - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.n / a.mean))), 6) score
  from q join d using (term) join p using (term, field) join a using (field) group by all)
select query_id, cast(row_number() over (partition by query_id order by score desc, doc) as int) as rank, doc, score from s qualify rank <= 10
"""


@query("flt15_fulltext", BM25)
def flt15(spark, d):
    """Each benchmark text as a query over seven fields of all documents."""
    part = lambda by, n: F.split_part("text", F.lit(by), F.lit(n))
    docs = t(spark, d, "documents").select("doc_id", "text", "lang", "source", part("\n", 1).alias("title"), part(".", 1).alias("opening"), part("\n", 2).alias("lead"), part("\n", -1).alias("closing"))
    index = fulltext.build(docs, "doc_id", [*WEIGHTS]).save(scratch(spark, "fulltext"))
    return fulltext.search(index, t(spark, d, "benchmark"), WEIGHTS, query_id="item_id")


@query("flt16_prefix", f"select id, model from {PARTS} where starts_with(model, 'STANDARD') or starts_with(model, 'Standard')")
def flt16(spark, d):
    return parts(spark, d).where(F.startswith("model", F.lit("STANDARD")) | F.startswith("model", F.lit("Standard"))).select("id", "model")


@query("flt22_having", f"select vehicle_id, count(*) n from {LISTINGS} group by vehicle_id having count(*) > 12")
def flt22(spark, d):
    return listings(spark, d).groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n")).where("n > 12")


@query("flt23_prefer_finished",
    f"select event_id from (select *, max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id) f from {EVENTS})"
    f" where f = 0 or event_type = 'purchase'"
)
def flt23(spark, d):
    any_done = F.max((F.col("event_type") == "purchase").cast("int")).over(Window.partitionBy("user_id"))
    return events(spark, d).withColumn("f", any_done).where("f = 0 or event_type = 'purchase'").select("event_id")


@query("srt05_nulls_last", f"select id, due from (select id, case when size % 3 > 0 then size end due from {PARTS}) order by due nulls last, id limit 100")
def srt05(spark, d):
    return parts(spark, d).select("id", F.when(F.col("size") % 3 > 0, F.col("size")).alias("due")).orderBy(F.asc_nulls_last("due"), "id").limit(100)


@query("srt06_severity",
    f"select event_id, event_type, ts from {EVENTS} order by case event_type when 'error' then 0 when 'purchase' then 1 else 2 end, ts desc,"
    f" event_id limit 200"
)
def srt06(spark, d):
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return events(spark, d).orderBy(rank, F.desc("ts"), "event_id").limit(200).select("event_id", "event_type", "ts")


@query("srt11_least_loaded",
    "select n_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey)) s_suppkey from supplier join nation on n_nationkey = s_nationkey"
    " where s_acctbal > 0 group by n_nationkey"
)
def srt11(spark, d):
    return t(spark, d, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("s_suppkey"))


@query("set01_history_union",
    f"select part_id, recorded_at, ok, kind, r, v from (select part_id, recorded_at, ok, ln, 'price' kind, 0 r, price_cents v from {HISTORY}"
    f" union all select l_partkey, l_shipdate, l_orderkey, l_linenumber, 'mileage', 1, cast(l_quantity as bigint) from lineitem)"
)
def set01(spark, d):
    """One vehicle's history is read in order; the whole table's is ordered within each part, not across all of them."""
    price = price_history(spark, d).select("part_id", "recorded_at", "ok", F.lit("price").alias("kind"), F.lit(0).alias("r"), F.col("price_cents").alias("v"))
    lines = t(spark, d, "lineitem").select(F.col("l_partkey").alias("part_id"), F.col("l_shipdate").alias("recorded_at"), F.col("l_orderkey").alias("ok"), F.col("l_quantity").cast("bigint").alias("v"))
    miles = lines.withColumns({"kind": F.lit("mileage"), "r": F.lit(1)}).select(*price.columns)
    return price.unionByName(miles).repartition("part_id").sortWithinPartitions("part_id", "recorded_at", "r", "ok")


@query("set03_difference",
    "select user_id, side from (select user_id, 'only_view' side from events where event_type = 'view' and hour(ts) < 1 except"
    " select user_id, 'only_view' from events where event_type = 'error' and hour(ts) < 1 union all (select user_id, 'only_error' from events"
    " where event_type = 'error' and hour(ts) < 1 except select user_id, 'only_error' from events where event_type = 'view' and hour(ts) < 1))"
)
def set03(spark, d):
    """Users of the first hour of days who did one thing and not the other."""
    of = lambda kind: events(spark, d).where((F.col("event_type") == kind) & (F.hour("ts") < 1)).select("user_id")
    one, two = of("view"), of("error")
    return one.subtract(two).withColumn("side", F.lit("only_view")).unionByName(two.subtract(one).withColumn("side", F.lit("only_error")))


@query("set05_problem_union",
    f"select source, key, n from (select 'events' source, event_type as key, count(*) n from {EVENTS} group by event_type union all select 'orders',"
    f" status, count(*) from {LISTINGS} group by status)"
)
def set05(spark, d):
    a = events(spark, d).groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("events"))
    b = listings(spark, d).groupBy(F.col("status").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit("orders"))
    return a.unionByName(b, allowMissingColumns=True).select("source", "key", "n")


@query("set06_set_equality", f"select p.id a, q.id b from {PARTS} p join {PARTS} q on p.size = q.size and p.id < q.id where list_sort(p.words) = list_sort(q.words)")
def set06(spark, d):
    rows = parts(spark, d).select("id", "size", F.array_sort("words").alias("bag"))
    return joins.blocked_pairs(rows, ["size", "bag"], "id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))


@query("prj06_snippet", "select doc_id, case when length(trim(text)) <= 300 then trim(text) else rtrim(substr(trim(text), 1, 300)) || '…' end snippet from documents")
def prj06(spark, d):
    from lotwise.functions.text import snippet

    return t(spark, d, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"))

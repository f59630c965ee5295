"""Queries on joins, intervals, lineage and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions.numeric import hamming, haversine, hex_to_long, long_to_hex
from lotwise.operators import joins, market
from lotwise.operators.groups import first_last
from lotwise.plans.registry import query
from lotwise.plans.standins import EVENTS, HISTORY, LISTINGS, PICTURES, events, listings, pictures, price_history, t


@query("jon02_first_last_join",
    f"with h as (select part_id, arg_min(price_cents, (recorded_at, ok, ln)) f, arg_max(price_cents, (recorded_at, ok, ln)) l from {HISTORY}"
    f" group by part_id) select p_partkey, p_brand, f, l from part join h on part_id = p_partkey where f > l"
)
def jon02(spark, d):
    h = first_last(price_history(spark, d), "part_id", "price_cents", ["recorded_at", "ok", "ln"]).where("first_value > last_value")
    return t(spark, d, "part").join(h, F.col("p_partkey") == F.col("part_id")).select("p_partkey", "p_brand", F.col("first_value").alias("f"), F.col("last_value").alias("l"))


@query("jon03_empty_buckets",
    f"select m, count(e.event_id) n from (select unnest(generate_series(timestamp '2023-12-01', timestamp '2024-03-01', interval 1 month)) m) left"
    f" join {EVENTS} e on date_trunc('month', e.ts) = m group by m"
)
def jon03(spark, d):
    n = events(spark, d).groupBy(F.date_trunc("month", "ts").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return joins.spine(spark, "2023-12-01", "2024-03-01", "month").select(F.col("bucket").alias("m")).join(n, "m", "left").select("m", F.coalesce("n", F.lit(0)).alias("n"))


@query("jon04_interval",
    f"select b as bucket, count(distinct id) n from (select unnest(generate_series(timestamp '1993-01-01', timestamp '1996-12-01',"
    f" interval 1 month)) b) left join (select id, listed_at, listed_at + interval 75 day gone_at"
    f" from {LISTINGS}) on listed_at <= b + interval 1 month and gone_at >= b group by b"
)
def jon04(spark, d):
    rows = listings(spark, d).withColumn("gone_at", F.col("listed_at") + F.expr("interval 75 days"))
    at = lambda s: F.lit(s).cast("timestamp")
    n = joins.covered_buckets(rows, F.col("listed_at"), F.col("gone_at"), "month", at("1993-01-01"), at("1996-12-01")).groupBy("bucket").agg(F.count_distinct("id").alias("n"))
    return joins.spine(spark, "1993-01-01", "1996-12-01", "month").join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query("jon05_point_in_bucket",
    f"select b as bucket, round(quantile_cont(price_cents, 0.5), 2) median from (select unnest(generate_series(timestamp '1994-01-03',"
    f" timestamp '1994-12-26', interval 7 day)) b) left join {HISTORY} on recorded_at >= b and recorded_at < b + interval 7 day group by b"
)
def jon05(spark, d):
    weekly = price_history(spark, d).select(F.date_trunc("week", "recorded_at").alias("bucket"), "price_cents")
    m = market.percentiles(weekly, ["bucket"], "price_cents", {"median": 0.5})
    return joins.spine(spark, "1994-01-03", "1994-12-26", "week").join(m.select("bucket", F.round("median", 2).alias("median")), "bucket", "left")


@query("jon08_blocked_pairs",
    "select a.c_custkey a, b.c_custkey b from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_mktsegment = b.c_mktsegment"
    " and a.c_custkey < b.c_custkey where abs(a.c_acctbal - b.c_acctbal) <= 500"
)
def jon08(spark, d):
    pairs = joins.blocked_pairs(t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), ["c_nationkey", "c_mktsegment"], "c_custkey", near=("c_acctbal", 500))
    return pairs.select(F.col("a_c_custkey").alias("a"), F.col("b_c_custkey").alias("b"))


@query("jon09_counts_or_zero",
    "select s_suppkey, coalesce(n, 0) n from supplier left join (select l_suppkey, count(*) n from lineitem where l_returnflag = 'R'"
    " and l_quantity > 49 group by 1) on l_suppkey = s_suppkey"
)
def jon09(spark, d):
    n = t(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return t(spark, d, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("jon10_reconcile_anti",
    "select c_custkey, 'missing' side from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P') union all"
    " select distinct o_custkey, 'unexpected' from orders where o_orderstatus = 'P' and o_custkey % 2 = 0 and o_custkey not in (select c_custkey"
    " from customer where c_acctbal > 0)"
)
def jon10(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders").where("o_orderstatus = 'P'")
    missing = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", F.lit("missing").alias("side"))
    rich = c.where("c_acctbal > 0")
    extra = o.where("o_custkey % 2 = 0").join(rich, o["o_custkey"] == rich["c_custkey"], "left_anti").select(F.col("o_custkey").alias("c_custkey"), F.lit("unexpected").alias("side")).distinct()
    return missing.unionByName(extra)


@query("jon12_not_in_keys", "select o_orderkey from orders where o_orderstatus = 'O' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'N')")
def jon12(spark, d):
    seen = t(spark, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, d, "orders").where("o_orderstatus = 'O'").join(seen, "o_orderkey", "left_anti").select("o_orderkey")


@query("jon13_semi_cross_source",
    f"select id from {LISTINGS} l where exists (select 1 from {LISTINGS} m where m.price_cents // 10000 = l.price_cents // 10000"
    f" and m.source <> l.source)"
)
def jon13(spark, d):
    rows = listings(spark, d).withColumn("key", F.floor(F.col("price_cents") / 10000))
    many = rows.groupBy("key").agg(F.count_distinct("source").alias("n")).where("n > 1")
    return rows.join(many, "key", "left_semi").select("id")


@query("jon14_same_vehicle", f"select l.id, count(m.id) others from {LISTINGS} l left join {LISTINGS} m on m.vehicle_id = l.vehicle_id and m.id <> l.id group by l.id")
def jon14(spark, d):
    rows = listings(spark, d)
    n = rows.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(n, "vehicle_id").select("id", (F.col("n") - 1).alias("others"))


@query("jon15_document_assembly", """with l as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) r from lineitem),
 a as (select l_orderkey, array_to_string(array_agg(l_partkey order by r), ',') top_parts from l where r <= 3 group by 1) select o_orderkey, top_parts from orders left join a on l_orderkey = o_orderkey""")
def jon15(spark, d):
    from lotwise.operators.groups import top_k

    lines = top_k(t(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"], 3, "r")
    first = F.transform(F.array_sort(F.collect_list(F.struct("r", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))  # three at most
    child = lines.groupBy("l_orderkey").agg(F.array_join(first, ",").alias("top_parts"))
    return t(spark, d, "orders").join(child, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "top_parts")


@query("jon16_divergence",
    "with b as (select o_orderkey id, o_orderstatus st, o_orderpriority pr from orders), x as (select id, case when id % 97 = 0 then 'X'"
    " else st end st, case when id % 89 = 0 then '0' else pr end pr from b) select b.id, 'status' field, b.st expected, x.st actual from b"
    " join x using (id) where b.st is distinct from x.st union all select b.id, 'priority', b.pr, x.pr from b join x using (id)"
    " where b.pr is distinct from x.pr"
)
def jon16(spark, d):
    b = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    x = b.select("id", F.when(F.col("id") % 97 == 0, "X").otherwise(F.col("status")).alias("x_status"), F.when(F.col("id") % 89 == 0, "0").otherwise(F.col("priority")).alias("x_priority"))
    long = b.join(x, "id").select("id", F.expr("stack(2, 'status', status, x_status, 'priority', priority, x_priority) as (field, expected, actual)"))
    return long.where(~F.col("expected").eqNullSafe(F.col("actual")))


@query("jon17_scalar_subquery", "select c_custkey, (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = 'P') n from customer")
def jon17(spark, d):
    counted = "select c_custkey, (select count(*) from {orders} where o_custkey = c_custkey and o_orderstatus = 'P') n from {customer}"
    return spark.sql(counted, orders=t(spark, d, "orders"), customer=t(spark, d, "customer"))


@query("jon19_fallback",
    "with m as (select p_brand make, p_size size, min(p_partkey) model_id from part where p_size % 3 = 0 group by 1, 2 union all select p_brand,"
    " null, min(p_partkey) from part where p_brand not like '%5' group by 1) select p_partkey, coalesce(e.model_id, f.model_id) model_id, case"
    " when e.model_id is not null then 'exact' when f.model_id is not null then 'fallback' else 'none' end as match from part left"
    " join m e on e.make = p_brand and e.size = p_size left join m f on f.make = p_brand and f.size is null"
)
def jon19(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.col("p_brand").alias("make"), F.col("p_size").alias("size"))
    table = p.where("size % 3 = 0").groupBy("make", "size").agg(F.min("p_partkey").alias("model_id")).unionByName(p.where("make not like '%5'").groupBy("make").agg(F.min("p_partkey").alias("model_id")).withColumn("size", F.lit(None).cast("int")))
    return joins.with_fallback(p, table, ["make", "size"], ["make"], "model_id").select("p_partkey", "model_id", "match")


GEO = "(select s_suppkey id, 25 + (s_suppkey * 37 % 240) / 10.0 lat, -120 + (s_suppkey * 53 % 500) / 10.0 lng from supplier)"


def _geo(spark, d):
    k = F.col("s_suppkey")
    return t(spark, d, "supplier").select(k.alias("id"), (25 + (k * 37 % 240) / 10.0).alias("lat"), (-120 + (k * 53 % 500) / 10.0).alias("lng"))


MILES = "2 * 3958.8 * asin(sqrt(pow(sin(radians(lat - 35) / 2), 2) + cos(radians(35)) * cos(radians(lat)) * pow(sin(radians(lng + 100) / 2), 2)))"


@query("jon22_radius", f"select id, round({MILES}, 1) miles from {GEO} where {MILES} <= 500")
def jon22(spark, d):
    return joins.within_radius(_geo(spark, d), "lat", "lng", (35.0, -100.0), 500).select("id", F.round("miles", 1).alias("miles"))


@query("mth01_haversine", f"select id, round({MILES}, 3) miles from {GEO}")
def mth01(spark, d):
    return _geo(spark, d).select("id", F.round(haversine(F.lit(35.0), F.lit(-100.0), F.col("lat"), F.col("lng")), 3).alias("miles"))


NEAR = (
    f"(select id, phash from {PICTURES} union all select id + 1000000000,"
    f" xor(phash, (1::bigint << cast(id % 60 as integer)) | (1::bigint << cast(id * 7 % 60 as integer)) | (id % 7)) from {PICTURES})"
)


def _near(spark, d):
    """Pictures, and an edited copy of each that differs by a few bits."""
    p = pictures(spark, d).select("id", "phash")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), (x % 60).cast("int"))
    edit = bit(F.col("id")).bitwiseOR(bit(F.col("id") * 7)).bitwiseOR(F.col("id") % 7)
    return p.unionByName(p.select((F.col("id") + 1_000_000_000).alias("id"), F.col("phash").bitwiseXOR(edit).alias("phash")))


@query("jon23_hamming",
    f"with g as (select phash h, min(id) id from {NEAR} group by 1) select a.id a, b.id b, cast(bit_count(xor(a.h, b.h)) as integer) distance"
    f" from g a join g b on a.id < b.id where bit_count(xor(a.h, b.h)) <= 10"
)
def jon23(spark, d):
    return joins.hamming_pairs(_near(spark, d), "id", "phash")


@query("mth02_hamming", f"select id, cast(bit_count(xor(phash, 81985529216486895)) as integer) distance from {PICTURES}")
def mth02(spark, d):
    return pictures(spark, d).select("id", hamming(F.col("phash"), F.lit(81985529216486895)).alias("distance"))


@query("mth03_hex_int",
    f"select id, lower(lpad(hex(cast(case when phash < 0 then phash + 18446744073709551616::hugeint else phash::hugeint end as ubigint)),"
    f" 16, '0')) h, phash back from {PICTURES}"
)
def mth03(spark, d):
    return pictures(spark, d).select("id", long_to_hex(F.col("phash")).alias("h")).withColumn("back", hex_to_long(F.col("h")))


@query("jon24_prefix_join",
    "select p.p_partkey, b.t from part p join (select distinct left(p_name, 3 + p_partkey % 7) t from part"
    " where p_partkey % 40 = 0) b on starts_with(p.p_name, b.t)"
)
def jon24(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_name")
    bases = p.where("p_partkey % 40 = 0").select(F.expr("left(p_name, cast(3 + p_partkey % 7 as int))").alias("t")).distinct()
    return joins.prefix_join(p, "p_name", bases, "t").select("p_partkey", "t")


@query("jon25_missing_or_stale",
    "select s_suppkey from supplier left join (select l_suppkey, max(l_shipdate) last from lineitem where l_suppkey % 10 > 0"
    " group by 1) on l_suppkey = s_suppkey where last is null or last < timestamp '2001-10-20' order by s_suppkey limit 50"
)
def jon25(spark, d):
    """The next fifty suppliers without a delivery (every tenth) or with none since a cutoff."""
    last = t(spark, d, "lineitem").where("l_suppkey % 10 > 0").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last"))
    due = t(spark, d, "supplier").join(last, F.col("s_suppkey") == F.col("l_suppkey"), "left").where("last is null or last < timestamp'2001-10-20'")
    return due.orderBy("s_suppkey").limit(50).select("s_suppkey")


@query("set02_recursive_lineage",
    "with recursive e as (select o_orderkey child, o_orderkey // 2 parent from orders where o_orderkey >= 2), tree as (select 1::bigint id,"
    " 1::bigint root, 0 depth union all select child, root, depth + 1 from tree join e on parent = id) select id, root, min(depth) depth from tree"
    " group by 1, 2"
)
def set02(spark, d):
    edges = t(spark, d, "orders").where("o_orderkey >= 2").select(F.col("o_orderkey").alias("child"), F.expr("o_orderkey div 2").alias("parent"))
    return joins.lineage(edges, spark.range(1, 2))


@query("dat02_series",
    "select unnest(generate_series(date_trunc('week', min(o_orderdate)), date_trunc('week', max(o_orderdate)),"
    " interval 7 day))::timestamp as bucket from orders"
)
def dat02(spark, d):
    return joins.spine_of(t(spark, d, "orders"), "o_orderdate", "week")


BUCKETS = "(select unnest(generate_series(timestamp '1993-01-01', timestamp '1996-12-01', interval 1 month)) as bucket)"
REPS = (
    f"(select *, listed_at + interval 1 day * (id % 200) gone_at from {LISTINGS} qualify row_number() over (partition by vehicle_id"
    f" order by listed_at desc, id) = 1)"
)


@query("dom18_trends", f"""with r as {REPS}, i as (select bucket, count(distinct id) n from {BUCKETS} left join r on listed_at <= bucket + interval 1 month and gone_at >= bucket group by 1),
 h as (select date_trunc('month', l_shipdate) as bucket, quantile_cont(cast(round(l_extendedprice * 100) as bigint), 0.5) m from lineitem join r on id = l_orderkey group by 1),
 g as (select date_trunc('month', gone_at) as bucket, avg(date_diff('second', listed_at, gone_at) / 86400.0) a from r group by 1)
 select bucket, coalesce(i.n, 0) inventory, round(m, 2) median_price, round(a, 4) days_to_gone from {BUCKETS} left join i using (bucket) left join h using (bucket) left join g using (bucket)""")
def dom18(spark, d):
    rows = listings(spark, d).withColumns({"gone_at": F.expr("timestampadd(day, cast(id % 200 as int), listed_at)"), "source_listed_at": F.col("listed_at")})
    history = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("listing_id"), F.col("l_shipdate").alias("recorded_at"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price_cents"))
    at = lambda s: F.lit(s).cast("timestamp")
    out = market.trends(rows, history, joins.spine(spark, "1993-01-01", "1996-12-01", "month"), "month", at("1993-01-01"), at("1996-12-01"))
    return out.select("bucket", "inventory", F.round("median_price", 2).alias("median_price"), F.round("days_to_gone", 4).alias("days_to_gone"))


@query("dom17_pricing", f"""with p as (select * from {LISTINGS} where price_cents is not null qualify row_number() over (partition by vehicle_id order by listed_at desc, id) = 1),
 s as (select count(*) total, quantile_cont(price_cents, 0.1) p10, quantile_cont(price_cents, 0.25) p25, quantile_cont(price_cents, 0.5) p50, quantile_cont(price_cents, 0.75) p75, quantile_cont(price_cents, 0.9) p90, quantile_cont(date_diff('second', listed_at, timestamp '1999-01-01') / 86400.0, 0.5) median_age_days from p),
 h as (select l_orderkey k, arg_min(cast(round(l_extendedprice * 100) as bigint), (l_shipdate, l_linenumber)) f, arg_max(cast(round(l_extendedprice * 100) as bigint), (l_shipdate, l_linenumber)) l from lineitem group by 1),
 r as (select count(distinct id) with_history, count(distinct case when f > l then id end) dropped from p join h on k = id)
 select total, round(p10, 2) p10, round(p25, 2) p25, round(p50, 2) p50, round(p75, 2) p75, round(p90, 2) p90, round(median_age_days, 4) median_age_days, with_history, dropped, round(dropped / with_history, 2) drop_rate from s, r""")
def dom17(spark, d):
    rows = listings(spark, d).where("price_cents is not null").withColumn("source_listed_at", F.col("listed_at"))  # also for the drop rate
    # a line's number may repeat in an order: then the row that comes first in the files counts
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    history = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("listing_id"), F.col("l_shipdate").alias("recorded_at"), F.col("l_linenumber").alias("seq"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price_cents"), *place)
    out = market.pricing(rows, history, F.lit("1999-01-01").cast("timestamp"), ["file", "row"])
    return out.select("total", *[F.round(p, 2).alias(p) for p in market.QUANTILES], F.round("median_age_days", 4).alias("median_age_days"), "with_history", "dropped", "drop_rate")

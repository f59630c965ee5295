"""Queries on merges, ledgers, concurrent writes and index upkeep, as batches over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import groups, merge
from lotwise.plans.registry import query
from lotwise.plans.standins import EVENTS, LISTINGS, events, listings, scratch, t
from lotwise.streaming import pipelines


@query("snk03_audit_rows", """select o_orderkey, case when o_orderkey % 5 = 0 and o_orderkey % 7 = 0 then '{"status":"' || o_orderstatus || '","note":"n"}' when o_orderkey % 5 = 0 then '{"status":"' || o_orderstatus || '"}' else '{"note":"n"}' end before,
 case when o_orderkey % 5 = 0 and o_orderkey % 7 = 0 then '{"status":"X","note":null}' when o_orderkey % 5 = 0 then '{"status":"X"}' else '{"note":null}' end after from orders where o_orderkey % 5 = 0 or o_orderkey % 7 = 0""")
def snk03(spark, d):
    old = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit("n").alias("note"))
    k = F.col("o_orderkey")
    new = old.withColumns({"status": F.when(k % 5 == 0, "X").otherwise(F.col("status")), "note": F.when(k % 7 > 0, "n")})
    return merge.audit_rows(old, new, ["o_orderkey"], ["status", "note"])


@query("snk05_swap", "select o_orderkey, 2 v from orders where o_orderstatus = 'F'")
def snk05(spark, d):
    """Two versions written; the second stands, a third whose count is wrong does not, and the first is cleaned up."""
    root = scratch(spark, "catalog")
    o = t(spark, d, "orders")
    for v, status in ((1, "O"), (2, "F")):
        rows = o.where(F.col("o_orderstatus") == status).select("o_orderkey", F.lit(v).alias("v"))
        merge.swap_in(rows, root, f"v{v}", rows.count())
    try:
        merge.swap_in(o.select("o_orderkey", F.lit(3).alias("v")), root, "v3", -1)
    except ValueError:
        merge.clean_up(spark, root)
    return merge.current(spark, root).select("o_orderkey", "v")


@query("stm04_apply_once", f"select user_id, cast(sum(k) as bigint) total from {EVENTS} where day(ts) % 2 = 1 group by 1")
def stm04(spark, d):
    """Runs are days, sent twice; the ledger holds the even ones already."""
    e = events(spark, d).select(F.dayofmonth("ts").alias("run_id"), "event_id", "user_id", "k")
    ledger = e.where("run_id % 2 = 0").select("run_id").distinct()
    fresh = merge.apply_once(ledger, e.unionByName(e), ["run_id"], ["event_id"])
    return fresh.groupBy("user_id").agg(F.sum("k").alias("total"))


@query("stm06_exactly_once",
    f"select user_id, date_trunc('hour', ts) scraped_at, arg_min(k, event_id) k from {EVENTS} where (user_id, date_trunc('hour',"
    f" ts)) not in (select (user_id, date_trunc('hour', ts)) from {EVENTS} where event_type = 'error') group by 1, 2"
)
def stm06(spark, d):
    e = events(spark, d).select("user_id", F.date_trunc("hour", "ts").alias("scraped_at"), "event_id", "k", "event_type")
    fresh = merge.append_new(e.where("event_type = 'error'"), e, ["user_id", "scraped_at"], ["event_id"])
    return fresh.select("user_id", "scraped_at", "k")


@query("stm11_guarded_update",
    f"select id, case when id % 9 > 0 and id % 14 > 0 then 'written' else 'skipped-stale' end outcome from {LISTINGS} where id % 2 = 0 union all"
    f" select -id, 'skipped-stale' from {LISTINGS} where id % 50 = 1"
)
def stm11(spark, d):
    rows = listings(spark, d)
    hidden = F.when(F.col("id") % 14 == 0, F.col("listed_at"))
    now = rows.select("id", F.when(F.col("id") % 9 == 0, 2).otherwise(1).alias("version"), hidden.alias("hidden_at"))
    made = rows.where("id % 2 = 0").select("id").unionByName(rows.where("id % 50 = 1").select((-F.col("id")).alias("id")))
    return merge.guarded_update(now, made.withColumn("version", F.lit(1)), "id", "version", "hidden_at").select("id", "outcome")


@query("stm15_claim_log",
    f"select event_id from (select *, lag(v) over w p, row_number() over w n from (select event_id, user_id, event_type, ts, k % 3 v"
    f" from {EVENTS}) window w as (partition by user_id, event_type order by ts, event_id)) where n = 1 or p <> v"
)
def stm15(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type", "ts", (F.col("k") % 3).alias("v"))
    return groups.changed(e, ["user_id", "event_type"], ["ts", "event_id"], ["v"]).select("event_id")


@query("stm17_orphan_catalog", f"""with l as (select vehicle_id % 97 catalog, count(*) filter (where status = 'P' and price_cents > 30000000) public from {LISTINGS} group by 1), i as (select p_partkey % 101 catalog, count(*) docs from part where p_partkey % 5 > 0 group by 1)
 select coalesce(l.catalog, i.catalog) catalog, coalesce(public, 0) public, coalesce(docs, 0) docs, coalesce(public, 0) = 0 and coalesce(docs, 0) > 0 rebuild from l full join i on i.catalog = l.catalog""")
def stm17(spark, d):
    rows = listings(spark, d).withColumn("catalog", F.col("vehicle_id") % 97)
    index = t(spark, d, "part").where("p_partkey % 5 > 0").select((F.col("p_partkey") % 101).alias("catalog"))
    return pipelines.orphaned(rows, (F.col("status") == "P") & (F.col("price_cents") > 30_000_000), index, "catalog")


@query("stm18_abandoned_runs", f"select event_id from {EVENTS} where event_type = 'view' and ts < timestamp '2024-01-20 10:00:00' and user_id % 3 = 1")
def stm18(spark, d):
    """Workers 0 live, workers 1 are known not to, and of workers 2 and of runs without a worker nothing is known."""
    runs = events(spark, d).select("event_id", F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), F.col("ts").alias("started_at"), F.when(F.col("user_id") % 6 != 3, F.col("user_id")).alias("worker"))
    live = runs.select("worker").where("worker % 3 < 2").distinct().withColumn("alive", F.col("worker") % 3 == 0)
    return pipelines.abandoned(runs, live, F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), 2).select("event_id")

"""Queries on incremental pipelines, as batches over the supplied tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lotwise.operators import merge, quality, scans
from lotwise.operators.groups import completeness, scored_representative
from lotwise.plans.registry import query
from lotwise.plans.standins import EVENTS, LISTINGS, events, listings
from lotwise.streaming import pipelines


@query("stm01_incremental", f"select event_id, ts from {EVENTS} where (ts, event_id) > (timestamp '2024-01-10 00:00:00', 0) order by ts, event_id limit 1000")
def stm01(spark, d):
    return pipelines.poll(events(spark, d).select("event_id", "ts"), ["ts", "event_id"], [dt.datetime(2024, 1, 10), 0], 500, 2)


@query("stm02_touched_groups", f"""with t as (select distinct vehicle_id from {LISTINGS} where id % 50 = 0), r as (select * from {LISTINGS} where status <> 'P' and vehicle_id in (select vehicle_id from t) qualify row_number() over (partition by vehicle_id order by (case when priority like '1%' then 1 else 0 end) desc, listed_at desc, id) = 1)
 select id, 'put' what from r union all select min(id), 'delete' from {LISTINGS} where vehicle_id in (select vehicle_id from t) group by vehicle_id having min(id) not in (select id from r)""")
def stm02(spark, d):
    rows = listings(spark, d).withColumns({"eligible": F.col("status") != "P", "first_class": F.when(F.startswith("priority", F.lit("1")), 1)})
    index = rows.groupBy("vehicle_id").agg(F.min("id").alias("id"))
    puts, deletes = pipelines.sync_groups(index, rows, rows.where("id % 50 = 0"), "vehicle_id", ["first_class"], "listed_at", "id")
    return puts.select("id", F.lit("put").alias("what")).unionByName(deletes.select("id", F.lit("delete").alias("what")))


@query("stm03_missing_state", f"""with e as (select 's' || cast(user_id % 3 as varchar) source, user_id record_key, cast(date_diff('day', timestamp '2024-01-01', date_trunc('day', ts)) as bigint) run_no, event_type from {EVENTS}),
 runs as (select distinct source, run_no, run_no % 4 <> 3 complete from e), seen as (select distinct source, record_key, run_no from e where event_type = 'error'), st as (select distinct source, record_key from e),
 ok as (select distinct r.source, r.run_no from runs r join seen s on r.source = s.source and r.run_no = s.run_no where complete),
 l as (select source, record_key, max(run_no) last_no from seen group by 1, 2),
 m as (select st.source, st.record_key, (select count(*) from ok where ok.source = st.source and ok.run_no > coalesce(last_no, -1)) + case when last_no is null then 1 else 0 end missing from st left join l on l.source = st.source and l.record_key = st.record_key)
 select source, record_key, missing, case when missing >= 6 then 'gone' when missing > 0 then 'possibly_gone' else 'active' end status from m""")
def stm03(spark, d):
    e = events(spark, d).select(F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source"), F.col("user_id").alias("record_key"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("bigint").alias("run_no"), "event_type")
    runs = e.select("source", "run_no").distinct().withColumns({"run_id": F.col("run_no"), "complete": F.col("run_no") % 4 != 3})
    seen = e.where("event_type = 'error'").select("source", "record_key", F.col("run_no").alias("run_id")).distinct()
    state = e.select("source", "record_key").distinct().withColumn("missing", F.lit(1))
    return merge.mark_missing(state, seen, runs, ["source", "record_key"])


@query("stm05_late", f"""with p as (select user_id, arg_max(k, (ts, event_id)) k, max(ts) m_at from {EVENTS} where event_type = 'view' group by 1) select u.user_id, coalesce(p.k, -1) as value, case when p.m_at is null or p.m_at < timestamp '2024-01-30 12:00:00' then timestamp '2024-01-30 12:00:00' end stale_at from (select distinct user_id from {EVENTS}) u left join p using (user_id)""")
def stm05(spark, d):
    e = events(spark, d)
    old = e.select("user_id").distinct().withColumns({"value": F.lit(-1).cast("bigint"), "stale_at": F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")})
    newest = e.where("event_type = 'view'").groupBy("user_id").agg(F.max_by("k", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("scraped_at"))
    return pipelines.apply_detail(old, newest, "user_id")


@query("stm09_drift", f"""with r as (select user_id % 5 source, date_trunc('day', ts) run, count(*) filter (where event_type = 'error') / count(*) rate, row_number() over (partition by user_id % 5 order by date_trunc('day', ts)) n from {EVENTS} group by 1, 2),
 w as (select a.source, a.run, a.rate, case when a.n > 1 then (select sum(b.rate * case when b.n = 1 then pow(0.8, a.n - 2) else 0.2 * pow(0.8, a.n - 1 - b.n) end) from r b where b.source = a.source and b.n < a.n) end base from r a)
 select source, run, round(base, 6) baseline, coalesce(rate - base > 0.05, false) drifted from w""")
def stm09(spark, d):
    r = events(spark, d).groupBy((F.col("user_id") % 5).alias("source"), F.date_trunc("day", "ts").alias("run")).agg((F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("rate"))
    return quality.drift(r, "source", "run", ["rate"], threshold=0.05).select("source", "run", F.round("rate_baseline", 6).alias("baseline"), "drifted")


@query("mth08_ewma",
    f"with v as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) n, count(*) over (partition by user_id) m"
    f" from {EVENTS}) select user_id, round(sum(value * case when n = 1 then pow(0.8, m - 1) else 0.2 * pow(0.8, m - n) end), 4) mean from v"
    f" group by user_id"
)
def mth08(spark, d):
    e = scans.smoothed(events(spark, d).select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], ["value"])
    return e.groupBy("user_id").agg(F.round(F.max_by("value_after", F.struct("ts", "event_id")), 4).alias("mean"))


@query("stm10_circuit_breaker", f"select user_id, count(*) >= 5 and count(*) filter (where event_type = 'error') / count(*) >= 0.2 stop from {EVENTS} group by user_id")
def stm10(spark, d):
    g = events(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    return g.select("user_id", quality.systemic(F.col("e"), F.col("n")).alias("stop"))


@query("stm13_ttl", f"select event_id from {EVENTS} where ts >= timestamp '2024-01-21'")
def stm13(spark, d):
    return merge.retained(events(spark, d), "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 10).select("event_id")


@query("win_tumbling", f"select date_trunc('hour', ts) \"start\", event_type, count(*) n from {EVENTS} group by 1, 2")
def tumbling(spark, d):
    return pipelines.windowed_counts(events(spark, d), "ts", ["event_type"], "1 hour")


@query("win_sliding",
    f"select s \"start\", event_type, count(*) n from (select event_type, unnest([date_trunc('hour', ts), date_trunc('hour',"
    f" ts) - interval 1 hour]) s from {EVENTS}) group by 1, 2"
)
def sliding(spark, d):
    return pipelines.windowed_counts(events(spark, d), "ts", ["event_type"], "2 hours", "1 hour")


@query("win_session",
    f"with g as (select user_id, ts, case when ts < lag(ts) over w + interval 30 minute then 0 else 1 end first"
    f" from {EVENTS} window w as (partition by user_id order by ts)), s as (select *, sum(first) over (partition by user_id"
    f" order by ts rows unbounded preceding) i from g) select min(ts) \"start\", max(ts) + interval 30 minute \"end\", user_id, count(*) n from s"
    f" group by user_id, i"
)
def session(spark, d):
    return pipelines.sessions(events(spark, d), "ts", "user_id")


@query("snk04_representatives_only",
    f"select id from {LISTINGS} where status <> 'P' qualify row_number() over (partition by vehicle_id order by (case when priority like '1%' then 1"
    f" else 0 end) desc, listed_at desc, id) = 1"
)
def snk04(spark, d):
    rows = listings(spark, d).where("status <> 'P'").withColumn("first_class", F.when(F.startswith("priority", F.lit("1")), 1))
    return scored_representative(rows, ["vehicle_id"], completeness(["first_class"]), "listed_at", "id").select("id")

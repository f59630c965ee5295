"""Functions of one row over values of the tables, with SQL that works each result out by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import canonical, numeric, text
from lotwise.operators import identity, projections
from lotwise.operators.merge import sale_transition
from lotwise.plans.registry import query
from lotwise.plans.standins import EVENTS, LISTINGS, PARTS, events, listings, parts, t
from lotwise.streaming.pipelines import crawl_decision


@query("mth07_bucket_prices", f"""select id, cast(cast(floor(price_cents / 100.0 / 5000) * 5000 as bigint) as varchar) || '-' || cast(cast(floor(price_cents / 100.0 / 5000) * 5000 as bigint) + 5000 as varchar) b,
 cast(floor(price_cents / 100.0 / 5000) * 5000 as bigint) low from {LISTINGS}""")
def mth07(spark, d):
    b = numeric.bucket(F.col("price_cents") / 100.0, 5000)
    return listings(spark, d).select("id", b.alias("b"), numeric.bucket_low(b).alias("low"))


@query("mth09_tolerance_of_sales", """select l_orderkey ok, l_linenumber ln, abs(cast(l_extendedprice as bigint) - cast(l_quantity * 2000 as bigint)) <= least(cast(l_extendedprice as bigint), cast(l_quantity * 2000 as bigint)) * 0.05 fine from lineitem""")
def mth09(spark, d):
    a, b = F.rint("l_extendedprice").cast("bigint"), F.rint(F.col("l_quantity") * 2000).cast("bigint")  # halves to the even number, as the SQL's cast
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), numeric.tolerance(a, b, 0.05).alias("fine"))


@query("set08_distinct_words", f"""with w as (select id, list_concat(words, string_split(model, ' '), words) w from {PARTS})
 select id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ',') codes from w""")
def set08(spark, d):
    codes = F.concat_ws(",", "words", F.split("model", " "), "words")
    return parts(spark, d).select("id", F.array_join(F.array_distinct(F.split(codes, ",")), ",").alias("codes"))


@query("arr03_seeded_words", f"""with w as (select id, list_filter(words, lambda x: length(x) > 5) images, string_split(model, ' ') cards from {PARTS})
 select id, array_to_string(case when len(images) > 0 then images else cards end, ',') shown from w""")
def arr03(spark, d):
    images = F.filter("words", lambda w: F.length(w) > 5)
    return parts(spark, d).select("id", F.array_join(projections.seeded(images, F.split("model", " ")), ",").alias("shown"))


PHOTO = (
    "(select vec_id id, case label % 3 when 0 then 'vehicle_photo' when 1 then 'site_chrome' else 'placeholder' end kind, case vec_id % 3"
    " when 0 then true when 1 then false end ph, case vec_id % 5 when 0 then true when 1 then false end crossed, case"
    " when vec_id % 4 > 0 then vec_id % 4 end version from embeddings)"
)


@query("dom12_photos", f"""select id, kind = 'vehicle_photo' and not coalesce(crossed, false) hero, kind = 'vehicle_photo' and not coalesce(ph, false) and not coalesce(crossed, false) and (version is null or version < 2) due from {PHOTO}""")
def dom12(spark, d):
    v, of = F.col("vec_id"), F.col("label") % 3
    yes_no = lambda n: F.when(v % n == 0, True).when(v % n == 1, False)
    kind = F.when(of == 0, "vehicle_photo").when(of == 1, "site_chrome").otherwise("placeholder")
    e = t(spark, d, "embeddings").select(v.alias("id"), kind.alias("kind"), yes_no(3).alias("ph"), yes_no(5).alias("crossed"), F.when(v % 4 > 0, v % 4).alias("version"))
    c = F.col
    return e.select("id", identity.hero_eligible(c("kind"), c("crossed")).alias("hero"), identity.analysis_due(c("kind"), c("ph"), c("crossed"), c("version"), 2).alias("due"))


@query("stm14_crawls", f"""with h as (select event_id, k % 3 now, case when user_id % 5 > 0 then lag(k % 3) over (partition by user_id order by ts, event_id) end before, case when user_id % 7 > 0 then ts end last from {EVENTS})
 select event_id, case when before is null or now <> before then 'changed' when last is null or last < timestamp '2024-01-15 12:00:00' - interval 24 hour then 'overdue' else 'skip' end decision from h""")
def stm14(spark, d):
    from pyspark.sql import Window

    before = F.lag(F.col("k") % 3).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = events(spark, d).withColumn("before", F.when(F.col("user_id") % 5 > 0, before)).withColumn("last", F.when(F.col("user_id") % 7 > 0, F.col("ts")))
    return e.select("event_id", crawl_decision(F.col("k") % 3, F.col("before"), F.col("last"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).alias("decision"))


SALES = (
    f"(select id, case id % 3 when 0 then 'active' when 1 then 'possibly_gone' else 'gone' end st, case vehicle_id % 4 when 0 then 'sold'"
    f" when 1 then 'gone' when 2 then 'pending' else 'active' end sale, case when id % 5 = 0 then listed_at end sold, vehicle_id % 2 missing"
    f" from {LISTINGS})"
)


@query("stm08_sales", f"""select id, case when sale in ('sold', 'gone') and st <> 'gone' then 'gone' when st = 'possibly_gone' and sale in ('pending', 'active') and missing = 0 then 'active' else st end status,
 case when sale in ('sold', 'gone') and st <> 'gone' then 'set' when st = 'possibly_gone' and sale in ('pending', 'active') and missing = 0 then 'cleared' else 'kept' end gone_mark,
 case when sale = 'sold' and st <> 'gone' then coalesce(sold, timestamp '2002-01-01') else sold end sold_at from {SALES}""")
def stm08(spark, d):
    i, v = F.col("id"), F.col("vehicle_id")
    of = lambda x, n, names: F.element_at(F.array(*map(F.lit, names)), (x % n + 1).cast("int"))
    now = F.lit("2002-01-01").cast("timestamp_ntz")
    out = sale_transition(of(i, 3, ["active", "possibly_gone", "gone"]), of(v, 4, ["sold", "gone", "pending", "active"]), F.when(i % 5 == 0, F.col("listed_at")), now, v % 2)
    return listings(spark, d).select("id", out.alias("o")).select("id", "o.status", F.col("o.gone_at").alias("gone_mark"), "o.sold_at")


@query("dom10_reviews", f"""with r as (select id, case id % 4 when 0 then 'candidate' when 1 then 'verified' when 2 then 'rejected' else 'split' end st, case vehicle_id % 5 when 0 then 'approve' when 1 then 'reject' when 2 then 'split' when 3 then 'undo' else 'other' end act,
  case when id % 3 = 0 then 'v' || vehicle_id end v, case when vehicle_id % 3 = 0 then 'a' || id end av from {LISTINGS}),
 n as (select *, case act when 'approve' then 'verified' when 'reject' then 'rejected' when 'split' then case when st in ('verified', 'split') then 'split' end when 'undo' then case st when 'split' then 'candidate' else st end end nxt from r)
 select id, nxt "next", case when nxt = 'verified' then coalesce(v, av, 'new:' || id) end vehicle from n""")
def dom10(spark, d):
    i, v = F.col("id"), F.col("vehicle_id")
    of = lambda x, n, names: F.element_at(F.array(*map(F.lit, names)), (x % n + 1).cast("int"))
    nxt = identity.decide(of(i, 4, ["candidate", "verified", "rejected", "split"]), of(v, 5, ["approve", "reject", "split", "undo", "other"]))
    text_of = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    vehicle = identity.decided_vehicle(nxt, F.when(i % 3 == 0, text_of("v", v)), F.when(v % 3 == 0, text_of("a", i)), F.lit(None).cast("string"), i)
    return listings(spark, d).select("id", nxt.alias("next"), vehicle.alias("vehicle"))


@query("jsn02_part_signals", f"""select id, case when size > 40 then '{{"score":0,"signals":[]}}' else '{{"score":' || (size + length(make)) || ',"signals":[{{"id":"size","weight":' || size || '}},{{"id":"' || lower(make) || '","weight":' || length(make) || '}}]}}' end j from {PARTS}""")
def jsn02(spark, d):
    signal = lambda name, weight: F.struct(name.alias("id"), weight.cast("int").alias("weight"))
    both = F.array(signal(F.lit("size"), F.col("size")), signal(F.lower("make"), F.length("make")))
    return parts(spark, d).select("id", projections.signals_json(F.when(F.col("size") > 40, F.slice(both, 1, 0)).otherwise(both)).alias("j"))


@query("str11_vins_of_parts", f"select id, upper(replace(replace(make, '#', ''), ' ', '')) || upper(replace(model, ' ', '')) || id v from {PARTS}")
def str11(spark, d):
    raw = F.concat(F.lit("  "), F.lower("make"), F.lit(" - "), F.col("model"), F.lit("./"), F.col("id").cast("string"), F.lit(" "))
    return parts(spark, d).select("id", numeric.vin_normal(raw).alias("v"))


@query("str12_vins_of_digests", """with v as (select doc_id, translate(upper(left(sha256(text), 15 + doc_id % 4)), '0', case doc_id % 5 when 0 then 'I' when 1 then 'O' when 2 then 'Q' else 'Z' end) v from documents)
 select doc_id, length(v) = 17 and not contains(v, 'I') and not contains(v, 'O') and not contains(v, 'Q') fine from v""")
def str12(spark, d):
    k = F.col("doc_id")
    zero = F.when(k % 5 == 0, "I").when(k % 5 == 1, "O").when(k % 5 == 2, "Q").otherwise("Z")
    v = F.replace(F.upper(F.left(F.sha2("text", 256), (15 + k % 4).cast("int"))), F.lit("0"), zero)
    return t(spark, d, "documents").select("doc_id", numeric.vin_valid(v).alias("fine"))


@query("str38_classes_of_parts", f"""select id, case when size % 3 > 0 then lower(replace(make, '#', '-')) else '' end make, case when size % 2 = 0 then words[1] else '' end ramp from {PARTS}""")
def str38(spark, d):
    size, make = F.col("size"), F.lower(F.replace("make", F.lit("#"), F.lit("-")))
    classes = F.concat_ws(" ", F.lit("card remake-x"), F.when(size % 2 == 0, F.concat(F.lit(" ramp-type-"), F.get("words", F.lit(0)))), F.when(size % 3 > 0, F.concat(F.lit("make-"), make, F.lit("\tmake-other"))))
    return parts(spark, d).select("id", text.class_token(classes, "make-").alias("make"), text.class_token(classes, "ramp-type-").alias("ramp"))


@query("str43_keys_of_pages", """select page_id, case when page_id % 4 = 0 then 'e' || page_id when page_id % 4 = 1 then 's' || page_id when page_id % 4 = 2 then 'v' || page_id else rtrim(regexp_extract(url, '^([^?#]*)', 1), '/') end k from pages""")
def str43(spark, d):
    k = F.col("page_id")
    name = lambda p: F.concat(F.lit(p), k.cast("string"))
    key = canonical.record_key(F.when(k % 4 == 0, name("e")).otherwise(" "), F.when(k % 4 == 1, name(" s")), F.when(k % 4 == 2, name("v")), F.col("url"))
    return t(spark, d, "pages").select("page_id", key.alias("k"))


@query("str29_remedies", f"""with r as (select id, case size % 4 when 0 then '  ' when 1 then ' UNKNOWN ' when 2 then title end remedy from {PARTS})
 select id, case when remedy is null or trim(remedy) = '' then 'open' when lower(trim(remedy)) = 'unknown' then 'unknown' else 'remedied' end listing, case when remedy is null or trim(remedy) = '' then 'open' else 'remedied' end vin from r""")
def str29(spark, d):
    of = F.col("size") % 4
    remedy = F.when(of == 0, "  ").when(of == 1, " UNKNOWN ").when(of == 2, F.col("title"))
    return parts(spark, d).select("id", canonical.recall_status(remedy, True).alias("listing"), canonical.recall_status(remedy, False).alias("vin"))


@query("dat06_dates_of_listings", f"""select id, case id % 4 when 0 then date_trunc('day', listed_at) when 1 then date_trunc('day', listed_at) + interval 10 hour when 2 then date_trunc('day', listed_at) - interval 2 hour end moment from {LISTINGS}""")
def dat06(spark, d):
    day, of = F.date_format("listed_at", "yyyy-MM-dd"), F.col("id") % 4
    raw = F.when(of == 0, day).when(of == 1, F.concat(day, F.lit("T10:00:00Z"))).when(of == 2, F.concat(day, F.lit("T00:00:00+02:00"))).otherwise(F.concat(day, F.lit("-99")))
    return listings(spark, d).select("id", numeric.iso_date(raw).cast("timestamp_ntz").alias("moment"))


@query("str32_dealers_of_pages", """select page_id, case when page_id % 3 = 0 then 'profile:p' || page_id when page_id % 3 = 1 then 'host:' || lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) when page_id % 2 = 0 then 'name:dealer ' || page_id end k from pages""")
def str32(spark, d):
    k = F.col("page_id")
    rows = t(spark, d, "pages").select(
        "page_id", F.when(k % 3 == 0, F.concat(F.lit("p"), k.cast("string"))).otherwise("").alias("x_dealer_profile_id"), F.when(k % 3 < 2, F.col("url")).alias("x_dealer_website"),
        F.when(k % 2 == 0, F.concat(F.lit(" Dealer "), k.cast("string"))).otherwise(" ").alias("x_dealer_name"),
    )
    return rows.select("page_id", identity.dealer_key("x").alias("k"))


@query("str35_vins_in_texts", """with x as (select doc_id, left(upper(sha256(text)), 17) v, doc_id % 3 k from documents where text is not null)
 select doc_id, case k when 0 then 'see [VIN].' when 1 then 'see ' || v || 'x' else 'see IO' || left(v, 15) end c from x""")
def str35(spark, d):
    v, of = F.upper(F.left(F.sha2("text", 256), F.lit(17))), F.col("doc_id") % 3
    c = F.when(of == 0, F.concat(F.lit("see "), v, F.lit("."))).when(of == 1, F.concat(F.lit("see "), v, F.lit("x"))).otherwise(F.concat(F.lit("see IO"), F.left(v, F.lit(15))))
    return t(spark, d, "documents").where("text is not null").select("doc_id", text.scrub_vin(c).alias("c"))


@query("flt06_cities_of_nations", """select n_nationkey k, case when n_nationkey % 3 = 0 then n_name else lower(n_name) || ' city|TX' end v from nation""")
def flt06(spark, d):
    from lotwise.operators.filters import city_pair

    raw = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.concat(F.lit("  "), F.col("n_name"), F.lit("   City |tx")))
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), city_pair(raw).alias("v"))

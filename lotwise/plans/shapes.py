"""Queries on projections, filters, sorts, sets, dates, numbers and reports that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import canonical
from lotwise.operators import facets, filters, groups, identity, joins, market, projections, quality, reports
from lotwise.plans.golden import golden, picked, picked_sql
from lotwise.plans.registry import query
from lotwise.plans.standins import EVENTS, LISTINGS, PARTS, events, listings, parts, t

MAKES, COLORS, FUELS, ENGINES = ["FORD", "toyota", "rolls-royce"], ["Oxford White", "Celestial Silver Metallic", "n/a", None], ["Gas", "3.5L V6", None], ["Diesel", None]
CONVERTERS, GEARS, CITIES, CHAIRS = ["Braun", "AMS Vans", "Wheelchair", None, "ats"], ["8-Speed Automatic", "CVT", None], ["San  Antonio", "a|b", None], [0, 1, 6, 7, None]


def _rows(spark, d):
    """Parts as rows of the listing table, with the raw values of several sources."""
    i = F.col("id")
    return parts(spark, d).select(
        "id", F.when(i % 3 > 0, i % 100).alias("vehicle_id"), F.concat(F.lit("s"), (i % 2).cast("string")).alias("source_id"), picked(MAKES, "string").alias("make"), F.lit("town & country").alias("model"),
        F.lit("LX").alias("trim"), (2000 + F.col("size")).alias("year"), picked(COLORS, "string").alias("color"), picked(FUELS, "string").alias("fuel_type"), picked(ENGINES, "string").alias("engine"),
        picked(GEARS, "string").alias("transmission"), picked(CITIES, "string").alias("city"), F.lit("tx").alias("state"), F.when(i % 7 > 0, F.col("price_cents") * 40).alias("price_cents"), (F.col("size") * 2500).alias("mileage"),
        picked(CONVERTERS, "string").alias("conversion_manufacturer"), picked(CHAIRS, "int").alias("wheelchair_capacity"), F.when(i % 4 == 0, "private").otherwise("dealer").alias("seller_type"), F.lit("Dealer").alias("dealer_name"),
        F.lit("212-555-0100").alias("dealer_phone"), F.lit("used").alias("condition"), F.lit("rear_entry").alias("conversion_type"), F.lit("none").alias("ramp_type"), F.array_distinct("words").alias("wav_features"),
    )


def _bucket(value: str, width: int) -> str:
    low = f"cast(floor({value} / {width}) * {width} as bigint)"
    return f"cast({low} as varchar) || '-' || cast({low} + {width} as varchar)"


DOCUMENT = f"""(select id, case when id % 3 > 0 then id % 100 end vehicle_id, case when id % 3 > 0 then id % 100 else id end vehicle_group_key, 's' || (id % 2) source_id, {picked_sql(["Ford", "Toyota", "Rolls-royce"], "string")} make, 'Town & Country' model,
 {picked_sql(["White", "Celestial silver", None, None], "string")} color, case when id % 3 = 0 then 'gasoline' when id % 2 = 0 then 'diesel' end fuel_type, {picked_sql(["automatic", "cvt", None], "string")} transmission,
 {picked_sql(["san antonio|TX", None, None], "string")} city_state, case when id % 7 > 0 then {_bucket("(price_cents * 40 / 100.0)", 5000)} end price_bucket, {_bucket("(size * 2500.0)", 12000)} mileage_bucket,
 {picked_sql(["Braun", "AMS Vans", None, None, "ats"], "string")} conversion_manufacturer, {picked_sql(["braunability", "ams-vans", None, None, "atc"], "string")} conversion_brand, {picked_sql([None, 1, 6, None, None], "int")} wheelchair_capacity,
 case when id % 4 = 0 then 'For Sale By Owner' else 'Dealer' end dealer_name, case when id % 4 > 0 then '212-555-0100' end dealer_phone, case when id % 4 = 0 then 'private' else 'dealer' end seller_type, 2000 + size as "year", words from {PARTS})"""
SHOWN = ["vehicle_group_key", "make", "model", "color", "fuel_type", "transmission", "city_state", "price_bucket", "mileage_bucket", "conversion_manufacturer", "conversion_brand", "wheelchair_capacity", "dealer_name", "dealer_phone"]


@query("prj01_search_documents", f"select id, {', '.join(SHOWN)} from {DOCUMENT}")
def prj01(spark, d):
    return projections.search_document(_rows(spark, d)).select("id", *SHOWN)


@query("prj05_facet_documents", f"""select id, source_id, vehicle_id, make, model, 'LX' trim_name, "year", price_bucket, mileage_bucket, 'tx' state, 'used' as "condition", 'rear_entry' conversion_type, color, 'none' ramp_type, seller_type, conversion_brand,
 array_to_string(list_sort(list_distinct(words)), ',') wav_features from {DOCUMENT}""")
def prj05(spark, d):
    doc = projections.facet_document(projections.search_document(_rows(spark, d)))
    return doc.withColumnRenamed("trim", "trim_name").withColumn("wav_features", F.array_join(F.array_sort("wav_features"), ","))


CLAIM = (
    f"(select event_id, user_id listing_id, event_type field, 's' || cast(k % 4 as varchar) source_ref, 'v' || cast(k % 7 as varchar) claimed_value,"
    f" case when k % 2 = 0 then 'photo' else 'specific_text' end evidence_kind, ts observed_at, k / 100.0 confidence, k % 9 > 0 eligible"
    f" from {EVENTS})"
)
SLOT = f"(select * from {CLAIM} qualify row_number() over (partition by listing_id, field, source_ref order by observed_at desc, event_id) = 1)"


def _claims(spark, d):
    k = F.col("k")
    return events(spark, d).select(
        "event_id", F.col("user_id").alias("listing_id"), F.col("event_type").alias("field"), F.concat(F.lit("s"), (k % 4).cast("string")).alias("source_ref"), F.concat(F.lit("v"), (k % 7).cast("string")).alias("claimed_value"),
        F.when(k % 2 == 0, "photo").otherwise("specific_text").alias("evidence_kind"), F.col("ts").alias("observed_at"), (k / 100.0).alias("confidence"), (k % 9 > 0).alias("eligible"),
    )


def _slots(spark, d):
    return groups.top_k(_claims(spark, d), ["listing_id", "field", "source_ref"], [F.desc("observed_at"), F.asc("event_id")])


@query("win08_latest_claims", f"select event_id, listing_id, field, source_ref from {SLOT}")
def win08(spark, d):
    return _slots(spark, d).select("event_id", "listing_id", "field", "source_ref")


@query("prj10_competing_claims", f"""select listing_id, field, array_to_string(array_agg(claimed_value order by source_ref), ',') competing_values, array_to_string(array_agg(evidence_kind order by source_ref), ',') evidence_kinds,
 array_to_string(array_agg(source_ref order by source_ref), ',') source_refs, max(observed_at) latest from {SLOT} group by 1, 2""")
def prj10(spark, d):
    out = projections.competing_claims(_slots(spark, d), ["listing_id", "field"], ["source_ref"])
    return out.select("listing_id", "field", *[F.array_join(c, ",").alias(c) for c in ("competing_values", "evidence_kinds", "source_refs")], F.array_max("observed_ats").alias("latest"))


@query("flt19_credible", f"select event_id from {CLAIM} where eligible and evidence_kind <> 'generic_text' and (evidence_kind <> 'photo' or confidence >= 0.7)")
def flt19(spark, d):
    return _claims(spark, d).where(filters.credible()).select("event_id")


READY = """detail_scraped_at is not null and detail_stale_at is null and quality_checked_at is not null and computed_at is not null and id % 5 > 0 and id % 7 > 0 and (vin is null or model_id is not null)"""
STATE = (
    f"(select id, case when id % 11 > 0 then 1 end detail_scraped_at, case when id % 13 = 0 then 1 end detail_stale_at, case"
    f" when id % 17 > 0 then 1 end quality_checked_at, case when id % 19 > 0 then 1 end computed_at, case when id % 2 = 0 then 'v' end vin, case"
    f" when id % 6 > 0 then 1 end model_id from {PARTS})"
)


def _states(spark, d):
    i, at = F.col("id"), F.lit("2024-01-01").cast("timestamp")
    some = lambda c, v=at: F.when(c, v)
    return parts(spark, d).select(
        "id", some(i % 11 > 0).alias("detail_scraped_at"), some(i % 13 == 0).alias("detail_stale_at"), F.when(i % 17 > 0, F.when(i % 23 == 0, F.lit("2023-12-31").cast("timestamp")).otherwise(at)).alias("quality_checked_at"),
        some(i % 19 > 0).alias("readiness_computed_at"), some(i % 5 > 0, F.array(F.lit("x"))).alias("pics"), some(i % 7 == 0, F.array(F.lit("no_images"))).alias("blocked"), F.when(i % 2 == 0, "v").alias("vin"),
        some(i % 6 > 0, F.lit("m")).alias("vehicle_model_id"), F.when(i % 29 > 0, "eligible").otherwise("quarantined").alias("publication_status"), F.when(i % 4 == 0, "unknown").otherwise("side_entry").alias("conversion_type"),
        F.when(i % 3 > 0, "Austin").when(i % 9 > 0, "").alias("city"),
    ).withColumns({"images": F.coalesce("pics", F.array().cast("array<string>")), "readiness_blockers": F.coalesce("blocked", F.array().cast("array<string>"))})


@query("flt02_strictly_ready", f"select id from {STATE} where {READY}")
def flt02(spark, d):
    return _states(spark, d).where(filters.strictly_ready()).select("id")


@query("dom04_readiness", f"""select id, b = '' ready, b blockers, w warnings from (select id,
 concat_ws(',', case when id % 11 = 0 then 'detail_not_crawled' when id % 13 = 0 then 'detail_stale' end, case when id % 11 = 0 or id % 17 = 0 or id % 23 = 0 or id % 29 = 0 then 'not_validated_after_detail' end,
 case when id % 5 = 0 then 'no_images' end, case when id % 2 = 0 and id % 6 = 0 then 'vin_not_decoded' end, case when id % 4 = 0 then 'conversion_type_unresolved' end) b,
 concat_ws(',', case when id % 2 > 0 then 'no_vin' end, case when id % 4 = 0 then 'conversion_type_unknown' end, case when id % 3 = 0 then 'no_city' end) w from {PARTS})""")
def dom04(spark, d):
    r = _states(spark, d).withColumn("r", quality.readiness())
    return r.select("id", "r.ready", F.array_join("r.blockers", ",").alias("blockers"), F.array_join("r.warnings", ",").alias("warnings"))


@query("flt08_optional_parameters", f"select id from {PARTS} where make = 'Brand#3' and size >= 5")
def flt08(spark, d):
    """Parameters that are not given say nothing."""
    given = filters.Search(any_of={"make": ["Brand#3"], "model": []}, any_in_array={"words": []}, ranges={"size": (5, None), "price_cents": (None, None)})
    return parts(spark, d).where(given.conditions()).select("id")


@query("flt10_array_contains", f"select id, list_contains(words, 'blue') one, list_has_any(words, ['blue', 'ring', 'bolt']) any_of from {PARTS}")
def flt10(spark, d):
    either = filters.Search(any_in_array={"words": ["blue", "ring", "bolt"]}).conditions()
    return parts(spark, d).select("id", F.array_contains("words", "blue").alias("one"), either.alias("any_of"))


@query("flt14_in_ignoring_case", f"select id, model from {PARTS} where lower(model) in ('economy', 'promo')")
def flt14(spark, d):
    return parts(spark, d).where(filters.one_of(F.col("model"), ["Economy", "PROMO"])).select("id", "model")


@query("flt20_analysis_due", """with c as (select label, count(*) > 50 placeholder, label % 4 = 1 cross_vehicle from embeddings where label <> 9 group by label)
 select e.vec_id from embeddings e left join c using (label) where e.vec_id % 5 > 0 and not coalesce(c.placeholder, false) and not coalesce(c.cross_vehicle, false) and (e.vec_id % 3 = 0 or e.vec_id % 3 < 2)""")
def flt20(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "label")
    n = e.where("label <> 9").groupBy("label").agg((F.count(F.lit(1)) > 50).alias("placeholder")).withColumn("cross_vehicle", F.col("label") % 4 == 1)
    kind = F.when(F.col("vec_id") % 5 > 0, "vehicle_photo").otherwise("site_chrome")
    version = F.when(F.col("vec_id") % 3 > 0, (F.col("vec_id") % 3).cast("int"))
    return e.join(n, "label", "left").where(identity.analysis_due(kind, F.col("placeholder"), F.col("cross_vehicle"), version, 2)).select("vec_id")


@query("flt24_dynamic_where", f"""select id, make, size from {PARTS} where make in ('Brand#1', 'Brand#2') and list_has_any(words, ['blue', 'ring']) and size <= 40 and price_cents >= 90100 order by price_cents desc, id limit 1 offset 1""")
def flt24(spark, d):
    s = filters.Search(any_of={"make": ["Brand#1", "Brand#2"]}, any_in_array={"words": ["blue", "ring"]}, ranges={"size": (None, 40), "price_cents": (90_100, None)}, sort="price_cents:desc", page=2, per_page=1)
    return filters.search(parts(spark, d), s, "id").select("id", "make", "size")


@query("jon01_listings_sources",
    "select o_orderkey, n_name, r_name from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey"
    " join region on r_regionkey = n_regionkey"
)
def jon01(spark, d):
    return listings(spark, d).select(F.col("id").alias("o_orderkey"), F.col("nation").alias("n_name"), F.col("source").alias("r_name"))


SPAN = "(select unnest(generate_series(timestamp '1995-01-01', timestamp '2001-12-01', interval 1 month)) as bucket)"


@query("jon06_gone_in_bucket", f"""select bucket, count(id) n, round(avg(mean_days), 6) mean_days from {SPAN} left join (select id, listed_at + interval 1 day * (id % 90) gone_at, cast(id % 90 as double) mean_days from {LISTINGS} where id % 3 = 0)
 on gone_at >= bucket and gone_at < bucket + interval 1 month group by 1""")
def jon06(spark, d):
    """A range join on aligned buckets is an equality on the bucket that a time falls in."""
    gone = listings(spark, d).where("id % 3 = 0").withColumn("gone_at", F.expr("timestampadd(day, cast(id % 90 as int), listed_at)"))
    from lotwise.functions.numeric import days_between

    n = gone.groupBy(F.date_trunc("month", "gone_at").alias("bucket")).agg(F.count("id").alias("n"), F.round(F.avg(days_between(F.col("gone_at"), F.col("listed_at"))), 6).alias("mean_days"))
    return joins.spine(spark, "1995-01-01", "2001-12-01", "month").join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "mean_days")


@query("jon07_one_row_cross",
    f"with q as (select max(price_cents) most, count(*) total from {LISTINGS}) select id, round(price_cents / most, 9) share, total from {LISTINGS},"
    f" q"
)
def jon07(spark, d):
    rows = listings(spark, d).select("id", "price_cents")
    one = rows.agg(F.max("price_cents").alias("most"), F.count(F.lit(1)).alias("total"))
    return rows.crossJoin(F.broadcast(one)).select("id", F.round(F.col("price_cents") / F.col("most"), 9).alias("share"), "total")  # one row


@query("jon11_not_researched",
    f"with m as (select distinct make, model, size from {PARTS}), r as (select make, model, size, max(id % 3) version from {PARTS} where id % 2 = 0"
    f" group by all) select m.* from m left join r using (make, model, size) where r.version is null or r.version < 2"
)
def jon11(spark, d):
    """Models without research at the current version."""
    p, key = parts(spark, d), ["make", "model", "size"]
    done = p.where("id % 2 = 0").groupBy(*key).agg(F.max(F.col("id") % 3).alias("version")).where("version >= 2")
    return p.select(*key).distinct().join(done, key, "left_anti")


@query("jon18_any_without_tls", f"select id, len(list_filter(words, lambda w: length(w) % 2 = 0)) > 0 drops from {PARTS}")
def jon18(spark, d):
    images = F.transform("words", lambda w: F.concat(F.when(F.length(w) % 2 == 0, "http://x/").otherwise("HTTPS://x/"), w))
    return parts(spark, d).select("id", (~projections.all_https(images)).alias("drops"))


@query("jon20_year_fallback",
    f"with m as (select make, size as \"year\", min(id) model_id from {PARTS} where size % 2 = 0 group by 1, 2), f as (select make, min(id) model_id"
    f" from {PARTS} where make <> 'Brand#1' group by 1) select p.id, coalesce(m.model_id, f.model_id) model_id, case"
    f" when m.model_id is not null then 'exact' when f.model_id is not null then 'fallback' else 'none' end as match from {PARTS} p left"
    f" join m on m.make = p.make and m.\"year\" = p.size left join f on f.make = p.make"
)
def jon20(spark, d):
    p = parts(spark, d).select("id", "make", F.col("size").alias("year"))
    table = p.where("year % 2 = 0").groupBy("make", "year").agg(F.min("id").alias("model_id"))
    loose = p.where("make <> 'Brand#1'").groupBy("make").agg(F.min("id").alias("model_id")).withColumn("year", F.lit(None).cast("int"))
    return joins.with_fallback(p, table.unionByName(loose), ["make", "year"], ["make"], "model_id").select("id", "model_id", "match")


@query("jon21_alias_join", f"""with a as (select * from (values {', '.join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in canonical.MODELS.items())}) v(alias, name)),
 r as (select id, ['Sienna', 't-350', 'TOWN AND COUNTRY', 'Leaf', 'promaster'][cast(id % 5 as integer) + 1] raw from {PARTS}) select id, coalesce(name, raw) model from r left join a on alias = upper(raw)""")
def jon21(spark, d):
    """The alias table as a table, for tables too long for an expression; this one has as many rows as there are aliases."""
    alias = spark.createDataFrame([*canonical.MODELS.items()], "alias string, name string")
    raw = parts(spark, d).select("id", picked(["Sienna", "t-350", "TOWN AND COUNTRY", "Leaf", "promaster"], "string").alias("raw"))
    return raw.join(alias, F.upper("raw") == F.col("alias"), "left").select("id", F.coalesce("name", "raw").alias("model"))


Q = ", ".join(f"round(quantile_cont(price_cents, {q}), 4) {n}" for n, q in market.QUANTILES.items())


@query("agg04_percentiles", f"select source, segment, {Q} from {LISTINGS} group by 1, 2")
def agg04(spark, d):
    g = market.percentiles(listings(spark, d), ["source", "segment"], "price_cents")
    return g.select("source", "segment", *[F.round(n, 4).alias(n) for n in market.QUANTILES])


@query("agg22_known_rate", f"""with f as (select source, unnest(['status', 'priority']) field, unnest([status <> 'P', priority not like '4%']) known from {LISTINGS})
 select field, source, count(*) total, count(*) filter (where known) known, round(count(*) filter (where known) / count(*), 9) rate from f group by 1, 2
 union all select field, 'global', count(*), count(*) filter (where known), round(count(*) filter (where known) / count(*), 9) from f group by 1""")
def agg22(spark, d):
    out = facets.coverage(listings(spark, d), {"status": F.col("status") != "P", "priority": ~F.startswith("priority", F.lit("4"))}, "source")
    return out.withColumn("rate", F.round("rate", 9))


@query("agg24_cluster_rollup", """with i as (select vec_id id, label "cluster", vec_id % (label + 2) listing_id, vec_id % 3 source_id, case when label % 3 = 0 then 7 when label % 3 = 1 and vec_id % 2 = 0 then vec_id % (label + 1) end vehicle_id, case when label % 3 = 1 then 'V' || (vec_id % 2) end vin from embeddings),
 g as (select "cluster", count(*) images, count(distinct listing_id) l, count(distinct source_id) s, count(distinct coalesce('v:' || vehicle_id, 'vin:' || vin)) v from i group by 1)
 select "cluster", images, l listings, s sources, v vehicles, v > 1 cross_vehicle, l > 5 placeholder,
 case when l > 5 and v > 1 then 'reused across ' || l || ' listings and ' || v || ' vehicle groups from ' || s || ' sources' when l > 5 then 'reused across ' || l || ' listings from ' || s || ' sources'
 when v > 1 then 'spans ' || v || ' vehicle groups — ineligible as vehicle-specific evidence' end reason, case when v = 0 then 'no_vehicle_context' when v > 1 then 'cross_vehicle' else 'same_vehicle' end reuse from g""")
def agg24(spark, d):
    e, i = t(spark, d, "embeddings"), F.col("vec_id")
    vehicle = F.when(F.col("label") % 3 == 0, 7).when((F.col("label") % 3 == 1) & (i % 2 == 0), i % (F.col("label") + 1))
    images = e.select(i.alias("id"), (i % (F.col("label") + 2)).alias("listing_id"), (i % 3).alias("source_id"), vehicle.alias("vehicle_id"), F.when(F.col("label") % 3 == 1, F.concat(F.lit("V"), (i % 2).cast("string"))).alias("vin"))
    clusters = e.select(i.alias("id"), F.col("label").alias("cluster"), F.lit("exact").alias("kind"))
    return identity.cluster_report(images, clusters).drop("kind")


@query("win07_completeness", f"select id, (case when id % 3 > 0 then 1 else 0 end) + (case when id % 4 < 3 then 1 else 0 end) + 1 + len(words) score from {PARTS}")
def win07(spark, d):
    rows = parts(spark, d).withColumns({"a": F.when(F.col("id") % 3 > 0, "x"), "b": F.when(F.col("id") % 4 < 3, 1), "c": F.lit(""), "n": F.lit(None).cast("string")})
    return rows.select("id", groups.completeness(["a", "b", "c", "n"], "words").alias("score"))


@query("srt01_limit_offset", f"select id, listed_at from {LISTINGS} order by listed_at desc, id limit 40 offset 60")
def srt01(spark, d):
    return filters.search(listings(spark, d), filters.Search(sort="listed_at:desc", page=4, per_page=20), "id").unionByName(
        filters.search(listings(spark, d), filters.Search(sort="listed_at:desc", page=5, per_page=20), "id")
    ).select("id", "listed_at")


@query("srt02_field_direction",
    f"(select 'price' by_field, id from {LISTINGS} order by price_cents, id limit 30) union all (select 'listed', id from {LISTINGS}"
    f" order by listed_at desc, id limit 30)"
)
def srt02(spark, d):
    def page(name: str, sort: str):
        return filters.search(listings(spark, d), filters.Search(sort=sort, per_page=30), "id").select(F.lit(name).alias("by_field"), "id")

    return page("price", "price_cents:asc").unionByName(page("listed", "listed_at:desc"))


@query("srt04_seek_page", f"select id, price_cents from {LISTINGS} where (price_cents, id) > (20000000, 5) order by price_cents, id limit 100")
def srt04(spark, d):
    rows = listings(spark, d).select("id", "price_cents")
    return rows.where(filters.after(["price_cents", "id"], [20_000_000, 5])).orderBy("price_cents", "id").limit(100)


@query("srt07_facet_order",
    f"select facet, value, n, row_number() over (partition by facet order by n desc, value) rank from (select 'source' facet, source as value,"
    f" count(*) n from {LISTINGS} group by 2 union all select 'segment', segment, count(*) from {LISTINGS} group by 2)"
)
def srt07(spark, d):
    return facets.ordered(facets.facet_counts(listings(spark, d), ["source", "segment"]))


@query("srt08_bucket_order", f"""with b as (select {_bucket("(price_cents / 100.0)", 50000)} as value, count(*) n from {LISTINGS} group by 1) select 'price' facet, value, n, row_number() over (order by cast(string_split(value, '-')[1] as bigint)) rank from b""")
def srt08(spark, d):
    from lotwise.functions.numeric import bucket

    counts = listings(spark, d).groupBy(bucket(F.col("price_cents") / 100, 50_000).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("facet", F.lit("price"))
    return facets.ordered(counts, buckets=True)


@query("srt09_lowest_candidates", """select a.c_custkey a, b.c_custkey b, cast(abs(a.c_acctbal - b.c_acctbal) as decimal(12,2)) gap from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_mktsegment = b.c_mktsegment and a.c_custkey < b.c_custkey
 where abs(a.c_acctbal - b.c_acctbal) <= 500 order by gap desc, a, b limit 20""")
def srt09(spark, d):
    """The twenty weakest pairs: those nearest to the limit."""
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return joins.widest_pairs(c, ["c_nationkey", "c_mktsegment"], "c_custkey", ("c_acctbal", 500), 20)


@query("srt10_bounded_samples",
    f"select source, count(*) n, array_to_string(array_agg(id order by id) filter (where r <= 10), ',') ids from (select *,"
    f" row_number() over (partition by source order by id) r from {LISTINGS}) group by 1"
)
def srt10(spark, d):
    out = facets.group_examples(listings(spark, d), F.col("source"), "id", ["id"], 10)
    return out.select(F.col("grp").alias("source"), "n", F.array_join(F.col("examples").cast("array<string>"), ",").alias("ids"))


@query("set07_shared_hashes", f"select a.id a, b.id b, cast(len(list_intersect(a.words, b.words)) as integer) shared from {PARTS} a join {PARTS} b on b.id = a.id + 1")
def set07(spark, d):
    """How many distinct hashes two neighbours share."""
    p = parts(spark, d).select("id", F.array_distinct("words").alias("words"))
    b = p.select((F.col("id") - 1).alias("id"), F.col("id").alias("b"), F.col("words").alias("other"))
    return p.join(b, "id").select(F.col("id").alias("a"), "b", identity.shared_hashes(F.col("words"), F.col("other")).alias("shared"))


@query("arr02_cardinality", f"select id, len(list_filter(words, lambda w: length(w) > 4)) n from {PARTS} where len(list_filter(words, lambda w: length(w) > 4)) > 0")
def arr02(spark, d):
    return parts(spark, d).select("id", F.size(F.filter("words", lambda w: F.length(w) > 4)).alias("n")).where("n > 0")




@query("map02_stable_key", f"""select event_id, '{{"kind":["' || event_type || '"],"q":["' || array_to_string(list_sort(['w' || (user_id % 7), 'w' || (k % 5), 'a"b']), '","').replace('a"b', 'a\\"b') || '"],"user":["' || user_id || '"]}}' as key from {EVENTS}""")
def map02(spark, d):
    """Equal parameters in any order give one key."""
    word = lambda c: F.concat(F.lit("w"), c.cast("string"))
    lists = F.array(F.lit('a"b'), word(F.col("k") % 5), word(F.col("user_id") % 7))
    given = F.create_map(F.lit("user"), F.array(F.col("user_id").cast("string")), F.lit("q"), lists, F.lit("kind"), F.array("event_type"))
    return events(spark, d).select("event_id", projections.stable_key_of(given).alias("key"))


@query("mth04_dhash", """with p as (select doc_id, left(sha256(coalesce(text, '')) || sha256('x'), 72) s from documents)
 select doc_id, cast(list_sum([case when ascii(s[9 * (i // 8) + i % 8 + 1]) > ascii(s[9 * (i // 8) + i % 8 + 2]) then (case when i = 0 then -9223372036854775808::hugeint else 1::hugeint << cast(63 - i as integer) end) else 0::hugeint end for i in range(64)]) as bigint) h from p""")
def mth04(spark, d):
    """Difference hashes of 9 x 8 grey bytes; a digest's digits stand in for the picture."""
    pixels = F.left(F.concat(F.sha2(F.coalesce("text", F.lit("")), 256), F.sha2(F.lit("x"), 256)), F.lit(72)).cast("binary")
    return t(spark, d, "documents").select("doc_id", projections.dhash(pixels).alias("h"))


@query("mth05_sha256", "select doc_id, sha256(text) h from documents")
def mth05(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("dat03_age_days", f"select id, round(date_diff('second', listed_at, timestamp '2002-01-01 06:00:00') / 86400.0, 6) age from {LISTINGS}")
def dat03(spark, d):
    from lotwise.functions.numeric import days_between

    return listings(spark, d).select("id", F.round(days_between(F.lit("2002-01-01 06:00:00").cast("timestamp"), F.col("listed_at")), 6).alias("age"))


@query("dat04_cutoff", f"select id from {LISTINGS} where listed_at >= timestamp '2001-08-01' - interval 90 day")
def dat04(spark, d):
    from lotwise.operators.merge import retained

    return retained(listings(spark, d), "listed_at", F.lit("2001-08-01").cast("timestamp_ntz"), 90).select("id")


@query("dat09_spans", """with r as (select o_orderkey id, case when o_orderkey % 3 > 0 then o_orderdate - interval 1 day * cast(o_custkey % 4000 - 1000 as integer) end f, case when o_orderkey % 11 > 0 then o_orderdate end l from orders),
 s as (select id, coalesce(f, l - interval 180 day) f, l from r),
 e as (select *, case when l is null then 'the span needs an end' when f > l then 'the span''s start must be before its end' when f < l - interval 1826 day then 'the span cannot exceed 1826 days' end error from s)
 select id, case when error is null then f end first, case when error is null then l end last, error from e""")
def dat09(spark, d):
    """Each order asks for the span from some days before or after it to itself; some name no start or no end."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    first = F.when(k % 3 > 0, at - F.make_interval(days=(F.col("o_custkey") % 4000 - 1000).cast("int")))
    return t(spark, d, "orders").select(k.alias("id"), market.spans(first, F.when(k % 11 > 0, at)).alias("s")).select("id", "s.*")


@query("mth11_settings", f"""select event_id, cast(case when k is null then 500 else least(greatest(k * 100, 1), 5000) end as bigint) poll_batch, cast(least(greatest(user_id - 20, 1), 100) as bigint) poll_batches,
 cast(case when event_type = 'view' then 30 else least(greatest(k * 7, 1), 365) end as bigint) page_ttl_days, cast(60 as bigint) facet_ttl_seconds from {EVENTS}""")
def mth11(spark, d):
    """Each event as settings given as texts: whole numbers in and out of bounds, none at all, and no numbers."""
    k = F.col("k")
    raw = {
        "poll_batch": (k * 100).cast("string"), "poll_batches": (F.col("user_id") - 20).cast("string"),
        "page_ttl_days": F.when(F.col("event_type") == "view", F.concat(F.lit("x"), k.cast("string"))).otherwise((k * 7).cast("string")), "facet_ttl_seconds": F.lit("1.5"),
    }
    return events(spark, d).select("event_id", projections.settings(raw).alias("s")).select("event_id", "s.*")


PAIR = ["vin", "make", "model", "year", "trim", "stock_number", "source_url", "price_cents", "mileage", "zip", "city", "state", "dealer_profile_id", "dealer_website", "dealer_name", "conflicting_image_hash", "image_hashes"]
KINDS = {"year": "int", "price_cents": "bigint", "mileage": "int", "conflicting_image_hash": "boolean", "image_hashes": "array<string>"}
BASE = {"make": "Ford", "model": "Transit", "year": 2019, "trim": "XL", "mileage": 80_000, "price_cents": 2_800_000, "zip": "78701", "dealer_name": "D", "stock_number": "S"}
#: (what differs in a, what differs in b, score, decision, signals)
PAIRS = [
    ({}, {"dealer_name": "d "}, 100, "auto_link", "stable_dealer_stock_number"),
    ({"source_url": "u", "stock_number": None}, {"source_url": "u", "stock_number": None}, 100, "auto_link", "identical_source_url"),
    ({"stock_number": None}, {"stock_number": None}, 75, "candidate", "same_dealer,trim_match,compatible_make_model_year,mileage_within_tolerance,price_within_tolerance,same_zip"),
    ({}, {"dealer_name": "E", "trim": "XLT", "mileage": 90_000, "price_cents": 1_000_000, "zip": None}, 3, "no_match", "trim_mismatch,compatible_make_model_year,mileage_outside_tolerance,price_outside_tolerance,matching_stock_number_unconfirmed_dealer"),
    ({}, {"make": "Ram"}, 0, "no_match", "incompatible_vehicle"), ({}, {"year": 2021}, 0, "no_match", "incompatible_vehicle"), ({"conflicting_image_hash": True}, {}, 0, "no_match", "conflicting_image_hash"),
    ({"vin": "1HGCM82633A004352"}, {"vin": "1M8GDM9AXKP042788"}, 0, "no_match", "conflicting_vin"),
    ({"stock_number": None, "image_hashes": ["h1"], "city": "A", "state": "TX", "zip": None}, {"dealer_name": "E", "image_hashes": ["h1", "h2"], "city": "a", "state": "tx", "mileage": None}, 62, "candidate", "trim_match,compatible_make_model_year,price_within_tolerance,same_city_state,trusted_image_hash_overlap"),
]


def _kind(n: str) -> str:
    return KINDS.get(n, "string")


@query("mth10_weighted_score",
    f"select id, {picked_sql([p[2] for p in PAIRS], 'int')} score, {picked_sql([p[3] for p in PAIRS], 'string')} decision, {picked_sql([p[4] for p in PAIRS], 'string')} signals"
    f" from {PARTS}"
)
def mth10(spark, d):
    def side(p: str, of: int):
        rows = [BASE | case[of] for case in PAIRS]
        cols = {}
        for n in PAIR:
            values = [r.get(n) for r in rows]
            whole = F.array(*[F.lit(None).cast(_kind(n)) if v is None else F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v).cast(_kind(n)) for v in values])
            cols[f"{p}_{n}"] = F.get(whole, (F.col("id") % len(PAIRS)).cast("int"))
        return cols

    pairs = parts(spark, d).select("id").withColumns(side("a", 0) | side("b", 1))
    scored = identity.score_pairs(pairs)
    return scored.select("id", "score", "decision", F.array_join(F.transform("signals", lambda s: s["id"]), ",").alias("signals"))


@query("dom23_run_forest",
    "with recursive e as (select o_orderkey child, o_orderkey // 3 parent from orders where o_orderkey >= 6), tree as (select o_orderkey id,"
    " o_orderkey root, 0 depth from orders where o_orderkey between 2 and 5 union all select child, root, depth + 1 from tree"
    " join e on parent = id) select id, root, depth, case when depth > 0 then id // 3 end parent from tree"
)
def dom23(spark, d):
    """Every run with its forest's root, its depth and its parent."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("child"), F.expr("o_orderkey div 3").alias("parent"))
    return reports.forest(o.where("child >= 6"), o.where("child between 2 and 5").select("child"))


golden("dat08_nanos_cases", {"ns": "bigint"}, {"at": "timestamp"}, [
    (1_704_067_200_123_999_999, "2024-01-01 00:00:00.123"), (0, "1970-01-01 00:00:00"), (-1, "1969-12-31 23:59:59.999"), (None, None),
], lambda ns: {"at": _nanos(ns)})


def _nanos(ns):
    from lotwise.functions.numeric import nanos_to_timestamp

    return nanos_to_timestamp(ns)

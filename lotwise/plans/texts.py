"""Queries on text, URLs, pages, dates and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import canonical, numeric, redaction, text
from lotwise.operators import redaction as redaction_of
from lotwise.plans.registry import query
from lotwise.plans.standins import EVENTS, PARTS, events, parts, t


@query("str01_color", f"""select id, case when w in ('white', 'ivory') then upper(left(w, 1)) || lower(substr(w, 2)) else upper(left(w, 1)) || lower(substr(w, 2)) end color from (select id, words[1] w from {PARTS})""")
def str01(spark, d):
    return parts(spark, d).select("id", canonical.color(F.concat(F.col("words")[0], F.lit(" Metallic Pearl Coat"))).alias("color"))


@query("str02_fuel",
    f"select id, case id % 8 when 0 then 'hybrid' when 1 then 'plug-in hybrid' when 2 then 'electric' when 3 then 'diesel' when 4 then 'gasoline'"
    f" when 5 then 'gasoline' when 6 then null else 'hydrogen' end fuel from {PARTS}"
)
def str02(spark, d):
    raw = F.get(F.array(*map(F.lit, ["Gas/Hybrid", "Plug-In Hybrid", "BEV", "DIESEL", "Regular Unleaded", "3.5L V6 DOHC", "2.5L 4-Cyl", "Fuel Cell"])), (F.col("id") % 8).cast("int"))
    engine = F.when(F.col("id") % 8 == 5, "3.5L V6 Gasoline")
    return parts(spark, d).select("id", canonical.fuel(raw, engine).alias("fuel"))


@query("str03_make_model", f"select id, array_to_string(list_transform(string_split(lower(model), ' '), lambda x: upper(x[1]) || x[2:]), ' ') model from {PARTS}")
def str03(spark, d):
    return parts(spark, d).select("id", canonical.model(F.lit(None).cast("string"), F.concat(F.lit("  "), F.replace(F.col("model"), F.lit(" "), F.lit("  ")))).alias("model"))


@query("str05_brand_slug", f"select id, trim(regexp_replace(replace(lower(trim(title)), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '-') slug from {PARTS}")
def str05(spark, d):
    return parts(spark, d).select("id", canonical.brand_slug(F.concat(F.lit(" "), "title", F.lit("!"))).alias("slug"))


@query("str07_vehicle_title",
    f"select id, 2000 + size as \"year\", string_split(title, ' ')[1] make, 'Grand Caravan' model, string_split(title, ' ')[2] trim_name"
    f" from {PARTS}"
)
def str07(spark, d):
    p = parts(spark, d)
    one = canonical.vehicle_title(F.concat_ws(" ", (F.col("size") + 2000).cast("string"), F.col("words")[0], F.lit("Grand Caravan"), F.col("words")[1]))
    return p.withColumn("v", one).select("id", "v.year", "v.make", "v.model", F.col("v.trim").alias("trim_name"))


@query("str09_city_state",
    "select s_suppkey, lower(regexp_replace(n_name, '\\s+', ' ', 'g')) || '|' || upper(left(r_name, 2)) key from supplier"
    " join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey"
)
def str09(spark, d):
    from lotwise.plans.standins import regions

    s = t(spark, d, "supplier").join(F.broadcast(regions(spark, d)), F.col("s_nationkey") == F.col("nation_key"))
    return s.select("s_suppkey", text.city_state(F.concat(F.lit(" "), "nation"), F.lower(F.left("source", F.lit(2)))).alias("key"))


@query("str10_transmission", f"select id, case size % 5 when 0 then 'cvt' when 1 then 'automated_manual' when 2 then 'automatic' when 3 then 'manual' end t from {PARTS}")
def str10(spark, d):
    raw = F.get(F.array(*map(F.lit, ["CVT", "Dual-Clutch", "8-speed Automatic", "Manual_6", "none"])), F.col("size") % 5)
    return parts(spark, d).select("id", canonical.transmission(raw).alias("t"))


VINS = f"(select id, 'HGCM82633A' || lpad(cast(id % 1000000 as varchar), 6, '0') body from {PARTS})"


@query("str13_check_digit", f"""with v as (select id, '1HGCM8263' || '3' || 'A' || lpad(cast(id % 1000000 as varchar), 6, '0') vin from {PARTS}), x as (select id, vin, list_sum([(case when vin[i] between '0' and '9' then ascii(vin[i]) - 48 else cast('12345678012345070923456789'[ascii(vin[i]) - 64] as integer) end) * [8,7,6,5,4,3,2,10,0,9,8,7,6,5,4,3,2][i] for i in range(1, 18)]) % 11 r from v)
 select id, vin, vin[9] = (case when r = 10 then 'X' else cast(cast(r as integer) as varchar) end) fine from x""")
def str13(spark, d):
    vin = numeric.vin_normal(F.concat(F.lit(" 1hgcm8263-"), F.lit("3A"), F.lpad((F.col("id") % 1_000_000).cast("string"), 6, "0")))
    return parts(spark, d).select("id", vin.alias("vin"), numeric.vin_check_digit(vin).alias("fine"))


@query("str14_sale_status",
    f"select id, case size % 5 when 0 then 'sold' when 1 then 'pending' when 2 then 'gone' when 3 then 'active' else 'active' end status"
    f" from {PARTS}"
)
def str14(spark, d):
    raw = F.get(F.array(*map(F.lit, ["SOLD!", "Sale Pending", "No longer available", "", "sold " * 30])), F.col("size") % 5)
    return parts(spark, d).select("id", text.sale_status(raw).alias("status"))


@query("str16_features", f"select id, case size % 3 when 0 then 'has_lift,hand_controls' when 1 then 'lowered_floor,tie_down_system' else '' end f from {PARTS}")
def str16(spark, d):
    raw = F.get(F.array(*map(F.lit, ["A wheelchair lift and Hand Control", "Lowered  floor with tie-downs", "forklift only"])), F.col("size") % 3)
    return parts(spark, d).select("id", F.array_join(canonical.features(raw), ",").alias("f"))


@query("str17_inches", f"select id, size inches, lpad(cast(id % 100000 as varchar), 5, '0') zip from {PARTS}")
def str17(spark, d):
    n = F.col("size").cast("string")
    raw = F.when(F.col("size") % 2 == 0, F.concat(n, F.lit(" in. floor drop"))).otherwise(F.concat(F.lit("Floor lowered of "), n, F.lit(" inches")))
    address = F.concat(F.lit("12 Main St, Austin TX "), F.lpad((F.col("id") % 100_000).cast("string"), 5, "0"), F.lit(" USA 123456"))
    return parts(spark, d).select("id", text.floor_lowering(raw).alias("inches"), text.zip_code(address).alias("zip"))


@query("str18_price_parsers", f"select id, price_cents // 100 * 100 first_digits, price_cents decimal_dollars, price_cents * 100 all_digits from {PARTS}")
def str18(spark, d):
    raw = F.concat(F.lit("$ "), F.format_number(F.col("price_cents") / 100, 2))
    return parts(spark, d).select("id", text.price_cents_first_digits(raw).alias("first_digits"), text.transform("parsePrice", raw).alias("decimal_dollars"), text.price_cents_all_digits(raw).alias("all_digits"))


@query("str19_record_key", "select page_id, regexp_replace(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+[^?#]*)', 1), '/+$', '') key from pages")
def str19(spark, d):
    return t(spark, d, "pages").select("page_id", text.origin_path(F.col("url")).alias("key"))


@query("str20_image_url", """select page_id, regexp_extract(url, '^([^?#]*)', 1) || '?a=1&page=' || coalesce(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), ''), 'none') || '&w=5#frag' clean from pages""")
def str20(spark, d):
    page = F.coalesce(F.nullif(F.regexp_extract("url", "[?&]page=([0-9]+)", 1), F.lit("")), F.lit("none"))
    raw = F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.lit("?w=5&utm_source=x&page="), page, F.lit("&REF=y&a=1&_ts=3#frag"))
    return t(spark, d, "pages").select("page_id", text.image_url(raw).alias("clean"))


@query("str22_host",
    "select page_id, case when host like '%.example.com' or host = 'example.com' then null else host end host from (select page_id,"
    " regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') host from pages)"
)
def str22(spark, d):
    return t(spark, d, "pages").select("page_id", text.allowed_host(F.col("url"), ["example.com"]).alias("host"))


@query("str24_unescape",
    "select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '),"
    " '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) plain from pages"
)
def str24(spark, d):
    return t(spark, d, "pages").select("page_id", text.unescape(F.col("html")).alias("plain"))


@query("str27_fingerprint", r"""select page_id, sha256(array_to_string(list_sort(regexp_extract_all(html, '<a href="([^"]*)">', 1)), '|')) h,
 sha256(array_to_string(regexp_extract_all(html, '<a href="([^"]*)">', 1), '|')) ordered from pages""")
def str27(spark, d):
    """A page's first cards as one hash: entries are those of one page."""
    entries = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))
    return t(spark, d, "pages").select("page_id", text.fingerprint(entries).alias("h"), text.fingerprint(entries, ordered=True).alias("ordered"))


@query("str30_log_lines", f"select event_id, case event_type when 'error' then 'error' else 'info' end level, event_type message from {EVENTS}")
def str30(spark, d):
    level = F.when(F.col("event_type") == "error", "50").otherwise("30")
    line = F.to_json(F.struct(level.alias("level"), F.col("event_type").alias("msg")))
    return events(spark, d).withColumn("l", text.log_line(line)).select("event_id", "l.level", "l.message")


@query("str33_redact_documents")
def str33(spark, d):
    """All documents. Rules with lookaround are beyond the other engine's expressions, so tests compare it with a loop over Python's."""
    return t(spark, d, "documents").select("doc_id", redaction.redact(F.col("text")).alias("redacted"))


@query("str34_redact_json", """select event_id, '{"event":' || event_id || ',"inner":"{\\"k\\":' || json_extract_string(props, '$.k') || '}","log":"got {\\"kind\\":\\"' || event_type || '\\"} back"'
 || ',"nested":{"kind":"' || event_type || '","list":[' || user_id || ',null,true,{}],"mail":"' || case when user_id % 2 = 0 then 'to [EMAIL] now' else 'to u' || user_id || ' now' end || '"}'
 || case when user_id % 3 = 0 then ',"note":"at [IP]"' else ',"note":"pwd:[REDACTED]"' end || '}' redacted from events""")
def str34(spark, d):
    """Each event as a report with private keys at several depths, JSON inside texts, and free text."""
    e, user = t(spark, d, "events"), F.col("user_id").cast("string")
    mail = F.concat(F.lit("to u"), user, F.when(F.col("user_id") % 2 == 0, "@mail.example.com now").otherwise(" now"))
    note = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("at 10.0."), F.pmod("user_id", F.lit(200)).cast("string"), F.lit(".7"))).otherwise(F.concat(F.lit("pwd: "), user))
    value = F.get_json_object("props", "$.k")
    inner = F.concat(F.lit('{"secret":"'), user, F.lit('","k":'), value, F.lit("}"))
    log = F.concat(F.lit('got {"kind":"'), F.col("event_type"), F.lit('","token":"'), user, F.lit('"} back'))
    q = redaction_of.as_json
    raw = F.concat(
        F.lit('{"note":'), q(note), F.lit(',"event":'), F.col("event_id").cast("string"), F.lit(',"apiKey":'), q(user), F.lit(',"log":'), q(log), F.lit(',"nested":{"list":['), user, F.lit(',null,true,{"session":'), user,
        F.lit('}],"password":{"deep":1},"mail":'), q(mail), F.lit(',"kind":'), q(F.col("event_type")), F.lit('},"inner":'), q(inner), F.lit("}"),
    )
    return redaction_of.redact_json(e.select("event_id", raw.alias("raw")), "event_id", "raw")


@query("str36_block_page", """select page_id, case when page_id % 10 = 0 then 'status_' || cast([403, 429, 503][page_id // 10 % 3 + 1] as varchar)
 else [null, 'generic_captcha', 'cloudflare_challenge', 'perimeterx_challenge', 'datadome_challenge', 'incapsula_challenge', null, null, null, null][page_id % 10 + 1] end blocked from pages""")
def str36(spark, d):
    status = F.when(F.col("page_id") % 10 == 0, F.get(F.array(F.lit(403), F.lit(429), F.lit(503)), (F.expr("page_id div 10") % 3).cast("int"))).otherwise(200)
    signs = ["", "<p>Please solve the CAPTCHA</p>", "Just a Moment...", "window._pxhd=1", "DataDome captcha", "_Incapsula_Resource", "fine", "captchas", " " * 5000 + "captcha", "plain"]
    body = F.get(F.array(*map(F.lit, signs)), (F.col("page_id") % 10).cast("int"))
    return t(spark, d, "pages").select("page_id", text.blocked(status, body).alias("blocked"))


@query("str37_location", """select s_suppkey, n_name city, case s_suppkey % 3 when 0 then 'TX' when 1 then 'NH' else 'Bavaria' end state, case when s_suppkey % 2 = 0 then lpad(cast(s_suppkey as varchar), 5, '0') end zip,
 n_name city2, case when s_suppkey % 4 > 0 then 'NV' end state2 from supplier join nation on n_nationkey = s_nationkey""")
def str37(spark, d):
    from lotwise.plans.standins import regions

    k = F.col("s_suppkey")
    s = t(spark, d, "supplier").join(F.broadcast(regions(spark, d)), F.col("s_nationkey") == F.col("nation_key"))
    state = F.when(k % 3 == 0, "texas").when(k % 3 == 1, "New Hampshire").otherwise("Bavaria")
    one = F.concat("nation", F.lit(", "), state, F.when(k % 2 == 0, F.concat(F.lit(" "), F.lpad(k.cast("string"), 5, "0"))).otherwise(""))
    two = F.concat("nation", F.when(k % 4 == 0, " (Metro) x").when(k % 4 == 1, " NV (Metro)").when(k % 4 == 2, " NV Stock: 12").otherwise(" NV"))
    rows = s.withColumns({"l": text.city_state_zip(one), "m": text.city_and_state(two)})
    return rows.select("s_suppkey", "l.city", "l.state", "l.zip", F.col("m.city").alias("city2"), F.col("m.state").alias("state2"))


@query("src05_html_cards", r"""select page_id, cast(u.position as integer) "position", u.href, u.label from pages, lateral (
 select unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">')))) "position", unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) label) u""")
def src05(spark, d):
    from lotwise.sources.html import links

    return links(t(spark, d, "pages"))


@query("src07_label_map", f"select id, model, cast(size as varchar) size, make, 3 n from {PARTS}")
def src07(spark, d):
    from lotwise.sources.html import label_map

    item = lambda label, value: F.concat(F.lit(f"<li class='list-group-item'> <span class='badge'>{label} </span> "), value, F.lit("</li>"))
    linked = F.concat(F.lit("by <a href='/m'>"), F.col("make"), F.lit("</a>"))
    page = F.concat(item("Model", F.lit("old")), item("Size", F.col("size").cast("string")), item("Model", F.col("model")), item("More: x", F.lit("y")), item("Make &amp; co", linked), item("Empty", F.lit(" ")))
    m = F.col("m")
    # a small file is few tasks, and a page is much more work than its row
    return parts(spark, d).repartition("id").withColumn("m", label_map(page)).select("id", m["Model"].alias("model"), m["Size"].alias("size"), m["Make & co"].alias("make"), F.size(m).alias("n"))


@query("src10_aspects_map", f"select id, model, size from {PARTS}")
def src10(spark, d):
    from lotwise.sources.html import aspects

    raw = F.to_json(F.array(F.struct(F.lit("Model").alias("name"), F.lit("old").alias("value")), F.struct(F.lit("Size").alias("name"), F.col("size").cast("string").alias("value")), F.struct(F.lit("Model").alias("name"), F.col("model").alias("value"))))
    return parts(spark, d).withColumn("m", aspects(raw)).select("id", F.col("m")["Model"].alias("model"), F.col("m")["Size"].cast("int").alias("size"))


@query("src12_pivot",
    f"select user_id, cast(sum(k) filter (where event_type = 'view') as bigint) \"view\","
    f" cast(sum(k) filter (where event_type = 'error') as bigint) error from {EVENTS} group by user_id"
)
def src12(spark, d):
    return events(spark, d).groupBy("user_id").pivot("event_type", ["view", "error"]).agg(F.sum("k"))


@query("src13_scalar_or_array", f"select id, size, n from (select id, size, case when size % 2 = 0 then 1 else 2 end n from {PARTS})")
def src13(spark, d):
    from lotwise.sources.html import one_or_many

    raw = F.when(F.col("size") % 2 == 0, F.format_string('{"v": %d}', "size")).otherwise(F.format_string('[{"v": %d}, {"v": 0}]', "size"))
    return parts(spark, d).withColumn("a", one_or_many(raw, "struct<v:int>")).select("id", F.col("a")[0]["v"].alias("size"), F.size("a").alias("n"))


@query("src14_log_range",
    f"select event_id, ts from {EVENTS} where ts between timestamp '2024-01-05' and timestamp '2024-01-08' and event_type like '%r%'"
    f" order by ts desc, event_id limit 100"
)
def src14(spark, d):
    e = events(spark, d)
    return e.where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-08").cast("timestamp_ntz")) & F.contains("event_type", F.lit("r"))).orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts")


@query("dat05_dates", f"select id, timestamp '2020-01-01' + interval 1 day * size iso from {PARTS}")
def dat05(spark, d):
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("size"))
    raw = F.when(F.col("id") % 2 == 0, F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "d/M/yyyy"))
    return parts(spark, d).select("id", numeric.nhtsa_date(raw).alias("iso"))


@query("dat07_timeline",
    f"select event_id, round(greatest(0.0, least(100.0, (date_diff('second', timestamp '2024-01-10', date_trunc('second',"
    f" ts)) + 86400.0) / 172800.0 * 100)) + 1e-7, 3) percent, abs(date_diff('second', timestamp '2024-01-10', date_trunc('second',"
    f" ts))) > 86400 overflow from {EVENTS}"
)
def dat07(spark, d):
    at = numeric.timeline_position(F.date_trunc("second", "ts"), F.lit("2024-01-10").cast("timestamp"))
    return events(spark, d).withColumn("p", at).select("event_id", F.round(F.col("p.percent") + 1e-7, 3).alias("percent"), "p.overflow")


@query("arr01_ordered_filter", f"select id, array_to_string(list_filter(words, lambda x: length(x) > 4), ',') kept from {PARTS}")
def arr01(spark, d):
    return parts(spark, d).select("id", F.array_join(F.filter("words", lambda x: F.length(x) > 4), ",").alias("kept"))


@query("arr04_posexplode", f"select id, unnest(range(len(words))) pos, unnest(words) word from {PARTS}")
def arr04(spark, d):
    return parts(spark, d).select("id", F.posexplode("words").alias("p", "word")).select("id", F.col("p").cast("bigint").alias("pos"), "word")


@query("prj07_hero",
    f"select id, array_to_string(case when id % 3 = 0 then words else list_concat([words[2]], list_filter(words,"
    f" lambda x: x <> words[2])) end, ',') images from {PARTS}"
)
def prj07(spark, d):
    from lotwise.operators.projections import promoted

    hero = F.when(F.col("id") % 3 == 0, F.lit("not there")).otherwise(F.col("words")[1])
    return parts(spark, d).select("id", F.array_join(promoted(F.col("words"), hero), ",").alias("images"))


@query("jsn01_diff",
    "select o_orderkey, '{\"status\":\"' || o_orderstatus || '\"}' before, '{\"status\":\"X\"}' after from orders where o_orderkey % 5 = 0"
    " and o_orderstatus <> 'X'"
)
def jsn01(spark, d):
    from lotwise.operators.merge import audit_rows

    old = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    new = old.withColumn("status", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("status")))
    return audit_rows(old, new, ["o_orderkey"], ["status", "priority"])


@query("jsn03_claims", f"select event_id, k, round(k / 100.0, 4) confidence from {EVENTS} where k / 100.0 >= 0.85")
def jsn03(spark, d):
    claims = F.to_json(F.array(F.struct(F.col("k").alias("value"), (F.col("k") / 100.0).alias("confidence"))))
    rows = events(spark, d).select("event_id", F.explode(F.from_json(claims, "array<struct<value:bigint,confidence:double>>")).alias("c"))
    return rows.where("c.confidence >= 0.85").select("event_id", F.col("c.value").alias("k"), F.round("c.confidence", 4).alias("confidence"))

"""String expressions: normalising, snippets, masks, URLs, entities and small parsers. Column builders only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track visitors, paths of a page's own pictures, and marks of a page that is no content.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "twclid",
    "cache_buster", "cb", "v", "ver", "version", "_t", "_ts", "source", "ref", "referral", "sid", "tracking", "uid",
)
CHROME_PATH = (
    r"(?i)/(?:icon|logo|badge|banner|avatar|staff|team|person|social|sprite|header|footer|favicon|placeholder|tracking|pixel|spacer|arrow|bullet|star|"
    r"rating|map|pin|marker)\b"
)
BLOCKED_STATUS = (403, 429, 503)
BLOCKED_BODY = [
    (r"cf-browser-verification|Just a moment|__cf_chl_", "cloudflare_challenge"),
    (r"_pxhd|PerimeterX", "perimeterx_challenge"),
    (r"datadome", "datadome_challenge"),
    (r"incapsula|_Incapsula_Resource", "incapsula_challenge"),
    (r"\bcaptcha\b", "generic_captcha"),
]
#: Keys whose values are personal.
PERSONAL_KEYS = ["ip_address", "x-forwarded-for", "x-real-ip", "cf-connecting-ip", "forwarded", "email", "phone", "dealer_email", "dealer_phone", "contact"]


def normalized(c: Column) -> Column:
    """STR31: trimmed and lower-cased; blank is null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def first_match(c: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The value of the first pattern that occurs in ``c``, ignoring case."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, value in rules:
        out = out.when(c.rlike(f"(?i){pattern}"), value)
    return out.otherwise(otherwise if otherwise is not None else F.lit(None).cast("string"))


def first_containing(c: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The value of the first substring that ``c`` contains, ignoring case."""
    low, out = F.lower(c), F.when(F.lit(False), F.lit(None).cast("string"))
    for part, value in rules:
        out = out.when(F.contains(low, F.lit(part)), value)
    return out.otherwise(F.lit(otherwise).cast("string"))


def present(flags: list[tuple[Column, str]]) -> Column:
    """Names whose flag holds, in the order given."""
    return F.filter(F.array(*[F.when(flag, name) for flag, name in flags]), lambda x: x.isNotNull())


def lookup(c: Column, table: dict[str, str]) -> Column:
    """A literal dictionary's value, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def snippet(c: Column, size: int = 300) -> Column:
    """PRJ06: trimmed text, or its first characters right-trimmed with an ellipsis."""
    t = F.trim(c)
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, size)), F.lit("…")))


def csv_list(c: Column) -> Column:
    """FLT07: comma-separated text as trimmed, distinct, non-blank values."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != ""))


def title_case(c: Column) -> Column:
    return F.initcap(F.regexp_replace(F.trim(c), r"\s+", " "))


def city_state(city: Column, state: Column) -> Column:
    """STR09: ``name|ST`` of a plausible pair, else null."""
    name, region = F.regexp_replace(F.lower(F.trim(city)), r"\s+", " "), F.upper(F.trim(state))
    fine = (name != "") & (F.length(name) <= 100) & ~name.rlike("[,|]") & region.rlike("^[A-Z]{2}$")
    return F.when(fine, F.concat_ws("|", name, region))


def origin_path(url: Column) -> Column:
    """STR19: scheme, host and path without trailing slashes; what is no URL stays as it is."""
    found = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+[^?#]*)", 1)
    return F.when(found == "", url).otherwise(F.regexp_replace(found, "/+$", ""))


def image_url(url: Column) -> Column:
    """STR20: without tracking parameters, the rest ordered by name (equal names keep their order); what is no web address stays as it is."""
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    bare = F.regexp_replace(url, "#.*$", "")
    pairs = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    named = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("name"), i.alias("i"), p.alias("p")))
    kept = F.transform(F.array_sort(named), lambda x: x["p"])
    base = F.regexp_replace(bare, r"\?.*$", "")
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#\s]+"), F.concat(base, query, fragment)).otherwise(url)


def site_chrome(url: Column) -> Column:
    """STR21: pictures of the page itself, by their path, and pictures held in the address."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.startswith(url, F.lit("data:")) | path.rlike(CHROME_PATH)


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def denied_host(h: Column, denied: list[str]) -> Column:
    """FLT21: a host that is, or ends in, a denied name."""
    return reduce(lambda a, b: a | b, [(h == d) | F.endswith(h, F.lit(f".{d}")) for d in denied], F.lit(False))


def allowed_host(url: Column, denied: list[str]) -> Column:
    """STR22: the host, unless it is denied."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    return F.when(~denied_host(h, denied), h)


def dealer_origin(raw: Column, denied: list[str]) -> Column:
    """STR22, FLT21: ``https://host`` of a web address or bare host; no other schemes, IP addresses, single labels or denied hosts."""
    t = F.trim(raw)
    url = F.when(t.rlike(r"^[^\s:/@?#]+(:\d+)?([/?#]|$)"), F.concat(F.lit("https://"), t)).otherwise(t)
    h = F.regexp_replace(F.regexp_replace(host(url), r"\.$", ""), r"^www\.", "")
    fine = url.rlike("(?i)^https?://") & ~h.rlike(r"^\[|^\d{1,3}(\.\d{1,3}){3}$|^\.|\.\.|\.$") & F.contains(h, F.lit("."))
    return F.when(fine & ~denied_host(h, denied), F.concat(F.lit("https://"), h))


def unescape(c: Column) -> Column:
    """STR24: tags dropped, then the common entities decoded."""
    out = F.regexp_replace(c, "<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def fingerprint(entries: Column, ordered: bool = False) -> Column:
    """STR27: SHA-256 of the joined entries, sorted unless their order counts."""
    return F.sha2(F.array_join(entries if ordered else F.array_sort(entries), "|"), 256)


def price_cents_first_digits(c: Column) -> Column:
    """The first run of digits and commas, as whole dollars."""
    return F.try_multiply(F.expr("cast(null as bigint)") if c is None else F.nullif(F.regexp_replace(F.regexp_extract(c, r"([\d,]+)", 1), ",", ""), F.lit("")).try_cast("bigint"), F.lit(100))


def price_cents_decimal(c: Column) -> Column:
    """Decimal dollars, rounded to cents."""
    return F.round(F.nullif(F.regexp_replace(c, r"[^0-9.]", ""), F.lit("")).try_cast("double") * 100).cast("bigint")


def price_cents_all_digits(c: Column) -> Column:
    """All digits run together, as whole dollars."""
    return F.nullif(F.regexp_replace(c, r"\D", ""), F.lit("")).try_cast("bigint") * 100


def inches(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def trim_text(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def after_colon(c: Column) -> Column:
    return trim_text(F.regexp_replace(c, r"^[^:]*:", ""))


#: STR18: named transforms; an unknown name means trimText.
TRANSFORMS = {"trimText": trim_text, "parsePrice": price_cents_decimal, "parseInches": inches, "afterColon": after_colon}


def transform(name: str, c: Column) -> Column:
    return TRANSFORMS.get(name, TRANSFORMS["trimText"])(c)


def floor_lowering(c: Column) -> Column:
    """STR17: whole inches named before or after the words."""
    before = F.regexp_extract(c, r"(?i)(\d+)\s*(?:\"|in\.?|inch(?:es)?)\s+floor\s*(?:low|drop)", 1)
    after = F.regexp_extract(c, r"(?i)floor\s*(?:low\w*|drop\w*)\s+(?:of\s+)?(\d+)", 1)
    return F.coalesce(F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))).cast("int")


def zip_code(c: Column) -> Column:
    """STR17: the first five digits that stand alone."""
    return F.nullif(F.regexp_extract(c, r"\b(\d{5})\b", 1), F.lit(""))


def city_state_zip(c: Column) -> Column:
    """STR37: struct of city, state and zip from ``City, State 12345``; a state's name becomes its code."""
    from lotwise.functions.canonical import STATE_CODES

    pattern = r"^(.+?),\s*([A-Za-z .]+?)(?:\s+(\d{5}))?$"
    part = lambda i: F.nullif(F.trim(F.regexp_extract(F.trim(c), pattern, i)), F.lit(""))
    return F.struct(part(1).alias("city"), F.coalesce(lookup(F.lower(part(2)), STATE_CODES), part(2)).alias("state"), part(3).alias("zip"))


def city_and_state(c: Column) -> Column:
    """STR37: struct of city and state from ``City ST``, without parentheses and labels that follow; without a state all is the city."""
    clean = F.regexp_replace(c, r"\s*\([^)]+\).*$", "")
    clean = F.trim(F.regexp_replace(clean, r"(?i)\s+(?:Stock|Mileage|Color|Conv Make|Conversion|Request|Schedule)\b.*", ""))
    state = F.nullif(F.regexp_extract(clean, r"^.+?\s+([A-Z]{2})$", 1), F.lit(""))
    city = F.when(state.isNotNull(), F.regexp_extract(clean, r"^(.+?)\s+[A-Z]{2}$", 1)).otherwise(clean)
    return F.struct(F.nullif(city, F.lit("")).alias("city"), state.alias("state"))


def class_token(c: Column, prefix: str) -> Column:
    """STR38: the rest of the first CSS class with a prefix, or nothing."""
    found = F.get(F.filter(F.split(c, r"\s+"), lambda x: F.startswith(x, F.lit(prefix))), F.lit(0)).substr(len(prefix) + 1, 1000)
    return F.coalesce(found, F.lit(""))


def sale_status(banner: Column) -> Column:
    """STR14."""
    t = F.lower(banner)
    has = lambda *parts: reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for p in parts])
    return F.when(F.length(banner) >= 100, "active").when(has("pending", "under contract"), "pending").when(has("sold"), "sold").when(has("no longer available", "unavailable"), "gone").otherwise("active")


def scrub_vin(c: Column) -> Column:
    """STR35: 17-character words without I, O and Q."""
    return F.regexp_replace(c, r"(?i)\b[A-HJ-NPR-Z0-9]{17}\b", "[VIN]")


def drop_keys(m: Column, denied: list[str]) -> Column:
    """STR35: a map without keys of denied names."""
    return F.map_filter(m, lambda k, _: ~F.lower(k).isin(*denied))


def blocked(status: Column, body: Column) -> Column:
    """STR36: why a page is no content, by its status or the first mark in its first 5,000 characters; else null."""
    reason = F.when(status.isin(*BLOCKED_STATUS), F.concat(F.lit("status_"), status.cast("string")))
    return reason.otherwise(first_match(F.substring(body, 1, 5000), BLOCKED_BODY))


def log_level(c: Column) -> Column:
    """STR30: names, or numbers in bands of ten."""
    n = c.try_cast("int")
    return F.when(n.isNull(), F.nullif(F.lower(F.trim(c)), F.lit(""))).when(n >= 60, "fatal").when(n >= 50, "error").when(n >= 40, "warn").when(n >= 30, "info").when(n >= 20, "debug").otherwise("trace")


def log_line(c: Column) -> Column:
    """STR30: struct of level and message from a JSON line, or the raw line."""
    one = F.from_json(c, "struct<level:string,msg:string,message:string>")
    json = F.startswith(F.ltrim(c), F.lit("{")) & one.isNotNull()
    return F.struct(F.when(json, log_level(one["level"])).alias("level"), F.when(json, F.coalesce(one["msg"], one["message"])).otherwise(c).alias("message"))

"""SRC16: the listings that a page's structured data describes, with their dates, as joins over its nodes.

Microdata: a scope is an element with ``itemscope`` and ``itemtype``; properties belong to every scope around them, and of a
name the first one in a scope counts. JSON-LD: blocks are opened level by level as variants, through arrays, ``@graph`` and
``mainEntity``, down to the records of listings; the records within a listing are its parts. A listing is *proven* where it bears
the page's address or VIN, *anonymous* where it bears neither an address nor an identifier, and else *unmatched*.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.operators.graph import shared_checkpoint, shared_table
from lotwise.sources.selectors import nodes

# Fixed values of structured data: types that are listings, the names of dates and identifiers, and where parts of a listing are.
LISTING_TYPES = ("car", "offer", "product", "vehicle")
LISTED, UPDATED = ("datePosted", "datePublished", "dateCreated"), ("dateModified",)
IDENTIFIERS = ("vehicleIdentificationNumber", "vin", "sku", "productID", "mpn", "identifier", "serialNumber")
ADDRESSES, PARTS = ("url", "@id"), ("itemOffered", "offers", "mainEntity")
#: Levels of JSON that are opened.
MOST_LEVELS = 32


def _short(kind: Column) -> Column:
    """``https://schema.org/Car`` and ``Car`` alike."""
    return F.substring_index(F.substring_index(F.lower(kind), "/", -1), "#", -1)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _ranked(df: DataFrame, by: list[str], names: tuple[str, ...], order: list[str], out: str) -> DataFrame:
    """Of rows (by, name, order, text) the first non-blank one, by ``order`` and then by the place of its name."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
    return df.where(F.col("name").isin(*names) & (F.col("text") != "")).groupBy(*by).agg(F.min_by("text", F.struct(*[place if o == "name" else F.col(o) for o in order])).alias(out))


def microdata(tree: DataFrame, key: str) -> DataFrame:
    """(key, block, place, listed, updated, urls, identifiers) of each scope that is a listing and not within another."""
    a = F.col("attributes")
    scopes = tree.where(F.map_contains_key("attributes", "itemscope") & (F.coalesce(a["itemtype"], F.lit("")) != "")).select(
        key, F.col("node").alias("scope"), F.col("last").alias("upto"), _short(a["itemtype"]).isin(*LISTING_TYPES).alias("is_listing"), a["itemid"].alias("itemid"), F.split(F.coalesce(a["itemprop"], F.lit("")), r"\s+").alias("own_names")
    )
    given = F.coalesce(*[F.nullif(a[n], F.lit("")) for n in ("datetime", "content", "href")])
    props = tree.where(F.coalesce(a["itemprop"], F.lit("")) != "").select(key, "node", "last", given.alias("given"), F.explode(F.split(a["itemprop"], r"\s+")).alias("name"))
    texts = tree.where("tag = '#text'").select(F.col(key).alias("__key"), F.col("node").alias("__node"), "text")
    read = props.where("given is null").join(texts, (F.col(key) == F.col("__key")) & (F.col("__node") > F.col("node")) & (F.col("__node") <= F.col("last")))
    read = read.groupBy(key, "node", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__node", "text"))), lambda t: t["text"]), "").alias("text"))
    values = props.where("given is not null").select(key, "node", "name", F.trim("given").alias("text")).unionByName(read.withColumn("text", F.trim("text")))

    around = scopes.select(F.col(key).alias("__key"), F.col("scope").alias("outer"), "upto", F.col("is_listing").alias("in_listing"), F.col("itemid").alias("outer_id"))
    above = scopes.drop("upto").join(around, (F.col(key) == F.col("__key")) & (F.col("outer") < F.col("scope")) & (F.col("scope") <= F.col("upto")), "left")
    nearest = F.max_by(F.struct("outer", "in_listing", "outer_id"), "outer").alias("up")
    found = above.groupBy(key, "scope", "is_listing", "itemid", "own_names").agg(nearest).where("is_listing and not coalesce(up.in_listing, false)")

    inside = scopes.select(F.col(key).alias("__key"), "scope", "upto").join(values, (F.col(key) == F.col("__key")) & (F.col("node") > F.col("scope")) & (F.col("node") <= F.col("upto")))
    first = shared_checkpoint(inside.groupBy(key, "scope", "name").agg(F.min_by("text", "node").alias("text")))
    by = [key, "scope"]
    outer = _ranked(first, by, ("url",), ["name"], "outer_url").withColumnRenamed("scope", "outer")
    ids = first.where(F.col("name").isin(*IDENTIFIERS) & (F.col("text") != "")).groupBy(*by).agg(F.collect_list("text").alias("identifiers"))
    out = found.withColumn("outer", F.when(F.array_contains("own_names", "mainEntity"), F.col("up.outer")))
    for df in (_ranked(first, by, LISTED, ["name"], "listed"), _ranked(first, by, UPDATED, ["name"], "updated"), _ranked(first, by, ("url",), ["name"], "url"), ids):
        out = out.join(df, by, "left")
    out = out.join(outer, [key, "outer"], "left")
    urls = F.filter(F.array("itemid", "url", F.when(F.col("outer").isNotNull(), F.col("up.outer_id")), "outer_url"), lambda u: F.coalesce(u, F.lit("")) != "")
    return out.select(key, F.lit(1).alias("block"), F.lpad(F.col("scope").cast("string"), 9, "0").alias("place"), "listed", "updated", urls.alias("urls"), F.coalesce("identifiers", F.array().cast("array<string>")).alias("identifiers"))


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _texts(v: Column, depth: int = 3) -> Column:
    """The texts that a value stands for: itself, those of its items, or those of its ``value`` and ``@id``."""
    none = F.array().cast("array<string>")
    own = F.array(F.trim(F.try_variant_get(v, "$", "string")))
    if not depth:
        return F.when(_is(v, "STRING"), own).otherwise(none)
    items = F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: _texts(x, depth - 1)))
    named = F.concat(_texts(_member(v, "value"), depth - 1), _texts(_member(v, "@id"), depth - 1))
    return F.when(_is(v, "STRING"), own).when(_is(v, "ARRAY"), items).when(_is(v, "OBJECT"), named).otherwise(none)


def _all_texts(v: Column, names: tuple[str, ...]) -> Column:
    return F.filter(F.concat(*[_texts(_member(v, n)) for n in names]), lambda t: t != "")


def _levels(rows: DataFrame, deeper) -> DataFrame:
    """All rows met from ``rows`` down: JSON text is carried, as plain text, from level to level. ``deeper`` gives an array of structs of place, urls and json."""
    met = []
    for _ in range(MOST_LEVELS):
        rows = shared_checkpoint(rows)
        if rows.isEmpty():
            break
        met.append(rows)
        v = F.try_parse_json("json")
        fixed = [c for c in rows.columns if c not in ("place", "urls", "json")]
        rows = rows.select(*fixed, F.col("place").alias("__place"), F.inline(deeper(v))).withColumn("place", F.concat("__place", F.lit("."), "place")).drop("__place").where("json is not null")
    return _union(met) if met else rows


def _row(place: Column, urls: Column, v: Column) -> Column:
    return F.struct(F.lpad(place.cast("string"), 6, "0").alias("place"), urls.alias("urls"), F.to_json(v).alias("json"))


def json_ld(tree: DataFrame, key: str) -> DataFrame:
    """As ``microdata``, of the page's JSON-LD blocks."""
    data = tree.where("tag = '#data'").select(key, F.lpad(F.col("node").cast("string"), 9, "0").alias("place"), F.array().cast("array<string>").alias("urls"), F.col("text").alias("json"))
    listing = lambda v: F.exists(_texts(_member(v, "@type"), 1), lambda t: _short(t).isin(*LISTING_TYPES))

    def through(v: Column) -> Column:
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _row(i, F.col("urls"), x))
        page = F.array(_row(F.lit(0), F.array().cast("array<string>"), _member(v, "@graph")), _row(F.lit(1), F.concat("urls", _all_texts(v, ADDRESSES)), _member(v, "mainEntity")))
        return F.when(_is(v, "ARRAY"), items).when(_is(v, "OBJECT") & ~listing(v), page)

    v = F.try_parse_json("json")
    found = _levels(data, through).where(_is(v, "OBJECT") & listing(v)).select(key, F.col("place").alias("listing"), F.col("urls").alias("above"), F.lit("").alias("place"), F.array().cast("array<string>").alias("urls"), "json")

    def parts(v: Column) -> Column:
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _row(i, F.col("urls"), x))
        return F.when(_is(v, "ARRAY"), items).when(_is(v, "OBJECT"), F.array(*[_row(F.lit(i), F.col("urls"), _member(v, n)) for i, n in enumerate(PARTS)]))

    by = [key, "listing"]
    records = shared_checkpoint(_levels(found, parts).where(_is(v, "OBJECT")))
    dates = records.select(*by, "place", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.trim(F.try_variant_get(v, f"$['{n}']", "string")).alias("text"), _is(_member(v, n), "STRING").alias("ok")) for n in (*LISTED, *UPDATED)])).alias("d")).select(*by, "place", "d.*").where("ok")
    gathered = lambda name: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(name).alias("x")))), lambda r: r["x"])).alias(name)
    named = records.select(*by, "above", "place", _all_texts(v, ADDRESSES).alias("urls"), _all_texts(v, IDENTIFIERS).alias("identifiers")).groupBy(*by, "above").agg(gathered("urls"), gathered("identifiers"))
    order = ["place", "name"]
    out = named.join(_ranked(dates, by, LISTED, order, "listed"), by, "left").join(_ranked(dates, by, UPDATED, order, "updated"), by, "left")
    return out.select(key, F.lit(0).alias("block"), F.col("listing").alias("place"), "listed", "updated", F.concat("above", "urls").alias("urls"), "identifiers")


def _page(url: Column, base: Column) -> Column:
    """Struct of an address's origin, path without a closing slash, and query; relative to ``base``."""
    from lotwise.sources.html import absolute

    whole = F.substring_index(absolute(url, base), "#", 1)
    origin = F.lower(F.regexp_extract(whole, r"^([A-Za-z][\w+.-]*://[^/?]*)", 1))
    rest = F.substr(whole, F.length(origin) + 1)
    path = F.substring_index(rest, "?", 1)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise("/")
    return F.struct(origin.alias("origin"), path.alias("path"), F.when(F.contains(rest, F.lit("?")), F.substring_index(rest, "?", -1)).otherwise("").alias("query"))


def same_page(a: Column, b: Column) -> Column:
    """Whether two addresses name one page; a query counts only where both have one."""
    x, y = _page(a, b), _page(b, b)
    return (x["origin"] == y["origin"]) & (x["path"] == y["path"]) & ((x["query"] == y["query"]) | (x["query"] == "") | (y["query"] == ""))


def date_candidates(pages: DataFrame, key: str = "page_id", vin: str | None = None, html: str = "html", url: str = "url") -> DataFrame:
    """(key, candidate, kind, listed, updated): a page's listings in order, those of JSON-LD first."""
    name, key = key, "__page"  # a key may be named as a column of nodes is
    pages = pages.withColumn(key, F.col(name))
    # pages are dealt out before they are read: a small file is few tasks
    tree = shared_table(nodes(pages.select(key, html).repartition(key), key, html).repartition(key))
    found = json_ld(tree, key).unionByName(microdata(tree, key))
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    own = plain(F.col(vin)) if vin else F.lit(None).cast("string")
    about = pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"), own.alias("__vin"))
    rows = found.join(about, F.col(key) == F.col("__key"))
    mine = F.exists("urls", lambda u: F.coalesce(same_page(u, F.col("__url")), F.lit(False))) | F.exists("identifiers", lambda i: F.coalesce(plain(i) == F.col("__vin"), F.lit(False)))
    kind = F.when(mine, "proven").when((F.size("urls") > 0) | (F.size("identifiers") > 0), "unmatched").otherwise("anonymous")
    each = rows.select(key, F.struct("block", "place", kind.alias("kind"), "listed", "updated").alias("c")).groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("c"))
    return each.select(key, F.posexplode("c").alias("candidate", "c")).select(F.col(key).alias(name), "candidate", "c.kind", "c.listed", "c.updated")

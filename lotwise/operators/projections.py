"""Shapes of rows for readers: masks, nesting, evidence, and hero pictures."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions import canonical, text
from lotwise.functions.numeric import bucket
from lotwise.operators.groups import top_k


def masked(df: DataFrame) -> DataFrame:
    """PRJ02: a private seller's phone is hidden and the name generic."""
    private = F.col("seller_type") == "private"
    return df.withColumns({"dealer_phone": F.when(~F.coalesce(private, F.lit(False)), F.col("dealer_phone")), "dealer_name": F.when(private, "For Sale By Owner").otherwise(F.col("dealer_name"))})


def settled(value: Column, resolution: Column) -> Column:
    """PRJ03: a conflicting field shows as unknown."""
    return F.when(resolution == "conflicting", "unknown").otherwise(value)


def search_document(df: DataFrame) -> DataFrame:
    """PRJ01: the flat document of a listing, with canonical values, buckets and group key."""
    c, none = F.col, F.lit(None).cast("string")
    maker = canonical.converter(c("conversion_manufacturer"))
    out = masked(df).withColumns({
        "vehicle_group_key": F.coalesce("vehicle_id", "id"), "make": F.coalesce(canonical.make(none, c("make")), "make"), "model": F.coalesce(canonical.model(none, c("model")), "model"),
        "color": canonical.color(c("color")), "fuel_type": canonical.fuel(c("fuel_type"), c("engine")), "transmission": canonical.transmission(c("transmission")), "city_state": text.city_state(c("city"), c("state")),
        "price_bucket": bucket(c("price_cents") / 100, 5000), "mileage_bucket": bucket(c("mileage"), 12000), "conversion_manufacturer": maker, "conversion_brand": canonical.brand_slug(maker),
        "wheelchair_capacity": F.when(c("wheelchair_capacity").between(1, 6), c("wheelchair_capacity")),
    })
    return out.drop("engine")


def nested(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """PRJ04: named structs of columns; the other columns stay."""
    inner = {c for each in groups.values() for c in each}
    return df.select(*[c for c in df.columns if c not in inner], *[F.struct(*each).alias(name) for name, each in groups.items()])


def public_evidence(claims: Column, fields_: list[str], least: float = 0.85) -> Column:
    """PRJ08: claims of allowed fields with enough confidence, from JSON."""
    each = F.from_json(claims, "array<struct<field:string,value:string,confidence:double>>")
    return F.filter(each, lambda c: c["field"].isin(*fields_) & (c["confidence"] >= least))


def promoted(images: Column, hero: Column) -> Column:
    """PRJ07: the hero first, the order of the rest kept."""
    return F.when(F.array_contains(images, hero), F.concat(F.array(hero), F.filter(images, lambda x: x != hero))).otherwise(images)


def hero(images: DataFrame, listing: str = "listing_id") -> DataFrame:
    """WIN12, DOM12: per listing the best picture: eligible ones by score, position and id. A cluster of other vehicles' pictures or a placeholder is not eligible."""
    fine = (F.col("kind") == "vehicle_photo") & ~F.coalesce("placeholder", F.lit(False)) & ~F.coalesce("cross_vehicle", F.lit(False))
    return top_k(images.where(fine), [listing], [F.desc_nulls_last("score"), "position", "id"])


def seeded(images: Column, cards: Column) -> Column:
    """ARR03: card pictures where there are none."""
    return F.when(F.size(images) == 0, cards).otherwise(images)


def all_https(images: Column) -> Column:
    """JON18, FLT17: whether no picture is fetched without encryption."""
    return ~F.exists(images, lambda x: ~x.rlike("(?i)^https://"))


def signals_json(signals: Column) -> Column:
    """JSN02: ``{score, signals}`` of weighted signals."""
    return F.to_json(F.struct(F.aggregate(signals, F.lit(0), lambda s, x: s + x["weight"]).alias("score"), signals.alias("signals")))


def claims_valid(raw: Column, labels: list[str], fields_: list[str]) -> Column:
    """ARR05: whether JSON has the shape of an analysis: a version, labels and claims that are known, not blank, and sure to a degree of 0 to 1."""
    v = F.try_parse_json(raw)
    at = lambda x, path, kind: F.try_variant_get(x, path, kind)
    kind = lambda x, path: F.regexp_extract(F.schema_of_variant(F.try_variant_get(x, path, "variant")), "^[A-Z]+", 0)
    each = lambda path: F.try_variant_get(v, path, "array<variant>")
    sure = lambda e: kind(e, "$.confidence").isin("BIGINT", "DECIMAL", "DOUBLE") & at(e, "$.confidence", "double").between(0, 1)
    text_or_null = lambda path: kind(v, path).isin("STRING", "VOID")
    fine = (
        (kind(v, "$.schemaVersion") == "STRING") & (at(v, "$.schemaVersion", "string") != "") & text_or_null("$.altText") & text_or_null("$.summary")
        & (kind(v, "$.labels") == "ARRAY") & F.forall(each("$.labels"), lambda e: at(e, "$.label", "string").isin(*labels) & sure(e))
        & (kind(v, "$.fieldClaims") == "ARRAY")
        & F.forall(each("$.fieldClaims"), lambda e: at(e, "$.field", "string").isin(*fields_) & (at(e, "$.claimedValue", "string") != "") & sure(e))
    )
    return F.coalesce(fine, F.lit(False))


def facet_document(df: DataFrame) -> DataFrame:
    """PRJ05: the fields of a search document that facets and reconciliation read."""
    return df.select(*FACET_FIELDS)


FACET_FIELDS = [
    "id", "source_id", "vehicle_id", "make", "model", "trim", "year", "price_bucket", "mileage_bucket", "state", "condition", "conversion_type", "color", "ramp_type",
    "seller_type", "conversion_brand", "wav_features",
]


def competing_claims(claims: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """PRJ10: one row per listing and field with parallel arrays of its latest claims; a slot has one claim, so arrays are as long as a field has sources."""
    each = F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"__{o}") for o in order], "claimed_value", "evidence_kind", "source_ref", "observed_at")))
    part = lambda name: F.transform("__c", lambda x: x[name])
    names = {"claimed_value": "competing_values", "evidence_kind": "evidence_kinds", "source_ref": "source_refs", "observed_at": "observed_ats"}
    return claims.groupBy(*keys).agg(each.alias("__c")).select(*keys, *[part(c).alias(n) for c, n in names.items()])


def stable_key_of(params: Column) -> Column:
    """MAP02 for a map of lists: names and lists in order, as JSON."""
    entries = F.array_sort(F.map_entries(params))
    return F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.array_sort(e["value"])))))


def stable_key(params: dict) -> str:
    """MAP02: one text for equal parameters: names and lists in order, as JSON."""
    return json.dumps({k: sorted(v) if isinstance(v, list) else v for k, v in sorted(params.items())}, separators=(",", ":"))


def dhash(pixels: Column) -> Column:
    """MTH04: 64 bits, left brighter than right, of 8 rows of 9 grey bytes. Expressions only."""
    at = lambda i: F.conv(F.hex(F.substring(pixels, i + 1, 1)), 16, 10).cast("int")
    bits = F.array(*[F.when(at(9 * r + c) > at(9 * r + c + 1), F.expr("1L")).otherwise(F.expr("0L")) for r in range(8) for c in range(8)])
    return F.when(F.octet_length(pixels) == 72, F.aggregate(bits, F.expr("0L"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b)))


#: Each tunable's default, least and greatest value.
TUNABLES = {"poll_batch": (500, 1, 5000), "poll_batches": (20, 1, 100), "page_ttl_days": (30, 1, 365), "facet_ttl_seconds": (60, 0, 3600)}


def settings(raw: dict[str, Column]) -> Column:
    """MTH11 for rows of texts: a struct of tunables; what is no whole number takes the default, and what is out of bounds the nearest bound."""
    return F.struct(*[F.least(F.greatest(F.coalesce(F.when(c.rlike(r"^\s*-?\d+\s*$"), F.trim(c).try_cast("long")), F.lit(default).cast("long")), F.lit(lo).cast("long")), F.lit(hi).cast("long")).alias(n) for n, (default, lo, hi) in TUNABLES.items() for c in (raw.get(n, F.lit(None).cast("string")),)])


@dataclass(frozen=True)
class Settings:
    """MTH11: tunables with bounds; what is out of bounds or no whole number takes the nearest bound or the default."""

    poll_batch: int = 500
    poll_batches: int = 20
    page_ttl_days: int = 30
    facet_ttl_seconds: int = 60

    @classmethod
    def of(cls, raw: dict) -> Settings:
        bounds = {"poll_batch": (1, 5000), "poll_batches": (1, 100), "page_ttl_days": (1, 365), "facet_ttl_seconds": (0, 3600)}
        out = {}
        for f in fields(cls):
            v = raw.get(f.name, f.default)
            v = v if isinstance(v, int) and not isinstance(v, bool) else f.default
            out[f.name] = min(max(v, bounds[f.name][0]), bounds[f.name][1])
        return cls(**out)

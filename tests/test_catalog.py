"""A small catalogue end to end: rows in; gate, representatives, search documents and facets out."""

import datetime as dt
from collections import defaultdict

from pyspark.sql import functions as F

from lotwise.operators import facets, filters, projections, quality
from lotwise.operators.groups import completeness, scored_representative

FIELDS = """id string, status string, came_with string, source_id string, make string, model string, trim string, year int, condition string, seller_type string, price_cents long, mileage int,
 color string, conversion_type string, conversion_manufacturer string, ramp_type string, wav_features array<string>, vin string, state string"""
ALL = ["transfer_seat", "lowered_floor", "power_ramp", "kneel_system", "tie_down_system", "automatic_door"]
ROWS = [
    ("private-no-optional-fields", "active", "", "blvd", "Chrysler", "Pacifica", "Touring L", 2020, "used", "private", None, None, None, "unknown", None, "unknown", [], None, None),
    ("duplicate-a-blvd", "active", "", "blvd", "Ford", "Transit", "XL", 2019, "used", "dealer", 2_800_000, 80_000, None, "rear_entry", None, "fold_out", ["tie_down_system"], "1FTFW1XT0EFA12345", "TX"),
    ("duplicate-b-mobilityworks", "active", "", "mw", "Ford", "Transit", "XL", 2019, "used", "dealer", 2_850_000, 79_500, "Silver", "rear_entry", "Braun", "fold_out", ["tie_down_system", "automatic_door"], "1FTFW1XT0EFA12345", "TX"),
    ("quarantined-bad-year", "active", "", "blvd", "Dodge", "Grand Caravan", "SXT", 1800, "used", "dealer", 1_500_000, 120_000, None, "rear_entry", None, "fold_out", [], None, "NY"),
    ("pending-never-resolved", "active", "pending", "pending", "Toyota", "Sienna", "LE", 2018, "used", "dealer", 2_600_000, 95_000, None, "side_entry", None, "in_floor", [], None, "FL"),
    ("gone-after-eligible", "gone", "", "mw", "Honda", "Odyssey", "Touring", 2020, "used", "dealer", 3_200_000, 60_000, None, "side_entry", None, "in_floor", [], None, "NV"),
    ("bucket-boundaries", "active", "", "blvd", "Ram", "ProMaster", "Cargo", 2023, "used", "dealer", 5_000_000, 24_000, "Guard", "rear_entry", "Freedom Motors", "fold_in", ["automatic_door"], None, "AZ"),
    ("conversion-brand-alias", "active", "", "mw", "Chrysler", "Pacifica", "Limited", 2021, "used", "dealer", 4_100_000, 45_000, "Rapid Red", "rear_entry", "ams", "in_floor", ["hand_controls", "motorized_running_board"], None, "OH"),
    ("extra-diversity", "active", "", "blvd", "Toyota", "Sienna", "Limited", 2023, "new", "dealer", 6_000_000, 10, "Ingot Silver", "side_entry", "Rollx Vans", "none", ["transfer_seat"], None, "IL"),
    ("blvd-normal", "active", "", "blvd", "Toyota", "Sienna", "XLE", 2022, "used", "dealer", 7_199_100, 50_094, "Celestial Silver", "rear_entry", "Driverge", "fold_out", ALL, None, "CO"),
    ("mobilityworks-normal", "active", "", "mw", "Toyota", "Sienna", "XLE", 2022, "used", "dealer", 6_825_000, 14_200, "Blueprint", "side_entry", "BraunAbility", "in_floor", ["hand_controls", *ALL], None, "GA"),
]
EXPECTED = {
    "make": {"Toyota": 3, "Chrysler": 2, "Ford": 1, "Ram": 1},
    "model": {"Sienna": 3, "Pacifica": 2, "Transit": 1, "ProMaster": 1},
    "trim": {"XLE": 2, "Limited": 2, "Touring L": 1, "XL": 1, "Cargo": 1},
    "year": {"2019": 1, "2020": 1, "2021": 1, "2022": 2, "2023": 2},
    "condition": {"used": 6, "new": 1},
    "seller_type": {"dealer": 6, "private": 1},
    "color": {"Silver": 2, "Celestial silver": 1, "Blueprint": 1, "Green": 1, "Red": 1},
    "conversion_type": {"rear_entry": 4, "side_entry": 2, "unknown": 1},
    "ramp_type": {"fold_out": 2, "in_floor": 2, "fold_in": 1, "none": 1, "unknown": 1},
    "conversion_brand": {"braunability": 2, "driverge": 1, "freedom-motors": 1, "ams-vans": 1, "rollx-vans": 1},
    "wav_features": {"transfer_seat": 3, "tie_down_system": 3, "automatic_door": 4, "lowered_floor": 2, "power_ramp": 2, "kneel_system": 2, "hand_controls": 2, "motorized_running_board": 1},
    "price_bucket": {"25000-30000": 1, "40000-45000": 1, "50000-55000": 1, "60000-65000": 1, "65000-70000": 1, "70000-75000": 1},
    "mileage_bucket": {"0-12000": 1, "12000-24000": 1, "24000-36000": 1, "36000-48000": 1, "48000-60000": 1, "72000-84000": 1},
}
COMPLETE = ["trim", "vin", "price_cents", "mileage", "color", "conversion_manufacturer"]


def catalogue(spark):
    none = lambda k: F.lit(None).cast(k)
    when = F.lit(dt.datetime(2026, 1, 1))
    return spark.createDataFrame(ROWS, FIELDS).withColumns({
        "source_record_key": F.col("id"), "external_id": none("string"), "stock_number": none("string"), "city": none("string"), "zip": none("string"), "floor_lowering_inches": none("double"), "wheelchair_capacity": none("int"),
        "images": F.array().cast("array<string>"), "source_url": F.concat(F.lit("https://x.example/"), "id"), "buyer_url": none("string"), "dealer_name": F.lit("Catalog Test Dealer"), "dealer_phone": F.lit("5"), "sale_status": F.lit("active"),
        "sold_at": none("timestamp"), "description": none("string"), "detail_scraped_at": when, "detail_stale_at": none("timestamp"), "quality_checked_at": when, "vehicle_model_id": none("string"), "vehicle_id": F.col("vin"),
        "fuel_type": none("string"), "engine": none("string"), "transmission": none("string"), "listed_at": when, "source_status": F.when(F.col("source_id") == "pending", "pending").otherwise("active"),
    })


def test_catalogue(spark):
    resolved = quality.resolve_listings(catalogue(spark))
    state = {r["id"]: (r["publication_status"], [i["rule"] for i in r["issues"]]) for r in resolved.collect()}
    assert state["quarantined-bad-year"] == ("quarantined", ["implausible_year"])
    assert [k for k, (s, _) in state.items() if s != "eligible"] == ["quarantined-bad-year"]
    # a listing that was never resolved keeps what it came with
    rows = resolved.withColumn("publication_status", F.coalesce(F.nullif("came_with", F.lit("")), "publication_status"))
    shown = rows.where(filters.published())
    assert shown.count() == 8
    one = scored_representative(shown, [F.coalesce("vehicle_id", "id")], completeness(COMPLETE), "listed_at", "id")
    docs = projections.search_document(one).cache()
    assert docs.count() == 7 and {r["id"] for r in docs.select("id").collect()} >= {"duplicate-b-mobilityworks"}
    private = docs.where("seller_type = 'private'").first()
    assert (private["dealer_name"], private["dealer_phone"]) == ("For Sale By Owner", None)
    assert projections.facet_document(docs).columns == projections.FACET_FIELDS
    got = defaultdict(dict)
    for r in facets.facet_counts(docs, [f for f in EXPECTED if f != "wav_features"], ["wav_features"]).collect():
        got[r["facet"]][r["value"]] = r["n"]
    assert got == EXPECTED
    # a facet keeps its own values when one of them is chosen; the others narrow
    s = filters.Search(any_of={"make": ["Toyota"], "condition": ["used"]})
    narrowed = defaultdict(dict)
    for r in facets.disjunctive_facets(docs, s, ["make", "condition", "model"]).collect():
        narrowed[r["facet"]][r["value"]] = r["n"]
    assert narrowed == {"make": {"Toyota": 2, "Chrysler": 2, "Ford": 1, "Ram": 1}, "condition": {"used": 2, "new": 1}, "model": {"Sienna": 2}}


def test_catalogue_again_without_a_representative(spark):
    """When the better of two rows goes, the other stands for the vehicle."""
    rows = quality.resolve_listings(catalogue(spark).where("id like 'duplicate%'"))
    first = scored_representative(rows.where("id <> 'duplicate-b-mobilityworks'"), ["vehicle_id"], completeness(COMPLETE), "listed_at", "id")
    assert [r["id"] for r in first.collect()] == ["duplicate-a-blvd"]

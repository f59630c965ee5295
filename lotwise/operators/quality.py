"""Rules over listings: validation, publication, readiness, drift and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.numeric import vin_check_digit, vin_normal, vin_valid
from lotwise.operators.scans import smoothed

# Fixed values.
STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO",
    "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
]
BLEED = r"(?i)\b(?:Mileage|Conv\s*Make|Conversion|Location|Request\s+Information|Schedule\s+a\s+Test\s+Drive)|Stock\s*:"
EVIDENCE_FEATURES = ["has_lift", "power_ramp", "kneel_system", "lowered_floor"]
BLOCKING_WARNS = ["unsupported_accessibility_claim"]
YEARS, PRICES = (1990, 2028), (50_000, 50_000_000)
MOST_MILES, MOST_INCHES, MOST_CHAIRS, MOST_IMAGES = 400_000, 14, 6, 60


def issue(when: Column, field: str, value: Column | str, rule: str, family: str, severity: str) -> Column:
    text = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.when(when, F.struct(F.lit(field).alias("field"), F.substring(F.coalesce(text, F.lit("")), 1, 120).alias("value"), F.lit(rule).alias("rule"), F.lit(family).alias("family"), F.lit(severity).alias("severity")))


def validate(last_year: int = YEARS[1]) -> Column:
    """DOM01: the issues of a listing, in the order of the rules."""
    c = F.col
    url = lambda x: x.rlike(r"(?i)^https?://[^/\s]+")
    vin = vin_normal(c("vin"))
    evidence = (c("conversion_type") != "unknown") | (c("ramp_type") != "unknown") | c("floor_lowering_inches").isNotNull() | c("wheelchair_capacity").isNotNull()
    claimed = F.get(F.filter("wav_features", lambda f: f.isin(*EVIDENCE_FEATURES)), F.lit(0))
    bad_image = F.get(F.filter("images", lambda i: ~url(i)), F.lit(0))
    rules = [
        issue(F.contains(c("source_record_key"), F.lit(" ")), "source_record_key", c("source_record_key"), "contains_space", "structural", "error"),
        *[issue(c(f).rlike(BLEED), f, c(f), "field_label_bleed", "structural", "warn") for f in ("external_id", "stock_number", "color", "conversion_manufacturer", "city", "state")],
        issue(c("city").rlike(r"\d"), "city", c("city"), "contains_digits", "structural", "warn"),
        issue(~c("state").isin(*STATES) & (c("state") != ""), "state", c("state"), "invalid_format", "format", "warn"),
        issue(~c("zip").rlike(r"^\d{5}(-\d{4})?$") & (c("zip") != ""), "zip", c("zip"), "invalid_format", "format", "warn"),
        issue(c("year").isNull() | ~c("year").between(YEARS[0], last_year), "year", c("year"), "implausible_year", "plausibility", "error"),
        issue(c("price_cents") < 0, "price_cents", c("price_cents"), "negative_value", "format", "error"),
        issue((c("price_cents") > 0) & ~c("price_cents").between(*PRICES), "price_cents", c("price_cents"), "implausible_value", "plausibility", "warn"),
        F.coalesce(
            issue(c("mileage") < 0, "mileage", c("mileage"), "negative_value", "format", "error"),
            issue(c("mileage") > MOST_MILES, "mileage", c("mileage"), "implausible_value", "plausibility", "warn"),
            issue((c("condition") == "new") & (c("mileage") > 500), "mileage", c("mileage"), "new_with_high_mileage", "cross_field", "warn"),
        ),
        issue(~c("floor_lowering_inches").between(0, MOST_INCHES), "floor_lowering_inches", c("floor_lowering_inches"), "implausible_value", "plausibility", "warn"),
        issue(~c("wheelchair_capacity").between(1, MOST_CHAIRS), "wheelchair_capacity", c("wheelchair_capacity"), "implausible_value", "plausibility", "warn"),
        issue(F.size("images") > MOST_IMAGES, "images", F.size("images"), "implausible_value", "plausibility", "warn"),
        issue(bad_image.isNotNull(), "images", bad_image, "invalid_format", "format", "warn"),
        issue(c("source_url").isNull() | ~url(c("source_url")), "source_url", c("source_url"), "malformed_source_url", "format", "error"),
        issue((c("buyer_url") != "") & ~url(c("buyer_url")), "buyer_url", c("buyer_url"), "invalid_format", "format", "warn"),
        F.coalesce(
            issue((c("vin") != "") & ~vin_valid(vin), "vin", c("vin"), "unparseable_vin", "format", "error"),
            issue((c("vin") != "") & ~vin_check_digit(vin), "vin", vin, "invalid_check_digit", "format", "warn"),
        ),
        issue(F.coalesce(c("make"), F.lit("")).isin("") | F.coalesce(c("model"), F.lit("")).isin(""), "make_model", F.concat(F.coalesce(c("make"), F.lit("")), F.lit("/"), F.coalesce(c("model"), F.lit(""))), "missing_identity_field", "completeness", "error"),
        issue((c("seller_type") == "dealer") & F.coalesce(c("dealer_name"), F.lit("")).isin(""), "dealer.name", "", "missing_required_field", "completeness", "warn"),
        issue((c("condition") != "new") & c("price_cents").isNull() & (c("seller_type") == "dealer"), "price_cents", "", "missing_conditional_field", "completeness", "warn"),
        issue((c("sale_status") == "sold") & c("sold_at").isNull(), "sold_at", "", "sold_without_sold_at", "cross_field", "warn"),
        issue(c("sale_status").isin("active", "pending") & c("sold_at").isNotNull(), "sale_status", c("sale_status"), "active_with_sold_at", "cross_field", "error"),
        issue((c("sale_status") == "gone") & (F.size("images") > 0) & (c("description") != ""), "sale_status", c("sale_status"), "gone_with_full_detail", "cross_field", "warn"),
        issue(~evidence & claimed.isNotNull(), "wav_features", claimed, "unsupported_accessibility_claim", "cross_field", "warn"),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def decoded_mismatch(make: tuple, model: tuple, year: tuple) -> Column:
    """DOM02: scraped against decoded identity; a year may differ by one."""
    text = lambda p: F.concat(F.lit("scraped="), p[0].cast("string"), F.lit(" decoded="), p[1].cast("string"))
    apart = lambda p: F.lower(F.trim(p[0])) != F.lower(F.trim(p[1]))
    rules = [issue(apart(make), "make", text(make), "nhtsa_make_mismatch", "authoritative", "error"), issue(apart(model), "model", text(model), "nhtsa_model_mismatch", "authoritative", "error"), issue(F.abs(year[0] - year[1]) > 1, "year", text(year), "nhtsa_year_mismatch", "authoritative", "error")]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def publication(issues: Column) -> Column:
    """DOM03: struct of status and distinct issue codes."""
    stop = F.exists(issues, lambda i: (i["severity"] == "error") | i["rule"].isin(*BLOCKING_WARNS))
    return F.struct(F.when(stop, "quarantined").otherwise("eligible").alias("status"), F.array_distinct(F.transform(issues, lambda i: i["rule"])).alias("codes"))


def readiness() -> Column:
    """DOM04: struct of ready, blockers and warnings."""
    c = F.col
    named = lambda pairs: F.filter(F.array(*[F.when(w, n) for w, n in pairs]), lambda x: x.isNotNull())
    no_vin = c("vin").isNull() | (F.trim("vin") == "")
    unchecked = c("detail_scraped_at").isNull() | c("quality_checked_at").isNull() | (c("quality_checked_at") < c("detail_scraped_at")) | (c("publication_status") != "eligible")
    blockers = named([(c("detail_scraped_at").isNull(), "detail_not_crawled"), (c("detail_scraped_at").isNotNull() & c("detail_stale_at").isNotNull(), "detail_stale"), (unchecked, "not_validated_after_detail"), (F.size("images") == 0, "no_images"), (~no_vin & c("vehicle_model_id").isNull(), "vin_not_decoded"), (c("conversion_type") == "unknown", "conversion_type_unresolved")])
    warnings = named([(no_vin, "no_vin"), (c("conversion_type") == "unknown", "conversion_type_unknown"), (c("city").isNull() | (F.trim("city") == ""), "no_city")])
    return F.struct((F.size(blockers) == 0).alias("ready"), blockers.alias("blockers"), warnings.alias("warnings"))


def resolve_listings(df: DataFrame) -> DataFrame:
    """DOM05: issues, then publication, then readiness under the new status, then what may be shown."""
    rows = df.withColumn("issues", validate()).withColumn("publication", publication(F.col("issues")))
    rows = rows.withColumn("publication_status", F.col("publication.status")).withColumn("readiness", readiness())
    return rows.withColumn("shown", (F.col("publication_status") == "eligible") & F.col("readiness.ready"))


def summary(df: DataFrame, issues: str = "issues") -> DataFrame:
    """AGG18: one row of totals, with issues per rule."""
    has = lambda s: F.exists(issues, lambda i: i["severity"] == s)
    rules = df.select(F.explode(issues).alias("i")).groupBy("i.rule").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "count")))).alias("by_rule"))  # as many as rules
    totals = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size(issues) > 0).alias("with_issues"), F.count_if(has("error")).alias("with_errors"), F.count_if(has("warn")).alias("with_warnings"))
    return totals.join(F.broadcast(rules), F.lit(True), "left")


def drift(df: DataFrame, source: str, run: str, rates: list[str], alpha: float = 0.2, threshold: float = 0.15) -> DataFrame:
    """MTH08, STM09: each run's rates against the smoothed rates of the runs before; the first run only seeds them."""
    out = smoothed(df, [source], [run], rates, alpha)
    apart = [F.coalesce(F.col(r) - F.col(f"{r}_before") > threshold, F.lit(False)) for r in rates]
    out = out.withColumn("drifted", F.greatest(*apart) if len(apart) > 1 else apart[0])
    return out.select(*df.columns, *[F.col(f"{r}_before").alias(f"{r}_baseline") for r in rates], "drifted")


def systemic(errors: Column, total: Column, rate: float = 0.2, least: int = 5) -> Column:
    """STM10: a run is stopped at this error rate, from this many rows on."""
    return (total >= least) & (errors / total >= rate)

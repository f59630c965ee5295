"""VINs, bits, distances, dates and buckets. Column builders only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the North American check digit.
VIN_LETTERS, VIN_VALUES = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
EARTH_MILES = 3958.8


def vin_normal(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]", "")


def vin_valid(v: Column) -> Column:
    return (F.length(v) == 17) & ~v.rlike("[IOQ]")


def vin_check_digit(v: Column) -> Column:
    """STR13: whether position 9 is the weighted sum modulo 11."""
    digits = F.split(F.translate(v, VIN_LETTERS, VIN_VALUES), "")
    weighted = F.zip_with(digits, F.array(*map(F.lit, VIN_WEIGHTS)), lambda d, w: d.try_cast("int") * w)
    rest = F.aggregate(weighted, F.lit(0), lambda a, x: a + x) % 11
    return F.when(vin_valid(v), F.substring(v, 9, 1) == F.when(rest == 10, "X").otherwise(rest.cast("string"))).otherwise(False)


def vin_from_slug(url: Column) -> Column:
    """STR40: struct of vin and issue codes from a URL's last part; a wrong check digit keeps the VIN."""
    v = vin_normal(F.regexp_extract(url, r"([A-Za-z0-9]+)/?$", 1))
    return F.struct(F.when(vin_valid(v), v).alias("vin"), F.when(~vin_valid(v), "unparseable_vin").when(~vin_check_digit(v), "invalid_check_digit").alias("issue"))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """MTH01: miles."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_MILES * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex_to_long(c: Column) -> Column:
    """MTH03: 16 hex digits as a signed number."""
    return F.conv(c, 16, -10).cast("long")


def long_to_hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def bucket(value: Column, width: int) -> Column:
    """AGG13, AGG14, MTH07: ``lo-hi`` of fixed width; null stays null."""
    lo = (F.floor(value / width) * width).cast("long")
    return F.when(value.isNotNull(), F.concat(lo.cast("string"), F.lit("-"), (lo + width).cast("string")))


def bucket_low(b: Column) -> Column:
    return F.split(b, "-")[0].cast("long")


def days_between(end: Column, start: Column) -> Column:
    """DAT03: fractional days."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86400e6)


def nhtsa_date(c: Column) -> Column:
    """DAT05: ``yyyymmdd`` or ``d/M/yyyy``; anything else is the epoch."""
    t = F.trim(c)
    return F.coalesce(F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd"))), F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(t, F.lit("d/M/yyyy"))), F.timestamp_seconds(F.lit(0)))


def iso_date(c: Column) -> Column:
    """DAT06."""
    return F.try_to_timestamp(c)


def nanos_to_timestamp(c: Column) -> Column:
    """DAT08: to milliseconds, downwards. Whole-number division: nanoseconds have more digits than a double."""
    n = F.lit(1_000_000).cast("long")
    return F.timestamp_millis(F.call_function("div", c - F.pmod(c, n), n))


def timeline_position(at: Column, now: Column, hours: int = 24) -> Column:
    """DAT07: struct of percent within now ± hours, clamped, and whether it overflowed."""
    span = F.lit(hours * 3600.0)
    off = days_between(at, now) * 86400.0
    return F.struct(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (off + span) / (2 * span) * 100)).alias("percent"), (F.abs(off) > span).alias("overflow"))


def price_band(price: Column, p10: Column, p25: Column, p50: Column, p75: Column, p90: Column) -> Column:
    """MTH13: struct of the band that a price falls in and its whole percent from the median."""
    band = F.when(price < p10, "below_p10").when(price < p25, "p10_p25").when(price < p50, "p25_p50").when(price <= p75, "p50_p75").when(price <= p90, "p75_p90").otherwise("above_p90")
    return F.struct(band.alias("band"), F.round((price - p50) / p50 * 100).cast("long").alias("percent"))


def ewma(values: Column, alpha: float = 0.2) -> Column:
    """MTH08: exponentially weighted mean over an ordered array, seeded by its first value."""
    return F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda m, x: m * (1 - alpha) + x * alpha)


def tolerance(a: Column, b: Column, fraction: float) -> Column:
    """MTH09: within a fraction of the lower."""
    return F.abs(a - b) <= F.least(a, b) * fraction

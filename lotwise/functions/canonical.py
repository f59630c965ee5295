"""Canonical values of listing fields. Unknown input gives null, never a guess. Column builders only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.text import first_containing, first_match, lookup, title_case

# They must be as data sources spell them and as readers see them.
COLOR_SUFFIXES = (
    "metallic|pearl|pearlescent|mica|crystal|clearcoat|coat|tinted|tint|effect|edition|special|premium|plus|ultra|brilliant|bright|deep|dark|light|"
    "vivid|rich|solid|matte|satin|gloss|glossy|frost|frosted|ice|icy|chrome|shimmer|shimmering|gleam|gleaming|radiant|lustrous|luster|lustre|iridescent|"
    "tri-?coat|bi-?coat|two-?tone|tone"
)
NO_COLOR = ["unknown", "n/a", "na", "tbd", "none"]
COLORS = {
    "oxford white": "White",
    "arctic white": "White",
    "bright white": "White",
    "glacier white": "White",
    "star white": "White",
    "shadow black": "Black",
    "agate black": "Black",
    "jet black": "Black",
    "piano black": "Black",
    "magnetic gray": "Gray",
    "magnetic grey": "Gray",
    "iconic silver": "Silver",
    "carbonized gray": "Gray",
    "carbonized grey": "Gray",
    "antimatter blue": "Blue",
    "rapid red": "Red",
    "area 51": "Teal",
    "cactus gray": "Gray",
    "cactus grey": "Gray",
    "copper canyon": "Brown",
    "stone gray": "Gray",
    "stone grey": "Gray",
    "ingot silver": "Silver",
    "diffused silver": "Silver",
    "guard": "Green",
    "guard green": "Green",
}
ENGINE = (
    r"\b(?:\d+\.\d+\s*[Ll]|v[468]|[46]-?cyl(?:inder)?|dohc|sohc|ohv|ohc|hemi|ecoboost|vtec|vvt|i[346]|inline[346]|"
    r"diesel\s+engine|turbocharged|supercharged)\b"
)
FUELS = [
    (r"\bplug.?in\s+hybrid\b", "plug-in hybrid"),
    (r"\bphev\b", "plug-in hybrid"),
    (r"\bhybrid\b", "hybrid"),
    (r"\belectric\b|\bbev\b|\bev\b", "electric"),
    (r"\bdiesel\b", "diesel"),
    (r"\bhydrogen\b|\bfuel\s+cell\b|\bfcev\b", "hydrogen"),
    (r"\bnatural\s+gas\b|\bcng\b", "natural gas"),
    (r"\bgasoline\b|\bgas\b|\bpetrol\b|\bunleaded\b|\bregular\b|\bpremium\b", "gasoline"),
]
MAKES = {
    "CHRYSLER": "Chrysler",
    "DODGE": "Dodge",
    "FORD": "Ford",
    "HONDA": "Honda",
    "TOYOTA": "Toyota",
    "VOLKSWAGEN": "Volkswagen",
    "CHEVROLET": "Chevrolet",
    "GMC": "GMC",
    "KIA": "Kia",
    "HYUNDAI": "Hyundai",
    "NISSAN": "Nissan",
    "MERCEDES-BENZ": "Mercedes-Benz",
    "MERCEDES": "Mercedes-Benz",
    "RAM": "Ram",
}
MODELS = {
    "GRAND CARAVAN": "Grand Caravan",
    "TOWN AND COUNTRY": "Town & Country",
    "TOWN & COUNTRY": "Town & Country",
    "PACIFICA": "Pacifica",
    "TRANSIT": "Transit",
    "T-350": "Transit",
    "T350": "Transit",
    "TRANSIT CONNECT": "Transit Connect",
    "TRANSIT T-350": "Transit",
    "SIENNA": "Sienna",
    "ODYSSEY": "Odyssey",
    "CARAVELLE": "Caravelle",
    "PROMASTER": "ProMaster",
}
MISSING = ["unknown", "n/a", "na", "none", "null", "undefined", "tbd", "", "-", "--", "not available", "not applicable", "not listed", "not provided"]
NO_CONVERTER = [
    r"^\d{4}$",
    r"^(?:non|wav|wheelchair|adapted|adaptation|handicap|disabled|mobility|accessible|converted|conversion|adapted\s+vehicle|wheelchair\s+van)$",
    r"^(?:vehicle|used|new|stock|dealer|inventory|listing|see\s+description|call\s+for\s+details)$",
]
CONVERTERS = [
    "BraunAbility", "braunability", "Braun", "braun", "VMI", "vmi", "AMS Vans", "ams", "ams vans", "Freedom Motors", "freedom motors", "freedom",
    "Rollx Vans", "rollx vans", "rollx", "Vantage Mobility", "vantage mobility", "vantage", "Mobility Works", "mobilityworks", "mobility works",
    "Coachmen", "coachmen", "Eldorado", "eldorado", "Creative Carriage", "creative carriage", "National Mobility Equipment", "nme",
    "Revability", "revability", "Revabilty", "revabilty", "Mobility SVM", "mobility svm", "svm", "Driverge", "driverge",
    "All Terrain Conversions", "all terrain conversions", "ATC", "atc", "ATS", "ats", "Tempest", "tempest", "Ryno", "ryno",
    "MV-1", "mv-1", "MV1", "mv1", "Northstar", "northstar", "Entervan", "entervan",
]
CONVERTER_PREFIXES = [
    "BraunAbility", "Braun", "Vantage Mobility International", "Vantage Mobility", "Vantage", "Freedom Motors", "Rollx Vans", "Rollx", "AMS Vans", "VMI",
    "MobilityWorks", "Mobility Works", "Driverge", "All Terrain Conversions", "ATC", "ATS", "Tempest", "Ryno", "Eldorado", "Revability", "Revabilty",
    "MV-1", "MV1", "Northstar", "Entervan",
]
CONVERTERS_DESCRIBED = [
    ("braunability", "BraunAbility"), ("braun ability", "BraunAbility"), ("vmi", "VMI"), ("vantage mobility", "VMI"), ("rollx", "Rollx Vans"), ("driverge", "Driverge"),
]
BRANDS = {
    "ams": "ams-vans",
    "ams-and-vans": "ams-vans",
    "freedom": "freedom-motors",
    "rollx": "rollx-vans",
    "vantage": "vantage-mobility",
    "vantage-mobility-international": "vantage-mobility",
    "braun": "braunability",
    "revabilty": "revability",
    "mv1": "mv-1",
    "northstar": "vmi",
    "entervan": "braunability",
    "ats": "atc",
    "all-terrain-conversions": "atc",
}
FAMILIES = {
    "black": "black", "onyx": "black", "ebony": "black", "jet": "black",
    "white": "white", "pearl": "white", "ivory": "white", "snow": "white",
    "silver": "silver", "platinum": "silver", "aluminum": "silver",
    "gray": "gray", "grey": "gray", "charcoal": "gray", "graphite": "gray", "gunmetal": "gray", "slate": "gray",
    "blue": "blue", "navy": "blue", "azure": "blue", "cobalt": "blue",
    "red": "red", "burgundy": "red", "maroon": "red", "crimson": "red", "ruby": "red", "cherry": "red",
    "green": "green", "olive": "green", "emerald": "green", "forest": "green",
    "brown": "brown", "bronze": "brown", "chocolate": "brown", "mocha": "brown", "copper": "brown",
    "beige": "beige", "tan": "beige", "cream": "beige", "champagne": "beige", "sand": "beige",
    "gold": "gold", "orange": "orange", "yellow": "yellow",
    "purple": "purple", "violet": "purple", "plum": "purple",
    "pink": "pink", "teal": "teal", "turquoise": "teal",
}
STATE_CODES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE",
    "district of columbia": "DC", "florida": "FL", "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN",
    "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
CONVERSIONS = [("rear entry", "rear_entry"), ("rear-entry", "rear_entry"), ("side entry", "side_entry"), ("side-entry", "side_entry")]
CONVERSIONS_LOOSE = [("rear", "rear_entry"), ("side", "side_entry")]
RAMPS = [
    ("in-floor", "in_floor"), ("in floor", "in_floor"), ("infloor", "in_floor"),
    ("fold out", "fold_out"), ("fold-out", "fold_out"), ("fold in", "fold_in"), ("fold-in", "fold_in"),
]
FEATURES = [
    (r"\blift\b", "has_lift"), (r"hand\s+control", "hand_controls"), (r"transfer\s+seat", "transfer_seat"),
    (r"lowered?\s+floor|floor\s+(?:low|drop)", "lowered_floor"), (r"power\s+ramp", "power_ramp"), (r"kneel\s+system|kneeling", "kneel_system"),
    (r"tie[-\s]?down", "tie_down_system"), (r"automatic\s+door", "automatic_door"), (r"motorized\s+running\s+board", "motorized_running_board"),
]
FEATURES_LOOSE = [
    ("hand control", "hand_controls"), ("kneel", "kneel_system"), ("lowered floor", "lowered_floor"), ("power ramp", "power_ramp"), ("lift", "has_lift"),
]


def joined(words: Column) -> Column:
    """Words with blanks between them; none at all is null."""
    return F.nullif(F.array_join(words, " "), F.lit(""))


def color(c: Column) -> Column:
    """STR01: alias, else without a marketing suffix (to the end) and only the first letter raised."""
    t = F.trim(c)
    low = F.lower(t)
    bare = F.trim(F.regexp_replace(t, rf"(?i)\s+(?:{COLOR_SUFFIXES})\b.*", ""))
    shown = F.concat(F.upper(F.substring(bare, 1, 1)), F.lower(bare.substr(2, 10_000)))
    value = F.coalesce(lookup(low, COLORS), lookup(F.lower(bare), COLORS), shown)
    return F.when(c.isNull() | low.isin("", *NO_COLOR), None).otherwise(value)


def fuel(fuel_type: Column, engine: Column) -> Column:
    """STR02: the first fuel named, unless the field describes an engine; then what the engine says."""
    t = F.trim(fuel_type)
    return F.coalesce(F.when(~t.rlike(f"(?i){ENGINE}"), first_match(t, FUELS)), first_match(F.trim(engine), FUELS))


def make(decoded: Column, scraped: Column) -> Column:
    raw = F.nullif(F.trim(F.coalesce(decoded, scraped)), F.lit(""))
    return F.coalesce(lookup(F.upper(raw), MAKES), title_case(raw))


def model(decoded: Column, scraped: Column) -> Column:
    raw = F.nullif(F.trim(F.coalesce(decoded, scraped)), F.lit(""))
    return F.coalesce(lookup(F.upper(raw), MODELS), title_case(raw))


def converter(c: Column) -> Column:
    """STR04: the trimmed original where it is a known converter."""
    t = F.trim(c)
    refused = reduce(lambda a, b: a | b, [t.rlike(f"(?i){p}") for p in NO_CONVERTER])
    return F.when(~F.lower(t).isin(*MISSING) & ~refused & (t.isin(*CONVERTERS) | F.lower(t).isin(*CONVERTERS)), t)


def converter_prefix(c: Column) -> Column:
    """STR23: the longest known converter that a text begins with, as a whole word."""
    t = F.trim(F.regexp_replace(c, "(?i)^(.*?)wheelchair van conversion", "$1"))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in sorted(CONVERTER_PREFIXES, key=len, reverse=True):
        out = out.when(t.rlike(rf"(?i)^\Q{name}\E(?:\b|$)"), name)
    return out


def converter_described(c: Column) -> Column:
    """STR44: the first converter whose name a description contains."""
    return first_containing(F.coalesce(c, F.lit("")), CONVERTERS_DESCRIBED)


def brand_slug(c: Column) -> Column:
    """STR05."""
    slug = F.replace(F.lower(F.trim(c)), F.lit("&"), F.lit(" and "))
    slug = F.nullif(F.regexp_replace(F.regexp_replace(slug, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))
    return F.coalesce(lookup(slug, BRANDS), slug)


def color_family(c: Column) -> Column:
    """STR26: the family of the first whole word that names one, else null."""
    family = F.transform(F.split(F.lower(c), "[^a-z]+"), lambda w: lookup(w, FAMILIES))
    return F.get(F.filter(family, lambda f: f.isNotNull()), F.lit(0))


def state_code(c: Column) -> Column:
    """STR28: the code of a state's name; a code of two letters stands for itself."""
    t = F.trim(c)
    return F.coalesce(lookup(F.lower(t), STATE_CODES), F.when(F.upper(t).isin(*STATE_CODES.values()), F.upper(t)))


def transmission(c: Column) -> Column:
    """STR10."""
    v = F.regexp_replace(F.lower(F.trim(c)), "[-_]", " ")
    rules = [
        (r"\b(?:cvt|continuously variable)\b", "cvt"), (r"\b(?:automated manual|dual clutch|dct)\b", "automated_manual"),
        (r"\b(?:automatic|auto)\b|^a/t$|^\d+\s*a$", "automatic"), (r"\bmanual\b|^m/t$|^\d+\s*m$", "manual"),
    ]
    return first_match(v, rules)


def model_tokens(tokens: Column) -> Column:
    """STR06: how many leading upper-case tokens are a model of several words (the longest), else 0."""
    several = sorted((m for m in MODELS if " " in m), key=lambda m: -m.count(" "))
    out = F.when(F.lit(False), 0)
    for m in several:
        words = m.split(" ")
        out = out.when(F.slice(tokens, 1, len(words)) == F.array(*map(F.lit, words)), len(words))
    return out.otherwise(0)


def upper_all(words: Column) -> Column:
    return F.transform(words, lambda w: F.upper(w))


def vehicle_title(c: Column) -> Column:
    """STR07: struct of year, make, model and trim from ``2021 Make Model Trim``."""
    words = F.split(F.trim(c), r"\s+")
    year = F.get(words, F.lit(0)).try_cast("int")
    tail = F.slice(words, 3, 1000)
    n = F.greatest(F.lit(1), model_tokens(upper_all(tail)))
    return F.struct(
        year.alias("year"), F.get(words, F.lit(1)).alias("make"),
        joined(F.slice(tail, F.lit(1), n)).alias("model"), joined(F.slice(tail, n + 1, F.lit(1000))).alias("trim"),
    )


def repaired_model_trim(model_name: Column, trim: Column) -> Column:
    """STR08: struct of model and trim where the model was cut after its first word; null where nothing is to repair."""
    words = F.concat(F.split(model_name, r"\s+"), F.when(F.coalesce(trim, F.lit("")) != "", F.split(trim, r"\s+")).otherwise(F.array().cast("array<string>")))
    n = model_tokens(upper_all(words))
    return F.when(n > 1, F.struct(joined(F.slice(words, F.lit(1), n)).alias("model"), joined(F.slice(words, n + 1, F.lit(1000))).alias("trim")))


def model_after_make(title: Column, maker: Column, trim: Column) -> Column:
    """STR39: struct of model and trim: what follows the make (a whole word, else the year), without the trim at its end."""
    words = F.split(F.trim(title), r"\s+")
    rest = F.array_join(F.slice(words, 2, 1000), " ")
    escaped = F.regexp_replace(maker, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    behind = F.trim(F.regexp_replace(rest, F.concat(F.lit(r"(?i)^.*?\b"), escaped, F.lit(r"\b")), F.lit("")))
    extra = F.coalesce(trim, F.lit(""))
    ends = (extra != "") & F.endswith(F.lower(behind), F.lower(extra))
    name = F.when(ends, F.trim(F.left(behind, F.length(behind) - F.length(extra)))).otherwise(behind)
    return F.struct(F.nullif(name, F.lit("")).alias("model"), F.nullif(extra, F.lit("")).alias("trim"))


def recall_status(remedy: Column, with_unknown: bool) -> Column:
    """STR29, both variants: no remedy is open; ``unknown`` is its own status in one of them only."""
    t = F.trim(remedy)
    out = F.when(remedy.isNull() | (t == ""), "open")
    return (out.when(F.lower(t) == "unknown", "unknown") if with_unknown else out).otherwise("remedied")


def condition(c: Column) -> Column:
    """STR41: certified before new before used."""
    return first_match(c, [(r"\bcertified\b|\bcpo\b", "certified"), (r"\bnew\b", "new"), (r"\bused\b|pre-?owned", "used")])


def conversion_type(c: Column, loose: bool = False) -> Column:
    """STR15: by entry side; the loose variant takes a bare side."""
    return first_containing(F.coalesce(c, F.lit("")), CONVERSIONS_LOOSE if loose else CONVERSIONS, "unknown")


def ramp_type(c: Column, closed_up: bool = True) -> Column:
    """STR15: by the ramp's kind; only one of the variants knows ``infloor``."""
    rules = RAMPS if closed_up else [r for r in RAMPS if r[0] != "infloor"]
    return first_containing(F.coalesce(c, F.lit("")), rules, "unknown")


def features(c: Column) -> Column:
    """STR16: features by pattern, in a fixed order."""
    return F.filter(F.array(*[F.when(c.rlike(f"(?i){p}"), v) for p, v in FEATURES]), lambda x: x.isNotNull())


def features_by_substring(c: Column) -> Column:
    """STR42: the looser test, where ``forklift`` counts as a lift."""
    low = F.lower(c)
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(p)), v) for p, v in FEATURES_LOOSE]), lambda x: x.isNotNull())


def record_key(external_id: Column, stock: Column, vin: Column, url: Column) -> Column:
    """STR43: the source's own id, else stock number, else VIN, else the normalised URL."""
    from lotwise.functions.text import origin_path

    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in (external_id, stock, vin)], origin_path(url))

"""Which rows are one physical vehicle: VIN groups, pair scores and image clusters."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.numeric import hamming, vin_check_digit, vin_normal, vin_valid
from lotwise.functions.text import host, normalized
from lotwise.operators.graph import connected
from lotwise.operators.groups import top_k
from lotwise.operators.joins import hamming_pairs

#: The score of a candidate, miles and share of the price within which listings agree; so are rule names and weights below.
CANDIDATE, MILES, PRICE_SHARE = 50, 1500, 0.05


def vin_groups(df: DataFrame, score: Column, row_id: str = "id", vin: str = "vin") -> DataFrame:
    """DOM07: rows of each valid VIN that occurs more than once, with the most complete one (least id among equals) as primary."""
    rows = df.withColumn("__vin", vin_normal(F.col(vin))).where(vin_valid(F.col("__vin")) & vin_check_digit(F.col("__vin")))
    many = rows.groupBy("__vin").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = top_k(rows.withColumn("__score", score), ["__vin"], [F.desc("__score"), F.asc(row_id)]).select("__vin", F.col(row_id).alias("primary_id"))
    return rows.join(many, "__vin").join(first, "__vin").select(row_id, F.col("__vin").alias("vin"), F.col("n").alias("group_size"), "primary_id", (F.col(row_id) != F.col("primary_id")).alias("is_duplicate"))


def dealer_key(p: str) -> Column:
    """STR32: profile, else website host, else name."""
    c = lambda n: F.col(f"{p}_{n}" if p else n)
    return F.coalesce(F.concat(F.lit("profile:"), F.nullif(c("dealer_profile_id"), F.lit(""))), F.concat(F.lit("host:"), host(c("dealer_website"))), F.concat(F.lit("name:"), normalized(c("dealer_name"))))


def shared_hashes(a: Column, b: Column) -> Column:
    """SET07: how many hashes of ``a`` are also in ``b``; null is none."""
    return F.when(a.isNull() | b.isNull(), 0).otherwise(F.size(F.filter(a, lambda h: F.array_contains(b, h))))


#: Columns whose texts are compared.
TEXTS = ("make", "model", "trim", "stock_number", "zip", "city", "state")


def comparable(df: DataFrame) -> DataFrame:
    """Rows with their texts as they are compared and ``dealer_key``, so that ``score_pairs`` need not work them out again for each pair."""
    return df.withColumns({**{c: normalized(F.col(c)) for c in TEXTS}, "dealer_key": dealer_key("")})


def score_pairs(pairs: DataFrame, miles: Column | None = None) -> DataFrame:
    """DOM08: decision, score and signals of pairs with columns a_* and b_*. Evidence against is absolute and comes first.

    ``miles`` is how far the mileages lie apart, for pairs whose mileages are derived: a difference of products is rounded otherwise than a product of the difference.
    Pairs of ``comparable`` rows are known by their ``a_dealer_key``.
    """
    a, b = (lambda n: F.col(f"a_{n}")), (lambda n: F.col(f"b_{n}"))
    ready = "a_dealer_key" in pairs.columns
    text = lambda n: (a(n), b(n)) if ready else (normalized(a(n)), normalized(b(n)))
    same = lambda n: text(n)[0] == text(n)[1]
    other = lambda n: F.coalesce(text(n)[0] != text(n)[1], F.lit(False))
    va, vb = vin_normal(a("vin")), vin_normal(b("vin"))
    vin_clash = F.coalesce(vin_valid(va) & vin_check_digit(va) & vin_valid(vb) & vin_check_digit(vb) & (va != vb), F.lit(False))
    against = F.when(vin_clash, "conflicting_vin").when(other("make") | other("model") | F.coalesce(F.abs(a("year") - b("year")) > 1, F.lit(False)), "incompatible_vehicle").when(F.coalesce(a("conflicting_image_hash"), F.lit(False)) | F.coalesce(b("conflicting_image_hash"), F.lit(False)), "conflicting_image_hash")
    yes = lambda c: F.coalesce(c, F.lit(False))
    dealer, stock = yes((a("dealer_key") == b("dealer_key")) if ready else (dealer_key("a") == dealer_key("b"))), yes(same("stock_number"))
    stable = [(dealer & stock, "stable_dealer_stock_number", 100), (yes((a("source_url") == b("source_url")) & (a("source_url") != "")), "identical_source_url", 100)]
    priced = yes((a("price_cents") > 0) & (b("price_cents") > 0))
    close_price = priced & (F.abs(a("price_cents") - b("price_cents")) <= F.least(a("price_cents"), b("price_cents")) * PRICE_SHARE)
    miles = F.abs(a("mileage") - b("mileage")) if miles is None else miles
    shared = shared_hashes(a("image_hashes"), b("image_hashes"))
    fuzzy = [
        (dealer, "same_dealer", 15), (yes(same("trim")), "trim_match", 10), (other("trim"), "trim_mismatch", -10), (F.lit(True), "compatible_make_model_year", 15),
        (yes(miles <= MILES), "mileage_within_tolerance", 15), (yes(miles > MILES), "mileage_outside_tolerance", -5), (close_price, "price_within_tolerance", 10), (priced & ~close_price, "price_outside_tolerance", -5),
        (yes(same("zip")), "same_zip", 10), (~yes(same("zip")) & yes(same("city") & same("state")), "same_city_state", 7), (stock & ~dealer, "matching_stock_number_unconfirmed_dealer", 8), (shared > 0, "trusted_image_hash_overlap", 20),
    ]
    listed = lambda rules: F.filter(F.array(*[F.when(w, F.struct(F.lit(n).alias("id"), F.lit(k).alias("weight"))) for w, n, k in rules]), lambda x: x.isNotNull())
    signals = F.when(against.isNotNull(), F.array(F.struct(against.alias("id"), F.lit(0).alias("weight")))).when(F.size(listed(stable)) > 0, listed(stable)).otherwise(listed(fuzzy))
    # sums of the rules themselves, not of the list of signals, which a query without signals leaves out
    total = lambda rules: reduce(add, [F.when(w, k).otherwise(0) for w, _, k in rules])
    linked = reduce(or_, [w for w, _, _ in stable])
    score = F.when(against.isNotNull(), 0).when(linked, total(stable)).otherwise(total(fuzzy))
    decision = F.when(against.isNotNull(), "no_match").when(linked, "auto_link").when(F.col("score") >= CANDIDATE, "candidate").otherwise("no_match")
    return pairs.withColumns({"signals": signals, "score": score}).withColumn("decision", decision)


def linked_vehicles(scored: DataFrame, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """DOM09: components of auto-linked pairs: the transitive closure, which does not depend on the order of pairs."""
    return connected(scored.where("decision = 'auto_link'").select(F.col(a).alias("a"), F.col(b).alias("b")))


def decide(current: Column, action: Column) -> Column:
    """DOM10: the next state of an identity decision. Repeating an action changes nothing; only a verified pair can be split (null: not allowed); undo takes back a split."""
    split = F.when(current.isin("verified", "split"), "split")
    undo = F.when(current == "split", "candidate").otherwise(current)
    return F.when(action == "approve", "verified").when(action == "reject", "rejected").when(action == "split", split).when(action == "undo", undo)


def decided_vehicle(state: Column, vehicle: Column, a_vehicle: Column, b_vehicle: Column, a_id: Column) -> Column:
    """DOM10: the vehicle of a pair after a decision: one already known, else a new one named by the first listing; none unless verified."""
    return F.when(state == "verified", F.coalesce(vehicle, a_vehicle, b_vehicle, F.concat(F.lit("new:"), a_id.cast("string"))))


def image_clusters(images: DataFrame, most: int = 10) -> DataFrame:
    """DOM11: (id, cluster, kind): pictures of equal hash first, then near-duplicates among the rest, greedily by id.

    A picture joins the earliest cluster whose first picture is close; firsts are found in rounds: in each, a
    picture all of whose earlier close ones are settled is settled too.
    """
    # groups are counted and joined, so that no task has all rows of a hash, or of none
    many = images.where("exact_hash is not null").groupBy("exact_hash").agg(F.min("id").alias("cluster"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = images.join(many, "exact_hash").select("id", "cluster", F.lit("exact").alias("kind"))
    rest = images.where("phash is not null").join(many, "exact_hash", "left_anti").select("id", "phash")
    # equal hashes are one picture here; its copies follow its least id
    pairs = hamming_pairs(rest, "id", "phash", most)
    settled = greedy_firsts(pairs)
    leads = rest.groupBy("phash").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).join(settled, F.col("lead") == F.col("node"), "left")
    leads = leads.select("phash", "n", F.coalesce("first", "lead").alias("cluster"))
    sized = leads.groupBy("cluster").agg(F.sum("n").alias("n")).where("n > 1").select("cluster")
    near = rest.join(leads.join(sized, "cluster").select("phash", "cluster"), "phash").select("id", "cluster", F.lit("near").alias("kind"))
    return same.unionByName(near)


def greedy_firsts(pairs: DataFrame) -> DataFrame:
    """(node, first) where ``first`` is the least id close to the node that itself follows no other; pairs have a < b."""
    from lotwise.operators.graph import shared_checkpoint, shared_table

    edges = shared_checkpoint(pairs.select("a", "b"))
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    done = shared_checkpoint(nodes.join(edges.select(F.col("b").alias("node")), "node", "left_anti").select("node", F.col("node").alias("first")))
    while True:
        left = edges.join(done.select(F.col("node").alias("b")), "b", "left_anti")
        known = left.join(done.select(F.col("node").alias("a"), "first"), "a", "left")
        lead = F.when(F.col("first") == F.col("a"), F.col("a"))  # only a cluster's first picture takes others in
        state = known.groupBy("b").agg(F.min(F.when(F.col("first").isNull(), F.col("a"))).alias("waiting"), F.min(lead).alias("lead"))
        fresh = state.where("waiting is null or lead < waiting").select(F.col("b").alias("node"), F.coalesce("lead", "b").alias("first"))
        fresh = shared_table(fresh)
        if fresh.isEmpty():
            return done
        done = done.unionByName(fresh)


#: Listings of a cluster beyond which it is taken for a placeholder.
PLACEHOLDER_LISTINGS = 5


def cluster_report(images: DataFrame, clusters: DataFrame) -> DataFrame:
    """AGG24, DOM12: distinct listings, sources and vehicles of each cluster, what they suggest and why, and its reuse."""
    vehicle = F.coalesce(F.concat(F.lit("v:"), F.col("vehicle_id").cast("string")), F.concat(F.lit("vin:"), "vin"))
    agg = clusters.join(images, "id").groupBy("cluster", "kind").agg(
        F.count(F.lit(1)).alias("images"), F.count_distinct("listing_id").alias("listings"), F.count_distinct("source_id").alias("sources"), F.count_distinct(vehicle).alias("vehicles")
    )
    cross, many = F.col("vehicles") > 1, F.col("listings") > PLACEHOLDER_LISTINGS
    n = lambda c, word: F.concat(F.col(c).cast("string"), F.lit(f" {word}"))
    used = F.concat(F.lit("reused across "), n("listings", "listings"))
    reason = (
        F.when(many & cross, F.concat(used, F.lit(" and "), n("vehicles", "vehicle groups"), F.lit(" from "), n("sources", "sources")))
        .when(many, F.concat(used, F.lit(" from "), n("sources", "sources")))
        .when(cross, F.concat(F.lit("spans "), n("vehicles", "vehicle groups"), F.lit(" \u2014 ineligible as vehicle-specific evidence")))
    )
    reuse = F.when(F.col("vehicles") == 0, "no_vehicle_context").when(cross, "cross_vehicle").otherwise("same_vehicle")
    return agg.withColumns({"cross_vehicle": cross, "placeholder": many, "reason": reason, "reuse": reuse})


def hero_eligible(kind: Column, cross_vehicle: Column) -> Column:
    """DOM12: a vehicle's own photo, outside clusters that span vehicles."""
    return (kind == "vehicle_photo") & ~F.coalesce(cross_vehicle, F.lit(False))


def analysis_due(kind: Column, placeholder: Column, cross_vehicle: Column, version: Column, current: int) -> Column:
    """FLT20: a vehicle's photo, in no suspect cluster, whose analysis is missing or of an older version."""
    suspect = F.coalesce(placeholder, F.lit(False)) | F.coalesce(cross_vehicle, F.lit(False))
    return (kind == "vehicle_photo") & ~suspect & (version.isNull() | (version < current))


def sign_bits(embedding: Column, n: int = 64) -> Column:
    """A 64-bit hash of the signs of an embedding's first components."""
    return F.aggregate(F.transform(F.slice(embedding, 1, n), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))), F.expr("0L"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def hamming_to(bits: Column, other: Column) -> Column:
    return hamming(bits, other)

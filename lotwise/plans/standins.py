"""The supplied tables seen as listings, histories, claims, pictures and pages; and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def regions(spark: SparkSession, d: str) -> DataFrame:
    """nation_key, nation, source."""
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("nation"), F.col("r_name").alias("source"))  # 25 rows in this schema at any scale


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def listings(spark: SparkSession, d: str) -> DataFrame:
    o, c = t(spark, d, "orders"), t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(regions(spark, d)), F.col("c_nationkey") == F.col("nation_key"))
    return rows.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("vehicle_id"), F.col("o_orderdate").alias("listed_at"), cents("o_totalprice").alias("price_cents"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), "nation", "source",
    )


LISTINGS = """(select o_orderkey id, o_custkey vehicle_id, o_orderdate listed_at, cast(round(o_totalprice * 100) as bigint) price_cents, o_orderstatus status,
 o_orderpriority priority, c_mktsegment segment, n_name nation, r_name source from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey)"""


def parts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.col("p_name").alias("title"), F.col("p_size").alias("size"),
        cents("p_retailprice").alias("price_cents"), F.split("p_name", " ").alias("words"),
    )


PARTS = (
    "(select p_partkey id, p_brand make, p_type model, p_name title, p_size size, cast(round(p_retailprice * 100) as bigint) price_cents,"
    " string_split(p_name, ' ') words from part)"
)


def price_history(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "lineitem").select(F.col("l_partkey").alias("part_id"), F.col("l_shipdate").alias("recorded_at"), F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), cents("l_extendedprice").alias("price_cents"))


HISTORY = (
    "(select l_partkey part_id, l_shipdate recorded_at, l_orderkey ok, l_linenumber ln, cast(round(l_extendedprice * 100) as bigint) price_cents"
    " from lineitem)"
)


def events(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


EVENTS = "(select event_id, ts, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) k from events)"


def pictures(spark: SparkSession, d: str) -> DataFrame:
    from lotwise.operators.identity import sign_bits

    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), sign_bits(F.col("embedding")).alias("phash"))


#: Bit i (from the left) is the sign of component i; -2^63 stands for the first.
PICTURES = (
    "(select vec_id id, label, cast(list_sum([case when embedding[i] > 0 then (case when i = 1 then -9223372036854775808::hugeint"
    " else (1::hugeint << (64 - i)) end) else 0::hugeint end for i in range(1, 65)]) as bigint) phash from embeddings)"
)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which the driver and all executors share."""
    import uuid

    from lotwise.operators.graph import checkpoint_folder

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"

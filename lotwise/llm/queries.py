"""Queries opN over the supplied tables: each applies one operator of this subpackage to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import bpe, chat, cluster, katz, kdtree, langid, lines, media, minhash, packing, phrases, quality, suffix
from lotwise.llm.common import crc_bucket, read
from lotwise.llm.sql import SQL

RANKS, VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), RANKS, PATTERN)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(crc_bucket("doc_id", 5) != 0))
    return langid.identify(docs, model).select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), k=3, numerator=85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(read(spark, sf_dir, "documents"), VOCABULARY, PATTERN)
    digest = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.number(digest).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn is taken as a call, which the assistant's next turn answers; call i of a conversation needs call i / 2.

    By conversation and turn some calls lack a field, have one of the wrong kind or one too many, are not an object,
    name no tool, bear the identifier of the call before, or need themselves or a later call.
    """
    k = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(16)).alias("k")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", k)
    call_id = lambda t: F.concat_ws("-", F.lit("call"), t.cast("string"))
    case = lambda n, then, other: F.when(F.col("k") == n, then).otherwise(other)
    turn, text, size = F.col("turn"), F.col("text"), F.length("text")
    name = F.when(F.col("k") == 4, "draw").when(F.instr(text, "e.") > 0, "ask").when(size > 200, "write").otherwise("say")
    write = F.col("name") == "write"
    number = lambda c: F.when(F.col("k") > 1, F.to_json(F.struct(c.alias("x")))).when(F.col("k") == 1, F.to_json(F.struct(c.cast("string").alias("x"))))
    inner = lambda c: c.substr(F.lit(6), F.length(c) - 6)
    fields = F.concat_ws(
        ",", F.concat(F.lit('"turn":'), inner(F.when(~write, number(turn)))), F.concat(F.lit('"title":'), F.when(write & (F.col("k") == 7), F.lit('"note"'))),
        F.concat(F.lit('"text":'), inner(F.to_json(F.struct(text.alias("x"))))), F.concat(F.lit('"mood":'), F.when(F.col("k") == 2, F.lit("null"))),
        F.concat(F.lit('"length":'), inner(F.when(write, number(size)))),
    )
    half = F.floor(F.floor(turn / 2) / 2) * 2 + turn % 2
    needs = F.filter(F.array(F.when(turn > 1, call_id(half)), case(9, call_id(turn), None), F.when((turn < 2) & (F.col("k") == 10), call_id(turn + 2))), lambda x: x.isNotNull())
    calls = turns.where("role = 'user'").withColumn("name", name).select(
        "conv_id", "turn", call_id(case(5, turn - 2, turn)).alias("call_id"), "name", case(3, text, F.concat(F.lit("{"), fields, F.lit("}"))).alias("arguments"), needs.alias("needs"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", "turn", call_id(turn - 1).alias("call_id"), text.alias("content"))
    schemas = spark.createDataFrame(
        [
            ("say", "text", "STRING", True), ("say", "turn", "BIGINT", True), ("ask", "text", "STRING", True), ("ask", "turn", "BIGINT", True),
            ("write", "text", "STRING", True), ("write", "length", "BIGINT", True), ("write", "title", "STRING", False),
        ],
        "name string, field string, kind string, required boolean",
    )
    return chat.link_tool_calls(calls, results, schemas)


def op7_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = katz.score(read(spark, sf_dir, "documents").select("doc_id", "text"), crc_bucket("doc_id", 7) != 2)
    return scored.select("doc_id", (crc_bucket("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no pictures: each embedding is drawn as one. All pairs of different pictures are compared."""
    return media.find_copies(media.drawn(read(spark, sf_dir, "embeddings")), exact=True)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels").where(crc_bucket("doc_id", 4) != 2))
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op10_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(read(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.with_inertia(*cluster.cluster(read(spark, sf_dir, "embeddings")))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return SQL

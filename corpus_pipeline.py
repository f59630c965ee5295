"""The corpus pipeline: language ID, quality, near-dedup, suffix-array dedup and packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Models learn from the stage's own documents (languages from ``lang``, quality from ``labels``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm import langid, minhash, packing, quality, suffix
from lotwise.llm.common import read, shared_checkpoint
from lotwise.llm.queries import PATTERN, VOCABULARY


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one struct beside its text, so that no added column can clash with its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose language stays ambiguous."""
    named = langid.identify(_rows(docs), langid.fit(docs), keep=("row",))
    return named.where("lang_pred <> 'und' and not ambiguous").select("row.*")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are likelier of label 0; keeps all where no labels are."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(_rows(docs), model, keep=("row",)).where("score >= 0.5").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at similarity 0.8 on 5-word shingles stays: that of the least doc_id."""
    names = docs.columns
    hashed = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__th"), F.col("text").alias("__text"))
    kept = minhash.near_duplicates(hashed, "__id", "__text", carry=("__th",)).where("kept").select("__id", "__th").distinct()
    packed = _rows(docs).select("row", F.col("row.doc_id").alias("__own"), F.xxhash64("text").alias("__oth"))
    both = packed.join(kept, packed["__own"].eqNullSafe(kept["__id"]) & (packed["__oth"] == kept["__th"]), "left_semi")
    once = Window.partitionBy("__own", "__oth").orderBy(F.lit(1))  # the same row twice
    return both.withColumn("__n", F.row_number().over(once)).where("__n = 1").select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes what strings of 200 bytes cover that also start elsewhere; n_chars follows the text."""
    done = suffix.remove_repeats(docs, as_text=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    return packing.pack(docs, VOCABULARY, PATTERN)


STAGES = [("language_id", language), ("quality", quality_filter), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", packed)]
#: Classifiers, near-duplicate groups and tokenizers are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = shared_checkpoint(docs)
    return docs

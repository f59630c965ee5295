"""Full-text search: an inverted index as tables, and BM25 over weighted fields as joins and sums.

``build`` makes three tables: postings (term, field, doc, tf, len), terms (term, field, docs) and fields (field, docs,
mean_len). ``save`` lays the postings out by a hash of the term, so that a search over a saved index reads the parts of
its own terms only. A score is a sum over (term, field) of

    weight * ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / mean_len))

with N the documents that have words in the field and df those with the term in it.

What a term adds to a document's score is the same for all queries. So a search deals the postings of the asked terms out by
document, once each however many queries ask for them, and a group of documents meets the queries as a product of matrices
(document, term) and (term, query). It returns its ``k`` best for each query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.operators.graph import shared_checkpoint

#: Parts of a saved index.
PARTS = 64
K1, B = 1.2, 0.75
#: Postings of a group of documents; queries, and words of queries, of a group of queries; terms sent to all tasks; cells of a matrix.
POSTINGS, QUERIES, WORDS, SENT, CELLS = 500_000, 1000, 10_000, 100_000, 1 << 22


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    terms: DataFrame
    fields: DataFrame

    def save(self, root: str) -> Index:
        """Write the tables; postings in parts by term, so that a search reads a share of them."""
        session = self.postings.sparkSession
        # dealt by part and a share of the documents, so that a common term is no task of its own and nothing need be sampled
        shares = -(-int(session.conf.get("spark.sql.shuffle.partitions")) // PARTS)
        spread = self.postings.withColumn("part", _part(F.col("term"))).repartition(PARTS * shares, "part", F.pmod(F.xxhash64("doc"), F.lit(shares)))
        spread.write.mode("overwrite").partitionBy("part").parquet(f"{root}/postings")
        saved = session.read.parquet(f"{root}/postings")
        # a row of n words has postings with n words in all, so their shares of n add up to one row
        about = [F.sum("tf").alias("words"), F.sum(F.col("tf") / F.col("len")).alias("rows")]
        saved.groupBy("part", "term", "field").agg(F.count(F.lit(1)).alias("docs"), *about).write.mode("overwrite").partitionBy("part").parquet(f"{root}/terms")
        terms, docs = session.read.parquet(f"{root}/terms"), F.round(F.sum("rows")).cast("long")
        terms.groupBy("field").agg(docs.alias("docs"), (F.sum("words") / docs).alias("mean_len")).write.mode("overwrite").parquet(f"{root}/fields")
        return load(session, root)


def load(spark: SparkSession, root: str) -> Index:
    postings, terms, fields = (spark.read.parquet(f"{root}/{name}") for name in ("postings", "terms", "fields"))
    return Index(postings, terms.drop("words", "rows"), fields)


def build(df: DataFrame, doc_id: str, fields: list[str]) -> Index:
    """The index of the given text columns. Null texts have no words; a document counts in a field if it has words there."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), words(F.coalesce(F.col(f), F.lit(""))).alias("words")) for f in fields])
    rows = df.select(F.col(doc_id).alias("doc"), F.inline(each)).withColumn("len", F.size("words")).where("len > 0")
    # a text's words are counted within its row: sorted, a word's count is where its run ends less where the one before ended
    runs = rows.withColumn("words", F.sort_array("words")).withColumn("ends", F.filter(F.sequence(F.lit(1), F.col("len")), lambda i: (i == F.col("len")) | (F.get("words", i) != F.get("words", i - 1))))
    run = lambda end, i: F.struct(F.get("words", end - 1).alias("term"), (end - F.when(i > 0, F.get("ends", i - 1)).otherwise(0)).cast("long").alias("tf"))
    counts = runs.select("doc", "field", "len", F.inline(F.transform("ends", run)))
    repeated = not df.groupBy(doc_id).count().where("count > 1").isEmpty()
    postings = counts.groupBy("term", "field", "doc", "len").agg(F.sum("tf").alias("tf")) if repeated else counts.select("term", "field", "doc", "len", "tf")
    about = rows.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean_len"))
    return Index(postings, postings.groupBy("term", "field").agg(F.count(F.lit(1)).alias("docs")), about)


def _best(k: int):
    """What groups of postings (no, doc, gain) and of queries (query_id, no) give: query_id, doc, score of each query's k best."""

    def best(postings: pa.Table, asked: pa.Table) -> pa.Table:
        docs, ids = (t.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for t, c in ((postings, "doc"), (asked, "query_id")))
        order = pc.array_sort_indices(docs.dictionary, null_placement="at_start")
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        row = place[docs.indices.to_numpy()]
        terms, col = np.unique(postings.column("no").to_numpy(), return_inverse=True)
        gain = postings.column("gain").to_numpy()
        at = np.argsort(row, kind="stable")
        row, col, gain = row[at], col[at], gain[at]

        no, query = asked.column("no").to_numpy(), ids.indices.to_numpy()
        known = np.isin(no, terms)
        wanted = np.zeros((len(terms), len(ids.dictionary)))
        wanted[np.searchsorted(terms, no[known]), query[known]] = 1
        scores, who = np.zeros((0, wanted.shape[1])), np.zeros((0, wanted.shape[1]), np.int64)
        step = max(1, CELLS // max(1, *wanted.shape))
        for lo in range(0, len(order), step):
            hi = min(lo + step, len(order))
            some = slice(*np.searchsorted(row, [lo, hi]))
            cell = (row[some] - lo) * len(terms) + col[some]
            dense = lambda x: np.bincount(cell, x, (hi - lo) * len(terms)).reshape(hi - lo, -1)  # noqa: B023, E731
            new = np.floor(dense(gain[some]) @ wanted * 1e6 + 0.5) / 1e6
            met = new > 0 if gain.min() > 1e-6 else dense(np.ones(some.stop - some.start)) @ wanted > 0
            new[~met] = -np.inf
            # earlier ones first and in order, so that ties go to the smaller document
            scores, who = np.concatenate([scores, new]), np.concatenate([who, np.repeat(np.arange(lo, hi)[:, None], wanted.shape[1], 1)])
            top = np.argsort(-scores, axis=0, kind="stable")[:k]
            scores, who = np.take_along_axis(scores, top, 0), np.take_along_axis(who, top, 0)
        i, q = np.nonzero(scores > -np.inf)
        return pa.table({"query_id": ids.dictionary.take(pa.array(q)), "doc": docs.dictionary.take(order.take(pa.array(who[i, q]))), "score": pa.array(scores[i, q])})

    return best


def search(index: Index, queries: DataFrame, weights: dict[str, float], k: int = 10, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """query_id, rank, doc, score: each query's k best documents with any of its words, scores to six decimals, ties to the smaller doc.

    A query's repeated words count once. Terms that no document has, and fields without a weight, give nothing.
    """
    weight = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, float(w))])
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(words(F.col(text)))).alias("term"))
    saved = "part" in index.postings.columns
    on = ["part", "term"] if saved else ["term"]
    asked = asked.withColumn("part", _part(F.col("term"))) if saved else asked
    postings, terms = index.postings, index.terms
    if saved:
        some = [r["part"] for r in asked.select("part").distinct().collect()]  # PARTS at most
        postings, terms = (x.where(F.col("part").isin(some)) for x in (postings, terms))
    about = index.fields.select("field", F.col("docs").alias("all"), "mean_len", weight[F.col("field")].alias("weight")).where("weight is not null")
    rare = F.log(1 + (F.col("all") - F.col("docs") + 0.5) / (F.col("docs") + 0.5))
    asked = shared_checkpoint(asked)
    numbers = shared_checkpoint(asked.select(*on).distinct().withColumn("no", F.monotonically_increasing_id()))
    size = asked.agg(F.count(F.lit(1)).alias("words"), F.count_distinct(F.struct("query_id")).alias("queries")).first()
    few = numbers.limit(SENT + 1).count() <= SENT
    known = numbers.join(terms, on)
    many = known.agg(F.sum("docs")).first()[0] or 0
    groups = max(asked.sparkSession.sparkContext.defaultParallelism, -(-many // POSTINGS))
    sets = max(1, -(-size["queries"] // QUERIES), -(-size["words"] // WORDS))
    known = known.join(F.broadcast(about), "field").select(*on, "field", "no", "mean_len", (F.col("weight") * rare).alias("worth"))  # a row for each field
    hits = postings.join(F.broadcast(known) if few else known, [*on, "field"])
    part = F.col("worth") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    gains = hits.select("doc", "no", part.alias("gain"), F.pmod(F.xxhash64("doc"), F.lit(groups)).cast("int").alias("of_docs")).select("*", each(sets).alias("of_queries"))
    words_of = asked.join(numbers, on).select("query_id", "no", F.pmod(F.xxhash64("query_id"), F.lit(sets)).cast("int").alias("of_queries")).select("*", each(groups).alias("of_docs"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    key = ["of_docs", "of_queries"]
    dealt = [df.repartition(groups * sets, *key).groupBy(*key) for df in (gains, words_of)]
    scored = dealt[0].cogroup(dealt[1]).applyInArrow(_best(k), f"query_id {kind(words_of, 'query_id')}, doc {kind(gains, 'doc')}, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "doc", "score")

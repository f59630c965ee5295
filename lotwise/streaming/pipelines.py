"""Structured Streaming pipelines: index maintenance, missing counters, late detail and windowed counts.

Each works the same over a stream or as a batch; ``foreachBatch`` writes are idempotent by batch id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lotwise.operators.groups import completeness, scored_representative


def windowed_counts(events: DataFrame, at: str, keys: list[str], length: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Counts per tumbling or sliding event-time window."""
    rows = events.withWatermark(at, watermark) if events.isStreaming else events
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions per key: a gap ends one."""
    rows = events.withWatermark(at, watermark) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def sync_groups(index: DataFrame, listings: DataFrame, touched: DataFrame, group: str, fields: list[str], at: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """STM02, SNK04: (representatives to put, index rows to delete) of whole touched groups.

    A changed row recomputes all of its group, since another row may now stand for it.
    """
    groups = touched.select(group).distinct()
    rows = listings.where("eligible").join(groups, group, "left_semi")
    puts = scored_representative(rows, [group], completeness(fields), at, row_id)
    deletes = index.join(groups, group, "left_semi").join(puts.select(row_id), row_id, "left_anti")
    return puts, deletes


def apply_sync(index: DataFrame, puts: DataFrame, deletes: DataFrame, row_id: str) -> DataFrame:
    gone = deletes.select(row_id).unionByName(puts.select(row_id))
    return index.join(gone, row_id, "left_anti").unionByName(puts.select(*index.columns))


def poll(changes: DataFrame, at: list[str], seen: list, size: int = 500, batches: int = 20) -> DataFrame:
    """STM01 as a batch: the next changes after a checkpoint (time, id), at most ``batches`` of ``size``, in order."""
    from lotwise.operators.filters import after

    return changes.where(after(at, seen)).orderBy(*at).limit(size * batches)


def once_per_batch(root: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """STM04: a ``foreachBatch`` function that skips a batch whose marker exists; the marker follows the write."""

    def run(df: DataFrame, batch: int) -> None:
        spark: SparkSession = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/applied/{batch}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            write(df, batch)
            fs.mkdirs(path)

    return run


def once_each(rows: DataFrame, key: list[str], at: str, watermark: str = "1 day") -> DataFrame:
    """STM06: each key's first row, over a stream as long as its repeats come within the watermark; a batch has all of them at hand."""
    return rows.withWatermark(at, watermark).dropDuplicatesWithinWatermark(key) if rows.isStreaming else rows.dropDuplicates(key)


#: Parts of a kept index. A batch reads and writes those that it touches.
BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def read_kept(spark: SparkSession, path: str, schema: StructType, row_id: str, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a table kept by ``keep_index``, of all its parts or of some."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(path)
    return (rows if buckets is None else rows.where(F.col("bucket").isin(buckets))).where(F.col(row_id).isNotNull()).drop("bucket")


def _put(rows: DataFrame, path: str, key: str, buckets: list[int], of: int) -> None:
    """Replace parts of a table, and no others. A row without a key marks each part, so that one left without rows is replaced too."""
    spark = rows.sparkSession
    marks = spark.createDataFrame([(b,) for b in buckets], "bucket int")
    whole = rows.withColumn("bucket", _bucket(key, of)).unionByName(marks, allowMissingColumns=True)
    whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def keep_index(changes: DataFrame, root: str, state: str, group: str, fields: list[str], at: str, row_id: str, buckets: int = BUCKETS):
    """STM01, STM02: keep an index of representatives in step with a stream of listing versions, each batch once.

    Three tables lie under ``root``: ``listings`` and ``index`` in parts by group, and ``known`` (each row's group and
    time) in parts by row. A batch finds the groups that its rows leave or enter in ``known``, and replaces the parts
    that hold them (Spark's dynamic partition overwrite); other parts are neither read nor written. A version older
    than the one known is ignored. ``known`` is written last: a batch that failed before finds the same groups when it
    is replayed, and a version as old as the known one applies again, to the same result.
    """
    schema = StructType([*changes.schema.fields])
    about = StructType([schema[row_id], schema[group], schema[at]])

    def sync(batch: DataFrame, number: int) -> None:
        from lotwise.operators.graph import shared_checkpoint
        from lotwise.operators.groups import top_k

        spark = batch.sparkSession
        latest = shared_checkpoint(top_k(batch, [row_id], [F.desc(at)]).select(*schema.names))
        if latest.isEmpty():
            return
        # part numbers: at most as many as there are parts
        parts = lambda df, key: sorted(r["b"] for r in df.select(_bucket(key, buckets).alias("b")).distinct().collect())
        row_parts = parts(latest, row_id)
        known = read_kept(spark, f"{root}/known", about, row_id, row_parts)
        before = known.select(F.col(row_id), F.col(group).alias("__group"), F.col(at).alias("__at"))
        fresh = shared_checkpoint(latest.join(before, row_id, "left").where(F.col("__at").isNull() | (F.col(at) >= F.col("__at"))))
        touched = shared_checkpoint(fresh.select(group).unionByName(fresh.select(F.col("__group").alias(group))).where(F.col(group).isNotNull()).distinct())
        group_parts = parts(touched, group)
        fresh = fresh.select(*schema.names)
        old = read_kept(spark, f"{root}/listings", schema, row_id, group_parts)
        listings = shared_checkpoint(old.join(fresh.select(row_id), row_id, "left_anti").select(*schema.names).unionByName(fresh.where(F.col(group).isNotNull())))
        index = read_kept(spark, f"{root}/index", schema, row_id, group_parts)
        puts, _ = sync_groups(index, listings, touched, group, fields, at, row_id)
        kept = index.join(touched, group, "left_anti").select(*schema.names).unionByName(puts.select(*schema.names))
        kept = shared_checkpoint(kept)
        _put(listings, f"{root}/listings", group, group_parts, buckets)
        _put(kept, f"{root}/index", group, group_parts, buckets)
        rest = known.join(fresh.select(row_id), row_id, "left_anti").select(*about.names).unionByName(fresh.select(*about.names))
        _put(shared_checkpoint(rest), f"{root}/known", row_id, row_parts, buckets)

    return changes.writeStream.foreachBatch(once_per_batch(root, sync)).option("checkpointLocation", state).trigger(availableNow=True).start()


class Missing(StatefulProcessor):
    """STM03 on a stream: per (source, key), complete runs since the last sight. A sight starts anew; ``run`` rows count up once."""

    def __init__(self, limit: int = 6):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("missing", StructType([StructField("missing", IntegerType()), StructField("last_run", StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        missing, last = self.state.get() if self.state.exists() else (0, "")
        for run, seen in sorted((r, bool(s)) for part in rows for r, s in zip(part["run_id"], part["seen"], strict=True)):
            if run <= last:
                continue  # a run is applied once
            missing, last = (0 if seen else missing + 1), run
        self.state.update((missing, last))
        status = "gone" if missing >= self.limit else "possibly_gone" if missing else "active"
        yield pd.DataFrame({"source": [key[0]], "record_key": [key[1]], "missing": [missing], "status": [status]})

    def close(self) -> None:
        pass


def missing_counters(rows: DataFrame, limit: int = 6) -> DataFrame:
    """Rows (source, record_key, run_id, seen) of complete runs; emits each touched key's counter and status."""
    out = "source string, record_key string, missing int, status string"
    return rows.groupBy("source", "record_key").transformWithStateInPandas(Missing(limit), out, "Update", "None")


def apply_detail(old: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """STM05: a page scraped before the listing went stale applies its values and leaves it stale; nothing late is dropped."""
    newest = pages.groupBy(key).agg(F.max_by(F.struct("value", "scraped_at"), "scraped_at").alias("p"))
    late = F.col("p.scraped_at") < F.col("stale_at")
    return old.join(newest, key, "left").select(key, F.coalesce("p.value", "value").alias("value"), F.when(F.col("p").isNull() | F.coalesce(late, F.lit(False)), F.col("stale_at")).alias("stale_at"))


def crawl_decision(hash_now: Column, hash_before: Column, last_full: Column, now: Column, every_hours: int = 24) -> Column:
    """STM14: skip a crawl whose first page has the hash of before, unless no full crawl is known or the last one is overdue."""
    overdue = last_full.isNull() | (last_full < now - F.make_interval(hours=F.lit(every_hours)))
    return F.when(~hash_now.eqNullSafe(hash_before), "changed").when(overdue, "overdue").otherwise("skip")


def orphaned(listings: DataFrame, public: Column, index: DataFrame, catalog: str) -> DataFrame:
    """STM17: by catalog its public listings, its documents in the index, and whether to rebuild: no listing is public while documents are left."""
    there = listings.groupBy(catalog).agg(F.count_if(public).alias("public"))
    docs = index.groupBy(catalog).agg(F.count(F.lit(1)).alias("docs"))
    n = {c: F.coalesce(c, F.lit(0)) for c in ("public", "docs")}
    return there.join(docs, catalog, "full").select(catalog, *[v.alias(c) for c, v in n.items()], ((n["public"] == 0) & (n["docs"] > 0)).alias("rebuild"))


def needs_rebuild(listings: DataFrame, public: Column, index: DataFrame) -> bool:
    """STM17: no public listing is left while the index still has documents."""
    return listings.where(public).isEmpty() and not index.isEmpty()


def abandoned(runs: DataFrame, live: DataFrame, now, hours: int = 2) -> DataFrame:
    """STM18: running jobs older than the limit whose worker is known not to live; an unknown worker counts as alive."""
    old = runs.where((F.col("status") == "running") & (F.col("started_at") < now - F.make_interval(hours=F.lit(hours))))
    return old.join(live, "worker", "left").where(~F.coalesce("alive", F.lit(True))).select(*runs.columns)

"""Writes as transformations of old rows and new ones: upserts, retention, markings and swaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.groups import top_k


def upsert(old: DataFrame, new: DataFrame, key: list[str], values: list[str], as_multiset: list[str] = ()) -> DataFrame:
    """SNK01: all rows after the merge, with ``outcome`` created, updated, unchanged or kept. Null equals null; some arrays compare without order."""
    side = lambda df, p: df.select(*key, *[F.col(v).alias(f"{p}_{v}") for v in values], F.lit(True).alias(f"{p}_here"))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    shape = lambda c, v: F.array_sort(c) if v in as_multiset else c
    diff = F.array(*[F.when(~shape(F.col(f"o_{v}"), v).eqNullSafe(shape(F.col(f"n_{v}"), v)), v) for v in values])
    changed = F.filter(diff, lambda x: x.isNotNull())
    outcome = F.when(F.col("o_here").isNull(), "created").when(F.col("n_here").isNull(), "kept").when(F.size(changed) > 0, "updated").otherwise("unchanged")
    out = both.withColumn("outcome", outcome).withColumn("changed_fields", F.when(F.col("outcome") == "updated", changed).otherwise(F.array().cast("array<string>")))
    return out.select(*key, *[F.when(F.col("n_here").isNotNull(), F.col(f"n_{v}")).otherwise(F.col(f"o_{v}")).alias(v) for v in values], "outcome", "changed_fields")


def audit_rows(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """SNK03, JSN01: before and after of changed fields only, as JSON."""
    pair = old.select(*key, F.struct(*values).alias("o")).join(new.select(*key, F.struct(*values).alias("n")), key)
    entry = lambda p: F.filter(F.array(*[F.when(~F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}")), F.struct(F.lit(v).alias("key"), F.col(f"{p}.{v}").cast("string").alias("value"))) for v in values]), lambda x: x.isNotNull())
    return pair.select(*key, F.to_json(F.map_from_entries(entry("o")), {"ignoreNullFields": "false"}).alias("before"), F.to_json(F.map_from_entries(entry("n")), {"ignoreNullFields": "false"}).alias("after"), F.size(entry("o")).alias("n")).where("n > 0").drop("n")


def append_new(ledger: DataFrame, incoming: DataFrame, key: list[str], order: list) -> DataFrame:
    """SNK06, STM06: the rows to append: the first per key of those that the ledger lacks."""
    return top_k(incoming, key, order).join(ledger.select(*key).distinct(), key, "left_anti")


def apply_once(ledger: DataFrame, rows: DataFrame, run: list[str], key: list[str]) -> DataFrame:
    """STM04: the rows of runs that the ledger lacks, each row once however often its run is sent."""
    return rows.join(ledger.select(*run).distinct(), run, "left_anti").dropDuplicates([*run, *key])


def count_problems(state: DataFrame, seen: DataFrame, key: str = "fingerprint", at: str = "seen_at", batch: str = "batch_id") -> DataFrame:
    """SNK07: first and last sight and occurrences; a fingerprint counts once in a batch."""
    new = seen.select(key, at, batch).groupBy(key, batch).agg(F.min(at).alias("lo"), F.max(at).alias("hi")).groupBy(key).agg(F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"), F.count(F.lit(1)).alias("occurrences"))
    return state.unionByName(new).groupBy(key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("occurrences").alias("occurrences"))


def fold_duplicates(df: DataFrame, folded: Column, row_id: str) -> DataFrame:
    """SNK08: (old id, kept id): the least id of each case-folded group, for rerouting references."""
    rows = df.select(F.col(row_id).alias("old_id"), folded.alias("__folded"))
    least = rows.groupBy(F.col("__folded").alias("__key")).agg(F.min("old_id").alias("kept_id"))  # partial minima, so a common name is no hot group
    return rows.join(least, F.col("__folded").eqNullSafe(F.col("__key"))).select("old_id", "kept_id")


def retained(df: DataFrame, at: str, as_of: Column, days: int, exempt: Column | None = None) -> DataFrame:
    """SNK09, STM13: rows younger than a cutoff, or exempt."""
    keep = F.col(at) >= as_of - F.make_interval(days=F.lit(days))
    return df.where(keep if exempt is None else keep | exempt)


def anonymised(df: DataFrame, expired: Column, nulls: list[str], arrays: list[str] = ()) -> DataFrame:
    """SNK10: personal fields emptied where expired."""
    new = {c: F.when(~F.coalesce(expired, F.lit(False)), F.col(c)) for c in nulls}
    new |= {c: F.when(F.coalesce(expired, F.lit(False)), F.array().cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in arrays}
    return df.withColumns(new)


def sticky(old: Column, new: Column) -> Column:
    """STM07: unknown, empty and null do not overwrite."""
    return F.when(new.isNull() | (F.trim(new) == "") | (new == "unknown"), old).otherwise(new)


def by_evidence(evidence: Column, old: Column, new: Column) -> Column:
    """DOM24: a missing field keeps its value; an authoritative empty one clears it."""
    return F.when(evidence == "missing", old).when(evidence == "authoritative_empty", F.lit(None)).otherwise(new)


def sale_transition(status: Column, sale: Column, sold_at: Column, now: Column, missing: Column) -> Column:
    """STM08: struct of status, gone_at_set and sold_at after a detail page.

    A sold or gone banner ends a listing and dates a first sale; a possibly gone listing comes back only if no
    complete crawl has missed it; anything else stays.
    """
    ends = sale.isin("sold", "gone") & (status != "gone")
    back = (status == "possibly_gone") & (sale != "sold") & (missing == 0) & ~ends
    sold = F.when(ends & (sale == "sold"), F.coalesce(sold_at, now)).otherwise(sold_at)
    mark = F.when(ends, "set").when(back, "cleared").otherwise("kept")
    return F.struct(F.when(ends, "gone").when(back, "active").otherwise(status).alias("status"), mark.alias("gone_at"), sold.alias("sold_at"))


def guarded_update(current: DataFrame, decisions: DataFrame, key: str, version: str, hidden: str) -> DataFrame:
    """STM11: each decision's outcome: ``written`` if its row still has the version it was made for and is not hidden, else ``skipped-stale``."""
    now = current.select(key, F.col(version).alias("__now"), F.col(hidden).alias("__hidden"))
    same = (F.col(version) == F.col("__now")) & F.col("__hidden").isNull()
    outcome = F.when(F.coalesce(same, F.lit(False)), "written").otherwise("skipped-stale")
    return decisions.join(now, key, "left").withColumn("outcome", outcome).drop("__now", "__hidden")


def mark_missing(state: DataFrame, seen: DataFrame, runs: DataFrame, key: list[str], limit: int = 6) -> DataFrame:
    """STM03 as a batch: (key, missing, status) after all runs: missing counts complete runs since the last sight.

    Runs that are not complete, or that saw nothing, change nothing; a key seen again starts anew. Each run is
    ranked among its source's complete runs once, so that a key needs two numbers only.
    """
    source = key[0]
    real = seen.select(source, "run_id").distinct()
    used = runs.join(real, [source, "run_id"], "left_semi").select(source, "run_id", "run_no", F.col("complete").cast("long").alias("one"))
    order = Window.partitionBy(source).orderBy("run_no")
    ranked = used.withColumn("rank", F.sum("one").over(order))
    last = seen.join(ranked, [source, "run_id"]).groupBy(*key).agg(F.max("rank").alias("seen_rank"))
    total = used.groupBy(source).agg(F.sum("one").alias("total"))
    known = state.select(*key, F.col("missing").alias("was")).join(last, key, "full_outer").join(total, source, "left")
    later = F.coalesce("total", F.lit(0)) - F.coalesce("seen_rank", F.lit(0))
    missing = later + F.when(F.col("seen_rank").isNull(), F.coalesce("was", F.lit(0))).otherwise(0)
    status = F.when(F.col("missing") >= limit, "gone").when(F.col("missing") > 0, "possibly_gone").otherwise("active")
    return known.withColumn("missing", missing.cast("long")).withColumn("status", status).select(*key, "missing", "status")


def _path(spark, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def swap_in(df: DataFrame, root: str, version: str, expected: int) -> str:
    """SNK05: write a version, verify its count, and only then point to it by renaming a finished marker into place.

    A reader takes the newest pointer, so it sees the old version or the new one whole, never neither.
    """
    spark, path = df.sparkSession, f"{root}/version={version}"
    df.write.mode("overwrite").parquet(path)
    found = spark.read.parquet(path).count()
    if found != expected:
        raise ValueError(f"{path} has {found} rows instead of {expected}; the current version stays")
    n = len(pointers(spark, root)) + 1
    draft, fs = _path(spark, f"{root}/draft/{n:09d}={version}")
    fs.mkdirs(draft.getParent())
    fs.create(draft, True).close()
    final, _ = _path(spark, f"{root}/current/{n:09d}={version}")
    fs.mkdirs(final.getParent())
    if not fs.rename(draft, final):
        raise ValueError(f"{final} is there already: another writer was first")
    return path


def pointers(spark, root: str) -> list[str]:
    path, fs = _path(spark, f"{root}/current")
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


def current(spark, root: str) -> DataFrame:
    version = pointers(spark, root)[-1].split("=", 1)[1]
    return spark.read.parquet(f"{root}/version={version}")


def clean_up(spark, root: str, keep: int = 1) -> list[str]:
    """SNK05: delete all but the newest ``keep`` versions that were ever current, and name those deleted."""
    names = [p.split("=", 1)[1] for p in pointers(spark, root)]
    old = [v for v in dict.fromkeys(names) if v not in names[-keep:]]
    for v in old:
        path, fs = _path(spark, f"{root}/version={v}")
        fs.delete(path, True)
    return old

"""Pipelines over real streams: files arrive one by one, queries stop and go on from their checkpoints, rows come late or twice."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lotwise.operators import merge
from lotwise.streaming import pipelines

DAY = dt.datetime(2024, 1, 1)


class Feed:
    """A folder that a stream reads a file at a time."""

    def __init__(self, spark, where, schema):
        self.spark, self.where, self.schema, self.n = spark, str(where), schema, 0

    def send(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.where)

    def read(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.where)


def drain(df, out, state, mode="append"):
    """Run a query over all that has arrived, and stop."""
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


def test_windows_close_behind_the_watermark_and_go_on_after_a_restart(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "ts timestamp, kind string")
    feed.send([(at(5), "a"), (at(50), "a"), (at(61), "b")])
    run = lambda: drain(pipelines.windowed_counts(feed.read(), "ts", ["kind"], "1 hour", watermark="30 minutes"), tmp_path / "out", tmp_path / "state")
    run()
    feed.send([(at(20), "a"), (at(300), "c")])  # twenty minutes past: within the watermark of minute 31
    run()
    feed.send([(at(10), "a"), (at(400), "c")])  # far too late
    feed.send([(at(700), "d")])
    run()
    got = sorted((r["start"], r["kind"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(at(0), "a", 3), (at(60), "b", 1), (at(300), "c", 1), (at(360), "c", 1)]


def test_sliding_windows_and_sessions(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "ts timestamp, user int")
    feed.send([(at(0), 1), (at(20), 1), (at(100), 1), (at(10), 2)])
    feed.send([(at(1000), 3)])
    feed.send([(at(2000), 3)])
    drain(pipelines.sessions(feed.read(), "ts", "user"), tmp_path / "out", tmp_path / "state")
    got = sorted((r["user"], r["start"], r["end"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).where("user < 3").collect())
    assert got == [(1, at(0), at(50), 2), (1, at(100), at(130), 1), (2, at(10), at(40), 1)]
    drain(pipelines.windowed_counts(feed.read(), "ts", [], "2 hours", "1 hour"), tmp_path / "out2", tmp_path / "state2")
    got = sorted((r["start"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out2")).collect())
    assert got[:3] == [(at(-60), 3), (at(0), 4), (at(60), 1)]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_missing_counters_over_a_stream(spark, tmp_path, rocks):
    feed = Feed(spark, tmp_path / "in", "source string, record_key string, run_id string, seen boolean")
    seen: dict = {}

    def keep(batch, _):
        seen.update({(r["source"], r["record_key"]): (r["missing"], r["status"]) for r in batch.collect()})

    def run():
        q = pipelines.missing_counters(feed.read(), limit=3).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(300)

    feed.send([("s", "a", "r1", True), ("s", "b", "r1", False)])
    feed.send([("s", "a", "r2", False), ("s", "b", "r2", False)])
    run()
    assert seen == {("s", "a"): (1, "possibly_gone"), ("s", "b"): (2, "possibly_gone")}
    feed.send([("s", "a", "r2", False), ("s", "b", "r3", False)])  # r2 of a comes again and counts once; b goes
    run()
    assert seen == {("s", "a"): (1, "possibly_gone"), ("s", "b"): (3, "gone")}
    feed.send([("s", "b", "r4", True), ("t", "b", "r1", False)])  # b is back; another source has its own b
    run()
    assert seen[("s", "b")] == (0, "active") and seen[("t", "b")] == (1, "possibly_gone")
    # as the fold over batches has it
    runs = spark.createDataFrame([("s", f"r{i}", i, True) for i in range(1, 5)], "source string, run_id string, run_no long, complete boolean")
    sights = spark.createDataFrame([("s", "a", "r1"), ("s", "b", "r4"), ("s", "c", "r2"), ("s", "c", "r3")], "source string, record_key string, run_id string")
    state = spark.createDataFrame([("s", "a", 0), ("s", "b", 0)], "source string, record_key string, missing int")
    folded = {r["record_key"]: (r["missing"], r["status"]) for r in merge.mark_missing(state, sights, runs, ["source", "record_key"], 3).collect()}
    assert folded == {"a": (3, "gone"), "b": (0, "active"), "c": (1, "possibly_gone")}


def test_incomplete_and_blind_runs_change_nothing(spark):
    runs = spark.createDataFrame([("s", "r1", 1, True), ("s", "r2", 2, False), ("s", "r3", 3, True), ("s", "r4", 4, True)], "source string, run_id string, run_no long, complete boolean")
    sights = spark.createDataFrame([("s", "x", "r1"), ("s", "y", "r2"), ("s", "x", "r4")], "source string, record_key string, run_id string")  # r3 saw nothing
    state = spark.createDataFrame([("s", "z", 4), ("s", "y", 2)], "source string, record_key string, missing int")
    got = {r["record_key"]: (r["missing"], r["status"]) for r in merge.mark_missing(state, sights, runs, ["source", "record_key"]).collect()}
    assert got == {"x": (0, "active"), "y": (1, "possibly_gone"), "z": (6, "gone")}


def test_a_batch_is_applied_once(spark, tmp_path):
    done = []
    apply = pipelines.once_per_batch(str(tmp_path / "root"), lambda df, n: done.append((n, df.count())))
    df = spark.range(3)
    for n in (0, 0, 1, 0):
        apply(df, n)
    assert done == [(0, 3), (1, 3)]

    def fails(df, n):
        raise ValueError("half way")

    broken = pipelines.once_per_batch(str(tmp_path / "root"), fails)
    with pytest.raises(ValueError, match="half way"):
        broken(df, 2)
    apply(df, 2)  # no marker stands for what failed
    assert done[-1] == (2, 3)


def test_the_index_follows_a_stream_of_listings(spark, tmp_path):
    schema = "id long, vehicle string, trim string, scraped_at timestamp, eligible boolean"
    feed = Feed(spark, tmp_path / "in", schema)

    index = lambda: pipelines.read_kept(spark, str(tmp_path / "root" / "index"), feed.read().schema, "id")

    def run():
        pipelines.keep_index(feed.read(), str(tmp_path / "root"), str(tmp_path / "state"), "vehicle", ["trim"], "scraped_at", "id").awaitTermination(300)
        return sorted(r["id"] for r in index().collect())

    feed.send([(1, "v1", None, at(1), True), (2, "v1", "XL", at(0), True), (3, "v2", None, at(1), True)])
    assert run() == [2, 3]
    feed.send([(1, "v1", "XL", at(2), True)])  # now as complete, and later
    assert run() == [1, 3]
    feed.send([(1, "v1", "XL", at(3), False), (3, "v3", None, at(3), True)])  # one is withdrawn, one changes its vehicle
    feed.send([(4, "v2", "LE", at(4), True)])
    assert run() == [2, 3, 4]
    assert run() == [2, 3, 4]  # nothing new
    feed.send([(2, "v1", None, at(-5), False), (4, "v9", "LE", at(1), True)])  # both late
    assert run() == [2, 3, 4] and {r["vehicle"] for r in index().collect()} == {"v1", "v2", "v3"}
    feed.send([(3, "v1", "XL", at(9), True)])  # the last row of v3 leaves it
    assert run() == [3, 4] and {r["vehicle"] for r in index().collect()} == {"v1", "v2"}


def test_a_batch_touches_the_parts_of_its_groups_only(spark, tmp_path):
    schema = "id int, vehicle string, trim string, scraped_at timestamp, eligible boolean"
    feed = Feed(spark, tmp_path / "in", schema)
    root = tmp_path / "root"

    def files():
        return {str(p.relative_to(root)): p.stat().st_mtime_ns for name in ("listings", "index", "known") for p in (root / name).rglob("*.parquet")}

    def run():
        pipelines.keep_index(feed.read(), str(root), str(tmp_path / "state"), "vehicle", ["trim"], "scraped_at", "id", buckets=16).awaitTermination(300)
        return {r["vehicle"]: r["id"] for r in pipelines.read_kept(spark, str(root / "index"), feed.read().schema, "id").collect()}

    feed.send([(i, f"v{i % 40}", None, at(i), True) for i in range(200)])
    assert run() == {f"v{i}": i + 160 for i in range(40)}
    before = files()
    feed.send([(3, "v3", "XL", at(500), True)])
    want = {f"v{i}": i + 160 for i in range(40)} | {"v3": 3}
    assert run() == want
    after = files()
    changed = {f.split("/part-")[0] for f in before.keys() ^ after.keys()} | {f.split("/part-")[0] for f in before.keys() & after.keys() if before[f] != after[f]}
    assert len(changed) == 3  # one part of each table
    # the same batch once more, as after a failure before its marker was made
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/applied")
    fs.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs, True)
    again = spark.createDataFrame([(3, "v3", "XL", at(500), True)], schema).coalesce(1)
    feed.spark, feed.n = spark, feed.n + 1
    again.write.mode("append").parquet(feed.where)
    assert run() == want


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "page string, scraped_at timestamp, v int")
    feed.send([("p", at(0), 1), ("p", at(0), 2)])
    feed.send([("p", at(0), 3), ("q", at(5), 4)])
    drain(pipelines.once_each(feed.read(), ["page", "scraped_at"], "scraped_at", "1 hour"), tmp_path / "out", tmp_path / "state")
    feed.send([("p", at(0), 5), ("p", at(9), 6)])
    drain(pipelines.once_each(feed.read(), ["page", "scraped_at"], "scraped_at", "1 hour"), tmp_path / "out", tmp_path / "state")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["page"], r["scraped_at"]) for r in got.collect()) == [("p", at(0)), ("p", at(9)), ("q", at(5))]


def test_a_late_page_applies_its_values_but_stays_stale(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "id int, value string, scraped_at timestamp")
    state = [spark.createDataFrame([(1, "old", at(10)), (2, "old", at(10)), (3, "old", None)], "id int, value string, stale_at timestamp")]

    def keep(batch, _):
        state[0] = spark.createDataFrame(pipelines.apply_detail(state[0], batch, "id").collect(), state[0].schema)

    feed.send([(1, "late", at(5)), (2, "fresh", at(11))])
    feed.send([(3, "x", at(1)), (3, "y", at(2))])
    feed.read().writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(300)
    assert sorted(map(tuple, state[0].collect())) == [(1, "late", at(10)), (2, "fresh", None), (3, "y", None)]


def test_swaps_are_whole_or_nothing(spark, tmp_path):
    root = str(tmp_path / "catalog")
    merge.swap_in(spark.range(5), root, "a", 5)
    with pytest.raises(ValueError, match="instead of"):
        merge.swap_in(spark.range(6), root, "b", 5)
    assert merge.current(spark, root).count() == 5
    merge.swap_in(spark.range(7), root, "c", 7)
    assert merge.current(spark, root).count() == 7 and merge.clean_up(spark, root) == ["a"] and merge.current(spark, root).agg(F.max("id")).first()[0] == 6

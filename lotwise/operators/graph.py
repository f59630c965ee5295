"""Connected components of an edge list, and walks down a hierarchy, in rounds over what is left of the graph."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A setting of Spark's: the files of a query's shuffles go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session, which is one machine, may do without the setting."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(place or tempfile.mkdtemp(prefix="lotwise-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Rounds after which a loop's state is written as a table instead of a checkpoint, whose size estimate has grown by then.
LONG = 4


@contextmanager
def cleaning(spark: SparkSession):
    """What is cut off from its lineage no longer needs its shuffles, so Spark is told to delete their files at once."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    checkpoint_folder(df.sparkSession)
    with cleaning(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan made under the setting


def shared_table(df: DataFrame) -> DataFrame:
    """The same for loops: a table written in the shared folder, whose size Spark then knows.

    A checkpoint keeps its plan's estimate, the product of what was joined; after some rounds that is a number of millions of digits.
    """
    where = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with cleaning(df.sparkSession):
        df.select("*").write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): each node of an undirected edge list with one node of its component, the same for all of them.

    Randomised contraction: every node points to the node of least hash among itself and its neighbours;
    edges move to where their ends point, and loops and repeated edges go. So each round works on what is
    left of the graph, expected to shrink by a fixed share. The pointers, one table for each round, are
    followed at the end, from the last round to the first. Nothing but "is an edge left" reaches the driver.
    """
    left = shared_checkpoint(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        salt = F.lit(len(rounds) // 2)  # the second round of a pair ends what became stars in the first
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = ends.groupBy(F.col("a").alias("node")).agg(F.min_by("b", F.xxhash64("b", salt)).alias("near"))
        less = F.xxhash64("near", salt) < F.xxhash64("node", salt)
        rounds.append(shared_checkpoint(best.select("node", F.when(less, F.col("near")).otherwise(F.col("node")).alias("comp"))))
        first, second = (rounds[-1].select(F.col("node").alias(x), F.col("comp").alias(f"to_{x}")) for x in ("a", "b"))
        moved = left.join(first, "a").join(second, "b").where("to_a <> to_b")
        left = (shared_table if len(rounds) > LONG else shared_checkpoint)(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    done = rounds.pop()
    while rounds:
        further = done.select(F.col("node").alias("comp"), F.col("comp").alias("last"))
        done = shared_checkpoint(rounds.pop().join(further, "comp", "left").select("node", F.coalesce("last", "comp").alias("comp")))
    return done


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each node with the least node of its component."""
    found = components(edges, a, b)
    least = found.groupBy("comp").agg(F.least(F.min("node"), F.col("comp")).alias("component"))
    return found.join(least, "comp").select(F.col("node").alias("id"), "component")


def _longer(jumps: DataFrame) -> DataFrame:
    """(above, below) pairs of twice as many steps."""
    first, second = jumps.select("above", F.col("below").alias("via")), jumps.select(F.col("above").alias("via"), "below")
    return shared_table(first.join(second, "via").select("above", "below").distinct())


def descendants(edges: DataFrame, roots: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(id, root, depth) of each root and all below it; a node reached twice keeps its least depth.

    Steps double: round k reaches from all that is known by jumps of 2**k steps, and then joins the jumps with
    themselves. So a chain of n nodes takes log2(n) rounds. A round without a new pair is the last: on a shortest
    way every depth occurs, so nothing lies deeper. Cycles end in the same way. In a forest there are at most as
    many jumps as edges; with several parents a node has a jump for each node so many steps above.
    """
    jumps = edges.select(F.col(parent).alias("above"), F.col(child).alias("below")).where("above is not null and below is not null").distinct()
    root = F.col(roots.columns[0])
    known = shared_checkpoint(roots.select(root.alias("id"), root.alias("root")).distinct().withColumn("depth", F.lit(0)))
    steps = 1
    while True:
        reached = known.join(jumps, F.col("id") == F.col("above")).groupBy(F.col("below").alias("id"), "root").agg((F.min("depth") + steps).cast("int").alias("depth"))
        fresh = shared_table(reached.join(known.select("id", "root"), ["id", "root"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)  # a table a round
        jumps = _longer(jumps)
        steps *= 2


def endless(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(id): nodes with a cycle below them, on it or above it: those from which as many steps lead down as there are nodes."""
    jumps = shared_table(edges.select(F.col(parent).alias("above"), F.col(child).alias("below")).where("above is not null and below is not null").distinct())
    nodes = jumps.select(F.col("above").alias("id")).unionByName(jumps.select(F.col("below").alias("id"))).distinct().count()
    steps = 1
    while steps <= nodes and not jumps.isEmpty():
        jumps, steps = _longer(jumps), steps * 2
    return jumps.select(F.col("above").alias("id")).distinct()

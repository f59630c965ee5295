"""Chat formatting: link tool calls with their results, order them, validate arguments, write canonical JSON.

DataFrame functions only. Calls and results meet in a hash join by (conversation, identifier), whose
built side holds each key once; calls are ordered by level (one more than the highest level among the calls that they need), resolved a level at a
time; arguments are compared with a schema table field by field. Rows stay one per call, so a
conversation of any length is never gathered.

Defined results: of several calls or results with one identifier the first by turn (then text) counts, the
others are ``duplicate``; a call without a result is ``unanswered``, a result without a call ``orphan``;
needs that name no call are ignored and listed; calls on a cycle, and those behind one, have a null level;
null or malformed arguments are invalid with error ``not an object``; rows with a null identifier
link with nothing and are ``unidentified``; what is not validated (duplicates, orphans, unidentified rows)
has a null ``valid``. Columns besides those named are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import shared_checkpoint
from lotwise.operators.graph import shared_table

KEY = ["conv_id", "call_id"]
#: A schema table of at most this many rows is broadcast; a larger one is shuffled.
SCHEMA_ROWS = 100_000


def hashed(df: DataFrame) -> DataFrame:
    """The built side of a hash join. Its keys are unique, so no key makes a large entry."""
    return df.hint("shuffle_hash")


def narrow(df: DataFrame) -> DataFrame:
    """Broadcast a table of tools, whose names are few keys with many calls each, if its size has been checked."""
    return F.broadcast(df) if df.limit(SCHEMA_ROWS + 1).count() <= SCHEMA_ROWS else df


def first_of_each(df: DataFrame, text: str) -> DataFrame:
    """Mark the first row of each identifier. Rows without one, however many, stay out of the window."""
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    order = Window.partitionBy(*KEY).orderBy(F.asc_nulls_last("turn"), F.asc_nulls_last(text))
    some = df.where(named).withColumn("first", F.row_number().over(order) == 1)
    return some.unionByName(df.where(~named).withColumn("first", F.lit(False)))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of unique calls with ``needs``; cyclic calls are absent. Rounds: the longest chain."""
    nodes = calls.select(*KEY)
    edges = shared_checkpoint(
        calls.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("need"))
        .join(hashed(nodes.select("conv_id", F.col("call_id").alias("need"))), ["conv_id", "need"])
    )
    waiting = edges.select(*KEY).distinct()
    done = shared_checkpoint(nodes.join(hashed(waiting), KEY, "left_anti").withColumn("level", F.lit(0)))
    level = 0
    while True:
        # a call is ready when all that it needs is done
        ready = done.select("conv_id", F.col("call_id").alias("need"), F.lit(1).alias("ready"))
        met = edges.join(hashed(ready), ["conv_id", "need"], "left")
        state = met.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.count("ready").alias("k")).where("n = k").select(*KEY)
        level += 1
        fresh = shared_table(state.join(hashed(done), KEY, "left_anti").withColumn("level", F.lit(level)))
        if fresh.isEmpty():
            return done
        done = done.unionByName(fresh)


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, errors) of unique calls: missing fields, wrong kinds, unknown fields and tools."""
    given = calls.select(*KEY, "name", F.explode(F.map_entries(F.from_json("arguments", "map<string,variant>"))).alias("e")).select(
        *KEY, "name", F.col("e.key").alias("field"), F.regexp_extract(F.schema_of_variant("e.value"), "^[A-Z]+", 0).alias("got")
    )
    asked = schemas.select("name", "field", "kind", "required")
    wanted = calls.select(*KEY, "name").join(narrow(asked), "name")
    both = wanted.join(hashed(given), [*KEY, "name", "field"], "full_outer")
    known = narrow(asked.select("name").distinct().withColumn("known", F.lit(True)))
    error = (
        F.when(F.col("got").isNull() & F.col("required"), F.concat(F.lit("missing "), "field"))
        .when(F.col("kind").isNull() & F.col("known"), F.concat(F.lit("unknown field "), "field"))
        .when(F.col("got").isNotNull() & (F.col("got") != F.col("kind")), F.concat(F.lit("not "), F.lower("kind"), F.lit(": "), "field"))
    )
    found = both.join(known, "name", "left").select(*KEY, error.alias("error")).where("error is not null")
    return found.groupBy(*KEY).agg(F.array_sort(F.collect_list("error")).alias("errors"))  # as many as a call has fields


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call or orphan result, with status, level, errors and canonical JSON.

    calls: conv_id, turn, call_id, name, arguments (JSON text), needs (array of call_id); results: conv_id,
    turn, call_id, content; schemas: name, field, kind (as ``schema_of_variant`` names it), required.
    """
    calls = shared_checkpoint(first_of_each(calls.select("conv_id", "turn", "call_id", "name", "arguments", "needs"), "arguments"))
    results = first_of_each(results.select("conv_id", "turn", "call_id", "content"), "content")
    own = calls.where("first")
    answers = results.where("first").select(*KEY, F.col("turn").alias("result_turn"), "content")
    parsed = F.try_parse_json("arguments")
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    tools = narrow(schemas.select("name").distinct().withColumn("known", F.lit(True)))
    orphan = F.col("turn").isNull() & F.col("name").isNull() & F.col("first").isNull()
    unanswered = F.col("result_turn").isNull() & F.col("content").isNull()
    linked = (
        own.join(hashed(answers), KEY, "full_outer")
        .join(hashed(levels(own)), KEY, "left")
        .join(hashed(validate(own.where(is_object), schemas)), KEY, "left")
        .join(tools, "name", "left")
        .withColumn("status", F.when(orphan, "orphan").when(unanswered, "unanswered").otherwise("linked"))
    )
    ids, none = F.col("first").isNotNull(), F.array().cast("array<string>")
    errors = F.concat(
        F.when(ids & F.col("known").isNull(), F.array(F.lit("unknown tool"))).otherwise(none),
        F.when(ids & ~is_object, F.array(F.lit("not an object"))).otherwise(none),
        F.coalesce("errors", none),
    )
    rows = linked.select(
        "conv_id", F.coalesce("turn", "result_turn").alias("turn"), "call_id", "name", "level", "status",
        F.when(ids, errors).alias("errors"), F.when(is_object, parsed).alias("args"), "arguments", "content",
    )
    missing = F.lit(None).cast("string")
    unnamed = F.col("conv_id").isNull() | F.col("call_id").isNull()

    def left_over(d: DataFrame, name, args, content) -> DataFrame:
        return d.where("not first").select(
            "conv_id", "turn", "call_id", name.alias("name"), F.lit(None).cast("int").alias("level"),
            F.when(unnamed, "unidentified").otherwise("duplicate").alias("status"), F.lit(None).cast("array<string>").alias("errors"),
            F.lit(None).cast("variant").alias("args"), args.alias("arguments"), content.alias("content"),
        )

    twice = [left_over(calls, F.col("name"), F.col("arguments"), missing), left_over(results, missing, missing, F.col("content"))]
    # keys in byte order, no blanks; a variant's objects are written with sorted keys

    def text(c: str):
        whole = F.to_json(F.struct(F.col(c).alias("x")))  # {"x":...}
        return F.when(F.col(c).isNull(), "null").otherwise(F.coalesce(whole.substr(F.lit(6), F.length(whole) - 6), F.lit("null")))

    arguments = F.when(F.col("args").isNotNull(), F.to_json("args")).otherwise(text("arguments"))
    fields = [F.concat(F.lit(f'"{k}":'), arguments if k == "arguments" else text(k)) for k in ("arguments", "call_id", "content", "name", "status")]
    json = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    out = rows.unionByName(twice[0]).unionByName(twice[1])
    valid = F.when(F.col("errors").isNotNull(), F.size("errors") == 0)
    return out.select("conv_id", "turn", "call_id", "name", "level", "status", valid.alias("valid"), F.concat_ws("; ", "errors").alias("errors"), json.alias("json"))

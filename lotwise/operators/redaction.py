"""STR34: JSON without private keys, and JSON inside texts cleaned as JSON, level by level within a row.

A level is an array of values. The next one has what lies in its objects and arrays (Spark's variant) under keys that are not
private, and the JSON inside its texts; then levels are put together again from the deepest up, keys in order. A text that has
no JSON, or whose brackets do not parse, is free text (``lotwise.functions.redaction``). No row is moved. A round opens
``LEVELS`` levels; rows that have more go on to the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.redaction import let, private_name, redact
from lotwise.operators.graph import shared_table

#: Budgets of depth, of values of a text, and of characters of a text and a key.
MOST_DEPTH, MOST_NODES, MOST_STRING, MOST_KEY = 32, 20_000, 65_536, 256
CUT = "[TRUNCATED]"
#: Levels that a round opens.
LEVELS = 6


def _brackets(depth: int) -> str:
    """A run from a bracket to the one that closes it, over so many levels; possessive, so that a failed try is not tried again."""
    inner = r"[^\[\]{}]"
    pattern = rf"[\[{{]{inner}*+[\]}}]"
    for _ in range(depth - 1):
        pattern = rf"[\[{{](?:{inner}++|{pattern})*+[\]}}]"
    return pattern


#: Levels of JSON that is found between words; deeper JSON is cleaned if it is the whole text.
FOUND = _brackets(6)


def as_json(c: Column) -> Column:
    """A string as JSON text."""
    whole = F.to_json(F.struct(c.alias("x")))
    return F.when(c.isNull(), "null").otherwise(F.substr(whole, F.lit(6), F.length(whole) - 6))


def _node(row: Column) -> Column:
    """A value (key, kind, text) with its parts, if it is a ``string``: plain ones, and the JSON between them as ``found``."""
    text, string = row["text"], row["kind"] == "string"
    cut = F.when(string & (F.length(text) > MOST_STRING), F.concat(F.left(text, F.lit(MOST_STRING)), F.lit("…" + CUT))).otherwise(text)
    none = F.array().cast("array<string>")

    def parted(t: Column) -> Column:
        whole = t.rlike(r"^\s*[\[{]") & F.try_parse_json(t).isNotNull()  # such a text has no plain part
        parts = (
            F.when(~string | t.isNull(), F.struct(none.alias("plain"), none.alias("found"))).when(~t.rlike(r"[\[{]"), F.struct(F.array(t).alias("plain"), none.alias("found")))
            .when(whole, F.struct(none.alias("plain"), F.array(t).alias("found"))).otherwise(F.struct(F.split(t, FOUND).alias("plain"), F.regexp_extract_all(t, F.lit(f"({FOUND})"), F.lit(1)).alias("found")))
        )
        return let(parts, lambda p: F.struct(row["key"].alias("key"), row["kind"].alias("kind"), t.alias("text"), p["plain"].alias("plain"), p["found"].alias("found")))

    return let(cut, parted)


def _kind(json: Column, depth: int) -> Column:
    """What a value's JSON is: a box to open, a string, or a value that is written as it is."""
    box = lambda kind: "cut" if depth >= MOST_DEPTH else kind
    return F.when(F.startswith(json, F.lit('"')), "string").when(F.startswith(json, F.lit("{")), box("object")).when(F.startswith(json, F.lit("[")), box("array")).otherwise("as it is")


def _within(node: Column, depth: int) -> Column:
    """The values within a text, an object or an array, without those under private keys."""
    row = lambda key, kind, text: F.struct(key.cast("string").alias("key"), kind.alias("kind"), text.alias("text"))

    def value(key: Column, v: Column) -> Column:
        of = lambda j: let(_kind(j, depth), lambda k: row(key, k, F.when(k == "string", F.try_variant_get(v, "$", "string")).otherwise(j)))
        return let(F.coalesce(F.to_json(v), F.lit("null")), of)

    def json(text: Column) -> Column:
        return row(F.lit(None), F.when(F.try_parse_json(text).isNull(), "as it is").otherwise(_kind(F.ltrim(text, F.lit(" \t\r\n")), depth)), text)

    def open_key(key: Column) -> Column:
        return (F.length(key) <= MOST_KEY) & ~private_name(key) & (redact(key) == key)

    parsed = F.try_parse_json(node["text"])
    members = F.filter(F.map_entries(F.try_variant_get(parsed, "$", "map<string, variant>")), lambda e: open_key(e["key"]))
    rows = (
        F.when(node["kind"] == "string", F.transform(node["found"], json)).when(node["kind"] == "object", F.transform(members, lambda e: value(e["key"], e["value"])))
        .when(node["kind"] == "array", F.transform(F.try_variant_get(parsed, "$", "array<variant>"), lambda v: value(F.lit(None), v)))
    )
    nothing = F.array().cast("array<struct<key:string,kind:string,text:string>>")
    return F.transform(F.coalesce(rows, nothing), _node)


def _opened(level: str, depth: int) -> Column:
    return F.transform(level, lambda n: _within(n, depth))


def _written(node: Column, rows: Column, quoted: bool) -> Column:
    """A value as text, from what the values within it (key, text) have become."""
    texts = lambda of, f: F.array_join(F.transform(of, f), ",")
    obj = F.concat(F.lit("{"), texts(F.array_sort(rows), lambda r: F.concat(as_json(r["key"]), F.lit(":"), r["text"])), F.lit("}"))
    arr = F.concat(F.lit("["), texts(rows, lambda r: r["text"]), F.lit("]"))
    mixed = F.array_join(F.zip_with(node["plain"], F.transform(rows, lambda r: r["text"]), lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")
    free = F.when(node["text"].isNull(), None).when(F.size(node["plain"]) == 0, F.get(rows, F.lit(0))["text"]).otherwise(let(mixed, redact))
    return (
        F.when(node["kind"] == "object", obj).when(node["kind"] == "array", arr).when(node["kind"] == "cut", as_json(F.lit(CUT)))
        .when(node["kind"] == "string", as_json(free) if quoted else free).otherwise(node["text"])
    )


def _places(groups: Column) -> Column:
    """Where each of some arrays begins when they stand end to end, and its size."""
    start = F.struct(F.array().cast("array<struct<at:int,n:int>>").alias("done"), F.lit(0).alias("at"))
    add = lambda s, g: F.struct(F.concat(s["done"], F.array(F.struct(s["at"].alias("at"), F.size(g).alias("n")))).alias("done"), (s["at"] + F.size(g)).alias("at"))
    return F.aggregate(groups, start, add, lambda s: s["done"])


def _level(k: int, made) -> Column:
    """A level as texts, from the next one (``made``)."""
    # the next level is worked out once, not again for each value
    return let(F.col("made"), lambda below: F.zip_with(f"l{k}", f"a{k}", lambda n, p: made(n, F.slice(below, p["at"] + 1, p["n"]))))


def _together(df: DataFrame, levels: int) -> DataFrame:
    """With the text ``made`` of levels l0, l1, ..., whose values lie within each other at a0, a1, ..."""
    made = lambda k: lambda n, rows: F.struct(n["key"].alias("key"), _written(n, rows, k > 0).alias("text"))
    none = F.array().cast("array<struct<key:string,text:string>>")
    df = df.withColumn("made", F.transform(f"l{levels}", lambda n: made(levels)(n, none)))
    for k in reversed(range(levels)):
        df = df.withColumn("made", _level(k, made(k)))
    return df.withColumn("made", F.col("made")[0]["text"])


def redact_json(df: DataFrame, row_id: str, text: str, out: str = "redacted") -> DataFrame:
    """``row_id`` and the cleaned text. Depth beyond ``MOST_DEPTH`` and texts of more than ``MOST_NODES`` values become ``CUT``; texts over ``MOST_STRING`` are cut."""
    root = F.struct(F.lit(None).cast("string").alias("key"), F.lit("string").alias("kind"), F.col(text).alias("text"))
    # texts are dealt out, since a table of few bytes has much work
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    df = df.select(row_id, text).repartition(tasks)
    left = df.select(F.col(row_id).alias("id"), F.array(_node(root)).alias("l0"), F.lit(0).alias("n"))
    done, depth = [], 0
    while True:
        for k in range(depth, depth + LEVELS):
            opened = left.withColumn("opened", _opened(f"l{k}", k))
            sized = opened.withColumn("n", F.col("n") + F.aggregate("opened", F.lit(0), lambda s, g: s + F.size(g)))
            few = F.when(F.col("n") <= MOST_NODES, F.col("opened")).otherwise(F.slice("opened", 1, 0))  # of others nothing is needed
            left = sized.withColumn("opened", few).withColumns({f"a{k}": _places(F.col("opened")), f"l{k + 1}": F.flatten("opened")}).drop("opened")
        depth += LEVELS
        ready = (F.col("n") > MOST_NODES) | (F.size(f"l{depth}") == 0)
        made = F.when(F.col("n") > MOST_NODES, CUT).when(ready, F.col("made"))
        left = _together(left, depth - 1)
        state = [f"l{k}" for k in range(depth + 1)] + [f"a{k}" for k in range(depth)]
        table = shared_table(left.select("id", made.alias("done"), ready.alias("ready"), "n", *[F.when(~ready, F.col(c)).alias(c) for c in state]))
        done.append(table.where("ready").select(F.col("id").alias(row_id), F.col("done").alias(out)))
        left = table.where("not ready").select("id", "n", *state)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)

"""SRC15: fields of pages by CSS selectors, kept as a table of mappings.

``nodes`` reads each page once and gives a row for every element and every run of text: its number in the page, its parent,
the last number within it, tag, id, classes and attributes. A selector is then filters on these rows, joined by page for its
steps (``>`` by parent, a space by the span of numbers). ``extract`` does so for a whole table of mappings.

Broken markup: a void element has no inside; an end tag closes the nearest open element of its name, and all within it, or
nothing if none is open; ``p``, ``li``, ``tr``, ``td``, ``th``, ``option``, ``dt`` and ``dd`` end before the next of
their kind in the same parent; what is open at the end ends there. Scripts and styles have no text; JSON in scripts is a run of ``#data``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without an inside, elements that end before the next of their kind, and those whose text is not read.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS = {"p", "li", "tr", "td", "th", "option", "dt", "dd"}
SILENT = {"script", "style"}
NODE = "node int, parent int, last int, tag string, id string, classes array<string>, attributes map<string, string>, text string"


class _Reader(HTMLParser):
    """One page as rows of ``NODE``."""

    def __init__(self, references: tuple[str, ...] | None = None):
        super().__init__(convert_charrefs=True)
        # scripts and styles, whose text is left as it is, or an ``&`` that begins none of the references
        self.other = re.compile(rf"(?is)<(script|style)\b.*?(?:</\1|\Z)|(?-i:&(?!(?:{'|'.join(map(re.escape, references))});))") if references else None
        self.rows: list[list] = []
        self.open: list[int] = []

    def add(self, tag: str, attributes: dict[str, str], text: str | None) -> None:
        n = len(self.rows)
        self.rows.append([n, self.open[-1] if self.open else -1, n, tag, attributes.get("id"), (attributes.get("class") or "").split(), attributes, text])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS and self.open and self.rows[self.open[-1]][3] == tag:
            self.end(1)
        self.add(tag, {k: v or "" for k, v in reversed(attrs)}, None)  # the first of a name counts
        if tag not in VOID:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for depth, n in enumerate(reversed(self.open), 1):
            if self.rows[n][3] == tag:
                return self.end(depth)

    def end(self, many: int) -> None:
        for _ in range(many):
            self.rows[self.open.pop()][2] = len(self.rows) - 1

    def handle_data(self, data: str) -> None:
        around = self.rows[self.open[-1]] if self.open else [None] * 8
        if around[3] in SILENT:
            if (around[6].get("type") or "").lower().endswith("json"):
                self.add("#data", {}, data)
        elif data:
            self.add("#text", {}, data)

    def read(self, page: str) -> list[list]:
        self.feed(self.other.sub(lambda m: "&amp;" if m[0] == "&" else m[0], page) if self.other else page)
        self.close()
        self.end(len(self.open))
        return self.rows


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html", references: tuple[str, ...] | None = None) -> DataFrame:
    """``key`` (unique) and the rows of each page; null and empty pages have none. With ``references`` (``amp``) only those are decoded, where a semicolon closes them."""

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *(c.split()[0] for c in NODE.split(", ") if " " in c and not c.startswith("string>"))]
        for part in parts:
            for at in range(0, len(part), 16):
                some = part.iloc[at : at + 16]
                rows = [[k, *row] for k, page in zip(some[key], some[html], strict=True) for row in _Reader(references).read(page)]
                yield pd.DataFrame(rows, columns=names)

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, html).where(f"`{html}` <> ''").mapInPandas(task, f"`{key}` {kind}, {NODE}")


_PART = re.compile(r"""([\w-]+|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]""", re.X)


def _test(compound: str) -> Column:
    """Whether a node is such an element: tag, ``#id``, ``.class``, and ``[attribute]`` with ``=``, ``~=``, ``^=``, ``$=`` or ``*=``."""
    tests, end = [~F.startswith("tag", F.lit("#"))], 0
    while end < len(compound):
        m = _PART.match(compound, end)
        if not m or (m[1] and end):
            raise ValueError(f"not a selector: {compound}")
        end = m.end()
        if m[1] and m[1] != "*":
            tests.append(F.col("tag") == m[1].lower())
        elif m[2]:
            tests.append(F.col("id") == m[2])
        elif m[3]:
            tests.append(F.array_contains("classes", m[3]))
        elif m[4]:
            a, want = F.col("attributes")[m[4].lower()], next((x for x in m.groups()[5:] if x is not None), None)
            how = {"=": lambda: a == want, "~=": lambda: F.array_contains(F.split(a, r"\s+"), want), "^=": lambda: F.startswith(a, F.lit(want)), "$=": lambda: F.endswith(a, F.lit(want)), "*=": lambda: F.contains(a, F.lit(want))}
            if m[5] and m[5] not in how:
                raise ValueError(f"not a selector: {compound}")
            tests.append(how[m[5]]() if m[5] else a.isNotNull())
    return reduce(lambda x, y: x & y, tests)


def select(found: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    """The nodes that a selector means, each once: steps by ``>`` or a space, alternatives by commas."""
    ways = []
    for way in re.split(r",(?![^\[]*\])", selector):
        steps = re.findall(r"(?:^|(>)|\s)\s*((?:\[[^\]]*\]|[^\s>\[])+)", way.strip())
        if not steps or re.sub(r"\s+", "", way) != "".join(a + re.sub(r"\s+", "", b) for a, b in steps):
            raise ValueError(f"not a selector: {selector}")
        got = found.where(_test(steps[0][1]))
        for child, compound in steps[1:]:
            above = got.select(F.col(key).alias("__key"), F.col("node").alias("__node"), F.col("last").alias("__last"))
            inside = F.col("parent") == F.col("__node") if child else (F.col("node") > F.col("__node")) & (F.col("node") <= F.col("__last"))
            got = found.where(_test(compound)).join(above, (F.col(key) == F.col("__key")) & inside, "left_semi")
        ways.append(got)
    return reduce(DataFrame.unionByName, ways).dropDuplicates([key, "node"]) if len(ways) > 1 else ways[0]


#: Mappings that are read at most: each is a part of the plan.
MOST_MAPPINGS = 1_000


def extract(pages: DataFrame, mappings: DataFrame, key: str = "page_id", html: str = "html", references: tuple[str, ...] | None = None) -> DataFrame:
    """(key, field, values): for each page and mapping (field, selector, take) what its nodes hold, in order, trimmed, without blank ones.

    ``take`` is an attribute's name, or ``text`` for all text within a node with its spaces folded. Rows exist for fields with values.
    """
    from lotwise.operators.graph import shared_checkpoint

    wanted = mappings.select("field", "selector", "take").orderBy("field", "selector", "take").limit(MOST_MAPPINGS + 1).collect()
    if len(wanted) > MOST_MAPPINGS:
        raise ValueError(f"more than {MOST_MAPPINGS} mappings")
    name, key = key, "__page"  # a key may be named as a column of nodes is
    pages = pages.select(F.col(name).alias(key), html)
    tree = shared_checkpoint(nodes(pages, key, html, references).repartition(key))  # by page, so that no step moves rows again
    each = [select(tree, m["selector"], key).select(key, F.lit(m["field"]).alias("field"), F.lit(m["take"]).alias("take"), "node", "last", "attributes") for m in wanted]
    hits = reduce(DataFrame.unionByName, each) if each else tree.limit(0).select(key, F.lit("").alias("field"), F.lit("").alias("take"), "node", "last", "attributes")
    named = hits.where("take <> 'text'").select(key, "field", "node", F.element_at("attributes", F.lower("take")).alias("value"))
    texts = tree.where("tag = '#text'").select(F.col(key).alias("__key"), F.col("node").alias("__node"), "text")
    whole = hits.where("take = 'text'").drop("attributes", "take").distinct()
    inside = whole.join(texts, (F.col(key) == F.col("__key")) & (F.col("__node") > F.col("node")) & (F.col("__node") <= F.col("last")))
    joined = inside.groupBy(key, "field", "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__node", "text"))), lambda t: t["text"]), "").alias("value"))
    values = named.unionByName(joined).withColumn("value", F.trim(F.regexp_replace("value", r"[ \t\n\x0B\f\r]+", " "))).where("value <> ''").distinct()
    return values.groupBy(F.col(key).alias(name), "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "value"))), lambda v: v["value"]).alias("values"))

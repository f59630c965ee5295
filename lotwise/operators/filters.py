"""Predicates: publication gates, optional parameters, IN lists, ranges and search."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.text import city_state
from lotwise.operators import fulltext
from lotwise.operators.quality import BLEED as FIELD_BLEED  # noqa: F401


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def published(status: str = "status", publication: str = "publication_status", source: str = "source_status") -> Column:
    """FLT01."""
    return (F.col(status) == "active") & (F.col(publication) == "eligible") & (F.col(source) != "disabled")


def strictly_ready() -> Column:
    """FLT02: seven conjuncts over a listing's columns."""
    return all_of([F.col("detail_scraped_at").isNotNull(), F.col("detail_stale_at").isNull(), F.col("quality_checked_at").isNotNull(), F.col("readiness_computed_at").isNotNull(), F.size("images") > 0, F.size("readiness_blockers") == 0, F.col("vin").isNull() | F.col("vehicle_model_id").isNotNull()])


def credible() -> Column:
    """FLT19: which claims count as evidence."""
    return F.col("eligible") & (F.col("evidence_kind") != "generic_text") & ((F.col("evidence_kind") != "photo") | F.coalesce(F.col("confidence") >= 0.7, F.lit(False)))


def city_pair(raw: Column) -> Column:
    """FLT06: a wanted ``name|ST`` as listings hold it; what is no such pair stays as given."""
    return F.coalesce(city_state(F.substring_index(raw, "|", 1), F.regexp_extract(raw, r"\|(.*)$", 1)), raw)


def one_of(c: Column, wanted: list[str]) -> Column:
    """FLT14: a value among those wanted, ignoring case."""
    return F.lower(c).isin(*[w.lower() for w in wanted])


def stale(checked: Column, cutoff: Column, flag: Column | None = None) -> Column:
    """FLT12: never checked, checked before the cutoff, or flagged."""
    out = checked.isNull() | (checked < cutoff)
    return out if flag is None else out | F.coalesce(flag, F.lit(False))


def after(keys: list[str], seen: list) -> Column:
    """FLT18, SRT04: the row-value comparison of keyset paging."""
    return F.struct(*[F.col(k) for k in keys]) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, seen, strict=True)])


@dataclass(frozen=True)
class Search:
    """A search: lists are AND-ed, each meaning any of its values; empty lists and missing bounds are ignored."""

    text: str | None = None
    any_of: dict[str, list] = field(default_factory=dict)
    any_in_array: dict[str, list] = field(default_factory=dict)
    ranges: dict[str, tuple] = field(default_factory=dict)
    sort: str | None = None
    page: int = 1
    per_page: int = 20
    cap: int = 20_000

    def conditions(self, without: str | None = None) -> Column:
        """FLT03, 04, 05, 08, 24. ``without`` leaves one parameter out, for its own facet."""
        parts = [F.col(c).isin(*v) for c, v in self.any_of.items() if v and c != without]
        parts += [F.arrays_overlap(F.col(c), F.array(*map(F.lit, v))) for c, v in self.any_in_array.items() if v and c != without]
        for c, (lo, hi) in self.ranges.items():
            if c != without:
                parts += [F.col(c) >= lo] if lo is not None else []
                parts += [F.col(c) <= hi] if hi is not None else []
        return all_of(parts)

    def order(self, tie: str) -> list[Column]:
        """SRT02: ``column:asc`` or ``column:desc``, then the tie-break."""
        name, _, way = (self.sort or "").partition(":")
        return ([F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_last()] if name else []) + [F.col(tie).asc()]


def search(df: DataFrame, s: Search, tie: str, index: fulltext.Index | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """SRT01, 03: one page of hits. With a text only rows that have a word of it, the best by BM25 first; ``index`` holds the ids of ``tie``."""
    hits, order = df.where(s.conditions()), s.order(tie)
    if s.text and index is not None:
        one = df.sparkSession.createDataFrame([(0, s.text)], "query_id int, text string")
        found = fulltext.search(index, one, weights or {}, s.cap)
        hits = hits.join(found.select(F.col("doc").alias(tie), F.col("score").alias("text_score")), tie)
        order = [F.desc("text_score"), *order]
    first = (s.page - 1) * s.per_page
    return hits.orderBy(*order).offset(first).limit(max(0, min(s.per_page, s.cap - first)))


def pages(total: Column, per_page: int) -> Column:
    return F.ceil(total / per_page)

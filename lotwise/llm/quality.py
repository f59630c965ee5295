"""Quality classifier: a sparse ensemble of rules.

Boosted trees over text statistics are taken apart into their paths, each a conjunction of thresholds;
a logistic model with an L1 penalty weighs the rules, and those with a weight become one Spark column
expression over the statistics.

The fit uses at most ``SAMPLE_ROWS`` labelled rows (those of least hash of their id); every document is
scored. Defined results: null text has the statistics of the empty text and a score like any other;
without labels of both kinds each score is the share of 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import lower_ascii, slices, span_hashes, utf8, words

#: Labelled rows that the fit may collect.
SAMPLE_ROWS = 20_000
STATISTICS = ("n_bytes", "n_words", "word_bytes", "upper", "letters", "digits", "symbols", "pipes", "marks", "wide", "stops", "line_bytes", "distinct", "commonest", "marked_words", "shouted_words", "short_words")


def statistics(column: pa.Array) -> list[np.ndarray]:
    """Numbers of each whole text, in the order of STATISTICS."""
    raw, offsets = utf8(column)
    size = np.diff(offsets)

    def share(mask: np.ndarray, of: np.ndarray = size) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask)])
        return (run[offsets[1:]] - run[offsets[:-1]]) / np.maximum(1, of)

    upper = (raw >= 65) & (raw <= 90)
    lower = lower_ascii(raw)
    letter = ((lower >= 97) & (lower <= 122)) | (raw >= 128)
    digit = (raw >= 48) & (raw <= 57)
    stop = (raw == 46) | (raw == 44)
    symbol = (raw > 32) & (raw < 127) & ~letter & ~digit & ~stop
    starts, ends, first = words(lower, offsets)
    n = np.diff(first)
    many = np.maximum(1, n)

    def of_words(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask)])
        return (run[first[1:]] - run[first[:-1]]) / many

    tail = ends - 1
    loud = np.concatenate([[0], np.cumsum(upper)])
    soft = np.concatenate([[0], np.cumsum(letter & ~upper & (raw < 128))])
    hashes = span_hashes(lower, starts, ends)
    distinct, commonest = np.zeros(len(size)), np.zeros(len(size))
    for i in range(len(size)):
        if n[i]:
            h = np.sort(hashes[first[i] : first[i + 1]])
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
            distinct[i], commonest[i] = (len(at) - 1) / n[i], np.diff(at).max() / n[i]
    lines = share(raw == 10, np.ones(len(size))) + 1
    return [
        size.astype(float), n.astype(float), size / many, share(upper), share(letter), share(digit), share(symbol), share(raw == 124), share(raw == 33), share(raw >= 128), share(stop),
        size / lines, distinct, commonest, of_words(symbol[tail]) if len(tail) else np.zeros(len(size)), of_words((loud[ends] - loud[starts] > 0) & (soft[ends] == soft[starts])), of_words(ends - starts <= 3),
    ]


def with_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    schema = df.select(*keep).schema
    for s in STATISTICS:
        schema = schema.add(f"stat_{s}", "double")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, statistics(batch.column(len(keep))))], names=schema.names)

    return df.selectExpr(*[f"`{c}`" for c in keep], f"`{text}` as __text").mapInArrow(task, schema)


Rule = tuple[tuple[int, bool, float], ...]  #: (statistic, whether above, threshold), all of which hold


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) == above
    return out


def tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cut: list[np.ndarray], depth: int, path: Rule = (), least: int = 20) -> list[tuple[Rule, float]]:
    """Paths to all nodes below the root, and at leaves their step (else nan): splits of the greatest gain."""
    value = float(g.sum() / (h.sum() + 1.0))
    best = (1e-3, -1, 0.0)
    if depth and len(g) >= 2 * least:
        base = g.sum() ** 2 / (h.sum() + 1)
        for f, ts in enumerate(cut):
            if not len(ts):
                continue
            at = np.searchsorted(ts, x[:, f], side="left")  # how many thresholds lie below
            gs, hs, ns = (np.cumsum(np.bincount(at, w, len(ts) + 1))[:-1] for w in (g, h, np.ones(len(g))))
            gain = np.where((ns >= least) & (len(g) - ns >= least), gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - base, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(ts[k]))
    if best[1] < 0:
        return [(path, value)] if path else []
    out: list[tuple[Rule, float]] = [(path, np.nan)] if path else []
    above = x[:, best[1]] > best[2]
    for side in (False, True):
        part = above == side
        out += tree(x[part], g[part], h[part], cut, depth - 1, (*path, (best[1], side, best[2])), least)
    return out


@dataclass
class Model:
    rules: list[Rule]
    weights: list[float]
    base: float

    def column(self) -> Column:
        """The score as an expression over stat_ columns."""
        total = F.lit(self.base)
        for rule, w in zip(self.rules, self.weights, strict=True):
            test = F.lit(True)
            for f, above, t in rule:
                stat = F.col(f"stat_{STATISTICS[f]}")
                test &= (stat > t) if above else (stat <= t)
            total = total + F.when(test, w).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def learn(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, steps: int = 600) -> Model:
    """Boost trees, take their paths as rules, and fit lasso logistic weights by accelerated proximal gradients."""
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        return Model([], [], float(np.log((share + 0.01) / (1.01 - share))) if len(y) else 0.0)
    cut = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33), method="lower")) for c in x.T]
    score, rules = np.full(len(y), np.log(share / (1 - share))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        for path, step in tree(x, y - p, p * (1 - p), cut, depth):
            rules.setdefault(tuple(sorted(path)))
            if step == step:
                score[holds(path, x)] += 0.3 * step
    names = list(rules)
    if not names:
        return Model([], [], float(np.log(share / (1 - share))))
    m = np.stack([holds(r, x) for r in names], 1).astype(np.float64)
    live = (m.mean(0) > 0.002) & (m.mean(0) < 0.998)
    names, m = [r for r, k in zip(names, live, strict=True) if k], m[:, live]
    if not names:
        return Model([], [], float(np.log(share / (1 - share))))
    scale = m.std(0)
    mean = m.mean(0)
    z = (m - mean) / scale
    w, b, v, last = np.zeros(z.shape[1]), float(np.log(share / (1 - share))), np.zeros(z.shape[1]), 1.0
    u = np.ones(z.shape[1])
    for _ in range(30):  # the greatest curvature, by power iteration
        u = z.T @ (z @ u)
        u /= np.linalg.norm(u)
    rate = 1 / (0.25 * np.linalg.norm(z @ u) ** 2 / len(y) + 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ v + b)))
        new = v - rate * (z.T @ (p - y) / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        b -= 4 * 0.5 * float((p - y).mean())
        ahead = (1 + np.sqrt(1 + 4 * last * last)) / 2
        v, w, last = new + (last - 1) / ahead * (new - w), new, ahead
    weights = w / scale
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return Model([names[i] for i in used], [float(weights[i]) for i in used], float(b - (weights[used] * mean[used]).sum()))


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", text: str = "text", sample: int = SAMPLE_ROWS) -> Model:
    """Learn from ``labels`` (doc_id, label) and the texts of ``df``, on at most ``sample`` labelled rows."""
    some = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("__label")).dropna().orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample)
    joined = df.select(F.col(doc_id).alias("__own"), F.col(text).alias("__text")).join(F.broadcast(some), F.col("__own") == F.col("__id"))
    joined = joined.withColumn("__row", F.xxhash64("__id", "__text", "__label"))
    rows = with_statistics(joined, "__text", ("__label", "__row")).orderBy("__row").limit(sample).toArrow()  # ids may repeat in either table
    x = np.stack([rows.column(f"stat_{s}").to_numpy() for s in STATISTICS], 1) if rows.num_rows else np.zeros((0, len(STATISTICS)))
    y = rows.column("__label").to_numpy() if rows.num_rows else np.zeros(0)
    order = np.lexsort(np.column_stack([x, y]).T)  # however the rows came in
    return learn(x[order], y[order])


def score(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the score of each whole text."""
    return with_statistics(df, text, keep).select(*keep, model.column().alias("score"))

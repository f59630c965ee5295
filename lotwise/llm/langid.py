"""Language identification by error-correcting output codes.

Each language has a binary codeword. For each bit a classifier over byte trigrams (log-odds of the
languages whose bit is 1 against the rest, from counts over all training texts) gives a margin; the
language whose codeword has the least weighted logistic loss is chosen, and a small lead over the next
is flagged as ambiguous.

Defined results: ``und`` with score 0 for null texts and texts without a letter, or where nothing was
learned; rows with a null label are not learned from; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import slices, utf8

BINS = 1 << 15
#: Lead of the best language's probability over the next below which a prediction is ambiguous.
AMBIGUOUS = 0.1


def normal(raw: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and two-byte Latin letters; anything else in ASCII is a space."""
    out = raw.copy()
    upper = (raw >= 65) & (raw <= 90)
    out[upper] += 32
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3
    out[after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)] += 32
    out[(out < 97) | ((out > 122) & (out < 128))] = 32
    return out


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all trigrams of each text between two spaces, and each text's first (n+1). Every text has one at least."""
    raw, offsets = utf8(column)
    n = len(offsets) - 1
    padded = np.full(len(raw) + 2 * n, 32, np.uint8)
    padded[np.arange(len(raw)) + np.repeat(np.arange(n) * 2 + 1, np.diff(offsets))] = normal(raw)
    padded = np.concatenate([padded, np.full(2, 32, np.uint8)]).astype(np.uint32)
    code = padded[:-2] << np.uint32(16) | padded[1:-1] << np.uint32(8) | padded[2:]
    bins = (code * np.uint32(0x9E3779B1)) >> np.uint32(17)
    bins[code & np.uint32(0xFFFF) == 0x2020] = BINS  # spaces, and what would reach into the next text
    return bins, offsets + 2 * np.arange(n + 1)


def letters(column: pa.Array) -> np.ndarray:
    """Which texts have a letter."""
    raw, offsets = utf8(column)
    lower = raw | np.uint8(32)
    seen = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    has = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~has):
        t = column[int(i)].as_py()
        has[i] = bool(t) and any(c.isalpha() for c in t)
    return has


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: the exhaustive code for up to 5 classes, else the best-spread of some seeded dense codes."""
    if k <= 5:
        bits = max(1, 2 ** (k - 1) - 1)
        code = np.array([[1] * bits] + [[1 if b >> (r - 1) & 1 else -1 for b in range(bits)] for r in range(1, k)])
        return code.reshape(max(1, k), bits) if k else np.ones((1, 1), int)
    rng, best, spread = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (k, int(np.ceil(10 * np.log2(k)))))
        apart = ((code[:, None] != code[None]).sum(2) + np.eye(k, dtype=int) * 10**6).min()
        if apart > spread and (np.abs(code.sum(0)) < k).all():
            best, spread = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and ambiguity of each text."""
        n = len(column)
        if not self.languages:
            return ["und"] * n, np.zeros(n), np.zeros(n, bool)
        bins, first = grams(column)
        counted = np.concatenate([[0], np.cumsum(bins < BINS)])
        size = np.maximum(1, counted[first[1:]] - counted[first[:-1]])
        margins = np.stack([np.add.reduceat(w[bins], first[:-1], dtype=np.float64) for w in self.weights], 1) / np.sqrt(size)[:, None]
        loss = np.zeros((n, len(self.languages)))
        for k, word in enumerate(self.code):
            loss[:, k] = (np.logaddexp(0, -margins * word) * self.trust).sum(1)
        chance = np.exp(loss.min(1, keepdims=True) - loss)
        chance /= chance.sum(1, keepdims=True)
        order = np.sort(chance, 1)
        has = letters(column)
        lead = order[:, -1] - (order[:, -2] if order.shape[1] > 1 else 0)
        names = [self.languages[k] if h else "und" for k, h in zip(loss.argmin(1), has, strict=True)]
        return names, np.where(has, order[:, -1], 0.0), has & (lead < AMBIGUOUS)


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count trigrams of every labelled row. What reaches the driver is one count for each language and bin."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def rows():
            for name, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bin", "n"])
            counts.clear()

        for batch in slices(batches, "__text"):
            names = batch.column(1).to_pylist()
            bins, first = grams(batch.column(0))
            owner = np.repeat(np.arange(len(names)), np.diff(first))
            kinds = sorted(set(names))
            kind = np.searchsorted(kinds, names)
            real = bins < BINS
            found = np.bincount(kind[owner[: len(bins)]][real[: len(owner)]] * BINS + bins[: len(owner)][real[: len(owner)]], minlength=len(kinds) * BINS).reshape(len(kinds), BINS)
            for name, c in zip(kinds, found, strict=True):
                counts[name] = counts[name] + c if name in counts else c
            if len(counts) > 256:
                yield from rows()
        yield from rows()

    learned = df.where(F.col(lang).isNotNull()).selectExpr(f"`{text}` as __text", f"`{lang}` as __lang")
    found = learned.mapInArrow(task, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((max(1, len(names)), BINS))
    if names:
        counts[np.searchsorted(names, found.column("lang").to_pylist()), found.column("bin").to_numpy()] = found.column("n").to_numpy()
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    code = codewords(len(names))
    weights, trust = [], []
    for bit in code.T:
        one, none = share[bit > 0].mean(0) if (bit > 0).any() else share.mean(0), share[bit < 0].mean(0) if (bit < 0).any() else share.mean(0)
        w = np.log(one / none)
        trust.append(max(0.05, float(((share * w).sum(1) * bit).min())))
        weights.append(np.append(w, 0.0).astype(np.float32))
    return Model(names, code, np.array(weights), np.array(trust) / max(np.mean(trust), 1e-9))


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, lang_pred, score and ambiguous, from each whole text alone."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bins x bits numbers, whatever the input
    schema = df.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            names, score, unclear = shared.value.predict(batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(score), pa.array(unclear)], names=[*keep, "lang_pred", "score", "ambiguous"])

    return df.selectExpr(*[f"`{c}`" for c in keep], f"`{text}` as __text").mapInArrow(task, schema)

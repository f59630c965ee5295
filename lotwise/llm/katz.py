"""Language-model scoring by Katz backoff over word bigrams and unigrams.

Counts of 1 to 5 are discounted by Good-Turing; a context's freed mass goes to the words not seen after
it, in proportion to the unigram model, with a weight that makes each distribution sum to exactly one.
The unigram model backs off to a single unknown type, so there are V + 1 types for V training tokens.

The corpus is cut into blocks of documents that carry their tokens as numbers into a local vocabulary.
Unigram counts live in tables partitioned by word, bigram counts in tables partitioned by context (a very
frequent context is split by its follower). A block sends each partition its distinct n-grams once, with
what it has learned of their words, and gets their counts back in the same order; the recursion bigram ->
unigram -> unknown then runs per token inside the block. Only totals and counts of counts up to ``LOW`` + 1,
a few numbers at any size, reach the driver.

Defined results: null text is empty and has the end token alone; without training tokens every token is
unknown with probability one; repeated rows are scored, and learned from, each for itself; ids may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.llm.common import mix, shared_checkpoint, slices, word_lists

#: Tokens of a block, distinct n-grams of a partition (about), and occurrences of a context's part.
BLOCK_TOKENS, PART_ENTRIES, CONTEXT_PART = 2 << 20, 1 << 20, 1 << 18
#: Counts up to this are discounted.
LOW = 5
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A text's end: the first word of each vocabulary. No word is empty.
END = b""
#: A word: 96 bits of BLAKE2, so that even ten billion words share none by chance.
WORD = np.dtype([("a", "<u8"), ("b", "<u4")])
#: Names of the totals among counts of counts.
TOKENS, TYPES = -1, -2
_zstd = "zstd"


def squeeze(x: np.ndarray) -> bytes:
    """Packed numbers: byte planes, so that high bytes, mostly equal, shrink together."""
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() if x.size else b""
    return np.uint32(len(raw)).tobytes() + pa.compress(raw, codec=_zstd, asbytes=True)


def spread(raw: bytes, kind: type) -> np.ndarray:
    size = int(np.frombuffer(raw[:4], np.uint32)[0])
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(raw[4:], size, codec=_zstd, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def discounts(n: dict[int, int]) -> np.ndarray:
    """Factors for counts 0..LOW from counts of counts: Katz's renormalised Good-Turing, else an absolute discount of a half."""
    d = np.ones(LOW + 1)
    top = (LOW + 1) * n.get(LOW + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, LOW + 1):
        x = ((r + 1) * n.get(r + 1, 0) / n[r] / r - top) / (1 - top) if n.get(r) and top < 1 else 0.0
        d[r] = x if 0 < x < 1 else 1 - 0.5 / r
    return d


def factor(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= LOW, d[np.minimum(c, LOW)], 1.0)


class Unigrams:
    """The unigram model, from the numbers of tokens and types and of types that occur once, twice and so on."""

    def __init__(self, of: dict[int, int]):
        self.total, self.types = of.get(TOKENS, 0), of.get(TYPES, 0)
        self.d = discounts(of)
        freed = sum((1 - self.d[r]) * r * of.get(r, 0) for r in range(1, LOW + 1))
        kept = 1 - freed / self.total if self.total else 0.0
        if self.total and kept > 1 - 1e-12:  # nothing rare: one part in total + 1 goes to the unknown
            self.shrink = self.total / (self.total + 1)
        else:
            self.shrink = 1.0
        self.unknown = 1 - kept * self.shrink

    def chance(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, factor(c, self.d) * c / max(1, self.total) * self.shrink, self.unknown)


def counts_of_counts(rows: DataFrame) -> dict[int, int]:
    """LOW + 1 numbers, and totals where there are any."""
    return {r["value"]: r["n"] for r in rows.where("value is not null").groupBy("value").agg(F.sum("many").alias("n")).collect()}


def low_counts(total: np.ndarray) -> tuple[list[int], list[int]]:
    value, many = np.unique(total[(total > 0) & (total <= LOW + 1)], return_counts=True)
    return value.tolist(), many.tolist()


def blocks(df: DataFrame, doc_id: str, text: str, train: Column) -> DataFrame:
    """One row per block: its documents, and their tokens as numbers into its vocabulary, whose words are ``WORD``."""
    kind = df.schema[doc_id].dataType
    fields = [("block", T.LongType()), ("ids", T.ArrayType(kind)), *((c, T.BinaryType()) for c in ("sizes", "train", "tokens", "vocabulary", "seen")), ("entries", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = n = len(self)
                return n

        numbers = Numbers({END: 0})

        def out() -> pa.RecordBatch:
            ids = pa.chunked_array([h[0] for h in held]).combine_chunks()
            sizes, learn = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            tokens = np.concatenate([x for h in held for x in h[3]])
            vocabulary = np.frombuffer(b"".join(blake2b(w, digest_size=12).digest() for w in numbers), WORD)
            many = len(numbers)
            seen = np.bincount(tokens, np.repeat(learn, sizes), many).astype(np.uint32)
            held.clear()
            numbers.clear()
            numbers[END] = 0
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([block]), lists, *(pa.array([squeeze(x)], pa.binary()) for x in (sizes.astype(np.uint32), learn.astype(np.uint8), tokens, vocabulary, seen)), pa.array([many])], names=schema.names)

        end = np.zeros(1, np.uint32)
        for batch in slices(batches, "__text"):
            tokens, sizes = [], []
            for raw in batch.column(2).cast(pa.binary()).to_pylist():
                own = [np.fromiter(map(numbers.__getitem__, some), np.uint32, len(some)) for some in word_lists(raw or b"")]
                tokens += [*own, end]
                sizes.append(sum(map(len, own)) + 1)
            held.append((batch.column(0), np.array(sizes), np.asarray(batch.column(1).fill_null(False)), tokens))
            size += sum(sizes)
            if size >= BLOCK_TOKENS:
                yield out()
                block, size = block + 1, 0
        if held:
            yield out()

    return df.select(F.col(doc_id).alias("id"), train.alias("train"), F.col(text).alias("__text")).mapInArrow(task, schema)


def words_of(vocabulary: bytes) -> np.ndarray:
    return spread(vocabulary, WORD)


def deal(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by part, and where each part ends."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def unigram_tables(state: DataFrame, parts: int) -> DataFrame:
    """Rows with block: numbers and counts of that block's words of a partition. Rows with value: counts of counts and totals of the partition.

    A word's number is its rank in its partition, by count, times parts plus partition.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, vocabulary, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v, n = words_of(vocabulary), spread(seen, np.uint32)
                order, cut = deal(v["a"] % np.uint64(parts), parts)
                has = np.flatnonzero(np.diff(cut))
                v, n = v[order], n[order]
                yield pa.RecordBatch.from_arrays([pa.array(has), pa.array([block] * len(has)), *(pa.array([squeeze(x[cut[p] : cut[p + 1]]) for p in has], pa.binary()) for x in (v, n))], names=["part", "block", "words", "seen"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        rows = [(b, words_of(w), spread(n, np.uint32)) for b, w, n in zip(*(table.column(c).to_pylist() for c in ("block", "words", "seen")), strict=True)]
        words = np.concatenate([r[1] for r in rows])
        order = np.lexsort((words["b"], words["a"]))
        where = np.empty(len(words), np.int64)
        where[order] = np.cumsum(np.concatenate([[False], words[order][1:] != words[order][:-1]]))
        total = np.bincount(where, np.concatenate([r[2] for r in rows])).astype(np.int64)
        order = np.argsort(-total, kind="stable")
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        number = np.where(total > 0, rank * np.uint64(parts) + np.uint64(part), NONE)[where]
        count = total.astype(np.uint64)[where]
        value, many = low_counts(total)
        value, many = [*value, TOKENS, TYPES], [*many, int(total.sum()), int((total > 0).sum())]
        at, blobs, counted = 0, [], []
        for _, w, _ in rows:
            blobs.append(squeeze(number[at : at + len(w)]))
            counted.append(squeeze(count[at : at + len(w)]))
            at += len(w)
        k = len(value)
        none = [None] * k
        return pa.table({
            "block": pa.array([r[0] for r in rows] + none, pa.int64()), "part": pa.array([part] * (len(rows) + k), pa.int64()), "numbers": pa.array(blobs + none, pa.binary()),
            "counted": pa.array(counted + none, pa.binary()), "value": pa.array([None] * len(rows) + value, pa.int64()), "many": pa.array([None] * len(rows) + many, pa.int64()),
        })

    sent = state.select("block", "vocabulary", "seen").mapInArrow(send, "part long, block long, words binary, seen binary")
    return sent.groupBy("part").applyInArrow(count, "block long, part long, numbers binary, counted binary, value long, many long")


class Block:
    """A block's documents with its words' numbers and counts, and its distinct bigrams of words known from training, in the order of partitions."""

    def __init__(self, state: pa.Table, replies: pa.Table, parts: int, total: int, contexts: int):
        one = {c: state.column(c)[0].as_py() for c in ("sizes", "train", "tokens", "vocabulary")}
        self.ids = state.column("ids").combine_chunks().flatten()
        self.sizes, self.train = spread(one["sizes"], np.uint32).astype(np.int64), spread(one["train"], np.uint8)
        tokens, v = spread(one["tokens"], np.uint32), words_of(one["vocabulary"])
        order, cut = deal(v["a"] % np.uint64(parts), parts)
        number, counted = np.full(len(v), NONE, np.uint64), np.zeros(len(v), np.int64)
        for p, blob, c in zip(*(replies.column(x).to_pylist() for x in ("part", "numbers", "counted")), strict=True):
            mine = order[cut[p] : cut[p + 1]]
            number[mine], counted[mine] = spread(blob, np.uint64), spread(c, np.uint64).astype(np.int64)
        self.count = counted[tokens]
        begin = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        before = np.concatenate([[0], tokens[:-1]]).astype(np.int64)
        before[begin] = 0  # a text begins after an end
        known = number[before] != NONE
        self.context_count = counted[before]
        # a follower that training lacks is asked for too: its context's weight is needed
        follower = np.where(number[tokens] != NONE, tokens.astype(np.int64), len(v))
        key = before[known].astype(np.uint64) << np.uint64(32) | follower[known].astype(np.uint64)
        pair, inverse = np.unique(key, return_inverse=True)
        self.pair_of = np.full(len(tokens), -1)
        self.pair_of[known] = inverse
        h, w = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        number, counted = np.append(number, NONE), np.append(counted, 0)
        self.h, self.w, self.word_count = number[h], number[w], counted[w].astype(np.uint64)
        self.seen = np.bincount(inverse, np.repeat(self.train, self.sizes)[known], len(pair)).astype(np.uint32)
        split = 1 + counted[h] // max(CONTEXT_PART, total // contexts)
        sub = mix(self.w) % split.astype(np.uint64)
        # every part of a split context answers, whether or not this block has followers there
        one = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]) & (split > 1)) if len(pair) else np.zeros(0, int)
        probe = np.repeat(self.h[one], split[one])
        nth = np.arange(len(probe)) - np.repeat(np.cumsum(split[one]) - split[one], split[one])
        self.h, self.w = np.concatenate([self.h, probe]), np.concatenate([self.w, np.full(len(probe), NONE, np.uint64)])
        self.seen = np.concatenate([self.seen, np.zeros(len(probe), np.uint32)])
        self.word_count = np.concatenate([self.word_count, np.zeros(len(probe), np.uint64)])
        sub = np.concatenate([sub, nth.astype(np.uint64)])
        part = mix(self.h * np.uint64(0x9E3779B97F4A7C15) + sub) % np.uint64(contexts)
        self.order, self.cut = deal(part, contexts)


def bigram_tables(state: DataFrame, numbers: DataFrame, parts: int, contexts: int, unigrams: Unigrams) -> DataFrame:
    """Rows with block: counts of its bigrams of a partition, and each context's n_1..n_LOW and seen unigram mass. Rows with value: counts of counts."""
    total_tokens = unigrams.total

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("h", "w", "seen", "word_count")
        if not len(left):
            return pa.table({"part": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in names}})
        b = Block(left, right, parts, total_tokens, contexts)
        has = np.flatnonzero(np.diff(b.cut))
        cols = {c: pa.array([squeeze(getattr(b, c)[b.order[b.cut[p] : b.cut[p + 1]]]) for p in has], pa.binary()) for c in names}
        return pa.table({"part": pa.array(has), "block": pa.array([key[0].as_py()] * len(has), pa.int64()), **cols})

    def count(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        kinds = {"h": np.uint64, "w": np.uint64, "seen": np.uint32, "word_count": np.uint64}
        blocks_ = table.column("block").to_pylist()
        cols = {c: [spread(x, k) for x in table.column(c).to_pylist()] for c, k in kinds.items()}
        h, w, n, counted = (np.concatenate(cols[c]) for c in kinds)
        order = np.lexsort((w, h))
        h_, w_ = h[order], w[order]
        head = np.concatenate([[True], (h_[1:] != h_[:-1]) | (w_[1:] != w_[:-1])])
        where = np.empty(len(order), np.int64)
        where[order] = np.cumsum(head) - 1
        firsts = order[head]
        total = np.bincount(where, n, len(firsts)).astype(np.int64)
        context, at = np.unique(h[firsts], return_inverse=True)
        chance = np.where(total > 0, unigrams.chance(counted[firsts].astype(np.int64)), 0.0)
        low = np.stack([np.bincount(at, total == r, len(context)) for r in range(1, LOW + 1)], 1).astype(np.uint32)
        mass = np.bincount(at, chance, len(context))
        value, many = low_counts(total)
        counts = total[where].astype(np.uint64)
        first, a, b, c = 0, [], [], []
        for x in cols["h"]:
            a.append(squeeze(counts[first : first + len(x)]))
            mine = np.searchsorted(context, np.unique(x))
            b.append(squeeze(low[mine].T.ravel()))
            c.append(squeeze(mass[mine]))
            first += len(x)
        k = len(value)
        none = [None] * k
        return pa.table({
            "block": pa.array(blocks_ + none, pa.int64()), "part": pa.array([part] * (len(blocks_) + k), pa.int64()), "counts": pa.array(a + none, pa.binary()), "low": pa.array(b + none, pa.binary()),
            "mass": pa.array(c + none, pa.binary()), "value": pa.array([None] * len(blocks_) + value, pa.int64()), "many": pa.array([None] * len(blocks_) + many, pa.int64()),
        })

    sent = state.groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(send, "part long, block long, h binary, w binary, seen binary, word_count binary")
    return sent.groupBy("part").applyInArrow(count, "block long, part long, counts binary, low binary, mass binary, value long, many long")


def score(df: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every text, learned from the rows where ``train`` holds."""
    state = shared_checkpoint(blocks(df, doc_id, text, train))
    entries = state.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("n")).first()["n"]
    parts = max(16, -(-entries // PART_ENTRIES))
    contexts = 4 * parts
    table = shared_checkpoint(unigram_tables(state, parts))
    u = Unigrams(counts_of_counts(table))
    numbers = table.where("block is not null").select("block", "part", "numbers", "counted")
    pairs = shared_checkpoint(bigram_tables(state, numbers, parts, contexts, u))
    d = discounts(counts_of_counts(pairs))
    empty = F.lit(None).cast("binary")
    replies = numbers.withColumns({"counts": empty, "low": empty, "mass": empty}).unionByName(pairs.where("block is not null").select("block", "part", "counts", "low", "mass").withColumns({"numbers": empty, "counted": empty}))

    def rate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.schema.field("ids").type.value_type
        out = pa.schema([("id", kind), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not len(left):
            return out.empty_table()
        unary = right.filter(right.column("numbers").is_valid())
        b = Block(left, unary, parts, u.total, contexts)
        count = np.zeros(len(b.h), np.int64)
        context, of = np.unique(b.h, return_inverse=True)
        low, mass = np.zeros((len(context), LOW)), np.zeros(len(context))
        binary = right.filter(right.column("counts").is_valid())
        for p, c, lo, m in zip(*(binary.column(x).to_pylist() for x in ("part", "counts", "low", "mass")), strict=True):
            rows = b.order[b.cut[p] : b.cut[p + 1]]
            count[rows] = spread(c, np.uint64).astype(np.int64)
            at = np.searchsorted(context, np.unique(b.h[rows]))  # parts of a split context add up
            low[at] += spread(lo, np.uint32).reshape(LOW, -1).T
            mass[at] += spread(m, np.float64)
        freed = low @ (np.arange(1, LOW + 1) * (1 - d[1:]))
        pair = b.pair_of
        has = np.flatnonzero(pair >= 0)
        c, h, n = count[pair[has]], of[pair[has]], b.context_count[has]
        single = u.chance(b.count)
        chance = single.copy()
        # contexts without a rare follower free one part in n + 1
        tight = freed[h] <= 0
        free = np.where(tight, 1 / (n + 1), freed[h] / np.maximum(n, 1))
        seen = factor(c, d) * c / np.maximum(n, 1) * np.where(tight, n / (n + 1), 1.0)
        chance[has] = np.where(c > 0, seen, free / (1 - mass[h]) * single[has])
        first = np.concatenate([[0], np.cumsum(b.sizes)[:-1]])
        base = np.log10((b.count + 1) / (u.total + u.types + 1))
        log = np.log10(np.maximum(chance, 1e-300))
        total = [np.add.reduceat(x, first) for x in ((b.count > 0).astype(np.int64), base, log)]
        return pa.table({"id": b.ids, "n_tokens": pa.array(b.sizes), "n_known": pa.array(total[0]), "base_score": pa.array(total[1]), "score": pa.array(total[2])}).cast(out)

    kind = df.schema[doc_id].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    rated = state.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(rate, schema)
    return rated.select(F.col("id").alias(doc_id), "n_tokens", "n_known", F.lit(u.total).cast("long").alias("train_tokens"), "base_score", "score")

"""Phrase collocations: phrases whose words meet more often than chance, for each language.

Counting goes up by levels, and only what is Apriori-safe goes on: a pair of words is a candidate if both
words are frequent, three words if both of their pairs are. The corpus is cut into blocks of documents that
hold their tokens as numbers into a vocabulary of their own. For each level a block bincounts its candidates
and sends every shard of the candidate space its distinct ones once, with their counts; so a very common
phrase costs a shard one entry a block. A shard builds a minimal perfect hash over its candidates, keeps their
keys by slot and compares them (no fingerprint decides), bincounts each block's part into an array over the
slots, and sums the arrays as a tree. Words are known by slot and shard from then on, and a phrase's parts are
looked up by those numbers.

Defined results: null text is empty, null language is ``und``; repeated rows count each for itself; ids and
further columns are not read. A break character ends a piece, and no phrase crosses pieces or documents. The
score is exact for counts up to 10**15. No rows: no phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import mix, shared_checkpoint, slices
from lotwise.llm.katz import deal, spread, squeeze

#: Tokens of a block, distinct candidates of a shard (about), and bytes of text that are split at once.
BLOCK_TOKENS, SHARD_ENTRIES, STEP_BYTES = 1 << 20, 1 << 18, 1 << 20
#: Groups in which a language's best are found before they meet.
SALTS = 256
#: floor(1000000 * a * a / (l * r)) in exact decimals; products may pass 64 bits, the quotient is at most a million.
SCORE = "cast(cast({a} as decimal(16,0)) * cast({a} as decimal(16,0)) * cast(1000000 as decimal(7,0)) div (cast({l} as decimal(16,0)) * cast({r} as decimal(16,0))) as long)"
#: No word: a piece's end, or a word that is too rare.
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_END = b"\xff"  # in no UTF-8 text
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _END * 10)


class SlotHash:
    """A minimal perfect hash of distinct pairs of 64-bit numbers, in levels: keys that are alone in a cell stay, the others go one level down."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # occupied cells, and how many came before each
        self.n, before = len(a), 0
        self.a, self.b = np.empty(len(a), np.uint64), np.empty(len(a), np.uint64)
        while len(a):
            cells = 2 * len(a)
            at = self._cell(a, b, len(self.levels), cells)
            alone = np.bincount(at, minlength=cells) == 1
            rank = before + np.cumsum(alone) - alone
            self.levels.append((alone, rank))
            here = alone[at]
            self.a[rank[at[here]]], self.b[rank[at[here]]] = a[here], b[here]
            before += int(here.sum())
            a, b = a[~here], b[~here]

    @staticmethod
    def _cell(a: np.ndarray, b: np.ndarray, level: int, cells: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = mix(mix(a + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) ^ (b * np.uint64(0xD6E8FEB86659FD93)))
        return (x % np.uint64(cells)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Each key's slot, or -1 where the key stored there is another."""
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._cell(a[left], b[left], level, len(alone))
            here = alone[at]
            slot = rank[at[here]]
            same = (self.a[slot] == a[left[here]]) & (self.b[slot] == b[left[here]])
            out[left[here][same]] = slot[same]
            left = left[~here]
        return out


def freed() -> None:
    """Workers live on between groups, and Arrow keeps what it has freed."""
    pa.default_memory_pool().release_unused()


def tree_sum(arrays: Iterator[np.ndarray]) -> np.ndarray:
    """Sum arrays in pairs of equal height, holding one for each height."""
    held: list[tuple[int, np.ndarray]] = []
    for x in arrays:
        height = 0
        while held and held[-1][0] == height:
            x, height = held.pop()[1] + x, height + 1
        held.append((height, x))
    while len(held) > 1:
        (_, x), (height, y) = held.pop(), held.pop()
        held.append((height, x + y))
    return held[0][1]


def keys_of(words: list[bytes]) -> np.ndarray:
    """128 bits that place each word; its bytes are compared besides."""
    return np.frombuffer(b"".join(blake2b(w, digest_size=16).digest() for w in words), np.uint64)


def halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.ascontiguousarray(keys[::2]), np.ascontiguousarray(keys[1::2])


def parts_of(raw: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words and piece ends of a text, about ``STEP_BYTES`` at a time; steps end between words."""
    raw = raw.lower().translate(_BREAKS)
    at = 0
    while at < len(raw):
        stop = at + STEP_BYTES
        if stop < len(raw):
            gaps = [i for c in (b" ", b"\t", _END) if (i := raw.find(c, stop)) >= 0]
            stop = min(gaps, default=len(raw))
        yield raw[at:stop].replace(_END, b" \xff ").split()
        at = stop


def blocks(df: DataFrame, text: str, lang: str) -> DataFrame:
    """Rows of blocks: tokens as numbers into a vocabulary of (language, word), 0 for a piece's end, and how often each occurs."""
    schema = "block long, tokens binary, words array<binary>, keys binary, seen binary, entries long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        numbers: dict[bytes, dict[bytes, int]] = {}
        names: list[bytes] = []
        held: list[np.ndarray] = []
        size = 0

        class Numbers(dict):
            def __init__(self, lang: bytes):
                super().__init__({_END: 0})
                self.lang = lang

            def __missing__(self, word: bytes) -> int:
                names.append(self.lang + b" " + word)  # words have no space
                self[word] = n = len(names)
                return n

        def out() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            seen = np.bincount(tokens, minlength=len(names) + 1)[1:].astype(np.uint32)
            blobs = [pa.array([squeeze(x)], pa.binary()) for x in (tokens, keys_of(names), seen)]
            row = [pa.array([block]), blobs[0], pa.array([names], pa.list_(pa.binary())), *blobs[1:], pa.array([len(names)], pa.int64())]
            return pa.RecordBatch.from_arrays(row, names=["block", "tokens", "words", "keys", "seen", "entries"])

        for batch in slices(batches, "__text"):
            for name, raw in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if name not in numbers:
                    numbers[name] = Numbers(name)
                use = numbers[name].__getitem__
                for words in parts_of(raw):
                    held.append(np.fromiter(map(use, words), np.uint32, len(words)))
                    size += len(words)
                held.append(np.zeros(1, np.uint32))
                size += 1
                if size >= BLOCK_TOKENS:
                    yield out()
                    block, size = block + 1, 0
                    numbers, names, held = {}, [], []
        if held:
            yield out()

    asked = df.select(F.coalesce(F.col(lang), F.lit("und")).alias("__lang"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return asked.mapInArrow(task, schema)


def shard_of(a: np.ndarray, b: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b)) % np.uint64(shards)


def counted(hashes: SlotHash, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The total of each slot, and each part's slots."""
    slots = [hashes.find(a, b) for a, b, _ in parts]
    total = tree_sum(np.bincount(s, n, hashes.n).astype(np.int64) for s, (_, _, n) in zip(slots, parts, strict=True))
    return total, slots


def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, and where each was seen first."""
    order = np.lexsort((b, a))
    head = np.ones(len(a), bool)
    head[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return a[order[head]], b[order[head]], order[head]


def word_tables(state: DataFrame, shards: int, least: int) -> DataFrame:
    """Rows with block: the numbers of its words of a shard, in the order sent. Rows without: a shard's frequent words, and its tokens by language."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, keys, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                order, cut = deal(shard_of(*halves(spread(keys, np.uint64)), shards), shards)
                n = spread(seen, np.uint32)[order]
                has = np.flatnonzero(np.diff(cut))
                sent = [pa.array([[words[i] for i in order[cut[s] : cut[s + 1]]] for s in has], pa.list_(pa.binary())), pa.array([squeeze(n[cut[s] : cut[s + 1]]) for s in has], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(has), pa.array([block] * len(has), pa.int64()), *sent], names=["shard", "block", "words", "seen"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        blocks_ = table.column("block").to_pylist()
        names = table.column("words").to_pylist()
        keys = [halves(keys_of(x)) for x in names]
        a, b, first = distinct(*(np.concatenate([k[i] for k in keys]) for i in (0, 1)))
        hashes = SlotHash(a, b)
        flat = [w for x in names for w in x]
        stored: list[bytes] = [b""] * hashes.n
        for slot, i in zip(hashes.find(a, b).tolist(), first.tolist(), strict=True):
            stored[slot] = flat[i]
        parts = [(*k, spread(x, np.uint32)) for k, x in zip(keys, table.column("seen").to_pylist(), strict=True)]
        total, slots = counted(hashes, parts)
        for x, s in zip(names, slots, strict=True):
            if any(stored[i] != w for i, w in zip(s.tolist(), x, strict=True)):
                raise ValueError("two words of one 128-bit key")
        freed()
        number = np.where(total >= least, np.arange(hashes.n, dtype=np.uint64) * np.uint64(shards) + np.uint64(shard), NONE)
        often = np.flatnonzero(total >= least).tolist()
        tokens: dict[str, int] = {}
        for w, n in zip(stored, total.tolist(), strict=True):
            lang = w.rpartition(b" ")[0].decode()
            tokens[lang] = tokens.get(lang, 0) + n
        cut = [stored[i].rpartition(b" ") for i in often]
        rows = [pa.array([*blocks_, None], pa.int64()), pa.array([shard] * (len(blocks_) + 1), pa.int64()), pa.array([*(squeeze(number[s]) for s in slots), None], pa.binary())]
        lists = [
            pa.array([None] * len(blocks_) + [[(int(number[i]), c[0].decode(), c[2].decode(), int(total[i])) for i, c in zip(often, cut, strict=True)]], pa.list_(_WORD)),
            pa.array([None] * len(blocks_) + [list(tokens.items())], pa.list_(_TOKENS)),
        ]
        return pa.table([*rows, *lists], names=["block", "shard", "numbers", "often", "tokens"])

    sent = state.select("block", "words", "keys", "seen").mapInArrow(send, "shard long, block long, words array<binary>, seen binary")
    return sent.groupBy("shard").applyInArrow(
        count, "block long, shard long, numbers binary, often array<struct<id:long,lang:string,word:string,f:long>>, tokens array<struct<lang:string,n:long>>"
    )


_WORD = pa.struct([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])
_TOKENS = pa.struct([("lang", pa.string()), ("n", pa.int64())])


class Block:
    """A block's candidates of two words, and of three once the counts of two are known, in the order of shards."""

    def __init__(self, state: pa.Table, replies: pa.Table, word_shards: int, shards: int):
        tokens = spread(state.column("tokens")[0].as_py(), np.uint32).astype(np.int64)
        words = halves(spread(state.column("keys")[0].as_py(), np.uint64))
        order, cut = deal(shard_of(*words, word_shards), word_shards)
        self.number = np.full(len(order) + 1, NONE, np.uint64)
        for s, blob in zip(replies.column("shard").to_pylist(), replies.column("numbers").to_pylist(), strict=True):
            self.number[order[cut[s] : cut[s + 1]] + 1] = spread(blob, np.uint64)
        self.tokens, self.shards = tokens, shards
        frequent = self.number[tokens] != NONE
        self.begins = np.flatnonzero(frequent[:-1] & frequent[1:])
        pair, self.pair_of = np.unique(tokens[self.begins] << 32 | tokens[self.begins + 1], return_inverse=True)
        self.a, self.b = self.number[pair >> 32], self.number[pair & 0xFFFFFFFF]
        self.seen = np.bincount(self.pair_of, minlength=len(pair)).astype(np.uint32)
        self.order, self.cut = deal(shard_of(self.a, self.b, shards), shards)

    def threes(self, replies: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(first, second, third, seen) of three words both of whose pairs are frequent, dealt by shard: columns, order and cuts."""
        often = np.zeros(len(self.a), bool)
        for s, blob in zip(replies.column("shard").to_pylist(), replies.column("often").to_pylist(), strict=True):
            often[self.order[self.cut[s] : self.cut[s + 1]]] = spread(blob, np.uint8).astype(bool)
        at = np.full(len(self.tokens) + 1, -1)
        at[self.begins[often[self.pair_of]]] = self.pair_of[often[self.pair_of]]
        i = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
        three, seen = np.unique(at[i] << 32 | self.tokens[i + 2], return_counts=True)
        first, third = three >> 32, self.number[three & 0xFFFFFFFF]
        cols = [self.a[first], self.b[first], third, seen.astype(np.uint32)]
        return cols, *deal(shard_of(mix(cols[0]) ^ cols[1], third, self.shards), self.shards)


def dealt(cols: list[np.ndarray], order: np.ndarray, cut: np.ndarray, block: int, names: tuple[str, ...]) -> pa.Table:
    has = np.flatnonzero(np.diff(cut))
    blobs = {n: pa.array([squeeze(c[order[cut[s] : cut[s + 1]]]) for s in has], pa.binary()) for n, c in zip(names, cols, strict=True)}
    return pa.table({"shard": pa.array(has, pa.int64()), "block": pa.array([block] * len(has), pa.int64()), **blobs})


def pair_tables(state: DataFrame, words: DataFrame, word_shards: int, shards: int, least: int) -> DataFrame:
    """Rows with block: which of its candidates of a shard are frequent. Rows without: the shard's frequent pairs and their counts."""

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return dealt([], np.zeros(0, int), np.zeros(1, int), 0, ())
        b = Block(left, right, word_shards, shards)
        return dealt([b.a, b.b, b.seen], b.order, b.cut, key[0].as_py(), ("a", "b", "seen"))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        parts = [tuple(spread(x, k) for x, k in zip(row, (np.uint64, np.uint64, np.uint32), strict=True)) for row in zip(*(table.column(c).to_pylist() for c in ("a", "b", "seen")), strict=True)]
        a, b, _ = distinct(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
        hashes = SlotHash(a, b)
        total, slots = counted(hashes, parts)
        often = total >= least
        freed()
        n, blocks_ = len(parts), table.column("block").to_pylist()
        lists = {c: pa.array([None] * n + [x[often].astype(np.int64)], pa.list_(pa.int64())) for c, x in (("a", hashes.a), ("b", hashes.b), ("n", total))}
        return pa.table({"block": pa.array([*blocks_, None], pa.int64()), "shard": pa.array([key[0].as_py()] * (n + 1), pa.int64()), "often": pa.array([*(squeeze(often[s].astype(np.uint8)) for s in slots), None], pa.binary()), **lists})

    sent = state.select("block", "tokens", "keys").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(send, "shard long, block long, a binary, b binary, seen binary")
    return sent.groupBy("shard").applyInArrow(count, "block long, shard long, often binary, a array<long>, b array<long>, n array<long>")


def three_tables(state: DataFrame, replies: DataFrame, word_shards: int, shards: int, least: int) -> DataFrame:
    """Frequent phrases of three words: a, b, c, n."""

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return dealt([], np.zeros(0, int), np.zeros(1, int), 0, ())
        block = Block(left, right.filter(right.column("numbers").is_valid()), word_shards, shards)
        return dealt(*block.threes(right.filter(right.column("often").is_valid())), key[0].as_py(), ("a", "b", "c", "seen"))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        kinds = (np.uint64, np.uint64, np.uint64, np.uint32)
        parts = [tuple(spread(x, k) for x, k in zip(row, kinds, strict=True)) for row in zip(*(table.column(c).to_pylist() for c in ("a", "b", "c", "seen")), strict=True)]
        a, b, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
        # the first pair's slot stands for its two words
        x, y, _ = distinct(a, b)
        pairs = SlotHash(x, y)
        first = pairs.find(a, b).astype(np.uint64)
        cut = np.cumsum([0, *(len(p[0]) for p in parts)])
        third = [(first[i:j], c[i:j], p[3]) for i, j, p in zip(cut[:-1], cut[1:], parts, strict=True)]
        x, y, _ = distinct(first, c)
        hashes = SlotHash(x, y)
        total, _ = counted(hashes, third)
        often = total >= least
        head = hashes.a[often].astype(np.int64)
        freed()
        return pa.table({k: v.astype(np.int64) for k, v in (("a", pairs.a[head]), ("b", pairs.b[head]), ("c", hashes.b[often]), ("n", total[often]))})

    sent = state.select("block", "tokens", "keys").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(send, "shard long, block long, a binary, b binary, c binary, seen binary")
    return sent.groupBy("shard").applyInArrow(count, "a long, b long, c long, n long")


def best(rows: DataFrame, k: int) -> DataFrame:
    """Each language's first k by score, count and phrase: in salted groups first, so that no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = rows.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = part.withColumn("__n", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("__n") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= k).drop("__salt", "__n")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, inside: int = 50, k: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's k best phrases of two or three words found ``least`` times or more.

    A phrase goes where a longer candidate around it has ``inside`` percent of its occurrences or more.
    """
    state = shared_checkpoint(blocks(df, text, lang))
    entries = state.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("blocks")).first()
    word_shards = max(16, -(-entries["n"] // SHARD_ENTRIES))
    shards = max(32, -(-entries["blocks"] * BLOCK_TOKENS // 2 // SHARD_ENTRIES))  # a block has fewer distinct candidates than tokens
    table = shared_checkpoint(word_tables(state, word_shards, least))
    numbers = table.where("block is not null").select("block", "shard", "numbers")
    pairs = shared_checkpoint(pair_tables(state, numbers, word_shards, shards, least))
    none = F.lit(None).cast("binary")
    replies = numbers.withColumn("often", none).unionByName(pairs.where("block is not null").select("block", "shard", "often").withColumn("numbers", none))
    threes = shared_checkpoint(three_tables(state, replies, word_shards, shards, least))

    word = table.where("block is null").select(F.explode("often").alias("w")).select("w.*")
    total = table.where("block is null").select(F.explode("tokens").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n"))
    two = pairs.where("block is null").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.a", "p.b", F.col("p.n").alias("f"))
    left, right = (word.select(F.col("id").alias(i), *([F.col("lang")] if i == "a" else []), F.col("word").alias(f"word_{i}"), F.col("f").alias(f"f_{i}")) for i in ("a", "b"))
    two = shared_checkpoint(two.join(left, "a").join(right, "b"))

    # a longer candidate's count, for the two pairs inside it
    over = threes.select(F.col("a"), F.col("b"), "n").unionByName(threes.select(F.col("b").alias("a"), F.col("c").alias("b"), "n")).groupBy("a", "b").agg(F.max("n").alias("around"))
    pair_rows = two.join(over, ["a", "b"], "left").where(f"around is null or 100 * around < {inside} * f").select(
        "lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("f").alias("a"), F.col("f_a").alias("l"), F.col("f_b").alias("r"), F.expr(SCORE.format(a="f", l="f_a", r="f_b")).alias("score")
    )
    front = two.select("a", "b", "lang", "word_a", "word_b", F.col("f_a").alias("l1"), F.col("f").alias("l2"))
    back = two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("word_b").alias("word_c"), F.col("f").alias("r1"), F.col("f_b").alias("r2"))
    cuts = threes.join(front, ["a", "b"]).join(back, ["b", "c"]).withColumns({"s1": F.expr(SCORE.format(a="n", l="l1", r="r1")), "s2": F.expr(SCORE.format(a="n", l="l2", r="r2"))})
    first = F.col("s1") <= F.col("s2")
    three_rows = cuts.select(
        "lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("n").alias("a"), F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    found = best(pair_rows.unionByName(three_rows), k).join(total, "lang")
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").select(*[F.col(c) if c in ("lang", "phrase") else F.col(c).cast("long") for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")])


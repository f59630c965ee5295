"""Byte-level BPE: encoding and decoding by the ranks of a published vocabulary.

Two tiers: a minimal perfect hash finds a pre-token that is itself in the vocabulary; any other is
merged by a heap of adjacent pairs over a doubly linked list of its bytes. Nothing is trained.

Defined results: null text counts as empty (no ids, the hashes of the empty string); repeated rows
give repeated results; extra columns are left alone unless asked to be kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lotwise.llm.common import slices

#: Distinct pre-tokens whose ids a Python worker keeps in each of its memo's two generations.
MEMO_ENTRIES = 250_000

# Character classes of the split pattern below U+0250, where Python's faster engine can be used.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼½¾"
_SPACES = r"\t-\r \x85\xa0"
_LATIN = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_BEYOND = re.compile("[^\u0000-ɏ]")
_WIDE_SPACE = r"\t-\r \x85\xa0  -     　"


#: Characters of the longest pre-token that a memo keeps, and pre-tokens that are looked up between two checks of its size.
LONGEST, STRIDE = 64, 1 << 16


def splitter(pattern: str):
    """A function that splits a text as ``pattern`` does. Texts within Latin use an equal, faster expression."""
    wide = regex.compile(pattern.replace(r"[^\s", f"[^{_WIDE_SPACE}").replace(r"\S", f"[^{_WIDE_SPACE}]").replace(r"\s", f"[{_WIDE_SPACE}]"))
    own = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+" in pattern

    def split(text: str) -> list[str]:
        return _LATIN.findall(text) if own and not _BEYOND.search(text) else wide.findall(text)

    return split


class Memo(dict):
    """Values made once for each key and kept while in use: when a generation is full, only what is asked for again moves to the next.

    Keys over ``LONGEST`` characters are not kept, so entries bound the memory.
    """

    def __init__(self, make: Callable[[str], bytes], entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.entries:
            self.old = dict(self)
            self.clear()


class PerfectHash:
    """Minimal perfect hash of byte strings: a displacement for each first-level bucket, one slot for each key."""

    def __init__(self, keys: list[bytes], load: int = 3):
        self.keys, n = keys, max(1, len(keys))
        self.buckets = max(1, n // load)
        at: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            at[zlib.crc32(key) % self.buckets].append(i)
        self.seeds, self.slots = [0] * self.buckets, [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(at[b]))
        for bucket in order:
            if len(at[bucket]) < 2:
                break
            for seed in range(1, 1 << 30):
                places = [self._place(keys[i], seed) for i in at[bucket]]
                if len(set(places)) == len(places) and all(self.slots[p] < 0 for p in places):
                    break
            self.seeds[bucket] = seed
            for p, i in zip(places, at[bucket], strict=True):
                self.slots[p] = i
        free = (p for p in range(n) if self.slots[p] < 0)
        for bucket in order:  # a lone key names its free slot
            if len(at[bucket]) == 1:
                p = next(free)
                self.seeds[bucket], self.slots[p] = -1 - p, at[bucket][0]

    def _place(self, key: bytes, seed: int) -> int:
        x = (zlib.crc32(key, seed) ^ seed) * 0x9E3779B1 & 0xFFFFFFFF
        return ((x ^ x >> 15) + len(key) * 0x85EBCA6B & 0xFFFFFFFF) % len(self.slots)

    def find(self, key: bytes) -> int:
        """The key's number, or -1."""
        seed = self.seeds[zlib.crc32(key) % self.buckets]
        x = self.slots[-1 - seed if seed < 0 else self._place(key, seed)]
        return x if x >= 0 and self.keys[x] == key else -1


class Codec:
    """Encodes and decodes by a rank file (base64 token and rank on each line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines) if a]
        self.token = {b: a for a, b in pairs}
        self.order = [b for _, b in pairs]
        self.packed = {b: struct.pack("<I", b) for b in self.order}
        self.hash = PerfectHash([a for a, _ in pairs])
        ranks = dict(pairs)
        self.byte = [ranks[bytes([x])] for x in range(256)]
        # the rank of two neighbours' union, by their ranks
        self.union = {ranks[a[:i]] << 32 | ranks[a[i:]]: b for a, b in pairs for i in range(1, len(a)) if a[:i] in ranks and a[i:] in ranks}
        self.split = splitter(pattern)
        self.memo = Memo(self.piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left. The heap may hold pairs that have gone."""
        get, n = self.union.get, len(piece)
        ids = [*map(self.byte.__getitem__, piece)]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        now = [get(a << 32 | b, -1) for a, b in pairwise(ids)]  # the rank of the pair that begins here
        now.append(-1)
        heap = [r * n + i for i, r in enumerate(now) if r >= 0]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            if now[i] != r:
                continue
            j, h = after[i], before[i]
            ids[i], ids[j], now[j] = r, -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                now[i] = x = get(r << 32 | ids[k], -1)
                if x >= 0:
                    heappush(heap, x * n + i)
            else:
                now[i] = -1
            if h >= 0:
                now[h] = x = get(ids[h] << 32 | r, -1)
                if x >= 0:
                    heappush(heap, x * n + h)
        return [x for x in ids if x >= 0]

    def piece(self, text: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        raw = text.encode()
        found = self.hash.find(raw)
        ids = [self.order[found]] if found >= 0 else self.merge(raw)
        return b"".join(map(self.packed.__getitem__, ids))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        parts, out = self.split(text), []
        for at in range(0, len(parts), STRIDE):
            self.memo.turn()
            out.append(b"".join(map(self.memo.__getitem__, parts[at : at + STRIDE])))
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the ids of each whole text, as an array of int. Streams within each partition; no shuffle."""
    schema = df.select(*keep).schema.add(ids, T.ArrayType(T.IntegerType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in slices(batches, "__text"):
            rows = [use.encode(t or "") for t in batch.column(len(keep)).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(rows), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(ends), flat)], names=[*keep, ids])

    return df.selectExpr(*[f"`{c}`" for c in keep], f"`{text}` as __text").mapInArrow(task, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and the bytes that the ids stand for; null ids give empty bytes."""
    schema = df.select(*keep).schema.add(out, "binary")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            done = [use.decode(x or ()) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(done, pa.binary())], names=[*keep, out])

    return df.select(*keep, ids).mapInArrow(task, schema)


def round_trip(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text, decode the ids, and return both results' digests: n_tokens, ids_sha256, decoded_sha256."""
    name = df.select(doc_id).schema[0]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        decimal = {i: str(i) for i in use.token}
        for batch in slices(batches, "__text"):
            n, first, second = [], [], []
            for t in batch.column(1).to_pylist():
                ids = np.frombuffer(use.encode(t or ""), "<u4").tolist()
                n.append(len(ids))
                first.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(use.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=[name.name, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = df.select(doc_id).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return df.selectExpr(f"`{doc_id}`", f"`{text}` as __text").mapInArrow(task, schema)

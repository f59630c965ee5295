"""Packing token sequences by power-of-two decomposition.

Every document's ids (and one closing id) are cut into pieces whose lengths are the full size and then
the powers of two of what remains. A sequence is one piece, so it never crosses documents and needs no
padding; pieces of equal length share a bucket.

Defined results: null or empty text gives the closing id alone; repeated rows are packed each for itself;
an empty table gives no pieces. Names of the vocabulary's added tokens within a text become their ids, as the
library does unless told otherwise.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.bpe import LONGEST, STRIDE, Memo, splitter
from lotwise.llm.common import slices

#: Distinct pre-tokens whose ids a Python worker keeps in each of its memo's two generations.
MEMO_ENTRIES = 300_000
#: Sub-buckets of each length, among which sequence numbers are dealt without meeting in one task.
SHARDS = 1024
_encoders: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Ids by the ``tokenizers`` library, kept by pre-token between batches. ``pattern`` must be the vocabulary's own."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        if isinstance(self.library.pre_tokenizer, pre_tokenizers.ByteLevel):  # what it gets is split already
            self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.size[[*vocabulary.values()]] = [*map(len, vocabulary)]  # a character of the byte-level alphabet is a byte
        added = self.library.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        names = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else lambda t: [t]
        self.split, self.memo = splitter(pattern), Memo(lambda p: self._ids([p])[0], MEMO_ENTRIES)

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of each pre-token: the library takes all at once, and the tokens' lengths in bytes tell where each ends."""
        if not parts:
            return []
        ids = np.array(self.library.encode_batch_fast([parts], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        ends, whole = np.cumsum(self.size[ids]), np.cumsum([len(p.encode()) for p in parts])
        last = np.searchsorted(ends, whole)
        if ends[-1] != whole[-1] or (ends[last] != whole).any():
            raise ValueError("the vocabulary does not split texts as the pattern does, or is not byte-level")
        raw = ids.tobytes()
        return [raw[x:y] for x, y in pairwise([0, *(4 * (last + 1)).tolist()])]

    def _stretch(self, parts: list[str]) -> list[bytes]:
        """Ids of pre-tokens; the library gets those that are new, all at once."""
        memo = self.memo
        memo.turn()
        found = [*map(memo.get, parts)]
        missed = [i for i, x in enumerate(found) if x is None]
        if missed:
            old, added = memo.old, self.added
            made = {p: old.get(p, added.get(p)) for p in {parts[i] for i in missed}}
            new = [p for p, x in made.items() if x is None]
            made.update(zip(new, self._ids(new), strict=True))
            for i in missed:
                found[i] = made[parts[i]]
            memo.update((p, x) for p, x in made.items() if len(p) <= LONGEST)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        parts, ends = [], []
        for t in texts:
            if t:
                if any(map(t.__contains__, self.added)):  # the library looks for added tokens first and splits what is between them
                    for part in self.cut(t):
                        parts += [part] if part in self.added else self.split(part)
                else:
                    parts += self.split(t)
            ends.append(len(parts))
        ids = [x for at in range(0, len(parts), STRIDE) for x in self._stretch(parts[at : at + STRIDE])]
        return [b"".join(ids[a:b]) for a, b in pairwise([0, *ends])]


def encoder(path: str, pattern: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path, pattern)
    return _encoders[path]


def cuts(n: int, size: int) -> list[int]:
    """Lengths of the pieces of n tokens: whole sizes first, then the binary digits of the rest."""
    return [size] * (n // size) + [1 << b for b in range(size.bit_length() - 1, -1, -1) if n % size >> b & 1]


def pieces(df: DataFrame, path: str, pattern: str, size: int = 2048, close: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens. No shuffle."""
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    name = df.select(doc_id).schema[0]
    schema = df.select(doc_id).schema.add("start", "long").add("length", "long").add("ids", "binary").add("doc_tokens", "long")
    end = np.array([close], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(path, pattern)
        for batch in slices(batches, "__text"):
            row, start, length, ids, total = [], [], [], [], []
            for i, packed in enumerate(use.encode(batch.column(1).to_pylist())):
                packed, at = packed + end, 0
                for k in cuts(n := len(packed) // 4, size):
                    row.append(i)
                    start.append(at)
                    length.append(k)
                    ids.append(packed[4 * at : 4 * (at + k)])
                    total.append(n)
                    at += k
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())], names=[name.name, "start", "length", "ids", "doc_tokens"])
        use.memo.old = {}  # the worker may go on to other stages, which need the memory

    return df.selectExpr(f"`{doc_id}`", f"`{text}` as __text").mapInArrow(task, schema)


def number(piece_rows: DataFrame, doc_id: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """Add sequence_id, ordered by bucket of equal length, and offset (0: a sequence is one piece)."""
    shard = F.pmod(F.xxhash64(doc_id, "start"), F.lit(shards))
    bucket = F.round(F.log2("length")).cast("long")
    within = Window.partitionBy("__bucket", "__shard").orderBy(doc_id, "start")
    return (
        piece_rows.withColumns({"__bucket": bucket, "__shard": shard})
        .withColumn("sequence_id", F.shiftleft("__bucket", 56) + (F.row_number().over(within) - 1) * F.lit(shards).cast("long") + F.col("__shard"))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("__bucket", "__shard")
    )


def pack(df: DataFrame, path: str, pattern: str, size: int = 2048, close: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return number(pieces(df, path, pattern, size, close, doc_id, text), doc_id)

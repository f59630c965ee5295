"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes that also starts elsewhere.

1. Anchors. In each window of ``length`` bytes the least hash of its K-byte strings marks an anchor, so
   equal windows have equal anchors at equal places. Anchors that occur once are dropped, so only bytes
   around repeated anchors are moved: an order of all suffixes of the corpus would move all of them.
2. Equal surroundings. A task names each text around an anchor once; all windows of its other copies are
   repeated, and nothing else of them is sent or kept.
3. Transforms. The texts around anchors meet by anchor. A task takes them in slices, splits a slice into two
   shards, sorts each shard's suffixes and writes its Burrows-Wheeler transform: the symbol before each suffix.
4. Merge. The two transforms are interleaved by refinement (as Holt and McMillan do): all suffixes begin in one
   block; a round moves each row to the suffix that begins one symbol earlier (two, where symbols are bytes of
   text) by a stable distribution on those symbols, and splits blocks where symbols differ. Suffixes are never
   sorted again. A row that is alone in its block is settled, its longest common prefix known; what shares a
   block at depth ``length`` is a repeated interval, exact on bytes.
5. Groups of a very frequent anchor are dealt by occurrence (document and place) to salted shards in many tasks;
   their intervals meet by a 128-bit digest of the repeated string, one row per interval and shard.

Defined results: null text is empty; a document shorter than ``length`` keeps all; repeated rows count as
different documents, so they lose what they share; ids may be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lotwise.llm.common import mix, shared_checkpoint, slices, span_hashes, utf8

K = 40
#: Occurrences beyond which an anchor's group is dealt to salted shards.
FREQUENT = 4096
#: The filter of repeated anchors has 16 bits for each, and this many at most (16 MB); with more anchors a join takes its place.
FILTER_LOG2 = 27
#: Bytes of anchors' surroundings that are sorted at once, and bytes that a task remembers to know equal ones.
SORT_BYTES, KNOWN_BYTES = 2 << 20, 8 << 20


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last window start, and document of each anchor, for windows that lie in one document."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none.astype(np.uint64), none, none, none
    at = np.arange(len(raw) - K + 1)
    full = span_hashes(raw, at, at + K)
    # 32 bits of hash and 32 of place: of equal hashes the leftmost is least
    low = (full >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    width, have = length - K + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    where = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offsets)
    start = np.arange(len(where))
    doc = np.repeat(np.arange(len(size)), size)[: len(where)]
    inside = start + length <= offsets[doc + 1]
    start, where, doc = start[inside], where[inside], doc[inside]
    if not len(start):
        return none.astype(np.uint64), none, none, none
    change = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    last = np.concatenate([change[1:] - 1, [len(start) - 1]])
    return full[where[change]], start[change], start[last], doc[change]


class Filter:
    """Which hashes may be in a set: two bits for each in a bitmap of fixed size, made by Spark aggregation."""

    def __init__(self, hashes: DataFrame, n: int):
        self.log2 = min(FILTER_LOG2, max(16, (16 * n).bit_length()))
        bit = hashes.select(F.explode(F.array(F.shiftrightunsigned("h", 64 - self.log2), F.pmod(F.col("h"), F.lit(1 << self.log2)))).alias("bit"))
        found = bit.select(F.shiftright("bit", 5).cast("int").alias("word"), F.expr("shiftleft(1L, cast(bit & 31 as int))").alias("mask")).groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
        self.words = np.zeros(1 << (self.log2 - 5), np.uint32)
        self.words[found.column("word").to_numpy()] = found.column("mask").to_numpy().astype(np.uint32)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for bit in (h >> np.uint64(64 - self.log2), h & np.uint64((1 << self.log2) - 1)):
            out &= (self.words[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of a text's suffixes in order, by prefix doubling of those that are not settled yet."""
    n = len(symbols)
    wide = np.concatenate([symbols.astype(np.uint64), np.zeros(7, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(7):  # of nine bits each
        key = key << np.uint64(9) | wide[j : j + n]
    order = np.argsort(key)  # equal keys are told apart by later rounds
    key, at, have = key[order], np.arange(n), 7
    rank = np.empty(n, np.int64)
    while len(at):
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[at]] = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        at = at[~(head & np.concatenate([head[1:], [True]]))]
        start = order[at]
        ahead = np.where(start + have < n, rank[np.minimum(start + have, n - 1)] + 1, 0)
        key = rank[start].astype(np.uint64) << np.uint64(32) | ahead.astype(np.uint64)
        again = np.argsort(key)
        order[at], key, have = start[again], key[again], have * 2
    return order


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix order of texts, each closed by an end of its own, the symbol before each suffix, and the row of the suffix one symbol earlier."""
    symbols = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    symbols[ends] = 0
    order = suffix_order(symbols)
    before = symbols[order - 1]
    earlier = np.empty(len(order), np.int64)
    earlier[np.argsort(before, kind="stable")] = np.arange(len(order))
    return order, before, earlier


def interleave(a: tuple, b: tuple, length: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two transforms (those of ``b`` numbered on from those of ``a``) whose first ``length`` symbols another row shares, and their blocks.

    ``live`` are the rows at which such symbols may end.

    A block holds the rows of both that share the symbols read so far: a common prefix, and in the end a repeated interval.
    A step reads the next symbols of all rows left, up to eight at once, and deals out anew only the blocks that they
    split; rows alone in a block leave.
    """
    symbol = np.concatenate([a[1], b[1]])
    move = np.concatenate([a[2], b[2] + len(a[2])])
    if len(symbol) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    jumps = [(1, symbol.astype(np.uint64), move)]
    while jumps[-1][0] < 8 and symbol.max() < 256:
        n, s, m = jumps[-1]
        jumps.append((2 * n, s[m] << np.uint64(8 * n) | s, m[m]))
    row, left = np.flatnonzero(live), length
    block = np.zeros(len(row), np.int64)
    if len(row) < 2:
        return row[:0], block[:0]
    while left and len(row):
        n, symbol, move = next(x for x in reversed(jumps) if x[0] <= left and left % x[0] == 0)
        mine, left = symbol[row], left - n
        split = (block[1:] == block[:-1]) & (mine[1:] != mine[:-1])
        if split.any():
            names = int(block.max()) + 1
            torn = np.zeros(names, bool)
            torn[block[1:][split]] = True
            torn = torn[block]
            some, value = row[torn], mine[torn]
            order = np.argsort(value)
            key = value[order]
            if names > 1:
                ranks = np.empty(len(value), np.int64)
                ranks[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
                key = block[torn] << 32 | ranks
                order = np.argsort(key)
                key = key[order]
            head = np.concatenate([[True], key[1:] != key[:-1]])
            shared = ~(head & np.concatenate([head[1:], [True]]))
            new = np.cumsum(head) + names
            row, block = np.concatenate([row[~torn], some[order][shared]]), np.concatenate([block[~torn], new[shared]])
            if names > len(row) << 2:
                block = np.unique(block, return_inverse=True)[1]
        row = move[row]
    return row, block


def intervals(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and interval of each window of ``length`` bytes that equals another one, ordered by text and place."""
    half = (len(texts) + 1) // 2
    one, two = transform(texts[:half]), transform(texts[half:]) if len(texts) > half else (np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.int64))
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    offset = np.arange(starts[-1]) - np.repeat(starts[:-1], sizes)
    live = offset[np.concatenate([one[0], two[0] + starts[half]])] >= length  # a window that ends here begins in its text
    row, block = interleave(one, two, length, live)
    at = np.where(row < len(one[0]), one[0][np.minimum(row, len(one[0]) - 1)], 0)
    if len(two[0]):
        at = np.where(row < len(one[0]), at, starts[half] + two[0][np.maximum(row - len(one[0]), 0)])
    text = np.searchsorted(starts, at, side="right") - 1
    place = at - starts[text]
    inside = at + length < starts[text + 1]  # what runs over a text's end is no window
    text, place, block = text[inside], place[inside], block[inside]
    order = np.lexsort((place, text))
    return text[order], place[order], block[order]


def resolve(salts: list[int], texts: list[bytes], length: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, bytes, bool]]]:
    """Of different texts around anchors: spans (text, first place, windows) of repeated windows, and, for salted ones, (text, place, digest, alone) for each interval."""
    text, place, interval = intervals(texts, length)
    spans, meet = [], []
    if len(text):
        cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1), [True]]))
        spans = list(zip(text[cut[:-1]].tolist(), place[cut[:-1]].tolist(), np.diff(cut).tolist(), strict=True))
    if any(salts):
        _, first = np.unique(interval, return_index=True)
        twice = set(zip(text.tolist(), place.tolist(), strict=True))
        leads = [(t, p, False) for t, p in zip(text[first].tolist(), place[first].tolist(), strict=True) if salts[t]]
        leads += [(t, p, True) for t, s in enumerate(salts) if s for p in range(len(texts[t]) - length + 1) if (t, p) not in twice]
        meet = [(t, p, hashlib.blake2b(texts[t][p : p + length], digest_size=16).digest(), alone) for t, p, alone in leads]
    return spans, meet


def dealt(row: np.ndarray, place: np.ndarray, salts: int) -> np.ndarray:
    """The shard of each occurrence of a frequent anchor, from the hash of its document's id and text and its place there."""
    with np.errstate(over="ignore"):
        return (mix(row.view(np.uint64) + mix(place.astype(np.uint64) + np.uint64(1))) % np.uint64(salts)).astype(np.int32)


def find_spans(df: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """(__id, __th, spans): the byte ranges to remove of each document that has any; __th is its text's hash."""
    docs = df.select(F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__th"), F.col(text).alias("__text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("__row")).where(F.octet_length("__text") >= length)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            h, n = np.unique(anchors(*utf8(batch.column(0)), length)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    counted = shared_checkpoint(docs.select("__text").mapInArrow(hashes, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    about = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count_if(F.col("n") > FREQUENT).alias("frequent")).first()
    small = about["n"] * 8 <= 1 << FILTER_LOG2
    context = df.sparkSession.sparkContext
    known = context.broadcast(Filter(counted.select("h"), about["n"]) if small else None)  # 16 MB at most
    often = context.broadcast(Filter(counted.where(F.col("n") > FREQUENT).select("h"), about["frequent"]) if about["frequent"] * 8 <= 1 << FILTER_LOG2 else None)
    salts = max(1, -(-about["most"] // FREQUENT))

    fields = ["h", "salt", "__id", "__th", "lo", "end", "ctx"]

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # texts around anchors that this task has sent, with whose they were; those told as repeated have None
        known_texts: dict[bytes, tuple | None] = {}
        size = 0
        for batch in slices(batches, "__text"):
            raw, offsets = utf8(batch.column(2))
            h, lo, hi, doc = anchors(raw, offsets, length)
            if known.value is not None:
                keep = known.value.has(h)
                h, lo, hi, doc = h[keep], lo[keep], hi[keep], doc[keep]
            hot = often.value.has(h) if often.value is not None else np.ones(len(h), bool)
            place = lo - offsets[doc]
            salt = np.where(hot, 1 + dealt(batch.column(3).to_numpy()[doc], place, salts), 0).astype(np.int32)
            whole = raw.tobytes()
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            spread = 0
            for key, s, d, p, a, b in zip(h.view(np.int64).tolist(), salt.tolist(), doc.tolist(), place.tolist(), lo.tolist(), (hi + length).tolist(), strict=True):
                ctx = whole[a:b]
                if ctx in known_texts:
                    first = known_texts[ctx]
                    if first is not None:
                        out.append((*first, None))
                        known_texts[ctx] = None
                    out.append((key, s, ids[d], texts[d], p, p + b - a, None))
                    continue
                if size > KNOWN_BYTES:
                    known_texts.clear()
                    size = 0
                known_texts[ctx] = (key, s, ids[d], texts[d], p, p + b - a)
                size += b - a
                out.append((key, s, ids[d], texts[d], p, None, ctx))
                spread += b - a
                if spread > SORT_BYTES:
                    yield packed(out)
                    out, spread = [], 0
            if out:
                yield packed(out)

    id_type = docs.schema["__id"].dataType.simpleString()
    id_arrow = to_arrow_type(docs.schema["__id"].dataType)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), id_arrow, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=fields)

    around = docs.select("__id", "__th", "__text", "__row").mapInArrow(surroundings, f"h long, salt int, __id {id_type}, __th long, lo long, end long, ctx binary")
    if not small:
        around = around.join(counted.select("h"), "h", "left_semi")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__id", "__th", "first", "end", "d1", "d2", "alone"]
        kinds = [id_arrow, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        done: list[tuple] = []  # rows of the result
        waiting: list[tuple] = []  # of finished groups with several texts: salt, id, th, lo, ctx
        group: dict[bytes, list] = {}  # of the group at hand: salt, id, th, lo, whether told as repeated
        key, size = None, 0

        def told(ctx: bytes, row: list) -> tuple:
            return (row[1], row[2], row[3], row[3] + len(ctx), None, None, None)

        def close() -> None:
            nonlocal size
            if len(group) > 1 or any(r[0] for r in group.values()):
                waiting.extend((*r[:4], ctx) for ctx, r in group.items())
                size += sum(map(len, group))
            group.clear()

        def settle() -> None:
            nonlocal size
            spans, meet = resolve([r[0] for r in waiting], [r[4] for r in waiting], length)
            for t, p, n in spans:
                _, i, th, lo, _ = waiting[t]
                done.append((i, th, lo + p, lo + p + n - 1 + length, None, None, None))
            for t, p, digest, alone in meet:
                _, i, th, lo, _ = waiting[t]
                d1, d2 = np.frombuffer(digest, np.int64).tolist()
                done.append((i, th, lo + p, lo + p + length, d1, d2, alone))
            waiting.clear()
            size = 0

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
            done.clear()
            return batch

        for batch in slices(batches, "ctx", SORT_BYTES):
            for h, salt, i, th, lo, end, ctx in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in fields), strict=True):
                if ctx is None:
                    done.append((i, th, lo, end, None, None, None))
                    continue
                if (h, salt) != key:
                    close()
                    key = (h, salt)
                    if size > SORT_BYTES:
                        settle()
                row = group.get(ctx)
                if row is None:
                    group[ctx] = [salt, i, th, lo, False]
                    continue
                if not row[4]:
                    row[4] = True
                    done.append(told(ctx, row))
                done.append((i, th, lo, lo + len(ctx), None, None, None))
            if len(done) > 50_000:
                yield out()
        close()
        if waiting:
            settle()
        if done:
            yield out()

    found = shared_checkpoint(
        around.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(merge, f"__id {id_type}, __th long, first long, end long, d1 long, d2 long, alone boolean")
    )
    span = F.struct("first", "end")
    met = found.where("d1 is not null").groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("alone"), F.struct("__id", "__th", "first", "end"))).alias("who"))
    late = met.where("n > 1").select(F.explode("who").alias("w")).select("w.*")  # at most one row for each salt
    all_spans = found.where("d1 is null").select("__id", "__th", "first", "end").unionByName(late)
    # rows of one id and text each send the spans of that text
    return all_spans.distinct().groupBy("__id", "__th").agg(F.collect_list(span).alias("spans"))


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, as_text: bool = False) -> DataFrame:
    """``row`` (a struct of all columns of ``df``), kept (the remaining bytes, or as text without the characters cut through), n_bytes, n_removed and n_spans."""
    spans = find_spans(df, doc_id, text, length)
    fields = df.columns
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in fields]).alias("row"), F.col(doc_id).alias("__id"), F.xxhash64(F.col(text)).alias("__th"), F.col(text).alias("__text"))
    s = spans.select(F.col("__id").alias("s_id"), F.col("__th").alias("s_th"), "spans")
    joined = docs.join(s, docs["__id"].eqNullSafe(s["s_id"]) & (docs["__th"] == s["s_th"]), "left").select("row", "__text", F.col("spans.first").alias("firsts"), F.col("spans.end").alias("ends"))
    schema = joined.select("row").schema.add("kept", "string" if as_text else "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            kept, size, gone, runs = [], [], [], []
            raw, offsets = utf8(batch.column(1))
            whole = raw.tobytes()
            for i, (a, b, firsts, ends) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(2), batch.column(3), strict=True)):
                n, at, parts, end = 0, a, [], -1
                if firsts.is_valid:
                    for f, e in sorted(zip(firsts.as_py(), ends.as_py(), strict=True)):
                        if f > end:  # runs that touch are one
                            parts.append(whole[at : a + f])
                            n += 1
                            end = e
                        elif e > end:
                            end = e
                        at = a + end
                parts.append(whole[at:b])
                kept.append(b"".join(parts))
                size.append(b - a)
                gone.append(b - a - len(kept[-1]))
                runs.append(n)
            out = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out, *(pa.array(x, pa.int64()) for x in (size, gone, runs))], names=schema.names)

    return joined.mapInArrow(cut, schema)

"""Line dedup: lines that many documents share, or that occurred before, by range-partitioned hashes.

1. A task reads texts and sends a row for each line that counts: 128 bits of its key, its document and its number.
2. Rows are partitioned by ranges of (hash, document, line) and sorted so within a partition. A line that a third
   of all documents have so fills several neighbouring partitions instead of one.
3. A first pass tells, of each partition, the lines that may go on in a neighbour (its first and last: two rows a
   partition); they are summed, and a line that spans partitions becomes known with its number of documents and
   its first place. A second pass streams the sorted rows; it holds back at most ``least`` documents of a line.
4. What goes is gathered as one compressed bitmap for each document, and only these bitmaps meet the texts.

Keys are lines without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; those shorter than ``chars`` code points
are never dropped.

Defined results: null or empty text is one empty line. Documents are told apart by (id, text): the same row twice
counts as two documents of a line's ``least``, and both rows get the same lines. Ids may be null or repeat; further
columns are left alone. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import shared_checkpoint, slices

_SPACE = b" \t\n\x0b\x0c\r"
#: Rows of a batch that the second pass sends on.
ROWS = 1 << 16
_KEY = ("h1", "h2", "id", "d1", "d2", "line")


def digest(raw: bytes) -> bytes:
    return blake2b(raw, digest_size=16).digest()


def document(doc_id: str, text: str) -> list[Column]:
    """128 bits of a row's id and text."""
    i, t = F.col(doc_id), F.col(text)
    return [F.xxhash64(i, t).alias("d1"), F.xxhash64(F.lit(1), t, i).alias("d2")]


def places(df: DataFrame, doc_id: str, text: str, chars: int) -> DataFrame:
    """A row for each line that counts: h1, h2 (its key), id, d1, d2 (its document), line, and ``first`` where the document has it for the first time."""
    docs = df.select(F.col(doc_id).alias("id"), *document(doc_id, text), F.col(text).alias("__text")).where("__text <> ''")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            hashes, rows, numbers, firsts = [], [], [], []
            for i, raw in enumerate(batch.column(3).cast(pa.binary()).to_pylist()):
                seen = set()
                for n, line in enumerate(raw.split(b"\n")):
                    key = line.strip(_SPACE).lower()
                    if len(key) >= chars if chars <= 1 else len(key.decode()) >= chars:
                        h = digest(key)
                        hashes.append(h)
                        rows.append(i)
                        numbers.append(n)
                        firsts.append(h not in seen)
                        seen.add(h)
            h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            whose = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(h[:, c])) for c in (0, 1)), *whose, pa.array(numbers, pa.int32()), pa.array(firsts, pa.bool_())], names=[*_KEY, "first"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(task, f"h1 long, h2 long, id {kind}, d1 long, d2 long, line int, first boolean")


def runs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where runs of one line begin and end in a sorted batch, and its columns."""
    x = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "d1", "d2", "line", "first")}
    new = (x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(x["h1"])]]), x


def dropped(df: DataFrame, doc_id: str, text: str, least: int, chars: int, keep_first: bool) -> DataFrame:
    """(d1, d2, line) of what goes: all lines whose key ``least`` documents have, but for its very first one if ``keep_first``."""
    ranged = shared_checkpoint(places(df, doc_id, text, chars).repartitionByRange(*_KEY).sortWithinPartitions(*_KEY))
    kind = ranged.schema["id"].dataType.simpleString()

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's first and last line: its documents here, and its first row."""
        ends: list[list] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cut, x = runs_of(batch)
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                n = int(x["first"][a:z].sum())
                if key == (key := (x["h1"][a], x["h2"][a])):
                    ends[-1][0] += n
                else:
                    ends[1:] = [[n, batch.slice(a, 1)]] if ends else []
                    ends = ends or [[n, batch.slice(a, 1)]]
        for n, row in ends:
            yield pa.RecordBatch.from_arrays([*row.columns[:6], pa.array([n], pa.int64())], names=[*_KEY, "n"])

    ends = ranged.mapInArrow(edges, f"h1 long, h2 long, id {kind}, d1 long, d2 long, line int, n long")
    whole = ends.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.min(F.struct("id", "d1", "d2", "line")).alias("at")).where("parts > 1")
    spanning = {(r["h1"], r["h2"]): (r["n"], [*r["at"]][1:]) for r in whole.collect()}  # fewer than partitions

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, seen, held = None, None, 0, []  # of the line at hand: its first row, its documents so far, rows held back
        out: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(out)
            out.clear()
            cols = [np.ascontiguousarray(rows[:, i]) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32))], names=["d1", "d2", "line"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cut, x = runs_of(batch)
            rows = np.stack([x["d1"], x["d2"], x["line"].astype(np.int64)], 1)
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if (own := (int(x["h1"][a]), int(x["h2"][a]))) != key:
                    key, held = own, []
                    seen, at = spanning.get(key, (0, rows[a].tolist()))
                if key not in spanning:
                    seen += int(x["first"][a:z].sum())
                part = rows[a:z]
                held.append(part[(part != at).any(1)] if keep_first else part)
                if seen >= least:
                    out += held
                    size += sum(map(len, held))
                    held = []
                if size >= ROWS:
                    yield flush()
                    size = 0
        if out:
            yield flush()

    return ranged.mapInArrow(task, "d1 long, d2 long, line int")


def bitmaps(gone: DataFrame) -> DataFrame:
    """(d1, d2, keep): a compressed bitmap of each document's lines, up to the last that goes: 1 stays, 0 goes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for lines in batch.column(2):
                at = lines.values.to_numpy()
                keep = np.ones(int(at.max()) // 8 * 8 + 8, np.uint8)  # whole bytes
                keep[at] = 0
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(maps, pa.binary())], names=["d1", "d2", "keep"])

    return gone.groupBy("d1", "d2").agg(F.collect_set("line").alias("lines")).mapInArrow(task, "d1 long, d2 long, keep binary")


def line_bitmaps(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10, chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(d1, d2, keep) of the documents that lose lines; ``keep_first`` with ``least`` 1 leaves each line's first occurrence by id and line."""
    return bitmaps(dropped(df, doc_id, text, least, chars, keep_first))


def drop_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10, chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``row`` (a struct of all columns of ``df``), kept (the lines that stay, joined by newlines), keep (their bitmap), n_lines and n_dropped."""
    maps = line_bitmaps(df, doc_id, text, least, chars, keep_first)
    docs = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *document(doc_id, text), F.col(text).alias("__text"))
    joined = docs.join(maps, ["d1", "d2"], "left").select("row", "__text", "keep")
    schema = joined.select("row").schema.add("kept", "string").add("keep", "binary").add("n_lines", "long").add("n_dropped", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            kept, counts, gone = [], [], []
            for raw, keep in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = (raw or b"").split(b"\n")
                counts.append(len(lines))
                if keep is not None:
                    stays = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
                    lines = [x for x, s in zip(lines, stays.tolist(), strict=False) if s] + lines[len(stays) :]
                kept.append(b"\n".join(lines))
                gone.append(counts[-1] - len(lines))
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text, batch.column(2), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return joined.mapInArrow(cut, schema)

"""Dedup of lines that several documents share.

Lines are compared by a 128-bit hash of their key (white space stripped, A-Z lower-cased).
Hashes go to partitions by ranges of their leading bits, which are uniform, so the borders
need no sampling; within a partition they are sorted by hash, then by document from the last
to the first, then by position. A stream over the sorted rows sees each hash's first
document (which keeps its lines), counts documents up to the bound, and reports the others'
lines. What comes out are numbers of lines, gathered as a compressed bitmap for each
document; texts meet their bitmaps only where lines are taken out.

Before the shuffle each block of documents is combined: of a hash in a block only the lines of
the ``documents`` last documents travel, as they decide for all others of the block; those are
settled and go straight to their documents' bitmaps. So a line of a third of all documents is
a few rows for each block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, arrow_schema, giving_back, packed, partitions

#: Lines of a block that are combined before the shuffle.
BLOCK_LINES = 1 << 19
#: What stands for a null id: below all others.
NO_ID = -(1 << 63)

LINES = "h1 long, h2 long, doc long, version long, line int, settled boolean"
DROPPED = "doc long, version long, line int"


def line_key(line: bytes) -> bytes:
    """The line without outer white space, in lower case (A-Z only)."""
    return line.strip().lower()


def long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (key.isascii() or len(key.decode()) >= chars)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first one does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def places(starts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For rows in groups that begin where ``starts``: the number of ``marks`` so far in the group."""
    total = np.cumsum(marks)
    return total - (total[starts] - marks[starts])[np.cumsum(starts) - 1]


def _identity() -> tuple[Column, Column]:
    """A row is told by its id and a hash of its text: rows alike in both are treated alike."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("version")


def hashed_lines(docs: DataFrame, documents: int, chars: int) -> DataFrame:
    """``LINES``: the lines long enough to count, combined in blocks. Settled ones are dropped
    already; their ``h1`` only spreads them."""
    spark = docs.sparkSession
    arrow_rows(spark)
    schema = arrow_schema(spark, LINES)

    def block(hashes: list[bytes], doc: list[int], version: list[int], line: list[int]) -> pa.RecordBatch:
        h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
        d, v, n = np.array(doc, np.int64), np.array(version, np.int64), np.array(line, np.int32)
        order = np.lexsort((n, ~d, h[:, 1], h[:, 0]))  # ~d falls where d rises
        h1, h2, d, v, n = h[order, 0], h[order, 1], d[order], v[order], n[order]
        starts = changes(h1, h2)
        settled = places(starts, starts | changes(d)) > documents
        h1 = np.where(settled, d * -7046029254386353131 ^ v, h1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, h2, d, v, n, settled)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            for doc, version, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for i, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                    key = line_key(line)
                    if long_enough(key, chars):
                        for column, x in zip(held, (xxhash.xxh3_128_digest(key), doc, version, i)):
                            column.append(x)
                        if len(held[0]) >= BLOCK_LINES:
                            yield block(*held)
                            held = ([], [], [], [])
        if held[0]:
            yield block(*held)

    return docs.select(*_identity(), "text").mapInArrow(giving_back(run), LINES)


class Hash:
    """The hash that the stream is at: its first document, how many documents it has had (up
    to the bound), and what is still open until the bound is reached."""

    def __init__(self, documents: int):
        self.documents, self.at, self.first, self.last, self.seen, self.open = documents, None, 0, None, 0, []

    def add(self, doc: np.ndarray, version: np.ndarray, line: np.ndarray) -> Iterator[tuple]:
        """Rows of the hash, documents falling: the lines that go."""
        if self.last is None:
            self.first = int(doc[0])
        marks = changes(doc)
        self.seen += int(marks.sum()) - (self.last == int(doc[0]))
        self.last = int(doc[-1])
        rest = doc != self.first
        self.open.append((doc[rest], version[rest], line[rest]))
        if self.seen >= self.documents:
            yield from self.open
            self.open = []


def dropped_lines(docs: DataFrame, documents: int = 3, chars: int = 20) -> DataFrame:
    """``(doc, version, line)``: the numbers of the lines that go, of the row with that id
    (``NO_ID`` for null) and hash of its text."""
    spark = docs.sparkSession
    schema = arrow_schema(spark, DROPPED)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now = Hash(documents)
        for batch in batches:
            h1, h2, d, v, n, settled = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield d[settled], v[settled], n[settled]
            h1, h2, d, v, n = (x[~settled] for x in (h1, h2, d, v, n))
            if not len(h1):
                continue
            starts = changes(h1, h2)
            begins = np.flatnonzero(starts)
            first = begins[1] if len(begins) > 1 else len(h1)  # the batch's first hash may go on from the one before,
            final = begins[-1]  # and its last one into the next
            if now.at != (h1[0], h2[0]):
                now = Hash(documents)
                now.at = (h1[0], h2[0])
            yield from now.add(d[:first], v[:first], n[:first])
            if final < first:
                continue
            s, dd, vv, nn = starts[first:final], d[first:final], v[first:final], n[first:final]
            if len(s):
                group = np.cumsum(s) - 1
                at = places(s, s | changes(dd))
                full = np.maximum.reduceat(at, np.flatnonzero(s)) >= documents
                gone = full[group] & (at > 1)
                yield dd[gone], vv[gone], nn[gone]
            now = Hash(documents)
            now.at = (h1[final], h2[final])
            yield from now.add(d[final:], v[final:], n[final:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in stream(batches):
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    parts = partitions(spark)
    # The top 16 bits of the hash, as a number from 0, in equal ranges.
    part = F.floor((F.shiftright("h1", 48) + 32768) * parts / 65536) if parts <= 65536 else F.floor((F.shiftright("h1", 32) + (1 << 31)) * parts / (1 << 32))
    lines = hashed_lines(docs, documents, chars)
    return lines.repartitionById(parts, part.cast("int")).sortWithinPartitions("h1", "h2", F.col("doc").desc(), "line").mapInArrow(giving_back(run), DROPPED)


def keep_bitmaps(docs: DataFrame, documents: int = 3, chars: int = 20) -> DataFrame:
    """``(doc_id, version, n_dropped, keep)`` of the documents that lose lines: a lost line is
    one whose key has ``chars`` code points or more, is found in ``documents`` documents or
    more, and stays in the one of greatest id.

    ``keep`` has a bit for each line, in order, up to the byte of the last one that goes (lines
    after it stay): eight lines a byte, the first one in the highest bit, compressed. ``version`` is
    ``xxhash64`` of the text. Rows with equal ids are one document; null ids are one below
    all others. Null and empty texts have one empty line; no short line ever goes. Repeated
    lines of the last document all stay. An empty table gives an empty result; other columns
    are ignored; texts are taken whole.
    """
    schema = arrow_schema(docs.sparkSession, "doc_id long, version long, n_dropped long, keep binary")

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for doc, version, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                at = lines.values.to_numpy(zero_copy_only=False)
                keep = np.ones(int(at.max()) // 8 * 8 + 8, np.uint8)
                keep[at] = 0
                yield {"doc_id": None if doc == NO_ID else doc, "version": version, "n_dropped": len(at), "keep": zlib.compress(np.packbits(keep).tobytes())}

    rows = dropped_lines(docs, documents, chars).groupBy("doc", "version").agg(F.collect_set("line").alias("lines"))
    return rows.mapInArrow(lambda b: packed(bitmaps(b), schema), "doc_id long, version long, n_dropped long, keep binary")


def kept_lines(text: str | None, keep: bytes | None) -> tuple[int, list[bytes]]:
    """The number of lines of a text, and those that its bitmap keeps."""
    lines = (text or "").encode().split(b"\n")
    if keep is None:
        return len(lines), lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].tolist()
    return len(lines), [x for x, bit in zip(lines, bits) if bit] + lines[len(bits) :]


def _with_bitmaps(docs: DataFrame, documents: int, chars: int) -> DataFrame:
    """``docs`` with its ``__keep``; bitmaps are few bytes a document, so a partition's are held and texts
    need no sort."""
    found = keep_bitmaps(docs, documents, chars).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__doc"), F.col("version").alias("__version"), F.col("keep").alias("__keep"))
    doc, version = _identity()
    rows = docs.withColumns({"__d": doc, "__v": version})
    return rows.join(found.hint("shuffle_hash"), (F.col("__d") == F.col("__doc")) & (F.col("__v") == F.col("__version")), "left").drop("__doc", "__version", "__d", "__v")


def drop_lines(docs: DataFrame, documents: int = 3, chars: int = 20) -> DataFrame:
    """``docs`` with the lines out of ``text`` that ``keep_bitmaps`` marks (the rest joined by
    line feeds); ``n_chars``, if it is there, stays as it was. All rows stay; null texts stay
    null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            keeps = batch.column(batch.num_columns - 1)
            texts = [t if k is None else b"\n".join(kept_lines(t, k)[1]).decode() for t, k in zip(batch.column(at).to_pylist(), keeps.to_pylist())]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))

    return _with_bitmaps(docs, documents, chars).select(*docs.columns, "__keep").mapInArrow(giving_back(run), docs.schema)


def dedup_lines(docs: DataFrame, documents: int = 3, chars: int = 20) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of every row: its lines, how many go by
    ``keep_bitmaps``, and a digest of the rest joined by line feeds. A row each for null ids
    and repeated rows."""
    result = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    schema = arrow_schema(docs.sparkSession, result)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for doc_id, text, keep in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                n, kept = kept_lines(text.as_py(), keep)
                yield {"doc_id": doc_id, "n_lines": n, "n_dropped": n - len(kept), "kept_sha256": hashlib.sha256(b"\n".join(kept)).hexdigest()}

    joined = _with_bitmaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), documents, chars)
    return joined.select("doc_id", "text", "__keep").mapInArrow(lambda b: packed(rows(b), schema), result)

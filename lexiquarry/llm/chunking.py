"""Documents packed into chunks: few rows with much text, written once and read by every
pass of an operator. Consecutive chunks of a task make a group. A group exchanges packed
messages with buckets of hashes: it asks about its hashes in sorted order and gets the
answers in that order.

There is at most one message for a group and a bucket that it has hashes for, so there are
never more messages than hashes. Buckets follow the bytes of all texts, not the settings.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import arrow_rows, arrow_schema, packed, partitions

#: Bytes of text of a chunk, of a group of chunks, and of all texts for a bucket.
CHUNK_BYTES, GROUP_BYTES, BUCKET_BYTES = 6 << 20, 12 << 20, 32 << 20
U = np.uint64
CHUNK = "group long, chunk long, doc_ids array<bigint>, ptr binary, text binary, n_bytes long, whole long, part int"
#: Where text rows come among answers: after them.
TEXT = 9
ANSWER = "group long, kind int, bucket int, chunks array<bigint>, counts array<int>, flags binary"


def chunks(docs: DataFrame, most: int = CHUNK_BYTES, overlap: int | None = None) -> DataFrame:
    """Documents packed into rows of about ``most`` bytes of text.

    A longer document is a row of its own or, with ``overlap``, several rows with the same
    number ``whole``: each starts ``most`` bytes after the one before and has the first
    ``overlap`` bytes of the next.
    """
    arrow_rows(docs.sparkSession)
    schema = arrow_schema(docs.sparkSession, CHUNK)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        squeeze, number = zstandard.ZstdCompressor(1), TaskContext.get().partitionId() << 32
        group, grouped = number, 0  # both count up from the task's number
        ids: list[int] = []
        sizes: list[np.ndarray] = []
        texts: list[bytes] = []
        held = 0

        def row(ids: list, sizes: np.ndarray, text: bytes, whole: int | None = None, part: int | None = None) -> dict:
            nonlocal number, group, grouped
            if grouped and grouped + len(text) > max(most, GROUP_BYTES):
                group, grouped = group + 1, 0
            grouped += len(text)
            number += 1
            ptr = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            return {"group": group, "chunk": number - 1, "doc_ids": list(ids), "ptr": ptr.tobytes(), "text": squeeze.compress(text), "n_bytes": len(text), "whole": whole, "part": part}

        for batch in batches:
            data, ptr = bs.text_bytes(batch.column(1))
            own = batch.column(0).to_pylist()
            for i, j in bs.blocks(ptr, min(most, bs.BLOCK_BYTES)):
                if held and held + ptr[j] - ptr[i] > most:
                    yield row(ids, np.concatenate(sizes), b"".join(texts))
                    ids, sizes, texts, held = [], [], [], 0
                if overlap is not None and j == i + 1 and ptr[j] - ptr[i] > most:
                    whole = number
                    for k, at in enumerate(range(int(ptr[i]), int(ptr[j]) - overlap, most)):
                        piece = data[at : min(at + most + overlap, ptr[j])].tobytes()
                        yield row(own[i:j], np.array([len(piece)]), piece, whole, k)
                    continue
                ids += own[i:j]
                sizes.append(np.diff(ptr[i : j + 1]))
                texts.append(data[ptr[i] : ptr[j]].tobytes())
                held += int(ptr[j] - ptr[i])
        if ids:
            yield row(ids, np.concatenate(sizes), b"".join(texts))

    return docs.select("doc_id", "text").mapInArrow(lambda b: packed(rows(b), schema, 2), CHUNK)


def bucket_count(table: DataFrame) -> int:
    """Buckets of hashes for a table of chunks: one for ``BUCKET_BYTES`` of text, and no
    fewer than tasks can run at once."""
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    return max(partitions(table.sparkSession), math.ceil(total / BUCKET_BYTES))


def group_parts(table: DataFrame) -> tuple[Column, int]:
    """A number from 0 for each group, and how many partitions there are for them: as a
    rule one each. Tasks have about equally many groups; if some have many more, groups
    share partitions, of which there are twice as many as groups at most."""
    task, place = F.shiftright("group", 32), F.col("group").bitwiseAND(0xFFFFFFFF)
    tasks, places, groups = table.agg(F.max(task), F.max(place), F.count_distinct("group")).first()
    if tasks is None:
        return F.lit(0), 1
    parts = min((tasks + 1) * (places + 1), 2 * groups)
    return F.pmod(task * F.lit(places + 1) + place, F.lit(parts)).cast("int"), int(parts)


class Outbox:
    """What the chunks of a group say to each bucket."""

    def __init__(self) -> None:
        self.group: int | None = None
        self.held: list[tuple[int, np.ndarray, np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]] = []

    def add(self, chunk: int, cut: np.ndarray, counts: np.ndarray, **columns) -> None:
        """``cut``: bounds of each bucket in a column, unless it comes as (values, cut);
        ``counts``: numbers of answers that the chunk expects of each bucket."""
        whole = {k: v if isinstance(v, tuple) else (v, cut) for k, v in columns.items()}
        self.held.append((chunk, np.diff(cut) > 0, counts, whole))

    def messages(self) -> Iterator[tuple[dict, dict[str, np.ndarray]]]:
        """``(bucket, group, chunks, counts)`` and the joined columns, by buckets."""
        some = np.flatnonzero(np.any([x[1] for x in self.held], axis=0)).tolist() if self.held else []
        for b in some:
            own = [x for x in self.held if x[1][b]]
            head = {"bucket": b, "group": self.group, "chunks": [x[0] for x in own], "counts": [int(x[2][b]) for x in own]}
            yield head, {k: np.concatenate([x[3][k][0][x[3][k][1][b] : x[3][k][1][b + 1]] for x in own]) for k in own[0][3]}
        self.held = []


def by_groups(rows: Iterator[dict], fill) -> Iterator[tuple[dict, dict[str, np.ndarray]]]:
    """Messages of consecutive rows of a group; ``fill(outbox, row)`` adds those of a chunk."""
    box = Outbox()
    for row in rows:
        if row["group"] != box.group:
            yield from box.messages()
            box.group = row["group"]
        fill(box, row)
    yield from box.messages()


class Inbox:
    """Answers to a group, by chunk and in order of buckets."""

    def __init__(self) -> None:
        self.held: dict[tuple[int, int], list[tuple[int, int, np.ndarray]]] = defaultdict(list)

    def add(self, row: dict) -> None:
        flags = np.frombuffer(zstandard.decompress(row["flags"]), np.uint8)
        for k, (chunk, own) in enumerate(zip(row["chunks"], np.split(flags, np.cumsum(row["counts"])[:-1]))):
            self.held[row["kind"], chunk].append((row["bucket"], k, own))

    def take(self, kind: int, chunk: int) -> np.ndarray:
        found = sorted(self.held.pop((kind, chunk), []), key=lambda x: x[:2])
        return np.concatenate([np.zeros(0, np.uint8), *(x[2] for x in found)])


def answered(row: dict, kind: int, flags: np.ndarray) -> dict:
    return {x: row[x] for x in ("group", "bucket", "chunks", "counts")} | {"kind": kind, "flags": zstandard.compress(flags.tobytes(), 1)}


def with_answers(table: DataFrame, *answers: DataFrame) -> DataFrame:
    """Chunks and the answers to their groups, as rows of one kind."""
    both = table.withColumn("kind", F.lit(TEXT))
    for x in answers:
        both = both.unionByName(x, allowMissingColumns=True)
    return both


def opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ptr = np.frombuffer(row["ptr"], np.int64)
    return np.frombuffer(zstandard.decompress(row["text"]), np.uint8), ptr


def squeeze(values: np.ndarray, width: int) -> bytes:
    """Byte planes of unsigned numbers, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1)[:, :width].T).tobytes(), 1)


def unsqueeze(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(U)

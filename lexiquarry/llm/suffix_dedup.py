"""Removal of later copies of long byte strings by longest previous factors.

A position goes if the 50 bytes from it also start in an earlier document, that is, if its
longest previous factor (over documents of smaller id) has 50 bytes. The text is parsed
prefix-free, as for building large suffix arrays: every 50-byte window has an anchor, the
26-gram of least hash in it, and consecutive windows with the same anchor make a phrase, so
equal windows lie at the same place of phrases with equal anchors.

1. Chunks of documents ask, for each of their distinct phrases (anchor hash, phrase hash,
   least doc_id), whether an earlier document has the phrase, and whether other phrases
   with this anchor compete with it. Phrases without either are settled. Phrases are equal
   by 104 bits of hashes.
2. Phrases with an earlier equal one go whole. The first ones of competing phrases are
   sent, once each, to the bucket of their anchor (those of anchors with very many phrases
   window by window, to buckets of the windows). There the windows' suffixes are sorted by
   their bytes, with the lengths of common prefixes of neighbours. The previous and the
   next position of a smaller document in this order give each suffix's longest previous
   factor: the greater of the two least common prefixes on the way. Those of 50 go.
3. Chunks gather the answers, cover the removed bytes and digest the rest. A document that
   is longer than a chunk is cut with 49 bytes of overlap, and its pieces are put together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .chunking import ANSWER, TEXT, Inbox, Outbox, answered, bucket_count, by_groups, chunks, group_parts, opened, squeeze, unsqueeze, with_answers
from .common import arrow_schema, by_group, materialise, packed, partitions, release

#: Bytes of a removed string, of an anchor; phrases of an anchor that are sent as windows.
LENGTH, ANCHOR, MANY = 50, 26, 512
#: Bytes of text of a chunk; its phrases take some thirty times that.
CHUNK_BYTES = 4 << 20
#: Bytes that are scanned at once, to stay in a core's cache.
SCAN_BYTES = 1 << 18
U = np.uint64
ASKED = "bucket int, group long, chunks array<bigint>, counts array<int>, anchors binary, phrases binary, docs binary"
TOLD = "bucket int, group long, chunks array<bigint>, counts array<int>, sizes binary, docs binary, text binary"
EARLIER, COMPETES, CROWDED = 1, 2, 4


class Phrases:
    """Phrases of a chunk's documents that have an id, and the distinct ones among them.

    ``start``/``last``: first and last window of a phrase; ``doc``: its document.
    ``number``: its distinct phrase, in order of (anchor, phrase hash). ``least``: the least
    doc_id with it; ``where``: one phrase of that document.
    """

    def __init__(self, row: dict, length: int = LENGTH, anchor: int = ANCHOR):
        self.data, self.ptr = opened(row)
        self.length = length
        ids = row["doc_ids"]
        self.ids = np.array([0 if x is None else x for x in ids], np.int64)
        known = np.array([x is not None for x in ids], bool)
        parts = [self._scan(i, j, length, anchor) for i, j in bs.blocks(self.ptr, SCAN_BYTES)]
        start, last, a, c = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, U if k > 1 else np.int64) for k in range(4))
        doc = np.searchsorted(self.ptr, start, "right") - 1
        use = known[doc] if len(doc) else np.zeros(0, bool)
        self.start, self.last, a, c, self.doc = start[use], last[use], a[use], c[use], doc[use]
        order = np.lexsort((self.ids[self.doc], c, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (c[order][1:] != c[order][:-1])
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.where = order[new]
        self.a, self.c, self.least = a[self.where], c[self.where], self.ids[self.doc[self.where]]

    def _scan(self, i: int, j: int, length: int, anchor: int):
        base, ptr = self.ptr[i], self.ptr[i : j + 1] - self.ptr[i]
        data = self.data[base : self.ptr[j]]
        grams = bs.gram_hashes(data, anchor)
        n, wide = len(data) - length + 1, length - anchor + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, none.astype(U), none.astype(U)
        # Hash above, position below: the least is the leftmost of least hash.
        least = (grams & ~U((1 << 28) - 1)) | np.arange(len(grams), dtype=U)
        width = 1
        while width * 2 <= wide:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: n], least[wide - width : wide - width + n])
        at = (least & U((1 << 28) - 1)).astype(np.int64)
        valid = np.zeros(n + 1, np.int8)
        size = np.diff(ptr)
        long_ = np.flatnonzero(size >= length)
        np.add.at(valid, ptr[long_], 1)
        np.add.at(valid, ptr[long_ + 1] - length + 1, -1)
        valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
        first = valid.copy()
        first[1:] &= (at[1:] != at[:-1]) | ~valid[:-1]
        cut = ptr[long_]
        first[cut] = True
        end = valid.copy()
        end[:-1] &= (at[1:] != at[:-1]) | ~valid[1:]
        end[ptr[long_ + 1] - length] = True
        start, last = np.flatnonzero(first), np.flatnonzero(end)
        return start + base, last + base, bs.mix(grams[at[start]] + U(1)) >> U(24), bs.word_hashes(data, start, last + length)


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(keys, (np.arange(buckets + 1) * (1 << 40) // buckets).astype(U))


def ask_phrases(table: DataFrame, buckets: int, length: int, anchor: int) -> DataFrame:
    """Messages with the distinct phrases of each chunk, by ranges of anchor hashes."""
    schema = arrow_schema(table.sparkSession, ASKED)

    def fill(box: Outbox, row: dict) -> None:
        p = Phrases(row, length, anchor)
        cut = _buckets(p.a, buckets)
        box.add(row["chunk"], cut, np.diff(cut), a=p.a, c=p.c, d=p.least)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for head, x in by_groups((row for batch in batches for row in batch.to_pylist()), fill):
            # Chunk by chunk in order of anchors: wrapping differences.
            yield head | {"anchors": squeeze(np.diff(x["a"], prepend=U(0)), 8), "phrases": x["c"].tobytes(), "docs": squeeze(x["d"].view(U), 8)}

    return table.select("group", "chunk", "doc_ids", "ptr", "text").mapInArrow(lambda b: packed(rows(b), schema, 256), ASKED)


def _judge_phrases(rows: list[dict], many: int) -> Iterator[dict]:
    """For each phrase asked: does an earlier document have it; do others compete."""
    a = [np.cumsum(unsqueeze(r["anchors"], 8), dtype=U) for r in rows]
    sizes = [len(x) for x in a]
    a = np.concatenate(a)
    c = np.frombuffer(b"".join(r["phrases"] for r in rows), U)
    doc = np.concatenate([unsqueeze(r["docs"], 8).view(np.int64) for r in rows])
    order = np.lexsort((doc, c, a))
    a, c, d = a[order], c[order], doc[order]
    new_a = np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new = new_a.copy()
    new[1:] |= c[1:] != c[:-1]
    least = d[new][np.cumsum(new) - 1]  # of the phrase
    group = np.cumsum(new_a) - 1
    at = np.flatnonzero(new_a)
    phrases = np.add.reduceat(new.astype(np.int64), at)
    apart = np.minimum.reduceat(least, at) < np.maximum.reduceat(least, at)
    flags = np.where(d > least, EARLIER, 0) + np.where(apart[group], COMPETES, 0) + np.where(phrases[group] > many, CROWDED, 0)
    back = np.empty(len(order), np.uint8)
    back[order] = flags
    for r, own in zip(rows, np.split(back, np.cumsum(sizes)[:-1])):
        yield answered(r, 1, own)


class Told:
    """What a chunk tells: windows of its competing phrases that no earlier phrase settles.

    ``start``/``size``: first window and number of windows of a context; ``doc``: doc_id;
    ``bucket``. Contexts of crowded anchors have one window, the first of equal ones;
    ``same`` has, for every such window, the context that stands for it.
    """

    def __init__(self, p: Phrases, flags: np.ndarray, buckets: int):
        ask = (flags & COMPETES > 0) & (flags & EARLIER == 0)
        crowded = ask & (flags & CROWDED > 0)
        plain = np.flatnonzero(ask & ~crowded)
        at = p.where[plain]
        start, size, doc = p.start[at], p.last[at] - p.start[at] + 1, p.least[plain]
        bucket = (p.a[plain] * U(buckets) >> U(40)).astype(np.int64)
        at = p.where[np.flatnonzero(crowded)]
        n = p.last[at] - p.start[at] + 1
        window = np.repeat(p.start[at] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        owner = np.repeat(p.ids[p.doc[at]], n)
        h = bs.word_hashes(p.data, window, window + p.length) if len(window) else np.zeros(0, U)
        order = np.lexsort((owner, h))
        new = np.ones(len(order), bool)
        new[1:] = h[order][1:] != h[order][:-1]
        self.same = np.empty(len(order), np.int64)
        self.same[order] = np.cumsum(new) - 1
        self.windows, self.owners, self.n_plain = window, owner, len(plain)
        first = order[new]
        self.start = np.concatenate([start, window[first]])
        self.size = np.concatenate([size, np.ones(len(first), np.int64)])
        self.doc = np.concatenate([doc, owner[first]])
        self.bucket = np.concatenate([bucket, ((h[first] >> U(24)) * U(buckets) >> U(40)).astype(np.int64)])
        self.order = np.argsort(self.bucket, kind="stable")
        self.cut = np.searchsorted(self.bucket[self.order], np.arange(buckets + 1))


def tell_contexts(table: DataFrame, answers: DataFrame, buckets: int, length: int, anchor: int, groups: tuple[Column, int]) -> DataFrame:
    """Bytes and documents of the competing contexts of each chunk, for the buckets."""

    def each(_, rows: Iterator[dict]) -> Iterator[dict]:
        inbox = Inbox()

        def fill(box: Outbox, row: dict) -> None:
            p = Phrases(row, length, anchor)
            told = Told(p, inbox.take(1, row["chunk"]), buckets)
            size = told.size[told.order]
            whole = size + (length - 1)
            at = np.repeat(told.start[told.order] - (np.cumsum(whole) - whole), whole) + np.arange(whole.sum())
            windows = np.concatenate([[0], np.cumsum(size)])[told.cut]
            bytes_ = np.concatenate([[0], np.cumsum(whole)])[told.cut]
            box.add(row["chunk"], told.cut, np.diff(windows), sizes=size.astype(U), docs=told.doc[told.order].view(U), text=(p.data[at], bytes_))

        def texts() -> Iterator[dict]:
            for row in rows:
                if row["kind"] == TEXT:
                    yield row
                else:
                    inbox.add(row)

        for head, x in by_groups(texts(), fill):
            yield head | {"sizes": squeeze(x["sizes"], 3), "docs": squeeze(x["docs"], 8), "text": zstandard.compress(x["text"].tobytes(), 1)}

    return by_group(with_answers(table, answers), "group", each, TOLD, groups[1], ("kind", "chunk"), groups[0])


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at ``at``, up to ``length`` bytes, in order of their bytes, and how many
    first bytes each has in common with the one before."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    keys = []
    for k in range(0, length, 8):
        word = np.zeros(len(at), U)
        for i in range(8):
            word = (word << U(8)) | (padded[at + k + i].astype(U) if k + i < length else U(0))
        keys.append(word)
    order = np.lexsort(keys[::-1])
    common = np.zeros(len(at), np.uint8)
    # Neighbours that are equal so far, and where their next eight bytes first differ.
    same = np.arange(1, len(at))
    for k, word in zip(range(0, length, 8), keys):
        differ = word[order[same]] ^ word[order[same - 1]]
        equal = np.zeros(len(same), np.uint8)
        for i in range(8):
            equal += differ < U(1 << 8 * i) if i else differ == 0
        # ``differ`` under 2**(8 i): the 8 - i leading bytes are equal.
        common[same] = np.minimum(k + equal, length)
        same = same[differ == 0]
    return order, common


def longest_previous_factors(order: np.ndarray, common: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each suffix the longest prefix that also starts a suffix of a smaller document.

    In suffix order, the longest is shared with the nearest suffix of a smaller document
    before or after. All pointers to these are found together: a pointer to a document that
    is not smaller moves on to where that one points, and what is common on the way is the
    least of both parts.
    """
    n = len(order)
    found = np.zeros(n, np.uint8)
    for ahead in (False, True):
        d, shared = doc[order], common.copy()
        if ahead:
            d, shared = d[::-1], np.concatenate([np.zeros(min(n, 1), np.uint8), common[:0:-1]])
        to = np.arange(n) - 1
        live = np.flatnonzero((to >= 0) & (d[to] >= d))
        while len(live):
            j = to[live]
            shared[live] = np.minimum(shared[live], shared[j])
            to[live] = to[j]
            k = to[live]
            live = live[(k >= 0) & (d[k] >= d[live])]
        shared[to < 0] = 0
        found = np.maximum(found, shared[::-1] if ahead else shared)
    out = np.empty(n, np.uint8)
    out[order] = found
    return out


def _judge_contexts(rows: list[dict], length: int) -> Iterator[dict]:
    sizes = [unsqueeze(r["sizes"], 3).astype(np.int64) for r in rows]
    data = np.frombuffer(b"".join(zstandard.decompress(r["text"]) for r in rows), np.uint8)
    size = np.concatenate(sizes)
    whole = size + (length - 1)
    begin = np.cumsum(whole) - whole
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    doc = np.repeat(np.concatenate([unsqueeze(r["docs"], 8).view(np.int64) for r in rows]), size)
    found = longest_previous_factors(*suffix_order(data, at, length), doc) >= length
    for r, own in zip(rows, np.split(found.astype(np.uint8), np.cumsum([x.sum() for x in sizes])[:-1])):
        yield answered(r, 2, own)


def _covered(p: Phrases, flags: np.ndarray, found: np.ndarray, buckets: int) -> np.ndarray:
    """Which bytes of the chunk go."""
    gone = np.zeros(len(p.data) + 1, np.int32)
    whole = (flags[p.number] & EARLIER > 0) | (p.ids[p.doc] > p.least[p.number])
    np.add.at(gone, p.start[whole], 1)
    np.add.at(gone, p.last[whole] + p.length, -1)
    told = Told(p, flags, buckets)
    # Answers come in order of bucket, then of contexts; spread them to the contexts.
    size = told.size[told.order]
    owner = np.repeat(told.order, size)
    offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    hit = np.zeros(len(told.size), bool)
    single = owner >= told.n_plain
    hit[owner[single]] = found[single] > 0
    # A plain context stands for all phrases of its document that equal it.
    plain = np.flatnonzero((flags & COMPETES > 0) & (flags & EARLIER == 0) & (flags & CROWDED == 0))
    first = np.concatenate([[0], np.cumsum(told.size[: told.n_plain])])
    mask = np.zeros(first[-1], bool)
    hits = (found > 0) & ~single
    mask[first[owner[hits]] + offset[hits]] = True
    place = np.full(len(flags), -1, np.int64)
    place[plain] = np.arange(len(plain))
    rest = np.flatnonzero(~whole & (place[p.number] >= 0)) if len(p.number) else np.zeros(0, np.int64)
    n = p.last[rest] - p.start[rest] + 1
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(p.start[rest], n) + step
    starts = [starts[mask[np.repeat(first[place[p.number[rest]]], n) + step]]]
    # Windows of crowded anchors: found in an earlier document, or one of the chunk.
    crowded = (flags & COMPETES > 0) & (flags & EARLIER == 0) & (flags & CROWDED > 0)
    by = told.n_plain + told.same
    bad = hit[by] | (told.owners > told.doc[by]) if len(by) else np.zeros(0, bool)
    number = np.full(len(flags), -1, np.int64)
    at = np.flatnonzero(crowded)
    number[at] = np.arange(len(at))
    n_of = p.last[p.where[at]] - p.start[p.where[at]] + 1
    first = np.concatenate([[0], np.cumsum(n_of)])
    rest = np.flatnonzero(~whole & (number[p.number] >= 0)) if len(p.number) else np.zeros(0, np.int64)
    n = p.last[rest] - p.start[rest] + 1
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    windows = np.repeat(p.start[rest], n) + step
    starts.append(windows[bad[np.repeat(first[number[p.number[rest]]], n) + step]] if len(windows) else windows)
    for s in starts:
        np.add.at(gone, s, 1)
        np.add.at(gone, s + p.length, -1)
    return np.cumsum(gone[:-1]) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(docs: DataFrame, length: int, anchor: int, many: int, schema: str, out) -> DataFrame:
    table = materialise(chunks(docs, CHUNK_BYTES, length - 1))
    buckets, groups = bucket_count(table), group_parts(table)
    first = materialise(by_group(ask_phrases(table, buckets, length, anchor), "bucket", lambda _, rows: _judge_phrases(list(rows), many), ANSWER, buckets, dealt=F.col("bucket")))
    told = tell_contexts(table, first, buckets, length, anchor, groups)
    second = by_group(told, "bucket", lambda _, rows: _judge_contexts(list(rows), length), ANSWER, buckets, dealt=F.col("bucket"))

    def each(_, rows: Iterator[dict]) -> Iterator[dict]:
        inbox = Inbox()
        for row in rows:
            if row["kind"] != TEXT:
                inbox.add(row)
                continue
            p = Phrases(row, length, anchor)
            gone = _covered(p, inbox.take(1, row["chunk"]), inbox.take(2, row["chunk"]), buckets)
            if row["whole"] is not None:
                yield {"whole": row["whole"], "part": row["part"], "doc_id": row["doc_ids"][0], "data": row["text"], "gone": zstandard.compress(np.packbits(gone).tobytes(), 1)}
                continue
            for d, doc_id in enumerate(row["doc_ids"]):
                own = slice(p.ptr[d], p.ptr[d + 1])
                yield out(doc_id, p.data[own], gone[own])

    if table.where("whole is not null").isEmpty():
        return by_group(with_answers(table, first, second), "group", each, schema, groups[1], ("kind", "chunk"), groups[0])

    def put_together(_, rows: Iterator[dict]) -> Iterator[dict]:
        """The pieces of one document, in order."""
        texts, masks, over = [], [], np.zeros(0, bool)
        for row in rows:
            data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
            gone = np.unpackbits(np.frombuffer(zstandard.decompress(row["gone"]), np.uint8), count=len(data)).astype(bool)
            gone[: len(over)] |= over
            if texts:  # the piece before has these bytes too
                texts[-1], masks[-1] = (x[-1][: len(x[-1]) - len(over)] for x in (texts, masks))
            texts.append(data)
            masks.append(gone)
            over = gone[len(gone) - (length - 1) :]
        yield out(row["doc_id"], np.concatenate(texts), np.concatenate(masks))

    pieces = f"{schema}, whole long, part int, data binary, gone binary"
    found = materialise(by_group(with_answers(table, first, second), "group", each, pieces, groups[1], ("kind", "chunk"), groups[0]))
    release(table, first)
    together = by_group(found.where("whole is not null").select("whole", "part", "doc_id", "data", "gone"), "whole", put_together, schema, partitions(docs.sparkSession), ("part",))
    return found.where("whole is null").select(*together.columns).unionByName(together)


def _digest(doc_id: int | None, data: np.ndarray, gone: np.ndarray) -> dict:
    edge = gone.copy()
    edge[1:] &= ~gone[:-1]
    return {
        "doc_id": doc_id,
        "n_bytes": len(data),
        "n_removed": int(gone.sum()),
        "n_spans": int(edge.sum()),
        "kept_sha256": hashlib.sha256(data[~gone].tobytes()).hexdigest(),
    }


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every document.

    Bytes covered by a string of ``length`` bytes (at least ``ANCHOR``) that also starts in
    a document with a smaller doc_id are removed; spans are maximal removed runs.

    Null text is empty. Rows without a doc_id are kept whole and remove nothing. Of rows
    with the same doc_id none removes from another. Repeated rows give a row each; an empty
    table gives an empty result; other columns are ignored. A text longer than a chunk goes
    through in pieces; only putting it together takes a few times its size.
    """
    return _removed(docs, length, min(ANCHOR, length), many, RESULT, _digest)


def kept_texts(docs: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """``(doc_id, text, spans)``: the text left (bytes of cut characters replaced), and the
    removed runs as start and end bytes."""

    def out(doc_id: int | None, data: np.ndarray, gone: np.ndarray) -> dict:
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
        return {"doc_id": doc_id, "text": data[~gone].tobytes().decode("utf-8", "replace"), "spans": edges.tolist()}

    return _removed(docs, length, min(ANCHOR, length), many, "doc_id long, text string, spans array<array<bigint>>", out)

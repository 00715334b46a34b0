"""Ranked lexical search over dual-sorted wavelet trees.

Documents are indexed in shards, where they are read. A shard's postings are one sequence of
document numbers (by rising doc_id): term after term, and within a term by falling impact. A
wavelet tree over the sequence halves the range of document numbers at each level and keeps
the order within it, so a term's postings are one interval in every node: sorted by impact,
and navigable by document. The first posting of an interval has the greatest impact of the
term in that range of documents; weighted and summed over a query's terms, these bound the
score of every document below the node. Levels are stored as bits, in the form of a wavelet
matrix (at each level the zeros before the ones).

A query descends best first: the node of greatest bound comes next, of equal ones that of the
least doc_id; a leaf is a document, and its bound is its score. What can't beat the k-th best
so far is never opened. A task carries the best over all its shards, so later shards open less,
and hands on k rows a query.

The impact of a posting depends on the mean length of documents, so lengths are counted in a
pass of their own before the index is built.
"""

from __future__ import annotations

import heapq
import itertools
import math
import zlib
from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, arrow_schema, materialise, packed

#: Bytes of text, and documents, of a shard; a longer document is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Bytes of query texts that are searched for in one pass over the index.
BLOCK_BYTES = 8 << 20
#: Nodes opened at once.
NODES = 48

SHARD = "n_known int, doc_ids binary, terms binary, offsets binary, levels binary, impacts binary"
#: Letters, digits and all bytes of non-ASCII characters stay, A-Z in lower case.
TERM_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split() if text else []


def counted(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms in all."""
    columns = "docs long, terms long"
    schema = arrow_schema(docs.sparkSession, columns)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sizes = [len(terms_of(x.as_py())) for batch in batches for x in batch.column(0)]
        yield {"docs": sum(map(bool, sizes)), "terms": sum(sizes)}

    found = docs.select("text").mapInArrow(lambda b: packed(rows(b), schema), columns).agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return found.docs or 0, found.terms or 0


class Builder:
    """Postings of a shard, as documents come."""

    def __init__(self, docs: int, terms: int):
        self.docs, self.terms = docs, terms
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.doc_ids: list[int | None] = []
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        found = terms_of(text)
        if not found:
            return
        tf = Counter(found)
        ids = np.fromiter(map(self.vocabulary.__getitem__, tf), np.int64, len(tf))
        n = np.fromiter(tf.values(), np.int64, len(tf))
        m = 50 + (50 * len(found) * self.docs) // self.terms
        self.doc_ids.append(doc_id)
        self.lists.append((ids, 1_000_000_000 * n // (1000 * n + 20 * m)))
        self.size += len(text)

    def row(self) -> dict:
        """Documents in order of their ids, nulls last."""
        order = sorted(range(len(self.doc_ids)), key=lambda i: (self.doc_ids[i] is None, self.doc_ids[i] or 0))
        known = [self.doc_ids[i] for i in order if self.doc_ids[i] is not None]
        names = sorted(self.vocabulary)
        rank = np.empty(len(names), np.int64)
        rank[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        term = rank[np.concatenate([self.lists[i][0] for i in order])]
        impact = np.concatenate([self.lists[i][1] for i in order])
        doc = np.repeat(np.arange(len(order)), [len(self.lists[i][0]) for i in order])
        sort = np.lexsort((doc, -impact, term))
        doc, impact = doc[sort].astype(np.int32), impact[sort].astype(np.int32)
        levels = []
        for shift in reversed(range(depth(len(order)))):
            bit = (doc >> shift & 1).astype(bool)
            levels.append(np.packbits(bit).tobytes())
            doc = np.concatenate([doc[~bit], doc[bit]])
        offsets = np.zeros(len(names) + 1, np.int32)
        np.cumsum(np.bincount(term, minlength=len(names)), out=offsets[1:])
        return {
            "n_known": len(known),
            "doc_ids": np.array(known + [0] * (len(order) - len(known)), np.int64).tobytes(),
            "terms": zlib.compress(b" ".join(names), 1),
            "offsets": offsets.tobytes(),
            "levels": b"".join(levels),
            "impacts": impact.tobytes(),
        }


def depth(docs: int) -> int:
    return max(docs - 1, 0).bit_length()


def build_index(docs: DataFrame) -> DataFrame:
    """``SHARD`` rows over all terms of all documents, written to the shared folder.

    Documents without a term (null, empty) are in no shard. Repeated rows and null ids are
    documents of their own.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    schema = arrow_schema(spark, SHARD)
    n_docs, n_terms = counted(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        shard = Builder(n_docs, n_terms)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(doc_id, text.as_py())
                if shard.size >= SHARD_BYTES or len(shard.doc_ids) >= SHARD_DOCS:
                    yield shard.row()
                    shard = Builder(n_docs, n_terms)
        if shard.doc_ids:
            yield shard.row()

    index = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: packed(rows(b), schema), SHARD))
    index._n_docs = n_docs
    return index


def document_frequencies(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of ``terms`` is; only terms and offsets of shards are read."""
    spark = index.sparkSession
    columns = "term binary, df long"
    schema = arrow_schema(spark, columns)
    asked = spark.sparkContext.broadcast(sorted(terms))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for names, offsets in zip(batch.column(0), batch.column(1)):
                at = {t: i for i, t in enumerate(zlib.decompress(names.as_py()).split(b" "))}
                sizes = np.diff(np.frombuffer(offsets.as_py(), np.int32))
                for t in asked.value:
                    if (i := at.get(t)) is not None:
                        total[t] += int(sizes[i])
        yield from ({"term": t, "df": n} for t, n in total.items())

    found = index.select("terms", "offsets").mapInArrow(lambda b: packed(rows(b), schema), columns).groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r.term): r.df for r in found.collect()}


class Shard:
    """A shard as it is searched: for each level the number of zeros before each place, and
    the impacts in that level's order."""

    def __init__(self, n_known: int, doc_ids: bytes, terms: bytes, offsets: bytes, levels: bytes, impacts: bytes):
        ids = np.frombuffer(doc_ids, np.int64).tolist()
        self.doc_ids = ids[:n_known] + [1 << 63] * (len(ids) - n_known)  # nulls come last
        self.at = {t: i for i, t in enumerate(zlib.decompress(terms).split(b" "))}
        self.offsets = np.frombuffer(offsets, np.int32)
        impact = np.frombuffer(impacts, np.int32)
        self.depth, self.n = depth(len(ids)), len(impact)
        bits = np.unpackbits(np.frombuffer(levels, np.uint8).reshape(self.depth, (self.n + 7) // 8), axis=1, count=self.n).astype(bool)
        self.zeros = np.zeros((self.depth, self.n + 1), np.int32)
        self.impacts = np.zeros((self.depth + 1, self.n + 1), np.int32)
        self.impacts[0, :-1] = impact
        for i, bit in enumerate(bits):
            np.cumsum(~bit, out=self.zeros[i, 1:])
            self.impacts[i + 1, :-1] = np.concatenate([self.impacts[i, :-1][~bit], self.impacts[i, :-1][bit]])

    def search(self, terms: list[tuple[bytes, int]], k: int, best: list[tuple[int, int]]) -> None:
        """Put the documents that belong there into ``best``: up to ``k`` of (-score, doc_id),
        sorted, of earlier shards."""
        own = [(self.at[t], w) for t, w in terms if t in self.at and w]
        if not own:
            return
        at, weight = np.array([i for i, _ in own]), np.array([w for _, w in own], np.int64)
        a, b = self.offsets[at], self.offsets[at + 1]
        order = itertools.count()
        # Key of a node: minus its bound, and the least doc_id below it.
        nodes = [(-int((weight * self.impacts[0, a]).sum()), self.doc_ids[0], next(order), 0, 0, a, b)]
        while nodes:
            opened = []
            while nodes and len(opened) < NODES:
                node = heapq.heappop(nodes)
                if len(best) == k and node[:2] >= best[-1]:
                    nodes = []
                    break
                if node[3] == self.depth:
                    insort(best, node[:2])
                    del best[k:]
                else:
                    opened.append(node)
            if opened:
                self._open(opened, weight, nodes, order, best[-1] if len(best) == k else None)

    def _open(self, opened: list[tuple], weight: np.ndarray, nodes: list[tuple], order: Iterator[int], bar: tuple[int, int] | None) -> None:
        level = np.array([x[3] for x in opened])[:, None]
        a, b = np.stack([x[5] for x in opened]), np.stack([x[6] for x in opened])
        za, zb = self.zeros[level, a], self.zeros[level, b]
        ones = self.zeros[level, self.n]
        for side, (c, d) in enumerate(((za, zb), (ones + a - za, ones + b - zb))):
            bounds = (np.where(d > c, self.impacts[level + 1, c], 0) @ weight).tolist()
            for i, bound in enumerate(bounds):
                if bound:
                    _, _, _, depth_, prefix, _, _ = opened[i]
                    prefix = 2 * prefix + side
                    key = (-bound, self.doc_ids[prefix << (self.depth - depth_ - 1)])
                    if bar is None or key < bar:
                        heapq.heappush(nodes, (*key, next(order), depth_ + 1, prefix, c[i], d[i]))


def blocks(items: DataFrame, most: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their distinct terms, in blocks of about ``most`` bytes of text."""
    held, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        held.append((r.item_id, sorted(set(terms_of(r.text)))))
        size += len(r.text or "") + 64
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(index: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of each item (a row of
    ``items (item_id, text)``) with a score above 0, all if fewer.

    Equal scores go by doc_id, nulls last. Null and empty items give no rows; repeated items
    are searched for each. An empty index gives an empty result. Long items are taken whole,
    with each of their terms once.
    """
    spark = index.sparkSession
    item = items.schema["item_id"].dataType.simpleString()
    columns = f"no long, item_id {item}, doc_id long, score long"
    schema = arrow_schema(spark, columns)
    found, first = [], 0
    for block in blocks(items, BLOCK_BYTES):
        df = document_frequencies(index, list({t for _, terms in block for t in terms}))
        weight = {t: math.floor(1000 * math.log((2 * index._n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        asked = spark.sparkContext.broadcast([(first + i, item_id, [(t, weight[t]) for t in terms if t in weight]) for i, (item_id, terms) in enumerate(block)])

        def rows(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[dict]:
            best: list[list[tuple[int, int]]] = [[] for _ in asked.value]
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = Shard(*(c[i].as_py() for c in batch.columns))
                    for (_, _, terms), own in zip(asked.value, best):
                        shard.search(terms, k, own)
            for (no, item_id, _), own in zip(asked.value, best):
                for score, doc_id in own:
                    yield {"no": no, "item_id": item_id, "doc_id": None if doc_id == 1 << 63 else doc_id, "score": -score}

        found.append(index.mapInArrow(lambda b, rows=rows: packed(rows(b), schema), columns))
        first += len(block)
    if not found:
        return spark.createDataFrame([], f"item_id {item}, rank int, doc_id long, score long")
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``search`` for ``items`` in an index of ``docs (doc_id, text)``; other columns are
    ignored."""
    return search(build_index(docs), items, k)

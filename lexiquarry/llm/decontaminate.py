"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by documents, as in search engines: a segment holds the postings of some
whole documents (positions of each benchmark term, ascending), written to the shared
folder. It is built once, for the terms of the whole benchmark; the benchmark's windows, in
blocks of bounded size, are then asked of all segments. A window of
benchmark words is looked up from its rarest term, by term counts over all segments: the
list of that term, shifted by the term's offset, is intersected with the other terms'
shifted lists until it is empty or only phrase occurrences are left. With ``slop`` a term
may stand that many words from its place (proximity matches).
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import arrow_rows, arrow_schema, broadcast_if_small, giving_back, materialise, packed

WINDOW = 13
#: Words of benchmark items that are asked at once; a longer benchmark goes in blocks.
BLOCK_WORDS = 2_000_000
#: Distinct words of a benchmark at most.
MOST_TERMS = 50_000_000
#: Windows of one rarest term that a segment is asked at once.
LIKELY = 65_536
#: Text of a segment.
SEGMENT_BYTES = 4 << 20
SEGMENT = "segment long, doc_ids array<bigint>, n_words binary, counts binary, postings binary"


def item_windows(text: str | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Windows of an item: ``window`` consecutive words, or all words if there are fewer."""
    found = bs.text_words(text, "plain")
    if not found:
        return []
    return [tuple(found[i : i + window]) for i in range(max(1, len(found) - window + 1))]


class Questions:
    """Windows of a block of benchmark items as numbers in the benchmark's vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int, vocabulary: np.ndarray, counts: np.ndarray):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item_id, text in items:
            for w in item_windows(text, window):
                owners[w].add(item_id)
        hashes = _hashes({t for win in owners for t in win})
        number = {t: int(np.searchsorted(vocabulary, h)) for t, h in hashes.items()}
        self.windows = [np.array([number[t] for t in win]) for win in owners]
        self.owners = [tuple(sorted(x)) for x in owners.values()]
        # Rarest terms first, by their counts over all segments.
        self.orders = [np.argsort(counts[w], kind="stable") for w in self.windows]
        by_width = {n: (np.flatnonzero([len(w) == n for w in self.windows])) for n in {len(w) for w in self.windows}}
        self.by_width = by_width
        self.matrix = {n: np.stack([self.windows[i] for i in at]) for n, at in by_width.items()}
        # Rows of the matrix in order of their rarest term, and these terms.
        self.rarest = {}
        for n, at in by_width.items():
            rare = np.array([self.windows[i][self.orders[i][0]] for i in at])
            rows = np.argsort(rare, kind="stable")
            self.rarest[n] = rare[rows], rows


def _hashes(terms: set[bytes]) -> dict[bytes, np.uint64]:
    listed = sorted(terms)
    if not listed:
        return {}
    data, ends = np.frombuffer(b"".join(listed), np.uint8), np.cumsum([len(t) for t in listed])
    return dict(zip(listed, bs.word_hashes(data, np.concatenate([[0], ends[:-1]]), ends)))


def benchmark_terms(benchmark: DataFrame) -> np.ndarray:
    """Sorted hashes of the distinct words of all items. A benchmark's vocabulary grows slowly
    with it; the hashes are eight bytes a word, up to ``MOST_TERMS``."""
    arrow_rows(benchmark.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ptr = bs.text_bytes(batch.column(0))
            for i, j in bs.blocks(ptr):
                text = bs.lower_ascii(data[ptr[i] : ptr[j]])
                starts, ends, _ = bs.words(text, ptr[i : j + 1] - ptr[i], bs.separators("plain"))
                yield pa.RecordBatch.from_pydict({"term": np.unique(bs.word_hashes(text, starts, ends)).view(np.int64)})

    found = benchmark.select("text").mapInArrow(rows, "term long").distinct()
    listed = [r.term for r in found.limit(MOST_TERMS + 1).toLocalIterator()]
    if len(listed) > MOST_TERMS:
        raise ValueError(f"the benchmark has over {MOST_TERMS} distinct words; ask it in parts")
    return np.unique(np.array(listed, np.int64).view(np.uint64))


def build_index(docs: DataFrame, vocabulary: np.ndarray, gap: int) -> DataFrame:
    """Segments of the positional index of ``docs`` over the terms of ``vocabulary``.

    Positions count the words of a segment; ``gap`` positions part two documents, so no
    match crosses them.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    schema = arrow_schema(spark, SEGMENT)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        terms, sep, segment = shared.value, bs.separators("plain"), TaskContext.get().partitionId() << 32
        for batch in batches:
            data, ptr = bs.text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in bs.blocks(ptr, SEGMENT_BYTES):
                own = ptr[i : j + 1] - ptr[i]
                text = bs.lower_ascii(data[ptr[i] : ptr[j]])
                starts, ends, range_ = bs.words(text, own, sep)
                h = bs.word_hashes(text, starts, ends)
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == h)
                term = at[hit].astype(np.uint16 if len(terms) <= 65536 else np.int64)
                doc = np.searchsorted(range_, hit, "right") - 1
                position = (hit + doc * gap).astype(np.uint32)
                by_term = np.argsort(term, kind="stable")
                listed = np.diff(position[by_term], prepend=np.uint32(0)).astype(np.uint32)
                present, n = np.unique(term, return_counts=True)
                yield {
                    "segment": segment,
                    "doc_ids": ids[i:j],
                    "n_words": np.diff(range_).astype(np.int32).tobytes(),
                    "counts": zstandard.compress(np.stack([present, n]).astype(np.uint32).tobytes(), 1),
                    "postings": zstandard.compress(listed.view(np.uint8).reshape(-1, 4).T.tobytes(), 1),
                }
                segment += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(rows(batches), schema, 4)

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), SEGMENT)


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """Postings of each term over all segments; of ``n_terms`` terms, up to ``MOST_TERMS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                present, n = _present(blob)
                total[present] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": used.astype(np.int64), "n": total[used]})

    counts = np.zeros(n_terms, np.int64)
    for row in index.select("counts").mapInArrow(giving_back(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.term] = row.n
    return counts


def _present(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The terms that a segment has, ascending, and how often."""
    both = np.frombuffer(zstandard.decompress(blob), np.uint32).reshape(2, -1).astype(np.int64)
    return both[0], both[1]


def segment_matches(ask: Questions, present: np.ndarray, counts: np.ndarray, postings: np.ndarray, slop: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """``(window, start positions)`` of the windows that occur in a segment.

    Windows are found by their rarest term among the segment's terms, so the work follows
    the segment and what it may have, not the benchmark.
    """
    if not len(present):
        return
    ptr = np.concatenate([[0], np.cumsum(counts)])
    for width, at in ask.by_width.items():
        rare, rows = ask.rarest[width]
        low, high = np.searchsorted(rare, present, "left"), np.searchsorted(rare, present, "right")
        n = high - low
        likely = rows[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        # A few windows at a time: those with a common rarest term may be many.
        for first in range(0, len(likely), LIKELY):
            some = likely[first : first + LIKELY]
            place = np.minimum(np.searchsorted(present, ask.matrix[width][some]), len(present) - 1)
            whole = (present[place] == ask.matrix[width][some]).all(axis=1)
            for w, terms in zip(at[some[whole]].tolist(), place[whole]):
                order = ask.orders[w]
                offset = int(order[0])
                t = terms[offset]
                start = postings[ptr[t] : ptr[t + 1]] - offset
                for offset in order[1:]:
                    t = terms[offset]
                    listed = postings[ptr[t] : ptr[t + 1]]
                    i = np.searchsorted(listed, start + (offset - slop))
                    start = start[(i < len(listed)) & (listed[np.minimum(i, len(listed) - 1)] <= start + (offset + slop))]
                    if not len(start):
                        break
                if len(start):
                    yield w, start


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words by document, terms, their counts and positions of a stored segment."""
    n_words = np.frombuffer(row["n_words"], np.int32)
    present, counts = _present(row["counts"])
    planes = np.frombuffer(zstandard.decompress(row["postings"]), np.uint8).reshape(4, -1)
    deltas = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint32)
    return n_words, present, counts, np.cumsum(deltas, dtype=np.uint32).astype(np.int64)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks of at most ``BLOCK_WORDS`` words, or one longer item."""
    held, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), "text").toLocalIterator():
        held.append((row.id, row.text))
        size += len(row.text or "") // 4
        if size >= BLOCK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _asked(docs: DataFrame, benchmark: DataFrame, window: int, slop: int) -> tuple[DataFrame, Iterator[Questions], int]:
    """The index, the blocks of questions (one at a time) and the gap between documents."""
    gap = window + slop + 1
    vocabulary = benchmark_terms(benchmark)
    vocabulary = vocabulary if len(vocabulary) else np.zeros(1, np.uint64)
    index = materialise(build_index(docs, vocabulary, gap))
    counts = term_counts(index, len(vocabulary))
    return index, (Questions(items, window, vocabulary, counts) for items in _blocks(benchmark)), gap


def _each_block(index: DataFrame, asked: Iterator[Questions], answer, schema: str) -> DataFrame:
    """``answer(row, questions)`` over all segments, block by block. With several blocks
    each one's answers are written before the next is read, so the driver holds one."""
    spark, fields = index.sparkSession, arrow_schema(index.sparkSession, schema)

    def part(ask: Questions):
        shared = spark.sparkContext.broadcast(ask)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from packed((x for batch in batches for row in batch.to_pylist() for x in answer(row, shared.value)), fields)

        return index.mapInArrow(giving_back(run), schema), shared

    first = next(asked, None)
    if first is None:
        first = Questions([], 1, np.zeros(1, np.uint64), np.zeros(1, np.int64))
    second = next(asked, None)
    if second is None:
        return part(first)[0]
    out: DataFrame | None = None
    for ask in itertools.chain([first, second], asked):
        found, shared = part(ask)
        found = materialise(found)
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """All occurrences of benchmark windows: ``(doc_id, item_id, start, n)`` by words.

    ``slop`` 0 gives exact phrases. Else these are proximity matches: at each place of the
    window's rarest word (by all documents; the first of equally rare ones), every other
    word must stand up to ``slop`` words from its own place. ``start`` is where the window
    starts if the rarest word is in place; it can lie before the document.
    ``item_id`` is a string, ``null`` for none.

    Null and empty texts match nothing; items without words ask nothing. Long texts go whole:
    a document is in one segment, which may be larger than ``SEGMENT_BYTES``. Repeated rows
    give their matches each, items with equal id and windows one. Empty tables give an empty
    result; other columns are ignored.
    """
    index, asked, gap = _asked(docs, benchmark, window, slop)

    def answer(row: dict, ask: Questions) -> Iterator[dict]:
        n_words, present, counts, postings = _open(row)
        base = np.concatenate([[0], np.cumsum(n_words.astype(np.int64) + gap)])
        for w, starts in segment_matches(ask, present, counts, postings, slop):
            # The rarest word is inside the document, whatever the start.
            of = np.searchsorted(base, starts + int(ask.orders[w][0]), "right") - 1
            for s, d in zip(starts.tolist(), of.tolist()):
                for item in ask.owners[w]:
                    yield {"doc_id": row["doc_ids"][d], "item_id": item, "start": s - int(base[d]), "n": len(ask.windows[w])}

    return _each_block(index, asked, answer, "doc_id long, item_id string, start long, n int")


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, parts: int = 20) -> DataFrame:
    """Per document ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased.
    A word inside any occurrence of a benchmark window is hit; ``items_sha256`` digests the
    ids of the items with occurring windows, sorted as strings and comma-joined;
    contaminated documents have a hit and ``parts * n_hit >= n_words``.

    Null and empty texts have no words; long texts go whole, a document is in one segment;
    items without words ask nothing; a null item_id
    reads ``null`` and rows with equal item_id are one item. Every row of ``docs`` gives a
    row, repeated ids too; empty tables give empty results or no hits; other columns are
    ignored.
    """
    index, asked, gap = _asked(docs, benchmark, window, 0)
    first = next(asked, None)
    second = next(asked, None)
    asked = itertools.chain((x for x in (first, second) if x is not None), asked)
    if second is None:
        return _judged(index, asked, gap, parts)
    return _judged_in_blocks(index, asked, gap, parts)


def _hits(row: dict, ask: Questions, gap: int) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Of a segment: words by document, coverage by position, item ids by document."""
    n_words, present, counts, postings = _open(row)
    base = np.concatenate([[0], np.cumsum(n_words.astype(np.int64) + gap)])
    edge = np.zeros(base[-1] + 1, np.int32)
    items: dict[int, set[str]] = defaultdict(set)
    for w, starts in segment_matches(ask, present, counts, postings):
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + len(ask.windows[w]), -1)
        for d in np.unique(np.searchsorted(base, starts, "right") - 1).tolist():
            items[d].update(ask.owners[w])
    return n_words, np.cumsum(edge) > 0, items


def _verdict(doc_id: int | None, n_words: int, n_hit: int, items: set[str], parts: int) -> dict:
    return {
        "doc_id": doc_id,
        "n_words": n_words,
        "n_hit": n_hit,
        "n_items": len(items),
        "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
        "contaminated": n_hit > 0 and parts * n_hit >= n_words,
    }


def _judged(index: DataFrame, asked: Iterator[Questions], gap: int, parts: int) -> DataFrame:
    def answer(row: dict, ask: Questions) -> Iterator[dict]:
        n_words, covered, items = _hits(row, ask, gap)
        base = np.concatenate([[0], np.cumsum(n_words.astype(np.int64) + gap)])
        sums = np.concatenate([[0], np.cumsum(covered)])
        n_hit = sums[base[1:]] - sums[base[:-1]]
        for d, doc_id in enumerate(row["doc_ids"]):
            yield _verdict(doc_id, int(n_words[d]), int(n_hit[d]), items.get(d, set()), parts)

    return _each_block(index, asked, answer, RESULT)


def _judged_in_blocks(index: DataFrame, asked: Iterator[Questions], gap: int, parts: int) -> DataFrame:
    """With several blocks of items: documents without a hit are settled by the index; hits
    of the others meet, packed, under their number, segment and place."""
    kind = "segment long, place int, covered binary, items array<string>"

    def answer(row: dict, ask: Questions) -> Iterator[dict]:
        n_words, covered, items = _hits(row, ask, gap)
        base = np.concatenate([[0], np.cumsum(n_words.astype(np.int64) + gap)])
        for d in sorted(items):
            own = np.packbits(covered[base[d] : base[d] + n_words[d]]).tobytes()
            yield {"segment": row["segment"], "place": d, "covered": own, "items": sorted(items[d])}

    out = _each_block(index, asked, answer, kind)
    hit = out.groupBy("segment", "place").agg(F.collect_list("covered").alias("covers"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("ids"))
    words = "segment long, place int, doc_id long, n_words long"
    schema, final = arrow_schema(index.sparkSession, words), arrow_schema(index.sparkSession, RESULT)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                for d, (doc_id, n) in enumerate(zip(row["doc_ids"], np.frombuffer(row["n_words"], np.int32).tolist())):
                    yield {"segment": row["segment"], "place": d, "doc_id": doc_id, "n_words": n}

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                bits = [np.frombuffer(x, np.uint8) for x in row["covers"] or ()]
                covered = np.bitwise_or.reduce(bits) if bits else np.zeros(0, np.uint8)
                yield _verdict(row["doc_id"], row["n_words"], int(np.unpackbits(covered).sum()), set(row["ids"] or ()), parts)

    docs = index.select("segment", "doc_ids", "n_words").mapInArrow(lambda b: packed(listed(b), schema), words)
    return docs.join(hit, ["segment", "place"], "left").select("doc_id", "n_words", "covers", "ids").mapInArrow(lambda b: packed(merged(b), final), RESULT)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, parts: int = 20) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not of a contaminated document.

    Rows without a doc_id can't be told apart and stay. Null and empty texts are clean. Of
    repeated ids all rows go if one is contaminated; else all stay. Empty tables give an
    empty result, or all rows; columns stay as they are, whatever their names.
    """
    judged = decontaminate(docs, benchmark, window, parts)
    bad = judged.where("contaminated and doc_id is not null").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(broadcast_if_small(materialise(bad)), F.col("doc_id") == F.col("__bad"), "left_anti")

"""Periodic runs of words by comparing a document with all its shifts.

A run is a stretch of words with a smallest period q, at least ``exponent`` periods and
``least`` words long, that can't be made longer. Words are numbered, and the array of numbers
is compared with itself shifted by each lag up to n / exponent; stretches of equal words that
are long enough are runs of that lag. A stretch of lag p holds ``exponent - 1`` successive
multiples of p, so a shift is compared at multiples of its lag first, for many lags at once,
and at every word only if it has so many equal ones in a row: about n log n comparisons
instead of n squared, with the same result.

Long documents are dealt as ranges of lags, each of about the same number of comparisons, to
different tasks; short ones are scanned where they are read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, arrow_schema, materialise, packed, partitions

#: Characters from which a document's lags are dealt to several tasks.
LONG_CHARS = 1 << 16
#: Comparisons for a range of lags, and ranges of a document at most (longer documents have
#: longer ranges).
RANGE_POINTS, MOST_RANGES = 1 << 16, 32
#: Comparisons made in one go.
BLOCK_POINTS = 1 << 20

Run = tuple[int, int, int]  # start, length, period
Edit = Callable[[list[bytes], object], list[bytes]]


def words_of(text: str | None) -> list[bytes]:
    """Maximal stretches without the six ASCII white-space characters."""
    return text.encode().split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def lag_ranges(n: int, exponent: int = 4) -> list[tuple[int, int]]:
    """Half-open ranges that cover the lags of ``n`` words. A lag p takes n / p comparisons,
    so borders in geometric progression give ranges of equal cost."""
    top = n // exponent
    if top < 1:
        return []
    many = min(max(math.ceil(n * (math.log(top) + 1) / RANGE_POINTS), 1), MOST_RANGES)
    borders = sorted({1, *(round((top + 1) ** (j / many)) for j in range(1, many)), top + 1})
    return list(zip(borders, borders[1:]))


def suspects(ids: np.ndarray, low: int, high: int, exponent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Lags from ``low`` to ``high - 1``, rising, with the multiples g of the lag p where the
    words g, g + p, ..., g + (exponent - 1) p are equal; lags without one are left out."""
    lags = np.arange(low, high, dtype=np.int64)
    counts = (len(ids) - 1) // lags - (exponent - 2)
    lags, counts = lags[counts > 0], counts[counts > 0]
    block = (np.cumsum(counts) - 1) // BLOCK_POINTS
    for at in np.split(np.arange(len(lags)), np.flatnonzero(np.diff(block)) + 1):
        c = counts[at]
        lag = np.repeat(lags[at], c)
        place = (np.arange(len(lag)) - np.repeat(np.cumsum(c) - c, c)) * lag
        for j in range(1, exponent):
            same = ids[place] == ids[place + j * lag]
            lag, place = lag[same], place[same]
        if len(lag):
            cuts = np.flatnonzero(np.diff(lag)) + 1
            yield from zip(lag[np.r_[0, cuts]].tolist(), np.split(place, cuts))


def stretches(ids: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words equal to the word ``lag`` further on."""
    same = np.zeros(len(ids) - lag + 2, np.int8)
    same[1:-1] = ids[:-lag] == ids[lag:]
    edges = np.flatnonzero(np.diff(same))
    return edges[::2], edges[1::2]


def smallest_period(block: np.ndarray, period: int) -> int:
    """Of two periods of words: the smallest period that divides ``period``."""
    rest, f = period, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        while rest % f == 0:
            rest //= f
            if np.array_equal(block[: -(period // f)], block[period // f :]):
                period //= f
        f += 1
    return period


def scan_lags(ids: np.ndarray, low: int, high: int, exponent: int = 4, least: int = 6) -> list[Run]:
    """Runs whose period is from ``low`` to ``high - 1``."""
    known: list[Run] = []  # start, end and period; those below ``low`` only save work
    for lag, places in suspects(ids, low, min(high, len(ids) // exponent + 1), exponent):
        for s, e, q in known:
            if lag % q == 0:  # within a run, its multiples are periods too, and not the smallest
                places = places[(places < s) | (places + (exponent - 1) * lag >= e)]
        if not len(places):
            continue
        starts, ends = stretches(ids, lag)
        enough = ends - starts >= max((exponent - 1) * lag, least - lag)
        for s, e in zip(starts[enough].tolist(), (ends[enough] + lag).tolist()):
            q = smallest_period(ids[s : s + 2 * lag], lag)
            if q == lag:
                known.append((s, e, lag))
            elif q < low:
                a, b = stretches(ids, q)
                i = int(np.searchsorted(a, s, "right")) - 1
                known.append((int(a[i]), int(b[i]) + q, q))
    return [(s, e - s, q) for s, e, q in known if q >= low]


def runs_of(ids: np.ndarray, exponent: int = 4, least: int = 6) -> list[Run]:
    """All runs, by start and period."""
    return sorted(scan_lags(ids, 1, len(ids) // exponent + 1, exponent, least), key=lambda r: (r[0], r[2]))


def best_run(runs: list[Run]) -> Run | None:
    """The run of most periods; then of least start, then of least period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words outside runs or within the first period of each run that they are in."""
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [w for w, out in zip(words, gone.tolist()) if not out]


def _per_document(docs: DataFrame, finish: Callable[[list[bytes], list[Run]], dict], result: str, exponent: int, least: int, edit: Edit | None) -> DataFrame:
    """``finish(words, runs)`` with doc_id, for every document."""
    spark = docs.sparkSession
    arrow_rows(spark)
    schema = arrow_schema(spark, result)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) >= LONG_CHARS

    def words_in(doc_id: object, text: str | None) -> list[bytes]:
        found = words_of(text)
        return edit(found, doc_id) if edit else found

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_in(doc_id, text.as_py())
                yield {"doc_id": doc_id} | finish(words, runs_of(numbered(words), exponent, least))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = numbered(words_in(doc_id, text.as_py()))
                words = zlib.compress(ids.tobytes(), 1)
                for low, high in lag_ranges(len(ids), exponent):
                    yield {"row": row, "low": low, "high": high, "words": words}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row, low, high, words in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                for start, length, period in scan_lags(np.frombuffer(zlib.decompress(words.as_py()), np.int32), low, high, exponent, least):
                    yield {"row": row, "start": start, "length": length, "period": period}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for doc_id, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                found = sorted(((r["start"], r["length"], r["period"]) for r in runs.as_py() or ()), key=lambda r: (r[0], r[2]))
                yield {"doc_id": doc_id} | finish(words_in(doc_id, text.as_py()), found)

    task, run = "row long, low long, high long, words binary", "row long, start long, length long, period long"
    tasks, found = arrow_schema(spark, task), arrow_schema(spark, run)
    short = docs.where(~is_long).mapInArrow(lambda b: packed(whole(b), schema), result)
    rows = materialise(docs.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    ranges = rows.mapInArrow(lambda b: packed(dealt(b), tasks, many=64), task).repartition(partitions(spark), "row", "low")
    runs = ranges.mapInArrow(lambda b: packed(scanned(b), found), run).groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    long_ = rows.join(runs, "row", "left").select("doc_id", "text", "runs").mapInArrow(lambda b: packed(joined(b), schema), result)
    return short.unionByName(long_)


def find_runs(docs: DataFrame, exponent: int = 4, least: int = 6, edit: Edit | None = None) -> DataFrame:
    """``(doc_id, runs)``: the runs of every document as an array of (start, length, period),
    by start and period; starts are word numbers from 0.

    Null and empty texts have no words and no runs. Repeated rows and null ids give a row
    each; an empty table gives an empty result; other columns are ignored. Texts are taken
    whole, whatever their length. ``edit(words, doc_id)`` may change the words first.
    """
    runs = lambda _, runs: {"runs": [{"start": s, "length": n, "period": q} for s, n, q in runs]}
    return _per_document(docs, runs, "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>", exponent, least, edit)


def collapse_runs(docs: DataFrame, exponent: int = 4, least: int = 6, edit: Edit | None = None) -> DataFrame:
    """``(doc_id, text)``: every document's words, parted by single spaces, without those that
    repeat an earlier period of a run; nulls become empty. Other cases as in ``find_runs``."""
    text = lambda words, runs: {"text": b" ".join(collapsed(words, runs)).decode()}
    return _per_document(docs, text, "doc_id long, text string", exponent, least, edit)


def digest_runs(docs: DataFrame, exponent: int = 4, least: int = 6, edit: Edit | None = None) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256)``: how many runs a document has, the run of most periods (of equal
    ones that of least start, then of least period; nulls without a run), and digests of all
    runs and of the collapsed text. Other cases as in ``find_runs``."""

    def digest(words: list[bytes], runs: list[Run]) -> dict:
        start, length, period = best_run(runs) or (None, None, None)
        return {
            "n_runs": len(runs),
            "start": start,
            "length": length,
            "period": period,
            "exponent_milli": None if period is None else 1000 * length // period,
            "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
        }

    columns = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _per_document(docs, digest, columns, exponent, least, edit)


def loop_some(words: list[bytes], doc_id: object) -> list[bytes]:
    """The edit of the test query: by a hash of its id, about one document in ten repeats a
    part of its own words from some word on. Rows without an id stay as they are."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]

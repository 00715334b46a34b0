"""Periodic runs, line dedup and ranked search against brute force, with nulls, empty tables,
repeated rows, long texts and clashing column names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lexiquarry.llm import line_dedup, periodic_runs, ranked_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, line string, doc string, version string, no string, score string"


def frame(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x", "y", "z", "n", "m") for i, t in rows], DOCS)


# Periodic runs


def brute_runs(words, exponent=4, least=6):
    """Every lag by the definition, word by word."""
    n, found = len(words), set()
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, exponent * p):
                block = words[i : i + length]
                if not any(all(block[k] == block[k + q] for k in range(length - q)) for q in range(1, p)):
                    found.add((i, length, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 1)])
def test_runs_by_definition(exponent, least):
    rng = random.Random(7)
    for size in (1, 2, 3):
        for _ in range(120):
            words = [rng.choice("abc"[:size]) for _ in range(rng.randint(0, 40))]
            if len(words) > 3 and rng.random() < 0.7:
                a, p = rng.randrange(len(words)), rng.randint(1, 8)
                words = words[:a] + [words[min(a + i % p, len(words) - 1)] for i in range(rng.randint(1, 60))] + words[a:]
            ids = periodic_runs.numbered([w.encode() for w in words])
            want = brute_runs(words, exponent, least)
            assert periodic_runs.runs_of(ids, exponent, least) == want
            # Ranges of lags know nothing of each other.
            cuts = sorted({1, *(rng.randint(1, 30) for _ in range(3)), len(words) + 1})
            parts = [r for low, high in zip(cuts, cuts[1:]) for r in periodic_runs.scan_lags(ids, low, high, exponent, least)]
            assert sorted(parts, key=lambda r: (r[0], r[2])) == want


def test_smallest_period():
    for q in range(1, 13):
        for times in range(1, 9):
            block = np.tile(np.arange(q), 2 * times)
            assert periodic_runs.smallest_period(block, q * times) == q


def test_lag_ranges(monkeypatch):
    monkeypatch.setattr(periodic_runs, "RANGE_POINTS", 50)
    for n in (0, 3, 4, 7, 100, 5000):
        found = [p for low, high in periodic_runs.lag_ranges(n) for p in range(low, high)]
        assert found == list(range(1, n // 4 + 1))
    assert len(periodic_runs.lag_ranges(5000)) > 10


def run_rows():
    rng = random.Random(3)
    rows = [(None, "a b " * 9), (None, None), (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "x y x y x y x y x y x y"), (5, "a\x1cb " * 7)]
    for i in range(6, 60):
        words = [rng.choice(["uno", "dos", "Tres", "tres"]) + (str(rng.randint(0, 3)) if i % 2 else "") for _ in range(rng.randint(1, 80))]
        a, p = rng.randrange(len(words)), rng.randint(1, 6)
        rows.append((i, " ".join(words[:a] + (words[a : a + p] * 9)[: rng.randint(1, 50)] + words[a:])))
    long_ = [rng.choice(["aa", "bb", "cc"]) + str(rng.randint(0, 50)) for _ in range(3000)]
    rows += [(900, " ".join(long_[:500] + long_[500:1200] * 5 + long_[1200:])), (901, "la " * 4000), rows[8], rows[8]]
    return rows


@pytest.mark.parametrize("long_chars", [None, 1, 500])
def test_periodic_runs(spark, long_chars, monkeypatch):
    if long_chars:
        monkeypatch.setattr(periodic_runs, "LONG_CHARS", long_chars)
        monkeypatch.setattr(periodic_runs, "RANGE_POINTS", 100)
    rows = run_rows()

    def looped(doc_id, text):
        w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + math.floor((n - a) / (3 + g % 8))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        return w

    want = []
    for doc_id, text in rows:
        words = looped(doc_id, text)
        small = len(words) < 400
        runs = brute_runs(words) if small else periodic_runs.runs_of(periodic_runs.numbered([w.encode() for w in words]))
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept))))
    docs = frame(spark, rows)
    found = [tuple(r) for r in periodic_runs.digest_runs(docs, edit=periodic_runs.loop_some).collect()]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert dict(want_row[:2] for want_row in want)[900] == 1
    texts = {r.doc_id: r.text for r in periodic_runs.collapse_runs(docs).collect()}
    assert texts[901] == "la" and texts[1] == ""
    assert {r.doc_id: len(r.runs) for r in periodic_runs.find_runs(docs).collect()}[901] == 1
    assert periodic_runs.digest_runs(docs.limit(0)).count() == 0


# Line dedup


def brute_lines(rows, documents=3, chars=20):
    low = -(1 << 63)
    key = lambda line: re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line))
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(low if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        own = low if doc_id is None else doc_id
        kept = [x for x in lines if len(key(x)) < chars or len(holders[key(x)]) < documents or max(holders[key(x)]) == own]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rng = random.Random(11)
    pool = ["A line that several Documents share " + str(i) for i in range(12)] + ["größe und länge der zeile ä" + str(i) for i in range(4)] + ["short", "", "nineteen characters", "twenty characters ok", "ä" * 20, "ä" * 19, " " * 21]
    rows = []
    for i in range(120):
        lines = [rng.choice(["", "  ", "\t", "\x0b"]) + rng.choice([x, x.upper() if x.isascii() else x]) + rng.choice(["", " ", "\r"]) for x in rng.choices(pool, k=rng.randint(0, 9))]
        lines += [f"a line of its own, of document {i} only"] * rng.randint(0, 2) + ["one very common line of all the documents"] * rng.randint(0, 3)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(None, None), (None, pool[0] + "\n" + pool[1]), (500, ""), (501, "\n\n"), (502, None), rows[5], rows[5], (7, pool[3]), (None, pool[0])]
    return rows + [(999, "\n".join([pool[2], "x" * 100_000, pool[2]] * 40))]


@pytest.mark.parametrize("block,batch,documents", [(1 << 19, 10_000, 3), (25, 7, 3), (1, 1, 2), (40, 3, 5)])
def test_line_dedup(spark, block, batch, documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)
    rows = line_rows()
    docs = frame(spark, rows).repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        want = brute_lines(rows, documents)
        found = [tuple(r) for r in line_dedup.dedup_lines(docs, documents).collect()]
        assert sorted(map(str, found)) == sorted(str((*r[:3], hashlib.sha256(r[3].encode()).hexdigest())) for r in want)
        kept = line_dedup.drop_lines(docs, documents)
        assert kept.columns == docs.columns
        assert sorted(str((r.doc_id, r.text or "")) for r in kept.collect()) == sorted(str((r[0], r[3])) for r in want)
        assert sum(r.text is None for r in kept.collect()) == 2
        marked = {r.doc_id: r for r in line_dedup.keep_bitmaps(docs, documents).collect()}
        assert all(marked[r[0]].n_dropped == r[2] for r in want if r[2] and r[0] not in (None, 5, 7))
        assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


# Ranked search


def brute_search(rows, items, k):
    terms = lambda t: [] if t is None else re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows if terms(t)]
    n, total, df = len(docs), sum(d[2] for d in docs), Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, size in docs:
            m = 100 - 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def search_rows():
    rng = random.Random(4)
    words = ["the", "of", "and"] * 6 + ["Größe", "naïve", "x1", "3", "don't"] + ["w" + str(i) for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(n))
    rows = [(i * 37 % 500, text(rng.randint(1, 60))) for i in range(150)]
    same = text(12)
    rows += [(2000 + i, same) for i in range(40)] + [(None, same), (None, None), (3000, ""), (3001, "..."), rows[3], rows[3], (3002, text(20_000))]
    items = [(i, text(rng.randint(1, 25))) for i in range(12)] + [(100, same), (100, same), (101, None), (102, ""), (103, "unheard-of"), (None, "w1 w2"), (104, "the of and")]
    return rows, items


@pytest.mark.parametrize("shard_bytes,block,nodes,k", [(16 << 20, 8 << 20, 48, 50), (900, 100, 1, 5), (1, 1, 3, 50), (4000, 8 << 20, 7, 1)])
def test_ranked_search(spark, shard_bytes, block, nodes, k, monkeypatch):
    for name, value in (("SHARD_BYTES", shard_bytes), ("BLOCK_BYTES", block), ("NODES", nodes)):
        monkeypatch.setattr(ranked_search, name, value)
    rows, items = search_rows()
    queries = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    docs = frame(spark, rows)
    found = [tuple(r) for r in ranked_search.rank_documents(docs, queries, k).collect()]
    assert sorted(map(str, found)) == sorted(map(str, brute_search(rows, items, k)))
    assert ranked_search.rank_documents(docs.limit(0), queries, k).count() == 0
    assert ranked_search.rank_documents(docs, queries.limit(0), k).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_opens_few_nodes(monkeypatch):
    """Bounds cut: for the best document of many, most of the tree stays closed."""
    rng = random.Random(2)
    built = ranked_search.Builder(3000, 3000 * 20)
    for i in range(3000):
        built.add(i, " ".join("w" + str(rng.randint(0, 4000)) for _ in range(20)) + (" rare rarer" if i == 1234 else ""))
    shard = ranked_search.Shard(**built.row())
    opened = []
    real = ranked_search.Shard._open
    monkeypatch.setattr(ranked_search, "NODES", 1)
    monkeypatch.setattr(ranked_search.Shard, "_open", lambda self, nodes, *a: opened.append(len(nodes)) or real(self, nodes, *a))
    best = []
    shard.search([(b"rare", 900), (b"rarer", 900), (b"w1", 300), (b"w2", 300)], 1, best)
    assert best[0][1] == 1234 and sum(opened) < 40

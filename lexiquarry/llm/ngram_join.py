"""N-gram Jaccard join over prefix trees.

1. Documents are packed into chunks, written once. Groups of chunks ask buckets of hashes
   how many documents have each of their shingles; the answers (a logarithmic class for
   each) return in the order asked. The shingles of a set are then ordered by class and
   hash: one global order, rarest first.
2. Equal sets are one class. A set's candidates share one of its first
   ``n - ceil(s n) + 1`` shingles. Shingles of a single document are never sent, so sets
   without a possible partner end here.
3. In stars, each class is joined with the least class of each of its prefix shingles;
   then, with connected classes known, shingles that still join different components are
   joined among all their classes. A join puts the sets into a trie (split in blocks of
   bounded shingles and rows) and walks it level by level: a node's overlap with the probe is computed
   once for all sets below it, and subtrees are cut when what is left can't reach the
   overlap needed. A pair is compared only under its first common shingle.
4. Components of the links are found by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytescan as bs
from .chunking import ANSWER, CHUNK_BYTES, TEXT, Inbox, Outbox, answered, bucket_count, by_groups, chunks, group_parts, opened, squeeze, unsqueeze, with_answers
from .common import arrow_rows, arrow_schema, broadcast_if_small, by_group, giving_back, join_spread, materialise, packed, partitions, release
from .components import components

#: Shingles and sets in a block of a star, whose leader meets every block.
STAR_SHINGLES, STAR_SETS = 500_000, 256
#: The same of a join of all sets, where every set is copied for every other block.
BLOCK_SHINGLES, BLOCK_SETS = 2_000_000, 1024
U = np.uint64
ASKED = "bucket int, group long, chunks array<bigint>, counts array<int>, hashes binary, many binary"
SETS = "doc_id long, n long, hi long, lo long, prefix array<struct<c:int,token:bigint>>, shingles binary"
#: What names a class of equal sets outside of the join: its least doc_id and the set's key.
CLASS = "struct<rep:bigint,hi:bigint,lo:bigint>"
#: Ids of documents to drop that are broadcast; more are joined by a shuffle of the documents.
BROADCAST_IDS = 2_000_000
#: Bytes of sets for a task of a join.
TASK_BYTES = 4 << 20
KEY, SET = ["hi", "lo", "n"], "struct<hi:bigint,lo:bigint,n:bigint>"


def shingle_sets(data: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``(hashes, ptr)``. A text with fewer
    than ``n`` words has its whole sequence as one; one without words has none."""
    parts, sizes = [], []
    sep = bs.separators("space")
    for i, j in bs.blocks(ptr):
        text = bs.lower_ascii(data[ptr[i] : ptr[j]])
        starts, ends, of = bs.words(text, ptr[i : j + 1] - ptr[i], sep)
        word = bs.word_hashes(text, starts, ends)
        counts = np.diff(of)
        width = np.minimum(counts, n)
        grams = np.maximum(counts - n + 1, np.minimum(counts, 1))
        owner = np.repeat(np.arange(j - i), grams)
        at = np.repeat(of[:-1], grams) + (np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams))
        wide = width[owner]
        h = wide.astype(U)
        for k in range(n):
            use = wide > k
            w = word[np.minimum(at + k, max(len(word) - 1, 0))] if len(word) else h
            h = np.where(use, bs.mix(h * U(0x9E3779B97F4A7C15) + w), h)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        parts.append(h[new])
        sizes.append(np.bincount(owner[new], minlength=j - i))
    if not parts:
        return np.zeros(0, U), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def set_keys(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each set, from two sums of mixed hashes."""
    hi, lo = bs.mix(h ^ U(0xA5A5A5A5A5A5A5A5)), bs.mix(h + U(0x1234567))
    return tuple(np.diff(np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])[ptr]) for x in (hi, lo))


def _first_of_keys(hi: np.ndarray, lo: np.ndarray, ids: list) -> np.ndarray:
    """Of equal sets of a chunk, the document of least id (of repeated ids, one)."""
    rank = np.array([np.iinfo(np.int64).max if x is None else x for x in ids])
    order = np.lexsort((rank, lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    return np.sort(order[new])


def _own_terms(row: dict, n: int):
    """Sets of a chunk, which documents stand for equal ones, and their 40-bit shingles."""
    h, ptr = shingle_sets(*opened(row), n)
    hi, lo = set_keys(h, ptr)
    first = _first_of_keys(hi, lo, row["doc_ids"])
    sizes = np.diff(ptr)
    stands = np.zeros(len(sizes), bool)
    stands[first] = True
    terms, counts = np.unique(h[np.repeat(stands, sizes)] >> U(24), return_counts=True)
    return h, ptr, hi, lo, stands, terms, counts


def _bucket_of(terms: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(terms, (np.arange(buckets + 1) * (1 << 40) // buckets).astype(U))


def ask_frequencies(table: DataFrame, n: int, buckets: int) -> DataFrame:
    """Messages of the chunks to the buckets: sorted 40-bit shingles and their counts."""
    schema = arrow_schema(table.sparkSession, ASKED)

    def fill(box: Outbox, row: dict) -> None:
        *_, terms, counts = _own_terms(row, n)
        cut = _bucket_of(terms, buckets)
        box.add(row["chunk"], cut, np.diff(cut), terms=terms, many=np.minimum(counts, 1 << 24).astype(np.uint32))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for head, x in by_groups((row for batch in batches for row in batch.to_pylist()), fill):
            # Chunk by chunk in order of hashes: wrapping differences.
            yield head | {"hashes": squeeze(np.diff(x["terms"], prepend=U(0)), 8), "many": zstandard.compress(x["many"].tobytes(), 1)}

    return table.select("group", "chunk", "doc_ids", "ptr", "text").mapInArrow(lambda b: packed(rows(b), schema, 512), ASKED)


def _answers(rows: list[dict]) -> Iterator[dict]:
    terms = [np.cumsum(unsqueeze(r["hashes"], 8), dtype=U) for r in rows]
    counts = np.concatenate([np.frombuffer(zstandard.decompress(r["many"]), np.uint32) for r in rows])
    _, number = np.unique(np.concatenate(terms), return_inverse=True)
    total = np.bincount(number, counts)
    classes = np.minimum(np.ceil(np.log2(np.maximum(total, 1))), 31).astype(np.uint8)[number]
    for r, own in zip(rows, np.split(classes, np.cumsum([len(t) for t in terms])[:-1])):
        yield answered(r, 1, own)


def needed(size: int, percent: int) -> int:
    """Least overlap of a set of this size with any partner."""
    return (percent * size + 99) // 100


def ordered_sets(table: DataFrame, answers: DataFrame, n: int, percent: int) -> DataFrame:
    """A row ``SETS`` of each document. The first of equal sets of a chunk has its prefix
    shingles that other sets have too and, if there are any, all shingles in global order."""

    number, parts = group_parts(table)

    def each(_, rows: Iterator[dict]) -> Iterator[dict]:
        inbox = Inbox()
        for row in rows:
            if row["kind"] == TEXT:
                yield from sets(row, inbox.take(1, row["chunk"]))
            else:
                inbox.add(row)

    def sets(row: dict, classes: np.ndarray) -> Iterator[dict]:
        h, ptr, hi, lo, stands, terms, _ = _own_terms(row, n)
        for d, doc_id in enumerate(row["doc_ids"]):
            own = h[ptr[d] : ptr[d + 1]]
            out = {"doc_id": doc_id, "n": len(own), "hi": int(hi[d].view(np.int64)), "lo": int(lo[d].view(np.int64)), "prefix": None, "shingles": None}
            if len(own) and stands[d] and doc_id is not None:
                of = classes[np.searchsorted(terms, own >> U(24))]
                if (of > 0).any():
                    order = np.lexsort((own, of))
                    own, of = own[order], of[order]
                    first = len(own) - needed(len(own), percent) + 1
                    if (many := of[:first] > 0).any():
                        # Flipped signs: signed numbers in the order of the hashes.
                        signed = (own[:first][many] ^ U(1 << 63)).view(np.int64)
                        out["prefix"] = [{"c": c, "token": t} for c, t in zip(of[:first][many].tolist(), signed.tolist())]
                        out["shingles"] = own.tobytes() + np.bincount(of, minlength=32).astype(np.uint32).tobytes()
            yield out

    return by_group(with_answers(table, answers), "group", each, SETS, parts, ("kind", "chunk"), number)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and their classes, in global order."""
    own = np.frombuffer(blob[:-128], U)
    return own, np.repeat(np.arange(32, dtype=np.uint8), np.frombuffer(blob[-128:], np.uint32))


class Trie:
    """Prefix tree of sets in global order, kept as arrays of its levels.

    A set's path ends where no other set shares it any more; what follows is compared at
    once, when a walk gets there.
    """

    def __init__(self, sets: list[np.ndarray]):
        """``sets``: ascending ranks, distinct within a set."""
        self.sets = sets
        keys = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        shared = np.zeros(len(sets) + 1, np.int64)
        for k in range(1, len(order)):
            s, t = sets[order[k - 1]], sets[order[k]]
            m = min(len(s), len(t))
            differ = s[:m] != t[:m]
            at = int(differ.argmax()) if m else 0
            shared[k] = at if m and differ[at] else m
        path = np.zeros(max(map(len, sets), default=0), np.int64)
        depths, tokens, parents, ends, nodes = [], [], [], [], 0
        for k, i in enumerate(order):
            s, low = sets[i], int(shared[k])
            high = min(len(s), max(low, int(shared[k + 1])) + 1)
            fresh = np.arange(nodes, nodes + high - low)
            nodes += len(fresh)
            path[low:high] = fresh
            depths.append(np.arange(low, high))
            tokens.append(s[low:high])
            parents.append(path[low - 1 : high - 1].copy() if low else np.concatenate([[-1], path[: high - 1]]))
            ends.append((path[high - 1], i))
        depth, token, parent = (np.concatenate([np.array(y, np.int64) for y in x]) if x else np.zeros(0, np.int64) for x in (depths, tokens, parents))
        by_level = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[by_level], np.arange((depth.max() if len(depth) else -1) + 2))
        place = np.empty(len(depth), np.int64)
        place[by_level] = np.arange(len(depth)) - cut[depth[by_level]]
        stops: dict[int, list[tuple[int, int]]] = {}
        for node, i in ends:
            stops.setdefault(int(depth[node]), []).append((int(place[node]), i))
        self.levels = []
        for d in range(len(cut) - 1):
            at = by_level[cut[d] : cut[d + 1]]
            up = place[parent[at]] if d else np.zeros(len(at), np.int64)
            self.levels.append((token[at], up, np.array(stops.get(d, []), np.int64).reshape(-1, 2)))

    def partners(self, probe: np.ndarray, universe: int, percent: int, skip, first: int = 0) -> Iterator[int]:
        """Numbers of the sets that link with ``probe``, but those that ``skip``. Sets with a
        common shingle before rank ``first`` are another task's and are cut off."""
        inside = np.zeros(universe, np.int64)
        inside[probe] = 1
        passed = np.cumsum(inside)
        size = len(probe)
        may_miss = size - needed(size, percent)
        longest = 100 * size // percent
        may_add = longest - needed(longest, percent)
        overlap, alive = np.zeros(1, np.int64), np.ones(1, bool)
        for d, (token, up, stop) in enumerate(self.levels):
            overlap = overlap[up] + inside[token]
            # Shingles of the probe gone by without a match, and shingles here that it lacks.
            alive = alive[up] & (passed[token] - overlap <= may_miss) & (d + 1 - overlap <= may_add)
            if first:
                alive &= (overlap == 0) | (token >= first)
            if not alive.any():
                return
            for i in stop[alive[stop[:, 0]], 1].tolist() if len(stop) else ():
                other = self.sets[i]
                if percent * max(size, len(other)) <= 100 * min(size, len(other)) and not skip(i):
                    both = inside[other]
                    if not first or not both[: np.searchsorted(other, first)].any():
                        k = int(both.sum())
                        if 100 * k >= percent * (size + len(other) - k):
                            yield i


def join_task(task: str, rows: Iterable[dict], percent: int, every: bool = False) -> Iterator[dict]:
    """Links among the sets of a task ``leader:block``: of the row marked ``probe`` with the
    others. Of a task ``token:block:block``: of rows of both blocks whose first common
    shingle is the token and, but for ``every``, whose components differ and stay unlinked."""
    rows = list({r["class"]: r for r in rows}.values())
    if len(rows) < 2:
        return
    found = [unpacked(r["shingles"]) for r in rows]
    h, of = np.concatenate([x for x, _ in found]), np.concatenate([c for _, c in found])
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    rank = np.empty(len(h), np.int64)
    rank[order] = np.cumsum(new) - 1
    universe = int(new.sum())
    sets = np.split(rank, np.cumsum([len(x) for x, _ in found])[:-1])
    probes = [i for i, r in enumerate(rows) if r["probe"]]
    if probes:
        others = [i for i in range(len(rows)) if i not in probes]
        trie = Trie([sets[i] for i in others])
        for p in probes:
            for i in trie.partners(sets[p], universe, percent, lambda _: False):
                yield {"a": rows[p]["class"], "b": rows[others[i]]["class"]}
        return
    own = [r["component"] for r in rows]
    root = {x: x for x in own}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    number, one, other = task.split(":")
    token = U(int(number) % (1 << 64)) ^ U(1 << 63)
    first = int(rank[np.flatnonzero(h == token)[0]])
    trie = Trie(sets)

    def skip(p: int, i: int) -> bool:
        same_block = one != other and rows[p]["own"] == rows[i]["own"]  # that block's own task has the pair
        return i <= p or same_block or (not every and find(own[i]) == find(own[p]))

    for p, r in enumerate(rows):
        for i in trie.partners(sets[p], universe, percent, lambda i: skip(p, i), first):
            a, b = find(own[p]), find(own[i])
            root[max(a, b)] = min(a, b)
            yield {"a": r["class"], "b": rows[i]["class"]}


def _tasks(members: DataFrame, percent: int, parts: int, every: bool = False) -> DataFrame:
    """Links from rows ``(task, class, component, own, probe, shingles)``."""
    return by_group(members, "task", lambda task, rows: join_task(task, rows, percent, every), "a long, b long", parts)


def _parts(parts: int, shingles: int | None) -> int:
    """Partitions for sets of so many shingles in all."""
    return max(parts, -(-8 * (shingles or 0) // TASK_BYTES))


def _blocks(sets: Column, shingles: Column, most_sets: int, most_shingles: int) -> Column:
    return F.greatest(F.ceil(shingles / most_shingles), F.ceil(sets / most_sets))


def star_links(active: DataFrame, tokens: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links of classes with the least class of each of their prefix shingles."""
    least = tokens.groupBy("token").agg(F.min("class").alias("leader"), F.count(F.lit(1)).alias("m")).where("m > 1")
    edges = materialise(join_spread(tokens, least, ["token"], "m").where("class <> leader").select("class", "leader", "n").distinct())
    blocks = edges.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), _blocks(F.count(F.lit(1)), F.sum("n"), STAR_SETS, STAR_SHINGLES).alias("blocks"))
    task = F.concat_ws(":", "leader", "block")
    sets = active.select("class", "shingles")
    members = (
        join_spread(edges, blocks, ["leader"], "m")
        .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
        .join(sets, "class")
        .select(task.alias("task"), "class", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("own"), F.lit(False).alias("probe"), "shingles")
    )
    probes = (
        blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .join(sets.withColumnRenamed("class", "leader"), "leader")
        .select(task.alias("task"), F.col("leader").alias("class"), F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("own"), F.lit(True).alias("probe"), "shingles")
    )
    return _tasks(members.unionByName(probes), percent, _parts(parts, edges.agg(F.sum("n")).first()[0]))


def rest_links(active: DataFrame, tokens: DataFrame, known: DataFrame, percent: int, parts: int, every: bool = False) -> DataFrame | None:
    """Links between components through shingles that still join several; None if no
    shingle does. Of shingles with the same classes the first in order stands for all.
    With ``every``, all links of the classes."""
    placed = tokens.join(known.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    open_ = (
        placed.groupBy("c", "token")
        .agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"), F.bit_xor(F.xxhash64("class")).alias("sig"))
        .where("x <> y")
        .groupBy("sig", "m", "s")
        .agg(F.min(F.struct("c", "token")).alias("f"))
        .select(F.col("f.token").alias("token"), "m", "s", _blocks(F.col("m"), F.col("s"), BLOCK_SETS, BLOCK_SHINGLES).alias("blocks"))
    )
    open_ = materialise(open_)
    shingles = open_.agg(F.sum(F.col("s") * F.col("blocks"))).first()[0]
    if shingles is None:
        return None
    own = F.pmod(F.xxhash64("class"), F.col("blocks"))
    # A pair of blocks is a task; a class goes to the tasks of its block.
    members = (
        join_spread(placed, open_.drop("s"), ["token"], "m")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .join(active.select("class", "shingles"), "class")
        .select(
            F.concat_ws(":", "token", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "class", "component", "own", F.lit(False).alias("probe"), "shingles"
        )
    )
    return _tasks(members, percent, _parts(parts, shingles), every)


def join_ngrams(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, class_id, class_key)`` of every document.

    Words are parted by ASCII white space, A-Z lower-cased; a document's set has its
    distinct ``n``-word shingles (hashed to 64 bits). Two documents link if ``100 *
    intersection >= percent * union``. ``class_id`` is the least doc_id with an equal set,
    ``class_key`` tells classes apart, ``component_id`` is the least doc_id that links
    reach. ``class_links`` gives all links themselves.

    Documents without words (null, empty) are linked with nothing. Rows without a doc_id
    take no part and have no component. Every row is a document of its own: of rows with
    one doc_id and different texts each has the component that its text links to. Repeated
    rows give a row each; an empty table gives an empty result; other columns are ignored.
    A text must fit in a worker some thirty times.
    """
    sets, reps, active, tokens, parts = _prepared(docs, n, percent)
    links = materialise(star_links(active, tokens, percent, parts))
    known = materialise(components(links))
    more = rest_links(active, tokens, known, percent, parts)
    if more is not None:
        more = materialise(more)
        if not more.isEmpty():
            known = materialise(components(links.unionByName(more)))
        release(more)
    release(links)
    # Components are named by their least doc_id.
    members = known.join(active.select(F.col("class").alias("id"), "rep", *KEY), "id")
    least = members.groupBy("component").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("m"))
    named = join_spread(members, least, ["component"], "m").select(*KEY, "first")
    classes = reps.join(named, KEY, "left").select(*KEY, "m", "rep", F.coalesce("first", "rep").alias("component"))
    found = sets.where("n > 0 and doc_id is not null").select("doc_id", *KEY)
    found = join_spread(found, classes, KEY, "m").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("rep").alias("class_id"), F.struct("rep", "hi", "lo").alias("class_key")
    )
    single = sets.where("n = 0 or doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(None).cast(CLASS).alias("class_key")
    )
    return found.unionByName(single)


def _prepared(docs: DataFrame, n: int, percent: int):
    """Sets, classes, the sets that can have a partner and their prefix shingles."""
    parts = partitions(docs.sparkSession)
    table = materialise(chunks(docs, CHUNK_BYTES))
    buckets = bucket_count(table)
    answers = by_group(ask_frequencies(table, n, buckets), "bucket", lambda _, rows: _answers(list(rows)), ANSWER, buckets, dealt=F.col("bucket"))
    sets = materialise(ordered_sets(table, answers, n, percent))
    release(table)
    reps = materialise(sets.where("n > 0 and doc_id is not null").groupBy(*KEY).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")))
    # One row of each class has the shingles: the least doc_id's, once. Classes get numbers,
    # which stay, as the table is written.
    own = sets.where("shingles is not null").select(F.col("doc_id").alias("rep"), *KEY, "prefix", "shingles").join(reps.drop("m"), [*KEY, "rep"])
    active = materialise(own.dropDuplicates([*KEY, "rep"]).select(F.monotonically_increasing_id().alias("class"), "rep", *KEY, "prefix", "shingles"))
    return sets, reps, active, active.select("class", "n", F.inline("prefix")), parts


def class_links(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, and who has them.

    The first table has ``(a, b)``, a < b, for every pair of classes of equal sets that
    links, each named by its ``class_key``; the second ``(doc_id, class_key, n_links)`` for
    every document with words: the number of other documents that link with it, by equal
    or by linked sets. Nulls, empty texts and repeated rows are as in ``join_ngrams``.
    """
    sets, reps, active, tokens, parts = _prepared(docs, n, percent)
    # Every class is a component of its own, so no pair is passed over as connected.
    none = active.select(F.col("class").alias("id"), F.col("class").alias("component")).limit(0)
    found = rest_links(active, tokens, none, percent, parts, every=True)
    kind = f"a {CLASS}, b {CLASS}"
    names = active.select("class", F.struct("rep", "hi", "lo").alias("name"))
    pairs = docs.sparkSession.createDataFrame([], kind)
    if found is not None:
        found = found.join(names.select(F.col("class").alias("a"), F.col("name").alias("x")), "a").join(names.select(F.col("class").alias("b"), F.col("name").alias("y")), "b")
        pairs = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = materialise(pairs)
    sizes = reps.select(F.struct("rep", "hi", "lo").alias("name"), "m")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(sizes.withColumnRenamed("name", "b"), "b").groupBy(F.col("a").alias("name")).agg(F.sum("m").alias("far"))
    linked = reps.withColumn("name", F.struct("rep", "hi", "lo")).join(far, "name", "left")
    linked = linked.select(*KEY, "m", "name", (F.col("m") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    rows = join_spread(sets.where("n > 0 and doc_id is not null").select("doc_id", *KEY), linked, KEY, "m")
    return pairs, rows.select("doc_id", F.col("name").alias("class_key"), "n_links")


def with_keys(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` with the key of each text's set, as struct ``__set``."""
    arrow_rows(docs.sparkSession)
    at = docs.columns.index("text")
    kind = f"__set {SET}"
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(kind).fields])
    of = arrow_schema(docs.sparkSession, kind).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ptr = shingle_sets(*bs.text_bytes(batch.column(at)), n)
            found = [dict(zip(KEY, x)) for x in zip(*(k.view(np.int64).tolist() for k in set_keys(h, ptr)), np.diff(ptr).tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, of)], names=[*batch.schema.names, "__set"])

    return docs.mapInArrow(giving_back(run), schema)


def keep_firsts(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of each component. Documents without words
    and rows without a doc_id stay.

    Of rows with one doc_id and different texts, each stays whose own component starts with
    that doc_id; of those with equal sets the first text in order stays. So of repeated rows
    there is one, but for rows without a doc_id, which all stay.
    """
    judged = join_ngrams(docs, n, percent).where("doc_id is not null")
    first = F.col("doc_id") == F.col("component_id")
    by_id = judged.groupBy(F.col("doc_id").alias("__id")).agg(F.count(F.lit(1)).alias("__rows"), F.count_if(first).alias("__firsts"))
    # Few documents go, so their ids are sent to the documents, while counted to be few.
    out = materialise(by_id.where("__firsts = 0 or __rows > 1"))
    kept = docs.join(broadcast_if_small(out.select("__id"), BROADCAST_IDS), F.col("doc_id") == F.col("__id"), "left_anti")
    repeated = out.where("__rows > 1 and __firsts > 0").select("__id")
    if repeated.isEmpty():
        return kept
    # The texts of repeated ids are told apart by their sets.
    firsts = judged.where(first).select(F.col("doc_id").alias("__id"), F.col("class_key").alias("__class")).distinct()
    rows = with_keys(docs.join(repeated, F.col("doc_id") == F.col("__id"), "left_semi"), n)
    same = (F.col("__set.hi") == F.col("__class.hi")) & (F.col("__set.lo") == F.col("__class.lo"))
    own = F.when(F.col("__set.n") == 0, F.col("__class").isNull()).otherwise(same)
    rows = rows.join(firsts, (F.col("doc_id") == F.col("__id")) & own, "left_semi")
    w = Window.partitionBy("doc_id", "__set").orderBy(F.col("text").asc_nulls_first(), *(F.xxhash64(c) for c in docs.columns))
    return kept.unionByName(rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").select(*docs.columns))

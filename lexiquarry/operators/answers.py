"""Validation, aggregation, consensus and clustering of answers.

Answers are rows ``(doc, idx, text, confidence, chunk_score, u)`` with ``u`` the text's unit
vector; ``idx`` breaks ties. Similarities are a self-join of a document's answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

CLUSTER_KEYS = {
    "highest_avg_score": "average",
    "weighted_score": "weighted",
    "highest_cohesion": "cohesion",
    "largest": "size",
    "best_single": "greatest",
}


def first_by(frame: DataFrame, keys: list[str], score: Column, *ties: Column) -> DataFrame:
    """The row of greatest score of each group; the first by ``ties`` among equals."""
    w = Window.partitionBy(*keys).orderBy(score.desc(), *ties)
    return frame.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pairs(answers: DataFrame) -> DataFrame:
    """``(doc, i, j, sim, j_confidence, j_chunk_score)`` of all ordered pairs, i <> j."""
    a, b = answers.alias("a"), answers.alias("b")
    joined = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.idx") != F.col("b.idx")))
    return joined.select(
        "a.doc",
        F.col("a.idx").alias("i"),
        F.col("b.idx").alias("j"),
        V.similarity(F.col("a.u"), F.col("b.u")).alias("sim"),
        F.col("b.confidence").alias("j_confidence"),
        F.col("b.chunk_score").alias("j_chunk_score"),
    )


def in_tiles(answers: DataFrame, block: int = 1000) -> DataFrame:
    """``answers`` with ``_row``, ``_column`` and ``_side``: a document's answers are dealt to
    blocks by a hash, about ``block`` to each, and go to every tile of two blocks that has
    theirs (0: to its rows, 1: to its columns; the tiles of one block have each answer once,
    in its rows). A document of up to ``block`` answers is one tile. Tiles cost more than their
    bytes show, so the number of partitions is given, and not left to their size."""
    sized = answers.join(answers.groupBy("doc").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")), "doc")
    own = F.pmod(F.xxhash64("doc", "idx"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = sized.withColumn("_own", own).withColumn("_other", other)
    tiles = dealt.withColumns(
        {"_row": F.least("_own", "_other"), "_column": F.greatest("_own", "_other"), "_side": (F.col("_own") > F.col("_other")).cast("int")}
    ).drop("_own", "_other", "_blocks")
    return tiles.repartition(int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc", "_row", "_column")


class _Side(NamedTuple):
    """Answers in order of ``idx``: one side of a tile."""

    idx: np.ndarray
    u: np.ndarray
    w: np.ndarray


def _tile(rows: _Side, columns: _Side) -> np.ndarray:
    """The similarities of a tile; an answer and itself are never alike."""
    if not len(rows.idx) or not len(columns.idx):
        return np.zeros((len(rows.idx), len(columns.idx)))
    sim = np.round(rows.u @ columns.u.T, 9)
    if columns is rows:
        np.fill_diagonal(sim, -np.inf)
    return sim


def _over_tiles(answers: DataFrame, block: int, made: Callable[[_Side, _Side], Sequence[np.ndarray]], schema: str) -> DataFrame:
    """``doc`` and the columns that ``made`` gives for the rows and columns of each tile of
    answers ``(doc, idx, u, w)``; a tile of one block has the same object as both. A task goes
    over its tiles one after the other in sorted rows, as a frame of its own for each tile
    costs more than most of them."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, _Side]] = []  # keys and rows of the last tile, which may go on in the next batch
        found: list[list[np.ndarray]] = []

        def ended() -> None:
            keys = held[0][0][0]
            side = np.concatenate([k[:, 3] for k, _ in held])
            whole = _Side(*(np.concatenate(x) for x in zip(*(part for _, part in held))))
            rows = whole if keys[1] == keys[2] else _Side(*(x[side == 0] for x in whole))
            made_of = made(rows, rows if keys[1] == keys[2] else _Side(*(x[side == 1] for x in whole)))
            found.append([np.full(len(made_of[0]), keys[0]), *made_of])
            held.clear()

        def taken() -> pa.RecordBatch:
            arrays = [pa.array(np.concatenate(x)) for x in zip(*found)]
            found.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[c].to_numpy() for c in ("doc", "_row", "_column", "_side")], axis=1)
            idx, w, u = batch["idx"].to_numpy(), batch["w"].to_numpy(), batch["u"]
            flat, at = u.flatten().to_numpy(), u.offsets.to_numpy() - u.offsets[0].as_py()
            borders = [0, *(np.flatnonzero((keys[1:, :3] != keys[:-1, :3]).any(axis=1)) + 1), len(keys)]
            for first, end in zip(borders, borders[1:]):
                if held and (held[0][0][0, :3] != keys[first, :3]).any():
                    ended()
                n = end - first
                part = flat[at[first] : at[end]]
                held.append((keys[first:end], _Side(idx[first:end], part.reshape(n, len(part) // n), w[first:end])))
            if found:
                yield taken()
        if held:
            ended()
            yield taken()

    tiles = in_tiles(answers.select(F.col("doc").cast("long"), F.col("idx").cast("long"), F.col("u").cast("array<double>"), F.col("w").cast("double")), block)
    ordered = tiles.select("doc", F.col("_row").cast("long"), F.col("_column").cast("long"), F.col("_side").cast("long"), "idx", "u", "w")
    return ordered.sortWithinPartitions("doc", "_row", "_column", "_side", "idx").mapInArrow(run, schema)


def near_pairs(answers: DataFrame, least: float, block: int = 1000) -> DataFrame:
    """``(doc, i, j, sim)`` of the pairs i < j with a similarity of ``least`` or more: tiles of
    a document's similarities, which different tasks make, so its answers may be many."""

    def made(rows: _Side, columns: _Side) -> Sequence[np.ndarray]:
        sim = _tile(rows, columns)
        a, b = np.nonzero(sim >= least)
        i, j, sim = rows.idx[a], columns.idx[b], sim[a, b]
        if columns is rows:
            once = i < j
            i, j, sim = i[once], j[once], sim[once]
        return np.minimum(i, j), np.maximum(i, j), sim

    return _over_tiles(answers.withColumn("w", F.lit(1.0)), block, made, "doc long, i long, j long, sim double")


def near_support(answers: DataFrame, least: float, weight: Column | None = None, block: int = 1000) -> DataFrame:
    """``(doc, i, s)``: of each answer with peers of a similarity of ``least`` or more their
    mean similarity, each times the peer's ``weight`` (1 without one). Tiles give sums, so no
    pairs leave them."""

    def made(rows: _Side, columns: _Side) -> Sequence[np.ndarray]:
        sim = _tile(rows, columns)
        near = sim >= least
        kept = np.where(near, sim, 0.0)
        i, n, t = rows.idx, near.sum(axis=1), kept @ columns.w
        if columns is not rows:
            i, n, t = (np.concatenate(x) for x in ((i, columns.idx), (n, near.sum(axis=0)), (t, rows.w @ kept)))
        return i[n > 0], n[n > 0], t[n > 0]

    weighed = answers.withColumn("w", F.lit(1.0) if weight is None else weight)
    return _over_tiles(weighed, block, made, "doc long, i long, n long, t double").groupBy("doc", "i").agg((F.sum("t") / F.sum("n")).alias("s"))


def validate(answers: DataFrame, references: DataFrame, strict: float = 0.9, least: float = 0.7, top_k: int = 1) -> DataFrame:
    """All answers with similarity of ``strict`` or more to the document's reference; where
    there is none, the ``top_k`` best of ``least`` or more. Adds ``similarity`` and the
    rank; ``references (doc, r)`` has unit vectors."""
    scored = answers.join(references, "doc").withColumn("similarity", V.similarity(F.col("u"), F.col("r"))).drop("r")
    w = Window.partitionBy("doc")
    ranked = scored.withColumn("place", F.row_number().over(w.orderBy(F.col("similarity").desc(), "idx"))).withColumn("best", F.max("similarity").over(w))
    sure = (F.col("best") >= strict) & (F.col("similarity") >= strict)
    rest = (F.col("best") < strict) & (F.col("similarity") >= least) & (F.col("place") <= top_k)
    return ranked.where(sure | rest).drop("best")


def near_reference(answers: DataFrame, references: DataFrame, least: float = 0.3) -> DataFrame:
    """Rows with a similarity of ``least`` or more to their document's reference, and the
    similarity; ``references (doc, r)`` has unit vectors."""
    scored = answers.join(references, "doc").withColumn("similarity", V.similarity(F.col("u"), F.col("r"))).drop("r")
    return scored.where(F.col("similarity") >= least)


def retrieve(answers: DataFrame, references: DataFrame, least: float = 0.0005, top_k: int = 100) -> DataFrame:
    """The ``top_k`` rows of a document nearest to its reference, of those with a similarity
    of ``least`` or more, with their ``place``; the first by ``idx`` among equals."""
    w = Window.partitionBy("doc").orderBy(F.col("similarity").desc(), "idx")
    return near_reference(answers, references, least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top_k)


def medoid(answers: DataFrame) -> DataFrame:
    """``(doc, idx, text, confidence, support)``: the answer most similar to all of its
    document's, itself included; the mean confidence of all; how many have its text.

    The sum of similarities to all is the similarity to the sum of all unit vectors, so no
    pairs are made. Similarities have nine places, and so have their means: where the sum
    leaves several vectors that differ by less, these are compared with each of the answers.
    """
    groups = answers.groupBy("doc").agg(F.collect_list("u").alias("us"), F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))
    near = V.bound(
        V.total(F.col("us")),
        lambda s: V.bound(F.transform("us", lambda u: V.dot(u, s) / F.col("n")), lambda x: V.bound(F.array_max(x), lambda top: F.array_distinct(F.filter("us", lambda _, i: F.get(x, i) >= top - 2e-9)))),
    )
    whole = lambda c: F.aggregate("us", F.lit(0).cast("long"), lambda t, u: t + F.round(V.dot(c, u) * 1e9).cast("long"))
    means = F.transform("near", lambda c: F.round(whole(c) / F.col("n")))
    chosen = F.when(F.size("near") == 1, F.col("near")).otherwise(V.bound(means, lambda m: V.bound(F.array_max(m), lambda top: F.filter("near", lambda _, i: F.get(m, i) == top))))
    groups = V.evaluated(groups, "near", near).select("doc", "mean_confidence", chosen.alias("chosen"))
    rows = answers.join(groups, "doc").withColumn("support", F.count(F.lit(1)).over(Window.partitionBy("doc", "text")))
    best = first_by(rows, ["doc"], F.coalesce(F.array_contains("chosen", F.col("u")), F.lit(False)), F.col("idx"))
    return best.select("doc", "idx", "text", F.round("mean_confidence", 6).alias("confidence"), "support")


def _base(score: str = "chunk_score", confidence: str = "confidence") -> Column:
    return (F.col(score) + F.col(confidence)) / 2


def _consensus(answers: DataFrame, support: DataFrame, score: Column) -> DataFrame:
    rows = answers.join(support.withColumnRenamed("i", "idx"), ["doc", "idx"], "left").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    rows = rows.withColumn("consensus_score", F.when(F.col("n") > 1, F.round(score, 9)))
    return first_by(rows, ["doc"], F.coalesce("consensus_score", F.lit(0.0)), F.col("idx")).select("doc", "idx", "text", F.round("consensus_score", 6).alias("consensus_score"))


def consensus(answers: DataFrame, chunk_weight: float = 0.6, similarity_weight: float = 0.4, least: float = 0.7) -> DataFrame:
    """Weighted sum of an answer's own score and the mean similarity of its near peers; a
    single answer is chosen without a score."""
    support = near_support(answers, least)
    return _consensus(answers, support, _base() * chunk_weight + F.coalesce("s", F.lit(0.0)) * similarity_weight)


def consensus_weighted(answers: DataFrame, chunk_weight: float = 0.6, similarity_weight: float = 0.4, least: float = 0.7) -> DataFrame:
    """As ``consensus``, with weights made to add to one and a peer's similarity times the
    peer's own score."""
    whole = chunk_weight + similarity_weight
    support = near_support(answers, least, _base())
    return _consensus(answers, support, _base() * (chunk_weight / whole) + F.coalesce("s", F.lit(0.0)) * (similarity_weight / whole))


def consensus_simple(answers: DataFrame) -> DataFrame:
    """0.7 of the own score, 0.3 of the mean over all peers of similarity times score; the
    sum over peers is the similarity to the sum of scored vectors, less the own part."""
    scored = F.transform("u", lambda x: x * F.col("_b"))
    sums = answers.withColumn("_b", _base()).withColumn("_v", scored).groupBy("doc").agg(V.total(F.collect_list("_v")).alias("v"))
    own = V.dot(F.col("u"), F.col("u")) * _base()
    support = answers.join(sums, "doc").select("doc", F.col("idx").alias("i"), (V.dot(F.col("u"), F.col("v")) - own).alias("s"))
    return _consensus(answers, support, _base() * 0.7 + F.coalesce("s", F.lit(0.0)) / (F.col("n") - 1) * 0.3)


# Clusterings of a document's answers. A document's answers are as many as its chunks; a
# matrix product in Arrow batches is the fast form for vectors of many dimensions.


def _similarities(u: pd.Series | np.ndarray) -> np.ndarray:
    m = np.array(u.tolist())
    return np.round(m @ m.T, 9)


def _clustered(answers: DataFrame, labels, of=_similarities) -> DataFrame:
    """``(doc, idx, cluster)`` by ``labels(of(u)) -> [(position, cluster)]``. A task goes over
    its documents one after the other in sorted rows, as a frame of its own for each document
    costs more than most clusterings; the number of tasks is given, and not left to bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held = None, []  # the last document, which may go on in the next batch
        found: list[tuple[int | None, int, int]] = []

        def ended() -> None:
            idx = np.concatenate([i for i, _ in held])
            found.extend((doc, idx[p], idx[c]) for p, c in labels(of(np.concatenate([u for _, u in held]))))

        def taken() -> pa.RecordBatch:
            arrays = [pa.array([row[k] for row in found], pa.int64()) for k in range(3)]
            found.clear()
            return pa.RecordBatch.from_arrays(arrays, ["doc", "idx", "cluster"])

        for batch in batches:
            docs, idx, u = batch["doc"].to_pylist(), batch["idx"].to_numpy(), batch["u"]
            flat, at = u.flatten().to_numpy(), u.offsets.to_numpy() - u.offsets[0].as_py()
            borders = [i for i in range(len(docs)) if i == 0 or docs[i] != docs[i - 1]] + [len(docs)]
            for first, end in zip(borders, borders[1:]):
                if held and docs[first] != doc:
                    ended()
                    held = []
                doc = docs[first]
                held.append((idx[first:end], flat[at[first] : at[end]].reshape(end - first, -1)))
            yield taken()
        if held:
            ended()
            yield taken()

    rows = answers.select(F.col("doc").cast("long"), F.col("idx").cast("long"), F.col("u").cast("array<double>"))
    dealt = rows.repartition(int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc").sortWithinPartitions("doc", "idx")
    return dealt.mapInArrow(run, "doc long, idx long, cluster long")


class Products:
    """The similarities of unit vectors, of which only what is asked for by rows and columns
    (``np.ix_``) is made."""

    def __init__(self, u: pd.Series | np.ndarray) -> None:
        self.m = np.array(u.tolist())

    def __len__(self) -> int:
        return len(self.m)

    def __getitem__(self, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        rows, columns = at
        return np.round(self.m[rows.ravel()] @ self.m[columns.ravel()].T, 9)


def greedy_labels(sim: np.ndarray | Products, threshold: float) -> list[tuple[int, int]]:
    """In order, an answer that is in no cluster starts one and takes all free ones at
    ``threshold`` or more to itself. A cluster's number is its first member's. A seed is
    compared with the free ones only."""
    free = np.arange(len(sim))
    out = []
    while len(free):
        seed, rest = int(free[0]), free[1:]
        near = sim[np.ix_([seed], rest)][0] >= threshold
        out += [(seed, seed), *((int(p), seed) for p in rest[near])]
        free = rest[~near]
    return out


def greedy_clusters(answers: DataFrame, threshold: float = 0.75) -> DataFrame:
    small = 256  # up to as many answers one product is quicker than a row for each seed
    return _clustered(answers, lambda sim: greedy_labels(sim, threshold), lambda u: Products(u) if len(u) > small else _similarities(u))


def agglomerative_labels(sim: np.ndarray, threshold: float = 0.5) -> list[tuple[int, int]]:
    """Average linkage on cosine distance until the nearest clusters are ``threshold`` apart.

    A chain of nearest neighbours ends in two clusters that are each other's nearest; these
    are merged, whatever their distance. Average linkage never brings a merged cluster nearer
    to a third, so the merges under the threshold are those of the plain order, at the cost of
    one row a step. Of equal distances that to the chain's own end counts, then the first.
    """
    n = len(sim)
    distance = 1.0 - sim
    np.fill_diagonal(distance, np.inf)
    sizes, label = np.ones(n), list(range(n))
    alive = np.ones(n, bool)
    members = {i: [i] for i in range(n)}
    chain: list[int] = []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            a = chain[-1]
            b = int(np.argmin(distance[a]))
            if len(chain) > 1 and distance[a, chain[-2]] <= distance[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        height = distance[a, b]
        a, b = min(a, b), max(a, b)
        if height < threshold:
            members[a] += members.pop(b)
        else:  # above the threshold clusters are only carried along
            members[n + b] = members.pop(b)
        merged = (distance[a] * sizes[a] + distance[b] * sizes[b]) / (sizes[a] + sizes[b])
        distance[a], distance[:, a] = merged, merged
        distance[b], distance[:, b] = np.inf, np.inf
        distance[a, a] = np.inf
        sizes[a] += sizes[b]
        alive[b] = False
    for group in members.values():
        for p in group:
            label[p] = min(group)
    return list(enumerate(label))


def agglomerative(answers: DataFrame, threshold: float = 0.5) -> DataFrame:
    return _clustered(answers, lambda sim: agglomerative_labels(sim, threshold))


def dbscan_labels(sim: np.ndarray | Products, eps: float = 0.5, min_samples: int = 2, block: int = 1024) -> list[tuple[int, int]]:
    """Density clusters on cosine distance; points in none are left out.
    Neighbours are counted by blocks of rows, and found again for the core points as a cluster
    grows, so memory is a block's."""
    n = len(sim)
    core, everyone = np.zeros(n, bool), np.arange(n)
    for at in range(0, n, block):
        near = 1.0 - sim[np.ix_(everyone[at : at + block], everyone)] <= eps
        near[np.arange(len(near)), np.arange(at, at + len(near))] = True
        core[at : at + block] = near.sum(axis=1) >= min_samples
    label = np.full(n, -1)
    for seed in range(n):
        if not core[seed] or label[seed] >= 0:
            continue
        label[seed] = seed
        front = np.array([seed])
        while len(front):
            free = np.flatnonzero(label < 0)
            reached = np.zeros(len(free), bool)
            for at in range(0, len(front), block):
                reached |= (1.0 - sim[np.ix_(front[at : at + block], free)] <= eps).any(axis=0)
            label[free[reached]] = seed
            front = free[reached & core[free]]
    return [(int(p), int(label[p])) for p in np.flatnonzero(label >= 0)]


def dbscan(answers: DataFrame, eps: float = 0.5, min_samples: int = 2) -> DataFrame:
    return _clustered(answers, lambda sim: dbscan_labels(sim, eps, min_samples), Products)


def percentile_labels(sim: np.ndarray, percentile: float = 75) -> list[tuple[int, int]]:
    """Groups of all answers within a percentile of the distances of a seed; groups may
    overlap, and only members of earlier groups are no seeds."""
    distance = np.round(1.0 - sim, 9)
    np.fill_diagonal(distance, 0.0)
    upper = distance[np.triu_indices(len(sim), 1)]
    bound = np.percentile(upper, percentile) if len(upper) else 0.0
    used: set[int] = set()
    out = []
    for seed in range(len(sim)):
        if seed not in used:
            members = np.flatnonzero(distance[seed] <= bound).tolist()
            out += [(p, seed) for p in members]
            used.update(members)
    return out


def percentile_groups(answers: DataFrame, percentile: float = 75) -> DataFrame:
    return _clustered(answers, lambda sim: percentile_labels(sim, percentile))


def reachability(sim: np.ndarray, min_samples: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order in which points are reached, and by place in it the distance at which a point
    is reached (infinite for the first) and the point that it is reached from (-1). The nearest
    point comes next, the first among equals; no point is nearer than the core of the other,
    the distance to its ``min_samples``-th point, itself included."""
    n = len(sim)
    distance = np.round(np.maximum(1.0 - sim, 0.0), 9)
    np.fill_diagonal(distance, 0.0)
    core = np.sort(distance, axis=1)[:, min_samples - 1] if n >= min_samples else np.full(n, np.inf)
    reach, source, done, order = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool), np.zeros(n, int)
    for k in range(n):
        free = np.flatnonzero(~done)
        p = free[np.argmin(reach[free])]
        done[p], order[k] = True, p
        offer = np.maximum(core[p], distance[p])
        better = ~done & (offer < reach)
        reach[better], source[better] = offer[better], p
    return order, reach[order], source[order]


def steep_areas(plot: np.ndarray, xi: float, min_samples: int, down: bool) -> list[tuple[int, int]]:
    """Maximal stretches ``(first, last)`` of a reachability plot that begin and end with a
    step by the share ``xi`` or more, never go the other way, and have no more than
    ``min_samples`` lesser steps in a row."""
    high, low = (plot[:-1], plot[1:]) if down else (plot[1:], plot[:-1])
    steep, along = (high > low) & (high * (1 - xi) >= low), high >= low
    areas: list[tuple[int, int]] = []
    first = last = None
    for p in range(len(steep)):
        if first is not None and (not along[p] or not steep[p] and p - last > min_samples):
            areas.append((first, last))
            first = None
        if steep[p]:
            first, last = (p if first is None else first), p
    return areas if first is None else [*areas, (first, last)]


def xi_clusters(reach: np.ndarray, order: np.ndarray, source: np.ndarray, xi: float = 0.05, min_samples: int = 2) -> list[tuple[int, int]]:
    """Clusters as places ``(first, last)`` of the order: a steep way down and a later steep
    way up, with all between them lower by the share ``xi`` than where they begin and end. The
    higher side is cut to the level of the other. Places at the end that are not reached from
    within are cut off, unless the cluster begins higher. Clusters nest; of those with one way
    up the inner come first."""
    plot = np.append(reach, np.inf)
    downs, ups = steep_areas(plot, xi, min_samples, True), steep_areas(plot, xi, min_samples, False)
    position = np.empty(len(order), int)
    position[order] = np.arange(len(order))
    came = np.where(source >= 0, position[source], -1)
    found = []
    open_ways: list[list] = []  # ways down with the greatest value since their end
    waiting, seen = list(downs), 0
    for up_first, up_last in ups:
        top = plot[seen : up_first + 1].max(initial=0.0)
        for way in open_ways:
            way[2] = max(way[2], top)
        while waiting and waiting[0][1] < up_first:
            first, last = waiting.pop(0)
            open_ways.append([first, last, plot[last + 1 : up_first + 1].max(initial=0.0)])
        open_ways = [way for way in open_ways if way[2] <= plot[way[0]] * (1 - xi)]
        seen, level = up_first + 1, plot[up_last + 1]
        for down_first, down_last, between in reversed(open_ways):
            if between > level * (1 - xi):
                continue
            start, end, begin = down_first, up_last, plot[down_first]
            if begin > level and begin * (1 - xi) >= level:
                start = down_first + int(np.flatnonzero(plot[down_first : down_last + 1] > level)[-1])
            elif level > begin and level * (1 - xi) >= begin:
                above = np.flatnonzero(plot[up_first : up_last + 1] > begin)
                end = up_first + int(above[0]) if len(above) else up_last
            while start < end and plot[start] <= plot[end] and not start <= came[end] < end:
                end -= 1
            if end - start + 1 >= max(min_samples, 2):
                found.append((start, end))
    return found


def optics_nested(sim: np.ndarray, min_samples: int = 2, xi: float = 0.05) -> list[tuple[int, int, int]]:
    """``(point, cluster, size)`` of all nested clusters, numbered from the inner ones."""
    order, reach, source = reachability(sim, min_samples)
    return [(int(p), k, end - start + 1) for k, (start, end) in enumerate(xi_clusters(reach, order, source, xi, min_samples)) for p in order[start : end + 1]]


def optics_labels(sim: np.ndarray, min_samples: int = 2, xi: float = 0.05) -> list[tuple[int, int]]:
    """The innermost clusters of the reachability plot; points in none are left out. A
    cluster's number is its least member."""
    order, reach, source = reachability(sim, min_samples)
    taken, out = np.zeros(len(order), bool), []
    for start, end in xi_clusters(reach, order, source, xi, min_samples):
        if not taken[start : end + 1].any():
            taken[start : end + 1] = True
            group = order[start : end + 1]
            out += [(int(p), int(group.min())) for p in group]
    return out


def optics(answers: DataFrame, min_samples: int = 2, xi: float = 0.05) -> DataFrame:
    return _clustered(answers, lambda sim: optics_labels(sim, min_samples, xi))


def optics_tree(answers: DataFrame, min_samples: int = 2, xi: float = 0.05) -> DataFrame:
    """``(doc, node, idx, size)``: the members of all nested clusters of a document."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        idx = frame["idx"].to_numpy()
        found = optics_nested(_similarities(frame["u"]), min_samples, xi)
        return pd.DataFrame({"doc": frame["doc"].iloc[0], "node": [k for _, k, _ in found], "idx": [idx[p] for p, _, _ in found], "size": [m for _, _, m in found]})

    return answers.select("doc", "idx", "u").groupBy("doc").applyInPandas(run, "doc long, node long, idx long, size long")


def members(answers: DataFrame, clusters: DataFrame) -> DataFrame:
    return answers.join(clusters, ["doc", "idx"])


def peer_similarity(answers: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(doc, cluster, idx, peers, total)``: each answer's similarities within its cluster."""
    a, b = members(answers, clusters).alias("a"), members(answers, clusters).alias("b")
    same = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.idx") != F.col("b.idx"))
    joined = a.join(b, same).select("a.doc", "a.cluster", "a.idx", V.similarity(F.col("a.u"), F.col("b.u")).alias("sim"))
    return joined.groupBy("doc", "cluster", "idx").agg(F.count(F.lit(1)).alias("peers"), F.sum("sim").alias("total"))


def cluster_metrics(answers: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(doc, cluster, size, average, weighted, cohesion, greatest)`` of chunk scores and
    of pairwise similarities (0 for a single answer). The sum of all pairs' similarities is
    the squared length of the sum of vectors, less the own parts."""
    u = V.dot(F.col("u"), F.col("u"))
    sizes = members(answers, clusters).withColumn("_l", u).groupBy("doc", "cluster").agg(
        F.count(F.lit(1)).alias("size"),
        F.round(F.avg("chunk_score"), 9).alias("average"),
        F.round(F.sum("chunk_score"), 9).alias("weighted"),
        F.max("chunk_score").alias("greatest"),
        V.total(F.collect_list("u")).alias("v"),
        F.sum("_l").alias("l"),
    )
    n = F.col("size")
    cohesion = F.when(n > 1, (V.dot(F.col("v"), F.col("v")) - F.col("l")) / (n * (n - 1))).otherwise(0.0)
    return sizes.select("doc", "cluster", "size", "average", "weighted", F.round(cohesion, 9).alias("cohesion"), "greatest")


def choose_cluster(metrics: DataFrame, strategy: str) -> DataFrame:
    """One cluster of each document; the first among equals. Unknown strategies weigh
    scores by size."""
    key = CLUSTER_KEYS.get(strategy, "weighted")
    return first_by(metrics, ["doc"], F.col(key), F.col("cluster"))


def select_clustered(answers: DataFrame, clusters: DataFrame, cluster_strategies: list[str], answer_strategies: list[str]) -> DataFrame:
    """The chosen answer of each document for every pair of strategies, with its cluster's
    figures. Documents with a single answer have it without figures.

    Metrics and peer similarities are computed once for all strategies.
    """
    metrics = cluster_metrics(answers, clusters)
    total = metrics.groupBy("doc").agg(F.count(F.lit(1)).alias("total_clusters"), F.sum("size").alias("n"))
    keyed = metrics.withColumn(
        "_clu", F.explode(F.array(*(F.struct(F.lit(s).alias("cluster_strategy"), F.col(CLUSTER_KEYS.get(s, "weighted")).cast("double").alias("key")) for s in cluster_strategies)))
    ).select("*", "_clu.*")
    chosen = first_by(keyed, ["doc", "cluster_strategy"], F.col("key"), F.col("cluster")).drop("_clu", "key")
    peers = peer_similarity(answers, clusters).select("doc", "idx", (F.col("total") / F.col("peers")).alias("p"))
    rows = members(answers, clusters).join(peers, ["doc", "idx"], "left").join(chosen, ["doc", "cluster"])
    peer, score = F.coalesce("p", F.lit(0.0)), F.col("chunk_score")
    scores = {"highest_chunk_score": score, "highest_similarity": peer, "combined_score": 0.5 * score + 0.5 * peer}
    rows = rows.withColumn(
        "_ans", F.explode(F.array(*(F.struct(F.lit(s).alias("answer_strategy"), F.round(scores.get(s, score), 9).alias("value")) for s in answer_strategies)))
    ).select("*", "_ans.*")
    best = first_by(rows, ["doc", "cluster_strategy", "answer_strategy"], F.col("value"), F.col("idx")).join(total, "doc")
    known = F.col("n") > 1
    return best.select(
        "doc",
        "cluster_strategy",
        "answer_strategy",
        "idx",
        "text",
        *(F.when(known, F.col(c)).alias(to) for c, to in (("size", "cluster_size"), ("total_clusters", "total_clusters"))),
        F.when(known, F.round("average", 6)).alias("cluster_average_score"),
        F.when(known, F.round("cohesion", 6)).alias("cluster_cohesion"),
    )


def representatives(answers: DataFrame, clusters: DataFrame) -> DataFrame:
    """Of each document the cluster of greatest confidence, and in it the answer nearest to
    the centroid: ``(doc, cluster, idx, text, confidence)``."""
    rows = members(answers, clusters)
    best = first_by(rows.groupBy("doc", "cluster").agg(F.max("confidence").alias("top")), ["doc"], F.col("top"), F.col("cluster"))
    rows = rows.join(best, ["doc", "cluster"])
    center = rows.select("doc", F.posexplode("u").alias("k", "x")).groupBy("doc", "k").agg(F.avg("x").alias("m"))
    apart = rows.select("doc", "idx", F.posexplode("u").alias("k", "x")).join(center, ["doc", "k"])
    apart = apart.groupBy("doc", "idx").agg(F.round(F.sqrt(F.sum(F.pow(F.col("x") - F.col("m"), 2))), 9).alias("far"))
    near = first_by(rows.join(apart, ["doc", "idx"]), ["doc"], -F.col("far"), F.col("idx"))
    return near.select("doc", "cluster", "idx", "text", F.col("top").alias("confidence"))


def rollup(answers: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(doc, cluster, size, avg_confidence, avg_chunk_score, combined_score, coherence,
    place)``: mean scores; one less the mean of the whole distance matrix; the place by
    combined score times coherence."""
    sums = peer_similarity(answers, clusters).groupBy("doc", "cluster").agg(F.sum("total").alias("t"))
    base = members(answers, clusters).groupBy("doc", "cluster").agg(
        F.count(F.lit(1)).alias("size"), F.round(F.avg("confidence"), 9).alias("avg_confidence"), F.round(F.avg("chunk_score"), 9).alias("avg_chunk_score")
    )
    n = F.col("size")
    rows = base.join(sums, ["doc", "cluster"], "left").withColumns(
        {"combined_score": F.round(F.col("avg_confidence") * F.col("avg_chunk_score"), 9), "coherence": F.round(F.when(n > 1, 1 - (n * (n - 1) - F.col("t")) / (n * n)).otherwise(1.0), 9)}
    ).drop("t")
    w = Window.partitionBy("doc").orderBy(F.round(F.col("combined_score") * F.col("coherence"), 9).desc(), "cluster")
    return rows.withColumn("place", F.row_number().over(w))


def final_best(answers: DataFrame, clusters: DataFrame) -> DataFrame:
    """The answer of greatest confidence times chunk score in the first cluster."""
    first = rollup(answers, clusters).where("place = 1").select("doc", "cluster")
    rows = members(answers, clusters).join(first, ["doc", "cluster"])
    return first_by(rows, ["doc"], F.round(F.col("confidence") * F.col("chunk_score"), 9), F.col("idx")).select("doc", "idx", "text")


def final_weighted(answers: DataFrame, clusters: DataFrame, top: int = 3) -> DataFrame:
    """Of the first clusters, the answer of greatest score times its cluster's coherence."""
    first = rollup(answers, clusters).where(F.col("place") <= top).select("doc", "cluster", "coherence", "place")
    rows = members(answers, clusters).join(first, ["doc", "cluster"])
    weight = F.round(F.col("confidence") * F.col("chunk_score") * F.col("coherence"), 9)
    return first_by(rows, ["doc"], weight, F.col("place"), F.col("idx")).select("doc", "idx", "text")


def final_ensemble(answers: DataFrame, clusters: DataFrame) -> DataFrame:
    """The text of greatest score summed over clusters, weighted by them."""
    weights = rollup(answers, clusters).select("doc", "cluster", (F.col("combined_score") * F.col("coherence")).alias("w"), "place")
    rows = members(answers, clusters).join(weights, ["doc", "cluster"])
    sums = rows.groupBy("doc", "text").agg(F.round(F.sum(F.col("w") * F.col("confidence") * F.col("chunk_score")), 9).alias("s"), F.min(F.struct("place", "idx")).alias("f"))
    return first_by(sums, ["doc"], F.col("s"), F.col("f")).select("doc", F.col("f.idx").alias("idx"), "text", F.round("s", 6).alias("score"))


def distance_percentile(answers: DataFrame, share: float = 0.75) -> DataFrame:
    """Percentile of the pairwise cosine distances of each document."""
    half = pairs(answers).where("i < j")
    return half.groupBy("doc").agg(F.round(F.percentile(1 - F.col("sim"), share), 6).alias("distance"))

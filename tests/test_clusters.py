"""Clusters by steep areas against the definition, and tiles against all pairs."""

import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiquarry.operators import answers as A


def vectors(rng, n, d=3, centres=4):
    x = rng.normal(size=(centres, d))[rng.integers(0, centres, n)] + rng.normal(scale=rng.choice([0.05, 0.2, 0.6]), size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def areas(plot, xi, most, down):
    """All stretches that satisfy the definition of a steep area, and are in no larger one."""
    n = len(plot) - 1
    before = (lambda p: (plot[p], plot[p + 1])) if down else (lambda p: (plot[p + 1], plot[p]))
    steep = [before(p)[0] > before(p)[1] and before(p)[0] * (1 - xi) >= before(p)[1] for p in range(n)]
    fits = []
    for a, b in itertools.combinations_with_replacement(range(n), 2):
        lesser = "".join("s" if steep[p] else "-" for p in range(a, b + 1))
        if steep[a] and steep[b] and all(before(p)[0] >= before(p)[1] for p in range(a, b + 1)) and "-" * (most + 1) not in lesser:
            fits.append((a, b))
    return [(a, b) for a, b in fits if not any((c, d) != (a, b) and c <= a and b <= d for c, d in fits)]


def by_definition(reach, order, source, xi, least):
    plot = np.append(reach, np.inf)
    place = {int(p): k for k, p in enumerate(order)}
    found = []
    for (us, ue), (ds, de) in itertools.product(areas(plot, xi, least, False), areas(plot, xi, least, True)):
        if de >= us or max(plot[de + 1 : us + 1]) > min(plot[ds], plot[ue + 1]) * (1 - xi):
            continue
        start, end = ds, ue
        if plot[ds] > plot[ue + 1] and plot[ds] * (1 - xi) >= plot[ue + 1]:
            start = max(x for x in range(ds, de + 1) if plot[x] > plot[ue + 1])
        elif plot[ue + 1] > plot[ds] and plot[ue + 1] * (1 - xi) >= plot[ds]:
            end = min([x for x in range(us, ue + 1) if plot[x] > plot[ds]], default=ue)
        while end > start and plot[start] <= plot[end] and int(source[end]) not in {int(p) for p in order[start:end]}:
            end -= 1
        if end - start + 1 >= least:
            found.append((start, end))
    return sorted(found)


def test_steep_areas_and_clusters():
    rng = np.random.default_rng(11)
    nested = 0
    for case in range(300):
        n, least, xi = int(rng.integers(1, 40)), int(rng.integers(2, 5)), float(rng.choice([0.02, 0.05, 0.3]))
        x = vectors(rng, n)
        if case % 3 == 0:
            x = x[rng.integers(0, n, n)]  # repeated answers
        sim = np.round(x @ x.T, 9)
        order, reach, source = A.reachability(sim, least)
        plot = np.append(reach, np.inf)
        for down in (True, False):
            assert A.steep_areas(plot, xi, least, down) == areas(plot, xi, least, down)
        found = A.xi_clusters(reach, order, source, xi, least)
        assert sorted(found) == by_definition(reach, order, source, xi, least)
        nested += len(found) > 1
        flat = A.optics_labels(sim, least, xi)
        assert len({p for p, _ in flat}) == len(flat)
    assert nested > 50


def test_reachability_is_a_walk_to_the_nearest():
    rng = np.random.default_rng(5)
    x = vectors(rng, 30)
    sim = np.round(x @ x.T, 9)
    order, reach, source = A.reachability(sim, 3)
    distance = np.round(np.maximum(1 - sim, 0), 9)
    np.fill_diagonal(distance, 0)
    core = [sorted(row)[2] for row in distance]
    for k in range(1, 30):
        offers = {q: min(max(core[p], distance[p, q]) for p in order[:k]) for q in set(range(30)) - set(order[:k].tolist())}
        assert reach[k] == min(offers.values()) == offers[order[k]]
        assert max(core[source[k]], distance[source[k], order[k]]) == reach[k]


def test_three_nested_groups():
    """Two near groups make a larger one, apart from a third."""
    angles = [0.0, 0.01, 0.021, 0.3, 0.31, 0.322, 2.0, 2.01, 2.023]
    x = np.array([[np.cos(a), np.sin(a)] for a in angles])
    sim = np.round(x @ x.T, 9)
    assert sorted(A.optics_labels(sim, 2)) == [(p, p // 3 * 3) for p in range(9)]
    sets = {}
    for p, k, _ in A.optics_nested(sim, 2):
        sets.setdefault(k, set()).add(p)
    assert {0, 1, 2, 3, 4, 5} in sets.values() and set(range(9)) in sets.values()
    assert A.optics_labels(np.ones((1, 1))) == [] and A.optics_labels(np.ones((4, 4))) == [(p, 0) for p in range(4)]


def rows_of(spark, x, doc=1):
    scores = [((k * 37) % 100 / 100, (k * 53) % 97 / 97) for k in range(len(x))]
    return [(doc, k, "t", *scores[k], [float(v) for v in x[k]]) for k in range(len(x))]


SCHEMA = "doc long, idx long, text string, confidence double, chunk_score double, u array<double>"


def test_tiles_give_all_pairs(spark):
    rng = np.random.default_rng(8)
    rows = rows_of(spark, vectors(rng, 60), 1) + rows_of(spark, vectors(rng, 1), 2) + rows_of(spark, vectors(rng, 7), 3)
    answers = spark.createDataFrame(rows, SCHEMA)
    want = {(r.doc, r.i, r.j): r.sim for r in A.pairs(answers).where("i < j and sim >= 0.6").collect()}
    base = {(r[0], r[1]): (r[3] + r[4]) / 2 for r in rows}
    for block in (1, 7, 1000):
        got = A.near_pairs(answers, 0.6, block).collect()
        assert {(r.doc, r.i, r.j): r.sim for r in got} == want and len(got) == len(want)
        support = {(r.doc, r.i): r.s for r in A.near_support(answers, 0.6, (F.col("confidence") + F.col("chunk_score")) / 2, block).collect()}
        each = {}
        for (doc, i, j), s in want.items():
            each.setdefault((doc, i), []).append(s * base[doc, j])
            each.setdefault((doc, j), []).append(s * base[doc, i])
        assert support.keys() == each.keys() and all(abs(support[k] - np.mean(v)) < 1e-9 for k, v in each.items())
    assert A.near_pairs(answers.where("doc > 9"), 0.6).count() == 0


def test_a_document_with_many_answers(spark):
    """Tiles of a part of a document's answers, and clusters without the whole matrix."""
    rng = np.random.default_rng(9)
    x = vectors(rng, 6000, 8, 300)
    answers = spark.createDataFrame(rows_of(spark, x), SCHEMA)
    found = A.near_pairs(answers, 0.999, 500)
    assert found.rdd.getNumPartitions() > 1
    assert found.count() == sum(int(np.count_nonzero(np.triu(np.round(x[a : a + 1000] @ x.T, 9) >= 0.999, a + 1))) for a in range(0, 6000, 1000))
    assert A.consensus(answers).count() == 1
    few = np.round(x[:1500] @ x[:1500].T, 9)
    lazy = _lazy(x[:1500])
    assert A.greedy_labels(lazy, 0.9) == A.greedy_labels(few, 0.9)
    assert A.dbscan_labels(lazy, 0.05, 4, 100) == A.dbscan_labels(few, 0.05, 4)
    began = time.time()
    assert len(A.greedy_labels(_lazy(x), 0.8)) == 6000 and A.dbscan_labels(_lazy(x), 0.05, 4) and time.time() - began < 60


def _lazy(x):
    return A.Products(pd.Series([v.tolist() for v in x]))


def test_medoid_by_rounded_similarities(spark):
    """Sums of similarities of nine places tell apart what the sum of vectors does not."""
    vectors = [[0, 2, 0, 1], [2, 1, 0, 0], [1, 0, 0, 2], [0, 0, 0, 2], [0, 2, 2, 1]]
    units = [[x / sum(y * y for y in v) ** 0.5 for x in v] for v in vectors]
    rows = [(7, i, str(i), 0.9, 0.0, u) for i, u in enumerate(units)] + [(8, 0, "a", 0.5, 0.0, [0.0, 0.0]), (9, 3, "x", 0.9, 0.0, None), (9, 4, "x", 0.7, 0.0, None)]
    found = A.medoid(spark.createDataFrame(rows, "doc long, idx int, text string, confidence double, chunk_score double, u array<double>")).collect()
    assert sorted((r.doc, r.idx, r.confidence, r.support) for r in found) == [(7, 2, 0.9, 1), (8, 0, 0.5, 1), (9, 3, 0.8, 2)]


def test_clusters_of_many_small_documents(spark):
    rng = random.Random(5)
    rows = [(None if d == 0 else d, 10 * i, [rng.choice([1.0, 0.6]), rng.choice([0.0, 0.8])]) for d in range(400) for i in range(rng.randint(1, 4))]
    rows += [(7000, i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(25_000)]  # more rows than an Arrow batch has
    found = A.greedy_clusters(spark.createDataFrame(rows, "doc long, idx int, u array<double>"), 0.75)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = {(7000, i, i % 2) for i in range(25_000)}
    for doc in {d for d, _, _ in rows} - {7000}:
        own = [(i, u) for d, i, u in rows if d == doc]
        want |= {(doc, own[p][0], own[c][0]) for p, c in A.greedy_labels(np.round(np.array([u for _, u in own]) @ np.array([u for _, u in own]).T, 9), 0.75)}
    assert {tuple(r) for r in found.collect()} == want


def test_tiles_in_one_pass(spark):
    """A task goes over all of its tiles: no frame is made for each document, and tiles may go
    on in the next batch."""
    rng = np.random.default_rng(3)
    rows = [(d, i, [float(x) for x in v / np.linalg.norm(v)], 0.1 * (i % 7)) for d, n in ((1, 9), (2, 1), (-3, 30), (4, 2)) for i, v in enumerate(rng.random((n, 3)))]
    answers = spark.createDataFrame(rows, "doc long, idx int, u array<double>, b double")
    expected = {}
    for d in (1, 2, -3, 4):
        own = [r for r in rows if r[0] == d]
        for _, i, u, _ in own:
            near = [(round(float(np.dot(u, v)), 9), b) for _, j, v, b in own if j != i and round(float(np.dot(u, v)), 9) >= 0.9]
            if near:
                expected[d, i] = sum(s * b for s, b in near) / len(near)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        for block in (4, 1000):
            found = A.near_support(answers, 0.9, F.col("b"), block)
            assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
            assert {(r.doc, r.i): r.s for r in found.collect()} == pytest.approx(expected)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

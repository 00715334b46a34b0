"""Average linkage by chains, the exact law of signed ranks and kernel densities, against
the definitions."""

import itertools
import math
import random
import time
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from lexiquarry.operators import answers as A
from lexiquarry.operators import results as R
from lexiquarry.operators import stats as S


def merged(sim, threshold):
    """The nearest two clusters, again and again, by the mean of all their distances."""
    groups = [[i] for i in range(len(sim))]
    while len(groups) > 1:
        apart = {(a, b): np.mean([1 - sim[p, q] for p in groups[a] for q in groups[b]]) for a, b in itertools.combinations(range(len(groups)), 2)}
        (a, b), d = min(apart.items(), key=lambda x: x[1])
        if d >= threshold:
            break
        groups[a] += groups.pop(b)
    return sorted((p, min(g)) for g in groups for p in g)


def test_average_linkage_by_chains():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 15, 25):
        for threshold in (0.1, 0.4, 0.7, 2.5):
            x = rng.normal(size=(n, 3))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            sim = x @ x.T
            assert A.agglomerative_labels(sim, threshold) == merged(sim, threshold)
    x = rng.normal(size=(2000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    began = time.time()
    assert len(A.agglomerative_labels(x @ x.T)) == 2000 and time.time() - began < 5
    # Equal answers are one cluster, whatever the order of merges.
    assert A.agglomerative_labels(np.ones((6, 6))) == [(i, 0) for i in range(6)]


def test_exact_law_of_signed_ranks(spark):
    cases = [(n, w) for n in range(1, 13) for w in {0, 1, n, n * (n + 1) // 4}]
    law = {n: [sum(s) for s in itertools.product(*((0, r) for r in range(1, n + 1)))] for n in range(1, 13)}
    rows = spark.createDataFrame([(n, float(w)) for n, w in cases], "n long, w double")
    for r in rows.select("n", "w", S.signed_rank_two_sided(F.col("n"), F.col("w")).alias("p")).collect():
        assert abs(r.p - min(1, 2 * sum(s <= r.w for s in law[r.n]) / 2**r.n)) < 1e-12
    rng = random.Random(2)
    d = [("few", rng.uniform(-1, 2)) for _ in range(10)] + [("few", 0.0)] + [("ties", float(rng.randint(-3, 4))) for _ in range(12)] + [("many", rng.uniform(-1, 1.2)) for _ in range(60)]
    found = {r.combo: r for r in S.wilcoxon(spark.createDataFrame(d, "combo string, d double")).collect()}
    assert found["few"].n == 10 and abs(found["few"].p - min(1, 2 * sum(s <= found["few"].w for s in law[10]) / 2**10)) < 1e-12
    z = (found["many"].w - 60 * 61 / 4) / math.sqrt(60 * 61 * 121 / 24)
    assert abs(found["many"].p - math.erfc(-z / math.sqrt(2))) < 1e-6


def test_density(spark):
    rng = random.Random(4)
    values = [rng.gauss(5, 2) for _ in range(500)] + [None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    found = R.density(rows, "v", points=50, bins=100_000).orderBy("point").collect()
    some = values[:-1]
    h = np.std(some, ddof=1) * len(some) ** -0.2
    for r in found:
        want = sum(math.exp(-0.5 * ((r.x - v) / h) ** 2) for v in some) / (len(some) * h * math.sqrt(2 * math.pi))
        assert abs(r.density - want) < 1e-3 * max(want, 0.01)
    assert abs(sum(r.density for r in found) * (found[1].x - found[0].x) - 1) < 0.01
    assert R.density(rows.where("v is null"), "v").count() == 0 and R.density(rows.limit(1), "v").count() == 0


def shapiro(values):
    """Weights and statistic by rank, from the definition."""
    x, n = np.sort(np.array(values, float)), len(values)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, size = n**-0.5, math.sqrt(m @ m)
    a = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / size], u)
    b = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / size], u)
    if n == 3:
        weights = np.array([-1, 0, 1]) * math.sqrt(0.5)
    elif n <= 5:
        weights = m / math.sqrt((m @ m - 2 * m[-1] ** 2) / (1 - 2 * a * a))
        weights[[0, -1]] = -a, a
    else:
        weights = m / math.sqrt((m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a * a - 2 * b * b))
        weights[[0, 1, -2, -1]] = -a, -b, b, a
    return (weights @ x) ** 2 / ((x - x.mean()) ** 2).sum()


def test_shapiro_wilk(spark):
    # Published examples with their statistics and p-values.
    known = {
        "weights": ([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.788815, 0.006704),
        "skewed": ([0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66], 0.900473, 0.042090),
        "normal": ([1.36, 1.14, 2.92, 2.55, 1.46, 1.06, 5.27, -1.11, 3.48, 1.10, 0.88, -0.51, 1.46, 0.52, 6.20, 1.69, 0.08, 3.67, 2.81, 3.49], 0.959027, 0.524600),
    }
    rng = random.Random(6)
    others = {f"{n}": [rng.expovariate(1) + 1e6 for _ in range(n)] for n in (3, 4, 5, 6, 7, 12, 200)}
    others |= {"tied": [float(rng.randint(0, 5)) for _ in range(300)], "ends": [1.0, 1.0, 1.0, 2.0, 3.0, 3.0]}
    none = {"two": [1.0, 2.0], "equal": [4.0] * 9, "null": [None, 1.0, 1.5]}
    rows = [(k, v) for k, vs in ({k: vs for k, (vs, _, _) in known.items()} | others | none).items() for v in vs]
    frame = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "combo string, x double")
    for block in (10_000, 7):
        found = {r.combo: r for r in S.shapiro_wilk(frame, block).collect()}
        for k, (_, w, p) in known.items():
            assert abs(found[k].w - w) < 1e-5 and abs(found[k].p - p) < 1e-4, k
        for k, values in others.items():
            assert abs(found[k].w - shapiro(values)) < 1e-7 and 0 <= found[k].p <= 1, k
        assert all(found[k].w is None and found[k].p is None for k in none)
    assert abs(found["3"].p - 6 / math.pi * (math.asin(math.sqrt(found["3"].w)) - math.asin(math.sqrt(0.75)))) < 1e-9
    assert found["200"].p < 1e-6 and found["null"].n == 2
    assert S.shapiro_wilk(frame.where("x > 1e9")).count() == 0

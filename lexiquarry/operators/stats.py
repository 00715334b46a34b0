"""Statistical tests over strategy results, as grouped aggregates.

Samples are counted by value before anything is ordered, so a window sees the distinct
values of a group, not its rows.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# Coefficients of two published rational approximations, of the complementary
# error function (relative error under 1.2e-7) and of the logarithm of the gamma function.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
GAMMA = [76.18009172947146, -86.50532032941677, 24.01409824083091, -1.231739572450155, 0.1208650973866179e-2, -0.5395239384953e-5]


def erfc(x: Column) -> Column:
    """Complementary error function of ``x`` >= 0: by a series of positive terms up to 3, by
    the rational approximation beyond."""
    step = lambda acc, i: F.struct((acc["term"] * 2 * x * x / (2 * i + 1)).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(x.alias("term"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])
    t = 1 / (1 + x / 2)
    far = t * F.exp(-x * x + reduce(lambda s, c: s * t + c, reversed(ERFC)))
    return F.when(x < 3, 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series).otherwise(far)


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of ``x`` > 0."""
    series = reduce(lambda s, k: s + GAMMA[k] / (x + k + 1), range(6), F.lit(1.000000000190015))
    return F.log(F.lit(math.sqrt(2 * math.pi)) * series / x) - (x + 5.5 - (x + 0.5) * F.log(x + 5.5))


def normal_two_sided(z: Column) -> Column:
    """Probability of a standard normal value at least as far from 0 as ``z``."""
    return erfc(F.abs(z) / math.sqrt(2))


def chi2_survival(x: Column, k: Column) -> Column:
    """P(X > x) of a chi-squared variable with ``k`` degrees of freedom: a finite sum."""
    half = x / 2
    odd = k % 2 == 1
    first = F.when(odd, 0.5).otherwise(0.0)
    terms = F.floor(k / 2).cast("int")
    part = lambda i: F.exp((i + first) * F.log(half) - half - ln_gamma(i + first + 1))
    total = F.when(terms > 0, F.aggregate(F.sequence(F.lit(0), terms - 1), F.lit(0.0), lambda s, i: s + part(i))).otherwise(F.lit(0.0))
    return F.when(x <= 0, 1.0).otherwise(total + F.when(odd, erfc(F.sqrt(half))).otherwise(0.0))


def t_two_sided(t: Column, freedom: Column, steps: int = 2000) -> Column:
    """Probability of a Student value at least as far from 0 as ``t``: Simpson's rule over
    the angle whose tangent is ``t / sqrt(freedom)``."""
    angle = F.atan(F.abs(t) / F.sqrt(freedom)) / steps
    f = lambda i: F.pow(F.cos(i * angle), freedom - 1)
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(steps - 1)), F.lit(0.0), lambda s, i: s + F.when(i % 2 == 1, 4.0).otherwise(2.0) * f(i))
    area = (1 + inner + f(F.lit(steps))) * angle / 3
    return 1 - 2 * area * F.exp(ln_gamma((freedom + 1) / 2) - ln_gamma(freedom / 2)) / math.sqrt(math.pi)


def doc_ranks(samples: DataFrame) -> DataFrame:
    """``samples (doc_id, combo, x)`` with average ranks of x within each document and the
    size of the group of ties."""
    w = Window.partitionBy("doc_id")
    ties = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "x"))
    return samples.withColumns({"ties": ties, "k": F.count(F.lit(1)).over(w)}).withColumn(
        "r", F.rank().over(w.orderBy("x")) + (F.col("ties") - 1) / 2
    )


def friedman(samples: DataFrame) -> DataFrame:
    """Tie-corrected Friedman statistic over documents with a value for every combination:
    ``(n, k, statistic, p)``."""
    ranks = doc_ranks(samples)
    k = ranks.agg(F.max("k").alias("kk"))
    full = ranks.join(F.broadcast(k), F.col("k") == F.col("kk"))
    # Over the rows of a group of t ties, t^2 - 1 adds up to t^3 - t.
    by_combo = full.groupBy("combo").agg(
        F.sum("r").alias("rank_sum"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k"), F.sum(F.pow("ties", 2) - 1).alias("t")
    )
    sums = by_combo.agg(F.sum(F.pow("rank_sum", 2)).alias("ss"), F.max("n").alias("n"), F.max("k").alias("k"), F.sum("t").alias("t"))
    n, kk = F.col("n"), F.col("k")
    raw = F.lit(12) / (n * kk * (kk + 1)) * F.col("ss") - 3 * n * (kk + 1)
    tied = 1 - F.col("t") / (n * (F.pow(kk, 3) - kk))
    value = F.round(raw / tied, 6)
    return sums.select("n", "k", value.alias("statistic"), F.round(chi2_survival(value, kk - 1), 6).alias("p"))


def mean_ranks(samples: DataFrame) -> DataFrame:
    """Mean rank of each combination, and its distance from the best one."""
    means = doc_ranks(samples).groupBy("combo").agg(F.avg("r").alias("m"))
    return means.select("combo", F.round("m", 6).alias("mean_rank"), F.round(F.max("m").over(Window.partitionBy()) - F.col("m"), 6).alias("behind_best"))


@F.pandas_udf(DoubleType())
def range_survival(q: pd.Series, k: pd.Series) -> pd.Series:
    """P(range of ``k`` standard normal values > ``q``), by Simpson's rule over the least
    value; a row a test, so few rows."""
    z = np.linspace(-9.0, 9.0, 2001)
    weight = np.where(np.arange(2001) % 2, 4.0, 2.0) * (z[1] - z[0]) / 3
    weight[[0, -1]] /= 2
    below = np.frompyfunc(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), 1, 1)
    density, phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi), below(z).astype(float)
    inside = [float(n * (weight * density * (below(z + x).astype(float) - phi) ** (n - 1)).sum()) for x, n in zip(q, k)]
    return pd.Series([min(1.0, max(0.0, 1 - x)) for x in inside])


def nemenyi(samples: DataFrame) -> DataFrame:
    """``(left, right, p)``: every pair of combinations compared by mean ranks over the
    documents with all combinations, by the studentised range."""
    ranks = doc_ranks(samples)
    full = ranks.join(F.broadcast(ranks.agg(F.max("k").alias("kk"))), F.col("k") == F.col("kk"))
    means = full.groupBy("combo").agg(F.avg("r").alias("m"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
    # All combinations in one row: pairs of them, not a join.
    listed = means.agg(F.sort_array(F.collect_list(F.struct("combo", "m"))).alias("c"), F.max("n").alias("n"), F.max("k").alias("k"))
    each = F.flatten(F.transform("c", lambda a, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda b: F.struct(a["combo"].alias("left"), b["combo"].alias("right"), F.abs(a["m"] - b["m"]).alias("apart")))))
    pairs = listed.select("n", "k", F.inline(each))
    q = F.col("apart") / F.sqrt(F.col("k") * (F.col("k") + 1) / (6 * F.col("n"))) * math.sqrt(2)
    return pairs.select("left", "right", range_survival(q, F.col("k")).alias("p"))


#: Differences up to which the exact law of the signed-rank sum is used.
EXACT = 50


def signed_rank_two_sided(n: Column, w: Column) -> Column:
    """Twice the share of the subsets of the ranks 1 to ``n`` whose sum is at most ``w``, one
    at most. Numbers of subsets by their sum grow rank by rank: each sum is reached without
    the rank, or with it from a sum less by the rank."""
    one = F.transform(F.sequence(F.lit(0), F.floor(w).cast("int")), lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), one, lambda ways, r: F.transform(ways, lambda x, s: x + F.coalesce(F.when(s >= r, F.get(ways, s - r)), F.lit(0.0))))
    return F.least(F.lit(1.0), 2 * F.aggregate(ways, F.lit(0.0), lambda a, x: a + x) / F.pow(F.lit(2.0), n))


def wilcoxon(differences: DataFrame) -> DataFrame:
    """Signed-rank sums of ``differences (combo, d)``, zeros dropped, ties averaged:
    ``(combo, n, w_plus, w_minus, w, p)``. The p-value is two-sided: of the exact law for up
    to ``EXACT`` differences without ties, else of the normal approximation with the variance
    corrected for ties, without a continuity correction."""
    counts = (
        differences.where("d <> 0")
        .groupBy("combo", F.abs("d").alias("size"))
        .agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("d") > 0).alias("plus"))
    )
    rank = F.sum("m").over(Window.partitionBy("combo").orderBy("size")) - (F.col("m") - 1) / 2
    out = (
        counts.withColumn("r", rank)
        .groupBy("combo")
        .agg(F.sum("m").alias("n"), F.sum(F.col("r") * F.col("plus")).alias("w_plus"), F.sum(F.col("r") * (F.col("m") - F.col("plus"))).alias("w_minus"), F.sum(F.pow("m", 3) - F.col("m")).alias("_t"))
    )
    n = F.col("n")
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48)
    out = out.withColumn("w", F.least("w_plus", "w_minus"))
    exact = (F.col("_t") == 0) & (n <= EXACT)
    return out.withColumn("p", F.when(exact, signed_rank_two_sided(n, F.col("w"))).otherwise(normal_two_sided(z))).drop("_t")


def effect_r(sums: DataFrame) -> DataFrame:
    """Effect size of signed-rank sums and its class."""
    n = F.col("n")
    r = F.abs(F.col("w") / F.sqrt(n * (n + 1) * (2 * n + 1) / 6)) / F.sqrt(n)
    size = F.when(r < 0.1, "negligible").when(r < 0.3, "small").when(r < 0.5, "medium").otherwise("large")
    return sums.select("combo", "n", "w", F.round(r, 6).alias("r"), size.alias("effect"))


def benjamini_hochberg(tests: DataFrame) -> DataFrame:
    """Adjusted p-values of ``tests (combo, p)``: one row a test, few rows."""
    m = F.count(F.lit(1)).over(Window.partitionBy())
    k = F.row_number().over(Window.orderBy("p", "combo"))
    ranked = tests.withColumn("k", k).withColumn("raw", F.col("p") * m / k)
    upward = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.select("combo", "p", F.least(F.min("raw").over(upward), F.lit(1.0)).alias("p_adjusted"))


def bonferroni(tests: DataFrame) -> DataFrame:
    """p times the number of tests, not capped."""
    return tests.withColumn("p_adjusted", F.col("p") * F.count(F.lit(1)).over(Window.partitionBy()))


def cliffs_delta(samples: DataFrame, best: str, others: list[str]) -> DataFrame:
    """Dominance of combination ``best`` over each of ``others``: ``(combo, delta, effect)``.

    Counted by value: above and below come from running sums over the distinct values.
    """
    counts = samples.groupBy("combo", "x").agg(F.count(F.lit(1)).alias("m"))
    chosen = counts.where(F.col("combo") == best).select("x", F.col("m").alias("b"))
    both = counts.where(F.col("combo").isin(others)).select("combo", "x", "m", F.lit(0).cast("long").alias("b")).unionByName(
        chosen.select(F.explode(F.array(*map(F.lit, others))).alias("combo"), "x", F.lit(0).cast("long").alias("m"), "b")
    )
    by_value = both.groupBy("combo", "x").agg(F.sum("m").alias("m"), F.sum("b").alias("b"))
    below = F.sum("m").over(Window.partitionBy("combo").orderBy("x")) - F.col("m")
    whole = F.sum("m").over(Window.partitionBy("combo"))
    parts = by_value.withColumns({"below": below, "whole": whole})
    delta = F.sum(F.col("b") * (2 * F.col("below") + F.col("m") - F.col("whole"))) / (F.max("whole") * F.sum("b"))
    out = parts.groupBy("combo").agg(F.round(delta, 9).alias("delta"))
    size = F.abs("delta")
    label = F.when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")
    return out.withColumn("effect", label)


def practical_significance(samples: DataFrame, margin: float = 0.05) -> DataFrame:
    x = F.col("x")
    n = F.count("x")
    return samples.groupBy("combo").agg(
        F.round(F.count_if(x > margin) / n * 100, 6).alias("gain_pct"),
        F.round(F.count_if(x < -margin) / n * 100, 6).alias("loss_pct"),
        F.round(F.count_if(F.abs("x") <= margin) / n * 100, 6).alias("same_pct"),
        F.round(F.percentile("x", 0.5), 6).alias("median"),
        F.round(F.percentile("x", 0.75) - F.percentile("x", 0.25), 6).alias("iqr"),
    )


def welch_t(samples: DataFrame, left: str, right: str) -> DataFrame:
    """Welch's statistic, degrees of freedom and two-sided p-value of two combinations."""
    side = lambda f, c: f(F.when(F.col("combo") == c, F.col("x")))
    m = samples.agg(
        *(side(f, c).alias(f"{k}{i}") for i, c in enumerate((left, right)) for k, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count)))
    )
    a, b = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    freedom = F.pow(a + b, 2) / (a * a / (F.col("n0") - 1) + b * b / (F.col("n1") - 1))
    tested = m.select(((F.col("m0") - F.col("m1")) / F.sqrt(a + b)).alias("t"), freedom.alias("freedom"))
    return tested.select(F.round("t", 6).alias("t"), F.round("freedom", 4).alias("freedom"), F.round(t_two_sided(F.col("t"), F.col("freedom")), 6).alias("p"))


def moments(samples: DataFrame) -> DataFrame:
    return samples.groupBy("combo").agg(
        F.round(F.avg("x"), 6).alias("mean"),
        F.round(F.stddev_samp("x"), 6).alias("std"),
        F.round(F.percentile("x", 0.5), 6).alias("median"),
        F.min("x").alias("least"),
        F.max("x").alias("greatest"),
        F.count("x").alias("n"),
    )


# Fixed values (Royston 1995): corrections of the two outer weights by powers of n^-1/2, and
# mean and log deviation of the transformed statistic by powers of n (up to 11) and ln n.
OUTER = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
NEXT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_MEAN, SMALL_SPREAD = [0.5440, -0.39978, 0.025054, -0.0006714], [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN, LARGE_SPREAD = [-1.5861, -0.31082, -0.083751, 0.0038915], [-0.4803, -0.082676, 0.0030302]


def _scores(ranks: np.ndarray, n: int) -> np.ndarray:
    """Expected normal order statistics of some of ``n`` ranks, by Blom's places."""
    normal = NormalDist()
    return np.array([normal.inv_cdf((r - 0.375) / (n + 0.25)) for r in ranks])


@F.pandas_udf(StructType([StructField("sum", DoubleType()), StructField("squares", DoubleType())]))
def rank_scores(first: pd.Series, last: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Sum and sum of squares of the normal scores of the ranks ``first`` to ``last`` of ``n``."""
    parts = [_scores(np.arange(a, b + 1), k) for a, b, k in zip(first, last, n)]
    return pd.DataFrame({"sum": [p.sum() for p in parts], "squares": [(p * p).sum() for p in parts]}, columns=["sum", "squares"], dtype=float)


def _power_sum(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda s, c: s * x + c, reversed(coefficients), F.lit(0.0))


def shapiro_wilk(samples: DataFrame, block: int = 10_000) -> DataFrame:
    """``(combo, n, w, p)`` of ``samples (combo, x)``: how near the values are to a normal
    sample, and the p-value by Royston's approximation (exact for three values).

    Values are counted first. A distinct value holds a stretch of ranks, of which only the sum
    of scores counts; stretches are cut to ``block`` ranks, so one frequent value is several
    rows. Nulls are left out; with fewer than three values or all equal, ``w`` and ``p`` are
    null. The approximation was made for up to 5,000 values; beyond, p is an extrapolation.
    """
    w = Window.partitionBy("combo")
    counts = samples.where("x is not null").groupBy("combo", "x").agg(F.count(F.lit(1)).alias("m"))
    ranked = counts.withColumns({"n": F.sum("m").over(w), "last": F.sum("m").over(w.orderBy("x"))}).withColumn("first", F.col("last") - F.col("m") + 1)
    starts = F.sequence("first", "last", F.lit(block).cast("long"))
    cut = ranked.withColumn("from", F.explode(starts)).withColumn("to", F.least(F.col("from") + block - 1, "last"))
    scored = cut.withColumn("score", rank_scores("from", "to", "n"))
    x, n = F.col("x").cast("double"), F.col("n")
    held = F.col("to") - F.col("from") + 1
    sums = scored.groupBy("combo").agg(
        F.max("n").alias("n"),
        F.sum(F.col("score.squares")).alias("mm"),
        F.sum(x * F.col("score.sum")).alias("mx"),
        F.sum(held * x).alias("total"),
        F.min(x).alias("x1"),
        F.min(F.when(F.col("last") >= 2, x)).alias("x2"),
        F.max(F.when(F.col("first") <= n - 1, x)).alias("y2"),
        F.max(x).alias("y1"),
    )
    # Squares around the mean in a second pass over the counts: sums of squares lose digits.
    around = counts.join(sums.select("combo", (F.col("total") / n).alias("mean")), "combo").groupBy("combo").agg(F.sum(F.col("m") * F.pow(x - F.col("mean"), 2)).alias("ss"))
    u = 1 / F.sqrt(n)
    rows = sums.join(around, "combo").withColumns({"s": rank_scores(n, n, n)["sum"], "t": rank_scores(n - 1, n - 1, n)["sum"]})
    size = F.sqrt("mm")
    rows = rows.withColumns({"a": F.when(n == 3, math.sqrt(0.5)).otherwise(F.col("s") / size + _power_sum(OUTER, u)), "b": F.col("t") / size + _power_sum(NEXT, u)})
    outer, inner = F.col("y1") - F.col("x1"), F.col("y2") - F.col("x2")
    a, b, s, t = (F.col(c) for c in "abst")
    one = F.sqrt((F.col("mm") - 2 * s * s) / (1 - 2 * a * a))
    two = F.sqrt((F.col("mm") - 2 * s * s - 2 * t * t) / (1 - 2 * a * a - 2 * b * b))
    top = (
        F.when(n == 3, a * outer)
        .when(n <= 5, (F.col("mx") - s * outer) / one + a * outer)
        .otherwise((F.col("mx") - s * outer - t * inner) / two + a * outer + b * inner)
    )
    value = F.when((n >= 3) & (F.col("ss") > 0), F.least(F.lit(1.0), top * top / F.col("ss")))
    left = F.log(F.greatest(1 - F.col("w"), F.lit(1e-300)))
    bound = 0.459 * n - 2.273
    few = (-F.log(bound - left) - _power_sum(SMALL_MEAN, n)) / F.exp(_power_sum(SMALL_SPREAD, n))
    many = (left - _power_sum(LARGE_MEAN, F.log(n))) / F.exp(_power_sum(LARGE_SPREAD, F.log(n)))
    z = F.when(n <= 11, few).otherwise(many)
    above = F.when(z >= 0, normal_two_sided(z) / 2).otherwise(1 - normal_two_sided(z) / 2)
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))))
    p = F.when(n == 3, three).when((n <= 11) & (left >= bound), 0.0).otherwise(above)
    return rows.withColumn("w", value).select("combo", "n", "w", F.when(F.col("w").isNotNull(), p).alias("p"))

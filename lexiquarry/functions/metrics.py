"""Text comparison metrics as column expressions; longest common subsequences by an Arrow
UDF (the recurrence has no built-in form)."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import vectors as V


def _overlap(p: Column, g: Column) -> Column:
    """Size of the common multiset of two arrays: the words of both are sorted together, and
    a run of equal ones has the lesser of its two counts in common."""
    tagged = lambda words, side: F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(side).alias("side")))
    start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("p"), F.lit(0).alias("g"), F.lit(0).alias("common"))

    def step(acc: Column, x: Column) -> Column:
        same, first = acc["w"] == x["w"], x["side"] == 0
        before = lambda side: F.when(same, acc[side]).otherwise(0)
        return F.struct(
            x["w"].alias("w"),
            (before("p") + first.cast("int")).alias("p"),
            (before("g") + (~first).cast("int")).alias("g"),
            (acc["common"] + F.when(same, 0).otherwise(F.least(acc["p"], acc["g"]))).alias("common"),
        )

    return F.aggregate(F.array_sort(F.concat(tagged(p, 0), tagged(g, 1))), start, step, lambda acc: acc["common"] + F.least(acc["p"], acc["g"]))


def _f1(common: Column, n: Column, m: Column) -> Column:
    """Harmonic mean of common / n and common / m; 0 without anything in common."""

    def mean(k: Column) -> Column:
        precision, recall = k / n, k / m
        return F.when(k > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)

    return V.bound(common, mean)


def _blank(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+", "") == "", F.lit(True))


def char_f1(pred: Column, gold: Column) -> Column:
    """Overlap of the characters of two texts, without case; 0 for blanks. A character's
    count is what its removal shortens the text by."""
    p, g = F.lower(pred), F.lower(gold)
    count = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    common = F.aggregate(F.array_distinct(F.filter(F.split(p, "", -1), lambda c: c != "")), F.lit(0), lambda s, c: s + F.least(count(p, c), count(g, c)))
    return F.when(_blank(pred) | _blank(gold), 0.0).otherwise(_f1(common, F.length(p), F.length(g)))


def best_over(golds: Column, metric) -> Column:
    """Greatest value of a metric over an array of references; 0 without any."""
    return F.coalesce(F.array_max(F.transform(golds, metric)), F.lit(0.0))


def answer_tokens(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, parted by white space."""
    t = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " ")
    return F.filter(F.split(t, r"\s+", -1), lambda w: w != "")


def token_f1(pred: Column, gold: Column) -> Column:
    """Overlap of answer tokens, 0 to 100."""
    both = F.struct(answer_tokens(pred).alias("p"), answer_tokens(gold).alias("g"))
    value = F.transform(F.array(both), lambda b: _f1(_overlap(b["p"], b["g"]), F.size(b["p"]), F.size(b["g"])) * 100)[0]
    return F.when(_blank(pred) | _blank(gold), 0.0).otherwise(value)


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, in bit rows (one integer step for each
    token of ``b``)."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


_ROUGE = re.compile(r"[a-z0-9]+")


def _rouge(p: str | None, g: str | None) -> float:
    a, b = _ROUGE.findall((g or "").lower()), _ROUGE.findall((p or "").lower())
    k = common_subsequence(a, b)
    return 2 * k / (len(a) + len(b)) if k else 0.0


@F.pandas_udf(DoubleType())
def rouge_l(pred: pd.Series, gold: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of lower-case ASCII tokens."""
    return pd.Series([_rouge(p, g) for p, g in zip(pred, gold)], dtype="float64")


@F.pandas_udf(DoubleType())
def best_rouge_l(pred: pd.Series, golds: pd.Series) -> pd.Series:
    """Greatest ``rouge_l`` over an array of references; 0 without any."""
    return pd.Series([max((_rouge(p, g) for g in (() if gs is None else gs)), default=0.0) for p, gs in zip(pred, golds)], dtype="float64")


def letter_vectors(text: Column) -> Column:
    """The built-in vectors of a text's words: counts of their letters. Contextual vectors of
    a model take their place."""
    words = F.filter(F.split(F.lower(text), r"\s+", -1), lambda w: w != "")
    return F.transform(words, lambda w: V.unit(V.encode_text(F.regexp_replace(w, "(.)", "$1 "))))


def greedy_match(pred: Column, gold: Column) -> Column:
    """Struct (p, r, f1) of two arrays of unit vectors: the mean over one side's vectors of
    the greatest similarity to the other side's; zeros if either is empty."""
    rows = F.transform(pred, lambda u: F.transform(gold, lambda v: V.similarity(u, v)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    def scores(m: Column) -> Column:
        best = F.aggregate(F.slice(m, F.lit(2), F.size(m) - 1), m[0], lambda a, r: F.zip_with(a, r, lambda x, y: F.greatest(x, y)))
        return V.bound(
            F.struct(mean(F.transform(m, F.array_max)).alias("p"), mean(best).alias("r")),
            lambda s: F.struct(s["p"].alias("p"), s["r"].alias("r"), F.when(s["p"] + s["r"] > 0, 2 * s["p"] * s["r"] / (s["p"] + s["r"])).otherwise(0.0).alias("f1")),
        )

    zeros = F.struct(*(F.lit(0.0).alias(x) for x in ("p", "r", "f1")))
    return F.when((F.size(pred) > 0) & (F.size(gold) > 0), V.bound(rows, scores)).otherwise(zeros)


def metrics_rowwise(rows: DataFrame, pred: str = "pred", golds: str = "golds", embed: Callable[[Column], Column] = letter_vectors) -> DataFrame:
    """``rows`` with six metrics of ``pred`` against an array of references, of each the
    greatest over them: ``char_f1``, ``token_f1`` (0 to 100), ``rouge_l_f1`` and, by the
    vectors of ``embed``, ``bertscore_p``, ``bertscore_r`` and ``bertscore_f1``. All but
    ``rouge_l_f1`` have four places. Null and blank references do not count; without any,
    and for a blank ``pred``, all are 0."""
    p = F.col(pred)
    kept = F.filter(F.coalesce(F.col(golds), F.array().cast("array<string>")), lambda g: ~_blank(g))
    # Vectors are bound, so each text's are made once.
    bert = V.bound(F.col("_p"), lambda own: F.transform("_g", lambda g: V.bound(embed(g), lambda other: greedy_match(own, other))))
    out = rows.withColumns({"_g": F.when(_blank(p), F.array().cast("array<string>")).otherwise(kept), "_p": embed(p)}).withColumn("_b", bert)
    of = lambda k: F.round(F.coalesce(F.array_max(F.transform("_b", lambda b: b[k])), F.lit(0.0)), 4)
    return out.withColumns(
        {
            "char_f1": F.round(best_over(F.col("_g"), lambda g: char_f1(p, g)), 4),
            "token_f1": F.round(best_over(F.col("_g"), lambda g: token_f1(p, g)), 4),
            "rouge_l_f1": best_rouge_l(p, F.col("_g")),
            **{f"bertscore_{k}": of(k) for k in ("p", "r", "f1")},
        }
    ).drop("_g", "_p", "_b")


def text_metrics(reference: Column, answer: Column, encode: V.Encoder = V.encode_text) -> Column:
    """Struct (cosine_sim, lev_dist) of two short texts."""
    u, v = V.unit(encode(reference)), V.unit(encode(answer))
    return F.struct(V.similarity(u, v).alias("cosine_sim"), F.levenshtein(reference, answer).cast("double").alias("lev_dist"))

"""Inputs of the engine's operators, derived from the star-schema and text tables by
deterministic formulas. ``*_SQL`` holds the same as common table expressions."""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V

SCORING = ["only_score_diff", "only_weight", "equal_weight_score_diff"]
CLUSTER = ["highest_avg_score", "weighted_score", "highest_cohesion"]
ANSWER = ["highest_chunk_score", "highest_similarity", "combined_score"]
COMBOS = [f"{s}_{c}_{a}" for s in SCORING for c in CLUSTER for a in ANSWER]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)`` dealt by document, once for all branches of a plan: what is made of
    documents (sentences, chunks, keywords) meets again without a shuffle. The number of
    partitions is given, as this work costs more than its bytes show."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return table(spark, sf_dir, "documents").select("doc_id", "text").repartition(partitions, "doc_id")


def most_frequent(words: Column, n: int) -> Column:
    """Array of (m, word) of the ``n`` most frequent words of an array, then in alphabetical
    order; m is minus their number. Equal words are neighbours once sorted."""
    counted = lambda s: F.transform(V.runs(s), lambda r: F.struct((-r["n"]).alias("m"), F.get(s, r["at"] - 1).alias("word")))
    return V.bound(F.sort_array(words), lambda s: F.slice(F.sort_array(counted(s)), 1, n))


def frequent_words(docs: DataFrame, kinds: list[tuple[int, str]]) -> DataFrame:
    """``(doc_id, kw_idx, word)``: of each kind, a number and a pattern of letters, a document's
    most frequent matches in its lower-cased texts, then in alphabetical order; the first of all
    kinds go before the second ones. Words are counted in their document's row, in Arrow batches."""
    # Line ends are in no pattern, so nothing is matched across the texts of a document.
    texts = docs.groupBy("doc_id").agg(F.lower(F.array_join(F.collect_list("text"), "\n")).alias("text"))
    # Runs of letters are possessive; behind ASCII the class takes all, as ``words`` leaves only letters there.
    found = [(n, re.compile(p.replace(r"\p{L}+(", r"\p{L}++(").replace(r"\p{L}", r"[A-Za-z\x80-\U0010ffff]"))) for n, p in kinds]

    def words(text: str) -> list[str]:
        if not text.isascii():
            for c in set(text):
                if c > "\x7f" and not c.isalpha():
                    text = text.replace(c, "_")
        own = [heapq.nsmallest(n, ((-m, w) for w, m in Counter(p.findall(text)).items())) for n, p in found]
        return [best[i][1] for i in range(max(map(len, own))) for best in own if i < len(best)]

    def frequent(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(map(words, batch)))

    return texts.select("doc_id", F.posexplode(F.pandas_udf(frequent, "array<string>")("text")).alias("kw_idx", "word"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result row for each document and each of the 27 strategy combinations."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    for name, values in (("s", SCORING), ("c", CLUSTER), ("a", ANSWER)):
        rows = rows.select("*", F.posexplode(F.array(*map(F.lit, values))).alias(name, f"{name}_name"))
    hundredths = lambda x: F.concat(F.floor(F.expr(x) / 100), F.lit("."), F.lpad(F.expr(f"({x}) % 100").cast("string"), 2, "0"))
    metrics = lambda cos, lev: F.concat(F.lit("{'cosine_sim': "), hundredths(cos), F.lit(", 'lev_dist': "), F.expr(lev).cast("string"), F.lit("}"))
    final = (
        F.when(F.expr("(doc_id + s + c + a) % 29 = 0"), "--No valid answers--")
        .when(F.expr("(doc_id + s + c + a) % 31 = 0"), "  ")
        .when(F.expr("(doc_id + s + c + a) % 37 = 0"), F.lit(None))
        .when(F.expr("(doc_id + s + c + a) % 23 = 0"), "--No keywords--")
        .otherwise(F.concat(F.lit("answer "), (F.col("doc_id") % 7).cast("string")))
    )
    return rows.select(
        "doc_id",
        "lang",
        F.col("s_name").alias("score_chunk_strategy"),
        F.col("c_name").alias("choose_cluster_strategy"),
        F.col("a_name").alias("choose_answer_strategy"),
        final.alias("final_answer"),
        metrics("(doc_id * 31) % 101", "(doc_id * 13) % 41").alias("base_metrics"),
        F.when(F.expr("(doc_id + s + c + a) % 29 = 0"), "--None--")
        .otherwise(metrics("(doc_id * 17 + s * 7 + c * 5 + a * 3) % 101", "(doc_id * 11 + s * 5 + c * 3 + a * 2) % 41"))
        .alias("corrected_metrics"),
        F.expr("CASE WHEN doc_id % 11 = 5 THEN NULL ELSE doc_id % 3 <> 0 END").alias("strategy_applicable"),
    )


RESULTS_SQL = """
results AS (
  SELECT doc_id, lang, sn AS score_chunk_strategy, cn AS choose_cluster_strategy, an AS choose_answer_strategy,
    CASE WHEN (doc_id + s + c + a) % 29 = 0 THEN '--No valid answers--' WHEN (doc_id + s + c + a) % 31 = 0 THEN '  '
      WHEN (doc_id + s + c + a) % 37 = 0 THEN NULL WHEN (doc_id + s + c + a) % 23 = 0 THEN '--No keywords--'
      ELSE 'answer ' || doc_id % 7 END AS final_answer,
    '{''cosine_sim'': ' || bc // 100 || '.' || lpad((bc % 100)::VARCHAR, 2, '0') || ', ''lev_dist'': ' || (doc_id * 13) % 41 || '}' AS base_metrics,
    CASE WHEN (doc_id + s + c + a) % 29 = 0 THEN '--None--' ELSE '{''cosine_sim'': ' || cc // 100 || '.' || lpad((cc % 100)::VARCHAR, 2, '0')
      || ', ''lev_dist'': ' || (doc_id * 11 + s * 5 + c * 3 + a * 2) % 41 || '}' END AS corrected_metrics,
    CASE WHEN doc_id % 11 = 5 THEN NULL ELSE doc_id % 3 <> 0 END AS strategy_applicable
  FROM (SELECT *, (doc_id * 31) % 101 AS bc, (doc_id * 17 + s * 7 + c * 5 + a * 3) % 101 AS cc FROM documents,
    (VALUES (0, 'only_score_diff'), (1, 'only_weight'), (2, 'equal_weight_score_diff')) AS x(s, sn),
    (VALUES (0, 'highest_avg_score'), (1, 'weighted_score'), (2, 'highest_cohesion')) AS y(c, cn),
    (VALUES (0, 'highest_chunk_score'), (1, 'highest_similarity'), (2, 'combined_score')) AS z(a, an))),
parsed AS (
  SELECT *, coalesce(TRY_CAST(regexp_extract(base_metrics, 'cosine_sim.: ([0-9.]+)', 1) AS DOUBLE), 0) AS cosine_sim_base,
    coalesce(TRY_CAST(regexp_extract(base_metrics, 'lev_dist.: ([0-9.]+)', 1) AS DOUBLE), 0) AS lev_dist_base,
    coalesce(TRY_CAST(regexp_extract(corrected_metrics, 'cosine_sim.: ([0-9.]+)', 1) AS DOUBLE), 0) AS cosine_sim_corrected,
    coalesce(TRY_CAST(regexp_extract(corrected_metrics, 'lev_dist.: ([0-9.]+)', 1) AS DOUBLE), 0) AS lev_dist_corrected FROM results),
bad AS (SELECT *, coalesce(final_answer IS NULL OR trim(final_answer) = '' OR final_answer = '--No valid answers--', false) AS invalid FROM parsed),
d AS (SELECT *, cosine_sim_corrected - cosine_sim_base AS cosine_sim_diff, lev_dist_corrected - lev_dist_base AS lev_dist_diff FROM bad WHERE NOT invalid),
e AS (SELECT *, cosine_sim_diff > 0 AS cosine_improved, cosine_sim_diff < 0 AS cosine_worsened, cosine_sim_diff = 0 AS cosine_unchanged,
    lev_dist_diff < 0 AS lev_improved, lev_dist_diff > 0 AS lev_worsened, lev_dist_diff = 0 AS lev_unchanged,
    cosine_sim_diff > 0 AND lev_dist_diff < 0 AS overall_improved, cosine_sim_diff < 0 AND lev_dist_diff > 0 AS overall_worsened,
    NOT ((cosine_sim_diff > 0 AND lev_dist_diff < 0) OR (cosine_sim_diff < 0 AND lev_dist_diff > 0) OR (cosine_sim_diff = 0 AND lev_dist_diff = 0)) AS overall_mixed,
    cosine_sim_diff = 0 AND lev_dist_diff = 0 AS overall_unchanged,
    score_chunk_strategy || '_' || choose_cluster_strategy || '_' || choose_answer_strategy AS strategy_combo FROM d)"""

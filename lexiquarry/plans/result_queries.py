"""Queries over strategy results, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import results as R
from ..operators import stats as S
from .fixtures import ANSWER, COMBOS, RESULTS_SQL, results, table

BEST = "only_weight_weighted_score_combined_score"
OTHERS = [c for c in COMBOS if c != BEST]


def _enriched(spark, sf) -> DataFrame:
    return R.enrich(R.valid_rows(results(spark, sf)))


def _summary(spark, sf) -> DataFrame:
    return R.summary(_enriched(spark, sf))


def _samples(spark, sf) -> DataFrame:
    return R.enrich(results(spark, sf)).select("doc_id", R.combo().alias("combo"), F.col("cosine_sim_diff").alias("x"))


def _against_best(spark, sf) -> DataFrame:
    """Differences of the best combination and each other one, by document."""
    x = _samples(spark, sf)
    best = x.where(F.col("combo") == BEST).select("doc_id", F.col("x").alias("b"))
    return x.where(F.col("combo") != BEST).join(best, "doc_id").select("combo", (F.col("b") - F.col("x")).alias("d"))


def _tests(spark, sf) -> DataFrame:
    return S.wilcoxon(_against_best(spark, sf)).select("combo", F.round("p", 9).alias("p"))


def q_parse_metrics(spark, sf):
    r = results(spark, sf)
    return r.select("doc_id", *R.STRATEGIES, R.parse_metrics(F.col("base_metrics")).alias("b"), R.parse_metrics(F.col("corrected_metrics")).alias("c")).select(
        "doc_id", *R.STRATEGIES, F.col("b.cosine_sim").alias("cos_base"), F.col("b.lev_dist").alias("lev_base"), F.col("c.cosine_sim").alias("cos_corr"), F.col("c.lev_dist").alias("lev_corr")
    )


def q_valid_rows(spark, sf):
    return results(spark, sf).select("doc_id", *R.STRATEGIES, R.invalid_row().alias("invalid"))


def q_evaluable_rows(spark, sf):
    r = results(spark, sf)
    return r.select("doc_id", *R.STRATEGIES, R.evaluable(r).alias("evaluable"))


def q_empty_answers(spark, sf):
    return R.empty_answers(results(spark, sf), ["final_answer", "strategy_applicable"]).select("doc_id", *R.STRATEGIES)


def q_enrich_metrics(spark, sf):
    return _enriched(spark, sf).select("doc_id", *R.STRATEGIES, "cosine_sim_diff", "lev_dist_diff", *R.FLAGS)


def q_change_bins(spark, sf):
    e = _enriched(spark, sf)
    return e.groupBy(R.change_bin(F.col("cosine_sim_diff")).alias("cosine"), R.change_bin(R.legacy_distance_change(F.col("lev_dist_base"), F.col("lev_dist_corrected"))).alias("lev")).agg(F.count(F.lit(1)).alias("n"))


def q_applicability(spark, sf):
    return R.applicability(results(spark, sf))


def q_strategy_summary(spark, sf):
    return _summary(spark, sf)


def q_strategy_summary_pop(spark, sf):
    return R.summary(_enriched(spark, sf), population=True).select("strategy_combo", "cosine_std_diff", "lev_std_diff")


def q_composite_score(spark, sf):
    return R.composite(_summary(spark, sf)).select("strategy_combo", "composite_score")


def q_by_strategy(spark, sf):
    return R.by_strategy(_enriched(spark, sf), "choose_cluster_strategy")


def q_strategy_stack(spark, sf):
    return R.stacked(_enriched(spark, sf)).select("dimension", "strategy", "overall_improved", "overall_worsened_pct", "count")


def q_pivot_pair(spark, sf):
    return R.pivot_pair(_enriched(spark, sf), "choose_cluster_strategy", "choose_answer_strategy", ANSWER)


def q_compare_langs(spark, sf):
    e = _enriched(spark, sf)
    return R.compare(R.summary(e.where("lang = 'en'")), R.summary(e.where("lang <> 'en'")), "overall_improved_pct")


def q_drop_invalid_docs(spark, sf):
    return R.drop_invalid_documents(results(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def q_topk(spark, sf):
    return R.extremes(R.composite(_summary(spark, sf)).select("strategy_combo", "composite_score"), "composite_score", "strategy_combo", 5)


def q_value_counts(spark, sf):
    return R.value_counts(results(spark, sf), "final_answer")


def q_describe_diff(spark, sf):
    return R.describe(_enriched(spark, sf), "choose_answer_strategy", "cosine_sim_diff")


def q_ecdf(spark, sf):
    return R.ecdf(_enriched(spark, sf), "choose_cluster_strategy", "lev_dist_diff")


def q_histogram(spark, sf):
    return R.histogram(_enriched(spark, sf), "lev_dist_diff", -40.0, 40.0, 20)


def q_worsened(spark, sf):
    return R.worsened_report(_enriched(spark, sf))


def q_combo_vs_all(spark, sf):
    return R.combo_against_all(_enriched(spark, sf), BEST)


def q_distinct_docs(spark, sf):
    return _enriched(spark, sf).agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("final_answer").alias("answers"))


def q_slice_rows(spark, sf):
    return R.slice_rows(results(spark, sf).select("doc_id").distinct(), "doc_id", 100, 50)


def q_resume_anti(spark, sf):
    done = results(spark, sf).where("final_answer like 'answer%'")
    return R.not_done(results(spark, sf), done.where("choose_answer_strategy = 'combined_score' and doc_id % 2 = 0")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def q_strategy_filters(spark, sf):
    e = _enriched(spark, sf)
    kept = e.where(F.col("corrected_metrics") != "--None--").where(F.col("score_chunk_strategy").isin("only_weight", "equal_weight_score_diff"))
    return kept.where("overall_improved and choose_cluster_strategy = 'weighted_score' and choose_answer_strategy = 'combined_score'").select("doc_id", "score_chunk_strategy")


def q_friedman_stat(spark, sf):
    return S.friedman(_samples(spark, sf))


def q_nemenyi_ranks(spark, sf):
    return S.mean_ranks(_samples(spark, sf))


def q_nemenyi(spark, sf):
    return S.nemenyi(_samples(spark, sf)).withColumn("p", F.round("p", 6))


def q_wilcoxon_w(spark, sf):
    return S.wilcoxon(_against_best(spark, sf)).withColumn("p", F.round("p", 6))


def q_wilcoxon_exact(spark, sf):
    """Small groups of parts: prices against a value, by the exact law."""
    d = table(spark, sf, "part").select(F.concat_ws("-", "p_brand", "p_size").alias("combo"), (F.col("p_retailprice") - 1400.003 - F.col("p_partkey") / 100000).alias("d"))
    return S.wilcoxon(d).where(F.col("n") <= S.EXACT).select("combo", "n", "w", F.round("p", 9).alias("p"))


def q_density(spark, sf):
    """Kernel density of prices at 200 places."""
    found = R.density(table(spark, sf, "part"), "p_retailprice")
    return found.select("point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


def q_shapiro_wilk(spark, sf):
    """Normality of the balances of the customers of each nation."""
    samples = table(spark, sf, "customer").select(F.col("c_nationkey").alias("combo"), F.col("c_acctbal").alias("x"))
    return S.shapiro_wilk(samples).select("combo", "n", F.round("w", 6).alias("w"), F.round("p", 6).alias("p"))


def q_shapiro_strategies(spark, sf):
    """Normality of the changes of each combination of strategies."""
    return S.shapiro_wilk(_samples(spark, sf)).select("combo", "n", F.round("w", 6).alias("w"), F.round("p", 6).alias("p"))


def q_wilcoxon_zero(spark, sf):
    return S.wilcoxon(_samples(spark, sf).select("combo", F.col("x").alias("d"))).withColumn("p", F.round("p", 6))


def q_effect_r(spark, sf):
    return S.effect_r(S.wilcoxon(_against_best(spark, sf)))


def q_fdr_bh(spark, sf):
    return S.benjamini_hochberg(_tests(spark, sf)).select("combo", F.round("p_adjusted", 6).alias("p_adjusted"))


def q_bonferroni(spark, sf):
    return S.bonferroni(_tests(spark, sf)).select("combo", F.round("p_adjusted", 6).alias("p_adjusted"))


def q_cliffs_delta(spark, sf):
    return S.cliffs_delta(_samples(spark, sf), BEST, OTHERS)


def q_practical_sig(spark, sf):
    return S.practical_significance(_samples(spark, sf))


def q_welch_t(spark, sf):
    return S.welch_t(_samples(spark, sf), BEST, OTHERS[0])


def q_strategy_moments(spark, sf):
    return S.moments(_samples(spark, sf))


KEYS = "doc_id, score_chunk_strategy, choose_cluster_strategy, choose_answer_strategy"
_WITH = f"WITH {RESULTS_SQL}"
_FLAG_AGGS = ", ".join(f"count(*) FILTER ({f}) AS {f}, round(count(*) FILTER ({f}) / count(*) * 100, 6) AS {f}_pct" for f in R.FLAGS)
_SUMMARY = f"""s AS (SELECT score_chunk_strategy, choose_cluster_strategy, choose_answer_strategy, strategy_combo, count(*) AS total_samples, {_FLAG_AGGS},
  round(avg(cosine_sim_diff), 6) AS cosine_mean_diff, round(stddev_samp(cosine_sim_diff), 6) AS cosine_std_diff,
  round(avg(lev_dist_diff), 6) AS lev_mean_diff, round(stddev_samp(lev_dist_diff), 6) AS lev_std_diff FROM e GROUP BY ALL)"""
_COMPOSITE = _SUMMARY + """, k AS (SELECT strategy_combo, round(overall_improved_pct * 0.4::DOUBLE + cosine_improved_pct * 0.3::DOUBLE
  + lev_improved_pct * 0.3::DOUBLE - overall_worsened_pct * 0.2::DOUBLE, 6) AS composite_score FROM s)"""
_BY = """SELECT {c}, round(avg(overall_improved::INT), 4) AS overall_improved, round(avg(cosine_improved::INT), 4) AS cosine_improved,
  round(avg(lev_improved::INT), 4) AS lev_improved, round(avg(overall_worsened::INT), 4) AS overall_worsened,
  round(avg(cosine_sim_diff), 4) AS cosine_mean_diff, round(stddev_samp(cosine_sim_diff), 4) AS cosine_std_diff,
  round(avg(lev_dist_diff), 4) AS lev_mean_diff, round(stddev_samp(lev_dist_diff), 4) AS lev_std_diff, count(doc_id) AS count,
  round(round(avg(overall_improved::INT), 4) * 100, 2) AS overall_improved_pct, round(round(avg(cosine_improved::INT), 4) * 100, 2) AS cosine_improved_pct,
  round(round(avg(lev_improved::INT), 4) * 100, 2) AS lev_improved_pct, round(round(avg(overall_worsened::INT), 4) * 100, 2) AS overall_worsened_pct
  FROM e GROUP BY 1"""
_X = """x AS (SELECT doc_id, score_chunk_strategy || '_' || choose_cluster_strategy || '_' || choose_answer_strategy AS combo,
  cosine_sim_corrected - cosine_sim_base AS x FROM parsed)"""
_R = """, r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS ties, count(*) OVER (PARTITION BY doc_id) AS k,
  rank() OVER (PARTITION BY doc_id ORDER BY x) + (count(*) OVER (PARTITION BY doc_id, x) - 1) / 2 AS r FROM x)"""
_DIFF = f""", diff AS (SELECT o.combo, b.x - o.x AS d FROM x o JOIN x b USING (doc_id) WHERE b.combo = '{BEST}' AND o.combo <> '{BEST}')"""
# Areas under curves by Simpson's rule, where the operators sum series.
_SIMPSON = "list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {})) / 3"
_NORMAL = "(1 - 2 / sqrt(2 * pi()) * " + _SIMPSON.format("exp(-pow(i * least(abs(z), 9) / 2000, 2) / 2)") + " * least(abs(z), 9) / 2000)"
_PHI = "(0.5 + sign({x}) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 201), lambda j: (CASE WHEN j IN (0, 200) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(j * least(abs({x}), 9) / 200, 2) / 2))) * least(abs({x}), 9) / 600)"
_STUDENT = (
    "(1 - 2 * " + _SIMPSON.format("pow(cos(i * atan(abs(t) / sqrt(freedom)) / 2000), freedom - 1)") + " * atan(abs(t) / sqrt(freedom)) / 2000 * "
    "exp(lgamma((freedom + 1) / 2) - lgamma(freedom / 2)) / sqrt(pi()))"
)
_CHI2 = "list_sum(list_transform(range(0, ((k - 1) // 2)::BIGINT), lambda i: exp(i * ln(statistic / 2) - statistic / 2 - lgamma(i + 1))))"
_W = f""", sr AS (SELECT combo, d, rank() OVER (PARTITION BY combo ORDER BY abs(d)) + (count(*) OVER (PARTITION BY combo, abs(d)) - 1) / 2 AS r,
    count(*) OVER (PARTITION BY combo, abs(d)) AS tied FROM diff WHERE d <> 0),
w0 AS (SELECT combo, count(*)::BIGINT AS n, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (d < 0), 0)::DOUBLE AS w_minus,
  least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0))::DOUBLE AS w, sum(tied * tied - 1) AS ties FROM sr GROUP BY combo),
w1 AS (SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w0),
w AS (SELECT combo, n, w_plus, w_minus, w, {_NORMAL} AS p FROM w1)"""
_P = """, t AS (SELECT combo, round(p, 9) AS p FROM w)"""
_STATS = f"{_WITH}, {_X}"
#: Expected normal scores by a rational approximation (fixed values, Acklam), in place of the
#: inverse of the distribution.
_TAIL = """(((((-7.784894002430293e-03 * {q} - 3.223964580411365e-01) * {q} - 2.400758277161838) * {q} - 2.549732539343734) * {q} + 4.374664141464968) * {q} + 2.938163982698783)
    / ((((7.784695709041462e-03 * {q} + 3.224671290700398e-01) * {q} + 2.445134137142996) * {q} + 3.754408661907416) * {q} + 1)"""
_SHAPIRO = f"""sn AS (SELECT combo, x, row_number() OVER (PARTITION BY combo ORDER BY x) AS k, count(*) OVER (PARTITION BY combo) AS n FROM sw WHERE x IS NOT NULL),
su AS (SELECT *, (k - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS u, u - 0.5::DOUBLE AS h, h * h AS r, sqrt(-2 * ln(least(u, 1 - u))) AS q FROM sn),
sm AS (SELECT combo, x, k, n, CASE WHEN u < 0.02425 THEN {_TAIL.format(q="q")} WHEN u > 1 - 0.02425 THEN -({_TAIL.format(q="q")})
  ELSE (((((-3.969683028665376e+01 * r + 2.209460984245205e+02) * r - 2.759285104469687e+02) * r + 1.383577518672690e+02) * r - 3.066479806614716e+01) * r + 2.506628277459239) * h
    / (((((-5.447609879822406e+01 * r + 1.615858368580409e+02) * r - 1.556989798598866e+02) * r + 6.680131188771972e+01) * r - 1.328068155288572e+01) * r + 1) END AS m FROM su),
sx AS (SELECT *, sum(m * m) OVER g AS mm, max(m) OVER g AS m1, max(m) FILTER (k < n) OVER g AS m2, 1 / sqrt(n) AS f, avg(x) OVER g AS mean FROM sm WINDOW g AS (PARTITION BY combo)),
sy AS (SELECT *, m1 / sqrt(mm) + ((((-2.706056 * f + 4.434685) * f - 2.071190) * f - 0.147981) * f + 0.221157) * f AS a1,
  m2 / sqrt(mm) + ((((-3.582633 * f + 5.682633) * f - 1.752461) * f - 0.293762) * f + 0.042981) * f AS a2 FROM sx),
sz AS (SELECT *, CASE WHEN n = 3 THEN (k - 2) * sqrt(0.5) WHEN k = n THEN a1 WHEN k = 1 THEN -a1 WHEN n > 5 AND k = n - 1 THEN a2 WHEN n > 5 AND k = 2 THEN -a2
  WHEN n > 5 THEN m / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) ELSE m / sqrt((mm - 2 * m1 * m1) / (1 - 2 * a1 * a1)) END AS a FROM sy),
sv AS (SELECT combo, any_value(n) AS n, CASE WHEN any_value(n) >= 3 AND max(x) > min(x) THEN least(1, pow(sum(a * x), 2) / sum(pow(x - mean, 2))) END AS w FROM sz GROUP BY combo),
st AS (SELECT *, ln(greatest(1 - w, 1e-300)) AS l, ln(n) AS g FROM sv),
sp AS (SELECT *, CASE WHEN n <= 11 THEN (-ln(0.459 * n - 2.273 - l) - (0.5440 - 0.39978 * n + 0.025054 * n * n - 0.0006714 * n * n * n)) / exp(1.3822 - 0.77857 * n + 0.062767 * n * n - 0.0020322 * n * n * n)
  ELSE (l - (-1.5861 - 0.31082 * g - 0.083751 * g * g + 0.0038915 * g * g * g)) / exp(-0.4803 - 0.082676 * g + 0.0030302 * g * g) END AS z FROM st)"""
_SHAPIRO_OUT = f"SELECT combo, n::BIGINT AS n, round(w, 6) AS w, round(CASE WHEN z >= 0 THEN ({_NORMAL}) / 2 ELSE 1 - ({_NORMAL}) / 2 END, 6) AS p FROM sp"

SQL = {
    "parse_metrics": f"{_WITH} SELECT {KEYS}, cosine_sim_base AS cos_base, lev_dist_base AS lev_base, cosine_sim_corrected AS cos_corr, lev_dist_corrected AS lev_corr FROM parsed",
    "valid_rows": f"{_WITH} SELECT {KEYS}, invalid FROM bad",
    "evaluable_rows": f"{_WITH} SELECT {KEYS}, coalesce(strategy_applicable, false) AS evaluable FROM results",
    "empty_answers": f"{_WITH} SELECT {KEYS} FROM results WHERE final_answer IS NULL OR final_answer = '' OR strategy_applicable IS NULL",
    "enrich_metrics": f"{_WITH} SELECT {KEYS}, cosine_sim_diff, lev_dist_diff, {', '.join(R.FLAGS)} FROM e",
    "change_bins": f"""{_WITH} SELECT CASE WHEN cosine_sim_diff <= -1e-4 THEN 'worse' WHEN cosine_sim_diff <= 1e-4 THEN 'same' ELSE 'better' END AS cosine,
      CASE WHEN -lev_dist_diff <= -1e-4 THEN 'worse' WHEN -lev_dist_diff <= 1e-4 THEN 'same' ELSE 'better' END AS lev, count(*) AS n FROM e GROUP BY 1, 2""",
    "applicability": f"""{_WITH}, p AS (SELECT doc_id, bool_or(coalesce(strategy_applicable, false)) AS has FROM results GROUP BY 1)
      SELECT count(*) AS total_documents, count(*) FILTER (has) AS evaluable_documents, round(count(*) FILTER (has) / count(*) * 100, 6) AS evaluable_documents_pct FROM p""",
    "strategy_summary": f"{_WITH}, {_SUMMARY} SELECT * FROM s",
    "strategy_summary_pop": f"{_WITH} SELECT strategy_combo, round(stddev_pop(cosine_sim_diff), 6) AS cosine_std_diff, round(stddev_pop(lev_dist_diff), 6) AS lev_std_diff FROM e GROUP BY 1",
    "composite_score": f"{_WITH}, {_COMPOSITE} SELECT * FROM k",
    "by_strategy": f"{_WITH} {_BY.format(c='choose_cluster_strategy')}",
    "strategy_stack": f"{_WITH} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, {c} AS strategy, overall_improved, overall_worsened_pct, count FROM ({_BY.format(c=c)})" for c in R.STRATEGIES
    ),
    "pivot_pair": f"{_WITH} SELECT choose_cluster_strategy, "
    + ", ".join(f"round(avg(overall_improved::INT) FILTER (choose_answer_strategy = '{v}') * 100, 6) AS {v}" for v in ANSWER)
    + " FROM e GROUP BY 1",
    "compare_langs": f"""{_WITH}, a AS (SELECT strategy_combo, round(count(*) FILTER (overall_improved) / count(*) * 100, 6) AS left_value FROM e WHERE lang = 'en' GROUP BY 1),
      b AS (SELECT strategy_combo, round(count(*) FILTER (overall_improved) / count(*) * 100, 6) AS right_value FROM e WHERE lang <> 'en' GROUP BY 1)
      SELECT *, round(right_value - left_value, 6) AS delta, round((left_value + right_value) / 2, 6) AS mean_value FROM a JOIN b USING (strategy_combo)""",
    "drop_invalid_docs": f"{_WITH} SELECT doc_id, count(*) AS n FROM bad WHERE doc_id NOT IN (SELECT doc_id FROM bad WHERE invalid) GROUP BY 1",
    "topk": f"""{_WITH}, {_COMPOSITE} (SELECT *, 'top' AS "end" FROM k ORDER BY composite_score DESC, strategy_combo LIMIT 5)
      UNION ALL (SELECT *, 'bottom' AS "end" FROM k ORDER BY composite_score, strategy_combo LIMIT 5)""",
    "value_counts": f"{_WITH} SELECT final_answer, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS pct FROM results WHERE final_answer IS NOT NULL GROUP BY 1",
    "describe_diff": f"""{_WITH} SELECT choose_answer_strategy, count(cosine_sim_diff) AS n, round(avg(cosine_sim_diff), 6) AS mean, round(stddev_samp(cosine_sim_diff), 6) AS std,
      min(cosine_sim_diff) AS least, max(cosine_sim_diff) AS greatest, round(quantile_cont(cosine_sim_diff, 0.25), 6) AS q25,
      round(quantile_cont(cosine_sim_diff, 0.5), 6) AS q50, round(quantile_cont(cosine_sim_diff, 0.75), 6) AS q75 FROM e GROUP BY 1""",
    "ecdf": f"""{_WITH}, i AS (SELECT choose_cluster_strategy, lev_dist_diff AS value, row_number() OVER (PARTITION BY choose_cluster_strategy ORDER BY lev_dist_diff)
      / count(*) OVER (PARTITION BY choose_cluster_strategy) AS step FROM e)
      SELECT choose_cluster_strategy, value, count(*) AS n, round(min(step), 9) AS first_step, round(max(step), 9) AS last_step FROM i GROUP BY 1, 2""",
    "density": """WITH v AS (SELECT p_retailprice::DOUBLE AS v FROM part), w AS (SELECT count(*) AS n, min(v) AS low, max(v) AS high, stddev_samp(v) * pow(count(*), -0.2) AS h FROM v),
      b AS (SELECT least(floor((v - low) / (high - low) * 400), 399) AS bin, count(*) AS m, avg(v) AS c FROM v, w GROUP BY 1),
      g AS (SELECT k::INT AS point, low - 3 * h + (high - low + 6 * h) * k / 199 AS x, n, h FROM w, unnest(range(0, 200)) AS u(k))
      SELECT point, round(x, 6) AS x, round(sum(m * exp(-0.5 * pow((x - c) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 9) AS density FROM g, b GROUP BY point, x""",
    "wilcoxon_exact": """WITH RECURSIVE d AS (SELECT p_brand || '-' || p_size AS combo, p_retailprice - 1400.003::DOUBLE - p_partkey / 100000::DOUBLE AS d FROM part),
      r AS (SELECT combo, d, row_number() OVER (PARTITION BY combo ORDER BY abs(d)) AS r FROM d WHERE d <> 0),
      t AS (SELECT combo, count(*) AS n, least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0)) AS w0, coalesce(sum(r) FILTER (d > 0), 0) AS p, coalesce(sum(r) FILTER (d < 0), 0) AS m FROM r GROUP BY 1),
      c AS (SELECT 0::BIGINT AS n, [1.0::DOUBLE] AS a UNION ALL
        SELECT n + 1, list_transform(range(1, len(a) + n + 2), lambda i: coalesce(a[i], 0) + CASE WHEN i > n + 1 THEN a[i - n - 1] ELSE 0 END) FROM c WHERE n < 50)
      SELECT combo, t.n, least(p, m)::DOUBLE AS w, round(least(1, 2 * list_sum(a[1:least(p, m)::BIGINT + 1]) / pow(2, t.n)), 9) AS p FROM t JOIN c ON t.n = c.n""",
    "histogram": f"""{_WITH} SELECT least(floor((lev_dist_diff + 40) / 80 * 20), 19)::BIGINT AS bin, count(*) AS n FROM e
      WHERE lev_dist_diff BETWEEN -40 AND 40 GROUP BY 1""",
    "worsened": f"""{_WITH} SELECT CASE WHEN cosine_worsened AND lev_worsened THEN 'both' WHEN cosine_worsened THEN 'cosine_only' WHEN lev_worsened THEN 'lev_only'
      ELSE 'none' END AS category, count(*) AS n, count(DISTINCT doc_id) AS documents FROM e GROUP BY 1""",
    "combo_vs_all": f"{_WITH} SELECT "
    + ", ".join(
        f"round(avg({c}{t}) FILTER (strategy_combo = '{BEST}') - avg({c}{t}), 6) AS {c}_gain"
        for c, t in (("overall_improved", "::INT"), ("cosine_improved", "::INT"), ("lev_improved", "::INT"), ("cosine_sim_diff", ""), ("lev_dist_diff", ""))
    )
    + " FROM e",
    "distinct_docs": f"{_WITH} SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT final_answer) AS answers FROM e",
    "slice_rows": "SELECT DISTINCT doc_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100",
    "resume_anti": f"""{_WITH} SELECT doc_id, count(*) AS n FROM results WHERE doc_id NOT IN (SELECT doc_id FROM results
      WHERE final_answer LIKE 'answer%' AND choose_answer_strategy = 'combined_score' AND doc_id % 2 = 0) GROUP BY 1""",
    "strategy_filters": f"""{_WITH} SELECT doc_id, score_chunk_strategy FROM e WHERE corrected_metrics <> '--None--' AND score_chunk_strategy IN
      ('only_weight', 'equal_weight_score_diff') AND overall_improved AND choose_cluster_strategy = 'weighted_score' AND choose_answer_strategy = 'combined_score'""",
    "friedman_stat": f"""{_STATS} {_R}, f AS (SELECT * FROM r WHERE k = (SELECT max(k) FROM r)), b AS (SELECT combo, sum(r) AS rs, count(*) AS n, any_value(k) AS k FROM f GROUP BY 1),
      u AS (SELECT sum(rs * rs) AS ss, max(n) AS n, max(k) AS k FROM b), g AS (SELECT sum(ties * ties - 1) AS t FROM f),
      v AS (SELECT n, k, round((12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - t / (n * (k * k * k - k))), 6) AS statistic FROM u, g)
      SELECT n, k, statistic, round({_CHI2}, 6) AS p FROM v""",
    "nemenyi_ranks": f"""{_STATS} {_R}, m AS (SELECT combo, avg(r) AS m FROM r GROUP BY 1)
      SELECT combo, round(m, 6) AS mean_rank, round(max(m) OVER () - m, 6) AS behind_best FROM m""",
    "nemenyi": f"""{_STATS} {_R}, m AS (SELECT combo, avg(r) AS m, count(*) AS n, max(k) AS k FROM r WHERE k = (SELECT max(k) FROM r) GROUP BY 1),
      pr AS (SELECT a.combo AS "left", b.combo AS "right", abs(a.m - b.m) / sqrt(a.k * (a.k + 1) / (6 * a.n)) * sqrt(2) AS q, a.k FROM m a JOIN m b ON a.combo < b.combo),
      st AS (SELECT i, -9 + i * 0.018::DOUBLE AS z, (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 0.018::DOUBLE / 3 AS w FROM range(0, 1001) AS t(i)),
      nd AS (SELECT z, w, exp(-z * z / 2) / sqrt(2 * pi()) AS d FROM st)
      SELECT "left", "right", round(greatest(0, least(1, 1 - any_value(k) * sum(nd.w * d * pow({_PHI.format(x='z + q')} - {_PHI.format(x='z')}, k - 1)))), 6) AS p FROM pr, nd GROUP BY 1, 2""",
    "wilcoxon_w": f"{_STATS} {_DIFF} {_W} SELECT * REPLACE (round(p, 6) AS p) FROM w",
    "shapiro_wilk": f"WITH RECURSIVE sw AS (SELECT c_nationkey AS combo, c_acctbal::DOUBLE AS x FROM customer), {_SHAPIRO} {_SHAPIRO_OUT}",
    "shapiro_strategies": f"{_STATS}, sw AS (SELECT combo, x::DOUBLE AS x FROM x), {_SHAPIRO} {_SHAPIRO_OUT}",
    "wilcoxon_zero": f"{_STATS}, diff AS (SELECT combo, x AS d FROM x) {_W} SELECT * REPLACE (round(p, 6) AS p) FROM w",
    "effect_r": f"""{_STATS} {_DIFF} {_W}, v AS (SELECT combo, n, w, abs(w / sqrt(n * (n + 1) * (2 * n + 1) / 6)) / sqrt(n) AS r FROM w)
      SELECT combo, n, w, round(r, 6) AS r, CASE WHEN r < 0.1 THEN 'negligible' WHEN r < 0.3 THEN 'small' WHEN r < 0.5 THEN 'medium' ELSE 'large' END AS effect FROM v""",
    "fdr_bh": f"""{_STATS} {_DIFF} {_W} {_P}, q AS (SELECT *, row_number() OVER (ORDER BY p, combo) AS k, count(*) OVER () AS m FROM t)
      SELECT combo, round(least(min(p * m / k) OVER (ORDER BY k DESC), 1), 6) AS p_adjusted FROM q""",
    "bonferroni": f"{_STATS} {_DIFF} {_W} {_P} SELECT combo, round(p * count(*) OVER (), 6) AS p_adjusted FROM t",
    "cliffs_delta": f"""{_STATS}, v AS (SELECT o.combo, round(avg(sign(b.x - o.x)), 9) AS delta FROM x o, x b WHERE b.combo = '{BEST}' AND o.combo <> '{BEST}' GROUP BY 1)
      SELECT *, CASE WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS effect FROM v""",
    "practical_sig": f"""{_STATS} SELECT combo, round(count(*) FILTER (x > 0.05) / count(x) * 100, 6) AS gain_pct, round(count(*) FILTER (x < -0.05) / count(x) * 100, 6) AS loss_pct,
      round(count(*) FILTER (abs(x) <= 0.05) / count(x) * 100, 6) AS same_pct, round(quantile_cont(x, 0.5), 6) AS median,
      round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr FROM x GROUP BY 1""",
    "welch_t": f"""{_STATS}, m AS (SELECT avg(x) FILTER (combo = '{BEST}') AS m0, avg(x) FILTER (combo = '{OTHERS[0]}') AS m1,
      var_samp(x) FILTER (combo = '{BEST}') / count(*) FILTER (combo = '{BEST}') AS a, var_samp(x) FILTER (combo = '{OTHERS[0]}') / count(*) FILTER (combo = '{OTHERS[0]}') AS b,
      count(*) FILTER (combo = '{BEST}') AS n0, count(*) FILTER (combo = '{OTHERS[0]}') AS n1 FROM x),
      s AS (SELECT (m0 - m1) / sqrt(a + b) AS t, pow(a + b, 2) / (a * a / (n0 - 1) + b * b / (n1 - 1)) AS freedom FROM m)
      SELECT round(t, 6) AS t, round(freedom, 4) AS freedom, round({_STUDENT}, 6) AS p FROM s""",
    "strategy_moments": f"""{_STATS} SELECT combo, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(quantile_cont(x, 0.5), 6) AS median,
      min(x) AS least, max(x) AS greatest, count(x) AS n FROM x GROUP BY 1""",
}

QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

"""Strategy results: cleaning, metric parsing, flags and grouped summaries.

All operators are DataFrame expressions; rows are (document, three strategies).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("score_chunk_strategy", "choose_cluster_strategy", "choose_answer_strategy")
#: Fixed value: the marker of rows without an answer.
INVALID = "--No valid answers--"
METRICS = "cosine_sim double, lev_dist double"


def parse_metrics(metrics: Column) -> Column:
    """Struct (cosine_sim, lev_dist) of a JSON or Python-dict text; 0 for what is missing
    or can't be read."""
    read = F.from_json(metrics, METRICS)
    return F.struct(
        F.coalesce(read["cosine_sim"], F.lit(0.0)).alias("cosine_sim"), F.coalesce(read["lev_dist"], F.lit(0.0)).alias("lev_dist")
    )


def invalid_row() -> Column:
    """Rows without a final answer, or with the marker as a strategy; never null."""
    blank = F.regexp_replace("final_answer", r"(?U)^\s+|\s+$", "") == ""
    marked = reduce(Column.__or__, (F.col(c) == INVALID for c in STRATEGIES))
    return F.col("final_answer").isNull() | F.coalesce((F.col("final_answer") == INVALID) | blank, F.lit(False)) | F.coalesce(marked, F.lit(False))


def valid_rows(results: DataFrame) -> DataFrame:
    return results.where(~invalid_row())


def invalid_rows(results: DataFrame) -> DataFrame:
    return results.where(invalid_row())


def evaluable(results: DataFrame) -> Column:
    """Rows whose strategies had a choice; all where the diagnostic column is absent."""
    if "strategy_applicable" not in results.columns:
        return F.lit(True)
    return F.coalesce(F.col("strategy_applicable"), F.lit(False))


def empty_answers(results: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null or empty value in any of ``columns``."""
    missing = [c for c in columns if c not in results.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return results.where(reduce(Column.__or__, (F.col(c).isNull() | (F.col(c).cast("string") == "") for c in columns)))


def enrich(results: DataFrame) -> DataFrame:
    """Parsed metrics, their differences (corrected less base) and ten flags.

    A greater cosine and a smaller edit distance are improvements.
    """
    out = results.withColumn("_b", parse_metrics(F.col("base_metrics"))).withColumn("_c", parse_metrics(F.col("corrected_metrics")))
    out = out.withColumns(
        {
            "cosine_sim_base": F.col("_b.cosine_sim"),
            "lev_dist_base": F.col("_b.lev_dist"),
            "cosine_sim_corrected": F.col("_c.cosine_sim"),
            "lev_dist_corrected": F.col("_c.lev_dist"),
            "cosine_sim_diff": F.col("_c.cosine_sim") - F.col("_b.cosine_sim"),
            "lev_dist_diff": F.col("_c.lev_dist") - F.col("_b.lev_dist"),
        }
    ).drop("_b", "_c")
    cos, lev = F.col("cosine_sim_diff"), F.col("lev_dist_diff")
    up, down, same = (cos > 0) & (lev < 0), (cos < 0) & (lev > 0), (cos == 0) & (lev == 0)
    return out.withColumns(
        {
            "cosine_improved": cos > 0,
            "cosine_worsened": cos < 0,
            "cosine_unchanged": cos == 0,
            "lev_improved": lev < 0,
            "lev_worsened": lev > 0,
            "lev_unchanged": lev == 0,
            "overall_improved": up,
            "overall_worsened": down,
            "overall_mixed": ~(up | down | same),
            "overall_unchanged": same,
        }
    )


FLAGS = [f"{m}_{k}" for m in ("cosine", "lev") for k in ("improved", "worsened", "unchanged")] + [
    f"overall_{k}" for k in ("improved", "worsened", "mixed", "unchanged")
]


def legacy_distance_change(before: Column, after: Column) -> Column:
    """The older sign of a distance's change: what it fell by."""
    return before - after


def append(results: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of further results at the end; columns that one side lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), more, results)


def change_bin(difference: Column, margin: float = 1e-4) -> Column:
    """Right-closed bins: worse up to -margin, same up to margin, better above."""
    return F.when(difference <= -margin, "worse").when(difference <= margin, "same").when(difference > margin, "better")


def applicability(results: DataFrame) -> DataFrame:
    """Documents, those with any evaluable row, and the percentage (0 without documents)."""
    per = results.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bool_or(evaluable(results)).alias("some"))
    return per.agg(F.count(F.lit(1)).alias("total_documents"), F.count_if("some").alias("evaluable_documents")).withColumn(
        "evaluable_documents_pct",
        F.when(F.col("total_documents") > 0, F.round(F.col("evaluable_documents") / F.col("total_documents") * 100, 6)).otherwise(0.0),
    )


def combo() -> Column:
    return F.concat(STRATEGIES[0], F.lit("_"), STRATEGIES[1], F.lit("_"), STRATEGIES[2])


def summary(enriched: DataFrame, population: bool = False) -> DataFrame:
    """Counts, percentages, means and deviations of every strategy combination; rows with a
    null strategy are in none. ``population`` chooses the population deviation."""
    std = F.stddev_pop if population else F.stddev_samp
    n = F.count(F.lit(1))
    known = enriched.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in STRATEGIES)))
    aggs = [n.alias("total_samples")]
    for flag in FLAGS:
        aggs += [F.count_if(flag).alias(flag), F.round(F.count_if(flag) / n * 100, 6).alias(f"{flag}_pct")]
    for name, column in (("cosine", "cosine_sim_diff"), ("lev", "lev_dist_diff")):
        aggs += [F.round(F.avg(column), 6).alias(f"{name}_mean_diff"), F.round(std(column), 6).alias(f"{name}_std_diff")]
    return known.groupBy(*STRATEGIES).agg(*aggs).withColumn("strategy_combo", combo())


def composite(summary_table: DataFrame) -> DataFrame:
    """Weighted score of a summary: gains overall, in cosine and distance, less losses."""
    score = F.col("overall_improved_pct") * 0.4 + F.col("cosine_improved_pct") * 0.3 + F.col("lev_improved_pct") * 0.3 - F.col("overall_worsened_pct") * 0.2
    return summary_table.withColumn("composite_score", F.round(score, 6))


def by_strategy(enriched: DataFrame, column: str) -> DataFrame:
    """Means of one strategy dimension; shares are rounded to four places before they
    become percentages."""
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 4)
    flags = ("overall_improved", "cosine_improved", "lev_improved", "overall_worsened")
    out = (
        enriched.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(
            *(share(c).alias(c) for c in flags),
            F.round(F.avg("cosine_sim_diff"), 4).alias("cosine_mean_diff"),
            F.round(F.stddev_samp("cosine_sim_diff"), 4).alias("cosine_std_diff"),
            F.round(F.avg("lev_dist_diff"), 4).alias("lev_mean_diff"),
            F.round(F.stddev_samp("lev_dist_diff"), 4).alias("lev_std_diff"),
            F.count("doc_id").alias("count"),
        )
    )
    return out.withColumns({f"{c}_pct": F.round(F.col(c) * 100, 2) for c in flags})


def stacked(enriched: DataFrame) -> DataFrame:
    """``by_strategy`` of all three dimensions under each other."""
    parts = [by_strategy(enriched, c).withColumnRenamed(c, "strategy").withColumn("dimension", F.lit(c)) for c in STRATEGIES]
    return reduce(DataFrame.unionByName, parts)


def pivot_pair(enriched: DataFrame, rows: str, columns: str, values: list[str], flag: str = "overall_improved") -> DataFrame:
    """Percentage of ``flag`` by two dimensions; ``values`` become columns."""
    wide = enriched.groupBy(rows).pivot(columns, values).agg(F.avg(F.col(flag).cast("int")) * 100)
    return wide.select(rows, *(F.round(F.col(v), 6).alias(v) for v in values))


def compare(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Two summaries side by side, with difference and mean of ``value``."""
    a = left.select("strategy_combo", F.col(value).alias("left_value"))
    b = right.select("strategy_combo", F.col(value).alias("right_value"))
    return a.join(b, "strategy_combo").withColumns(
        {"delta": F.round(F.col("right_value") - F.col("left_value"), 6), "mean_value": F.round((F.col("left_value") + F.col("right_value")) / 2, 6)}
    )


def drop_invalid_documents(results: DataFrame) -> DataFrame:
    """Rows of documents that have no invalid row."""
    return results.join(invalid_rows(results).select("doc_id").distinct(), "doc_id", "left_anti")


def extremes(frame: DataFrame, column: str, key: str, k: int) -> DataFrame:
    """The k greatest and k least rows by ``column``, ties by ``key``."""
    top = frame.orderBy(F.col(column).desc(), key).limit(k).withColumn("end", F.lit("top"))
    return top.unionByName(frame.orderBy(column, key).limit(k).withColumn("end", F.lit("bottom")))


def value_counts(frame: DataFrame, column: str) -> DataFrame:
    """Counts and percentages of the non-null values."""
    counts = frame.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100, 6))


def describe(frame: DataFrame, group: str, column: str) -> DataFrame:
    quantiles = F.percentile(column, [0.25, 0.5, 0.75])
    out = frame.groupBy(group).agg(
        F.count(column).alias("n"),
        F.round(F.avg(column), 6).alias("mean"),
        F.round(F.stddev_samp(column), 6).alias("std"),
        F.min(column).alias("least"),
        F.max(column).alias("greatest"),
        quantiles.alias("q"),
    )
    return out.select("*", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75")))).drop("q")


def ecdf(frame: DataFrame, group: str, column: str) -> DataFrame:
    """Empirical distribution by group: for each value the number of rows and the first
    and last step. Rows are counted by value before values are ordered."""
    counts = frame.where(F.col(column).isNotNull()).groupBy(group, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(group).orderBy("value")
    whole = F.sum("n").over(Window.partitionBy(group))
    last = F.sum("n").over(upto)
    return counts.select(
        group, "value", "n", F.round((last - F.col("n") + 1) / whole, 9).alias("first_step"), F.round(last / whole, 9).alias("last_step")
    )


def histogram(frame: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts of equal bins; the last one includes its end."""
    number = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1))
    inside = frame.where((F.col(column) >= low) & (F.col(column) <= high))
    return inside.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(frame: DataFrame, column: str, points: int = 200, bins: int = 400) -> DataFrame:
    """``(point, x, density)``: a Gaussian kernel density of a column at ``points`` places,
    from three bandwidths below its least value to three above its greatest. The bandwidth is
    the standard deviation times n to the power -1/5.

    Values are counted in ``bins`` bins first, each of which counts at its mean value, so
    what is smoothed does not grow with the rows. Nulls do not count; without two different
    values there is no row.
    """
    values = frame.select(F.col(column).cast("double").alias("v")).where("v is not null")
    whole = values.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("s"), F.min("v").alias("low"), F.max("v").alias("high")).where("s > 0")
    whole = whole.withColumn("h", F.col("s") * F.pow(F.col("n"), F.lit(-0.2)))
    number = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    binned = values.join(F.broadcast(whole.select("low", "high"))).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.avg("v").alias("at"))
    # One row with all bins, and one with the whole; the grid is what is exploded.
    listed = binned.agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("b")).join(F.broadcast(whole))
    grid = listed.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("low") - 3 * F.col("h") + (F.col("high") - F.col("low") + 6 * F.col("h")) * F.col("point") / (points - 1)
    kernel = F.aggregate("b", F.lit(0.0), lambda s, b: s + b["m"] * F.exp(-0.5 * F.pow((F.col("x") - b["at"]) / F.col("h"), 2)))
    return grid.withColumn("x", x).select("point", "x", (kernel / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def worsened_report(enriched: DataFrame) -> DataFrame:
    """Rows by which metrics worsened."""
    cos, lev = F.col("cosine_worsened"), F.col("lev_worsened")
    kind = F.when(cos & lev, "both").when(cos, "cosine_only").when(lev, "lev_only").otherwise("none")
    return enriched.groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


def combo_against_all(enriched: DataFrame, chosen: str) -> DataFrame:
    """Means of one combination less the means of all rows."""
    of = lambda c: F.avg(F.when(combo() == chosen, F.col(c)))
    flags = {c: F.col(c).cast("int") for c in ("overall_improved", "cosine_improved", "lev_improved")}
    wide = enriched.withColumns(flags)
    return wide.agg(*(F.round(of(c) - F.avg(c), 6).alias(f"{c}_gain") for c in (*flags, "cosine_sim_diff", "lev_dist_diff")))


def slice_rows(frame: DataFrame, key: str, start: int, limit: int) -> DataFrame:
    """Rows ``start .. start + limit - 1`` in order of ``key``; only the rows up to the
    end of the slice are kept while sorting."""
    return frame.orderBy(key).offset(start).limit(limit)


def not_done(frame: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is not yet among the written ones."""
    return frame.join(done.select(key).distinct(), key, "left_anti")

"""Mixing sources to target weights by capped water-filling.

Source sizes come from one grouped aggregate. The water level is found in closed form:
in order of cap/weight, a source is capped while its share at the level of the rest
exceeds its cap; the budget left is shared by weight among the others.

Every document is taken a whole number of times, and the words that are then left to the
target come from one more repetition of a seeded sample: documents in order of a hash, as
many as fit whole, and of the next one a fraction. Where the sample of a source ends is
found from sums over ranges of the hash and then within one range, so no source is ever
sorted or gathered as a whole, and texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise

#: Hexadecimal digits of the hash whose ranges are summed, step by step; each step looks into
#: one range of the step before, so a source has at most 256 ranges at a time.
RANGE_DIGITS = (2, 4, 6, 16)
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, budget: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    Sources take ``weights`` in turn, in code point order, null last; the sizes times
    ``budget`` are shared by weight, a source gets at most ``max_epochs`` times its size,
    and what is above is shared again until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    listed = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.expr(f"element_at(array({', '.join(f'{w}D' for w in weights)}), cast((place - 1) % {len(weights)} + 1 as int))")
    ranked = (
        totals.withColumn("place", F.row_number().over(listed))
        .withColumn("weight", turn)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("whole", F.sum("source_size").over(everything) * F.lit(float(budget)))
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("left", F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("heavy", F.sum("weight").over(after))
        .withColumn("capped", F.col("left") * F.col("weight") >= F.col("cap") * F.col("heavy"))
    )
    # The first source that is not capped, in filling order, sets the level of all after it.
    first = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "place", "left", "heavy"))).over(everything)
    return levels.withColumn("level", first).select(
        "source",
        "source_size",
        F.when(
            F.col("level").isNull() | (F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "place") < F.struct("level.ratio", "level.place")),
            F.col("cap"),
        )
        .otherwise(F.col("level.left") * F.col("weight") / F.col("level.heavy"))
        .alias("target"),
    )


def _draw(seed: str) -> Column:
    """The hash that orders the documents of a source."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 16)


def sample_ends(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``(source, end, room, own)``: the hash at which a source's sample ends, the words
    still to be taken there and the size of all documents with that hash.

    ``sizes (source, draw, size)``; ``plan (source, extra)``: words of the sample. Sources
    without a sample have no row.
    """
    at = plan.where("extra > 0").select(F.col("source").alias("p_source"), F.lit("").alias("prefix"), "extra")
    for digits in RANGE_DIGITS:
        inside = sizes.join(broadcast_if_small(at.select("p_source", "prefix", "extra")), F.col("source").eqNullSafe(F.col("p_source")) & F.col("draw").startswith(F.col("prefix")))
        parts = inside.groupBy("source", "extra", F.substring("draw", 1, digits).alias("part")).agg(F.sum("size").alias("s"))
        before = F.sum("s").over(Window.partitionBy("source").orderBy("part")) - F.col("s")
        found = parts.withColumn("before", before).where((F.col("before") < F.col("extra")) & (F.col("before") + F.col("s") >= F.col("extra")))
        at = materialise(found.select(F.col("source").alias("p_source"), F.col("part").alias("prefix"), (F.col("extra") - F.col("before")).alias("extra"), "s"))
    return at.select(F.col("p_source").alias("source"), F.col("prefix").alias("end"), F.col("extra").alias("room"), F.col("s").alias("own"))


def mix_sources(
    docs: DataFrame,
    budget: float = 1.5,
    max_epochs: float = 2.0,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    seed: str = "mix",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every document, and columns ``keep``.

    A source is read ``target / source_size`` times. All its documents are taken the whole
    part of that; of the words left, those documents that come first by a hash of ``seed``
    and doc_id are taken once more, and the one at which the words run out as far as they
    go. So a source's words are its target but for rounding, ``taken div size`` repetitions
    of a document are whole, and reruns agree.

    Null text has size 0 and gives nothing; a source of size 0 has target 0; null is a
    source of its own. Repeated rows count each time; rows with equal doc_id have equal
    hashes and, where the words run out, share what is left by size, rounded down. Very long
    texts are counted whole. An empty table gives an empty result; other columns do not
    matter. Sources are a row each in one task.
    """
    sizes = materialise(docs.select("doc_id", F.col("source").alias("source"), word_count(F.col("text")).alias("size"), _draw(seed).alias("draw")))
    targets = source_targets(sizes.select("source", "size"), budget, max_epochs, weights)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("whole", F.floor(rate)).withColumn("extra", F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size"))
    plan = materialise(plan)
    ends = sample_ends(sizes.select("source", "draw", "size"), plan).withColumnRenamed("source", "e_source")
    plan = plan.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source").withColumnRenamed("source", "t_source")
    plan = broadcast_if_small(materialise(plan))

    rows = sizes
    if keep:
        rows = docs.select("doc_id", F.col("source").alias("source"), word_count(F.col("text")).alias("size"), _draw(seed).alias("draw"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    once_more = (
        F.when(F.col("end").isNull() | (F.col("draw") > F.col("end")), F.lit(0))
        .when(F.col("draw") < F.col("end"), F.col("size"))
        .otherwise(F.expr("size * room div own"))
    )
    most = F.floor(F.col("size") * F.lit(float(max_epochs)))
    return rows.join(plan, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.least(F.col("whole") * F.col("size") + once_more, most).cast("long").alias("taken"),
        *(F.col(f"keep_{c}").alias(c) for c in keep),
    )

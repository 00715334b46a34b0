"""Dense vectors as arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A text's vector as a column function or a pandas UDF; models take the place of the built-in one.
Encoder = Callable[[Column], Column]
#: Buckets of the built-in bag-of-words encoder.
DIMENSIONS = 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (a one-element transform binds it)."""
    return F.transform(F.array(value), body)[0]


def evaluated(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """``frame`` with a column that is made once a row: filters and projections over it are
    merged with a plain column, and pushed into joins, so they would make it again in each
    place that reads it. A generator of one row keeps it where it is."""
    return frame.select("*", F.explode(F.array(value)).alias(name))


def runs(ordered: Column, key=lambda x: x) -> Column:
    """Array of (at, n): places, from 1, and lengths of the stretches of equal keys in a sorted
    array."""
    starts = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: (i == 1) | (key(F.get(ordered, i - 1)) != key(F.get(ordered, i - 2))))
    ends = lambda at: F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(ordered) + 1))
    found = bound(starts, lambda at: F.zip_with(at, ends(at), lambda a, b: F.struct(a.alias("at"), (b - a).alias("n"))))
    return F.when(F.size(ordered) > 0, found).otherwise(F.array().cast("array<struct<at:int,n:int>>"))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays zero. Similarities of unit vectors are
    dot products, so norms are computed once a row and not once a pair."""

    def scaled(x: Column) -> Column:
        return bound(F.sqrt(dot(x, x)), lambda n: F.when(n > 0, F.transform(x, lambda y: y / n)).otherwise(x))

    return bound(v.cast("array<double>"), scaled)


def similarity(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, to nine places so that equal texts tie exactly."""
    return F.round(dot(a, b), 9)


def bucket_of(word: Column) -> Column:
    """The bucket of a word in the built-in encoder."""
    return F.conv(F.substring(F.sha2(word, 256), 1, 4), 16, 10).cast("int") % DIMENSIONS


def encode_words(words: DataFrame, keys: list[str], word: str = "word") -> DataFrame:
    """``(*keys, vector)``: counts of words in ``DIMENSIONS`` buckets of a SHA-256 hash.

    Words are counted before they are hashed; buckets are summed as sixteen aggregates.
    """
    counted = words.groupBy(*keys, word).agg(F.count(F.lit(1)).alias("m"))
    sums = [F.coalesce(F.sum(F.when(F.col("_b") == k, F.col("m"))), F.lit(0)).cast("double") for k in range(DIMENSIONS)]
    return counted.withColumn("_b", bucket_of(F.col(word))).groupBy(*keys).agg(F.array(*sums).alias("vector"))


def encode_text(text: Column) -> Column:
    """The same encoder for a short text in place (lower-cased words)."""
    words = F.filter(F.split(F.lower(text), r"\s+", -1), lambda w: w != "")
    buckets = F.transform(words, bucket_of)
    places = F.sequence(F.lit(0), F.lit(DIMENSIONS - 1))
    return bound(buckets, lambda found: F.transform(places, lambda k: F.size(F.filter(found, lambda b: b == k)).cast("double")))


def total(vectors: Column) -> Column:
    """The sum of an array of vectors."""
    return F.aggregate(F.slice(vectors, F.lit(2), F.greatest(F.size(vectors) - 1, F.lit(0))), F.get(vectors, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))


def masked_mean(tokens: DataFrame, keys: list[str], vector: str, mask: str, floor: float = 1e-9) -> DataFrame:
    """``(*keys, vector)``: mean of token vectors whose ``mask`` is one."""
    parts = tokens.select(*keys, F.col(mask).cast("double").alias("_m"), F.posexplode(vector).alias("_i", "_x"))
    means = parts.groupBy(*keys, "_i").agg((F.sum(F.col("_x").cast("double") * F.col("_m")) / F.greatest(F.sum("_m"), F.lit(floor))).alias("_x"))
    return means.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda s: F.round(s["_x"], 6)).alias("vector"))

"""URL filter lists as a sort-merge range join.

A host is reversed by labels, each ended by a byte below all others (``www.example.com`` ->
``com\\0example\\0www\\0``), so no label runs into a longer one; a path follows after a mark.
A rule's host and path make one key, and the urls that a rule fits are an interval of keys:
those with the rule's key as prefix. A rule without a path ends with its host and so holds
all subdomains. Rules open at their key and close at key + 0xFF. Intervals of prefixes are
nested or apart, so a sweep over the sorted events needs only the stack of rules that are
open: a running sum of openings and closings is its height, and the last rule opened at a
height is the entry of that height. A url takes the top of the stack where it is met.

Keys of urls and rules are dealt together by ranges of the key, each key once, so neither a
hot host nor a hot path makes a task larger. What is open where a range begins are the rules
whose keys are prefixes of its first key: no more than that key has bytes. They are carried
into the range, and nothing else is copied. The sweep of a range is two window functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_spread, materialise, partitions, release

#: Hosts of rules up to which their set is broadcast to leave out suffixes without rules.
BROADCAST_HOSTS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``; A-Z lower-cased; empty if there is none."""
    after = F.substring_index(url, "://", 1)
    tail = url.substr(F.length(after) + 4, F.length(url))
    host = F.translate(F.regexp_extract(tail, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(F.when(F.instr(url, "://") > 0, host), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``? #``; empty without ``://``."""
    after = F.substring_index(url, "://", 1)
    tail = url.substr(F.length(after) + 4, F.length(url))
    path = F.regexp_extract(tail, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(F.instr(url, "://") > 0, path), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table of literals."""
    kind = "array<struct<verdict:string,host:string,path:string>>"
    listed = F.array(*(F.struct(*map(F.lit, r)) for r in rules)).cast(kind) if rules else F.array().cast(kind)
    return spark.range(1).select(F.inline(listed))


def _labels(host: Column) -> Column:
    """Labels from the last to the first, without the bytes that end and mark them."""
    plain = host
    for i, mark in ((2, "c"), (1, "b"), (0, "a")):
        plain = F.replace(plain, F.lit(chr(i)), F.lit("\2" + mark))
    return F.reverse(F.split(plain, r"\.", -1))


def _host_key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "\0"), F.lit("\0"))


def rule_events(rules: DataFrame) -> DataFrame:
    """``(k, kind, step, item)``: opening (1) and closing (-1) of each rule."""
    key = F.concat(_host_key(_labels(F.col("host"))), F.when(F.col("path") != "", F.concat(F.lit("\1"), "path")).otherwise(F.lit("")))
    keyed = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .withColumn("host", F.translate("host", UPPER, LOWER))
        .groupBy(F.encode(key, "UTF-8").alias("k"))
        .agg(F.max(F.struct("verdict", F.concat("host", "path").alias("rule"))).alias("v"))
        .select("k", F.struct(F.length("v.rule").alias("n"), F.col("v.rule").alias("rule"), F.col("v.verdict").alias("verdict")).alias("item"))
    )
    opens = keyed.select("k", F.lit(0).alias("kind"), F.lit(1).alias("step"), "item")
    closes = keyed.select(F.expr("concat(k, X'FF')").alias("k"), F.lit(1).alias("kind"), F.lit(-1).alias("step"))
    return opens.unionByName(closes, allowMissingColumns=True)


def url_levels(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """``(host, path, k)``: the key of each url under each of its host's suffixes that has no
    more labels than a rule's host and, where the rules' hosts are counted to be few, is one."""
    hosts = rules.where("host is not null").select(F.encode(_host_key(_labels(F.translate("host", UPPER, LOWER))), "UTF-8").alias("suffix")).distinct()
    depth = rules.agg(F.coalesce(F.max(F.size(F.split("host", r"\.", -1))), F.lit(1))).first()[0]
    levels = (
        keys.withColumn("labels", _labels(F.col("host")))
        .withColumn("level", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(depth)))))
        .withColumn("suffix", F.encode(_host_key(F.expr("slice(labels, 1, level)")), "UTF-8"))
    )
    if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        levels = levels.join(F.broadcast(hosts), "suffix", "left_semi")
    return levels.select("host", "path", F.concat("suffix", F.encode(F.concat(F.lit("\1"), "path"), "UTF-8")).alias("k"))


def sweep(points: DataFrame, events: DataFrame, parts: int) -> DataFrame:
    """``(k, m, top)``: the rule with the longest key among those that hold the point ``k``,
    for the points ``(k, m)`` that any rule holds.

    ``events`` are those of ``rule_events``; keys of points are distinct. Work is dealt by
    ``parts`` ranges of keys.
    """
    both = points.select("k", "m", F.lit(2).alias("kind"), F.lit(0).alias("step")).unionByName(events, allowMissingColumns=True)
    # Written once, so that ranges stay what they are.
    dealt = materialise(both.repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id()))
    opens = dealt.where("kind = 0").select("k", "step", "kind", "item")
    longest = opens.agg(F.coalesce(F.max(F.length("k")), F.lit(0))).first()[0]
    heads = (
        dealt.groupBy("part")
        .agg(F.min("k").alias("first"))
        .where((F.length("first") > 1) & F.lit(longest > 0))
        .select("part", F.explode(F.expr(f"transform(sequence(1, least(length(first) - 1, {max(longest, 1)})), i -> substring(first, 1, i))")).alias("k"))
    )
    carried = heads.join(opens, "k")
    upto = lambda *by: Window.partitionBy("part", *by).orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        dealt.unionByName(carried, allowMissingColumns=True)
        .withColumn("height", F.sum("step").over(upto()))
        .withColumn("top", F.last("item", ignorenulls=True).over(upto("height")))
        .where((F.col("kind") == 2) & (F.col("height") > 0))
        .select("k", "m", "top")
    )
    found = materialise(found)
    release(dealt)
    return found


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Verdict of every row: ``(id_col, host, path, rule, verdict)``.

    A rule (verdict, host, path) fits its host and all subdomains where the url's path
    starts with the rule's path; one with an empty path fits whole hosts. The longest rule
    string wins; of several of that length the greatest string, and of two rules with the
    same host and path the greater verdict (``block``). Rules with a null host or path fit
    nothing.

    Null urls and urls without ``://`` have an empty host and path and get ``default``
    unless a rule with an empty host fits them. Repeated rows and ids are judged one by
    one; an empty table gives an empty result; other columns of ``pages`` are ignored,
    whatever their names. Very long urls are keys like others.
    """
    parsed = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    keys = materialise(parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")))
    levels = url_levels(keys, rules)
    held = sweep(levels.groupBy("k").agg(F.count(F.lit(1)).alias("m")), rule_events(rules), partitions(pages.sparkSession))
    best = join_spread(levels, held, ["k"], "m").groupBy("host", "path").agg(F.max("top").alias("top"))
    judged = keys.join(best, ["host", "path"], "left")
    return join_spread(parsed, judged, ["host", "path"], "n").select(
        id_col, "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict")
    )

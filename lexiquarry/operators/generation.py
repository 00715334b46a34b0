"""Answers over windows of long texts, and generated answers.

A window is a part of the text itself, so an answer's place in it is a place in the document,
and windows that overlap agree on what they both find.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import answers as A
from .qa import NOT_FOUND, Answerer, context_tail, rule_answerer

#: White space, as a set of a pattern.
BLANKS = r"\x20\x09-\x0D"
#: A word and the white space after it.
WORD = rf"[^{BLANKS}]+[{BLANKS}]*"
#: The context and the question have these names in a template.
TEMPLATE = "Answer strictly by the text below. If it does not say, write 'Not stated in the text'.\n\nText:\n{context}\n\nQuestion: {question}"
#: Replies begin after the last of these, if there, and end before the first of those.
REPLY_AFTER, REPLY_BEFORE = "<|assistant|>", ("Question:", "<|end|>")


def text_windows(docs: DataFrame, size: int = 512, stride: int = 128, column: str = "text") -> DataFrame:
    """``(doc_id, window, first_char, text)``: windows of ``size`` words, each with the last
    ``stride`` words of the one before; the last one ends with the text. ``text`` is the
    document's from character ``first_char`` on. Blank and null texts have none."""
    if not 0 <= stride < size:
        raise ValueError("stride must be at least 0 and less than size")
    step = size - stride
    words = F.regexp_extract_all(F.col(column), F.lit(WORD), F.lit(0))
    lead = F.length(column) - F.length(F.regexp_replace(column, rf"^[{BLANKS}]+", ""))
    cut = docs.select("doc_id", lead.alias("_lead"), words.alias("_w")).where(F.size("_w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("_w") - size) / step)).cast("int")
    part = lambda k, n: F.array_join(F.slice("_w", k * step + 1, F.lit(n)), "")
    passed = F.transform(F.sequence(F.lit(0), last), lambda k: F.length(part(k, step)))
    # Where windows begin: a sum over windows, of which there are few, not over words.
    starts = F.aggregate(passed, F.array("_lead"), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)), lambda acc: F.slice(acc, 1, F.size(acc) - 1))
    whole = F.transform(starts, lambda at, k: F.struct(at.alias("first_char"), part(k, size).alias("text")))
    return cut.select("doc_id", F.posexplode(whole).alias("window", "_p")).select("doc_id", "window", "_p.first_char", "_p.text")


def windowed_answers(docs: DataFrame, question: str, answerer: Answerer = rule_answerer, size: int = 512, stride: int = 128, most: int = 100, impossible: bool = True) -> DataFrame:
    """``(doc_id, answer, score, start, end, windows, agreeing)``: the best answer over the
    windows of each document, ``start`` and ``end`` being characters of the document.

    Answers of over ``most`` words count for nothing. One span found by several windows has
    its greatest score and the number of windows as ``agreeing``; of equal scores the first
    span counts. A window without an answer says with its score that there is none; one with
    an answer of score s says so with 1 - s. The least of these is the document's score of no
    answer, and with ``impossible`` it is an empty answer that competes with the others.
    Documents without any have nulls, blank ones 0 windows. Rows of one ``doc_id`` are one
    document.
    """
    asked = text_windows(docs, size, stride).withColumn("_a", answerer(F.lit(question), F.col("text")))
    inside = (F.col("_a.end") > F.col("_a.start")) & (F.col("_a.start") >= 0) & (F.col("_a.end") <= F.length("text"))
    short = F.size(F.regexp_extract_all("_a.answer", F.lit(WORD), F.lit(0))) <= most
    found = F.coalesce(inside & (F.trim("_a.answer") != ""), F.lit(False))
    score = F.coalesce("_a.score", F.lit(0.0))
    rows = asked.select(
        "doc_id",
        F.when(found & short, F.col("first_char") + F.col("_a.start")).alias("start"),
        F.when(found & short, F.col("first_char") + F.col("_a.end")).alias("end"),
        F.when(found & short, F.col("_a.answer")).alias("answer"),
        score.alias("score"),
        F.when(found, 1 - score).otherwise(score).alias("none"),
    )
    spans = rows.groupBy("doc_id", "start", "end").agg(
        F.max("score").alias("score"), F.min("answer").alias("answer"), F.count(F.lit(1)).alias("agreeing"), F.min("none").alias("none")
    )
    best = F.max(F.when(F.col("start").isNotNull(), F.struct("score", (-F.col("start")).alias("before"), (-F.col("end")).alias("shorter"), "answer", "agreeing")))
    result = spans.groupBy("doc_id").agg(best.alias("b"), F.min("none").alias("none"), F.sum("agreeing").alias("windows"))
    empty = F.col("none") > F.coalesce("b.score", F.lit(-1.0)) if impossible else F.lit(False)
    of = lambda c: F.when(~F.col("empty"), c)
    chosen = result.withColumn("empty", empty).select(
        "doc_id",
        F.when(F.col("empty"), "").otherwise(F.col("b.answer")).alias("answer"),
        F.when(F.col("empty"), F.col("none")).otherwise(F.col("b.score")).alias("score"),
        of(-F.col("b.before")).alias("start"),
        of(-F.col("b.shorter")).alias("end"),
        "windows",
        of(F.col("b.agreeing")).alias("agreeing"),
    )
    return docs.select("doc_id").join(chosen, "doc_id", "left").withColumn("windows", F.coalesce("windows", F.lit(0)))


def prompt(context: Column, question: Column, template: str = TEMPLATE) -> Column:
    """The template with context and question in their places; braces in these are plain."""
    head, rest = template.split("{context}")
    middle, tail = rest.split("{question}")
    return F.concat(F.lit(head), context, F.lit(middle), question, F.lit(tail))


def reply(text: Column, after: str = REPLY_AFTER, before: Sequence[str] = REPLY_BEFORE) -> Column:
    """What a generated text says: after the last ``after``, before the first of ``before``."""
    said = F.substring_index(text, after, -1) if after else text
    for marker in before:
        said = F.substring_index(said, marker, 1)
    return F.trim(F.regexp_replace(said, rf"^[{BLANKS}]+|[{BLANKS}]+$", ""))


def generated_answers(docs: DataFrame, question: str, tokens: Column, generate: Callable[[Column], Column], most: int = 16384, template: str = TEMPLATE, after: str = REPLY_AFTER, before: Sequence[str] = REPLY_BEFORE) -> DataFrame:
    """``(doc_id, answer)``: the reply of a generating model to the last ``most`` tokens of
    each text, where conclusions stand, and the question. Blank texts are not asked; they and
    empty replies have the marker. Errors stay as the model's function gives them."""
    context = F.array_join(context_tail(tokens, most), " ")
    rows = docs.select("doc_id", context.alias("_c"))
    # A null prompt is not asked.
    asked = F.when(F.trim("_c") != "", prompt(F.col("_c"), F.lit(question), template))
    said = rows.select("doc_id", generate(asked).alias("_r"))
    answer = F.when(F.col("_r").startswith("[ERROR]"), F.col("_r")).otherwise(reply(F.col("_r"), after, before))
    return said.select("doc_id", F.coalesce(F.nullif(answer, F.lit("")), F.lit(NOT_FOUND)).alias("answer"))


def best_of_windows(docs: DataFrame, question: str, generate: Callable[[Column], Column], score: Callable[[Column], Column], size: int = 6000, stride: int = 200, template: str = TEMPLATE) -> DataFrame:
    """``(doc_id, window, answer)``: as ``generated_answers``, with a reply to every window of a
    text, of which the one of greatest ``score`` stays, the first among equals. Errors stay
    only where all windows have them; blank texts are left out."""
    asked = text_windows(docs, size, stride).withColumn("_r", generate(prompt(F.trim("text"), F.lit(question), template)))
    failed = F.col("_r").startswith("[ERROR]")
    rows = asked.select("doc_id", "window", F.when(failed, F.col("_r")).otherwise(reply(F.col("_r"))).alias("answer"), failed.alias("_f"))
    rank = F.when(F.col("_f") | (F.col("answer") == ""), -1e300).otherwise(score(F.col("answer")))
    best = A.first_by(rows, ["doc_id"], rank, F.col("window"))
    return best.select("doc_id", "window", F.coalesce(F.nullif("answer", F.lit("")), F.lit(NOT_FOUND)).alias("answer"))

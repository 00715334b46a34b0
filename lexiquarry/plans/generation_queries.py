"""Queries of windowed and generated answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import models as M
from ..operators import generation as G
from ..operators.qa import NOT_FOUND
from .fixtures import table
from .keyword_queries import QUESTION

SIZE, STRIDE, TAIL = 40, 10, 50


def long_word(question: Column, context: Column) -> Column:
    """The first word of nine or more letters, scored by its length; a window without one says
    so with 0.5."""
    word = F.regexp_extract(context, "[A-Za-z]{9,}", 0)
    at = (F.instr(context, word) - 1).cast("int")
    score = F.when(word == "", 0.5).otherwise(F.length(word) / 20)
    return F.struct(word.alias("answer"), score.alias("score"), at.alias("start"), (at + F.length(word)).cast("int").alias("end"))


def echo_model():
    """A model that repeats the prompt and says how many words the text has and its last one;
    it goes on to a question of its own, as small models do. It fails on texts with a bar."""

    def replies(prompts: list[str]) -> list[str]:
        if any("|" in p for p in prompts):
            raise ValueError("a bar")
        texts = [p.split("Text:\n", 1)[1].rsplit("\n\nQuestion:", 1)[0] for p in prompts]
        return [f"{p}<|assistant|> {len(t.split())} words, {t.split()[-1]}\nQuestion: what else?<|end|>" for p, t in zip(prompts, texts)]

    return replies


def q_text_windows(spark, sf):
    found = G.text_windows(table(spark, sf, "documents"), SIZE, STRIDE)
    return found.select("doc_id", "window", "first_char", F.md5("text").alias("digest"))


def q_windowed_answers(spark, sf):
    found = G.windowed_answers(table(spark, sf, "documents"), QUESTION, long_word, SIZE, STRIDE)
    return found.withColumn("score", F.round("score", 6))


def q_windowed_possible(spark, sf):
    """As ``windowed_answers``, without the answer that there is none."""
    found = G.windowed_answers(table(spark, sf, "documents"), QUESTION, long_word, SIZE, STRIDE, impossible=False)
    return found.withColumn("score", F.round("score", 6))


def q_generated_answers(spark, sf):
    words = F.filter(F.split("text", rf"[{G.BLANKS}]+", -1), lambda w: w != "")
    return G.generated_answers(table(spark, sf, "documents"), QUESTION, words, M.generator("echo", echo_model), TAIL)


def q_generated_windows(spark, sf):
    """The longest of the replies to the windows of a document."""
    return G.best_of_windows(table(spark, sf, "documents"), QUESTION, M.generator("echo", echo_model), F.length, SIZE, STRIDE)


_STEP = SIZE - STRIDE
_WINDOWS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{G.WORD}') AS w, length(text) - length(regexp_replace(text, '^[{G.BLANKS}]+', '')) AS lead FROM documents WHERE text IS NOT NULL),
win AS (SELECT doc_id, k::INT AS "window", (lead + coalesce(length(array_to_string(w[1:k * {_STEP}], '')), 0))::INT AS first_char, array_to_string(w[k * {_STEP} + 1:k * {_STEP} + {SIZE}], '') AS text
  FROM w, unnest(range(0, greatest(0, ceil((len(w) - {SIZE}) / {_STEP}))::BIGINT + 1)) AS u(k) WHERE len(w) > 0)"""


def _windowed(impossible: bool) -> str:
    empty = "n.none > coalesce(b.score, -1)" if impossible else "false"
    return f"""{_WINDOWS}, a AS (SELECT *, regexp_extract(text, '[A-Za-z]{{9,}}') AS answer FROM win),
      s AS (SELECT doc_id, "window", answer, CASE WHEN answer = '' THEN 0.5 ELSE length(answer) / 20 END AS score, (first_char + instr(text, answer) - 1)::INT AS start FROM a),
      n AS (SELECT doc_id, min(CASE WHEN answer = '' THEN score ELSE 1 - score END) AS none, count(*) AS windows FROM s GROUP BY 1),
      g AS (SELECT doc_id, start, (start + length(answer))::INT AS "end", answer, max(score) AS score, count(*) AS agreeing FROM s WHERE answer <> '' GROUP BY ALL),
      b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) = 1)
      SELECT d.doc_id, CASE WHEN {empty} THEN '' ELSE b.answer END AS answer, round(CASE WHEN {empty} THEN n.none ELSE b.score END, 6) AS score,
        CASE WHEN NOT ({empty}) THEN b.start END AS start, CASE WHEN NOT ({empty}) THEN b."end" END AS "end", coalesce(n.windows, 0) AS windows, CASE WHEN NOT ({empty}) THEN b.agreeing END AS agreeing
      FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN b ON d.doc_id = b.doc_id"""


_SAID = "len(t) || ' words, ' || t[-1]"

SQL = {
    "text_windows": f"{_WINDOWS} SELECT doc_id, \"window\", first_char, md5(text) AS digest FROM win",
    "windowed_answers": _windowed(True),
    "windowed_possible": _windowed(False),
    "generated_answers": f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^{G.BLANKS}]+')[-{TAIL}:] AS t FROM documents)
      SELECT doc_id, CASE WHEN coalesce(len(t), 0) = 0 THEN '{NOT_FOUND}' WHEN contains(array_to_string(t, ' '), '|') THEN '[ERROR] a bar' ELSE {_SAID} END AS answer FROM t""",
    "generated_windows": f"""{_WINDOWS}, t AS (SELECT doc_id, "window", contains(text, '|') AS bar, regexp_extract_all(text, '[^{G.BLANKS}]+') AS t FROM win),
      s AS (SELECT doc_id, "window", bar, CASE WHEN bar THEN '[ERROR] a bar' ELSE {_SAID} END AS answer FROM t)
      SELECT doc_id, "window", answer FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN bar THEN -1 ELSE length(answer) END DESC, "window") = 1""",
}

QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

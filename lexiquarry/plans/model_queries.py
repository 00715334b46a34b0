"""Queries of the model seams: table functions in lateral joins, resumable calls and stems;
their SQL."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from ..functions import models as M
from ..functions import stems
from ..operators import keywords as K
from ..sources.resumable import answer_all
from ..sources.staging import fresh_folder
from .fixtures import table
from .keyword_queries import _ANSWERS, _CHUNKS, _SHARES, QUESTION, chunks, dealt_chunks, keywords

PHRASE = "semantic segmentation"


def rule_model():
    """The rules of the built-in answerer, as a model in Python."""

    def answer(question: str, context: str) -> dict:
        at = context.find(PHRASE)
        found = PHRASE if at >= 0 else context.split(".", 1)[0]
        return {"answer": found, "score": 0.9, "start": max(at, 0), "end": max(at, 0) + len(found)}

    return answer


def share_model():
    """The built-in source of attention, as a model in Python."""

    def words(question: str, context: str) -> list[tuple[str, float]]:
        found = [w for w in re.split(r"\s+", re.sub(r"[^\w\s]+", " ", context).lower()) if w]
        return [(w, round(n / len(found), 9)) for w, n in Counter(found).items() if len(w) > 1]

    return words


def q_answer_udtf(spark, sf):
    found = M.lateral(chunks(spark, sf), M.answer_function("rules", rule_model), QUESTION)
    return found.select("doc_id", "chunk_idx", F.col("answer").alias("text"), F.col("score").alias("confidence"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


def q_attention_udtf(spark, sf):
    found = M.lateral(dealt_chunks(spark, sf), M.attention_function("shares", share_model), QUESTION)
    return found.groupBy("doc_id", "word").agg(F.round(F.max("weight"), 6).alias("weight"), F.count(F.lit(1)).alias("n_chunks"))


def first_sentence():
    """A deterministic model that fails on texts with a bar."""

    def answer(text: str | None) -> str:
        head = (text or "").split(".", 1)[0]
        if "|" in head:
            raise ValueError("a table")
        return head

    return answer


def q_resumable_answers(spark, sf):
    """Two runs into one folder: the second asks only for what the first was not given."""
    docs, folder = table(spark, sf, "documents"), fresh_folder(spark)
    answer_all(docs.where("lang = 'en'"), folder, first_sentence, batch=50, buckets=16)
    return answer_all(docs, folder, first_sentence, batch=50, buckets=16).select("doc_id", "status", "answer")


def q_stem_words(spark, sf):
    """Stems of all words of the documents, with the number of documents they are in."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{2,}"), F.lit(0))
    counts = table(spark, sf, "documents").select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("documents"))
    return counts.select("word", "documents", stems.stemmer("en")(F.col("word")).alias("stem"))


def q_score_chunks_stems(spark, sf):
    """Chunks scored by keywords of which the stems count besides the words."""
    k = K.add_lemma_and_stem(keywords(spark, sf), F.lower, stems.stemmer("en"))
    return K.score_chunks(K.matched_chunks(dealt_chunks(spark, sf), k)).select("doc_id", "chunk_idx", "score")


SQL = {
    "answer_udtf": f"""{_CHUNKS}, {_ANSWERS} SELECT doc_id, chunk_idx, answer AS text, 0.9::DOUBLE AS confidence,
      (CASE WHEN contains(whole, '{PHRASE}') THEN instr(whole, '{PHRASE}') - 1 ELSE 0 END)::INT AS start_pos,
      (CASE WHEN contains(whole, '{PHRASE}') THEN instr(whole, '{PHRASE}') + 20 ELSE length(answer) END)::INT AS end_pos FROM fa""",
    "attention_udtf": f"{_CHUNKS}, {_SHARES} SELECT doc_id, word, round(max(weight), 6) AS weight, count(*) AS n_chunks FROM sx GROUP BY 1, 2",
    "resumable_answers": f"""WITH h AS (SELECT doc_id, string_split(coalesce(text, ''), '.')[1] AS a FROM documents)
      SELECT doc_id, CASE WHEN contains(a, '|') THEN 'error' WHEN regexp_matches(a, '^\\s*$') THEN 'missing' ELSE 'success' END AS status,
        CASE WHEN contains(a, '|') THEN '[ERROR] a table' ELSE a END AS answer FROM h""",
}

QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

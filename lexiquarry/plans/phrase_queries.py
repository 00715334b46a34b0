"""Queries of the chunk filters and scores with keywords of several words and with hyphens,
and of several questions to a document; their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import keywords as K
from ..operators import qa as Q
from ..sources.staging import staged
from .fixtures import documents, frequent_words
from .keyword_queries import _COS, _VEC, _density, _score
from .text_queries import CHUNKS_SQL, MAX_TOKENS, OVERLAP

#: Long words next to each other become one with a hyphen, as the tables have few.
HYPHENS = r"(\p{L}{6,}) (\p{L}{5,})"
#: Of each kind of keyword, the most frequent ones of a document: number and pattern.
KINDS = [(4, r"\p{L}{4,}"), (3, r"\p{L}+(?:-\p{L}+)+"), (3, r"\p{L}{2,} \p{L}{2,}(?: \p{L}{2,})?")]


def docs(spark, sf):
    return documents(spark, sf).withColumn("text", F.regexp_replace("text", HYPHENS, "$1-$2"))


def chunks(spark, sf):
    return C.build_chunks(docs(spark, sf), MAX_TOKENS, OVERLAP)


def keywords(spark, sf):
    """Words, hyphenated words and phrases of two or three words; the stem is what stands
    before the first blank or hyphen, so it begins the term."""
    return frequent_words(docs(spark, sf), KINDS).select(
        "doc_id", "kw_idx", "word", (1 / (1 + F.col("kw_idx"))).alias("weight"), F.col("word").alias("lemma"), F.regexp_extract("word", r"^\p{L}+", 0).alias("stem"), ((F.length("word") % 5) / 4.0).alias("score_diff")
    )


def _matched(spark, sf):
    return K.matched_chunks(chunks(spark, sf), keywords(spark, sf))


def _found(spark, sf):
    return K.matched_chunks(chunks(spark, sf), keywords(spark, sf), places=False)


def _off_ties(score: str):
    """Four places; scores of these keywords often lie halfway between two."""
    return F.round(F.col(score) + 1.86e-5, 4)


def q_filter_chunks_phrases(spark, sf):
    return K.filter_chunks(_found(spark, sf), 3).select("doc_id", "chunk_idx")


def q_filter_chunks_lemstem_phrases(spark, sf):
    return K.filter_chunks_by_word(_found(spark, sf), 3).select("doc_id", "chunk_idx")


def q_filter_chunks_raw_phrases(spark, sf):
    return K.filter_chunks_raw(chunks(spark, sf), keywords(spark, sf), 3).select("doc_id", "chunk_idx", "found")


def q_keyword_hits(spark, sf):
    """Every match with its place and keyword."""
    hits = _matched(spark, sf).select("doc_id", "chunk_idx", F.explode("hits").alias("h"))
    return hits.select("doc_id", "chunk_idx", "h.start", "h.word", "h.k")


def q_score_chunks_phrases(spark, sf):
    rows = K.score_chunks(_matched(spark, sf))
    return rows.select("doc_id", "chunk_idx", "score", F.array_join("matched", "|").alias("matched"), F.array_join(F.transform("keyword_scores", lambda k: k["n"].cast("string")), "|").alias("numbers"))


def q_score_advanced_phrases(spark, sf):
    return K.score_advanced(chunks(spark, sf), keywords(spark, sf), 0.7, minimum=2).select("doc_id", "chunk_idx", "score")


def q_score_density_phrases(spark, sf):
    return K.score_density(_matched(spark, sf)).select("doc_id", "chunk_idx", _off_ties("score").alias("score"))


def q_filter_and_score_phrases(spark, sf):
    return K.score_density(K.filter_chunks_by_word(_matched(spark, sf), 2)).where("score >= 2").select("doc_id", "chunk_idx", _off_ties("score").alias("score"))


def questions(spark, sf, found=None):
    """Three questions to a document: its first three keywords, of those ``found``."""
    k = (keywords(spark, sf) if found is None else found).where("kw_idx < 3")
    return k.select("doc_id", F.col("kw_idx").alias("question_no"), F.concat(F.lit("What is said of "), "word", F.lit("?")).alias("question"))


def said_of(question, context):
    """An answerer that depends on the question: what follows the first mention of its
    subject, up to a dot; without one, what stands before the first dot, with a lower score."""
    subject = F.regexp_extract(question, r"said of (.*)\?$", 1)
    at = F.instr(F.lower(context), subject)
    answer = F.substring_index(F.when(at > 0, F.substring(context, at, F.length(context))).otherwise(context), ".", 1)
    start = F.greatest(at - 1, F.lit(0))
    return F.struct(answer.alias("answer"), F.when(at > 0, 0.9).otherwise(0.4).alias("score"), start.cast("int").alias("start"), (start + F.length(answer)).cast("int").alias("end"))


MODELS = Q.Models(answerer=said_of)
CONFIG = Q.PipelineConfig(chunk_max_tokens=MAX_TOKENS, overlap_tokens=OVERLAP)


def q_question_answers(spark, sf):
    found = Q.find_answers_to(chunks(spark, sf), questions(spark, sf), said_of)
    return found.select("doc_id", "question_no", "answer_idx", "chunk_idx", "text", "confidence", "start_pos", "end_pos")


def q_baseline_questions(spark, sf):
    found = Q.baseline_questions(docs(spark, sf), questions(spark, sf), CONFIG, MODELS)
    return found.select("doc_id", "idx", "question_no", "text", "confidence", "support", "n_answers", "chunks_used")


def q_baseline_questions_filtered(spark, sf):
    k = staged(keywords(spark, sf))
    found = Q.baseline_questions(docs(spark, sf), questions(spark, sf, k), CONFIG, MODELS, k.where("kw_idx between 3 and 5"))
    return found.select("doc_id", "idx", "question_no", "text", "confidence", "support", "n_answers", "chunks_used")


_DOCS = rf"hdocs AS (SELECT * REPLACE (regexp_replace(text, '{HYPHENS}', '\1-\2', 'g') AS text) FROM documents)"
_PCHUNKS = CHUNKS_SQL.replace("documents", "hdocs")
_KW = "kc AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {i} AS kind, word, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{p}')) AS word FROM hdocs) GROUP BY 1, 2, 3" for i, (_, p) in enumerate(KINDS)
) + f"""), kp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY m DESC, word) AS place FROM kc),
  kw AS (SELECT doc_id, kw_idx, word, 1 / (1 + kw_idx) AS weight, word AS lemma, regexp_extract(word, '^\\p{{L}}+') AS stem, (length(word) % 5) / 4.0::DOUBLE AS score_diff
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, kind) - 1 AS kw_idx FROM kp WHERE place <= {[n for n, _ in KINDS]}[kind + 1]))"""
_W = r"[\p{L}\p{N}_]"


def _hits(name: str, terms: str, order: str, low: str = "lower(text)") -> str:
    """Matches from left to right: at every start of a word the first term that ends with a
    word, and of these those that begin after the one before has ended."""
    return rf"""{name}_t AS ({terms}),
  {name}_w AS (SELECT doc_id, chunk_idx, low, unnest(w) AS word, generate_subscripts(w, 1) AS p, g FROM
    (SELECT doc_id, chunk_idx, {low} AS low, regexp_extract_all({low}, '{_W}+') AS w, regexp_split_to_array({low}, '{_W}+') AS g FROM chunks)),
  {name}_s AS (SELECT doc_id, chunk_idx, low, sum(length(g[p])) OVER o + coalesce(sum(length(word)) OVER b, 0) AS start FROM {name}_w
    WINDOW o AS (PARTITION BY doc_id, chunk_idx ORDER BY p ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY doc_id, chunk_idx ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  {name}_c AS (SELECT doc_id, chunk_idx, start::BIGINT AS start, arg_min(term, {order}) AS term FROM {name}_s JOIN {name}_t USING (doc_id)
    WHERE starts_with(substr(low, start::BIGINT + 1), term) AND NOT regexp_matches(substr(low, start::BIGINT + 1 + length(term), 1), '{_W}') GROUP BY 1, 2, 3),
  {name}_l AS (SELECT doc_id, chunk_idx, list_reduce(list([{{'s': start, 'e': start + length(term), 't': term}}] ORDER BY start),
    lambda a, x: CASE WHEN x[1].s >= a[-1].e THEN list_concat(a, x) ELSE a END) AS l FROM {name}_c GROUP BY 1, 2),
  {name} AS (SELECT doc_id, chunk_idx, h.s AS start, h.t AS word FROM (SELECT doc_id, chunk_idx, unnest(l) AS h FROM {name}_l))"""


_TERMS = "SELECT doc_id, term, max(kw_idx) AS k FROM (SELECT doc_id, kw_idx, lemma AS term FROM kw UNION ALL SELECT doc_id, kw_idx, stem FROM kw) GROUP BY 1, 2"
_HIT = f"""WITH RECURSIVE {_DOCS}, {_PCHUNKS}, {_KW}, {_hits('m', _TERMS, 'term')},
  hit AS (SELECT m.doc_id, chunk_idx, start, word, k FROM m JOIN m_t ON m.doc_id = m_t.doc_id AND m.word = m_t.term),
  hk AS (SELECT DISTINCT doc_id, chunk_idx, k FROM hit), kn AS (SELECT doc_id, count(*) AS kn FROM kw GROUP BY 1)"""
_ASKED = f"""qs AS (SELECT doc_id, kw_idx AS question_no, word FROM kw WHERE kw_idx < 3),
  qa0 AS (SELECT doc_id, question_no, chunk_idx, text AS whole, instr(lower(text), word) AS at_ FROM used JOIN qs USING (doc_id)),
  qa1 AS (SELECT doc_id, question_no, chunk_idx, string_split(CASE WHEN at_ > 0 THEN substr(whole, at_) ELSE whole END, '.')[1] AS text, CASE WHEN at_ > 0 THEN 0.9 ELSE 0.4 END::DOUBLE AS confidence,
    greatest(at_ - 1, 0)::INT AS start_pos FROM qa0),
  qa2 AS (SELECT *, (start_pos + length(text))::INT AS end_pos, (row_number() OVER (PARTITION BY doc_id, question_no ORDER BY confidence DESC, chunk_idx) - 1)::INT AS answer_idx FROM qa1)"""


def _asked(used: str) -> str:
    return f"""used AS ({used}), {_ASKED}, al AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY question_no, answer_idx) - 1)::INT AS idx, {_VEC.format('text')} AS v FROM qa2),
      ap AS (SELECT a.doc_id, a.idx, a.question_no, a.text, round(avg(b.confidence), 6) AS confidence, sum({_COS.format(a='a.v', b='b.v')}) AS s, count(*) AS n, count(*) FILTER (a.text = b.text) AS support
        FROM al a JOIN al b USING (doc_id) GROUP BY ALL),
      rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(s / n, 9) DESC, idx) AS rn FROM ap), uc AS (SELECT doc_id, count(*) AS chunks_used FROM used GROUP BY 1)
      SELECT hdocs.doc_id, idx, question_no, rk.text, confidence, support, n AS n_answers, coalesce(chunks_used, 0) AS chunks_used
      FROM hdocs LEFT JOIN rk ON hdocs.doc_id = rk.doc_id AND rn = 1 LEFT JOIN uc ON hdocs.doc_id = uc.doc_id"""


_RAW = "SELECT doc_id, word AS term, kw_idx AS k FROM kw"
SQL = {
    "filter_chunks_phrases": f"{_HIT} SELECT doc_id, chunk_idx FROM hit GROUP BY 1, 2 HAVING count(DISTINCT word) >= 3",
    "filter_chunks_lemstem_phrases": f"{_HIT} SELECT doc_id, chunk_idx FROM hit GROUP BY 1, 2 HAVING count(DISTINCT k) >= 3",
    "filter_chunks_raw_phrases": f"""WITH RECURSIVE {_DOCS}, {_PCHUNKS}, {_KW}, {_hits('m', _RAW, 'k')}
      SELECT doc_id, chunk_idx, count(DISTINCT substr(text, start + 1, length(word)))::INT AS found FROM m JOIN chunks USING (doc_id, chunk_idx) GROUP BY 1, 2 HAVING found >= 3""",
    "keyword_hits": f"{_HIT} SELECT doc_id, chunk_idx, start::INT AS start, word, k::INT AS k FROM hit",
    "score_chunks_phrases": f"""{_HIT}, nm AS (SELECT hit.doc_id, chunk_idx, kw.word, count(*) AS n FROM hit JOIN kw ON hit.doc_id = kw.doc_id AND k = kw_idx GROUP BY 1, 2, 3),
      na AS (SELECT doc_id, chunk_idx, string_agg(word, '|' ORDER BY word) AS matched, string_agg(n, '|' ORDER BY word) AS numbers FROM nm GROUP BY 1, 2)
      SELECT doc_id, chunk_idx, round(raw, 6) AS score, matched, numbers FROM {_score('0.5::DOUBLE')} JOIN na USING (doc_id, chunk_idx)""",
    "score_advanced_phrases": f"{_HIT} SELECT doc_id, chunk_idx, round(raw, 6) AS score FROM {_score('0.7::DOUBLE')} WHERE m >= 2",
    "score_density_phrases": f"{_HIT} SELECT doc_id, chunk_idx, round(score + 1.86e-5::DOUBLE, 4) AS score FROM {_density('0.5::DOUBLE')}",
    "filter_and_score_phrases": f"{_HIT} SELECT doc_id, chunk_idx, round(score + 1.86e-5::DOUBLE, 4) AS score FROM {_density('0.5::DOUBLE')} WHERE m >= 2 AND score >= 2",
    "question_answers": f"WITH RECURSIVE {_DOCS}, {_PCHUNKS}, {_KW}, used AS (SELECT * FROM chunks), {_ASKED} SELECT doc_id, question_no::INT AS question_no, answer_idx, chunk_idx, text, confidence, start_pos, end_pos FROM qa2",
    "baseline_questions": f"WITH RECURSIVE {_DOCS}, {_PCHUNKS}, {_KW}, {_asked('SELECT * FROM chunks')}",
    "baseline_questions_filtered": f"""WITH RECURSIVE {_DOCS}, {_PCHUNKS}, {_KW}, {_hits('m', _TERMS.replace('FROM kw', 'FROM (SELECT * FROM kw WHERE kw_idx BETWEEN 3 AND 5)'), 'term')},
      {_asked('SELECT * FROM chunks WHERE (doc_id, chunk_idx) IN (SELECT (doc_id, chunk_idx) FROM m)')}""",
}

QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

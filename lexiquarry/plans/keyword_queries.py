"""Queries of keywords, attention words, chunk scoring, answers and metrics; their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import chunks as C
from ..operators import keywords as K
from ..operators import qa as Q
from .answer_queries import _CL, _KEYS, _VALUES, NEAR, _chosen
from .fixtures import ANSWER, CLUSTER, documents, frequent_words, table
from .text_queries import CHUNKS_SQL, MAX_TOKENS, OVERLAP, RUSSIAN, SENTENCES, TOKENS, _exploded

QUESTION = "Which task does the text describe?"
MODES = {"only_score_diff": 0.0, "only_weight": 1.0, "equal_weight_score_diff": 0.5}
ASPECT = "of the and is to in"
CONFIG = Q.PipelineConfig(chunk_max_tokens=MAX_TOKENS, overlap_tokens=OVERLAP)


def _docs(spark, sf):
    return table(spark, sf, "documents")


def texts(spark, sf):
    """Sentences as the texts of a document."""
    return C.split_sentences(_docs(spark, sf)).withColumnRenamed("sent_pos", "text_id")


def dealt_texts(spark, sf):
    return C.split_sentences(documents(spark, sf)).withColumnRenamed("sent_pos", "text_id")


def keywords(spark, sf, n: int = 8):
    """The ``n`` most frequent words of four or more letters of a document."""
    return frequent_words(documents(spark, sf), [(n, r"\p{L}{4,}")]).select(
        "doc_id", "kw_idx", "word", (1 / (1 + F.col("kw_idx"))).alias("weight"), F.col("word").alias("lemma"), F.substring("word", 1, 6).alias("stem"), ((F.length("word") % 5) / 4.0).alias("score_diff")
    )


def chunks(spark, sf):
    return C.build_chunks(_docs(spark, sf), MAX_TOKENS, OVERLAP)


def dealt_chunks(spark, sf):
    """Chunks where their documents' keywords are made."""
    return C.build_chunks(documents(spark, sf), MAX_TOKENS, OVERLAP)


def _matched(spark, sf):
    return K.matched_chunks(dealt_chunks(spark, sf), keywords(spark, sf))


def _found(spark, sf):
    return K.matched_chunks(dealt_chunks(spark, sf), keywords(spark, sf), places=False)


def pieces(spark, sf, mark: str = "▁", inner: str = ""):
    """Turns cut in pieces of four characters; ``mark`` starts a word, ``inner`` the rest."""
    words = F.filter(F.split("text", r"\s+", -1), lambda w: w != "")
    cut = lambda w: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(w) - 1) / 4).cast("int")),
        lambda k: F.concat(F.when(k == 0, mark).otherwise(inner), F.substring(w, k * 4 + 1, F.lit(4))),
    )
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.flatten(F.transform(words, cut)).alias("tokens")).where(F.size("tokens") > 0)
    return t.withColumn("weights", F.transform(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: (i % 10) / 10.0))


def pairs(spark, sf):
    """A user's turn and the assistant's next one."""
    c = table(spark, sf, "conversations")
    gold = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("pred")).join(gold, ["conv_id", "turn"])


def q_ngrams(spark, sf):
    return _docs(spark, sf).select("doc_id", F.explode(K.ngrams(F.col("text"), 2)).alias("gram"))


def q_extract_keywords(spark, sf):
    return K.extract(_docs(spark, sf)).select("doc_id", "place", "word", F.round("similarity", 6).alias("similarity"))


def q_idf(spark, sf):
    return K.idf(texts(spark, sf)).select("doc_id", "word", "df", F.round("idf", 6).alias("idf"))


def q_idf_filter(spark, sf):
    return K.idf_filter(dealt_texts(spark, sf))


def q_dynamic_idf(spark, sf):
    return K.dynamic_idf(dealt_texts(spark, sf))


def q_characteristic(spark, sf):
    return K.characteristic(dealt_texts(spark, sf))


def q_characteristic_contrast(spark, sf):
    return K.characteristic_contrast(texts(spark, sf))


def q_characteristic_filter(spark, sf):
    return K.characteristic_filter(dealt_texts(spark, sf), targets=5)


def q_lemma_stem(spark, sf):
    return K.add_lemma_and_stem(keywords(spark, sf).select("doc_id", F.concat(F.lit("Task_"), "word").alias("word")))


def q_keyword_contrast(spark, sf):
    u = lambda c: Q.V.unit(Q.V.encode_text(c))
    found = K.contrast(keywords(spark, sf), u(F.lit("the task of the text")), u(F.lit("an answer by a model")))
    return found.select("doc_id", "word", F.round("score_diff", 6).alias("score_diff"))


def _batches(spark, sf):
    k = keywords(spark, sf).select("doc_id", (F.col("kw_idx") % 3).alias("batch"), "kw_idx", F.upper("word").alias("word"), "weight")
    t = texts(spark, sf).select("doc_id", (F.col("text_id") % 3).alias("batch"), "text")
    return k, t


def q_merge_keywords(spark, sf):
    return K.merge_batches(*_batches(spark, sf)).select("doc_id", "word", F.round("weight", 6).alias("weight"))


def q_dedup_keywords(spark, sf):
    k = keywords(spark, sf).select("doc_id", "kw_idx", F.substring("word", 1, 4).alias("word"), "weight")
    return K.deduplicate(k, ["doc_id"]).select("doc_id", "word", F.round("weight", 6).alias("weight"))


def q_kw_join(spark, sf):
    """Keywords with the stem and the number of documents of their word, of all words."""
    every = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0))
    words = _docs(spark, sf).select(F.explode(F.array_distinct(every)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("documents"))
    stems = words.withColumn("stem", F.substring("word", 1, 6))
    return keywords(spark, sf).select("doc_id", "word", F.round("weight", 6).alias("weight")).join(stems, "word")


def q_kw_by_cosine(spark, sf):
    found = K.by_cosine(keywords(spark, sf).select("doc_id", "word"), _docs(spark, sf))
    return found.select("doc_id", "place", "word", F.round("similarity", 6).alias("similarity"))


def q_kw_in_text(spark, sf):
    return K.in_text(keywords(spark, sf), _docs(spark, sf)).select("doc_id", "word")


def q_kw_stop(spark, sf):
    """All words of a document with their numbers, without stop words."""
    every = _docs(spark, sf).select("doc_id", F.explode(K.words(F.col("text"))).alias("word"))
    return K.without_stop_words(every).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


def q_special_tokens(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"\s+", -1)).alias("pos", "token"))
    return t.where(K.is_word_token(F.col("token")) & (F.col("token") != "")).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))


def q_attention_words(spark, sf):
    w = K.attention_words(pieces(spark, sf), ["conv_id", "turn"])
    return w.select("conv_id", "turn", "word_pos", "word", F.round(F.col("total") / F.col("m"), 6).alias("weight"))


def q_attention_wordpiece(spark, sf):
    w = K.attention_words(pieces(spark, sf, "", "##"), ["conv_id", "turn"])
    return w.select("conv_id", "turn", "word_pos", "word", F.round(F.col("total") / F.col("m"), 6).alias("weight"))


def q_attention_rank(spark, sf):
    w = K.attention_words(pieces(spark, sf), ["conv_id", "turn"])
    return K.attention_rank(w, ["conv_id", "turn"]).select("conv_id", "turn", "place", "word", F.round("weight", 6).alias("weight"))


def q_attention_words_legacy(spark, sf):
    return K.legacy_attention_words(pieces(spark, sf, "Ġ"), ["conv_id", "turn"]).select("conv_id", "turn", "word_pos", "word", F.round("weight", 6).alias("weight"))


def q_attn_norm(spark, sf):
    t = pieces(spark, sf).select("conv_id", "turn", F.posexplode("weights").alias("pos", "weight")).withColumn("weight", F.col("weight") + 0.1)
    return K.normalised(t, ["conv_id", "turn"]).select("conv_id", "turn", "pos", "share")


def q_filter_chunks(spark, sf):
    return K.filter_chunks(_found(spark, sf), 3).select("doc_id", "chunk_idx")


def q_filter_chunks_lemstem(spark, sf):
    return K.filter_chunks_by_word(_found(spark, sf), 3).select("doc_id", "chunk_idx")


def q_filter_chunks_raw(spark, sf):
    return K.filter_chunks_raw(dealt_chunks(spark, sf), keywords(spark, sf), 3).select("doc_id", "chunk_idx", "found")


def _scored(frame):
    return frame.select("doc_id", "chunk_idx", "score")


def q_score_chunks(spark, sf):
    return _scored(K.score_chunks(_matched(spark, sf)))


def q_score_advanced(spark, sf):
    """Keywords under the first three letters of their words, which several may share."""
    k = keywords(spark, sf).withColumn("word", F.substring("word", 1, 3))
    return _scored(K.score_advanced(dealt_chunks(spark, sf), k, 0.7, minimum=2, case_sensitive=True))


def q_score_density(spark, sf):
    return _scored(K.score_density(_matched(spark, sf)))


def q_filter_and_score(spark, sf):
    return _scored(K.score_density(K.filter_chunks_by_word(_matched(spark, sf), 2)).where("score >= 2"))


def q_scoring_modes(spark, sf):
    mode = F.explode(F.array(*(F.struct(F.lit(k).alias("mode"), F.lit(r).alias("ratio")) for k, r in MODES.items())))
    scored = K.score_chunks(_matched(spark, sf).withColumn("_m", mode).select("*", "_m.*"), F.col("ratio"))
    return scored.select("mode", "doc_id", "chunk_idx", "score")


def q_find_answers(spark, sf):
    return Q.find_answers(chunks(spark, sf), F.lit(QUESTION))


def q_find_scored_answers(spark, sf):
    found = Q.find_scored_answers(K.score_chunks(_matched(spark, sf)), F.lit(QUESTION))
    return found.select("doc_id", "answer_idx", "chunk_idx", "text", "confidence")


def q_rank_combined(spark, sf):
    found = Q.find_scored_answers(K.score_chunks(_matched(spark, sf)), F.lit(QUESTION), by_combined=True)
    return found.select("doc_id", "answer_idx", "chunk_idx", F.round("combined_score", 3).alias("combined_score"))


def q_strategy_diag(spark, sf):
    return Q.strategy_diagnostics(Q.find_answers(chunks(spark, sf), F.lit(QUESTION)))


def q_baseline(spark, sf):
    return Q.baseline(_docs(spark, sf), QUESTION, CONFIG)


def _references(spark, sf):
    return texts(spark, sf).where("text_id = 0").select("doc_id", F.col("text").alias("reference"))


def q_baseline_ru(spark, sf):
    return Q.baseline(_docs(spark, sf), QUESTION, replace(CONFIG, language="ru"))


def q_attention_keywords(spark, sf):
    found = Q.attention_keywords(dealt_chunks(spark, sf), QUESTION)
    return found.select("doc_id", "kw_idx", "word", F.round("weight", 6).alias("weight"))


def q_attention_pipeline(spark, sf):
    found = Q.attention(_docs(spark, sf), _references(spark, sf), QUESTION, CONFIG, aspect=ASPECT)
    return found.select("doc_id", "text", F.round("confidence", 6).alias("confidence"), "reranked", "chunks_used")


def q_experiment(spark, sf):
    return Q.experiment(_docs(spark, sf), keywords(spark, sf), _references(spark, sf), QUESTION, MODES, CLUSTER, ANSWER, CONFIG, aspect=ASPECT)


def q_span_search(spark, sf):
    k = F.col("doc_id") % 13 + 1
    at = F.sequence(F.lit(0), F.lit(99))
    logits = _docs(spark, sf).select("doc_id", F.transform(at, lambda p: (p * k) % 17 / 4.0).alias("s"), F.transform(at, lambda p: (p * (k + 3)) % 19 / 4.0).alias("e"))
    return Q.span_search(logits).select("doc_id", "start", "end", F.round("probability", 6).alias("probability"))


def q_post_rules(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", Q.checked_answer(F.col("text"), F.col("turn") / 4.0).alias("answer"))


def q_ctx_tail(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(Q.context_tail(F.split("text", r"\s+", -1), 50), " ").alias("tail"))


def q_answer_stats(spark, sf):
    answer = F.when(F.col("turn") == 0, F.lit(None)).when(F.col("turn") == 1, F.concat(F.lit("ERROR "), "role")).when(F.col("turn") == 2, Q.NOT_FOUND).otherwise(F.col("text"))
    return table(spark, sf, "conversations").groupBy(Q.answer_status(answer).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def q_levenshtein(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


def q_text_metrics(spark, sf):
    m = M.text_metrics(F.col("p_name"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", m.alias("m")).select("p_partkey", F.round("m.cosine_sim", 6).alias("cosine_sim"), F.col("m.lev_dist").alias("lev_dist"))


def q_char_f1(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", F.round(M.char_f1(F.col("pred"), F.col("gold")), 6).alias("char_f1"))


def q_token_f1(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", F.round(M.token_f1(F.col("pred"), F.col("gold")), 6).alias("token_f1"))


def q_rouge_l(spark, sf):
    return pairs(spark, sf).select("conv_id", "turn", F.round(M.rouge_l("pred", "gold"), 6).alias("rouge_l"))


def q_metrics_rowwise(spark, sf):
    """The golds of a user's turn are the assistant's next turn and, if there is one, the one
    before."""
    before = table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    rows = pairs(spark, sf).join(before, ["conv_id", "turn"], "left").select("conv_id", "turn", "pred", F.array("gold", "before").alias("golds"))
    found = M.metrics_rowwise(rows).drop("pred", "golds")
    return found.withColumns({c: F.round(c, 4) for c in found.columns[2:]})


_TEXTS = f"texts AS (SELECT doc_id, sent_pos AS text_id, text FROM ({_exploded(SENTENCES)}))"
_STOP = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> '')"
_IDF = f"""{_TEXTS}, tn AS (SELECT doc_id, count(*) AS n FROM texts GROUP BY 1), seen AS (SELECT doc_id, text_id, unnest(list_distinct({_TERMS.format('text')})) AS word FROM texts),
  idf AS (SELECT doc_id, word, count(*) AS df, ln(any_value(n) / count(*)) + 1 AS idf FROM seen JOIN tn USING (doc_id) GROUP BY 1, 2),
  pw AS (SELECT doc_id, text_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, text_id, {_WORDS.format('text')} AS w FROM texts))"""
_KW = r"""kc AS (SELECT doc_id, word, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS word FROM documents) GROUP BY 1, 2),
  kw AS (SELECT doc_id, kw_idx, word, 1 / (1 + kw_idx) AS weight, word AS lemma, word[1:6] AS stem, (length(word) % 5) / 4.0::DOUBLE AS score_diff
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, word) - 1 AS kw_idx FROM kc) WHERE kw_idx < 8)"""
_HIT_ONLY = r"""tk AS (SELECT doc_id, chunk_idx, unnest(w) AS word, generate_subscripts(w, 1) AS p, g FROM
    (SELECT doc_id, chunk_idx, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w, regexp_split_to_array(lower(text), '[\p{L}\p{N}_]+') AS g FROM chunks)),
  ts AS (SELECT doc_id, chunk_idx, word, p, sum(length(g[p])) OVER o + coalesce(sum(length(word)) OVER b, 0) AS start FROM tk
    WINDOW o AS (PARTITION BY doc_id, chunk_idx ORDER BY p ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY doc_id, chunk_idx ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  tm AS (SELECT doc_id, term, max(kw_idx) AS k FROM (SELECT doc_id, kw_idx, lower(lemma) AS term FROM kw UNION ALL SELECT doc_id, kw_idx, lower(stem) FROM kw) GROUP BY 1, 2),
  hit AS (SELECT ts.doc_id, chunk_idx, word, start, k FROM ts JOIN tm ON ts.doc_id = tm.doc_id AND ts.word = tm.term),
  hk AS (SELECT DISTINCT doc_id, chunk_idx, k FROM hit), kn AS (SELECT doc_id, count(*) AS kn FROM kw GROUP BY 1)"""
_HIT = f"{CHUNKS_SQL}, {_KW}, {_HIT_ONLY}"
# Keywords under the first three letters of their words; of several the last.
_KW3 = _KW.replace("kw AS (SELECT doc_id, kw_idx, word, ", "k0 AS (SELECT doc_id, kw_idx, word[1:3] AS word, ") + """,
  kw AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, word ORDER BY kw_idx DESC) AS rn FROM k0) WHERE rn = 1)"""


def _score(ratio: str) -> str:
    return f"""(SELECT b.doc_id, b.chunk_idx, base * (1 + 0.3::DOUBLE * early) * (1 + 0.7::DOUBLE * ln(1 + n)) * (1 + m / kn * 0.5::DOUBLE) AS raw, m, base FROM
      (SELECT hk.doc_id, chunk_idx, sum(weight * {ratio} + score_diff * (1 - {ratio})) AS base, count(*) AS m FROM hk JOIN kw ON hk.doc_id = kw.doc_id AND hk.k = kw.kw_idx GROUP BY 1, 2) b
      JOIN (SELECT hit.doc_id, hit.chunk_idx, avg(1 - start / greatest(1, length(text))) AS early, count(*) AS n FROM hit JOIN chunks USING (doc_id, chunk_idx) GROUP BY 1, 2) e USING (doc_id, chunk_idx)
      JOIN kn USING (doc_id))"""


def _density(ratio: str) -> str:
    return f"""(SELECT b.doc_id, b.chunk_idx, m, round(base * (1 + m / greatest(1, token_count / 10)) * least(2, 1 + m / greatest(1, len({_WORDS.format('text')}) / 20)), 6) AS score FROM
      (SELECT hk.doc_id, chunk_idx, sum(weight * {ratio} + score_diff * (1 - {ratio})) AS base, count(*) AS m FROM hk JOIN kw ON hk.doc_id = kw.doc_id AND hk.k = kw.kw_idx GROUP BY 1, 2) b
      JOIN chunks USING (doc_id, chunk_idx))"""


def _pieces(mark: str, inner: str) -> str:
    return rf"""w AS (SELECT conv_id, turn, unnest(w) AS word, generate_subscripts(w, 1) AS wp FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations)),
  pc AS (SELECT conv_id, turn, wp, k, (CASE WHEN k = 0 THEN '{mark}' ELSE '{inner}' END) || word[k * 4 + 1:k * 4 + 4] AS token FROM w, unnest(range(0, (length(word) - 1) // 4 + 1)) AS u(k)),
  tok AS (SELECT conv_id, turn, token, row_number() OVER (PARTITION BY conv_id, turn ORDER BY wp, k) - 1 AS pos FROM pc),
  tokw AS (SELECT *, (pos % 10) / 10.0::DOUBLE AS weight FROM tok)"""


_EDGE = r"""[.,?!:;()\[\]{{}}"'']"""
_CLEAN = rf"""lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(token, '^[Ġ▁]+', ''), '^##', ''), '^{_EDGE}+', ''), '{_EDGE}+$', ''))""".replace("{{", "{").replace("}}", "}")


def _attention(mark: str, inner: str, starts: str) -> str:
    return f"""{_pieces(mark, inner)}, cl AS (SELECT *, {_CLEAN} AS c, ({starts})::INT AS s FROM tokw), nw AS (SELECT * FROM cl WHERE c <> ''),
      wd AS (SELECT *, sum(s) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS word_pos FROM nw),
      occ AS (SELECT conv_id, turn, word_pos, string_agg(c, '' ORDER BY pos) AS word, sum(weight) AS total, count(*) AS m FROM wd GROUP BY 1, 2, 3)"""


_PAIRS = "qa AS (SELECT u.conv_id, u.turn, u.text AS pred, a.text AS gold FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
_BLANK = r"regexp_replace({}, '\s+', '', 'g') = ''"


def _f1(frame: str, tokens: str, scale: str) -> str:
    """Multiset overlap of ``tokens(column)`` of pred and gold."""
    return f"""{frame}, p AS (SELECT conv_id, turn, unnest({tokens.format('pred')}) AS x FROM qa), g AS (SELECT conv_id, turn, unnest({tokens.format('gold')}) AS x FROM qa),
      pc AS (SELECT conv_id, turn, x, count(*) AS n FROM p GROUP BY 1, 2, 3), gc AS (SELECT conv_id, turn, x, count(*) AS n FROM g GROUP BY 1, 2, 3),
      cm AS (SELECT conv_id, turn, sum(least(pc.n, gc.n)) AS common FROM pc JOIN gc USING (conv_id, turn, x) GROUP BY 1, 2),
      f AS (SELECT qa.*, common, len({tokens.format('pred')}) AS np, len({tokens.format('gold')}) AS ng FROM qa LEFT JOIN cm USING (conv_id, turn)),
      v AS (SELECT conv_id, turn, CASE WHEN common IS NULL OR {_BLANK.format('pred')} OR {_BLANK.format('gold')} THEN 0
        ELSE 2 * (common / np) * (common / ng) / (common / np + common / ng) * {scale} END AS f1 FROM f)"""


_SQUAD = (
    r"list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), "
    r"'(^|[^\p{{L}}\p{{N}}_])(a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \3', 'g'), '(^|[^\p{{L}}\p{{N}}_])(a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \3', 'g'), '\s+'), lambda w: w <> '')"
)
_CHARS = "list_filter(string_split(lower({}), ''), lambda c: c <> '')"
_ANSWERS = """fa AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) - 1)::INT AS answer_idx, chunk_idx,
    CASE WHEN contains(text, 'semantic segmentation') THEN 'semantic segmentation' ELSE string_split(text, '.')[1] END AS answer, text AS whole FROM chunks)"""
_VEC = r"""list_transform(range(0, 16), lambda k: len(list_filter(list_transform(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> ''),
    lambda w: ('0x' || substr(sha256(w), 1, 4))::INT % 16), lambda b: b = k))::DOUBLE)"""
_COS = "coalesce(CASE WHEN list_sum({a}) = 0 OR list_sum({b}) = 0 THEN 0 ELSE round(list_cosine_similarity({a}, {b}), 9) END, 0)"
_CHUNKS = f"WITH RECURSIVE {CHUNKS_SQL}"
_HITS = f"WITH RECURSIVE {_HIT}"

# Longest common subsequences of token lists, row by row: a row is the greatest so far of the
# row before and of its matches.
def _lcs(frame: str) -> str:
    tokens = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
    return f"""{frame}, lt AS (SELECT conv_id, turn, {tokens.format('gold')} AS a, {tokens.format('pred')} AS b FROM qa),
      lr AS (SELECT conv_id, turn, a, b, 0::BIGINT AS j, list_transform(range(0, len(a)), lambda k: 0::BIGINT) AS r FROM lt
        UNION ALL SELECT conv_id, turn, a, b, j + 1, list_transform(range(1, len(a) + 1), lambda n: list_max(list_transform(range(1, n + 1),
          lambda k: greatest(r[k], CASE WHEN a[k] = b[j + 1] THEN (CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END) + 1 ELSE 0 END)))) FROM lr WHERE j < len(b)),
      lv AS (SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE 2 * r[-1] / (len(a) + len(b)) END::DOUBLE AS rouge FROM lr WHERE j = len(b))"""


_PAIRS2 = """qa AS (SELECT u.conv_id, u.turn * 2 + (a.turn > u.turn)::INT AS turn, u.text AS pred, a.text AS gold FROM conversations u JOIN conversations a
    ON u.conv_id = a.conv_id AND abs(a.turn - u.turn) = 1 JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND n.role = 'assistant')"""
_LETTERS = _VEC.format("regexp_replace(w, '(.)', '\\1 ', 'g')")
_BERT = f"""bw AS (SELECT conv_id, turn, side, w, p, {_LETTERS} AS v FROM (SELECT conv_id, turn, side, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM
      (SELECT conv_id, turn, 'p' AS side, {_WORDS.format('pred')} AS l FROM qa UNION ALL SELECT conv_id, turn, 'g', {_WORDS.format('gold')} FROM qa))),
    bp AS (SELECT x.conv_id, x.turn, x.p AS i, y.p AS j, {_COS.format(a='x.v', b='y.v')} AS sim FROM bw x JOIN bw y USING (conv_id, turn) WHERE x.side = 'p' AND y.side = 'g'),
    bs AS (SELECT conv_id, turn, (SELECT avg(m) FROM (SELECT max(sim) AS m FROM bp b WHERE b.conv_id = qa.conv_id AND b.turn = qa.turn GROUP BY i)) AS p,
      (SELECT avg(m) FROM (SELECT max(sim) AS m FROM bp b WHERE b.conv_id = qa.conv_id AND b.turn = qa.turn GROUP BY j)) AS r FROM qa)"""


def _rowwise() -> str:
    char, token = _f1(_PAIRS2, _CHARS, "1"), _f1(_PAIRS2, _SQUAD, "100")
    best = lambda frame, last: f"(WITH RECURSIVE {frame} SELECT conv_id, turn // 2 AS turn, {last} GROUP BY 1, 2)"
    return f"""SELECT conv_id, turn, round(char_f1, 4) AS char_f1, round(token_f1, 4) AS token_f1, round(rouge_l_f1, 4) AS rouge_l_f1,
        round(bertscore_p, 4) AS bertscore_p, round(bertscore_r, 4) AS bertscore_r, round(bertscore_f1, 4) AS bertscore_f1
      FROM {best(char, 'max(f1)::DOUBLE AS char_f1 FROM v')} JOIN {best(token, 'max(f1)::DOUBLE AS token_f1 FROM v')} USING (conv_id, turn)
      JOIN {best(_lcs(_PAIRS2), 'max(rouge) AS rouge_l_f1 FROM lv')} USING (conv_id, turn)
      JOIN {best(f'{_PAIRS2}, {_BERT}', "max(coalesce(p, 0)) AS bertscore_p, max(coalesce(r, 0)) AS bertscore_r, max(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) AS bertscore_f1 FROM bs")} USING (conv_id, turn)"""


_MEDOID = f"""av AS (SELECT doc_id, answer_idx, chunk_idx, answer, {_VEC.format('answer')} AS v FROM fa),
      ap AS (SELECT a.doc_id, a.answer_idx, a.answer, sum({_COS.format(a='a.v', b='b.v')}) AS s, count(*) AS n, count(*) FILTER (a.answer = b.answer) AS support
        FROM av a JOIN av b USING (doc_id) GROUP BY ALL),
      rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(s / n, 9) DESC, answer_idx) AS rn FROM ap)"""
# Words of a chunk with their shares, ranked; and of those of valid chunks the keywords.
_SHARES = r"""sw AS (SELECT doc_id, chunk_idx, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\p{L}\p{N}_\s]+', ' ', 'g')), '\s+'), lambda w: w <> '') AS w FROM chunks),
      sx AS (SELECT doc_id, chunk_idx, word, min(p) AS p, round(count(*) / any_value(n), 9) AS weight FROM (SELECT doc_id, chunk_idx, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n FROM sw)
        WHERE length(word) > 1 GROUP BY 1, 2, 3),
      sr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_idx ORDER BY weight DESC, p) AS place FROM sx)"""


def _best_words(where: str) -> str:
    return f"""sk AS (SELECT doc_id, word, weight, chunk_idx * 100 + place AS kw_idx, row_number() OVER (PARTITION BY doc_id, word ORDER BY weight DESC, chunk_idx * 100 + place) AS rn
        FROM sr WHERE place <= 100 AND {where}), kb AS (SELECT doc_id, kw_idx, word, weight FROM sk WHERE rn = 1)"""


_PIPELINE = f"""{_CHUNKS}, {_ANSWERS}, {_MEDOID}, rf AS (SELECT doc_id, l[1] AS reference FROM (SELECT doc_id, {SENTENCES} AS l FROM documents) WHERE len(l) > 0),
      vs AS (SELECT av.*, {_COS.format(a='av.v', b='r')} AS similarity FROM av JOIN (SELECT doc_id, {_VEC.format('reference')} AS r FROM rf) USING (doc_id)),
      vr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, answer_idx) AS place, max(similarity) OVER (PARTITION BY doc_id) AS best FROM vs),
      va AS (SELECT doc_id, chunk_idx FROM vr WHERE (best >= 0.9 AND similarity >= 0.9) OR (best < 0.9 AND similarity >= 0.7 AND place <= 1)),
      {_SHARES}, {_best_words('(doc_id, chunk_idx) IN (SELECT (doc_id, chunk_idx) FROM va)')},
      kd AS (SELECT kb.*, round({_COS.format(a=_VEC.format('word'), b=_VEC.format(f"'{ASPECT}'"))} - {_COS.format(a=_VEC.format('word'), b=_VEC.format('reference'))}, 9) AS score_diff FROM kb JOIN rf USING (doc_id)),
      kw AS (SELECT *, word AS lemma, word AS stem FROM kd WHERE score_diff > 0), {_HIT_ONLY},
      ag AS (SELECT s.doc_id, s.chunk_idx, fa.answer, round(raw, 6) AS score, (row_number() OVER (PARTITION BY s.doc_id ORDER BY round(raw, 6) DESC, s.chunk_idx) - 1) AS idx, {_VEC.format('fa.answer')} AS v
        FROM {_score('0.5::DOUBLE')} s JOIN fa USING (doc_id, chunk_idx)),
      an AS (SELECT a.doc_id, a.idx, avg(sim) FILTER (sim >= 0.7) AS s FROM (SELECT a.doc_id, a.idx, {_COS.format(a='a.v', b='b.v')} AS sim FROM ag a JOIN ag b ON a.doc_id = b.doc_id AND a.idx <> b.idx) a GROUP BY 1, 2),
      ac AS (SELECT ag.doc_id, ag.idx, answer, CASE WHEN count(*) OVER (PARTITION BY ag.doc_id) > 1 THEN round((score + 0.9::DOUBLE) / 2 * 0.6::DOUBLE + coalesce(s, 0) * 0.4::DOUBLE, 9) ELSE 0 END AS c,
        count(*) OVER (PARTITION BY ag.doc_id) AS m FROM ag LEFT JOIN an ON ag.doc_id = an.doc_id AND ag.idx = an.idx),
      fi AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, idx) AS rn FROM ac)
      SELECT rk.doc_id, coalesce(fi.answer, rk.answer) AS text, 0.9::DOUBLE AS confidence, fi.answer IS NOT NULL AS reranked, coalesce(m, rk.n) AS chunks_used
      FROM rk LEFT JOIN fi ON rk.doc_id = fi.doc_id AND fi.rn = 1 WHERE rk.rn = 1"""

# The batch experiment: valid chunks, their words by the dynamic idf, keywords that the chunks
# have and that are nearer to the question than to the reference; then the chunks scored by
# them in three modes, answered, clustered and chosen from. A document in a mode is a group.
def _experiment() -> str:
    idf = _IDF.replace(_TEXTS, "texts AS (SELECT doc_id, chunk_idx AS text_id, text FROM chunks WHERE (doc_id, chunk_idx) IN (SELECT (doc_id, chunk_idx) FROM va))")
    thresholds = ", ".join(f"({i}, {round(t, 9)}::DOUBLE)" for i, t in enumerate(K.thresholds()))
    modes = " UNION ALL ".join(f"SELECT doc_id * 3 + {i} AS doc, chunk_idx, round(raw, 6) AS score FROM {_score(f'{r}::DOUBLE')}" for i, r in enumerate(MODES.values()))
    clustered = _CL.replace(f"sim >= {NEAR}", "sim >= 0.5").replace(", mat AS", "mat AS", 1)
    names = "[" + ", ".join(f"'{m}'" for m in MODES) + "]"
    grid = " CROSS JOIN ".join(f"(SELECT unnest([{', '.join(repr(x) for x in values)}]) AS {name})" for name, values in (("mode", MODES), ("cluster_strategy", CLUSTER), ("answer_strategy", ANSWER)))
    # The SQL engine counts bytes: letters of the tables that have two become one.
    one = "translate({}, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', " + " || ".join(f"chr({c})" for c in [*range(1, 9), *range(14, 27)]) + ")"
    lev = f"levenshtein({one.format('reference')}, {one})::DOUBLE"
    cos = _COS.format(a=_VEC.format("reference"), b="{v}")
    return f"""{_CHUNKS}, {_ANSWERS}, {_MEDOID}, rf AS (SELECT doc_id, l[1] AS reference FROM (SELECT doc_id, {SENTENCES} AS l FROM documents) WHERE len(l) > 0),
      vs AS (SELECT av.*, {_COS.format(a='av.v', b='r')} AS similarity FROM av JOIN (SELECT doc_id, {_VEC.format('reference')} AS r FROM rf) USING (doc_id)),
      vr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, answer_idx) AS place, max(similarity) OVER (PARTITION BY doc_id) AS best FROM vs),
      va AS (SELECT doc_id, chunk_idx FROM vr WHERE (best >= 0.9 AND similarity >= 0.9) OR (best < 0.9 AND similarity >= 0.7 AND place <= 1)),
      {idf}, th(i, t) AS (VALUES {thresholds}),
      kc2 AS (SELECT doc_id, text_id, i, count(*) AS n FROM pw JOIN idf USING (doc_id, word), th WHERE round(idf, 9) >= t GROUP BY 1, 2, 3),
      cv AS (SELECT x.doc_id, x.i, x.t, avg((coalesce(n, 0) >= 3)::INT) AS c FROM (SELECT doc_id, text_id, i, t FROM texts, th) x LEFT JOIN kc2 USING (doc_id, text_id, i) GROUP BY 1, 2, 3),
      tr AS (SELECT doc_id, round(t, 6) AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY least(c, 0.8) DESC, i) AS rn FROM cv) WHERE rn = 1),
      kt AS (SELECT doc_id, text_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM pw JOIN idf USING (doc_id, word) JOIN tr USING (doc_id) WHERE round(idf, 9) >= t GROUP BY 1, 2),
      hs AS (SELECT DISTINCT doc_id FROM seen), ft AS (SELECT texts.doc_id, text_id, CASE WHEN hs.doc_id IS NULL THEN array_to_string({_WORDS.format('text')}, ' ') ELSE coalesce(kept, '') END AS text
        FROM texts LEFT JOIN hs USING (doc_id) LEFT JOIN kt USING (doc_id, text_id)),
      al AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_-]+')) AS word FROM ft),
      {_KW.replace('kw AS (', 'kf AS (')},
      km AS (SELECT kf.doc_id, kf_idx, word, weight FROM (SELECT *, kw_idx AS kf_idx FROM kf) kf JOIN al USING (doc_id, word) WHERE word NOT IN ({_STOP}) AND length(word) > 1),
      kd AS (SELECT km.doc_id, kf_idx AS kw_idx, word, weight, round({_COS.format(a=_VEC.format('word'), b=_VEC.format(f"'{ASPECT}'"))} - {_COS.format(a=_VEC.format('word'), b=_VEC.format('reference'))}, 9) AS score_diff
        FROM km JOIN rf USING (doc_id)),
      kw AS (SELECT *, word AS lemma, word AS stem FROM kd WHERE score_diff > 0), {_HIT_ONLY}, sm AS ({modes}),
      ans AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY sm.chunk_idx) - 1 AS idx, answer AS text, 0.9::DOUBLE AS confidence, score AS chunk_score, {_VEC.format('answer')} AS v
        FROM sm JOIN fa ON sm.doc // 3 = fa.doc_id AND sm.chunk_idx = fa.chunk_idx),
      pr AS (SELECT a.doc, a.idx AS i, b.idx AS j, {_COS.format(a='a.v', b='b.v')} AS sim FROM ans a JOIN ans b ON a.doc = b.doc AND a.idx <> b.idx),
      {clustered} {_chosen(_KEYS, _VALUES)},
      aim AS (SELECT DISTINCT doc_id FROM kw), gr AS (SELECT * FROM aim CROSS JOIN {grid}),
      gs AS (SELECT gr.*, sel.text AS chosen FROM gr LEFT JOIN (SELECT doc // 3 AS doc_id, {names}[doc % 3 + 1] AS mode, cluster_strategy, answer_strategy, text FROM sel) sel USING (doc_id, mode, cluster_strategy, answer_strategy)),
      bs AS (SELECT documents.doc_id, nullif(rk.answer, '') AS f, reference FROM documents LEFT JOIN rk ON documents.doc_id = rk.doc_id AND rn = 1 LEFT JOIN rf ON documents.doc_id = rf.doc_id)
      SELECT bs.doc_id, coalesce(mode, '{Q.NO_VALID}') AS score_chunk_strategy, coalesce(cluster_strategy, '{Q.NO_VALID}') AS choose_cluster_strategy, coalesce(answer_strategy, '{Q.NO_VALID}') AS choose_answer_strategy,
        CASE WHEN mode IS NULL THEN '{Q.NO_VALID}' ELSE coalesce(chosen, '{Q.NONE}') END AS final_answer,
        CASE WHEN chosen IS NOT NULL THEN round({cos.format(v=_VEC.format('chosen'))}, 6) END AS cosine_sim, CASE WHEN chosen IS NOT NULL THEN {lev.format('chosen')} END AS lev_dist,
        coalesce(f, '{Q.NONE}') AS first_answer, CASE WHEN f IS NOT NULL AND reference IS NOT NULL THEN round({cos.format(v=_VEC.format('f'))}, 6) END AS base_cosine_sim,
        CASE WHEN f IS NOT NULL AND reference IS NOT NULL THEN {lev.format('f')} END AS base_lev_dist
      FROM bs LEFT JOIN gs USING (doc_id)"""


SQL = {
    "ngrams": f"""WITH k AS (SELECT doc_id, list_filter({_TERMS.format('text')}, lambda w: w NOT IN ({_STOP})) AS k FROM documents)
      SELECT DISTINCT doc_id, k[i] || ' ' || k[i + 1] AS gram FROM k, unnest(range(1, len(k))) AS u(i)""",
    "extract_keywords": rf"""WITH g AS (SELECT DISTINCT doc_id, unnest(list_filter({_TERMS.format('text')}, lambda w: w NOT IN ({_STOP}) AND NOT regexp_matches(w, '\p{{Nd}}'))) AS word FROM documents),
      b AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 4))::INT % 16 AS b FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS w FROM documents)),
      c AS (SELECT doc_id, b, count(*) AS n FROM b GROUP BY 1, 2), nm AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1),
      s AS (SELECT g.doc_id, word, round(coalesce(n, 0) / norm, 9) AS similarity FROM g JOIN nm USING (doc_id) LEFT JOIN c ON g.doc_id = c.doc_id AND c.b = ('0x' || substr(sha256(word), 1, 4))::INT % 16),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, word DESC) AS place FROM s)
      SELECT doc_id, place, word, round(similarity, 6) AS similarity FROM r WHERE place <= 20""",
    "idf": f"WITH {_IDF} SELECT doc_id, word, df, round(idf, 6) AS idf FROM idf",
    "idf_filter": f"""WITH {_IDF}, k AS (SELECT doc_id, text_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM pw JOIN idf USING (doc_id, word) WHERE round(idf, 9) >= 1.5 GROUP BY 1, 2)
      SELECT doc_id, text_id, coalesce(kept, '') AS kept FROM texts LEFT JOIN k USING (doc_id, text_id)""",
    "dynamic_idf": f"""WITH {_IDF}, th(i, t) AS (VALUES {', '.join(f'({i}, {round(t, 9)}::DOUBLE)' for i, t in enumerate(K.thresholds()))}),
      kc AS (SELECT doc_id, text_id, i, count(*) AS n FROM pw JOIN idf USING (doc_id, word), th WHERE round(idf, 9) >= t GROUP BY 1, 2, 3),
      cv AS (SELECT x.doc_id, x.i, x.t, avg((coalesce(n, 0) >= 3)::INT) AS c FROM (SELECT doc_id, text_id, i, t FROM texts, th) x LEFT JOIN kc USING (doc_id, text_id, i) GROUP BY 1, 2, 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY least(c, 0.8) DESC, i) AS rn FROM cv)
      SELECT doc_id, round(t, 6) AS threshold, round(c, 6) AS coverage FROM r WHERE rn = 1""",
    "characteristic": f"""WITH {_TEXTS}, tn AS (SELECT doc_id, count(*) AS n FROM texts GROUP BY 1), tl AS (SELECT doc_id, text_id, {_TERMS.format('text')} AS t FROM texts),
      tf AS (SELECT doc_id, text_id, word, count(*) AS tf FROM (SELECT doc_id, text_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS word FROM tl) GROUP BY 1, 2, 3),
      df AS (SELECT doc_id, word, count(*) AS df, any_value(n) AS n FROM tf JOIN tn USING (doc_id) GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) <= 0.8::DOUBLE * any_value(n)),
      x AS (SELECT doc_id, text_id, word, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (doc_id, word)),
      y AS (SELECT doc_id, text_id, word, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, text_id)), 6) AS tfidf FROM x) SELECT * FROM y WHERE tfidf >= 0.1""",
    "characteristic_filter": f"""WITH RECURSIVE {_IDF}, sc AS (SELECT doc_id, word, (ln(any_value(n) / count(*)) + 1) * (count(*) FILTER (text_id < 5) + 1) / (count(*) FILTER (text_id >= 5) + 1) AS score
        FROM seen JOIN tn USING (doc_id) GROUP BY 1, 2),
      pl AS (SELECT doc_id, text_id, pos, word, score FROM pw JOIN sc USING (doc_id, word) WHERE text_id < 5), tg AS (SELECT doc_id, count(*) AS m FROM texts WHERE text_id < 5 GROUP BY 1),
      rc AS (SELECT doc_id, text_id, list(round(score, 9) ORDER BY score DESC)[3] AS reach FROM pl GROUP BY 1, 2), rl AS (SELECT doc_id, list(reach) FILTER (reach IS NOT NULL) AS l FROM rc GROUP BY 1),
      wk AS (SELECT doc_id, m, coalesce(l, []) AS l, 0 AS i, 1.5::DOUBLE AS t, -1.0::DOUBLE AS best, 1.5::DOUBLE AS best_t, false AS done FROM tg LEFT JOIN rl USING (doc_id)
        UNION ALL SELECT doc_id, m, l, i + 1, t - greatest(0.2::DOUBLE * (1 - c), 0.05::DOUBLE), greatest(c, best), CASE WHEN c > best THEN t ELSE best_t END, c >= 0.8
        FROM (SELECT *, len(list_filter(l, lambda x: x >= round(t, 9))) / m AS c FROM wk) WHERE NOT done AND t >= 0.5),
      la AS (SELECT doc_id, arg_max(best_t, i) AS threshold, arg_max(best, i) AS coverage FROM wk GROUP BY 1),
      kp AS (SELECT doc_id, text_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM pl JOIN la USING (doc_id) WHERE round(score, 9) >= round(threshold, 9) GROUP BY 1, 2)
      SELECT doc_id, text_id, coalesce(kept, '') AS kept, round(threshold, 6) AS threshold, round(coverage, 6) AS coverage FROM texts JOIN la USING (doc_id) LEFT JOIN kp USING (doc_id, text_id) WHERE text_id < 5""",
    "characteristic_contrast": f"""WITH {_IDF} SELECT doc_id, word, round((ln(any_value(n) / count(*)) + 1) * (count(*) FILTER (text_id < 1) + 1) / (count(*) FILTER (text_id >= 1) + 1), 6) AS score
      FROM seen JOIN tn USING (doc_id) GROUP BY 1, 2""",
    "lemma_stem": f"WITH {_KW} SELECT doc_id, 'Task_' || word AS word, 'task_' || word AS lemma, 'task_' || word AS stem FROM kw",
    "keyword_contrast": f"""WITH {_KW}, v AS (SELECT doc_id, word, {_VEC.format('word')} AS u, {_VEC.format("'the task of the text'")} AS p, {_VEC.format("'an answer by a model'")} AS n FROM kw),
      d AS (SELECT doc_id, word, round(round(list_cosine_similarity(u, p), 9) - round(list_cosine_similarity(u, n), 9), 9) AS d FROM v) SELECT doc_id, word, round(d, 6) AS score_diff FROM d WHERE d > 0""",
    "merge_keywords": rf"""WITH {_KW}, {_TEXTS}, al AS (SELECT DISTINCT doc_id, text_id % 3 AS batch, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_-]+')) AS word FROM texts)
      SELECT doc_id, kw.word, round(max(weight), 6) AS weight FROM kw JOIN al USING (doc_id, word) WHERE al.batch = kw_idx % 3 AND kw.word NOT IN ({_STOP}) AND length(kw.word) > 1 GROUP BY 1, 2""",
    "dedup_keywords": f"WITH {_KW} SELECT doc_id, word[1:4] AS word, round(max(weight), 6) AS weight FROM kw GROUP BY 1, 2",
    "kw_join": rf"""WITH {_KW}, wd AS (SELECT word, word[1:6] AS stem, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}{{4,}}')) AS word FROM documents) GROUP BY 1)
      SELECT doc_id, word, round(weight, 6) AS weight, wd.stem, documents FROM kw JOIN wd USING (word)""",
    "kw_by_cosine": f"""WITH {_KW}, b AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 4))::INT % 16 AS b FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS w FROM documents)),
      c AS (SELECT doc_id, b, count(*) AS n FROM b GROUP BY 1, 2), nm AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1),
      d AS (SELECT kw.doc_id, word, round(coalesce(n, 0) / norm, 9) AS similarity FROM kw JOIN nm USING (doc_id) LEFT JOIN c ON kw.doc_id = c.doc_id AND c.b = ('0x' || substr(sha256(word), 1, 4))::INT % 16)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, word))::INT AS place, word, round(similarity, 6) AS similarity FROM d""",
    "kw_in_text": rf"WITH {_KW} SELECT doc_id, word FROM kw JOIN documents USING (doc_id) WHERE list_contains(regexp_split_to_array(lower(text), '\s+'), word)",
    "kw_stop": f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS word FROM documents) WHERE word NOT IN ({_STOP}) AND length(word) > 1 GROUP BY 1, 2",
    "special_tokens": r"""WITH t AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\s+')) AS token FROM conversations) SELECT conv_id, turn, count(*) AS n FROM t
      WHERE token NOT IN ('', '<s>', '</s>', '<pad>', '[CLS]', '[SEP]', '.', '?', '!', ',', '/', '//', '][') AND token NOT LIKE '<%' AND token NOT LIKE '%>' AND trim(token, '.') <> '' GROUP BY 1, 2""",
    "attention_words": f"WITH {_attention('▁', '', chr(39).join(['starts_with(token, ', 'Ġ', ') OR starts_with(token, ', '▁', ')']))} SELECT conv_id, turn, word_pos::BIGINT AS word_pos, word, round(total / m, 6) AS weight FROM occ",
    "attention_wordpiece": f"""WITH {_attention('', '##', "NOT starts_with(token, '##')")}, sch AS (SELECT conv_id, turn, bool_or(starts_with(token, '##')) AS wp FROM tok GROUP BY 1, 2),
      alt AS (SELECT conv_id, turn, 0 AS word_pos, string_agg(c, '' ORDER BY pos) AS word, sum(weight) AS total, count(*) AS m FROM nw GROUP BY 1, 2)
      SELECT conv_id, turn, word_pos::BIGINT AS word_pos, word, round(total / m, 6) AS weight FROM occ JOIN sch USING (conv_id, turn) WHERE wp
      UNION ALL SELECT conv_id, turn, 0, word, round(total / m, 6) FROM alt JOIN sch USING (conv_id, turn) WHERE NOT wp""",
    "attention_rank": f"""WITH {_attention('▁', '', chr(39).join(['starts_with(token, ', 'Ġ', ') OR starts_with(token, ', '▁', ')']))},
      mn AS (SELECT conv_id, turn, word, round(sum(total) / sum(m), 9) AS weight, min(word_pos) AS fst FROM occ WHERE length(word) > 1 GROUP BY 1, 2, 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY weight DESC, fst) AS place FROM mn) SELECT conv_id, turn, place, word, round(weight, 6) AS weight FROM r WHERE place <= 100""",
    "attention_words_legacy": f"""WITH {_pieces('Ġ', '')}, a AS (SELECT * FROM tokw WHERE token NOT IN ('<s>', '</s>', '<pad>', '[CLS]', '[SEP]', '.', '?', '!', ',', '/', '//', '][')
        AND token NOT LIKE '<%' AND token NOT LIKE '%>' AND trim(token, '.') <> ''),
      b AS (SELECT *, trim(replace(token, 'Ġ', ' ')) AS c0, starts_with(token, 'Ġ')::INT AS s FROM a),
      c AS (SELECT *, lower(CASE WHEN ends_with(c0, '.') AND length(c0) > 1 THEN c0[:-2] ELSE c0 END) AS c FROM b), d AS (SELECT * FROM c WHERE c <> ''),
      e AS (SELECT *, sum(s) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS word_pos FROM d)
      SELECT conv_id, turn, word_pos::BIGINT AS word_pos, regexp_replace(string_agg(c, '' ORDER BY pos), '\\.$', '') AS word, round(sum(weight) / count(*), 6) AS weight FROM e GROUP BY 1, 2, 3""",
    "attn_norm": f"WITH {_pieces('▁', '')} SELECT conv_id, turn, pos::INT AS pos, round((weight + 0.1::DOUBLE) / sum(weight + 0.1::DOUBLE) OVER (PARTITION BY conv_id, turn), 9) AS share FROM tokw",
    "filter_chunks": f"{_HITS} SELECT doc_id, chunk_idx FROM hit GROUP BY 1, 2 HAVING count(DISTINCT word) >= 3",
    "filter_chunks_lemstem": f"{_HITS} SELECT doc_id, chunk_idx FROM hit GROUP BY 1, 2 HAVING count(DISTINCT k) >= 3",
    "filter_chunks_raw": rf"""{_HITS}, rw AS (SELECT doc_id, chunk_idx, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS w FROM chunks)
      SELECT rw.doc_id, chunk_idx, count(DISTINCT w)::INT AS found FROM rw JOIN kw ON rw.doc_id = kw.doc_id AND lower(w) = kw.word GROUP BY 1, 2 HAVING count(DISTINCT w) >= 3""",
    "score_chunks": f"{_HITS} SELECT doc_id, chunk_idx, round(raw, 6) AS score FROM {_score('0.5::DOUBLE')}",
    "score_advanced": f"""{_CHUNKS}, {_KW3}, {_HIT_ONLY.replace("lower(text)", "text").replace("lower(lemma)", "lemma").replace("lower(stem)", "stem")}, na AS (SELECT doc_id, count(*) AS na FROM k0 GROUP BY 1)
      SELECT doc_id, chunk_idx, round(raw / (1 + m / kn * 0.5::DOUBLE) * (1 + m / na * 0.5::DOUBLE), 6) AS score FROM {_score('0.7::DOUBLE')} JOIN na USING (doc_id) JOIN kn USING (doc_id) WHERE m >= 2""",
    "score_density": f"{_HITS} SELECT doc_id, chunk_idx, score FROM {_density('0.5::DOUBLE')}",
    "filter_and_score": f"{_HITS} SELECT doc_id, chunk_idx, score FROM {_density('0.5::DOUBLE')} WHERE m >= 2 AND score >= 2",
    "scoring_modes": f"{_HITS} " + " UNION ALL ".join(f"SELECT '{k}' AS mode, doc_id, chunk_idx, round(raw, 6) AS score FROM {_score(f'{r}::DOUBLE')}" for k, r in MODES.items()),
    "find_answers": f"""{_CHUNKS}, {_ANSWERS} SELECT doc_id, answer_idx, chunk_idx, answer AS text, 0.9::DOUBLE AS confidence,
      (CASE WHEN contains(whole, 'semantic segmentation') THEN instr(whole, 'semantic segmentation') - 1 ELSE 0 END)::INT AS start_pos,
      (CASE WHEN contains(whole, 'semantic segmentation') THEN instr(whole, 'semantic segmentation') + 20 ELSE length(answer) END)::INT AS end_pos FROM fa""",
    "find_scored_answers": f"""{_HITS}, {_ANSWERS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY round(raw, 6) DESC, chunk_idx) - 1)::INT AS answer_idx, chunk_idx, answer AS text,
      0.9::DOUBLE AS confidence FROM {_score('0.5::DOUBLE')} JOIN fa USING (doc_id, chunk_idx)""",
    "rank_combined": f"""{_HITS}, sc AS (SELECT doc_id, chunk_idx, round(0.9::DOUBLE * round(raw, 6), 6) AS c FROM {_score('0.5::DOUBLE')})
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, chunk_idx) - 1)::INT AS answer_idx, chunk_idx, round(c, 3) AS combined_score FROM sc""",
    "strategy_diag": f"""{_CHUNKS}, {_ANSWERS} SELECT doc_id, count(*) AS answer_candidate_count, count(DISTINCT nullif(trim(answer), '')) AS distinct_answer_count,
      count(DISTINCT nullif(trim(answer), '')) > 1 AS strategy_applicable FROM fa GROUP BY 1""",
    "baseline": f"{_CHUNKS}, {_ANSWERS}, {_MEDOID} SELECT doc_id, answer_idx AS idx, answer AS text, 0.9::DOUBLE AS confidence, support FROM rk WHERE rn = 1",
    "baseline_ru": f"WITH RECURSIVE {CHUNKS_SQL.replace(SENTENCES, RUSSIAN)}, {_ANSWERS}, {_MEDOID} SELECT doc_id, answer_idx AS idx, answer AS text, 0.9::DOUBLE AS confidence, support FROM rk WHERE rn = 1",
    "attention_keywords": f"{_CHUNKS}, {_SHARES}, {_best_words('true')} SELECT doc_id, kw_idx, word, round(weight, 6) AS weight FROM kb",
    "attention_pipeline": _PIPELINE,
    "experiment": _experiment(),
    "rouge_l": f"WITH RECURSIVE {_lcs(_PAIRS)} SELECT conv_id, turn, round(rouge, 6) AS rouge_l FROM lv",
    "metrics_rowwise": _rowwise(),
    "span_search": """WITH l AS (SELECT doc_id, p, (p * (doc_id % 13 + 1)) % 17 / 4.0::DOUBLE AS s, (p * (doc_id % 13 + 4)) % 19 / 4.0::DOUBLE AS e FROM documents, unnest(range(0, 100)) AS u(p)),
      z AS (SELECT doc_id, sum(exp(s)) AS zs, sum(exp(e)) AS ze FROM l GROUP BY 1), b AS (SELECT a.doc_id, a.p AS i, b.p AS j, a.s, b.e,
        row_number() OVER (PARTITION BY a.doc_id ORDER BY a.s + b.e DESC, a.p, b.p) AS rn FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + 63)
      SELECT doc_id, i::INT AS start, j::INT AS "end", round(exp(s) / zs * exp(e) / ze, 6) AS probability FROM b JOIN z USING (doc_id) WHERE rn = 1""",
    "post_rules": f"SELECT conv_id, turn, CASE WHEN turn / 4.0 > 0.001 AND length(text) >= 2 THEN substr(text, 1, 150) ELSE '{Q.NOT_FOUND}' END AS answer FROM conversations",
    "ctx_tail": r"SELECT doc_id, array_to_string(w[greatest(1, len(w) - 49):], ' ') AS tail FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS w FROM documents)",
    "answer_stats": """SELECT CASE WHEN turn = 0 THEN 'missing' WHEN turn = 1 THEN 'error' WHEN turn = 2 THEN 'not_found' WHEN text IS NULL OR trim(text) = '' THEN 'missing' ELSE 'success' END AS status,
      count(*) AS n FROM conversations GROUP BY 1""",
    "levenshtein": "SELECT p_partkey, levenshtein(p_name, p_type)::INT AS distance FROM part",
    "text_metrics": f"""SELECT p_partkey, round({_COS.format(a='a', b='b')}, 6) AS cosine_sim, levenshtein(p_name, p_type)::DOUBLE AS lev_dist
      FROM (SELECT *, {_VEC.format('p_name')} AS a, {_VEC.format('p_type')} AS b FROM part)""",
    "char_f1": f"WITH {_f1(_PAIRS, _CHARS, '1')} SELECT conv_id, turn, round(f1, 6) AS char_f1 FROM v",
    "token_f1": f"WITH {_f1(_PAIRS, _SQUAD, '100')} SELECT conv_id, turn, round(f1, 6) AS token_f1 FROM v",
}

QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

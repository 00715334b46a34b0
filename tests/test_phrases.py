"""Keywords of several words, with hyphens and marks, and several questions, against the
definition."""

import math
import random
import re

from pyspark.sql import functions as F

from lexiquarry.functions import metrics as M
from lexiquarry.operators import keywords as K
from lexiquarry.operators import qa as Q
from lexiquarry.plans.fixtures import frequent_words, most_frequent

KEYWORDS = "doc_id long, kw_idx long, word string, weight double, lemma string, stem string, score_diff double"
CHUNKS = "doc_id long, chunk_idx int, text string, token_count int"


def by_definition(text, terms):
    """One alternation of the sorted terms between borders of words."""
    if not terms:
        return None
    pattern = re.compile(r"\b(?:{})\b".format("|".join(map(re.escape, sorted(terms)))))
    return [(m.start(), m.group()) for m in pattern.finditer(text.lower())]


def test_matches_by_definition(spark):
    rng = random.Random(8)
    pool = ["self", "self-attention", "attention", "semantic", "semantic segmentation", "c++", "c", "a.b", "größe", "U-Net", "u", "net", "x_1", "the end", "end", "-x", "(see", "3d", "$5"]
    chunks, keywords, want = [], [], {}
    for doc in range(60):
        own = rng.sample(pool, rng.randint(1, 6)) if doc else []
        keywords += [(doc, i, w, 1.0, w, rng.choice([w, w.split("-")[0].split(" ")[0], ""]), 0.5) for i, w in enumerate(own)]
        for c in range(2):
            text = rng.choice(["", " ", "."]).join(rng.choice([*pool, "Self-Attention", "SEMANTIC segmentation", "others", "selfish"]) + rng.choice([" ", "-", ", ", "\n", ""]) for _ in range(rng.randint(0, 12)))
            chunks.append((doc, c, text, 5))
    for doc, c, text, _ in chunks:
        terms = {t.lower() for d, _, _, _, a, b, _ in keywords if d == doc for t in (a, b) if t}
        found = by_definition(text, terms)
        if found is not None:
            want[doc, c] = found
    chunk_rows, keyword_rows = spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(keywords, KEYWORDS)
    matched = K.matched_chunks(chunk_rows, keyword_rows)
    assert {(r.doc_id, r.chunk_idx): [(h.start, h.word) for h in r.hits] for r in matched.collect()} == want
    assert {(r.doc_id, r.chunk_idx) for r in K.filter_chunks(matched, 2).collect()} == {k for k, v in want.items() if len({w for _, w in v}) >= 2}
    raw = {}
    for doc, c, text, _ in chunks:
        own = [w for d, _, w, *_ in keywords if d == doc]
        n = len(set(re.findall(r"\b(?:{})\b".format("|".join(map(re.escape, own))), text, re.I))) if own else 0
        if n >= 1:
            raw[doc, c] = n
    assert {(r.doc_id, r.chunk_idx): r.found for r in K.filter_chunks_raw(chunk_rows, keyword_rows, 1).collect()} == raw


def test_scores_of_phrases(spark):
    chunks = spark.createDataFrame([(1, 0, "Self-attention helps semantic segmentation; semantic tasks too.", 9), (1, 1, "nothing here", 2)], CHUNKS)
    rows = [(1, 0, "self-attention", 1.0, "self-attention", "self-attention", 0.5), (1, 1, "semantic segmentation", 0.5, "semantic segmentation", "segmentation", 0.25)]
    found = K.score_chunks(K.matched_chunks(chunks, spark.createDataFrame(rows, KEYWORDS))).collect()
    assert [(r.chunk_idx, r.matched) for r in found] == [(0, ["self-attention", "semantic segmentation"])]


def test_questions(spark):
    chunks = [(1, i, t, 3) for i, t in enumerate(["Alpha is one. Rest", "Beta is two. Rest", "none"])] + [(2, 0, "Alpha again. x", 3)]

    def said(question, context):
        at = F.instr(context, question)
        return F.struct(F.when(at > 0, F.substring_index(F.substring(context, at, F.length(context)), ".", 1)).otherwise("").alias("answer"), F.when(at > 0, 0.9).otherwise(0.1).alias("score"), at.alias("start"), at.alias("end"))

    asked = spark.createDataFrame([(1, 0, "Beta"), (1, 1, "Alpha"), (3, 0, "Alpha")], "doc_id long, question_no int, question string")
    found = Q.find_answers_to(spark.createDataFrame(chunks, CHUNKS), asked, said).orderBy("doc_id", "question_no", "answer_idx").collect()
    assert [(r.doc_id, r.question_no, r.answer_idx, r.chunk_idx, r.text) for r in found] == [
        (1, 0, 0, 1, "Beta is two"), (1, 0, 1, 0, ""), (1, 0, 2, 2, ""), (1, 1, 0, 0, "Alpha is one"), (1, 1, 1, 1, ""), (1, 1, 2, 2, ""),
    ]
    docs = spark.createDataFrame([(1, "Alpha is one. Beta is two."), (2, "Beta."), (3, None), (4, "Gamma is.")], "doc_id long, text string")
    keywords = spark.createDataFrame([(1, 0, "beta is", 1.0, "beta is", "beta is", 0.5)], KEYWORDS)
    models = Q.Models(answerer=said)
    whole = {r.doc_id: r for r in Q.baseline_questions(docs, asked, models=models).collect()}
    assert set(whole) == {1, 2, 3, 4} and whole[1].n_answers == 2 and whole[1].support == 1 and whole[2].text is None and whole[4].chunks_used == 1
    some = {r.doc_id: r for r in Q.baseline_questions(docs, asked, models=models, keywords=keywords).collect()}
    assert some[1].n_answers == 2 and some[2].chunks_used == 0 and some[4].text is None


def test_token_f1_counts_repeats(spark):
    rng = random.Random(1)
    rows = [(" ".join(rng.choice("xyz") for _ in range(rng.randint(0, 6))), " ".join(rng.choice("xyzw") for _ in range(rng.randint(0, 6)))) for _ in range(80)]

    def want(p, g):
        a, b = p.split(), g.split()
        k = sum(min(a.count(w), b.count(w)) for w in set(a))
        return 0.0 if not k else 100 * 2 * (k / len(a)) * (k / len(b)) / (k / len(a) + k / len(b))

    found = spark.createDataFrame(rows, "p string, g string").select("p", "g", M.token_f1(F.col("p"), F.col("g")).alias("f")).collect()
    assert all(abs(r.f - want(r.p, r.g)) < 1e-9 for r in found)


def test_matches_are_made_once_a_chunk(spark):
    chunks = spark.createDataFrame([(1, 0, "the cat sat. a cat", 5)], "doc_id long, chunk_idx int, text string, token_count int")
    kws = spark.createDataFrame([(1, 0, "cat", 1.0, "cat", "ca", 0.5)], "doc_id long, kw_idx int, word string, weight double, lemma string, stem string, score_diff double")
    rows = K.score_density(K.filter_chunks_by_word(K.matched_chunks(chunks, kws), 1)).where("score > 0")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(text") == 1
    assert rows.count() == 1


def test_marks_in_a_text_change_no_match(spark):
    chunks = spark.createDataFrame([(1, 0, "a\x00cat\x00-cat. Cat", 5), (1, 1, "a cat -cat. Cat", 5)], "doc_id long, chunk_idx int, text string, token_count int")
    kws = spark.createDataFrame([(1, 0, "cat", 1.0, "cat", "-cat", 0.5)], "doc_id long, kw_idx int, word string, weight double, lemma string, stem string, score_diff double")
    hits = {r.chunk_idx: [(h.start, h.word) for h in r.hits] for r in K.matched_chunks(chunks, kws).collect()}
    assert hits == {0: [(2, "cat"), (7, "cat"), (12, "cat")], 1: [(2, "cat"), (7, "cat"), (12, "cat")]}


def test_most_frequent_words(spark):
    rows = spark.createDataFrame([(["b", "a", "b", "c", "a", "b"],), ([],), (["x"],), (None,)], "w array<string>").select(most_frequent(F.col("w"), 2).alias("m")).collect()
    assert [[tuple(x) for x in r.m] for r in rows] == [[(-3, "b"), (-2, "a")], [], [(-1, "x")], []]


def test_words_of_documents_are_counted_in_place(spark):
    texts = spark.createDataFrame([(d, i, f"the cat {i} sat on mat {i % 2} end.") for d in range(3) for i in range(6)] + [(3, 0, None), (None, 0, "a cat")], "doc_id long, text_id int, text string")
    found = {f.__name__: f(texts) for f in (K.idf_filter, K.characteristic, K.characteristic_filter)}
    for name, rows in found.items():
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1, name
    kept = {(r.doc_id, r.text_id): r.kept for r in found["idf_filter"].collect()}
    assert len(kept) == 20 and kept[3, 0] == "" and kept[None, 0] == "" and kept[0, 2] == ""
    assert {(r.doc_id, r.text_id) for r in found["characteristic_filter"].collect()} == {(d, 0) for d in range(4)}


def test_distinct_keywords_of_a_chunk_are_made_once(spark):
    chunks = spark.createDataFrame([(1, 0, "the cat sat. a cat", 5), (1, 1, "none", 1)], CHUNKS)
    kws = spark.createDataFrame([(1, 0, "cat", 1.0, "cat", "ca", 0.5)], KEYWORDS)
    matched = K.matched_chunks(chunks, kws)
    for rows in (K.score_chunks(matched), K.score_density(matched)):
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(transform(hits") == 1
        assert [r.chunk_idx for r in rows.collect()] == [0]


def test_borders_of_plain_terms_look_at_one_character(spark):
    patterns = [r.p for r in spark.createDataFrame([(["cat", "a b"],), (["c++", "d"],), (["-x"],)], "t array<string>").select(K.term_pattern(F.col("t")).alias("p")).collect()]
    assert [(K._EDGE + "(?:" in p, p.endswith(K._EDGE)) for p in patterns] == [(False, False), (False, True), (True, False)]


def test_keywords_of_filtered_questions_are_made_once(spark, tmp_path, monkeypatch):
    from lexiquarry.plans import phrase_queries as P

    spark.createDataFrame([(1, "One text of words. Words of text again. Text is last."), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made, keywords = [], P.keywords
    monkeypatch.setattr(P, "keywords", lambda *a: made.append(1) or keywords(*a))
    rows = {r.doc_id: r for r in P.q_baseline_questions_filtered(spark, str(tmp_path)).collect()}
    assert len(made) == 1 and set(rows) == {1, 2} and rows[1].n_answers == 3 and rows[2].text is None


def test_advanced_score_makes_keywords_once(spark):
    chunks = spark.createDataFrame([(1, 0, "Alpha beta gamma alpha.", 4), (2, 0, "none", 1)], CHUNKS)
    rows = [(1, 0, "a", 1.0, "alpha", "alp", 0.5), (1, 1, "a", 0.5, "beta", "bet", 0.25), (1, 2, "g", 0.25, "gamma", "gam", 0.0), (2, 0, "x", 1.0, "x", "x", 0.0)]
    keywords = spark.createDataFrame(rows, KEYWORDS)
    scored = K.score_advanced(chunks, keywords)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    # Of the keywords with the word "a" the last counts, and all three count in the share.
    row = scored.collect()
    assert [(r.doc_id, r.matched) for r in row] == [(1, ["a", "g"])]
    base, early = 0.75 * 0.5 + 0.25 * 0.5, (1 - 6 / 23 + 1 - 11 / 23) / 2
    assert abs(row[0].score - base * (1 + 0.3 * early) * (1 + 0.7 * math.log(3)) * (1 + 2 / 3 * 0.5)) < 2e-6


def test_filters_make_no_places(spark):
    chunks = spark.createDataFrame([(1, 0, "Beta alpha, beta and alpha-beta.", 6), (1, 1, "Alpha \x00 alpha", 3), (1, 2, "", 0)], CHUNKS)
    keywords = spark.createDataFrame([(1, 0, "alpha", 1.0, "alpha", "alp", 0.5), (1, 1, "beta", 0.5, "beta", "beta", 0.5)], KEYWORDS)
    found = K.matched_chunks(chunks, keywords, places=False)
    assert {r.chunk_idx: [(h.word, h.k) for h in r.hits] for r in found.collect()} == {0: [("beta", 1), ("alpha", 0)], 1: [("alpha", 0)], 2: []}
    placed = K.matched_chunks(chunks, keywords)
    assert {r.chunk_idx: [(h.start, h.word, h.k) for h in r.hits] for r in placed.where("chunk_idx > 0").collect()} == {1: [(0, "alpha", 0), (8, "alpha", 0)], 2: []}
    for kept in (K.filter_chunks, K.filter_chunks_by_word):
        for n in (1, 2, 3):
            assert {r.chunk_idx for r in kept(found, n).collect()} == {r.chunk_idx for r in kept(placed, n).collect()}


def test_frequent_words_by_definition(spark):
    rng = random.Random(3)
    pool = ["alpha", "Beta", "größe", "x²y", "ⅳiv", "well-known", "a-b-c", "-", "--", "to", "i", "slovo_1", "слово", "e\u0301te", "\U00010400\U00010401", "ab", "\n", "3d", "٣x"]
    docs = [(d, "".join(rng.choice(pool) + rng.choice([" ", " ", "-", ", "]) for _ in range(40))) for d in list(range(20)) * 2] + [(99, None), (98, "")]
    kinds = [(4, r"\p{L}{4,}"), (3, r"\p{L}+(?:-\p{L}+)+"), (3, r"\p{L}{2,} \p{L}{2,}(?: \p{L}{2,})?")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = {}
    for kind, (n, pattern) in enumerate(kinds):
        words = frame.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("w")).groupBy("doc_id", "w").count().collect()
        for doc in {r.doc_id for r in words}:
            best = sorted((-r["count"], r.w) for r in words if r.doc_id == doc)[:n]
            want.setdefault(doc, []).extend((place, kind, w) for place, (_, w) in enumerate(best))
    found = {}
    for r in frequent_words(frame, kinds).orderBy("doc_id", "kw_idx").collect():
        assert r.kw_idx == len(found.setdefault(r.doc_id, []))
        found[r.doc_id].append(r.word)
    assert found == {doc: [w for *_, w in sorted(own)] for doc, own in want.items()}

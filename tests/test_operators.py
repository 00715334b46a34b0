import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import metrics as M
from lexiquarry.functions import vectors as V
from lexiquarry.operators import answers as A
from lexiquarry.operators import clean as P
from lexiquarry.operators import keywords as K
from lexiquarry.operators import qa as Q
from lexiquarry.operators import results as R
from lexiquarry.operators import stats as S
from lexiquarry.plans import keyword_queries
from lexiquarry.sources import files


def test_list_texts():
    assert P.parse_list_text("['a', ' b ', '']") == ["a", "b"]
    assert P.parse_list_text("plain") == ["plain"] and P.parse_list_text("[]") == [] and P.parse_list_text(None) == []
    assert P.parse_list_text("3") == ["3"] and P.parse_list_text("('x',)") == ["x"]


def test_string_lists(spark):
    rows = spark.createDataFrame([("['a','b']",), (None,)], "x string").select(P.string_lists("x").alias("y")).collect()
    assert [r.y for r in rows] == [["a", "b"], []]


def test_replace_underscores(spark):
    frame = spark.createDataFrame([(["a_b", "c"], 1)], "t array<string>, n int")
    assert P.replace_underscores(frame, "t").first().t_cleaned == ["a b", "c"]
    assert P.replace_underscores(frame, "n", "m").first().m == 1
    with pytest.raises(ValueError):
        P.replace_underscores(frame, "none")


def test_entity_tag(spark):
    rows = spark.createDataFrame([("PERSON",), ("x",)], "c string").select(P.entity_tag(F.col("c"), {"PERSON": "PER"}).alias("t")).collect()
    assert [r.t for r in rows] == ["PER", "O"]


def test_encoder_bucket(spark):
    v = spark.range(1).select(V.encode_text(F.lit("semantic Semantic")).alias("v")).first().v
    assert v[4] == 2 and sum(v) == 2


@pytest.mark.parametrize(
    ("tokens", "weights", "expected"),
    [
        (["▁анализ", "▁текст", "ов"], [0.4, 0.6, 0.8], [("анализ", 0.4), ("текстов", 0.7)]),
        (["Ġsemantic", "Ġsegment", "ation"], [0.3, 0.5, 0.7], [("semantic", 0.3), ("segmentation", 0.6)]),
        (["анализ", "текст", "##ов"], [0.2, 0.4, 0.6], [("анализ", 0.2), ("текстов", 0.5)]),
        (["first", "▁next"], [0.1, 0.2], [("first", 0.1), ("next", 0.2)]),
    ],
)
def test_attention_words(spark, tokens, weights, expected):
    frame = spark.createDataFrame([(1, tokens, weights)], "k int, tokens array<string>, weights array<double>")
    rows = K.attention_words(frame, ["k"]).orderBy("word_pos").collect()
    assert [(r.word, round(r.total / r.m, 6)) for r in rows] == expected


def test_score_chunks(spark):
    text = "semantic segmentation method. unrelated baseline."
    chunks = spark.createDataFrame([(1, 0, text, 5)], "doc_id long, chunk_idx int, text string, token_count int")
    kws = spark.createDataFrame([(1, 0, "segmentation", "segmentation", "segment", 0.8, 0.4)], "doc_id long, kw_idx int, word string, lemma string, stem string, weight double, score_diff double")
    row = K.score_chunks(K.matched_chunks(chunks, kws)).first()
    expected = 0.6 * (1 + 0.3 * (1 - 9 / len(text))) * (1 + 0.7 * np.log1p(1)) * 1.5
    assert row.matched == ["segmentation"] and abs(row.score - expected) < 1e-6
    with pytest.raises(ValueError):
        K.score_chunks(chunks, 1.5)


def test_thresholds():
    assert [round(t, 7) for t in K.thresholds()] == [1.5, 1.3, 1.14, 1.012, 0.9096, 0.82768, 0.762144, 0.7097152, 0.6597152, 0.6097152, 0.5597152, 0.5097152]


def test_extract_keywords(spark):
    docs = spark.createDataFrame([(1, "semantic segmentation segmentation network")], "doc_id long, text string")
    rows = K.extract(docs, 2).collect()
    assert len(rows) == 2 and "segmentation" in {r.word for r in rows}


def test_baseline_and_attention(spark):
    docs = spark.createDataFrame([(1, "We study semantic segmentation. We propose a residual model.")], "doc_id long, text string")
    config = Q.PipelineConfig(20, 2, min_answer_threshold=0.0)
    assert Q.baseline(docs, "task?", config).first().text == "semantic segmentation"
    kws = spark.createDataFrame([(1, 0, "semantic", 1.0)], "doc_id long, kw_idx int, word string, weight double")
    refs = spark.createDataFrame([(1, "unrelated reference")], "doc_id long, reference string")
    row = Q.attention(docs, refs, "semantic", config, keywords=kws).first()
    assert (row.text, row.reranked, row.chunks_used) == ("semantic segmentation", True, 1)
    own = Q.attention(docs, refs, "semantic", config).first()
    assert (own.text, own.reranked) == ("semantic segmentation", True)
    none = Q.attention(docs, refs, "semantic", Q.PipelineConfig(20, 2)).first()
    assert (none.text, none.reranked, none.confidence, none.chunks_used) == ("semantic segmentation", False, 0.9, 1)


def test_attention_keywords(spark):
    """The greatest weight of a word over all chunks; ranks up to the limit."""
    chunks = spark.createDataFrame([(1, 0, "aa bb bb"), (1, 1, "bb cc cc cc"), (2, 0, "x"), (3, 0, "")], "doc_id long, chunk_idx int, text string")
    found = sorted((r.doc_id, r.kw_idx, r.word, round(r.weight, 6)) for r in Q.attention_keywords(chunks, "q").collect())
    assert found == [(1, 1, "bb", 0.666667), (1, 2, "aa", 0.333333), (1, 101, "cc", 0.75)]
    assert {r.word for r in Q.attention_keywords(chunks, "q", limit=1).collect()} == {"bb", "cc"}


def test_dynamic_idf_in_place(spark, tmp_path):
    """Words are counted in their document's row: only documents are dealt, and nothing is
    joined or ordered. Repeated, null and odd rows against a plain count."""
    spark.createDataFrame([(1, "One two three. Two three four! Three four five? Don't a_b c.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = keyword_queries.q_dynamic_idf(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Sort" not in plan
    rng = np.random.default_rng(5)
    words = ["aa", "Bb", "cc", "d", "e-f", "gg.", "İx", "ΣΑΣ", "1½", "hh\nii", "jj\u2003kk", "ll\x1fmm", ".", ""]
    made = [(d, i, " ".join(rng.choice(words, rng.integers(0, 9)))) for d in range(40) for i in range(rng.integers(1, 9))]
    rows = [*made, *((d, i, t) for d, i, t in made if d < 5), (50, 0, None), (51, 0, "x y"), (52, None, "aa bb cc"), (52, 0, "aa bb dd"), (None, 0, "aa bb cc"), (None, 1, "dd ee ff")]
    expected = {}
    terms = lambda t: re.findall(r"\w{2,}", t.lower())
    for doc in {d for d, _, _ in rows}:
        own = [(i, (t or "") if doc is not None else "") for d, i, t in rows if d == doc]
        df = Counter(w for _, t in own for w in set(terms(t)))
        idf = {w: round(math.log(len(own) / m) + 1, 9) for w, m in df.items()}
        best = (-1.0, 0.0, 0.0)
        for at in K.thresholds():
            kept = Counter(i for i, t in own for w in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if re.fullmatch(r"\w{2,}", w) and idf[w] >= round(at, 9))
            cover = sum(i is not None and kept[i] >= 3 for i, _ in own) / len(own)
            best = max(best, (min(cover, 0.8), cover, at), key=lambda x: x[0])
        expected[doc] = (round(best[2], 6), round(best[1], 6))
    found = K.dynamic_idf(spark.createDataFrame(rows, "doc_id long, text_id int, text string")).collect()
    assert len(found) == len(expected) and {r.doc_id: (r.threshold, r.coverage) for r in found} == expected


def test_attention_keywords_in_place(spark, tmp_path):
    """Words are counted in their document's row, so only documents are dealt and nothing is
    ordered; the words are those of the source of attention given as any other."""
    docs = [(1, "One two two. " * 90), (2, "x y z"), (3, None), (4, "Straße\u00a0İstanbul a_b don't 1½ ΣΑΣ. " * 40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = keyword_queries.q_attention_keywords(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    tied = " ".join(f"w{i}" for i in range(1024))  # 1 / 1024 has ten places, of which half a one goes up
    odd = [(1, 0, tied), (1, 1, "W1 w1\tb\u2003c.d"), (2, 0, None), (None, 0, "aa aa"), (None, 3, "bb")]
    chunks = spark.createDataFrame(odd, "doc_id long, chunk_idx int, text string").unionByName(keyword_queries.chunks(spark, str(tmp_path)).select("doc_id", "chunk_idx", "text").where("doc_id > 2"))
    given = Q.Models(attention=lambda question, context: Q.word_shares(question, context))
    rows = [set(map(tuple, Q.attention_keywords(chunks, "q", m, limit).collect())) for limit in (3, 100) for m in (Q.Models(), given)]
    assert rows[0] == rows[1] and rows[2] == rows[3] and (1, 1, "w0", 0.000976563) in rows[0] and (None, 1, "aa", 1.0) in rows[0]


def test_russian_path(spark):
    text = "Мы решаем задачу, т.е. ищем слова. Это г. Москва… Конец."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ru, en = (Q.Models().chunks(docs, Q.PipelineConfig(5, 1, language=x)).collect() for x in ("ru", "en"))
    assert [r.text for r in ru] != [r.text for r in en] and ru[0].text == "Мы решаем задачу, т.е. ищем"[: len(ru[0].text)]
    assert Q.baseline(docs, "?", Q.PipelineConfig(8, 1, language="ru")).count() == 1
    diagnostics = Q.strategy_diagnostics(spark.createDataFrame([(1, "анализ текстов"), (1, "классификация текстов")], "doc_id long, text string")).first()
    assert (diagnostics.strategy_applicable, diagnostics.distinct_answer_count, diagnostics.answer_candidate_count) == (True, 2, 2)


def test_model_seams(spark):
    """Models take the place of encoder, tokenizer, answerer, splitter and attention."""
    from lexiquarry.functions import models

    seams = Q.Models(
        answerer=models.answerer("answer", lambda: lambda q, c: {"answer": c[:3], "score": len(c) / 100, "start": 0, "end": 3}),
        encode=models.encoder("length", lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]),
        tokenize=models.tokenizer("letters", lambda: list),
        splitter=lambda text: F.split(text, ";", -1),
        attention=models.attention("first", lambda: lambda q, c: [(c[:2], 0.5)]),
    )
    docs = spark.createDataFrame([(1, "ab;cdef;gh"), (2, "zz")], "doc_id long, text string")
    config = Q.PipelineConfig(4, 0, min_answer_threshold=0.0)
    chunks = seams.chunks(docs, config).orderBy("doc_id", "chunk_idx").collect()
    assert [(r.text, r.token_count) for r in chunks] == [("ab", 2), ("cdef", 4), ("gh", 2), ("zz", 2)]
    assert {r.doc_id: r.text for r in Q.baseline(docs, "q", config, seams).collect()} == {1: "ab", 2: "zz"}
    refs = spark.createDataFrame([(1, "abc")], "doc_id long, reference string")
    assert Q.attention(docs, refs, "q", config, seams).count() == 2
    loads = []
    assert models.once("n", lambda: loads.append(1) or "m") == models.once("n", lambda: loads.append(1) or "m") == "m" and loads == [1]


def test_span_search(spark):
    rows = [(1, [0.0, 1.0, 2.0, 0.0], [0.0, 3.0, 1.0, 9.0], [None, 1, 1, None], [(0, 0), (0, 2), (3, 6), (0, 0)], "ab cde"), (2, [1.0], [1.0], [0], [(0, 1)], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, s array<double>, e array<double>, segments array<int>, offsets array<struct<from:int,to:int>>, context string")
    plain = {r.doc_id: (r.start, r.end) for r in Q.span_search(frame.drop("segments", "offsets", "context")).collect()}
    assert plain == {1: (2, 3), 2: (0, 0)}
    assert {r.doc_id: (r.start, r.end) for r in Q.span_search(frame.drop("segments", "offsets", "context"), most=1).collect()} == {1: (3, 3), 2: (0, 0)}
    found = {r.doc_id: (r.start, r.end, r.answer) for r in Q.span_search(frame).collect()}
    assert found == {1: (0, 2, "ab"), 2: (0, 0, "")}
    shares = np.exp([0.0, 1.0, 2.0, 0.0]) / np.exp([0.0, 1.0, 2.0, 0.0]).sum(), np.exp([0.0, 3.0, 1.0, 9.0]) / np.exp([0.0, 3.0, 1.0, 9.0]).sum()
    probability = {r.doc_id: r.probability for r in Q.span_search(frame).collect()}
    assert probability == {1: pytest.approx(shares[0][1] * shares[1][1], abs=1e-9), 2: 0.0}


def test_stride_windows(spark):
    rng = np.random.default_rng(1)
    for n, size, stride in ((0, 4, 1), (3, 4, 1), (4, 4, 1), (5, 4, 3), (11, 4, 1), (10, 4, 0)):
        words = [f"w{k}" for k in range(n)]
        docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
        tokens = F.filter(F.split("text", " "), lambda w: w != "")
        found = [(r.first, r.tokens) for r in Q.stride_windows(docs, tokens, size, stride).orderBy("window").collect()]
        want, at = [], 0
        while n and (not want or at - (size - stride) + size < n):
            want.append((at, words[at : at + size]))
            at += size - stride
        assert found == want
    docs = spark.createDataFrame([(1, "one. two semantic segmentation"), (2, "  ")], "doc_id long, text string")
    tokens = F.filter(F.split("text", " "), lambda w: w != "")
    found = {r.doc_id: r.answer for r in Q.long_context_answer(docs, "q", tokens, size=2, stride=1).collect()}
    assert found == {1: "one", 2: Q.NOT_FOUND} and rng is not None


def test_scored_answers_carry_keywords(spark):
    chunks = spark.createDataFrame([(1, 0, "Task about data data. x"), (1, 1, "none")], "doc_id long, chunk_idx int, text string")
    kws = spark.createDataFrame([(1, 0, "Data", 1.0, "data", "dat", 0.5), (1, 1, "task", 0.5, "task", "task", 0.1)], "doc_id long, kw_idx int, word string, weight double, lemma string, stem string, score_diff double")
    row = Q.find_scored_answers(K.score_chunks(K.matched_chunks(chunks, kws)), F.lit("q")).collect()
    assert len(row) == 1 and row[0].matched == ["Data", "task"] and [tuple(x) for x in row[0].keyword_scores] == [("Data", 2), ("task", 1)]


def test_keyword_parameters(spark):
    docs = spark.createDataFrame([(1, "deep learning model 3d deep learning nets")], "doc_id long, text string")
    grams = [r.word for r in K.extract(docs, n=2).collect()]
    assert set(grams) == {"deep learning", "learning model", "learning nets"}
    refs = spark.createDataFrame([(1, "nets nets")], "doc_id long, text string")
    assert K.extract(docs, references=refs).first().word == "nets"
    assert K.extract(docs, stop_words=["deep", "learning"]).count() == 2
    words = spark.createDataFrame([(1, "nets"), (1, "absent"), (2, "x")], "doc_id long, word string")
    found = K.by_cosine(words, spark.createDataFrame([(1, "nets"), (2, " ")], "doc_id long, text string")).orderBy("place").collect()
    assert [(r.doc_id, r.word) for r in found] == [(1, "nets"), (1, "absent")]
    assert len(K.STOP_WORDS) == len(set(K.STOP_WORDS)) and len(K.RUSSIAN_STOP_WORDS) == len(set(K.RUSSIAN_STOP_WORDS))


def test_reduced_attention(spark):
    """Mean over layers, heads and from-positions, of context tokens."""
    rng = np.random.default_rng(3)
    tensor = rng.random((2, 3, 4, 4))
    frame = spark.createDataFrame([(tensor.tolist(), [None, 0, 1, 1])], "w array<array<array<array<double>>>>, s array<int>")
    found = frame.select(K.reduced_attention(F.col("w"), F.col("s")).alias("r")).first().r
    assert [r.pos for r in found] == [2, 3] and [r.weight for r in found] == pytest.approx(tensor.mean(axis=(0, 1, 2))[2:].tolist())
    rows = spark.createDataFrame([(["ab", "c"], [1.0, 2.0])], "tokens array<string>, weights array<double>")
    assert K.attention_words(rows.withColumn("k", F.lit(1)), ["k"], "BertTokenizerFast").count() == 2
    assert K.attention_words(rows.withColumn("k", F.lit(1)), ["k"], "RobertaTokenizerFast").count() == 1


def test_experiment_has_all_documents(spark):
    text = "We study images for semantic segmentation. "
    docs = spark.createDataFrame([(1, text), (2, "Other words stand here. More follow."), (3, ""), (4, text), (5, text), (6, text)], "doc_id long, text string")
    # 1 is re-ranked; 2 fails validation; 3 is blank; 4 has no keyword, 5 none in its text, 6 no reference.
    kws = spark.createDataFrame([(d, 0, "Images" if d != 5 else "absent", 1.0) for d in (1, 2, 3, 5, 6)] + [(1, 1, "study", 0.5)], "doc_id long, kw_idx int, word string, weight double")
    refs = spark.createDataFrame([(d, "semantic segmentation") for d in range(1, 6)], "doc_id long, reference string")
    modes = {"a": 0.0, "b": 1.0}
    rows = Q.experiment(docs, kws, refs, "images?", modes, ["largest"], ["highest_chunk_score", "combined_score"], Q.PipelineConfig(20, 2), aspect="images").collect()
    of = {d: [r for r in rows if r.doc_id == d] for d in range(1, 7)}
    assert {d: len(x) for d, x in of.items()} == {1: 4, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}
    assert all((r.final_answer, r.cosine_sim, r.lev_dist, r.base_cosine_sim, r.base_lev_dist) == ("semantic segmentation", 1.0, 0.0, 1.0, 0.0) for r in of[1])
    assert {(r.score_chunk_strategy, r.choose_answer_strategy) for r in of[1]} == {(m, a) for m in modes for a in ("highest_chunk_score", "combined_score")}
    for d in range(2, 7):
        r = of[d][0]
        assert {r.score_chunk_strategy, r.choose_cluster_strategy, r.choose_answer_strategy, r.final_answer} == {Q.NO_VALID} and r.lev_dist is None
    assert of[2][0].first_answer == "Other words stand here" and of[2][0].base_lev_dist > 0
    assert (of[3][0].first_answer, of[3][0].base_lev_dist) == (Q.NONE, None)
    assert of[6][0].first_answer == "semantic segmentation" and of[6][0].base_lev_dist is None


def test_config():
    for bad in ({"chunk_max_tokens": 3}, {"overlap_tokens": 200}, {"min_answer_threshold": 0.95}, {"language": "de"}, {"answer_cluster_threshold": 2}):
        with pytest.raises(ValueError):
            Q.PipelineConfig(**bad)


def test_select_clustered_labels(spark):
    rows = [(1, 0, "a", 0.9, 0.8, [1.0, 0.0]), (1, 1, "b", 0.8, 0.7, [0.8, 0.6]), (1, 2, "c", 0.4, 0.1, [0.0, 1.0]), (2, 0, "z", 0.5, 0.5, [1.0, 0.0])]
    a = spark.createDataFrame(rows, "doc long, idx long, text string, confidence double, chunk_score double, u array<double>")
    found = A.select_clustered(a, A.greedy_clusters(a, 0.0), list(A.CLUSTER_KEYS), ["highest_chunk_score", "highest_similarity", "combined_score"]).collect()
    assert len(found) == 30
    assert all(r.cluster_size is None for r in found if r.doc == 2) and all(r.cluster_size == 3 for r in found if r.doc == 1)


def test_clusterings():
    sim = np.array([[1, 0.9, 0.1, 0.0], [0.9, 1, 0.2, 0.0], [0.1, 0.2, 1, 0.95], [0.0, 0.0, 0.95, 1]])
    assert sorted(A.agglomerative_labels(sim)) == [(0, 0), (1, 0), (2, 2), (3, 2)]
    assert A.dbscan_labels(sim, 0.2) == [(0, 0), (1, 0), (2, 2), (3, 2)]
    assert sorted(A.greedy_labels(sim, 0.5)) == [(0, 0), (1, 0), (2, 2), (3, 2)]
    assert {p for p, _ in A.percentile_labels(sim)} == {0, 1, 2, 3}
    assert sorted(A.optics_labels(sim)) == [(0, 0), (1, 0), (2, 2), (3, 2)]
    assert A.dbscan_labels(np.eye(3), 0.2) == []


def test_parse_metrics_and_applicability(spark):
    frame = spark.createDataFrame([("{'cosine_sim': 0.9, 'lev_dist': 2}",), ('{"cosine_sim": 0.5}',), ("--None--",), (None,)], "m string")
    rows = frame.select(R.parse_metrics(F.col("m")).alias("p")).collect()
    assert [tuple(r.p) for r in rows] == [(0.9, 2.0), (0.5, 0.0), (0.0, 0.0), (0.0, 0.0)]
    docs = spark.createDataFrame([("a", True), ("a", False), ("b", False)], "doc_id string, strategy_applicable boolean")
    assert tuple(R.applicability(docs).first()) == (2, 1, 50.0)
    assert tuple(R.applicability(docs.drop("strategy_applicable")).first()) == (2, 2, 100.0)
    assert tuple(R.applicability(docs.limit(0)).first()) == (0, 0, 0.0)


def test_diagnostics(spark):
    frame = spark.createDataFrame([(1, "x"), (1, "y "), (1, " "), (2, "z")], "doc_id long, text string")
    rows = {r.doc_id: tuple(r)[1:] for r in Q.strategy_diagnostics(frame).collect()}
    assert rows == {1: (3, 2, True), 2: (1, 1, False)}


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        return row[-1]

    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = (["abcd"[i] for i in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(2))
        assert M.common_subsequence(a, b) == plain(a, b)


def test_metrics_rowwise(spark, tmp_path):
    import re
    from collections import Counter

    def f1(p, g):
        k = sum((Counter(p) & Counter(g)).values())
        return 2 * k / (len(p) + len(g)) if k else 0.0

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return 2 * row[-1] / (len(a) + len(b)) if row[-1] else 0.0

    def squad(t):
        return re.sub(r"\b(a|an|the)\b", " ", re.sub(r"[!-/:-@\[-`{-~]", "", t.lower())).split()

    long = "an answer of many words, " * 6
    turns = [("user", "first"), ("assistant", "The tail of it."), ("user", long + "and the tail of it"), ("assistant", long), ("user", "the tail, of"), ("assistant", " "), ("user", " "), ("assistant", "x"), ("user", "unanswered")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    expected = {}
    for i in range(0, 8, 2):
        p, golds = turns[i][1], [t for _, t in turns[max(i - 1, 0) : i + 2 : 2 if i else 1] if t.strip()]
        golds = [g for g in golds if g != p] if i == 0 else golds
        best = lambda m: max((m(g) for g in golds if p.strip()), default=0.0)  # noqa: E731, B023
        words = lambda t: re.findall("[a-z0-9]+", t.lower())
        expected[i] = (best(lambda g: f1(p.lower(), g.lower())), 100 * best(lambda g: f1(squad(p), squad(g))), best(lambda g: lcs(words(p), words(g))))
    found = {r.turn: (r.char_f1, r.token_f1, r.rouge_l_f1) for r in keyword_queries.q_metrics_rowwise(spark, str(tmp_path)).collect()}
    assert found.keys() == expected.keys()
    for i, e in expected.items():
        assert found[i] == pytest.approx(e, abs=6e-5)


def test_p_values(spark):
    """Against tabled quantiles and closed forms."""
    one = spark.range(1)
    value = lambda c: one.select(c.alias("p")).first().p
    for x, k, p in ((3.841458820694124, 1, 0.05), (38.885138659830055, 26, 0.05), (11.344866730144373, 3, 0.01), (0.0, 4, 1.0), (2.0, 2, np.exp(-1.0))):
        assert value(S.chi2_survival(F.lit(x), F.lit(k))) == pytest.approx(p, abs=1e-8)
    for z, p in ((1.959963984540054, 0.05), (2.5758293035489004, 0.01), (0.0, 1.0), (6.0, 1.973175290075e-9)):
        assert value(S.normal_two_sided(F.lit(z))) == pytest.approx(p, rel=2e-7)
    for t, v, p in ((2.2281388519649385, 10.0, 0.05), (1.0, 1.0, 0.5), (0.0, 3.0, 1.0), (12.706204736432095, 1.0, 0.05)):
        assert value(S.t_two_sided(F.lit(t), F.lit(v))) == pytest.approx(p, abs=1e-7)


def test_clusterings_against_definitions():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 14))
        m = rng.normal(size=(n, 3))
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        sim = np.round(m @ m.T, 9)
        # Average linkage by its definition: means over all pairs of two clusters.
        groups = [[i] for i in range(n)]
        while len(groups) > 1:
            apart = {(a, b): np.mean([1 - sim[i, j] for i in groups[a] for j in groups[b]]) for a in range(len(groups)) for b in range(a + 1, len(groups))}
            (a, b), least = min(apart.items(), key=lambda x: x[1])
            if least >= 0.5:
                break
            groups[a] += groups.pop(b)
        assert sorted(A.agglomerative_labels(sim)) == sorted((p, min(g)) for g in groups for p in g)
        # Density clusters: cores joined by nearness; a border point goes to its first core's.
        near = 1 - sim <= 0.4
        core = [i for i in range(n) if near[i].sum() >= 3]
        label = {i: i for i in core}
        for _ in core:
            for i in core:
                label[i] = min(label[j] for j in core if near[i, j])
        want = label | {i: min(label[j] for j in core if near[i, j]) for i in range(n) if i not in label and any(near[i, j] for j in core)}
        assert dict(A.dbscan_labels(sim, 0.4, 3)) == want


def test_prune_append_results(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", "x")], "doc_id long, t string, gone string")
    pruned = P.with_nulls(frame, ["doc_id", "t"], ["note"])
    assert pruned.columns == ["doc_id", "t", "note"] and tuple(pruned.first()) == (1, "a", None)
    assert sorted(str(tuple(r)) for r in R.append(pruned, frame.drop("gone")).collect()) == ["(1, 'a', None)"] * 2
    lines = [{"doc_id": "1", "final_answer": "x", "base_metrics": "{'cosine_sim': 0.5}", "strategy_applicable": True}, {"doc_id": "2", "corrected_metrics": "--None--"}]
    (tmp_path / "results.json").write_text("\n".join(map(json.dumps, lines)))
    found = files.read_results(spark, str(tmp_path / "results.json")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.final_answer, r.corrected_metrics, r.strategy_applicable) for r in found] == [("1", "x", None, True), ("2", None, "--None--", None)]


def test_files(spark, tmp_path):
    rows = [{"doc_id": "1", "original_text": "a", "tasks": ["t"]}, {"doc_id": "2", "original_text": "б", "tasks": []}]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)), encoding="utf-8")
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=2), encoding="utf-8")
    for name in ("lines.json", "array.json"):
        assert files.read_json(spark, str(tmp_path / name), files.DOCUMENTS).count() == 2
    with pytest.raises(FileNotFoundError):
        files.read_json(spark, str(tmp_path / "none.json"), files.DOCUMENTS)
    files.export_json(files.read_json(spark, str(tmp_path / "lines.json"), files.DOCUMENTS), str(tmp_path / "deep/out.json"))
    assert len(json.loads((tmp_path / "deep/out.json").read_text(encoding="utf-8"))) == 2
    (tmp_path / "e.csv").write_text("﻿id;text;text_clean;Task_aspects\n1;raw;;\"['x', 'y']\"\n2;raw;clean;[]\n", encoding="utf-8")
    found = files.read_error_corpus(spark, str(tmp_path / "e.csv")).collect()
    assert [tuple(r) for r in found] == [("1", "raw", ["x", "y"])]
    files.export_csv(files.read_json(spark, str(tmp_path / "lines.json"), files.DOCUMENTS).select("doc_id", "original_text"), str(tmp_path / "out/x.csv"), index="n")
    assert (tmp_path / "out/x.csv").read_bytes().startswith(b"\xef\xbb\xbfn;doc_id;original_text")
    back = files.read_csv(spark, str(tmp_path / "out/x.csv"), index=True)
    assert back.columns == ["doc_id", "original_text"] and [tuple(r) for r in back.orderBy("doc_id").collect()] == [("1", "a"), ("2", "б")]
    (tmp_path / "m.json").write_text(json.dumps({"fields": [{"field_id": "f", "field_name": "n", "questions": ["q"], "keywords": []}]}))
    assert files.read_field(spark, str(tmp_path / "m.json"))["questions"] == ["q"]
    files.append_done(spark.createDataFrame([(1, "a")], "doc_id long, x string"), str(tmp_path / "done"))
    todo = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert [r.doc_id for r in R.not_done(todo, spark.read.parquet(str(tmp_path / "done"))).collect()] == [2]


def test_cli(spark, tmp_path):
    from lexiquarry import cli

    (tmp_path / "t.txt").write_text("We study semantic segmentation. We propose a model.")
    args = cli.parser().parse_args([str(tmp_path / "t.txt"), "--question", "task?"])
    assert cli.answer(spark, args) == {"answer": "semantic segmentation", "confidence": 0.9, "chunks_used": 1, "metadata": {"mode": "baseline"}}
    args = cli.parser().parse_args([str(tmp_path / "t.txt"), "--question", "q", "--mode", "attention", "--reference-answer", "r"])
    assert cli.answer(spark, args) == {"answer": "semantic segmentation", "confidence": 0.9, "chunks_used": 1, "metadata": {"mode": "attention", "reranked": False}}
    args = cli.parser().parse_args([str(tmp_path / "t.txt"), "--question", "q", "--mode", "attention"])
    with pytest.raises(SystemExit):
        cli.answer(spark, args)


def test_entry_point_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert found.returncode == 0 and int(found.stdout.split()[-1]) > 100, found.stderr

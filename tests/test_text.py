import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiquarry.functions import text as X
from lexiquarry.operators import chunks as C


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column(F.col("text")).alias("x")).first().x


def test_english_sentences(spark):
    assert one(spark, "Dr. Smith reports 3.14 points. This works!", X.sentences) == ["Dr. Smith reports 3.14 points.", "This works!"]
    assert one(spark, "He has a Ph.D. degree. See Plan B. Next one.", X.sentences) == ["He has a Ph.", "D. degree.", "See Plan B. Next one."]
    assert one(spark, None, X.sentences) == [] and one(spark, " \n ", X.sentences) == []


def test_russian_sentences(spark):
    text = "Проф. А. С. Иванов описал метод, т.е. основной алгоритм. Он работает!"
    assert one(spark, text, X.russian_sentences) == ["Проф. А. С. Иванов описал метод, т.е. основной алгоритм.", "Он работает!"]


def test_chunks_of_six_with_overlap(spark):
    docs = spark.createDataFrame([(1, "one two three. four five. six seven.")], "doc_id long, text string")
    rows = C.build_chunks(docs, 6, 2).orderBy("chunk_idx").collect()
    assert [r.token_count for r in rows] == [5, 4]
    assert rows[1].text.startswith("four five") and (rows[1].start_sentence, rows[1].end_sentence) == (1, 2)


def fold(counts, most, overlap):
    """The chunk rule, one part after another."""
    done, current = [], []
    for i, n in enumerate(counts):
        if current and sum(counts[k] for k in current) + n > most:
            done.append(current)
            kept = []
            for k in reversed(current if overlap else []):
                if kept and sum(counts[j] for j in kept) + counts[k] > overlap:
                    break
                kept.insert(0, k)
            current = kept
        current.append(i)
    return [(c[0], c[-1]) for c in [*done, current] if c]


def test_chunk_ranges_against_fold(spark):
    import random

    rng = random.Random(3)
    lists = [[rng.randint(0, 9) for _ in range(rng.randint(0, 30))] for _ in range(60)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, counts array<int>")
    for most, overlap in ((12, 4), (9, 0), (20, 9)):
        rows = frame.select("i", X.chunk_ranges(F.col("counts"), most, overlap).alias("r")).collect()
        for r in rows:
            assert [(x.first, x.last) for x in r.r] == fold(lists[r.i], most, overlap)


def test_chunk_limits(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    with pytest.raises(ValueError):
        C.build_chunks(docs, 10, 5)
    assert C.build_chunks(docs, 10, 2).count() == 0


def test_long_sentence_keeps_its_number(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj. kk ll.")], "doc_id long, text string")
    rows = C.split_long(docs, 5).orderBy("part_pos").collect()
    assert [(r.number, r.n) for r in rows] == [(0, 3), (0, 3), (0, 3), (0, 1), (1, 2)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=20), st.integers(4, 12), st.integers(0, 3))
def test_legacy_chunks_cover_all(counts, most, overlap):
    found = C.legacy_chunks(counts, most, overlap)
    fit = [i for i, n in enumerate(counts) if n <= most]
    assert {i for own, _ in found for i in own} >= set(fit)
    assert all(n == sum(counts[i] for i in own) for own, n in found)


def test_streaming_chunks(spark, tmp_path):
    from lexiquarry.streaming import stream_chunks, write_chunks

    spark.createDataFrame([(1, "one two three. four five. six seven.")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = write_chunks(stream_chunks(stream, 6, 2), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stops_are_found_in_one_pass(spark):
    rows = ["Mr. X met Dr. Y. at a.com today. v1.2.3 is out!", "1.2.3.4 and 3.14. <prd> <stop> End", "xMr. A.B. Ph.D. yes?! No.COM. \x85", None, " . "]
    frame = spark.createDataFrame([(t,) for t in rows], "text string")
    found = frame.select(X.sentences(F.col("text")).alias("s"))
    assert [r.s for r in found.collect()] == [
        ["Mr. X met Dr. Y. at a.com today.", "v1.2.", "3 is out!"],
        ["1.2.", "3.4 and 3.14.", ".", "End"][:2] + ["End"],
        ["xMr.", "A.B. Ph.", "D. yes?", "No.COM."],
        [],
        [],
    ]
    plain = frame.select(X.strip(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plain


def test_token_counts(spark):
    rng = random.Random(5)
    texts = ["", ".", "...", " ", "a", " a", "a ", "a b.", ". a", "a . b", "a\tb", "a  b", "a\x0bb\x0cc\rd\ne", "a\xa0b", "A.B. c"]
    texts += ["".join(rng.choice("ab.. \t\n é") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.text for r in frame.where(X.tokens.count(F.col("text")) != F.size(X.tokens(F.col("text")))).collect()] == []
    parts = frame.select(F.sort_array(X.sentence_parts(F.array("text"), 3)).alias("made"), F.sort_array(X.sentence_parts(F.array("text"), 3, lambda t: X.tokens(t))).alias("counted"))
    assert parts.where("made <> counted").count() == 0


def test_chunks_hold_no_parts_of_their_document(spark):
    docs = spark.createDataFrame([(1, " ".join(f"Word {i} ends." for i in range(40)))], "doc_id long, text string")
    plan = C.build_chunks(docs, 6, 2)._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.splitlines() if "Generate explode" in line]
    # Of doc_id, parts, counts and texts only the first goes on.
    assert len(generated) == 1 and "posexplode" not in plan and ", [1, 2, 3], false, [" in generated[0]

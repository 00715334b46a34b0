"""Resumable model calls, table functions and stems."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import models as M
from lexiquarry.functions import stems
from lexiquarry.sources.resumable import answer_all, without_errors, written

DOCS = "doc_id long, text string"


def killed_once(log, marker):
    """A model that notes each call, and takes its whole process down at one document, once."""

    def load():
        def answer(text):
            with open(log, "a") as f:
                f.write(f"{text}\n")
            if text == "text 33" and not os.path.exists(marker):
                open(marker, "w").close()
                os._exit(1)
            if text == "text 7":
                raise ValueError("seven")
            return None if text is None else text.upper()

        return answer

    return load


def test_killed_run_is_resumed(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(90, None), (91, " "), (None, "lost"), (5, "text 5"), (6, "zz")], DOCS)
    path, log = f"file://{tmp_path}/out", str(tmp_path / "calls")
    load = killed_once(log, str(tmp_path / "killed"))
    with pytest.raises(Exception):
        answer_all(docs, path, load, batch=4, buckets=3)
    kept = {r.doc_id for r in written(spark, path).collect()}
    before = Counter(open(log).read().splitlines())
    assert 33 not in kept and 0 < len(kept) < 62
    rows = answer_all(docs, path, load, batch=4, buckets=3).collect()
    assert Counter(r.doc_id for r in rows) == Counter([*range(60), 90, 91])
    calls = Counter(open(log).read().splitlines())
    assert all(calls[f"text {i}"] == before[f"text {i}"] == 1 for i in kept if i < 60)
    status = {r.doc_id: (r.status, r.answer) for r in rows}
    assert status[7] == ("error", "[ERROR] seven") and status[90] == ("missing", None) and status[91] == ("missing", " ".upper()) and status[6] == ("success", "TEXT 6")
    # A third run has nothing to ask; without errors the error is asked again.
    answer_all(docs, path, load, batch=4, buckets=3)
    assert Counter(open(log).read().splitlines()) == calls
    without_errors(spark, path, f"file://{tmp_path}/again")
    answer_all(docs, f"file://{tmp_path}/again", load, batch=4, buckets=3)
    assert Counter(open(log).read().splitlines()) - calls == Counter({"text 7": 1})
    assert written(spark, f"file://{tmp_path}/again").count() == 62


def test_same_batches_have_same_files(spark, tmp_path):
    """A task that runs again finds its files and calls nothing."""
    from lexiquarry.sources.resumable import _Writer

    class Row:
        def __init__(self, i):
            self.doc_id, self.bucket, self.text = i, i // 10, f"t{i}"

    calls = []
    writer = _Writer(f"file:{tmp_path}/x", 4, lambda: lambda t: calls.append(t) or t)
    first, again = writer.write(iter(map(Row, range(25)))), writer.write(iter(map(Row, range(25))))
    assert (first.answers, first.skipped, again.answers, again.skipped, len(calls)) == (25, 0, 0, 8, 25)
    assert written(spark, f"file:{tmp_path}/x").count() == 25 and not [f for f in os.listdir(tmp_path / "x") if f.startswith("_")]


def test_empty_table(spark, tmp_path):
    assert answer_all(spark.createDataFrame([], DOCS), f"file://{tmp_path}/none", lambda: str).count() == 0


def test_table_functions(spark):
    rows = spark.createDataFrame([(1, "q1", "a b a"), (2, "q2", ""), (3, None, None)], "doc_id long, question string, text string")
    load = lambda: lambda q, c: {"answer": f"{q}:{c}", "score": 0.5, "start": 0, "end": 1} if c else None
    found = M.lateral(rows, M.answer_function("t1", load), F.col("question")).collect()
    column = rows.select("doc_id", M.answerer("t2", lambda: lambda q, c: {"answer": f"{q}:{c}", "score": 0.5, "start": 0, "end": 1})(F.col("question"), F.col("text")).alias("a")).where("doc_id = 1").first().a
    assert [(r.doc_id, r.answer, r.score) for r in found] == [(1, "q1:a b a", 0.5)] and column.answer == "q1:a b a"
    words = lambda: lambda q, c: sorted(Counter((c or "").split()).items())
    found = M.lateral(rows, M.attention_function("t3", words), "q").orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.word, r.weight) for r in found] == [(1, 0, "a", 2.0), (1, 1, "b", 1.0)]


# Words and stems that are published with the rules.
ENGLISH = """caresses caress flies fli dies die denied deni died die agreed agre owned own sized size meeting meet stating state siezing siez itemization item
sensational sensat traditional tradit reference refer colonizer colon plotted plot consigned consign consignment consign consistency consist consistently consist
consolation consol consolatory consolatori knack knack knackeries knackeri knavish knavish kneaded knead knightly knight generously generous generate generat
general general communiti communiti community communiti happy happi by by say say cries cri ties tie gas gas this this gaps gap kiwis kiwi hopping hop hoping hope
luxuriated luxuri falling fall bed bed shed shed fizzed fizz dog's dog youth youth boyish boyish skies sky succeeding succeed relational relat possibly possibl
electricity electr controlling control rolling roll""".split()
RUSSIAN = """в в вавиловка вавиловк вагнера вагнер вагон вагон вагоне вагон вагонов вагон вагоны вагон важная важн важнее важн важнейшие важн важнейшими важн
важничал важнича важно важн важность важност важностью важност поступаешь поступа поступала поступа поступить поступ поступкам поступк красивая красив
красивейший красив бегавшая бега читающий чита программирование программирован""".split()


@pytest.mark.parametrize("language,golden", [("en", ENGLISH), ("ru", RUSSIAN)])
def test_stems(spark, language, golden):
    pairs = list(zip(golden[::2], golden[1::2]))
    rows = spark.createDataFrame([(w.upper(), s) for w, s in pairs] + [(None, None), ("", "")], "word string, stem string")
    found = rows.select("stem", stems.stemmer(language)(F.col("word")).alias("found")).collect()
    assert [r.found for r in found] == [r.stem for r in found]


def test_chunks_of_the_table_function_are_dealt_to_tasks(spark, tmp_path):
    from lexiquarry.plans import model_queries

    spark.createDataFrame([(d, f"Words of text {d}. More words.") for d in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = model_queries.q_attention_udtf(spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.word, r.n_chunks) for r in rows.collect()} == {(d, w, 1) for d in range(5) for w in ("words", "of", "text", "more")}

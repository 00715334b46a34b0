"""Windows of texts, answers over windows and generated answers, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexiquarry.functions import models as M
from lexiquarry.operators import generation as G
from lexiquarry.operators.qa import NOT_FOUND

BLANK = " \t\n\x0b\f\r"
WORDS = re.compile(r"[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*")
TEXTS = [None, "", " \n ", "one", "  a bb  ccc\n", "ж😀 слово x y", " ".join(f"w{k % 7}" for k in range(95)) + "\n"]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def windows(text, size, stride):
    found = list(WORDS.finditer(text or ""))
    out, k = [], 0
    while found:
        part = found[k * (size - stride) : k * (size - stride) + size]
        out.append((k, part[0].start(), text[part[0].start() : part[-1].end()]))
        if k * (size - stride) + size >= len(found):
            break
        k += 1
    return out


def test_windows_are_parts_of_the_text(spark):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice(["ab", "c", " ", "\n ", "é", "😀"]) for _ in range(rng.randint(0, 80))) for _ in range(40)]
    docs = docs_of(spark, texts)
    for size, stride in ((3, 1), (4, 0), (10, 9), (512, 128)):
        got = sorted((r.doc_id, r.window, r.first_char, r.text) for r in G.text_windows(docs, size, stride).collect())
        assert got == sorted((d, *w) for d, t in enumerate(texts) for w in windows(t, size, stride))
    with pytest.raises(ValueError):
        G.text_windows(docs, 4, 4)


def test_a_very_long_text(spark):
    text = " ".join(f"word{k}" for k in range(300_000))
    got = G.text_windows(docs_of(spark, [text]), 512, 128).agg(F.count(F.lit(1)).alias("n"), F.max("first_char").alias("last")).first()
    want = windows(text, 512, 128)
    assert (got.n, got["last"]) == (len(want), want[-1][1])


def number(question, context):
    """The first run of digits, scored by its value; without one, 0.6 for none."""
    found = F.regexp_extract(context, "[0-9]+", 0)
    at = (F.instr(context, found) - 1).cast("int")
    score = F.when(found == "", 0.6).otherwise(found.cast("double") / 100)
    return F.struct(found.alias("answer"), score.alias("score"), at.alias("start"), (at + F.length(found)).cast("int").alias("end"))


def test_answers_over_windows(spark):
    texts = ["a b c 70 d e f g h 90 i j k l", "a b c d e f", "20 a b c d e f g", None, "", "a 30 b c d e 30 f"]
    got = {r.doc_id: r for r in G.windowed_answers(docs_of(spark, texts), "how many?", number, 4, 2).collect()}
    for doc, text in enumerate(texts):
        spans, none, n = {}, [], 0
        for _, first, part in windows(text, 4, 2):
            n += 1
            m = re.search("[0-9]+", part)
            none.append(1 - int(m[0]) / 100 if m else 0.6)
            if m:
                spans.setdefault((first + m.start(), first + m.end()), []).append(int(m[0]) / 100)
        best = max(spans, key=lambda s: (max(spans[s]), -s[0]), default=None)
        r = got[doc]
        assert r.windows == n
        if n == 0:
            assert r.answer is None and r.score is None
        elif best is None or min(none) > max(spans[best]):
            assert (r.answer, r.start, r.end, r.agreeing) == ("", None, None, None) and abs(r.score - min(none)) < 1e-12
        else:
            assert (r.answer, r.start, r.end, r.agreeing) == (text[best[0] : best[1]], *best, len(spans[best]))
    assert got[0].answer == "90" and got[2].answer == "" and got[0].agreeing == 2
    sure = {r.doc_id: r for r in G.windowed_answers(docs_of(spark, texts), "how many?", number, 4, 2, impossible=False).collect()}
    assert sure[2].answer == "20" and sure[1].answer is None and sure[1].windows == 2
    # Answers of more words than asked for, and outside of their window, count for nothing.
    whole = lambda q, c: F.struct(c.alias("answer"), F.lit(0.9).alias("score"), F.lit(0).alias("start"), F.length(c).alias("end"))
    outside = lambda q, c: F.struct(c.alias("answer"), F.lit(0.9).alias("score"), F.lit(0).alias("start"), (F.length(c) + 1).alias("end"))
    for answerer, most in ((whole, 3), (outside, 100)):
        assert all(r.answer in ("", None) for r in G.windowed_answers(docs_of(spark, texts), "?", answerer, 4, 2, most).collect())


def counted(fail="|"):
    """Loads a model that fails on whole batches with a bar, and gives the length of the prompt."""

    def load():
        def replies(prompts):
            if any(fail in p for p in prompts):
                raise ValueError("a bar")
            return [f"{p}<|assistant|>\n{len(p)} {{context}}\nQuestion: and?" for p in prompts]

        return replies

    return load


def test_generated_answers(spark):
    texts = TEXTS + ["a | b", "{question} {context}", "c d e f"]
    docs = docs_of(spark, texts)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    for batch in (1, 3, 50):
        generate = M.generator(f"counted{batch}", counted(), batch)
        got = {r.doc_id: r.answer for r in G.generated_answers(docs, "why?", words, generate, 3).collect()}
        for doc, text in enumerate(texts):
            tail = [w for w in re.split(f"[{BLANK}]+", text or "") if w][-3:]
            prompt = G.TEMPLATE.replace("{context}", "\0").replace("{question}", "why?").replace("\0", " ".join(tail))
            want = NOT_FOUND if not tail else "[ERROR] a bar" if "|" in " ".join(tail) else f"{len(prompt)} {{context}}"
            assert got[doc] == want, (doc, got[doc], want)
    best = {r.doc_id: r for r in G.best_of_windows(docs, "why?", M.generator("counted3", counted(), 3), F.length, 2, 0).collect()}
    assert best[7].answer.split()[1] == "{context}" and best[7].window == 1 and 0 not in best and 2 not in best
    assert G.generated_answers(docs.where("doc_id > 99"), "why?", words, M.generator("counted3", counted(), 3)).count() == 0


def test_replies_that_do_not_fit(spark):
    """Fewer replies than prompts are errors of each prompt, not shifted replies."""
    short = M.generator("short", lambda: lambda prompts: ["one"] if len(prompts) == 1 else [], 4)
    none = M.generator("none", lambda: lambda prompts: [], 4)
    rows = docs_of(spark, ["a", None, "b", "c"]).repartition(1)
    assert [r.r for r in rows.orderBy("doc_id").select(short(F.col("text")).alias("r")).collect()] == ["one", None, "one", "one"]
    assert {r.r for r in rows.where("text is not null").select(none(F.col("text")).alias("r")).collect()} == {"[ERROR] 0 replies to 1 prompts"}

"""Models as column and table functions. A model is loaded once in each Python worker, on first use,
and gets whole Arrow batches; the seams of the operators take what these functions return.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Models of this process by the name they were asked for.
_LOADED: dict[str, Any] = {}


def once(name: str, load: Callable[[], Any]) -> Any:
    """The model ``name`` of this process; ``load`` is called the first time only."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def encoder(name: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """Vectors of texts by a model that takes a list of texts. Null texts are empty."""

    def run(texts: pd.Series) -> pd.Series:
        listed = texts.fillna("").tolist()
        return pd.Series([[float(x) for x in v] for v in once(name, load)(listed)] if listed else [])

    return F.pandas_udf(run, "array<double>")


def tokenizer(name: str, load: Callable[[], Callable[[str], list[str]]]) -> Callable[[Column], Column]:
    """Tokens of texts; ``sentences`` of what is returned takes arrays of sentences."""

    def run(texts: pd.Series) -> pd.Series:
        model = once(name, load)
        return pd.Series([list(model(t)) for t in texts.fillna("")], dtype="object")

    def run_all(texts: pd.Series) -> pd.Series:
        model = once(name, load)
        return pd.Series([None if ts is None else [list(model(t)) for t in ts] for ts in texts], dtype="object")

    one, many = F.pandas_udf(run, "array<string>"), F.pandas_udf(run_all, "array<array<string>>")

    def tokenize(text: Column) -> Column:
        return one(text)

    tokenize.sentences = many
    return tokenize


def answerer(name: str, load: Callable[[], Callable[[str, str], dict]]) -> Callable[[Column, Column], Column]:
    """Answers ``{answer, score, start, end}`` of a model that takes a question and a context."""

    def run(questions: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        model = once(name, load)
        found = [model(q, c) for q, c in zip(questions, contexts)]
        return pd.DataFrame([{k: f.get(k) for k in ("answer", "score", "start", "end")} for f in found], columns=["answer", "score", "start", "end"])

    return F.pandas_udf(run, "answer string, score double, start int, end int")


def attention(name: str, load: Callable[[], Callable[[str, str], list[tuple[str, float]]]]) -> Callable[[Column, Column], Column]:
    """Words and weights of a model that takes a question and a context."""

    def run(questions: pd.Series, contexts: pd.Series) -> pd.Series:
        model = once(name, load)
        return pd.Series([[{"word": w, "weight": float(x)} for w, x in model(q, c)] for q, c in zip(questions, contexts)], dtype="object")

    return F.pandas_udf(run, "array<struct<word:string,weight:double>>")


def generator(name: str, load: Callable[[], Callable[[list[str]], list[str]]], batch: int = 8) -> Callable[[Column], Column]:
    """Replies of a model that takes a list of prompts, ``batch`` at a time. The model is loaded
    once for all batches of a task. Prompts of a batch that fails are asked one by one, and one
    that still fails has ``[ERROR]`` and the message as its reply; null prompts have null."""

    def ask(model: Callable[[list[str]], list[str]], prompts: list[str]) -> list[str]:
        try:
            replies = list(model(prompts))
            if len(replies) != len(prompts):
                raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
            return replies
        except Exception as error:  # the model's own, whatever it is
            if len(prompts) == 1:
                return [f"[ERROR] {error}"]
            return [ask(model, [prompt])[0] for prompt in prompts]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = once(name, load)
        for prompts in batches:
            asked = prompts.dropna()
            replies = [r for at in range(0, len(asked), batch) for r in ask(model, asked.iloc[at : at + batch].tolist())]
            yield pd.Series(replies, index=asked.index, dtype="object").reindex(prompts.index).where(prompts.notna(), None)

    return F.pandas_udf(run, "string")


def answer_function(name: str, load: Callable[[], Callable[[str, str], dict]]) -> Any:
    """A table function ``(question, context) -> (answer, score, start, end)`` of the same
    models as ``answerer``, for lateral joins and SQL; rows go to it in Arrow batches. A
    model's null is no row."""

    class Answers:
        def eval(self, question: str, context: str) -> Iterator[tuple]:
            found = once(name, load)(question, context)
            if found is not None:
                yield tuple(found.get(k) for k in ("answer", "score", "start", "end"))

    return F.udtf(Answers, returnType="answer string, score double, start int, end int", useArrow=True)


def attention_function(name: str, load: Callable[[], Callable[[str, str], list[tuple[str, float]]]]) -> Any:
    """A table function ``(question, context) -> (pos, word, weight)``: a row for each word
    that the model of ``attention`` gives, in its order."""

    class Words:
        def eval(self, question: str, context: str) -> Iterator[tuple]:
            for pos, (word, weight) in enumerate(once(name, load)(question, context)):
                yield pos, word, float(weight)

    return F.udtf(Words, returnType="pos int, word string, weight double", useArrow=True)


def lateral(rows: DataFrame, function: Any, question: str | Column, context: str = "text") -> DataFrame:
    """``rows`` joined with what a table function gives for each, ``question`` being a text or
    a column; rows for which it gives nothing go."""
    asked = F.lit(question) if isinstance(question, str) else question.outer()
    return rows.lateralJoin(function(asked, F.col(context).outer()))

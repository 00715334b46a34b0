"""Cleaning of input columns."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replace_underscores(frame: DataFrame, column: str, to: str | None = None) -> DataFrame:
    """Underscores of an array's strings become spaces, in column ``to`` (by default
    ``<column>_cleaned``); columns of other types pass through."""
    if column not in frame.columns:
        raise ValueError(f"no column {column}")
    kind = frame.schema[column].dataType
    is_list = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)
    cleaned = F.transform(column, lambda x: F.replace(x, F.lit("_"), F.lit(" "))) if is_list else F.col(column)
    return frame.withColumn(to or f"{column}_cleaned", cleaned)


def first_reference(cleaned: str = "tasks_cleaned", tasks: str = "tasks") -> Column:
    """The first reference answer; a row without one fails."""
    found = F.coalesce(F.get(F.col(cleaned), F.lit(0)), F.get(F.col(tasks), F.lit(0)))
    return F.coalesce(found, F.raise_error(F.lit("row without a reference answer")))


def has_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def digit_candidates(candidates: DataFrame, column: str = "candidate") -> DataFrame:
    """Distinct candidates without a digit, or of three or four words whose first and last
    have none."""
    words = F.filter(F.split(F.col(column), r"\s+", -1), lambda w: w != "")
    framed = F.size(words).isin(3, 4) & ~has_digit(F.get(words, F.lit(0))) & ~has_digit(F.element_at(words, -1))
    return candidates.select(column).where(~has_digit(F.col(column)) | framed).distinct()


def parse_list_text(value: object) -> list[str]:
    """Strings of a Python-list text: blank gives none, other text itself."""
    if value is None or (isinstance(value, float) and value != value):
        return []
    text = str(value).strip()
    if text in ("", "[]"):
        return []
    try:
        found = ast.literal_eval(text)
    except (SyntaxError, ValueError):
        return [text]
    listed = found if isinstance(found, (list, tuple)) else [found]
    return [s for s in (str(x).strip() for x in listed) if s]


@F.pandas_udf(T.ArrayType(T.StringType()))
def string_lists(values: pd.Series) -> pd.Series:
    """``parse_list_text`` over a column (Python literals have no native reader)."""
    return values.map(parse_list_text)


def entity_tag(category: Column, tags: dict[str, str], default: str = "O") -> Column:
    """Tag of a category by lookup in ``tags``."""
    entries = [F.lit(x) for pair in tags.items() for x in pair]
    return F.coalesce(F.create_map(*entries)[category], F.lit(default)) if entries else F.lit(default)


def with_nulls(frame: DataFrame, keep: list[str], empty: list[str]) -> DataFrame:
    """Columns ``keep``, and null string columns ``empty``."""
    return frame.select(*keep, *(F.lit(None).cast("string").alias(c) for c in empty))

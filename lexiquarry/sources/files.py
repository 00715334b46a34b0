"""Readers and writers of document collections, results and field models."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import string_lists

DOCUMENTS = "doc_id string, original_text string, tasks array<string>"
#: Result rows; metrics stay text, as they can be objects, texts of dicts or markers.
RESULTS = (
    "doc_id string, original_text string, tasks_cleaned array<string>, first_answer string, score_chunk_strategy string, "
    "choose_cluster_strategy string, choose_answer_strategy string, final_answer string, base_metrics string, corrected_metrics string, "
    "total_chunk_count int, scored_chunk_count int, answer_candidate_count int, distinct_answer_count int, strategy_applicable boolean, "
    "valid_answer_count int, keyword_count int, chunk_max_tokens int"
)


def _head(spark: SparkSession, path: str) -> str:
    """First non-blank line of a text file, in whatever store; FileNotFoundError without it."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.text(path).where(F.trim("value") != "").first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise
    return row.value.lstrip("﻿ \t") if row else ""


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON Lines, or a JSON array where the file begins with one."""
    return spark.read.schema(schema).option("multiLine", _head(spark, path).startswith("[")).json(path)


def write_json(frame: DataFrame, path: str) -> None:
    """JSON Lines, in as many files as partitions."""
    frame.write.mode("overwrite").json(path)


def export_json(frame: DataFrame, path: str) -> None:
    """A pretty JSON array in one local file, for small results; rows stream one by one."""
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, text in enumerate(frame.toJSON().toLocalIterator()):
            out.write((",\n" if i else "\n") + json.dumps(json.loads(text), ensure_ascii=False, indent=4))
        out.write("\n]\n")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, RESULTS)


def read_csv(spark: SparkSession, path: str, sep: str = ";", index: bool = False) -> DataFrame:
    """CSV with a header and quoted fields over several lines; a byte order mark is dropped,
    and with ``index`` the first column, too."""
    frame = spark.read.option("quote", '"').option("escape", '"').csv(path, sep=sep, header=True, multiLine=True)
    frame = frame.toDF(*(c.lstrip("﻿") for c in frame.columns))
    return frame.drop(frame.columns[0]) if index else frame


def write_csv(frame: DataFrame, path: str, sep: str = ";") -> None:
    frame.write.mode("overwrite").csv(path, sep=sep, header=True)


def export_csv(frame: DataFrame, path: str, sep: str = ";", index: str | None = None) -> None:
    """One local CSV file with a header and a byte order mark, for spreadsheets; rows stream
    one by one. ``index`` names a first column with the rows' numbers from 0."""
    import csv
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        rows = csv.writer(out, delimiter=sep)
        rows.writerow([*([] if index is None else [index]), *frame.columns])
        for i, row in enumerate(frame.toLocalIterator()):
            rows.writerow([*([] if index is None else [i]), *("" if x is None else x for x in row)])


def read_error_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, original_text, tasks_cleaned)`` of a ``;`` CSV with ``id``, ``text_clean`` and
    ``Task_aspects`` (a Python list as text); ``text`` stands in for missing clean text. Rows
    without an aspect go."""
    frame = read_csv(spark, path)
    missing = [c for c in ("id", "text_clean", "Task_aspects") if c not in frame.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    text: Column = F.coalesce("text_clean", "text") if "text" in frame.columns else F.col("text_clean")
    rows = frame.select(F.col("id").cast("string").alias("doc_id"), text.alias("original_text"), string_lists("Task_aspects").alias("tasks_cleaned"))
    return rows.where(F.size("tasks_cleaned") > 0)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as documents: ``(doc_id, text)`` with the path as id."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def read_field(spark: SparkSession, path: str) -> dict:
    """The first field of a field model; it must be there and have questions."""
    kind = "fields array<struct<field_id:string,field_name:string,questions:array<string>,keywords:array<string>>>"
    row = spark.read.schema(kind).json(path, multiLine=True).first()
    if row is None or not row.fields:
        raise ValueError("the model has no fields")
    if not row.fields[0].questions:
        raise ValueError("the first field has no questions")
    return row.fields[0].asDict()


def append_done(frame: DataFrame, path: str, buckets: int = 64) -> None:
    """Append finished documents, laid out by a bucket of their id, so a resumed run reads
    only ids and nothing is written twice."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    frame.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(path)

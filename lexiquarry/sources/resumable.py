"""Calls of a slow model whose finished batches outlive the run: a Spark data source that
calls the model as it writes.

Rows go to buckets of their id, in order of the id, and are written in small files, each
under a name made of its bucket and ids. A file appears whole or not at all, so what a killed
run has finished stays; the next run leaves out the ids that have been written. A task that
is run again, or twice at once, makes the same files under the same names: no document is
written twice. A row on which the model fails is written with the error, and the run goes on.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What is written for a document; ``status`` is as in ``operators.qa.answer_status``.
RESULT = "doc_id long, bucket int, status string, answer string"

Model = Callable[[str | None], str | None]


@dataclass
class Written(WriterCommitMessage):
    """What a task has done: answers written, of these errors, and batches found written."""

    answers: int
    errors: int
    skipped: int


def _filesystem(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _status(answer: str | None) -> str:
    return "missing" if answer is None or not answer.strip() else "success"


class _Writer(DataSourceWriter):
    """Calls ``load()`` once a task, and its model for every row of ``(doc_id, bucket, text)``."""

    def __init__(self, path: str, batch: int, load: Callable[[], Model]):
        self.path, self.batch, self.load = path, batch, load

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow.fs import FileType

        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        schema = pa.schema([("doc_id", pa.int64()), ("bucket", pa.int32()), ("status", pa.string()), ("answer", pa.string())])
        model, done = None, Written(0, 0, 0)
        for bucket, rows in itertools.groupby(iterator, key=lambda r: r.bucket):
            while part := list(itertools.islice(rows, self.batch)):
                ids = ",".join(str(r.doc_id) for r in part)
                name = f"{root}/part-{bucket:05d}-{hashlib.sha256(ids.encode()).hexdigest()[:32]}.parquet"
                if system.get_file_info(name).type != FileType.NotFound:
                    done.skipped += 1
                    continue
                model = model or self.load()
                answers = []
                for r in part:
                    try:
                        answer = model(r.text)
                        answers.append((r.doc_id, bucket, _status(answer), answer))
                    except Exception as error:  # the row's own; the run goes on
                        answers.append((r.doc_id, bucket, "error", f"[ERROR] {error}"))
                        done.errors += 1
                # Names that begin with an underscore or a dot are not read as data.
                hidden = f"{root}/_{name.rsplit('/', 1)[1]}-{id(part):x}"
                pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*answers), schema)], schema=schema), hidden, filesystem=system)
                system.move(hidden, name)
                done.answers += len(part)
        return done

    def commit(self, messages: list) -> None:
        """Every finished file counts already."""

    def abort(self, messages: list) -> None:
        """What has been finished stays for the next run."""


def _source(load: Callable[[], Model]) -> type[DataSource]:
    class ModelCalls(DataSource):
        @classmethod
        def name(cls) -> str:
            return "model_calls"

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            return _Writer(self.options["path"], int(self.options["batch"]), load)

    return ModelCalls


def written(spark: SparkSession, path: str) -> DataFrame:
    """``RESULT`` of all runs so far; empty without any."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(path)


def answer_all(docs: DataFrame, path: str, load: Callable[[], Model], batch: int = 10, buckets: int = 64) -> DataFrame:
    """Answers of a model to the documents ``(doc_id, text)`` that ``path`` has none of yet,
    written in batches of ``batch``; all that ``path`` has, as in ``written``.

    ``load`` makes the model, in each task that calls it. Ids name documents: of repeated ids
    the least text is asked, and rows without an id are left out. Null texts go to the model
    as they are. Errors are answers too; ``without_errors`` asks them again.
    """
    spark = docs.sparkSession
    spark.dataSource.register(_source(load))
    rows = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("text").alias("text"))
    todo = rows.join(written(spark, path).select("doc_id"), "doc_id", "left_anti")
    todo = todo.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).select("doc_id", "bucket", "text")
    dealt = todo.repartition(buckets, "bucket").sortWithinPartitions("bucket", "doc_id")
    dealt.write.format("model_calls").option("path", path).option("batch", str(batch)).mode("append").save()
    return written(spark, path)


def without_errors(spark: SparkSession, path: str, to: str) -> None:
    """Copy the answers that are no errors to a new folder, where ``answer_all`` then asks
    for the rest. Its files have names of their own."""
    kept = written(spark, path).where("status <> 'error'")
    hidden = f"{to}/_copy"
    kept.write.mode("overwrite").parquet(hidden)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{hidden}/part-*")
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.globStatus(at) or []:
        system.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{to}/{status.getPath().getName()}"))
    system.delete(jvm.org.apache.hadoop.fs.Path(hidden), True)

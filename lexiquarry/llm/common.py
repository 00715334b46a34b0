"""Helpers shared by the training-data operators: written intermediates, size-checked
broadcasts and streaming over groups of packed rows."""

from __future__ import annotations

import atexit
import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python; bounds a worker's memory with long texts.
BATCH_ROWS = 2048
#: Rows up to which a side is broadcast; checked by counting before the hint is given.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session
    on one machine (tests) gets one of its own where that is unset; on a cluster, where
    executors would not see each other's files, an unset folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexiquarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete_all(spark: SparkSession, path: str) -> None:
    """At the end of the process: what is still staged, if the session is alive."""
    try:
        _delete(spark, path)
    except Exception:  # the session has been stopped; the folder's owner cleans up
        pass


_FOLDERS: set[str] = set()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost
    executor costs a re-read, not a recomputation. ``release`` deletes the files as soon as
    no plan reads them; what is left goes when the process ends."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/lexiquarry/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete_all, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def release(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no plan still to be run reads."""
    for table in tables:
        _delete(table.sparkSession, table._staged_at)


def arrow_rows(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting at most ``rows`` rows; else Spark chooses."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows of one key beyond which a join spreads the key over several tasks.
HOT_ROWS = 100_000


def join_spread(rows: DataFrame, one: DataFrame, keys: list[str], count: str, how: str = "inner", hot: int | None = None, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``one`` (a row for each key, with the number ``count`` of the
    rows that have it) on null-safe equal ``keys``; ``count`` goes.

    A key with more than ``HOT_ROWS`` rows is spread: its rows are dealt by a hash of the
    row (so a lost task deals them alike again), and its row of ``one`` is copied for each. There are at most rows / ``HOT_ROWS`` such keys;
    they are broadcast if they are counted to be few. ``total``: number of ``rows``, if
    known; so few can't have such a key.
    """
    hot = hot or HOT_ROWS
    if total is not None and total <= hot:
        return _null_safe(rows, one.drop(count), keys, how)
    many = one.where(F.col(count) > hot).select(*(F.col(k).alias(f"__hot_{k}") for k in keys), F.ceil(F.col(count) / hot).cast("long").alias("__deals"))
    if many.isEmpty():
        return _null_safe(rows, one.drop(count), keys, how)
    many = broadcast_if_small(many)
    same = lambda side: [side[k].eqNullSafe(many[f"__hot_{k}"]) for k in keys]
    drop = [f"__hot_{k}" for k in keys]
    deals = F.coalesce("__deals", F.lit(1))
    left = rows.join(many, same(rows), "left").withColumn("__deal", F.pmod(F.xxhash64(*(rows[c] for c in rows.columns)), deals)).drop("__deals", *drop)
    right = one.join(many, same(one), "left").withColumn("__deal", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1))).drop("__deals", count, *drop)
    return _null_safe(left, right, [*keys, "__deal"], how).drop("__deal")


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    named = right.select(*(F.col(k).alias(f"__key_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    return left.join(named, [left[k].eqNullSafe(named[f"__key_{k}"]) for k in keys], how).drop(*(f"__key_{k}" for k in keys))


def by_group(
    df: DataFrame, key: str, each: Callable[[object, Iterator[dict]], Iterator[dict]], schema: str, parts: int, order: tuple[str, ...] = (), dealt: Column | None = None
) -> DataFrame:
    """Bring rows of equal ``key`` together, in ``order``, and call ``each(key, rows)`` on
    every group; ``rows`` is an iterator, so a group need not fit in memory.

    ``dealt``: the partition of a key, from 0 to ``parts - 1``; without it keys are hashed.
    """
    arrow_schema = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for value, group in itertools.groupby(rows, key=lambda r: r[key]):
            yield from _packed(each(value, group), arrow_schema)

    dealt_out = df.repartitionById(parts, dealt.cast("int")) if dealt is not None else df.repartition(parts, key)
    return dealt_out.sortWithinPartitions(key, *order).mapInArrow(giving_back(run), schema)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which what the task has freed goes back to the system: workers are kept
    for later tasks of any kind, and their memory with them."""

    def wrapped(rows: Iterator) -> Iterator:
        yield from run(rows)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def packed(rows: Iterator[dict], schema: pa.Schema, many: int = 4096, most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of a task's rows, of at most ``many`` rows or about ``most_bytes`` of
    binary."""
    return giving_back(lambda rows: _packed(rows, schema, many, most_bytes))(rows)


def _packed(rows: Iterator[dict], schema: pa.Schema, many: int = 4096, most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, (bytes, str)))
        if len(held) >= many or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


arrow_schema = _arrow_schema

"""Canonical exact digests of documents.

The canonical form of a text is its NFKC normalisation, case-folded, with runs of white
space folded to one space and trimmed. Its fingerprint is the 128-bit xxhash (xxh3) of the
UTF-8 bytes. Within buckets of equal fingerprints the canonical bytes are compared; where
they differ (a collision), the fingerprints of the bucket are lengthened by a SHA-256.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, arrow_schema, materialise, packed, partitions


#: Level of compression of what is shuffled.
LEVEL = 3
#: Digests of several texts that are handled as literals; more are joined.
FEW_CLASHES = 1000


def canonical(text: str | None) -> bytes:
    """NFKC, case-folded, NFKC again (folding can undo it), white space folded."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


Digest = Callable[[bytes], str]


def exact_groups(docs: DataFrame, digest: Digest = digest) -> DataFrame:
    """Buckets of equal canonical texts: ``(digest, form, n_docs, first_doc)``.

    ``form`` is the compressed canonical text; grouping by digest and form compares bytes,
    and partial aggregation keeps a large group of copies in no single task.
    """
    arrow_rows(docs.sparkSession)
    kind = "doc_id long, digest string, form binary"
    schema = arrow_schema(docs.sparkSession, kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        squeeze = zstandard.ZstdCompressor(LEVEL)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                form = canonical(text)
                yield {"doc_id": doc_id, "digest": digest(form), "form": squeeze.compress(form)}

    forms = docs.select("doc_id", "text").mapInArrow(lambda b: packed(rows(b), schema), kind)
    return forms.groupBy("digest", "form").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def collisions(groups: DataFrame) -> DataFrame:
    """Digests that stand for several canonical texts (by all odds none)."""
    return groups.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")


def in_order(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` in partitions by ranges of doc_id, sorted by it and the text, nulls
    first. Texts are compressed while they are shuffled."""
    spark = docs.sparkSession
    squeezed, plain = "doc_id long, text binary", "doc_id long, text string"
    small, whole = arrow_schema(spark, squeezed), arrow_schema(spark, plain)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        compressor = zstandard.ZstdCompressor(LEVEL)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield {"doc_id": doc_id, "text": compressor.compress(text.encode())}

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield {"doc_id": doc_id, "text": zstandard.decompress(text).decode()}

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sent = texts.mapInArrow(lambda b: packed(squeeze(b), small), squeezed).repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first())
    return sent.mapInArrow(lambda b: packed(restore(b), whole), plain).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_INNER = RESULT + ", form_sha string, edited_form_sha string, edge int, text string"


def _judge(doc_id: int, text: str, following: str, digest: Digest) -> dict:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    forms = [canonical(x) for x in (text, edited, following)]
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fingerprint": digest(forms[0]),
        "edited_fingerprint": digest(forms[1]),
        "near_edited": float(forms[0] == forms[1]),
        "near_next": float(forms[0] == forms[2]),
        "form_sha": hashlib.sha256(forms[0]).hexdigest(),
        "edited_form_sha": hashlib.sha256(forms[1]).hexdigest(),
    }


def fingerprint_edits(docs: DataFrame, digest: Digest = digest) -> DataFrame:
    """Fingerprints of every document, of its text with the last half replaced by the start
    of the next document's, and their likenesses (columns of ``RESULT``).

    An exact digest is equal or not: likeness is 1 where the canonical texts are equal,
    else 0. Documents are in order of doc_id, then of the text; null ids come first; after
    the last comes the first, and a single document follows itself. Null text is empty.
    Repeated rows stand next to each other and give a row each; an empty table gives an
    empty result; other columns are ignored.

    Texts are shuffled by ranges of doc_id, and their canonical forms by digests, both
    compressed; long texts go whole. The last document of a range meets the
    first one of the next range in a join by the ranges' numbers (two rows a partition).
    Where different canonical texts have one digest, all fingerprints of that digest are
    lengthened by the text's SHA-256.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    schema = arrow_schema(spark, _INNER)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: tuple[int, str] | None = None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                if held is None:
                    yield {"doc_id": doc_id, "edge": 1, "text": text}
                else:
                    yield _judge(*held, text, digest) | {"edge": 0}
                held = doc_id, text
        if held is not None:
            yield {"doc_id": held[0], "edge": 2, "text": held[1]}

    part = in_order(docs).mapInArrow(lambda b: packed(rows(b), schema), _INNER)
    stored = materialise(part.withColumn("part", F.spark_partition_id()))
    # Ids are not split between ranges, so partition numbers order the edges.
    ranges = Window.orderBy("part")
    numbers = stored.where("edge = 1").select("part").withColumn("next", F.coalesce(F.lead("part").over(ranges), F.min("part").over(Window.partitionBy())))
    lasts = stored.where("edge = 2").select("part", "doc_id", "text")
    firsts = stored.where("edge = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    met = lasts.join(numbers, "part").join(firsts, "next").select("doc_id", "text", "following")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _judge(row["doc_id"], row["text"], row["following"], digest) | {"edge": 0}

    columns = [*arrow_schema(spark, RESULT).names, "form_sha", "edited_form_sha"]
    joins = met.mapInArrow(lambda b: packed(judged(b), schema), _INNER)
    found = stored.where("edge = 0").select(columns).unionByName(joins.select(columns))

    clash = collisions(exact_groups(docs, digest)).withColumn("clash", F.lit(True))
    digests = [r.digest for r in clash.limit(FEW_CLASHES + 1).collect()]
    if len(digests) > FEW_CLASHES:  # no longer a proven bound
        for name, sha in (("fingerprint", "form_sha"), ("edited_fingerprint", "edited_form_sha")):
            found = found.join(clash.withColumnRenamed("digest", name), name, "left").withColumn(
                name, F.when(F.col("clash"), F.concat_ws("-", name, sha)).otherwise(F.col(name))
            ).drop("clash")
    elif digests:
        for name, sha in (("fingerprint", "form_sha"), ("edited_fingerprint", "edited_form_sha")):
            found = found.withColumn(name, F.when(F.col(name).isin(digests), F.concat_ws("-", name, sha)).otherwise(F.col(name)))
    return found.select(*arrow_schema(spark, RESULT).names)

"""Row-local operators over streams of documents. Sentences, parts and chunks need one
document at a time, so they run unchanged on a streaming DataFrame and keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.chunks import build_chunks


def stream_chunks(docs: DataFrame, max_tokens: int = 384, overlap: int = 50) -> DataFrame:
    """Chunks of a stream of ``(doc_id, text)``."""
    return build_chunks(docs, max_tokens, overlap)


def write_chunks(chunks: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A Parquet sink for ``stream_chunks``; start it with the trigger that fits."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")

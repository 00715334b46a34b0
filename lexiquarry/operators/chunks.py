"""Documents to sentences and overlapping chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


def split_sentences(docs: DataFrame, splitter: X.Splitter = X.sentences) -> DataFrame:
    """``(doc_id, sent_pos, text)``: one row a sentence."""
    return docs.select("doc_id", F.posexplode(splitter(F.col("text"))).alias("sent_pos", "text"))


def split_long(docs: DataFrame, max_tokens: int = 384, splitter: X.Splitter = X.sentences, tokenize: X.Tokenizer = X.tokens) -> DataFrame:
    """``(doc_id, part_pos, number, text, n)``: sentences and parts of long ones."""
    parts = X.sentence_parts(splitter(F.col("text")), max_tokens, tokenize)
    return docs.select("doc_id", F.posexplode(parts).alias("part_pos", "p")).select("doc_id", "part_pos", "p.number", "p.text", "p.n")


def build_chunks(docs: DataFrame, max_tokens: int = 384, overlap: int = 50, splitter: X.Splitter = X.sentences, tokenize: X.Tokenizer = X.tokens) -> DataFrame:
    """``(doc_id, chunk_idx, text, token_count, start_sentence, end_sentence)``.

    Requires ``overlap`` under half of ``max_tokens``. One document is one row until its
    chunks are exploded, so nothing is shuffled.
    """
    if not 0 <= overlap < max_tokens / 2:
        raise ValueError("overlap must be at least 0 and less than half of max_tokens")
    parts = docs.select("doc_id", X.sentence_parts(splitter(F.col("text")), max_tokens, tokenize).alias("parts"))
    rows = parts.select("doc_id", "parts", F.col("parts.n").alias("counts"), F.col("parts.text").alias("texts"))

    def chunk(r, i):
        at, n = r["first"] + 1, r["last"] - r["first"] + 1
        return F.struct(
            i.alias("chunk_idx"),
            F.array_join(F.slice("texts", at, n), " ").alias("text"),
            F.aggregate(F.slice("counts", at, n), F.lit(0), lambda s, m: s + m).alias("token_count"),
            F.get("parts", r["first"])["number"].alias("start_sentence"),
            F.get("parts", r["last"])["number"].alias("end_sentence"),
        )

    # Chunks are made in their document's row: with its parts in each chunk's row, long documents would be copied for each chunk.
    return rows.select("doc_id", F.explode(F.transform(X.chunk_ranges(F.col("counts"), max_tokens, overlap), chunk)).alias("c")).select("doc_id", "c.*")


def legacy_chunks(counts: list[int], max_tokens: int, overlap: int) -> list[tuple[list[int], int]]:
    """Chunks over token counts by the older rule: positions and token count of each.

    A buffer of the last parts, trimmed from the left while it exceeds ``overlap`` and has
    more than one, starts the next chunk; after a chunk closes the buffer holds only the
    new part.
    """
    done: list[tuple[list[int], int]] = []
    current: list[int] = []
    buffer: list[int] = []
    size = held = 0
    for i, n in enumerate(counts):
        if size + n <= max_tokens:
            current, size = [*current, i], size + n
            buffer, held = [*buffer, i], held + n
            while held > overlap and len(buffer) > 1:
                held -= counts[buffer[0]]
                buffer = buffer[1:]
        else:
            if current:
                done.append((current, size))
            current, size = ([*buffer, i], held + n) if n <= max_tokens else (buffer, held)
            buffer, held = [i], n
    if current:
        done.append((current, size))
    return done


def build_legacy_chunks(docs: DataFrame, max_tokens: int = 384, overlap: int = 50, long: str = "split") -> DataFrame:
    """``(doc_id, chunk_idx, text, token_count)`` by the older rule. Sentences over the
    limit are halved once (``split``) or cut to ``max_tokens - 2`` (``truncate``)."""
    if overlap >= max_tokens // 2:
        raise ValueError("overlap must be less than half of max_tokens")
    if long not in ("split", "truncate"):
        raise ValueError("long must be 'split' or 'truncate'")
    sents = docs.select("doc_id", F.transform(X.sentences(F.col("text")), lambda s: F.struct(s.alias("text"), X.tokens(s).alias("t"))).alias("s"))

    def prepared(text: str, words: list[str]) -> list[tuple[str, int]]:
        if len(words) <= max_tokens:
            return [(text, len(words))]
        half = len(words) // 2
        pieces = [words[: max_tokens - 2]] if long == "truncate" else [words[:half], words[half:]]
        return [(" ".join(p), len(p)) for p in pieces]

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for doc_id, s in zip(batch["doc_id"], batch["s"]):
                parts = [p for x in s for p in prepared(x["text"], list(x["t"]))]
                for i, (own, n) in enumerate(legacy_chunks([n for _, n in parts], max_tokens, overlap)):
                    out.append((doc_id, i, " ".join(parts[k][0] for k in own), n))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_idx", "text", "token_count"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("chunk_idx int, text string, token_count int").fields])
    return sents.mapInPandas(run, schema)


def long_sentences(docs: DataFrame, limit: int = 512) -> DataFrame:
    """Sentences with more than ``limit`` tokens."""
    rows = split_sentences(docs).withColumn("n", F.size(X.tokens(F.col("text"))))
    return rows.where(F.col("n") > limit)


def token_summary(docs: DataFrame, splitter: X.Splitter = X.sentences, tokenize: X.Tokenizer = X.tokens) -> DataFrame:
    """One row of figures of sentences' token counts: ``(n, mean, std, least, q1, median, q3,
    greatest)``."""
    n = split_sentences(docs, splitter).select(F.size(tokenize(F.col("text"))).alias("n"))
    quarters = [F.percentile("n", q).alias(name) for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    return n.agg(
        F.count("n").alias("n"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_samp("n"), 6).alias("std"), F.min("n").alias("least"), *quarters, F.max("n").alias("greatest")
    )

"""Command line: the answer to a question about one text file.

``python -m lexiquarry.cli FILE --question Q [--mode attention --reference-answer R]``
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import qa as Q
from .sources.files import read_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiquarry")
    p.add_argument("file")
    p.add_argument("--question", required=True)
    p.add_argument("--mode", choices=("baseline", "attention"), default="baseline")
    p.add_argument("--reference-answer")
    p.add_argument("--language", choices=("en", "ru"), default="en")
    p.add_argument("--max-tokens", type=int, default=384)
    p.add_argument("--overlap", type=int, default=50)
    return p


def answer(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The result object of one file; attention needs a reference answer and English."""
    if args.mode == "attention" and not args.reference_answer:
        raise SystemExit("attention mode needs --reference-answer")
    if args.mode == "attention" and args.language == "ru":
        raise SystemExit("attention mode is not for Russian texts")
    config = Q.PipelineConfig(args.max_tokens, args.overlap, language=args.language)
    docs = read_text(spark, args.file).select(F.lit(0).cast("long").alias("doc_id"), "text")
    metadata: dict[str, object] = {"mode": args.mode}
    if args.mode == "attention":
        references = docs.select("doc_id", F.lit(args.reference_answer).alias("reference"))
        found = Q.attention(docs, references, args.question, config).first()
        used = found.chunks_used if found else 0
        metadata["reranked"] = bool(found and found.reranked)
    else:
        found, used = Q.baseline(docs, args.question, config).first(), Q.Models().chunks(docs, config).count()
    text, confidence = (found.text, found.confidence) if found else (None, None)
    return {"answer": text, "confidence": confidence, "chunks_used": used, "metadata": metadata}


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("lexiquarry").getOrCreate()
    print(json.dumps(answer(spark, args), ensure_ascii=False))


if __name__ == "__main__":
    main()

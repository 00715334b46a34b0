"""Question answering over chunks, span search, and the pipelines built on them.

Answerers, encoders and splitters are given as column functions (or pandas UDFs), so a
model can take the place of the built-in rules.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as X
from ..functions import vectors as V
from ..sources.staging import staged
from . import answers as A
from . import chunks as C
from . import keywords as K

Answerer = Callable[[Column, Column], Column]
#: Fixed value: the answer of rows without one.
NOT_FOUND = "Ответ не найден"


def rule_answerer(question: Column, context: Column) -> Column:
    """Struct (answer, score, start, end): a known phrase if the text has it, else what
    stands before its first dot."""
    phrase = "semantic segmentation"
    at = F.instr(context, phrase) - 1
    answer = F.when(at >= 0, phrase).otherwise(F.substring_index(context, ".", 1))
    start = F.when(at >= 0, at).otherwise(0)
    return F.struct(answer.alias("answer"), F.lit(0.9).alias("score"), start.cast("int").alias("start"), (start + F.length(answer)).cast("int").alias("end"))


def find_answers(chunks: DataFrame, question: Column, answerer: Answerer = rule_answerer) -> DataFrame:
    """One answer a chunk, ``(doc_id, answer_idx, chunk_idx, text, confidence, start_pos,
    end_pos)``, in order of confidence, then of chunks."""
    found = chunks.withColumn("_a", answerer(question, F.col("text")))
    w = Window.partitionBy("doc_id").orderBy(F.col("_a.score").desc(), "chunk_idx")
    return found.select(
        "doc_id",
        (F.row_number().over(w) - 1).alias("answer_idx"),
        "chunk_idx",
        F.col("_a.answer").alias("text"),
        F.col("_a.score").alias("confidence"),
        F.col("_a.start").alias("start_pos"),
        F.col("_a.end").alias("end_pos"),
    )


def find_answers_to(chunks: DataFrame, questions: DataFrame, answerer: Answerer = rule_answerer) -> DataFrame:
    """``find_answers`` for several questions to each document, ``(doc_id, question_no,
    question)``, with ``question_no``; answers are in order for each question.

    A document's questions are one row that its chunks meet; a chunk is given to the answerer
    once for each question where it is, and only answers are shuffled.
    """
    asked = questions.groupBy("doc_id").agg(F.collect_list(F.struct("question_no", "question")).alias("_q"))
    rows = chunks.join(asked, "doc_id").select("doc_id", "chunk_idx", "text", F.explode("_q").alias("_q"))
    found = rows.select("doc_id", "_q.question_no", "chunk_idx", answerer(F.col("_q.question"), F.col("text")).alias("_a"))
    w = Window.partitionBy("doc_id", "question_no").orderBy(F.col("_a.score").desc(), "chunk_idx")
    return found.select(
        "doc_id",
        "question_no",
        (F.row_number().over(w) - 1).alias("answer_idx"),
        "chunk_idx",
        F.col("_a.answer").alias("text"),
        F.col("_a.score").alias("confidence"),
        F.col("_a.start").alias("start_pos"),
        F.col("_a.end").alias("end_pos"),
    )


def find_scored_answers(scored: DataFrame, question: Column, answerer: Answerer = rule_answerer, by_combined: bool = False) -> DataFrame:
    """Answers of scored chunks with ``chunk_score`` and ``combined_score``, in order of
    either, then of chunks."""
    found = scored.withColumn("_a", answerer(question, F.col("text"))).withColumn("combined_score", F.round(F.col("_a.score") * F.col("score"), 6))
    key = F.col("combined_score") if by_combined else F.col("score")
    w = Window.partitionBy("doc_id").orderBy(key.desc(), "chunk_idx")
    return found.select(
        "doc_id",
        (F.row_number().over(w) - 1).alias("answer_idx"),
        "chunk_idx",
        F.col("_a.answer").alias("text"),
        F.col("_a.score").alias("confidence"),
        F.col("score").alias("chunk_score"),
        "combined_score",
        *(c for c in ("matched", "keyword_scores") if c in found.columns),
    )


def span_search(logits: DataFrame, key: str = "doc_id", most: int = 64) -> DataFrame:
    """``(key, start, end, probability)`` of the best answer span of ``(key, s, e)``, arrays
    of start and end logits: greatest sum with start <= end < start + ``most``, the first
    among equals; the probability is over all positions.

    With a column ``segments`` (the segment of each position, null for special tokens) a
    span starts and ends in segment 1 (the context). With ``offsets`` (array of (from, to),
    characters of each position) and ``context`` besides, ``start`` and ``end`` are
    characters and ``answer`` the text between; rows without a position of the context have
    an empty answer with probability 0.
    """
    n = F.size("s")
    inside = lambda x, i: F.when(F.get("segments", i) == 1, x) if "segments" in logits.columns else x
    # The best end of each start is the greatest of the next ends; nulls count for nothing.
    ends = logits.where(n > 0).withColumn("_e", F.transform("e", inside))
    sums = F.transform(F.transform("s", inside), lambda x, i: x + F.array_max(F.slice("_e", i + 1, F.lit(most))))
    best = ends.withColumn("_s", sums).withColumn("_from", F.array_position("_s", F.array_max("_s")).cast("int") - 1)
    window = F.slice("_e", F.col("_from") + 1, F.lit(most))
    best = best.withColumn("_to", F.col("_from") + F.array_position(window, F.array_max(window)).cast("int") - 1)

    def share(c: str, at: str) -> Column:
        top = F.array_max(c)
        return V.bound(top, lambda t: F.exp(F.get(c, F.col(at)) - t) / F.aggregate(c, F.lit(0.0), lambda total, x: total + F.exp(x - t)))

    probability = F.coalesce(F.round(share("s", "_from") * share("e", "_to"), 9), F.lit(0.0)).alias("probability")
    if "offsets" not in logits.columns:
        return best.where("_from >= 0").select(key, F.col("_from").alias("start"), F.col("_to").alias("end"), probability)
    start, end = F.coalesce(F.get("offsets", F.col("_from"))["from"], F.lit(0)), F.coalesce(F.get("offsets", F.col("_to"))["to"], F.lit(0))
    return best.select(key, start.alias("start"), end.alias("end"), probability, F.substring("context", start + 1, end - start).alias("answer"))


def stride_windows(docs: DataFrame, tokens: Column, size: int = 512, stride: int = 128) -> DataFrame:
    """``(doc_id, window, first, tokens)``: windows of ``size`` tokens, each with the last
    ``stride`` of the one before; the last one ends with the text. Blank texts have none."""
    if not 0 <= stride < size:
        raise ValueError("stride must be at least 0 and less than size")
    step = size - stride
    cut = docs.select("doc_id", tokens.alias("t")).where(F.size("t") > 0)
    windows = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("t") - size) / step)).cast("int"))
    return cut.select("doc_id", F.explode(windows).alias("window"), "t").select("doc_id", "window", (F.col("window") * step).alias("first"), F.slice("t", F.col("window") * step + 1, F.lit(size)).alias("tokens"))


def long_context_answer(docs: DataFrame, question: str, tokens: Column, answerer: Answerer = rule_answerer, size: int = 512, stride: int = 128) -> DataFrame:
    """``(doc_id, answer)``: the answer of greatest score over the windows of a document,
    checked; blank texts have the marker."""
    windows = stride_windows(docs, tokens, size, stride).withColumn("_a", answerer(F.lit(question), F.array_join("tokens", " ")))
    best = A.first_by(windows, ["doc_id"], F.col("_a.score"), F.col("window")).select("doc_id", checked_answer(F.trim("_a.answer"), F.col("_a.score")).alias("answer"))
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("answer", F.lit(NOT_FOUND)).alias("answer"))


def checked_answer(answer: Column, score: Column, most: int = 150, least: float = 0.001) -> Column:
    """The answer cut to ``most`` characters if it scores and has two or more, else a marker."""
    return F.when((score > least) & (F.length(answer) >= 2), F.substring(answer, 1, most)).otherwise(NOT_FOUND)


def context_tail(tokens: Column, most: int) -> Column:
    """The last ``most`` tokens."""
    return F.when(F.size(tokens) > most, F.slice(tokens, -most, most)).otherwise(tokens)


def answer_status(answer: Column) -> Column:
    """``missing``, ``error``, ``not_found`` or ``success`` of an answer column."""
    return (
        F.when(answer.isNull() | (F.trim(answer) == ""), "missing")
        .when(answer.startswith("ERROR") | answer.startswith("[ERROR]"), "error")
        .when(answer == NOT_FOUND, "not_found")
        .otherwise("success")
    )


def strategy_diagnostics(answers: DataFrame) -> DataFrame:
    """Answers and distinct non-blank answers of a document; strategies apply to several."""
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    out = answers.groupBy("doc_id").agg(F.count(F.lit(1)).alias("answer_candidate_count"), F.countDistinct(F.nullif(text, F.lit(""))).alias("distinct_answer_count"))
    return out.withColumn("strategy_applicable", F.col("distinct_answer_count") > 1)


#: What a limit or threshold may be: least and greatest value.
BOUNDS = {
    "chunk_max_tokens": (4, float("inf")),
    "answer_cluster_threshold": (0, 1),
    "strict_answer_threshold": (0, 1),
    "min_answer_threshold": (0, 1),
}
SPLITTERS = {"en": X.sentences, "ru": X.russian_sentences}


@dataclass(frozen=True)
class PipelineConfig:
    """Limits and thresholds, checked when made."""

    chunk_max_tokens: int = 384
    overlap_tokens: int = 50
    answer_cluster_threshold: float = 0.5
    strict_answer_threshold: float = 0.9
    min_answer_threshold: float = 0.7
    keyword_idf_threshold: float = 1.5
    language: str = "en"

    def __post_init__(self) -> None:
        wrong = [f"{k}={getattr(self, k)} is not in {low}..{high}" for k, (low, high) in BOUNDS.items() if not low <= getattr(self, k) <= high]
        if self.language not in SPLITTERS:
            wrong.append(f"language={self.language!r} is not one of {sorted(SPLITTERS)}")
        if not 0 <= 2 * self.overlap_tokens < self.chunk_max_tokens:
            wrong.append(f"overlap_tokens={self.overlap_tokens} is not under half of chunk_max_tokens={self.chunk_max_tokens}")
        if self.strict_answer_threshold < self.min_answer_threshold:
            wrong.append("strict_answer_threshold is under min_answer_threshold")
        if wrong:
            raise ValueError("; ".join(wrong))


def _letters(context: Column) -> Column:
    """Lower-cased words of letters, digits and underscores, with white space between them."""
    return F.lower(F.regexp_replace(context, r"[^\p{L}\p{N}_\s]+", " "))


def word_shares(question: Column, context: Column) -> Column:
    """The built-in source of attention: each word of two or more characters with its share
    of the context's words, in order of the text."""
    found = K.words(_letters(context))
    weigh = lambda ws: F.transform(
        F.filter(F.array_distinct(ws), lambda w: F.length(w) > 1),
        lambda w: F.struct(w.alias("word"), F.round(F.size(F.filter(ws, lambda x: x == w)) / F.size(ws), 9).alias("weight")),
    )
    return V.bound(found, weigh)


def _best_shares(chunks: DataFrame, limit: int) -> DataFrame:
    """``attention_keywords`` by ``word_shares``: a document's words are counted in its row, in
    Arrow batches, so its chunks are shuffled at most once and words never."""
    docs = chunks.select("doc_id", F.struct("chunk_idx", _letters(F.col("text")).alias("text")).alias("c")).groupBy("doc_id").agg(F.collect_list("c").alias("c"))
    shape = docs.select("doc_id", F.lit(0).cast("long").alias("kw_idx"), F.lit("").alias("word"), F.lit(0.0).alias("weight")).schema

    def best(chunk_idx: list[int], texts: list[str | None]) -> dict[str, tuple[int, int]]:
        kept: dict[str, tuple[int, int]] = {}
        ranked: dict[int, list[tuple[int, str]]] = {}
        for idx, text in zip(chunk_idx, texts):
            ws = (text or "").split()
            # Shares to nine places, half of the last one up, as whole numbers.
            own = [((2 * 10**9 * n + len(ws)) // (2 * len(ws)), w) for w, n in Counter(ws).items() if len(w) > 1]
            ranked.setdefault(idx, []).extend(own)
        for idx in sorted(ranked):
            # The order is stable, so of equal shares the first in the text stands.
            for place, (share, w) in enumerate(sorted(ranked[idx], key=lambda x: -x[0])[:limit], 1):
                if w not in kept or share > kept[w][0]:
                    kept[w] = share, idx * limit + place
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch["c"]
            flat, at = c.flatten(), c.offsets.to_numpy() - c.offsets[0].as_py()
            idx, texts = flat.field("chunk_idx").to_pylist(), flat.field("text")
            for first in range(0, batch.num_rows, 256):
                rows, shares, places, words = [], [], [], []
                for i in range(first, min(first + 256, batch.num_rows)):
                    kept = best(idx[at[i] : at[i + 1]], texts[at[i] : at[i + 1]].to_pylist())
                    rows += [i] * len(kept)
                    words += kept
                    shares += [share for share, _ in kept.values()]
                    places += [place for _, place in kept.values()]
                arrays = [batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(places, pa.int64()), pa.array(words, pa.string()), pa.array(np.array(shares, float) / 1e9)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "kw_idx", "word", "weight"])

    return docs.mapInArrow(run, shape)


@dataclass(frozen=True)
class Models:
    """What models can take the place of: column functions or pandas UDFs (see
    ``functions.models``). ``splitter`` None is the configured language's."""

    answerer: Answerer = rule_answerer
    encode: V.Encoder = V.encode_text
    tokenize: X.Tokenizer = X.tokens
    splitter: X.Splitter | None = None
    lemma: Callable[[Column], Column] = F.lower
    stem: Callable[[Column], Column] = F.lower
    attention: Callable[[Column, Column], Column] = word_shares

    def chunks(self, docs: DataFrame, config: PipelineConfig) -> DataFrame:
        splitter = self.splitter or SPLITTERS[config.language]
        return C.build_chunks(docs, config.chunk_max_tokens, config.overlap_tokens, splitter, self.tokenize)

    def unit(self, text: Column) -> Column:
        return V.unit(self.encode(text))


def with_vectors(found: DataFrame, encode: V.Encoder = V.encode_text) -> DataFrame:
    """Answers in the form of the aggregation operators, with unit vectors of their texts."""
    chunk_score = F.col("chunk_score") if "chunk_score" in found.columns else F.lit(0.0)
    return found.select(
        F.col("doc_id").alias("doc"), F.col("answer_idx").alias("idx"), "text", "confidence", chunk_score.alias("chunk_score"), V.unit(encode(F.col("text"))).alias("u"), "chunk_idx"
    )


def baseline(docs: DataFrame, question: str, config: PipelineConfig = PipelineConfig(), models: Models = Models()) -> DataFrame:
    """``(doc_id, idx, text, confidence, support)``: chunks in the configured language, an
    answer of each, the medoid."""
    found = A.medoid(with_vectors(find_answers(models.chunks(docs, config), F.lit(question), models.answerer), models.encode))
    return found.withColumnRenamed("doc", "doc_id")


def baseline_questions(docs: DataFrame, questions: DataFrame, config: PipelineConfig = PipelineConfig(), models: Models = Models(), keywords: DataFrame | None = None) -> DataFrame:
    """``(doc_id, idx, question_no, text, confidence, support, n_answers, chunks_used)``: the
    medoid of the answers to all questions ``(doc_id, question_no, question)`` of a document,
    numbered by question and then in order of confidence.

    With ``keywords`` (as in ``matched_chunks``) only chunks with one of them are asked.
    Documents without such a chunk, or without a question, have one row without an answer.
    """
    chunks = models.chunks(docs, config)
    if keywords is not None:
        chunks = K.filter_chunks(K.matched_chunks(chunks, keywords)).select("doc_id", "chunk_idx", "text")
    chunks = staged(chunks.select("doc_id", "chunk_idx", "text"))
    found = find_answers_to(chunks, questions, models.answerer)
    order = Window.partitionBy("doc_id").orderBy("question_no", "answer_idx")
    found = staged(found.withColumn("answer_idx", F.row_number().over(order) - 1))
    best = A.medoid(with_vectors(found, models.encode)).select(F.col("doc").alias("doc_id"), "idx", "text", "confidence", "support")
    best = best.join(found.select("doc_id", F.col("answer_idx").alias("idx"), "question_no"), ["doc_id", "idx"])
    counts = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_answers"))
    used = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks_used"))
    rows = docs.select("doc_id").join(best, "doc_id", "left").join(counts, "doc_id", "left").join(used, "doc_id", "left")
    return rows.select("doc_id", "idx", "question_no", "text", "confidence", "support", "n_answers", F.coalesce("chunks_used", F.lit(0)).alias("chunks_used"))


def attention_keywords(chunks: DataFrame, question: str, models: Models = Models(), limit: int = 100) -> DataFrame:
    """``(doc_id, kw_idx, word, weight)``: the words of each chunk that the source of
    attention ranks first, up to ``limit``; of each word of a document the greatest weight,
    the first among equals."""
    if models.attention is word_shares:
        return _best_shares(chunks, limit)
    asked = chunks.select("doc_id", "chunk_idx", F.posexplode(models.attention(F.lit(question), F.col("text"))).alias("pos", "k"))
    w = Window.partitionBy("doc_id", "chunk_idx").orderBy(F.col("k.weight").desc(), "pos")
    ranked = asked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    # One number orders the words of all chunks: chunk by chunk, then by rank.
    rows = ranked.select("doc_id", (F.col("chunk_idx").cast("long") * limit + F.col("place")).alias("kw_idx"), F.lower("k.word").alias("word"), F.col("k.weight").alias("weight"))
    return K.deduplicate(rows, ["doc_id"])


def attention(
    docs: DataFrame, references: DataFrame, question: str, config: PipelineConfig = PipelineConfig(), models: Models = Models(), keywords: DataFrame | None = None, aspect: str | None = None
) -> DataFrame:
    """``(doc_id, text, confidence, reranked, chunks_used)``: the baseline's answer or, where
    an answer of its is near the reference, the consensus of answers from chunks scored by
    the keywords of those answers' chunks.

    ``references (doc_id, reference)`` hold a known answer. Keywords come from
    ``models.attention``, or are given as ``(doc_id, kw_idx, word, weight)``; those nearer
    to the aspect (or the question) than to the reference count. ``chunks_used`` counts the
    chunks that the answer was chosen from. The chunk table is written once.
    """
    chunks = staged(models.chunks(docs, config))
    first = staged(with_vectors(find_answers(chunks, F.lit(question), models.answerer), models.encode))
    used = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    base = A.medoid(first).select(F.col("doc").alias("doc_id"), F.col("text").alias("base_text"), F.col("confidence").alias("base_confidence")).join(used, "doc_id")
    # The aspect's vector is made once a reference, and not once a keyword.
    vectors = staged(references.select("doc_id", models.unit(F.col("reference")).alias("r"), models.unit(F.lit(aspect or question)).alias("p")))
    valid = A.validate(first, vectors.select(F.col("doc_id").alias("doc"), "r"), config.strict_answer_threshold, config.min_answer_threshold)
    valid = staged(valid.select(F.col("doc").alias("doc_id"), "chunk_idx"))
    if keywords is None:
        found = attention_keywords(chunks.join(valid, ["doc_id", "chunk_idx"], "left_semi"), question, models)
    else:
        found = K.deduplicate(keywords.join(valid.select("doc_id").distinct(), "doc_id", "left_semi"), ["doc_id"])
    aimed = K.contrast(found.join(vectors, "doc_id"), F.col("p"), F.col("r"), models.encode)
    wanted = staged(K.add_lemma_and_stem(aimed, models.lemma, models.stem).select("doc_id", "kw_idx", "word", "weight", "lemma", "stem", "score_diff"))
    scored = K.score_chunks(K.matched_chunks(chunks, wanted))
    again = staged(with_vectors(find_scored_answers(scored, F.lit(question), models.answerer), models.encode))
    final = A.consensus(again).join(again.select("doc", "idx", "confidence"), ["doc", "idx"]).select(F.col("doc").alias("doc_id"), F.col("text").alias("final_text"), "confidence")
    final = final.join(again.groupBy(F.col("doc").alias("doc_id")).agg(F.count(F.lit(1)).alias("m")), "doc_id")
    return base.join(final, "doc_id", "left").select(
        "doc_id",
        F.coalesce("final_text", "base_text").alias("text"),
        F.coalesce("confidence", "base_confidence").alias("confidence"),
        F.col("final_text").isNotNull().alias("reranked"),
        F.coalesce("m", "n").alias("chunks_used"),
    )


#: The strategies and answer of documents that can't be re-ranked, and a missing answer.
NO_VALID = "--No valid answers--"
NONE = "--None--"


def experiment(
    docs: DataFrame,
    keywords: DataFrame,
    references: DataFrame,
    question: str,
    modes: dict[str, float],
    cluster_strategies: list[str],
    answer_strategies: list[str],
    config: PipelineConfig = PipelineConfig(),
    models: Models = Models(),
    aspect: str | None = None,
) -> DataFrame:
    """A row for every document, scoring mode, cluster and answer strategy with the final
    answer and its metrics against the reference, besides the baseline's (``first_answer``,
    ``base_cosine_sim``, ``base_lev_dist``). Chunks are answered once for all modes.

    ``keywords (doc_id, kw_idx, word, weight)`` come from attention and are the batch of each
    chunk of their document with a valid answer: they count if the chunk's words after the
    dynamic idf filter have them, and if they are nearer to ``aspect`` (or the question) than
    to the reference. Documents without a valid answer, a keyword or a reference have one row
    of fillers; where no chunk has a keyword, the final answers are ``NONE``.

    ``modes`` maps names to the share of the attention weight in a keyword's score.
    """
    chunks = staged(models.chunks(docs, config))
    known = staged(references.select("doc_id", "reference", models.unit(F.col("reference")).alias("r")))
    references, vectors = known.select("doc_id", "reference"), known.select("doc_id", "r")
    first = staged(with_vectors(find_answers(chunks, F.lit(question), models.answerer), models.encode))
    base = A.medoid(first).select(F.col("doc").alias("doc_id"), F.nullif(F.col("text"), F.lit("")).alias("first"))
    base = docs.select("doc_id").distinct().join(base, "doc_id", "left").join(references, "doc_id", "left")
    base = staged(base.withColumn("b", F.when(F.col("first").isNotNull() & F.col("reference").isNotNull(), M.text_metrics(F.col("reference"), F.col("first"), models.encode))))

    valid = A.validate(first, vectors.withColumnRenamed("doc_id", "doc"), config.strict_answer_threshold, config.min_answer_threshold)
    valid = chunks.join(valid.select(F.col("doc").alias("doc_id"), "chunk_idx"), ["doc_id", "chunk_idx"], "left_semi")
    valid = staged(valid.select("doc_id", F.col("chunk_idx").alias("text_id"), "text"))
    batches = keywords.select("doc_id", "kw_idx", "word", "weight").join(valid.select("doc_id", F.col("text_id").alias("batch")), "doc_id")
    filtered = K.dynamic_idf_filter(valid, config.keyword_idf_threshold).select("doc_id", F.col("text_id").alias("batch"), F.col("kept").alias("text"))
    merged = K.merge_batches(batches, filtered, K.RUSSIAN_STOP_WORDS if config.language == "ru" else K.STOP_WORDS).join(vectors, "doc_id")
    wanted = K.contrast(merged, models.unit(F.lit(aspect or question)), F.col("r"), models.encode)
    wanted = staged(K.add_lemma_and_stem(wanted, models.lemma, models.stem).select("doc_id", "kw_idx", "word", "weight", "lemma", "stem", "score_diff"))

    answered = K.matched_chunks(chunks, wanted).withColumn("_a", models.answerer(F.lit(question), F.col("text")))
    mode = F.explode(F.array(*(F.struct(F.lit(k).alias("mode"), F.lit(float(r)).alias("ratio")) for k, r in modes.items())))
    scored = K.score_chunks(answered.withColumn("_m", mode).select("*", "_m.*"), F.col("ratio"))
    # A document in a mode is a group of its own; its number keeps the mode.
    names = list(modes)
    number = F.col("doc_id") * len(names) + F.array_position(F.array(*map(F.lit, names)), F.col("mode")) - 1
    rows = staged(scored.select(
        number.alias("doc"),
        F.col("chunk_idx").cast("long").alias("idx"),
        F.col("_a.answer").alias("text"),
        F.col("_a.score").alias("confidence"),
        F.col("score").alias("chunk_score"),
        models.unit(F.col("_a.answer")).alias("u"),
    ))
    chosen = A.select_clustered(rows, staged(A.greedy_clusters(rows, config.answer_cluster_threshold)), cluster_strategies, answer_strategies)
    chosen = chosen.select(
        F.floor(F.col("doc") / len(names)).alias("doc_id"),
        F.element_at(F.array(*map(F.lit, names)), (F.col("doc") % len(names) + 1).cast("int")).alias("mode"),
        "cluster_strategy",
        "answer_strategy",
        F.col("text").alias("chosen"),
    )
    chosen = staged(chosen)
    each = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    aimed = wanted.select("doc_id").distinct()
    grid = aimed.select("doc_id", each(names, "mode")).select("*", each(cluster_strategies, "cluster_strategy")).select("*", each(answer_strategies, "answer_strategy"))
    grid = grid.join(chosen, ["doc_id", "mode", "cluster_strategy", "answer_strategy"], "left").withColumn("known", F.lit(True))
    out = base.join(grid, "doc_id", "left")
    # Strategies choose few different answers, so each is compared with the reference once.
    compared = chosen.select("doc_id", "chosen").distinct().join(references.distinct(), "doc_id").withColumn("m", M.text_metrics(F.col("reference"), F.col("chosen"), models.encode))
    out = out.join(compared, ["doc_id", "chosen", "reference"], "left")
    filled = lambda c: F.when(F.col("known"), F.col(c)).otherwise(NO_VALID)
    return out.select(
        "doc_id",
        filled("mode").alias("score_chunk_strategy"),
        filled("cluster_strategy").alias("choose_cluster_strategy"),
        filled("answer_strategy").alias("choose_answer_strategy"),
        F.when(F.col("known"), F.coalesce("chosen", F.lit(NONE))).otherwise(NO_VALID).alias("final_answer"),
        F.round("m.cosine_sim", 6).alias("cosine_sim"),
        F.col("m.lev_dist").alias("lev_dist"),
        F.coalesce("first", F.lit(NONE)).alias("first_answer"),
        F.round("b.cosine_sim", 6).alias("base_cosine_sim"),
        F.col("b.lev_dist").alias("base_lev_dist"),
    )

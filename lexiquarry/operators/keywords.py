"""Keywords: candidates, inverse document frequencies, contrast, attention words, and the
scoring of chunks by keywords."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.staging import staged

# Words without a meaning of their own, left out of candidates and keywords.
STOP_WORDS = """
the a an and or but in on at to for of with by
is are was were be been being have has had do does did will would could should may might must can
i you he she it we they me him her us them this that these those my your his its our their
as from into upon about against between through during before after above below up down off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very
often early unlikely usually always never sometimes frequently rarely seldom generally normally typically occasionally constantly
continuously regularly daily weekly monthly yearly annually soon late later earlier recently currently presently immediately
quickly slowly suddenly gradually rapidly easily hardly barely scarcely clearly obviously evidently apparently possibly probably
likely certainly definitely absolutely completely totally entirely fully partially mostly mainly chiefly primarily
especially particularly specifically exactly precisely accurately
who whom whose which what
therefore however thus hence consequently accordingly furthermore moreover additionally besides also likewise similarly
conversely instead rather otherwise nevertheless nonetheless although though while whereas despite regardless notwithstanding
quite fairly pretty somewhat almost nearly just even still yet already else indeed surely maybe perhaps
one two three first second third last next previous many much less least several various
well back out now ever
""".split()
# The same for Russian texts.
RUSSIAN_STOP_WORDS = """
а без более бы был была были было быть в вам вас весь во вот все всего всех вы где да даже для до его ее если есть
еще же за здесь и из или им их к как ко когда который ли либо мне может мы на над надо наш не него нее нет ни них но
ну о об однако он она они оно от очень по под при про с сам себя со так также такой там те тем то того тоже той только
том тот у уже чем что чтобы эта эти это этого этой этот я
""".split()
# Tokens that are no words.
SPECIAL = ["<s>", "</s>", "<pad>", "[CLS]", "[SEP]", ".", "?", "!", ",", "/", "//", "]["]

#: Words of two or more letters, digits or underscores.
TERM = r"[\p{L}\p{N}_]{2,}"
WORD = r"[\p{L}\p{N}_]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased words parted by white space."""
    return F.filter(F.split(F.lower(text), r"\s+", -1), lambda w: w != "")


def ngrams(text: Column, n: int, stop_words: list[str] = STOP_WORDS) -> Column:
    """Distinct n-grams of the terms that are no stop words (formed after these are out)."""
    kept = F.filter(terms(text), lambda w: ~w.isin(*stop_words)) if stop_words else terms(text)
    return F.transform(
        F.array(kept),
        lambda k: F.when(
            F.size(k) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(k) - n + 1), lambda i: F.array_join(F.slice(k, i, F.lit(n)), " ")))
        ).otherwise(F.array().cast("array<string>")),
    )[0]


def kept_candidate(gram: Column, n: int) -> Column:
    """No digit anywhere; n-grams of three or four words may have one inside."""
    digit = gram.rlike(r"\p{Nd}")
    if n not in (3, 4):
        return ~digit
    ends = F.concat_ws(" ", F.substring_index(gram, " ", 1), F.substring_index(gram, " ", -1))
    return ~digit | ~ends.rlike(r"\p{Nd}")


def extract(
    docs: DataFrame, limit: int = 20, stop_words: list[str] = STOP_WORDS, n: int = 1, references: DataFrame | None = None, encode: V.Encoder = V.encode_text
) -> DataFrame:
    """``(doc_id, place, word, similarity)``: the n-grams nearest to their document's text or
    to that of ``references (doc_id, text)``. Of equal similarities the last in alphabetical
    order comes first.

    With the built-in encoder a single word's vector has one bucket, so its cosine is that
    bucket's share of the text's vector.
    """
    grams = docs.select("doc_id", F.explode(ngrams(F.col("text"), n, stop_words)).alias("word")).where(kept_candidate(F.col("word"), n))
    of = references if references is not None else docs
    if encode is V.encode_text:
        whole = V.encode_words(of.select("doc_id", F.explode(words(F.col("text"))).alias("word")), ["doc_id"])
    else:
        whole = of.select("doc_id", encode(F.col("text")).alias("vector"))
    if encode is V.encode_text and n == 1:
        similarity = F.round(F.col("vector")[V.bucket_of(F.col("word"))] / F.sqrt(V.dot(F.col("vector"), F.col("vector"))), 9)
    else:
        whole, similarity = whole.withColumn("vector", V.unit(F.col("vector"))), V.similarity(V.unit(encode(F.col("word"))), F.col("vector"))
    scored = grams.join(whole, "doc_id").select("doc_id", "word", similarity.alias("similarity"))
    w = Window.partitionBy("doc_id").orderBy(F.col("similarity").desc(), F.col("word").desc())
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def by_cosine(words: DataFrame, texts: DataFrame, encode: V.Encoder = V.encode_text) -> DataFrame:
    """``(doc_id, place, word, similarity)``: given words ``(doc_id, word)`` in order of their
    cosine to the document's text ``(doc_id, text)``, then of the alphabet; blank texts give
    no rows."""
    whole = texts.where(F.regexp_replace("text", r"(?U)\s+", "") != "").select("doc_id", V.unit(encode(F.col("text"))).alias("v"))
    scored = words.join(whole, "doc_id").select("doc_id", "word", V.similarity(V.unit(encode(F.col("word"))), F.col("v")).alias("similarity"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("similarity").desc(), "word")))


def idf(texts: DataFrame) -> DataFrame:
    """``(doc_id, word, df, idf)`` over the texts ``(doc_id, text_id, text)`` of a document:
    ln(n / df) + 1, unsmoothed."""
    texts = staged(texts)
    return _idf(texts)


def _idf(texts: DataFrame) -> DataFrame:
    seen = texts.select("doc_id", "text_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("word"))
    sizes = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return seen.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("df")).join(sizes, "doc_id").select(
        "doc_id", "word", "df", (F.log(F.col("n") / F.col("df")) + 1).alias("idf")
    )


def _weighed(texts: DataFrame) -> DataFrame:
    """Words of texts with their place and idf; words with attached marks have none."""
    placed = texts.select("doc_id", "text_id", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return placed.join(_idf(texts).select("doc_id", "word", "idf"), ["doc_id", "word"])


def _documents(texts: DataFrame) -> DataFrame:
    """``(doc_id, n, ts)``: a document's texts ``(text_id, text)`` in one row, so its words are
    counted in place and only texts are shuffled. Without texts of no document."""
    rows = texts.where("doc_id is not null").groupBy("doc_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("text_id", F.coalesce("text", F.lit("")).alias("text"))).alias("ts"))


def _is_term(word: Column) -> Column:
    """A word parted by white space that is a term as a whole."""
    return word.rlike(rf"\A{TERM}\z")


def _all_terms(texts: Column) -> Column:
    """The terms of several texts, each once a text, sorted."""
    return F.sort_array(F.flatten(F.transform(texts, lambda x: F.array_distinct(terms(x["text"])))))


def idf_filter(texts: DataFrame, threshold: float = 1.5) -> DataFrame:
    """``(doc_id, text_id, kept)``: the words with an idf of at least ``threshold``.

    A word goes with ``m`` texts or more, ``m`` being the least number whose idf is under the
    threshold: in the sorted terms its neighbour ``m - 1`` places on is equal. Such words are
    few, as each takes ``m`` of the document's terms."""
    enough = F.size(F.filter(F.sequence(F.lit(1), F.col("n").cast("int")), lambda d: F.round(F.log(F.col("n") / d) + 1, 9) >= threshold))
    docs = V.evaluated(_documents(texts).withColumn("_m", enough), "_s", _all_terms(F.col("ts")))
    docs = V.evaluated(docs, "_out", F.array_distinct(F.filter("_s", lambda w, i: F.get("_s", i + F.col("_m")) == w))).drop("_s", "_m")
    kept = F.array_join(F.filter(words(F.col("t.text")), lambda w: _is_term(w) & ~F.array_contains("_out", w)), " ")
    rows = docs.select("doc_id", "_out", F.explode("ts").alias("t")).select("doc_id", "t.text_id", kept.alias("kept"))
    return rows.unionAll(texts.where("doc_id is null").select("doc_id", "text_id", F.lit("").alias("kept")))


def thresholds(initial: float = 1.5, least: float = 0.5, step: float = 0.2) -> list[float]:
    """The falling thresholds, with steps that shrink by a fifth down to 0.05."""
    out = []
    while initial >= least:
        out.append(initial)
        initial -= step
        step = max(step * 0.8, 0.05)
    return out


def dynamic_idf(texts: DataFrame, each: int = 3, enough: float = 0.8, initial: float = 1.5) -> DataFrame:
    """``(doc_id, threshold, coverage)``: the first threshold whose share of texts with at
    least ``each`` kept words is greatest, going no further than the first share of
    ``enough``. The thresholds do not depend on the data, so all are tried in one pass.

    A text has enough words at every threshold up to its ``each``-th greatest idf, so it gives
    one number. Words are counted in their document's row, in Arrow batches; texts of no
    document have none."""
    # Other marks become one that no word has; a line is a text.
    lines = F.transform("ts", lambda x: F.translate(F.coalesce(x["text"], F.lit("")), "\n", " "))
    marked = F.regexp_replace(F.lower(F.array_join(lines, "\n")), r"[^\p{L}\p{N}_\s]", ".")
    docs = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("text_id", F.when(F.col("doc_id").isNotNull(), F.col("text")).alias("text"))).alias("ts"))

    def reached(ids: np.ndarray, text: str) -> list[int]:
        listed = text.split("\n")
        df = Counter(chain.from_iterable(set(t.replace(".", " ").split()) for t in listed))
        placed = list(map(str.split, listed))
        unknown = pd.isna(ids)
        if unknown.any() or len(set(ids)) < len(ids):  # rows of one text count together, those of none not at all
            whole: dict = {}
            for i, ws in zip(ids, placed):
                whole[i] = whole.get(i, []) + ws
            placed = [whole[i] for i in ids[~unknown]]
        rare = (sorted([df[w] for w in ws if len(w) > 1 and w in df]) for ws in placed)
        return [own[each - 1] for own in rare if len(own) >= each]

    def reach(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, marked in batches:
            yield pd.Series(list(map(reached, ids, marked)))

    docs = docs.select("doc_id", "n", F.pandas_udf(reach, "array<long>")(F.col("ts.text_id"), marked).alias("dfs"))
    docs = V.evaluated(docs, "reach", F.transform("dfs", lambda df: F.round(F.log(F.col("n") / df) + 1, 9)))
    shares = [F.size(F.filter("reach", lambda x: x >= round(t, 9))) / F.col("n") for t in thresholds(initial)]
    tried = [F.struct(F.least(c, F.lit(enough)).alias("score"), F.lit(-i).alias("order"), F.lit(t).alias("threshold"), c.alias("coverage")) for i, (t, c) in enumerate(zip(thresholds(initial), shares))]
    best = V.evaluated(docs, "b", F.array_max(F.array(*tried)))
    return best.select("doc_id", F.round("b.threshold", 6).alias("threshold"), F.round("b.coverage", 6).alias("coverage"))


def dynamic_idf_filter(texts: DataFrame, initial: float = 1.5) -> DataFrame:
    """``(doc_id, text_id, kept)``: the words that reach their document's dynamic threshold.
    Texts of a document without any term stay whole, in lower case."""
    texts = staged(texts)
    weighed = staged(_weighed(texts))
    kept = weighed.join(dynamic_idf(texts, initial=initial).select("doc_id", "threshold"), "doc_id").where(F.round("idf", 9) >= F.col("threshold"))
    kept = kept.groupBy("doc_id", "text_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("kept"))
    has_terms = F.max(F.size(terms(F.col("text"))) > 0).over(Window.partitionBy("doc_id"))
    rows = texts.select("doc_id", "text_id", "text", has_terms.alias("_t")).join(kept, ["doc_id", "text_id"], "left")
    return rows.select("doc_id", "text_id", F.when(F.col("_t"), F.coalesce("kept", F.lit(""))).otherwise(F.array_join(words(F.col("text")), " ")).alias("kept"))


def characteristic(texts: DataFrame, share: float = 0.8, least_df: int = 2, weight: float = 0.1, lemma=lambda term: term) -> DataFrame:
    """``(doc_id, text_id, word, tfidf)``: terms and pairs of terms in at least ``least_df``
    and at most ``share`` of a document's texts whose normalised weight in a text reaches
    ``weight``. ``lemma`` is a column function of a term. A document is one row until the
    words that count are known, so only texts are shuffled."""

    def grams(text: Column) -> Column:
        t = F.transform(terms(text), lemma)
        couples = lambda t: F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.concat_ws(" ", a, b))
        return V.bound(t, lambda t: F.when(F.size(t) > 1, F.concat(t, couples(t))).otherwise(t))

    placed = F.flatten(F.transform("ts", lambda x: F.transform(grams(x["text"]), lambda g: F.struct(g.alias("word"), x["text_id"].alias("text_id")))))
    docs = V.evaluated(_documents(texts), "_s", F.sort_array(placed)).drop("ts")
    tf = F.transform(V.runs(F.col("_s")), lambda r: V.bound(F.get("_s", r["at"] - 1), lambda x: F.struct(x["word"].alias("word"), x["text_id"].alias("text_id"), r["n"].alias("tf"))))
    docs = V.evaluated(docs, "_tf", tf).drop("_s")
    # Texts with a word are neighbours; then words of a text.
    fit = F.filter(V.runs(F.col("_tf"), lambda x: x["word"]), lambda r: (r["n"] >= least_df) & (r["n"] <= share * F.col("n")))
    weighed = lambda r: F.transform(
        F.slice("_tf", r["at"], r["n"]), lambda x: F.struct(x["text_id"].alias("text_id"), x["word"].alias("word"), (x["tf"] * (F.log((1 + F.col("n")) / (1 + r["n"])) + 1)).alias("x"))
    )
    docs = V.evaluated(docs, "_w", F.sort_array(F.flatten(F.transform(fit, weighed)))).drop("_tf")

    def normalised_text(r: Column) -> Column:
        own = F.slice("_w", r["at"], r["n"])
        norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, y: s + y["x"] * y["x"]))
        heavy = lambda norm: F.filter(F.transform(own, lambda y: F.struct(y["text_id"].alias("text_id"), y["word"].alias("word"), F.round(y["x"] / norm, 6).alias("tfidf"))), lambda y: y["tfidf"] >= weight)
        return V.bound(norm, heavy)

    found = F.flatten(F.transform(V.runs(F.col("_w"), lambda x: x["text_id"]), normalised_text))
    return docs.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.text_id", "f.word", "f.tfidf")


def characteristic_contrast(texts: DataFrame, targets: int = 1) -> DataFrame:
    """``(doc_id, word, score)``: idf times the ratio of target texts (the first ``targets``
    of a document) to background texts with the word, each plus one."""
    return _contrasted(staged(texts), targets).select("doc_id", "word", F.round("score", 6).alias("score"))


def _contrasted(texts: DataFrame, targets: int) -> DataFrame:
    seen = texts.select("doc_id", "text_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("word"))
    n = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    counts = seen.groupBy("doc_id", "word").agg(
        F.count(F.lit(1)).alias("df"), F.count_if(F.col("text_id") < targets).alias("t"), F.count_if(F.col("text_id") >= targets).alias("b")
    )
    score = (F.log(F.col("n") / F.col("df")) + 1) * (F.col("t") + 1) / (F.col("b") + 1)
    return counts.join(n, "doc_id").select("doc_id", "word", score.alias("score"))


def characteristic_filter(texts: DataFrame, targets: int = 1, each: int = 3, enough: float = 0.8, initial: float = 1.5, least: float = 0.5) -> DataFrame:
    """``(doc_id, text_id, kept, threshold, coverage)`` of the target texts: their words whose
    contrast score reaches a threshold that falls until enough texts keep ``each`` words.

    The threshold falls by a fifth of the share of texts without enough words, by 0.05 at
    least; the first one of greatest coverage counts. A text has enough words at every
    threshold up to its ``each``-th greatest score, so the walk needs one number a text.
    """
    aimed = lambda side: F.filter("ts", lambda x: (x["text_id"] < targets) == side)
    listed = F.transform(aimed(True), lambda x: F.struct(x["text_id"].alias("text_id"), F.filter(words(x["text"]), _is_term).alias("words")))
    docs = V.evaluated(_documents(texts), "_a", listed).where(F.size("_a") > 0)
    # Of all terms only those of the targets count; (word, side) are neighbours once sorted.
    docs = V.evaluated(docs, "_own", F.array_distinct(F.flatten(F.transform("_a", lambda x: x["words"]))))
    sided = lambda side: F.flatten(F.transform(aimed(side), lambda x: F.transform(F.array_intersect(terms(x["text"]), "_own"), lambda w: F.struct(w.alias("word"), F.lit(int(not side)).alias("b")))))
    docs = V.evaluated(docs, "_s", F.sort_array(F.concat(sided(True), sided(False)))).drop("ts", "_own")

    def scored(r: Column) -> Column:
        background = F.aggregate(F.slice("_s", r["at"], r["n"]), F.lit(0), lambda n, x: n + x["b"])
        return V.bound(background, lambda b: F.struct(F.get("_s", r["at"] - 1)["word"].alias("word"), ((F.log(F.col("n") / r["n"]) + 1) * (r["n"] - b + 1) / (b + 1)).alias("score")))

    docs = V.evaluated(docs, "_scores", F.map_from_entries(F.transform(V.runs(F.col("_s"), lambda x: x["word"]), scored))).drop("_s", "n")
    placed = F.transform("_a", lambda x: F.struct(x["text_id"].alias("text_id"), F.transform(x["words"], lambda w: F.struct(w.alias("word"), F.round(F.col("_scores")[w], 9).alias("score"))).alias("words")))
    docs = V.evaluated(docs, "_p", placed).drop("_a", "_scores")
    best = F.transform("_p", lambda x: F.get(F.reverse(F.sort_array(F.transform(x["words"], lambda w: w["score"]))), F.lit(each - 1)))
    reach = V.evaluated(docs, "reach", F.filter(best, lambda x: x.isNotNull())).withColumn("n", F.size("_p"))

    def step(acc: Column, _: Column) -> Column:
        cover = F.size(F.filter(F.col("reach"), lambda x: x >= F.round(acc["t"], 9))) / F.col("n")

        def moved(c: Column) -> Column:
            better = c > acc["best"]
            return F.struct(
                (acc["t"] - F.greatest(0.2 * (1 - c), F.lit(0.05))).alias("t"),
                F.when(better, c).otherwise(acc["best"]).alias("best"),
                F.when(better, acc["t"]).otherwise(acc["at"]).alias("at"),
                (c >= enough).alias("done"),
            )

        return F.when(acc["done"] | (acc["t"] < least), acc).otherwise(V.bound(cover, moved))

    begin = F.struct(F.lit(initial).alias("t"), F.lit(-1.0).alias("best"), F.lit(initial).alias("at"), F.lit(False).alias("done"))
    most = F.sequence(F.lit(0), F.lit(round((initial - least) / 0.05) + 1))
    walked = V.evaluated(reach, "w", F.aggregate(most, begin, step)).select("doc_id", F.col("w.at").alias("threshold"), F.col("w.best").alias("coverage"), F.explode("_p").alias("p"))
    kept = F.array_join(F.transform(F.filter("p.words", lambda w: w["score"] >= F.round("threshold", 9)), lambda w: w["word"]), " ")
    return walked.select("doc_id", "p.text_id", kept.alias("kept"), F.round("threshold", 6).alias("threshold"), F.round("coverage", 6).alias("coverage"))


def add_lemma_and_stem(keywords: DataFrame, lemma=F.lower, stem=F.lower) -> DataFrame:
    """Columns ``lemma`` and ``stem`` by the given column functions (or pandas UDFs)."""
    return keywords.withColumns({"lemma": lemma(F.col("word")), "stem": stem(F.col("word"))})


def contrast(keywords: DataFrame, positive: Column, negative: Column, encode: V.Encoder = V.encode_text) -> DataFrame:
    """Keywords nearer to ``positive`` than to ``negative`` (unit vectors), with the difference.
    With the built-in encoder a single word's vector has one bucket, so its similarity is what
    the other vector has there."""
    u = V.unit(encode(F.col("word")))

    def near(v: Column) -> Column:
        if encode is not V.encode_text:
            return V.similarity(u, v)
        return F.when(F.col("word").rlike(r"\A\S+\z"), F.round(F.get(v, V.bucket_of(F.lower("word"))), 9)).otherwise(V.similarity(u, v))

    return keywords.withColumn("score_diff", F.round(near(positive) - near(negative), 9)).where("score_diff > 0")


def in_text(keywords: DataFrame, texts: DataFrame) -> DataFrame:
    """Keywords that are a word of their document's text ``(doc_id, text)``, without case,
    words being parted by white space."""
    found = keywords.join(texts.select("doc_id", F.split(F.lower("text"), r"\s+", -1).alias("_w")), "doc_id")
    return found.where(F.array_contains("_w", F.lower("word"))).drop("_w")


def without_stop_words(keywords: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Keywords of two or more characters that are no stop words."""
    return keywords.where(~F.col("word").isin(*stop_words) & (F.length("word") > 1))


def deduplicate(keywords: DataFrame, keys: list[str]) -> DataFrame:
    """The record of greatest weight of every word, the first among equals."""
    w = Window.partitionBy(*keys, "word").orderBy(F.col("weight").desc(), "kw_idx")
    return keywords.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_batches(batches: DataFrame, chunks: DataFrame, stop_words: list[str] = STOP_WORDS, word: str = r"[\p{L}\p{N}_-]+") -> DataFrame:
    """Keywords ``(doc_id, batch, kw_idx, word, weight)`` that occur in their batch's text
    ``(doc_id, batch, text)``, are no stop words and longer than one character; the greatest
    weight of each word of a document. ``word`` matches a word of the text."""
    allowed = chunks.select("doc_id", "batch", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(word), F.lit(0)))).alias("word"))
    low = batches.withColumn("word", F.lower("word")).where(~F.col("word").isin(*stop_words) & (F.length("word") > 1))
    kept = low.join(allowed, ["doc_id", "batch", "word"], "left_semi")
    w = Window.partitionBy("doc_id", "word").orderBy(F.col("weight").desc(), "batch", "kw_idx")
    return kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# Attention words


def is_word_token(token: Column) -> Column:
    """No special token, no ``<...`` or ``...>``, not dots only."""
    return ~token.isin(*SPECIAL) & ~token.startswith("<") & ~token.endswith(">") & (F.regexp_replace(token, r"^\.+|\.+$", "") != "")


def word_scheme(tokens: Column, tokenizer: str = "") -> Column:
    """How sub-tokens make words: ``wordpiece`` if one is marked ``##`` or the tokenizer's
    class is named after BERT but not RoBERTa, else ``sentencepiece``."""
    name = tokenizer.lower()
    if "bert" in name and "roberta" not in name:
        return F.lit("wordpiece")
    return F.when(F.exists(tokens, lambda t: t.startswith("##")), "wordpiece").otherwise("sentencepiece")


def reduced_attention(weights: Column, segments: Column, context: int = 1) -> Column:
    """The weight of each context token from an attention tensor (layers x heads x from x to):
    the mean over layers, heads and from-positions. ``segments`` has each position's segment
    (null for special tokens); the others' weights go. Array of (pos, weight)."""
    rows = F.flatten(F.flatten(weights))
    share = lambda total, k: F.struct(k.alias("pos"), (total / F.size(rows)).alias("weight"))
    zeros = F.transform(segments, lambda _: F.lit(0.0))
    sums = F.aggregate(rows, zeros, lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y))
    return F.filter(F.transform(sums, share), lambda p: F.coalesce(F.get(segments, p["pos"]) == context, F.lit(False)))


def attention_words(rows: DataFrame, keys: list[str], tokenizer: str = "") -> DataFrame:
    """``(*keys, word_pos, word, weight)``: words put together from sub-tokens ``(*keys,
    tokens, weights)``, with the mean weight of an occurrence.

    In a sequence with ``##`` all other tokens start words; else ``Ġ`` and ``▁`` do. Marks
    are stripped, tokens without anything left are passed over; a first token without a
    mark starts a word too.
    """
    t = rows.where(F.size("tokens") == F.size("weights")).withColumn("scheme", word_scheme(F.col("tokens"), tokenizer))
    t = t.select(*keys, "scheme", F.posexplode(F.arrays_zip("tokens", "weights")).alias("pos", "x")).select(*keys, "scheme", "pos", "x.tokens", "x.weights")
    token = F.col("tokens")
    starts = F.when(F.col("scheme") == "wordpiece", ~token.startswith("##")).otherwise(token.startswith("Ġ") | token.startswith("▁"))
    clean = F.regexp_replace(F.regexp_replace(token, "^[Ġ▁]+", ""), "^##", "")
    clean = F.lower(F.regexp_replace(clean, "^[.,?!:;()\\[\\]{}\"']+|[.,?!:;()\\[\\]{}\"']+$", ""))
    t = t.withColumns({"starts": starts.cast("int"), "clean": clean}).where("clean <> ''")
    t = t.withColumn("word_pos", F.sum("starts").over(Window.partitionBy(*keys).orderBy("pos")))
    return t.groupBy(*keys, "word_pos").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "clean"))), lambda x: x["clean"]), "").alias("word"),
        F.sum("weights").alias("total"),
        F.count(F.lit(1)).alias("m"),
    )


def attention_rank(occurrences: DataFrame, keys: list[str], limit: int = 100) -> DataFrame:
    """``(*keys, place, word, weight)``: mean token weight of words over all their tokens."""
    means = occurrences.where(F.length("word") > 1).groupBy(*keys, "word").agg(F.round(F.sum("total") / F.sum("m"), 9).alias("weight"), F.min("word_pos").alias("at"))
    w = Window.partitionBy(*keys).orderBy(F.col("weight").desc(), "at")
    return means.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("at")


def legacy_attention_words(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The older rule: only ``Ġ`` starts a word, special tokens are out, a trailing dot goes;
    ``(*keys, word_pos, word, weight)`` with the mean weight of each occurrence."""
    t = rows.select(*keys, F.posexplode(F.arrays_zip("tokens", "weights")).alias("pos", "x")).select(*keys, "pos", "x.tokens", "x.weights")
    t = t.where(is_word_token(F.col("tokens")))
    clean = F.trim(F.replace("tokens", F.lit("Ġ"), F.lit(" ")))
    clean = F.lower(F.when(clean.endswith(".") & (F.length(clean) > 1), F.expr("substring(trim(replace(tokens, 'Ġ', ' ')), 1, length(trim(replace(tokens, 'Ġ', ' '))) - 1)")).otherwise(clean))
    t = t.withColumn("clean", clean).where("clean <> ''").withColumn("starts", F.col("tokens").startswith("Ġ").cast("int"))
    t = t.withColumn("word_pos", F.sum("starts").over(Window.partitionBy(*keys).orderBy("pos")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "clean"))), lambda x: x["clean"]), "")
    return t.groupBy(*keys, "word_pos").agg(F.regexp_replace(joined, r"\.$", "").alias("word"), F.round(F.sum("weights") / F.count(F.lit(1)), 9).alias("weight"))


def normalised(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weights that add up to one within each group."""
    return weights.withColumn("share", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy(*keys)), 9))


# Chunks by keywords


#: A letter, digit or underscore, and a border between one and what is none.
_W = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def term_pattern(terms: Column) -> Column:
    """A pattern of one document's terms: the first of the array that stands between borders
    of words. Terms may have several words, hyphens and other marks; there must be one. Where
    no term begins with the next character, nothing else is tried; where all terms begin (end)
    with a character of words, only the character before (after) is looked at."""
    escaped = lambda texts: F.transform(texts, lambda t: F.regexp_replace(t, r"([^\p{L}\p{N}_])", r"\\$1"))
    first = F.array_join(escaped(F.array_distinct(F.transform(terms, lambda t: F.substring(t, 1, 1)))), "")
    before = F.when(F.forall(terms, lambda t: t.rlike(rf"\A{_W}")), rf"(?<!{_W})").otherwise(_EDGE)
    after = F.when(F.forall(terms, lambda t: t.rlike(rf"{_W}\z")), rf"(?!{_W})").otherwise(_EDGE)
    return F.concat(F.lit("(?=["), first, F.lit("])"), before, F.lit("(?:"), F.array_join(escaped(terms), "|"), F.lit(")"), after)


def matches_of(text: Column, pattern: Column, terms: Column) -> Column:
    """Array of (start, word, k): the matches from left to right, which do not overlap, with
    their places and what ``terms`` has for them: a match begins where the matches and gaps
    before it end. The pattern goes over the text once and puts marks around its matches; a
    text that has the mark itself is gone over twice."""
    mark = "\x00"
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{mark}$0{mark}")), mark, -1)
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, word: F.array(gap, word))
    pieces = F.when(F.contains(text, F.lit(mark)), F.array_compact(F.flatten(both))).otherwise(marked)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,word:string,k:int>>").alias("found"))

    def folded(p: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            at, word = acc["at"] + F.length(F.get(p, i - 1)), F.get(p, i)
            hit = F.struct(at.alias("start"), word.alias("word"), terms[word].cast("int").alias("k"))
            return F.struct((at + F.length(word)).alias("at"), F.concat(acc["found"], F.array(hit)).alias("found"))

        return F.when(F.size(p) > 1, F.aggregate(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), start, step, lambda acc: acc["found"])).otherwise(start["found"])

    return V.bound(pieces, folded)


def grouped_keywords(keywords: DataFrame, case_sensitive: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, terms, kws, pattern)``: a document's keywords as an array, a map from terms
    (lemmas and stems) to positions in it, and the pattern of the terms in alphabetical order,
    so a term goes before the longer ones that it begins. Of a term with several keywords the
    last stands; empty terms are none. Columns ``kept`` are a document's, the same in its rows."""
    fold = (lambda c: c) if case_sensitive else F.lower
    listed = F.sort_array(F.collect_list(F.struct("kw_idx", "word", "weight", "score_diff", fold(F.col("lemma")).alias("lemma"), fold(F.col("stem")).alias("stem"))))
    placed = F.flatten(F.transform("kws", lambda k, i: F.array(F.struct(k["lemma"].alias("t"), i.alias("i")), F.struct(k["stem"].alias("t"), i.alias("i")))))
    # Equal terms are neighbours once sorted; the last of them has the last keyword.
    last = F.filter("_s", lambda x, i: (x["t"] != "") & F.coalesce(F.get("_s", i + 1)["t"] != x["t"], F.lit(True)))
    grouped = keywords.where("lemma is not null and stem is not null").groupBy("doc_id").agg(listed.alias("kws"), *(F.max(c).alias(c) for c in kept))
    grouped = V.evaluated(V.evaluated(grouped, "_s", F.sort_array(placed)), "_t", last).where(F.size("_t") > 0)
    return grouped.select("doc_id", *kept, F.map_from_entries("_t").alias("terms"), "kws", term_pattern(F.transform("_t", lambda x: x["t"])).alias("pattern"))


def matched_chunks(chunks: DataFrame, keywords: DataFrame, case_sensitive: bool = False, kept: tuple[str, ...] = (), places: bool = True) -> DataFrame:
    """Chunks with ``hits``: array of (start, word, k) for every match of a term, ``k`` being
    its keyword; without ``places``, of (word, k) for every distinct match, which is all that
    filters look at. A document's terms are one pattern (``term_pattern``), which is compiled
    once for its chunks. Matches are made once a chunk, and chunks are not broadcast."""
    low, terms = F.col("text") if case_sensitive else F.lower("text"), F.col("terms")
    if places:
        hits = matches_of(low, F.col("pattern"), terms)
    else:
        distinct = F.array_distinct(F.regexp_extract_all(low, F.col("pattern"), F.lit(0)))
        hits = F.transform(distinct, lambda word: F.struct(word.alias("word"), terms[word].cast("int").alias("k")))
    joined = chunks.join(grouped_keywords(keywords, case_sensitive, kept).hint("merge"), "doc_id")
    return V.evaluated(joined, "hits", hits).drop("terms", "pattern")


def filter_chunks(matched: DataFrame, minimum: int = 1) -> DataFrame:
    """Chunks with at least ``minimum`` distinct matched terms."""
    return matched.where(F.size(F.array_distinct(F.transform("hits", lambda h: h["word"]))) >= minimum)


def filter_chunks_by_word(matched: DataFrame, minimum: int = 1) -> DataFrame:
    """Chunks with at least ``minimum`` distinct keywords, found by lemma or stem."""
    return matched.where(F.size(F.array_distinct(F.transform("hits", lambda h: h["k"]))) >= minimum)


def filter_chunks_raw(chunks: DataFrame, keywords: DataFrame, minimum: int = 3) -> DataFrame:
    """Chunks with at least ``minimum`` distinct matches as written, found without case; a
    keyword goes before later ones."""
    words = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("kw_idx", "word"))), lambda k: k["word"]), lambda w: w != "")
    patterns = keywords.groupBy("doc_id").agg(words.alias("_t")).where(F.size("_t") > 0).select("doc_id", F.concat(F.lit("(?iu)"), term_pattern(F.col("_t"))).alias("pattern"))
    found = F.size(F.array_distinct(F.regexp_extract_all("text", F.col("pattern"), F.lit(0))))
    return V.evaluated(chunks.join(patterns.hint("merge"), "doc_id"), "found", found).where(F.col("found") >= minimum).drop("pattern")


def score_chunks(matched: DataFrame, ratio: Column | float = 0.5, minimum: int = 1, position: float = 0.3, frequency: float = 0.7, total: Column | None = None) -> DataFrame:
    """``score`` of chunks: weights of the distinct keywords, raised by early matches, their
    number and the share of keywords; ``matched``, the keywords in order, and
    ``keyword_scores``, each with its number of matches. A chunk without a match has no score."""
    if isinstance(ratio, (int, float)):
        if not 0 <= ratio <= 1:
            raise ValueError("ratio must be between 0 and 1")
        ratio = F.lit(float(ratio))
    n = F.size("hits")
    own = F.sort_array(F.array_distinct(F.transform("hits", lambda h: h["k"])))
    base = F.aggregate("own", F.lit(0.0), lambda s, k: s + F.col("kws")[k]["weight"] * ratio + F.col("kws")[k]["score_diff"] * (1 - ratio))
    early = V.bound(F.greatest(F.lit(1), F.length("text")), lambda whole: F.aggregate("hits", F.lit(0.0), lambda s, h: s + 1 - h["start"] / whole)) / n
    score = base * (1 + position * early) * (1 + frequency * F.log1p(n)) * (1 + F.size("own") / (F.size("kws") if total is None else total) * 0.5)
    rows = V.evaluated(matched.where(n > 0), "own", own).where(F.size("own") >= minimum)
    named = F.array_sort(F.transform("own", lambda k: F.struct(F.col("kws")[k]["word"].alias("word"), F.size(F.filter("hits", lambda h: h["k"] == k)).alias("n"))))
    return rows.withColumn("score", F.round(score, 6)).withColumn("keyword_scores", named).withColumn("matched", F.transform("keyword_scores", lambda x: x["word"])).drop("own", "hits", "kws")


def score_advanced(chunks: DataFrame, keywords: DataFrame, ratio: float = 0.5, minimum: int = 1, case_sensitive: bool = False) -> DataFrame:
    """``score_chunks`` with keywords told apart by their words: of several with one word the
    last one's weights count, and all count in the share of keywords found. Terms and texts
    are compared as written with ``case_sensitive``."""
    w = Window.partitionBy("doc_id", "word")
    last = keywords.withColumns({"_n": F.row_number().over(w.orderBy(F.col("kw_idx").desc())), "_all": F.count(F.lit(1)).over(Window.partitionBy("doc_id"))})
    matched = matched_chunks(chunks, last.where("_n = 1").drop("_n"), case_sensitive, ("_all",))
    return score_chunks(matched, ratio, minimum, total=F.col("_all")).drop("_all")


def score_density(matched: DataFrame, ratio: float = 0.5, minimum: int = 1) -> DataFrame:
    """``score`` of chunks: weights of distinct keywords, raised by their number against
    tokens and words."""
    own = F.sort_array(F.array_distinct(F.transform("hits", lambda h: h["k"])))
    k = F.size("own")
    base = F.aggregate("own", F.lit(0.0), lambda s, i: s + F.col("kws")[i]["weight"] * ratio + F.col("kws")[i]["score_diff"] * (1 - ratio))
    dense = 1 + k / F.greatest(F.lit(1.0), F.col("token_count") / 10)
    bonus = F.least(F.lit(2.0), 1 + k / F.greatest(F.lit(1.0), F.size(words(F.col("text"))) / 20))
    rows = V.evaluated(matched, "own", own).where((k > 0) & (k >= minimum))
    return rows.withColumn("score", F.round(base * dense * bonus, 6)).drop("own", "hits", "kws")

"""Language identification with a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes, its letter bigrams and trigrams, the word
itself, and the lexicons (words that the training sample has mostly in one language).
Emissions and transitions are learned together by gradient ascent on the likelihood of
chains of labelled words; part of the chains switch between languages. Forward-backward
gives each word of code-switched text its language distribution; a document's is the mean
over all its words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, arrow_schema, packed

#: Training documents of a language at most, and their greatest length.
SAMPLE_DOCS, SAMPLE_CHARS = 150, 20_000
#: Words of a chain; longer documents are several chains.
CHAIN = 128
#: Slots of hashed features.
SLOTS = 1 << 16
#: Words whose emissions a worker remembers.
REMEMBERED = 400_000

WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def features(word: str, lexicon: dict[str, int]) -> list[int]:
    """Slots of a word's affix, n-gram and lexicon features."""
    marked = f"<{word}>"
    named = [f"w{word}", *(f"p{word[:k]}" for k in (1, 2, 3)), *(f"s{word[-k:]}" for k in (1, 2, 3))]
    named += [marked[i : i + k] for k in (2, 3) for i in range(len(marked) - k + 1)]
    if word in lexicon:
        named.append(f"l{lexicon[word]}")
    return [zlib.crc32(x.encode()) % SLOTS for x in named]


class Crf:
    """Emission weights (slots x labels), transitions (labels x labels) and lexicon."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        self.labels, self.lexicon = labels, lexicon
        k = len(labels)
        self.emit = np.zeros((SLOTS, k), np.float32)
        self.step = np.zeros((k, k), np.float32)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, k), np.float32)

    def __getstate__(self):
        return {x: v for x, v in self.__dict__.items() if x not in ("known", "scores")}

    def __setstate__(self, state):
        self.__dict__ |= state | {"known": {}, "scores": np.zeros((0, len(state["labels"])), np.float32)}

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        slots = [features(w, self.lexicon) for w in words]
        return np.concatenate([np.array(s) for s in slots]), np.cumsum([0, *map(len, slots)])[:-1]

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)), np.float32)
        slots, at = self.flat(words)
        return np.add.reduceat(self.emit[slots], at, axis=0)

    def numbers(self, texts: list[list[str]]) -> np.ndarray:
        """Numbers of all words of a batch in ``scores``, which grows by the new ones."""
        if len(self.known) > REMEMBERED:
            self.known, self.scores = {}, self.scores[:0]
        known, new = self.known, []
        for words in texts:
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    new.append(w)
        if new:
            self.scores = np.concatenate([self.scores, self.word_scores(new)])
        return np.array([known[w] for words in texts for w in words], np.int64)

    def marginals(self, scores: np.ndarray, chain_of: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Label distributions of words by forward-backward; word i is at ``place[i]`` of
        chain ``chain_of[i]``."""
        k = scores.shape[1]
        n, t = int(chain_of[-1]) + 1, int(place.max()) + 1
        grid = np.ones((t, n, k), np.float32)
        grid[place, chain_of] = np.exp(scores - scores.max(axis=1, keepdims=True))
        real = np.zeros((t, n, 1), bool)
        real[place, chain_of] = True
        step = np.exp(self.step - self.step.max())
        forward = np.empty_like(grid)
        forward[0] = grid[0] / grid[0].sum(axis=1, keepdims=True)
        for i in range(1, t):
            x = (forward[i - 1] @ step) * grid[i]
            forward[i] = x / x.sum(axis=1, keepdims=True)
        backward = np.ones((n, k), np.float32)
        self.pairs = np.zeros((k, k))
        for i in range(t - 1, -1, -1):
            if i < t - 1:
                ahead = grid[i + 1] * backward
                if self.counting:
                    joint = forward[i][:, :, None] * step[None] * ahead[:, None, :]
                    joint /= joint.sum(axis=(1, 2), keepdims=True)
                    self.pairs += joint[real[i + 1, :, 0]].sum(axis=0)
                backward = np.where(real[i + 1], ahead @ step.T, 1)
                backward /= backward.sum(axis=1, keepdims=True)
            forward[i] *= backward
        found = forward[place, chain_of]
        return found / found.sum(axis=1, keepdims=True)

    counting = False

    def fit(self, chains: list[list[tuple[str, int]]], rounds: int = 30, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Adaptive gradient ascent on the mean log-likelihood of labelled chains."""
        vocabulary = sorted({w for c in chains for w, _ in c})
        number = {w: i for i, w in enumerate(vocabulary)}
        slots, at = self.flat(vocabulary)
        owner = np.repeat(np.arange(len(vocabulary)), np.diff([*at, len(slots)]))
        word = np.array([number[w] for c in chains for w, _ in c])
        label = np.array([y for c in chains for _, y in c])
        chain_of = np.repeat(np.arange(len(chains)), [len(c) for c in chains])
        place = np.concatenate([np.arange(len(c)) for c in chains])
        k = len(self.labels)
        gold = np.zeros((k, k))
        inner = np.flatnonzero(place > 0)
        np.add.at(gold, (label[inner - 1], label[inner]), 1)
        sums, step_sums, total = np.full_like(self.emit, 1e-8), np.full((k, k), 1e-8), len(word)
        self.counting = True
        for _ in range(rounds):
            scores = np.add.reduceat(self.emit[slots], at, axis=0)[word]
            error = -self.marginals(scores, chain_of, place)
            error[np.arange(total), label] += 1
            by_word = np.stack([np.bincount(word, error[:, j], len(vocabulary)) for j in range(k)], axis=1)
            gradient = np.stack([np.bincount(slots, by_word[owner, j], SLOTS) for j in range(k)], axis=1) / total - decay * self.emit
            sums += gradient**2
            self.emit += (rate * gradient / np.sqrt(sums)).astype(np.float32)
            gradient = (gold - self.pairs) / total - decay * self.step
            step_sums += gradient**2
            self.step += (rate * gradient / np.sqrt(step_sums)).astype(np.float32)
        self.counting = False


def held_out(doc_id="doc_id"):
    """Whether a document is kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame) -> dict[str, list[list[str]]]:
    """Words of up to ``SAMPLE_DOCS`` documents of each language, the first in order of a
    hash of doc_id among those not held out and not longer than ``SAMPLE_CHARS``."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 3 * SAMPLE_DOCS / n))))
    rank = F.xxhash64("doc_id")
    chosen = (
        usable.where((F.pmod(rank, F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000) & (F.length("text") <= SAMPLE_CHARS))
        .select("lang", "text", rank.alias("h"))
        .orderBy("h", "text")
        .limit(6 * SAMPLE_DOCS * len(counts))
    )
    found: dict[str, list[list[str]]] = defaultdict(list)
    for row in chosen.toLocalIterator():
        if len(found[row.lang]) < SAMPLE_DOCS and (words := words_of(row.text)):
            found[row.lang].append(words)
    return {lang: found[lang] for lang in sorted(found) if found[lang]}


def train(sample: dict[str, list[list[str]]], seed: int = 1) -> Crf | None:
    """The field for a sample of word lists by language; None without any."""
    if not sample:
        return None
    labels = list(sample)
    counts: dict[str, Counter[int]] = defaultdict(Counter)
    for y, lang in enumerate(labels):
        for words in sample[lang]:
            for w in words:
                counts[w][y] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in counts.items() if sum(c.values()) >= 3 and c.most_common(1)[0][1] >= 0.9 * sum(c.values())}
    rng = np.random.default_rng(seed)
    spans: list[list[tuple[str, int]]] = []
    for y, lang in enumerate(labels):
        for words in sample[lang]:
            i = 0
            while i < len(words):
                n = int(rng.integers(8, 64))
                spans.append([(w, y) for w in words[i : i + n]])
                i += n
    # Half of the chains take spans in random order and so switch languages.
    half = len(spans) // 2
    order = rng.permutation(len(spans))
    single, mixed = sorted(order[:half].tolist()), order[half:].tolist()
    chains: list[list[tuple[str, int]]] = []
    for listed, switching in ((single, False), (mixed, True)):
        held: list[tuple[str, int]] = []
        for i in listed:
            if held and (len(held) + len(spans[i]) > CHAIN or (not switching and held[-1][1] != spans[i][0][1])):
                chains.append(held)
                held = []
            held = held + spans[i]
        if held:
            chains.append(held)
    model = Crf(labels, lexicon)
    model.fit(chains)
    return model


RESULT = "doc_id long, held_out boolean, lang_pred string, score double, n_words long"


def _chains(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chain and place of the words of documents with ``sizes`` words."""
    place = np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else np.zeros(0, np.int64)
    own = (sizes + CHAIN - 1) // CHAIN
    first = np.concatenate([[0], np.cumsum(own)])[:-1]
    return np.repeat(first, sizes) + place // CHAIN, place % CHAIN


def label_words(model: Crf, words: list[str]) -> np.ndarray:
    """Language distributions of the words of one text."""
    if not words:
        return np.zeros((0, len(model.labels)))
    chain, place = _chains(np.array([len(words)]))
    return model.marginals(model.word_scores(words), chain, place)


def identify_languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, n_words)`` of every document's whole text.

    ``score`` is the mean probability of the predicted language over the words. Null texts
    and texts without a letter get ``und`` and 0; so do all where no document can be
    trained on. Repeated rows give a row each; an empty table gives an empty result; other
    columns are ignored. ``lang`` is only read for training.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    model = spark.sparkContext.broadcast(train(training_sample(docs)))
    schema = arrow_schema(spark, RESULT)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        crf = model.value
        for batch in batches:
            ids, held = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):  # about a million characters at once
                upto, size = at, 0
                while upto < len(texts) and size < 2_000_000:
                    size += len(texts[upto] or "")
                    upto += 1
                words = [[w for w in words_of(t) if w.isascii() or any(map(str.isalpha, w))] for t in texts[at:upto]]
                sizes = np.array([len(w) for w in words], np.int64)
                full = np.flatnonzero(sizes)
                means = np.zeros((len(sizes), 1))
                if crf is not None and len(full):
                    numbers = crf.numbers(words)
                    found = crf.marginals(crf.scores[numbers], *_chains(sizes[full]))
                    starts = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
                    means = np.zeros((len(sizes), found.shape[1]))
                    means[full] = np.add.reduceat(found.astype(np.float64), starts, axis=0) / sizes[full][:, None]
                best = means.argmax(axis=1)
                for i in range(upto - at):
                    some = crf is not None and sizes[i] > 0
                    yield {
                        "doc_id": ids[at + i],
                        "held_out": held[at + i],
                        "lang_pred": crf.labels[best[i]] if some else "und",
                        "score": min(1.0, float(means[i, best[i]])) if some else 0.0,
                        "n_words": int(sizes[i]),
                    }
                at = upto

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(lambda b: packed(rows(b), schema), RESULT)


WORD_RESULT = "doc_id long, place long, word string, lang string, score double"


def identify_words(docs: DataFrame) -> DataFrame:
    """``(doc_id, place, word, lang, score)``: the language of every word of every text, with
    its probability by forward-backward, for texts that switch languages.

    Words are runs of letters, lower-cased, numbered from 0. Training is as in
    ``identify_languages``; if no document can be trained on, words are ``und`` with 0.
    Null texts and texts without letters have no rows; equal probabilities give the first
    label; repeated rows give their words each; an empty table gives an empty result; other
    columns are ignored. A very long text is held as a whole, some hundred bytes a word.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    model = spark.sparkContext.broadcast(train(training_sample(docs)))
    schema = arrow_schema(spark, WORD_RESULT)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        crf = model.value
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w for w in words_of(text) if any(map(str.isalpha, w))]
                found = label_words(crf, words) if crf is not None else np.zeros((len(words), 1))
                for i, (w, p) in enumerate(zip(words, found)):
                    best = int(p.argmax())
                    yield {"doc_id": doc_id, "place": i, "word": w, "lang": crf.labels[best] if crf is not None else "und", "score": min(1.0, float(p[best]))}

    return docs.select("doc_id", "text").mapInArrow(lambda b: packed(rows(b), schema), WORD_RESULT)

"""Secret scans by grammar inference.

Patterns of fixed form find the base secrets. Their values, as labelled credentials, make
one prefix tree for each kind over character classes; states whose outgoing frequencies
are statistically compatible (Hoeffding bound, checked down the subtrees) are merged, in
breadth-first order, into a probabilistic automaton, to which the lengths of the values
belong. Every other candidate token is scored by its likelihood under the automata against a
chain over character classes, counted (with lengths) from the ordinary tokens of all
documents; tokens that a credential automaton explains better by a margin are reported too.

A token is of a format only if its automaton has seen each of its steps and has ended where
it ends; what neither has seen is no format. Both models give the same share, ``UNSEEN``, to
what they have not counted, so rare tokens do not gain from being rare.

The margin follows from a stated rate of false finds: of tokens that the ordinary model
makes, at most ``exp(-margin)`` reach it under one automaton (Markov's inequality for the
likelihood ratio), and no more than the sum of these under several.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, arrow_schema, giving_back, materialise, packed

KINDS = ("assign", "access", "hex")
#: Base patterns. Groups, lengths: a match counts if the group has that many characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{32,}")
HINTS = ("passw", "secret", "token", "api_key", "apikey")
#: Tokens that the automata judge: the values that ``ASSIGN`` takes, without outer dots.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{6,}[A-Za-z0-9+/_=-]")
#: What is judged of a token with dots that is no secret as a whole.
PIECE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")

#: Labelled credentials of a kind that are learned from at most, and characters of each.
SAMPLE, VALUE_CHARS = 2000, 256
#: Ordinary tokens that may be found, as a share, if the model of them holds.
FALSE_RATE = 1e-6
#: What an automaton must gain for each character, in nats, as the model of ordinary tokens
#: (one class of context) is a rough one and its errors add up over long tokens.
MARGIN_EACH = 0.75
#: Share of probability that either model spreads evenly over all steps, and over all lengths.
UNSEEN = 0.01


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of base matches, leftmost non-overlapping for each kind."""
    found = []
    low = text.lower()
    if any(x in low for x in HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # A run of hex digits is matched whole, so the long runs are the matches that count.
    found += [("hex", *m.span()) for m in HEX_LONG.finditer(text)]
    return found


def symbol(c: str) -> str:
    """Class of a character: hex letters, other letters by case, digits, punctuation."""
    if c.isdigit():
        return "9"
    if c in "abcdef":
        return "h"
    if c.islower():
        return "a"
    if c.isupper():
        return "A"
    return "-" if c in "-_" else "+"


CLASSES = str.maketrans({chr(i): symbol(chr(i)) for i in range(128)})


def steps(tokens: dict[str, int]) -> Counter[str]:
    """Steps ``class, next class`` of tokens with their numbers; a token starts at ``^`` and
    ends at ``$``. Lengths stand under ``#`` and the number."""
    found: Counter[str] = Counter()
    for token, n in tokens.items():
        found[f"#{min(len(token), VALUE_CHARS)}"] += n
        of = "^" + token.translate(CLASSES) + "$"
        for a, b in zip(of, of[1:]):
            found[a + b] += n
    return found


#: Characters of a class, which share its likelihood; a step goes to a class or to the end.
WIDTH = {"9": 10, "h": 6, "a": 20, "A": 26, "-": 2, "+": 3}
LOG_WIDTH = {c: math.log(n) for c, n in WIDTH.items()}
STEPS = len(WIDTH) + 1


def log_share(n: int, total: int, even: float) -> float:
    """Log of the share of a count, with ``UNSEEN`` (all, without counts) spread as ``even`` says."""
    return math.log((1 - UNSEEN) * n / total + UNSEEN * even if total else even)


class Automaton:
    """A probabilistic automaton merged from the prefix tree of ``samples``."""

    ALPHA = 0.05

    def __init__(self, samples: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.out: list[Counter[str]] = [Counter()]
        for s in samples:
            state = 0
            for c in map(symbol, s):
                self.out[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.out.append(Counter())
                state = self.next[state][c]
            self.out[state]["$"] += 1
        self.n, self.lengths = len(samples), Counter(min(len(s), VALUE_CHARS) for s in samples)
        self._merge()
        self.total = [sum(x.values()) for x in self.out]

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = sum(self.out[a].values()), sum(self.out[b].values())
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / self.ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(self.out[a][c] / n - self.out[b][c] / m) > bound for c in self.out[a].keys() | self.out[b].keys()):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree at ``b`` to state ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.out[a] += self.out[b]
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge(self) -> None:
        kept, frontier = [0], [(0, c) for c in sorted(self.next[0])]
        while frontier:
            parent, c = frontier.pop(0)
            state = self.next[parent][c]
            if state in kept:
                continue
            same = next((k for k in kept if self._compatible(k, state)), None)
            if same is None:
                kept.append(state)
                frontier += [(state, d) for d in sorted(self.next[state])]
            else:
                self.next[parent][c] = same
                self._fold(same, state)
                frontier += [(same, d) for d in sorted(self.next[same]) if self.next[same][d] not in kept]

    def score(self, token: str) -> float:
        """Log-likelihood of the characters, the end and the length; ``-inf`` for a token with
        a step or an end that was never seen."""
        state, total = 0, log_share(self.lengths[min(len(token), VALUE_CHARS)], self.n, 1 / VALUE_CHARS)
        for c in token.translate(CLASSES):
            if not self.out[state][c]:
                return -math.inf
            total += log_share(self.out[state][c], self.total[state], 1 / STEPS) - LOG_WIDTH[c]
            state = self.next[state][c]
        return total + log_share(self.out[state]["$"], self.total[state], 1 / STEPS) if self.out[state]["$"] else -math.inf


class Chain:
    """Likelihood of ordinary tokens: prefix trees merged by the last class, so that counts
    of steps add up over documents. Of steps without counts, half stay in their class, as
    words, numbers and rules do."""

    def __init__(self, counts: Counter[str]):
        even = lambda a, b: 1 / STEPS if a == "^" else 0.5 if a == b else 0.5 / (STEPS - 1)
        total: Counter[str] = Counter()
        for step, n in counts.items():
            total[step[0]] += n
        self.cost = {a + b: log_share(counts[a + b], total[a], even(a, b)) - LOG_WIDTH.get(b, 0.0) for a in "^9haA-+" for b in "9haA-+$"}
        self.lengths = [log_share(counts[f"#{n}"], total["#"], 1 / VALUE_CHARS) for n in range(VALUE_CHARS + 1)]

    def score(self, token: str) -> float:
        of = "^" + token.translate(CLASSES) + "$"
        return sum(self.cost[a + b] for a, b in zip(of, of[1:])) + self.lengths[min(len(token), VALUE_CHARS)]


def candidates(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """Tokens that overlap no span."""
    ordered, at, end = sorted((s, e) for _, s, e in spans), 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(ordered) and ordered[at][0] < m.end():
            end = max(end, ordered[at][1])
            at += 1
        if end <= m.start():
            yield m


def value_of(kind: str, matched: str) -> str:
    return ASSIGN.match(matched)[2] if kind == "assign" else matched


class Least:
    """The ``n`` distinct values of least hash among those added."""

    def __init__(self, n: int):
        self.n, self.bound = n, 1 << 64
        self.held: dict[str, int] = {}

    def add(self, value: str) -> None:
        h = xxhash.xxh3_64_intdigest(value)
        if h < self.bound and value not in self.held:
            self.held[value] = h
            if len(self.held) >= 4 * self.n:
                self._cut()

    def _cut(self) -> None:
        kept = sorted(self.held.items(), key=lambda x: (x[1], x[0]))[: self.n]
        self.held = dict(kept)
        if len(kept) == self.n:
            self.bound = kept[-1][1]

    def items(self) -> list[tuple[str, int]]:
        self._cut()
        return list(self.held.items())


def labelled_tokens(docs: DataFrame) -> dict[str, list[str] | Counter[str]]:
    """Values of base matches by kind, of each the ``SAMPLE`` first in order of a hash, and
    the ``steps`` of all ordinary tokens of all documents under ``word``."""
    spark = docs.sparkSession
    arrow_rows(spark)
    kind = "kind string, h string, value string, n long"
    schema = arrow_schema(spark, kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        least = {k: Least(SAMPLE) for k in KINDS}
        words: Counter[str] = Counter()
        walked: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                for k, s, e in spans:
                    least[k].add(value_of(k, text[s:e])[:VALUE_CHARS])
                words.update(m[0] for m in candidates(text, spans))
                if len(words) > 50_000:
                    walked += steps(words)
                    words.clear()
        walked += steps(words)
        for k, x in least.items():
            yield from ({"kind": k, "h": f"{h:016x}", "value": v, "n": 1} for v, h in x.items())
        yield from ({"kind": "word", "h": "", "value": v, "n": n} for v, n in walked.items())

    # The least of all are among the least of each task: a few thousand rows a task. Steps
    # are a few dozen.
    tokens = materialise(docs.select("text").mapInArrow(lambda b: packed(rows(b), schema), kind))
    found: dict[str, list[str] | Counter[str]] = {}
    for k in KINDS:
        part = tokens.where(F.col("kind") == k).distinct()
        found[k] = [r.value for r in part.orderBy("h", "value").limit(SAMPLE).collect()]
    found["word"] = Counter({r.value: r.n for r in tokens.where("kind = 'word'").groupBy("value").agg(F.sum("n").alias("n")).collect()})
    return found


class Grammar:
    """Automata of all kinds with data, and the chain of ordinary tokens (from these, or
    from their steps)."""

    def __init__(self, tokens: dict[str, list[str] | Counter[str]]):
        self.kinds = {k: Automaton(sorted(tokens[k])) for k in KINDS if len(tokens[k]) >= 10}
        word = tokens["word"]
        self.words = Chain(word if isinstance(word, Counter) else steps(Counter(word)))
        self.margin = math.log(max(len(self.kinds), 1) / FALSE_RATE)
        self.seen: dict[str, bool] = {}

    def gain(self, token: str) -> float:
        """Nats by which the best automaton explains a token better than the chain."""
        return max((a.score(token) for a in self.kinds.values()), default=-math.inf) - self.words.score(token)

    def is_secret(self, token: str) -> bool:
        if token not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            gain = self.gain(token)
            self.seen[token] = gain > self.margin and gain > MARGIN_EACH * len(token)
        return self.seen[token]

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans and added ones (kind ``format``), which overlap no base span."""
        base, more = base_spans(text), []
        for m in candidates(text, base):
            if self.is_secret(m[0]):
                more.append(("format", *m.span()))
            elif "." in m[0]:
                more += (("format", *p.span()) for p in PIECE.finditer(text, *m.span()) if self.is_secret(p[0]))
        return base, more


def joined(spans: list[tuple[str, int, int]]) -> str:
    rank = {k: i for i, k in enumerate((*KINDS, "format"))}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]])))


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of every document.

    Positions are code points, ends exclusive. Null text is empty. Repeated rows give a row
    each; an empty table gives an empty result; other columns are ignored. Texts are scanned
    whole, whatever their length; spans that start together are in order of their kinds. With
    fewer than ten labelled credentials of a kind, that kind has no automaton.
    """
    spark = docs.sparkSession
    grammar = spark.sparkContext.broadcast(Grammar(labelled_tokens(docs)))
    schema = arrow_schema(spark, RESULT)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, more = grammar.value.spans(text or "")
                n = Counter(k for k, _, _ in base)
                yield {
                    "doc_id": doc_id,
                    "n_assign": n["assign"],
                    "n_access": n["access"],
                    "n_hex": n["hex"],
                    "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
                    "spans": joined(base + more),
                }

    return docs.select("doc_id", "text").mapInArrow(lambda b: packed(rows(b), schema), RESULT)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with all found spans replaced by ``mark`` in ``text``; ``n_chars``, where
    there is such a column of whole numbers, follows. Spans that overlap are one.

    Null and empty texts, other columns (whatever their names) and all rows stay as they
    are; repeated rows are treated alike; long texts go through whole; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    counted = dict(docs.dtypes).get("n_chars") in ("tinyint", "smallint", "int", "bigint")
    grammar = spark.sparkContext.broadcast(Grammar(labelled_tokens(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [_redacted(grammar.value, t, mark) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if counted:
                n = batch.schema.get_field_index("n_chars")
                lengths = [None if t is None else len(t) for t in texts]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(lengths, batch.schema.field(n).type))
            yield batch

    # Null texts have no length, whatever the column allowed before.
    return docs.mapInArrow(giving_back(run), T.StructType([T.StructField(f.name, f.dataType, f.nullable or f.name == "n_chars", f.metadata) for f in docs.schema]))


def _redacted(grammar: Grammar, text: str | None, mark: str) -> str | None:
    if not text:
        return text
    base, more = grammar.spans(text)
    if not base and not more:
        return text
    out, at = [], 0
    for s, e in sorted((s, e) for _, s, e in base + more):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])

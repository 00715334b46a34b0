"""Quality classification by hierarchical empirical Bayes.

A logistic model on counts of bytes, words and lines gives each document's own evidence.
Grouped sums of the evidence (labels where known, else the model's probability) give hosts
and paths Beta posteriors: a path is shrunk towards its host, a host towards the whole,
each by a strength estimated from the spread between groups (method of moments). The
document's evidence is then combined, as log odds, with its path's posterior by the evidence
of the other documents there, so its own counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import BROADCAST_ROWS, _null_safe, arrow_rows, arrow_schema, broadcast_if_small, giving_back, join_spread, materialise

#: Labelled documents that the document model learns from at most.
SAMPLE = 4000
#: Groups of bytes whose shares are features.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#$%&*!@^~<>{}[]\\=+",
    "bar": b"|",
    "stop": b".,;:?'\"()-",
    "line": b"\n",
    "space": b" \t\r\x0b\x0c",
}
FEATURES = 12


def document_features(column: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` numbers for each text of an Arrow column."""
    data, ptr = bs.text_bytes(column)
    parts = [_features(data[ptr[i] : ptr[j]], ptr[i : j + 1] - ptr[i]) for i, j in bs.blocks(ptr)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


def _features(data: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    n = np.diff(ptr).astype(float)
    some = np.maximum(n, 1)
    out = []
    for members in CLASSES.values():
        flag = np.zeros(256, np.int32)
        flag[list(members)] = 1
        out.append(_sums(flag[data], ptr) / some)
    high = np.zeros(256, np.int32)
    high[0x80:] = 1
    out.append(_sums(high[data], ptr) / some)
    starts, ends, of = bs.words(data, ptr, bs.separators("space"))
    words = np.diff(of).astype(float)
    out += [np.log1p(words), n / np.maximum(words, 1)]
    out.append(_distinct(bs.word_hashes(data, starts, ends), of) / np.maximum(words, 1))
    newline = np.zeros(256, bool)
    newline[10] = True
    starts, ends, of = bs.words(data, ptr, newline)
    out.append(_distinct(bs.word_hashes(data, starts, ends), of) / np.maximum(np.diff(of), 1))
    return np.stack(out, axis=1)


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ptr]).astype(float)


def _distinct(hashes: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Number of distinct hashes in each range."""
    owner = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(ptr) - 1).astype(float)


class DocumentModel:
    """Ridge logistic regression on standardised features; without labels of both kinds,
    the labels' mean (or one half)."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        self.mean, self.scale, self.w = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1)
        self.w[-1] = _logit(self.base)
        if len(set(y.tolist())) < 2:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._design(x)
        ridge = np.eye(FEATURES + 1) * 1.0
        ridge[-1, -1] = 1e-6
        for _ in range(25):
            p = _sigmoid(z @ self.w)
            h = (z * (p * (1 - p))[:, None]).T @ z + ridge
            self.w += np.linalg.solve(h, z.T @ (y - p) - ridge @ self.w)

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.clip(_sigmoid(self._design(x) @ self.w), 1e-6, 1 - 1e-6)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logit(p):
    return np.log(p / (1 - p))


def known_labels(labels: DataFrame) -> DataFrame:
    """``(label_id, label)``: the mean quality of each labelled id."""
    some = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return some.groupBy(F.col("doc_id").alias("label_id")).agg(F.avg("quality").alias("label"))


def train_document_model(docs: DataFrame, labels: DataFrame) -> DocumentModel:
    """Learn from the ``SAMPLE`` labelled ids that come first by a hash. Repeated ids may
    give more rows than the sample has ids; of twice as many, the first by a hash of id and
    text count, so reruns agree."""
    arrow_rows(docs.sparkSession)
    chosen = known_labels(labels).orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE)
    kind = "h long, g long, x array<double>, y double"
    schema = arrow_schema(docs.sparkSession, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(document_features(batch.column(2)).tolist(), schema.field(2).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x, batch.column(3).cast(pa.float64())], schema=schema)

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    found = joined.select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("g"), "text", F.col("label").cast("double").alias("label")).mapInArrow(giving_back(run), kind)
    rows = found.orderBy("h", "g", "x", "y").limit(2 * SAMPLE).collect()
    x = np.array([r.x for r in rows]).reshape(len(rows), FEATURES)
    return DocumentModel(x, np.array([float(r.y >= 0.5) for r in rows]))


#: Private names, which no column of documents clashes with.
P, HOST, PATH, HOST_MEAN, PATH_MEAN, OWN, LABEL_ID, LABEL = (f"__lexiquarry_{x}" for x in ("p", "host", "path", "host_mean", "path_mean", "own", "label_id", "label"))


def _with_probability(frame: DataFrame, model) -> DataFrame:
    """``frame`` (with ``text``) and the document model's probability as column ``P``."""
    from pyspark.sql.types import DoubleType, StructType

    names = frame.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.probability(document_features(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*names, P])

    return frame.mapInArrow(giving_back(run), StructType([*frame.schema.fields]).add(P, DoubleType()))


def site_sums(evidence: DataFrame) -> tuple[DataFrame, float, float, float]:
    """``(host, path, n, s, hn, hs)`` from ``(host, path, e)`` rows: numbers and sums of the
    evidence of each path and of its host; then the mean of all, and the strengths of the
    priors of hosts and of paths.

    Strength of a prior: ``m (1 - m) / t - 1`` for the variance t between groups beyond
    what groups of their sizes have by chance; from 1 to 10,000.
    """
    paths = materialise(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    n, s = hosts.agg(F.coalesce(F.sum("hn"), F.lit(0)), F.coalesce(F.sum("hs"), F.lit(0.0))).first()
    m = min(max(s / n, 0.01), 0.99) if n else 0.5

    def strength(groups: DataFrame, n: Column, s: Column, mean: Column) -> float:
        spread = n * (F.pow(s / n - mean, 2) - mean * (1 - mean) / n)
        w, t = groups.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(spread), F.lit(0.0))).first()
        t = max(t / w, 1e-9) if w else 1.0
        return float(min(max(m * (1 - m) / t - 1, 1.0), 1e4))

    k1 = strength(hosts, F.col("hn"), F.col("hs"), F.lit(m))
    both = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "path", "n", "s", "hn", "hs")
    k2 = strength(both, F.col("n"), F.col("s"), (F.col("hs") + k1 * m) / (F.col("hn") + k1))
    return both, m, k1, k2


def posterior_means(n: Column, s: Column, hn: Column, hs: Column, own: Column, m: float, k1: float, k2: float) -> tuple[Column, Column]:
    """Means of a document's host and path by the evidence of the others there: the global
    mean is the host's prior, the host's mean the path's."""
    host = (hs - own + k1 * m) / (hn - 1 + k1)
    return host, (s - own + k2 * host) / (n - 1 + k2)


def _posterior(p: Column, path_mean: Column, base: float) -> Column:
    logit = lambda x: F.log(x / (1 - x))
    odds = logit(p) - F.lit(float(_logit(base))) + logit(F.least(F.greatest(path_mean, F.lit(0.001)), F.lit(0.999)))
    return 1 / (1 + F.exp(-odds))


#: Labels up to which they are broadcast; counted first.
LABEL_ROWS = 1_000_000


def _evidence(frame: DataFrame, known: DataFrame) -> DataFrame:
    """``frame`` with ``OWN``: the label of a document, else the model's probability."""
    return frame.join(known, F.col("doc_id") == F.col(LABEL_ID), "left").withColumn(OWN, F.coalesce(LABEL, P)).drop(LABEL_ID, LABEL)


def _with_sites(scores: DataFrame, sums: DataFrame, m: float, k1: float, k2: float) -> DataFrame:
    """``scores`` (with ``HOST``, ``PATH`` and ``OWN``) with the means of their sites. Sites
    are broadcast where they are counted to be few; else large sites are spread."""
    one = sums.select(F.col("host").alias(HOST), F.col("path").alias(PATH), *(F.col(c).alias(f"__site_{c}") for c in ("n", "s", "hn", "hs")))
    few = one.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = _null_safe(scores, F.broadcast(one), [HOST, PATH], "inner") if few else join_spread(scores, one.withColumn("__site_rows", F.col("__site_n")), [HOST, PATH], "__site_rows")
    means = posterior_means(*(F.col(f"__site_{c}") for c in ("n", "s", "hn", "hs")), F.col(OWN), m, k1, k2)
    return rows.withColumns({HOST_MEAN: means[0], PATH_MEAN: means[1]})


def _sited(frame: DataFrame, host: str, path: str) -> DataFrame:
    return frame.withColumns({HOST: F.col(host).cast("string"), PATH: F.col(path).cast("string")})


def _named(sums: DataFrame) -> DataFrame:
    return sums.select(F.col(HOST).alias("host"), F.col(PATH).alias("path"), F.col(OWN).alias("e"))


def classify_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """``(doc_id, p_doc, host_mean, path_mean, quality, keep)`` of every document.

    A site's path is the pair of columns ``host`` and ``path``. Null hosts and paths are
    groups of their own. Null and empty texts have all-zero counts and are judged so; very
    long texts are judged whole. A quality equal to ``threshold`` is kept. Labels that are
    null or of no document do not count; of repeated labels the mean does. Repeated rows
    give a row each and count each time in their sites; an empty table gives an empty
    result; without labels all documents have the same evidence. Other columns are ignored.
    """
    model = train_document_model(docs, labels)
    known = _private_labels(labels)
    frame = _sited(docs.select(*dict.fromkeys(["doc_id", "text", host, path])), host, path)
    scored = _with_probability(frame, docs.sparkSession.sparkContext.broadcast(model)).select("doc_id", HOST, PATH, P)
    scores = materialise(_evidence(scored, known))
    scores = _with_sites(scores, *site_sums(_named(scores)))
    quality = _posterior(F.col(P), F.col(PATH_MEAN), model.base)
    return scores.select(
        "doc_id", F.col(P).alias("p_doc"), F.col(HOST_MEAN).alias("host_mean"), F.col(PATH_MEAN).alias("path_mean"), quality.alias("quality"), (quality >= threshold).alias("keep")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``classify_quality`` keeps, with their columns, whatever
    their names; nulls, empty and long texts, ties and repeated rows are as there.

    The model goes over the texts twice, for the sums of sites and for the verdicts, so that
    no second copy of them is written or shuffled."""
    model = train_document_model(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    known = _private_labels(labels)
    slim = _sited(docs.select(*dict.fromkeys(["doc_id", "text", host, path])), host, path)
    sums = site_sums(_named(_evidence(_with_probability(slim, shared).select("doc_id", HOST, PATH, P), known)))
    scores = _with_sites(_evidence(_with_probability(_sited(docs, host, path), shared), known), *sums)
    return scores.where(_posterior(F.col(P), F.col(PATH_MEAN), model.base) >= threshold).select(*docs.columns)


def _private_labels(labels: DataFrame) -> DataFrame:
    known = known_labels(labels).select(F.col("label_id").alias(LABEL_ID), F.col("label").alias(LABEL))
    return broadcast_if_small(known, LABEL_ROWS)
